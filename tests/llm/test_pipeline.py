import corpus_pipeline as C
import public_tokenizers
import tiktoken

from tests.llm import brute
from tests.llm.conftest import prose
from tickloom.llm.byte_bpe import read_ranks

N = 60


def corpus(spark):
    rows = [(i, prose(i, 60 + i) if i % 7 else prose(3, 80), "en", f"s{i % 3}", 0) for i in range(N)]
    rows += [(N, None, "en", "s1", 0), (N + 1, "###$$$ " * 40, "en", "s1", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stages_equal_brute_force_one_after_another(spark):
    docs = corpus(spark)
    stages = dict(C.STAGES)
    kept = stages["quality rules"](spark, docs, "").cache()
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(N))
    lined = stages["line dedup"](spark, kept, "").cache()
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    wanted = brute.deduped(rows)
    assert sorted((r["doc_id"], r["text"]) for r in lined.collect()) == [(k, w) for (k, _), w in zip(rows, wanted, strict=True)]
    assert all(r["n_chars"] == len(r["text"]) for r in lined.collect())
    single = stages["near-dedup"](spark, lined, "").cache()
    ids = [k for k, _ in rows]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(brute.components(ids, [brute.simhash(w) for w in wanted])))
    mixed = stages["source mix"](spark, single, "").cache()
    assert mixed.columns == docs.columns
    counts = {}
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert max(counts.values()) <= 2 and set(counts) <= {r["doc_id"] for r in single.collect()}
    encoded = stages["byte-level BPE"](spark, mixed, "").collect()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    assert len(encoded) == mixed.count()
    assert all(list(r["ids"]) == own.encode_ordinary(texts[r["doc_id"]]) for r in encoded)


def test_run_is_the_stages_in_order(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs = corpus(spark)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = lambda r: (r["doc_id"], r["ids_sha256"])
    assert sorted(map(key, C.run(spark, str(tmp_path)).collect())) == sorted(map(key, docs.collect()))


def test_empty_documents_run_through(spark, tmp_path):
    corpus(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).collect() == []
