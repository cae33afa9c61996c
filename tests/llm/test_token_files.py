import tempfile
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tickloom.llm import token_files
from tickloom.llm.token_files import Part, PerfectHash

PATH = public_tokenizers.path("byte_bpe_50k.json")


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_numbers_are_a_permutation_and_foreign_keys_fail_the_fingerprint():
    draw = np.random.default_rng(3)
    keys = draw.integers(0, 2**63, 5000).astype(np.uint64)
    assert sorted(PerfectHash.build(keys).number(keys)) == list(range(5000))
    prints = (keys % np.uint64(2**31)).astype(np.int64)
    values = {k: np.arange(5000) for k in Part.NAMES} | {"print": prints}
    part = Part.load(Part.build(keys, values).dump())
    assert (part.look_up(keys, prints)["offset"] == np.arange(5000)).all()
    foreign = draw.integers(0, 2**63, 1000).astype(np.uint64)
    assert (part.look_up(foreign, np.full(1000, -7))["shard"] == -1).all()


def test_files_hold_the_ids_of_the_library_in_order(spark, docs):
    tokenizer, at = Tokenizer.from_file(PATH), folder()
    stored = token_files.write(docs.withColumnRenamed("source", "shard"), at, PATH, end_id=2)
    rows = token_files.read(spark, at, PATH, stored.select("key", "copy")).collect()
    sums = token_files.read_checksums(spark, at, PATH, stored.select("key", "copy")).collect()
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    ids = [[*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in order]
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    rows.sort(key=lambda r: r["start"])
    assert [r["key"] for r in rows] == [r["doc_id"] for r in order]
    assert [list(r["ids"]) for r in rows] == ids
    assert [r["start"] for r in rows] == starts
    crc = {r["start"]: r["ids_crc32"] for r in sums}
    assert [crc[s] for s in starts] == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]


def test_unknown_keys_and_empty_tables(spark, docs, empty):
    at = folder()
    token_files.write(docs, at, PATH, end_id=None)
    asked = spark.createDataFrame([(10**9, 0), (-20, 0), (-20, 5)], "key bigint, copy bigint")
    assert [(r["key"], r["copy"]) for r in token_files.read(spark, at, PATH, asked).collect()] == [(-20, 0)]
    nothing = folder()
    assert token_files.write(empty, nothing, PATH, end_id=2).collect() == []
    assert token_files.read(spark, nothing, PATH, asked).collect() == []


def test_units_over_line_ends_are_put_together_from_their_words():
    """Units seldom repeat over line ends: their words are remembered, they are not."""
    import array

    encode = token_files.Encoder(PATH)
    texts = ["one stop.\nAnother, word one.\nAnother", "a.\nb é.,\nÉa.. b ça,\n,a b", "I'm we'll.\nThey're x\n\ny x \ny\nA\n"]
    for t in texts:
        assert list(array.array(encode.code, encode(t))) == encode.tokenizer.encode(t, add_special_tokens=False).ids
    assert "stop." in encode.rest and "stop.\nAnother," not in encode.rest
