import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm.token_counts import Counter, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def wanted():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)


@pytest.mark.parametrize(("huge", "chunk", "overlap"), [(32_768, 16_384, 512), (60, 40, 2), (10, 7, 1)])
def test_counts_equal_the_library_whatever_the_chunks(texts, wanted, huge, chunk, overlap):
    count = Counter(PATH, huge, chunk, overlap, memo=50)
    assert [count(t or "") for t in texts] == [wanted(t) for t in texts]


def test_a_text_without_white_space_widens_to_its_end(wanted):
    count = Counter(PATH, 100, 50, 4)
    text = "語" * 900 + " ab " + "x" * 700
    assert count(text) == wanted(text)


def test_rows_nulls_and_clashing_names(docs, empty, wanted):
    rows = count_tokens(docs.withColumnRenamed("n_chars", "n_tokens"), PATH).collect()
    assert len(rows) == docs.count()
    assert all(r["n_tokens"] == wanted(r["text"]) for r in rows)
    assert count_tokens(empty, PATH, carry=["doc_id"]).collect() == []
