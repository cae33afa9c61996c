import hashlib

import public_tokenizers
import tiktoken

from tickloom.llm.byte_bpe import ByteBpe, encode, read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_ids_equal_the_library_and_decode_to_the_text(texts):
    bpe, own = ByteBpe(PATH, public_tokenizers.PATTERN, memo=40), library()
    for t in [*(t or "" for t in texts), " \n x", "a \n", "don't 12 345 ***  ...\n\n\n  y", "é   z", "Ünï.\nNew,x"]:
        ids = bpe.encode(t)
        assert ids.tolist() == own.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()
        assert bpe.written(ids).decode() == " ".join(map(str, ids.tolist()))


def test_columns_nulls_and_clashing_names(docs, empty):
    own = library()
    rows = encode(docs.withColumnRenamed("n_chars", "ids"), PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["text"] or ""
        assert list(r["ids"]) == own.encode_ordinary(text)
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert encode(empty, PATH, public_tokenizers.PATTERN).collect() == []
