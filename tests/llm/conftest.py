import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and thing stone river morning light under over slowly carry window green paper kettle quiet orchard letter bridge".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    words = [draw.choice(WORDS) + draw.choice(["", "", "s", "ed", "er"]) + str(draw.randrange(40)) * (draw.random() < 0.3) for _ in range(n)]
    return "".join(w + (".\n" if i % 17 == 16 else " ") for i, w in enumerate(words)).strip()


@pytest.fixture(scope="session")
def texts():
    """Plain and odd texts: copies, near copies, nulls, empties, one long text, junk."""
    base = [prose(i, 30 + 7 * i) for i in range(24)]
    near = [base[3].replace("river", "lake", 1), base[5] + " indeed", base[20][:-3]]
    odd = [None, "", "   ", "\n\n", "a", "Á Éé ́x ΣΑΣ Σ", "a  b", "tab\there \n\nnew", "it's we'LL\x1cq \x85 w", "日本語のテキスト" * 30, "<|endoftext|> x  <|endoftext|>"]
    junk = ["###$$$ " * 30, "SHOUTING WORDS!! " * 20, "one two three four five six seven eight nine ten " * 9, "same line\n" * 30]
    licensed = ["CC-BY 4.0, cc by", "the GNU General Public License, version 2 or later. All rights reserved. all rights reserved"]
    return [*base, base[2], base[2], *near, *odd, *junk, *licensed, prose(99, 4000)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with gaps in their ids, a null id, a null source and one row twice."""
    rows = [(7 * i - 20, t, "en", f"s{i % 4}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, prose(7, 40), "en", "s9", None), rows[4]]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
