import json
import random
from functools import reduce

import pytest

from tests.llm.conftest import prose
from tickloom.llm import html_text
from tickloom.llm import wrappers as W

SCHEMA = "page_id bigint, url string, html string, text int"


def article(i):
    blocks = [f"Title {i} & more", *(prose(1000 * i + j, 25).replace("\n", " ") for j in range(1 + i % 4))]
    return blocks, f"<h1>Title {i} &amp; more</h1>" + "".join(f"<p>{b}\n</p>" for b in blocks[1:])


def tagged(i):
    """A site that names its article, with every kind of surroundings."""
    draw, (blocks, inner) = random.Random(i), article(i)
    menu = "".join(f"<li><a href='/{j}'>Menu {draw.randrange(99)}</a></li>" for j in range(draw.randrange(2, 6)))
    comments = "".join(f"<div class='comment'><p>Nice {draw.random()}</p></div>" for _ in range(draw.randrange(4)))
    advert = f"<div class=\"ad box\">Buy {draw.random()}</div>" if i % 3 else ""
    notice = "<div id='cookie-notice'>We use cookies <button>OK</button></div>" if i % 2 else ""
    html = (
        f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body><header>Site</header><nav><ul>{menu}</ul></nav>{notice}{advert}<!-- a > b -->"
        f"<article>{inner}<section class=comments>{comments}</section></article><aside><p>Other {i}</p></aside><form><p>Search {i}</p></form>"
        f"<script>var t='</p>';</script><footer>&copy; {i}</footer></body></html>"
    )
    return blocks, html


def untagged(i):
    """A site of plain boxes, where only the pages together tell template from text."""
    draw, (blocks, inner) = random.Random(i), article(i)
    links = "".join(f"<a href='/{j}'>Link {draw.randrange(99)}</a> " for j in range(4))
    return blocks, f"<html><body><div>Welcome to our site</div><div>{links}</div><div>{inner}</div><div>All content is ours. Contact us.</div></body></html>"


@pytest.mark.parametrize(("make", "salt", "small"), [(tagged, 2000, 1 << 25), (untagged, 2000, 1 << 25), (tagged, 2, 0)])
def test_articles_come_out_and_nothing_else(spark, monkeypatch, make, salt, small):
    monkeypatch.setattr(html_text, "STREAMS_A_SALT", salt)
    monkeypatch.setattr(html_text, "SMALL_WRAPPERS", small)
    monkeypatch.setattr(html_text, "PAGES_A_SALT", 5)
    made = [make(i) for i in range(30)]
    rows = [(i, f"https://WWW.site.example/{i}?q=1", h, 0) for i, (_, h) in enumerate(made)]
    found = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (blocks, _) in enumerate(made):
        assert found[i]["text"] == "\n".join(" ".join(b.split()) for b in blocks)
        assert found[i]["n_chars"] == len(found[i]["text"])


def test_nulls_empties_fragments_and_repeated_rows(spark):
    rows = [
        (1, None, None, 1),
        (2, "http://a.example/", "", 1),
        (3, None, "just words &lt;b&gt; &amp;amp; <b>bold</b>ly<br>next", 1),
        (3, None, "just words &lt;b&gt; &amp;amp; <b>bold</b>ly<br>next", 1),
        (4, "nonsense", "<article><p>open <i>ended", 1),
        (5, "http://b.example", "<p>a < b and c > d</p></div></nav><script>never closed", 1),
        (6, "http://b.example", "<div " * 2000, 1),
    ]
    found = html_text.extract(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r["page_id"], r["text"]) for r in found.collect())
    plain = (3, "just words <b> &amp; boldly next")
    assert got[:6] == [(1, ""), (2, ""), plain, plain, (4, "open ended"), (5, "a < b and c > d")]
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_folding_and_merging_keep_every_stream_within_the_wrapper():
    streams = [tagged(i)[1] for i in range(40)] + [untagged(i)[1] for i in range(5)]
    wrapper = W.folded(W.parsed(streams[0])[0])[0]
    for page in streams[1:]:
        wrapper = W.merged(wrapper, W.folded(W.parsed(page)[0])[0])
    for page in streams:
        tokens, texts = W.parsed(page)
        stream, places = W.folded(tokens)
        slots = W.slots_of(wrapper, stream)
        assert -1 not in slots
        assert sorted(t for ts in places for t in ts) == [i for i, t in enumerate(tokens) if W.is_slot(t)]
        assert len(slots) == len(places) and len(texts) == sum(map(len, places))


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<article><p>one</p><svg class=i/><p>two</p><p>three</p></article>", "one two three"),
        ("<article><p>one</p><div><button>OK</div><p>two</p></article><p>three</p>", "one two three"),
        ("<div><p>one</p><button>OK<div>no</div>no</div><p>two</p>", "one two"),
        ("<p>one</p><svg><g>no</g></svg><p>two<select><option>no</select></p>", "one two"),
        ("<html><head><title>no</title><p>one</p><p>two</p>", "one two"),
        ("<head><title>no</title><noscript><p>no</p></noscript></head><body><p>one</p>", "one"),
        ("<head><noscript><p>no</p><body><p>one</p>", "one"),
        ("<style-guide><p>one</p></style-guide><p>two</p><script>no", "one two"),
        ("<p>one</p><noscript><div><p>no</p></div></noscript><iframe src='x' /><p>two</p>", "one two"),
    ],
)
def test_hidden_elements_take_nothing_behind_them(page, wanted):
    assert " ".join(t for t, _ in W.parsed(page)[1]) == wanted


def test_copies_of_one_page_are_no_template(spark):
    """On a host of copies alone nothing is template; beside other pages only what those share."""
    one = "<div>Head line</div><div><p>First copy text</p><p>second</p></div><div>Foot line</div>"
    rows = [(i, "http://copies.example/", one, 0) for i in range(5)]
    rows += [(10 + i, f"http://mixed.example/{i}", untagged(i)[1], 0) for i in range(6)]
    optional = untagged(7)[1].replace("<h1>", "<blockquote>Only in these copies</blockquote><h1>")
    rows += [(20 + i, "http://mixed.example/copy", optional, 0) for i in range(4)]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[i] == "Head line\nFirst copy text\nsecond\nFoot line" for i in range(5))
    assert all(found[20 + i].startswith("Only in these copies\nTitle 7") for i in range(4))
    assert all("Welcome" not in t and "All content" not in t for i, t in found.items() if i >= 10)


def test_random_streams_lose_no_block_of_an_article():
    """Whatever the alignment of a page to its host's wrapper, all blocks of its article come out."""
    draw, unmatched = random.Random(4), 0
    kinds = [lambda: "<p>x" * draw.randrange(1, 4), lambda: "<h2>x", lambda: "<h1>x", lambda: "<ul>" + "<li>x" * draw.randrange(1, 4) + "</ul>", lambda: "<p>x<ul>" + "<li>x" * draw.randrange(1, 3) + "</ul>"]
    for _ in range(200):
        pages = ["<article>" + "".join(draw.choice(kinds)() for _ in range(draw.randrange(1, 7))) + "</article>" for _ in range(draw.randrange(2, 9))]
        streams = [W.folded(W.parsed(page)[0])[0] for page in pages]
        items = reduce(W.merged, streams)
        unmatched += sum(W.slots_of(items, s).count(-1) for s in streams)
        for page in pages:
            assert html_text.main_text(page, json.dumps({"items": items, "drop": []})).count("x") == page.count("x")
    assert unmatched > 0  # so some did without a slot


def test_groups_are_aligned_by_their_bodies():
    a, b = ["*", [["p", False], ["+ul", False], ["-ul", False]]], ["*", [["p", False]]]
    assert W._pairs([[b, False], [a, False]], [[a, False]]) == [(1, 0)]
