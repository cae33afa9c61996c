"""Main text of web pages by wrappers inferred from the pages of a host (operator 4)."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import wrappers as W
from tickloom.llm.common import cut, whole

# Wrappers up to this many bytes together travel to every task; more are joined by salted host.
SMALL_WRAPPERS = 32 << 20
STREAMS_A_SALT = 2_000
PAGES_A_SALT = 20_000


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _streams(pages: DataFrame) -> DataFrame:
    """``host, stream, pages``: the distinct folded streams of every host, counted map-side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for host, page in zip(batch["host"].to_pylist(), batch["page"].to_pylist(), strict=True):
                seen[host, json.dumps(W.folded(W.parsed(page)[0])[0])] += 1
            columns = [pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["host", "stream", "pages"])

    found = pages.select("host", "page").mapInArrow(run, "host string, stream string, pages bigint")
    return found.groupBy("host", "stream").agg(F.sum("pages").alias("pages"))


def _fold(streams: DataFrame, keys: list[str]) -> DataFrame:
    """One wrapper for each key: the most frequent stream first, then one alignment after another."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = sorted(zip(rows["pages"].to_pylist(), rows["stream"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
        wrapper = reduce(W.merged, (json.loads(s) for _, s in order))
        columns = {k: [v.as_py()] for k, v in zip(keys, key, strict=True)}
        return pa.table(columns | {"stream": [json.dumps(wrapper)], "pages": [sum(n for n, _ in order)]}).cast(schema)

    kinds = {"host": pa.string(), "salt": pa.int32()}
    schema = pa.schema([*((k, kinds[k]) for k in keys), ("stream", pa.string()), ("pages", pa.int64())])
    ddl = ", ".join(f"{k} {'string' if k == 'host' else 'int'}" for k in keys) + ", stream string, pages bigint"
    return streams.groupBy(*keys).applyInArrow(run, ddl)


def infer(pages: DataFrame) -> DataFrame:
    """``host, stream, pages``: one wrapper for every host of ``pages`` (host, page).

    Streams of a host are aligned in salted shares first and their wrappers with each other then,
    so a host with a third of all pages is no single task; only distinct streams take part.
    """
    streams = cut(_streams(pages))
    most = streams.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-most // STREAMS_A_SALT))
    shares = streams.withColumn("salt", F.pmod(F.xxhash64("stream"), F.lit(salts)).cast("int"))
    return _fold(_fold(shares, ["host", "salt"]), ["host"]) if salts > 1 else _fold(streams, ["host"])


def _with_wrappers(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Pages beside their host's wrapper."""
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    if size <= SMALL_WRAPPERS:
        return pages.join(F.broadcast(wrappers), "host")
    salts = max(1, -(-(wrappers.agg(F.max("pages")).first()[0]) // PAGES_A_SALT))
    spread = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"]).drop("salt")


@lru_cache(maxsize=256)
def _loaded(wrapper: str) -> tuple[list, frozenset]:
    """The wrapper's items, and the slots known to be template or menus."""
    w = json.loads(wrapper)
    return w["items"], frozenset(w.get("drop", ()))


@lru_cache(maxsize=20_000)
def _labels(wrapper: str, tokens: tuple[str, ...]) -> list[int]:
    """The wrapper's slot of every block of a page with this token stream, -1 for none."""
    items, _ = _loaded(wrapper)
    stream, places = W.folded(list(tokens))
    at = {t: slot for slot, ts in zip(W.slots_of(items, stream), places, strict=True) for t in ts}
    return [at[t] for t, token in enumerate(tokens) if W.is_slot(token)]


def _statistics(pages: DataFrame) -> DataFrame:
    """Per host and slot: different pages, whether all hold the same text there, and its share in links.

    Pages that hold the same text in all blocks but noise are one page, however many copies of it
    there are: what copies share is no sign of a template.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page, wrapper in zip(batch["host"].to_pylist(), batch["page"].to_pylist(), batch["wrapper"].to_pylist(), strict=True):
                tokens, texts = W.parsed(page)
                slots: dict[int, list] = {}
                content = xxhash.xxh64_intdigest("\0".join(t for (t, _), (_, loose) in zip(texts, W.places_of(tuple(tokens)), strict=True) if loose)) >> 1
                for slot, text in zip(_labels(wrapper, tuple(tokens)), texts, strict=True):
                    slots.setdefault(slot, []).append(text)
                rows += [
                    (host, s, content, xxhash.xxh64_intdigest("\n".join(t for t, _ in held)) >> 1, sum(len(t) for t, _ in held), sum(n for _, n in held)) for s, held in slots.items() if s >= 0
                ]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["host", "slot", "content", "hash", "chars", "linked"])

    found = pages.select("host", "page", "wrapper").mapInArrow(run, "host string, slot int, content bigint, hash bigint, chars bigint, linked bigint")
    return found.groupBy("host", "slot").agg(
        F.count_distinct("content").alias("n"), (F.min("hash") == F.max("hash")).alias("same"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )


def wrappers_of(pages: DataFrame) -> DataFrame:
    """``host, wrapper, pages``: wrappers with the slots that are template or mostly links.

    Outside articles, a slot with one and the same text on at least three different pages is template, and
    one with over half of its text in links is a menu.
    """
    bare = cut(infer(pages).select("host", F.concat(F.lit('{"items": '), "stream", F.lit("}")).alias("wrapper"), "pages"))
    slots = _statistics(_with_wrappers(pages, bare))
    drop = slots.where((F.col("same") & (F.col("n") >= 3)) | (2 * F.col("linked") > F.col("chars")))
    listed = drop.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list("slot"))).alias("drop"))  # as long as a wrapper at most
    full = F.concat(F.substring("wrapper", 1, F.length("wrapper") - 1), F.lit(', "drop": '), F.coalesce("drop", F.lit("[]")), F.lit("}"))
    return cut(bare.join(listed, "host", "left").select("host", full.alias("wrapper"), "pages"))


def main_text(page: str, wrapper: str) -> str:
    """The blocks of a page that hold content: those of its article if it has any.

    The containers around a block on its own page say whether it is article or noise; its slot
    only says whether it is template or a menu, and a block without a slot is neither.
    """
    tokens, texts = W.parsed(page)
    places = W.places_of(tuple(tokens))
    chosen = [article for article, _ in places]
    if not any(chosen):
        _, drop = _loaded(wrapper)
        chosen = [loose and s not in drop for (_, loose), s in zip(places, _labels(wrapper, tuple(tokens)), strict=True)]
    return "\n".join(text for (text, _), keep in zip(texts, chosen, strict=True) if keep)


def extract(pages: DataFrame, page: str = "html", url: str = "url", carry: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text`` (the main text) and ``n_chars``, its code points.

    ``carry`` names the columns to return beside them (all but the page by default). Null and
    empty pages have the empty text; pages whose address is null or has no host share a wrapper;
    repeated rows keep their rows; an empty table stays empty; columns named like new ones are
    replaced. Pages are parsed whole, three times: for their streams, for what the slots hold and
    for the text; the first two leave one row for each distinct stream and each slot of a host.
    """
    carry = [c for c in (pages.columns if carry is None else carry) if c not in ("text", "n_chars") and (carry is not None or c != page)]
    held = {c: f"__c{i}" for i, c in enumerate(carry)}
    rows = pages.select(*[F.col(f"`{c}`").alias(h) for c, h in held.items()], host_of(F.col(f"`{url}`")).alias("host"), whole(F.col(f"`{page}`")).alias("page"))
    found = _with_wrappers(rows, wrappers_of(rows.select("host", "page")).select("host", "wrapper", "pages")).drop("pages")
    schema = "".join(f"`{h}` {pages.schema[c].dataType.simpleString()}, " for c, h in held.items()) + "text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, w) for p, w in zip(batch["page"].to_pylist(), batch["wrapper"].to_pylist(), strict=True)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch[h] for h in held.values()), *made], names=[*held.values(), "text", "n_chars"])

    out = found.select(*held.values(), "page", "wrapper").mapInArrow(run, schema)
    return out.withColumnsRenamed({h: c for c, h in held.items()})
