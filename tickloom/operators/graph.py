"""Dependency graphs as edge tables: reachability, impact, cycles, independent support.

Traversals start with a few plain rounds, which join only the frontier with the edges; most
graphs of claims end there. What is deeper is finished by path doubling, so rounds grow with the
logarithm of the longest path. Every round cuts lineage to the shared checkpoint folder, so a
lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.session import Workspace, cut_lineage, shared, sided, workspace

#: Rounds that follow single edges before paths are doubled.
PLAIN_ROUNDS = 6
#: Walks are doubled while that joins at most this many rows an edge.
DOUBLED = 64
#: Supporters of a claim that are chosen at a time, where many of them collide.
BLOCK = 64
#: Collisions a supporter that are listed at a time, and the share of a claim's pairs that may collide for it.
LISTED, THIN = 2.0, 1 / 16
#: Correlates, and places of supporters, that a task holds at a time.
TILE, LISTS = 1 << 21, 1 << 20


def squared(paths: DataFrame) -> DataFrame:
    """(a, b): ends of walks of twice the length. A chain or a cycle keeps one row a node."""
    left = paths.select("a", F.col("b").alias("via"))
    return cut_lineage(left.join(paths.select(F.col("a").alias("via"), "b"), "via").select("a", "b").distinct())


def reach(edges: DataFrame, starts: DataFrame, forward: bool = True, plain: int = PLAIN_ROUNDS) -> DataFrame:
    """(start, node, depth): everything reachable from each start, itself excluded, by the shortest path.

    ``edges`` is (src, dst); ``starts`` is (start). After ``plain`` rounds of single edges, walks
    of 1, 2, 4, ... edges are added to all that is known: every distance is a sum of these, so what
    is known reaches twice as far after each round, and rounds stop when nothing new appears.
    Nodes that every start has been led past take no part in doubling.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    e = shared(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    seen = cut_lineage(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    frontier, depth = seen.select("start", "node"), 0
    while depth < plain:
        depth += 1
        step = frontier.join(e, frontier["node"] == e["a"]).select("start", F.col("b").alias("node")).distinct()
        fresh = cut_lineage(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            return seen.where("depth > 0")
        seen = seen.unionByName(fresh)
        frontier = fresh.select("start", "node")
    # A node at this depth or more lies behind the frontier: paths between nodes that every start has passed are not needed.
    passed = seen.where(F.col("depth") < depth).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    passed = passed.where(F.col("n") == starts.distinct().count()).select(F.col("node").alias("a"))
    paths = cut_lineage(e.join(passed, "a", "left_anti"))
    n, length = seen.count(), 1
    while True:
        led = seen.select("start", F.col("node").alias("a"), F.col("depth").alias("before")).join(paths, "a")
        led = led.select("start", F.col("b").alias("node"), (F.col("before") + length).alias("depth"))
        seen = cut_lineage(seen.unionByName(led).groupBy("start", "node").agg(F.min("depth").alias("depth")))
        before, n = n, seen.count()
        if n == before:
            return seen.where("depth > 0")
        paths, length = squared(paths), 2 * length


def impact(depends: DataFrame, supports: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): what rests on a node, and what it is cited as supporting."""
    back = reach(depends, starts, forward=False).select("start", "node")
    ahead = reach(supports, starts, forward=True).select("start", "node")
    return back.unionByName(ahead).distinct()


def _surely_cyclic(edges: DataFrame, nodes: int) -> DataFrame:
    """(node): nodes whose walk along one chosen edge a node never ends; these reach a cycle.

    One row a node: the walk of every node is doubled, twice a round, until it is longer than there are nodes.
    """

    def doubled(walk):
        return walk.join(walk.select(F.col("a").alias("b"), F.col("b").alias("to")), "b").select("a", F.col("to").alias("b"))

    walk, length = cut_lineage(edges.groupBy(F.col("src").alias("a")).agg(F.min("dst").alias("b"))), 1
    while length <= nodes:
        walk, length = cut_lineage(doubled(doubled(walk))), 4 * length
    return walk.select(F.col("a").alias("node"))


def _squaring(paths: DataFrame) -> int:
    """Rows that :func:`squared` joins before it drops repeats."""
    into = paths.groupBy(F.col("b").alias("via")).agg(F.count(F.lit(1)).alias("x"))
    outof = paths.groupBy(F.col("a").alias("via")).agg(F.count(F.lit(1)).alias("y"))
    return into.join(outof, "via").agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0


def cyclic_edges(edges: DataFrame, plain: int = PLAIN_ROUNDS) -> DataFrame:
    """(src, dst): edges from whose end a cycle can be reached; none exactly if the graph is acyclic.

    Walks along one edge a node settle most nodes of a graph with many cycles; only edges out of
    the others stay open. Rounds then settle nodes with an edge into a settled one and drop edges
    into nodes without outgoing edges. If chains are longer than ``plain`` rounds, walks over what
    is left are doubled until they have as many edges as there are nodes: only a node that reaches
    a cycle begins so long a walk. Walks are doubled only while that joins at most ``DOUBLED``
    times as many rows as there are edges; where graphs are denser, rounds go on.
    """
    whole = cut_lineage(edges.select("src", "dst").distinct())
    sure = _surely_cyclic(whole, whole.select("src").distinct().count())
    left = cut_lineage(whole.join(sure.select(F.col("node").alias("src")), "src", "left_anti"))
    n, rounds, dense = left.count(), 0, False
    while n:
        led = cut_lineage(left.join(sure.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct())
        sure = sure.unionByName(led)
        rest = left.join(led.select(F.col("node").alias("src")), "src", "left_anti")
        alive = left.select(F.col("src").alias("dst")).distinct()
        left = cut_lineage(rest.join(alive, "dst", "left_semi").select("src", "dst"))
        before, n, rounds = n, left.count(), rounds + 1
        if n == before:
            sure = sure.unionByName(left.select(F.col("src").alias("node")))
            break
        if n and rounds >= plain and not dense:
            if (long := _long_walks(left, sure, DOUBLED * n)) is None:
                dense = True
            else:
                sure = sure.unionByName(long)
                break
    return whole.join(sure.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def _long_walks(left: DataFrame, sure: DataFrame, limit: int) -> DataFrame | None:
    """(node): where walks of ``left`` begin that are longer than it has nodes or end in ``sure``; None beyond ``limit``."""
    ends = left.select("dst").distinct().join(sure.select(F.col("node").alias("dst")), "dst", "left_semi")
    nodes = left.select("src").distinct().count()
    stays = ends.select(F.col("dst").alias("a"), F.col("dst").alias("b"))
    paths, length = left.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(stays), 1
    while length <= nodes:
        if _squaring(paths) > limit:
            return None
        paths, length = squared(paths), 2 * length
    return paths.select(F.col("a").alias("node")).distinct()


def _tiles(correlated: DataFrame, threshold: float, work: Workspace) -> tuple[DataFrame, DataFrame, int, int]:
    """Nodes dealt into parts, and who correlates with whom by pairs of parts.

    (node, part, at), their number, the number of parts, and (i, j, x, ys): the places ``ys`` in
    part ``j`` of all that correlate with the node at place ``x`` of part ``i``. A pair of parts
    holds about ``TILE`` correlates.
    """
    pairs = work.written("pairs", correlated.where((F.abs("r") >= threshold) & (F.col("a") != F.col("b"))).select("a", "b"))
    parts = max(1, round((2 * pairs.count() / TILE) ** 0.5 + 0.5))
    dealt = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))
    names = work.written("names", dealt.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("node")) - 1))
    n = names.count()
    placed = pairs
    for end, part, at in (("a", "i", "x"), ("b", "j", "y")):
        placed = placed.join(sided(names.select(F.col("node").alias(end), F.col("part").alias(part), F.col("at").alias(at)), n), end)
    placed = placed.select("i", "j", "x", "y")
    both = placed.unionByName(placed.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("y").alias("x"), F.col("x").alias("y")))
    tiles = work.written("tiles", both.groupBy("i", "j", "x").agg(F.collect_set("y").alias("ys")), "i")
    work.drop("pairs")
    return names, tiles, n, parts


def _ragged(table: pa.Table, name: str, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where the lists of a column begin and end, and their flat elements, one array a field of the elements."""
    chunk = table.column(name).combine_chunks()
    flat = chunk.values
    return chunk.offsets.to_numpy(), [(flat.field(f) if f else flat).to_numpy(zero_copy_only=False) for f in fields]


def _meetings(tile: pa.Table, early: pa.Table, late: pa.Table) -> Iterator[tuple]:
    """(row of ``early``, row of ``late``, places in their lists) for every claim with correlated members in both lists.

    ``early`` and ``late`` are (claim, list) over the two parts of the tile, one row a claim.
    """
    if not (tile.num_rows and early.num_rows and late.num_rows):
        return
    cut_e, (xs, _) = _ragged(early, "list", "at", "ord")
    cut_l, (ys, _) = _ragged(late, "list", "at", "ord")
    cut_t, (near,) = _ragged(tile, "ys", "")
    at = tile.column("x").to_numpy()
    row = np.full(max(at.max(), xs.max(initial=0)) + 1, -1, np.int64)
    row[at] = np.arange(len(at))
    place = np.full(max(near.max(initial=0), ys.max(initial=0)) + 1, -1, np.int64)
    other = {claim: r for r, claim in enumerate(late.column("claim").to_pylist())}
    for e, claim in enumerate(early.column("claim").to_pylist()):
        if (r := other.get(claim)) is None:
            continue
        rows = row[xs[cut_e[e] : cut_e[e + 1]]]
        known = np.flatnonzero(rows >= 0)
        if not len(known):
            continue
        starts, ends = cut_t[rows[known]], cut_t[rows[known] + 1]
        mine = ys[cut_l[r] : cut_l[r + 1]]
        place[mine] = np.arange(len(mine))
        met = place[np.concatenate([near[s:t] for s, t in zip(starts.tolist(), ends.tolist(), strict=True)])]
        place[mine] = -1
        if len(hit := np.flatnonzero(met >= 0)):
            yield e, r, known[np.searchsorted(np.cumsum(ends - starts), hit, "right")], met[hit]


def _dealt(tiles: DataFrame, i: int, others: range, early: DataFrame, late: DataFrame, groups: int):
    """Tiles of part ``i`` and ``others``, and lists (claim, part, list, ...) in them, grouped by part and share of the claims."""
    share = F.pmod(F.xxhash64("claim", F.lit(i)), F.lit(groups)).cast("int").alias("k")
    tile = tiles.where((F.col("i") == i) & (F.col("j") >= others.start)).select("j", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("k"), "x", "ys")
    every = F.explode(F.sequence(F.lit(others.start), F.lit(others.stop - 1))).alias("j")
    first = early.where(F.col("part") == i).select(every, share, F.lit(True).alias("early"), "claim", "list")
    rest = late.where(F.col("part") >= others.start).select(F.col("part").alias("j"), share, F.lit(False).alias("early"), *[c for c in late.columns if c != "part"])
    return tile.groupBy("j", "k").cogroup(first.unionByName(rest, allowMissingColumns=True).groupBy("j", "k"))


def _sides(lists: pa.Table) -> tuple[pa.Table, pa.Table]:
    early = lists.column("early")
    return lists.filter(early), lists.filter(pc.invert(early))


def _code(part: int, at: np.ndarray) -> np.ndarray:
    return (part << 32) + at.astype(np.int64)


def _collisions(lists: DataFrame, tiles: DataFrame, parts: int, groups: int, work: Workspace) -> DataFrame:
    """(claim, early, late, ord): correlated supporters of a claim, the earlier one first, as part << 32 + place."""
    claim, ord_ = lists.schema["claim"].dataType, lists.schema["list"].dataType.elementType["ord"].dataType
    schema = f"claim {claim.simpleString()}, early bigint, late bigint, ord {ord_.simpleString()}"

    def of(i: int):
        def run(key, tile: pa.Table, group: pa.Table) -> pa.Table:
            j, (first, rest) = key[0].as_py(), _sides(group)
            found = []
            if first.num_rows and rest.num_rows:
                cut_e, (xs, before) = _ragged(first, "list", "at", "ord")
                cut_l, (ys, after) = _ragged(rest, "list", "at", "ord")
                for e, r, a, b in _meetings(tile, first, rest):
                    a, b = a + cut_e[e], b + cut_l[r]
                    x, y, s, t = _code(i, xs[a]), _code(j, ys[b]), before[a], after[b]
                    # Within a part a pair is met from both ends.
                    ways = [(s < t, x, y, t)] + [(t < s, y, x, s)] * (i != j)
                    found += [(e, u[w], v[w], o[w]) for w, u, v, o in ways]
            many = [len(u) for _, u, _, _ in found]
            claims = first.column("claim").take(pa.array(np.repeat([f[0] for f in found], many).astype(np.int64)))
            flat = [np.concatenate([f[c] for f in found]) if found else [] for c in (1, 2, 3)]
            return pa.table([claims, pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64()), pa.array(flat[2], first.schema.field("list").type.value_type.field("ord").type)], names=["claim", "early", "late", "ord"])

        return run

    found = []
    for i in range(parts):
        steps = _dealt(tiles, i, range(i, parts), lists, lists, groups)
        found.append(work.written(f"collisions-{i}", steps.applyInArrow(of(i), schema)))
    return reduce(DataFrame.unionByName, found)


def _settled(collisions: DataFrame) -> DataFrame:
    """(claim, late): the discounted, of :func:`_collisions`; a claim's rows stream by in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gone = None, set()
        for batch in batches:
            out = []
            for r, (claim, early, late) in enumerate(zip(batch["claim"].to_pylist(), batch["early"].to_pylist(), batch["late"].to_pylist(), strict=True)):
                if claim != now:
                    now, gone = claim, set()
                if late not in gone and early not in gone:
                    gone.add(late)
                    out.append(r)
            yield batch.select(["claim", "late"]).take(pa.array(out, pa.int64()))

    inorder = collisions.repartition("claim").sortWithinPartitions("claim", "ord", "late")
    return inorder.mapInArrow(run, f"claim {collisions.schema['claim'].dataType.simpleString()}, late bigint")


def _discounted(lists: DataFrame, tiles: DataFrame, parts: int, groups: int, work: Workspace) -> DataFrame:
    """(claim, late) of the discounted, from all collisions of ``lists``."""
    return _settled(_collisions(lists, tiles, parts, groups, work))


def _without(lists: DataFrame, tiles: DataFrame, kept: DataFrame, parts: int, groups: int, work: Workspace) -> DataFrame:
    """(claim, part, list, out): who stays, and the places of those that correlate with an earlier one of ``kept``."""
    now = lists.select("claim", "part", "list", F.array().cast("array<int>").alias("out"))
    schema = now.select(F.col("part").alias("j"), "claim", "list", "out").schema

    def run(key, tile: pa.Table, group: pa.Table) -> pa.Table:
        first, rest = _sides(group)
        rest = rest.select(["j", "claim", "list", "out"])
        if not (first.num_rows and rest.num_rows):
            return rest
        cut_e, (_, before) = _ragged(first, "list", "at", "ord")
        cut_l, (ys, after) = _ragged(rest, "list", "at", "ord")
        met = np.zeros(len(ys), bool)
        for e, r, a, b in _meetings(tile, first, rest):
            a, b = a + cut_e[e], b + cut_l[r]
            met[b[before[a] < after[b]]] = True
        column = rest.column("list").combine_chunks()
        gone = np.concatenate([[0], np.cumsum(met)])
        stay = pa.ListArray.from_arrays(pa.array((cut_l - gone[cut_l]).astype(np.int32)), column.values.filter(pa.array(~met)))
        cut_o, (out,) = _ragged(rest, "out", "")
        many = np.diff(cut_o), np.diff(gone[cut_l])
        owner = np.concatenate([np.repeat(np.arange(len(many[0])), m) for m in many])
        flat = np.concatenate([out[cut_o[0] : cut_o[-1]], ys[met]])[np.argsort(owner, kind="stable")]
        outs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many[0] + many[1])]).astype(np.int32)), pa.array(flat.astype(np.int32)))
        return pa.table([rest.column("j"), rest.column("claim"), stay, outs], names=["j", "claim", "list", "out"])

    for i in range(parts):
        step = _dealt(tiles, i, range(parts), kept, now, groups).applyInArrow(run, schema)
        now = work.written("without", step.withColumnRenamed("j", "part"))
    return now


def independent_support(supports: DataFrame, correlated: DataFrame, threshold: float = 0.7, sparse: float | None = None) -> DataFrame:
    """(claim, node, ord, kept): whether a supporter stands apart from the kept ones before it.

    ``supports`` is (claim, node, ord); ``correlated`` is (a, b, r), undirected. A supporter is
    discounted if an earlier kept one of its claim correlates with it. Pairs of supporters are
    never joined with the correlated: nodes are dealt into parts, so that a task holds the
    correlates between two parts and the supporters in them of a share of the claims, as lists of
    numbers. Parts are gone through one after another, and what one leaves is deleted, so disk
    holds the lists a few times over, however many pairs are compared.

    A claim's first undecided supporters (16, 32, ``BLOCK``) are chosen in order from
    the collisions among them, and all that correlate with the newly kept leave before the next
    block. Where few pairs of a block collide, and a supporter should have fewer collisions than
    ``sparse`` (by default ``LISTED``), those of all that are left are listed and settled at once.
    """
    spark, sparse = supports.sparkSession, LISTED if sparse is None else sparse
    with workspace(spark) as work:
        names, tiles, n, parts = _tiles(correlated, threshold, work)
        # Who correlates with nobody stays, and so does who has no place in the order.
        dealt = supports.where(F.col("claim").isNotNull() & F.col("ord").isNotNull()).join(sided(names, n), "node").select("claim", "part", "at", "ord")
        once = dealt.repartition("claim", "part").groupBy("claim", "part", "at").agg(F.min("ord").alias("ord"))
        rest = work.written("rest", once.groupBy("claim", "part").agg(F.array_sort(F.collect_list(F.struct("ord", "at"))).alias("list")))
        gone, size = [], BLOCK // 4
        while True:
            claims, rows, pairs = _held(rest)
            if not rows:
                break
            groups = 1 + rows // (parts * LISTS)
            block, later = _first(rest, size, claims, work)
            _, some, within = _held(block)
            collisions = _collisions(block, tiles, parts, 1 + some // (parts * LISTS), work)
            density = collisions.count() / max(within, 1)
            if density <= THIN and density * pairs < sparse * rows:
                gone.append(work.written("last", _discounted(rest, tiles, parts, groups, work)))
                break
            dropped = work.written(f"gone-{len(gone)}", _settled(collisions))
            lost = dropped.groupBy("claim", _place("late")[0]).agg(F.collect_list(_place("late")[1]).alias("lost"))
            stay = F.filter("list", lambda x: ~F.array_contains(F.coalesce("lost", F.array().cast("array<int>")), x["at"]))
            kept = work.written("kept", block.join(lost, ["claim", "part"], "left").select("claim", "part", stay.alias("list")).where(F.size("list") > 0))
            left = _without(later, tiles, kept, parts, groups, work)
            gone.append(dropped)
            out = left.select("claim", F.explode("out").alias("at"), "part").select("claim", (F.shiftleft(F.col("part").cast("bigint"), 32) + F.col("at")).alias("late"))
            gone.append(work.written(f"gone-{len(gone)}", out))
            rest = work.written("rest", left.select("claim", "part", "list").where(F.size("list") > 0))
            size = min(2 * size, BLOCK)
        if not gone:
            return supports.select("claim", "node", "ord", F.lit(True).alias("kept"))
        out = cut_lineage(reduce(DataFrame.unionByName, gone).select("claim", *_place("late")).join(sided(names, n), ["part", "at"]).select("claim", "node", F.lit(False).alias("kept")))
    return supports.join(out, ["claim", "node"], "left").select("claim", "node", "ord", F.coalesce("kept", F.lit(True)).alias("kept"))


def _held(lists: DataFrame) -> tuple[int, int, float]:
    """How many claims have supporters in ``lists``, how many supporters, and how many pairs of these."""
    n = F.col("n")
    held = lists.groupBy("claim").agg(F.sum(F.size("list")).alias("n")).where(n > 0)
    return tuple(held.agg(F.count(F.lit(1)), F.coalesce(F.sum(n), F.lit(0)), F.sum(n * (n - 1) / 2)).first())


def _place(code: str) -> tuple[Column, Column]:
    return F.shiftright(code, 32).cast("int").alias("part"), F.col(code).bitwiseAND(2**32 - 1).cast("int").alias("at")


def _first(rest: DataFrame, size: int, claims: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The first ``size`` supporters of every claim, and the others, both as (claim, part, list)."""
    head = rest.select("claim", F.explode(F.slice("list", 1, size)).alias("e"), "part").select("claim", F.struct("e.ord", "part", "e.at").alias("e"))
    k = F.row_number().over(W.partitionBy("claim").orderBy("e"))
    last = head.withColumn("k", k).where(F.col("k") == size).select("claim", F.col("e").alias("last"))
    inside = lambda x: F.coalesce(F.struct(x["ord"], F.col("part"), x["at"]) <= F.col("last"), F.lit(True))
    parted = rest.join(sided(last, claims), "claim", "left").select("claim", "part", F.filter("list", inside).alias("block"), F.filter("list", lambda x: ~inside(x)).alias("later"))
    parted = work.written("parted", parted)
    return tuple(parted.select("claim", "part", F.col(c).alias("list")).where(F.size(c) > 0) for c in ("block", "later"))


def support_counts(chosen: DataFrame) -> DataFrame:
    """(claim, claimed, kept, discounted) of :func:`independent_support`."""
    kept = F.count_if("kept")
    return chosen.groupBy("claim").agg(F.count(F.lit(1)).alias("claimed"), kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("discounted"))


def contradictory_edges(edges: DataFrame) -> DataFrame:
    """(src, dst): pairs one node both supports and contradicts."""
    s = edges.where("kind = 'supports'").select("src", "dst").distinct()
    return edges.where("kind = 'contradicts'").select("src", "dst").distinct().join(s, ["src", "dst"], "left_semi")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes no edge touches."""
    touched = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return nodes.join(touched.distinct(), "node", "left_anti")
