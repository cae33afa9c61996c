"""Fuzzy line dedup: one occurrence of every connected group of lines stays (operator 1).

Lines are compared by their words, lower-cased and joined by single spaces. Equal ones are one
node at once. SimHashes of the nodes meet under pigeonhole keys, and what lies within the radius
is verified by edit similarity. Built-in functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.blocks import FULL, bit_sums, block_keys, byte_majority, byte_sums, distance, majority
from tickloom.llm.common import cut, freed_shuffles, let, whole
from tickloom.llm.components import components

NOT_LETTERS = r"[^\p{L}\p{N}]+"
# The runs between those; the first two ranges only make it quick.
LETTERS = r"[a-z0-9\p{L}\p{N}]+"
# Buckets of up to this many SimHashes are paired; larger ones are keyed more finely. The last
# level leaves three blocks of four bits open, so no bucket can hold more than 4096.
BUCKET = 256
LEVELS = (5, 8, 16)
# Rows of some tens of bytes that may travel to every task; more are joined.
SMALL = 1_000_000


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), NOT_LETTERS, " "))


def _edits(a: str, b: str, bound: str, enough: str | None = None) -> Column:
    """Edit distance of two columns of words, -1 above the bound; or as many edits as are ``enough``.

    Most near copies have other words in some places. To replace these is no more than their
    longer lengths, and if that is ``enough`` (the bound, if not given) or fewer, it is the result:
    at least the distance, and no pair is lost or won by it.

    What both begin and end with costs no edits, so whole words of it are stripped first: the
    cost of the rest grows with the square of its length, and near copies leave little.
    """

    def replaced(x: Column, y: Column) -> Column:
        """Edits that put the words of one in the places of the other; null if they are not as many."""
        costs = F.zip_with(x, y, lambda v, w: F.when(v == w, 0).otherwise(F.greatest(F.length(v), F.length(w))))
        return F.when(F.size(x) == F.size(y), F.aggregate(costs, F.lit(0), lambda n, c: n + c))

    def shared(x: Column, y: Column) -> Column:
        """How many words both arrays begin with."""
        n = F.least(F.size(x), F.size(y))
        differ = F.array_position(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda v, w: v == w), False)
        return F.when(differ > 0, differ - 1).otherwise(n).cast("int")

    def rest(x: Column, y: Column, head: Column) -> Column:
        """Both arrays less their common beginning and end, as texts."""

        def less(tail: Column) -> Column:
            cut_of = lambda z: F.array_join(F.slice(z, head + 1, F.size(z) - head - tail), " ")
            return F.struct(cut_of(x).alias("x"), cut_of(y).alias("y"))

        left = lambda z: F.reverse(F.slice(z, head + 1, F.size(z) - head))
        return let(shared(left(x), left(y)), less)

    def least(w: Column) -> Column:
        stripped = let(shared(w["x"], w["y"]), lambda head: rest(w["x"], w["y"], head))
        return let(stripped, lambda r: _levenshtein(r["x"], r["y"], w["k"]))

    words = F.struct(F.split(a, " ").alias("x"), F.split(b, " ").alias("y"), F.expr(bound).alias("k"), F.expr(enough or bound).alias("e"))
    found = let(words, lambda w: let(replaced(w["x"], w["y"]), lambda n: F.when(n <= w["e"], n).otherwise(least(w))))
    return F.when(F.col(a) == F.col(b), 0).when(F.expr(f"abs(length({a}) - length({b})) > {bound}"), -1).otherwise(found)


# Edits tried first: the cost of a comparison grows with its bound, and most near copies are nearer than this.
FEW = 16


def _levenshtein(x: Column, y: Column, bound: Column) -> Column:
    """Edit distance of what is left of two texts, up to a bound that is a column; -1 above it.

    If nothing is left of one, the words of the other are put in with a space of theirs.
    """
    put = F.length(x) + F.length(y) + 1
    far = F.when(bound <= FEW, -1).otherwise(F.call_function("levenshtein", x, y, bound))
    near = let(F.call_function("levenshtein", x, y, F.least(bound, F.lit(FEW))), lambda d: F.when(d >= 0, d).otherwise(far))
    return F.when((x == "") | (y == ""), F.when(put <= bound, put).otherwise(-1)).otherwise(near)


def _bound(a: str, b: str, similarity: float) -> str:
    """The most edits that leave two columns similar: a share of the longer one."""
    return f"CAST(floor({1 - similarity:.6f}D * greatest(length({a}), length({b})) + 1e-9D) AS INT)"


def _lines(docs: DataFrame) -> DataFrame:
    """Every line that has a letter or digit: its place and its words.

    ``row`` tells apart rows that are equal in key and text.
    """
    split = docs.withColumn("row", F.monotonically_increasing_id()).select("doc", "print", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = F.regexp_extract_all(F.lower("line"), F.lit(LETTERS), F.lit(0))
    return split.select("doc", "print", "row", "pos", F.inline(F.array(F.struct(words.alias("words"))))).where(F.size("words") > 0)


def _nodes(lines: DataFrame) -> DataFrame:
    """Distinct lines: two independent hashes of the words, SimHash of the distinct words, first place.

    Bits are counted line by line where the lines are read: words are rows, and up to ``FULL`` of
    a line leave their task as eight sums. Only longer lines are put together from several rows.
    A word counts once a line, so that one which prevails does not decide alone.
    """
    # Rows of their own, so that a line is hashed once and not once a word.
    hashes = F.xxhash64("words").alias("node"), F.xxhash64(F.lit("again"), "words").alias("other")
    hashed = lines.select("doc", "print", "row", "pos", F.inline(F.array(F.struct(*hashes, F.array_distinct("words").alias("distinct")))))
    line = ["node", "other", "doc", "print", "row", "pos"]
    size = F.size("distinct")
    slices = F.transform(F.sequence(F.lit(1), size, F.lit(FULL)), lambda i: F.slice("distinct", i, FULL))
    parts = hashed.select(*line, size.alias("size"), F.posexplode(F.when(size <= FULL, F.array("distinct")).otherwise(slices)).alias("part", "distinct"))
    word = parts.select(*line, "size", "part", F.explode("distinct").alias("word")).withColumn("h", F.xxhash64("word"))
    counted = word.groupBy(*line, "part").agg(F.count("h").alias("n"), F.max("size").alias("size"), *byte_sums(F.col("h")))
    at = lambda sim: F.struct("doc", "print", "pos", sim.alias("sim")).alias("first")
    short = counted.where("n = size").select("node", "other", at(byte_majority(F.col("n"))))
    long_ = counted.where("n < size").groupBy(*line).agg(F.max("size").alias("size"), *bit_sums()).select("node", "other", at(majority(F.col("size"))))
    first = short.unionByName(long_).groupBy("node", "other").agg(F.min("first").alias("first"))
    return first.select("node", "other", "first.sim", F.struct("first.doc", "first.print", "first.pos").alias("at"))


def _sim_pairs(sims: DataFrame, radius: int) -> DataFrame:
    """Pairs of SimHashes within the radius: ``s < t``, each once."""
    found, here = None, sims
    for blocks in LEVELS:
        last = blocks == LEVELS[-1]
        keyed = here.select(F.explode(block_keys(F.col("sim"), radius, blocks)).alias("key"), "sim")
        live = cut(keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1"))
        small = live if last else live.where(F.col("n") <= BUCKET)
        a, b = small.select("key", F.col("sim").alias("s")), small.select("key", F.col("sim").alias("t"))
        close = a.join(b, (a["key"] == b["key"]) & (F.col("s") < F.col("t")) & (distance(F.col("s"), F.col("t")) <= radius))
        pairs = close.select("s", "t").distinct()
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            break
        hot = live.where(F.col("n") > BUCKET)
        if hot.isEmpty():
            break
        here = cut(hot.select("sim").distinct())
    return cut(found.distinct())


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The words of the given nodes, read again at their first places."""
    wanted = cut(nodes.groupBy(F.col("at.doc").alias("d"), F.col("at.print").alias("p")).agg(F.collect_list(F.struct(F.col("at.pos").alias("pos"), "node", "sim")).alias("of")))
    few = (wanted.agg(F.sum(F.size("of"))).first()[0] or 0) <= SMALL
    both = docs.join(F.broadcast(wanted) if few else wanted, F.col("doc").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")))
    # A text is parted once, however many of its lines are wanted.
    found = let(
        F.split("text", "\n"),
        lambda lines: F.transform("of", lambda x: F.struct(x["node"].alias("node"), x["sim"].alias("sim"), x["pos"].alias("pos"), normalised(F.get(lines, x["pos"])).alias("words"))),
    )
    rows = both.select("doc", "print", F.inline(found))
    return rows.select("node", "sim", F.struct("doc", "print", "pos").alias("at"), "words").dropDuplicates(["node"])


def _led(members: DataFrame, similarity: float) -> DataFrame:
    """Every node with a leader of the same SimHash: ``node, leader, d`` (edits that suffice between them).

    The first line of a SimHash leads those similar to it; of the others the first leads next,
    and so on until all are led. Nothing is paired within a group.
    """
    led, open_ = None, members
    while True:
        first = open_.groupBy("sim").agg(F.min_by(F.struct("node", "words"), "at").alias("first"))
        d = _edits("words", "lead", _bound("words", "lead", similarity))
        tried = open_.join(first, "sim").select("node", "sim", "at", "words", F.col("first.node").alias("leader"), F.col("first.words").alias("lead"))
        tried = cut(tried.select("node", "sim", "at", "words", "leader", d.alias("d")))
        now = tried.where("d >= 0").select("node", "leader", "sim", "words", "d")
        led = now if led is None else led.unionByName(now)
        open_ = tried.where("d < 0").select("node", "sim", "at", "words")
        if open_.isEmpty():
            return led


def _edges(led: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Links between the groups of leaders, besides those of members to their own.

    Leaders of close SimHashes are compared: first each with one other, then those pairs that
    this leaves unconnected, so that a dense group costs a comparison a member and not one a
    pair. Where leaders are too far apart themselves but their members might still meet (by the
    triangle inequality on edit distances), the members of the two groups are compared.
    """
    groups = led.groupBy("leader").agg(F.max("d").alias("reach"), F.max(F.length("words")).alias("longest"))
    heads = cut(led.where("node = leader").select("leader", "sim", "words").join(groups, "leader"))
    ids = heads.select("leader", "sim")
    same = ids.groupBy("sim").count().where("count > 1").select(F.col("sim").alias("s"), F.col("sim").alias("t"))
    left, right = ids.select(F.col("leader").alias("a"), F.col("sim").alias("s")), ids.select(F.col("leader").alias("b"), F.col("sim").alias("t"))
    met = cut(pairs.unionByName(same).join(left, "s").join(right, "t").where("s != t OR a < b").select("a", "b").distinct())

    def compared(some: DataFrame) -> DataFrame:
        """``a, b, d, own``: pairs within reach of each other, their edits and the bound on them."""
        one = heads.select(F.col("leader").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("words", "reach", "longest")])
        two = heads.select(F.col("leader").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("words", "reach", "longest")])
        bound = F.floor((1 - similarity) * F.greatest("a_longest", "b_longest") + 1e-9)
        near = some.join(one, "a").join(two, "b").withColumn("limit", (F.col("a_reach") + F.col("b_reach") + bound).cast("int"))
        near = near.where("abs(length(a_words) - length(b_words)) <= limit")
        own = _bound("a_words", "b_words", similarity)
        found = near.select("a", "b", _edits("a_words", "b_words", "limit", own).alias("d"), F.expr(own).alias("own"))
        return cut(found).where("d >= 0")

    star = met.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    tried = compared(star)
    roots = components(tried.where("d <= own").select("a", "b"))
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    open_ = met.join(star, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    open_ = open_.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    tried = tried.unionByName(compared(open_))
    first = led.select(F.col("leader").alias("a"), F.col("node").alias("x"), F.col("words").alias("x_words"))
    second = led.select(F.col("leader").alias("b"), F.col("node").alias("y"), F.col("words").alias("y_words"))
    members = tried.where("d > own").select("a", "b").join(first, "a").join(second, "b")
    one_by_one = members.where(_edits("x_words", "y_words", _bound("x_words", "y_words", similarity)) >= 0).select(F.col("x").alias("a"), F.col("y").alias("b"))
    own = led.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    return own.unionByName(tried.where("d <= own").select("a", "b")).unionByName(one_by_one)


def _lost(docs: DataFrame, nodes: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Places of distinct lines that are not the first of their group of similar lines."""
    sims = nodes.groupBy("sim").count()
    pairs = _sim_pairs(sims.select("sim"), radius)
    involved = reduce(DataFrame.unionByName, [sims.where("count > 1").select("sim"), pairs.select(F.col("s").alias("sim")), pairs.select(F.col("t").alias("sim"))])
    members = cut(_texts(docs, nodes.join(involved.distinct(), "sim", "left_semi")))
    led = cut(_led(members, similarity))
    rooted = components(_edges(led, pairs, similarity))
    placed = members.select("node", "at").join(rooted, "node")
    first = placed.groupBy("root").agg(F.min("at").alias("first"))
    return placed.join(first, "root").where("at != first").select("at")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and ``n_lines``, ``n_removed`` (longs).

    Lines (parted by ``\\n``) are linked if their words are equal, or if their SimHashes differ by
    at most ``radius`` bits and one less the edit distance over the longer length is at least
    ``similarity``. Of every connected group the occurrence with the smallest key (null first)
    and then the earliest in its text stays. Lines without letters or digits always stay. A text
    that loses all its lines becomes empty; null stays null with 0 lines; rows equal in key and
    text are one document to this operator and come out alike; an empty table stays empty; input
    columns named like new ones are replaced.

    Occurrences of a line meet as one row a task and line, without their text. Texts are shuffled
    once, to meet their lists of kept places; texts of candidate lines are read again where they
    first stand. Every step that later ones reuse is written to the shared folder.
    """
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    slim = docs.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(whole(F.col(f"`{text}`"))).alias("print"), whole(F.col(f"`{text}`")).alias("text"))
    with freed_shuffles(docs.sparkSession):
        nodes = cut(_nodes(_lines(slim)))
        lost = _lost(slim, nodes, similarity, radius)
    marked = nodes.select("at.*", F.lit(True).alias("stays")).unionByName(lost.select("at.*", F.lit(False).alias("stays")))
    listed = marked.groupBy(F.col("doc").alias("__doc"), F.col("print").alias("__print")).agg(
        F.collect_list(F.when(F.col("stays"), F.col("pos"))).alias("__first"), F.collect_list(F.when(~F.col("stays"), F.col("pos"))).alias("__lost")
    )
    print_ = F.xxhash64(whole(F.col(f"`{text}`")))
    both = docs.select(*[F.col(f"`{c}`") for c in kept_columns]).join(listed, F.col(f"`{key}`").eqNullSafe(F.col("__doc")) & (print_ == F.col("__print")), "left")

    def rebuilt(lines: Column) -> Column:
        blank = F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(r"[\p{L}\p{N}]"), i)), lambda i: i.isNotNull())
        places = F.array_sort(F.array_union(blank, F.array_except(F.coalesce("__first", F.array().cast("array<int>")), F.coalesce("__lost", F.array().cast("array<int>")))))
        return let(
            places,
            lambda p: F.struct(
                F.array_join(F.transform(p, lambda i: F.get(lines, i)), "\n").alias("text"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(p)).cast("long").alias("n_removed"),
            ),
        )

    made = both.select("*", F.inline(F.array(let(F.split(whole(F.col(f"`{text}`")), "\n"), rebuilt))).alias("__text", "n_lines", "n_removed"))
    is_null = F.col(f"`{text}`").isNull()
    columns = [F.when(~is_null, F.col("__text")).alias(c) if c == text else F.col(f"`{c}`") for c in kept_columns]
    return made.select(*columns, F.when(is_null, 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.when(is_null, 0).otherwise(F.col("n_removed")).cast("long").alias("n_removed"))
