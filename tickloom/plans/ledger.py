"""Registry, document and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import graph as G
from tickloom.operators import ledger as L
from tickloom.plans.oracle import over
from tickloom.registry import query
from tickloom.session import cut_lineage, freed_shuffles
from tickloom.sources import market


def entries(spark, sf_dir):
    """Batch entries from the part table: a hypothesis, its declared and run counts, a ratio."""
    t = market.table(spark, sf_dir, "part")
    fam = market.trials(spark, sf_dir).select(F.col("trial_id").alias("doc"), "hypothesis", "family", "verdict")
    n = t.select(
        F.col("p_partkey").alias("doc"), (F.col("p_size") % 5 + 1).alias("trial_count"), (F.col("p_size") % 3 + 1).alias("run_count"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice") / 2000).alias("dsr"),
    )
    return fam.join(n, "doc")


_ENT = """WITH en AS (SELECT t.trial_id AS doc, hypothesis, family, verdict, p_size % 5 + 1 AS trial_count, p_size % 3 + 1 AS run_count, CASE WHEN p_size % 3 = 0 THEN p_retailprice / 2000 END AS dsr FROM trials t JOIN part p ON t.trial_id = p.p_partkey)"""


@query("trial_expansion", "M1", over("trials", _ENT + """,
 b AS (SELECT *, coalesce(sum(trial_count) OVER (ORDER BY doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM en),
 x AS (SELECT *, unnest(range(1, trial_count + 1)) AS seq FROM b)
SELECT CAST(before + seq AS BIGINT) AS trial_id, CASE WHEN trial_count > 1 THEN hypothesis || '#' || seq ELSE hypothesis END AS hypothesis, family, verdict, seq <= run_count AS ran, R6(CASE WHEN seq = 1 THEN dsr END) AS dsr FROM x
UNION ALL SELECT CAST((SELECT sum(trial_count) FROM en) + i AS BIGINT), 'UNALLOCATED#' || i, 'unallocated', 'inconclusive', TRUE, NULL FROM (SELECT unnest(range(1, CAST(greatest(6100 - (SELECT sum(trial_count) FROM en), 0) + 1 AS BIGINT))) AS i) q"""))
def trial_expansion(spark, sf_dir):
    """Batches into numbered trials, with the claimed remainder made visible."""
    return L.expand_batches(entries(spark, sf_dir), claimed=6100)


@query("range_expansion", "S11 M14", """
WITH n AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'PHASE' || p_size ELSE 'H' || p_partkey || '-H' || (p_partkey + p_size % 4) END AS name, p_partkey AS lo, p_partkey + p_size % 4 AS hi, p_size FROM part)
SELECT name, CASE WHEN p_size % 3 = 0 THEN name ELSE 'H' || k END AS expanded FROM (SELECT *, unnest(CASE WHEN p_size % 3 = 0 THEN [lo] ELSE range(lo, hi + 1) END) AS k FROM n) x""")
def range_expansion(spark, sf_dir):
    p = market.table(spark, sf_dir, "part")
    key, span = F.col("p_partkey"), F.col("p_size") % 4
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("PHASE"), "p_size")).otherwise(F.concat(F.lit("H"), key, F.lit("-H"), key + span))
    return L.expand_ranges(p.select(name.alias("name")))


@query("trial_search", "M2 S8", over("trials", """
SELECT trial_id, hypothesis, family, verdict, CASE WHEN contains(lower(hypothesis), 'ring') THEN 'hypothesis' WHEN contains(lower(family), 'ring') THEN 'family' ELSE 'evidence' END AS matched_on
FROM trials WHERE contains(lower(hypothesis), 'ring') OR contains(lower(family), 'ring') OR contains(lower(evidence), 'ring')"""))
def trial_search(spark, sf_dir):
    return L.search(market.trials(spark, sf_dir), " Ring ").select("trial_id", "hypothesis", "family", "verdict", "matched_on")


@query("trial_kill_rates", "M3 S8", over("trials", """
SELECT split_part(family, '.', 1) AS prefix, count(*) AS trials, count(*) FILTER (WHERE verdict IN ('killed', 'rejected', 'noise')) AS dead, R6(avg(CASE WHEN verdict IN ('killed', 'rejected', 'noise') THEN 1.0 ELSE 0.0 END)) AS kill_rate FROM trials GROUP BY 1"""))
def trial_kill_rates(spark, sf_dir):
    return L.kill_rates(L.in_family(market.trials(spark, sf_dir), "info").unionByName(L.in_family(market.trials(spark, sf_dir), "strategy")))


@query("trial_graveyard", "M3 G14", over("trials", """
SELECT verdict, count(*) AS trials, verdict IN ('killed', 'rejected', 'noise') AS dead FROM trials WHERE verdict <> 'inconclusive' GROUP BY verdict"""))
def trial_graveyard(spark, sf_dir):
    """Dead and surviving trials by verdict."""
    t = market.trials(spark, sf_dir)
    both = L.graveyard(t).withColumn("dead", F.lit(True)).unionByName(L.survivors(t).withColumn("dead", F.lit(False)))
    return both.groupBy("verdict", "dead").agg(F.count(F.lit(1)).alias("trials"))


@query("trial_summary", "M4", over("trials", """
SELECT count(*) AS registered, count(DISTINCT family) AS families, count(*) FILTER (WHERE verdict IN ('killed', 'rejected', 'noise')) AS dead, count(*) FILTER (WHERE verdict IN ('signal', 'candidate')) AS alive,
 R6(avg(CASE WHEN verdict IN ('killed', 'rejected', 'noise') THEN 1.0 ELSE 0.0 END)) AS kill_rate FROM trials"""))
def trial_summary(spark, sf_dir):
    return L.summary(market.trials(spark, sf_dir))


@query("strategy_trials", "M4 K1", over("trials", _ENT + """
SELECT doc AS trial_id, hypothesis, family, R6(dsr) AS dsr FROM en WHERE starts_with(family, 'strategy') AND dsr IS NOT NULL"""))
def strategy_trials(spark, sf_dir):
    """Strategy trials with a published ratio, newest first."""
    e = entries(spark, sf_dir).where(F.startswith("family", F.lit("strategy")) & F.col("dsr").isNotNull())
    return e.select(F.col("doc").alias("trial_id"), "hypothesis", "family", "dsr").orderBy(F.col("trial_id").desc())


@query("family_contradictions", "M5 J12", over("trials", """
WITH l AS (SELECT * FROM trials WHERE verdict IN ('signal', 'candidate')), d AS (SELECT * FROM trials WHERE verdict IN ('killed', 'rejected', 'noise'))
SELECT l.family, count(DISTINCT l.trial_id) AS live, count(DISTINCT d.trial_id) AS dead, count(*) AS pairs FROM l JOIN d ON l.family = d.family AND split_part(l.hypothesis, '#', 1) <> split_part(d.hypothesis, '#', 1) GROUP BY l.family"""))
def family_contradictions(spark, sf_dir):
    return L.contradictions(market.trials(spark, sf_dir))


@query("contradiction_sides", "M5 J12", over("trials", """
WITH s AS (SELECT family, CASE WHEN verdict IN ('signal', 'candidate') THEN 'live' WHEN verdict IN ('killed', 'rejected', 'noise') THEN 'dead' END AS side, trial_id FROM trials)
SELECT * FROM s WHERE side IS NOT NULL AND family IN (SELECT family FROM s WHERE side = 'live') AND family IN (SELECT family FROM s WHERE side = 'dead')"""))
def contradiction_sides(spark, sf_dir):
    return L.contradiction_sides(market.trials(spark, sf_dir))


@query("ceiling_violations", "M6", over("trials", """
WITH t AS (SELECT p_partkey AS trial_id, CASE p_size % 4 WHEN 0 THEN 'exploratory' WHEN 1 THEN 'confirmatory' WHEN 2 THEN 'replication' ELSE 'stress' END AS protocol, p_size % 8 AS maturity, CASE WHEN p_size % 5 = 0 THEN p_retailprice / 2000 END AS dsr, CASE WHEN p_size % 10 = 0 THEN 65 END AS nt FROM part),
 c AS (SELECT *, CASE protocol WHEN 'exploratory' THEN 1 WHEN 'confirmatory' THEN 4 WHEN 'replication' THEN 5 ELSE 6 END AS ceiling FROM t)
SELECT trial_id, protocol, maturity, ceiling, maturity > ceiling AS over_ceiling, (dsr IS NULL) <> (nt IS NULL) AS unpaired_dsr FROM c WHERE maturity > ceiling OR (dsr IS NULL) <> (nt IS NULL)"""))
def ceiling_violations(spark, sf_dir):
    size = F.col("p_size")
    t = market.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("trial_id"),
        F.when(size % 4 == 0, "exploratory").when(size % 4 == 1, "confirmatory").when(size % 4 == 2, "replication").otherwise("stress").alias("protocol"),
        (size % 8).alias("maturity"), F.when(size % 5 == 0, F.col("p_retailprice") / 2000).alias("dsr"), F.when(size % 10 == 0, 65).alias("dsr_n_trials"),
    )
    return L.ceiling_violations(t).drop("dsr", "dsr_n_trials")


@query("evidence_descriptors", "M7", over("trials", """
WITH t AS (SELECT evidence AS claim, family, verdict, trial_id % 4 AS period FROM trials),
 r AS (SELECT claim, count(*) AS a, count(*) FILTER (WHERE verdict IN ('signal', 'candidate')) AS s FROM t WHERE period = 3 GROUP BY claim)
SELECT t.claim, count(*) AS volume, count(DISTINCT family) AS families, count(DISTINCT period) AS periods, coalesce(max(a), 0) AS attempted, coalesce(max(s), 0) AS survived,
 CASE WHEN coalesce(max(s), 0) = 0 THEN 'no surviving replication' WHEN count(DISTINCT period) <= 1 THEN 'single period' WHEN count(DISTINCT family) <= 1 THEN 'single family' ELSE 'none' END AS weakest FROM t LEFT JOIN r ON t.claim = r.claim GROUP BY t.claim"""))
def evidence_descriptors(spark, sf_dir):
    t = market.trials(spark, sf_dir).select(F.col("evidence").alias("claim"), "family", "verdict", (F.col("trial_id") % 4).alias("period"))
    reps = t.where("period = 3").select("claim", F.col("verdict").isin(*L.LIVE).alias("survived"))
    return L.evidence(t, reps)


@query("declared_cells", "M7", over("trials", """
WITH p AS (SELECT CAST(trial_id % 4 AS INTEGER) AS period, count(*) AS cells FROM trials GROUP BY 1)
SELECT period, cells, CAST(sum(cells) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lifetime FROM p"""))
def declared_cells(spark, sf_dir):
    fam = market.trials(spark, sf_dir).groupBy("family", (F.col("trial_id") % 4).cast("int").alias("period")).agg(F.count(F.lit(1)).alias("cells"))
    return L.declared_cells(fam)


@query("claim_reconciliation", "M8", over("trials", _ENT + """,
 d AS (SELECT family, CAST(sum(trial_count) AS BIGINT) AS documented FROM en GROUP BY family), c AS (SELECT family, count(*) * 3 AS claimed FROM trials WHERE verdict <> 'noise' GROUP BY family)
SELECT family, coalesce(documented, 0) AS documented, coalesce(claimed, 0) AS claimed, coalesce(claimed, 0) - coalesce(documented, 0) AS unallocated FROM d FULL JOIN c USING (family)"""))
def claim_reconciliation(spark, sf_dir):
    claimed = market.trials(spark, sf_dir).where("verdict <> 'noise'").groupBy("family").agg((F.count(F.lit(1)) * 3).alias("claimed"))
    return L.reconcile_claims(entries(spark, sf_dir), claimed, "family")


@query("proposal_objections", "M14", over("trials", """
WITH p AS (SELECT p_partkey AS proposal, 'H' || (p_partkey * 7 % 500) AS revisits, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'doc' END AS pre, p_size % 4 AS tc, p_name || ' because ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' holds now' ELSE '' END AS reason,
  CASE WHEN p_size % 6 = 0 THEN 'F1' ELSE '' END AS con, p_size % 5 = 0 AS learns, p_size % 10 = 0 AS eq, CASE p_size % 7 WHEN 0 THEN 'Zero ' WHEN 1 THEN '' ELSE 'deployed' END AS beats, CASE WHEN p_size % 2 = 0 THEN 'strategy' ELSE 'info' END AS grade FROM part),
 k AS (SELECT DISTINCT hypothesis FROM trials WHERE verdict = 'killed'),
 j AS (SELECT p.*, k.hypothesis IS NOT NULL AS again, len(regexp_split_to_array(trim(reason), '\\s+')) < 5 AS thin FROM p LEFT JOIN k ON p.revisits = k.hypothesis)
SELECT proposal, 'blocking' AS severity, 'no pre-registration' AS objection FROM j WHERE pre = '' UNION ALL SELECT proposal, 'blocking', 'trial count not declared' FROM j WHERE tc < 1
UNION ALL SELECT proposal, CASE WHEN thin THEN 'blocking' ELSE 'caution' END, 're-tests killed hypothesis' FROM j WHERE again UNION ALL SELECT proposal, 'caution', 'contradicts settled finding' FROM j WHERE con <> ''
UNION ALL SELECT proposal, 'blocking', 'no equal-weight baseline' FROM j WHERE learns AND NOT eq UNION ALL SELECT proposal, 'blocking', 'no incremental bar' FROM j WHERE beats = ''
UNION ALL SELECT proposal, 'blocking', 'incremental bar is zero' FROM j WHERE lower(trim(beats)) = 'zero' UNION ALL SELECT proposal, 'caution', 'strategy grade claimed' FROM j WHERE grade = 'strategy'"""))
def proposal_objections(spark, sf_dir):
    """Standing rules over a table of proposals derived from the parts."""
    size = F.col("p_size")
    p = market.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("proposal"), F.concat(F.lit("H"), F.col("p_partkey") * 7 % 500).alias("revisits"),
        F.when(size % 3 == 0, "").otherwise("doc").alias("preregistration"), (size % 4).alias("trial_count"),
        F.concat("p_name", F.lit(" because "), "p_brand", F.when(size % 2 == 0, " holds now").otherwise("")).alias("reason"),
        F.when(size % 6 == 0, "F1").otherwise("").alias("contradicts"), (size % 5 == 0).alias("learns_parameters"), (size % 10 == 0).alias("equal_weight_baseline"),
        F.when(size % 7 == 0, "Zero ").when(size % 7 == 1, "").otherwise("deployed").alias("beats"), F.when(size % 2 == 0, "strategy").otherwise("info").alias("grade"),
    )
    return L.objections(p, market.trials(spark, sf_dir).where("verdict = 'killed'"))


@query("document_scan", "M15", """
SELECT doc_id AS number, trim(regexp_extract(text, '^\\s*([^\\n]+)', 1)) AS title, CASE WHEN NOT regexp_matches(text, '[0-9]') THEN 'registered' WHEN regexp_matches(text, '(?i)license|copyright') THEN 'killed' ELSE 'run' END AS state FROM documents ORDER BY doc_id DESC LIMIT 50""")
def document_scan(spark, sf_dir):
    """Title and state of the fifty newest documents, from their whole text."""
    return L.scan_documents(market.table(spark, sf_dir, "documents"), F.col("doc_id"), "text", r"^\s*([^\n]+)", "[0-9]", "(?i)license|copyright", 50)


@query("report_number_diff", "S12 J3", """
WITH x AS (SELECT page_id, unnest(l) AS tok, unnest(range(len(l))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '[-+]?[0-9]+(?:\\.[0-9]+)?') AS l FROM pages) t),
 b AS (SELECT page_id - 1 AS page_id, tok, pos FROM x)
SELECT coalesce(a.page_id, b.page_id) AS page_id, count(*) AS differing, count(a.tok) AS with_a, count(b.tok) AS with_b FROM x a FULL JOIN b ON a.page_id = b.page_id AND a.pos = b.pos
WHERE NOT coalesce(abs(TRY_CAST(a.tok AS DOUBLE) - TRY_CAST(b.tok AS DOUBLE)) <= 0, FALSE) GROUP BY 1""")
def report_number_diff(spark, sf_dir):
    """Numbers that differ between a page and the next one, position by position."""
    p = market.table(spark, sf_dir, "pages")
    a = L.numeric_tokens(p, ["page_id"], "html")
    b = L.numeric_tokens(p.withColumn("page_id", F.col("page_id") - 1), ["page_id"], "html")
    return L.token_diff(a, b, ["page_id"]).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("differing"), F.count("a").alias("with_a"), F.count("b").alias("with_b")
    )


_REACH = """WITH RECURSIVE r(start, node) AS (SELECT {a}, {b} FROM edges WHERE {a} IN ({starts}) UNION SELECT r.start, e.{b} FROM r JOIN edges e ON r.node = e.{a})
SELECT start, node FROM r"""


def _starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "start string")


@query("graph_depends_on", "M10", over("edges", _REACH.format(a="src", b="dst", starts="'N0', 'N5'")))
def graph_depends_on(spark, sf_dir):
    """Everything two nodes rest on, transitively."""
    return G.reach(market.edges(spark, sf_dir), _starts(spark, "N0", "N5")).select("start", "node")


@query("graph_impact", "M10", over("edges", """WITH RECURSIVE r(start, node) AS (SELECT dst, src FROM edges WHERE dst IN ('N40', 'N99') UNION SELECT r.start, e.src FROM r JOIN edges e ON r.node = e.dst),
 s(start, node) AS (SELECT src, dst FROM edges WHERE src IN ('N40', 'N99') UNION SELECT s.start, e.dst FROM s JOIN edges e ON s.node = e.src)
SELECT * FROM r UNION SELECT * FROM s"""))
def graph_impact(spark, sf_dir):
    """What would be affected if a node were wrong: dependants, and what it supports."""
    e = cut_lineage(market.edges(spark, sf_dir))
    return G.impact(e, e, _starts(spark, "N40", "N99"))


@query("graph_cycles", "M13", over("edges", """WITH RECURSIVE e AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges WHERE CAST(substr(src, 2) AS INTEGER) % 10 = 5 AND CAST(substr(dst, 2) AS INTEGER) % 4 = 0),
 r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
 c AS (SELECT a AS node FROM r WHERE a = b), into_c AS (SELECT node FROM c UNION SELECT a FROM r JOIN c ON r.b = c.node)
SELECT src, dst FROM e WHERE dst IN (SELECT node FROM into_c)"""))
def graph_cycles(spark, sf_dir):
    """Edges on or leading into dependency cycles, after some edges are turned back."""
    e = market.edges(spark, sf_dir)
    num = lambda c: F.substring(c, 2, 20).cast("int")
    back = e.where((num("src") % 10 == 5) & (num("dst") % 4 == 0)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.cyclic_edges(e.unionByName(back))


_SUPPORT = """
WITH RECURSIVE sup AS (SELECT dst AS claim, src AS node, CAST(substr(src, 2) AS INTEGER) AS ord, row_number() OVER (PARTITION BY dst ORDER BY CAST(substr(src, 2) AS INTEGER)) AS k FROM edges),
 high AS (SELECT src AS a, dst AS b FROM edges WHERE abs(1 - (CAST(substr(dst, 2) AS INTEGER) - CAST(substr(src, 2) AS INTEGER)) / 200) >= 0.7),
 pair AS (SELECT a, b FROM high UNION SELECT b, a FROM high),
 hit AS (SELECT s.claim, s.node, list(e.node) AS earlier FROM sup s JOIN pair ON pair.a = s.node JOIN sup e ON e.claim = s.claim AND e.node = pair.b AND e.ord < s.ord GROUP BY s.claim, s.node),
 st(claim, k, kept) AS (SELECT DISTINCT claim, 0::BIGINT, []::VARCHAR[] FROM sup
  UNION ALL SELECT s.claim, s.k, CASE WHEN list_has_any(st.kept, coalesce(h.earlier, []::VARCHAR[])) THEN st.kept ELSE list_append(st.kept, s.node) END
  FROM st JOIN sup s ON s.claim = st.claim AND s.k = st.k + 1 LEFT JOIN hit h ON h.claim = s.claim AND h.node = s.node),
 last AS (SELECT claim, max_by(kept, k) AS kept FROM st GROUP BY claim),
 chosen AS (SELECT s.claim, s.node, s.ord, list_contains(last.kept, s.node) AS kept FROM sup s JOIN last ON last.claim = s.claim)"""


def _chosen_support(spark, sf_dir):
    with freed_shuffles(spark):
        e = cut_lineage(market.edges(spark, sf_dir))
    num = lambda c: F.substring(c, 2, 20).cast("int")
    supports = e.select(F.col("dst").alias("claim"), F.col("src").alias("node"), num(F.col("src")).alias("ord"))
    corr = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), (1 - (num(F.col("dst")) - num(F.col("src"))) / 200).alias("r"))
    return G.independent_support(supports, corr)


@query("independent_supporters", "M11", over("edges", _SUPPORT + """
SELECT claim, node, ord, kept FROM chosen"""))
def independent_supporters(spark, sf_dir):
    """Every supporter of every node: whether it stands apart from the kept ones before it."""
    return _chosen_support(spark, sf_dir)


@query("independent_support", "M11", over("edges", _SUPPORT + """
SELECT claim, count(*) AS claimed, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS discounted FROM chosen GROUP BY claim"""))
def independent_support(spark, sf_dir):
    """Supporters of each node, claimed and kept once directly linked ones are collapsed."""
    return G.support_counts(_chosen_support(spark, sf_dir))


@query("graph_contradictions", "M12", over("edges", """
WITH k AS (SELECT src, dst, CASE WHEN CAST(substr(dst, 2) AS INTEGER) % 3 = 0 THEN 'contradicts' ELSE 'supports' END AS kind FROM edges UNION ALL SELECT src, dst, 'supports' FROM edges WHERE CAST(substr(dst, 2) AS INTEGER) % 2 = 0)
SELECT DISTINCT src, dst FROM k WHERE kind = 'contradicts' AND EXISTS (SELECT 1 FROM k s WHERE s.kind = 'supports' AND s.src = k.src AND s.dst = k.dst)"""))
def graph_contradictions(spark, sf_dir):
    e = market.edges(spark, sf_dir)
    num = F.substring("dst", 2, 20).cast("int")
    k = e.withColumn("kind", F.when(num % 3 == 0, "contradicts").otherwise("supports"))
    return G.contradictory_edges(k.unionByName(e.where(num % 2 == 0).withColumn("kind", F.lit("supports"))))


@query("graph_orphans", "M12 J9", over("edges", """
SELECT 'N' || s_suppkey AS node FROM supplier WHERE 'N' || s_suppkey NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)"""))
def graph_orphans(spark, sf_dir):
    nodes = market.table(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), F.col("s_suppkey")).alias("node"))
    return G.orphans(nodes, market.edges(spark, sf_dir))
