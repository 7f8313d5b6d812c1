"""Selection, sampling, statistics, routing rules, generation and notebook analytics (SL, SM, SA, RO, GV, NB, ST7)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waymark.functions import labels as L
from waymark.functions import text as T
from waymark.operators import graph
from waymark.operators import relational as O
from waymark.operators import reports as R
from waymark.operators import selection as S
from waymark.operators import statistics as A
from waymark.plans import fixtures as X
from waymark.plans.define import query
from waymark.plans.q_labels import classified, paired
from waymark.plans.q_relational import celled, generated, order


def every():
    """All rows as one window; only over tables of lanes, cells or bounded draws."""
    return W.partitionBy(F.lit(0))


def labelled(spark, sf):
    return X.labelled(spark, sf).withColumn("o", order())


@query("st7_connected_components", "WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, c_custkey - c_custkey % 7 AS b FROM customer WHERE c_custkey % 3 > 0 UNION SELECT DISTINCT c_custkey, c_custkey - 21 FROM customer WHERE c_custkey % 105 = 0 AND c_custkey > 21), u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r(node, part) AS (SELECT a, a FROM u UNION SELECT u.b, r.part FROM r JOIN u ON r.node = u.a AND r.part < u.b) SELECT node, min(part) AS part FROM r GROUP BY node")
def st7(spark, sf):
    c = X.table(spark, sf, "customer").select("c_custkey")
    near = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") - F.col("c_custkey") % 7).alias("b"))
    far = c.where("c_custkey % 105 = 0 AND c_custkey > 21").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") - 21).alias("b"))
    return graph.components(near.union(far).where("a <> b").distinct())


# Selection.


@query("sl1_lane_cap", """
WITH c AS (SELECT count(*) AS n FROM $triples GROUP BY dataset), d AS (SELECT unnest([10, 100, 1000, 2000]) AS draw),
f AS (SELECT draw, coalesce(min(r) / draw::DOUBLE, 1) AS floor FROM d LEFT JOIN (SELECT r, sum(least(n, r)) AS s FROM c, range(1, 2001) t(r) GROUP BY r) ON s >= draw AND r <= draw GROUP BY draw),
s AS (SELECT draw, floor, greatest(0.2::DOUBLE, floor) AS share FROM f),
k AS (SELECT draw, max(m) AS capacity FROM (SELECT draw, m, sum(least(n, ceil(share * m))) AS reach FROM s, c, range(0, 2001) t(m) WHERE m <= draw GROUP BY draw, m) WHERE reach >= m GROUP BY draw)
SELECT CAST(draw AS INTEGER) AS draw, floor, share, CAST(capacity AS INTEGER) AS capacity, floor > 0.2::DOUBLE AS infeasible FROM s JOIN k USING (draw)""")
def sl1(spark, sf):
    """The cap of a draw over the lanes' counts, and what it admits."""
    counts = [r["n"] for r in labelled(spark, sf).groupBy("dataset").agg(F.count("*").alias("n")).collect()]  # one row a lane
    rows = [(draw, *S.lane_cap(counts, draw, 0.2).values()) for draw in (10, 100, 1000, 2000)]
    return spark.createDataFrame(rows, "draw int, floor double, share double, capacity int, infeasible boolean")


@query("sl2_mass_cap", "SELECT cell, round(n / t, 6) AS p_natural, q AS quota, 2 * q < 900 AS generation_only FROM (SELECT *, CAST(least(500, round_even(5.0::DOUBLE * (n / t) * 400, 0)) AS BIGINT) AS q FROM (SELECT cell, count(*) AS n FROM (SELECT unnest(cells) AS cell FROM $celled) GROUP BY cell), (SELECT count(*) AS t FROM $celled))")
def sl2(spark, sf):
    rows = celled(spark, sf)
    total = rows.count()
    counts = rows.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    return counts.select("cell", *[c.alias(k) for k, c in S.mass_quota(F.col("n"), F.lit(total), flat=500, floor=900, k_cap=5.0, size=400).items()])


@query("sl3_cell_plan", "SELECT cell, n AS supply, CAST(greatest(2000 - n, 0) AS BIGINT) AS short, CAST(ceil(greatest(2000 - n, 0) / 0.6::DOUBLE) AS BIGINT) AS wanted FROM (SELECT cell, count(*) AS n FROM (SELECT unnest(cells) AS cell FROM $celled WHERE depth > 0) GROUP BY cell)")
def sl3(spark, sf):
    counts = celled(spark, sf).where("depth > 0").select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("supply"))
    short = F.greatest(2000 - F.col("supply"), F.lit(0))
    return counts.select("cell", "supply", short.alias("short"), F.ceil(short / 0.6).alias("wanted"))


@query("sl4_capped_draw", "SELECT dataset, query_id, turn FROM (SELECT dataset, query_id, row_number() OVER (PARTITION BY dataset ORDER BY md5('take:' || query_id), query_id) AS turn FROM $triples) WHERE turn <= 60 ORDER BY turn, dataset, query_id LIMIT 200")
def sl4(spark, sf):
    return S.capped_draw(X.triples(spark, sf).select("dataset", "query_id"), "dataset", "query_id", "take", 60, 200).withColumn("turn", F.col("turn").cast("long"))


@query("sl5_floor_ledger", "SELECT cell, dataset, CAST(least(count(*), 150) AS BIGINT) AS credit FROM (SELECT dataset, unnest(cells) AS cell FROM $celled) GROUP BY cell, dataset")
def sl5(spark, sf):
    counts = celled(spark, sf).select("dataset", F.explode("cells").alias("cell")).groupBy("cell", "dataset").agg(F.count("*").alias("n"))
    return counts.select("cell", "dataset", F.least("n", F.lit(150)).alias("credit"))


@query("sl6_control_draw", "SELECT query_id FROM (SELECT query_id FROM $celled WHERE len(cells) = 0 ORDER BY md5('control:' || query_id), query_id LIMIT (SELECT CAST(round(0.02 * count(*)) AS BIGINT) FROM $celled WHERE len(cells) > 0))")
def sl6(spark, sf):
    rows = celled(spark, sf)
    n = round(0.02 * rows.where(F.size("cells") > 0).count())
    return O.sample(rows.where(F.size("cells") == 0).select("query_id"), n, "control", "query_id")


@query("sl8_invariants", "SELECT 'duplicates' AS check_name, count(*) AS violations FROM (SELECT query_id FROM $triples GROUP BY query_id HAVING count(*) > 1) UNION ALL SELECT 'lane_cap', count(*) FROM (SELECT dataset FROM $triples GROUP BY dataset HAVING count(*) > 1200)")
def sl8(spark, sf):
    rows = X.triples(spark, sf)
    check = lambda name, df: df.agg(F.lit(name).alias("check_name"), F.count("*").alias("violations"))
    return check("duplicates", rows.groupBy("query_id").count().where("count > 1")).unionByName(check("lane_cap", rows.groupBy("dataset").count().where("count > 1200")))


@query("sl9_admission_credit", "SELECT home_lane, CAST(least(count(*), 40) AS BIGINT) AS credit FROM $generated WHERE gate = 'none' OR verdict GROUP BY home_lane")
def sl9(spark, sf):
    ok = generated(spark, sf).where((F.col("gate") == "none") | F.col("verdict"))
    return ok.groupBy("home_lane").agg(F.least(F.count("*"), F.lit(40)).alias("credit"))


@query("sl10_feasible_total")
def sl10(spark, sf):
    rows = classified(labelled(spark, sf)).where("certified").groupBy("route_class", "dataset").agg(F.count("*").alias("n")).collect()  # classes x lanes
    total = S.feasible_total({(r["route_class"], r["dataset"]): r["n"] for r in rows}, {"dense": 0.4, "sparse": 0.2, "hybrid": 0.4}, 0.3, 200_000)
    return spark.createDataFrame([(total,)], "total int")


@query("sl12_two_tier_select", "SELECT query_id, tier FROM (SELECT query_id, CASE WHEN class <> '' THEN 'certified' WHEN class_any <> '' THEN 'top_up' ELSE 'waste' END AS tier, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN class <> '' THEN 0 WHEN class_any <> '' THEN 1 ELSE 2 END, md5('tier:' || query_id), query_id) AS k FROM $classed) WHERE k <= 100")
def sl12(spark, sf):
    """Certified rows first, then decided ones, then waste, under one cap a lane."""
    rows = classified(labelled(spark, sf))
    tier = F.when(F.col("certified"), "certified").when(F.col("route_class_any") != "", "top_up").otherwise("waste")
    rank = F.when(F.col("certified"), 0).when(F.col("route_class_any") != "", 1).otherwise(2)
    return O.keep_one(rows.select("dataset", "query_id", tier.alias("tier"), rank.alias("rank")), ["dataset"], [F.col("rank"), O.draw_key("tier", "query_id"), F.col("query_id")], 100).select("query_id", "tier")


@query("sl13_order_sheet", "SELECT name, CAST(greatest(floor - coalesce(n, 0), 0) AS BIGINT) AS owed FROM (VALUES ('dense_high', 1500), ('fused_mid', 2500), ('sparse_low', 500)) AS s(name, floor) LEFT JOIN (SELECT unnest(cells) AS name, count(*) AS n FROM $celled WHERE depth > 2 GROUP BY 1) c USING (name)")
def sl13(spark, sf):
    floors = spark.createDataFrame([("dense_high", 1500), ("fused_mid", 2500), ("sparse_low", 500)], "name string, floor int")
    have = celled(spark, sf).where("depth > 2").select(F.explode("cells").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return floors.join(have, "name", "left").select("name", F.greatest(F.col("floor") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("owed"))


@query("sl14_label_allocation")
def sl14(spark, sf):
    rows = classified(labelled(spark, sf))
    lanes = rows.groupBy("dataset").agg(F.count("*").alias("n"), *[R.share(F.col("route_class_any") == c).alias(c) for c in ("dense", "sparse", "hybrid")]).collect()  # one row a lane
    bought = S.allocate({"dense": 900.0, "sparse": 400.0, "hybrid": 700.0}, {r["dataset"]: {c: r[c] for c in ("dense", "sparse", "hybrid")} for r in lanes}, {r["dataset"]: r["n"] for r in lanes}, {(r["dataset"], c): 300.0 for r in lanes for c in ("dense", "sparse", "hybrid")})
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sorted(bought.items())], "dataset string, labels double")


@query("sl15_named_picks", "SELECT dataset, query_id FROM (SELECT dataset, query_id, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN list_contains(cells, 'sparse_low') THEN 0 ELSE 1 END, md5('pick:' || query_id), query_id) AS k FROM $celled WHERE depth > 0) WHERE k <= 75")
def sl15(spark, sf):
    rows = celled(spark, sf).where("depth > 0").withColumn("hungry", F.when(F.array_contains("cells", "sparse_low"), 0).otherwise(1))
    return O.keep_one(rows, ["dataset"], [F.col("hungry"), O.draw_key("pick", "query_id"), F.col("query_id")], 75).select("dataset", "query_id")


@query("sl19_requirements", "SELECT DISTINCT cell, CAST(greatest(25, floor(0.5::DOUBLE * 600 / count(*) OVER ())) AS BIGINT) AS floor FROM (SELECT DISTINCT unnest(cells) AS cell FROM $celled)")
def sl19(spark, sf):
    names = celled(spark, sf).select(F.explode("cells").alias("cell")).distinct()
    return names.select("cell", F.greatest(F.lit(25), F.floor(F.lit(0.5 * 600) / F.count("*").over(every()))).cast("long").alias("floor"))


def _composer_rows(spark, sf):
    rows = celled(spark, sf).where(F.size("cells") > 0)
    return rows.select(F.col("query_id").alias("row_id"), F.col("dataset").alias("lane"), F.coalesce("stage", F.lit("none")).alias("family"), F.col("cells").alias("strata"), F.split("query_id", ":").alias("tokens"))


@query("sl20_greedy_compose")
def sl20(spark, sf):
    """Candidates are prepared by Spark, which leaves out only those that no choice can reach; the sequential choice runs in one grouped function."""
    floors, budgets = {"dense_high": 40, "fused_mid": 60, "sparse_low": 30}, {"A-F": 30, "N-O": 30, "R-F": 30}

    rows = _composer_rows(spark, sf)
    strata = rows.select("lane", F.explode("strata").alias("name"))
    limits = spark.createDataFrame(sorted(budgets.items()), "lane string, budget long")
    free = strata.select("lane").distinct().join(limits, "lane", "left").fillna(100, ["budget"])
    supply = {r["name"]: r["supply"] for r in S.admissible_supply(strata, free).collect()}  # one row a stratum
    reachable = {name: floor for name, floor in floors.items() if supply.get(name, 0) >= floor}  # the others are debt

    def one(pdf):
        return S.compose(pdf, reachable, budgets, 100)

    picked = S.shortlist(rows, 100).withColumn("g", F.lit(0)).groupBy("g").applyInPandas(one, "row_id string, stratum string, lane string, theta double, rank long")
    picked = graph.checkpointed(picked.withColumn("reason", F.lit("floor")))  # the choice is long and read three times
    filled = S.residual_fill(rows, picked, budgets, 100).withColumn("reason", F.lit("residual"))
    return picked.unionByName(filled, allowMissingColumns=True)


@query("sl21_strata_prepare", "SELECT query_id, array_to_string(list_sort(list_concat(cells, ['lane:' || dataset])), ',') AS strata FROM $celled")
def sl21(spark, sf):
    strata = F.array_sort(F.concat("cells", F.array(F.concat(F.lit("lane:"), "dataset"))))
    return celled(spark, sf).select("query_id", F.array_join(strata, ",").alias("strata"))


@query("sl22_admissible_supply", "SELECT name, CAST(sum(least(n, 500)) AS BIGINT) AS supply FROM (SELECT name, dataset, count(*) AS n FROM (SELECT dataset, unnest(cells) AS name FROM $celled) GROUP BY ALL) GROUP BY name")
def sl22(spark, sf):
    strata = celled(spark, sf).select(F.explode("cells").alias("name"), F.col("dataset").alias("lane"))
    return S.admissible_supply(strata, strata.select("lane").distinct().withColumn("budget", F.lit(500)))


@query("sl23_debt_split", "SELECT name, CAST(greatest(floor - s, 0) AS BIGINT) AS unreachable, CAST(greatest(least(floor, s) - n, 0) AS BIGINT) AS reachable FROM (SELECT name, 2500 AS floor, sum(least(n, 500)) AS s, sum(least(c, 100)) AS n FROM (SELECT name, dataset, count(*) AS n, count(*) FILTER (depth > 3) AS c FROM (SELECT dataset, depth, unnest(cells) AS name FROM $celled) GROUP BY ALL) GROUP BY name)")
def sl23(spark, sf):
    """What no supply can reach of a floor, and what is still to be had."""
    rows = celled(spark, sf).select("dataset", "depth", F.explode("cells").alias("name")).groupBy("name", "dataset").agg(F.count("*").alias("n"), R.count_if(F.col("depth") > 3).alias("c"))
    out = rows.groupBy("name").agg(F.sum(F.least("n", F.lit(500))).alias("s"), F.sum(F.least("c", F.lit(100))).alias("have"))
    return out.select("name", F.greatest(2500 - F.col("s"), F.lit(0)).alias("unreachable"), F.greatest(F.least(F.lit(2500), F.col("s")) - F.col("have"), F.lit(0)).alias("reachable"))


@query("sl24_structural_gain", "SELECT query_id, round(max(greatest(0, 1 - n / 2500)), 6) AS gain FROM (SELECT query_id, unnest(cells) AS name FROM $celled) JOIN (SELECT unnest(cells) AS name, count(*) AS n FROM $celled WHERE depth > 2 GROUP BY 1) USING (name) GROUP BY query_id")
def sl24(spark, sf):
    rows = celled(spark, sf)
    counts = rows.where("depth > 2").select(F.explode("cells").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    gain = F.max(F.greatest(F.lit(0.0), 1 - F.col("n") / 2500))
    return rows.select("query_id", F.explode("cells").alias("name")).join(counts, "name").groupBy("query_id").agg(F.round(gain, 6).alias("gain"))


@query("sl25_novelty", """
WITH t AS (SELECT CAST(query_id AS INTEGER) AS i, query_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS w FROM $queries), c AS (SELECT * FROM t WHERE i % 4 = 0), f AS (SELECT * FROM t WHERE i % 4 > 0)
SELECT f.query_id, round(1 - coalesce(max(len(list_intersect(f.w, c.w)) / len(list_distinct(list_concat(f.w, c.w)))), 0), 6) AS novelty FROM f LEFT JOIN c ON len(list_intersect(f.w, c.w)) > 0 GROUP BY f.query_id""")
def sl25(spark, sf):
    """1 less the largest Jaccard similarity to a chosen row; pairs meet by a shared token only."""
    rows = X.search_queries(spark, sf).select("query_id", F.col("query_id").cast("int").alias("i"), T.token_set(F.col("query")).alias("w"))
    tokens = rows.select("query_id", "i", F.size("w").alias("n"), F.explode("w").alias("t"))
    chosen = tokens.where("i % 4 = 0").select(F.col("query_id").alias("c"), F.col("n").alias("m"), "t")
    met = tokens.where("i % 4 > 0").join(chosen, "t").groupBy("query_id", "c", "n", "m").agg(F.count("*").alias("both"))
    best = met.groupBy("query_id").agg(F.max(F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("j"))
    return rows.where("i % 4 > 0").join(best, "query_id", "left").select("query_id", F.round(1 - F.coalesce("j", F.lit(0.0)), 6).alias("novelty"))


@query("sl26_provenance_score", "SELECT a.query_id, round(1 - coalesce(n, 0) / greatest(1, t), 6) AS score FROM $labelled a LEFT JOIN (SELECT stage, count(*) AS n FROM $labelled WHERE depth > 2 GROUP BY stage) b ON a.stage = b.stage, (SELECT count(*) AS t FROM $labelled WHERE depth > 2) WHERE a.depth <= 2")
def sl26(spark, sf):
    rows = X.labelled(spark, sf)
    chosen = rows.where("depth > 2")
    total = max(1, chosen.count())
    return rows.where("depth <= 2").join(chosen.groupBy("stage").agg(F.count("*").alias("n")), "stage", "left").select("query_id", F.round(1 - F.coalesce("n", F.lit(0)) / F.lit(total), 6).alias("score"))


@query("sl27_residual_fill", "SELECT dataset, query_id FROM (SELECT dataset, query_id, row_number() OVER (PARTITION BY dataset ORDER BY query_id) AS k FROM $labelled WHERE depth = 0) WHERE k <= 40 ORDER BY query_id LIMIT 150")
def sl27(spark, sf):
    left = O.keep_one(X.labelled(spark, sf).where("depth = 0"), ["dataset"], [F.col("query_id")], 40)
    return left.select("dataset", "query_id").orderBy("query_id").limit(150)


@query("sl28_coverage_report", "SELECT name, count(*) AS pool, CAST(count(*) FILTER (depth > 0) AS BIGINT) AS achievable, CAST(count(*) FILTER (depth > 2) AS BIGINT) AS selected FROM (SELECT depth, unnest(cells) AS name FROM $celled) GROUP BY name")
def sl28(spark, sf):
    return celled(spark, sf).select("depth", F.explode("cells").alias("name")).groupBy("name").agg(F.count("*").alias("pool"), R.count_if(F.col("depth") > 0).alias("achievable"), R.count_if(F.col("depth") > 2).alias("selected"))


@query("sl30_spend_gate", "SELECT CASE WHEN bool_and(n >= 300) AND bool_and(d > 0) THEN 'PASS' ELSE 'FAIL' END AS verdict, CAST(count(*) FILTER (n < 300) AS BIGINT) AS unmet FROM (SELECT name, count(*) AS n, count(depth) AS d FROM (SELECT depth, unnest(cells) AS name FROM $celled WHERE depth > 2) GROUP BY name)")
def sl30(spark, sf):
    rows = celled(spark, sf).where("depth > 2").select("depth", F.explode("cells").alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.count("depth").alias("d"))
    ok = F.bool_and(F.col("n") >= 300) & F.bool_and(F.col("d") > 0)
    return rows.agg(F.when(ok, "PASS").otherwise("FAIL").alias("verdict"), R.count_if(F.col("n") < 300).alias("unmet"))


@query("sl31_label_run_partition", "SELECT query_id, CASE WHEN provenance = 'natural' THEN 'natural' WHEN stage IS NULL THEN 'constructed' ELSE 'supplemented' END AS part FROM $labelled")
def sl31(spark, sf):
    part = F.when(F.col("provenance") == "natural", "natural").when(F.col("stage").isNull(), "constructed").otherwise("supplemented")
    return X.labelled(spark, sf).select("query_id", part.alias("part"))


@query("sl33_plan_fingerprint", """
WITH b AS (SELECT substring(m, 1, 4) AS bucket, sha256(string_agg(m || ':' || n, chr(10) ORDER BY m)) AS digest FROM (SELECT md5(dataset || '|' || query_id) AS m, CAST(count(*) AS VARCHAR) AS n FROM $labelled WHERE depth = 4 GROUP BY 1) GROUP BY 1)
SELECT sha256(coalesce(string_agg(digest, chr(10) ORDER BY bucket), '')) AS fp FROM b""")
def sl33(spark, sf):
    """Fingerprint of a plan, whatever the order of its rows."""
    rows = X.labelled(spark, sf).where("depth = 4").select(F.md5(F.concat_ws("|", "dataset", "query_id")).alias("row"))
    return O.bag_digest(rows, "row").select(F.sha2("digest", 256).alias("fp"))


@query("sl34_label_more", "SELECT dataset, query_id FROM (SELECT l.dataset, query_id, row_number() OVER (PARTITION BY l.dataset ORDER BY md5('more:' || query_id), query_id) AS k, need FROM $labelled l JOIN (SELECT dataset, CAST(ceil(50 / greatest(avg(CASE WHEN depth > 2 THEN 1.0 ELSE 0.0 END), 0.05::DOUBLE) * 1.5) AS BIGINT) AS need FROM $labelled GROUP BY dataset) n ON l.dataset = n.dataset WHERE depth = 0) WHERE k <= need")
def sl34(spark, sf):
    rows = X.labelled(spark, sf)
    need = F.ceil(F.lit(50) / F.greatest(R.share(F.col("depth") > 2), F.lit(0.05)) * 1.5)
    return S.matched_draw(rows.where("depth = 0").select("dataset", "query_id"), rows.groupBy("dataset").agg(need.alias("want")), ["dataset"], "more", "query_id")


@query("sl35_matched_comparator", "SELECT query_id FROM (SELECT c.query_id, row_number() OVER (PARTITION BY c.class, c.kind ORDER BY md5('match:' || query_id), query_id) AS k, w.n FROM $classed c JOIN (SELECT class, kind, count(*) AS n FROM $classed WHERE o % 9 = 0 GROUP BY ALL) w ON c.class = w.class AND c.kind = w.kind WHERE o % 9 > 0) WHERE k <= n")
def sl35(spark, sf):
    rows = classified(labelled(spark, sf))
    wanted = rows.where("o % 9 = 0").groupBy("route_class", "kind").agg(F.count("*").alias("want"))
    return S.matched_draw(rows.where("o % 9 > 0").select("query_id", "route_class", "kind"), wanted, ["route_class", "kind"], "match", "query_id").select("query_id")


@query("sl36_cluster_excluded_arm", "SELECT query_id, reused FROM (SELECT l.query_id, l.cluster IN (SELECT cluster FROM $labelled WHERE o % 9 = 0) AS reused, row_number() OVER (PARTITION BY l.dataset ORDER BY l.cluster IN (SELECT cluster FROM $labelled WHERE o % 9 = 0), md5('arm:' || query_id), query_id) AS k, n FROM $labelled l JOIN (SELECT dataset, count(*) AS n FROM $labelled WHERE o % 9 = 0 GROUP BY dataset) w ON l.dataset = w.dataset WHERE o % 9 > 0) WHERE k <= n")
def sl36(spark, sf):
    """An arm of the same size per lane that avoids the other arm's clusters while it can."""
    rows = labelled(spark, sf)
    other = rows.where("o % 9 = 0")
    pool = rows.where("o % 9 > 0").join(other.select("cluster").distinct().withColumn("there", F.lit(True)), "cluster", "left").select("dataset", "query_id", F.col("there").isNotNull().alias("reused"))
    return S.matched_draw(pool, other.groupBy("dataset").agg(F.count("*").alias("want")), ["dataset"], "arm", "query_id", avoid=F.col("reused")).select("query_id", "reused")


@query("sl38_parent_pool", "SELECT CAST(c_custkey AS VARCHAR) AS parent FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0) AND c_custkey NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0)")
def sl38(spark, sf):
    c = X.table(spark, sf, "customer").select("c_custkey")
    c = O.difference(c, X.table(spark, sf, "orders").where("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return O.difference(c, X.table(spark, sf, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("c_custkey")), "c_custkey").select(F.col("c_custkey").cast("string").alias("parent"))


@query("sl40_campaign_plan", "SELECT name, CAST(greatest(2000 - n, 0) AS BIGINT) AS missing, CASE WHEN n >= 2000 THEN 'skip' WHEN n >= 500 THEN 'produce' ELSE 'needs_synthesis' END AS action FROM (SELECT name, count(*) AS n FROM (SELECT unnest(cells) AS name FROM $celled) GROUP BY name)")
def sl40(spark, sf):
    counts = celled(spark, sf).select(F.explode("cells").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return counts.select("name", F.greatest(2000 - F.col("n"), F.lit(0)).alias("missing"), F.when(F.col("n") >= 2000, "skip").when(F.col("n") >= 500, "produce").otherwise("needs_synthesis").alias("action"))


# Sampling and splits.


@query("sm1_stratified_fraction", "SELECT query_id FROM (SELECT query_id, row_number() OVER (PARTITION BY dataset, class ORDER BY md5('frac:' || query_id), query_id) AS k, count(*) OVER (PARTITION BY dataset, class) AS n FROM $classed) WHERE k <= round(0.2::DOUBLE * n)")
def sm1(spark, sf):
    rows = classified(labelled(spark, sf)).select("query_id", "dataset", "route_class")
    wanted = rows.groupBy("dataset", "route_class").agg(F.round(0.2 * F.count("*")).alias("want"))
    return S.matched_draw(rows, wanted, ["dataset", "route_class"], "frac", "query_id").select("query_id")


@query("sm2_within_lane_split", "SELECT query_id, k <= round(0.2::DOUBLE * n) AS is_test FROM (SELECT query_id, row_number() OVER (PARTITION BY dataset ORDER BY md5('split:' || query_id), query_id) AS k, count(*) OVER (PARTITION BY dataset) AS n FROM $triples)")
def sm2(spark, sf):
    rows = X.triples(spark, sf).select("dataset", "query_id")
    counts = rows.groupBy("dataset").agg(F.count("*").alias("n"))
    placed = rows.withColumn("k", F.row_number().over(W.partitionBy("dataset").orderBy(O.draw_key("split", "query_id"), "query_id"))).join(counts, "dataset")
    return placed.select("query_id", (F.col("k") <= F.round(0.2 * F.col("n"))).alias("is_test"))


@query("sm3_hold_out_lane", "SELECT query_id, dataset = 'N-O' AS is_test FROM $triples")
def sm3(spark, sf):
    return X.triples(spark, sf).select("query_id", (F.col("dataset") == "N-O").alias("is_test"))


@query("sm4_lane_rotation", "SELECT fold, CAST(count(*) FILTER (t.dataset = fold) AS BIGINT) AS test, CAST(count(*) FILTER (t.dataset <> fold) AS BIGINT) AS train FROM $triples t, (SELECT DISTINCT dataset AS fold FROM $triples) GROUP BY fold")
def sm4(spark, sf):
    """Folds by lane counts; each row is a test row of its own lane's fold and a training row of all others."""
    counts = X.triples(spark, sf).groupBy(F.col("dataset").alias("fold")).agg(F.count("*").alias("test"))
    return counts.select("fold", "test", (F.sum("test").over(every()) - F.col("test")).alias("train"))


@query("sm5_cluster_split", "SELECT query_id, coalesce(s, 0) < 0.2::DOUBLE * t AS is_test FROM $labelled JOIN (SELECT dataset, cluster, sum(n) OVER (PARTITION BY dataset ORDER BY md5('cl:' || dataset || ':' || CAST(cluster AS VARCHAR)), cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, sum(n) OVER (PARTITION BY dataset) AS t FROM (SELECT dataset, cluster, count(*) AS n FROM $labelled GROUP BY ALL)) USING (dataset, cluster)")
def sm5(spark, sf):
    """Whole clusters to the test side until a fifth of the lane is there."""
    rows = X.labelled(spark, sf).select("dataset", "cluster", "query_id")
    sizes = rows.groupBy("dataset", "cluster").agg(F.count("*").alias("n"))
    before = W.partitionBy("dataset").orderBy(O.draw_key("cl", "dataset", "cluster"), "cluster").rowsBetween(W.unboundedPreceding, -1)
    sides = sizes.select("dataset", "cluster", (F.coalesce(F.sum("n").over(before), F.lit(0)) < 0.2 * F.sum("n").over(W.partitionBy("dataset"))).alias("is_test"))
    return rows.join(sides, ["dataset", "cluster"]).select("query_id", "is_test")


@query("sm6_balanced_judge_sample", "SELECT query_id, doc_id, positive FROM (SELECT query_id, doc_id, relevance >= 2 AS positive, row_number() OVER (PARTITION BY relevance >= 2 ORDER BY md5('judge:' || query_id || ':' || doc_id), query_id, doc_id) AS k FROM $qrels) WHERE k <= 20")
def sm6(spark, sf):
    rows = X.qrels(spark, sf).select("query_id", "doc_id", (F.col("relevance") >= 2).alias("positive"))
    return O.keep_one(rows, ["positive"], [O.draw_key("judge", "query_id", "doc_id"), F.col("query_id"), F.col("doc_id")], 20)


@query("sm7_pseudo_negatives", "SELECT doc_id FROM $corpus WHERE doc_id NOT IN (SELECT doc_id FROM $qrels) ORDER BY md5('neg:' || doc_id), doc_id LIMIT 50")
def sm7(spark, sf):
    return O.sample(O.difference(X.corpus(spark, sf).select("doc_id"), X.qrels(spark, sf), "doc_id"), 50, "neg", "doc_id")


@query("sm8_round_robin", "SELECT query_id FROM (SELECT query_id, depth, row_number() OVER (PARTITION BY depth ORDER BY md5('rr:' || query_id), query_id) AS k FROM $labelled) ORDER BY k, depth LIMIT 123")
def sm8(spark, sf):
    turn = F.row_number().over(W.partitionBy("depth").orderBy(O.draw_key("rr", "query_id"), "query_id"))
    return X.labelled(spark, sf).select("query_id", "depth", turn.alias("k")).orderBy("k", "depth").limit(123).select("query_id")


@query("sm9_tune_slice", "SELECT query_id, k <= round(0.1::DOUBLE * n) AS tune FROM (SELECT query_id, row_number() OVER (PARTITION BY shape ORDER BY md5('tune:' || query_id), query_id) AS k, count(*) OVER (PARTITION BY shape) AS n FROM $shaped)")
def sm9(spark, sf):
    rows = X.triples(spark, sf).select("query_id", L.outcome_shape().alias("shape"))
    counts = rows.groupBy("shape").agg(F.count("*").alias("n"))
    placed = rows.withColumn("k", F.row_number().over(W.partitionBy("shape").orderBy(O.draw_key("tune", "query_id"), "query_id"))).join(counts, "shape")
    return placed.select("query_id", (F.col("k") <= F.round(0.1 * F.col("n"))).alias("tune"))


# Statistics.

_MD5 = "CAST('0x' || substring(md5({}), 1, 7) AS BIGINT)"


@query("sa1_lane_bootstrap", f"""
WITH l AS (SELECT row_number() OVER (ORDER BY dataset) - 1 AS p, count(*) AS n, sum(hi) AS s FROM $scored GROUP BY dataset), r AS (SELECT b, sum(s) / sum(n) AS m FROM (SELECT b, {_MD5.format("'boot:' || CAST(b AS VARCHAR) || ':' || CAST(k AS VARCHAR)")} % (SELECT count(*) FROM l) AS p FROM range(300) x(b), range((SELECT count(*) FROM l)) y(k)) JOIN l USING (p) GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(stddev_samp(m), 6) AS se FROM r""")
def sa1(spark, sf):
    lanes = X.triples(spark, sf).groupBy("dataset").agg(F.count("*").alias("n"), F.sum(L.top()).alias("total"))
    return A.interval(A.lane_bootstrap(lanes.withColumn("position", F.row_number().over(every().orderBy("dataset")) - 1), 300, "boot"))


def poisson_sql(rows: str, resamples: int, seed: str) -> str:
    """Interval of the Poisson bootstrap of ``rows`` (key, d): a row's count in a resample is how many steps of the distribution its hash passes."""
    counts = " + ".join(f"CAST(u >= {edge!r}::DOUBLE AS INTEGER)" for edge in A.POISSON)
    number = _MD5.format(f"'{seed}:' || CAST(key AS VARCHAR) || ':' || CAST(b AS VARCHAR)")
    means = f"SELECT b, sum(c * d) / sum(c) AS m FROM (SELECT b, d, {counts} AS c FROM (SELECT b, d, {number} / 268435456.0::DOUBLE AS u FROM ({rows}), range({resamples}) t(b))) GROUP BY b HAVING sum(c) > 0"
    return f"SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(stddev_samp(m), 6) AS se FROM ({means})"


@query("sa3_paired_bootstrap", poisson_sql("SELECT query_id AS key, greatest(d1, p1, s1) - greatest(d2, p2, s2) AS d FROM $paired", 100, "pair"))
def sa3(spark, sf):
    rows = paired(spark, sf).select(F.col("query_id").alias("key"), (L.top("_1") - L.top("_2")).alias("d"))
    return A.interval(A.paired_bootstrap(rows, 100, "pair"))


@query("sa7_discordant_pairs", "SELECT CAST(count(*) FILTER (w1 = 0 AND w2 <> 0) AS BIGINT) AS a_only, CAST(count(*) FILTER (w1 <> 0 AND w2 = 0) AS BIGINT) AS b_only FROM $views")
def sa7(spark, sf):
    one, two = (L.argmax(s, L.COMBINER_ROUTES) == "dense_only" for s in ("_1", "_2"))
    return paired(spark, sf).agg(R.count_if(one & ~two).alias("a_only"), R.count_if(~one & two).alias("b_only"))


@query("sa8_signed_ranks", "SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, CAST(count(*) AS BIGINT) AS n FROM (SELECT d, avg(k) OVER (PARTITION BY abs(d)) AS r FROM (SELECT d, row_number() OVER (ORDER BY abs(d)) AS k FROM (SELECT round(t1 - t2, 6) AS d FROM $views) WHERE d <> 0))")
def sa8(spark, sf):
    return A.signed_ranks(paired(spark, sf).select(F.round(L.top("_1") - L.top("_2"), 6).alias("d")))


@query("sa9_auc", "SELECT round((sum(r) - p * (p + 1) / 2) / (p * q), 6) AS auc FROM (SELECT avg(k) OVER (PARTITION BY dn) AS r, y FROM (SELECT dn, rf > sp AS y, row_number() OVER (ORDER BY dn) AS k FROM $scored)), (SELECT count(*) FILTER (rf > sp) AS p, count(*) FILTER (rf <= sp) AS q FROM $scored) WHERE y GROUP BY p, q")
def sa9(spark, sf):
    return A.auc(X.triples(spark, sf), "score_dense_only", F.col("score_pure_rrf") > F.col("score_sparse_only"))


X.SQL["nulls"] = f"SELECT h, b, {_MD5.format(chr(39) + 'null:' + chr(39) + ' || h || ' + chr(39) + ':' + chr(39) + ' || CAST(b AS VARCHAR)')} % 1000 / 300.0::DOUBLE AS z FROM (SELECT DISTINCT dataset AS h FROM $triples), range(200) t(b)"


@query("sa10_step_down_max_t", """
WITH o AS (SELECT dataset AS h, round(avg(hi) * 5, 4) AS z FROM $scored GROUP BY dataset), k AS (SELECT *, row_number() OVER (ORDER BY abs(z) DESC, h) AS place FROM o),
r AS (SELECT k.h, k.place, k.z, max(abs(n.z)) OVER (PARTITION BY b ORDER BY place DESC) AS m FROM $nulls n JOIN k ON n.h = k.h), p AS (SELECT h, place, (count(*) FILTER (m >= abs(z)) + 1) / (count(*) + 1) AS p FROM r GROUP BY h, place)
SELECT h AS hypothesis, round(max(p) OVER (ORDER BY place), 6) AS p_adjusted FROM p""")
def sa10(spark, sf):
    observed = X.triples(spark, sf).groupBy(F.col("dataset").alias("hypothesis")).agg(F.round(F.avg(L.top()) * 5, 4).alias("z"))
    null = observed.select("hypothesis", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("b"))
    return A.step_down(observed, null.withColumn("z", A.md5_number(F.lit("null"), F.col("hypothesis"), F.col("b")) % 1000 / 300.0))


@query("sa12_duplicate_share", "SELECT round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS share FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def sa12(spark, sf):
    sizes = X.table(spark, sf, "documents").groupBy(F.sha2("text", 256)).agg(F.count("*").alias("n"))
    return sizes.agg(F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share"))


X.SQL["lane_gain"] = "SELECT dataset, count(*) AS n, avg(rf) - avg(dn) AS v FROM $scored GROUP BY dataset"


@query("sa13_sign_robustness", "SELECT CASE WHEN least(a, b) > 0 OR greatest(a, b) < 0 THEN 'robust' WHEN a = 0 OR b = 0 THEN 'at_zero' ELSE 'sign_flip' END AS verdict FROM (SELECT round(avg(v), 9) AS a, round(sum(n * v) / sum(n), 9) AS b FROM $lane_gain)")
def sa13(spark, sf):
    lanes = X.triples(spark, sf).groupBy("dataset").agg(F.count("*").alias("n"), (F.avg("score_pure_rrf") - F.avg("score_dense_only")).alias("v"))
    out = lanes.agg(F.round(F.avg("v"), 9).alias("a"), F.round(F.sum(F.col("n") * F.col("v")) / F.sum("n"), 9).alias("b"))
    verdict = F.when((F.least("a", "b") > 0) | (F.greatest("a", "b") < 0), "robust").when((F.col("a") == 0) | (F.col("b") == 0), "at_zero").otherwise("sign_flip")
    return out.select(verdict.alias("verdict"))


@query("sa14_weighted_means", "SELECT round(avg(v), 6) AS uniform, round(sum(n * v) / sum(n), 6) AS pool, round(sum(least(n, 800) * v) / sum(least(n, 800)), 6) AS capped FROM $lane_gain")
def sa14(spark, sf):
    lanes = X.triples(spark, sf).groupBy("dataset").agg(F.count("*").alias("n"), (F.avg("score_pure_rrf") - F.avg("score_dense_only")).alias("v"))
    weighted = lambda w: F.round(F.sum(w * F.col("v")) / F.sum(w), 6)
    return lanes.agg(F.round(F.avg("v"), 6).alias("uniform"), weighted(F.col("n")).alias("pool"), weighted(F.least("n", F.lit(800))).alias("capped"))


@query("sa15_threshold_grid", """
SELECT a, b, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, a, b) AS k FROM (SELECT a / 10::DOUBLE AS a, b / 10::DOUBLE AS b, round(avg(CASE WHEN dn >= a / 10::DOUBLE THEN dn WHEN sp >= b / 10::DOUBLE THEN sp ELSE rf END), 6) AS score FROM $shaped, range(1, 10) x(a), range(1, 10) y(b) WHERE shape = 'routes_differ' GROUP BY ALL)) WHERE k = 1""")
def sa15(spark, sf):
    """Every row carries its value under the whole grid; the grid is a fixed 81 points."""
    d, p, s = (L.score(r) for r in L.ROUTES)
    points = [(a / 10, b / 10) for a in range(1, 10) for b in range(1, 10)]
    rows = X.triples(spark, sf).where(L.outcome_shape() == "routes_differ")
    sums = rows.agg(*[F.round(F.avg(F.when(d >= L.d(a), d).when(s >= L.d(b), s).otherwise(p)), 6).alias(f"g{i}") for i, (a, b) in enumerate(points)])
    grid = sums.select(F.explode(F.array(*[F.struct(F.col(f"g{i}").alias("score"), (-L.d(a)).alias("a"), (-L.d(b)).alias("b")) for i, (a, b) in enumerate(points)])).alias("g"))
    return grid.agg(F.max("g").alias("g")).select((-F.col("g.a")).alias("a"), (-F.col("g.b")).alias("b"), "g.score")


@query("sa17_z_score", "SELECT query_id, round((dn - m) / CASE WHEN s IS NULL OR s = 0 THEN 1 ELSE s END, 6) AS z FROM $scored, (SELECT avg(dn) AS m, stddev_samp(dn) AS s FROM $labelled WHERE depth < 4)")
def sa17(spark, sf):
    rows = X.labelled(spark, sf)
    m, s = rows.where("depth < 4").agg(F.avg("score_dense_only"), F.stddev_samp("score_dense_only")).first()  # two numbers
    return rows.select("query_id", F.round((F.col("score_dense_only") - F.lit(m)) / F.lit(s or 1.0), 6).alias("z"))


# Routing rules.


@query("ro1_two_threshold_hedge", "SELECT query_id, CASE WHEN dn < 0.4::DOUBLE AND sp < 0.3::DOUBLE THEN 'pure_rrf' WHEN abs(dn - sp) < 0.05::DOUBLE THEN 'pure_rrf' WHEN dn >= 0.4::DOUBLE AND sp >= 0.3::DOUBLE THEN CASE WHEN dn > sp THEN 'dense_only' ELSE 'sparse_only' END WHEN dn >= 0.4::DOUBLE THEN 'dense_only' ELSE 'sparse_only' END AS route FROM $scored")
def ro1(spark, sf):
    from waymark.functions.routing import hedge

    return X.triples(spark, sf).select("query_id", hedge(F.col("score_dense_only"), F.col("score_sparse_only"), 0.4, 0.3, 0.05).alias("route"))


@query("ro2_serve_indices", "SELECT query_id, CASE WHEN dn >= 0.5::DOUBLE AND (sp < 0.5::DOUBLE OR dn >= sp) THEN 'dense_only' WHEN sp >= 0.5::DOUBLE THEN 'sparse_only' WHEN greatest(dn, sp) < 0.1::DOUBLE THEN 'pure_rrf' WHEN dn >= sp THEN 'dense_only' ELSE 'sparse_only' END AS route FROM $scored")
def ro2(spark, sf):
    from waymark.functions.routing import serve_most_probable

    heads = {"dense_only": F.col("score_dense_only"), "sparse_only": F.col("score_sparse_only")}
    return X.triples(spark, sf).select("query_id", serve_most_probable(heads, 0.5, 0.1).alias("route"))


@query("ro3_delta_hedge", "SELECT query_id, CASE WHEN abs(dn - sp) < 0.1::DOUBLE THEN 'pure_rrf' WHEN dn > sp THEN 'dense_only' ELSE 'sparse_only' END AS route FROM $scored")
def ro3(spark, sf):
    d, s = F.col("score_dense_only"), F.col("score_sparse_only")
    return X.triples(spark, sf).select("query_id", F.when(F.abs(d - s) < L.d(0.1), "pure_rrf").when(d > s, "dense_only").otherwise("sparse_only").alias("route"))


@query("ro4_rarity_rule", "SELECT query_id, CASE WHEN sp >= 0.3::DOUBLE OR rf >= 0.8::DOUBLE THEN 'sparse_only' WHEN dn * 10 >= 4.5::DOUBLE THEN 'dense_only' ELSE 'sparse_only' END AS route FROM $scored")
def ro4(spark, sf):
    from waymark.functions.routing import rarity_rule

    return X.triples(spark, sf).select("query_id", rarity_rule(F.col("score_sparse_only"), F.col("score_pure_rrf"), F.col("score_dense_only") * 10, oov=0.8).alias("route"))


@query("ro5_acceptability_serve", "SELECT query_id, CASE WHEN sp >= 0.6::DOUBLE THEN 'sparse_only' WHEN dn >= 0.6::DOUBLE THEN 'dense_only' WHEN rf >= 0.6::DOUBLE THEN 'pure_rrf' ELSE win END AS route FROM $shaped")
def ro5(spark, sf):
    """The first route above the threshold in order of cost, else the most probable."""
    first = L.first_route(lambda r: L.score(r) >= L.d(0.6), L.BY_COST)
    return X.triples(spark, sf).select("query_id", F.coalesce(first, L.argmax()).alias("route"))


@query("ro6_logistic_router")
def ro6(spark, sf):
    """Standardised scores, a logistic head weighted to balance; rows: query and probability."""
    from waymark.functions.routing import logistic_head

    rows = X.triples(spark, sf).withColumn("y", (L.argmax() == "dense_only").cast("double"))
    return logistic_head(rows, ["score_pure_rrf", "score_sparse_only"], "y").select("query_id", "p")


@query("ro11_cached_scores", "SELECT query_id, coalesce(c.band, 9) AS band FROM $scored s LEFT JOIN (SELECT query_id AS q, CAST(round(dn * 10) AS INTEGER) AS band FROM $labelled WHERE depth < 3) c ON s.query_id = c.q")
def ro11(spark, sf):
    rows = X.labelled(spark, sf)
    cache = rows.where("depth < 3").select("query_id", F.round(F.col("score_dense_only") * 10).cast("int").alias("band"))
    return rows.select("query_id").join(cache, "query_id", "left").fillna(9, ["band"])


@query("ro12_probe_table", "SELECT query, expected, expected = CASE WHEN regexp_matches(query, '[0-9]') THEN 'sparse_only' ELSE 'dense_only' END AS agrees FROM (VALUES ('error E1234', 'sparse_only'), ('how do plants grow', 'dense_only'), ('blue shoes 42', 'dense_only')) AS p(query, expected)")
def ro12(spark, sf):
    probes = spark.createDataFrame([("error E1234", "sparse_only"), ("how do plants grow", "dense_only"), ("blue shoes 42", "dense_only")], "query string, expected string")
    route = F.when(F.col("query").rlike("[0-9]"), "sparse_only").otherwise("dense_only")
    return probes.select("query", "expected", (F.col("expected") == route).alias("agrees"))


@query("ro13_behavior_audit", "SELECT provenance, round(avg(CASE WHEN w1 = w2 THEN 1.0 ELSE 0.0 END), 6) AS stable, count(*) AS n FROM (SELECT l.provenance, l.win AS w1, s.win2 AS w2 FROM $labelled l JOIN (SELECT query_id, CASE WHEN score_dense_only = h THEN 'dense_only' WHEN score_pure_rrf = h THEN 'pure_rrf' ELSE 'sparse_only' END AS win2 FROM (SELECT *, greatest(score_dense_only, score_pure_rrf, score_sparse_only) AS h FROM $second)) s USING (query_id)) GROUP BY provenance")
def ro13(spark, sf):
    """Whether a paraphrase (here the other stack) gets the same route, by category."""
    one = X.labelled(spark, sf).select("query_id", "provenance", L.argmax().alias("w1"))
    both = one.join(X.second_triples(spark, sf).select("query_id", L.argmax().alias("w2")), "query_id")
    return both.groupBy("provenance").agg(F.round(R.share(F.col("w1") == F.col("w2")), 6).alias("stable"), F.count("*").alias("n"))


# Generation and verification.


@query("gv1_verify_targets", "SELECT query_id, CASE WHEN len(cells) = 0 THEN NULL ELSE dn >= 0.2::DOUBLE AND dn <= 0.8::DOUBLE - 1e-9 END AS ok FROM $celled")
def gv1(spark, sf):
    """A row without a measured cell fails with null."""
    d = F.col("score_dense_only")
    return celled(spark, sf).select("query_id", F.when(F.size("cells") > 0, (d >= L.d(0.2)) & (d <= L.d(0.8) - L.d(1e-9))).alias("ok"))


@query("gv3_decorate", "SELECT query_id, CASE WHEN CAST('0x' || substring(md5('deco:' || query_id), 1, 7) AS BIGINT) % 2 = 0 THEN 'please find ' || query ELSE query || ' for me' END AS child FROM $queries")
def gv3(spark, sf):
    even = A.md5_number(F.lit("deco"), F.col("query_id")) % 2 == 0
    return X.search_queries(spark, sf).select("query_id", F.when(even, F.concat(F.lit("please find "), "query")).otherwise(F.concat("query", F.lit(" for me"))).alias("child"))


@query("gv6_inject_surfaces", "SELECT query_id, query || ' ' || array_to_string(list_filter(['the', 'of', 'zzz'], lambda x: NOT list_contains(w, x)), ' ') AS child FROM (SELECT *, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS w FROM $queries)")
def gv6(spark, sf):
    missing = F.array_except(F.array(F.lit("the"), F.lit("of"), F.lit("zzz")), T.token_set(F.col("query")))
    return X.search_queries(spark, sf).select("query_id", F.concat("query", F.lit(" "), F.array_join(missing, " ")).alias("child"))


@query("gv7_headroom_filter", "SELECT dataset FROM (SELECT dataset, count(*) AS n, avg(CASE WHEN gap >= 0.3::DOUBLE THEN 1.0 ELSE 0.0 END) AS s FROM $shaped GROUP BY dataset) WHERE s * n / (n + 50) >= 0.2")
def gv7(spark, sf):
    out = X.triples(spark, sf).groupBy("dataset").agg(F.count("*").alias("n"), R.share(L.margin() >= L.d(0.3)).alias("s"))
    return out.where(F.col("s") * F.col("n") / (F.col("n") + 50) >= 0.2).select("dataset")


@query("gv8_offers", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey)))[1:3], ',') AS offers FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) >= 3")
def gv8(spark, sf):
    sets = X.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("s")).where(F.size("s") >= 3)
    return sets.select("l_orderkey", F.array_join(F.slice("s", 1, 3).cast("array<string>"), ",").alias("offers"))


@query("gv11_mint_qrels", "SELECT child, doc_id, relevance, 'inherited' AS source FROM $generated JOIN $qrels ON generated_from = query_id WHERE operator = 'typo' UNION ALL SELECT child, generated_from, 2::DOUBLE, 'constructed' FROM $generated WHERE operator = 'swap'")
def gv11(spark, sf):
    g = generated(spark, sf)
    q = X.qrels(spark, sf).withColumnRenamed("query_id", "generated_from")
    inherited = g.where("operator = 'typo'").join(q, "generated_from").select("child", "doc_id", "relevance", F.lit("inherited").alias("source"))
    return inherited.unionByName(g.where("operator = 'swap'").select("child", F.col("generated_from").alias("doc_id"), F.lit(2.0).alias("relevance"), F.lit("constructed").alias("source")))


@query("gv12_surface_mining", "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '[A-Z][a-z]{5,}'))) AS surface FROM pages")
def gv12(spark, sf):
    found = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("[A-Z][a-z]{5,}"), F.lit(0))))
    return X.table(spark, sf, "pages").select("page_id", found.alias("surface"))


@query("gv13_no_new_tokens", r"SELECT query_id, len(list_filter(w, lambda x: NOT list_contains(p, x) AND x NOT IN ('and', 'or'))) = 0 AND NOT list_contains(w, 'not') AS structural FROM (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS w, list_distinct(regexp_extract_all(lower(regexp_replace(query, '[^ \n]+[ \n]*$', '')), '[a-z0-9]+')) AS p FROM $queries)")
def gv13(spark, sf):
    w, p = T.token_set(F.col("query")), T.token_set(F.regexp_replace("query", r"[^ \n]+[ \n]*\z", ""))
    fresh = F.array_except(F.array_except(w, p), F.array(F.lit("and"), F.lit("or")))
    return X.search_queries(spark, sf).select("query_id", ((F.size(fresh) == 0) & ~F.array_contains(w, "not")).alias("structural"))


@query("gv15_judge_worklist", "SELECT query_id, doc_id, CAST((row_number() OVER (ORDER BY query_id, doc_id) - 1) // 10 AS BIGINT) AS chunk FROM $qrels WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM $qrels WHERE relevance = 2)")
def gv15(spark, sf):
    q = X.qrels(spark, sf)
    left = O.difference(q, q.where("relevance = 2"), ["query_id", "doc_id"])
    return left.select("query_id", "doc_id", F.floor((F.row_number().over(every().orderBy("query_id", "doc_id")) - 1) / 10).alias("chunk"))


@query("gv16_judge_cost", "SELECT CAST(sum(length(text) // 3) AS BIGINT) AS tokens, round(sum(length(text) // 3) * 2e-6::DOUBLE, 6) AS dollars FROM $qrels JOIN $corpus USING (doc_id)")
def gv16(spark, sf):
    tokens = F.sum(F.floor(F.length("text") / 3))
    return X.qrels(spark, sf).join(X.corpus(spark, sf), "doc_id").agg(tokens.alias("tokens"), F.round(tokens * 2e-6, 6).alias("dollars"))


@query("gv17_false_positives", "SELECT doc_id, substring(text, 1, 30) AS clip FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND quality = 0")
def gv17(spark, sf):
    return X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id").where("toxic = 0 AND quality = 0").select("doc_id", F.substring("text", 1, 30).alias("clip"))


# Notebook analytics.


@query("nb1_shape_table", "SELECT dataset, CAST(count(*) FILTER (shape = 'routes_differ') AS BIGINT) AS routes_differ, CAST(count(*) FILTER (shape = 'all_tied') AS BIGINT) AS all_tied, CAST(count(*) FILTER (shape = 'all_zero') AS BIGINT) AS all_zero, round(avg(CASE WHEN shape = 'routes_differ' THEN 1.0 ELSE 0.0 END), 6) AS differ_share FROM $shaped GROUP BY dataset")
def nb1(spark, sf):
    rows = X.triples(spark, sf).withColumn("shape", L.outcome_shape())
    return rows.groupBy("dataset").agg(*[R.count_if(F.col("shape") == s).alias(s) for s in ("routes_differ", "all_tied", "all_zero")], F.round(R.share(F.col("shape") == "routes_differ"), 6).alias("differ_share"))


@query("nb2_eta_squared", "SELECT round(sum(n * (m - g) * (m - g)) / any_value(t), 6) AS eta FROM (SELECT dataset, count(*) AS n, avg(gap) AS m FROM $shaped GROUP BY dataset), (SELECT avg(gap) AS g, var_pop(gap) * count(*) AS t FROM $shaped)")
def nb2(spark, sf):
    """Between-group share of the variance from group sums, sums of squares and counts alone."""
    lanes = X.triples(spark, sf).groupBy("dataset").agg(F.count("*").alias("n"), F.sum(L.margin()).alias("s"), F.sum(L.margin() * L.margin()).alias("q"))
    total = lanes.agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    centre = F.col("s") * F.col("s") / F.col("n")
    return total.select(F.round((F.col("b") - centre) / (F.col("q") - centre), 6).alias("eta"))


@query("nb3_top_lane_share", "SELECT win, round(max(n) / sum(n), 6) AS share FROM (SELECT win, dataset, count(*) AS n FROM $shaped GROUP BY ALL) GROUP BY win HAVING sum(n) >= 20")
def nb3(spark, sf):
    counts = X.triples(spark, sf).groupBy(L.argmax().alias("win"), "dataset").agg(F.count("*").alias("n"))
    return counts.groupBy("win").agg(F.sum("n").alias("t"), F.max("n").alias("m")).where("t >= 20").select("win", F.round(F.col("m") / F.col("t"), 6).alias("share"))


@query("nb7_lane_constant_mean", "SELECT round(sum(greatest(d, r, s)) / sum(n), 6) AS mean FROM (SELECT count(*) AS n, sum(dn) AS d, sum(rf) AS r, sum(sp) AS s FROM $scored GROUP BY dataset)")
def nb7(spark, sf):
    best = R.lane_best(X.triples(spark, sf))
    return best.agg(F.round(F.sum(F.col("constant") * F.col("n")) / F.sum("n"), 6).alias("mean"))


@query("nb9_generation_funnel", "SELECT operator, count(*) AS minted, CAST(count(l.doc_id) AS BIGINT) AS judged, CAST(count(*) FILTER (verdict) AS BIGINT) AS passed FROM $generated g LEFT JOIN labels l ON g.n = l.doc_id GROUP BY operator")
def nb9(spark, sf):
    g = generated(spark, sf).join(X.table(spark, sf, "labels").select(F.col("doc_id").alias("n"), F.lit(1).alias("judged")), "n", "left")
    return g.groupBy("operator").agg(F.count("*").alias("minted"), F.count("judged").alias("judged"), R.count_if(F.col("verdict")).alias("passed"))


@query("nb10_leg_selection", "SELECT CASE WHEN (m1, t1) >= (m2, t2) THEN 'first' ELSE 'second' END AS leg, count(*) AS n FROM $views GROUP BY leg")
def nb10(spark, sf):
    leg = F.when(F.struct(L.margin("_1").alias("m"), L.top("_1").alias("t")) >= F.struct(L.margin("_2").alias("m"), L.top("_2").alias("t")), "first").otherwise("second")
    return paired(spark, sf).groupBy(leg.alias("leg")).agg(F.count("*").alias("n"))


@query("nb12_discordant_test", """
WITH c AS (SELECT count(*) FILTER (w1 = 0 AND w2 <> 0) AS a, count(*) FILTER (w1 <> 0 AND w2 = 0) AS b FROM $views), n AS (SELECT *, a + b AS n, least(a, b) AS k FROM c),
t AS (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS tail FROM n, LATERAL (SELECT unnest(range(0, k + 1)) AS i)),
w AS (SELECT *, a / n::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM n), v AS (SELECT *, p + z * z / (2 * n) AS m, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) AS s, 1 + z * z / n AS o FROM w)
SELECT CAST(a AS BIGINT) AS a_only, CAST(b AS BIGINT) AS b_only, CASE WHEN n = 0 THEN 1 ELSE round(least(1, 2 * tail), 9) END AS p, CASE WHEN n = 0 THEN 0 ELSE round((m - s) / o, 9) END AS low, CASE WHEN n = 0 THEN 1 ELSE round((m + s) / o, 9) END AS high FROM v, t""")
def nb12(spark, sf):
    one, two = (L.argmax(s, L.COMBINER_ROUTES) == "dense_only" for s in ("_1", "_2"))
    a, b = paired(spark, sf).agg(R.count_if(one & ~two), R.count_if(~one & two)).first()  # two numbers
    return spark.createDataFrame([(a, b, round(A.binomial_two_sided(a, b), 9), *[round(x, 9) for x in A.wilson(a, a + b)])], "a_only long, b_only long, p double, low double, high double")


@query("nb13_gold_rank_band", "SELECT l_orderkey, CASE WHEN n <= 2 THEN '<=2' WHEN n <= 4 THEN '3-4' WHEN n <= 6 THEN '5-6' ELSE 'absent' END AS band FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def nb13(spark, sf):
    n = F.col("n")
    return X.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).select("l_orderkey", F.when(n <= 2, "<=2").when(n <= 4, "3-4").when(n <= 6, "5-6").otherwise("absent").alias("band"))


@query("nb14_margin_band_accuracy", "SELECT CASE WHEN gap <= 0.1::DOUBLE THEN 'a' WHEN gap <= 0.3::DOUBLE THEN 'b' ELSE 'c' END AS band, count(*) AS n, round(avg(CASE WHEN cheap = win THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(greatest(count(*) FILTER (win = 'dense_only'), count(*) FILTER (win = 'pure_rrf'), count(*) FILTER (win = 'sparse_only')) / count(*), 6) AS majority FROM $shaped GROUP BY band")
def nb14(spark, sf):
    from waymark.functions.bands import cut_right_closed

    rows = X.triples(spark, sf).select(cut_right_closed(L.margin(), [0.1, 0.3], ["a", "b", "c"]).alias("band"), L.argmax().alias("win"), L.derive_route().alias("cheap"))
    most = F.greatest(*[R.count_if(F.col("win") == r) for r in L.ROUTES])
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.round(R.share(F.col("cheap") == F.col("win")), 6).alias("accuracy"), F.round(most / F.count("*"), 6).alias("majority"))


@query("nb16_vote_pattern", "SELECT pattern, count(*) AS n FROM (SELECT CASE WHEN len(v) = 0 THEN 'all_silent' WHEN len(list_distinct(v)) = 1 THEN 'agree' ELSE 'disagree' END AS pattern FROM (SELECT list_filter([CASE WHEN dn > 0.5::DOUBLE THEN 'd' END, CASE WHEN rf > 0.5::DOUBLE THEN 'r' END, CASE WHEN sp > 0.5::DOUBLE THEN 'd' END], lambda x: x IS NOT NULL) AS v FROM $scored)) GROUP BY pattern")
def nb16(spark, sf):
    vote = lambda r, name: F.when(L.score(r) > L.d(0.5), name)
    v = F.array_compact(F.array(vote("dense_only", "d"), vote("pure_rrf", "r"), vote("sparse_only", "d")))
    pattern = F.when(F.size(v) == 0, "all_silent").when(F.size(F.array_distinct(v)) == 1, "agree").otherwise("disagree")
    return X.triples(spark, sf).groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"))


@query("nb18_lane_decisive", "SELECT dataset, count(*) AS labelled, CAST(count(*) FILTER (shape = 'routes_differ') AS BIGINT) AS differ, round(quantile_cont(gap, 0.5), 6) AS median_margin, round(quantile_cont(gap, 0.9), 6) AS p90_margin, CAST(count(*) FILTER (gap >= 0.06::DOUBLE AND hi >= 0.7::DOUBLE) AS BIGINT) AS decisive FROM $shaped GROUP BY dataset")
def nb18(spark, sf):
    q = lambda p: F.round(F.percentile(L.margin(), F.lit(p)), 6)
    return X.triples(spark, sf).groupBy("dataset").agg(F.count("*").alias("labelled"), R.count_if(L.outcome_shape() == "routes_differ").alias("differ"), q(0.5).alias("median_margin"), q(0.9).alias("p90_margin"), R.count_if((L.margin() >= L.d(0.06)) & (L.top() >= L.d(0.7))).alias("decisive"))


@query("nb19_score_pivot", "SELECT shape, CAST(count(*) FILTER (depth = 0) AS BIGINT) AS d0, CAST(count(*) FILTER (depth = 1) AS BIGINT) AS d1, CAST(count(*) FILTER (depth > 1) AS BIGINT) AS more FROM $labelled GROUP BY shape")
def nb19(spark, sf):
    return X.labelled(spark, sf).groupBy(L.outcome_shape().alias("shape")).agg(R.count_if(F.col("depth") == 0).alias("d0"), R.count_if(F.col("depth") == 1).alias("d1"), R.count_if(F.col("depth") > 1).alias("more"))


@query("nb20_dkw_risk", "SELECT dataset, round(least(1, 2 * exp(-2 * n * 0.03::DOUBLE * 0.03::DOUBLE)), 9) AS risk FROM (SELECT dataset, count(*) AS n FROM $triples GROUP BY dataset)")
def nb20(spark, sf):
    n = F.count("*")
    return X.triples(spark, sf).groupBy("dataset").agg(F.round(F.least(F.lit(1.0), 2 * F.exp(-2 * n * 0.03 * 0.03)), 9).alias("risk"))
