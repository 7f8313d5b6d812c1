"""Rewrites, resampling in two levels, further selection steps and notebook analytics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waymark.functions import bands as B
from waymark.functions import damage as D
from waymark.functions import labels as L
from waymark.functions import text as T
from waymark.operators import features as C
from waymark.operators import metrics as M
from waymark.operators import relational as O
from waymark.operators import reports as R
from waymark.operators import retrieval as V
from waymark.operators import selection as S
from waymark.operators import statistics as A
from waymark.operators import worklist as K
from waymark.plans import fixtures as X
from waymark.plans.define import query
from waymark.plans.q_labels import classified
from waymark.plans.q_relational import celled, generated, t
from waymark.plans.q_retrieval import assessed, label_qrels, rankings
from waymark.plans.q_selection import poisson_sql


def every():
    """All rows as one window; only over tables of lanes, cells or bounded draws."""
    return W.partitionBy(F.lit(0))
_NUMBER = "CAST('0x' || substring(md5({}), 1, 7) AS BIGINT)"


def _mistype(w, seed):
    at = f"(CAST({_NUMBER.format(repr(seed + ':') + ' || ' + w)} % greatest(length({w}), 1) + 1 AS INTEGER))"
    return f"(substring({w}, 1, {at} - 1) || translate(substring({w}, {at}, 1), '{D.KEYS}', '{D.NEIGHBOURS}') || substring({w}, {at} + 1))"


@query("fn13_stat_column", "SELECT query_id, score_pure_rrf AS stat FROM $triples")
def fn13(spark, sf):
    """The only column that ends in the suffix; none or several are an error."""
    rows = X.triples(spark, sf)
    found = [c for c in rows.columns if c.endswith("_pure_rrf")]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns with that suffix")
    return rows.select("query_id", F.col(found[0]).alias("stat"))


@query("fn24_mistype", f"SELECT p_partkey, {_mistype('p_brand', 'typo')} AS child FROM (SELECT p_partkey, lower(p_brand) AS p_brand FROM part)")
def fn24(spark, sf):
    return t(spark, sf, "part").select("p_partkey", D.mistype(F.lower("p_brand"), "typo").alias("child"))


@query("gv2_band_to_target", "SELECT * FROM (VALUES ('a', 1::DOUBLE, 3 - 1e-9), ('b', NULL, 0.5::DOUBLE - 1e-9), ('c', 2::DOUBLE, NULL)) AS t(stat, least, most)")
def gv2(spark, sf):
    """Half-open bands as closed targets."""
    bands = [B.Band("a", 1, 3), B.Band("b", None, 0.5), B.Band("c", 2)]
    rows = [(b.column, None if b.at_least is None else float(b.at_least), None if b.below is None else b.below - 1e-9) for b in bands]
    return spark.createDataFrame(rows, "stat string, least double, most double")


@query("gv4_operator_syntax", r"SELECT query_id, regexp_replace(regexp_replace(lower(query), '\b(and|of)\b', 'AND', 'g'), '\b(or|to)\b', 'OR', 'g') AS child FROM $queries")
def gv4(spark, sf):
    rewritten = F.regexp_replace(F.regexp_replace(F.lower("query"), r"\b(and|of)\b", "AND"), r"\b(or|to)\b", "OR")
    return X.search_queries(spark, sf).select("query_id", rewritten.alias("child"))


@query("gv5_shorten", """
SELECT query_id, array_to_string(CASE WHEN len(w) <= 4 THEN w WHEN len(a) <= 4 THEN a ELSE list_filter(a, lambda x: x = 'that' OR list_contains(g, x)) END[1:4], ' ') AS child FROM (SELECT *, list_filter(w, lambda x: x = 'that' OR NOT list_contains(['the', 'of', 'and', 'that'], x)) AS a
FROM (SELECT query_id, regexp_extract_all(lower(query), '[a-z0-9]+') AS w, regexp_extract_all(lower(substring(query, 20)), '[a-z0-9]+') AS g FROM $queries))""")
def gv5(spark, sf):
    words, gold = T.tokens(F.col("query")), T.tokens(F.substring("query", 20, 1000))
    return X.search_queries(spark, sf).select("query_id", F.array_join(D.shorten(words, ["the", "of", "and", "that"], gold, F.array(F.lit("that")), 4), " ").alias("child"))


@query("gv9_seeded_damage", f"SELECT doc_id, strlen(text) AS mojibake_chars, substring(text, 1, greatest(5, CAST({_NUMBER.format(repr('cut:') + ' || CAST(doc_id AS VARCHAR)')} % length(text) AS INTEGER))) AS cut FROM documents")
def gv9(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "text")
    return rows.select("doc_id", F.length(D.mojibake(F.col("text"))).cast("long").alias("mojibake_chars"), D.truncate(F.col("text"), "cut", F.col("doc_id")).alias("cut"))


@query("gv10_degree_corruption", f"SELECT query_id, array_to_string(list_transform(w, lambda x: CASE WHEN md5('deg' || x) <= list_sort(list_transform(w, lambda y: md5('deg' || y)))[least(2, len(w))] THEN {_mistype('x', 'deg')} ELSE x END), ' ') AS child FROM (SELECT query_id, regexp_extract_all(lower(query), '[a-z0-9]+') AS w FROM $queries)")
def gv10(spark, sf):
    return X.search_queries(spark, sf).select("query_id", F.array_join(D.corrupt(T.tokens(F.col("query")), 2, "deg"), " ").alias("child"))


X.SQL["rarest"] = "SELECT query_id, arg_min(term, (coalesce(df, 0), term)) AS term FROM (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+'))) AS term FROM $queries) LEFT JOIN $word_share USING (term) GROUP BY query_id"


@query("gv18_contrast_pairs", "SELECT query_id, term AS rarest, array_to_string(list_transform(w, lambda x: CASE WHEN x = term THEN 'the' ELSE x END), ' ') AS common FROM (SELECT query_id, regexp_extract_all(lower(query), '[a-z0-9]+') AS w FROM $queries) JOIN $rarest USING (query_id)")
def gv18(spark, sf):
    """The rarest word of a query swapped for a common anchor."""
    rows = X.search_queries(spark, sf).select("query_id", T.tokens(F.col("query")).alias("w"))
    df = V.document_frequency(X.corpus(spark, sf))
    rare = rows.select("query_id", F.explode(F.array_distinct("w")).alias("term")).join(df, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("rarest"))
    return rows.join(rare, "query_id").select("query_id", "rarest", F.array_join(D.swap(F.col("w"), F.col("rarest"), "the"), " ").alias("common"))


@query("rt11_reranker_scores", "SELECT query_id, round(max(CASE WHEN s >= f THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS discovered, CAST(count(*) FILTER (s > f AND doc_id IS NULL) AS BIGINT) AS fresh FROM (SELECT r.query_id, l.doc_id, 1.0 / r.rank AS s, min(CASE WHEN l.doc_id IS NOT NULL THEN 1.0 / r.rank END) OVER (PARTITION BY r.query_id) AS f FROM (SELECT * FROM $ranks WHERE route = 'dense_only') r LEFT JOIN $rel l ON r.query_id = l.query_id AND r.doc_id = l.doc_id) GROUP BY query_id")
def rt11(spark, sf):
    """Documents scored above the lowest judged one count as found."""
    met = rankings(spark, sf).where("route = 'dense_only'").join(label_qrels(spark, sf), ["query_id", "doc_id"], "left")
    s = 1.0 / F.col("rank")
    floor = F.min(F.when(F.col("relevance").isNotNull(), s)).over(W.partitionBy("query_id"))
    rows = met.select("query_id", "relevance", s.alias("s"), floor.alias("f"))
    return rows.groupBy("query_id").agg(F.round(F.max(F.when(F.col("s") >= F.col("f"), 1.0).otherwise(0.0)), 6).alias("discovered"), R.count_if((F.col("s") > F.col("f")) & F.col("relevance").isNull()).alias("fresh"))


@query("sa2_two_level_bootstrap", f"""
WITH c AS (SELECT dense_rank() OVER (ORDER BY dataset) - 1 AS lane, row_number() OVER (PARTITION BY dataset ORDER BY cluster) - 1 AS place, n, s FROM (SELECT dataset, cluster, count(*) AS n, sum(hi) AS s FROM $labelled GROUP BY ALL)),
k AS (SELECT lane, count(*) AS k FROM c GROUP BY lane), d AS (SELECT b, slot, {_NUMBER.format("'two:' || CAST(b AS VARCHAR) || ':' || CAST(slot AS VARCHAR)")} % (SELECT count(*) FROM k) AS lane FROM range(60) x(b), range((SELECT count(*) FROM k)) y(slot)),
i AS (SELECT b, slot, d.lane, {_NUMBER.format("'two:' || CAST(b AS VARCHAR) || ':' || CAST(slot AS VARCHAR) || ':' || CAST(j AS VARCHAR)")} % k AS place FROM d JOIN k ON d.lane = k.lane, LATERAL (SELECT unnest(range(k)) AS j)),
m AS (SELECT b, avg(m) AS m FROM (SELECT b, slot, sum(s) / sum(n) AS m FROM i JOIN c ON i.lane = c.lane AND i.place = c.place GROUP BY b, slot) GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(stddev_samp(m), 6) AS se FROM m""")
def sa2(spark, sf):
    sums = X.labelled(spark, sf).groupBy("dataset", "cluster").agg(F.count("*").alias("n"), F.sum(L.top()).alias("total"))
    clusters = sums.select((F.dense_rank().over(every().orderBy("dataset")) - 1).alias("lane"), (F.row_number().over(W.partitionBy("dataset").orderBy("cluster")) - 1).alias("place"), "n", "total")
    return A.interval(A.two_level_bootstrap(clusters, 60, "two"))


@query("sa4_ratio_bootstrap", poisson_sql("SELECT doc_id AS key, CAST(quality AS DOUBLE) AS d FROM labels WHERE toxic = 0", 200, "ratio"))
def sa4(spark, sf):
    """Precision of predictions, resampled by labelled row; resamples without a predicted positive are left out."""
    rows = t(spark, sf, "labels").where("toxic = 0").select(F.col("doc_id").alias("key"), F.col("quality").cast("double").alias("d"))
    return A.interval(A.paired_bootstrap(rows, 200, "ratio").where("mean IS NOT NULL"))


@query("sa11_twin_share", """
WITH w AS (SELECT CAST(item_id AS VARCHAR) AS i, item_id % 4 AS g, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark)
SELECT a.g AS grp, round(avg(CASE WHEN EXISTS (SELECT 1 FROM w b WHERE b.g = a.g AND b.i <> a.i AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) > 0.12) THEN 1.0 ELSE 0.0 END), 6) AS twins FROM w a GROUP BY a.g""")
def sa11(spark, sf):
    """Rows with a similar row of their own group; rows meet by shared tokens only."""
    rows = t(spark, sf, "benchmark").select(F.col("item_id").alias("i"), (F.col("item_id") % 4).alias("grp"), T.token_set(F.col("text")).alias("w"))
    tokens = rows.select("i", "grp", F.size("w").alias("n"), F.explode("w").alias("t"))
    other = tokens.select(F.col("i").alias("j"), "grp", F.col("n").alias("m"), "t")
    both = tokens.join(other, ["grp", "t"]).where("i <> j").groupBy("i", "j", "n", "m").agg(F.count("*").alias("both"))
    twins = both.where(F.col("both") / (F.col("n") + F.col("m") - F.col("both")) > 0.12).select("i").distinct().withColumn("twin", F.lit(True))
    return rows.join(twins, "i", "left").groupBy("grp").agg(F.round(R.share(F.col("twin")), 6).alias("twins"))


@query("sa16_coordinate_ascent")
def sa16(spark, sf):
    """Two thresholds, each moved in turn to its best of 19 values, twice; every step is one aggregate over the rows."""
    d, p, s = (L.score(r) for r in L.ROUTES)
    rows = X.triples(spark, sf).select(d.alias("d"), p.alias("p"), s.alias("s"))
    values, at = [i / 20 for i in range(1, 20)], [0.5, 0.5]

    def reward(a, b):
        return F.avg(F.when(F.col("d") >= a, F.col("d") - 0.01).when(F.col("s") >= b, F.col("s")).otherwise(F.col("p") - 0.02))

    best = 0.0
    for _ in range(2):
        for head in (0, 1):
            trial = [[v if i == head else x for i, x in enumerate(at)] for v in values]
            got = rows.agg(*[F.round(reward(*x), 9) for x in trial]).first()  # one row of 19 numbers
            best = max(x or 0.0 for x in got)
            at = trial[[x or 0.0 for x in got].index(best)]
    return spark.createDataFrame([(at[0], at[1], best)], "dense double, sparse double, reward double")


@query("sa18_nuisance_gap", "SELECT round(avg(CASE WHEN l.win = c.best THEN 1.0 ELSE 0.0 END) - max(g.m), 6) AS gap FROM $labelled l JOIN (SELECT dataset, arg_max(win, (n, win)) AS best FROM (SELECT dataset, win, count(*) AS n FROM $labelled GROUP BY ALL) GROUP BY dataset) c USING (dataset), (SELECT max(n) / sum(n) AS m FROM (SELECT count(*) AS n FROM $labelled GROUP BY win)) g")
def sa18(spark, sf):
    """How much knowing the lane alone gains over the majority."""
    counts = X.labelled(spark, sf).groupBy("dataset", L.argmax().alias("win")).agg(F.count("*").alias("n"))
    by_lane = counts.groupBy("dataset").agg(F.max("n").alias("best"), F.sum("n").alias("n")).agg((F.sum("best") / F.sum("n")).alias("a"))
    overall = counts.groupBy("win").agg(F.sum("n").alias("n")).agg((F.max("n") / F.sum("n")).alias("m"))
    return by_lane.join(overall, F.lit(True)).select(F.round(F.col("a") - F.col("m"), 6).alias("gap"))  # one row each


@query("sl7_order_sheet", "SELECT name, CAST(1000000 - n AS BIGINT) AS augmentation_rows FROM (SELECT name, count(*) AS n FROM (SELECT unnest(cells) AS name FROM $celled) GROUP BY name) WHERE n < 1000000")
def sl7(spark, sf):
    counts = celled(spark, sf).select(F.explode("cells").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return counts.where("n < 1000000").select("name", (F.lit(1_000_000) - F.col("n")).alias("augmentation_rows"))


@query("sl11_class_draw")
def sl11(spark, sf):
    """Groups of interchangeable rows are counted by Spark, the greedy draw runs on the counts, and ranks pick the rows."""
    rows = celled(spark, sf).withColumn("sig", F.array_join("cells", ","))
    counts = rows.groupBy("dataset", "sig").agg(F.count("*").alias("n")).collect()  # lanes x signatures
    drawn = S.draw_class({(r["dataset"], tuple(r["sig"].split(","))): r["n"] for r in counts}, 120, 40)
    wanted = spark.createDataFrame([(lane, ",".join(sig), n) for (lane, sig), n in sorted(drawn.items())], "dataset string, sig string, want int")
    return S.matched_draw(rows.select("dataset", "sig", "query_id"), wanted, ["dataset", "sig"], "class", "query_id")


@query("sl16_lane_order")
def sl16(spark, sf):
    lanes = X.triples(spark, sf).groupBy("dataset").agg(F.count("*").alias("n")).collect()  # one row a lane
    order = S.lane_order({r["dataset"]: r["n"] for r in lanes}, {"A-F": 100}, 0.25, 2000)
    return spark.createDataFrame(sorted(order.items()), "dataset string, rows long")


@query("sl17_sheet_admission", "SELECT child FROM (SELECT child, row_number() OVER (PARTITION BY operator, home_lane ORDER BY md5('adm:' || child), child) AS k FROM $generated WHERE gate = 'none' OR coalesce(verdict, false)) WHERE k <= 8")
def sl17(spark, sf):
    ok = generated(spark, sf).where((F.col("gate") == "none") | F.coalesce("verdict", F.lit(False)))
    return O.keep_one(ok, ["operator", "home_lane"], [O.draw_key("adm", "child"), F.col("child")], 8).select("child")


@query("sl29_floors_from_dials", "SELECT name, CAST(greatest(50, ceil(0.4::DOUBLE * 1200 / count(*) OVER ())) AS BIGINT) AS floor FROM (SELECT DISTINCT unnest(cells) AS name FROM $celled)")
def sl29(spark, sf):
    names = celled(spark, sf).select(F.explode("cells").alias("name")).distinct()
    return names.select("name", F.greatest(F.lit(50), F.ceil(F.lit(0.4 * 1200) / F.count("*").over(every()))).alias("floor"))


@query("sl32_label_run_publish", "SELECT row_number() OVER (ORDER BY md5('pub:' || query_id), query_id) AS place, query_id, cheap AS route FROM $labelled WHERE depth = 3")
def sl32(spark, sf):
    """Exactly one label for each planned row and no others, in plan order."""
    rows = X.labelled(spark, sf).where("depth = 3")
    drawn = rows.select("query_id", F.struct(O.draw_key("pub", "query_id"), "query_id").alias("draw"))
    plan = A.numbered(drawn, "draw", "place").select("query_id", F.col("place").cast("long").alias("place"))
    made = rows.select("query_id", L.derive_route().alias("route"))
    O.require_none(O.difference(plan, made, "query_id"), "planned rows without a label")
    O.require_none(O.difference(made, plan, "query_id"), "labels nobody planned")
    return plan.join(made, "query_id")


@query("sl37_class_share_cap")
def sl37(spark, sf):
    rows = classified(X.labelled(spark, sf)).where("certified").select("query_id", "route_class")
    return S.class_share_cap(rows, "route_class", 0.4, "share", "query_id")


@query("sl39_staged_dispatch", "SELECT query_id FROM $celled WHERE depth > 0 AND stage IS NOT NULL AND list_contains(cells, 'fused_mid') AND NOT list_contains(cells, 'dense_high')")
def sl39(spark, sf):
    """Selecting filters first, then eligibility, then the constraint."""
    staged = celled(spark, sf).where("depth > 0").where("stage IS NOT NULL")
    return staged.where(F.array_contains("cells", "fused_mid")).where(~F.array_contains("cells", "dense_high")).select("query_id")


@query("nb4_capped_supply", "SELECT CAST(sum(least(n, 300)) AS BIGINT) AS supply FROM (SELECT dataset, count(*) AS n FROM $shaped WHERE gap >= 0.3::DOUBLE GROUP BY dataset)")
def nb4(spark, sf):
    counts = X.triples(spark, sf).where(L.margin() >= L.d(0.3)).groupBy("dataset").agg(F.count("*").alias("n"))
    return counts.agg(F.sum(F.least("n", F.lit(300))).alias("supply"))


@query("nb5_novelty_survival", """
WITH q AS (SELECT CAST(query_id AS INTEGER) AS i, query_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS w FROM $queries), n AS (SELECT a.query_id, 1 - max(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))) AS v FROM q a, q b WHERE a.i % 4 > 0 AND b.i % 4 = 0 GROUP BY a.query_id)
SELECT th / 10::DOUBLE AS theta, round(avg(CASE WHEN round(v, 9) >= th / 10::DOUBLE THEN 1.0 ELSE 0.0 END), 6) AS survival FROM n, (VALUES (7), (8), (9)) AS t(th) GROUP BY th""")
def nb5(spark, sf):
    rows = X.search_queries(spark, sf).select("query_id", F.col("query_id").cast("int").alias("i"), T.token_set(F.col("query")).alias("w"))
    tokens = rows.select("query_id", "i", F.size("w").alias("n"), F.explode("w").alias("t"))
    seed = tokens.where("i % 4 = 0").select(F.col("query_id").alias("c"), F.col("n").alias("m"), "t")
    best = tokens.where("i % 4 > 0").join(seed, "t").groupBy("query_id", "c", "n", "m").agg(F.count("*").alias("b")).groupBy("query_id").agg(F.max(F.col("b") / (F.col("n") + F.col("m") - F.col("b"))).alias("j"))
    novelty = rows.where("i % 4 > 0").join(best, "query_id", "left").select(F.round(1 - F.coalesce("j", F.lit(0.0)), 9).alias("v"), F.explode(F.array(*[F.lit(x / 10) for x in (7, 8, 9)])).alias("theta"))
    return novelty.groupBy("theta").agg(F.round(R.share(F.col("v") >= F.col("theta")), 6).alias("survival"))


@query("nb8_balanced_split", r"""
WITH d AS (SELECT min(doc_id) AS doc_id, min_by(lang, doc_id) AS lang FROM documents GROUP BY trim(regexp_replace(lower(text), '\s+', ' ', 'g'))), c AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM d GROUP BY lang)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('mix:' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM d) SELECT doc_id, lang, k.k <= round(0.25::DOUBLE * n) AS is_eval FROM k, c WHERE k.k <= n""")
def nb8(spark, sf):
    """Distinct texts, classes brought to the size of the rarest, a fixed share of each held out."""
    docs = t(spark, sf, "documents").groupBy(F.sha2(T.normalize(F.col("text")), 256).alias("fp")).agg(F.min(F.struct("doc_id", "lang")).alias("r")).select("r.*")
    least = docs.groupBy("lang").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0  # one number
    placed = docs.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(O.draw_key("mix", "doc_id"), "doc_id"))).where(F.col("k") <= least)
    return placed.select("doc_id", "lang", (F.col("k") <= F.round(F.lit(0.25 * least))).alias("is_eval"))


@query("nb11_binary_ndcg", """
SELECT m.query_id, m.route, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM (SELECT r.query_id, r.route, sum(CASE WHEN l.doc_id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM $ranks r LEFT JOIN $rel l ON r.query_id = l.query_id AND r.doc_id = l.doc_id GROUP BY ALL) m
LEFT JOIN (SELECT query_id, sum(CASE WHEN k <= 100 THEN 1 / log2(k + 1) ELSE 0 END) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS k FROM $rel) GROUP BY query_id) i ON m.query_id = i.query_id""")
def nb11(spark, sf):
    return M.assess(rankings(spark, sf), label_qrels(spark, sf).withColumn("relevance", F.lit(1.0)), 100).select("query_id", "route", F.round("ndcg", 6).alias("ndcg"))


@query("nb15_pooled_verdict", "SELECT round(avg(m), 6) AS mean, CASE WHEN avg(m) - 1.96 * stddev_samp(m) / sqrt(count(*)) > 0 THEN 'PASS' WHEN avg(m) + 1.96 * stddev_samp(m) / sqrt(count(*)) < 0 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict FROM (SELECT avg(rf - dn) AS m FROM $scored GROUP BY dataset HAVING count(*) >= 50)")
def nb15(spark, sf):
    """Lanes with enough rows count alike; the interval of their mean decides."""
    lanes = X.triples(spark, sf).groupBy("dataset").agg(F.avg(L.score("pure_rrf") - L.score("dense_only")).alias("m"), F.count("*").alias("n")).where("n >= 50")
    out = lanes.agg(F.avg("m").alias("a"), (F.stddev_samp("m") / F.sqrt(F.count("*")) * 1.96).alias("w"))
    return out.select(F.round("a", 6).alias("mean"), F.when(F.col("a") - F.col("w") > 0, "PASS").when(F.col("a") + F.col("w") < 0, "FAIL").otherwise("INCONCLUSIVE").alias("verdict"))


@query("nb17_quintile_split", """
WITH e AS (SELECT quantile_cont(n_chars, 0.2) AS a, quantile_cont(n_chars, 0.4) AS b, quantile_cont(n_chars, 0.6) AS c, quantile_cont(n_chars, 0.8) AS d FROM documents), q AS (SELECT doc_id, CAST(CASE WHEN n_chars <= a THEN 0 WHEN n_chars <= b THEN 1 WHEN n_chars <= c THEN 2 WHEN n_chars <= d THEN 3 ELSE 4 END AS INTEGER) AS quintile FROM documents, e)
SELECT doc_id, quintile FROM (SELECT *, row_number() OVER (PARTITION BY quintile ORDER BY md5('q:' || CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY quintile) AS n FROM q) WHERE k <= round(0.1::DOUBLE * n)""")
def nb17(spark, sf):
    """Quantile edges keep ties together; a tenth of each quintile is drawn."""
    docs = t(spark, sf, "documents").select("doc_id", "n_chars")
    edges = docs.agg(F.percentile("n_chars", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8))))).first()[0]  # four numbers
    x = F.col("n_chars")
    quintile = F.when(x <= edges[0], 0).when(x <= edges[1], 1).when(x <= edges[2], 2).when(x <= edges[3], 3).otherwise(4)
    rows = docs.select("doc_id", quintile.alias("quintile"))
    return S.matched_draw(rows, rows.groupBy("quintile").agg(F.round(0.1 * F.count("*")).alias("want")), ["quintile"], "q", "doc_id").select("doc_id", "quintile")


@query("nb21_objective_variants", "SELECT route, round(avg(0.7::DOUBLE * hit + 0.3::DOUBLE * ndcg), 6) AS router, round(avg(ndcg), 6) AS ndcg, round(avg(0.7::DOUBLE * hit + 0.3::DOUBLE * ndcg * ndcg - 0.3::DOUBLE * recall * (1 - ndcg)), 6) AS wasted FROM $assessed GROUP BY route")
def nb21(spark, sf):
    out = assessed(spark, sf).groupBy("route")
    return out.agg(F.round(F.avg(M.router_objective()), 6).alias("router"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg(M.wasted_recall_objective()), 6).alias("wasted"))


@query("ro7_feature_space", "SELECT CAST(count(*) FILTER (dn > 0) >= 100 AS INTEGER) + CAST(count(*) FILTER (rf > 0) >= 100 AS INTEGER) + CAST(count(*) FILTER (sp > 0.75::DOUBLE) >= 1000000 AS INTEGER) AS columns FROM $scored")
def ro7(spark, sf):
    """Columns that fire often enough."""
    fires = X.triples(spark, sf).agg(R.count_if(F.col("score_dense_only") > 0).alias("d"), R.count_if(F.col("score_pure_rrf") > 0).alias("r"), R.count_if(F.col("score_sparse_only") > 0.75).alias("s"))
    return fires.select(((F.col("d") >= 100).cast("int") + (F.col("r") >= 100).cast("int") + (F.col("s") >= 1_000_000).cast("int")).alias("columns"))


@query("ro7_principal_components")
def ro7_components(spark, sf):
    """Vectors on their first 50 principal directions."""
    return C.principal_components(t(spark, sf, "embeddings"), "vec_id", "embedding", 50)


_GRAMS = "list_transform(range(1, greatest(length(w) + 4 - n, 1)), lambda i: substring(' ' || w || ' ', i, n))"


@query("ro8_character_ngrams", f"SELECT query_id, len(grams) AS grams, len(list_distinct(grams)) AS different FROM (SELECT query_id, flatten(list_transform(list_filter(string_split_regex(lower(query), '\\s+'), lambda w: w <> ''), lambda w: flatten(list_transform([3, 4, 5], lambda n: {_GRAMS})))) AS grams FROM $queries)")
def ro8(spark, sf):
    """Character 3- to 5-grams within word borders, the input of hashed features."""
    grams = X.search_queries(spark, sf).select("query_id", C.border_grams(F.col("query")).alias("g"))
    return grams.select("query_id", F.size("g").cast("long").alias("grams"), F.size(F.array_distinct("g")).cast("long").alias("different"))


@query("ro8_ngram_svd")
def ro8_svd(spark, sf):
    """Hashed n-grams of the queries on their first 128 singular directions."""
    return C.truncated_svd(C.hashed_grams(X.search_queries(spark, sf), "query_id", "query"), "query_id", 128)


@query("ro9_neural_router")
def ro9(spark, sf):
    """A multilayer perceptron on the logistic head's targets."""
    rows = X.triples(spark, sf).withColumn("y", (L.argmax() == "dense_only").cast("double"))
    return C.neural_head(rows, ["score_pure_rrf", "score_sparse_only"], "y").select("query_id", "p")


@query("rt5_bounded_retries", """
SELECT o_orderkey, CASE WHEN n < 4 THEN 'seen ' || o_orderkey END AS answer, CAST(least(n + 1, 4) AS INTEGER) AS attempts, CASE WHEN n >= 4 THEN 'transient: busy' END AS fault FROM (SELECT o_orderkey, o_orderkey % 6 AS n FROM orders)""")
def rt5(spark, sf):
    """A service that is busy for the first key % 6 calls; four attempts in all."""
    calls = {}

    def busy(payload):
        calls[payload] = n = calls.get(payload, 0) + 1
        if n >= 4 or n > int(payload) % 6:
            del calls[payload]  # the last call for this payload
        if n <= int(payload) % 6:
            raise K.Transient("busy")
        return f"seen {payload}"

    rows = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("payload"))
    return K.answered(rows, "o_orderkey", "payload", busy, rest=lambda seconds: None)


@query("gv14_budgeted_calls", "SELECT o_orderkey, upper(o_orderstatus) || '!' AS answer, 1::INTEGER AS attempts, NULL::VARCHAR AS fault FROM (SELECT *, sum(o_orderkey % 7 + 1) OVER (ORDER BY o_orderkey) AS spent FROM orders) WHERE spent <= 3000")
def gv14(spark, sf):
    """Calls in plan order while their costs stay below a ceiling."""
    rows = t(spark, sf, "orders").select("o_orderkey", F.upper("o_orderstatus").alias("payload"), (F.col("o_orderkey") % 7 + 1).alias("cost"))
    return K.answered(K.within_budget(rows, "o_orderkey", "cost", 3000), "o_orderkey", "payload", lambda payload: payload + "!")


@query("sl41_lane_turns")
def sl41(spark, sf):
    """Lanes are served in turns of 30 rows; lanes whose name ends in O have a fault after every turn, and two chances."""
    lanes = X.triples(spark, sf).groupBy("dataset").agg(F.count("*").alias("n")).orderBy("dataset").collect()  # one row a lane
    state = K.take_turns({r["dataset"]: min(r["n"], 100) for r in lanes}, lambda lane, n: (min(n, 30), True) if lane.endswith("O") else (n, False), 450, 2)
    return spark.createDataFrame([(lane, s["made"], s["chances"], s["dropped"]) for lane, s in state.items()], "dataset string, made int, chances int, dropped boolean")


@query("ro10_boosted_trees")
def ro10(spark, sf):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = X.triples(spark, sf).withColumn("y", (L.argmax() == "dense_only").cast("double"))
    x = VectorAssembler(inputCols=["score_pure_rrf", "score_sparse_only"], outputCol="x").transform(rows)
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=5, maxDepth=3, seed=1).fit(x)
    return model.transform(x).select("query_id", F.round(vector_to_array("probability")[1], 6).alias("p"))


@query("sc30_release_union", "SELECT dataset, query_id, 'second' AS source FROM $second WHERE score_pure_rrf >= 0.3::DOUBLE UNION ALL SELECT dataset, query_id, 'first' FROM $triples WHERE (dataset, query_id) NOT IN (SELECT (dataset, query_id) FROM $second WHERE score_pure_rrf >= 0.3::DOUBLE)")
def sc30(spark, sf):
    keys = ["dataset", "query_id"]
    a = X.triples(spark, sf).select(*keys, F.lit("first").alias("source"))
    return O.priority_union([a, X.second_triples(spark, sf).where(F.col("score_pure_rrf") >= 0.3).select(*keys, F.lit("second").alias("source"))], keys)


@query("pf3_cell_loader", "SELECT * FROM (VALUES ('dense_high', 1, 0), ('fused_mid', 1, 0), ('sparse_low', 1, 2)) AS c(name, bands, alternatives)")
def pf3(spark, sf):
    cells = B.load_cells([{"name": "dense_high", "predicate": [["d", 0.7]]}, {"name": "fused_mid", "predicate": [["p", 0.3, 0.7]]}, {"name": "sparse_low", "predicate": [["s", None, 0.2]], "any_of": [[["p", 0.5]], [["d", 0.5]]]}])
    return spark.createDataFrame([(c.name, len(c.predicate), len(c.any_of)) for c in cells], "name string, bands int, alternatives int")


# The columns that a candidate table must have, and those that only labelling can know.
CANDIDATE_COLUMNS = ["row_id", "dataset", "query_id", "query", "provenance", "family", "cells"]
POST_LABEL_COLUMNS = ["rung", "version", "route_class", "route_class_any", "margin", "oracle", "route_scores", "route_rankings", "kind", "depth", "certified", "is_decisive", "is_hybrid", "is_waste", "winner"]


@query("pf16_post_label_refusal", "SELECT query_id AS row_id, dataset, query_id, query_id AS query, provenance, CAST(cluster AS VARCHAR) AS family, cells FROM (SELECT l.*, c.cells FROM $labelled l JOIN (SELECT query_id, array_to_string(cells, ',') AS cells FROM $celled) c USING (query_id))")
def pf16(spark, sf):
    """Candidates may not carry what only labelling can know."""
    rows = celled(spark, sf).select(
        F.col("query_id").alias("row_id"), "dataset", "query_id", F.col("query_id").alias("query"), "provenance", F.col("cluster").cast("string").alias("family"), F.array_join("cells", ",").alias("cells"),
    )
    return O.require(rows, CANDIDATE_COLUMNS, forbidden=POST_LABEL_COLUMNS)


@query("wn7_history_prefix", "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM conversations")
def wn7(spark, sf):
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return t(spark, sf, "conversations").select("conv_id", "turn", F.count("*").over(before).alias("earlier"))


@query("tk2_route_fetch_limit", "SELECT query_id, route, doc_id FROM $ranks WHERE rank <= 15")
def tk2(spark, sf):
    return rankings(spark, sf).where("rank <= 15").select("query_id", "route", "doc_id")


@query("sa5_paired_interval", poisson_sql("SELECT query_id AS key, rf - dn AS d FROM $scored", 200, "audit"))
def sa5(spark, sf):
    """Mean difference of two routes on the same queries, with a bootstrap interval."""
    rows = X.triples(spark, sf).select(F.col("query_id").alias("key"), (L.score("pure_rrf") - L.score("dense_only")).alias("d"))
    return A.interval(A.paired_bootstrap(rows, 200, "audit"))


@query("sa6_power")
def sa6(spark, sf):
    """Power at several effects for the standard error that the lane bootstrap gives."""
    lanes = X.triples(spark, sf).groupBy("dataset").agg(F.count("*").alias("n"), F.sum(L.top()).alias("total"))
    se = A.interval(A.lane_bootstrap(lanes.withColumn("position", F.row_number().over(every().orderBy("dataset")) - 1), 200, "power")).first()["se"]
    rows = [(d, round(A.power(d, max(se or 0.0, 1e-9)), 9)) for d in (0.02, 0.03, 0.05, 0.1)]
    return spark.createDataFrame(rows, "effect double, power double")


@query("sl18_requirement_composer")
def sl18(spark, sf):
    """The most under-covered requirement first; each lane holds a fixed share of the target at most."""
    target = 90
    rows = celled(spark, sf).where(F.size("cells") > 0)
    shaped = rows.select(F.col("query_id").alias("row_id"), F.col("dataset").alias("lane"), F.coalesce("stage", F.lit("none")).alias("family"), "provenance", F.col("cells").alias("strata"))
    floors = {c: max(25, int(0.5 * target / 3)) for c in ("dense_high", "fused_mid", "sparse_low")}
    return S.cover_shortlist(shaped, target).withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda pdf: S.cover(pdf, floors, target, 0.25), "row_id string, stratum string, lane string, rank long")


@query("nb6_widest_gap", """
WITH d AS (SELECT query_id, doc_id, max(CASE WHEN route = 'dense_only' AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) - max(CASE WHEN route = 'sparse_only' AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS w FROM $ranks GROUP BY ALL),
r AS (SELECT d.*, l.doc_id IS NOT NULL AS judged FROM d LEFT JOIN $rel l ON d.query_id = l.query_id AND d.doc_id = l.doc_id), b AS (SELECT query_id, sum(CASE WHEN judged THEN w ELSE 0 END) AS base FROM r GROUP BY query_id), n AS (SELECT query_id, count(*) AS n FROM $rel GROUP BY query_id),
s AS (SELECT query_id, sum(w) OVER (PARTITION BY query_id ORDER BY w DESC, doc_id ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER (PARTITION BY query_id ORDER BY w DESC, doc_id ROWS UNBOUNDED PRECEDING) AS m FROM r WHERE NOT judged AND w > 0 UNION ALL SELECT query_id, 0, 0 FROM b)
SELECT s.query_id, round(max(CASE WHEN coalesce(n, 0) + m > 0 THEN (base + s) / list_sum(list_transform(range(1, least(coalesce(n, 0) + m, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END), 6) AS gap FROM s JOIN b ON s.query_id = b.query_id LEFT JOIN n ON s.query_id = n.query_id GROUP BY s.query_id""")
def nb6(spark, sf):
    return M.widest_gap(rankings(spark, sf), label_qrels(spark, sf), "dense_only", "sparse_only")
