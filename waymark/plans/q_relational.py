"""Sources, predicates, joins, windows, top-k and set operations (SC, PF, JN, WN, TK, ST)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waymark.functions import labels as L
from waymark.operators import relational as O
from waymark.operators import reports as R
from waymark.operators import statistics as A
from waymark.plans import fixtures as X
from waymark.plans.define import query
from waymark.plans.q_labels import classified

KEYS = ["dataset", "query_id"]


def order():
    """The order number in a query id."""
    return F.split("query_id", ":")[0].cast("long")


def t(spark, sf, name):
    return X.table(spark, sf, name)


@query("sc1_lane_snapshot", "SELECT query_id, q.query, (SELECT count(*) FROM $qrels r WHERE r.query_id = q.query_id) AS judgments FROM $queries q")
def sc1(spark, sf):
    """Queries of a lane with the number of their judgments."""
    counts = X.qrels(spark, sf).groupBy("query_id").agg(F.count("*").alias("judgments"))
    return X.search_queries(spark, sf).join(counts, "query_id", "left").fillna(0, ["judgments"])


@query("sc3_query_subset", "SELECT query_id, doc_id, relevance FROM $qrels WHERE query_id IN (SELECT query_id FROM $queries WHERE CAST(query_id AS INTEGER) % 2 = 0)")
def sc3(spark, sf):
    return O.subset(X.qrels(spark, sf), X.search_queries(spark, sf).where(F.col("query_id").cast("int") % 2 == 0), "query_id")


@query("sc4_query_supplement", """
SELECT query_id, query FROM $queries UNION ALL SELECT CAST(doc_id AS VARCHAR), text FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT query_id FROM $queries)""")
def sc4(spark, sf):
    extra = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    return O.supplement(X.search_queries(spark, sf), extra, ["query_id"])


@query("sc5_corpus_target", "SELECT DISTINCT o_custkey AS lane, CAST(least(greatest(round_even(n / 0.2::DOUBLE, 0), 10), 60) AS BIGINT) AS target FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def sc5(spark, sf):
    counts = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("lane")).agg(F.count("*").alias("n"))
    return counts.select("lane", O.corpus_target(F.col("n"), 0.2, 10, 60).alias("target"))


@query("sc6_corpus_materialize", """
WITH j AS (SELECT DISTINCT doc_id FROM $qrels WHERE relevance >= 1), f AS (SELECT * FROM $corpus WHERE doc_id IN (SELECT doc_id FROM j)), r AS (SELECT * FROM $corpus WHERE doc_id NOT IN (SELECT doc_id FROM j))
SELECT doc_id, lane FROM f UNION ALL (SELECT doc_id, lane FROM r ORDER BY md5('corpus:' || doc_id), doc_id LIMIT (SELECT CAST(least(greatest(round_even(count(*) / 0.2::DOUBLE, 0), 150), 100000) AS BIGINT) - count(*) FROM f))""")
def sc6(spark, sf):
    """The target follows from how many documents are judged relevant, so no table can ask for fewer than those."""
    return O.materialize(X.corpus(spark, sf), X.qrels(spark, sf), O.corpus_size(0.2, 150, 100_000), "corpus").select("doc_id", "lane")


@query("sc7_reservoir", "SELECT event_id, event_type FROM events ORDER BY md5('reservoir:' || CAST(event_id AS VARCHAR)), event_id LIMIT 500")
def sc7(spark, sf):
    return O.sample(t(spark, sf, "events"), 500, "reservoir", "event_id").select("event_id", "event_type")


@query("sc10_gold_explode", "SELECT query_id, doc_id, 1::DOUBLE AS relevance FROM (SELECT CAST(o_orderkey AS VARCHAR) AS query_id, unnest(string_split(o_orderpriority || ',N/A,,' || o_orderstatus, ',')) AS doc_id FROM orders) WHERE doc_id NOT IN ('', 'N/A')")
def sc10(spark, sf):
    """Lists of gold ids as rows, empty ones and N/A left out."""
    gold = F.split(F.concat_ws(",", "o_orderpriority", F.lit("N/A"), F.lit(""), "o_orderstatus"), ",")
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("query_id"), F.explode(gold).alias("doc_id"))
    return rows.where(~F.col("doc_id").isin("", "N/A")).withColumn("relevance", F.lit(1.0))


@query("sc11_letter_grades", "SELECT o_orderkey AS query_id, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 WHEN 'P' THEN 0 END AS relevance, o_orderstatus || ' ' || o_orderpriority AS text FROM orders WHERE o_orderpriority <> '5-LOW'")
def sc11(spark, sf):
    grade = F.create_map(*[F.lit(x) for x in ("F", 2, "O", 1, "P", 0)])[F.col("o_orderstatus")]
    return t(spark, sf, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("query_id"), grade.alias("relevance"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("text"))


@query("sc12_passage_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies, md5(text) AS fp FROM documents GROUP BY text")
def sc12(spark, sf):
    """Equal texts by their digests (256 and 128 bits), so that texts are not shuffled."""
    digests = t(spark, sf, "documents").select("doc_id", F.md5("text").alias("fp"), F.sha2("text", 256).alias("whole"))
    return digests.groupBy("whole", "fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies", "fp")


@query("sc13_term_ids", "SELECT substring(sha1(lower(trim(p_name))), 1, 16) AS query_id, string_agg(p_brand || ': ' || p_type, chr(10) ORDER BY p_partkey) AS attributes FROM part GROUP BY lower(trim(p_name))")
def sc13(spark, sf):
    """Query ids from normalized terms; attributes gathered to lines in a stated order."""
    lines = F.array_sort(F.collect_list(F.struct("p_partkey", F.concat_ws(": ", "p_brand", "p_type").alias("line"))))
    grouped = t(spark, sf, "part").groupBy(F.lower(F.trim("p_name")).alias("term")).agg(lines.alias("lines"))
    return grouped.select(F.substring(F.sha1("term"), 1, 16).alias("query_id"), F.array_join(F.col("lines.line"), "\n").alias("attributes"))


@query("sc15_click_pairs", "SELECT user_id, event_type, count(*) AS clicks FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY user_id, event_type")
def sc15(spark, sf):
    wanted = t(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return O.subset(t(spark, sf, "events"), wanted, "user_id").groupBy("user_id", "event_type").agg(F.count("*").alias("clicks"))


@query("sc16_fetch_documents", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT item_id * 3 FROM benchmark)")
def sc16(spark, sf):
    return O.subset(t(spark, sf, "documents").select("doc_id", "lang"), t(spark, sf, "benchmark").select((F.col("item_id") * 3).alias("doc_id")), "doc_id")


@query("sc18_seeded_sample", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM (SELECT event_id FROM events ORDER BY md5('queries:' || CAST(event_id AS VARCHAR)), event_id LIMIT 100)")
def sc18(spark, sf):
    """A draw, numbered in source order."""
    chosen = O.sample(t(spark, sf, "events").select("event_id"), 100, "queries", "event_id")
    return chosen.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("event_id")).cast("long"))


@query("sc19_registry_overview", "SELECT n_name AS dataset, count(c_custkey) AS cached FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey WHERE n_regionkey < 3 GROUP BY n_name")
def sc19(spark, sf):
    cards = t(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_name").alias("dataset"), F.col("n_nationkey").alias("c_nationkey"))
    return cards.join(t(spark, sf, "customer"), "c_nationkey", "left").groupBy("dataset").agg(F.count("c_custkey").alias("cached"))


@query("sc20_language_filter", r"""
SELECT doc_id, en > other AS is_english, regexp_matches(text, '[\x{4E00}-\x{9FFF}]') AS has_cjk FROM (SELECT doc_id, text, len(list_intersect(w, ['the', 'of', 'and', 'is', 'to'])) AS en, len(list_intersect(w, ['der', 'die', 'und', 'le', 'la', 'les', 'de', 'los', 'que'])) AS other
FROM (SELECT doc_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents))""")
def sc20(spark, sf):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    marks = lambda *w: F.size(F.array_intersect(words, F.array(*map(F.lit, w))))
    english = marks("the", "of", "and", "is", "to") > marks("der", "die", "und", "le", "la", "les", "de", "los", "que")
    return t(spark, sf, "documents").select("doc_id", english.alias("is_english"), F.col("text").rlike("[\\u4E00-\\u9FFF]").alias("has_cjk"))


@query("sc21_nested_flatten", "SELECT event_type AS category, CAST(i - 1 AS INTEGER) AS position, ids[i] AS question FROM (SELECT event_type, ids, unnest(range(1, len(ids) + 1)) AS i FROM (SELECT event_type, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY event_type))")
def sc21(spark, sf):
    """A map of lists as rows with their place in the list. The test tables hold the rows and not the map: gathering a list per category
    would bring a third of them into one task, so places come from counts of ranges."""
    rows = t(spark, sf, "events").where("event_id IS NOT NULL").select(F.col("event_type").alias("category"), F.col("event_id").alias("question"))
    return A.numbered_within(rows, "category", "question", "at").select("category", F.col("at").cast("int").alias("position"), "question")


@query("sc22_dialogue_history", "SELECT conv_id, turn, concat_ws(chr(10), string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '[CURRENT] ' || text) AS query FROM conversations")
def sc22(spark, sf):
    return O.dialogue_history(t(spark, sf, "conversations"), "conv_id", "turn", "text")


@query("sc25_append_keep_last", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def sc25(spark, sf):
    return O.keep_one(t(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value")


@query("sc26_append_keep_first", "SELECT event_id, 'new' AS origin FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) UNION ALL SELECT o_orderkey, 'current' FROM orders WHERE o_orderkey % 2 = 0")
def sc26(spark, sf):
    current = t(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("event_id"), F.lit("current").alias("origin")).distinct()
    fresh = O.difference(t(spark, sf, "events").select("event_id", F.lit("new").alias("origin")), current, "event_id")
    return current.unionByName(fresh)


@query("sc28_vector_cache_misses", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)")
def sc28(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", "label")
    return O.difference(e.select("vec_id"), e.where("label < 5"), "vec_id")


@query("sc29_incremental_fill", "SELECT vec_id, label < 5 AS cached, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm FROM embeddings")
def sc29(spark, sf):
    """Cached vectors as they are, missing ones computed and appended."""
    norm = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4)
    e = t(spark, sf, "embeddings").select("vec_id", "label", norm.alias("norm"))
    have = e.where("label < 5").select("vec_id", F.lit(True).alias("cached"), "norm")
    return have.unionByName(O.difference(e, have, "vec_id").select("vec_id", F.lit(False).alias("cached"), "norm"))


# Predicates.


@query("pf1_band_predicate", "SELECT dataset, query_id FROM $scored WHERE dn >= 0.3::DOUBLE AND dn < 0.7::DOUBLE")
def pf1(spark, sf):
    from waymark.functions.bands import Band

    return X.triples(spark, sf).where(Band("score_dense_only", 0.3, 0.7).mask()).select(*KEYS)


@query("pf2_cell_predicate", "SELECT dataset, query_id FROM $scored WHERE rf >= 0.2::DOUBLE AND (dn >= 0.8::DOUBLE OR sp < 0.1::DOUBLE)")
def pf2(spark, sf):
    from waymark.functions.bands import Band, Cell

    cell = Cell("c", [Band("score_pure_rrf", 0.2)], [[Band("score_dense_only", 0.8)], [Band("score_sparse_only", below=0.1)]])
    return X.triples(spark, sf).where(cell.mask()).select(*KEYS)


def _cells():
    from waymark.functions.bands import Band, Cell

    return [Cell("dense_high", [Band("score_dense_only", 0.7)]), Cell("fused_mid", [Band("score_pure_rrf", 0.3, 0.7)]), Cell("sparse_low", [Band("score_sparse_only", below=0.2)], [[Band("score_pure_rrf", 0.5)], [Band("score_dense_only", 0.5)]])]


X.SQL["celled"] = """
SELECT *, list_filter([CASE WHEN dn >= 0.7::DOUBLE THEN 'dense_high' END, CASE WHEN rf >= 0.3::DOUBLE AND rf < 0.7::DOUBLE THEN 'fused_mid' END, CASE WHEN sp < 0.2::DOUBLE AND (rf >= 0.5::DOUBLE OR dn >= 0.5::DOUBLE) THEN 'sparse_low' END], lambda x: x IS NOT NULL) AS cells FROM $labelled
"""


def celled(spark, sf):
    from waymark.functions.bands import memberships

    return X.labelled(spark, sf).withColumn("cells", memberships(_cells()))


@query("pf4_multi_membership", "SELECT dataset, query_id, array_to_string(cells, ',') AS cells FROM $celled")
def pf4(spark, sf):
    return celled(spark, sf).select(*KEYS, F.array_join("cells", ",").alias("cells"))


@query("pf5_unclaimed", "SELECT dataset, query_id FROM $celled WHERE len(cells) = 0")
def pf5(spark, sf):
    return celled(spark, sf).where(F.size("cells") == 0).select(*KEYS)


@query("pf6_derived_totals", "SELECT dataset, query_id, round(dn + rf + sp, 6) AS total FROM $scored")
def pf6(spark, sf):
    from waymark.functions.bands import prefix_total

    rows = X.triples(spark, sf)
    return rows.select(*KEYS, F.round(prefix_total(rows.columns, "score_"), 6).alias("total"))


@query("pf7_relevant", "SELECT query_id, doc_id FROM $qrels WHERE relevance >= CASE WHEN CAST(query_id AS INTEGER) % 2 = 0 THEN 2 ELSE 1 END")
def pf7(spark, sf):
    """Judgments at or above their lane's threshold."""
    lanes = spark.createDataFrame([(0, 2.0), (1, 1.0)], "lane int, min_relevance double")
    return X.qrels(spark, sf).withColumn("lane", F.col("query_id").cast("int") % 2).join(lanes, "lane").where("relevance >= min_relevance").select("query_id", "doc_id")


@query("pf8_text_bearing", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND trim(text) <> ''")
def pf8(spark, sf):
    return t(spark, sf, "conversations").where(F.col("text").isNotNull() & (F.trim("text") != "")).select("conv_id", "turn")


@query("pf9_answer_covered", "SELECT query_id FROM $queries WHERE query_id IN (SELECT query_id FROM $qrels WHERE relevance >= 2)")
def pf9(spark, sf):
    return O.subset(X.search_queries(spark, sf), X.qrels(spark, sf).where("relevance >= 2"), "query_id").select("query_id")


@query("pf10_all_documents_covered", "SELECT query_id FROM $qrels r LEFT JOIN (SELECT doc_id FROM $corpus WHERE lane <> 'fr') c ON r.doc_id = c.doc_id GROUP BY query_id HAVING bool_and(c.doc_id IS NOT NULL)")
def pf10(spark, sf):
    present = X.corpus(spark, sf).where("lane <> 'fr'").select("doc_id", F.lit(True).alias("there"))
    return X.qrels(spark, sf).join(present, "doc_id", "left").groupBy("query_id").agg(F.bool_and(F.col("there").isNotNull()).alias("ok")).where("ok").select("query_id")


@query("pf11_content_coverage", """
SELECT query_id, sha256(string_agg(doc_id, '|' ORDER BY doc_id)) AS manifest FROM (SELECT query_id, r.doc_id, c.doc_id AS there FROM $qrels r LEFT JOIN (SELECT doc_id FROM $corpus WHERE trim(title || text) <> '' AND lane <> 'es') c ON r.doc_id = c.doc_id)
GROUP BY query_id HAVING count(there) = count(*)""")
def pf11(spark, sf):
    """Queries all of whose judged documents have content, with an id of that set."""
    present = X.corpus(spark, sf).where((F.trim(F.concat("title", "text")) != "") & (F.col("lane") != "es")).select("doc_id", F.col("doc_id").alias("there"))
    rows = X.qrels(spark, sf).join(present, "doc_id", "left").groupBy("query_id").agg(F.count("there").alias("kept"), F.count("*").alias("n"), F.array_sort(F.collect_list("doc_id")).alias("docs"))
    return rows.where("kept = n").select("query_id", F.sha2(F.array_join("docs", "|"), 256).alias("manifest"))


X.SQL["generated"] = """
SELECT 'aug-' || CASE doc_id % 2 WHEN 0 THEN 'swap' ELSE 'typo' END || '-' || CAST(d.doc_id AS VARCHAR) AS child, CAST(d.doc_id AS VARCHAR) AS generated_from, lang AS home_lane,
  CASE d.doc_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'coherence_gate' ELSE 'declaration_audit' END AS gate, CASE d.doc_id % 2 WHEN 0 THEN 'swap' ELSE 'typo' END AS operator, l.quality = 1 AS verdict, d.doc_id AS n
FROM documents d LEFT JOIN labels l USING (doc_id)
"""


def generated(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    op = F.when(F.col("doc_id") % 2 == 0, "swap").otherwise("typo")
    gate = F.when(F.col("doc_id") % 3 == 0, "none").when(F.col("doc_id") % 3 == 1, "coherence_gate").otherwise("declaration_audit")
    return d.select(F.concat_ws("-", F.lit("aug"), op, "doc_id").alias("child"), F.col("doc_id").cast("string").alias("generated_from"), F.col("lang").alias("home_lane"), gate.alias("gate"), op.alias("operator"), (F.col("quality") == 1).alias("verdict"), F.col("doc_id").alias("n"))


@query("pf12_gate_admission", "SELECT child FROM $generated WHERE CASE gate WHEN 'none' THEN true WHEN 'coherence_gate' THEN coalesce(verdict, false) WHEN 'declaration_audit' THEN n IN (SELECT item_id * 5 + 2 FROM benchmark) ELSE false END")
def pf12(spark, sf):
    passed = t(spark, sf, "benchmark").select((F.col("item_id") * 5 + 2).alias("n"), F.lit(True).alias("passed"))
    rows = generated(spark, sf).join(passed, "n", "left")
    ok = F.when(F.col("gate") == "none", True).when(F.col("gate") == "coherence_gate", F.coalesce("verdict", F.lit(False))).when(F.col("gate") == "declaration_audit", F.coalesce("passed", F.lit(False))).otherwise(False)
    return rows.where(ok).select("child")


@query("pf13_lane_minted_admission", """
WITH s AS (SELECT home_lane, count(verdict) AS judged, avg(CASE WHEN verdict THEN 1.0 WHEN NOT verdict THEN 0.0 END) AS rate FROM $generated GROUP BY home_lane)
SELECT child FROM $generated g JOIN s USING (home_lane) WHERE CASE WHEN verdict THEN true WHEN NOT verdict THEN false ELSE judged >= 10 AND rate >= 0.85 END""")
def pf13(spark, sf):
    """An own verdict decides; unjudged rows flow where their lane's pilot is large and good enough."""
    rows = generated(spark, sf)
    lanes = rows.groupBy("home_lane").agg(F.count("verdict").alias("judged"), F.avg(F.col("verdict").cast("double")).alias("rate"))
    return rows.join(lanes, "home_lane").where(F.coalesce("verdict", (F.col("judged") >= 10) & (F.col("rate") >= 0.85))).select("child")


@query("pf14_rejects", """
SELECT doc_id, CASE WHEN n = '' THEN 'empty' WHEN n LIKE 'the %' THEN 'refusal' WHEN taken THEN 'taken' WHEN contains(lower(text), n) THEN 'verbatim' ELSE 'ok' END AS verdict
FROM (SELECT doc_id, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS n, doc_id % 50 = 0 AS taken FROM documents)""")
def pf14(spark, sf):
    from waymark.functions.text import normalize

    taken = t(spark, sf, "documents").where("doc_id % 50 = 0").select("doc_id", F.lit(True).alias("taken"))
    n = normalize(F.col("text"))
    rows = t(spark, sf, "documents").join(taken, "doc_id", "left").withColumn("n", n)
    verdict = F.when(F.col("n") == "", "empty").when(F.col("n").startswith("the "), "refusal").when(F.col("taken"), "taken").when(F.lower("text").contains(F.col("n")), "verbatim").otherwise("ok")
    return rows.select("doc_id", verdict.alias("verdict"))


@query("pf15_indexable_count", "SELECT count(DISTINCT CASE WHEN trim(title || text) <> '' THEN doc_id END) AS indexable FROM $corpus")
def pf15(spark, sf):
    return X.corpus(spark, sf).agg(F.count_distinct(F.when(F.trim(F.concat("title", "text")) != "", F.col("doc_id"))).alias("indexable"))


@query("pf17_rename_on_clash", "SELECT a.dataset, a.query_id, a.depth, b.stage AS stage_selected, a.stage FROM $labelled a JOIN $labelled b ON a.query_id = b.query_id WHERE a.depth = 4")
def pf17(spark, sf):
    rows = X.labelled(spark, sf).select(*KEYS, "depth", "stage")
    carried = rows.select("query_id", F.col("stage").alias("stage_selected"))
    return rows.where("depth = 4").join(carried, "query_id")


# Joins.


@query("jn1_left_composite", "SELECT a.dataset, a.query_id, round(b.score_pure_rrf, 6) AS carried FROM $labelled a LEFT JOIN (SELECT * FROM $second WHERE score_pure_rrf > 0.5::DOUBLE) b ON a.query_id = b.query_id AND a.dataset = b.dataset")
def jn1(spark, sf):
    carry = X.second_triples(spark, sf).where(F.col("score_pure_rrf") > 0.5).select(*KEYS, F.round("score_pure_rrf", 6).alias("carried"))
    return X.triples(spark, sf).select(*KEYS).join(carry, KEYS, "left")


@query("jn2_inner_suffixes", "SELECT a.query_id, round(a.score_dense_only, 6) AS score_golden, round(b.score_dense_only, 6) AS score_candidate FROM $triples a JOIN $second b ON a.dataset = b.dataset AND a.query_id = b.query_id")
def jn2(spark, sf):
    a = X.triples(spark, sf).select(*KEYS, F.round("score_dense_only", 6).alias("score_golden"))
    return a.join(X.second_triples(spark, sf).select(*KEYS, F.round("score_dense_only", 6).alias("score_candidate")), KEYS).drop("dataset")


def validated_join(plan, labels, keys):
    """Plan rows with their labels, whose columns win; errors on duplicate keys and on rows without a label."""
    for name, df in (("plan", plan), ("label", labels)):
        O.require_none(df.groupBy(*keys).count().where("count > 1"), f"duplicate {name} keys")
    O.require_none(O.difference(plan, labels, keys), "plan rows without a label")
    own = [c for c in plan.columns if c in keys or c not in labels.columns]
    return plan.select(*own).join(labels, list(keys), "left")


@query("jn3_validated_join", "SELECT query_id, depth, round(score_dense_only, 6) AS score FROM (SELECT l.query_id, l.depth, s.score_dense_only FROM $labelled l JOIN $triples s ON l.query_id = s.query_id WHERE l.depth = 1)")
def jn3(spark, sf):
    plan = X.labelled(spark, sf).where("depth = 1").select("query_id", "depth")
    return validated_join(plan, X.triples(spark, sf).select("query_id", F.round("score_dense_only", 6).alias("score")), ["query_id"])


@query("jn4_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn4(spark, sf):
    keep = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return O.subset(t(spark, sf, "orders"), keep, "o_custkey").select("o_orderkey")


@query("jn5_anti_join_worklist", "SELECT query_id FROM $triples WHERE query_id NOT IN (SELECT query_id FROM $labelled WHERE depth < 4)")
def jn5(spark, sf):
    return O.difference(X.triples(spark, sf).select("query_id"), X.labelled(spark, sf).where("depth < 4"), "query_id")


@query("jn6_key_map", "SELECT c.c_custkey, coalesce(n.n_name, 'parent-' || CAST(c.c_nationkey % 3 AS VARCHAR)) AS name FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON c.c_nationkey = n.n_nationkey")
def jn6(spark, sf):
    names = t(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t(spark, sf, "customer").join(names, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.concat(F.lit("parent-"), (F.col("c_nationkey") % 3).cast("string"))).alias("name"))


@query("jn7_filter_after_equi_join", "SELECT l.l_orderkey, l.l_partkey FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey AND l.l_extendedprice >= p.p_retailprice * 20")
def jn7(spark, sf):
    parts = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return t(spark, sf, "lineitem").join(parts, "l_partkey").where(F.col("l_extendedprice") >= F.col("p_retailprice") * 20).select("l_orderkey", "l_partkey")


@query("jn8_subset_containment", """
WITH p AS (SELECT o_orderkey, list_distinct(list(l_returnflag || l_linestatus)) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey), c AS (SELECT l_suppkey, list_distinct(list(l_returnflag || l_linestatus)) AS s FROM lineitem GROUP BY l_suppkey),
l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT p.o_orderkey AS parent, CAST(count(*) AS BIGINT) AS grounded, CAST(max(len(c.s)) AS INTEGER) AS deepest FROM p JOIN l ON p.o_orderkey = l.l_orderkey JOIN c ON l.l_suppkey = c.l_suppkey WHERE len(c.s) >= 2 AND len(list_filter(c.s, lambda x: NOT list_contains(p.s, x))) = 0 GROUP BY p.o_orderkey""")
def jn8(spark, sf):
    """Documents whose surfaces are all offered by the parent, where the two are linked at all."""
    lines = t(spark, sf, "lineitem")
    return _grounded(lines, lines)


def _grounded(lines, surfaces):
    offered = lines.groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("offered"))
    own = surfaces.groupBy("l_suppkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("own"))
    links = lines.select("l_orderkey", "l_suppkey").distinct()
    met = links.join(offered, "l_orderkey").join(own, "l_suppkey").where((F.size("own") >= 2) & (F.size(F.array_except("own", "offered")) == 0))
    return met.groupBy(F.col("l_orderkey").alias("parent")).agg(F.count("*").alias("grounded"), F.max(F.size("own")).alias("deepest"))


@query("jn10_inherited_qrels", "SELECT g.child, r.doc_id, r.relevance FROM $generated g JOIN $qrels r ON g.generated_from = r.query_id WHERE g.home_lane <> 'fr'")
def jn10(spark, sf):
    children = generated(spark, sf).where("home_lane <> 'fr'").select("child", F.col("generated_from").alias("query_id"))
    return children.join(X.qrels(spark, sf), "query_id").select("child", "doc_id", "relevance")


@query("jn11_qrel_backfill", "SELECT child, EXISTS (SELECT 1 FROM $qrels r WHERE r.query_id = generated_from) AS filled FROM $generated WHERE generated_from NOT IN (SELECT query_id FROM $qrels WHERE relevance >= 2 AND CAST(query_id AS INTEGER) % 2 = 0)")
def jn11(spark, sf):
    """Children without a judgment yet, and whether another look at their parents gives one."""
    q = X.qrels(spark, sf)
    known = q.where((F.col("relevance") >= 2) & (F.col("query_id").cast("int") % 2 == 0)).select(F.col("query_id").alias("generated_from"))
    parents = q.select(F.col("query_id").alias("generated_from"), F.lit(True).alias("there")).distinct()
    return O.difference(generated(spark, sf), known, "generated_from").join(parents, "generated_from", "left").select("child", F.coalesce("there", F.lit(False)).alias("filled"))


@query("jn12_join_text", "SELECT r.query_id, r.doc_id, length(c.text) AS chars FROM $qrels r JOIN $corpus c ON r.doc_id = c.doc_id")
def jn12(spark, sf):
    rows = X.qrels(spark, sf).join(X.corpus(spark, sf).select("doc_id", "text"), "doc_id", "left")
    O.require_none(rows.where("text IS NULL"), "judged documents without text")
    return rows.select("query_id", "doc_id", F.length("text").cast("long").alias("chars"))


@query("jn13_arm_pivot", "SELECT o_custkey AS pair_id, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS common, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS rare FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey")
def jn13(spark, sf):
    rows = t(spark, sf, "orders").where("o_orderstatus IN ('F', 'O')").select(F.col("o_custkey").alias("pair_id"), F.col("o_orderstatus").alias("arm"))
    return rows.groupBy("pair_id").pivot("arm", ["F", "O"]).count().fillna(0).withColumnsRenamed({"F": "common", "O": "rare"})


@query("jn14_two_leg_compare", "SELECT a.query_id, a.cheap AS route_leg1, b.cheap AS route_legb, a.cheap = b.cheap AS same FROM $shaped a JOIN (SELECT query_id, CASE WHEN h - score_sparse_only <= 1e-9 THEN 'sparse_only' WHEN h - score_dense_only <= 1e-9 THEN 'dense_only' ELSE 'pure_rrf' END AS cheap FROM (SELECT *, greatest(score_dense_only, score_pure_rrf, score_sparse_only) AS h FROM $second)) b ON a.query_id = b.query_id")
def jn14(spark, sf):
    a = X.triples(spark, sf).select("query_id", L.derive_route().alias("route_leg1"))
    b = X.second_triples(spark, sf).select("query_id", L.derive_route().alias("route_legb"))
    return a.join(b, "query_id").withColumn("same", F.col("route_leg1") == F.col("route_legb"))


@query("jn15_outcome_rates", "SELECT l.query_id, round(r.rate, 6) AS lane_rate FROM $labelled l LEFT JOIN (SELECT dataset, avg(CASE WHEN shape = 'routes_differ' THEN 1.0 ELSE 0.0 END) AS rate FROM $labelled WHERE depth < 3 GROUP BY dataset) r ON l.dataset = r.dataset")
def jn15(spark, sf):
    rows = X.labelled(spark, sf)
    rates = rows.where("depth < 3").groupBy("dataset").agg(F.round(R.share(L.outcome_shape() == "routes_differ"), 6).alias("lane_rate"))
    return rows.select("dataset", "query_id").join(rates, "dataset", "left").drop("dataset")


# Windows, top-k and sets.


@query("wn1_interleaved_turns", "SELECT dataset, query_id, row_number() OVER (PARTITION BY dataset ORDER BY md5('draw:' || query_id), query_id) AS turn FROM $triples")
def wn1(spark, sf):
    return O.interleaved(X.triples(spark, sf).select(*KEYS), "dataset", "draw", "query_id").withColumn("turn", F.col("turn").cast("long"))


@query("wn2_first_of_group", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k <= 5")
def wn2(spark, sf):
    return O.keep_one(t(spark, sf, "events"), ["event_type"], [F.col("event_id")], 5).select("event_type", "event_id")


@query("wn3_keep_first_keep_last", "SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
def wn3(spark, sf):
    at = F.struct("o_orderdate", "o_orderkey")
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_order"), F.max_by("o_orderkey", at).alias("last_order"))


@query("wn4_group_manifest", "SELECT l_orderkey, l_linenumber, l_partkey, sha256(string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_partkey) OVER (PARTITION BY l_orderkey)) AS manifest FROM lineitem")
def wn4(spark, sf):
    """The id of a group's sorted members on each of its rows."""
    return _manifests(t(spark, sf, "lineitem"))


def _manifests(rows):
    lines = rows.select("l_orderkey", "l_linenumber", "l_partkey")
    ids = lines.groupBy("l_orderkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l_partkey")).cast("array<string>"), "|"), 256).alias("manifest"))
    return lines.join(ids, "l_orderkey")


@query("wn6_rank_within_ranking", "SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS place FROM lineitem")
def wn6(spark, sf):
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", place.cast("long").alias("place"))


@query("wn8_plan_order", "SELECT row_number() OVER (ORDER BY md5('plan:' || query_id), query_id) AS plan_rank, query_id, cheap AS route FROM $shaped WHERE gap >= 0.6::DOUBLE")
def wn8(spark, sf):
    """Labels joined to a plan keep the plan's order as a column."""
    rows = X.triples(spark, sf).where(L.margin() >= L.d(0.6))
    drawn = rows.select("query_id", F.struct(O.draw_key("plan", "query_id"), "query_id").alias("draw"))
    plan = A.numbered(drawn, "draw", "plan_rank").select("query_id", F.col("plan_rank").cast("long").alias("plan_rank"))
    return plan.join(rows.select("query_id", L.derive_route().alias("route")), "query_id")


@query("tk1_stable_top_k", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, k FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k <= 3")
def tk1(spark, sf):
    k = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    return t(spark, sf, "lineitem").withColumn("k", k).where("k <= 3").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "k")


@query("tk3_total_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_custkey, o_orderkey) AS place FROM orders ORDER BY place LIMIT 200")
def tk3(spark, sf):
    top = t(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_custkey", "o_orderkey").limit(200)
    return top.select("o_orderkey", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("o_totalprice"), "o_custkey", "o_orderkey")).cast("long").alias("place"))


@query("tk4_hungry_first", "SELECT cell, missing, row_number() OVER (ORDER BY missing DESC, cell) AS place FROM (SELECT cell, 1000000 - count(*) AS missing FROM (SELECT unnest(cells) AS cell FROM $celled) GROUP BY cell) WHERE missing > 0")
def tk4(spark, sf):
    counts = celled(spark, sf).select(F.explode("cells").alias("cell")).groupBy("cell").agg((F.lit(1_000_000) - F.count("*")).alias("missing")).where("missing > 0")
    return counts.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("missing"), "cell")).cast("long"))


@query("tk5_proportional_cap", "SELECT dataset, query_id FROM (SELECT dataset, query_id, row_number() OVER (PARTITION BY dataset ORDER BY query_id) AS k, count(*) OVER (PARTITION BY dataset) AS n, count(*) OVER () AS a FROM $triples) WHERE k <= greatest(1, ceil(300 * n / a))")
def tk5(spark, sf):
    return O.proportional_cap(X.triples(spark, sf).select(*KEYS), "dataset", 300, [F.col("query_id")])


@query("tk6_largest_remainder", "SELECT dataset, n, CAST(f + CASE WHEN row_number() OVER (ORDER BY round(e - f, 9) DESC, dataset) <= 1000 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT *, floor(e) AS f FROM (SELECT dataset, count(*) AS n, 1000 * count(*) / sum(count(*)) OVER () AS e FROM $triples GROUP BY dataset))")
def tk6(spark, sf):
    return O.quotas(X.triples(spark, sf).groupBy("dataset").agg(F.count("*").alias("n")), 1000, "n", "dataset")


@query("tk7_first_fit", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS pick FROM orders GROUP BY o_custkey")
def tk7(spark, sf):
    return O.keep_one(t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("pick"))


@query("tk8_distance_order", "SELECT query_id, round(d, 6) AS distance, row_number() OVER (ORDER BY round(d, 6), query_id) AS place FROM (SELECT query_id, CASE WHEN dn >= 0.4::DOUBLE AND dn < 0.6::DOUBLE THEN -1 WHEN dn < 0.4::DOUBLE THEN 0.4::DOUBLE - dn ELSE dn - 0.6::DOUBLE END AS d FROM $scored) ORDER BY place LIMIT 500")
def tk8(spark, sf):
    """Rows already in the band first, the others by their distance to it."""
    x = L.score("dense_only")
    distance = F.round(F.when((x >= 0.4) & (x < 0.6), -1.0).when(x < 0.4, L.d(0.4) - x).otherwise(x - L.d(0.6)), 6)
    top = X.triples(spark, sf).select("query_id", distance.alias("distance")).orderBy("distance", "query_id").limit(500)
    return top.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("distance", "query_id")).cast("long"))


@query("tk9_argmax_row", "SELECT query_id, win AS best, CASE WHEN dn = lo THEN 'dense_only' WHEN rf = lo THEN 'pure_rrf' ELSE 'sparse_only' END AS worst FROM $shaped")
def tk9(spark, sf):
    return X.triples(spark, sf).select("query_id", L.argmax().alias("best"), L.first_route(lambda r: L.score(r) == L.low(), L.ROUTES).alias("worst"))


@query("st1_cascade_union", "SELECT dataset, query_id, round(score_dense_only, 6) AS score, 'second' AS origin FROM $second WHERE score_dense_only > 0.02::DOUBLE UNION ALL SELECT dataset, query_id, round(score_dense_only, 6), 'first' FROM $triples WHERE (dataset, query_id) NOT IN (SELECT (dataset, query_id) FROM $second WHERE score_dense_only > 0.02::DOUBLE)")
def st1(spark, sf):
    pick = lambda df, name: df.select(*KEYS, F.round("score_dense_only", 6).alias("score"), F.lit(name).alias("origin"))
    return O.priority_union([pick(X.triples(spark, sf), "first"), pick(X.second_triples(spark, sf).where(F.col("score_dense_only") > 0.02), "second")], KEYS)


X.SQL["judgments"] = """
SELECT query_id, doc_id, relevance, CASE WHEN relevance = 2 THEN 'human' ELSE 'click' END AS source, 0 AS seq FROM $qrels UNION ALL SELECT query_id, doc_id, 3 - relevance, CASE WHEN relevance = 2 THEN 'llm' ELSE 'constructed' END, 1 FROM $qrels
"""


def judgments(spark, sf):
    q = X.qrels(spark, sf)
    a = q.withColumns({"source": F.when(F.col("relevance") == 2, "human").otherwise("click"), "seq": F.lit(0)})
    return a.unionByName(q.select("query_id", "doc_id", (3 - F.col("relevance")).alias("relevance"), F.when(F.col("relevance") == 2, "llm").otherwise("constructed").alias("source"), F.lit(1).alias("seq")))


PRECEDENCE = ["human", "constructed", "click", "llm"]


@query("st2_qrel_precedence", "SELECT query_id, doc_id, relevance, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY list_position(['human', 'constructed', 'click', 'llm'], source), seq) AS k FROM $judgments) WHERE k = 1")
def st2(spark, sf):
    return O.resolve_conflicts(judgments(spark, sf), PRECEDENCE, ["query_id", "doc_id"]).drop("seq")


@query("st3_labelled_pool_union", "SELECT query_id, dataset, rung = 'base' AS native, rung, first_value(stage IGNORE NULLS) OVER (PARTITION BY dataset ORDER BY query_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lane_stage FROM (SELECT *, CASE WHEN depth < 3 THEN 'base' ELSE 'rung_a' END AS rung FROM $labelled)")
def st3(spark, sf):
    """Pools of several rungs; the lane's first known stage, in order of query, fills in."""
    rows = X.labelled(spark, sf)
    both = O.priority_union([rows.where("depth < 3").withColumn("rung", F.lit("base")), rows.where("depth >= 2").withColumn("rung", F.lit("rung_a"))], KEYS, last_wins=False)
    lanes = both.where("stage IS NOT NULL").groupBy("dataset").agg(F.min_by("stage", "query_id").alias("lane_stage"))
    return both.join(lanes, "dataset", "left").select("query_id", "dataset", (F.col("rung") == "base").alias("native"), "rung", "lane_stage")


@query("st4_candidate_universe", "SELECT query_id, 'natural' AS origin FROM $queries UNION ALL SELECT DISTINCT generated_from, 'augmented' FROM $generated WHERE generated_from NOT IN (SELECT query_id FROM $queries)")
def st4(spark, sf):
    natural = X.search_queries(spark, sf).select("query_id", F.lit("natural").alias("origin"))
    return O.supplement(natural, generated(spark, sf).select(F.col("generated_from").alias("query_id"), F.lit("augmented").alias("origin")), ["query_id"])


@query("st5_needs_label", "SELECT query_id FROM $labelled WHERE depth > 1 EXCEPT SELECT query_id FROM $labelled WHERE depth > 3")
def st5(spark, sf):
    rows = X.labelled(spark, sf)
    return rows.where("depth > 1").select("query_id").exceptAll(rows.where("depth > 3").select("query_id"))


@query("st6_intersect_counts", "SELECT greatest((SELECT count(*) FROM (SELECT query_id FROM $labelled WHERE depth > 1 INTERSECT SELECT query_id FROM $labelled WHERE o % 2 = 0)) - (SELECT count(*) FROM $labelled WHERE depth = 4), 0) AS ready")
def st6(spark, sf):
    rows = X.labelled(spark, sf)
    both = rows.where("depth > 1").select("query_id").intersect(rows.where(order() % 2 == 0).select("query_id"))
    counted = both.select(F.lit(1).alias("n")).unionByName(rows.where("depth = 4").select(F.lit(-1).alias("n")))
    return counted.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(0)).alias("ready"))


@query("st8_cluster_lookup", "SELECT a.query_id, coalesce(CAST(b.cluster AS VARCHAR), 'solo:' || a.dataset || ':' || a.query_id) AS cluster FROM $labelled a LEFT JOIN (SELECT * FROM $labelled WHERE depth > 0) b ON a.query_id = b.query_id")
def st8(spark, sf):
    rows = X.labelled(spark, sf)
    known = rows.where("depth > 0").select("query_id", F.col("cluster").cast("string").alias("known"))
    return rows.join(known, "query_id", "left").select("query_id", F.coalesce("known", F.concat_ws(":", F.lit("solo"), "dataset", "query_id")).alias("cluster"))


def families(children, parents):
    """A child's family is its parent's key, any other row's its own; a parent that is itself a child is an error."""
    O.require_none(children.join(children.select(F.col("child").alias("parent")), "parent", "left_semi"), "more than one generation")
    return parents.select(F.col("parent").alias("row"), F.col("parent").alias("family")).unionByName(children.select(F.col("child").alias("row"), F.col("parent").alias("family")))


@query("st9_generation_family", "SELECT 'c' || CAST(c_custkey AS VARCHAR) AS row, 'c' || CAST(c_custkey AS VARCHAR) AS family FROM customer UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), 'c' || CAST(o_custkey AS VARCHAR) FROM orders")
def st9(spark, sf):
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    children = t(spark, sf, "orders").select(named("o", "o_orderkey").alias("child"), named("c", "o_custkey").alias("parent"))
    return families(children, t(spark, sf, "customer").select(named("c", "c_custkey").alias("parent")))


@query("st10_leak_fence", "SELECT query_id FROM $labelled WHERE cluster IN (SELECT cluster FROM $labelled WHERE o % 50 = 0) OR o IN (SELECT o FROM $labelled WHERE o % 50 = 0)")
def st10(spark, sf):
    """All rows that share a cluster or a family with the reserve."""
    rows = X.labelled(spark, sf).withColumn("family", order())
    reserve = rows.where("family % 50 = 0")
    return O.subset(rows, reserve, "cluster").unionByName(O.subset(rows, reserve, "family")).select("query_id").distinct()


@query("st11_leak_share", "SELECT round(avg(CASE WHEN cluster IN (SELECT cluster FROM $labelled WHERE o % 5 > 0 AND o % 3 = 0) THEN 1.0 ELSE 0.0 END), 6) AS leak FROM $labelled WHERE o % 5 = 0")
def st11(spark, sf):
    rows = X.labelled(spark, sf)
    train = rows.where((order() % 5 > 0) & (order() % 3 == 0)).select("cluster").distinct().withColumn("there", F.lit(True))
    return rows.where(order() % 5 == 0).join(train, "cluster", "left").agg(F.round(R.share(F.col("there").isNotNull()), 6).alias("leak"))


@query("st12_set_algebra", "SELECT query_id, array_to_string(list_sort(list_filter(['dense_high', 'fused_mid', 'sparse_low'], lambda x: NOT list_contains(cells, x))), ',') AS uncovered, list_contains(cells, 'fused_mid') AS mid FROM $celled")
def st12(spark, sf):
    every = F.array(*map(F.lit, ("dense_high", "fused_mid", "sparse_low")))
    return celled(spark, sf).select("query_id", F.array_join(F.array_sort(F.array_except(every, "cells")), ",").alias("uncovered"), F.array_contains("cells", "fused_mid").alias("mid"))


# Reports on cells, lanes and floors.


@query("ag7_qrels_depth", "SELECT q.query_id, CAST(coalesce(count(r.doc_id), 0) AS BIGINT) AS depth FROM $queries q LEFT JOIN (SELECT * FROM $qrels WHERE relevance >= 2) r ON q.query_id = r.query_id GROUP BY q.query_id")
def ag7(spark, sf):
    counts = X.qrels(spark, sf).where("relevance >= 2").groupBy("query_id").agg(F.count("*").alias("depth"))
    return X.search_queries(spark, sf).select("query_id").join(counts, "query_id", "left").fillna(0, ["depth"])


@query("ag9_per_dataset_report", """
SELECT dataset, count(*) AS labelled, round(quantile_cont(depth, 0.5), 6) AS median_depth, round(avg(hi) - greatest(avg(dn), avg(rf), avg(sp)), 6) AS gap, round(avg(CASE WHEN class <> '' THEN 1.0 ELSE 0.0 END), 6) AS yield,
  CASE WHEN count(*) < 500 THEN 'label_more' WHEN quantile_cont(depth, 0.5) < 1 THEN 'deepen' WHEN avg(CASE WHEN class <> '' THEN 1.0 ELSE 0.0 END) < 0.5 * (SELECT avg(CASE WHEN class <> '' THEN 1.0 ELSE 0.0 END) FROM $classed) THEN 'poor_yield' WHEN avg(hi) - greatest(avg(dn), avg(rf), avg(sp)) < 0.05 THEN 'no_gap' ELSE 'keep' END AS action FROM $classed GROUP BY dataset""")
def ag9(spark, sf):
    rows = classified(X.labelled(spark, sf))
    pooled = rows.agg(R.share(F.col("certified"))).first()[0]  # one number
    gap = F.avg(L.top()) - F.greatest(*[F.avg(L.score(r)) for r in L.ROUTES])
    out = rows.groupBy("dataset").agg(F.count("*").alias("labelled"), F.percentile("depth", F.lit(0.5)).alias("m"), gap.alias("g"), R.share(F.col("certified")).alias("y"))
    action = F.when(F.col("labelled") < 500, "label_more").when(F.col("m") < 1, "deepen").when(F.col("y") < 0.5 * (pooled or 0.0), "poor_yield").when(F.col("g") < 0.05, "no_gap").otherwise("keep")
    return out.select("dataset", "labelled", F.round("m", 6).alias("median_depth"), F.round("g", 6).alias("gap"), F.round("y", 6).alias("yield"), action.alias("action"))


@query("ag11_marginals", "SELECT s.name, CAST(coalesce(n, 0) AS BIGINT) AS rows, coalesce(n, 0) >= floor AS met, s.floor FROM (VALUES ('dense_high', 1000), ('fused_mid', 2000), ('sparse_low', 50000), ('nowhere', 1)) AS s(name, floor) LEFT JOIN (SELECT unnest(cells) AS name, count(*) AS n FROM $celled GROUP BY 1) c ON s.name = c.name")
def ag11(spark, sf):
    declared = spark.createDataFrame([("dense_high", 1000), ("fused_mid", 2000), ("sparse_low", 50000), ("nowhere", 1)], "name string, floor int")
    counts = celled(spark, sf).select(F.explode("cells").alias("name")).groupBy("name").agg(F.count("*").alias("rows"))
    out = declared.join(counts, "name", "left").fillna(0, ["rows"])
    return out.select("name", "rows", (F.col("rows") >= F.col("floor")).alias("met"), "floor")


X.SQL["lane_cells"] = "SELECT dataset, avg(CASE WHEN list_contains(cells, 'dense_high') THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM $celled GROUP BY dataset"


@query("ag12_inversion", """
WITH w AS (SELECT share, 1.0 / count(*) OVER () AS u, n / sum(n) OVER () AS p, least(n, 800) / sum(least(n, 800)) OVER () AS c FROM $lane_cells)
SELECT 'dense_high' AS cell, round(s, 6) AS selected, round(least(sum(share * u), sum(share * p), sum(share * c)), 6) AS least_share, round(s / least(sum(share * u), sum(share * p), sum(share * c)), 6) AS ratio
FROM w, (SELECT avg(CASE WHEN list_contains(cells, 'dense_high') THEN 1.0 ELSE 0.0 END) AS s FROM $celled WHERE depth > 2) GROUP BY s""")
def ag12(spark, sf):
    """A cell's share in the selection against the smallest of its shares under three weightings of the lanes."""
    has = F.array_contains("cells", "dense_high")
    rows = celled(spark, sf)
    every = W.partitionBy(F.lit(0))
    lanes = rows.groupBy("dataset").agg(R.share(has).alias("share"), F.count("*").alias("n"))
    capped = F.least("n", F.lit(800))
    weights = lanes.select("share", (1 / F.count("*").over(every)).alias("u"), (F.col("n") / F.sum("n").over(every)).alias("p"), (capped / F.sum(capped).over(every)).alias("c"))
    least = weights.agg(F.least(*[F.sum(F.col("share") * F.col(c)) for c in "upc"]).alias("least_share"))
    chosen = rows.where("depth > 2").agg(R.share(has).alias("selected"))
    both = chosen.join(least, F.lit(True))  # one row each
    return both.select(F.lit("dense_high").alias("cell"), F.round("selected", 6).alias("selected"), F.round("least_share", 6).alias("least_share"), F.round(F.col("selected") / F.col("least_share"), 6).alias("ratio"))


@query("ag13_lane_weightings", "SELECT dataset, round(1.0 / count(*) OVER (), 6) AS uniform, round(n / sum(n) OVER (), 6) AS pool, round(least(n, 800) / sum(least(n, 800)) OVER (), 6) AS capped FROM $lane_cells")
def ag13(spark, sf):
    every, capped = W.partitionBy(F.lit(0)), F.least("n", F.lit(800))
    lanes = X.triples(spark, sf).groupBy("dataset").agg(F.count("*").alias("n"))
    return lanes.select("dataset", F.round(1 / F.count("*").over(every), 6).alias("uniform"), F.round(F.col("n") / F.sum("n").over(every), 6).alias("pool"), F.round(capped / F.sum(capped).over(every), 6).alias("capped"))


@query("ag14_realism", "SELECT round(avg(CASE WHEN provenance = 'generated' THEN 1.0 ELSE 0.0 END), 6) AS damaged, round(sum(n * r) / sum(n), 6) AS census FROM $labelled, (SELECT sum(n * share) / sum(n) AS r, sum(n) AS n FROM $lane_cells)")
def ag14(spark, sf):
    """The damaged share of a selection and the sample-weighted rate of a census."""
    rows = celled(spark, sf)
    lanes = rows.groupBy("dataset").agg(R.share(F.array_contains("cells", "dense_high")).alias("share"), F.count("*").alias("n"))
    census = lanes.agg(F.round(F.sum(F.col("n") * F.col("share")) / F.sum("n"), 6).alias("census"))
    return rows.agg(F.round(R.share(F.col("provenance") == "generated"), 6).alias("damaged")).join(census, F.lit(True))  # one row each


@query("ag20_cell_census", """
SELECT cell, count(*) AS claimed, round(count(*) / (SELECT count(*) FROM $celled), 6) AS share, CAST(count(*) FILTER (gap >= 0.1::DOUBLE AND shape = 'routes_differ') AS BIGINT) AS decisive, CAST(count(DISTINCT dataset) AS BIGINT) AS lanes
FROM (SELECT *, unnest(cells) AS cell FROM $celled) GROUP BY cell""")
def ag20(spark, sf):
    rows = celled(spark, sf)
    total = rows.count()
    out = rows.withColumn("cell", F.explode("cells")).groupBy("cell")
    decisive = (L.margin() >= L.d(0.1)) & (L.outcome_shape() == "routes_differ")
    return out.agg(F.count("*").alias("claimed"), F.round(F.count("*") / F.lit(total), 6).alias("share"), R.count_if(decisive).alias("decisive"), F.count_distinct("dataset").alias("lanes"))


@query("ag22_corruption_census", "SELECT lang AS lane, count(*) AS n, round(avg(CASE WHEN regexp_matches(text, '[0-9]{4,}') THEN 1.0 ELSE 0.0 END), 6) AS digits, round(avg(CASE WHEN contains(text, '!!') THEN 1.0 ELSE 0.0 END), 6) AS shouting, round(avg(n_chars), 4) AS mean_chars, round(avg(CASE WHEN regexp_matches(text, '[0-9]{4,}') OR contains(text, '!!') THEN 1.0 ELSE 0.0 END), 6) AS any_span FROM documents GROUP BY lang")
def ag22(spark, sf):
    digits, shout = F.col("text").rlike("[0-9]{4,}"), F.col("text").contains("!!")
    sh = lambda c, n: F.round(R.share(c), 6).alias(n)
    return t(spark, sf, "documents").groupBy(F.col("lang").alias("lane")).agg(F.count("*").alias("n"), sh(digits, "digits"), sh(shout, "shouting"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), sh(digits | shout, "any_span"))


@query("ag23_quartile_table", "SELECT round(quantile_cont(m, 0.25), 6) AS q25, round(quantile_cont(m, 0.5), 6) AS q50, round(quantile_cont(m, 0.75), 6) AS q75 FROM (SELECT source, avg(n_chars) AS m FROM documents GROUP BY source)")
def ag23(spark, sf):
    """Quartiles across lanes of per-lane means."""
    means = t(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("m"))
    return means.agg(*[F.round(F.percentile("m", F.lit(q)), 6).alias(f"q{round(100 * q)}") for q in (0.25, 0.5, 0.75)])


X.SQL["predictions"] = "SELECT source AS lane, quality = 1 AS truth, toxic = 0 AS pred FROM labels JOIN documents USING (doc_id)"


def predictions(spark, sf):
    return t(spark, sf, "labels").join(t(spark, sf, "documents"), "doc_id").select(F.col("source").alias("lane"), (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("pred"))


_CONFUSION = "CAST(count(*) FILTER (truth AND pred) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT truth AND pred) AS BIGINT) AS fp, CAST(count(*) FILTER (truth AND NOT pred) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT truth AND NOT pred) AS BIGINT) AS tn, round(count(*) FILTER (truth AND pred) / nullif(count(*) FILTER (pred), 0), 6) AS precision, round(count(*) FILTER (truth AND pred) / nullif(count(*) FILTER (truth), 0), 6) AS recall, round(count(*) FILTER (truth = pred) / count(*), 6) AS agreement"


@query("ag24_confusion", f"SELECT lane, {_CONFUSION} FROM $predictions GROUP BY lane")
def ag24(spark, sf):
    return R.confusion(predictions(spark, sf), F.col("truth"), F.col("pred"), ["lane"])


@query("ag25_validation_score", f"SELECT s.*, h.lane AS hardest_lane, CASE WHEN s.precision >= 0.9 AND s.recall >= 0.3 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT {_CONFUSION} FROM $predictions) s, (SELECT lane FROM (SELECT lane, {_CONFUSION} FROM $predictions GROUP BY lane) ORDER BY precision, lane LIMIT 1) h")
def ag25(spark, sf):
    rows = predictions(spark, sf)
    pooled = R.confusion(rows, F.col("truth"), F.col("pred"))
    hardest = R.confusion(rows, F.col("truth"), F.col("pred"), ["lane"]).agg(F.min_by("lane", F.struct("precision", "lane")).alias("hardest_lane"))
    verdict = F.when((F.col("precision") >= 0.9) & (F.col("recall") >= 0.3), "PASS").otherwise("FAIL")
    return pooled.join(hardest, F.lit(True)).withColumn("verdict", verdict)  # one row each


@query("ag34_floor_status", "SELECT dataset, CAST(n AS BIGINT) AS selected, CASE WHEN n >= 700 THEN 'met' WHEN a >= 700 THEN 'unmet' ELSE 'unreachable' END AS status FROM (SELECT dataset, count(*) FILTER (depth > 2) AS n, count(*) AS a FROM $labelled GROUP BY dataset)")
def ag34(spark, sf):
    out = X.labelled(spark, sf).groupBy("dataset").agg(R.count_if(F.col("depth") > 2).alias("selected"), F.count("*").alias("a"))
    return out.select("dataset", "selected", F.when(F.col("selected") >= 700, "met").when(F.col("a") >= 700, "unmet").otherwise("unreachable").alias("status"))


@query("ag35_augmentation_funnel", "SELECT operator, count(*) AS minted, CAST(count(*) FILTER (gate = 'none') AS BIGINT) AS open_gate, CAST(count(*) FILTER (gate = 'none' OR verdict) AS BIGINT) AS admitted FROM $generated GROUP BY operator")
def ag35(spark, sf):
    gate_open = F.col("gate") == "none"
    return generated(spark, sf).groupBy("operator").agg(F.count("*").alias("minted"), R.count_if(gate_open).alias("open_gate"), R.count_if(gate_open | F.col("verdict")).alias("admitted"))


@query("ag36_audit_opened_floors", "SELECT home_lane, round(avg(CASE WHEN verdict THEN 1.0 ELSE 0.0 END), 6) AS rate, avg(CASE WHEN verdict THEN 1.0 ELSE 0.0 END) >= 0.8 AS opened FROM (SELECT *, row_number() OVER (PARTITION BY home_lane ORDER BY n) AS k FROM $generated WHERE verdict IS NOT NULL) WHERE k <= 20 GROUP BY home_lane")
def ag36(spark, sf):
    pilot = O.keep_one(generated(spark, sf).where("verdict IS NOT NULL"), ["home_lane"], [F.col("n")], 20)
    rate = R.share(F.col("verdict"))
    return pilot.groupBy("home_lane").agg(F.round(rate, 6).alias("rate"), (rate >= 0.8).alias("opened"))


@query("ag37_open_floors", "SELECT home_lane, bool_and(verdict IS NOT NULL) AND avg(CASE WHEN verdict THEN 1.0 ELSE 0.0 END) >= 0.5 AS open FROM (SELECT *, row_number() OVER (PARTITION BY home_lane ORDER BY n) AS k FROM $generated) WHERE k <= 4 GROUP BY home_lane")
def ag37(spark, sf):
    pilot = O.keep_one(generated(spark, sf), ["home_lane"], [F.col("n")], 4)
    return pilot.groupBy("home_lane").agg((F.bool_and(F.col("verdict").isNotNull()) & (R.share(F.col("verdict")) >= 0.5)).alias("open"))


@query("ag38_examine", "SELECT name, CAST(coalesce(n, 0) AS BIGINT) AS rows, round(coalesce(n, 0) / (SELECT count(*) FROM $celled), 6) AS share, coalesce(n, 0) < 1500 AS ordered FROM (VALUES ('dense_high'), ('fused_mid'), ('sparse_low'), ('unclaimed')) AS s(name) LEFT JOIN (SELECT unnest(CASE WHEN len(cells) = 0 THEN ['unclaimed'] ELSE cells END) AS name, count(*) AS n FROM $celled GROUP BY 1) c USING (name)")
def ag38(spark, sf):
    rows = celled(spark, sf)
    total = rows.count()
    claimed = F.explode(F.when(F.size("cells") == 0, F.array(F.lit("unclaimed"))).otherwise(F.col("cells")))
    counts = rows.select(claimed.alias("name")).groupBy("name").agg(F.count("*").alias("rows"))
    names = spark.createDataFrame([(n,) for n in ("dense_high", "fused_mid", "sparse_low", "unclaimed")], "name string")
    return names.join(counts, "name", "left").fillna(0, ["rows"]).select("name", "rows", F.round(F.col("rows") / F.lit(max(total, 1)), 6).alias("share"), (F.col("rows") < 1500).alias("ordered"))


@query("ag39_supply_readout", "SELECT gate AS floor, home_lane AS lane, count(DISTINCT generated_from) AS documents, count(DISTINCT CASE WHEN verdict IS NULL THEN generated_from END) AS lacking FROM $generated GROUP BY gate, home_lane")
def ag39(spark, sf):
    return generated(spark, sf).groupBy(F.col("gate").alias("floor"), F.col("home_lane").alias("lane")).agg(F.count_distinct("generated_from").alias("documents"), F.count_distinct(F.when(F.col("verdict").isNull(), F.col("generated_from"))).alias("lacking"))


@query("ag40_provenance_share", "SELECT dataset, round(avg(CASE WHEN provenance = 'natural' THEN 1.0 ELSE 0.0 END), 6) AS natural, round(avg(CASE WHEN provenance = 'generated' THEN 1.0 ELSE 0.0 END), 6) AS generated FROM $labelled GROUP BY dataset")
def ag40(spark, sf):
    counts = X.labelled(spark, sf).groupBy("dataset").pivot("provenance", ["natural", "generated"]).count().fillna(0)
    total = F.col("natural") + F.col("generated")
    return counts.select("dataset", *[F.round(F.col(c) / total, 6).alias(c) for c in ("natural", "generated")])


@query("ag41_cost_plan", "SELECT CAST(count(*) FILTER (hit) AS BIGINT) AS hits, CAST(count(*) FILTER (NOT hit) AS BIGINT) AS misses, round(count(*) FILTER (NOT hit) * 0.002::DOUBLE, 6) AS spend FROM (SELECT md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0) AS hit FROM documents)")
def ag41(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", F.md5("text").alias("fp"))
    cached = docs.where("doc_id % 2 = 0").select("fp", F.lit(True).alias("hit")).distinct()
    rows = docs.join(cached, "fp", "left")
    return rows.agg(R.count_if(F.col("hit")).alias("hits"), R.count_if(F.col("hit").isNull()).alias("misses"), F.round(R.count_if(F.col("hit").isNull()) * 0.002, 6).alias("spend"))
