"""Ranking metrics over long rankings (query_id, route, rank, doc_id) and judgments (query_id, doc_id, relevance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waymark.functions import labels as L

DEPTH = 10


def relevant(qrels: DataFrame, least: float = 1.0) -> DataFrame:
    return qrels.where(F.col("relevance") >= least)


def ideal(rel: DataFrame, k: int = DEPTH) -> DataFrame:
    """(query_id, idcg, n_relevant) over the judged relevant documents, with linear gains."""
    at = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    gain = F.when(F.col("at") <= k, F.col("relevance") / F.log2(F.col("at") + 1)).otherwise(0.0)
    return rel.withColumn("at", at).groupBy("query_id").agg(F.sum(gain).alias("idcg"), F.count("*").alias("n_relevant"))


def assess(rankings: DataFrame, qrels: DataFrame, k: int = DEPTH, least: float = 1.0) -> DataFrame:
    """Per query and route: hit at 1, ndcg at ``k`` and recall over the whole ranking; zeros without relevant documents."""
    rel = relevant(qrels, least)
    met = rankings.join(rel, ["query_id", "doc_id"], "left")
    gain = F.when(F.col("rank") <= k, F.coalesce("relevance", F.lit(0.0)) / F.log2(F.col("rank") + 1)).otherwise(0.0)
    hit = F.max(F.when((F.col("rank") == 1) & F.col("relevance").isNotNull(), 1.0).otherwise(0.0))
    out = met.groupBy("query_id", "route").agg(hit.alias("hit"), F.sum(gain).alias("dcg"), F.count("relevance").alias("found")).join(ideal(rel, k), "query_id", "left")
    return out.select("query_id", "route", "hit", F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"), F.coalesce(F.col("found") / F.col("n_relevant"), F.lit(0.0)).alias("recall"))


def router_objective() -> Column:
    return L.d(L.HIT_WEIGHT) * F.col("hit") + L.d(L.NDCG_WEIGHT) * F.col("ndcg")


def wasted_recall_objective() -> Column:
    return L.d(0.7) * F.col("hit") + L.d(0.3) * F.col("ndcg") * F.col("ndcg") - L.d(0.3) * F.col("recall") * (1 - F.col("ndcg"))


def triples(assessed: DataFrame, score: Column) -> DataFrame:
    """Score triples of assessed rankings."""
    rows = assessed.select("query_id", "route", score.alias("s"))
    return rows.groupBy("query_id").pivot("route", list(L.ROUTES)).agg(F.max("s")).select("query_id", *[F.coalesce(r, F.lit(0.0)).alias(f"score_{r}") for r in L.ROUTES])


def without_excluded(rankings: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rankings without banned pairs, ranks closed up."""
    kept = rankings.join(excluded, ["query_id", "doc_id"], "left_anti")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "route").orderBy("rank")))


def documents_above_gold(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, doc_id): what some route ranks before its first gold document."""
    marked = rankings.join(gold.select("query_id", "doc_id", F.lit(True).alias("gold")), ["query_id", "doc_id"], "left")
    first = F.min(F.when(F.col("gold"), F.col("rank"))).over(W.partitionBy("query_id", "route"))
    return marked.withColumn("first", first).where(F.col("rank") < F.col("first")).select("query_id", "doc_id").distinct()


def tail_spread(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, doc_id, spread) of documents that are no gold and that routes rank differently; absent counts as the longest list's length."""
    query = W.partitionBy("query_id")
    marked = rankings.withColumns({"longest": F.max("rank").over(query), "all_routes": F.size(F.collect_set("route").over(query))})
    rows = marked.groupBy("query_id", "doc_id").agg(*[F.max(c).alias(c) for c in ("longest", "all_routes")], F.min("rank").alias("best"), F.max("rank").alias("worst"), F.size(F.collect_set("route")).alias("routes"))
    worst = F.when(F.col("routes") < F.col("all_routes"), F.greatest("worst", "longest")).otherwise(F.col("worst"))
    out = rows.withColumn("spread", (worst - F.col("best")).cast("long")).where("spread > 0")
    return out.join(gold.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", "spread")


def widest_gap(rankings: DataFrame, qrels: DataFrame, a: str, b: str, k: int = DEPTH) -> DataFrame:
    """(query_id, gap): the largest lead in binary ndcg that route ``a`` could have over ``b`` if unjudged documents of either list turned out relevant.

    Documents help in the order of their difference in weight, so running sums over that order contain the best choice."""
    weight = lambda r: F.max(F.when((F.col("route") == r) & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    docs = rankings.groupBy("query_id", "doc_id").agg((weight(a) - weight(b)).alias("w"))
    known = qrels.select("query_id", "doc_id", F.lit(True).alias("judged"))
    rows = docs.join(known, ["query_id", "doc_id"], "left")
    base = rows.groupBy("query_id").agg(F.sum(F.when(F.col("judged"), F.col("w")).otherwise(0.0)).alias("base"))
    counts = qrels.groupBy("query_id").agg(F.count("*").alias("n"))
    order = W.partitionBy("query_id").orderBy(F.desc("w"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    added = rows.where("judged IS NULL AND w > 0").withColumns({"s": F.sum("w").over(order), "m": F.count("*").over(order)}).select("query_id", "s", "m")
    steps = added.unionByName(base.select("query_id", F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("m")))
    met = steps.join(base, "query_id").join(counts, "query_id", "left")
    ideal_of = F.aggregate(F.sequence(F.lit(1), F.least(F.coalesce("n", F.lit(0)) + F.col("m"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1))
    total = F.coalesce("n", F.lit(0)) + F.col("m")
    return met.groupBy("query_id").agg(F.round(F.max(F.when(total > 0, (F.col("base") + F.col("s")) / ideal_of).otherwise(0.0)), 6).alias("gap"))
