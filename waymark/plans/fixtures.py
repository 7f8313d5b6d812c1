"""Inputs of the registered queries, built from the test tables in Spark and, apart from that, in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL: dict[str, str] = {}


def expand(sql: str) -> str:
    """Replaces every ``$name`` by the SQL of that fixture, in parentheses."""
    while found := re.search(r"\$([a-z_0-9]+)", sql):
        sql = sql.replace(found[0], f"({SQL[found[1]].strip()})")
    return sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _triples(spark: SparkSession, sf: str, pick) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber")
    tenth = lambda c: F.round(pick(c) * 100) / 10
    return lines.agg(
        F.max(F.concat_ws("-", "l_returnflag", "l_linestatus")).alias("dataset"),
        tenth("l_discount").alias("score_dense_only"),
        ((pick("l_quantity").cast("long") % 11).cast("double") / 10).alias("score_pure_rrf"),
        tenth("l_tax").alias("score_sparse_only"),
    ).select("dataset", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("query_id"), "score_dense_only", "score_pure_rrf", "score_sparse_only")


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """Score triples of three routes; six lanes."""
    return _triples(spark, sf, F.max)


def second_triples(spark: SparkSession, sf: str) -> DataFrame:
    """The same queries as scored by a second stack."""
    return _triples(spark, sf, F.min)


_TRIPLES = """
SELECT max(l_returnflag || '-' || l_linestatus) AS dataset, CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS query_id,
  round(PICK(l_discount) * 100) / 10 AS score_dense_only, CAST(CAST(PICK(l_quantity) AS BIGINT) % 11 AS DOUBLE) / 10 AS score_pure_rrf,
  round(PICK(l_tax) * 100) / 10 AS score_sparse_only
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""
SQL["triples"] = _TRIPLES.replace("PICK", "max")
SQL["second"] = _TRIPLES.replace("PICK", "min")

#: Triples with what most oracles need of them.
SQL["scored"] = """
SELECT dataset, query_id, score_dense_only AS dn, score_pure_rrf AS rf, score_sparse_only AS sp,
  greatest(score_dense_only, score_pure_rrf, score_sparse_only) AS hi, least(score_dense_only, score_pure_rrf, score_sparse_only) AS lo,
  list_sort([score_dense_only, score_pure_rrf, score_sparse_only])[2] AS mid
FROM $triples
"""
SQL["shaped"] = """
SELECT *, CASE WHEN hi <= 1e-9 THEN 'all_zero' WHEN hi - lo <= 1e-9 THEN 'all_tied' ELSE 'routes_differ' END AS shape, hi - mid AS gap,
  CASE WHEN hi - sp <= 1e-9 THEN 'sparse_only' WHEN hi - dn <= 1e-9 THEN 'dense_only' ELSE 'pure_rrf' END AS cheap,
  CASE WHEN dn = hi THEN 'dense_only' WHEN rf = hi THEN 'pure_rrf' ELSE 'sparse_only' END AS win
FROM $scored
"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Triples with a judged depth, a provenance and a cluster, all from their key."""
    key = F.split("query_id", ":")
    order, line = key[0].cast("long"), key[1].cast("int")
    return triples(spark, sf).select(
        "*", (order % 5).cast("int").alias("depth"), F.when(line % 4 == 0, "generated").otherwise("natural").alias("provenance"), (order % 97).alias("cluster"),
        F.when(order % 11 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("s"), (order % 3).cast("string"))).alias("stage"),
    )


SQL["labelled"] = """
SELECT t.*, CAST(o % 5 AS INTEGER) AS depth, CASE WHEN l % 4 = 0 THEN 'generated' ELSE 'natural' END AS provenance, o % 97 AS cluster,
  CASE WHEN o % 11 = 0 THEN NULL ELSE 's' || CAST(o % 3 AS VARCHAR) END AS stage
FROM (SELECT *, CAST(split_part(query_id, ':', 1) AS BIGINT) AS o, CAST(split_part(query_id, ':', 2) AS INTEGER) AS l FROM $shaped) t
"""

# Texts.


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, dealt out by id where the file has fewer partitions than the session has cores; larger tables stay as they lie."""
    docs, cores = table(spark, sf, "documents"), spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores, "doc_id")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("title"), "text", F.col("lang").alias("lane"), "source")


SQL["corpus"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, '' AS title, text, lang AS lane, source FROM documents"


def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


SQL["queries"] = "SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark"


#: Characters of a query that a judged document must hold; part of what the fixture means by relevant.
NEEDLE = 60


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Grade 2 where a document contains the begin of the query (its first ``NEEDLE`` characters); grade 1 for two fixed neighbours of each such document."""
    # ids alone meet, by the rarest of the words that surely lie whole in the needle; texts are fetched for pairs that met
    docs = corpus(spark, sf).select("doc_id", "text")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    asked = search_queries(spark, sf).select("query_id", F.substring("query", 1, NEEDLE).alias("needle"))
    inner = asked.select("query_id", F.explode(F.expr(r"slice(split(needle, '\\s+'), 2, greatest(size(split(needle, '\\s+')) - 2, 1))")).alias("word")).distinct()
    common = words.join(F.broadcast(inner.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    rarest = inner.join(common, "word").groupBy("query_id").agg(F.min(F.struct("df", "word")).alias("w")).select("query_id", "w.word")
    near_by = words.join(rarest, "word").select("query_id", "doc_id").join(asked, "query_id").join(docs, "doc_id")
    met = near_by.where(F.col("text").contains(F.col("needle"))).select("query_id", "doc_id").distinct()
    near = met.select("query_id", F.explode(F.array((F.col("doc_id").cast("long") + 1).cast("string"), (F.col("doc_id").cast("long") + 2).cast("string"))).alias("doc_id"))
    near = near.join(corpus(spark, sf).select("doc_id"), "doc_id", "left_semi").join(met, ["query_id", "doc_id"], "left_anti").distinct()
    return met.withColumn("relevance", F.lit(2.0)).unionByName(near.withColumn("relevance", F.lit(1.0)))


SQL["met"] = "SELECT DISTINCT q.query_id, d.doc_id FROM $corpus d, $queries q WHERE contains(d.text, substring(q.query, 1, 60))"
SQL["qrels"] = """
SELECT query_id, doc_id, CAST(2 AS DOUBLE) AS relevance FROM $met UNION ALL
SELECT DISTINCT query_id, n.doc_id, CAST(1 AS DOUBLE) FROM (SELECT query_id, unnest([CAST(CAST(doc_id AS BIGINT) + 1 AS VARCHAR), CAST(CAST(doc_id AS BIGINT) + 2 AS VARCHAR)]) AS doc_id FROM $met) n
WHERE n.doc_id IN (SELECT doc_id FROM $corpus) AND (query_id, n.doc_id) NOT IN (SELECT (query_id, doc_id) FROM $met)
"""
