"""Retrieval routes and fusion: BM25 over an inverted index, exact vector search in query blocks, rank fusion.

Rankings are long rows (query_id, route, rank, doc_id, score); ties go to the smaller document id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waymark.functions.text import token_set, tokens
from waymark.operators.graph import checkpointed

#: Queries of one block of vector search; a block of 64 dimensions takes 2 MB.
BLOCK = 4096
#: Vectors of one side of a block pair in the search for near pairs.
PAIR_BLOCK = 2048
#: Query terms, and (query, term) rows, up to which bm25 sends them to every task: some 40 MB.
ASKED = 1_000_000
K1, B = 1.2, 0.75
RRF_K = 60


def body(title: Column, text: Column) -> Column:
    """Title, blank line, text; trimmed."""
    return F.trim(F.concat_ws("\n\n", F.nullif(F.coalesce(title, F.lit("")), F.lit("")), F.coalesce(text, F.lit(""))))


def index_statistics(docs: DataFrame, text_col: str = "text") -> tuple[int, float]:
    """Number of documents and their mean length; one row."""
    row = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text_col)))).alias("l")).first()
    return row["n"], row["l"] or 0.0


def document_frequency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select(F.explode(token_set(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(n_docs: int, df: Column) -> Column:
    return F.log(1 + (F.lit(float(n_docs)) - df + 0.5) / (df + 0.5))


def top(scored: DataFrame, k: int, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    at = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", at).where(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int, *, text_col: str = "text", query_col: str = "query", k1: float = K1, b: float = B) -> DataFrame:
    """Top ``k`` documents of each query. Only postings of query terms are scored; scores are sums of millionths, so their order does not depend on the order of summing.

    Postings carry their document's length, and document frequencies count the same shuffled rows. If the queries' terms are at most
    ``ASKED``, postings are dealt by document before they meet the queries, so a document's sums are made in one place; else joins by term do it."""
    n_docs, mean = index_statistics(docs, text_col)
    asked = queries.select("query_id", F.explode(token_set(F.col(query_col))).alias("term"))
    words = docs.select("doc_id", tokens(F.col(text_col)).alias("words")).select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    posted = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    frequency = posted.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df"))  # reads tf, so that both plans share the shuffle
    few = asked.count() <= ASKED
    saturation = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean or 1.0)))
    weighted = posted.join(F.broadcast(frequency) if few else frequency, "term").select("term", "doc_id", F.round(idf(n_docs, F.col("df")) * saturation * 1_000_000).cast("long").alias("w"))
    met = weighted.repartition("doc_id").join(F.broadcast(asked), "term") if few else weighted.join(asked, "term")
    scored = met.groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))
    return top(scored, k)


def vector_rank(queries: DataFrame, docs: DataFrame, k: int, *, dims: int | None = None) -> DataFrame:
    """Exact cosine top ``k``, scores to 6 digits and ties by id: blocks of queries meet every partition of documents, which keeps ``k`` rows a query and sends those on."""
    spark = docs.sparkSession
    blocks, ids, rows = [], [], []
    for row in queries.select("query_id", "vector").toLocalIterator():
        ids.append(row["query_id"])
        rows.append(np.asarray(row["vector"][:dims], np.float64))
        if len(ids) == BLOCK:
            blocks.append(spark.sparkContext.broadcast((ids, np.stack(rows))))
            ids, rows = [], []
    if ids:
        blocks.append(spark.sparkContext.broadcast((ids, np.stack(rows))))

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)

    def scan(batches):
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(names):
                continue
            matrix = unit(np.stack([np.asarray(v, np.float64)[:dims] for v in batch.column(1).to_pylist()]))
            for b, block in enumerate(blocks):
                scores = np.round(unit(block.value[1]) @ matrix.T, 6)
                for i, own in enumerate(scores):
                    near = np.flatnonzero(own >= np.partition(own, len(own) - k)[len(own) - k]) if len(own) > k else np.arange(len(own))
                    s, n = best.get((b, i), (own[:0], names[:0]))
                    s, n = np.concatenate([s, own[near]]), np.concatenate([n, names[near]])
                    order = np.lexsort((n, -s))[:k]
                    best[b, i] = s[order], n[order]
        for (b, i), (s, n) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([blocks[b].value[0][i]] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array(s)], ["query_id", "doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "vector").mapInArrow(scan, "query_id long, doc_id long, score double")
    return top(scored, k)


def near_pairs(vectors: DataFrame, bound: float) -> DataFrame:
    """(a, b), a < b, from (vec_id, vector): every pair of different vectors with a cosine above ``bound``, each equal vector standing under
    its smallest id, and that id with each id of an equal vector.

    Vectors are packed into blocks and every block meets itself and each later one, so no side is collected or broadcast; the work is
    quadratic, the rows are those pairs. Vectors of length zero, null ones and null ids have no pairs.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    own = own.where(F.exists("vector", lambda x: x != 0))
    n_blocks = -(-own.count() // PAIR_BLOCK)
    classes = own.groupBy("vector").agg(F.min("vec_id").alias("a"))
    equal = own.join(classes, "vector").where("a < vec_id").select("a", F.col("vec_id").alias("b")).distinct()

    def pack(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, PAIR_BLOCK):
                part = batch.slice(begin, PAIR_BLOCK)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                matrix = np.array(part.column(1).to_pylist(), "<f8")
                matrix /= np.sqrt((matrix * matrix).sum(1, keepdims=True))
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], ["block", "ids", "rows"])

    def compare(batches):
        for batch in batches:
            for block, ids, rows, other, other_ids, other_rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, right = np.frombuffer(ids, "<i8"), np.frombuffer(other_ids, "<i8")
                scores = np.frombuffer(rows, "<f8").reshape(len(left), -1) @ np.frombuffer(other_rows, "<f8").reshape(len(right), -1).T
                i, j = np.nonzero(scores > bound)
                if block == other:
                    i, j = i[i < j], j[i < j]
                a, b = left[i], right[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    # a block is named by its first id, which no other block holds; few partitions, as each meets all others
    blocks = checkpointed(classes.select("a", "vector").coalesce(max(1, n_blocks)).mapInArrow(pack, "block long, ids binary, rows binary"))
    others = blocks.select(F.col("block").alias("other"), F.col("ids").alias("other_ids"), F.col("rows").alias("other_rows"))
    return blocks.crossJoin(others).where("block <= other").mapInArrow(compare, "a long, b long").union(equal)


def rrf(a: DataFrame, b: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings."""
    both = a.select("query_id", "doc_id", "rank").unionByName(b.select("query_id", "doc_id", "rank"))
    scored = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    return top(scored, k)


def weighted_rrf(a: DataFrame, b: DataFrame, weights: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """Fusion with a weight pair (w_a, w_b) for each query; ranks count from 0."""
    part = lambda df, w: df.join(weights, "query_id").select("query_id", "doc_id", (F.col(w) / (constant + F.col("rank"))).alias("s"))
    scored = part(a, "w_a").unionByName(part(b, "w_b")).groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 9).alias("score"))
    return top(scored, k)


def pair_counts(queries: DataFrame, docs: DataFrame, *, query_col: str = "query", text_col: str = "text") -> DataFrame:
    """(a, b, together): documents with both terms, for the unordered term pairs of queries.

    Documents keep only the terms queries use and are numbered in groups of 64, so a term is one number a group and a pair meets
    once a group that has both, not once a document."""
    words = F.array_sort(token_set(F.col(query_col)))
    pairs = queries.select(F.posexplode(words).alias("i", "a"), words.alias("w")).select("a", F.explode(F.expr("slice(w, i + 2, size(w))")).alias("b")).distinct()
    vocabulary = pairs.select(F.col("a").alias("term")).union(pairs.select(F.col("b").alias("term"))).distinct()
    spread = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.lit(docs.count() // 64)))
    place = F.row_number().over(W.partitionBy("group").orderBy("doc_id")) - 1
    numbered = docs.select("doc_id").distinct().withColumn("group", spread).select("doc_id", "group", F.floor(place / 64).alias("part"), F.expr("shiftleft(1L, cast(pmod(row_number() OVER (PARTITION BY group ORDER BY doc_id) - 1, 64) AS int))").alias("bit"))
    has = docs.select("doc_id", F.explode(token_set(F.col(text_col))).alias("term")).join(vocabulary, "term", "left_semi")
    marks = has.join(numbered, "doc_id").groupBy("term", "group", "part").agg(F.bit_or("bit").alias("bits"))
    left, right = (marks.select(F.col("term").alias(c), "group", "part", F.col("bits").alias(f"bits_{c}")) for c in ("a", "b"))
    met = pairs.join(left, "a").join(right, ["b", "group", "part"]).groupBy("a", "b").agg(F.sum(F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b")))).alias("together"))
    return pairs.join(met, ["a", "b"], "left").fillna(0, ["together"])
