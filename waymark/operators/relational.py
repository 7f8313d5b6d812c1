"""Views, unions, deduplication, worklists and draws: the relational steps between tables.

No step depends on the order of rows: whatever the order decided elsewhere is a column here. Draws
go by the md5 of seed and key, so they repeat exactly on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def require(df: DataFrame, columns: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """Fails unless all ``columns`` are there and none that is ``forbidden``."""
    missing, present = sorted(set(columns) - set(df.columns)), sorted(set(forbidden) & set(df.columns))
    if missing or present:
        raise ValueError(f"missing columns {missing}, forbidden columns {present}")
    return df


def require_none(df: DataFrame, message: str) -> None:
    if not df.isEmpty():
        raise ValueError(message)


def draw_key(seed: str, *keys: str) -> Column:
    """A pseudo-random order of rows that depends on seed and keys alone."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def priority_union(frames: Sequence[DataFrame], keys: Sequence[str], last_wins: bool = True) -> DataFrame:
    """Rows of all frames, columns aligned; of equal keys the row of the last (or first) frame that has it."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return keep_one(both, keys, [F.desc("_source") if last_wins else F.asc("_source")]).drop("_source")


def subset(df: DataFrame, ids: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return df.join(ids, key, "left_semi")


def difference(df: DataFrame, known: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return df.join(known, key, "left_anti")


def supplement(own: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``own`` and what ``extra`` has besides; own rows win."""
    return priority_union([own, extra], keys, last_wins=False)


def corpus_target(relevant: Column, rate: float = 0.2, least: int = 10_000, most: int = 100_000) -> Column:
    """min(max(relevant / rate, least), most), rounded half to even."""
    return F.least(F.greatest(F.bround(relevant / F.lit(rate)).cast("long"), F.lit(least)), F.lit(most)).cast("long")


def sample(df: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    """``n`` rows drawn uniformly; a top-n, so no task holds more than n rows of any partition."""
    return df.orderBy(draw_key(seed, *keys), *keys).limit(n)


def corpus_size(rate: float = 0.2, least: int = 10_000, most: int = 100_000) -> Callable[[int], int]:
    """``corpus_target`` for a number."""
    return lambda relevant: min(max(round(relevant / rate), least), most)


def materialize(corpus: DataFrame, qrels: DataFrame, target: int | Callable[[int], int], seed: str) -> DataFrame:
    """All documents with a relevant judgment and a draw of the others up to ``target``, which may be a function of the judged ones' number;
    an error if the judged ones alone exceed it."""
    once = keep_one(corpus, ["doc_id"], [F.col("title"), F.col("text")])
    judged = qrels.where("relevance >= 1").select("doc_id").distinct()
    forced = subset(once, judged, "doc_id")
    relevant = forced.count()
    budget = (target(relevant) if callable(target) else target) - relevant
    if budget < 0:
        raise ValueError(f"{-budget} relevant documents more than the target")
    return forced.unionByName(sample(difference(once, judged, "doc_id"), budget, seed, "doc_id"))


def interleaved(df: DataFrame, lane: str, seed: str, key: str) -> DataFrame:
    """``turn``: a row's place in a round-robin draw over the lanes."""
    return df.withColumn("turn", F.row_number().over(W.partitionBy(lane).orderBy(draw_key(seed, key), key)))


def quotas(counts: DataFrame, total: int, weight: str = "n", position: str = "position") -> DataFrame:
    """Largest-remainder shares of ``total``; ``counts`` is a small table of lanes."""
    everything = W.partitionBy(F.lit(0))
    exact = F.lit(total) * F.col(weight) / F.sum(weight).over(everything)
    rows = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = F.lit(total) - F.sum("_floor").over(everything)
    place = F.row_number().over(everything.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), position))
    return rows.withColumn("quota", (F.col("_floor") + F.when(place <= left, 1).otherwise(0)).cast("long")).drop("_exact", "_floor")


def proportional_cap(df: DataFrame, lane: str, cap: int, order: Sequence[Column]) -> DataFrame:
    """At most max(1, ceil(cap * rows of the lane / all rows)) rows a lane. Lane counts are few and join by broadcast where Spark finds them small."""
    counts = df.groupBy(lane).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_cap", F.greatest(F.lit(1), F.ceil(cap * F.col("_n") / F.sum("_n").over(W.partitionBy(F.lit(0))))))
    place = F.row_number().over(W.partitionBy(lane).orderBy(*order))
    return df.withColumn("_at", place).join(counts, lane).where("_at <= _cap").drop("_at", "_n", "_cap")


def dialogue_history(turns: DataFrame, topic: str, turn: str, text: str) -> DataFrame:
    """Each utterance with all earlier ones of its topic before it. The result itself grows as the square of a topic's turns."""
    before = W.partitionBy(topic).orderBy(turn).rowsBetween(W.unboundedPreceding, -1)
    earlier = F.collect_list(text).over(before)
    return turns.select(topic, turn, F.concat_ws("\n", earlier, F.concat(F.lit("[CURRENT] "), F.col(text))).alias("query"))


def resolve_conflicts(qrels: DataFrame, precedence: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One judgment per key: the source earlier in ``precedence``, then the smaller ``seq``."""
    rank = F.coalesce(*[F.when(F.col("source") == s, i) for i, s in enumerate(precedence)], F.lit(len(precedence)))
    return keep_one(qrels, keys, [rank, F.col("seq")])


def bag_digest(rows: DataFrame, digest: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, digest): lines of bucket digests that tell whether two tables hold the same row digests (hexadecimal) equally often.

    Copies are counted first; then each of 65,536 buckets, by the first four digits, digests its sorted rows. Only the buckets' digests
    (4 MB at most) meet in one place. Null digests are left out; a group of nothing else has no lines, and neither has an empty table.
    """
    counted = rows.groupBy(*by, digest).agg(F.count("*").alias("_n"))
    line = F.when(F.col(digest).isNotNull(), F.concat_ws(":", digest, F.col("_n").cast("string")))
    bucket = F.substring(digest, 1, 4).alias("_bucket")
    lines = counted.groupBy(*by, bucket).agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    each = F.when(F.col("_bucket").isNotNull(), F.struct("_bucket", F.sha2(F.array_join("_lines", "\n"), 256).alias("d")))
    gathered = lines.groupBy(*by).agg(F.array_sort(F.collect_list(each)).alias("_all"))
    return gathered.select(*by, F.array_join(F.col("_all.d"), "\n").alias("digest"))
