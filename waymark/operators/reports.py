"""Reports over labelled score triples: headroom, coverage, summaries, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waymark.functions import labels as L

POOLED = "POOLED"


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def pooled(df: DataFrame, key: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates per key and over all rows, the latter as key POOLED, in one pass; null keys are left out of both."""
    out = df.where(F.col(key).isNotNull()).rollup(key).agg(F.grouping(key).alias("_g"), *aggregates)
    return out.withColumn(key, F.when(F.col("_g") == 1, POOLED).otherwise(F.col(key))).drop("_g")


def headroom(triples: DataFrame, routes: Sequence[str] = L.ROUTES, decisive: float = L.DECISIVE_MARGIN) -> DataFrame:
    """Per lane and POOLED: what a perfect router adds to the best constant route."""
    means = [F.avg(L.score(r)).alias(f"_{r}") for r in routes]
    out = pooled(triples, "dataset", [F.count("*").alias("labelled"), F.avg(L.top()).alias("_oracle"), *means, share(L.margin() >= L.d(decisive)).alias("_decisive"), share(L.top() <= 0).alias("_zero")])
    best = F.greatest(*[F.col(f"_{r}") for r in routes])
    name = L.first_route(lambda r: F.col(f"_{r}") == best, routes)
    gap = F.col("_oracle") - best
    return out.select(
        "dataset", "labelled", F.round("_oracle", 3).alias("oracle"), name.alias("best_constant"), F.round(best, 3).alias("constant"), F.round(gap, 3).alias("headroom"),
        F.when(best != 0, F.round(100 * gap / best, 1)).otherwise(0.0).alias("headroom_pct"), F.round("_decisive", 3).alias("decisive_share"), F.round("_zero", 3).alias("all_zero_share"),
    )


def headroom_levels(triples: DataFrame, routes: Sequence[str] = L.ROUTES) -> DataFrame:
    """One global constant, the best constant per lane, the oracle, and each level's gain over the one before."""
    lanes = triples.groupBy("dataset").agg(F.count("*").alias("n"), F.sum(L.top()).alias("oracle"), *[F.sum(L.score(r)).alias(r) for r in routes])
    best = F.greatest(*[F.col(r) for r in routes])
    total = F.sum("n")
    one = lanes.agg(F.greatest(*[F.sum(r) / total for r in routes]).alias("l1"), (F.sum(best) / total).alias("l2"), (F.sum("oracle") / total).alias("l3"))
    rows = one.select(F.posexplode(F.array("l1", "l2", "l3")).alias("level_no", "score"))
    before = F.lag("score").over(W.partitionBy(F.lit(0)).orderBy("level_no"))
    return rows.select(F.element_at(F.array(F.lit("global_constant"), F.lit("lane_constant"), F.lit("oracle")), F.col("level_no") + 1).alias("level"), F.round("score", 6).alias("score"), F.round((F.col("score") / before - 1) * 100, 1).alias("gain_vs_previous_pct"))


def crosstab(df: DataFrame, key: str, value: Column, values: Sequence[str]) -> DataFrame:
    """Counts of ``values`` per key with a POOLED row; absent ones are 0."""
    return pooled(df, key, [count_if(value == v).alias(v) for v in values])


def compare(golden: DataFrame, candidate: DataFrame, keys: Sequence[str], epsilon: float) -> DataFrame:
    """How far a candidate's scores fall short of golden ones, over the queries of both; columns ``score`` and ``route``."""
    g = golden.select(*keys, F.col("score").alias("g"), F.col("route").alias("gr"))
    both = g.join(candidate.select(*keys, F.col("score").alias("c"), F.col("route").alias("cr")), list(keys))
    regret = F.col("g") - F.col("c")
    return both.agg(
        F.count("*").alias("n"), F.round(F.avg("g"), 6).alias("mean_golden"), F.round(F.avg("c"), 6).alias("mean_candidate"), F.round(F.avg(regret), 6).alias("mean_regret"),
        F.round(F.percentile(regret, F.lit(0.5)), 6).alias("median_regret"), F.round(F.percentile(regret, F.lit(0.9)), 6).alias("p90_regret"),
        F.round(100 * share(regret <= L.d(epsilon)), 4).alias("hit_rate_pct"), F.round(100 * share(F.col("gr") == F.col("cr")), 4).alias("agreement_pct"),
    )


def coverage(selected: DataFrame, triples: DataFrame, judged: DataFrame) -> DataFrame:
    """Per dataset: selected rows, those labelled, unlabelled ones that are ready to be, and the shapes."""
    keys = ["dataset", "query_id"]
    shaped = triples.select(*keys, L.outcome_shape().alias("shape"))
    ready = judged.select(*keys).distinct().withColumn("judged", F.lit(True))
    met = selected.select(*keys).join(shaped, keys, "left").join(ready, keys, "left")
    is_labelled = F.col("shape").isNotNull()
    out = met.groupBy("dataset").agg(F.count("*").alias("selected"), count_if(is_labelled).alias("labelled"), count_if(F.col("judged")).alias("judged"), *[count_if(F.col("shape") == s).alias(s) for s in ("routes_differ", "all_tied", "all_zero")])
    return out.select("dataset", "selected", "labelled", F.greatest(F.col("judged") - F.col("labelled"), F.lit(0)).alias("qrels_ready"), (F.col("selected") - F.col("labelled")).alias("unlabelled"), "routes_differ", "all_tied", "all_zero")


def summary(df: DataFrame, value: Column, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, sample deviation (0 for one row), extremes and quartiles."""
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 6)
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"), F.round(F.min(value), 6).alias("min"),
        q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.round(F.max(value), 6).alias("max"),
    )


def breakdowns(df: DataFrame, dimensions: dict[str, Column], decisive: float = L.RUNG_B_MARGIN) -> DataFrame:
    """Counts, decisive share and mean margin along several dimensions; a null value counts as ``unknown``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.coalesce(v.cast("string"), F.lit("unknown")).alias("value")) for k, v in dimensions.items()]))
    rows = df.select(L.margin().alias("m"), L.outcome_shape().alias("shape"), pairs.alias("p")).select("m", "shape", "p.*")
    return rows.groupBy("dimension", "value").agg(
        F.count("*").alias("n"), count_if(F.col("m") >= L.d(decisive)).alias("decisive"), F.round(share(F.col("m") >= L.d(decisive)), 6).alias("decisive_share"),
        *[count_if(F.col("shape") == s).alias(s) for s in ("routes_differ", "all_tied", "all_zero")], F.round(F.avg("m"), 6).alias("mean_margin"),
    )


def concentration(df: DataFrame, column: str) -> DataFrame:
    """The largest share and the effective number (inverse Simpson) of a column's values, nulls aside."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("top"), F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"), F.sum("n").alias("all")).select(
        F.lit(column).alias("column"), F.round("top", 6).alias("largest_share"), F.round(F.col("all").cast("double") * F.col("all") / F.col("sq"), 6).alias("effective_count")
    )


def lane_best(triples: DataFrame, routes: Sequence[str] = L.ROUTES) -> DataFrame:
    """(dataset, best_constant, constant, n): the route with the largest mean in each lane, earlier routes winning ties."""
    out = triples.groupBy("dataset").agg(F.count("*").alias("n"), *[F.avg(L.score(r)).alias(r) for r in routes])
    best = F.greatest(*[F.col(r) for r in routes])
    return out.select("dataset", L.first_route(lambda r: F.col(r) == best, routes).alias("best_constant"), best.alias("constant"), "n")


def headroom_captured(df: DataFrame, routed: Column, routes: Sequence[str] = L.ROUTES) -> DataFrame:
    """Means of each constant, the oracle and a router, and the share of the headroom that the router gains; null without headroom."""
    out = df.agg(*[F.avg(L.score(r)).alias(f"mean_{r}") for r in routes], F.avg(L.top()).alias("oracle"), F.avg(routed).alias("router"))
    best = F.greatest(*[F.col(f"mean_{r}") for r in routes])
    captured = F.when(F.col("oracle") - best > 0, (F.col("router") - best) / (F.col("oracle") - best))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns], F.round(captured, 6).alias("captured"))


def confusion(df: DataFrame, truth: Column, predicted: Column, keys: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*keys).agg(count_if(truth & predicted).alias("tp"), count_if(~truth & predicted).alias("fp"), count_if(truth & ~predicted).alias("fn"), count_if(~truth & ~predicted).alias("tn"))
    rate = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select(*keys, "tp", "fp", "fn", "tn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(tp + tn, tp + fp + fn + tn).alias("agreement"))


def gate(paired: DataFrame, base: str = "_1", cand: str = "_2", *, trust: str = "verified", class_margin: float = L.CLASS_MARGIN) -> DataFrame:
    """One row that weighs what a candidate labelling gains against what it damages, with a verdict."""
    routes = L.COMBINER_ROUTES
    top = {s: F.greatest(*L.scores(s, routes)) for s in (base, cand)}
    shape = {s: L.outcome_shape(s) for s in (base, cand)}
    zero, tied, decisive = (shape[base] == s for s in ("all_zero", "all_tied", "routes_differ"))
    ceiling, lowtie = tied & (top[base] >= L.d(L.CEILING)), tied & (top[base] < L.d(L.CEILING))
    differ, certain = shape[cand] == "routes_differ", decisive & (L.margin(base) >= L.d(class_margin))
    higher = top[cand] > top[base] + L.d(L.TIE_TOLERANCE)
    flip = L.argmax(base, routes) != L.argmax(cand, routes)
    marks = {
        "n": F.lit(True), "all_zero_n": zero, "low_tie_n": lowtie, "ceiling_tie_n": ceiling, "decisive_n": decisive,
        "rescued": zero & (top[cand] > L.d(L.TIE_TOLERANCE)), "broke_up": lowtie & differ & higher, "ceil_broke": ceiling & (shape[cand] != "all_tied"),
        "destroyed": decisive & (shape[cand] == "all_zero"), "collapsed": certain & (shape[cand] == "all_tied"),
        "decisive_thinned": certain & differ & (L.margin(cand) < L.d(class_margin)) & flip,
        "decisive_strengthened": decisive & (L.margin(base) < L.d(class_margin)) & differ & (L.margin(cand) >= L.d(class_margin)),
        "broke_down": lowtie & differ & ~higher, "low_tie_lost": lowtie & (shape[cand] == "all_zero"),
        "cand_certain": differ & (L.margin(cand) >= L.d(class_margin)), "base_certain": certain,
    }
    out = paired.agg(*[count_if(v).alias(k) for k, v in marks.items()])
    c = F.col
    out = out.withColumn("benefit", c("rescued") + c("broke_up") + c("decisive_strengthened"))
    out = out.withColumn("damage", c("destroyed") + c("collapsed") + c("ceil_broke") + c("broke_down") + c("low_tie_lost") + c("decisive_thinned"))
    rate = lambda a, b: c(a).cast("double") / c(b)
    checks = [
        (c("all_zero_n") == 0) | (rate("rescued", "all_zero_n") >= L.d(0.25)), (c("low_tie_n") == 0) | (rate("broke_up", "low_tie_n") >= L.d(0.10)),
        (c("ceiling_tie_n") == 0) | (rate("ceil_broke", "ceiling_tie_n") <= L.d(0.05)), c("benefit") / F.greatest(c("damage"), F.lit(1)) >= L.d(3.0),
        c("damage") / F.greatest(c("decisive_n"), F.lit(1)) <= L.d(0.05), c("cand_certain") > c("base_certain"),
    ]
    passed = checks[0]
    for x in checks[1:]:
        passed = passed & x
    return out.withColumn("verdict", F.when(passed, F.lit("PASS" if trust == "verified" else "PROVISIONAL")).otherwise("FAIL"))
