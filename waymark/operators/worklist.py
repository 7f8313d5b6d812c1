"""Calls to outside services over tables: bounded attempts, a ceiling on costs, results that a later run takes up.

A service is a plain callable on one payload, so any judge or generator fits. Rows stay in Spark; the driver sees one row a lane.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.graph import checkpointed
from waymark.operators.statistics import sums_before

ANSWER = "answer string, attempts int, fault string"


class Transient(Exception):
    """A fault that another attempt may cure."""


def attempt(call: Callable[[str], str], payload: str, pauses: Sequence[float] = (5, 10, 20), rest: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str | None]:
    """(answer, attempts, fault): one attempt more than there are pauses, and only after transient faults; any other fault ends the row."""
    for n in range(1, len(pauses) + 2):
        try:
            return call(payload), n, None
        except Transient as fault:
            if n > len(pauses):
                return None, n, f"transient: {fault}"
            rest(pauses[n - 1])
        except Exception as fault:  # noqa: BLE001 - a row's fault is a result, not the end of the job
            return None, n, f"{type(fault).__name__}: {fault}"
    raise AssertionError("the loop ends in a return")


def answered(df: DataFrame, key: str, payload: str, call: Callable[[str], str], pauses: Sequence[float] = (5, 10, 20), rest: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, answer, attempts, fault) of every row. A task that is run again asks again, so calls must be repeatable."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [attempt(call, p, pauses, rest) for p in rows[payload]]
            yield pd.DataFrame({key: rows[key], "answer": [a for a, _, _ in found], "attempts": [n for _, n, _ in found], "fault": [f for _, _, f in found]})

    return df.select(key, payload).mapInPandas(ask, f"{key} {df.schema[key].dataType.simpleString()}, {ANSWER}")


def within_budget(df: DataFrame, key: str, cost: str, ceiling: float) -> DataFrame:
    """The rows, in the order of their distinct ``key``, whose costs sum up to no more than ``ceiling``; summed range by range."""
    return sums_before(df, key, cost, "_spent").where(F.col("_spent") + F.col(cost) <= ceiling).drop("_spent")


def resume(df: DataFrame, key: str, payload: str, call: Callable[[str], str], path: str, *, cost: str, ceiling: float, **retry) -> DataFrame:
    """All answers of the table at ``path`` after this run: rows that have one there are neither asked nor paid again, faults are.

    What earlier runs paid counts against the ceiling. A run's answers are appended in one write, so a run that dies leaves nothing half done.
    """
    spark = df.sparkSession
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {ANSWER}, cost double"
    try:
        done = spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        done = spark.createDataFrame([], schema)
    paid = done.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
    open_rows = df.join(done.where("fault IS NULL").select(key), key, "left_anti")
    chosen = checkpointed(within_budget(open_rows, key, cost, ceiling - paid))
    fresh = answered(chosen, key, payload, call, **retry).join(chosen.select(key, F.col(cost).cast("double").alias("cost")), key)
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def take_turns(need: Mapping[str, int], produce: Callable[[str, int], tuple[int, bool]], budget: int, chances: int = 3) -> dict[str, dict[str, int | bool]]:
    """Lanes in turn until each has what it needs, the row budget is spent or its chances are.

    ``produce(lane, n)`` gives the rows made, at most ``n``, and whether it stopped early after a streak of faults. A turn that ends by itself
    finishes its lane; a streak costs the lane a chance and sends it to the end of the queue. One entry a lane: made, chances, dropped.
    """
    state = {lane: {"made": 0, "chances": chances, "dropped": False} for lane in need}
    queue = list(need)
    while queue and budget > 0:
        lane, *queue = queue
        turn = state[lane]
        made, faulty = produce(lane, min(need[lane] - turn["made"], budget))
        turn["made"] += made
        budget -= made
        if faulty:
            turn["chances"] -= 1
            turn["dropped"] = not turn["chances"]
            if turn["chances"]:
                queue.append(lane)
    return state
