"""Feature spaces against numpy, calls to services, choices against plain versions over single rows."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.operators import features, relational, selection, statistics, worklist


def grams_by_hand(text):
    words = [f" {w} " for w in text.lower().split()]
    return [w[i : i + n] for w in words for n in (3, 4, 5) for i in range(len(w) - n + 1)]


def test_border_grams(spark):
    texts = ["One two,  x\tTHREE", "", "a", None, "ab" * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", features.border_grams(F.col("text")).alias("g")).collect()
    assert {r["id"]: sorted(r["g"]) for r in rows} == {i: sorted(grams_by_hand(t or "")) for i, t in enumerate(texts)}


def test_principal_components_as_numpy(spark):
    x = np.random.default_rng(1).normal(size=(60, 5)) * [5, 3, 2, 1, 0.5] + 7
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, None)], "id int, v array<double>")
    got = {r["id"]: r["components"] for r in features.principal_components(rows, "id", "v", 3).collect()}
    assert got.pop(60) is None
    centred = x - x.mean(axis=0)
    want = centred @ np.linalg.svd(centred, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs([got[i] for i in range(60)]), np.abs(want), atol=1e-6)
    assert features.principal_components(rows.limit(0), "id", "v", 3).count() == 0


def test_truncated_svd_as_numpy(spark):
    words = ["river", "stone", "cloud", "paper", "green", "table"]
    draw = random.Random(2)
    texts = [" ".join(draw.choices(words, k=6)) for _ in range(40)] + [""]
    vectors = features.hashed_grams(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", 128)
    x = np.array([r["x"].toArray() for r in vectors.orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(x, axis=1), [1] * 40 + [0])
    got = {r["id"]: r["components"] for r in features.truncated_svd(vectors, "id", 3).collect()}
    want = x @ np.linalg.svd(x, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs([got[i] for i in range(41)]), np.abs(want), atol=1e-5)


def test_firing_columns(spark):
    rows = spark.createDataFrame([(1.0, 0.0, None), (2.0, 0.0, 1.0), (0.0, 3.0, 2.0)], "a double, b double, c double")
    assert features.firing(rows, ["a", "b", "c"], 2) == ["a", "c"]


def test_attempts_are_bounded_and_only_transient_faults_repeat():
    waits, calls = [], []

    def down(payload):
        calls.append(payload)
        raise worklist.Transient("busy")

    assert worklist.attempt(down, "x", rest=waits.append) == (None, 4, "transient: busy")
    assert waits == [5, 10, 20] and len(calls) == 4

    def wrong(payload):
        raise KeyError(payload)

    assert worklist.attempt(wrong, "x", rest=waits.append) == (None, 1, "KeyError: 'x'")


def test_a_later_run_takes_up_where_one_ended(spark, tmp_path):
    rows = spark.createDataFrame([(i, str(i), 1.0) for i in range(10)], "id long, payload string, cost double")
    path = str(tmp_path / "answers")

    def fussy(payload):
        if payload == "1":
            raise ValueError("no")
        return payload * 2

    run = lambda call, ceiling: {r["id"]: r["answer"] for r in worklist.resume(rows, "id", "payload", call, path, cost="cost", ceiling=ceiling).where("fault IS NULL").collect()}
    assert run(fussy, 4.0) == {0: "00", 2: "22", 3: "33"}
    assert run(fussy, 4.0) == {0: "00", 2: "22", 3: "33"}  # nothing is left to spend
    later = run(lambda payload: payload + "!", 11.0)
    assert later == {0: "00", 2: "22", 3: "33"} | {i: f"{i}!" for i in (1, 4, 5, 6, 7, 8, 9)}


def test_lanes_take_turns_until_chances_or_rows_are_spent():
    asked = []

    def produce(lane, n):
        asked.append((lane, n))
        return (1, True) if lane == "bad" else (n, False)

    got = worklist.take_turns({"bad": 5, "good": 4}, produce, 100, 2)
    assert asked == [("bad", 5), ("good", 4), ("bad", 4)]
    assert got == {"bad": {"made": 2, "chances": 0, "dropped": True}, "good": {"made": 4, "chances": 3 - 1, "dropped": False}}
    assert worklist.take_turns({"a": 5, "b": 5}, lambda lane, n: (n, False), 7) == {"a": {"made": 5, "chances": 3, "dropped": False}, "b": {"made": 2, "chances": 3, "dropped": False}}


def covered_row_by_row(rows, floors, size, share):
    """Every single row weighed at every turn."""
    have, lanes, families, origins, out, stuck = Counter(), Counter(), Counter(), Counter(), [], set()
    left = {r["row_id"]: r for r in rows}
    while len(out) < size and len(stuck) < len(floors):
        need = min((f for f in floors if f not in stuck), key=lambda f: (have[f] / floors[f], f))
        able = [r for r in left.values() if need in r["strata"] and lanes[r["lane"]] < math.ceil(share * size)]
        if not able:
            stuck.add(need)
            continue
        serves = lambda r: sum(have[s] < floors[s] for s in set(r["strata"]) if s in floors)
        top = max(map(serves, able))
        lane = min((lanes[r["lane"]], r["lane"]) for r in able if serves(r) == top)[1]
        best = min((r for r in able if r["lane"] == lane and serves(r) == top), key=lambda r: (families[r["family"]], origins[r["provenance"]], r["row_id"]))
        del left[best["row_id"]]
        lanes[lane] += 1
        families[best["family"]] += 1
        origins[best["provenance"]] += 1
        have.update(s for s in set(best["strata"]) if s in floors)
        out.append((best["row_id"], need))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_cover_weighs_piles_as_if_row_by_row(spark, seed):
    draw = random.Random(seed)
    rows = [{"row_id": f"r{i:03}", "lane": draw.choice("abc"), "family": draw.choice("fg"), "provenance": draw.choice("no"), "strata": draw.sample(["s", "t", "u", "v"], draw.randint(0, 3))} for i in range(150)]
    floors, size, share = {"s": 12, "t": 5, "u": 30, "gone": 3}, 40, 0.4
    want = covered_row_by_row(rows, floors, size, share)
    draw.shuffle(rows)
    got = selection.cover(pd.DataFrame(rows), floors, size, share)
    assert list(zip(got["row_id"], got["stratum"], strict=True)) == want
    if not seed:
        schema = "row_id string, lane string, family string, provenance string, strata array<string>"
        short = selection.cover_shortlist(spark.createDataFrame(rows, schema), size).toPandas()
        assert selection.cover(short, floors, size, share).equals(got)


def test_cover_of_nothing():
    assert selection.cover(pd.DataFrame(columns=["row_id", "lane", "family", "provenance", "strata"]), {"s": 1}, 5, 0.5).empty


def test_residual_fill_keeps_budgets_and_order(spark):
    rows = spark.createDataFrame([(f"r{i:02}", "ab"[i % 2]) for i in range(20)], "row_id string, lane string")
    chosen = rows.where("row_id IN ('r00', 'r02')")
    got = selection.residual_fill(rows, chosen, {"a": 3}, 6).orderBy("rank").collect()
    assert [(r["row_id"], r["rank"]) for r in got] == [("r01", 3), ("r03", 4), ("r04", 5), ("r05", 6)]
    assert selection.residual_fill(rows, chosen, {}, 2).count() == 0


def test_bag_digest_tells_copies_but_not_order(spark):
    digest = lambda rows: relational.bag_digest(spark.createDataFrame([(r,) for r in rows], "d string"), "d").first()["digest"]
    a, b, c = "00ab" + "0" * 28, "00ab" + "1" * 28, "ff00" + "0" * 28
    assert digest([a, b, c]) == digest([c, None, b, a]) != digest([a, b, c, c])
    assert digest([]) == digest([None]) == ""


def test_places_within_a_hot_group(spark):
    rows = [("hot", i // 2) for i in range(600)] + [("cold", 5), (None, 1), (None, 2), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = statistics.numbered_within(df, "g", "v", "at").collect()
    for group in ("hot", "cold", None):
        mine = sorted((r["at"], -1 if r["v"] is None else r["v"]) for r in got if r["g"] == group)
        assert [at for at, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted(v for _, v in mine)
    assert len(got) == len(rows)
    places = statistics.numbered(spark.range(500).withColumn("x", -F.col("id")), "x", "n").collect()
    assert all(r["n"] == 500 - r["id"] for r in places)


def test_judgments_and_documents_of_evaluation_campaigns(spark, tmp_path):
    from waymark.sources.adapters import ADAPTERS

    (tmp_path / "qrels").write_text("301 0 FR-1 2\n 302\t0  FR-2\t0\n")
    got = ADAPTERS["qrels_trec"].read(spark, str(tmp_path / "qrels")).collect()
    assert [tuple(r) for r in got] == [("301", "FR-1", 2.0), ("302", "FR-2", 0.0)]
    (tmp_path / "short").write_text("301 0 FR-1\n")
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        ADAPTERS["qrels_trec"].read(spark, str(tmp_path / "short")).collect()
    (tmp_path / "docs").write_text('D1\thttp://x\tA "title\tbody, "quoted"\nD2\thttp://y\t\tonly\n')
    got = ADAPTERS["documents_tsv"].read(spark, str(tmp_path / "docs")).collect()
    assert [tuple(r) for r in got] == [("D1", 'A "title', 'body, "quoted"'), ("D2", "", "only")]
    (tmp_path / "passages").write_text('{"docid": "1#0", "text": "one"}\n')
    assert [tuple(r) for r in ADAPTERS["passages_jsonl"].read(spark, str(tmp_path / "passages")).collect()] == [("1#0", "", "one")]
