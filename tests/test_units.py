"""Hand values, boundaries, nulls and invariances."""

from __future__ import annotations

import io
import json
import math
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.functions import bands as B
from waymark.functions import labels as L
from waymark.functions import routing
from waymark.operators import graph, metrics, relational, retrieval, selection, statistics
from waymark.operators import reports as R
from waymark.sources import adapters, caches, lanes

TRIPLE = "dataset string, query_id string, score_dense_only double, score_pure_rrf double, score_sparse_only double"


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([("lane-a", "1", 1.0, 0.15, 0.0), ("lane-a", "2", 0.0, 0.9, 0.1), ("lane-b", "3", 0.0, 0.0, 0.0)], TRIPLE)


def test_headroom_by_hand(labels):
    got = {r["dataset"]: r for r in R.headroom(labels).collect()}
    assert got["lane-a"]["headroom"] == 0.425 and got["lane-a"]["best_constant"] == "pure_rrf" and got["lane-a"]["oracle"] == 0.95
    assert got["lane-b"]["headroom"] == 0.0 and got["lane-b"]["all_zero_share"] == 1.0
    assert got["POOLED"]["constant"] == 0.35 and got["POOLED"]["labelled"] == 3


def test_decisive_margin_boundary(spark):
    rows = spark.createDataFrame([("a", "1", 0.7, 0.3, 0.0), ("a", "2", 0.4, 0.0, 0.0)], TRIPLE)
    got = {r["query_id"]: (r["a"], r["b"]) for r in rows.select("query_id", (L.margin() >= L.d(L.DECISIVE_MARGIN)).alias("a"), (L.margin() >= L.d(L.RUNG_B_MARGIN)).alias("b")).collect()}
    assert L.DECISIVE_MARGIN < 0.4
    assert got == {"1": (True, False), "2": (True, True)}


def test_shapes_and_serving(spark):
    rows = [("near", 0.9, 0.9, 0.9), ("sparse", 0.1, 0.2, 0.8), ("zero", 0.0, 0.0, 0.0), ("two", 0.5, 0.5, 0.0), ("parity", 0.9, 0.75, 0.65), ("nan", float("nan"), 0.4, 0.1)]
    df = spark.createDataFrame([("x", *r) for r in rows], TRIPLE)
    got = {r["query_id"]: (r["shape"], r["route"], r["serve"]) for r in df.select("query_id", L.outcome_shape().alias("shape"), L.route_label().alias("route"), L.serve().alias("serve")).collect()}
    assert got["near"] == ("all_tied", "sparse_only", "sparse_only")
    assert got["sparse"] == ("routes_differ", "sparse_only", "sparse_only")
    assert got["zero"] == ("all_zero", None, None)
    assert got["two"] == ("routes_differ", "dense_only", "dense_only")
    assert got["parity"][1:] == ("dense_only", "sparse_only")
    assert got["nan"][1] == "pure_rrf"  # a missing score never wins


def test_bands_fail_on_nan_and_null(spark):
    df = spark.createDataFrame([(0.5,), (float("nan"),), (None,), (0.7,)], "x double")
    assert [r["m"] for r in df.select(B.Band("x", 0.5, 0.7).mask().alias("m")).collect()] == [True, False, False, False]
    assert [r["m"] for r in df.select(B.Band("x", at_least=0.1).mask().alias("m")).collect()] == [True, False, False, True]
    with pytest.raises(ValueError):
        B.Band("x")
    for at_least, below in ((0.5, 0.5), (0.7, 0.5)):
        with pytest.raises(ValueError):
            B.Band("x", at_least, below)


def test_cells_drop_missing_columns_and_doubled_names():
    cells = B.load_cells([{"name": "a", "predicate": [["x", 0.5, None]]}, {"name": "b", "any_of": [[["y", None, 1.0]]]}])
    assert [c.name for c in B.available(cells, ["x"])] == ["a"]
    with pytest.raises(ValueError):
        B.load_cells([{"name": "a", "predicate": [["x", 1]]}, {"name": "a", "predicate": [["x", 2]]}])
    with pytest.raises(ValueError):
        B.load_cells([{"name": "a", "predicate": []}])


def test_cells_from_catalog_files(spark, tmp_path):
    first, second = tmp_path / "first.json", tmp_path / "second.yaml"
    cells = [{"name": f"c{i}", "note": "ignored", "predicate": [{"column": "shape.words", "at_least": i, "below": i + 2}], "any_of": [{"column": "share", "below": 0.5}, {"column": "spans", "at_least": 1}]} for i in range(40)]
    first.write_text(json.dumps({"_note": "ignored", "cells": cells}))
    second.write_text("_note: >\n  ignored\ncells:\n- name: long\n  predicate:\n  - column: shape.words\n    at_least: 3\n")
    pytest.importorskip("yaml")
    loaded = B.read_cells(first, second)
    assert [c.name for c in loaded] == [*(f"c{i}" for i in range(40)), "long"]
    rows = spark.createDataFrame([(1, 3.0, 0.9, 1), (2, 3.0, 0.9, 0), (3, 0.0, 0.1, 0), (4, None, 0.1, 2)], "id int, words double, share double, spans int").withColumnRenamed("words", "shape.words")
    got = {r["id"]: r["cells"] for r in rows.select("id", B.memberships(loaded).alias("cells")).collect()}
    assert got == {1: ["c2", "c3", "long"], 2: ["long"], 3: ["c0"], 4: []}
    with pytest.raises(ValueError):
        B.read_cells(first, first)


def test_cuts(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (1.6,), (None,)], "x double")
    right = [r[0] for r in df.select(B.cut_right_closed(F.col("x"), [0.5, 1.5], ["clean", "light", "heavy"])).collect()]
    left = [r[0] for r in df.select(B.cut_left_closed(F.col("x"), [0.5, 1.5], ["clean", "light", "heavy"])).collect()]
    assert right == ["clean", "light", "heavy", "unknown"] and left == ["light", "heavy", "heavy", "unknown"]


def test_unions_and_precedence(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b", 7), (2, "c", 8)], "k int, v string, w int")
    assert {(r["k"], r["v"]) for r in relational.priority_union([a, b], ["k"]).collect()} == {(1, "b"), (2, "c")}
    assert {(r["k"], r["v"]) for r in relational.supplement(a, b, ["k"]).collect()} == {(1, "a"), (2, "c")}
    with pytest.raises(ValueError):
        relational.require(a, ["missing"])
    with pytest.raises(ValueError):
        relational.require(a, ["k"], forbidden=["v"])
    with pytest.raises(ValueError):
        relational.materialize(spark.createDataFrame([("d", "", "x")], "doc_id string, title string, text string"), spark.createDataFrame([("q", "d", 1.0)], "query_id string, doc_id string, relevance double"), 0, "s")


def test_corpus_target_rounds_half_to_even(spark):
    df = spark.createDataFrame([(2_500.5,), (1.0,), (1e9,)], "x double")
    assert [r[0] for r in df.select(relational.corpus_target(F.col("x"), 1.0, 10, 10_000)).collect()] == [2500, 10, 10_000]


def test_ranking_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", "r", 1, "a"), ("q", "r", 2, "b"), ("p", "r", 1, "z")], "query_id string, route string, rank int, doc_id string")
    gold = spark.createDataFrame([("q", "b", 1.0), ("q", "c", 1.0)], "query_id string, doc_id string, relevance double")
    got = {r["query_id"]: r for r in metrics.assess(ranked, gold).collect()}
    import math

    assert got["q"]["hit"] == 0 and abs(got["q"]["ndcg"] - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-12 and got["q"]["recall"] == 0.5
    assert (got["p"]["hit"], got["p"]["ndcg"], got["p"]["recall"]) == (0, 0, 0)


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([("1", "common common rare"), ("2", "common common common"), ("3", "common other words")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "rare common")], "query_id string, query string")
    assert [r["doc_id"] for r in retrieval.bm25(asked, docs, 2).orderBy("rank").collect()] == ["1", "2"]
    assert retrieval.bm25(asked, docs.limit(0), 2).count() == 0


def test_bm25_same_rows_by_either_join(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i), " ".join(f"w{(i * k) % 7}" for k in range(1, 9))) for i in range(40)], "doc_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 1} w{i}") for i in range(5)], "query_id string, query string")
    by_document = sorted(map(tuple, retrieval.bm25(asked, docs, 3).collect()))
    monkeypatch.setattr(retrieval, "ASKED", 0)
    assert len(by_document) == 15 and by_document == sorted(map(tuple, retrieval.bm25(asked, docs, 3).collect()))


def test_pair_counts(spark):
    docs = spark.createDataFrame([("1", "a b c"), ("2", "a c"), ("3", "b")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "c a b")], "query_id string, query string")
    assert {(r["a"], r["b"], r["together"]) for r in retrieval.pair_counts(asked, docs).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_lane_cap_against_search():
    draw = random.Random(1)
    for _ in range(300):
        counts = [draw.randint(0, 12) for _ in range(draw.randint(1, 5))]
        n = draw.randint(1, 30)
        want = next((r / n for r in range(1, n + 1) if sum(min(c, r) for c in counts) >= n), 1.0)
        assert selection.lane_cap(counts, n, 0.0)["floor"] == want, (counts, n)
        share = draw.random()
        fits = [k for k in range(n + 1) if sum(min(c, math.ceil(share * k)) for c in counts) >= k]
        assert selection.supply(counts, share, n) == max(fits)
    assert selection.lane_cap([5, 5, 0], 0, 0.1) == {"floor": 1.0, "share": 1.0, "capacity": 0, "infeasible": True}


def test_feasible_total():
    supply = {("dense", "a"): 10, ("dense", "b"): 10, ("sparse", "a"): 3, ("sparse", "b"): 3}
    assert selection.feasible_total(supply, {"dense": 0.5, "sparse": 0.5}, 0.5, 1000) == 13
    assert selection.feasible_total({}, {"dense": 1.0}, 0.5, 1000) == 0


def test_allocation_respects_supply_and_caps():
    bought = selection.allocate({"dense": 100.0}, {"a": {"dense": 0.5}, "b": {"dense": 0.25}}, {"a": 60, "b": 1000}, {("a", "dense"): 100.0, ("b", "dense"): 20.0})
    assert bought == {"a": 60.0, "b": 80.0}


def test_composer_ignores_row_order():
    draw = random.Random(3)
    rows = [{"row_id": f"r{i:03d}", "lane": draw.choice("ab"), "family": draw.choice("xyz"), "strata": sorted(draw.sample(["s", "t", "u"], draw.randint(1, 2))), "tokens": draw.sample("abcdefgh", 3)} for i in range(80)]
    one = selection.compose(pd.DataFrame(rows), {"s": 10, "t": 5, "u": 60}, {"a": 20, "b": 20}, 50)
    draw.shuffle(rows)
    assert one.equals(selection.compose(pd.DataFrame(rows), {"s": 10, "t": 5, "u": 60}, {"a": 20, "b": 20}, 50))
    assert one["lane"].value_counts().max() <= 20 and one["row_id"].is_unique


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["part"] for r in found.collect()} == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_tests():
    assert statistics.binomial_two_sided(0, 0) == 1.0
    assert abs(statistics.binomial_two_sided(1, 5) - 0.21875) < 1e-12
    low, high = statistics.wilson(5, 10)
    assert abs(low - 0.2366) < 1e-3 and abs(high - 0.7634) < 1e-3
    assert 0.49 < statistics.power(0.02 + 1.96 * 0.05, 0.05) < 0.51


def test_paired_bootstrap_covers_the_mean(spark):
    rows = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % 11).cast("double").alias("d"))
    got = statistics.interval(statistics.paired_bootstrap(rows, 200, "s")).first()
    assert got["low"] < 4.99 < got["high"] and abs(got["se"] - 3.16 / 2000**0.5) < 0.02


def test_sums_before(spark):
    draw = random.Random(2)
    rows = [(x, draw.randint(0, 9)) for x in draw.sample(range(1000), 200)]
    got = {r["x"]: r["b"] for r in statistics.sums_before(spark.createDataFrame(rows, "x int, v int").repartition(5), "x", "v", "b").collect()}
    assert got == {x: sum(v for y, v in rows if y < x) for x, _ in rows}


def test_serving_rule_without_fire(spark):
    df = spark.createDataFrame([(0.2, 0.1), (0.05, 0.04), (0.6, 0.7), (0.9, 0.1)], "d double, s double")
    heads = {"dense_only": F.col("d"), "sparse_only": F.col("s")}
    assert [r[0] for r in df.select(routing.serve_most_probable(heads, 0.5, 0.1)).collect()] == ["dense_only", "pure_rrf", "sparse_only", "dense_only"]
    assert [r[0] for r in df.select(routing.serve_most_probable(heads, 0.5)).collect()][1] == "dense_only"  # the default bar never hedges


def test_lane_snapshots(spark, tmp_path):
    paths = lanes.LanePaths(str(tmp_path))
    queries = spark.createDataFrame([("q", "text")], "query_id string, text string")
    qrels = spark.createDataFrame([("q", "d", 1)], "query_id string, doc_id string, relevance int")
    lanes.LaneSnapshot.write(paths, "one", queries=queries, qrels=qrels)
    lane = lanes.LaneSnapshot(spark, paths, "one")
    assert lane.read("qrels").first()["relevance"] == 1.0 and lane.read("excluded").count() == 0
    with pytest.raises(FileNotFoundError):
        lane.read("corpus")
    with pytest.raises(ValueError):
        lanes.LaneSnapshot.write(paths, "two", queries=queries, qrels=qrels, corpus=spark.createDataFrame([], lanes.SCHEMAS["corpus"]))
    assert paths.lanes(spark, "qrels") == ["one"]
    with pytest.raises(FileNotFoundError):
        lanes.LaneSnapshot(spark, paths, "absent")


def test_adapters_and_uploads(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\ta\t2\n")
    assert adapters.ADAPTERS["qrels_tsv"].read(spark, str(tmp_path / "q.tsv")).collect()[0].asDict() == {"query_id": "1", "doc_id": "a", "relevance": 2.0}
    (tmp_path / "c.jsonl").write_text('{"_id": "x", "text": "body"}\n')
    assert adapters.ADAPTERS["corpus_jsonl"].read(spark, str(tmp_path / "c.jsonl")).first()["title"] == ""
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as archive:
        archive.writestr("queries.csv", "text,other\nhello,1\n,2\n")
    assert [r["query"] for r in adapters.queries_from_zip(spark, blob.getvalue(), str(tmp_path)).collect()] == ["hello"]
    with pytest.raises(ValueError):
        adapters.queries_from_zip(spark, blob.getvalue(), str(tmp_path), most=3)


def test_caches(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert caches.build_or_load(spark, path, {"k": 10}, build).count() == 3
    assert caches.build_or_load(spark, path, {"k": 10}, build).count() == 3 and len(calls) == 1
    with pytest.raises(caches.StaleCache):
        caches.build_or_load(spark, path, {"k": 20}, build)
    store = str(tmp_path / "vectors")
    compute = lambda missing: missing.withColumn("v", F.col("id") * 2)
    assert caches.fill_missing(spark, store, spark.range(3), "id", compute).count() == 3
    assert caches.fill_missing(spark, store, spark.range(5), "id", compute).count() == 5
    assert {r["dataset"]: r["cached"] for r in caches.registry_counts(spark, {"a": path, "b": str(tmp_path / "no")}).collect()} == {"a": 3, "b": None}


def test_near_pairs_ask_every_vector(spark, monkeypatch):
    """Neither id of a pair need be a multiple of ten, and ids go both ways; equal vectors are linked to their smallest id alone."""
    import numpy as np

    from waymark.operators import graph
    from waymark.operators import retrieval as V

    monkeypatch.setattr(V, "PAIR_BLOCK", 16)
    draw = np.random.Generator(np.random.PCG64(3))
    m = draw.normal(size=(120, 8)).astype(np.float32)
    for a, b in ((7, 20), (11, 13), (13, 58), (99, 101)):
        m[b] = m[a] + draw.normal(size=8) * 0.02
    m[[31, 42, 53]] = m[5]
    m[77] = 0
    rows = spark.createDataFrame([(i, m[i].tolist()) for i in range(120)], "vec_id long, vector array<float>").repartition(3)
    unit = m.astype(float) / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-12)
    copies = {31, 42, 53}
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if a not in copies and b not in copies and unit[a] @ unit[b] > 0.95} | {(5, c) for c in copies}
    assert {(7, 20), (11, 13), (99, 101)} <= want
    found = V.near_pairs(rows, 0.95)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    parts = {r["node"]: r["part"] for r in graph.components(found).collect()}
    assert parts[20] == 7 and parts[58] == parts[13] == 11 and parts[53] == 5


@pytest.mark.parametrize("theta", [0.7, 0.0])
def test_shortlist_changes_no_choice(spark, theta):
    draw = random.Random(4)
    rows = [(f"{o}:{n}", draw.choice("AB"), draw.choice("st"), draw.choice([["x"], ["y"], ["x", "y"]]), [str(o), str(n)]) for o in range(1, 400) for n in (1, 2)]
    names = "row_id string, lane string, family string, strata array<string>, tokens array<string>"
    short = selection.shortlist(spark.createDataFrame(rows, names), 5).toPandas()
    every = pd.DataFrame(rows, columns=["row_id", "lane", "family", "strata", "tokens"])
    args = ({"x": 3, "y": 4}, {"A": 3, "B": 3}, 5, theta)
    assert 5 < len(short) < len(rows)
    assert selection.compose(short, *args).to_dict("records") == selection.compose(every, *args).to_dict("records")


def test_composers_see_every_order(spark):
    from waymark.plans import q_selection

    orders = {int(r["o"]) % 3 for r in q_selection._composer_rows(spark, "/root/testdata/sf0.001").select(F.element_at("tokens", 1).alias("o")).distinct().collect()}
    assert orders == {0, 1, 2}
