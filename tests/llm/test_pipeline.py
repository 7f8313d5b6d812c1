"""The pipeline stage by stage, each on what its predecessor kept."""

from __future__ import annotations

import corpus_pipeline
import pytest
from tests.llm import brute

from waymark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(number)))
        docs = spark.read.parquet(str(folder / str(number)))
        out.append(docs)
    return out


def test_columns_stay(spark, stages):
    want = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(sorted(s.columns) == sorted(want) for s in stages[:-1])


def test_decisions_take_effect(spark, stages):
    rows = [{r["doc_id"]: r["text"] for r in s.collect()} for s in stages[:-1]]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [labels[i] for i in rows[0] if i in labels]
    assert sum(kept) / len(kept) > 0.9
    groups = brute.components([(i, brute.fingerprint(t)) for i, t in rows[0].items()])
    assert set(rows[1]) == set(groups.values())
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(rows[2]) == {i for i, _, hit, _ in brute.contamination(list(rows[1].items()), bench) if not hit}
    assert set(rows[3]) == set(rows[2])
    assert not any(brute.secrets(t) for t in rows[3].values())
    assert all(rows[3][i] == t for i, t in rows[2].items() if not brute.secrets(t) and "[secret]" not in rows[3][i])
    assert {r["doc_id"] for r in stages[4].select("doc_id").distinct().collect()} == set(rows[3])


def test_odd_tables(spark, tmp_path):
    """Null and repeated ids, clashing columns and empty tables: every stage judges row by row and keeps clean rows."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(4).collect()]
    rows = [(1, good[0]), (1, good[1]), (None, good[2]), (None, f"{good[3]} {item}"), (2, f"{good[3]} {item}"), (3, good[0]), (3, good[0]), (None, good[2]), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 5, "x", 1.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, row string, score double")
    texts = [set(map(tuple, [(r["doc_id"], r["text"]) for r in docs.collect()]))]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        texts.append({(r["doc_id"], r["text"]) for r in now.collect()})
    assert {(1, good[0]), (1, good[1]), (None, good[2])} <= texts[3]
    assert not any(t == f"{good[3]} {item}" for _, t in texts[3]) and (3, good[0]) not in texts[2]
    assert len([1 for r in now.collect() if r["text"] == good[2]]) == 1
    folder = tmp_path / "empty"
    folder.mkdir()
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(folder / f"{name}.parquet"))
    docs.limit(0).write.parquet(str(folder / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(folder)).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(folder)).count() == len(rows)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[4].count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    as_text = lambda x: sorted(map(tuple, x[columns].astype(str).values.tolist()))
    assert as_text(got) == as_text(want)
