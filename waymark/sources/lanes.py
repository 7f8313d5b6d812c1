"""Lane snapshots and their layout: ``<root>/<lane>/{queries,qrels,corpus,excluded}.parquet``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from waymark.operators.relational import require_none

TEXT = T.StringType()
SCHEMAS = {
    "queries": T.StructType([T.StructField("query_id", TEXT), T.StructField("text", TEXT)]),
    "qrels": T.StructType([T.StructField("query_id", TEXT), T.StructField("doc_id", TEXT), T.StructField("relevance", T.DoubleType())]),
    "corpus": T.StructType([T.StructField("doc_id", TEXT), T.StructField("title", TEXT), T.StructField("text", TEXT)]),
    "excluded": T.StructType([T.StructField("query_id", TEXT), T.StructField("doc_id", TEXT)]),
}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@dataclass(frozen=True)
class LanePaths:
    root: str

    def of(self, lane: str, artifact: str) -> str:
        return f"{self.root.rstrip('/')}/{lane}/{artifact}.parquet"

    def lanes(self, spark: SparkSession, artifact: str) -> list[str]:
        """The lanes that hold an artifact."""
        top = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory()]
        return sorted(n for n in names if exists(spark, self.of(n, artifact)))


class LaneSnapshot:
    """Queries and judgments are required, the corpus only when asked for, exclusions can be absent."""

    def __init__(self, spark: SparkSession, paths: LanePaths, lane: str):
        self.spark, self.paths, self.lane = spark, paths, lane
        for artifact in ("queries", "qrels"):
            if not exists(spark, paths.of(lane, artifact)):
                raise FileNotFoundError(f"{lane} has no {artifact}")

    def read(self, artifact: str) -> DataFrame:
        path = self.paths.of(self.lane, artifact)
        if not exists(self.spark, path):
            if artifact == "excluded":
                return self.spark.createDataFrame([], SCHEMAS[artifact])
            raise FileNotFoundError(f"{self.lane} has no {artifact} yet")
        return self.spark.read.schema(SCHEMAS[artifact]).parquet(path)

    @staticmethod
    def write(paths: LanePaths, lane: str, *, queries: DataFrame, qrels: DataFrame, corpus: DataFrame | None = None, excluded: DataFrame | None = None) -> None:
        """Writes metadata first and the corpus last; refuses an empty corpus and null judgments."""
        require_none(qrels.where("query_id IS NULL OR doc_id IS NULL OR relevance IS NULL"), "judgments with nulls")
        if corpus is not None and corpus.isEmpty():
            raise ValueError("the corpus is empty")
        for artifact, df in (("queries", queries), ("qrels", qrels), ("excluded", excluded), ("corpus", corpus)):
            if df is not None:
                names = SCHEMAS[artifact].fieldNames()
                df.select(*[df[c].cast(SCHEMAS[artifact][c].dataType) for c in names]).write.mode("overwrite").parquet(paths.of(lane, artifact))
