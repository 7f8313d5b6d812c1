"""Declarative adapters from published file formats to lane tables, and uploads."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Adapter:
    """How a file becomes a table: a format with reader options, and an expression per column.

    Columns the file lacks are an error at once, not nulls later."""

    format: str
    columns: Mapping[str, str]
    schema: str
    options: Mapping[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        raw = reader.load(path) if self.format == "parquet" else reader.schema(self.schema).option("mode", "FAILFAST").load(path)
        wanted = {part.split()[0].strip("`") for part in self.schema.split(",")}
        if missing := sorted(wanted - set(raw.columns)):
            raise ValueError(f"{path} lacks {missing}")
        return raw.select(*[F.expr(e).alias(c) for c, e in self.columns.items()])


QREL_COLUMNS = {"query_id": "CAST(`query-id` AS STRING)", "doc_id": "CAST(`corpus-id` AS STRING)", "relevance": "CAST(score AS DOUBLE)"}

#: Field mappings of the public collections' files.
ADAPTERS = {
    "qrels_tsv": Adapter("csv", QREL_COLUMNS, "`query-id` string, `corpus-id` string, score double", {"sep": "\t", "header": "true"}),
    "qrels_jsonl": Adapter("json", QREL_COLUMNS, "`query-id` string, `corpus-id` string, score double"),
    "corpus_jsonl": Adapter("json", {"doc_id": "_id", "title": "coalesce(title, '')", "text": "text"}, "_id string, title string, text string"),
    "queries_jsonl": Adapter("json", {"query_id": "_id", "text": "text"}, "_id string, text string"),
    "corpus_tsv": Adapter("csv", {"doc_id": "id", "title": "''", "text": "text"}, "id string, text string", {"sep": "\t"}),
    "queries_tsv": Adapter("csv", {"query_id": "id", "text": "text"}, "id string, text string", {"sep": "\t"}),
    "products_latin1": Adapter("csv", {"doc_id": "product_uid", "title": "product_title", "text": "coalesce(product_description, '')"}, "product_uid string, product_title string, product_description string", {"header": "true", "encoding": "ISO-8859-1", "quote": '"', "escape": '"'}),
    "qrels_trec": Adapter("text", {n: f"CAST(split(trim(value), '\\\\s+')[{i}] AS {k})" for n, i, k in (("query_id", 0, "STRING"), ("doc_id", 2, "STRING"), ("relevance", 3, "DOUBLE"))}, "value string"),
    "documents_tsv": Adapter("csv", {"doc_id": "id", "title": "coalesce(title, '')", "text": "coalesce(body, '')"}, "id string, url string, title string, body string", {"sep": "\t", "quote": ""}),
    "passages_jsonl": Adapter("json", {"doc_id": "docid", "title": "coalesce(title, '')", "text": "text"}, "docid string, title string, text string"),
    "answers_parquet": Adapter("parquet", {"query_id": "CAST(id AS STRING)", "text": "question", "gold_ids": "gold_ids"}, "id string, question string, gold_ids string"),
}

ALIASES = ("query", "text", "question")
MAX_UPLOAD = 64 << 20


def first_alias(df: DataFrame, names: Sequence[str] = ALIASES) -> Column:
    """The first of several column names that a table has."""
    there = [F.col(n) for n in names if n in df.columns]
    if not there:
        raise ValueError(f"none of {list(names)} in {df.columns}")
    return F.coalesce(*there)


def queries_from_zip(spark: SparkSession, blob: bytes, folder: str, most: int = MAX_UPLOAD) -> DataFrame:
    """(query) from an uploaded archive with ``queries.parquet`` or ``queries.csv``; its size is bounded before anything is unpacked.

    ``folder`` is where the driver and all executors can read the unpacked file."""
    with zipfile.ZipFile(io.BytesIO(blob)) as archive:
        names = {i.filename: i for i in archive.infolist()}
        name = next((n for n in ("queries.parquet", "queries.csv") if n in names), None)
        if name is None:
            raise ValueError("the archive has no queries.parquet or queries.csv")
        if names[name].file_size > most:
            raise ValueError(f"{name} is larger than {most} bytes")
        data = archive.read(name)
    path = f"{folder.rstrip('/')}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    df = spark.read.parquet(path) if name.endswith("parquet") else spark.read.option("header", True).csv(path)
    return df.select(first_alias(df).alias("query")).where("query IS NOT NULL")
