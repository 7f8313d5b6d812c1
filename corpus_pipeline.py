"""A corpus pipeline: filter by quality, drop near-duplicates and benchmark leaks, mask secrets, pack.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return
the columns of ``documents``; the last returns one row for each piece of a packed sequence, with its ids.

Rows are judged one by one, by their own texts: those without an id or with another row's id go or stay like others. Texts
move once, where near-duplicates are told apart, and those with weak parts of secrets once more. Null and empty texts score by the classifier's bias,
are copies of each other, hold nothing to find or mask, and pack as their end id. Texts of any length are read whole; an empty table gives no rows
in every stage; without labels nothing is rejected, without benchmark nothing is contaminated; further columns stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import Staged, read
from waymark.llm.decontaminate import drop_contaminated
from waymark.llm.packing import pack_documents
from waymark.llm.quality_model import drop_rejected
from waymark.llm.secrets import redact
from waymark.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go; no row is moved."""
    return drop_rejected(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: the first by id (null ids last), then by length and hash of its text; of rows equal in id and text one."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark window go; no row is moved."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked and ``n_chars`` follows; every row stays."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 2048."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), store=STORE)


#: Workers keep what they have stored into the next run's stages, which need the memory more than this one needs speed.
STORE = 200_000

STAGES = [
    ("quality classifier", quality),
    ("simhash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_masking),
    ("packing", packing),
]

#: A classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    staged = Staged(spark)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged.put(docs, f"stage-{number}")
    return docs
