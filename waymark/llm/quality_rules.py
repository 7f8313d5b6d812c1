"""Quality rules of documents and of their hosts.

Each document gets counts and a verdict of its own; the failures of a host's documents become a
rate, shrunk towards all hosts by an empirical beta prior, and a host whose shrunk rate is too
high fails as a whole. Only hosts that fail are joined back, so a hot host costs no more than another.

Defined results: null, empty and blank texts have no words and fail; a null host is nobody's host and
never fails; repeated rows count each time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Staged, read, settled, texts

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A host fails if more than this share of its documents is expected to fail.
HOST_RATE = 0.8
#: Strength of the prior where hosts do not tell one (fewer than two of them, or no spread).
PRIOR_STRENGTH = 10.0

_COUNTS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_FIRST = np.ones(256, np.int64)  # bytes that begin a character that is no white space
_FIRST[0x80:0xC0] = 0
_FIRST[[9, 10, 11, 12, 13, 32]] = 0


def _ranks(a: np.ndarray) -> tuple[np.ndarray, int]:
    values, inverse = np.unique(a, return_inverse=True)
    return inverse.astype(np.int64), len(values)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in ``words``; exact, without hashing."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    base, key, span = len(numbers), ids[:n], len(numbers)
    for j in range(1, window):
        if span * base >= 1 << 62:
            key, span = _ranks(key)
        key, span = key * base + ids[j : j + n], span * base
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    delta = np.zeros(len(words) + 1, np.int64)
    delta[:n] += twice
    delta[window : window + n] -= twice
    return int((np.cumsum(delta) > 0).sum())


def _measure(text: bytes | None) -> tuple[int, int, int, int, int]:
    words = text.split() if text else []
    if not words:
        found = np.bincount(np.frombuffer(text or b"", np.uint8), minlength=256)
        return 0, 0, int(found @ _SYMBOL), 0, 0
    found = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), int(found @ _FIRST), int(found @ _SYMBOL), len(lines) - len(set(lines)), repeated_words(words)


def document_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The base counts of every row, and its host."""

    def scan(batches):
        for batch in batches:
            rows = np.array([_measure(v) for v in texts(batch.column(2))], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(rows[:, i]) for i in range(5))], ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    host = F.col(host_col).cast("string")
    domain = F.coalesce(F.nullif(F.lower(F.regexp_extract(host, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit("")), host)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), domain.alias("host"), F.col(text_col).cast("string").alias("text")).mapInArrow(settled(scan), _COUNTS)


def base_failure() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) by the method of moments over hosts (n, failed); one aggregated row reaches the driver."""
    rate = F.col("failed") / F.col("n")
    row = hosts.agg(F.count("*").alias("k"), F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("n")).alias("i")).first()
    mean = min(max(row["m"] if row["m"] is not None else 0.5, 1e-3), 1 - 1e-3)
    spread = mean * (1 - mean)
    between = (row["v"] or 0.0) - spread * (row["i"] or 0.0)  # without what sampling alone would give
    strength = min(max(spread / between - 1, 1.0), 1e6) if row["k"] >= 2 and between > 0 else PRIOR_STRENGTH
    return mean * strength, (1 - mean) * strength


def host_verdicts(counts: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """(host, n, failed, rate, host_failed) with rates shrunk towards all hosts."""
    hosts = counts.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum(base_failure().cast("long")).alias("failed"))
    alpha, beta = beta_prior(hosts)
    rate = (F.col("failed") + alpha) / (F.col("n") + alpha + beta)
    return hosts.withColumn("rate", rate).withColumn("host_failed", F.col("rate") > host_rate)


def judge(docs: DataFrame, *, host_rate: float = HOST_RATE, **columns) -> DataFrame:
    """Every row's counts, ``base_failed`` and ``kept``."""
    counts = Staged(docs.sparkSession).put(document_counts(docs, **columns), "counts")
    bad = host_verdicts(counts, host_rate).where("host_failed").select("host", "host_failed")
    judged = counts.join(bad, "host", "left")
    return judged.withColumn("base_failed", base_failure()).withColumn("kept", ~F.col("base_failed") & F.col("host_failed").isNull()).drop("host_failed")


def op8_quality_rules(spark, sf_dir):
    return judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM f WHERE source IS NOT NULL GROUP BY source),
p0 AS (SELECT count(*) AS k, least(greatest(coalesce(avg(failed / n), 0.5::DOUBLE), 1e-3), 1 - 1e-3) AS m, coalesce(var_samp(failed / n), 0) AS v, coalesce(avg(1 / n), 0) AS i FROM h),
p1 AS (SELECT m, CASE WHEN k >= 2 AND v - m * (1 - m) * i > 0 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * i) - 1, 1.0), 1e6) ELSE {PRIOR_STRENGTH}::DOUBLE END AS s FROM p0),
b AS (SELECT source FROM h, p1 WHERE (failed + m * s) / (n + s) > {HOST_RATE}::DOUBLE)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM b)) AS kept FROM f
"""
