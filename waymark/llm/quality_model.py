"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Features are one- and two-word n-grams, once of the words themselves (letters A-Z in lower case) and once of
their shapes (runs of upper case, other letters, digits and each mark), hashed into ``BUCKETS``
weights. A pair of equal words gives one more n-gram, the same for all words. A feature's value is its share of the document's n-grams times ``SCALE``, so a score is one
sparse dot product whatever the length of the text.

Training is bounded: of the labelled rows that may be learned from, those with the smallest hashes of
their ids are used, about ``SAMPLE`` of them (all, if there are fewer). One task fits them in the order of that
hash. Scoring is a narrow pass with the weights, 1 MB, broadcast.

Defined results: null, empty and blank texts score by the bias alone; rows with a null id are never learned
from and count as held out; null labels are ignored and an id labelled twice takes its mean label;
repeated documents are learned once and scored alike; without usable labels every score is 0.5; texts of any length are read
whole; an empty table gives no rows; other columns are ignored, and ``drop_rejected`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import LOWER, held_out, joined, kept_rows, mix, read, settled, steps, texts, word_hashes, word_runs

BUCKETS = 1 << 18
SAMPLE = 8000
THRESHOLD = 0.3
SCALE = 12.0
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.4, 1.0, 0.02, 0.02

#: Classes of bytes for shapes: white space 0, upper case 1, digits 2, other letters 3, each mark its own.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[33:127] = np.arange(33, 127)
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 3
_CLASS[:33] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 0


def _ngrams(values: list[bytes | None], begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the texts of a step and, for each, the row it belongs to."""
    buf, row_ends = joined(values, begin, end)
    starts, ends = word_runs(buf)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.searchsorted(row_ends, starts, "right")
    word = word_hashes(LOWER[buf], starts, ends)
    kinds = _CLASS[buf]
    change = np.empty(len(buf), bool)
    change[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
    at = np.flatnonzero(change & (kinds != 0))
    shape_start = np.searchsorted(at, starts)
    shape_end = np.concatenate([shape_start[1:], [len(at)]])
    shape = word_hashes(kinds[at], shape_start, shape_end)
    follows = rows[1:] == rows[:-1]
    found, owner = [], []
    for salt, h in ((1, word), (2, shape)):
        pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(salt + 2))[follows]
        found += [mix(h + np.uint64(salt)), pair]
        owner += [rows, rows[1:][follows]]
    again = follows & (word[1:] == word[:-1])  # a pair of one word twice, whichever word it is
    found.append(np.full(int(again.sum()), mix(np.array([5], np.uint64))[0], np.uint64))
    owner.append(rows[1:][again])
    return (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(owner)


def fit(examples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights (McMahan et al., 2013); the last one is the bias."""
    z, n, w = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(epochs):
        for index, value, label in examples:
            wi = w[index]
            p = 1.0 / (1.0 + np.exp(-np.clip(wi @ value, -30, 30)))
            g = (p - label) * value
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - sigma * wi
            n[index] += g * g
            zi = z[index]
            l1 = np.where(index == BUCKETS, 0.0, L1)
            w[index] = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[index])) / ALPHA + L2))
    return w


def example(text: bytes | None, label: float) -> tuple[np.ndarray, np.ndarray, float]:
    features, _ = _ngrams([text], 0, 1)
    index, count = np.unique(features, return_counts=True)
    value = SCALE * count / max(1, len(features))
    return np.append(index, BUCKETS).astype(np.int32), np.append(value, 1.0).astype(np.float32), label


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> np.ndarray | None:
    """Weights from the labelled rows whose ids are not held out; None if there are none."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("id")))
    chosen = usable.groupBy("id").agg(F.avg("y").alias("y"))
    total = chosen.count()
    if not total:
        return None
    place = F.pmod(F.xxhash64(F.lit("quality"), F.col("id")), F.lit(1 << 30))
    chosen = chosen.where(place < int((1 << 30) * min(1.0, sample / total)))  # about ``sample`` rows, so the broadcast is bounded
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = own.join(F.broadcast(chosen), "id").select("id", "text", "y", place.alias("place"))

    def one_task(batches):
        seen, examples = set(), []
        for batch in batches:
            for i, text, y, place in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if i not in seen:
                    seen.add(i)
                    examples.append((place, i, *example(text, y)))
        examples.sort(key=lambda x: x[:2])
        w = fit([x[2:] for x in examples])
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes() if examples else None], pa.binary())], ["w"])

    row = rows.repartition(1).mapInArrow(settled(one_task), "w binary").where("w IS NOT NULL").first()
    return np.frombuffer(row["w"], np.float32) if row else None


def scores(values: list[bytes | None], w: np.ndarray | None) -> np.ndarray:
    """The scores of texts; a text longer than a step is one alone."""
    out = np.full(len(values), 0.5)
    for begin, end in steps(values) if w is not None else ():
        features, rows = _ngrams(values, begin, end)
        sums = np.bincount(rows, w[features].astype(np.float64), minlength=end - begin)
        counts = np.bincount(rows, minlength=end - begin)
        out[begin:end] = 1.0 / (1.0 + np.exp(-np.clip(float(w[BUCKETS]) + SCALE * sums / np.maximum(1, counts), -30, 30)))
    return out


def score(docs: DataFrame, weights: np.ndarray | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(texts(batch.column(1)), shared.value))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(settled(scan), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE, label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    scored = score(docs, train(docs, labels, sample=sample, label_col=label_col))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; every row is judged by its own text, whatever its id."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample))
    return kept_rows(docs, text_col, lambda values: scores(values, shared.value) >= threshold)


def op6_quality_model(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
