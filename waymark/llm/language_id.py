"""Language identification with language-bitmask n-gram filters.

Character n-grams (of UTF-8 bytes, letters A-Z in lower case) seen in a language's training texts go into
that language's Bloom filter. All filters have the same hash functions and are stored bit-sliced: slot i holds
one machine word whose bit l is slot i of language l's filter. So the AND of the slots of an n-gram gives the
languages that contain it at once. A text's votes for a language are the popcount of its bit over the n-grams,
less what false positives give: with h of n n-grams found and a filter that answers yes by chance with
rate f, (h - n f) / (1 - f) remain. The language with most left is predicted; the score is its lead.

An n-gram enters a filter if it makes up more than ``MIN_SHARE`` of the language's n-grams in training, so quotations
and stray words of other languages do not fill it. The filters are fitted on a bounded sample: of the rows that may be
learned from, about ``SAMPLE``, those with the smallest hashes of their ids. N-gram counts are summed
per language by Spark before one task builds the filters.

Defined results: null texts and texts without a letter are ``und`` with score 0, as are all without any
learned language; ties (so texts whose n-grams no language has) go to the language with most training rows, then by name; repeated training rows count once each; rows with
a null id are held out; rows with a null language teach nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import LOWER, held_out, joined, mix, read, settled, steps, texts

NGRAM = 4
SLOT_BITS = 18
HASHES = 2
SAMPLE = 6000
MIN_SHARE = 2e-6
LANES = 64
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "ignore")))


def _grams(values: list[bytes | None], begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams inside the texts of a step, and each one's row."""
    buf, row_ends = joined(values, begin, end)
    low = np.concatenate([np.full(1, 32, np.uint8), LOWER[buf]])  # so the first word, too, has a border before it
    low[low < 65] = 32  # marks, digits and white space all end a word
    n = len(low) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = np.zeros(n, np.uint32)
    for j in range(NGRAM):
        code = (code << np.uint32(8)) | low[j : j + n]
    inner = (low[1 : n + 1] != 32) & (low[2 : n + 2] != 32)  # at most a border at either side
    at = np.flatnonzero(inner)
    rows = np.searchsorted(row_ends, at, "right")
    whole = at + NGRAM - 1 <= row_ends[rows]
    return code[at[whole]], rows[whole]


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    h = mix(codes.astype(np.uint64) + np.uint64(0x51ED270B))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """Bit-sliced Bloom filters of up to any number of languages, 64 to a slice."""

    def __init__(self, members: dict[str, np.ndarray], sizes: dict[str, int]):
        self.languages = sorted(members, key=lambda x: (-sizes[x], x))
        kind = np.uint8 if len(self.languages) <= 8 else np.uint64
        width = np.dtype(kind).itemsize * 8
        self.slices = [np.zeros(1 << SLOT_BITS, kind) for _ in range(-(-len(self.languages) // width))]
        self.width = width
        self.chance = np.zeros(len(self.languages))
        for number, language in enumerate(self.languages):
            table, bit = self.slices[number // width], kind(1 << (number % width))
            for slots in _slots(members[language]):
                table[slots] |= bit
            self.chance[number] = np.count_nonzero(table & bit) / (1 << SLOT_BITS)
        self.chance = self.chance**HASHES

    def votes(self, codes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        """Corrected popcounts, a row for each text."""
        total = np.bincount(rows, minlength=n_rows).astype(np.float64)
        out = np.zeros((n_rows, len(self.languages)))
        slots = _slots(codes)
        for s, table in enumerate(self.slices):
            masks = table[slots[0]]
            for more in slots[1:]:
                masks = masks & table[more]
            for bit in range(min(self.width, len(self.languages) - s * self.width)):
                number = s * self.width + bit
                hits = np.bincount(rows[(masks >> masks.dtype.type(bit)) & masks.dtype.type(1) != 0], minlength=n_rows)
                out[:, number] = (hits - total * self.chance[number]) / max(1e-9, 1 - self.chance[number])
        return np.maximum(out, 0)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Filters:
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["lang"]: r["n"] for r in usable.select("lang").groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return Filters({}, {})
    share = F.lit(0.0)
    for lang, n in sizes.items():  # as many of each language, as far as there are
        share = F.when(F.col("lang") == lang, min(1.0, sample / len(sizes) / n)).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("language"), F.col("id")), F.lit(1 << 30))
    chosen = usable.where(place < (F.lit(1 << 30) * share).cast("long")).select("lang", "text")

    def count(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs, values = np.array(batch.column(0).to_pylist(), object), texts(batch.column(1))
            for begin, end in steps(values):
                codes, rows = _grams(values, begin, end)
                for lang in set(langs[begin:end]):
                    part, n = np.unique(codes[(langs[begin:end] == lang)[rows]], return_counts=True)
                    if lang in sums:
                        part, inverse = np.unique(np.concatenate([sums[lang][0], part]), return_inverse=True)
                        n = np.bincount(inverse, np.concatenate([sums[lang][1], n])).astype(np.int64)
                    sums[lang] = part, n
        for lang, (codes, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    grams = chosen.mapInArrow(settled(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    total = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = grams.join(F.broadcast(total), "lang").where(F.col("n") > F.greatest(F.lit(1), F.col("total") * MIN_SHARE))  # one row a language is broadcast
    # the share alone bounds a language's members by 1 / MIN_SHARE
    found: dict[str, list[int]] = {lang: [] for lang in sizes}
    for row in kept.select("lang", "code").toLocalIterator():
        found[row["lang"]].append(row["code"])
    return Filters({lang: np.array(codes, np.int64) for lang, codes in found.items()}, sizes)


def predict(docs: DataFrame, filters: Filters, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; score is the winner's lead over the second as a share of its votes."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def scan(batches):
        known = shared.value
        for batch in batches:
            values = texts(batch.column(1))
            names, scores = [], []
            for begin, end in steps(values):
                letters = [has_letter(v) for v in values[begin:end]]
                if not known.languages:
                    names += ["und"] * len(letters)
                    scores += [0.0] * len(letters)
                    continue
                votes = known.votes(*_grams(values, begin, end), end - begin)
                best = votes.argmax(1)
                ranked = np.sort(votes, 1)
                first = ranked[:, -1]
                lead = np.where(first > 0, (first - (ranked[:, -2] if votes.shape[1] > 1 else 0)) / np.maximum(first, 1e-9), 0.0)
                names += [known.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters, strict=True)]
                scores += [min(1.0, max(0.0, x)) if ok else 0.0 for x, ok in zip(lead.tolist(), letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(settled(scan), "doc_id long, lang_pred string, score double")


def op10_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
