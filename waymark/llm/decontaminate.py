"""Benchmark decontamination with suffix arrays of the training shards.

Every training shard (some rows of a partition, about ``SHARD_BYTES`` of text) gets a suffix array over its words: the places sorted by
all words that follow them, first by the words of a window, then by doubling. Every suffix of every benchmark item is looked up in it by
binary search. The places that share a window's words are its verbatim occurrences; the neighbours of the whole suffix give its longest
verbatim match and where it is. One narrow pass, no shuffle of texts: a lost task is just run again.

The suffix array leaves out places that no match can pass: words that no item has end a suffix, and runs of fewer words than the
shortest window are left out.

The benchmark comes in blocks of at most ``BLOCK_BYTES`` of text; a worker holds one block at a time, and every block meets every shard.

Defined results: null or empty text has no words and no hits; null item texts and items
without words match nothing; repeated rows are judged one by one, rows without an id like others; texts of any length are read whole (a longer one than
a shard is a shard alone); an empty benchmark leaves all documents clean; an empty table gives no rows; columns other than the id and the text are ignored, and
``drop_contaminated`` keeps them.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import kept_rows, settled, steps, texts

WINDOW = 10
SHARD_BYTES = 4 << 20
#: A block of the benchmark is broadcast alone, so its size has this bound (one longer item excepted).
BLOCK_BYTES = 4 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_ID_BYTES = 4

SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,stop:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall(text.lower()) if text else []


def _keys(matrix: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like the rows."""
    big = np.ascontiguousarray(matrix.astype(">u4"))
    return big.view(f"S{_ID_BYTES * matrix.shape[1]}").reshape(-1)


def _windows(ids: np.ndarray, at: np.ndarray, room: np.ndarray, window: int, fill: int = 0) -> np.ndarray:
    """Keys of the ``window`` words from each place on, ``fill`` beyond its ``room``."""
    padded = np.concatenate([ids, np.zeros(window, ids.dtype)])
    rows = padded[at[:, None] + np.arange(window)]
    rows[np.arange(window) >= room[:, None]] = fill
    return _keys(rows)


class TestSuffixes:
    """A block of items: the word numbers of all, and the distinct windows that their suffixes start with."""

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        number = self.vocabulary.setdefault
        sizes = np.array([len(w) for _, w in items], np.int64)
        self.items = [item for item, _ in items]
        self.ids = np.array([i for _, words in items for i in (*(number(w, len(self.vocabulary) + 1) for w in words), 0)], np.uint32)
        begin = np.cumsum(sizes + 1) - sizes - 1
        #: Places in ``ids`` at which a window starts: a shorter item is one window.
        self.at = np.concatenate([np.arange(b, b + max(1, n - window + 1)) for b, n in zip(begin.tolist(), sizes.tolist(), strict=True) if n] or [np.zeros(0, np.int64)]).astype(np.int64)
        owner = np.searchsorted(begin, self.at, "right") - 1
        self.room = (begin + sizes)[owner] - self.at  # words up to the end of the item
        keys = _windows(self.ids, self.at, self.room, window)
        self.low, first, self.which = np.unique(keys, return_index=True, return_inverse=True)
        self.lengths = np.minimum(self.room[first], window)
        self.high = _windows(self.ids, self.at[first], self.room[first], window, 0xFFFFFFFF)
        self.high[self.lengths == window] = self.low[self.lengths == window]
        self.least = int(self.lengths.min()) if len(self.at) else 0
        pairs = np.unique(np.stack([self.which, owner]), axis=1) if len(self.at) else np.zeros((2, 0), np.int64)
        self.owner, self._pair_items = owner, pairs[1]
        self._pair_begin = np.searchsorted(pairs[0], np.arange(len(self.low) + 1))

    def owners(self, window: int) -> list[str]:
        return [self.items[i] for i in self._pair_items[self._pair_begin[window] : self._pair_begin[window + 1]].tolist()]

    def numbers(self, rows: list[list[bytes]], sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The words of a shard as numbers, 0 for foreign ones and after each row."""
        ids, number = np.zeros(offsets[-1], np.uint32), self.vocabulary.get
        for row, at, n in zip(rows, offsets.tolist(), sizes.tolist(), strict=False):
            ids[at : at + n] = np.fromiter((number(w, 0) for w in row), np.uint32, n)
        return ids


class ShardSuffixes:
    """The suffix array of a shard: ``order`` has the places, sorted by the words from each up to the next 0."""

    def __init__(self, ids: np.ndarray, window: int, least: int):
        self.ids, self.window = ids, window
        known = np.concatenate([[False], ids > 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        begins, stops = edges[0::2], edges[1::2]
        long = stops - begins >= max(1, least)
        begins, stops = begins[long], stops[long]
        sizes = stops - begins
        before = np.cumsum(sizes) - sizes
        self.place = np.arange(int(sizes.sum())) + np.repeat(begins - before, sizes)
        self.run = np.repeat(stops, sizes) - self.place  # words up to the next 0
        keys = _windows(ids, self.place, self.run, window) if len(self.place) else np.zeros(0, "S1")
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self._refine()

    def _refine(self) -> None:
        """Sorts ties of the first ``window`` words by what follows, doubling the words compared each time."""
        n, size = len(self.place), self.window
        fresh = np.concatenate([[True], self.keys[1:] != self.keys[:-1]]) if n else np.zeros(0, bool)
        while not fresh.all():
            rank = np.empty(n, np.int64)
            rank[self.order] = np.cumsum(fresh)
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            if self.run[self.order[tied]].max() <= size:
                break
            later = np.zeros(n, np.int64)  # a run's places are neighbours, so the one ``size`` words on is ``size`` places on
            on = np.flatnonzero(self.run > size)
            later[on] = rank[on + size]
            both = rank * (n + 1) + later
            self.order = np.argsort(both, kind="stable")
            ranked = both[self.order]
            fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            size *= 2

    def occurrences(self, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct window found: its number and the range of the suffix array that starts with it."""
        left = np.searchsorted(self.keys, test.low, "left")
        right = np.searchsorted(self.keys, test.high, "right")
        found = np.flatnonzero(right > left)
        return found, left[found], right[found]

    def places(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of some ranges, and the number of the range that each is from."""
        counts = right - left
        which = np.repeat(np.arange(len(left)), counts)
        at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(left, counts)
        return self.place[self.order[at]], which

    def longest(self, suffix: np.ndarray, left: int, right: int) -> tuple[int, np.ndarray]:
        """(words, places) of the longest match of ``suffix`` among the suffixes in a range: by binary search, at its neighbours."""
        big = suffix.astype(">u4")
        key = lambda i: self._words(i).astype(">u4").tobytes()
        at = bisect_left(range(left, right), big.tobytes(), key=key) + left
        size = max(self._common(big, i) for i in (at - 1, at) if left <= i < right)
        prefix = big[:size].tobytes()
        first = bisect_left(range(left, right), prefix, key=key) + left
        last = bisect_left(range(first, right), True, key=lambda i: key(i)[: len(prefix)] > prefix) + first
        return size, self.place[self.order[first:last]]

    def _words(self, i: int) -> np.ndarray:
        p = self.order[i]
        return self.ids[self.place[p] : self.place[p] + self.run[p]]

    def _common(self, suffix: np.ndarray, i: int) -> int:
        own = self._words(i)
        n = min(len(own), len(suffix))
        differ = np.flatnonzero(own[:n] != suffix[:n])
        return int(differ[0]) if len(differ) else n


def _value(block) -> TestSuffixes:
    """A broadcast block; where a worker can read it again from its file, it does not keep it."""
    value = block.value
    if getattr(block, "_path", None):
        block.__dict__.pop("_value", None)
    return value


class Shard:
    """The words of some texts, and where each text's begin."""

    def __init__(self, values: list[bytes | None]):
        self.rows = [words_of(v) for v in values]
        self.sizes = np.fromiter(map(len, self.rows), np.int64, len(self.rows))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes + 1)])

    def against(self, test: TestSuffixes) -> ShardSuffixes:
        return ShardSuffixes(test.numbers(self.rows, self.sizes, self.offsets), test.window, test.least)

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int, item_col: str, text_col: str):
    """Blocks of at most ``block_bytes`` of item text, streamed by the driver one by one."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull())
    for row in rows.toLocalIterator():
        words = words_of(row["text"].encode())
        if not words:
            continue
        if block and size + len(row["text"]) > block_bytes:
            yield TestSuffixes(block, window)
            block, size = [], 0
        block.append((row["item"], words))
        size += len(row["text"])
    if block:
        yield TestSuffixes(block, window)


class Benchmark:
    """The blocks of a benchmark, broadcast one by one."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id", text_col: str = "text"):
        sc = benchmark.sparkSession.sparkContext
        self.blocks = [sc.broadcast(b) for b in benchmark_blocks(benchmark, window, block_bytes, item_col, text_col)]

    def reader(self):
        """The blocks for a task: a single one stays, of several each is read anew for every shard."""
        only = self.blocks[0].value if len(self.blocks) == 1 else None
        return lambda: [only] if only is not None else map(_value, self.blocks)


def hits(shard: Shard, blocks) -> tuple[np.ndarray, dict[int, set[str]]]:
    """(whether each place is inside a window, item ids by row)."""
    delta = np.zeros(shard.offsets[-1] + 1, np.int64)
    items: dict[int, set[str]] = {}
    for test in blocks:
        suffixes = shard.against(test)
        found, left, right = suffixes.occurrences(test)
        places, which = suffixes.places(left, right)
        np.add.at(delta, places, 1)
        np.add.at(delta, places + test.lengths[found][which], -1)
        pairs = np.unique(np.stack([shard.row_of(places), found[which]]), axis=1)
        for r, w in pairs.T.tolist():
            items.setdefault(r, set()).update(test.owners(w))
    return np.cumsum(delta)[:-1] > 0, items


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: its words, the words inside benchmark windows, the items found and the covered spans as [start, stop) in words."""
    against = Benchmark(benchmark, window, block_bytes, item_col, item_text_col)

    def scan(batches):
        blocks = against.reader()
        for batch in batches:
            values = texts(batch.column(1))
            out_words, out_hit, out_items, out_spans = [], [], [], []
            for begin, end in steps(values, SHARD_BYTES):
                shard = Shard(values[begin:end])
                covered, items = hits(shard, blocks())
                for r, n in enumerate(shard.sizes.tolist()):
                    own = covered[shard.offsets[r] : shard.offsets[r] + n] if r in items else np.zeros(0, bool)
                    edges = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
                    out_words.append(n)
                    out_hit.append(int(own.sum()))
                    out_items.append(sorted(items.get(r, ())))
                    out_spans.append([{"start": a, "stop": b} for a, b in zip(edges[0::2], edges[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out_words, pa.int64()), pa.array(out_hit, pa.int64()), pa.array(out_items, pa.list_(pa.string())), pa.array(out_spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                ["doc_id", "n_words", "n_hit", "item_ids", "spans"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(settled(scan), SCHEMA)


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, n_words, doc_id, start, item_start) of every item that occurs: its longest verbatim match in the training texts.

    Of equally long ones the one in the smallest document (null ids last), first there, first in the item. Every shard sends one row an item."""
    against = Benchmark(benchmark, window, block_bytes, item_col, item_text_col)
    schema = pa.schema([("item_id", pa.string()), ("n_words", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int32()), ("item_start", pa.int32())])

    def scan(batches):
        blocks = against.reader()
        for batch in batches:
            values, names = texts(batch.column(1)), batch.column(0).to_pylist()
            for begin, end in steps(values, SHARD_BYTES):
                shard, best = Shard(values[begin:end]), {}
                for test in blocks():
                    suffixes = shard.against(test)
                    found, left, right = suffixes.occurrences(test)
                    range_of = dict(zip(found.tolist(), zip(left.tolist(), right.tolist(), strict=True), strict=True))
                    for s in np.flatnonzero(np.isin(test.which, found)).tolist():
                        at, room, item = int(test.at[s]), int(test.room[s]), int(test.owner[s])
                        if room < best.get(test.items[item], (0,))[0] * -1:
                            continue  # too short to be longer
                        n, places = suffixes.longest(test.ids[at : at + room], *range_of[int(test.which[s])])
                        rows = shard.row_of(places)
                        where = min((names[begin + r] is None, names[begin + r] or 0, p - int(shard.offsets[r])) for r, p in zip(rows.tolist(), places.tolist(), strict=True))
                        start = at - int(test.at[np.searchsorted(test.owner, item)])
                        best[test.items[item]] = min(best.get(test.items[item], (1,)), (-n, *where, start))
                rows = [{"item_id": k, "n_words": -n, "doc_id": None if null else doc, "start": p, "item_start": q} for k, (n, null, doc, p, q) in best.items()]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = own.mapInArrow(settled(scan), "item_id string, n_words int, doc_id long, start int, item_start int")
    place = F.struct((-F.col("n_words")).alias("n"), F.col("doc_id").isNull().alias("null_id"), "doc_id", "start", "item_start")
    best = rows.groupBy("item_id").agg(F.min(place).alias("m"))
    return best.select("item_id", (-F.col("m.n")).alias("n_words"), "m.doc_id", "m.start", "m.item_start")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; every row is judged by its own text, whatever its id."""
    against = Benchmark(benchmark, window, block_bytes, item_col, item_text_col)

    def clean(values: list[bytes | None]) -> np.ndarray:
        keep, blocks = np.ones(len(values), bool), against.reader()
        for begin, end in steps(values, SHARD_BYTES):
            _, items = hits(Shard(values[begin:end]), blocks())
            keep[[begin + r for r in items]] = False
        return keep

    return kept_rows(docs, text_col, clean)


def op3_decontaminate(spark, sf_dir):
    from waymark.llm.common import read

    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same rows from plain window equality; a document word i is hit if a window that starts at i - 9 to i is an item's.
OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
