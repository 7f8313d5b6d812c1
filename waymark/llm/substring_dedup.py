"""Substring deduplication on a compacted de Bruijn graph of token k-mers.

An edge of the graph is a k-mer of words (13 of them); its two 12-word ends are the nodes. Only edges that occur more than once matter:

1. ``chunks``: the texts, words joined by single blanks, compressed, in a staged table of bounded chunks, dealt by chunk once, so that
   the joins of steps 3 and 6 do not move it again.
2. ``shared_edges``: every chunk sends its distinct edges, shortened to about log2(edges) + 13 bits and delta-coded, to buckets; a
   bucket tells each chunk which of them other chunks have, too. Short keys let about one edge in ten thousand pass that is not
   repeated; it does no harm later.
3. ``walks``: each chunk cuts its documents to maximal walks along repeated edges. Equal walks are told by a 128-bit digest of
   their words, leave a chunk once with all their source coordinates (document, word), and contract to one over all chunks.
4. ``joints``: the in- and out-edges of every node are counted over all distinct walks, the begin or end of a walk as one more edge.
   A node with one in-edge and one out-edge is nonbranching; all others are joints.
5. ``compaction``: Spark joins bring each walk its joints, and it falls apart into unitigs: paths through nonbranching nodes that every
   walk either follows from end to end or does not touch. Unitigs are joined by a 128-bit digest of their words, and the smallest
   document through a unitig is the first of all its edges.
6. ``cut``: of a document with an equal walk in a smaller document the whole walk goes, of the smallest one those
   unitigs that an even smaller document has; the source coordinates bring the spans back to the chunks.

Hashes of 64 bits only choose candidates and joints. Two nodes of one hash give a joint too many, which cuts all walks alike and changes nothing;
two edges of one hash at one node would hide a joint, with a chance of 2**-64 a node. What is removed was equal in 128 bits.

Defined results: null, empty and blank texts have no words; rows with a null id are neither sources nor cut; repeated rows have
equal ids and so do not cut each other; texts of fewer than 13 words stay whole; a very long text is a chunk alone; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Staged, mix, read, release, settled, texts, word_hashes, word_runs

WINDOW = 13
CHUNK_BYTES = 1 << 20
BUCKET_EDGES = 2 << 20
#: A word takes at least about so many bytes with the blank after it; sizes buckets only.
WORD_BYTES = 5
#: Shares into which rows of one joint or one unitig are split, so that a very common passage does not end in one task.
SALTS = 8
#: Bytes of output after which a batch is sent on.
FLUSH_BYTES = 1 << 21

_M = np.uint64(0x9DDFEA08EB382D69)
_BLANKS = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))


def _squeeze(raw: bytes) -> bytes:
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) > 128 else b"\0" + raw


def _unsqueeze(raw: bytes, size: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw[1:], max_output_size=max(1, size)) if raw[:1] == b"\1" else raw[1:]


def normal(text: bytes | None) -> bytes:
    """The words of a text joined by one blank each."""
    text = (text or b"").translate(_BLANKS)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.strip(b" ")


def chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, size, doc_ids, blob): a line of words for each document."""
    schema = pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("blob", pa.binary())])

    def scan(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        names, held, size = [], [], 0

        def out():
            lines = b"\n".join(held) + b"\n"
            return pa.RecordBatch.from_pylist([{"chunk": number, "size": len(lines), "doc_ids": names, "blob": _squeeze(lines)}], schema=schema)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                text = normal(text)
                if held and size + len(text) > chunk_bytes:
                    yield out()
                    number, names, held, size = number + 1, [], [], 0
                names.append(name)
                held.append(text)
                size += len(text) + 1
        if held:
            yield out()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(settled(scan), "chunk long, size long, doc_ids array<long>, blob binary")


def _rows(batches, *columns: str):
    """The rows of batches one at a time, so that a batch of many chunks is never held as Python objects."""
    for batch in batches:
        own = [batch.column(c) for c in columns]
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in own]


class Lines:
    """Words and k-mers of some lines of words."""

    def __init__(self, raw: bytes):
        self.buf = np.frombuffer(raw, np.uint8)
        self.starts, self.ends = word_runs(self.buf)
        line_ends = np.flatnonzero(self.buf == 10)
        self.row = np.searchsorted(line_ends, self.starts)
        self.first = np.searchsorted(self.row, np.arange(len(line_ends) + 1))  # first word of each line

    def hashes(self) -> np.ndarray:
        return word_hashes(self.buf, self.starts, self.ends)

    def grams(self, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word at which each k-mer starts, its hash); none crosses lines."""
        n = len(word) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h *= _M
            h += word[j : j + n]
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return at, mix(h[at])

    def slice(self, a: int, b: int) -> memoryview:
        """The bytes of words a to b of one line."""
        return self.buf[self.starts[a] : self.ends[b - 1]].data


class Keys:
    """How edges shorten to keys and go to buckets."""

    def __init__(self, total_bytes: int):
        edges = max(1, total_bytes // WORD_BYTES)
        self.bucket_bits = max(3, (edges // BUCKET_EDGES).bit_length())
        self.bits = min(62, max(40, edges.bit_length() + 13))

    def short(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def split(self, keys: np.ndarray):
        """(bucket, from, to) of the runs of sorted keys."""
        bucket = (keys >> np.uint64(self.bits - self.bucket_bits)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(bucket[a]), a, b


def _delta(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    top = int(np.flatnonzero(planes.any(0)).max(initial=0)) + 1
    return bytes([top]) + _squeeze(np.ascontiguousarray(planes[:, :top].T).tobytes())


def _undelta(raw: bytes, n: int) -> np.ndarray:
    top = raw[0]
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :top] = np.frombuffer(_unsqueeze(raw[1:], n * top), np.uint8).reshape(top, n).T
    return np.cumsum(planes.reshape(-1).view("<u8").astype(np.uint64), dtype=np.uint64)


def shared_edges(stored: DataFrame, keys: Keys, window: int) -> DataFrame:
    """(chunk, [(bucket, flags)]): for each chunk's sorted distinct keys of a bucket, whether another chunk has them."""

    def send(batches):
        for chunk, size, blob in _rows(batches, "chunk", "size", "blob"):
            lines = Lines(_unsqueeze(blob, size))
            own = np.unique(keys.short(lines.grams(lines.hashes(), window)[1]))
            parts = [(bucket, b - a, _delta(own[a:b])) for bucket, a, b in keys.split(own)]
            if parts:
                bucket, n, raw = zip(*parts, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([chunk] * len(bucket), pa.int64()), pa.array(n, pa.int32()), pa.array(raw, pa.binary())], ["bucket", "chunk", "n", "raw"])

    def meet(table: pa.Table) -> pa.Table:
        names, sizes, bucket = table.column("chunk").to_pylist(), table.column("n").to_pylist(), table.column("bucket")[0].as_py()
        ends = np.cumsum(sizes)
        every = np.empty(int(ends[-1]), np.uint64)
        for raw, n, end in zip(table.column("raw"), sizes, ends.tolist(), strict=True):
            every[end - n : end] = _undelta(raw.as_py(), n)
        order = np.argsort(every)
        ranked = every[order]
        del every
        same = ranked[1:] == ranked[:-1]
        del ranked
        flags = np.zeros(len(order), bool)
        flags[order[1:][same]] = True
        flags[order[:-1][same]] = True
        del order
        told = [(name, _squeeze(np.packbits(flags[end - n : end]).tobytes())) for name, n, end in zip(names, sizes, ends.tolist(), strict=True) if flags[end - n : end].any()]
        release()
        return pa.table({"chunk": pa.array([x for x, _ in told], pa.int64()), "bucket": pa.array([bucket] * len(told), pa.int32()), "flags": pa.array([x for _, x in told], pa.binary())})

    sent = stored.select("chunk", "size", "blob").mapInArrow(settled(send), "bucket int, chunk long, n int, raw binary")
    told = sent.groupBy("bucket").applyInArrow(meet, "chunk long, bucket int, flags binary")
    return told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "flags")).alias("told"))


WALK = "path binary, chunk long, n int, least long, places array<struct<doc:int,doc_id:long,start:int>>, words binary"
_WALK = pa.schema([("path", pa.binary()), ("chunk", pa.int64()), ("n", pa.int32()), ("least", pa.int64()), ("places", pa.list_(pa.struct([("doc", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int32())]))), ("words", pa.binary())])


def walks(stored: DataFrame, told: DataFrame, keys: Keys, window: int) -> DataFrame:
    """Maximal walks along repeated edges; one row for each chunk and distinct walk, with its words and all its places."""

    def scan(batches):
        for chunk, size, doc_ids, blob, told in _rows(batches, "chunk", "size", "doc_ids", "blob", "told"):
            lines = Lines(_unsqueeze(blob, size))
            at, h = lines.grams(lines.hashes(), window)
            if not len(at):
                continue
            own, inverse, count = np.unique(keys.short(h), return_inverse=True, return_counts=True)
            del h
            flags = count > 1  # met again in this chunk, or told by a bucket
            bits = {t["bucket"]: t["flags"] for t in told or []}
            for bucket, a, b in keys.split(own):
                if bucket in bits:
                    raw = _unsqueeze(bits[bucket], (b - a + 7) // 8)
                    flags[a:b] |= np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a).astype(bool)
            here = at[flags[inverse]]
            if not len(here):
                continue
            # a walk ends where the next edge is not repeated, does not start at the next word or is another document's
            docs = lines.row[here]
            cut = np.flatnonzero((np.diff(here) != 1) | (np.diff(docs) != 0)) + 1
            begins, stops = np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(here)]]).tolist()
            found: dict[bytes, list] = {}
            for a, b in zip(begins, stops, strict=True):
                doc, word = int(docs[a]), int(here[a])
                if doc_ids[doc] is not None:
                    path = xxhash.xxh3_128_digest(lines.slice(word, word + b - a + window - 1))
                    found.setdefault(path, []).append((doc, doc_ids[doc], word - int(lines.first[doc]), b - a, word))
            rows, held = [], 0
            for path, places in found.items():
                _, _, _, n, word = places[0]
                words = bytes(lines.slice(word, word + n + window - 1))
                rows.append({"path": path, "chunk": chunk, "n": n, "least": min(p[1] for p in places), "places": [{"doc": p[0], "doc_id": p[1], "start": p[2]} for p in places], "words": words})
                held += len(words) + 32 * len(places)
                if held > FLUSH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_WALK)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_WALK)

    return stored.select("chunk", "size", "doc_ids", "blob").join(told, "chunk", "left").mapInArrow(settled(scan), WALK)


def _groups(batches, *columns: str):
    """Rows of walks, in groups of about ``FLUSH_BYTES`` of words; ``columns`` end with the words."""
    rows, held = [], 0
    for row in _rows(batches, *columns):
        rows.append(row)
        held += len(row[-1])
        if held > FLUSH_BYTES:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _lines_of(rows: list) -> Lines:
    return Lines(b"\n".join(r[-1] for r in rows) + b"\n")


def joints(paths: DataFrame, window: int) -> DataFrame:
    """(node): the nodes that do not have exactly one in-edge and one out-edge."""

    def degrees(batches):
        for rows in _groups(batches, "words"):
            lines = _lines_of(rows)
            word = lines.hashes()
            at, node = lines.grams(word, window - 1)
            _, edge = lines.grams(word, window)
            # a line of n edges has n + 1 nodes: an edge goes out of all but the last and into all but the first
            row = lines.row[at]
            last = np.concatenate([row[1:] != row[:-1], [True]])
            goes, came = np.zeros(len(node), np.uint64), np.zeros(len(node), np.uint64)
            goes[~last] = edge
            came[1:][~last[:-1]] = edge
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (node, came, goes)], ["node", "came", "goes"])

    ends = paths.select("words").mapInArrow(settled(degrees), "node long, came long, goes long")
    met = ends.groupBy("node").agg(F.min("came").alias("c"), F.max("came").alias("d"), F.min("goes").alias("g"), F.max("goes").alias("h"))
    return met.where("c < d OR g < h").select("node")


def _salt(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def unitigs(paths: DataFrame, joints: DataFrame, window: int) -> DataFrame:
    """(path, owner, unitig, start, n): the walks cut at their joints; a unitig is the digest of its words."""

    def inner(batches):
        for rows in _groups(batches, "path", "words"):
            lines = _lines_of(rows)
            at, node = lines.grams(lines.hashes(), window - 1)
            row = lines.row[at]
            middle = np.flatnonzero((row[1:-1] == row[:-2]) & (row[1:-1] == row[2:])) + 1
            row, place = row[middle], (at[middle] - lines.first[row[middle]]).astype(np.int32)
            names = pa.array([r[0] for r in rows], pa.binary())
            for a in range(0, len(middle), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(node[middle[part]].view(np.int64)), names.take(pa.array(row[part])), pa.array(place[part])], ["node", "path", "place"])

    nodes = paths.select("path", "words").mapInArrow(settled(inner), "node long, path binary, place int").withColumn("salt", _salt("path"))
    spread = joints.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cuts = nodes.join(spread, ["node", "salt"]).groupBy("path").agg(F.collect_list("place").alias("cuts"))

    def split(batches):
        for rows in _groups(batches, "path", "owner", "cuts", "words"):
            lines = _lines_of(rows)
            out = []
            for i, (path, owner, places, _) in enumerate(rows):
                first = int(lines.first[i])
                n = int(lines.first[i + 1]) - first - window + 1
                edges = [0, *sorted(set(places or ())), n]
                out += [(path, owner, path if b - a == n else xxhash.xxh3_128_digest(lines.slice(first + a, first + b + window - 1)), a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
            for a in range(0, len(out), 1 << 14):
                columns = zip(*out[a : a + (1 << 14)], strict=True)
                kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "owner", "unitig", "start", "n"])

    return paths.join(cuts, "path", "left").select("path", "owner", "cuts", "words").mapInArrow(settled(split), "path binary, owner long, unitig binary, start int, n int")


def earlier(pieces: DataFrame) -> DataFrame:
    """(path, earlier): the unitigs of each walk that pass through a smaller document than its own smallest.

    The least document is taken per share of a unitig, then per unitig, and goes back the same way."""
    salted = pieces.withColumn("salt", _salt("path"))
    shares = salted.groupBy("unitig", "salt").agg(F.min("owner").alias("low"), F.max("owner").alias("high"))
    first = shares.groupBy("unitig").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").select("unitig", "first")
    told = shares.join(first, "unitig").where("first < high").select("unitig", "salt", "first")
    return salted.join(told, ["unitig", "salt"]).where("first < owner").groupBy("path").agg(F.collect_list(F.struct("start", "n")).alias("earlier"))


def compact(walk: DataFrame, staged: Staged, window: int) -> DataFrame:
    """(path, owner, earlier) of every distinct walk."""
    whole = walk.groupBy("path").agg(F.min("least").alias("owner"), F.first("words", ignorenulls=True).alias("words"))
    paths = staged.put(whole, "paths")
    branching = staged.put(joints(paths, window), "joints")
    pieces = staged.put(unitigs(paths, branching, window), "unitigs")
    return paths.select("path", "owner").join(earlier(pieces), "path", "left")


def removals(walk: DataFrame, compacted: DataFrame) -> DataFrame:
    """(chunk, cuts): the spans of edges to remove, by document of the chunk."""
    met = walk.drop("words").join(compacted, "path")
    spans = F.transform("places", lambda p: F.struct(p["doc"].alias("doc"), p["start"].alias("start"), F.when(p["doc_id"] > F.col("owner"), F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("n")))).otherwise(F.col("earlier")).alias("spans")))
    hit = F.filter(spans, lambda s: s["spans"].isNotNull())
    return met.select("chunk", F.explode(hit).alias("cut")).groupBy("chunk").agg(F.collect_list("cut").alias("cuts"))


OUT = "doc_id long, n_words long, n_removed long, kept binary, removed array<struct<start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def cut(stored: DataFrame, cuts: DataFrame, window: int) -> DataFrame:
    """Every document's kept words, joined by blanks, and the spans of removed words."""

    def scan(batches):
        for size, doc_ids, blob, own_cuts in _rows(batches, "size", "doc_ids", "blob", "cuts"):
            lines = Lines(_unsqueeze(blob, size))
            delta = np.zeros(len(lines.starts) + window + 1, np.int32)
            for c in own_cuts or []:
                begin = int(lines.first[c["doc"]]) + c["start"]
                for s in c["spans"]:
                    delta[begin + s["start"]] += 1
                    delta[begin + s["start"] + s["n"] + window - 1] -= 1
            gone = np.cumsum(delta)[: len(lines.starts)] > 0
            out, held = [], 0
            for i, name in enumerate(doc_ids):
                a, b = int(lines.first[i]), int(lines.first[i + 1])
                edges = np.flatnonzero(np.diff(gone[a:b], prepend=False, append=False)).tolist()
                removed = list(zip(edges[0::2], edges[1::2], strict=True))
                stay = [(x, y) for x, y in zip([0, *edges[1::2]], [*edges[0::2], b - a], strict=True) if y > x]
                kept = b" ".join([bytes(lines.slice(a + x, a + y)) for x, y in stay])
                out.append((name, b - a, sum(y - x for x, y in removed), kept, [{"start": x, "stop": y} for x, y in removed]))
                held += len(kept) + 64
                if held > FLUSH_BYTES or i == len(doc_ids) - 1:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), _SPANS]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept", "removed"])
                    out, held = [], 0

    return stored.select("chunk", "size", "doc_ids", "blob").join(cuts, "chunk", "left").mapInArrow(settled(scan), OUT)


def deduplicate(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed) of every row."""
    staged = Staged(docs.sparkSession)
    stored = staged.put_bucketed(chunks(docs, id_col, text_col, chunk_bytes), "chunks", "chunk")
    total = stored.agg(F.sum("size")).first()[0] or 0
    keys = Keys(total)
    told = shared_edges(stored, keys, window)
    walk = staged.put(walks(stored, told, keys, window), "walks")
    return cut(stored, removals(walk, compact(walk, staged, window)), window)


def op9_substring_dedup(spark, sf_dir):
    found = deduplicate(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM g) WHERE m < doc_id),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM f),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM w),
k AS (SELECT p.doc_id, string_agg(p.x, ' ' ORDER BY p.j) AS s FROM p ANTI JOIN r ON p.doc_id = r.doc_id AND p.j = r.j GROUP BY p.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id LEFT JOIN c ON w.doc_id = c.doc_id
"""
