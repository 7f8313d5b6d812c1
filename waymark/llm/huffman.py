"""Token ids as canonical length-limited Huffman code in files of independent blocks.

1. Texts are tokenized once into a staged table, sorted by id within each partition.
2. Ids are counted over the whole table; the driver gets one row per id of the vocabulary, gives each a code length
   of at most ``limit`` bits by package-merge, and the canonical code follows from the lengths alone.
3. If the partitions' ranges of document ids overlap, the table is first dealt by ranges; a table that was written in
   order needs no shuffle. Ranges become numbered shards.
4. Each shard's rows are coded in blocks of whole documents; a document longer than a block is cut into blocks of its own. A block holds its document ids and sizes, its bits,
   and the bit offset of every ``CHECKPOINT``-th id; so it can be decoded alone, and within it all checkpoints side by side,
   a table look-up each step.

Files: ``codes`` has (id, bits) for every id in use; ``blocks/shard=N/whole=true`` has the blocks of whole documents, ``whole=false`` those of
cut ones, each with the number of the document's ids in earlier blocks (``before``). Shards, blocks by their
``first_token`` and the documents in them are in ascending order of document id (null ids first). Both are Parquet, so any store that Spark writes holds them.

Defined results: null and empty texts are their end id; repeated rows follow each other; an empty table gives empty
files and no rows; a long text is coded and decoded block by block; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import Staged, read, settled
from waymark.llm.tokens import tokenize

END_ID = 2
LIMIT = 20
BLOCK_TOKENS = 1 << 16
CHECKPOINT = 128

BLOCK = "first_token long, n_tokens long, width int, before long, doc_ids array<long>, sizes array<long>, bits binary, checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge, Larmore and Hirschberg, 1990)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, marks = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        level = both[place]
        marks.append(place < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(marks):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


@dataclass
class Code:
    """The canonical code of ``symbols`` with ``lengths``: shorter codes first, then by symbol."""

    symbols: np.ndarray
    lengths: np.ndarray

    def __post_init__(self):
        order = np.lexsort((self.symbols, self.lengths))
        self.symbols, self.lengths = self.symbols[order], self.lengths[order]
        self.limit = int(self.lengths.max()) if len(order) else 1
        wide = np.uint64(1) << (self.limit - self.lengths).astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(wide)]).astype(np.uint64)[:-1]  # left-aligned in ``limit`` bits
        self.words = self.first >> (self.limit - self.lengths).astype(np.uint64)

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.symbols.max()) + 1 if len(self.symbols) else 0
        words, lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        words[self.symbols], lengths[self.symbols] = self.words, self.lengths
        return words, lengths

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """For every ``limit``-bit prefix, the symbol that it starts with and its length."""
        times = (1 << (self.limit - self.lengths)).astype(np.int64)
        symbol, length = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.uint8)
        n = int(times.sum())
        symbol[:n], length[:n] = np.repeat(self.symbols, times), np.repeat(self.lengths, times)
        return symbol, length


def encode(ids: np.ndarray, words: np.ndarray, lengths: np.ndarray, checkpoint: int = CHECKPOINT) -> tuple[bytes, bytes]:
    """(bits, checkpoints) of a block; the first bit is the highest of the first byte."""
    size = lengths[ids]
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(ids) else 0
    out = np.zeros(total // 64 + 2, np.uint64)
    cell, room = start >> 6, 64 - (start & 63)
    code = words[ids]
    over = size - room
    fits = over <= 0
    high = np.where(fits, code << np.where(fits, -over, 0).astype(np.uint64), code >> np.where(fits, 0, over).astype(np.uint64))
    if len(ids):
        begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        out[cell[begins]] = np.add.reduceat(high, begins)  # no two codes share a bit
        cut = np.flatnonzero(~fits)  # at most one code crosses into a cell
        out[cell[cut] + 1] += code[cut] << (64 - over[cut]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (total + 7) // 8], start[::checkpoint].astype("<u8").tobytes()


def decode(bits: bytes, checkpoints: bytes, n: int, symbol: np.ndarray, length: np.ndarray, limit: int, checkpoint: int = CHECKPOINT) -> np.ndarray:
    """The ids of a block: one table look-up for each step of all checkpoints at once."""
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
    lanes = len(at)
    raw = np.frombuffer(bits + bytes(16), np.uint8)
    cells = np.frombuffer(raw[: len(raw) // 4 * 4].tobytes(), ">u4").astype(np.uint64)
    out = np.zeros((checkpoint, lanes), np.uint32)
    for step in range(min(checkpoint, n)):
        cell = at >> 5
        cell = np.minimum(cell, len(cells) - 2)  # lanes past the end of the block read what nobody keeps
        window = (cells[cell] << np.uint64(32)) | cells[cell + 1]
        prefix = ((window >> (64 - limit - (at & 31)).astype(np.uint64)) & np.uint64((1 << limit) - 1)).astype(np.int64)
        out[step] = symbol[prefix]
        at = at + length[prefix]
    return out.T.reshape(-1)[:n]


def _count(tokens: DataFrame) -> dict[int, int]:
    """Global counts; one row per id reaches the driver."""

    def partial(batches):
        sums = np.zeros(0, np.int64)
        for batch in batches:
            for width, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(np.frombuffer(raw, f"<u{width}"))
                if len(found) > len(sums):
                    sums = np.concatenate([sums, np.zeros(len(found) - len(sums), np.int64)])
                sums[: len(found)] += found
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(sums[at])], ["id", "n"])

    rows = tokens.select("width", "ids").mapInArrow(settled(partial), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in rows.toLocalIterator()}


def _ranges(tokens: DataFrame) -> list:
    """(part, least, most, tokens) of each partition, null ids before all others, in order; one row a partition."""
    low = F.coalesce(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))), F.lit(0))
    rows = tokens.groupBy("part").agg(low.alias("least"), F.max(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("most"), F.sum("n_tokens").alias("n"))
    return sorted(rows.collect(), key=lambda r: (r["least"], r["most"]))


def _renumbered(tokens: DataFrame) -> DataFrame:
    """Parts and starts as the partitions now are."""

    def scan(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = total + np.cumsum(batch.column("n_tokens").to_numpy())
            starts = ends - batch.column("n_tokens").to_numpy()
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(starts), pa.int32()), pa.array(starts), *batch.columns[2:]], batch.schema.names)

    return tokens.mapInArrow(settled(scan), tokens.schema)


@dataclass
class TokenFiles:
    path: str
    limit: int = LIMIT
    checkpoint: int = CHECKPOINT


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str | None = None, *, end_id: int = END_ID, limit: int = LIMIT, checkpoint: int = CHECKPOINT, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> TokenFiles:
    """Writes the files under ``path`` (by default in the shared folder) and says where they are."""
    spark = docs.sparkSession
    staged = Staged(spark)
    path = path or f"{staged.base}/token-files"
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).sortWithinPartitions("doc_id")
    tokens = staged.put(tokenize(own, tokenizer_path, end_id), "tokens")
    ranges = _ranges(tokens)
    if any(a["most"] > b["least"] for a, b in zip(ranges, ranges[1:], strict=False)):
        tokens = staged.put(_renumbered(tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id")), "sorted")
        staged.drop("tokens")
        ranges = _ranges(tokens)
    counts = _count(tokens)
    symbols = np.array(sorted(counts), np.int64)
    lengths = code_lengths(np.array([counts[s] for s in symbols.tolist()], np.int64), max(limit, len(symbols).bit_length()))
    code = Code(symbols, lengths)
    spark.createDataFrame([(int(s), int(n)) for s, n in zip(code.symbols, code.lengths, strict=True)], "id long, bits int").coalesce(1).write.mode("overwrite").parquet(f"{path}/codes")
    before = np.cumsum([0, *(r["n"] for r in ranges)]).tolist()
    shards = spark.sparkContext.broadcast(({r["part"]: (i, before[i]) for i, r in enumerate(ranges)}, code.encoder()))

    def blocks(batches):
        shard_of, (words, sizes_of) = shards.value

        def block(part: int, start: int, names: list, ids: list[np.ndarray], width: int, before: int = -1):
            """``before``: the document's ids in earlier blocks, -1 for whole documents."""
            shard, first = shard_of[part]
            flat = np.concatenate(ids)
            bits, marks = encode(flat, words, sizes_of, checkpoint)
            row = {"shard": shard, "whole": before < 0, "first_token": first + start, "n_tokens": len(flat), "width": width, "before": max(0, before), "doc_ids": names, "sizes": [len(x) for x in ids], "bits": bits, "checkpoints": marks}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        part, at, names, ids, total, width = None, 0, [], [], 0, 2
        for batch in batches:
            for i in range(batch.num_rows):
                p, start, name, w, raw = (c[i].as_py() for c in batch.columns)
                own = np.frombuffer(raw, f"<u{w}")
                if ids and (p != part or total >= block_tokens or len(own) > block_tokens):
                    yield block(part, at, names, ids, width)
                    names, ids, total = [], [], 0
                if len(own) > block_tokens:
                    for cut in range(0, len(own), block_tokens):
                        yield block(p, start + cut, [name], [own[cut : cut + block_tokens]], w, cut)
                    continue
                if not ids:
                    at = start
                part, width = p, w
                names.append(name)
                ids.append(own)
                total += len(own)
        if ids:
            yield block(part, at, names, ids, width)

    coded = tokens.select("part", "start", "doc_id", "width", "ids").mapInArrow(settled(blocks), f"shard int, whole boolean, {BLOCK}")
    coded.write.mode("overwrite").option("compression", "uncompressed").partitionBy("shard", "whole").parquet(f"{path}/blocks")
    staged.drop("tokens", "sorted")
    return TokenFiles(path, code.limit, checkpoint)


_BLOCK_ARROW = pa.schema([("shard", pa.int32()), ("whole", pa.bool_()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("checkpoints", pa.binary())])


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the files; ids little-endian, 4 bytes each."""
    rows = spark.read.parquet(f"{files.path}/codes").collect()  # one row per id of the vocabulary
    code = Code(np.array([r["id"] for r in rows], np.int64), np.array([r["bits"] for r in rows], np.int64))
    shared = spark.sparkContext.broadcast((code.symbols, code.lengths))

    def scan(batches):
        own = Code(*shared.value)
        symbol, length = own.decoder()
        for batch in batches:
            for i in range(batch.num_rows):
                first, n, before, names, sizes, bits, marks = (c[i].as_py() for c in batch.columns)
                ids = decode(bits, marks, n, symbol, length, own.limit, files.checkpoint).astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - np.array(sizes, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(starts + first - before), pa.array(sizes, pa.int64()), pa.array([before] * len(names), pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "before", "ids"],
                )

    def join(pieces: pa.Table) -> pa.Table:
        own = pieces.sort_by("before")
        whole = b"".join(own.column("ids").to_pylist())
        return pa.table({"doc_id": own.column("doc_id")[:1], "start": own.column("start")[:1], "n_tokens": pa.array([len(whole) // 4], pa.int64()), "ids": pa.array([whole], pa.binary())})

    blocks = spark.read.schema(f"{BLOCK}, shard int, whole boolean").parquet(f"{files.path}/blocks")

    def decoded(part: DataFrame) -> DataFrame:
        return part.select("first_token", "n_tokens", "before", "doc_ids", "sizes", "bits", "checkpoints").mapInArrow(settled(scan), "doc_id long, start long, n_tokens long, before long, ids binary")

    cut = decoded(blocks.where("NOT whole")).groupBy("start").applyInArrow(join, "doc_id long, start long, n_tokens long, ids binary")
    return decoded(blocks.where("whole")).drop("before").unionByName(cut)


def op1_huffman(spark, sf_dir):
    import public_tokenizers

    files = write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
