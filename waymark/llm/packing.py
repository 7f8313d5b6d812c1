"""Packing of token ids into sequences by minimum bin slack.

Documents are cut at full sequences; what remains of each is one piece, and pieces are told apart by length
alone. For each sequence the longest piece left is fixed and a subset-sum dynamic program over the
lengths left, as bits of one integer, finds the multiset that comes closest to the capacity; backtracking
gives how often each length is taken, and the pattern is used as often as its lengths last. Slack that no
multiset fills is filled by cutting a further piece, and what is left at the end goes into sequences of a power of two
each, which need no padding.

A partition packs on its own, block by block of at most ``BLOCK_TOKENS`` ids, so there is no shuffle, memory is bounded
and a lost task is run again alone. Sequence ids are the partition number times 2**33 plus a count.

Defined results: null and empty texts are their end id; repeated rows and null ids are packed like others;
an empty table gives no pieces; a very long text becomes many full sequences; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import read, settled
from waymark.llm.tokens import STORE, ids_of

CAPACITY = 2048
END_ID = 1
BLOCK_TOKENS = 4 << 20

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: A piece: number of its document in the block, first id, number of ids.
Piece = tuple[int, int, int]


def best_fill(counts: Iterable[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """(length, times) of a sub-multiset of ``counts`` with the largest sum up to ``room``; reads no further than needed."""
    whole, reach, before = (1 << (room + 1)) - 1, 1, []
    for length, count in counts:
        before.append((length, reach))
        left, step = min(count, room // length), 1
        while left > 0:  # binary splitting: any number of copies up to ``left``
            take = min(step, left)
            reach |= (reach << (take * length)) & whole
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, []
    for length, earlier in reversed(before):
        times = 0
        while not earlier >> at & 1:
            at -= length
            times += 1
        if times:
            taken.append((length, times))
    return taken


def pack(sizes: list[int], capacity: int = CAPACITY) -> Iterator[list[Piece]]:
    """Sequences, as lists of pieces in their order, that together hold every id of documents of ``sizes`` once."""
    open_pieces: dict[int, list[Piece]] = {}
    for doc, size in enumerate(sizes):
        for start in range(0, size - size % capacity, capacity):
            yield [(doc, start, capacity)]
        if size % capacity:
            open_pieces.setdefault(size % capacity, []).append((doc, size - size % capacity, size % capacity))
    lengths = sorted(open_pieces)

    def pop(length: int) -> Piece:
        own = open_pieces[length]
        piece = own.pop()
        if not own:
            del open_pieces[length], lengths[bisect_left(lengths, length)]
        return piece

    def push(piece: Piece):
        if piece[2] not in open_pieces:
            open_pieces[piece[2]] = []
            insort(lengths, piece[2])
        open_pieces[piece[2]].append(piece)

    while lengths:
        longest = lengths[-1]
        room = capacity - longest
        others = ((x, len(open_pieces[x]) - (x == longest)) for x in reversed(lengths[: bisect_right(lengths, room)]))
        taken = dict(best_fill(((x, n) for x, n in others if n), room)) if room else {}
        taken[longest] = taken.get(longest, 0) + 1
        slack = capacity - sum(x * n for x, n in taken.items())
        for _ in range(1 if slack else min(len(open_pieces[x]) // n for x, n in taken.items())):
            sequence = [pop(x) for x in sorted(taken, reverse=True) for _ in range(taken[x])]
            need = slack
            while need and lengths:  # cut the shortest piece that suffices, else take the longest whole
                at = bisect_right(lengths, need)
                doc, start, length = pop(lengths[at] if at < len(lengths) else lengths[-1])
                used = min(need, length)
                sequence.append((doc, start, used))
                if length > used:
                    push((doc, start + used, length - used))
                need -= used
            if need:
                yield from _powers_of_two(sequence)
            else:
                yield sequence


def _powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The same ids in sequences whose lengths are the powers of two that make up their number."""
    left = sum(n for _, _, n in pieces)
    queue = list(reversed(pieces))
    while left:
        need = size = 1 << (left.bit_length() - 1)
        sequence = []
        while need:
            doc, start, n = queue.pop()
            used = min(n, need)
            sequence.append((doc, start, used))
            if n > used:
                queue.append((doc, start + used, n - used))
            need -= used
        left -= size
        yield sequence


def pack_documents(docs: DataFrame, path: str, *, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, store: int = STORE) -> DataFrame:
    """One row per piece with its ids (little-endian, 4 bytes each). ``store``: units whose ids a worker keeps."""

    def scan(batches):
        from pyspark import TaskContext

        sequence_id = TaskContext.get().partitionId() << 33

        def emit(names: list, ids: list[np.ndarray]):
            nonlocal sequence_id
            rows, size = [], 0
            for sequence in pack([len(x) for x in ids], capacity):
                offset = 0
                for doc, start, length in sequence:
                    rows.append((names[doc], start, length, ids[doc][start : start + length].astype("<u4").tobytes(), len(ids[doc]), sequence_id, offset))
                    offset += length
                sequence_id += 1
                size += offset
                if size > 1 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

        names, held, total = [], [], 0
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1), path, end_id, store), strict=True):
                names.append(name)
                held.append(ids)
                total += len(ids)
                if total >= block_tokens:
                    yield from emit(names, held)
                    names, held, total = [], [], 0
        yield from emit(names, held)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(settled(scan), SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark, sf_dir):
    import public_tokenizers

    return digests(pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def crc32_of(ids: np.ndarray) -> int:
    """What ``digests`` gives, for tests."""
    return zlib.crc32(ids.astype("<u4").tobytes())
