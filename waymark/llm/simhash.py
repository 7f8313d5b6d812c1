"""SimHash near-duplicates found by pigeonring filtering.

Fingerprints are 64-bit majorities of shingle hashes. Two fingerprints link if at most
``radius`` bits differ. Their bits lie in ``radius + 1`` segments on a ring, and the pigeonring
principle (Qin and Xiao, 2018) says: if the differences sum to at most ``radius``, some segment starts a chain
in which the first l segments together differ in at most l * radius / (radius + 1) bits, for every l. So the first differs in none, the
first two in one at most, and so on. The join key takes the first two segments of a chain: one side gives
its bits, the other all values within one bit of the second segment; longer chains and then all bits are tested on what the join
brings together. From ``WIDE`` fingerprints on, where random ones would meet often under a key of 26 bits, the key takes three segments
(38 bits), and both sides give all values within one bit of the last two, so that two bits of difference meet half-way.

Copies share a fingerprint, so the join sees each fingerprint once, whatever the size of a
group of copies. Where many fingerprints crowd under one key, those within one or two bits of each other are first
linked through shared one-bit neighbours, as stars and not as pairs; the pigeonring join then has to link only
what is still apart, so a dense group of near copies gives no square of pairs. How fingerprints are linked, by either key or by
stars, never changes which components there are.

Defined results: null, empty and blank texts have fingerprint 0 and link like any other; repeated rows are copies; rows with a null id take
part, and a component of null ids alone has a null id; texts of any length are read whole; an empty table gives no rows; other columns are ignored,
and ``drop_near_duplicates`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Staged, apart, read, salted_join, settled, texts
from waymark.llm.components import connected_components

SHINGLE = 4
RADIUS = 4
#: Fingerprints under one chain key from which on they are first linked as stars.
CROWD = 32
#: Distinct fingerprints from which on chain keys take three segments: random ones then meet about as often as there are keys.
WIDE = 1 << 26
SEED = 42


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text as an unsigned number; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    k = min(shingle, len(words))
    stops = ends[k - 1 :].tolist()
    starts = (ends - sizes + 1)[: len(stops)].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounds the memory of a long text
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, n, fp) for every row: a hash and the length of its text, which with the id tell rows apart, and the fingerprint as a signed number."""

    def scan(batches):
        for batch in batches:
            values = texts(batch.column(3))
            found = np.fromiter((fingerprint(v, shingle) for v in values), np.uint64, len(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found.view(np.int64))], ["doc_id", "h", "n", "fp"])

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.coalesce(F.length(text), F.lit(-1)).alias("n"), text.alias("text"))
    return own.mapInArrow(settled(scan), "doc_id long, h long, n int, fp long")


def _bits(width: int) -> int:
    return (1 << width) - 1


def _signed(value: int) -> int:
    value &= _bits(64)
    return value - (1 << 64) if value >> 63 else value


def segments(radius: int) -> list[int]:
    """Masks of the ``radius + 1`` segments, as even as they can be."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [_bits(edges[i + 1] - edges[i]) << edges[i] for i in range(n)]


def _mask(value: int) -> Column:
    return F.lit(_signed(value)).cast("long")


def _one_bits(mask: int) -> list[int]:
    return [1 << b for b in range(64) if mask >> b & 1]


def star_links(nodes: DataFrame) -> DataFrame:
    """Links among fingerprints two or fewer bits apart, as stars around the smallest ``fp``
    of those that share a neighbour: 65 rows a fingerprint, however dense its surroundings."""
    near = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(_mask(b)) for b in _one_bits(_bits(64))]))
    hubs = nodes.select("fp", near.alias("at"))
    least = hubs.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n"))
    pairs = least.where("n = 2").select("a", F.col("z").alias("b"))
    crowd = least.where("n > 2").select("at", "a")
    rest = apart(hubs).join(crowd, "at").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(rest).distinct()


def _chains(radius: int, probing: bool, length: int = 2) -> list[Column]:
    """(chain, key) of every segment that a chain can start at, over ``length`` segments; with ``probing``, also those one bit of all but the first segment away."""
    ring, out = segments(radius), []
    for i, first in enumerate(ring):
        rest = 0
        for j in range(1, length):
            rest |= ring[(i + j) % len(ring)]
        key = F.col("fp").bitwiseAND(_mask(first | rest))
        for bit in [0, *(_one_bits(rest) if probing else [])]:
            out.append(F.struct(F.lit(i).cast("byte").alias("chain"), (key.bitwiseXOR(_mask(bit)) if bit else key).alias("key")))
    return out


def crowded(nodes: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(fp): fingerprints with a chain key that more than ``crowd`` have."""
    keyed = nodes.select("fp", F.explode(F.array(*_chains(radius, False))).alias("s")).select("fp", "s.chain", "s.key")
    full = keyed.groupBy("chain", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("chain", "key")
    return keyed.join(full, ["chain", "key"], "left_semi").select("fp").distinct()


def chain_links(nodes: DataFrame, radius: int = RADIUS, length: int = 2) -> DataFrame:
    """Links of ``radius`` or fewer bits between fingerprints of different ``part``, by pigeonring chains.

    With a key of two segments one side probes; with three, both do, and two bits of difference meet half-way."""
    ring = segments(radius)
    n = len(ring)
    length = min(length, n)
    left = apart(nodes.select(F.col("fp").alias("a"), F.col("part").alias("pa"), F.explode(F.array(*_chains(radius, length > 2, length))).alias("s")).select("a", "pa", "s.chain", "s.key"))
    right = nodes.select(F.col("fp").alias("b"), F.col("part").alias("pb"), F.explode(F.array(*_chains(radius, True, length))).alias("s")).select("b", "pb", "s.chain", "s.key")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    chained = F.lit(False)
    for i in range(n):
        own, mask = F.col("chain") == i, 0
        for size in range(1, n):
            mask |= ring[(i + size - 1) % n]
            if size > 1:
                own = own & (F.bit_count(differing.bitwiseAND(_mask(mask))) <= size * radius // n)
        chained = chained | own
    joined = left.join(right, (left["chain"] == right["chain"]) & (left["key"] == right["key"]) & (F.col("pa") < F.col("pb")), "inner").drop(right["chain"])
    return joined.where(chained).where(F.bit_count(differing) <= radius).select("a", "b").distinct()


def link(distinct: DataFrame, staged: Staged, radius: int = RADIUS, crowd: int = CROWD, wide: int = WIDE) -> DataFrame:
    """(fp, least, whole): the component of every fingerprint, named by one of its fingerprints."""
    if radius >= 2:
        stars = connected_components(star_links(crowded(distinct, radius, crowd)), staged, "stars")
        parts = distinct.join(stars.select(F.col("node").alias("fp"), "part"), "fp", "left")
    else:
        parts = distinct.withColumn("part", F.lit(None).cast("long"))
    parts = staged.put(parts.select("fp", "least", F.coalesce("part", "fp").alias("part")), "parts")
    links = chain_links(parts, radius, 3 if parts.count() >= wide else 2)
    ends = links.join(parts.select(F.col("fp").alias("a"), F.col("part").alias("p")), "a").join(parts.select(F.col("fp").alias("b"), F.col("part").alias("q")), "b")
    merged = connected_components(ends.select(F.col("p").alias("a"), F.col("q").alias("b")).where("a <> b").distinct(), staged, "chains")
    return parts.join(merged.select(F.col("node").alias("part"), F.col("part").alias("whole")), "part", "left").select("fp", "least", F.coalesce("whole", "part").alias("whole"))


def grouped(docs: DataFrame, radius: int, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and for each fingerprint the first row of its component: (fp, first).

    Rows come in the order of id (null ids last), length and hash; each fingerprint's first row is found before components are looked at."""
    staged = Staged(docs.sparkSession)
    prints = staged.put(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "n", "h")
    distinct = staged.put(prints.groupBy("fp").agg(F.min(place).alias("least")), "nodes")
    groups = link(distinct, staged, radius)
    first = groups.groupBy("whole").agg(F.min("least").alias("first"))
    return prints, salted_join(groups, first, "whole", "fp").select("fp", "first")


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id reachable."""
    prints, groups = grouped(docs, radius, shingle, id_col, text_col)
    ids = groups.select("fp", F.col("first.doc_id").alias("component_id"))
    return salted_join(prints, ids, "fp", "doc_id").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, *, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row left of each group: the first by id (null ids last), length and hash of its text.

    Rows are told apart by id, length and hash, so rows of one id, or without one, are judged each by its own text; of rows
    equal in all three one stays. The texts move once, to the keys of what goes."""
    prints, groups = grouped(docs, radius, shingle, id_col, text_col)
    own = salted_join(prints, groups, "fp", "doc_id")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h")) & (F.col("n") == F.col("first.n"))
    text = F.col(f"row.{text_col}").cast("string")
    key = [F.coalesce(F.col(f"row.{id_col}").cast("long"), F.lit(0)).alias("i"), F.col(f"row.{id_col}").isNull().alias("z"), F.xxhash64(text).alias("h"), F.coalesce(F.length(text), F.lit(-1)).alias("n")]
    gone = own.where(~is_first).select(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("z"), "h", "n").distinct()
    kept = docs.select(F.struct("*").alias("row")).select("row", *key).join(gone, ["i", "z", "h", "n"], "left_anti").dropDuplicates(["i", "z", "h", "n"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op4_simhash(spark, sf_dir):
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
