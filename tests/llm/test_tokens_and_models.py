"""Token files, packing and trained models: exact round trips and held-out accuracy."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm import huffman, language_id, packing, quality_model, queries
from waymark.llm.tokens import Encoder

SF = "/root/testdata/sf0.01"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [(7, None), (8, ""), (None, "null id"), (9, "same"), (9, "same"), (10, "word " * 20000), (-3, " \n\n x")]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_units_give_the_tokenizers_ids(path):
    draw, own, plain = random.Random(1), Encoder(path, store=500), Tokenizer.from_file(path)
    alphabet = [*"ab é Ñß.,'s\n\n  \t\r9#İſ\x85\x1c​  　日本\U0001d4b3ć", "ć", "<|endoftext|>", "'ll ", "  ", "\n ", "the ", "ABC", " !"]
    for _ in range(4000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40)))
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == want, repr(text)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_added_tokens_get_their_ids(path):
    """Ids are those of the library's plain call, one text at a time and in columns."""
    draw, own, plain = random.Random(2), Encoder(path, store=500), Tokenizer.from_file(path)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "a", "Bar", " ", "  ", "\n", "\t", "é", "."]
    texts = ["foo <|endoftext|> bar", "<|endoftext|>", "a<|endoftext|>\u0338b", *("".join(draw.choice(marks) for _ in range(draw.randint(0, 12))) for _ in range(1500))]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(own.encode(t), own.dtype).tolist() for t in texts] == want
    ids, stops = own.encode_all(pa.array(texts), 7)
    assert [x.tolist() for x in np.split(ids, stops[:-1])] == [[*w, 7] for w in want]
    assert plain.token_to_id("<|endoftext|>") in want[0]


@pytest.mark.parametrize(("symbols", "limit"), [(1, 20), (2, 20), (5, 3), (300, 9), (20000, 16)])
def test_huffman_round_trip(symbols, limit):
    draw = np.random.default_rng(symbols)
    counts = np.maximum(1, (1e6 / np.arange(1, symbols + 1) ** 1.5)).astype(np.int64)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and (symbols == 1 or abs((2.0**-lengths).sum() - 1) < 1e-9)
    code = huffman.Code(np.arange(symbols), lengths)
    for n in (0, 1, 127, 128, 129, 4000):
        ids = draw.integers(0, symbols, n).astype(np.uint16)
        bits, marks = huffman.encode(ids, *code.encoder())
        assert (huffman.decode(bits, marks, n, *code.decoder(), code.limit) == ids).all()


def test_package_merge_is_optimal_when_unlimited():
    import heapq

    counts = np.array([50, 20, 10, 9, 6, 3, 1, 1])
    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    assert int((huffman.code_lengths(counts, 20) * counts).sum()) == total


@pytest.mark.parametrize("ordered", [True, False])
def test_token_files(spark, ordered):
    rows = [(i, f"Text number {i} of some words") for i in range(11, 60)] + ODD
    docs = spark.createDataFrame(sorted(rows, key=lambda r: -1 << 40 if r[0] is None else r[0]) if ordered else rows, "doc_id long, text string").withColumn("start", F.lit("x"))
    files = huffman.write_tokens(docs if ordered else docs.repartition(4), WORD, block_tokens=100)
    got = [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in huffman.read_tokens(spark, files).collect()]
    plain, at, want = Tokenizer.from_file(WORD), 0, []
    for i, text in sorted(rows, key=lambda r: -1 << 40 if r[0] is None else r[0]):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    blocks = spark.read.parquet(f"{files.path}/blocks")
    assert blocks.where("NOT whole").count() >= 200 and blocks.agg(F.max("n_tokens")).first()[0] < 250  # the long text lies in blocks like others
    first = [r["first"] for r in blocks.groupBy("shard").agg(F.min("first_token").alias("first")).orderBy("shard").collect()]
    assert first == sorted(first)


def test_no_token_files(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert huffman.read_tokens(spark, huffman.write_tokens(docs, WORD)).count() == 0


@pytest.mark.parametrize("sizes", [[], [5], [2048], [4096, 1], [1500] * 40, list(range(1, 4000, 7)), [1025] * 7 + [3], [1] * 300])
def test_packing_wastes_nothing(sizes):
    seen, padding = {}, 0
    for sequence in packing.pack(sizes):
        n = sum(length for _, _, length in sequence)
        assert 0 < n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
        for doc, start, length in sequence:
            seen.setdefault(doc, []).append((start, length))
    assert padding == 0
    for doc, size in enumerate(sizes):
        at = 0
        for start, length in sorted(seen.get(doc, [])):
            assert start == at
            at += length
        assert at == size


def test_best_fill_is_best():
    draw = random.Random(2)
    for _ in range(200):
        counts = sorted({draw.randint(1, 30): draw.randint(1, 3) for _ in range(4)}.items(), reverse=True)
        room = draw.randint(1, 60)
        sums = {0}
        for length, n in counts:
            sums = {s + k * length for s in sums for k in range(n + 1)}
        taken = packing.best_fill(counts, room)
        assert all(k <= dict(counts)[length] for length, k in taken)
        assert sum(length * k for length, k in taken) == max(s for s in sums if s <= room)


def test_packed_documents(spark):
    rows = [*ODD, (11, "a <|endoftext|> b"), (12, "many words " * 1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).withColumn("start", F.lit("x"))
    pieces = packing.pack_documents(docs, BYTE).collect()
    plain = Tokenizer.from_file(BYTE)
    got = {}
    for r in pieces:
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
        assert r["length"] == len(r["ids"]) // 4
    for i, text in set(rows):  # every id lies in exactly one piece, those of cut documents too
        ids, times = [*plain.encode(text or "", add_special_tokens=False).ids, 1], rows.count((i, text))
        own = sorted(got.pop((i, len(ids))))[::times]
        assert sum((x for _, x in own), []) == ids and [a for a, _ in own] == [sum(len(x) for _, x in own[:k]) for k in range(len(own))]
    assert not got
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


def test_minimum_slack_fills_more_than_first_fit():
    """How many sequences whole pieces alone fill: the subset sums against first fit on the same lengths."""
    draw = np.random.default_rng(5)
    sizes = np.minimum(2047, draw.lognormal(6, 0.8, 2000).astype(int) + 1).tolist()
    sequences = list(packing.pack(sizes))
    uncut = sum(all(n == sizes[doc] for doc, _, n in s) and sum(x[2] for x in s) == 2048 for s in sequences)
    bins = []
    for n in sorted(sizes, reverse=True):
        at = next((i for i, used in enumerate(bins) if used + n <= 2048), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    assert uncut > 0.8 * len(sequences) and uncut > sum(b == 2048 for b in bins)


def test_quality_held_out(spark):
    found = queries.QUERIES["op6_quality_model"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["quality"]).mean() > 0.95


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_model.classify(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(9, 1, 0), (9, None, 0), (None, 1, 0), (10, 0, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality_model.classify(docs, labels).count() == len(ODD)
    assert quality_model.drop_rejected(docs, labels).columns == docs.columns
    assert quality_model.classify(docs.limit(0), labels).count() == 0


def test_language_held_out(spark):
    found = queries.QUERIES["op10_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.97


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "en" if i != 9 else None) for i, t in ODD] + [(20, "12 34 !?", "en"), (21, "ж", "ru")], "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert (7, "und") in got and (8, "und") in got and (20, "und") in got and (21, "und") not in got
    nothing = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_more_languages_than_a_machine_word():
    members = {f"l{i:03d}": np.arange(i * 50, i * 50 + 50) for i in range(70)}
    filters = language_id.Filters(members, dict.fromkeys(members, 1))
    for i in (0, 63, 64, 69):
        votes = filters.votes(np.arange(i * 50, i * 50 + 50), np.zeros(50, np.int64), 1)
        assert filters.languages[int(votes.argmax())] == f"l{i:03d}"
