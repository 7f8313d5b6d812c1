"""Token ids of whole texts with a public tokenizer, at dictionary speed.

Two families of byte-pair tokenizers never join characters across a blank, so a text's ids are
those of its blank-separated units in a row; a worker keeps the ids of units it has met. Where that is not
certain (runs of white space, other tokenizers) larger units or the whole text go to the tokenizer. The ids
are always exactly those of ``Tokenizer.encode(text, add_special_tokens=False)``, so a text that holds the content of
an added token (``<|endoftext|>``) gets that token's id; such texts go to the tokenizer whole. A test holds both
against each other on random texts.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import settled

#: Units whose ids a worker keeps; about 200 bytes each. The store starts afresh when it is full.
STORE = 1_200_000

#: Text that one vectorised step handles.
GROUP_BYTES = 16 << 20

# The characters of Unicode's White_Space property.
WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_ODD_WHITE = [c for c in WHITE if c not in " \n"] + ["  ", "\n\n", " \n", "\n "]
#: Marks in front of a unit without a blank, in place of the end id, and between units; texts that hold them take the slow path.
_BARE, _END, _BETWEEN = "\x01", "\x02", "\x03"
_ODD = "[\x01-\x03" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE if c not in " \n") + "]|  |\n\n| \n|\n "
_RUNS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"( ?)([{_LETTERS}]+)([.,;:!?]*)")


def _byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts to little-endian ids, 2 bytes each if the vocabulary allows, else 4."""

    def __init__(self, path: str, store: int = STORE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._code = {2: "H", 4: "I"}[self.dtype.itemsize]
        if sys.byteorder != "little":
            raise NotImplementedError("ids are kept in the machine's byte order")
        spec = json.loads(Path(path).read_text())
        added = [x["content"] for x in spec.get("added_tokens") or []]
        self.kind = "" if any(re.search(r"\s", x) for x in added) else self._family(spec)
        #: What may hold an added token; in any case, as normalizers may lower it.
        self._added = "(?i)" + "|".join(map(re.escape, added)) if added else ""
        self._holds_added = re.compile(self._added).search if added else lambda _: None
        letters = _byte_letters()
        self._seen = [letters[b] for b in range(256)]
        encode, store_limit = self._encode_unit, store

        class Units(dict):
            """Ids by unit; ``lead`` stands before each."""

            def __init__(self, lead: str):
                self.lead = lead

            def __missing__(self, unit: str) -> bytes:
                if len(self) >= store_limit:
                    self.clear()
                found = self[unit] = encode(self, unit) if unit or self.lead else b""
                return found

        self.bare = Units("")
        self.led = Units(" ") if self.kind == "blank" else self.bare

    @staticmethod
    def _family(spec: dict) -> str:
        """"blank": a unit takes the blank before it along; "bare": white space yields nothing; "": any other."""
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if (spec.get("model") or {}).get("type") != "BPE" or spec.get("truncation") or spec.get("padding"):
            return ""
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and norm is None:
            return "blank"
        parts = before.get("pretokenizers") or []
        split = parts[0] if len(parts) == 2 and parts[0].get("type") == "Split" else {}
        spaceless = split.get("behavior") == "Removed" and split.get("invert") and split.get("pattern", {}).get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        byte_level = len(parts) == 2 and parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space")
        norms = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        return "bare" if spaceless and byte_level and norms == ["NFC", "Replace", "Lowercase"] else ""

    def _encode_unit(self, units: dict, unit: str) -> bytes:
        plain = _PLAIN.fullmatch(unit) if self.kind else None
        if plain is None or plain[1]:
            return self.whole(units.lead + unit)
        _, word, marks = plain.groups()
        if marks:  # letters and marks never share a token
            return units[word] + self.bare[marks]
        if self.kind == "bare" and (small := word.lower()) != word:
            return units[small]
        if not word.isascii():  # ASCII letters stand for themselves
            word = "".join([self._seen[b] for b in word.encode()])
        lead = self._seen[32] if units.lead else ""
        return array(self._code, [t.id for t in self.model.tokenize(lead + word)]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.kind or self._holds_added(text):
            return self.whole(text) if text else b""
        if any(x in text for x in _ODD_WHITE):
            return b"".join(map(self.bare.__getitem__, _RUNS.findall(text)))
        led, bare, out = self.led.__getitem__, self.bare.__getitem__, []
        for number, line in enumerate(text.split("\n")):
            if number and self.kind == "blank":
                out.append(bare("\n"))
            units = line.split(" ")
            out.append(bare(units[0]))
            out += map(led, units[1:])
        return b"".join(out)


    def encode_all(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with ``end_id`` after each, in a row; their ends). Arrow splits the texts and
        numbers the distinct units, so only those are looked up here."""
        column = pc.fill_null(column, "")
        odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
        last = np.array([end_id], self.dtype).tobytes()
        if self._added:
            odd = odd | pc.match_substring_regex(column, self._added).to_numpy(zero_copy_only=False)
        if not self.kind:
            odd[:] = True
        plain = pc.if_else(pa.array(~odd), column, "")
        if self.kind == "blank":
            plain = pc.binary_join_element_wise(_BARE, pc.replace_substring(plain, "\n", f" \n {_BARE}"), "")
        else:
            plain = pc.replace_substring(plain, "\n", " ")
        plain = pc.binary_join_element_wise(plain, f" {_END}", "")
        units = pc.split_pattern(plain, " ")
        coded = units.flatten().dictionary_encode()
        number = coded.indices.to_numpy()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), _BETWEEN)[0].as_py()
        found = [self._marked(u, last) for u in distinct.split(_BETWEEN)] if len(coded) else []
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(found), self.dtype)
        begin = np.cumsum(size) - size
        sizes = size[number]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[number] - (ends - sizes), sizes)
        ids = pool[at]
        offsets = units.offsets.to_numpy()
        stops = ends[offsets[1:] - offsets[0] - 1]
        if odd.any():
            parts = np.split(ids, stops[:-1])
            for i in np.flatnonzero(odd).tolist():
                parts[i] = np.frombuffer(self.encode(column[i].as_py()) + last, self.dtype)
            ids, stops = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, stops

    def _marked(self, unit: str, last: bytes) -> bytes:
        if unit == _END:
            return last
        if unit[:1] == _BARE:
            return self.bare[unit[1:]]
        return self.bare[unit] if unit == "\n" else self.led[unit]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, store: int = STORE) -> Encoder:
    """One encoder per worker and file; workers outlive tasks, and so keep their store for whatever runs next."""
    if (path, store) not in _ENCODERS:
        _ENCODERS[path, store] = Encoder(path, store)
    return _ENCODERS[path, store]


def ids_of(column: pa.Array, path: str, end_id: int, store: int = STORE):
    """The ids of each text of a column with ``end_id`` after them, as numpy arrays."""
    own = encoder(path, store)
    column = column.cast(pa.large_string()) if pa.types.is_large_string(column.type) else column.cast(pa.string())
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // GROUP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            ids, stops = own.encode_all(column.slice(a, b - a), end_id)
            yield from np.split(ids, stops[:-1])


def tokenize(docs: DataFrame, path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, start, doc_id, n_tokens, width, ids) of every row: part is the partition it was read in, start the ids before it there."""

    def scan(batches):
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            names, begin, size = batch.column(0), 0, 0
            out: list[bytes] = []
            counts: list[int] = []
            width = 2
            for i, ids in enumerate(ids_of(batch.column(1), path, end_id)):
                width = ids.itemsize
                out.append(ids.tobytes())
                counts.append(len(ids))
                size += len(out[-1])
                if size > 1 << 23 or i == len(names) - 1:
                    n, ends = len(out), start + np.cumsum(counts)
                    starts, start = ends - np.array(counts), int(ends[-1])
                    yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(starts), names.slice(begin, n), pa.array(counts, pa.int64()), pa.array([width] * n, pa.int32()), pa.array(out, pa.binary())], ["part", "start", "doc_id", "n_tokens", "width", "ids"])
                    begin, size, out, counts = begin + n, 0, [], []

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(settled(scan), "part int, start long, doc_id long, n_tokens long, width int, ids binary")
