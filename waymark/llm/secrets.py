"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans are what three fixed patterns match. Weak candidates (identifiers such as user names, tokens that look
random, endpoints) mean little alone; they are interval-joined within ``SCOPE`` code points of the same text, and a weak
secret is reported only near an access identifier, a weak identifier or an endpoint, a weak identifier only near a secret.
Endpoints are evidence and never reported. The join goes by (row, bucket of ``SCOPE`` positions): candidates meet, in their own and the
neighbouring buckets, one row of first and last positions for each kind of part, so a text full of candidates gives
three rows each and no pairs.

Positions are code points, end exclusive. A pattern's matches and the pieces between them give them as running sums of lengths,
in blocks; masking puts a text together from blocks of itself. Both cost about the text and its matches, not their product. Patterns
repeat single characters only, never groups, so a long run neither recurses nor is read again from each of its characters.

Only rows with weak parts that could be reported take part in the join; all others pass through.

Defined results: null text is empty; every row gives a row; repeated rows get equal results; null ids are kept; texts of any length are
read whole; an empty table gives no rows; other columns, whatever their names, are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Staged, read

# The base patterns, and the least length of what each must have matched.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

#: The same maximal runs as HEX and ACCESS where they are long enough, without a match for every letter from a to f.
_LONG_HEX = rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LENGTH},}}+"

IDENTIFIER = r"""(?i)(?<![A-Za-z0-9_])(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_=-])"
#: A URL, an IPv4 address, or the last two labels of a host name.
ENDPOINT = r"(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|ssh)://[^\s\"'<>]++|(?<![A-Za-z0-9_])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![A-Za-z0-9_])|(?<![a-z0-9-])[a-z0-9-]++\.(?:com|net|org|io|dev|cloud|internal|local)(?![A-Za-z0-9_])"
SCOPE = 256
#: Elements of an array, or code points of a text, that are handled together.
BLOCK, TEXT_BLOCK = 256, 4096

KINDS = ["assign", "access", "hex", "identifier", "secret"]
MASK = "[secret]"

_SPAN = "array<struct<start:int,rank:int,stop:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, op) -> Column:
    """``op`` over all earlier elements, for each element, from 0 on; blockwise, so no array of n is copied n times."""

    def within(part: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        block = lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
        sums = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), op))
        return _let(within(sums, F.lit(0)), lambda begins: F.flatten(F.transform(blocks, lambda b: within(block(b), F.element_at(begins, b + 1)))))

    return _let(values, whole)


def matches(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """(start, rank, stop) of the leftmost matches for which ``keep`` holds."""

    def spans(whole: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), whole, lambda p, m: F.length(p) + F.length(m))
        ends = F.zip_with(_running(lengths, lambda a, x: a + x), lengths, lambda before, n: before + n)
        found = F.zip_with(ends, whole, lambda end, m: F.struct((end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), end.alias("stop"), (keep(m) if keep else F.lit(True)).alias("keep")))
        return F.transform(F.filter(found, lambda r: r["keep"]), lambda r: F.struct(r["start"].alias("start"), r["rank"].alias("rank"), r["stop"].alias("stop")))

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_VALUE


def _looks_random(match: Column) -> Column:
    return match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, row key, base spans, weak parts) of every row, with the ``whole`` row if asked for. Weak ranks: 3 identifier, 4 secret, 5 endpoint."""
    row = [F.struct("*").alias("row")] if whole else []
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *row)
    text = F.col("text")
    base = F.concat(matches(text, ASSIGN, 0, _long_value), matches(text, ACCESS, 1, lambda m: F.length(m) >= ACCESS_LENGTH), matches(text, _LONG_HEX, 2))
    weak = F.concat(matches(text, IDENTIFIER, 3), matches(text, WEAK_SECRET, 4, _looks_random))
    # endpoints are looked for only where there is something that they could complete
    weak = _let(weak, lambda w: F.when(F.size(w) > 0, F.concat(w, matches(text, ENDPOINT, 5))).otherwise(w))
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))
    return own.select("doc_id", key.alias("key"), F.array_sort(base).alias("base"), weak.alias("weak"), *(["row"] if whole else []))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, linked spans): the weak identifiers and secrets with a complementary part in scope."""
    parts = found.where(F.size("weak") > 0).select("key", F.explode(F.concat("base", "weak")).alias("s")).select("key", "s.start", "s.rank", "s.stop").distinct()
    # an access identifier, a weak one or an endpoint completes a secret; any secret completes an identifier
    side = F.when(F.col("rank").isin(1, 3, 5), F.lit("name")).otherwise(F.lit("secret"))
    bucket = F.floor(F.col("start") / scope)
    ends = parts.groupBy("key", side.alias("side"), bucket.alias("bucket")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    asks = parts.where("rank IN (3, 4)").withColumn("wants", F.when(F.col("rank") == 3, "secret").otherwise("name")).withColumn("own", bucket).withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    near = (F.col("bucket") == F.col("own")) | ((F.col("bucket") < F.col("own")) & (F.col("start") - F.col("last") <= scope)) | ((F.col("bucket") > F.col("own")) & (F.col("first") - F.col("start") <= scope))
    met = asks.join(ends.withColumnRenamed("side", "wants"), ["key", "wants", "bucket"]).where(near)
    return met.select("key", F.struct("start", "rank", "stop").alias("s")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("linked"))


def _with_spans(found: DataFrame, scope: int) -> DataFrame:
    """``found`` with ``spans``: the base spans and the linked ones, sorted. Rows without weak parts are not moved."""
    met = found.where(F.size("weak") > 0).join(linked(found, scope), "key", "left")
    met = met.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(_SPAN))))).drop("linked")
    return found.where(F.size("weak") == 0).withColumn("spans", F.col("base")).unionByName(met)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, key, base, spans) of every row: spans are the base spans and the linked ones, sorted."""
    found = Staged(docs.sparkSession).put(candidates(docs, id_col=id_col, text_col=text_col), "secret-parts")
    return _with_spans(found, scope).select("doc_id", "key", "base", "spans")


def masked(text: Column, spans: Column) -> Column:
    """The text with ``MASK`` for every span; spans that overlap share one."""
    stops = F.transform(spans, lambda s: s["stop"])

    def build(blocks: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / TEXT_BLOCK).cast("int")
            part = F.slice(blocks, first + 1, F.floor(b / TEXT_BLOCK).cast("int") - first + 1)
            return F.substring(F.array_join(part, ""), a - first * TEXT_BLOCK + 1, b - a)

        rows = F.zip_with(spans, _running(stops, lambda a, x: F.greatest(a, x)), lambda s, before: F.struct(s["start"].alias("start"), before.alias("before")))
        fresh = F.filter(rows, lambda r: r["start"] >= r["before"])
        pieces = F.transform(fresh, lambda r: F.concat(between(r["before"], r["start"]), F.lit(MASK)))
        return F.concat(F.array_join(pieces, ""), between(F.array_max(stops), F.length(text)))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0)), build)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span replaced by ``MASK``; ``length_col``, if it is there, follows the new text.

    Rows are staged with their candidates, so each text is read once and only rows with weak parts are moved."""
    found = Staged(docs.sparkSession).put(candidates(docs, id_col=id_col, text_col=text_col, whole=True), "secret-rows")
    met = _with_spans(found, scope).select("row", "spans")
    text, hit = F.col("row")[text_col].cast("string"), F.size("spans") > 0
    out = met.select("row", hit.alias("hit"), F.when(hit, masked(text, F.col("spans"))).otherwise(text).alias("text"))
    kinds = {f.name: f.dataType for f in docs.schema}

    def column(name: str) -> Column:
        if name == text_col:
            return F.when(F.col("hit"), F.col("text")).otherwise(F.col("row")[name])
        if name == length_col:
            return F.when(F.col("hit"), F.length("text").cast(kinds[name])).otherwise(F.col("row")[name])
        return F.col("row")[name]

    return out.select(*[column(name).cast(kinds[name]).alias(name) for name in docs.columns])


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["stop"])), ",")


def op7_secrets(spark, sf_dir):
    found = scan(read(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
