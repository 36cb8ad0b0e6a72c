"""Copies of a hunk that hide behind formatting: whitespace, letter case, punctuation, field order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkmill.plans.lineage import cut
from hunkmill.plans.skew import attach_by_key

_PAYLOAD = "condition array<string>, consequent array<string>, _broken string"
#: The letters that the histogram counts, frequent ones; what it does not count is told apart by the digest.
LETTERS = "etaoinsr"
#: Bits of the table of class keys held by several records; the table is broadcast and never larger than 2**MOST_BITS bits (8 MB).
#: Its rows are of 2**15 bits, as Spark's bitmap functions have them.
LEAST_BITS, MOST_BITS = 16, 26


def _side(lines: Column) -> Column:
    """Letters and digits of all lines of a side, in order and in lower case; null lines and sides give nothing."""
    return F.regexp_replace(F.lower(F.array_join(F.coalesce(lines, F.array().cast("array<string>")), " ")), r"[^\p{L}\p{N}]+", "")


def _histogram(text: Column) -> list[Column]:
    """What is left of the text's length without each of ``LETTERS``, which together with the length gives how often it stands there."""
    return [F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS]


def parsed_hunks(records: DataFrame, id_col: str = "record_id", payload: str = "payload") -> DataFrame:
    """(record_id, before, after): the stripped sides of each record whose payload is a whole JSON hunk with some letter or digit.

    Null payloads, payloads that are cut off or are no JSON object, payloads in which neither field is present, and hunks without any
    letter or digit are left out. Other columns of ``records`` are ignored, whatever their names.
    """
    doc = F.from_json(F.col(payload), _PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = records.select(F.col(id_col).alias("record_id"), doc.alias("doc")).filter(
        "doc is not null and doc._broken is null and (doc.condition is not null or doc.consequent is not null)"
    )
    sides = rows.select("record_id", _side(F.col("doc.condition")).alias("before"), _side(F.col("doc.consequent")).alias("after"))
    return sides.filter("before != '' or after != ''")


def _several(rows: DataFrame, key: list[Column], bits: int) -> DataFrame:
    """The rows whose key, hashed to ``bits`` bits, is that of another row too: all members of classes with several rows, and a few others.

    Keys are counted with map-side sums; the hashes with several rows become a table of bits that is broadcast, of a size fixed by ``bits``. So
    rows stay where they are, with their text. More rows than bits only make more rows pass.
    """
    hashed = rows.withColumn("_k", F.xxhash64(*key).bitwiseAND(F.lit((1 << bits) - 1)))  # never null, so that no filter computes it again
    held = hashed.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    row, bit = F.shiftright("_k", 15), F.col("_k").bitwiseAND(F.lit((1 << 15) - 1))
    table = held.groupBy(row.alias("_row")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    met = hashed.withColumns({"_row": row, "_bit": bit}).join(F.broadcast(table), "_row")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.filter(F.bit_get(byte, F.col("_bit").bitwiseAND(F.lit(7))) == 1).drop("_k", "_row", "_bit", "_bits")


def _refined(records: DataFrame, id_col: str, payload: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, members, classes), see ``copy_classes``; rows are all parsed hunks with their stripped sides."""
    rows = cut(parsed_hunks(records, id_col, payload).select("record_id", "before", "after", F.length("before").alias("lb"), F.length("after").alias("la")))
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * rows.count()).bit_length()))
    # 1. stripped lengths
    first = _several(rows, [F.col("lb"), F.col("la")], bits)
    # 2. letter counts, only where lengths meet
    second = _several(first, [F.col("lb"), F.col("la"), *_histogram(F.concat("before", "after"))], bits)
    # 3. the digest, only where letter counts meet; the text goes no further
    digest = F.unhex(F.sha2(F.concat_ws("\u0001", "before", "after"), 256))
    members = cut(second.select("record_id", digest.alias("digest")).distinct())
    classes = members.groupBy("digest").agg(F.min("record_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows, members, cut(classes)


def copy_classes(records: DataFrame, id_col: str = "record_id", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(members, classes) of the sets of at least two copies, by progressive refinement.

    1. The stripped lengths of both sides are counted; a record whose lengths no other record has ends there.
    2. Of the others the letters are counted (``LETTERS``, a histogram); a record whose histogram no other has ends there.
    3. Only what is left gets the costly key, a 256-bit digest of the stripped text, which decides.

    The payload is parsed once; texts are never shuffled. Steps 1 and 2 filter by hashed keys, so they may let a record pass that has no
    partner, never the other way round. ``members`` has record_id and digest; ``classes`` has digest, keep_id (the smallest record_id) and n. A
    record_id that is repeated with the same content counts once in n.
    """
    return _refined(records, id_col, payload)[1:]


def _followers(members: DataFrame, classes: DataFrame) -> DataFrame:
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = attach_by_key(members, classes, "digest", "n", total)
    return joined.filter("record_id != keep_id").select("keep_id", F.col("record_id").alias("copy_id"))


def copies(records: DataFrame, id_col: str = "record_id", payload: str = "payload") -> DataFrame:
    """(keep_id, copy_id): one row for each record that copies another; keep_id is the smallest record_id of its class.

    Defined results: null, cut-off and letterless payloads give no row; an empty table gives no row; a repeated record_id with the same
    content is one record; a class may hold any share of all rows (hot classes are joined by a broadcast of at most 200 keys).
    """
    return _followers(*copy_classes(records, id_col, payload))


def copy_counts(records: DataFrame, id_col: str = "record_id", payload: str = "payload") -> DataFrame:
    """(keep_id, copies): every distinct hunk once, with the number of records that hold it (1 for a hunk without copies)."""
    rows, members, classes = _refined(records, id_col, payload)
    doubles = _followers(members, classes).select(F.col("copy_id").alias("record_id"))
    firsts = rows.select("record_id").distinct().join(doubles, "record_id", "left_anti")
    return firsts.join(classes.select(F.col("keep_id").alias("record_id"), "n"), "record_id", "left").select(
        F.col("record_id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("copies")
    )
