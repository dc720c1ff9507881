"""Differences between two copies of a dataset, by hierarchical checksums.

Keys are spread over a tree of key ranges (ranges of the key's 64-bit hash, so a
frequent part of a key does not make one range heavy).  One scan of either side
leaves narrow records: keys, hashes of texts, numbers and one checksum term, laid
out by coarse range.  The coarse ranges' checksums are compared first; a range
that differs is cut into finer ones, whose checksums are made from its records
only, and so on.  Records of ranges that agree are not read again, and fields are
compared only in the finest ranges that differ.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import stage

#: Bits by which a differing range is cut finer, and most bits of the coarse ranges that records are laid out by.
FAN_BITS, COARSE_BITS = 6, 8


@F.pandas_udf(T.StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def plain_text(text: Column) -> Column:
    """Text with ``\\n`` line ends, without white space at line ends and at the end, composed.

    Most texts are plain already; plain string searches find the others, and only
    those are rewritten.  Only texts with characters beyond ASCII leave the JVM for
    composition.
    """
    beyond = text.rlike(r"[^\x00-\x7F]")
    marks = [F.contains(text, F.lit(m)) for m in (" \n", "\t\n", "\r", "\x0b", "\x0c")]
    rough = beyond | F.right(text, F.lit(1)).isin(" ", "\t", "\n")
    for m in marks:
        rough = rough | m
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    # a run is tried at its first character only, so long runs take linear time
    trimmed = F.regexp_replace(unix, r"[\p{IsWhite_Space}&&[^\n]](?<![\p{IsWhite_Space}&&[^\n]](?s:.))[\p{IsWhite_Space}&&[^\n]]*+(?=\n|\z)", "")
    ended = F.regexp_replace(trimmed, r"\n(?<!\n\n)\n*+\z", "")
    clean = F.when(rough, ended).otherwise(text)
    return F.when(beyond, _composed(F.when(beyond, ended))).otherwise(clean)


def number_key(text: Column, width: int = 6) -> Column:
    """The number in a key text, padded with zeros to ``width``; other texts keep their form without outer white space and marks."""
    trimmed = F.regexp_replace(text, r"^[^\p{L}\p{N}]++|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++\z", "")
    bare = F.regexp_replace(trimmed, r"^0+(?=\d)", "")
    return F.when(trimmed.rlike(r"^\d+$"), F.when(F.length(bare) < width, F.lpad(bare, width, "0")).otherwise(bare)).otherwise(trimmed)


@dataclass(frozen=True)
class Field:
    """A compared field: text (normalised) or a number with a tolerance."""

    name: str
    tolerance: float | None = None


def _side(df: DataFrame, keys: dict[str, Column], fields: list[Field], left: bool) -> DataFrame:
    """Keys, the hash of every text and the value of every number of one side."""
    cols = [c.alias(k) for k, c in keys.items()]
    vals = [(F.when(F.col(f.name).isNotNull(), F.xxhash64(plain_text(F.col(f.name)))) if f.tolerance is None else F.col(f.name).cast("double")).alias(f"v_{i}") for i, f in enumerate(fields)]
    return df.select(F.lit(left).alias("is_left"), *cols, *vals)


def range_bits(rows: int, rows_per_range: int) -> tuple[int, int]:
    """(bits of the coarse ranges, bits of the finest ones) for so many rows: the finest hold about ``rows_per_range``."""
    coarse = 4 if rows < 1 << 22 else COARSE_BITS
    need = max(0, math.ceil(math.log2(max(rows / rows_per_range, 1))))
    return coarse, min(40, max(coarse, need))


def laid_out(records: DataFrame, keys: list[str], fields: list[Field], rows: int, coarse: int, bits: int) -> DataFrame:
    """Distinct records with their coarse (``top``) and finest (``leaf``) range and checksum ``term``, staged with one coarse range a file.

    A coarse range has as many files as its share of the rows asks for, by the term,
    so a key with many versions is spread too.
    """
    rounded = [F.col(f"v_{i}") if f.tolerance is None else F.round(F.col(f"v_{i}") / f.tolerance) for i, f in enumerate(fields)]
    present = [F.col(f"v_{i}").isNull() for i in range(len(fields))]
    parts = max(1, math.ceil(rows / (1 << coarse) / 1_000_000))
    own = records.distinct().withColumn("leaf", F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits)).withColumn("term", F.xxhash64(*keys, *rounded, *present))
    own = own.withColumn("top", F.shiftrightunsigned("leaf", bits - coarse).cast("int"))
    place = (F.col("top") * parts + F.pmod(F.col("term"), F.lit(parts))).cast("int")
    return stage(own.repartitionById((1 << coarse) * parts, place), "ranges")


def range_checksums(rows: DataFrame, size: int, bits: int) -> DataFrame:
    """(``range``, ``n_left``, ``sum_left``, ``n_right``, ``sum_right``): both sides' records and checksums of ranges of ``size`` bits.

    Terms of a side are distinct, so their exclusive or is a checksum that does not
    depend on their order and cannot overflow.
    """
    mine = F.col("is_left")
    return rows.groupBy(F.shiftrightunsigned("leaf", bits - size).alias("range")).agg(
        F.count_if(mine).alias("n_left"),
        F.bit_xor(F.when(mine, F.col("term")).otherwise(F.lit(0).cast("long"))).alias("sum_left"),
        F.count_if(~mine).alias("n_right"),
        F.bit_xor(F.when(~mine, F.col("term")).otherwise(F.lit(0).cast("long"))).alias("sum_right"),
    )


DIFFER = "n_left <> n_right OR sum_left <> sum_right"


def compared_ranges(rows: DataFrame, coarse: int, bits: int) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """The levels of the descent, coarse to fine, and the records of the finest ranges that differ.

    A level is (bits, ``range_checksums`` of the ranges compared there).  The ids of
    the coarse ranges that differ (at most 2 ** COARSE_BITS) come to the driver, so
    that files of the others are not opened again; a finer level only reads what lies
    in ranges that differ on the level above it.  Where the copies agree there is no
    finer level and no record.
    """
    levels = [(coarse, range_checksums(rows, coarse, bits))]
    wrong = sorted(r["range"] for r in levels[0][1].filter(DIFFER).select("range").collect())
    inside = rows.filter(F.col("top").isin(wrong)) if wrong else rows.limit(0)
    while wrong and levels[-1][0] < bits:
        size = min(bits, levels[-1][0] + FAN_BITS)
        levels.append((size, range_checksums(_within(inside, levels, bits), size, bits)))
    return levels, _within(inside, levels, bits)


def _within(inside: DataFrame, levels: list[tuple[int, DataFrame]], bits: int) -> DataFrame:
    """The records in ranges that differ on the last of ``levels``; of the coarse ranges only those that differ are left already."""
    if len(levels) == 1:
        return inside
    size, compared = levels[-1]
    parents = compared.filter(DIFFER).select(F.col("range").alias("parent"))
    return inside.join(parents, F.shiftrightunsigned("leaf", bits - size) == F.col("parent"), "left_semi")


def _same_number(x: Column, y: Column, tolerance: float) -> Column:
    return x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))


def _by_sets(records: DataFrame, keys: list[str], fields: list[Field]) -> DataFrame:
    """(keys, ``place``): fields of keys with several versions whose sets of values differ.

    A text needs its equal on the other side, a number one within the tolerance.
    Every value is a row of its own, so no key's versions are collected; numbers are
    looked up by cells as wide as the tolerance, in the own cell and both next to it.
    """
    entries = []
    for i, f in enumerate(fields):
        v = F.col(f"v_{i}")
        if f.tolerance is None:
            cells = [v] * 3
            value = F.lit(0.0)
        else:
            q = v / f.tolerance if f.tolerance else v
            cell = F.when(F.abs(q) < 9e15, F.floor(q).cast("double")).otherwise(q) if f.tolerance else v + 0.0
            cells, value = [F.xxhash64(cell + d) for d in (-1.0, 0.0, 1.0)], v
        entries.append(F.struct(F.lit(i).alias("place"), v.isNull().alias("none"), *[F.when(v.isNotNull(), c).alias(n) for c, n in zip(cells, ("under", "cell", "over"))], F.when(v.isNotNull(), value).alias("value")))
    each = records.select("is_left", *keys, F.explode(F.array(*entries)).alias("e")).select("is_left", *keys, "e.*").distinct()
    tolerances = F.element_at(F.array(*[F.lit(float(f.tolerance or 0.0)) for f in fields]), F.col("x.place") + 1)
    unmatched = None
    for left in (True, False):
        mine, other = each.filter(F.col("is_left") == left).alias("x"), each.filter(F.col("is_left") != left)
        spans = other.groupBy(*keys, "place", "none", "under", "cell", "over").agg(F.min("value").alias("low"), F.max("value").alias("high"))
        near = spans.select(*keys, "place", "none", "low", "high", F.explode(F.array_distinct(F.array("under", "cell", "over"))).alias("at")).alias("y")
        on = (F.col("x.place") == F.col("y.place")) & (F.col("x.none") == F.col("y.none")) & F.col("x.cell").eqNullSafe(F.col("y.at")) & (_same_number(F.col("x.value"), F.col("y.low"), tolerances) | _same_number(F.col("x.value"), F.col("y.high"), tolerances))
        for k in keys:
            on = on & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
        lone = mine.join(near, on, "left_anti").select(*keys, "place")
        unmatched = lone if unmatched is None else unmatched.unionByName(lone)
    return unmatched.distinct()


def compare_copies(left: DataFrame, right: DataFrame, keys: dict[str, str | None], fields: list[Field], missing_left: str, missing_right: str, rows_per_range: int = 8) -> DataFrame:
    """One row per difference: the keys and ``diff_kind``.

    keys: column name to "number" (compared as a zero-padded number) or None (as it
    is); diff_kind is ``missing_right`` for a key only ``left`` has, ``missing_left``
    for one only ``right`` has, or the name of a differing field.  Repeated records
    of a side count once.  Of a key with several versions on a side, a field differs
    where the sets of its values do.  Null equals only null, in keys as well.  Texts
    are compared as ``plain_text``, by 64-bit hashes, numbers within the field's
    tolerance.  Empty tables are copies of one another.
    """
    made = {f"k_{n}": number_key(F.col(k)) if how == "number" else F.col(k) for n, (k, how) in enumerate(keys.items())}
    names = list(made)
    total = left.count() + right.count()
    coarse, bits = range_bits(total, 2 * rows_per_range)
    rows = laid_out(_side(left, made, fields, True).unionByName(_side(right, made, fields, False)), names, fields, total, coarse, bits)
    _, inside = compared_ranges(rows, coarse, bits)
    mine = F.col("is_left")
    values = [F.min(F.when(mine == left, F.col(f"v_{i}"))).alias(f"{side}_{i}") for i in range(len(fields)) for side, left in (("l", True), ("r", False))]
    per_key = stage(inside.groupBy(*names).agg(F.count_if(mine).alias("n_left"), F.count_if(~mine).alias("n_right"), *values), "compared")
    one = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    kinds = [F.when(F.col("n_right") == 0, F.lit(missing_right)), F.when(F.col("n_left") == 0, F.lit(missing_left))]
    for i, f in enumerate(fields):
        x, y = F.col(f"l_{i}"), F.col(f"r_{i}")
        kinds.append(F.when(one & ~(x.eqNullSafe(y) if f.tolerance is None else _same_number(x, y, f.tolerance)), F.lit(f.name)))
    found = per_key.select(*names, F.explode(F.array_compact(F.array(*kinds))).alias("diff_kind"))
    several = per_key.filter("n_left > 0 AND n_right > 0 AND (n_left > 1 OR n_right > 1)").select(*[F.col(k).alias(f"s_{k}") for k in names])
    if not several.isEmpty():
        on = None
        for k in names:
            same = F.col(k).eqNullSafe(F.col(f"s_{k}"))
            on = same if on is None else on & same
        sets = _by_sets(inside.join(several, on, "left_semi"), names, fields)
        found = found.unionByName(sets.select(*names, F.element_at(F.array(*[F.lit(f.name) for f in fields]), F.col("place") + 1).alias("diff_kind")))
    return found.select(*[F.col(k).alias(own) for k, own in zip(names, keys)], "diff_kind")
