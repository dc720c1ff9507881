"""Quantisation, bit packing and byte accounting on arrays, with higher-order functions.

Arrays are rows of a tensor: one row per (layer, head, token).  Everything works in
the row, so no shuffle is needed; per-channel scales over tokens come from an
aggregate by channel and are passed in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

SUPPORTED_BITS = (2, 4, 8, 16)


def symmetric(values: Column, bits: int, eps: float = 1e-8) -> Column:
    """Values after symmetric quantisation with one scale per array, rounded half to even; 16 bits and more change nothing.

    Fewer than 2 bits are an error.  Null arrays stay null, null elements too.
    """
    if bits < 2:
        raise ValueError("at least 2 bits are needed")
    if bits >= 16:
        return values
    top = float(2 ** (bits - 1) - 1)
    scale = F.greatest(F.array_max(F.transform(values, lambda x: F.abs(x.cast("double")))), F.lit(eps)) / top
    return let(scale, lambda s: F.transform(values, lambda x: F.least(F.greatest(F.rint(x / s), F.lit(-top)), F.lit(top)) * s))


def symmetric_recent(values: Column, bits: int, residual: int, protected: Column | None = None, high_bits: int = 8) -> Column:
    """``symmetric`` on all but the last ``residual`` elements; protected ones (a mask aligned at the right) get ``high_bits``."""
    low, high = symmetric(values, bits), symmetric(values, high_bits)
    size = F.size(values)

    def pick(pair: Column, i: Column) -> Column:
        return F.when(i >= size - residual, pair["values"].cast("double")).when(pair["m"], pair["high"]).otherwise(pair["low"])

    mask = F.transform(values, lambda _: F.lit(False)) if protected is None else F.concat(F.array_repeat(F.lit(False), F.greatest(size - F.size(protected), F.lit(0))), protected)
    zipped = F.arrays_zip(values.alias("values"), low.alias("low"), high.alias("high"), mask.alias("m"))
    return F.transform(zipped, pick)


def sealed_prefix(prefix: Column, length: Column, residual: int, block: int) -> Column:
    """Elements sealed after whole blocks beyond the residual are sealed; an incomplete block waits."""
    evictable = F.greatest(length - residual - prefix, F.lit(0))
    return (prefix + F.floor(evictable / block) * block).cast("int")


def groups(values: Column, size: int) -> Column:
    """An array cut into groups of ``size``; its length must be a multiple."""
    ok = F.size(values) % size == 0
    cut = F.transform(F.sequence(F.lit(0), F.greatest((F.size(values) / size).cast("int") - 1, F.lit(0))), lambda g: F.slice(values, g * size + 1, F.lit(size)))
    return F.when(ok & (F.size(values) > 0), cut).when(F.size(values) == 0, F.array().cast("array<array<double>>")).when(values.isNotNull(), F.raise_error(F.lit("the group size must divide the length")).cast("array<array<double>>"))


def affine(group: Column, bits: int) -> Column:
    """struct(codes, scale, minimum) of a group: codes from 0 to 2^bits - 1, rounded half to even; a constant group has scale 1."""
    if bits not in SUPPORTED_BITS:
        raise ValueError(f"bits must be one of {SUPPORTED_BITS}")
    top = float(2**bits - 1)
    low, high = F.array_min(group).cast("double"), F.array_max(group).cast("double")
    ends = F.struct(F.when(high > low, (high - low) / top).otherwise(1.0).alias("scale"), low.alias("minimum"))

    def coded(e: Column) -> Column:
        codes = F.transform(group, lambda x: F.least(F.greatest(F.rint((x.cast("double") - e["minimum"]) / e["scale"]), F.lit(0.0)), F.lit(top)).cast("int"))
        return F.struct(codes.alias("codes"), e["scale"].alias("scale"), e["minimum"].alias("minimum"))

    return let(ends, coded)


def affine_blocks(values: Column, bits: int, group_size: int) -> Column:
    """``affine`` of every group."""
    return F.transform(groups(values, group_size), lambda g: affine(g, bits))


def restored(block: Column) -> Column:
    """Values of an ``affine`` block."""
    return F.transform(block["codes"], lambda c: c * block["scale"] + block["minimum"])


def packed(codes: Column, bits: int) -> Column:
    """Bytes (as ints) of codes, the first code in the lowest bits, padded with zeros; 8 and 16 bits are one and two bytes each."""
    if bits == 16:
        return F.flatten(F.transform(codes, lambda c: F.array(c.bitwiseAND(255), F.shiftright(c, 8))))
    per = 8 // bits
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(codes) / per).cast("int") - 1, F.lit(0)))

    def one(g: Column) -> Column:
        part = F.slice(codes, g * per + 1, F.lit(per))
        return F.aggregate(F.transform(part, lambda c, i: (c * F.pow(F.lit(2), i * bits)).cast("int")), F.lit(0), lambda a, x: a.bitwiseOR(x))

    return F.when(F.size(codes) == 0, F.array().cast("array<int>")).otherwise(F.transform(starts, one))


def unpacked(data: Column, bits: int, count: Column) -> Column:
    """Codes of packed bytes; ``data`` should be a column or a bound value."""
    if bits == 16:
        pairs = F.sequence(F.lit(0), F.greatest((F.size(data) / 2).cast("int") - 1, F.lit(0)))
        return F.transform(pairs, lambda i: F.element_at(data, i * 2 + 1) + F.element_at(data, i * 2 + 2) * 256)
    per = 8 // bits
    codes = F.flatten(F.transform(data, lambda b: F.array(*[F.shiftright(b, bits * i).bitwiseAND(2**bits - 1) for i in range(per)])))
    return F.slice(codes, F.lit(1), count)


def packed_bytes(elements: Column, bits: int, group_size: int, scale_bytes: int = 2) -> Column:
    """struct(payload, scale, minimum) bytes of so many elements."""
    n = F.ceil(elements / group_size)
    return F.struct(F.ceil(elements * bits / 8).cast("long").alias("payload"), (n * scale_bytes).cast("long").alias("scale"), (n * scale_bytes).cast("long").alias("minimum"))


def top_with_margin(scores: Column, ids: Column, k: int) -> Column:
    """struct(top, margin): the k best (score, id) and the lead of the first over the second; ties go to the greater id."""
    pairs = F.zip_with(scores, ids, lambda s, i: F.struct(s.alias("score"), i.alias("id")))
    ranked = F.slice(F.sort_array(pairs, asc=False), 1, k)
    return F.struct(ranked.alias("top"), F.when(F.size(ranked) >= 2, ranked[0]["score"] - ranked[1]["score"]).alias("margin"))


def log_softmax(scores: Column) -> Column:
    """Log probabilities of scores, safe for large ones."""
    def shifted(high: Column) -> Column:
        total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - high))
        return let(high + F.log(total), lambda norm: F.transform(scores, lambda x: x.cast("double") - norm))

    return let(F.array_max(scores).cast("double"), shifted)


def first_within_budget(costs: Column, budget: Column) -> Column:
    """Places (from 0) taken in order while a budget lasts; a cost that does not fit is skipped, not the end."""
    start = F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<int>").alias("taken"))
    indexed = F.transform(costs, lambda c, i: F.struct(c.cast("double").alias("c"), i.alias("i")))

    def step(a: Column, x: Column) -> Column:
        fits = a["spent"] + x["c"] <= budget
        return F.struct(F.when(fits, a["spent"] + x["c"]).otherwise(a["spent"]).alias("spent"), F.when(fits, F.array_append(a["taken"], x["i"])).otherwise(a["taken"]).alias("taken"))

    return F.aggregate(indexed, start, step, lambda a: a["taken"])


def token_budget_mask(candidates: Column, scores: Column, order: str, base: int, high: int, residual: int, target: float, full: int = 16) -> Column:
    """Mask of older candidates that a mean-bits target pays for, in the order prefix, recent or score.

    The last ``residual`` places are at full width anyway.  The extra bits that the
    target leaves beyond the base buy floor(extra / (high - base)) places.
    """
    n = F.size(candidates)
    older = F.greatest(n - residual, F.lit(0))
    extra = F.lit(float(target)) * n - older * base - F.least(n, F.lit(residual)) * full
    buys = F.greatest(F.floor(extra / (high - base)), F.lit(0))
    places = F.filter(F.transform(F.arrays_zip(candidates.alias("c"), scores.alias("s")), lambda x, i: F.struct(x["c"].alias("c"), x["s"].cast("double").alias("s"), i.alias("i"))), lambda x: x["c"] & (x["i"] < older))
    if order == "prefix":
        key = F.transform(places, lambda x: F.struct(x["i"].cast("double").alias("k"), x["i"].alias("i")))
    elif order == "recent":
        key = F.transform(places, lambda x: F.struct((-x["i"]).cast("double").alias("k"), x["i"].alias("i")))
    elif order == "score":
        key = F.transform(places, lambda x: F.struct((-x["s"]).alias("k"), x["i"].alias("i")))
    else:
        raise ValueError("order is prefix, recent or score")
    taken = F.transform(F.slice(F.array_sort(key), F.lit(1), buys.cast("int")), lambda x: x["i"])
    return let(taken, lambda t: F.transform(candidates, lambda _, i: F.array_contains(t, i)))
