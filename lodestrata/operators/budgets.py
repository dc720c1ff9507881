"""Byte budgets of packed key-value storage, protection under them, and reports on both.

Keys are packed in groups of tokens per channel, values per token in groups of
channels; what is newer than the residual stays at full width.  All of it works on
one row per sequence.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import token_budget_mask
from ..functions.columns import effective_bits, let, path_terms, simple_tokens, structure_score
from .aggregates import nearest_percentile

TARGETS = ("both", "keys", "values")


@dataclass(frozen=True)
class StorageShape:
    """Shape and formats of a packed cache."""

    layers: int
    heads: int
    dim: int
    group: int
    residual: int
    key_bits: int
    value_bits: int
    protected_bits: int = 16
    scalar_bytes: int = 2
    target: str = "both"

    def __post_init__(self) -> None:
        if min(self.layers, self.heads, self.dim, self.group, self.residual, self.scalar_bytes) <= 0:
            raise ValueError("sizes must be positive")
        if self.residual % self.group or self.dim % self.group:
            raise ValueError("the group must divide the residual and the head dimension")
        if self.target not in TARGETS:
            raise ValueError(f"target is one of {TARGETS}")

    def _bytes(self, scalars: int, bits: int, scales: int) -> int:
        if bits >= 16:
            return scalars * self.scalar_bytes
        return -(-scalars * bits // 8) + 2 * scales * self.scalar_bytes

    def key_group(self, bits: int) -> int:
        """Bytes of one group of key tokens over all layers and heads; each channel has a scale and a minimum."""
        rows = self.layers * self.heads
        return self._bytes(rows * self.group * self.dim, bits, rows * self.dim)

    def value_token(self, bits: int) -> int:
        """Bytes of the values of one token."""
        rows = self.layers * self.heads
        return self._bytes(rows * self.dim, bits, rows * self.dim // self.group)

    @property
    def full_token(self) -> int:
        """Bytes of one token's keys, or values, at full width."""
        return self.layers * self.heads * self.dim * self.scalar_bytes


def _sealed(shape: StorageShape, n: Column) -> tuple[Column, Column]:
    """Key and value tokens that are packed."""
    return n - n % shape.residual, F.greatest(n - shape.residual, F.lit(0))


def _places(mask: Column, limit: Column) -> Column:
    """Set places of a mask below a limit."""
    marked = F.transform(mask, lambda m, i: F.when(F.coalesce(m, F.lit(False)) & (i < limit), i))
    return F.filter(marked, lambda i: i.isNotNull())


def stored_bytes(shape: StorageShape, n: Column, mask: Column | None = None) -> Column:
    """Bytes of a sequence of n tokens with the masked places protected; 0 for n <= 0."""
    keys, values = _sealed(shape, n)
    key_up = value_up = F.lit(0)
    if mask is not None and shape.target != "values":
        key_up = F.size(F.array_distinct(F.transform(_places(mask, keys), lambda i: F.floor(i / shape.group))))
    if mask is not None and shape.target != "keys":
        value_up = F.size(_places(mask, values))
    groups = F.floor(keys / shape.group)
    total = (groups - key_up) * shape.key_group(shape.key_bits) + key_up * shape.key_group(shape.protected_bits)
    total = total + (values - value_up) * shape.value_token(shape.value_bits) + value_up * shape.value_token(shape.protected_bits)
    total = total + (2 * n - keys - values) * shape.full_token
    return F.when(n > 0, total).otherwise(0).cast("long")


def target_bytes(shape: StorageShape, n: Column, mean_bits: float | Column) -> Column:
    """Bytes that a mean number of bits per scalar allows."""
    bits = mean_bits if isinstance(mean_bits, Column) else F.lit(float(mean_bits))
    return F.floor(bits * (2 * n * shape.layers * shape.heads * shape.dim) / 8)


def ordered_candidates(candidates: Column, scores: Column | None, order: str) -> Column:
    """Set places in the order prefix, recent or score (descending, ties by place)."""
    if order not in ("prefix", "recent", "score"):
        raise ValueError("order is prefix, recent or score")
    if order == "score":
        if scores is None:
            raise ValueError("ordering by score needs scores")
        keyed = F.zip_with(candidates, scores, lambda c, s: F.struct(c.alias("c"), (-s.cast("double")).alias("s")))
        places = F.transform(keyed, lambda x, i: F.struct(x["s"].alias("s"), i.alias("i"), x["c"].alias("c")))
        return F.transform(F.array_sort(F.filter(places, lambda x: F.coalesce(x["c"], F.lit(False)))), lambda x: x["i"])
    places = _places(candidates, F.size(candidates))
    return F.reverse(places) if order == "recent" else places


def byte_budget_mask(shape: StorageShape, candidates: Column, order: str, mean_bits: float | Column, scores: Column | None = None) -> Column:
    """Mask of candidates that fit a byte target, taken greedily in order.

    The first protected token of a key group pays for the whole group, further ones
    of it only for their value; a token that does not fit is skipped, later ones may
    still fit; a token that costs nothing is not marked.
    """
    key_step = max(0, shape.key_group(shape.protected_bits) - shape.key_group(shape.key_bits)) if shape.target != "values" else 0
    value_step = max(0, shape.value_token(shape.protected_bits) - shape.value_token(shape.value_bits)) if shape.target != "keys" else 0
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).cast("long").alias("spent"), none.alias("groups"), none.alias("taken"))
    n = F.size(candidates)
    keys, values = _sealed(shape, n)
    limits = F.struct(keys.alias("keys"), values.alias("values"), (target_bytes(shape, n, mean_bits) - stored_bytes(shape, n)).alias("room"))

    def step(state: Column, i: Column, limit: Column) -> Column:
        group = F.floor(i / shape.group).cast("int")
        opens = (i < limit["keys"]) & ~F.array_contains(state["groups"], group) & F.lit(key_step > 0)
        cost = F.when(opens, key_step).otherwise(0) + F.when(i < limit["values"], value_step).otherwise(0)
        takes = (cost > 0) & (state["spent"] + cost <= limit["room"])
        return F.struct(
            F.when(takes, state["spent"] + cost).otherwise(state["spent"]).cast("long").alias("spent"),
            F.when(takes & opens, F.array_append(state["groups"], group)).otherwise(state["groups"]).alias("groups"),
            F.when(takes, F.array_append(state["taken"], i.cast("int"))).otherwise(state["taken"]).alias("taken"),
        )

    taken = let(limits, lambda limit: F.aggregate(ordered_candidates(candidates, scores, order), start, lambda s, i: step(s, i, limit), lambda s: s["taken"]))
    return let(taken, lambda t: F.transform(candidates, lambda _, i: F.array_contains(t, i.cast("int"))))


def full_precision_bytes(recorded: Column, prompt: Column, generated: Column, prefix: Column, residual: Column, layers: Column, heads: Column, dim: Column) -> Column:
    """Bytes at full precision: as recorded, else from tokens, else from the sealed prefix and the residual; null or 0 sizes take 28, 4 and 128."""
    known = F.coalesce(prompt, F.lit(0)) + F.coalesce(generated, F.lit(0))
    tokens = F.when(known > F.coalesce(generated, F.lit(0)), known).otherwise(F.greatest(known.cast("double"), F.coalesce(prefix, F.lit(0)) + F.coalesce(residual, F.lit(0))))
    size = lambda c, d: F.coalesce(F.nullif(c, F.lit(0)), F.lit(d))
    return F.coalesce(F.when(recorded > 0, recorded.cast("double")), tokens * size(layers, 28) * size(heads, 4) * size(dim, 128) * 4.0)


def budget_per_task(tasks: DataFrame, key: str, prompt: str, paths: str, base: int, high: int, residual: int, mean_bits: float, order: str, tokenize: Callable[[Column], Column] = simple_tokens) -> DataFrame:
    """Per task: tokens, candidate and protected ones, the share of score protected, and the effective bits under a token budget.

    tokenize: a text column to an array of token texts; a tokenizer's own goes in as a
    pandas function.
    """
    terms = F.flatten(F.transform(F.coalesce(F.col(paths), F.array().cast("array<string>")), path_terms))
    t = tasks.select(F.col(key), tokenize(F.col(prompt)).alias("words"), F.array_distinct(F.transform(terms, lambda x: x["term"])).alias("terms"))
    t = t.withColumn("scores", F.transform("words", lambda x: structure_score(x, F.col("terms")))).withColumn("candidates", F.transform("scores", lambda s: s > 0))
    t = t.withColumn("mask", token_budget_mask(F.col("candidates"), F.col("scores"), order, base, high, residual, mean_bits))
    n = F.size("words")
    total = lambda mask: F.aggregate(F.zip_with(mask, "scores", lambda m, s: F.when(m, s).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    older = F.transform("candidates", lambda c, i: c & (i < n - residual))
    protected = F.size(F.filter("mask", lambda m: m))
    return t.select(
        key,
        n.alias("tokens"),
        F.size("terms").alias("n_terms"),
        F.size(F.filter("candidates", lambda c: c)).alias("n_candidates"),
        protected.alias("n_protected"),
        F.coalesce(F.try_divide(total(F.col("mask")), total(older)), F.lit(0.0)).alias("score_share"),
        effective_bits(n, protected, F.lit(residual), F.lit(base), F.lit(high)).alias("bits"),
    )


def budget_summary(per_task: DataFrame) -> DataFrame:
    """One row: means over tasks and the nearest-rank 90th percentile of tokens."""
    one = per_task.withColumn("all_rows", F.lit(1))
    means = one.groupBy("all_rows").agg(F.count("*").alias("n_rows"), F.round(F.avg("tokens"), 2).alias("mean_tokens"), F.round(F.avg(F.coalesce(F.try_divide("n_protected", "tokens"), F.lit(0.0))), 4).alias("mean_protected_share"), F.round(F.avg("score_share"), 4).alias("mean_score_share"), F.round(F.avg("bits"), 4).alias("mean_bits"), F.round(F.avg(F.coalesce(F.try_divide(F.lit(16.0), "bits"), F.lit(0.0))), 4).alias("mean_compression"))
    return means.join(nearest_percentile(one, ["all_rows"], "tokens", 0.9, "p90_tokens"), "all_rows", "left").drop("all_rows")


def setting_summary(rows: DataFrame, setting: Column, parsed: str, path: str, score: str, hit_limit: Column) -> DataFrame:
    """Per setting: rows, and over rows with a parse outcome the parse, path and score means; 0 where there is none."""
    has = F.col(parsed).isNotNull()
    mean = lambda c: F.coalesce(F.avg(F.when(has, c)), F.lit(0.0))
    return rows.groupBy(setting.alias("setting")).agg(
        F.count("*").alias("n_rows"),
        F.round(mean((F.col(parsed) == 1).cast("double")), 6).alias("parse_share"),
        F.round(mean(F.coalesce(path, F.lit(0.0))), 6).alias("mean_path"),
        F.round(mean(F.coalesce(score, F.lit(0.0))), 6).alias("mean_score"),
        F.round(F.avg(F.coalesce(hit_limit, F.lit(False)).cast("double")), 6).alias("limit_share"),
    )


def quantised_cache(rows: DataFrame, group: list[str], values: str, bits: int, axis: str = "token", eps: float = 1e-8) -> DataFrame:
    """``rows`` with ``quantised``: symmetric quantisation with one scale per token (the row) or per channel (a place of the array over a group's rows).

    Channel scales are aggregated place by place with map-side combining and joined
    back as one short array per group.
    """
    if axis not in ("token", "channel"):
        raise ValueError("axis is token or channel")
    top = float(2 ** (bits - 1) - 1)
    if bits >= 16:
        return rows.withColumn("quantised", F.transform(values, lambda x: x.cast("double")))
    fit = lambda x, s: F.least(F.greatest(F.rint(x.cast("double") / s), F.lit(-top)), F.lit(top)) * s
    if axis == "token":
        scale = F.greatest(F.array_max(F.transform(values, lambda x: F.abs(x.cast("double")))), F.lit(eps)) / top
        return rows.withColumn("quantised", let(scale, lambda s: F.transform(values, lambda x: fit(x, s))))
    peaks = rows.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.posexplode(values).alias("_i", "_x")).groupBy(*[f"_g{i}" for i in range(len(group))], "_i").agg(F.max(F.abs(F.col("_x").cast("double"))).alias("_m"))
    scales = peaks.groupBy(*[f"_g{i}" for i in range(len(group))]).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda p: F.greatest(p["_m"], F.lit(eps)) / top).alias("_scales"))
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & rows[g].eqNullSafe(scales[f"_g{i}"])
    joined = rows.join(scales, on, "left").drop(*[f"_g{i}" for i in range(len(group))])
    return joined.withColumn("quantised", F.zip_with(values, "_scales", fit)).drop("_scales")


def compression(shape: StorageShape, n: int) -> float:
    """Full width over packed bytes of n unprotected tokens, on the driver."""
    keys, values = n - n % shape.residual, max(0, n - shape.residual)
    packed = keys // shape.group * shape.key_group(shape.key_bits) + values * shape.value_token(shape.value_bits) + (2 * n - keys - values) * shape.full_token
    return math.nan if not packed else 2 * n * shape.full_token / packed
