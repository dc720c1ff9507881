"""Strict and lenient pairing of a baseline with candidates, and what follows from pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import parse_transition, parsed_ok, score_or_zero, transition

CONSISTENT = ("input_type", "output_type", "query", "generation_protocol")


def latest_per(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row per key: the newest by the given descending order (end it with a unique column)."""
    w = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn("_latest", F.row_number().over(w)).filter("_latest = 1").drop("_latest")


def pair_violations(base: DataFrame, cand: DataFrame, key: str, fields: tuple[str, ...] = CONSISTENT, ordinal: str | None = None) -> DataFrame:
    """(``violation``, ``key_text``, ``rows``): all that forbids a strict 1:1 pairing; no rows means it is allowed.

    Kinds: null_key and duplicate_key of either side, missing_in_base,
    missing_in_candidate, differing_<field> (null equals null), and, where an
    ordinal column is named, differing_order.
    """

    def own(df: DataFrame, side: str) -> DataFrame:
        nulls = df.filter(F.col(key).isNull()).groupBy().agg(F.count("*").alias("rows")).filter("rows > 0").select(F.lit(f"null_key_in_{side}").alias("violation"), F.lit(None).cast("string").alias("key_text"), "rows")
        dups = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1").select(F.lit(f"duplicate_key_in_{side}").alias("violation"), F.col(key).cast("string").alias("key_text"), "rows")
        return nulls.unionByName(dups)

    cols = [*fields, *([ordinal] if ordinal else [])]
    b = base.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.lit(True).alias("in_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    c = cand.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.lit(True).alias("in_c"), *[F.col(x).alias(f"c_{x}") for x in cols])
    joined = b.join(c, "k", "full_outer")
    both = F.col("in_b").isNotNull() & F.col("in_c").isNotNull()
    kinds = [F.when(F.col("in_b").isNull(), "missing_in_base"), F.when(F.col("in_c").isNull(), "missing_in_candidate")]
    kinds += [F.when(both & ~F.col(f"b_{x}").eqNullSafe(F.col(f"c_{x}")), f"differing_{x}") for x in fields]
    if ordinal:
        kinds.append(F.when(both & ~F.col(f"b_{ordinal}").eqNullSafe(F.col(f"c_{ordinal}")), "differing_order"))
    found = joined.select(F.explode(F.array_compact(F.array(*kinds))).alias("violation"), F.col("k").cast("string").alias("key_text")).groupBy("violation", "key_text").agg(F.count("*").alias("rows"))
    return own(base, "base").unionByName(own(cand, "candidate")).unionByName(found)


def strict_pairs(base: DataFrame, cand: DataFrame, key: str, fields: tuple[str, ...] = CONSISTENT, ordinal: str | None = None) -> DataFrame:
    """``key``, ``base`` and ``cand`` (structs); raises where a violation exists, naming the first twenty."""
    bad = pair_violations(base, cand, key, fields, ordinal).orderBy("violation", "key_text").limit(20).collect()
    if bad:
        raise ValueError("the sides cannot be paired: " + "; ".join(f"{r['violation']} {r['key_text']}" for r in bad))
    return lenient_pairs(base, cand, key)


def lenient_pairs(base: DataFrame, cand: DataFrame, key: str) -> DataFrame:
    """Inner pairs on the key; null keys pair with nothing."""
    b = base.select(F.col(key), F.struct("*").alias("base"))
    c = cand.select(F.col(key), F.struct("*").alias("cand"))
    return b.join(c, key)


def positional_pairs(base: DataFrame, cand: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Pairs by ordinal; raises where the ordered key lists differ."""
    b, c = base.select(F.col(ordinal), F.struct("*").alias("base")), cand.select(F.col(ordinal), F.struct("*").alias("cand"))
    joined = b.join(c, ordinal, "full_outer")
    off = joined.filter(~F.col(f"base.{key}").eqNullSafe(F.col(f"cand.{key}"))).orderBy(ordinal).limit(5).collect()
    if off:
        raise ValueError(f"the key lists differ at {[r[ordinal] for r in off]}")
    return joined


def scored(pairs: DataFrame, score: str = "final_eval_score", render: str = "render_score", path: str = "key_validation_score") -> DataFrame:
    """Pairs with deltas and transitions of score, path score and parsing."""
    b, c = (lambda n: F.col(f"base.{n}")), (lambda n: F.col(f"cand.{n}"))
    return (
        pairs.withColumn("base_score", score_or_zero(b(score)))
        .withColumn("cand_score", score_or_zero(c(score)))
        .withColumn("score_delta", F.col("cand_score") - F.col("base_score"))
        .withColumn("path_delta", score_or_zero(c(path)) - score_or_zero(b(path)))
        .withColumn("base_parsed", parsed_ok(b(render)))
        .withColumn("cand_parsed", parsed_ok(c(render)))
        .withColumn("score_transition", transition(b(score), c(score)))
        .withColumn("path_transition", transition(b(path), c(path)))
        .withColumn("parse_transition", parse_transition(F.col("base_parsed"), F.col("cand_parsed")))
    )


def transition_report(pairs: DataFrame, *groups: str) -> DataFrame:
    """Counts of every transition and mean deltas, by the given columns."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    return pairs.groupBy(*groups).agg(
        F.count("*").alias("pairs"),
        *[n("parse_transition", v).alias(f"parse_{v}") for v in ("both_pass", "baseline_only", "candidate_only", "both_fail")],
        *[n("score_transition", v).alias(f"score_{v}") for v in ("improved", "regressed", "unchanged")],
        *[n("path_transition", v).alias(f"path_{v}") for v in ("improved", "regressed", "unchanged")],
        F.avg("score_delta").alias("mean_score_delta"),
        F.avg("path_delta").alias("mean_path_delta"),
    )


def induced_failures(pairs: DataFrame) -> DataFrame:
    """Pairs whose baseline parsed and whose candidate did not."""
    return pairs.filter(F.col("base_parsed") & ~F.col("cand_parsed"))


def worst(pairs: DataFrame, k: int, by: str, *tie: str) -> DataFrame:
    """The k lowest by a column, ties by further columns; a top-k, so never a full sort."""
    return pairs.orderBy(F.col(by).asc_nulls_last(), *tie).limit(k)


def manifest_rows(source: DataFrame, manifest: DataFrame, key: str, place: str, ordinal: str, agree: tuple[str, ...] = ("input_type", "output_type"), most_rows: int = 1_000_000) -> DataFrame:
    """Source rows in the manifest's order, with its columns as ``manifest_<name>``.

    The last source row of a repeated key wins.  A manifest key that the source
    lacks, or a type that differs, is an error.  The manifest is broadcast where it
    has at most ``most_rows`` rows, else joined by shuffle.
    """
    one = latest_per(source.filter(F.col(key).isNotNull()), [key], [F.col(ordinal).desc()])
    m = manifest.select(*[F.col(c).alias(f"manifest_{c}") for c in manifest.columns])
    m = F.broadcast(m) if manifest.limit(most_rows + 1).count() <= most_rows else m
    joined = m.join(one, m[f"manifest_{key}"] == one[key], "left")
    ok = F.col(key).isNotNull()
    for c in agree:
        ok = ok & F.col(c).eqNullSafe(F.col(f"manifest_{c}"))
    checked = F.when(ok, F.col(f"manifest_{place}")).otherwise(F.raise_error(F.concat(F.lit("no matching source row for "), F.coalesce(F.col(f"manifest_{key}").cast("string"), F.lit("null")))).cast("bigint"))
    return joined.withColumn(f"manifest_{place}", checked)


def unfinished(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs that no finished row has."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def lookup(df: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is wanted, wanted keys without a row)."""
    return df.join(wanted.select(key).distinct(), key, "left_semi"), wanted.select(key).distinct().join(df.select(key), key, "left_anti")


def same_order(df: DataFrame, group: str, key: str, ordinal: str) -> DataFrame:
    """(group, rows, order_hash): two groups list the same keys at the same ordinals iff both agree.

    The hash is a sum of per-row hashes of (ordinal, key), so no list is built and
    no group is sorted; the ordinals must be contiguous (see ``contiguous``).
    """
    return df.groupBy(group).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(F.col(ordinal).cast("long"), key).cast("decimal(38,0)")).cast("string").alias("order_hash"))


def assembled(df: DataFrame, parts: dict[str, list[str]], *keys: str) -> DataFrame:
    """The keys and one struct per part of a result row (run, treatment, outcome, storage); a column that the table lacks is null."""
    have = set(df.columns)
    return df.select(*keys, *[F.struct(*[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in names]).alias(part) for part, names in parts.items()])
