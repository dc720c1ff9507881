"""Samples whose category shares match targets: raking, weighted exponential keys, repair.

A draw names a pool, the margins to go by (one or several category fields), target
shares and least rows per category, and a size.  Pools are reduced to cells (one
per combination of categories) before anything is collected, so the raking sees
counts, never rows:

1. iterative proportional fitting scales the cell counts until every margin has
   its target shares, never beyond what a cell holds; where margins contradict one
   another, the cells get the mean of what each margin asks for;
2. the fitted cell sizes are rounded by largest remainders, and minimums of small
   categories are repaired by swaps with categories that can give rows;
3. each task gets the key -ln(u)/w with u a hash of (draw, task, seed) and w its
   cell's weight; the smallest keys of a cell fill its quota.

Labels are compared without case and outer white space; a null label belongs to no
category (it can be sampled only where targets leave room).  Repeated tasks of a
pool count once.  A draw without pool rows gives an empty sample and reports every
target; an empty table of draws gives empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPACE = r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def normal_label(label: Column) -> Column:
    """The label in lower case without outer white space of any kind."""
    edged = F.regexp_replace(label, rf"^[{_SPACE}]++|[{_SPACE}](?<![{_SPACE}](?s:.))[{_SPACE}]*+\z", "")
    return F.lower(F.when(label.rlike(r"^[!-~](?s:.*[!-~])?\z"), label).otherwise(edged))


def rake(counts: np.ndarray, codes: np.ndarray, targets: list[dict[int, float]], size: float, rounds: int = 200) -> np.ndarray:
    """Fitted cell sizes: ``counts`` scaled so that every margin meets its targets as far as the cells hold them.

    codes[c, m] is the category of cell c in margin m (-1: none); targets[m] maps
    categories to wanted rows.  Cells without a wanted category in a margin that
    has targets for the whole size get nothing.  Margins that the cells cannot meet
    together never settle; then no margin wins, the last round's fits are averaged.
    """
    fit = counts * min(1.0, size / max(counts.sum(), 1))
    for _ in range(rounds):
        before, by_margin = fit.copy(), []
        for m, wanted in enumerate(targets):
            for c in np.unique(codes[:, m]):
                mine = codes[:, m] == c
                want, cap = wanted.get(int(c), 0.0), counts[mine].sum()
                goal = min(want, cap)
                if goal <= 0:
                    fit[mine] = 0
                    continue
                part = np.where(fit[mine] > 0, fit[mine], counts[mine] * 1e-9)
                for _ in range(20):  # scale, cut at what is there, scale the rest again
                    part = np.minimum(part * (goal / part.sum()), counts[mine])
                    if abs(part.sum() - goal) < 1e-9 * max(goal, 1):
                        break
                    free = part < counts[mine] - 1e-12
                    if not free.any():
                        break
                    part[free] *= max(goal - part[~free].sum(), 0) / max(part[free].sum(), 1e-300)
                fit[mine] = np.minimum(part, counts[mine])
            by_margin.append(fit.copy())
        moved = max((np.abs(f - fit).max(initial=0) for f in by_margin), default=0.0)
        if np.abs(fit - before).max(initial=0) < 1e-7:
            break
    return np.mean(by_margin, axis=0) if targets and moved > 1e-3 else fit


def round_and_repair(fit: np.ndarray, counts: np.ndarray, codes: np.ndarray, targets: list[dict[int, float]], least: list[dict[int, int]], size: int) -> np.ndarray:
    """Whole cell quotas of at most ``size`` rows, minimums kept where the cells allow it."""
    quota = np.floor(fit + 1e-9).astype(np.int64)
    total = min(size, int(round(fit.sum())))
    for c in np.argsort(-(fit - quota), kind="stable"):
        if quota.sum() >= total:
            break
        if quota[c] < counts[c] and fit[c] > 0:
            quota[c] += 1
    for m, floors in enumerate(least):
        for cat, low in sorted(floors.items()):
            mine = codes[:, m] == cat
            while quota[mine].sum() < min(low, int(counts[mine].sum())):
                take = np.flatnonzero(mine & (quota < counts))[0]
                if quota.sum() >= size:
                    over = []
                    for d in np.flatnonzero(~mine & (quota > 0)):
                        have = quota[codes[:, m] == codes[d, m]].sum()
                        if all(quota[codes[:, k] == codes[d, k]].sum() > least[k].get(int(codes[d, k]), 0) for k in range(codes.shape[1])):
                            over.append((have - targets[m].get(int(codes[d, m]), 0.0), have, -d))
                    if not over:
                        break
                    quota[-max(over)[2]] -= 1
                quota[take] += 1
    return quota


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Quotas of the cells of one draw and the report on its targets."""
    draw, size = pdf["draw_key"].iloc[0], 0 if pd.isna(pdf["size"].iloc[0]) else int(pdf["size"].iloc[0])
    want = pdf[pdf["cell"].isna()]
    cells = pdf[pdf["cell"].notna()]
    fields = sorted(want["field"].unique())
    labels = {f: {c: i for i, c in enumerate(sorted(set(want.loc[want["field"] == f, "label"].dropna())))} for f in fields}
    split = [dict(zip(x[0::2], x[1::2])) for x in (list(c) for c in cells["cell"])]
    codes = np.array([[labels[f].get(s.get(f), -1) for f in fields] for s in split], np.int64).reshape(len(cells), len(fields))
    counts = cells["available"].to_numpy(float)
    targets, least = [], []
    for f in fields:
        rows = want[want["field"] == f]
        targets.append({labels[f][r.label]: (0.0 if pd.isna(r.share) else float(r.share)) * size for r in rows.itertuples() if r.label in labels[f]})
        least.append({labels[f][r.label]: int(r.min_rows) for r in rows.itertuples() if r.label in labels[f]})
    fit = rake(counts, codes, targets, size) if len(cells) else counts
    quota = round_and_repair(fit, counts, codes, targets, least, size) if len(cells) else counts.astype(np.int64)
    out = [(draw, list(c), int(q), float(max(f, 1e-9) / max(n, 1)), None, None, None, None, None, None, None, None) for c, q, f, n in zip(cells["cell"], quota, fit, counts)]
    for r in want.itertuples():
        m = fields.index(r.field)
        mine = codes[:, m] == labels[r.field].get(r.label, -2)
        need = max(int(r.min_rows), int(round((0.0 if pd.isna(r.share) else float(r.share)) * size)))
        got = int(quota[mine].sum()) if len(cells) else 0
        asked = min((0.0 if pd.isna(r.share) else float(r.share)) * size, counts[mine].sum() if len(cells) else 0.0)
        contradicted = bool(len(cells)) and fit[mine].sum() < asked - 0.5
        out.append((draw, None, None, None, r.field, r.category, int(r.holds), need, got, max(0, need - got), max(0, need - int(r.holds)), contradicted))
    return pd.DataFrame(out, columns=["draw_key", "cell", "quota", "weight", "field", "category", "available", "needed", "sampled", "gap", "shortfall", "contradicted"])


class ProportionalSample:
    """The plan of all draws; ``sample()`` gives the rows, ``report()`` the targets and their gaps."""

    def __init__(self, pool: DataFrame, draws: DataFrame, targets: DataFrame, fields: list[str], pool_key: str = "pool_id", item: str = "task_id", draw_key: str = "draw_id", seed: int = 42, order: str | None = None):
        """pool: (pool_key, item, *fields); draws: (draw_key, pool_key, category_field or null for all ``fields``, sample_size);
        targets: (draw_key, category, target_share, min_rows and, with several margins, category_field)."""
        self.seed, self.kinds = seed, (dict(draws.dtypes)[draw_key], dict(pool.dtypes)[item])
        self.draw_key, self.item = draw_key, item
        self.parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # set by the size of the data, and so are the parts of a cell
        rows = pool.select(F.col(pool_key).alias("pool_key"), F.col(item).alias("item_key"), (F.col(order) if order else F.lit(0)).alias("place"), *[normal_label(F.col(f)).alias(f"label_{i}") for i, f in enumerate(fields)]).filter(F.col("item_key").isNotNull())
        distinct = rows.groupBy("pool_key", "item_key", *[f"label_{i}" for i in range(len(fields))]).agg(F.min("place").alias("place"))
        asked = draws.select(F.col(draw_key).alias("draw_key"), F.col(pool_key).alias("pool_key"), F.col("category_field").alias("by"), F.col("sample_size").cast("long").alias("size"))
        margin = F.col("category_field") if "category_field" in targets.columns else F.lit(None).cast("string")
        wanted = targets.select(F.col(draw_key).alias("draw_key"), "category", normal_label(F.col("category")).alias("label"), F.col("target_share").alias("share"), F.coalesce("min_rows", F.lit(0)).cast("long").alias("min_rows"), margin.alias("own")).join(asked, "draw_key").withColumn("field", F.coalesce("own", "by"))

        by_field = distinct.select("pool_key", "item_key", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"label_{i}").alias("label")) for i, f in enumerate(fields)])).alias("x")).select("pool_key", "item_key", "x.field", "x.label").filter(F.col("label").isNotNull())
        holds = by_field.distinct().groupBy("pool_key", "field", "label").agg(F.count("*").alias("holds"))
        wanted = wanted.join(holds, ["pool_key", "field", "label"], "left").withColumn("holds", F.coalesce("holds", F.lit(0)))

        # one row per task: its first listing with the most labels; then its cell in the eyes of each set of fields a draw goes by
        labelled = sum(F.col(f"label_{i}").isNotNull().cast("int") for i in range(len(fields)))
        self.tasks = distinct.groupBy("pool_key", "item_key").agg(F.min_by(F.struct(*[f"label_{i}" for i in range(len(fields))]), F.struct((-labelled).alias("a"), "place", *[F.coalesce(f"label_{i}", F.lit("")) for i in range(len(fields))])).alias("l"))
        pairs = [F.when(F.col("by").isNull() | (F.col("by") == f), F.array(F.lit(f), F.coalesce(F.col(f"l.label_{i}"), F.lit("")))).otherwise(F.array().cast("array<string>")) for i, f in enumerate(fields)]
        self.cell = F.flatten(F.array(*pairs))
        kinds = [*fields, None]
        views = self.tasks.withColumn("by", F.explode(F.array(*[F.lit(k).cast("string") for k in kinds])))
        cells = views.groupBy("pool_key", "by", self.cell.alias("cell")).agg(F.count("*").alias("available"))
        mine = asked.join(cells, (asked["pool_key"] == cells["pool_key"]) & asked["by"].eqNullSafe(cells["by"])).select("draw_key", "size", "cell", "available")
        both = mine.select("draw_key", "size", "cell", "available", *[F.lit(None).cast(t).alias(n) for n, t in (("field", "string"), ("category", "string"), ("label", "string"), ("share", "double"), ("min_rows", "long"), ("holds", "long"))]).unionByName(wanted.select("draw_key", "size", F.lit(None).cast("array<string>").alias("cell"), F.lit(None).cast("long").alias("available"), "field", "category", "label", "share", "min_rows", "holds"))
        self.asked = asked
        # the cells are few bytes but each draw takes a while, so they must not be merged into few tasks
        spread = both.repartition(self.parts, "draw_key")
        self.plan = spread.groupBy("draw_key").applyInPandas(_plan, f"draw_key {self.kinds[0]}, cell array<string>, quota long, weight double, field string, category string, available long, needed long, sampled long, gap long, shortfall long, contradicted boolean")

    def report(self) -> DataFrame:
        """Every target: (draw, field, category as written, available, needed, sampled, gap, shortfall, contradicted).

        gap is what the sample lacks of the needed rows, shortfall what the whole pool
        lacks of them; contradicted tells that the pool holds the rows of the target's
        share, but other margins of the draw do not leave room for them.
        """
        return self.plan.filter(F.col("cell").isNull()).select(F.col("draw_key").alias(self.draw_key), "field", "category", "available", "needed", "sampled", "gap", "shortfall", "contradicted")

    def sample(self) -> DataFrame:
        """(draw, item, cell) of every sampled task, distinct in a draw.

        The smallest keys of a cell are found in two steps, first within hashed
        parts of the cell, so that a hot pool is never sorted by one task.
        """
        quotas = self.plan.filter(F.col("quota") > 0).select("draw_key", F.col("cell").alias("plan_cell"), "quota", "weight")
        views = self.asked.join(self.tasks, "pool_key").withColumn("cell", self.cell)
        u = (F.pmod(F.xxhash64(F.lit(self.seed), "draw_key", "item_key"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        keyed = views.alias("v").join(quotas.alias("q"), (F.col("v.draw_key") == F.col("q.draw_key")) & (F.col("v.cell") == F.col("q.plan_cell"))).select(F.col("v.draw_key").alias("draw_key"), "item_key", "cell", "quota", "weight").select("draw_key", "item_key", "cell", "quota", (-F.log(u) / F.col("weight")).alias("key"))
        part = Window.partitionBy("draw_key", "cell", F.pmod(F.hash("item_key"), F.lit(self.parts))).orderBy("key", "item_key")
        whole = Window.partitionBy("draw_key", "cell").orderBy("key", "item_key")
        best = keyed.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= F.col("quota")).withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= F.col("quota"))
        return best.select(F.col("draw_key").alias(self.draw_key), F.col("item_key").alias(self.item), F.array_join("cell", "=").alias("cell"))
