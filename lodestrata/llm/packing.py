"""Filling fixed-capacity containers with items of varying length.

Only the histogram of lengths, which has at most ``capacity`` entries, reaches the
driver.  There, shallow combinations of lengths that fill a window below the
capacity are enumerated, a non-negative least-squares fit finds how often each
should be used, the counts are rounded down, and a greedy pass makes further
combinations from what is left, until every length is used up.  The result is a
bounded list of (combination, repeats); items are then assigned by their rank
within their length, without moving any texts.
"""

from __future__ import annotations

import base64
import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the byte-level vocabulary.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODINGS: dict = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(docs: DataFrame, key: str, text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(``item_key``, ``tokens``) of every row; null and empty texts have 0 tokens."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        enc = _encoding(tokenizer)
        for b in batches:
            yield pd.DataFrame({"item_key": b["k"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["t"]]})

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"item_key {kind}, tokens long")


def shallow_combinations(lengths: np.ndarray, capacity: int, window: int, depth: int = 3, per_length: int = 6) -> list[tuple[tuple[int, int], ...]]:
    """Combinations of at most ``depth`` distinct lengths, each some times, whose sum is within ``window`` below ``capacity``."""
    ordered = sorted(map(int, lengths))
    found: dict[tuple, None] = {}

    def below(room: int) -> int:
        return bisect.bisect_right(ordered, room) - 1

    for first in ordered:
        most = capacity // first
        for a in sorted({1, 2, 3, most, max(1, most // 2), max(1, most - 1)} & set(range(1, most + 1)))[:per_length]:
            room = capacity - a * first
            if room <= window:
                found[((first, a),)] = None
            if room < ordered[0] or depth < 2:
                continue
            at = below(room)
            for step in range(per_length):
                i = at - step * max(1, at // per_length) if step else at
                if i < 0:
                    break
                second = ordered[i]
                b = room // second
                rest = room - b * second
                if second != first and rest <= window:
                    found[tuple(sorted(((first, a), (second, b)), reverse=True))] = None
                for bb in {1, b}:
                    rest = room - bb * second
                    j = below(rest)
                    if depth >= 3 and second != first and j >= 0 and ordered[j] not in (first, second):
                        third = ordered[j]
                        c = rest // third
                        if rest - c * third <= window:
                            found[tuple(sorted(((first, a), (second, bb), (third, c)), reverse=True))] = None
    return list(found)


def nonnegative_fit(combos: list[tuple[tuple[int, int], ...]], lengths: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least-squares repeats of the combinations against the histogram, by multiplicative updates on the sparse system."""
    at = {int(v): i for i, v in enumerate(lengths)}
    col = np.array([k for k, c in enumerate(combos) for _ in c], np.int64)
    row = np.array([at[v] for c in combos for v, _ in c], np.int64)
    val = np.array([n for c in combos for _, n in c], float)
    goal = counts.astype(float)
    reach = np.bincount(col, val * goal[row], minlength=len(combos))
    x = np.full(len(combos), goal.sum() / max(val.sum(), 1))
    for _ in range(rounds):
        made = np.bincount(row, val * x[col], minlength=len(lengths))
        x *= reach / np.maximum(np.bincount(col, val * made[row], minlength=len(combos)), 1e-12)
    return x


def plan_containers(histogram: dict[int, int], capacity: int, window: int | None = None, depth: int = 3) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(combination, repeats) that use up a histogram of lengths between 1 and ``capacity``."""
    left = {int(v): int(n) for v, n in histogram.items() if n > 0}
    if not left:
        return []
    window = max(1, capacity // 200) if window is None else window
    lengths = np.array(sorted(left))
    plan: list[tuple[tuple[tuple[int, int], ...], int]] = []
    combos = shallow_combinations(lengths, capacity, window, depth)
    if combos:
        fit = nonnegative_fit(combos, lengths, np.array([left[int(v)] for v in lengths]))
        for k in np.argsort(-fit, kind="stable"):
            times = min([int(fit[k] + 1e-6)] + [left[v] // n for v, n in combos[k]])
            if times > 0:
                plan.append((combos[k], times))
                for v, n in combos[k]:
                    left[v] -= n * times
    ordered = sorted(v for v, n in left.items() if n)
    while ordered:
        room, combo = capacity, {}
        for _ in range(1_000_000):
            i = bisect.bisect_right(ordered, room) - 1
            while i >= 0 and combo.get(ordered[i], 0) >= left[ordered[i]]:
                i -= 1
            if i < 0:
                break
            v = ordered[i]
            take = min(left[v] - combo.get(v, 0), room // v)
            combo[v] = combo.get(v, 0) + take
            room -= take * v
        times = min(left[v] // n for v, n in combo.items())
        plan.append((tuple(sorted(combo.items(), reverse=True)), times))
        for v, n in combo.items():
            left[v] -= n * times
        ordered = [v for v in ordered if left[v]]
    return plan


def _slots(plan: list[tuple[tuple[tuple[int, int], ...], int]], first: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, items of that length per container, first container) of every use of a length."""
    used: dict[int, int] = {}
    out, container = [], first
    for combo, times in plan:
        for v, n in combo:
            out.append((v, used.get(v, 0), n * times, n, container))
            used[v] = used.get(v, 0) + n * times
        container += times
    return out


def pack(items: DataFrame, capacities: dict[str, int], tokens: str = "tokens", key: str = "item_key", window: int | None = None) -> DataFrame:
    """(``container_kind``, ``key``, ``piece_no``, ``piece_tokens``, ``container_id``) of every piece of every item, for every container kind.

    ``items`` should be staged: it is read twice.  An item longer than the capacity
    is split into full pieces, each a container of its own, and a rest; any other
    item is one piece (piece_no 0).  Items without tokens go into container 0.
    Repeated keys are separate items.
    """
    spark = items.sparkSession
    base = items.select(F.col(key).alias("k"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("n"))
    kinds = [F.struct(F.lit(k).alias("kind"), F.lit(int(c)).cast("long").alias("capacity")) for k, c in sorted(capacities.items()) if c and c > 0]
    if not kinds:
        return spark.createDataFrame([], f"container_kind string, {key} {dict(items.dtypes)[key]}, piece_no int, piece_tokens long, container_id long")
    each = base.withColumn("kinds", F.explode(F.array(*kinds))).select("k", "n", F.col("kinds.kind").alias("container_kind"), F.col("kinds.capacity").alias("capacity"))
    rest = each.withColumn("whole", F.when(F.col("n") > F.col("capacity"), F.floor(F.col("n") / F.col("capacity"))).otherwise(F.lit(0))).withColumn("size", F.col("n") - F.col("whole") * F.col("capacity"))
    salt = F.pmod(F.xxhash64("k"), F.lit(SALTS))
    sized = rest.withColumn("salt", salt)
    counted = sized.groupBy("container_kind", "capacity", "size", "salt").agg(F.count("*").alias("items"), F.sum("whole").alias("wholes"))
    rows = counted.groupBy("container_kind", "capacity", "size").agg(F.sum("items").alias("items"), F.sum("wholes").alias("wholes")).collect()  # at most capacity + 1 rows a kind
    slots, firsts = [], []
    for kind, capacity in sorted({(r["container_kind"], r["capacity"]) for r in rows}):
        mine = [r for r in rows if r["container_kind"] == kind]
        plan = plan_containers({r["size"]: r["items"] for r in mine if r["size"]}, capacity, window)
        slots += [(kind, *s) for s in _slots(plan, 0)]
        firsts.append((kind, sum(t for _, t in plan)))
    slot_table = spark.createDataFrame(slots, "s_kind string, s_size long, s_first long, s_ranks long, s_per long, s_container long").groupBy("s_kind", "s_size").agg(F.array_sort(F.collect_list(F.struct("s_first", "s_ranks", "s_per", "s_container"))).alias("uses"))
    before = Window.partitionBy("container_kind", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("offset", F.coalesce(F.sum("items").over(before), F.lit(0))).select(F.col("container_kind").alias("o_kind"), F.col("size").alias("o_size"), F.col("salt").alias("o_salt"), "offset")
    ranked = sized.filter("size > 0").withColumn("local", F.row_number().over(Window.partitionBy("container_kind", "size", "salt").orderBy("k")) - 1)
    ranked = ranked.join(offsets, (F.col("container_kind") == F.col("o_kind")) & (F.col("size") == F.col("o_size")) & (F.col("salt") == F.col("o_salt"))).withColumn("rank", F.col("offset") + F.col("local"))
    placed = ranked.join(slot_table, (F.col("container_kind") == F.col("s_kind")) & (F.col("size") == F.col("s_size")))
    use = F.element_at(F.filter("uses", lambda u: (u["s_first"] <= F.col("rank")) & (F.col("rank") < u["s_first"] + u["s_ranks"])), 1)
    placed = placed.withColumn("use", use).select("container_kind", F.col("k").alias(key), F.col("whole").cast("int").alias("piece_no"), F.col("size").alias("piece_tokens"), (F.col("use.s_container") + F.floor((F.col("rank") - F.col("use.s_first")) / F.col("use.s_per"))).alias("container_id"))
    # full pieces of items beyond the capacity: containers after the planned ones, numbered by salted running sums
    start = spark.createDataFrame(firsts, "f_kind string, f_first long")
    by_salt = counted.groupBy("container_kind", "salt").agg(F.sum("wholes").alias("wholes"))
    salt_start = by_salt.withColumn("o", F.coalesce(F.sum("wholes").over(Window.partitionBy("container_kind").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(F.broadcast(start), F.col("container_kind") == F.col("f_kind")).select(F.col("container_kind").alias("w_kind"), F.col("salt").alias("w_salt"), (F.col("o") + F.col("f_first")).alias("w_first"))
    running = Window.partitionBy("container_kind", "salt").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    long_items = sized.filter("whole > 0").withColumn("own", F.coalesce(F.sum("whole").over(running), F.lit(0))).join(salt_start, (F.col("container_kind") == F.col("w_kind")) & (F.col("salt") == F.col("w_salt")))
    full = long_items.select("container_kind", F.col("k").alias(key), F.col("capacity").alias("piece_tokens"), (F.col("w_first") + F.col("own")).alias("c"), F.posexplode(F.sequence(F.lit(1), F.col("whole"))).alias("p", "_")).select("container_kind", key, F.col("p").cast("int").alias("piece_no"), "piece_tokens", (F.col("c") + F.col("p")).alias("container_id"))
    nothing = sized.filter("n = 0").select("container_kind", F.col("k").alias(key), F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("piece_tokens"), F.lit(0).cast("long").alias("container_id"))
    return placed.unionByName(full).unionByName(nothing)


def fill_report(placed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Per container kind: containers, tokens, fill (share of the room that is used) and the fewest containers possible."""
    spark = placed.sparkSession
    kinds = spark.createDataFrame(sorted(capacities.items()), "c_kind string, capacity long")
    one = placed.groupBy("container_kind", "container_id").agg(F.sum("piece_tokens").alias("used"))
    total = one.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return total.join(F.broadcast(kinds), F.col("container_kind") == F.col("c_kind")).select("container_kind", "capacity", "containers", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"))
