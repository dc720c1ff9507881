import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.packing import DEFAULT_TOKENIZER, _slots, fill_report, nonnegative_fit, pack, plan_containers, shallow_combinations, token_counts


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.data())
def test_plan_uses_up_the_histogram(capacity, data):
    hist = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(1, 50), max_size=25))
    plan = plan_containers(hist, capacity)
    used = Counter()
    for combo, times in plan:
        assert times > 0 and sum(v * n for v, n in combo) <= capacity
        for v, n in combo:
            used[v] += n * times
    assert used == Counter(hist)
    ranks = Counter()
    for v, first, count, per, _ in _slots(plan, 0):
        assert first == ranks[v] and count % per == 0
        ranks[v] += count
    assert ranks == used


def test_fill_is_close_to_the_bound():
    rng = random.Random(1)
    hist = Counter(min(500, max(1, int(rng.lognormvariate(4.5, 1)))) for _ in range(20_000))
    plan = plan_containers(hist, 512)
    made, total = sum(t for _, t in plan), sum(v * n for v, n in hist.items())
    assert total / (made * 512) > 0.995


def test_fit_of_a_solvable_system():
    import numpy as np

    combos = [((6, 1), (4, 1)), ((5, 2),), ((3, 2), (4, 1))]
    lengths = np.array([3, 4, 5, 6])
    x = nonnegative_fit(combos, lengths, np.array([20, 17, 8, 7]), 4000)
    assert np.allclose(x, [7, 4, 10], atol=0.05)
    assert all(10 - 1 <= sum(v * n for v, n in c) <= 10 for c in shallow_combinations(lengths, 10, 1))


def placed(spark, items, capacities):
    df = spark.createDataFrame(items, "item_key long, tokens long")
    return pack(df, capacities).collect()


def check(rows, items, capacities):
    for kind, capacity in capacities.items():
        mine = [r for r in rows if r["container_kind"] == kind]
        used, pieces = Counter(), Counter()
        for r in mine:
            used[r["container_id"]] += r["piece_tokens"]
            pieces[r["item_key"]] += r["piece_tokens"]
        assert max(used.values(), default=0) <= capacity
        want = Counter()
        for k, n in items:
            want[k] += n or 0
        assert +pieces == +want
        split = Counter(r["item_key"] for r in mine)
        count = Counter(k for k, _ in items)
        for k, n in items:
            if (n or 0) <= capacity and count[k] == 1:
                assert split[k] == 1


def test_assignment(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 1, 7, 30, 64, 65, 100, 1000])) for i in range(500)] + [(900, None), (901, 6400)]
    check(placed(spark, items, {"s": 64, "l": 300}), items, {"s": 64, "l": 300})
    same = [(i, 33) for i in range(300)]
    rows = placed(spark, same, {"s": 66})
    check(rows, same, {"s": 66})
    assert len({r["container_id"] for r in rows}) == 150


def test_repeated_keys_and_empty_tables(spark):
    items = [(1, 10), (1, 10), (2, 50)]
    rows = placed(spark, items, {"s": 32})
    assert len(rows) == 4 and Counter(r["piece_tokens"] for r in rows) == {10: 2, 32: 1, 18: 1}
    assert placed(spark, [], {"s": 32}) == [] and placed(spark, items, {}) == []


@pytest.mark.skipif(not os.path.exists(DEFAULT_TOKENIZER), reason="no tokenizer files")
def test_tokens_and_report(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a " * 5000)], "doc_id long, text string")
    counts = token_counts(df, "doc_id")
    got = {r["item_key"]: r["tokens"] for r in counts.collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 4000
    r = fill_report(pack(counts, {"s": 512}), {"s": 512}).first()
    assert r["fullest"] <= 512 and r["containers"] == r["least_containers"]
