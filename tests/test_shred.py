import random

import pyarrow as pa
from pyspark.sql import types as T

from lodestrata.operators.shred import Path, elements, leaf_paths, shred_levels, shred_links, shred_tables



def struct(**fields):
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


INT = T.IntegerType()
TYPE = T.ArrayType(struct(name=T.StringType(), ids=T.ArrayType(INT), spots=T.ArrayType(struct(n=INT, tops=T.ArrayType(struct(id=INT, p=T.DoubleType()))))))


def record(rng, depth=0):
    def maybe(x):
        return None if rng.random() < 0.2 else x

    def many(f):
        return maybe([maybe(f()) for _ in range(rng.choice([0, 0, 1, 2, 5]))])

    return many(lambda: (rng.choice("abc"), many(lambda: rng.randint(0, 9)), many(lambda: (rng.randint(0, 9), many(lambda: (rng.randint(0, 9), 0.5))))))


def brute(key, value):
    out = []
    for i, t in enumerate(value or []):
        if t is None:
            continue
        out.append((key, "task", i, -1, -1))
        out += [(key, "id", i, j, -1) for j, x in enumerate(t[1] or []) if x is not None]
        for j, s in enumerate(t[2] or []):
            if s is not None:
                out.append((key, "spot", i, j, -1))
                out += [(key, "top", i, j, k) for k, x in enumerate(s[1] or []) if x is not None]
    return out


KINDS = {"col": ("task", [1, 0, 0]), "col.ids": ("id", [1, 2, 0]), "col.spots": ("spot", [1, 2, 0]), "col.spots.tops": ("top", [1, 2, 3])}


def frame(spark, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField("key", T.LongType()), T.StructField("col", TYPE), T.StructField("ord_1", T.IntegerType())]))


def test_links_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, record(rng), 1) for k in range(200)] + [(7, None, 1), (7, [], 1)]
    want = sorted(x for k, v, _ in rows for x in brute(k, v))
    assert sorted(map(tuple, shred_links(frame(spark, rows), "key", "col", KINDS).collect())) == want


def test_tables_keep_values_and_parents(spark):
    rows = [(1, [("a", [5, None, 6], [(1, [(9, 0.1), None]), None, (2, None)]), None, ("b", None, [])], 1)]
    t = shred_tables(frame(spark, rows), "key", "col")
    assert [tuple(r) for r in t["col"].collect()] == [(1, 0, "a"), (1, 2, "b")]
    assert [tuple(r) for r in t["col.ids"].collect()] == [(1, 0, 0, 5), (1, 0, 2, 6)]
    assert [tuple(r) for r in t["col.spots"].collect()] == [(1, 0, 0, 1), (1, 0, 2, 2)]
    assert [tuple(r) for r in t["col.spots.tops"].collect()] == [(1, 0, 0, 0, 9, 0.1)]


def test_empty_table(spark):
    assert shred_links(frame(spark, []), "key", "col", KINDS).count() == 0


def test_levels_of_the_textbook_example():
    # two records; a.b repeated within a repeated
    kind = pa.list_(pa.list_(pa.int32()))
    array = pa.array([[[1, 2], []], None, [None, [3]]], kind)
    path = Path(("x", "[]", "[]"), T.IntegerType())
    lv = shred_levels(array, path)
    assert lv.rep.tolist() == [0, 2, 1, 0, 0, 1]
    assert [lv.leaf[i].as_py() if i >= 0 else None for i in lv.value.tolist()] == [1, 2, None, None, None, 3]
    pos, ords = elements(lv, 2)
    assert [(o1, o2) for o1, o2 in zip(*map(list, ords))] == [(0, 0), (0, 1), (1, 0)]


def test_sliced_batches_read_their_own_rows():
    array = pa.array([[[1]], [[2], [3]], [[4]]], pa.list_(pa.list_(pa.int32())))
    lv = shred_levels(array.slice(1, 2), Path(("x", "[]", "[]"), T.IntegerType()))
    assert [lv.leaf[i].as_py() for i in lv.value.tolist()] == [2, 3, 4]


def test_leaf_paths():
    assert [".".join(p.names) for p in leaf_paths(TYPE, ("c",))] == ["c.[].name", "c.[].ids.[]", "c.[].spots.[].n", "c.[].spots.[].tops.[].id", "c.[].spots.[].tops.[].p"]
