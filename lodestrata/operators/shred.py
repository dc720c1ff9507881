"""Columnar shredding of nested records with repetition and definition levels.

A nested column is cut into its leaf paths.  Every leaf path becomes a sequence of
(repetition level, definition level, value): the repetition level says which
repeated ancestor starts a new element, the definition level how much of the path
exists.  From the sequences alone, the flat table of any repeated ancestor is put
together again, with the ordinals of all its ancestors as links.

Records stay in Arrow batches; levels are made with whole-array operations on the
offsets and validity of the nested arrays, never value by value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Path:
    """A leaf path: names from the column down, ``[]`` for the elements of an array."""

    names: tuple[str, ...]
    kind: T.DataType

    @property
    def depth(self) -> int:
        return self.names.count("[]")

    def ancestor(self, level: int) -> tuple[str, ...]:
        """The names up to and with the ``level``-th ``[]``."""
        seen = 0
        for i, n in enumerate(self.names):
            seen += n == "[]"
            if n == "[]" and seen == level:
                return self.names[: i + 1]
        raise ValueError(f"{self.names} has no repeated level {level}")


def leaf_paths(kind: T.DataType, names: tuple[str, ...]) -> list[Path]:
    """All leaf paths below a type, in schema order."""
    if isinstance(kind, T.ArrayType):
        return leaf_paths(kind.elementType, (*names, "[]"))
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in leaf_paths(f.dataType, (*names, f.name))]
    return [Path(names, kind)]


@dataclass
class Levels:
    """Level sequences of one leaf path in one batch; ``value`` is the index into ``leaf`` or -1."""

    path: Path
    record: np.ndarray
    rep: np.ndarray
    dfn: np.ndarray
    value: np.ndarray
    leaf: pa.Array
    defined_at: dict[int, tuple[int, int]]  # level: (definition level of "has elements", of "element is there")


def _valid(array: pa.Array) -> np.ndarray:
    return np.asarray(array.is_valid()) if array.null_count else np.ones(len(array), bool)


def shred_levels(array: pa.Array, path: Path) -> Levels:
    """Repetition and definition levels of ``path`` in an array of records.

    Every node on the way counts one definition level for being there, and an array
    one more for having elements.
    """
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    n = len(array)
    record, rep, dfn, at = np.arange(n), np.zeros(n, np.int16), np.zeros(n, np.int16), np.arange(n)
    defined_at: dict[int, tuple[int, int]] = {}
    depth = level = 0
    for step in [*path.names[1:], None]:
        alive = at >= 0
        there = np.zeros(len(at), bool)
        there[alive] = _valid(array)[at[alive]]
        level += 1
        dfn = np.where(there, level, dfn).astype(np.int16)
        if depth and depth in defined_at and defined_at[depth][1] < 0:
            defined_at[depth] = (defined_at[depth][0], level)
        at = np.where(there, at, -1)
        if step is None:
            break
        if step == "[]":
            depth += 1
            offsets = np.asarray(array.offsets)
            child = array.values
            i = np.where(at >= 0, at, 0)
            size = np.where(at >= 0, offsets[i + 1] - offsets[i], 0) if len(array) else np.zeros(len(at), np.int64)
            copies = np.maximum(size, 1)
            src = np.repeat(np.arange(len(at)), copies)
            within = np.arange(len(src)) - np.repeat(np.cumsum(copies) - copies, copies)
            has = size[src] > 0
            level += 1
            record, rep, dfn = record[src], np.where(within > 0, depth, rep[src]).astype(np.int16), np.where(has, level, dfn[src]).astype(np.int16)
            at = np.where(has, (offsets[i])[src] + within if len(array) else -1, -1)
            defined_at[depth] = (level, -1)
            array = child
        else:
            array = array.field(array.type.get_field_index(step))
    return Levels(path, record, rep, dfn, at, array, defined_at)


def ordinals(levels: Levels, level: int) -> list[np.ndarray]:
    """Ordinal of each entry at the repeated levels 1 to ``level``, from the sequences alone."""
    out = []
    for j in range(1, level + 1):
        starts = np.cumsum(levels.rep <= j)
        anew = np.where(levels.rep < j, starts, 0)
        out.append(starts - np.maximum.accumulate(anew))
    return out


def elements(levels: Levels, level: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(positions in the sequences, ordinals) of the elements of the ``level``-th repeated ancestor that are not null."""
    there = (levels.rep <= level) & (levels.dfn >= levels.defined_at[level][1])
    return np.flatnonzero(there), [o[there].astype(np.int32) for o in ordinals(levels, level)]


def _table_paths(kind: T.DataType, column: str) -> dict[tuple[str, ...], list[Path]]:
    """Leaf paths by the repeated ancestor that directly holds them; ancestors without scalars of their own get a leaf below."""
    paths = leaf_paths(kind, (column,))
    own: dict[tuple[str, ...], list[Path]] = {}
    for p in paths:
        for level in range(1, p.depth + 1):
            own.setdefault(p.ancestor(level), [])
        if p.depth:
            own[p.ancestor(p.depth)].append(p)
    return own


def shred_tables(df: DataFrame, key: str, column: str) -> dict[str, DataFrame]:
    """Flat tables of a nested column, one per repeated ancestor, by dotted name.

    Each holds ``record_key``, ``ord_1`` to ``ord_n`` (the element's place in each
    array above and around it, from 0, null elements counted) and the ancestor's
    own scalars as ``v_<name>``; a child links to its parent by ``record_key`` and
    the parent's ordinals.  Elements that are null have no row.  A null record, a
    null or empty array and an empty table give no rows.
    """
    kind = df.schema[column].dataType
    key_kind = df.schema[key].dataType.simpleString()
    by_table = _table_paths(kind, column)
    out = {}
    for ancestor, own in by_table.items():
        level = ancestor.count("[]")
        below = own or [next(p for p in leaf_paths(kind, (column,)) if p.names[: len(ancestor)] == ancestor)]
        names = ["_".join(n for n in p.names[len(ancestor) :] if n != "[]") or "value" for p in own]
        schema = ", ".join([f"record_key {key_kind}", *[f"ord_{j} int" for j in range(1, level + 1)], *[f"`v_{n}` {p.kind.simpleString()}" for n, p in zip(names, own)]])
        out[".".join(n for n in ancestor if n != "[]")] = df.select(df[key], df[column]).mapInArrow(_rebuild(below, level, names, bool(own)), schema)
    return out


def _rebuild(paths: list[Path], level: int, names: list[str], with_values: bool):
    def run(batches):
        for batch in batches:
            cols: dict[str, pa.Array] = {}
            for k, p in enumerate(paths):
                lv = shred_levels(batch.column(1), p)
                pos, ords = elements(lv, level)
                if not k:
                    cols["record_key"] = batch.column(0).take(pa.array(lv.record[pos]))
                    cols |= {f"ord_{j}": pa.array(o, pa.int32()) for j, o in enumerate(ords, 1)}
                if with_values:
                    at = lv.value[pos]
                    cols[f"v_{names[k]}"] = lv.leaf.take(pa.array(np.where(at < 0, 0, at), mask=at < 0)) if len(lv.leaf) else pa.nulls(len(pos), lv.leaf.type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def shred_links(df: DataFrame, key: str, column: str, kinds: dict[str, tuple[str, list[int]]]) -> DataFrame:
    """All elements of several repeated ancestors in one pass over the records.

    kinds: dotted ancestor name to (node kind, for each of the three ordinals of
    the result the repeated level it shows, or 0 for -1).  Rows: (``key``,
    ``node_kind``, ``task_ord``, ``item_ord``, ``token_ord``).
    """
    kind = df.schema[column].dataType
    tables = {".".join(n for n in a if n != "[]"): (a, own) for a, own in _table_paths(kind, column).items()}
    wanted = []
    for name, (label, show) in kinds.items():
        ancestor, own = tables[name]
        leaf = own[0] if own else next(p for p in leaf_paths(kind, (column,)) if p.names[: len(ancestor)] == ancestor)
        wanted.append((leaf, ancestor.count("[]"), label, show))

    def run(batches):
        for batch in batches:
            for leaf, level, label, show in wanted:
                lv = shred_levels(batch.column(1), leaf)
                pos, ords = elements(lv, level)
                blank = np.full(len(pos), -1, np.int32)
                cols = [batch.column(0).take(pa.array(lv.record[pos])), pa.array([label] * len(pos), pa.string()), *[pa.array(ords[j - 1] if j else blank, pa.int32()) for j in show]]
                yield pa.RecordBatch.from_arrays(cols, [key, "node_kind", "task_ord", "item_ord", "token_ord"])

    return df.select(df[key], df[column]).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, node_kind string, task_ord int, item_ord int, token_ord int")
