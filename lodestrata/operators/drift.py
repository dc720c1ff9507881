"""Semi-structured rows whose fields drift between files: changes, and one consistent table.

``ingest`` reads every payload into a target schema and keeps what does not fit in
a rescue column; ``field_changes`` reports, from the typed and the rescued values,
what each file of a series adds, removes, renames or retypes against the file
before it; ``replay`` moves rescued values of newly approved fields into typed
columns without reading the files again.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..staging import stage, temp_name

# A number that stands alone; longer ones are codes and count as words.
_NUMBER = r"(?<![\p{L}\p{N}.])(?:(?<![\p{L}\p{N}])-)?\d{1,15}(?:\.\d+)?(?:e[+-]?\d{1,3})?(?![\p{L}\p{N}])"
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def payload_map(payload: Column) -> Column:
    """The fields of a payload that is one complete JSON object, as map<string,variant>; null for any other."""
    whole = F.trim(F.regexp_replace(payload, r"^\s++|(?<!\s)\s++\z", ""))
    return F.when(whole.startswith("{") & whole.endswith("}"), F.from_json(whole, "map<string,variant>"))


def json_kind(value: Column) -> Column:
    """string, number, boolean, object or array; null for a JSON null."""

    def named(kind: Column) -> Column:
        return (
            F.when(kind.startswith("OBJECT"), "object")
            .when(kind.startswith("ARRAY"), "array")
            .when(kind == "BOOLEAN", "boolean")
            .when(kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), "number")
            .otherwise("string")
        )

    return F.when(value.isNotNull() & ~F.is_variant_null(value), let(F.schema_of_variant(value), named))


def _tokens(value: Column) -> Column:
    """Words and numbers of a value whatever its JSON form, as distinct structs of ``word`` or ``number``: 4, 4.0 and "4" are the same."""
    text = F.lower(F.regexp_replace(value.cast("string"), r'"\w+"\s*:', " "))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), lambda x: F.struct(F.lit(None).cast("string").alias("word"), (x.cast("double") + 0.0).alias("number")))
    words = F.transform(F.filter(F.split(F.regexp_replace(text, _NUMBER, " "), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.struct(x.alias("word"), F.lit(None).cast("double").alias("number")))
    return F.array_distinct(F.concat(words, numbers))


_KINDS = {"string": "string", "boolean": "boolean", "int": "number", "bigint": "number", "double": "number"}


def rescued_rows(rows: DataFrame, series: str, seq: str, payload: str, target: dict[str, str] | None = None) -> DataFrame:
    """``ingest`` of the payloads alone, strict and with the names of null fields, staged: (``series_key``, ``seq_key``, ``c_0`` ... the target's values, ``rescued``, ``null_fields``, ``payload_state``)."""
    named = rows.select(F.col(series).alias("series_key"), F.col(seq).alias("seq_key"), F.col(payload).alias("p"))
    table = ingest(named, "p", target or {}, strict=True, keep_nulls=True)
    plain = [F.col(c).alias(c if c in ("series_key", "seq_key", "rescued", "null_fields", "payload_state") else f"c_{i}") for c, i in zip(table.columns, [-1, -1, *range(len(target or {})), -1, -1, -1])]
    return stage(table.select(*plain), "rescued")


def _rescued_map() -> Column:
    return F.when(F.col("payload_state") == "complete", F.from_json("rescued", "map<string,variant>"))


def file_fields(table: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """(series, seq, ``fields``): per file its fields with their kinds, from ``rescued_rows``.

    A typed value has its column's kind, a rescued one that of its JSON, a null none.
    Partly aggregated before every shuffle; what is kept of a file is bounded by
    its number of fields, whatever its number of rows.
    """
    none = F.lit(None).cast("string")
    typed = [F.when(F.col(f"c_{i}").isNotNull(), F.struct(F.lit(f).alias("field"), F.lit(_KINDS[kind]).alias("kind"))) for i, (f, kind) in enumerate((target or {}).items())]
    empty = F.array().cast("array<struct<field:string,kind:string>>")
    left = F.transform(F.coalesce(F.map_entries(_rescued_map()), F.array().cast("array<struct<key:string,value:variant>>")), lambda e: F.struct(e["key"].alias("field"), json_kind(e["value"]).alias("kind")))
    nulls = F.transform(F.coalesce("null_fields", F.array().cast("array<string>")), lambda n: F.struct(n.alias("field"), none.alias("kind")))
    each = table.select("series_key", "seq_key", F.explode_outer(F.concat(F.array_compact(F.array(*typed)) if typed else empty, left, nulls)).alias("e"))
    fields = each.groupBy("series_key", "seq_key", F.col("e.field").alias("field")).agg(F.array_sort(F.collect_set("e.kind")).alias("kinds"))
    one = F.when(F.col("field").isNotNull(), F.struct("field", "kinds"))
    return fields.groupBy("series_key", "seq_key").agg(F.collect_list(one).alias("fields"))


def _value_counts(table: DataFrame, steps: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """(series, ``step``, ``old``, ``field``, ``word``, ``number``, ``n``) of the fields that a file lost (``old``) or won, whatever its rows, one row per value.

    Values come from the typed columns, or from what was rescued.
    """
    sides = [
        steps.select("series_key", F.col("before_key").alias("seq_key"), F.col("seq_key").alias("step"), F.lit(True).alias("old"), F.col("gone").alias("names")),
        steps.select("series_key", "seq_key", F.col("seq_key").alias("step"), F.lit(False).alias("old"), F.col("new").alias("names")),
    ]
    wanted = sides[0].unionByName(sides[1]).groupBy(F.col("series_key").alias("s"), F.col("seq_key").alias("q")).agg(F.collect_list(F.struct("step", "old", "names")).alias("uses"))
    typed = F.create_map(*[x for i, f in enumerate(target or {}) for x in (F.lit(f), F.col(f"c_{i}").cast("string"))]) if target else F.create_map().cast("map<string,string>")
    named = table.join(wanted, F.col("series_key").eqNullSafe(F.col("s")) & F.col("seq_key").eqNullSafe(F.col("q"))).select("series_key", typed.alias("typed"), _rescued_map().alias("m"), F.explode("uses").alias("u"))
    values = named.select("series_key", "u.step", "u.old", F.explode("u.names").alias("field"), "typed", "m").withColumn("v", F.coalesce(F.try_element_at("typed", "field"), F.try_element_at("m", "field").cast("string")))
    tokens = values.filter(F.col("v").isNotNull()).select("series_key", "step", "old", "field", F.explode(_tokens(F.col("v"))).alias("t"))
    return tokens.groupBy("series_key", "step", "old", "field", "t.word", "t.number").agg(F.count("*").alias("n"))


def value_likeness(counts: DataFrame) -> DataFrame:
    """(series, ``step``, ``gone``, ``new``, ``alike``): overlap of the values of a lost and a won field, from 0 to 1, of all pairs above 0.

    Words overlap by their exact counts, and so do numbers that repeat.  Numbers that
    occur once say nothing by their counts (a score, a size): that part of them
    overlaps by the largest gap between both distribution functions.  Numbers inside
    texts count as far as the words around them overlap.
    """
    place = ["series_key", "step"]
    sums = counts.groupBy(*place, "old", "field").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("word").isNotNull(), F.col("n")).otherwise(0)).alias("words"), F.count_if(F.col("number").isNotNull() & (F.col("n") == 1)).alias("once")
    )

    def side(df: DataFrame, old: bool, name: str, *columns: str) -> DataFrame:
        return df.filter(F.col("old") == old).select(F.col("series_key").alias(f"{name}_s"), F.col("step").alias(f"{name}_q"), F.col("field").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    here = F.col("gone_s").eqNullSafe(F.col("new_s")) & F.col("gone_q").eqNullSafe(F.col("new_q"))
    pairs = side(sums, True, "gone", "total", "words", "once").join(side(sums, False, "new", "total", "words", "once"), here).drop("new_s", "new_q").withColumnsRenamed({"gone_s": "series_key", "gone_q": "step"})
    shares = counts.join(sums.withColumnsRenamed({"series_key": "s", "step": "q", "old": "o", "field": "f"}), F.col("series_key").eqNullSafe(F.col("s")) & F.col("step").eqNullSafe(F.col("q")) & (F.col("old") == F.col("o")) & (F.col("field") == F.col("f")))
    shares = shares.withColumns({"share": F.col("n") / F.col("total"), "part": F.when(F.col("number").isNotNull(), F.col("n") / (F.col("total") - F.col("words")))}).select(*place, "old", "field", "word", "number", "share", "part")
    same = here & F.col("gone_word").eqNullSafe(F.col("new_word")) & F.col("gone_number").eqNullSafe(F.col("new_number"))
    both = side(shares, True, "gone", "word", "number", "share").join(side(shares, False, "new", "word", "number", "share"), same)
    least = F.least("gone_share", "new_share")
    exact = both.groupBy(F.col("gone_s").alias("e_s"), F.col("gone_q").alias("e_q"), F.col("gone").alias("e_gone"), F.col("new").alias("e_new")).agg(
        F.sum(F.when(F.col("gone_word").isNotNull(), least).otherwise(0.0)).alias("in_words"), F.sum(F.when(F.col("gone_number").isNotNull(), least).otherwise(0.0)).alias("in_numbers")
    )

    rare = pairs.filter((F.col("gone_once") > 0) & (F.col("new_once") > 0)).select(*place, "gone", "new")
    numbers = shares.filter(F.col("number").isNotNull()).select(F.col("series_key").alias("s"), F.col("step").alias("q"), "old", "field", "number", "part")
    mine = F.col("series_key").eqNullSafe(F.col("s")) & F.col("step").eqNullSafe(F.col("q")) & (F.col("field") == F.when(F.col("old"), F.col("gone")).otherwise(F.col("new")))
    by = [*place, "gone", "new"]
    rises = rare.join(numbers, mine).groupBy(*by, "number").agg(F.sum(F.when(F.col("old"), F.col("part")).otherwise(-F.col("part"))).alias("rise"))
    running = rises.withColumn("gap", F.abs(F.sum("rise").over(Window.partitionBy(*by).orderBy("number").rowsBetween(Window.unboundedPreceding, 0))))
    gaps = running.groupBy(*[F.col(c).alias(f"g_{c}") for c in by]).agg(F.max("gap").alias("gap"))

    def at(p: str, s: str, q: str) -> Column:
        return F.col("series_key").eqNullSafe(F.col(s)) & F.col("step").eqNullSafe(F.col(q)) & (F.col("gone") == F.col(f"{p}_gone")) & (F.col("new") == F.col(f"{p}_new"))

    all_pairs = pairs.join(exact, at("e", "e_s", "e_q"), "left").join(gaps, at("g", "g_series_key", "g_step"), "left")
    single = F.least(F.col("gone_once") / F.col("gone_total"), F.col("new_once") / F.col("new_total"))
    numeric = F.least((F.col("gone_total") - F.col("gone_words")) / F.col("gone_total"), (F.col("new_total") - F.col("new_words")) / F.col("new_total"))
    in_numbers = F.least(numeric, F.coalesce("in_numbers", F.lit(0.0)) + single * F.coalesce(1 - F.col("gap"), F.lit(0.0)))
    in_words, worded = F.coalesce("in_words", F.lit(0.0)), F.least(F.col("gone_words") / F.col("gone_total"), F.col("new_words") / F.col("new_total"))
    alike = in_words + in_numbers * F.when(worded > 0, F.least(F.lit(1.0), in_words / worded)).otherwise(1.0)
    return all_pairs.select(*by, alike.alias("alike")).filter("alike > 0")


def _likeness(a: dict, b: dict) -> float:
    """Overlap of two fields' value distributions, from 0 to 1."""
    na, nb = sum(a.values()), sum(b.values())
    if not na or not nb:
        return 0.0
    return sum(min(n / na, b[k] / nb) for k, n in a.items() if k in b)


def _name_parts(name: str) -> list[str]:
    return [p.lower() for p in _PARTS.findall(name)]


def renames(removed: dict[str, dict], added: dict[str, dict], alike: float = 0.5, known: dict[tuple[str, str], float] | None = None) -> list[tuple[str, str]]:
    """Pairs (old, new) of fields whose values go on under another name, best pairs first.

    Names that differ only in case and separators go together where their values do
    not contradict it; other pairs need value distributions that overlap by
    ``alike``, or a bit less where the names share a word.  known: the overlaps, where
    they were found before (``value_likeness``); else they come from the counts.
    """
    scored = []
    for old, a in removed.items():
        for new, b in added.items():
            like, pa, pb = _likeness(a, b) if known is None else known.get((old, new), 0.0), _name_parts(old), _name_parts(new)
            same = "".join(pa) == "".join(pb)
            shared = bool(set(pa) & set(pb))
            if same or like >= alike or shared and like >= 0.6 * alike:
                scored.append((-(like + same + 0.1 * shared), old, new))
    out, used = [], set()
    for _, old, new in sorted(scored):
        if ("o", old) not in used and ("n", new) not in used:
            used |= {("o", old), ("n", new)}
            out.append((old, new))
    return out


def _compare_files(pdf: pd.DataFrame) -> list[tuple]:
    out = []
    for r in pdf.itertuples():
        before, now = ({f["field"]: set(f["kinds"]) for f in x} for x in (r.before, r.fields))
        gone, new = sorted(before.keys() - now.keys()), sorted(now.keys() - before.keys())
        pairs = renames(dict.fromkeys(gone, {}), dict.fromkeys(new, {}), known={(p["gone"], p["new"]): p["alike"] for p in ([] if r.pairs is None else r.pairs)})
        moved, came = {a for a, _ in pairs}, {b for _, b in pairs}
        out += [(r.series_key, r.seq_key, "removed", k, None) for k in gone if k not in moved]
        out += [(r.series_key, r.seq_key, "added", k, None) for k in new if k not in came]
        out += [(r.series_key, r.seq_key, "renamed", a, b) for a, b in pairs]
        for a, b in [*pairs, *((k, k) for k in sorted(before.keys() & now.keys()))]:
            if before[a] and now[b] and before[a] != now[b]:
                out.append((r.series_key, r.seq_key, "type_changed", a, ",".join(sorted(now[b]))))
    return out


def field_changes(rows: DataFrame, series: str = "series_id", seq: str = "file_seq", payload: str = "payload", target: dict[str, str] | None = None) -> DataFrame:
    """(series, seq, ``change_kind``, ``field_name``, ``detail``) of every file against the one with the previous ``seq`` of its series.

    The payloads are ingested once into ``target`` (none: everything is rescued), and
    all comes from the typed, rescued and null fields, so the target changes no result.
    Null, empty, broken and repeated payloads change nothing; a file without any
    complete payload has no fields.  detail is the new name or the new kinds.  Of the
    values only those of fields that a file lost or won are counted.
    """
    table = rescued_rows(rows, series, seq, payload, target)
    files = file_fields(table, target)
    order = Window.partitionBy("series_key").orderBy("seq_key")
    before = stage(files.withColumns({"before": F.lag("fields").over(order), "before_key": F.lag("seq_key").over(order)}).filter(F.col("before").isNotNull()), "fields")
    kinds = dict(files.dtypes)
    names = {c: F.transform(c, lambda f: f["field"]) for c in ("before", "fields")}
    steps = before.select("series_key", "seq_key", "before_key", F.array_except(names["before"], names["fields"]).alias("gone"), F.array_except(names["fields"], names["before"]).alias("new")).filter((F.size("gone") > 0) & (F.size("new") > 0))
    counts = stage(_value_counts(table, steps, target), "values")
    likely = value_likeness(counts).groupBy(F.col("series_key").alias("l_s"), F.col("step").alias("l_q")).agg(F.collect_list(F.struct("gone", "new", "alike")).alias("pairs"))
    before = before.join(likely, F.col("series_key").eqNullSafe(F.col("l_s")) & F.col("seq_key").eqNullSafe(F.col("l_q")), "left")

    def run(batches):
        for b in batches:
            yield pd.DataFrame(_compare_files(b), columns=["series_key", "seq_key", "change_kind", "field_name", "detail"])

    out = before.select("series_key", "seq_key", "fields", "before", "pairs").mapInPandas(run, f"series_key {kinds['series_key']}, seq_key {kinds['seq_key']}, change_kind string, field_name string, detail string")
    return out.withColumnsRenamed({"series_key": series, "seq_key": seq})


def renamed_to(changes: DataFrame, target: dict[str, str], known: dict[str, str] | None = None, most_names: int = 10_000) -> dict[str, str]:
    """``known`` names of target fields, and those that renames tie to exactly one target field: {name: target field}.

    changes: as ``field_changes`` gives them.  Only distinct name pairs reach the
    driver; they are bounded by the fields that exist, and more than ``most_names``
    of them are an error.
    """
    pairs = changes.filter("change_kind = 'renamed'").select("field_name", "detail").distinct().limit(most_names + 1).collect()
    if len(pairs) > most_names:
        raise ValueError(f"more than {most_names} distinct renames")
    known = known or {}
    near: dict[str, set[str]] = {}
    for a, b in [*pairs, *known.items()]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out: dict[str, set[str]] = {}
    for field in target:
        seen, todo = {field}, [field]
        while todo:
            for other in near.get(todo.pop(), ()):
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        for name in seen - {field}:
            out.setdefault(name, set()).add(field)
    return {name: min(fields) for name, fields in out.items() if len(fields) == 1 and name not in target} | known


def _typed(value: Column, kind: str) -> Column:
    """The value as ``kind``, or null where it does not fit: no object or array becomes a scalar, no number loses its fraction."""
    have = json_kind(value)
    if kind in ("int", "bigint", "double"):
        number = F.try_variant_get(value, "$", "double")
        return F.when(have.isin("number", "string") & number.isNotNull() & (F.lit(kind == "double") | (number == F.floor(number))), number.cast(kind))
    if kind == "boolean":
        return F.when(have.isin("boolean", "string"), F.try_variant_get(value, "$", "boolean"))
    return F.when(have.isin("string", "number", "boolean"), F.try_variant_get(value, "$", "string"))


def _of_kind(value: Column, kind: str) -> Column:
    """The value as ``kind`` where its JSON kind is the column's own, else null: "4" is no number, and a fraction no integer."""
    return F.when(json_kind(value) == _KINDS[kind], _typed(value, kind))


def ingest(rows: DataFrame, payload: str, target: dict[str, str], approved: dict[str, str] | None = None, filled: dict[str, Column] | None = None, strict: bool = False, keep_nulls: bool = False) -> DataFrame:
    """``rows`` without ``payload``, plus the target's typed columns, ``rescued`` and ``payload_state``.

    target: field to type (string, int, bigint, double, boolean).  approved: further
    field names whose values belong to a target field; of several that fit the first
    is taken.  filled: columns that hold a target field already, where they are not
    null.  strict: a value must have its column's JSON kind; others are rescued, to be
    cast by ``replay``.  keep_nulls: the names of fields with a JSON null come as
    ``null_fields``.  A field that is unknown or not taken, or whose value does not fit, stays in ``rescued`` as JSON, under its own name; a
    payload that is no complete object stays there whole, under ``_payload``.
    payload_state is complete, broken or missing.  A typed column whose name is
    taken gets a numbered one.
    """
    approved = approved or {}
    m = temp_name(rows.columns, "payload_fields")
    names = {f: [f, *[a for a, t in sorted(approved.items()) if t == f]] for f in target}
    keep = [c for c in rows.columns if c != payload]
    values, typed, takers = [], [], []
    for field, kind in target.items():
        free, own = (filled or {}).get(field, F.lit(None)).isNull(), []
        for n in names[field]:
            value = temp_name(rows.columns, f"payload_value_{len(values)}")
            values.append((_of_kind if strict else _typed)(F.try_element_at(m, F.lit(n)), kind).alias(value))
            own.append(F.col(value))
            takers.append(F.when(free & F.col(value).isNotNull(), F.lit(n)))
            free = free & F.col(value).isNull()
        typed.append(F.coalesce(*own).alias(temp_name(keep, field)))
    # names whose value was taken: bound once a row, as the filter below asks for every field
    taken = temp_name(rows.columns, "payload_taken")
    df = rows.withColumn(m, payload_map(F.col(payload))).select("*", *values)
    df = df.withColumn(taken, F.array_compact(F.array(*takers)) if takers else F.array().cast("array<string>"))
    left = F.map_filter(m, lambda k, v: v.isNotNull() & ~F.is_variant_null(v) & ~F.array_contains(taken, k))
    whole = F.when(F.col(m).isNull() & F.col(payload).isNotNull(), F.to_json(F.create_map(F.lit("_payload"), F.col(payload))))
    rescued = F.coalesce(whole, F.when(F.size(left) > 0, F.to_json(left))).alias(temp_name([*keep, *target], "rescued"))
    state = F.when(F.col(payload).isNull(), "missing").when(F.col(m).isNull(), "broken").otherwise("complete").alias(temp_name([*keep, *target], "payload_state"))
    nulls = F.map_keys(F.map_filter(m, lambda k, v: v.isNull() | F.is_variant_null(v))).alias(temp_name([*keep, *target], "null_fields"))
    return df.select(*keep, *typed, rescued, *([nulls] if keep_nulls else []), state)


def replay(table: DataFrame, target: dict[str, str], approved: dict[str, str], rescued: str = "rescued") -> DataFrame:
    """``table`` with rescued values of newly approved fields moved into typed columns.

    A new target field gets a column; an existing column only takes a rescued value
    where it is null, else the value stays rescued.
    """
    filled = {c: F.col(f"_old_{c}") for c in table.columns if c in target}
    again = ingest(table.withColumn("_rescued_payload", F.coalesce(rescued, F.lit("{}"))).withColumnsRenamed({c: f"_old_{c}" for c in table.columns}), "_rescued_payload", target, approved, filled)
    out = []
    for c in table.columns:
        if c == rescued:
            out.append(F.col("rescued").alias(rescued))
        else:
            out.append((F.coalesce(F.col(f"_old_{c}"), F.col(c)) if c in target else F.col(f"_old_{c}")).alias(c))
    return again.select(*out, *[F.col(f) for f in target if f not in table.columns])
