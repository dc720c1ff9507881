"""Column expressions for tasks, answers and configurations.

Everything here is a pure expression that stays inside whole-stage code
generation; nulls follow the rule given in each docstring.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of the answer protocol.
BEGIN_MARK, END_MARK, FENCE = "<|BEGIN_CODE|>", "<|END_CODE|>", "```"
# Leaderboard categories in report order and their full sizes.
CATEGORY_SIZES = {"T-generation": 250, "T-conversion": 700, "V-generation": 650, "V-conversion": 435}
# Fixed value: two scores this close are the same.
SAME_SCORE = 1e-12
_SPACE = r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Possessive, and the trailing run is tried at its beginning only, so inner white space costs nothing.
_EDGE_SPACE = rf"^[{_SPACE}]++|(?<![{_SPACE}])[{_SPACE}]++\z"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row.

    A lambda body evaluates everything it names again for every element; what does
    not depend on the element is bound outside with this.
    """
    return F.transform(F.array(value), use)[0]


def stripped(text: Column) -> Column:
    """Text without outer white space of any kind (``trim`` only knows the blank)."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def leaderboard_category(rendering: Column, input_type: Column) -> Column:
    """Track V where a task is rendered, else T; generation from Text, else conversion. Null rendering is T, null input a conversion."""
    track = F.when(F.coalesce(rendering, F.lit(False)), "V").otherwise("T")
    return F.concat(track, F.when(input_type.eqNullSafe("Text"), "-generation").otherwise("-conversion"))


def text_category(input_type: Column) -> Column:
    """The category without its track."""
    return F.when(input_type.eqNullSafe("Text"), "generation").otherwise("conversion")


def score_or_zero(score: Column) -> Column:
    """A score as double; null is 0."""
    return F.coalesce(score.cast("double"), F.lit(0.0))


def parsed_ok(render_score: Column) -> Column:
    """True where the render score is exactly 1."""
    return score_or_zero(render_score) == 1.0


def transition(before: Column, after: Column, tolerance: float = SAME_SCORE) -> Column:
    """improved, regressed or unchanged, by the difference of two scores; null counts as 0."""
    delta = score_or_zero(after) - score_or_zero(before)
    return F.when(delta > tolerance, "improved").when(delta < -tolerance, "regressed").otherwise("unchanged")


def parse_transition(before: Column, after: Column) -> Column:
    """both_pass, baseline_only, candidate_only or both_fail."""
    return F.when(before & after, "both_pass").when(before, "baseline_only").when(after, "candidate_only").otherwise("both_fail")


def stratum(input_type: Column, output_type: Column, one_output: bool = False) -> Column:
    """``input->output``, or the input alone where one output type is selected; null is ``unknown``."""
    left = F.coalesce(input_type, F.lit("unknown"))
    return left if one_output else F.concat_ws("->", left, F.coalesce(output_type, F.lit("unknown")))


def setting_text(present: Column, value: Column, default: Column) -> Column:
    """A setting as JSON text: the default only where the key is absent; an explicit null stays ``null``."""

    def encoded(c: Column) -> Column:
        return F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', 1), F.lit("null"))

    return F.when(F.coalesce(present, F.lit(False)), encoded(value)).otherwise(encoded(default))


def configuration_key(*settings: Column) -> Column:
    """One canonical text of many settings, to group by."""
    return F.to_json(F.array(*[F.coalesce(s, F.lit("null")) for s in settings]))


def checkpoint_key(index: Column, task_id: Column, bits: Column, key_bits: Column, value_bits: Column) -> Column:
    """``0007_<id>_K4_V2``: file-safe id, bits as default of both bit widths; a null id is ``missing``, a null index 0."""
    safe = F.regexp_replace(F.coalesce(F.when(task_id != "", task_id), F.lit("missing")), r"[^A-Za-z0-9_.-]+", "_")
    return F.format_string("%04d_%s_K%d_V%d", F.coalesce(index, F.lit(0)).cast("int"), safe, F.coalesce(key_bits, bits).cast("int"), F.coalesce(value_bits, bits).cast("int"))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in columns])


def preview(text: Column, size: int = 500) -> Column:
    """The first characters, line ends written as escapes; a display of the text, not a reading of it."""
    return F.replace(F.replace(F.substring(text, 1, size), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def json_number(value: Column) -> Column:
    """A double that JSON can hold: NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def method_label(protected: Column, signal: Column) -> Column:
    """How positions were protected: uniform, oracle-path-upper-bound or prompt-schema-lexical."""
    return F.when(~F.coalesce(protected, F.lit(False)), "uniform").when(signal == "oracle-paths", "oracle-path-upper-bound").otherwise("prompt-schema-lexical")


def readable_bytes(size: Column) -> Column:
    """Bytes with a unit, in steps of 1024."""
    units = ["B", "KB", "MB", "GB", "TB"]
    power = F.least(F.lit(len(units) - 1), F.when(size >= 1, F.floor(F.log(2.0, size.cast("double")) / 10 + 1e-12)).otherwise(0)).cast("int")
    return F.format_string("%.1f %s", size.cast("double") / F.pow(F.lit(1024.0), power), F.element_at(F.array(*map(F.lit, units)), power + 1))


#: The settings that make up a configuration, in the order of its key.
CONFIGURATION = (
    "bits", "key_bits", "value_bits", "cache_quantization_mode", "cache_algorithm_revision", "residual_length", "kv_group_size", "quantize_block_size", "structure_token_protection", "protection_signal_source", "protection_target", "protected_bits",
    "target_average_bits", "protection_budget_model", "protection_budget_order", "official_prompt", "official_extraction", "stop_on_end_code", "loop_ngram_size", "loop_repeat_threshold", "output_type", "structeval_manifest", "structeval_manifest_source_sha256",
)


def full_configuration(columns: list[str], defaults: dict[str, object] | None = None) -> Column:
    """The key of all settings of ``CONFIGURATION``: the column where there is one, else the setting's default, else null."""
    defaults = defaults or {}
    return configuration_key(*[setting_text(F.lit(c in columns), F.col(c) if c in columns else F.lit(None).cast("string"), F.lit(defaults.get(c))) for c in CONFIGURATION])


def filters(output_type: str | None = None, categories: list[str] | None = None, rendered: bool | None = None) -> list[Column]:
    """Pushable predicates of a task selection; an argument that is None selects all."""
    out = []
    if output_type is not None:
        out.append(F.col("output_type") == output_type)
    if categories is not None:
        out.append(F.col("category").isin(categories))
    if rendered is not None:
        out.append(F.coalesce(F.col("rendering"), F.lit(False)) == rendered)
    return out


# --- answers ------------------------------------------------------------


def _last_instr(text: Column, piece: str) -> Column:
    """1-based place of the last occurrence, 0 where there is none."""
    at = F.instr(F.reverse(text), piece[::-1])
    return F.when(at > 0, F.length(text) - at - len(piece) + 2).otherwise(0)


def marked_code(text: Column) -> Column:
    """Payload between the first begin and the last end marker, stripped; a missing marker means the text's edge."""
    t = F.coalesce(text, F.lit(""))
    begin, end = F.instr(t, BEGIN_MARK), _last_instr(t, END_MARK)
    start = F.when(begin > 0, begin + len(BEGIN_MARK)).otherwise(1)
    stop = F.when((end > 0) & (end >= start), end).otherwise(F.length(t) + 1)
    return stripped(F.substring(t, start, stop - start))


def marker_issues(text: Column) -> Column:
    """missing_begin_marker and missing_end_marker, as far as they apply."""
    t = F.coalesce(text, F.lit(""))
    begin, end = F.instr(t, BEGIN_MARK), _last_instr(t, END_MARK)
    start = F.when(begin > 0, begin + len(BEGIN_MARK)).otherwise(1)
    return F.array_compact(F.array(F.when(begin == 0, "missing_begin_marker"), F.when((end == 0) | (end < start), "missing_end_marker")))


def official_code(text: Column) -> Column:
    """Payload by priority: any fenced block, else a begin marker up to the next end marker or the end, else all; stripped.

    Angle entities are decoded and an empty thinking block is dropped first.
    """
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    t = F.replace(t, F.lit("<think>\n\n</think>\n\n"), F.lit(""))
    fence = r"(?s)```[^\n]*\n(.*?)(?:```|\z)"
    marked = r"(?is)<\|BEGIN_CODE\|>[ \t]*\n?(.*?)(?:<\|END_CODE\|>|\z)"
    clean = F.when(F.contains(t, F.lit(FENCE)) & t.rlike(fence), F.regexp_extract(t, fence, 1)).when(t.rlike(r"(?i)<\|BEGIN_CODE") & t.rlike(marked), F.regexp_extract(t, marked, 1)).otherwise(t)
    return stripped(clean)


def json_candidate(text: Column) -> Column:
    """The likeliest JSON in a text: a fenced block if there is one, then from the first opening to the last closing bracket."""
    t = F.coalesce(text, F.lit(""))
    fence = r"(?is)```(?:json)?\s*(.*?)```"
    fenced = F.regexp_extract(t, fence, 1)
    inner = F.when(F.contains(t, F.lit(FENCE)) & t.rlike(fence), stripped(fenced)).otherwise(t)

    def cut(x: Column) -> Column:
        start = F.least(F.nullif(F.instr(x["v"], "{"), F.lit(0)), F.nullif(F.instr(x["v"], "["), F.lit(0)))
        stop = F.greatest(_last_instr(x["v"], "}"), _last_instr(x["v"], "]"))
        ends = F.struct(x["v"].alias("v"), start.alias("start"), stop.alias("stop"))
        return let(ends, lambda e: stripped(F.when(e["start"].isNull(), e["v"]).when(e["stop"] > e["start"], F.substring(e["v"], e["start"], e["stop"] - e["start"] + 1)).otherwise(F.substring(e["v"], e["start"], F.length(e["v"])))))

    return let(F.struct(inner.alias("v")), cut)


def first_braces(text: Column) -> Column:
    """From the first opening to the next closing brace, or empty."""
    t = F.coalesce(text, F.lit(""))
    tail = F.when(F.instr(t, "{") > 0, F.substring(t, F.instr(t, "{"), F.length(t))).otherwise("")
    return let(tail, lambda x: F.substring(x, F.lit(1), F.instr(x, "}")))


def occurrences(text: Column, piece: str) -> Column:
    """How often a piece occurs, without overlaps."""
    t = F.coalesce(text, F.lit(""))
    return ((F.length(t) - F.length(F.replace(t, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def has_end_marker(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit(END_MARK)), F.lit(False))


def open_fence(text: Column) -> Column:
    """True where a fence is left open."""
    return occurrences(text, FENCE) % 2 == 1


def stop_reason(tokens: Column, limit: Column, text: Column, last_is_eos: Column) -> Column:
    """end_code, eos, max_new_tokens or unknown, in this order."""
    return F.when(has_end_marker(text), "end_code").when(F.coalesce(last_is_eos, F.lit(False)), "eos").when(tokens >= limit, "max_new_tokens").otherwise("unknown")


def required_share(text: Column, required: Column) -> Column:
    """Share of the required pieces that a text contains; 0 where none is required."""
    t = F.coalesce(text, F.lit(""))
    hit = F.size(F.filter(required, lambda r: F.contains(t, r)))
    return F.when(F.size(required) > 0, hit / F.size(required)).otherwise(0.0)


def built_prompt(query: Column, suffix: str, think_off: bool = False) -> Column:
    """A query with the protocol's suffix."""
    return F.concat(F.coalesce(query, F.lit("")), F.lit(suffix + (" /no_think" if think_off else "")))


def middle_cut(tokens: Column, limit: int) -> Column:
    """First and last half of an array that is longer than ``limit``; shorter ones stay."""
    half = limit // 2
    return F.when(F.size(tokens) > limit, F.concat(F.slice(tokens, 1, half), F.slice(tokens, -half, half)) if half else F.slice(tokens, 1, 0)).otherwise(tokens)


# --- terms and tokens -----------------------------------------------------


def identifier_parts(text: Column) -> Column:
    """Lower-case parts of an identifier with at least two characters, and the whole of it."""
    whole = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_]+", "_"), r"^_++|(?<!_)_++\z", ""))
    parts = F.filter(F.split(whole, "_+"), lambda x: F.length(x) >= 2)
    return F.array_distinct(F.concat(parts, F.when(F.length(whole) >= 2, F.array(whole)).otherwise(F.array().cast("array<string>"))))


#: What names a field in a prompt: XML tags, JSON keys, TOML keys and TOML tables.
VISIBLE_NAMES = (r"</?([A-Za-z_][A-Za-z0-9_-]*)\b", r"\"([A-Za-z_][A-Za-z0-9_.-]*)\"\s*:", r"(?md)^\s*([A-Za-z_][A-Za-z0-9_.-]*(?:\[[0-9*]+\])?)\s*=", r"(?md)^\s*\[\[?\s*([A-Za-z_][A-Za-z0-9_.-]*)\s*\]\]?")
#: Fixed value: a line of names parted by commas, without blanks.
_CSV_HEAD = r"^[A-Za-z_][A-Za-z0-9_.\[\]-]*(?:,[^\S ]*[A-Za-z_][A-Za-z0-9_.\[\]-]*[^\S ]*)+$"


def visible_terms(prompt: Column) -> Column:
    """Sorted identifier parts of the field names that a prompt shows, in its code blocks if it has some; null shows none."""
    p = F.coalesce(prompt, F.lit(""))
    closing = F.lower(p)
    closed = F.substring(p, 1, _last_instr(closing, "</code>") + len("</code>") - 1)  # what an open tag behind it would scan in vain
    blocks = F.regexp_extract_all(F.when(F.contains(closing, F.lit("</code>")), closed).otherwise(""), F.lit(r"(?is)<code>(.*?)</code>"), F.lit(1))
    scopes = F.when(F.size(blocks) > 0, blocks).otherwise(F.array(p))

    def names(scope: Column) -> Column:
        found = [F.regexp_extract_all(scope, F.lit(x), F.lit(1)) for x in VISIBLE_NAMES]
        heads = F.filter(F.transform(F.split(scope, r"\r?\n"), stripped), lambda x: x.rlike(_CSV_HEAD))
        return F.concat(*found, F.flatten(F.transform(heads, lambda x: F.transform(F.split(x, ","), stripped))))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(scopes, names)), identifier_parts))))


def path_terms(path: Column) -> Column:
    """Terms of one dotted path with weights: depth from 1, the leaf gets its depth once more, sub-parts half of it."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\[\d+\]|\*", ""), r"\.+"), lambda x: x != "")
    depth = F.size(parts)

    def weighed(name: Column, i: Column) -> Column:
        weight = (i + 1 + F.when(i == depth - 1, depth).otherwise(0)).cast("double")
        terms = identifier_parts(name)
        whole = F.lower(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_]+", "_"), r"^_++|(?<!_)_++\z", ""))
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.when(t == whole, weight).otherwise(weight / 2).alias("weight")))

    return F.flatten(F.transform(parts, weighed))


def fuzzy_hit(piece: Column, terms: Column) -> Column:
    """True where a normalised piece equals, holds or lies within one of the terms."""
    bare = F.lower(F.regexp_replace(F.coalesce(piece, F.lit("")), r"[^A-Za-z0-9_]+", ""))
    return let(bare, lambda p: (F.length(p) >= 2) & F.exists(terms, lambda t: F.contains(p, t) | F.contains(t, p)))


def fuzzy_score(piece: Column, terms: Column) -> Column:
    """The greatest weight of the terms (structs of ``term`` and ``weight``) that a normalised piece equals, holds or lies within; 0 for none."""
    bare = F.lower(F.regexp_replace(F.coalesce(piece, F.lit("")), r"[^A-Za-z0-9_]+", ""))
    hit = lambda p: F.filter(terms, lambda t: F.contains(p, t["term"]) | F.contains(t["term"], p))
    return let(bare, lambda p: F.when(F.length(p) >= 2, F.coalesce(F.array_max(F.transform(hit(p), lambda t: t["weight"])), F.lit(0.0))).otherwise(0.0))


def token_kind(token: Column) -> Column:
    """empty, whitespace, structural_marker, control_marker or content, tested in this order."""
    return F.when(F.coalesce(token, F.lit("")) == "", "empty").when(token.rlike(r"^\s+$"), "whitespace").when(token.rlike(r"[{}\[\]:,<>/=\"]"), "structural_marker").when(token.rlike(r"<\||\|>|BEGIN_CODE|END_CODE"), "control_marker").otherwise("content")


def structure_score(token: Column, terms: Column | None = None, control: float = 100.0, syntax: float = 4.0, term: float = 2.0) -> Column:
    """Weight of a token for protection: control markers, then JSON syntax, then visible terms, else 0."""
    base = F.when(token.rlike(r"BEGIN_CODE|END_CODE|<\||\|>"), control).when(token.rlike(r"[{}\[\]:,\"]"), syntax)
    return (base.when(fuzzy_hit(token, terms), term) if terms is not None else base).otherwise(0.0)


#: What is protected in each mode.
PROTECTION_MODES = ("none", "markers", "json-syntax", "json-constraints")


def protected_token(token: Column, mode: str, terms: Column | None = None) -> Column:
    """Whether a token is protected: in no mode but ``none`` are control markers left out; json-syntax adds JSON marks, json-constraints the visible terms too."""
    if mode not in PROTECTION_MODES:
        raise ValueError(f"unknown protection mode {mode}")
    kept = token.rlike(r"BEGIN_CODE|END_CODE|<\||\|>")
    if mode in ("json-syntax", "json-constraints"):
        kept = kept | token.rlike(r"[{}\[\]:,\"]")
    if mode == "json-constraints" and terms is not None:
        kept = kept | fuzzy_hit(token, terms)
    return F.lit(False) if mode == "none" else F.coalesce(kept, F.lit(False))


def simple_tokens(text: Column) -> Column:
    """Words, white-space runs and single marks of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]"), F.lit(0))


def tail_repeats(tokens: Column, n: int) -> Column:
    """How many times the last ``n`` tokens follow one another at the end; 1 for short arrays, empty ones and n <= 0."""
    if n <= 0:
        return F.lit(1)

    def count(t: Column) -> Column:
        size = F.size(t["all"])
        steps = F.sequence(F.lit(1), F.greatest(F.floor(size / n), F.lit(1)).cast("int"))
        same = F.transform(steps, lambda k: F.when(F.slice(t["all"], F.greatest(size - k * n + 1, F.lit(1)).cast("int"), F.lit(n)).eqNullSafe(t["tail"]), 1).otherwise(0))
        return let(same, lambda s: F.when(F.array_position(s, 0) == 0, F.size(s)).otherwise(F.array_position(s, 0) - 1)).cast("int")

    found = let(F.struct(tokens.alias("all"), F.slice(tokens, -n, n).alias("tail")), count)
    return F.when(F.size(tokens) < 2 * n, 1).otherwise(found).cast("int")


def task_list(raw: Column) -> Column:
    """Names of a comma list, stripped, without empty ones."""
    return F.filter(F.transform(F.split(raw, ","), stripped), lambda x: x != "")


def guarded_ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    """part / whole, or the default where whole is 0 or null."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(default))


def set_fingerprint(ids: Column) -> Column:
    """First 12 hex digits of the SHA-256 of the sorted ids joined by line ends; repeated ids count."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), "\n"), 256), 1, 12)


def suffix_sum(sizes: Column, *suffixes: str) -> Column:
    """Sum of the map values whose key ends with one of the suffixes."""
    hit = F.map_filter(sizes, lambda k, v: reduce(lambda a, b: a | b, [F.endswith(k, F.lit(s)) for s in suffixes]))
    return F.aggregate(F.map_values(hit), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def cache_bytes(batch: Column, layers: Column, heads: Column, length: Column, dim: Column, width: Column) -> Column:
    """Bytes of a key-value cache of full precision."""
    return (batch * layers * 2 * heads * length * dim * width).cast("long")


def effective_bits(n: Column, protected: Column, residual: Column, base: Column, high: Column, full: int = 16) -> Column:
    """Mean bits of n tokens: the last ``residual`` at full width, ``protected`` older ones at high, the rest at base; 0 for n = 0."""
    kept = F.least(F.greatest(residual, F.lit(0)), n)
    up = F.least(F.greatest(protected, F.lit(0)), n - kept)
    return F.when(n > 0, (kept * full + up * high + (n - kept - up) * base) / n).otherwise(0.0)


def generation_limit(requested: Column, context: Column, prompt: Column) -> Column:
    """Requested tokens, or what the context leaves; an error where nothing is left."""
    left = context - prompt
    return F.when(requested > 0, requested).when(left > 0, left).otherwise(F.raise_error(F.lit("the prompt leaves no room to generate")).cast("int"))
