"""Parsers and path checks that the built-in functions cannot express, as Arrow-batched functions.

Built-in JSON functions accept trailing text and cannot tell null from absent;
strict parsing, error kinds, path existence and exact decimal rounding therefore
run in Python on whole batches.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import subprocess
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Error kinds by what each parser reports: JSON by its message, XML by its error number, YAML and TOML by the beginning of the problem they name.
_JSON_KINDS = {
    "Unterminated string starting at": "unterminated_string_or_token",
    "Invalid \\escape": "invalid_escape_or_control_character",
    "Invalid \\uXXXX escape": "invalid_escape_or_control_character",
    "Invalid control character at": "invalid_escape_or_control_character",
    "Expecting ',' delimiter": "unbalanced_or_mismatched_delimiter",
    "Expecting ':' delimiter": "unbalanced_or_mismatched_delimiter",
    "Expecting property name enclosed in double quotes": "unbalanced_or_mismatched_delimiter",
    "Extra data": "extra_content_or_multiple_roots",
}
_XML_KINDS = {
    3: "unbalanced_or_mismatched_delimiter",
    4: "invalid_token",
    5: "unterminated_string_or_token",
    7: "unbalanced_or_mismatched_delimiter",
    9: "extra_content_or_multiple_roots",
    14: "invalid_number",
}
_YAML_KINDS = {
    "mapping values are not allowed": "indentation_or_mapping_syntax",
    "could not find expected": "indentation_or_mapping_syntax",
    "found unknown escape": "invalid_escape_or_control_character",
    "expected escape sequence": "invalid_escape_or_control_character",
}
_TOML_KINDS = {
    "Unterminated string": "unterminated_string_or_token",
    "Unescaped": "invalid_escape_or_control_character",
    "Escaped": "invalid_escape_or_control_character",
    "Invalid initial character for a key": "invalid_key_syntax",
}


def _json_kind(error: Exception) -> str:
    said = getattr(error, "msg", "")  # an object nested too deeply has none
    if said == "Expecting value" and error.pos == 0:
        return "invalid_leading_token"
    return next((kind for begin, kind in _JSON_KINDS.items() if said.startswith(begin)), OTHER)


def _xml_kind(error: Exception) -> str:
    return _XML_KINDS.get(getattr(error, "code", None), OTHER)


def _yaml_kind(error: Exception) -> str:
    problem = getattr(error, "problem", None) or ""
    return next((kind for said, kind in _YAML_KINDS.items() if problem.startswith(said)), OTHER)


def _toml_kind(error: Exception) -> str:
    return next((kind for said, kind in _TOML_KINDS.items() if str(error).startswith(said)), OTHER)


OTHER = "other_parser_error"
_KIND_OF = {"JSON": _json_kind, "XML": _xml_kind, "YAML": _yaml_kind, "TOML": _toml_kind}


def _yaml(text: str) -> object:
    import yaml

    return yaml.safe_load(text)


def _row(**kinds: T.DataType) -> T.StructType:
    """A result type without a session (DDL text needs one)."""
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_TEXT, _REAL, _WHOLE, _FLAG = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()
_PARSERS: dict[str, Callable[[str], object]] = {"JSON": json.loads, "XML": ET.fromstring, "TOML": tomllib.loads, "CSV": lambda t: list(csv.reader(io.StringIO(t), strict=True)), "YAML": _yaml}


def parse_outcome(notation: str | None, code: str | None) -> tuple[str, str]:
    """(kind, message) of strictly parsing a payload; local_parser_succeeded, unsupported_format and parser_unavailable are kinds too.

    A payload that begins with a written-out line end or tab failed for that reason,
    whatever its parser says.
    """
    if notation not in _PARSERS:
        return "unsupported_format", f"no parser for {notation}"
    text = code or ""
    failure = None
    try:
        _PARSERS[notation](text)
    except ModuleNotFoundError:
        return "parser_unavailable", f"no parser for {notation} is installed"
    except Exception as error:  # every parser has its own kinds of errors
        failure = error
    if failure is None:
        return "local_parser_succeeded", ""
    message = " ".join(str(failure).split("\n"))
    if text[:2] in ("\\n", "\\r", "\\t"):
        return "literal_escaped_layout_outside_string", message
    return _KIND_OF[notation](failure) if notation in _KIND_OF else OTHER, message


@F.pandas_udf(_row(kind=_TEXT, message=_TEXT))
def parse_kind(notation: pd.Series, code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_outcome(n, c) for n, c in zip(notation, code)], columns=["kind", "message"])


def failure_kind(stop: Column, issues: Column, code: Column, parser_kind: Column) -> Column:
    """Why an answer failed: the limit, a missing marker, an empty payload, then the parser's kind."""
    return F.when(stop == "max_new_tokens", "generation_limit").when(F.size(issues) > 0, issues[0]).when(F.coalesce(code, F.lit("")) == "", "empty_payload").otherwise(parser_kind)


def split_path(path: str) -> list[str | int]:
    """``a.b[0].*`` as keys and places."""
    out: list[str | int] = []
    for part in re.findall(r"\[\d+\]|[^\[\].]+", path):
        out.append(int(part[1:-1]) if part[0] == "[" else part)
    return out


def path_exists(value: object, path: list[str | int]) -> bool:
    """True where a path leads somewhere, to a null as well; ``*`` stands for any element of an array, not of an object."""
    reached = [value]
    for step in path:
        found = []
        for v in reached:
            if step == "*":
                found += v if isinstance(v, list) else []
            elif isinstance(step, int):
                found += v[step : step + 1] if isinstance(v, list) else []
            elif isinstance(v, dict) and step in v:
                found.append(v[step])
        reached = found
    return bool(reached)


@F.pandas_udf(_row(parsed=_FLAG, present=T.ArrayType(_TEXT), missing=T.ArrayType(_TEXT), share=_REAL))
def path_report(document: pd.Series, required: pd.Series) -> pd.DataFrame:
    """Strict JSON and its required paths; share is 0 where nothing is required or nothing parses."""
    rows = []
    for doc, req in zip(document, required):
        req = [] if req is None else [str(r) for r in req if r is not None]
        try:
            value, ok = json.loads(doc), True
        except (TypeError, ValueError):
            value, ok = None, False
        there = [r for r in req if ok and value is not None and path_exists(value, split_path(r))]
        rows.append((ok, there, [r for r in req if r not in there], len(there) / len(req) if req else 0.0))
    return pd.DataFrame(rows, columns=["parsed", "present", "missing", "share"])


def leaves(value: object, path: str = "$") -> dict[str, str]:
    """Leaf paths with their canonical JSON; an empty object or array is a leaf."""
    out: dict[str, str] = {}
    todo = [(path, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict) and v:
            todo += [(f"{at}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            todo += [(f"{at}[{i}]", x) for i, x in enumerate(v)]
        else:
            out[at] = json.dumps(v, sort_keys=True, ensure_ascii=False)
    return out


@F.pandas_udf(_row(base_leaves=_WHOLE, cand_leaves=_WHOLE, precision=_REAL, recall=_REAL, f1=_REAL, common_accuracy=_REAL, path_jaccard=_REAL, exact=_FLAG))
def leaf_agreement(base: pd.Series, cand: pd.Series) -> pd.DataFrame:
    """Agreement of two JSON documents leaf by leaf; all null where the base does not parse, an unparsed candidate has no leaves."""
    rows = []
    for b, c in zip(base, cand):
        try:
            vb = json.loads(b)
        except (TypeError, ValueError):
            rows.append((None,) * 8)
            continue
        try:
            vc, lc = json.loads(c), None
            lc = leaves(vc)
        except (TypeError, ValueError):
            vc, lc = object(), {}
        lb = leaves(vb)
        same = len(lb.items() & lc.items())
        common, union = lb.keys() & lc.keys(), lb.keys() | lc.keys()
        p, r = same / len(lc) if lc else 0.0, same / len(lb) if lb else 0.0
        rows.append((len(lb), len(lc), p, r, 2 * p * r / (p + r) if p + r else 0.0, same / len(common) if common else 0.0, len(common) / len(union) if union else 1.0, vb == vc))
    return pd.DataFrame(rows, columns=["base_leaves", "cand_leaves", "precision", "recall", "f1", "common_accuracy", "path_jaccard", "exact"])


@F.pandas_udf(_REAL)
def final_score(render: pd.Series, path: pd.Series) -> pd.Series:
    """0.2 render + 0.8 path to two places, rounding the exact binary value, ties to even, as the published scores do."""
    return pd.Series([None if pd.isna(r) or pd.isna(p) else round(0.2 * r + 0.8 * p, 2) for r, p in zip(render, path)], dtype="float64")


@F.pandas_udf(_TEXT)
def unescaped(text: pd.Series) -> pd.Series:
    """Backslash escapes decoded; a text with a broken escape, and characters beyond ASCII, stay as they are."""

    def one(t):
        if not isinstance(t, str) or "\\" not in t:
            return t
        try:
            return re.sub(r"(?:\\(?:[abfnrtv\\'\"0]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))+", lambda m: m.group().encode("ascii").decode("unicode_escape"), t)
        except UnicodeDecodeError:
            return t

    return text.map(one)


def _hashed(document: object, **form: object) -> str | None:
    try:
        return hashlib.sha256(json.dumps(json.loads(document), sort_keys=True, **form).encode()).hexdigest()
    except (TypeError, ValueError):
        return None


@F.pandas_udf(_TEXT)
def fingerprint(document: pd.Series) -> pd.Series:
    """SHA-256 of JSON with sorted keys and default separators; null where it does not parse."""
    return document.map(_hashed)


@F.pandas_udf(_TEXT)
def compact_fingerprint(document: pd.Series) -> pd.Series:
    """SHA-256 of JSON with sorted keys and no blanks; null where it does not parse."""
    return document.map(lambda d: _hashed(d, separators=(",", ":")))


def external_scores(df: DataFrame, key: str, text: str, command: list[str], timeout: float = 600.0) -> DataFrame:
    """(``key``, ``score``): each batch as JSON lines (key, text) through an external program, which answers one JSON line (key, score) per row.

    One process per batch and task, so the cluster's cores are the concurrency; the
    program runs as given, so a sandbox is part of the command.  A program that
    fails, stays silent on a row or runs too long is an error.  Null texts are empty.
    """
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            lines = "".join(json.dumps({"key": str(k), "text": t or ""}) + "\n" for k, t in zip(b["k"], b["t"]))
            done = subprocess.run(command, input=lines, capture_output=True, text=True, timeout=timeout, check=True)
            scores = {r["key"]: float(r["score"]) for r in map(json.loads, done.stdout.splitlines())}
            yield pd.DataFrame({key: b["k"], "score": [scores[str(k)] for k in b["k"]]})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, score double")


def scored_by(df: DataFrame, group: str, scorer: Callable[[pd.DataFrame], float], name: str = "score") -> DataFrame:
    """A plug-in scorer over each group's rows; a group must fit one task, as the scorer sees it whole."""
    kind = dict(df.dtypes)[group]
    return df.groupBy(group).applyInPandas(lambda pdf: pd.DataFrame({group: [pdf[group].iloc[0]], name: [float(scorer(pdf))]}), f"{group} {kind}, {name} double")
