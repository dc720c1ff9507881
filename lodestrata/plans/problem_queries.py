"""Registered queries of the general data-preparation operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import Field, compare_copies
from ..operators.drift import field_changes, ingest, renamed_to, replay
from ..operators.shred import shred_links, shred_tables

# The target table of the result rows; other names of its fields are found by renames.
RESULT_FIELDS = {
    "task_id": "string", "input_type": "string", "output_type": "string", "cache_algorithm_revision": "string", "protection_signal_source": "string",
    "protection_budget_model": "string", "key_bits": "double", "value_bits": "double", "residual_length": "double", "official_prompt": "boolean", "final_score": "double",
}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [Field("query"), Field("generation_protocol"), Field("final_eval_score", 1e-6)]
    return compare_copies(_t(spark, sf_dir, "evaluation"), _t(spark, sf_dir, "evaluation_copy"), {"run_id": None, "task_id": "number"}, fields, "missing_in_evaluation", "missing_in_copy")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = "task_traces"
    kinds = {at: ("task", [1, 0, 0]), f"{at}.positions": ("position", [1, 2, 0]), f"{at}.frozen_token_ids": ("frozen_id", [1, 2, 0]), f"{at}.positions.top_tokens": ("top_token", [1, 2, 3])}
    return shred_links(_t(spark, sf_dir, "traces"), "trace_id", at, kinds)


def _trace_table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: shred_tables(_t(spark, sf_dir, "traces"), "trace_id", "task_traces")[name].withColumnRenamed("record_key", "trace_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_changes(_t(spark, sf_dir, "result_rows"), target=RESULT_FIELDS).drop("detail")


def p6_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result rows under the target's own names, values of another kind and other fields rescued."""
    return ingest(_t(spark, sf_dir, "result_rows"), "payload", RESULT_FIELDS, strict=True).select("row_id", *RESULT_FIELDS, "payload_state")


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consistent table: ingested, then the rescued values replayed under the names that renames tie to the target."""
    rows = _t(spark, sf_dir, "result_rows")
    known = ingest(rows, "payload", RESULT_FIELDS, strict=True)
    return replay(known, RESULT_FIELDS, renamed_to(field_changes(rows, target=RESULT_FIELDS), RESULT_FIELDS))


def p6_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target field: values that the first ingestion took, and values after the replay of what it rescued."""
    rows = _t(spark, sf_dir, "result_rows")
    out = None
    for step, table in (("ingested", ingest(rows, "payload", RESULT_FIELDS, strict=True)), ("replayed", p6_table(spark, sf_dir))):
        counts = table.agg(*[F.count(f).alias(f) for f in RESULT_FIELDS])
        one = counts.select(F.lit(step).alias("step"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in RESULT_FIELDS])).alias("e")).select("step", "e.*")
        out = one if out is None else out.unionByName(one)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p3_found": p3_found,
        "p5_found": p5_found,
        "p5_tasks": _trace_table("task_traces"),
        "p5_positions": _trace_table("task_traces.positions"),
        "p5_frozen_ids": _trace_table("task_traces.frozen_token_ids"),
        "p5_top_tokens": _trace_table("task_traces.positions.top_tokens"),
        "p6_found": p6_found,
        "p6_ingest": p6_ingest,
        "p6_table": p6_table,
        "p6_replay": p6_replay,
    }


_E = "unnest(task_traces) AS t, unnest(range(len(task_traces))) AS i"


def oracle_sql() -> dict[str, str]:
    number = "lpad(CAST(CAST(regexp_extract(task_id, '[0-9]+') AS BIGINT) AS VARCHAR), 6, '0')"
    side = "SELECT DISTINCT run_id, {n} AS task_id, {q} AS query, {p} AS generation_protocol, final_eval_score FROM {t}"
    a, b = (side.format(n=number, q="query", p="generation_protocol", t=t) for t in ("evaluation", "evaluation_copy"))
    lines = r"regexp_replace(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[ \t]+' || chr(10), chr(10), 'g'), '[\s]+$', '')"
    a, b = (s.replace("query AS query", f"nfc_normalize({lines.format(x='query')}) AS query") for s in (a, b))
    tasks = f"SELECT trace_id, {_E} FROM traces"
    links = "CAST(i AS INTEGER) AS ord_1, CAST(j AS INTEGER) AS ord_2"
    positions = "SELECT trace_id, i, unnest(t.positions) AS p, unnest(range(len(t.positions))) AS j FROM x"
    at = "json_extract(p, '$.{f}')"
    taken = {
        "string": f"CASE WHEN json_type({at}) = 'VARCHAR' THEN json_extract_string(p, '$.{{f}}') END AS {{f}}",
        "double": f"CASE WHEN json_type({at}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST({at} AS DOUBLE) END AS {{f}}",
        "boolean": f"CASE WHEN json_type({at}) = 'BOOLEAN' THEN CAST({at} AS BOOLEAN) END AS {{f}}",
    }
    columns = ", ".join(taken[kind].format(f=f) for f, kind in RESULT_FIELDS.items())
    return {
        "p6_ingest": f"SELECT row_id, {columns}, CASE WHEN payload IS NULL THEN 'missing' WHEN p IS NULL THEN 'broken' ELSE 'complete' END AS payload_state FROM (SELECT row_id, payload, CASE WHEN json_valid(payload) AND trim(payload) LIKE '{{%' THEN CAST(payload AS JSON) END AS p FROM result_rows)",
        "p3_found": f"WITH a AS ({a}), b AS ({b}), j AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.task_id, b.task_id) AS task_id, a.run_id IS NULL AS na, b.run_id IS NULL AS nb, a.query IS DISTINCT FROM b.query AS dq, a.generation_protocol IS DISTINCT FROM b.generation_protocol AS dp, NOT (coalesce(abs(a.final_eval_score - b.final_eval_score) <= 1e-6, false) OR (a.final_eval_score IS NULL AND b.final_eval_score IS NULL)) AS ds FROM a FULL JOIN b ON a.run_id = b.run_id AND a.task_id = b.task_id) "
        "SELECT DISTINCT * FROM (SELECT run_id, task_id, 'missing_in_copy' AS diff_kind FROM j WHERE nb UNION ALL SELECT run_id, task_id, 'missing_in_evaluation' FROM j WHERE na UNION ALL SELECT run_id, task_id, 'query' FROM j WHERE dq AND NOT na AND NOT nb UNION ALL SELECT run_id, task_id, 'generation_protocol' FROM j WHERE dp AND NOT na AND NOT nb UNION ALL SELECT run_id, task_id, 'final_eval_score' FROM j WHERE ds AND NOT na AND NOT nb)",
        "p5_found": f"WITH x AS ({tasks}), y AS ({positions}), f AS (SELECT trace_id, i, unnest(t.frozen_token_ids) AS p, unnest(range(len(t.frozen_token_ids))) AS j FROM x), z AS (SELECT trace_id, i, j, unnest(p.top_tokens) AS k, unnest(range(len(p.top_tokens))) AS l FROM y) "
        "SELECT trace_id, 'task' AS node_kind, CAST(i AS INTEGER) AS task_ord, -1 AS item_ord, -1 AS token_ord FROM x WHERE t IS NOT NULL UNION ALL SELECT trace_id, 'position', CAST(i AS INTEGER), CAST(j AS INTEGER), -1 FROM y WHERE p IS NOT NULL UNION ALL SELECT trace_id, 'frozen_id', CAST(i AS INTEGER), CAST(j AS INTEGER), -1 FROM f WHERE p IS NOT NULL UNION ALL SELECT trace_id, 'top_token', CAST(i AS INTEGER), CAST(j AS INTEGER), CAST(l AS INTEGER) FROM z WHERE k IS NOT NULL",
        "p5_tasks": f"WITH x AS ({tasks}) SELECT trace_id, CAST(i AS INTEGER) AS ord_1, t.task_id AS v_task_id, t.task_name AS v_task_name, t.input_type AS v_input_type, t.output_type AS v_output_type, t.prompt_tokens AS v_prompt_tokens, t.top1_disagreements_from_fp16 AS v_top1_disagreements_from_fp16, t.top1_disagreement_rate AS v_top1_disagreement_rate, t.structural_positions AS v_structural_positions FROM x WHERE t IS NOT NULL",
        "p5_positions": f"WITH x AS ({tasks}), y AS ({positions}) SELECT trace_id, {links}, p.prediction_index AS v_prediction_index, p.target_token_id AS v_target_token_id, p.target_token AS v_target_token, p.target_token_kind AS v_target_token_kind, p.target_log_probability AS v_target_log_probability, p.top1_token_id AS v_top1_token_id, p.top1_token AS v_top1_token FROM y WHERE p IS NOT NULL",
        "p5_top_tokens": f"WITH x AS ({tasks}), y AS ({positions}), z AS (SELECT trace_id, i, j, unnest(p.top_tokens) AS k, unnest(range(len(p.top_tokens))) AS l FROM y) SELECT trace_id, {links}, CAST(l AS INTEGER) AS ord_3, k.token_id AS v_token_id, k.token AS v_token, k.log_probability AS v_log_probability FROM z WHERE k IS NOT NULL",
        "p5_frozen_ids": f"WITH x AS ({tasks}), f AS (SELECT trace_id, i, unnest(t.frozen_token_ids) AS p, unnest(range(len(t.frozen_token_ids))) AS j FROM x) SELECT trace_id, CAST(i AS INTEGER) AS ord_1, CAST(j AS INTEGER) AS ord_2, p AS v_value FROM f WHERE p IS NOT NULL",
    }
