"""Registered queries of gates, reports, configurations, terms and further intervals, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import columns as C
from ..functions import parsers as X
from ..operators import manifests as M
from ..operators import pairing as P
from ..operators import statistics as S
from ..operators import traces as T
from ..operators import validate as V
from ..sources import files, sinks
from ..staging import shared_dir
from .reference_queries import CATEGORY, LATEST, PAIRS, STRATUM, TASKS, Query, _categorised, _latest, _pairs, _t, _tasks, decimal_rounds

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = decimal_rounds(sql)
        return f

    return add


# --- gates ------------------------------------------------------------------------------

TEXT_SIZES = {"T-generation": 250, "T-conversion": 700}


def _rules(source: str, group: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {group}, '{n}' AS rule, CAST({e} AS BIGINT) AS violations FROM {source} GROUP BY 1" for n, e in rules.items())


@query(f"WITH {LATEST}, c AS (SELECT *, {CATEGORY} AS category FROM latest) " + _rules("c", "run_condition", {"row_count": "abs(count(*) - 950)", "scored_rows": "abs(count(final_eval_score) - 950)", "unscored_rows": "count(*) FILTER (WHERE final_eval_score IS NULL)", **{f"category_{k}": f"abs(count(*) FILTER (WHERE category = '{k}') - {n})" for k, n in TEXT_SIZES.items()}}))
def summary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary_gate(_categorised(_latest(spark, sf_dir)), "run_condition", "final_eval_score", "category", TEXT_SIZES)


_OUTPUTS = ("JSON", "XML", "YAML", "TOML", "CSV")


@query(_rules("allformats_100_category_balanced_seed42", "pool_id", {"row_count": "abs(count(*) - 100)", "null_key": "count(*) FILTER (WHERE task_id IS NULL OR task_id = '')", "repeated_key": "count(task_id) - count(DISTINCT task_id)", **{f"category_{k}": f"abs(count(*) FILTER (WHERE leaderboard_category = '{k}') - 25)" for k in C.CATEGORY_SIZES}, "other_category": "count(*) FILTER (WHERE coalesce(leaderboard_category, '') NOT IN ('T-generation', 'T-conversion', 'V-generation', 'V-conversion'))", **{f"output_{o}": f"abs(count(*) FILTER (WHERE lower(output_type) = '{o.lower()}') - 20)" for o in _OUTPUTS}, "other_output": "count(*) FILTER (WHERE coalesce(lower(output_type), '') NOT IN ('json', 'xml', 'yaml', 'toml', 'csv'))"}))
def manifest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps each pool from being a manifest of 100 rows, 25 of each category and 20 of each notation."""
    return V.manifest_gate(_t(spark, sf_dir, "allformats_100_category_balanced_seed42"), "pool_id", "task_id", "leaderboard_category", "output_type", 100, dict.fromkeys(C.CATEGORY_SIZES, 25), dict.fromkeys(_OUTPUTS, 20))


@query("""WITH e AS (SELECT DISTINCT task_id FROM tasks WHERE NOT coalesce(rendering, false)), r AS (SELECT run_condition, task_id, count(*) AS n, max(e.task_id) AS k FROM evaluation LEFT JOIN e USING (task_id) GROUP BY 1, 2), """ + "x AS (" + _rules("evaluation", "run_condition", {"missing_render_score": "count(*) FILTER (WHERE render_score IS NULL)", "missing_generated_tokens": "count(*) FILTER (WHERE generated_tokens IS NULL)", "other_key_bits": "count(*) FILTER (WHERE key_bits IS DISTINCT FROM 4)", "other_value_bits": "count(*) FILTER (WHERE value_bits IS DISTINCT FROM 4)", "several_generation_protocol": "greatest(count(DISTINCT coalesce(generation_protocol, 'null')) - 1, 0)"}) + """)
 SELECT * FROM x UNION ALL SELECT run_condition, 'missing_key', (SELECT count(*) FROM e) - count(*) FILTER (WHERE k IS NOT NULL) FROM r GROUP BY 1 UNION ALL SELECT run_condition, 'unexpected_key', count(*) FILTER (WHERE k IS NULL) FROM r GROUP BY 1 UNION ALL SELECT run_condition, 'repeated_key', CAST(sum(n - 1) AS BIGINT) FROM r GROUP BY 1""")
def result_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps each condition's rows from being one 4-bit result of all textual tasks."""
    expected = _t(spark, sf_dir, "tasks").filter(~F.coalesce(F.col("rendering"), F.lit(False)))
    return V.result_gate(_t(spark, sf_dir, "evaluation"), expected, "run_condition", "task_id", ["render_score", "generated_tokens"], {"key_bits": 4, "value_bits": 4}, ["generation_protocol"])


@query("WITH j AS (SELECT m.pool_id, t.ord, lag(t.ord) OVER (PARTITION BY m.pool_id ORDER BY m.selection_index, m.task_id) AS b FROM allformats_100_category_balanced_seed42 m JOIN (SELECT task_id, min(ord) AS ord FROM tasks GROUP BY 1) t USING (task_id)) SELECT pool_id, count(*) FILTER (WHERE b > ord) AS inversions FROM j GROUP BY 1")
def order_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.order_violations(_t(spark, sf_dir, "allformats_100_category_balanced_seed42"), _t(spark, sf_dir, "tasks"), "pool_id", "task_id", "selection_index", "ord")


@query("SELECT pool_id, count(*) AS rows, CAST(sum(selection_index) AS BIGINT) AS places FROM allformats_100_category_balanced_seed42 GROUP BY 1")
def order_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools and their order hash; the hash itself has no SQL, its rows and places do."""
    m = _t(spark, sf_dir, "allformats_100_category_balanced_seed42")
    hashes = P.same_order(m, "pool_id", "task_id", "selection_index")
    return hashes.join(m.groupBy("pool_id").agg(F.sum("selection_index").alias("places")), "pool_id").select("pool_id", "rows", "places")


@query(f"WITH {TASKS} SELECT task_id, category, row_number() OVER (ORDER BY ord) - 1 AS selection_index, 'category-complete' AS sampling, 42 AS seed FROM tk WHERE category IN ('T-generation', 'V-conversion')")
def complete_category_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.complete_categories(_tasks(spark, sf_dir), "category", ["T-generation", "V-conversion"], "ord", 42, list(C.CATEGORY_SIZES))
    return rows.select("task_id", "category", F.col("selection_index").cast("long").alias("selection_index"), "sampling", "seed")


# --- pairs ----------------------------------------------------------------------------


@query(f"""WITH {PAIRS} SELECT run_condition, round(avg(score_delta), 6) AS mean_delta, count(*) FILTER (WHERE score_delta < 0) AS regressed, count(*) FILTER (WHERE score_delta > 0) AS improved, count(*) FILTER (WHERE score_delta = 0) AS unchanged,
 count(*) FILTER (WHERE base_parsed AND NOT cand_parsed) AS new_parse_failures, count(*) FILTER (WHERE NOT base_parsed AND cand_parsed) AS parse_recoveries, count(*) FILTER (WHERE path_delta < 0) AS path_regressions FROM pairs GROUP BY 1""")
def strict_sign_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison by the sign of the difference, without a tolerance."""
    d = F.col("score_delta")
    return _pairs(spark, sf_dir).groupBy("run_condition").agg(
        F.round(F.avg(d), 6).alias("mean_delta"), F.count_if(d < 0).alias("regressed"), F.count_if(d > 0).alias("improved"), F.count_if(d == 0).alias("unchanged"),
        F.count_if(F.col("base_parsed") & ~F.col("cand_parsed")).alias("new_parse_failures"), F.count_if(~F.col("base_parsed") & F.col("cand_parsed")).alias("parse_recoveries"), F.count_if(F.col("path_delta") < 0).alias("path_regressions"),
    )


@query(f"""WITH {LATEST}, p AS (SELECT c.run_condition, b.task_id, coalesce(b.final_eval_score, 0) AS bs, coalesce(c.final_eval_score, 0) AS cs, coalesce(b.key_validation_score, 0) AS bp, coalesce(c.key_validation_score, 0) AS cp FROM latest b JOIN latest c USING (task_id) WHERE b.run_condition = 'fp16' AND c.run_condition <> 'fp16')
 SELECT run_condition, count(*) AS common_tasks, round(avg(bs), 6) AS base_score, round(avg(cs), 6) AS cand_score, round(avg(cs - bs), 6) AS score_delta, round(avg(bp), 6) AS base_path, round(avg(cp), 6) AS cand_path, round(avg(cp - bp), 6) AS path_delta FROM p GROUP BY 1""")
def six_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of both sides and of their difference, of two scores, over the tasks that both have."""
    p = P.lenient_pairs(*[_latest(spark, sf_dir).drop("text").filter(f"run_condition {op} 'fp16'") for op in ("=", "<>")], "task_id")
    means = [F.round(F.avg(x), 6).alias(n) for k, c in (("score", "final_eval_score"), ("path", "key_validation_score")) for b, d in [(C.score_or_zero(F.col(f"base.{c}")), C.score_or_zero(F.col(f"cand.{c}")))] for n, x in ((f"base_{k}", b), (f"cand_{k}", d), (f"{k}_delta", d - b))]
    return p.groupBy(F.col("cand.run_condition").alias("run_condition")).agg(F.count("*").alias("common_tasks"), *means)


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_condition ORDER BY task_id) AS n FROM pairs WHERE base_parsed AND NOT cand_parsed) SELECT run_condition, task_id FROM r WHERE n <= 10")
def first_induced_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten failures of each condition that its baseline did not have, by task."""
    lists = P.induced_failures(_pairs(spark, sf_dir)).groupBy("run_condition").agg(F.slice(F.array_sort(F.collect_set("task_id")), 1, 10).alias("t"))
    return lists.select("run_condition", F.explode("t").alias("task_id"))


@query()
def worst_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten JSON pairs that agree least, leaf by leaf."""
    answers = _latest(spark, sf_dir).filter("output_type = 'JSON'").select("run_condition", "task_id", C.official_code(F.col("text")).alias("code"))
    pairs = P.lenient_pairs(answers.filter("run_condition = 'fp16'"), answers.filter("run_condition <> 'fp16'"), "task_id")
    scored = pairs.select("task_id", F.col("cand.run_condition").alias("run_condition"), X.leaf_agreement("base.code", "cand.code").alias("a")).select("task_id", "run_condition", "a.f1", "a.exact")
    return P.worst(scored.filter("f1 IS NOT NULL AND NOT exact"), 10, "f1", "task_id", "run_condition")


@query(f"""WITH {LATEST}, w AS (SELECT DISTINCT task_id FROM tasks WHERE rendering) SELECT 'found' AS kind, task_id FROM latest WHERE run_condition = 'fp16' AND task_id IN (SELECT task_id FROM w) UNION ALL SELECT 'missing', task_id FROM w WHERE task_id NOT IN (SELECT task_id FROM latest WHERE run_condition = 'fp16' AND task_id IS NOT NULL)""")
def wanted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the rendered tasks, and the rendered tasks without one."""
    rows, missing = P.lookup(_latest(spark, sf_dir).filter("run_condition = 'fp16'").select("task_id"), _t(spark, sf_dir, "tasks").filter("rendering").select("task_id"), "task_id")
    return rows.select(F.lit("found").alias("kind"), "task_id").unionByName(missing.select(F.lit("missing").alias("kind"), "task_id"))


# --- traces ------------------------------------------------------------------------------


def _one_trace(condition: str) -> str:
    return f"(SELECT trace_method || '/' || seed AS k, arg_min(t, trace_id) AS t FROM (SELECT trace_id, trace_method, seed, run_condition, struct_pack(trace_method, model_name_or_path, model_revision, kivi_commit, seed, selected_task_ids, tt := list_filter(coalesce(task_traces, []), lambda x: x IS NOT NULL)) AS t FROM traces) WHERE run_condition = '{condition}' GROUP BY 1)"


_SAME_TASK = {**{f"task_{f}": f"x.{f} IS DISTINCT FROM y.{f}" for f in T.TASK}, "position_count": "coalesce(len(x.positions), 0) <> coalesce(len(y.positions), 0)"}
_IDS = "list_transform({0}.t.tt, lambda x: x.task_id)"


@query(
    f"WITH j AS (SELECT b.k, b.t AS b, c.t AS c FROM {_one_trace('fp16')} b JOIN {_one_trace('q4')} c USING (k)), u AS (SELECT k, unnest(b.tt) AS x, unnest(range(len(b.tt))) AS i FROM j), v AS (SELECT k, unnest(c.tt) AS x, unnest(range(len(c.tt))) AS i FROM j), "
    "ub AS (SELECT k, x.task_id AS id, arg_max(x, i) AS x, min(i) AS f FROM u GROUP BY 1, 2), vb AS (SELECT k, x.task_id AS id, arg_max(x, i) AS x, min(i) AS f FROM v GROUP BY 1, 2), "
    "o AS (SELECT k, string_agg(coalesce(id, 'null'), ',' ORDER BY f) AS ids FROM ub GROUP BY 1), o2 AS (SELECT k, string_agg(coalesce(id, 'null'), ',' ORDER BY f) AS ids FROM vb GROUP BY 1), s AS (SELECT ub.k, ub.id, ub.x, vb.x AS y FROM ub JOIN vb ON ub.k = vb.k AND ub.id IS NOT DISTINCT FROM vb.id) "
    + " UNION ALL ".join(f"SELECT k AS trace_key, 'header_{f}' AS violation, CAST(NULL AS VARCHAR) AS task_id FROM j WHERE b.{f} IS DISTINCT FROM c.{f}" for f in T.HEADER)
    + " UNION ALL SELECT j.k, 'task_order', NULL FROM j LEFT JOIN o USING (k) LEFT JOIN o2 USING (k) WHERE o.ids IS DISTINCT FROM o2.ids UNION ALL "
    + " UNION ALL ".join(f"SELECT k, '{n}', id FROM s WHERE {e}" for n, e in _SAME_TASK.items())
)
def trace_pair_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forbids comparing the first 4-bit trace of each method and seed with the first full-precision one."""
    t = _t(spark, sf_dir, "traces").withColumn("trace_key", F.concat_ws("/", "trace_method", F.col("seed").cast("string")))
    one = lambda c: t.filter(F.col("run_condition") == c).groupBy("trace_key").agg(F.min_by(F.struct(*[x for x in t.columns if x != "trace_key"]), "trace_id").alias("r")).select("trace_key", "r.*")
    return T.pair_violations(one("fp16"), one("q4"), "trace_key")


# --- intervals -----------------------------------------------------------------------------


def _boot_sql(seed: str, ends: str, value: str = "score_delta", extra: str = "") -> str:
    return f"""WITH {PAIRS}, num AS (SELECT run_condition, {value} AS v, row_number() OVER (PARTITION BY run_condition ORDER BY substr(md5(task_id), 1, 2), task_id) - 1 AS slot FROM pairs {extra}), sz AS (SELECT run_condition, count(*) AS n FROM num GROUP BY 1), reps AS (SELECT run_condition, n, rep, unnest(range(n)) AS i FROM (SELECT *, unnest(range(100)) AS rep FROM sz)),
 means AS (SELECT r.run_condition, r.rep, avg(v) AS m FROM reps r JOIN num ON num.run_condition = r.run_condition AND num.slot = CAST(('0x' || substr(md5('{seed}:' || rep || ':' || i), 1, 8)) AS BIGINT) % n GROUP BY 1, 2) {ends}"""


@query(_boot_sql("42", "SELECT run_condition, round(list_sort(list(m))[CAST(floor(99 * 0.025) AS BIGINT) + 1], 9) AS low, round(list_sort(list(m))[CAST(floor(99 * 0.975) AS BIGINT) + 1], 9) AS high FROM means GROUP BY 1"))
def floor_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = S.floor_interval(_pairs(spark, sf_dir), ["run_condition"], "score_delta", "task_id", 100, 42)
    return ends.select("run_condition", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


_SCHEDULE = [(c, m, 42 + 100 * i + j) for i, c in enumerate(("q2", "q4")) for j, m in enumerate(("score_delta", "path_delta"))]


@query(" UNION ALL ".join("SELECT * FROM (" + _boot_sql(str(s), f"SELECT run_condition, '{m}' AS measure, {s} AS seed, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM means GROUP BY 1", m, f"WHERE run_condition = '{c}'") + ")" for c, m, s in _SCHEDULE))
def scheduled_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two measures of two conditions, every interval with its own seed of the schedule."""
    ends = S.scheduled_intervals(_pairs(spark, sf_dir), ["q2", "q4"], "run_condition", ["score_delta", "path_delta"], "task_id", 100, 42)
    return ends.select("run_condition", "measure", "seed", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


_POISSON = " + ".join(f"(u >= {p!r})::INT" for p in S.POISSON)


@query(f"""WITH {PAIRS}, r AS (SELECT run_condition, score_delta AS v, rep, CAST(('0x' || substr(md5('42:' || rep || ':' || task_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM (SELECT *, unnest(range(200)) AS rep FROM pairs)), w AS (SELECT run_condition, rep, v, {_POISSON} AS w FROM r), means AS (SELECT run_condition, rep, sum(w * v) / sum(w) AS m FROM w GROUP BY 1, 2 HAVING sum(w) > 0)
 SELECT run_condition, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM means GROUP BY 1""")
def weighted_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = S.weighted_interval(_pairs(spark, sf_dir), ["run_condition"], "score_delta", "task_id", 200, 42)
    return ends.select("run_condition", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


# --- configurations, labels, projections ------------------------------------------------------


@query("""SELECT '[' || array_to_string(list_transform(['16', coalesce(CAST(key_bits AS VARCHAR), 'null'), coalesce(CAST(value_bits AS VARCHAR), 'null'), 'null', 'null', '128', 'null', 'null', 'null', 'null', 'null', 'null', 'null', 'null', 'null', 'true', 'null', 'null', 'null', 'null', coalesce('\\"' || output_type || '\\"', 'null'), 'null', 'null'], lambda x: '"' || x || '"'), ',') || ']' AS config, count(*) AS n FROM evaluation GROUP BY 1""")
def full_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the key of all settings; those that the table lacks have a default or are null."""
    e = _t(spark, sf_dir, "evaluation").select("key_bits", "value_bits", "output_type")
    return e.groupBy(C.full_configuration(e.columns, {"bits": 16, "residual_length": 128, "official_prompt": True}).alias("config")).agg(F.count("*").alias("n"))


@query(f"""WITH {LATEST}, c AS (SELECT run_condition, coalesce(input_type, 'unknown') AS i, count(*) AS n FROM latest GROUP BY 1, 2), k AS (SELECT run_condition, string_agg(i || ':' || n, ',' ORDER BY i) AS input_type_counts FROM c GROUP BY 1)
 SELECT run_condition, count(*) AS n, any_value(k.input_type_counts) AS input_type_counts, count(*) FILTER (WHERE render_score = 1) || '/' || count(*) AS parse_success, count(*) FILTER (WHERE key_validation_score = 1) || '/' || count(*) AS strict_full_paths, count(*) FILTER (WHERE stop_reason = 'max_new_tokens') || '/' || count(*) AS max_token_hits,
 round(avg(coalesce(key_validation_score, 0)), 4) AS mean_path_rate, round(avg(coalesce(final_eval_score, 0)), 4) AS mean_score, round(avg(coalesce(generated_tokens, 0)), 1) AS mean_tokens, round(avg(coalesce(generated_tokens, 0) * 512.0) / 1048576, 3) AS mean_storage_mb, round(avg(coalesce(generated_tokens, 0) * 2048.0) / 1048576, 3) AS mean_full_mb, round(avg(coalesce(generated_tokens, 0) * 2048.0) / avg(coalesce(generated_tokens, 0) * 512.0), 3) AS compression FROM latest JOIN k USING (run_condition) GROUP BY 1""")
def result_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares as ``k/n``, means, sizes in MB, a ratio of means and the counts of input types, per condition."""
    e = _latest(spark, sf_dir).drop("text").withColumn("i", F.coalesce("input_type", F.lit("unknown")))
    tokens = F.coalesce("generated_tokens", F.lit(0))
    share = lambda ok, name: F.concat(F.count_if(ok).cast("string"), F.lit("/"), F.count("*").cast("string")).alias(name)
    main = e.groupBy("run_condition").agg(
        F.count("*").alias("n"), share(F.col("render_score") == 1, "parse_success"), share(F.col("key_validation_score") == 1, "strict_full_paths"), share(F.col("stop_reason") == "max_new_tokens", "max_token_hits"),
        F.round(F.avg(C.score_or_zero(F.col("key_validation_score"))), 4).alias("mean_path_rate"), F.round(F.avg(C.score_or_zero(F.col("final_eval_score"))), 4).alias("mean_score"), F.round(F.avg(tokens), 1).alias("mean_tokens"),
        F.avg(tokens * 512.0).alias("held"), F.avg(tokens * 2048.0).alias("whole"),
    )
    kinds = e.groupBy("run_condition", "i").agg(F.count("*").alias("k")).groupBy("run_condition").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "i", F.col("k").cast("string")))), ",").alias("input_type_counts"))
    return main.join(kinds, "run_condition").select("run_condition", "n", "input_type_counts", "parse_success", "strict_full_paths", "max_token_hits", "mean_path_rate", "mean_score", "mean_tokens", F.round(F.col("held") / 1048576, 3).alias("mean_storage_mb"), F.round(F.col("whole") / 1048576, 3).alias("mean_full_mb"), F.round(C.guarded_ratio(F.col("whole"), F.col("held"), 1.0), 3).alias("compression"))


@query("SELECT eval_id, run_condition, key_bits AS k_bits, coalesce(final_eval_score, 0) AS score, coalesce(render_score, 0) = 1 AS parsed, generated_tokens * 1024 AS cache_bytes FROM evaluation")
def result_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows as structs of run, treatment, outcome and storage, and fields of each read back."""
    rows = P.assembled(_t(spark, sf_dir, "evaluation").withColumn("cache_bytes", F.col("generated_tokens") * 1024), {"run": ["run_id", "run_condition", "export_source", "evaluated_at"], "treatment": ["key_bits", "value_bits", "generation_protocol"], "outcome": ["render_score", "key_validation_score", "final_eval_score", "stop_reason", "generated_tokens"], "storage": ["cache_bytes"]}, "eval_id", "task_id")
    return rows.select("eval_id", "run.run_condition", F.col("treatment.key_bits").alias("k_bits"), C.score_or_zero(F.col("outcome.final_eval_score")).alias("score"), C.parsed_ok(F.col("outcome.render_score")).alias("parsed"), "storage.cache_bytes")


@query("SELECT CASE WHEN input_type = 'Text' THEN 'generation' ELSE 'conversion' END AS category, count(*) AS n FROM tasks GROUP BY 1")
def text_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "tasks").groupBy(C.text_category(F.col("input_type")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(CASE WHEN abs(embedding[1]) > 0.1 THEN 1 / embedding[1]::DOUBLE END, 6) AS number FROM embeddings")
def json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverses of a value; what JSON cannot hold becomes null."""
    x = F.col("embedding")[0].cast("double")
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(C.json_number(F.when(F.abs(F.col("embedding")[0]) > 0.1, 1 / x).otherwise(F.lit(float("inf")))), 6).alias("number"))


@query("SELECT run_condition, CASE WHEN coalesce(key_bits, 16) >= 16 THEN 'uniform' WHEN export_source = (SELECT min(export_source) FROM evaluation) THEN 'oracle-path-upper-bound' ELSE 'prompt-schema-lexical' END AS label, count(*) AS n FROM evaluation GROUP BY 1, 2")
def method_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "evaluation").select("run_condition", "key_bits", "export_source")
    first = e.agg(F.min("export_source")).scalar()
    signal = F.when(F.col("export_source") == first, "oracle-paths").otherwise("prompt-terms")
    return e.groupBy("run_condition", C.method_label(F.coalesce("key_bits", F.lit(16)) < 16, signal).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT task_id, md5(coalesce(query, '') || chr(10) || 'Answer with the code only. /no_think') AS prompt FROM tasks")
def built_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "tasks").select("task_id", F.md5(C.built_prompt(F.col("query"), "\nAnswer with the code only.", True)).alias("prompt"))


@query("SELECT task_id, list_filter(list_transform(string_split(feature_requirements, ','), lambda x: trim(x)), lambda x: x <> '') AS names FROM tasks")
def task_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "tasks").select("task_id", C.task_list(F.col("feature_requirements")).alias("names"))


@query("SELECT eval_id, CASE WHEN generated_tokens > 64 THEN generated_tokens ELSE 4096 - length(query) END AS tokens FROM evaluation")
def generation_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("generated_tokens") > 64, F.col("generated_tokens"))
    return _t(spark, sf_dir, "evaluation").select("eval_id", C.generation_limit(asked, F.lit(4096), F.length("query")).alias("tokens"))


@query(f"WITH {TASKS} SELECT task_id FROM tk WHERE output_type = 'JSON' AND category IN ('T-generation', 'T-conversion') AND NOT coalesce(rendering, false)")
def selected_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection by output type, category and track; the output type reaches the scan."""
    t = _tasks(spark, sf_dir)
    for f in C.filters("JSON", ["T-generation", "T-conversion"], False):
        t = t.filter(f)
    return t.select("task_id")


@query("SELECT vec_id, round(list_sort(list_transform(embedding, lambda v: v::DOUBLE), 'DESC')[1], 6) AS best, round(list_sort(list_transform(embedding, lambda v: v::DOUBLE), 'DESC')[1] - list_sort(list_transform(embedding, lambda v: v::DOUBLE), 'DESC')[2], 6) AS margin FROM embeddings")
def best_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", A.top_with_margin(F.transform("embedding", lambda v: v.cast("double")), F.sequence(F.lit(0), F.size("embedding") - 1), 5).alias("t"))
    return e.select("vec_id", F.round(F.col("t.top")[0]["score"], 6).alias("best"), F.round("t.margin", 6).alias("margin"))


@query("SELECT vec_id, round(list_max(x) - list_max(x) - ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))), 6) AS best FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)")
def log_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of each vector's best value."""
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_max(A.log_softmax(F.transform("embedding", lambda v: v.cast("double")))), 6).alias("best"))


# --- protection --------------------------------------------------------------------------------


@query("""WITH tt AS (SELECT unnest(task_traces) AS t FROM traces), pp AS (SELECT unnest(t.positions) AS p FROM tt), k AS (SELECT coalesce(p.target_token, '') AS x FROM pp WHERE p IS NOT NULL), b AS (SELECT regexp_matches(x, 'BEGIN_CODE|END_CODE|<\\||\\|>') AS m, regexp_matches(x, '[{}\\[\\]:,"]') AS s FROM k)
 SELECT 'none' AS mode, CAST(0 AS BIGINT) AS kept, CAST(0 AS DOUBLE) AS weight FROM b GROUP BY 1 UNION ALL SELECT 'markers', count(*) FILTER (WHERE m), CAST(sum(CASE WHEN m THEN 100 ELSE 0 END) AS DOUBLE) FROM b UNION ALL SELECT 'json-syntax', count(*) FILTER (WHERE m OR s), CAST(sum(CASE WHEN m THEN 100 WHEN s THEN 4 ELSE 0 END) AS DOUBLE) FROM b""")
def protection_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that each mode protects, and their weight."""
    tokens = T.positions(_t(spark, sf_dir, "traces")).select(F.coalesce("target_token", F.lit("")).alias("x"))
    weight = C.structure_score(F.col("x"))
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), C.protected_token(F.col("x"), m).alias("kept"), (F.lit(0.0) if m == "none" else F.when(C.protected_token(F.col("x"), m), weight).otherwise(0.0)).alias("weight")) for m in ("none", "markers", "json-syntax")])
    return tokens.select(F.explode(modes).alias("m")).groupBy("m.mode").agg(F.count_if("m.kept").alias("kept"), F.sum("m.weight").alias("weight"))


@query()
def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per task: the pieces of its query's field names and the greatest weight of a required term that each matches."""
    t = _t(spark, sf_dir, "tasks").filter(F.size("raw_output_metric") > 0)
    terms = F.flatten(F.transform(F.filter("raw_output_metric", lambda p: p.isNotNull()), C.path_terms))
    w = t.select("task_id", F.explode(C.visible_terms(F.col("query"))).alias("piece"), terms.alias("terms"))
    return w.select("task_id", "piece", C.fuzzy_score(F.col("piece"), F.col("terms")).alias("weight"))


@query()
def compact_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fingerprints of each distinct run setting."""
    runs = _t(spark, sf_dir, "evaluation").select("run_condition", "key_bits", "value_bits", "generation_protocol").distinct()
    document = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return runs.select("*", X.fingerprint(document).alias("fingerprint"), X.compact_fingerprint(document).alias("compact"))


@query()
def decoded_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their backslash escapes decoded, by hash."""
    e = _t(spark, sf_dir, "evaluation").filter(F.contains("text", F.lit("\\")))
    return e.select("eval_id", F.md5(X.unescaped("text")).alias("decoded"))


@query("SELECT run_condition, CAST(count(*) AS DOUBLE) AS score FROM evaluation GROUP BY 1")
def plugged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer of one's own per condition, over the narrow columns that it needs: here it counts its rows in per-task batches.

    Each batch is scored on its own, and only the batches' scores are summed, so no condition is held by one task.
    """
    e = _t(spark, sf_dir, "evaluation").select("run_condition", F.concat_ws("/", "run_condition", F.pmod("eval_id", F.lit(64)).cast("string")).alias("batch"))
    parts = X.scored_by(e, "batch", len)
    return parts.groupBy(F.regexp_extract("batch", r"^(.*)/\d+$", 1).alias("run_condition")).agg(F.sum("score").alias("score"))


# --- sources ---------------------------------------------------------------------------------


@query("SELECT task_id, query, rendering FROM tasks")
def lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks written as JSON lines, then read with the check that names a broken line."""
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    sinks.write_json_lines(_t(spark, sf_dir, "tasks").select("task_id", "query", "rendering"), folder)
    return files.checked_lines(spark, folder, "task_id string, query string, rendering boolean")


@query("SELECT task_id FROM tasks")
def keys_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.keys_only(_t(spark, sf_dir, "tasks"), "task_id")


@query("SELECT output_type, count(*) AS n FROM tasks GROUP BY 1")
def variant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of any shape read as variants, one field of each."""
    t = _t(spark, sf_dir, "tasks")
    folder = f"{shared_dir(spark)}/variants-{uuid.uuid4().hex}"
    sinks.write_json_lines(t.select("task_id", "output_type", "vqa"), folder)
    records = files.first_records(spark, folder, t.count())
    return records.groupBy(F.try_variant_get("record", "$.output_type", "string").alias("output_type")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
