"""Registered queries of the paired-evaluation operators, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import columns as C
from ..operators import aggregates as G
from ..operators import manifests as M
from ..operators import pairing as P
from ..operators import statistics as S
from ..operators import traces as T
from ..operators import validate as V

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decimal_rounds(sql: str) -> str:
    """``round(x, n)`` of an SQL text on decimals, as Spark rounds: ties on the printed number, not on the binary one."""
    out, at = [], 0
    for m in re.finditer(r"(?<![\w.])round\(", sql):
        if m.start() < at:
            continue
        depth, comma, i = 1, 0, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        out += [sql[at : m.start()], f"CAST(round(CAST({decimal_rounds(sql[m.end() : comma])} AS DECIMAL(38, 15)){sql[comma:i]} AS DOUBLE)"]
        at = i
    return "".join([*out, sql[at:]])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = decimal_rounds(sql)
        return f

    return add


# --- evaluated rows ----------------------------------------------------------

LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_condition, task_id ORDER BY evaluated_at DESC NULLS LAST, eval_id DESC) AS rn FROM evaluation) WHERE rn = 1)"""
CATEGORY = "(CASE WHEN input_type = 'Text' THEN 'T-generation' ELSE 'T-conversion' END)"
PAIRS = f"""{LATEST}, pairs AS (SELECT c.run_condition, b.task_id, b.input_type, b.output_type, {CATEGORY.replace("input_type", "b.input_type")} AS category,
 coalesce(b.final_eval_score, 0) AS base_score, coalesce(c.final_eval_score, 0) AS cand_score, coalesce(c.final_eval_score, 0) - coalesce(b.final_eval_score, 0) AS score_delta,
 coalesce(c.key_validation_score, 0) - coalesce(b.key_validation_score, 0) AS path_delta, coalesce(b.render_score, 0) = 1 AS base_parsed, coalesce(c.render_score, 0) = 1 AS cand_parsed
 FROM latest b JOIN latest c ON b.task_id = c.task_id WHERE b.run_condition = 'fp16' AND c.run_condition <> 'fp16')"""


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest_per(_t(spark, sf_dir, "evaluation"), ["run_condition", "task_id"], [F.col("evaluated_at").desc_nulls_last(), F.col("eval_id").desc()])


def _categorised(df: DataFrame) -> DataFrame:
    return df.withColumn("category", C.leaderboard_category(F.lit(False), F.col("input_type")))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = _latest(spark, sf_dir).drop("text")
    base, cand = latest.filter("run_condition = 'fp16'"), latest.filter("run_condition <> 'fp16'")
    p = P.scored(P.lenient_pairs(base, cand, "task_id"))
    return p.select("task_id", F.col("cand.run_condition").alias("run_condition"), F.col("base.input_type").alias("input_type"), F.col("base.output_type").alias("output_type"), C.leaderboard_category(F.lit(False), F.col("base.input_type")).alias("category"), *[c for c in p.columns if c not in ("task_id", "base", "cand")])


@query(f"WITH {LATEST} SELECT eval_id, run_condition, task_id FROM latest")
def latest_by_config(spark, sf_dir):
    return _latest(spark, sf_dir).select("eval_id", "run_condition", "task_id")


@query(f"""WITH {LATEST}, m AS (SELECT run_condition, {CATEGORY} AS category, count(final_eval_score) AS scored, count(*) FILTER (WHERE final_eval_score IS NULL) AS unscored, avg(final_eval_score) AS m FROM latest GROUP BY 1, 2)
 SELECT run_condition, CAST(sum(scored) AS BIGINT) AS scored, CAST(sum(unscored) AS BIGINT) AS unscored, CASE WHEN count(m) = 2 THEN round(avg(m), 6) END AS macro_score, CASE WHEN count(m) = 2 THEN round(avg(m) * 100, 2) END AS macro_percent,
 round(sum(m * scored) / sum(scored), 6) AS task_weighted_score, count(m) = 2 AND bool_and(scored = CASE category WHEN 'T-generation' THEN 250 ELSE 700 END AND unscored = 0) AS complete FROM m GROUP BY 1""")
def macro_category_summary(spark, sf_dir):
    return G.macro_summary(_categorised(_latest(spark, sf_dir)), ["run_condition"], "category", "final_eval_score", {"T-generation": 250, "T-conversion": 700})


@query(f"""WITH {LATEST} SELECT run_condition, output_type, count(*) AS n_rows, round(avg(final_eval_score), 6) AS mean_score, count(*) FILTER (WHERE render_score = 1) AS parsed,
 round(avg(CASE WHEN render_score = 1 THEN 1 ELSE 0 END), 6) AS parse_share, round(avg(coalesce(key_validation_score, 0)), 6) AS mean_path, count(*) FILTER (WHERE final_eval_score = 1) AS perfect FROM latest GROUP BY 1, 2""")
def format_summary(spark, sf_dir):
    return G.format_summary(_latest(spark, sf_dir), ["run_condition", "output_type"], "final_eval_score", "render_score", "key_validation_score")


@query(f"""WITH {LATEST}, m AS (SELECT run_condition, {CATEGORY} AS category, avg(final_eval_score) * 100 AS p FROM latest GROUP BY 1, 2) SELECT run_condition, round(avg(round(p, 2)), 2) AS mean_of_rounded, count(p) AS parts FROM m GROUP BY 1""")
def pilot_average(spark, sf_dir):
    means = G.category_means(_categorised(_latest(spark, sf_dir)), ["run_condition"], "category", "final_eval_score").withColumn("percent", F.col("mean_score") * 100)
    return G.mean_of_rounded(means, ["run_condition"], "percent", 2)


_REPORT = """count(*) AS pairs, count(*) FILTER (WHERE base_parsed AND cand_parsed) AS parse_both_pass, count(*) FILTER (WHERE base_parsed AND NOT cand_parsed) AS parse_baseline_only, count(*) FILTER (WHERE NOT base_parsed AND cand_parsed) AS parse_candidate_only, count(*) FILTER (WHERE NOT base_parsed AND NOT cand_parsed) AS parse_both_fail,
 count(*) FILTER (WHERE score_delta > 1e-12) AS score_improved, count(*) FILTER (WHERE score_delta < -1e-12) AS score_regressed, count(*) FILTER (WHERE abs(score_delta) <= 1e-12) AS score_unchanged,
 count(*) FILTER (WHERE path_delta > 1e-12) AS path_improved, count(*) FILTER (WHERE path_delta < -1e-12) AS path_regressed, count(*) FILTER (WHERE abs(path_delta) <= 1e-12) AS path_unchanged"""


@query(f"WITH {PAIRS} SELECT run_condition, {_REPORT}, round(avg(score_delta), 6) AS mean_score_delta, round(avg(path_delta), 6) AS mean_path_delta FROM pairs GROUP BY 1")
def paired_comparison(spark, sf_dir):
    r = P.transition_report(_pairs(spark, sf_dir), "run_condition")
    return r.withColumns({c: F.round(c, 6) for c in ("mean_score_delta", "mean_path_delta")})


@query(f"WITH {PAIRS} SELECT run_condition, category, output_type, CAST(grouping(category) AS INTEGER) AS g_category, CAST(grouping(output_type) AS INTEGER) AS g_output, count(*) AS pairs, count(*) FILTER (WHERE base_parsed AND NOT cand_parsed) AS lost, round(avg(score_delta), 6) AS mean_delta FROM pairs GROUP BY GROUPING SETS ((run_condition), (run_condition, category), (run_condition, output_type))")
def paired_transitions(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    p.createOrReplaceTempView("_paired_rows")
    return spark.sql("SELECT run_condition, category, output_type, CAST(grouping(category) AS INT) AS g_category, CAST(grouping(output_type) AS INT) AS g_output, count(*) AS pairs, count_if(base_parsed AND NOT cand_parsed) AS lost, round(avg(score_delta), 6) AS mean_delta FROM _paired_rows GROUP BY GROUPING SETS ((run_condition), (run_condition, category), (run_condition, output_type))")


@query(f"WITH {PAIRS} SELECT run_condition, output_type, count(*) FILTER (WHERE base_parsed AND NOT cand_parsed) AS lost, count(*) FILTER (WHERE NOT base_parsed AND cand_parsed) AS won FROM pairs GROUP BY 1, 2")
def discordant_counts(spark, sf_dir):
    return P.transition_report(_pairs(spark, sf_dir), "run_condition", "output_type").select("run_condition", "output_type", F.col("parse_baseline_only").alias("lost"), F.col("parse_candidate_only").alias("won"))


@query(f"""WITH {PAIRS}, d AS (SELECT run_condition, output_type, count(*) FILTER (WHERE base_parsed AND NOT cand_parsed) AS b, count(*) FILTER (WHERE NOT base_parsed AND cand_parsed) AS c FROM pairs GROUP BY 1, 2)
 SELECT run_condition, output_type, b AS lost, c AS won, CASE WHEN b + c = 0 THEN 1.0 ELSE round(least(1.0, 1e-13 + 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0))) FROM unnest(range(least(b, c) + 1)) AS u(k))), 9) END AS p_value FROM d""")
def mcnemar_by_group(spark, sf_dir):
    return discordant_counts(spark, sf_dir).withColumn("p_value", F.round(F.least(F.lit(1.0), S.mcnemar(F.col("lost"), F.col("won")) + 1e-13), 9))


@query(f"WITH {PAIRS} SELECT run_condition, input_type, count(*) FILTER (WHERE base_parsed) AS base_passes, count(*) FILTER (WHERE base_parsed AND NOT cand_parsed) AS induced, round(CASE WHEN count(*) FILTER (WHERE base_parsed) > 0 THEN count(*) FILTER (WHERE base_parsed AND NOT cand_parsed) / count(*) FILTER (WHERE base_parsed) ELSE 0 END, 6) AS induced_share FROM pairs GROUP BY 1, 2")
def induced_failures(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    g = p.groupBy("run_condition", "input_type").agg(F.count_if("base_parsed").alias("base_passes"), F.count_if(F.col("base_parsed") & ~F.col("cand_parsed")).alias("induced"))
    return g.withColumn("induced_share", F.round(C.guarded_ratio(F.col("induced"), F.col("base_passes")), 6))


@query(f"WITH {PAIRS} SELECT run_condition, task_id, round(score_delta, 6) AS score_delta FROM pairs ORDER BY round(score_delta, 6), task_id, run_condition LIMIT 20")
def largest_regressions(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("run_condition", "task_id", F.round("score_delta", 6).alias("score_delta"))
    return P.worst(p, 20, "score_delta", "task_id", "run_condition")


def _boot(seed: int) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || rep || ':' || i), 1, 8)) AS BIGINT) % n"


@query(f"""WITH {PAIRS}, num AS (SELECT run_condition, score_delta, row_number() OVER (PARTITION BY run_condition ORDER BY substr(md5(task_id), 1, 2), task_id) - 1 AS slot FROM pairs), sz AS (SELECT run_condition, count(*) AS n FROM num GROUP BY 1),
 reps AS (SELECT run_condition, n, rep, unnest(range(n)) AS i FROM (SELECT *, unnest(range(200)) AS rep FROM sz)), means AS (SELECT r.run_condition, r.rep, avg(score_delta) AS m FROM reps r JOIN num ON num.run_condition = r.run_condition AND num.slot = {_boot(42)} GROUP BY 1, 2)
 SELECT run_condition, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM means GROUP BY 1""")
def bootstrap_ci(spark, sf_dir):
    return _rounded_ends(S.bootstrap_interval(_pairs(spark, sf_dir), ["run_condition"], "score_delta", "task_id", 200, 42))


@query(f"""WITH {PAIRS}, num AS (SELECT run_condition, category, score_delta, row_number() OVER (PARTITION BY run_condition, category ORDER BY substr(md5(task_id), 1, 2), task_id) - 1 AS slot FROM pairs), sz AS (SELECT run_condition, category, count(*) AS n FROM num GROUP BY 1, 2),
 reps AS (SELECT run_condition, category, n, rep, unnest(range(n)) AS i FROM (SELECT *, unnest(range(200)) AS rep FROM sz)), means AS (SELECT r.run_condition, r.category, r.rep, avg(score_delta) AS m FROM reps r JOIN num ON num.run_condition = r.run_condition AND num.category = r.category AND num.slot = {_boot(7)} GROUP BY 1, 2, 3),
 macro AS (SELECT run_condition, rep, avg(m) AS m FROM means GROUP BY 1, 2) SELECT run_condition, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM macro GROUP BY 1""")
def stratified_bootstrap_ci(spark, sf_dir):
    return _rounded_ends(S.stratified_interval(_pairs(spark, sf_dir), ["run_condition"], "category", "score_delta", "task_id", 200, 7))


def _rounded_ends(df: DataFrame) -> DataFrame:
    return df.withColumns({"low": F.round("low", 9), "high": F.round("high", 9)})


@query(f"""WITH {LATEST} SELECT run_condition, key_bits, generation_protocol, count(*) AS n_rows, count(*) FILTER (WHERE render_score = 1) || '/' || count(*) AS parsed, round(avg(coalesce(key_validation_score, 0)), 6) AS mean_path, round(avg(coalesce(final_eval_score, 0)), 6) AS mean_score,
 substr(sha256(string_agg(DISTINCT task_id, chr(10) ORDER BY task_id)), 1, 12) AS task_set FROM latest GROUP BY 1, 2, 3""")
def config_matrix(spark, sf_dir):
    return G.config_matrix(_latest(spark, sf_dir), ["run_condition", "key_bits", "generation_protocol"], "task_id", "render_score", "key_validation_score", "final_eval_score")


@query(f"""WITH {LATEST}, m AS (SELECT run_condition, {CATEGORY} AS category, round(avg(final_eval_score), 6) AS v FROM latest GROUP BY 1, 2) SELECT run_condition, max(v) FILTER (WHERE category = 'T-generation') AS "T-generation", max(v) FILTER (WHERE category = 'T-conversion') AS "T-conversion" FROM m GROUP BY 1""")
def condition_matrix(spark, sf_dir):
    means = G.category_means(_categorised(_latest(spark, sf_dir)), ["run_condition"], "category", "final_eval_score").withColumn("v", F.round("mean_score", 6))
    return G.condition_matrix(means, "run_condition", "category", "v", ["T-generation", "T-conversion"])


@query("SELECT export_source, stop_reason, count(*) AS n FROM evaluation GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return G.duplicates(_t(spark, sf_dir, "evaluation"), "export_source", "stop_reason")


@query("""SELECT 'unscored' AS kind, eval_id FROM evaluation WHERE final_eval_score IS NULL""")
def unscored_rows(spark, sf_dir):
    return _t(spark, sf_dir, "evaluation").filter(F.col("final_eval_score").isNull()).select(F.lit("unscored").alias("kind"), "eval_id")


@query("SELECT run_condition, round(avg(generated_tokens) / avg(render_score), 6) AS tokens_per_parse FROM evaluation GROUP BY 1")
def ratio_of_means(spark, sf_dir):
    r = G.ratio_of_means(_t(spark, sf_dir, "evaluation"), ["run_condition"], "generated_tokens", "render_score", "tokens_per_parse")
    return r.withColumn("tokens_per_parse", F.round("tokens_per_parse", 6))


# --- percentiles ----------------------------------------------------------------


@query("""WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders WHERE o_totalprice IS NOT NULL)
 SELECT round(quantile_cont(v, 0.9), 6) AS linear, max(v) FILTER (WHERE i = CAST(round_even((n - 1) * 0.9, 0) AS BIGINT)) AS nearest, max(v) FILTER (WHERE i = CAST(floor((n - 1) * 0.9) AS BIGINT)) AS floored FROM r""")
def percentiles_three_ways(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").withColumn("all_rows", F.lit(1))
    a = G.interpolated_percentile(orders, ["all_rows"], "o_totalprice", 0.9, "linear").withColumn("linear", F.round("linear", 6))
    b = G.nearest_percentile(orders, ["all_rows"], "o_totalprice", 0.9, "nearest")
    return a.join(b, "all_rows").join(G.floor_percentile(orders, ["all_rows"], "o_totalprice", 0.9, "floored"), "all_rows").drop("all_rows")


# --- tasks, manifests and samples -----------------------------------------------

STRATUM = "coalesce(input_type, 'unknown') || '->' || coalesce(output_type, 'unknown')"


def _md5(seed: int, x: str) -> str:
    return f"md5('{seed}:' || coalesce(CAST({x} AS VARCHAR), ''))"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "tasks")
    return t.withColumn("stratum", C.stratum(F.col("input_type"), F.col("output_type"))).withColumn("category", C.leaderboard_category(F.col("rendering"), F.col("input_type")))


TASKS = f"tk AS (SELECT *, {STRATUM} AS stratum, (CASE WHEN rendering THEN 'V' ELSE 'T' END) || (CASE WHEN input_type = 'Text' THEN '-generation' ELSE '-conversion' END) AS category FROM tasks)"


@query(f"WITH {TASKS} SELECT task_id, stratum, category FROM tk")
def task_categories(spark, sf_dir):
    return _tasks(spark, sf_dir).select("task_id", "stratum", "category")


@query(f"""WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_md5(42, 'task_id')}, task_id) AS rn FROM tk), l AS (SELECT * FROM r ORDER BY rn, {_md5(42, 'stratum')}, stratum LIMIT 100)
 SELECT task_id, stratum, row_number() OVER (ORDER BY {_md5(43, 'task_id')}, task_id) - 1 AS selection_index FROM l""")
def stratified_sample(spark, sf_dir):
    return M.stratified_round_robin(_tasks(spark, sf_dir), "task_id", "stratum", 100, 42).select("task_id", "stratum", F.col("selection_index").cast("long").alias("selection_index"))


@query(f"""WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY category, stratum ORDER BY {_md5(42, 'task_id')}, task_id) AS rn FROM tk), u AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rn, {_md5(42, 'stratum')}, stratum) AS turn FROM r WHERE rn <= 25)
 SELECT task_id, category, row_number() OVER (ORDER BY {_md5(43, 'task_id')}, task_id) - 1 AS selection_index FROM u WHERE turn <= 25""")
def category_balanced_sample(spark, sf_dir):
    return M.category_balanced(_tasks(spark, sf_dir), "task_id", "category", "stratum", 25, 42).select("task_id", "category", F.col("selection_index").cast("long").alias("selection_index"))


@query(f"""WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS rn FROM tk) SELECT task_id, category FROM r ORDER BY rn, category LIMIT 20""")
def round_robin_smoke(spark, sf_dir):
    return M.round_robin(_tasks(spark, sf_dir), "category", "ord", 20).select("task_id", "category")


@query("SELECT task_id, ord FROM tasks ORDER BY ord LIMIT 10")
def head_sample(spark, sf_dir):
    return M.head(_t(spark, sf_dir, "tasks"), "ord", 10).select("task_id", "ord")


@query("SELECT output_type, task_id FROM (SELECT *, row_number() OVER (PARTITION BY output_type ORDER BY ord) AS rn FROM tasks) WHERE rn = 1")
def first_per_group(spark, sf_dir):
    return M.first_per(_t(spark, sf_dir, "tasks"), "output_type", "ord").select("output_type", "task_id")


@query("SELECT count(*) AS n_rows, max(ord) = count(*) - 1 AND count(DISTINCT ord) = count(*) AND min(ord) = 0 AS contiguous FROM tasks")
def contiguous_index(spark, sf_dir):
    return M.contiguous(_t(spark, sf_dir, "tasks"), "ord")


@query("SELECT count(*) AS n_rows, min(length(query)) AS min_length, max(length(query)) AS max_length, avg(length(query)) AS mean_length, min(coalesce(len(vqa), 0)) AS min_parts, max(coalesce(len(vqa), 0)) AS max_parts, avg(coalesce(len(vqa), 0)) AS mean_parts FROM tasks")
def dataset_profile(spark, sf_dir):
    p = G.profile(_t(spark, sf_dir, "tasks"), F.col("query"), F.col("vqa"))
    return p.withColumns({c: F.col(c).cast("long") for c in ("min_length", "max_length", "min_parts", "max_parts")})


@query(f"WITH {TASKS} SELECT stratum, count(*) AS n FROM tk GROUP BY 1 ORDER BY n DESC, stratum LIMIT 20")
def most_common_strata(spark, sf_dir):
    return G.most_common(_tasks(spark, sf_dir), "stratum", 20)


@query("""WITH m AS (SELECT pool_id, selection_index, task_id, input_type, output_type FROM allformats_100_category_balanced_seed42), s AS (SELECT * FROM tasks)
 SELECT m.pool_id, m.selection_index, m.task_id, s.ord FROM m JOIN s USING (task_id)""")
def manifest_join(spark, sf_dir):
    m = _t(spark, sf_dir, "allformats_100_category_balanced_seed42").select("pool_id", "selection_index", "task_id")
    joined = P.manifest_rows(_t(spark, sf_dir, "tasks").select("task_id", "ord"), m, "task_id", "selection_index", "ord", agree=())
    return joined.select(F.col("manifest_pool_id").alias("pool_id"), F.col("manifest_selection_index").alias("selection_index"), F.col("manifest_task_id").alias("task_id"), "ord")


@query("SELECT DISTINCT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def anti_join_resume(spark, sf_dir):
    jobs = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return P.unfinished(jobs, _t(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key")), "key")


@query("""SELECT 'intersect' AS op, count(*) AS n FROM (SELECT task_id FROM tasks INTERSECT SELECT task_id FROM evaluation) UNION ALL SELECT 'except', count(*) FROM (SELECT task_id FROM tasks EXCEPT SELECT task_id FROM evaluation) UNION ALL SELECT 'union', count(*) FROM (SELECT task_id FROM tasks UNION SELECT task_id FROM evaluation) UNION ALL SELECT 'bag', count(*) FROM (SELECT task_id FROM tasks UNION ALL SELECT task_id FROM evaluation)""")
def set_ops(spark, sf_dir):
    a, b = _t(spark, sf_dir, "tasks").select("task_id"), _t(spark, sf_dir, "evaluation").select("task_id")
    parts = {"intersect": a.intersect(b), "except": a.subtract(b), "union": a.union(b).distinct(), "bag": a.unionByName(b)}
    out = None
    for name, df in parts.items():
        one = df.groupBy().agg(F.lit(name).alias("op"), F.count("*").alias("n")).select("op", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH u AS (SELECT unnest(string_split(feature_requirements, '; ')) AS f FROM tasks WHERE feature_requirements <> '') SELECT f AS feature, count(*) AS n FROM u WHERE f <> '' GROUP BY 1""")
def feature_counts(spark, sf_dir):
    t = _t(spark, sf_dir, "tasks").filter("feature_requirements <> ''")
    return t.select(F.explode(F.split("feature_requirements", "; ")).alias("feature")).filter("feature <> ''").groupBy("feature").agg(F.count("*").alias("n"))


# --- strict pairing and gates -----------------------------------------------------


@query("""WITH b AS (SELECT task_id, any_value(query ORDER BY eval_id) AS query FROM evaluation WHERE run_condition = 'fp16' GROUP BY 1), c AS (SELECT task_id, any_value(query ORDER BY eval_id) AS query FROM evaluation WHERE run_condition = 'q4' GROUP BY 1)
 SELECT CASE WHEN b.task_id IS NULL THEN 'missing_in_base' ELSE 'missing_in_candidate' END AS violation, coalesce(b.task_id, c.task_id) AS key_text, CAST(1 AS BIGINT) AS rows FROM b FULL JOIN c USING (task_id) WHERE b.task_id IS NULL OR c.task_id IS NULL""")
def pair_violations(spark, sf_dir):
    latest = _latest(spark, sf_dir).drop("text")
    return P.pair_violations(latest.filter("run_condition = 'fp16'"), latest.filter("run_condition = 'q4'"), "task_id", ("input_type", "output_type", "query")).select("violation", "key_text", "rows")


@query("""SELECT 'category_T-conversion' AS rule, abs(count(*) FILTER (WHERE c = 'T-conversion') - 700) AS violations FROM (SELECT *, (CASE WHEN rendering THEN 'V' ELSE 'T' END) || (CASE WHEN input_type = 'Text' THEN '-generation' ELSE '-conversion' END) AS c FROM tasks)
 UNION ALL SELECT 'category_T-generation', abs(count(*) FILTER (WHERE NOT coalesce(rendering, false) AND input_type = 'Text') - 250) FROM tasks UNION ALL SELECT 'category_V-conversion', abs(count(*) FILTER (WHERE rendering AND input_type IS DISTINCT FROM 'Text') - 435) FROM tasks UNION ALL SELECT 'category_V-generation', abs(count(*) FILTER (WHERE rendering AND input_type = 'Text') - 650) FROM tasks
 UNION ALL SELECT 'missing_query', count(*) FILTER (WHERE query IS NULL OR query = '') FROM tasks UNION ALL SELECT 'missing_query_example', count(*) FILTER (WHERE query_example IS NULL OR query_example = '') FROM tasks UNION ALL SELECT 'null_key', count(*) FILTER (WHERE task_id IS NULL) FROM tasks UNION ALL SELECT 'repeated_key', count(task_id) - count(DISTINCT task_id) FROM tasks UNION ALL SELECT 'row_count', abs(count(*) - 2035) FROM tasks UNION ALL SELECT 'unknown_category', 0""")
def artifact_gate(spark, sf_dir):
    return V.gate(_tasks(spark, sf_dir), "task_id", ["query", "query_example"], None, 2035, C.CATEGORY_SIZES)


@query("SELECT 'missing' AS rule, CAST(o_orderkey AS VARCHAR) AS key_text FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT 'unexpected', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def key_difference(spark, sf_dir):
    return V.key_difference(_t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k"), _t(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k"), "k")


# --- traces -------------------------------------------------------------------------

POSITIONS = """tt AS (SELECT trace_id, run_condition, unnest(task_traces) AS t, unnest(range(len(task_traces))) AS task_ord FROM traces), pp AS (SELECT trace_id, run_condition, task_ord, t.task_id AS task_id, unnest(t.positions) AS p, unnest(range(len(t.positions))) AS item_ord FROM tt), ps AS (SELECT trace_id, run_condition, task_ord, task_id, item_ord, p.target_token_id AS tid, p.top1_token_id AS bid, p.target_token_kind AS kind FROM pp WHERE p IS NOT NULL AND p.target_token_id IS NOT NULL AND p.top1_token_id IS NOT NULL)"""
_DIS = """count(*) AS positions, count(*) FILTER (WHERE tid <> bid) AS disagreements, count(*) FILTER (WHERE kind IN ('structural_marker', 'control_marker')) AS structural_positions, count(*) FILTER (WHERE tid <> bid AND kind IN ('structural_marker', 'control_marker')) AS structural_disagreements"""


@query(f"WITH {POSITIONS} SELECT run_condition, {_DIS}, round(count(*) FILTER (WHERE tid <> bid) / count(*), 6) AS disagreement_share FROM ps GROUP BY 1")
def trace_disagreement(spark, sf_dir):
    d = T.disagreements(T.positions(_t(spark, sf_dir, "traces")), "run_condition")
    return d.select("run_condition", "positions", "disagreements", "structural_positions", "structural_disagreements", F.round("disagreement_share", 6).alias("disagreement_share"))


@query(f"WITH {POSITIONS} SELECT trace_id, CAST(task_ord AS INTEGER) AS task_ord, CAST(min(item_ord) FILTER (WHERE tid <> bid) AS INTEGER) AS first_disagreement FROM ps GROUP BY 1, 2")
def first_disagreement(spark, sf_dir):
    return T.disagreements(T.positions(_t(spark, sf_dir, "traces")), "trace_id", "task_ord").select("trace_id", "task_ord", "first_disagreement")


@query("""WITH tt AS (SELECT trace_id, unnest(task_traces) AS t FROM traces), pp AS (SELECT unnest(t.positions) AS p FROM tt), k AS (SELECT coalesce(p.target_token, '') AS x FROM pp WHERE p IS NOT NULL)
 SELECT CASE WHEN x = '' THEN 'empty' WHEN regexp_full_match(x, '\\s+') THEN 'whitespace' WHEN regexp_matches(x, '[{}\\[\\]:,<>/="]') THEN 'structural_marker' WHEN regexp_matches(x, '<\\||\\|>|BEGIN_CODE|END_CODE') THEN 'control_marker' ELSE 'content' END AS kind, count(*) AS n FROM k GROUP BY 1""")
def token_kind_counts(spark, sf_dir):
    return T.positions(_t(spark, sf_dir, "traces")).select(C.token_kind(F.col("target_token")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# --- windows, runs, tokens --------------------------------------------------------


@query("""WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_no FROM f)
 SELECT user_id, CAST(run_no AS BIGINT) AS run_no, any_value(event_type) AS event_type, min(ts) AS first, max(ts) AS last, count(*) AS length FROM r GROUP BY user_id, run_no""")
def run_length_segments(spark, sf_dir):
    return M.runs(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", F.date_trunc("day", "ts")).withColumn("run_no", F.col("run_no").cast("long"))


@query()
def ngram_tail_repeats(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", C.simple_tokens(F.col("text")).alias("tokens"))
    return d.select("doc_id", *[C.tail_repeats(F.col("tokens"), n).alias(f"repeats_{n}") for n in (1, 2, 4)])


@query("""SELECT eval_id, CASE WHEN b = 0 AND (e = 0) THEN 2 WHEN b = 0 OR e = 0 OR e < b + 14 THEN 1 ELSE 0 END AS issues FROM (SELECT eval_id, instr(coalesce(text, ''), '<|BEGIN_CODE|>') AS b, CASE WHEN contains(coalesce(text, ''), '<|END_CODE|>') THEN length(text) - instr(reverse(text), reverse('<|END_CODE|>')) - 10 ELSE 0 END AS e FROM evaluation)""")
def code_extraction_issues(spark, sf_dir):
    return _t(spark, sf_dir, "evaluation").select("eval_id", F.size(C.marker_issues(F.col("text"))).alias("issues"))


# Fixed value: white space of every kind, for engines whose own class knows the ASCII ones only.
_WHITE = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"


@query(f"""SELECT eval_id, md5(CASE WHEN regexp_matches(t, '```[^\\n]*\\n') THEN {_strip("regexp_extract(t, '(?s)```[^\\n]*\\n(.*?)(?:```|\\z)', 1)")} WHEN contains(t, '<|BEGIN_CODE|>') THEN {_strip("regexp_extract(t, '(?s)<\\|BEGIN_CODE\\|>[ \\t]*\\n?(.*?)(?:<\\|END_CODE\\|>|\\z)', 1)")} ELSE {_strip("t")} END) AS code
 FROM (SELECT eval_id, replace(replace(text, '&lt;', '<'), '&gt;', '>') AS t FROM evaluation WHERE text IS NOT NULL)""")
def official_code(spark, sf_dir):
    return _t(spark, sf_dir, "evaluation").filter(F.col("text").isNotNull()).select("eval_id", F.md5(C.official_code(F.col("text"))).alias("code"))


_QUERIES["official_code_all"] = official_code  # its name while ``official_code`` left texts with wide white space out
_SQL["official_code_all"] = _SQL["official_code"]


@query()
def json_candidates(spark, sf_dir):
    e = _t(spark, sf_dir, "evaluation").filter("output_type = 'JSON'")
    return e.select("eval_id", C.json_candidate(F.col("text")).alias("c")).select("eval_id", F.length("c").alias("size"), F.try_parse_json("c").isNotNull().alias("parses"))


@query("""SELECT stop_reason, count(*) AS n, count(*) FILTER (WHERE contains(coalesce(text, ''), '<|END_CODE|>')) AS ended, count(*) FILTER (WHERE ((length(coalesce(text, '')) - length(replace(coalesce(text, ''), '```', ''))) // 3) % 2 = 1) AS open_fences FROM evaluation GROUP BY 1""")
def terminator_counts(spark, sf_dir):
    e = _t(spark, sf_dir, "evaluation")
    return e.groupBy("stop_reason").agg(F.count("*").alias("n"), F.count_if(C.has_end_marker(F.col("text"))).alias("ended"), F.count_if(C.open_fence(F.col("text"))).alias("open_fences"))


@query("""WITH p AS (SELECT task_id, unnest(raw_output_metric) AS path FROM tasks), w AS (SELECT task_id, path, list_filter(regexp_split_to_array(regexp_replace(path, '\\[\\d+\\]|\\*', '', 'g'), '\\.+'), lambda x: x <> '') AS parts FROM p) SELECT len(parts) AS depth, count(*) AS paths FROM w GROUP BY 1""")
def path_depths(spark, sf_dir):
    p = _t(spark, sf_dir, "tasks").select(F.explode("raw_output_metric").alias("path"))
    parts = F.filter(F.split(F.regexp_replace("path", r"\[\d+\]|\*", ""), r"\.+"), lambda x: x != "")
    return p.groupBy(F.size(parts).cast("long").alias("depth")).agg(F.count("*").alias("paths"))


@query()
def constraint_terms(spark, sf_dir):
    p = _t(spark, sf_dir, "tasks").select("task_id", F.explode("raw_output_metric").alias("path")).select("task_id", F.explode(C.path_terms(F.col("path"))).alias("t"))
    return p.groupBy("task_id", "t.term").agg(F.max("t.weight").alias("weight"))


@query()
def visible_terms(spark, sf_dir):
    return _t(spark, sf_dir, "tasks").select("task_id", F.explode(C.visible_terms(F.col("query"))).alias("term")).groupBy("term").agg(F.count("*").alias("tasks"))


# --- arrays -------------------------------------------------------------------------

_GROUPS = "g AS (SELECT vec_id, unnest([0, 1]) AS grp, unnest([embedding[1:32], embedding[33:64]]) AS x FROM embeddings)"


def _blocks(spark: SparkSession, sf_dir: str, bits: int) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.posexplode(A.affine_blocks(F.col("embedding"), bits, 32)).alias("grp", "block"))


@query(f"""WITH {_GROUPS}, s AS (SELECT vec_id, grp, x, list_min(x)::DOUBLE AS lo, CASE WHEN list_max(x) > list_min(x) THEN (list_max(x)::DOUBLE - list_min(x)::DOUBLE) / 15.0 ELSE 1.0 END AS sc FROM g) SELECT vec_id, CAST(grp AS INTEGER) AS grp, CAST(list_sum(list_transform(x, lambda v: least(greatest(round_even((v::DOUBLE - lo) / sc, 0), 0.0), 15.0))) AS BIGINT) AS code_sum FROM s""")
def affine_codes(spark, sf_dir):
    return _blocks(spark, sf_dir, 4).select("vec_id", "grp", F.aggregate("block.codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"))


@query(f"""WITH {_GROUPS}, s AS (SELECT vec_id, grp, x, list_min(x)::DOUBLE AS lo, CASE WHEN list_max(x) > list_min(x) THEN (list_max(x)::DOUBLE - list_min(x)::DOUBLE) / 3.0 ELSE 1.0 END AS sc FROM g), c AS (SELECT vec_id, grp, list_transform(x, lambda v: CAST(least(greatest(round_even((v::DOUBLE - lo) / sc, 0), 0.0), 3.0) AS INTEGER)) AS q FROM s)
 SELECT vec_id, CAST(grp AS INTEGER) AS grp, CAST(list_sum(list_transform(range(8), lambda b: q[b * 4 + 1] + 4 * q[b * 4 + 2] + 16 * q[b * 4 + 3] + 64 * q[b * 4 + 4])) AS BIGINT) AS byte_sum FROM c""")
def pack_bits(spark, sf_dir):
    return _blocks(spark, sf_dir, 2).select("vec_id", "grp", F.aggregate(A.packed(F.col("block.codes"), 2), F.lit(0).cast("long"), lambda a, x: a + x).alias("byte_sum"))


@query(f"""WITH {_GROUPS}, s AS (SELECT vec_id, x, list_min(x)::DOUBLE AS lo, CASE WHEN list_max(x) > list_min(x) THEN (list_max(x)::DOUBLE - list_min(x)::DOUBLE) / 15.0 ELSE 1.0 END AS sc FROM g) SELECT vec_id, round(max(list_max(list_transform(x, lambda v: abs(least(greatest(round_even((v::DOUBLE - lo) / sc, 0), 0.0), 15.0) * sc + lo - v::DOUBLE)))), 6) AS max_error FROM s GROUP BY 1""")
def dequant_error(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    back = F.flatten(F.transform(A.affine_blocks(F.col("embedding"), 4, 32), A.restored))
    return e.select("vec_id", F.round(F.array_max(F.zip_with(back, "embedding", lambda a, b: F.abs(a - b.cast("double")))), 6).alias("max_error"))


@query("""WITH s AS (SELECT vec_id, embedding AS x, greatest(list_max(list_transform(embedding, lambda v: abs(v::DOUBLE))), 1e-8) / 7.0 AS sc FROM embeddings) SELECT vec_id, round(list_sum(list_transform(x, lambda v: abs(least(greatest(round_even(v::DOUBLE / sc, 0), -7.0), 7.0) * sc))), 6) AS total FROM s""")
def fake_quantize(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(A.symmetric(F.col("embedding"), 4), F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("total"))


@query("""SELECT vec_id, round(list_sort(list_transform(embedding, lambda v: v::DOUBLE), 'DESC')[1] - list_sort(list_transform(embedding, lambda v: v::DOUBLE), 'DESC')[2], 6) AS margin FROM embeddings""")
def top_margin(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    s = F.sort_array(F.transform("embedding", lambda v: v.cast("double")), asc=False)
    return e.select("vec_id", F.round(s[0] - s[1], 6).alias("margin"))


@query("""SELECT doc_id, CASE WHEN n > 0 THEN round((least(128, n) * 16 + least(n - least(128, n), n // 10) * 8 + (n - least(128, n) - least(n - least(128, n), n // 10)) * 4) / n, 6) ELSE 0.0 END AS bits FROM (SELECT doc_id, coalesce(n_chars, 0) AS n FROM documents)""")
def effective_bits(spark, sf_dir):
    n = F.coalesce("n_chars", F.lit(0))
    return _t(spark, sf_dir, "documents").select("doc_id", F.round(C.effective_bits(n, F.floor(n / 10), F.lit(128), F.lit(4), F.lit(8)), 6).alias("bits"))


@query("SELECT doc_id, CAST(2 * 28 * 4 * 128 * 2 * coalesce(n_chars, 0) AS BIGINT) AS bytes FROM documents")
def kv_bytes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", C.cache_bytes(F.lit(1).cast("long"), F.lit(28), F.lit(4), F.coalesce("n_chars", F.lit(0)), F.lit(128), F.lit(2)).alias("bytes"))


@query()
def budget_selection(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    costs = F.transform("embedding", lambda v: F.ceil(F.abs(v) * 10) + 1)
    return e.select("vec_id", F.size(A.first_within_budget(costs, F.lit(100.0))).alias("taken"))


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS payload, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS rest FROM lineitem GROUP BY 1""")
def map_suffix_breakdown(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    sums = li.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).cast("long").alias("a"), F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0)).cast("long").alias("b"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0)).cast("long").alias("c"))
    m = F.create_map(F.lit("r_payload_bytes"), F.col("a"), F.lit("a_scale_bytes"), F.col("b"), F.lit("n_minimum_bytes"), F.col("c"))
    return sums.select("l_orderkey", C.suffix_sum(m, "payload_bytes").alias("payload"), C.suffix_sum(m, "scale_bytes", "minimum_bytes").alias("rest"))


# --- flagship ---------------------------------------------------------------------


#: Most labels whose centroids each vector is compared with (a few MB of centroids).
MOST_LABELS = 10_000


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantise vectors at 4 and 2 bits, label each by its nearest label centroid, pair with full precision, and test.

    Centroids are one short array per label, at most ``MOST_LABELS`` of them: aggregated
    by dimension, then read as one value, so that each vector is scored in its own row.
    """
    e = _t(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull() & F.col("label").isNotNull())
    dims = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    cents = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    book = cents.agg(F.collect_list(F.struct(F.col("label").alias("l"), "c")).alias("book"))

    def nearest(v):
        dist = lambda x, c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
        return C.let(v, lambda x: F.array_min(F.transform("book", lambda b: F.struct(dist(x, b["c"]).alias("d"), b["l"].alias("l"))))["l"])

    full = F.transform("embedding", lambda x: x.cast("double"))
    labels = cents.limit(MOST_LABELS + 1).count()
    if labels > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels to compare each vector with")
    rows = e.withColumn("book", book.scalar())
    wide = rows.select("vec_id", "label", nearest(full).alias("full"), *[nearest(F.flatten(F.transform(A.affine_blocks(F.col("embedding"), b, 32), A.restored))).alias(f"q{b}") for b in (4, 2)])
    long = wide.select("vec_id", (F.col("full") == F.col("label")).alias("base_ok"), F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), (F.col(f"q{b}") == F.col("label")).alias("ok")) for b in (4, 2)])).alias("c"))
    pairs = long.select("vec_id", "c.bits", "base_ok", F.col("c.ok").alias("cand_ok"), (F.col("c.ok").cast("int") - F.col("base_ok").cast("int")).cast("double").alias("delta"))
    counts = pairs.groupBy("bits").agg(F.count("*").alias("n_rows"), F.count_if(F.col("base_ok") & ~F.col("cand_ok")).alias("lost"), F.count_if(~F.col("base_ok") & F.col("cand_ok")).alias("won"), F.round(F.avg("delta"), 6).alias("mean_delta"))
    ends = S.weighted_interval(pairs, ["bits"], "delta", "vec_id", 200, 42)
    return counts.join(ends, "bits").select("bits", "n_rows", "lost", "won", "mean_delta", F.round(S.mcnemar(F.col("lost"), F.col("won")), 9).alias("p_value"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_QUERIES["flagship_quantised_pairs"] = flagship


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
