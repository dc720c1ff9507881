"""Registered queries of parsers, sources, sinks, streams and budgets, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import columns as C
from ..functions import parsers as X
from ..operators import budgets as B
from ..operators import pairing as P
from ..operators import traces as T
from ..sources import files, sinks
from ..staging import shared_dir
from ..streaming import incremental as I
from .reference_queries import LATEST, Query, _latest, _t, decimal_rounds

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


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- JSON documents and parsers ---------------------------------------------------


@query()
def json_path_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each task's required paths in its JSON answers."""
    answers = _latest(spark, sf_dir).filter("output_type = 'JSON'").select("eval_id", "run_condition", "task_id", C.official_code(F.col("text")).alias("code"))
    required = _t(spark, sf_dir, "tasks").select("task_id", "raw_output_metric")
    r = answers.join(required, "task_id").select("eval_id", "run_condition", X.path_report("code", "raw_output_metric").alias("r"))
    return r.select("eval_id", "run_condition", F.col("r.parsed").alias("parsed"), F.size("r.present").alias("present"), F.size("r.missing").alias("missing"), F.round("r.share", 6).alias("share"))


@query()
def json_leaf_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf agreement of each candidate's JSON answer with the baseline's."""
    answers = _latest(spark, sf_dir).filter("output_type = 'JSON'").select("run_condition", "task_id", C.official_code(F.col("text")).alias("code"))
    pairs = P.lenient_pairs(answers.filter("run_condition = 'fp16'"), answers.filter("run_condition <> 'fp16'"), "task_id")
    return pairs.select("task_id", F.col("cand.run_condition").alias("run_condition"), X.leaf_agreement("base.code", "cand.code").alias("a")).select("task_id", "run_condition", "a.*")


@query()
def parse_failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why unparsed answers failed, by output type."""
    bad = _t(spark, sf_dir, "evaluation").filter(~C.parsed_ok(F.col("render_score"))).select("output_type", "stop_reason", C.marked_code(F.col("text")).alias("code"), C.marker_issues(F.col("text")).alias("issues"))
    kinds = bad.withColumn("parser", X.parse_kind("output_type", "code"))
    return kinds.select("output_type", X.failure_kind(F.col("stop_reason"), F.col("issues"), F.col("code"), F.col("parser.kind")).alias("kind")).groupBy("output_type", "kind").agg(F.count("*").alias("n"))


@query("SELECT eval_id, CASE WHEN render_score IS NOT NULL AND key_validation_score IS NOT NULL THEN CAST(printf('%.2f', 0.2::DOUBLE * render_score + 0.8::DOUBLE * key_validation_score) AS DOUBLE) END AS score FROM evaluation WHERE final_eval_score IS NOT NULL")
def recomputed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final scores recomputed from render and path scores, with exact decimal rounding."""
    e = _t(spark, sf_dir, "evaluation").filter(F.col("final_eval_score").isNotNull())
    return e.select("eval_id", X.final_score(F.col("render_score").cast("double"), F.col("key_validation_score")).alias("score"))


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS n FROM events GROUP BY 1")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON scalar read on the JVM and summed by event type."""
    e = _t(spark, sf_dir, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count("*").alias("n"))


@query()
def run_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each distinct run setting."""
    runs = _t(spark, sf_dir, "evaluation").select("run_condition", "key_bits", "value_bits", "generation_protocol").distinct()
    return runs.select("*", X.fingerprint(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("fingerprint"))


# --- projections --------------------------------------------------------------------


@query("SELECT eval_id, printf('%04d_%s_K%d_V%d', CAST(run_id % 1000 AS INTEGER), task_id, coalesce(key_bits, 16), coalesce(value_bits, 16)) AS checkpoint_key FROM evaluation")
def checkpoint_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "evaluation")
    return e.select("eval_id", C.checkpoint_key(F.col("run_id") % 1000, F.col("task_id"), F.lit(16), F.col("key_bits"), F.col("value_bits")).alias("checkpoint_key"))


@query("""SELECT '["' || coalesce(CAST(key_bits AS VARCHAR), 'null') || '","' || coalesce(CAST(value_bits AS VARCHAR), CAST(key_bits AS VARCHAR), 'null') || '"]' AS config, count(*) AS n FROM evaluation GROUP BY 1""")
def configuration_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by configuration key; an absent value width takes the key width."""
    e = _t(spark, sf_dir, "evaluation")
    key = C.configuration_key(C.setting_text(F.lit(True), F.col("key_bits"), F.lit(16)), C.setting_text(F.col("value_bits").isNotNull(), F.col("value_bits"), F.col("key_bits")))
    return e.groupBy(key.alias("config")).agg(F.count("*").alias("n"))


@query("SELECT task_id, coalesce(CASE WHEN query_example <> '' THEN query_example END, CASE WHEN feature_requirements <> '' THEN feature_requirements END, query) AS shown FROM tasks")
def first_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "tasks").select("task_id", C.first_filled(F.col("query_example"), F.col("feature_requirements"), F.col("query")).alias("shown"))


@query("SELECT doc_id, md5(replace(replace(substr(text, 1, 500), chr(13), '\\r'), chr(10), '\\n')) AS preview FROM documents WHERE text IS NOT NULL")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display form of texts; their analysis elsewhere reads them whole."""
    return _t(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.md5(C.preview(F.col("text"))).alias("preview"))


@query("SELECT task_id, CASE WHEN len(f) > 0 THEN round(len(list_filter(f, lambda x: contains(q, x))) / len(f), 6) ELSE 0.0 END AS share FROM (SELECT task_id, query AS q, CASE WHEN feature_requirements <> '' THEN string_split(feature_requirements, '; ') ELSE [] END AS f FROM tasks)")
def required_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a task's features that its query names."""
    t = _t(spark, sf_dir, "tasks")
    parts = F.when(F.coalesce(F.col("feature_requirements"), F.lit("")) != "", F.split("feature_requirements", "; ")).otherwise(F.array().cast("array<string>"))
    return t.select("task_id", F.round(C.required_share(F.col("query"), parts), 6).alias("share"))


@query()
def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of answers' field names that match a required term; terms are a bounded dimension (the tasks are fixed)."""
    words = _t(spark, sf_dir, "tasks").select(F.explode(C.visible_terms(F.col("query"))).alias("word")).distinct()
    terms = _t(spark, sf_dir, "tasks").select(F.explode("raw_output_metric").alias("p")).select(F.explode(C.path_terms(F.col("p"))).alias("t")).select("t.term").distinct()
    book = terms.agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return words.withColumn("terms", book.scalar()).select("word", C.fuzzy_hit(F.col("word"), F.col("terms")).alias("hit"))


@query("SELECT task_id, len(x) AS tokens, CASE WHEN len(x) > 64 THEN 64 ELSE len(x) END AS kept FROM (SELECT task_id, string_split(query, ' ') AS x FROM tasks)")
def middle_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "tasks").select("task_id", F.split("query", " ").alias("x"))
    return t.select("task_id", F.size("x").cast("long").alias("tokens"), F.size(C.middle_cut(F.col("x"), 64)).cast("long").alias("kept"))


@query("SELECT task_id, md5(array_to_string(CASE WHEN len(x) > 64 THEN list_concat(x[1:32], x[len(x) - 31:len(x)]) ELSE x END, ' ')) AS kept FROM (SELECT task_id, string_split(query, ' ') AS x FROM tasks)")
def middle_cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cut in the middle leaves of each query, by hash."""
    return _t(spark, sf_dir, "tasks").select("task_id", F.md5(F.array_join(C.middle_cut(F.split("query", " "), 64), " ")).alias("kept"))


@query("SELECT 'json' AS format, task_id, md5(query) AS query FROM tasks UNION ALL SELECT 'csv', task_id, md5(query) FROM tasks")
def sink_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the tasks after a round trip through JSON lines and through CSV, by hash."""
    t, folder = _t(spark, sf_dir, "tasks").select("task_id", "query"), _folder(spark, "contents")
    sinks.write_json_lines(t, f"{folder}/json")
    sinks.write_csv(t, f"{folder}/csv", one_part=False)
    back = {"json": files.json_lines(spark, f"{folder}/json", "task_id string, query string"), "csv": spark.read.schema("task_id string, query string").csv(f"{folder}/csv", header=True, multiLine=True, escape='"', lineSep="\n")}
    one = [df.select(F.lit(k).alias("format"), "task_id", F.md5("query").alias("query")) for k, df in back.items()]
    return one[0].unionByName(one[1])


@query("""SELECT vec_id, round(list_sum(list_transform(embedding[1:60], lambda v: abs(least(greatest(round_even(v::DOUBLE / sc, 0), -7.0), 7.0) * sc))), 6) AS older_sum FROM (SELECT vec_id, embedding, greatest(list_max(list_transform(embedding, lambda v: abs(v::DOUBLE))), 1e-8) / 7.0 AS sc FROM embeddings)""")
def residual_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values before the last four after quantisation, the scale being that of all values."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", A.symmetric_recent(F.col("embedding"), 4, 4).alias("q"))
    return e.select("vec_id", F.round(F.aggregate(F.slice("q", 1, 60), F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("older_sum"))


@query(f"WITH {LATEST} SELECT run_condition, CASE WHEN contains(coalesce(text, ''), '<|END_CODE|>') THEN 'end_code' WHEN stop_reason = 'eos' THEN 'eos' WHEN generated_tokens >= 96 THEN 'max_new_tokens' ELSE 'unknown' END AS reason, count(*) AS n FROM latest GROUP BY 1, 2")
def stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop reasons recomputed from text and tokens."""
    e = _latest(spark, sf_dir)
    return e.groupBy("run_condition", C.stop_reason(F.col("generated_tokens"), F.lit(96), F.col("text"), F.col("stop_reason") == "eos").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT output_type, count(*) AS found, max(e) AS expected, count(*) - max(e) AS delta FROM tasks JOIN (VALUES ('CSV', 50), ('JSON', 250), ('TOML', 250), ('XML', 200), ('YAML', 200)) AS x(o, e) ON output_type = o GROUP BY 1")
def constant_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts against a literal table of expected ones."""
    # Expected rows by output format.
    expected = spark.createDataFrame([("CSV", 50), ("JSON", 250), ("TOML", 250), ("XML", 200), ("YAML", 200)], "output_type string, expected int")
    counts = _t(spark, sf_dir, "tasks").groupBy("output_type").agg(F.count("*").alias("found"))
    return counts.join(F.broadcast(expected), "output_type").select("output_type", "found", "expected", (F.col("found") - F.col("expected")).alias("delta"))


# --- budgets --------------------------------------------------------------------------


@query("""SELECT vec_id, CASE WHEN n > 0 THEN n ELSE 0 END AS protected FROM (SELECT vec_id, least(greatest(CAST(floor((6.0 * 64 - 48 * 4 - 16 * 16) / 4) AS INTEGER), 0), len(list_filter(embedding[1:48], lambda v: v > 0))) AS n FROM embeddings)""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected places under a mean-bits target."""
    e = _t(spark, sf_dir, "embeddings")
    mask = A.token_budget_mask(F.transform("embedding", lambda v: v > 0), F.col("embedding"), "score", 4, 8, 16, 6.0)
    return e.select("vec_id", F.size(F.filter(mask, lambda m: m)).alias("protected"))


@query("SELECT doc_id, CAST(ceil(n * 4 / 8.0) AS BIGINT) AS payload, CAST(ceil(n / 32.0) * 2 AS BIGINT) AS scales FROM (SELECT doc_id, coalesce(n_chars, 0) AS n FROM documents)")
def packed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", A.packed_bytes(F.coalesce("n_chars", F.lit(0)), 4, 32).alias("b"))
    return d.select("doc_id", "b.payload", F.col("b.scale").alias("scales"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[61:64], lambda v: v::DOUBLE)), 6) AS recent_sum FROM embeddings")
def residual_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four values are untouched by quantisation."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", A.symmetric_recent(F.col("embedding"), 4, 4).alias("q"))
    return e.select("vec_id", F.round(F.aggregate(F.slice("q", 61, 4), F.lit(0.0), lambda a, x: a + x), 6).alias("recent_sum"))


SHAPE = B.StorageShape(layers=28, heads=4, dim=128, group=32, residual=128, key_bits=4, value_bits=4, protected_bits=8)


@query("SELECT doc_id, CASE WHEN n > 0 THEN (n - n % 128) // 32 * (28 * 4 * 32 * 128 * 4 // 8 + 2 * 28 * 4 * 128 * 2) + greatest(n - 128, 0) * (28 * 4 * 128 * 4 // 8 + 2 * 28 * 4 * 4 * 2) + (2 * n - (n - n % 128) - greatest(n - 128, 0)) * 28 * 4 * 128 * 2 ELSE 0 END AS bytes FROM (SELECT doc_id, coalesce(n_chars, 0) AS n FROM documents)")
def stored_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed bytes of a cache as long as each text."""
    return _t(spark, sf_dir, "documents").select("doc_id", B.stored_bytes(SHAPE, F.coalesce("n_chars", F.lit(0))).alias("bytes"))


@query()
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places protected under a byte budget, by group-aware greedy selection."""
    shape = B.StorageShape(layers=1, heads=1, dim=32, group=8, residual=8, key_bits=4, value_bits=4, protected_bits=8)
    e = _t(spark, sf_dir, "embeddings")
    mask = B.byte_budget_mask(shape, F.transform("embedding", lambda v: v > 0), "score", 8.0, F.col("embedding"))
    return e.select("vec_id", F.size(F.filter(mask, lambda m: m)).alias("protected"))


@query()
def budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token budget over the tasks' queries, summarised."""
    return B.budget_summary(B.budget_per_task(_t(spark, sf_dir, "tasks"), "task_id", "query", "raw_output_metric", 4, 8, 64, 6.5, "score"))


@query("""SELECT 'K=' || coalesce(CAST(key_bits AS VARCHAR), 'none') || ',V=' || coalesce(CAST(value_bits AS VARCHAR), 'none') AS setting, count(*) AS n_rows, round(coalesce(avg(CASE WHEN render_score IS NOT NULL THEN CASE WHEN render_score = 1 THEN 1.0 ELSE 0.0 END END), 0), 6) AS parse_share,
 round(coalesce(avg(CASE WHEN render_score IS NOT NULL THEN coalesce(key_validation_score, 0) END), 0), 6) AS mean_path, round(coalesce(avg(CASE WHEN render_score IS NOT NULL THEN coalesce(final_eval_score, 0) END), 0), 6) AS mean_score, round(avg(CASE WHEN stop_reason = 'max_new_tokens' THEN 1.0 ELSE 0.0 END), 6) AS limit_share FROM evaluation GROUP BY 1""")
def setting_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "evaluation")
    setting = F.concat(F.lit("K="), F.coalesce(F.col("key_bits").cast("string"), F.lit("none")), F.lit(",V="), F.coalesce(F.col("value_bits").cast("string"), F.lit("none")))
    return B.setting_summary(e, setting, "render_score", "key_validation_score", "final_eval_score", F.col("stop_reason") == "max_new_tokens")


@query("""WITH d AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings), s AS (SELECT label, i, greatest(max(abs(x::DOUBLE)), 1e-8) / 7.0 AS sc FROM d GROUP BY 1, 2) SELECT vec_id, round(sum(abs(least(greatest(round_even(x::DOUBLE / sc, 0), -7.0), 7.0) * sc)), 6) AS total FROM d JOIN s USING (label, i) GROUP BY 1""")
def channel_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric quantisation with one scale per channel of each label's vectors."""
    q = B.quantised_cache(_t(spark, sf_dir, "embeddings"), ["label"], "embedding", 4, "channel")
    return q.select("vec_id", F.round(F.aggregate("quantised", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("total"))


# --- traces -----------------------------------------------------------------------------


@query("""WITH tt AS (SELECT trace_id, run_condition, unnest(task_traces) AS t, unnest(range(len(task_traces))) AS o FROM traces), pp AS (SELECT trace_id, run_condition, o, t.task_id AS task_id, unnest(t.positions) AS p, unnest(range(len(t.positions))) AS i FROM tt), q AS (SELECT *, row_number() OVER (PARTITION BY run_condition, task_id, p.prediction_index ORDER BY trace_id, o, i) AS rn FROM pp WHERE p IS NOT NULL AND p.prediction_index IS NOT NULL AND task_id IS NOT NULL), f AS (SELECT * FROM q WHERE rn = 1)
 SELECT b.p.target_token_kind AS kind, count(*) AS positions, count(*) FILTER (WHERE b.p.target_token_id IS NOT DISTINCT FROM c.p.target_token_id) AS same_target, count(*) FILTER (WHERE b.p.top1_token_id IS NOT DISTINCT FROM c.p.top1_token_id) AS same_best FROM f b JOIN f c ON b.task_id = c.task_id AND b.p.prediction_index = c.p.prediction_index WHERE b.run_condition = 'fp16' AND c.run_condition = 'q4' GROUP BY 1""")
def aligned_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the 4-bit traces with the full-precision ones, by token kind."""
    t = _t(spark, sf_dir, "traces")
    a = T.aligned(t.filter("run_condition = 'fp16'"), t.filter("run_condition = 'q4'"))
    return a.groupBy("kind").agg(F.count("*").alias("positions"), F.count_if("same_target").alias("same_target"), F.count_if("same_best").alias("same_best"))


@query()
def trace_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields that must agree between two conditions: all scalars but keys, widths and times."""
    t = _t(spark, sf_dir, "traces")
    fields = [c for c, kind in t.dtypes if kind in ("string", "int", "bigint") and c not in ("trace_id", "run_condition", "k_bits", "v_bits")]
    return T.header_violations(t.filter("run_condition = 'fp16'"), t.filter("run_condition = 'q4'"), fields)


# --- sources, sinks and streams -------------------------------------------------------------


@query("SELECT 'json' AS format, count(*) AS n_rows, CAST(sum(length(query)) AS BIGINT) AS chars FROM tasks UNION ALL SELECT 'csv', count(*), CAST(sum(length(query)) AS BIGINT) FROM tasks")
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks written as JSON lines and as CSV, then read back."""
    t, folder = _t(spark, sf_dir, "tasks").select("task_id", "query"), _folder(spark, "roundtrip")
    sinks.write_json_lines(t, f"{folder}/json")
    sinks.write_csv(t, f"{folder}/csv")
    back = {"json": files.json_lines(spark, f"{folder}/json", "task_id string, query string"), "csv": spark.read.schema("task_id string, query string").csv(f"{folder}/csv", header=True, multiLine=True, escape='"')}
    one = [df.agg(F.lit(k).alias("format"), F.count("*").alias("n_rows"), F.sum(F.length("query")).alias("chars")).select("format", "n_rows", "chars") for k, df in back.items()]
    return one[0].unionByName(one[1])


@query("SELECT run_condition, count(DISTINCT eval_id) AS n FROM evaluation GROUP BY 1")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder processed by a resumable stream, twice; the second run adds nothing."""
    folder = _folder(spark, "resume")
    schema = "eval_id long, run_condition string"
    args = (spark, f"{sf_dir}/evaluation.parquet", schema, f"{folder}/out", f"{folder}/checkpoint", "eval_id", "")
    I.resume(*args)
    I.resume(*args)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/out").groupBy("run_condition").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT user_id, CAST(count(*) AS BIGINT) AS total FROM events GROUP BY 1) SELECT user_id, total AS appended, greatest(total - 32, 0) // 32 * 32 AS sealed_keys, greatest(total - 32, 0) AS sealed_values FROM t""")
def stateful_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed and residual entries per user of a stateful stream over the events."""
    folder = _folder(spark, "stateful")
    events = I.stream(spark, f"{sf_dir}/events.parquet", "event_id long, user_id long").select("user_id", F.lit(1).alias("n"))
    q = I.sealed_counts(events, "user_id", "n", 32).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema("user_id long, appended long, sealed_keys long, sealed_values long").option("recursiveFileLookup", True).parquet(f"{folder}/out")
    return out.groupBy("user_id").agg(*[F.max(c).alias(c) for c in ("appended", "sealed_keys", "sealed_values")])


@query("""WITH c AS (SELECT item_id, list_filter(string_split(coalesce(text, ''), ''), lambda x: x <> '') AS x FROM heldout_items), v AS (SELECT list_sort(list(DISTINCT ch)) AS v FROM (SELECT unnest(x) AS ch FROM c)) SELECT item_id, len(x) AS size, CAST(list_sum(list_transform(x, lambda ch: list_position(v, ch) - 1)) AS BIGINT) AS total FROM c, v""")
def character_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as character numbers: size and sum of each vector."""
    v = files.character_ids(_t(spark, sf_dir, "heldout_items"), "item_id", "text")
    return v.select("item_id", F.size("ids").alias("size"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT 1 AS one, count(*) AS n_rows FROM orders")
def synthetic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many generated records as there are orders; every one parses."""
    n = _t(spark, sf_dir, "orders").count()
    r = files.synthetic_records(spark, n, 42).filter(F.try_parse_json("record").isNotNull())
    return r.agg(F.lit(1).alias("one"), F.count("*").alias("n_rows"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
