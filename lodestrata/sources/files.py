"""Scans of evaluation artifacts under explicit schemas.

Schemas are never inferred: inference types a column of nulls as text and reads
everything twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _root_character(spark: SparkSession, path: str) -> str | None:
    """First visible character of a document, read from its first lines only."""
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.trim(F.regexp_replace("value", "^﻿", "")), 1, 1).alias("c")).first()
    return first["c"] if first else None


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a file that is one JSON array; any other root is an error."""
    if _root_character(spark, path) != "[":
        raise ValueError(f"{path} holds no JSON array")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array, or of an object that holds them under ``rows`` or ``results``."""
    if _root_character(spark, path) == "[":
        return json_array(spark, path, schema)
    held = spark.read.schema(f"rows array<struct<{_fields(schema)}>>, results array<struct<{_fields(schema)}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = held.select(F.coalesce("rows", "results").alias("rows"))
    if rows.filter(F.col("rows").isNull()).limit(1).count():
        raise ValueError(f"{path} holds neither an array nor rows or results")
    return rows.select(F.inline("rows"))


def _fields(schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def json_object(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row of a file that is one JSON object; any other root is an error."""
    if _root_character(spark, path) != "{":
        raise ValueError(f"{path} holds no JSON object")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of JSON lines, blank lines skipped; with strict a broken line fails, else it is a row of nulls with ``_corrupt`` (select a field beside it)."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def located_lines(spark: SparkSession, path: str) -> DataFrame:
    """(``file``, ``offset_block``, ``line``, ``parses``): text lines with their file, for error messages that name the place."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset_block"), F.col("value").alias("line"))
    return lines.filter(F.trim("line") != "").withColumn("parses", F.try_parse_json("line").isNotNull())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def checked_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a path that is not there has none, and a broken line is an error that names file and line.

    Lines are numbered only after a broken one was found, within its file alone.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    bad = located_lines(spark, path).filter(~F.col("parses")).select("file").first()
    if bad is None:
        return json_lines(spark, path, schema)
    numbered = spark.read.text(bad["file"]).coalesce(1).withColumn("n", F.monotonically_increasing_id() + 1)
    first = numbered.filter((F.trim("value") != "") & F.try_parse_json("value").isNull()).agg(F.min("n")).first()[0]
    raise RuntimeError(f"{bad['file']}:{first}: no JSON")


def first_records(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(``record``): the first n JSON lines as variants, whatever their shapes; the scan stops after n. Broken lines are null."""
    return spark.read.text(path).limit(n).select(F.try_parse_json("value").alias("record"))


def keys_only(rows: DataFrame, key: str) -> DataFrame:
    """The key column alone (the scan reads no other); a null or empty key is an error."""
    ok = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    return rows.select(F.when(ok, F.col(key)).otherwise(F.raise_error(F.lit(f"a row has no {key}")).cast(rows.schema[key].dataType)).alias(key))


def selection_list(spark: SparkSession, path: str, condition: str, extra: list[str], limit: int | None = None) -> DataFrame:
    """(``task_id``, ``place``): ids of the command line, then those of a CSV with the condition, each once at its first place, blanks dropped."""
    listed = spark.read.schema("condition string, task_id string").csv(path, header=True, multiLine=True, escape='"', enforceSchema=False).withColumn("n", F.monotonically_increasing_id() + len(extra))
    given = spark.createDataFrame([(i, x) for i, x in enumerate(extra)], "n long, task_id string")
    ids = given.select("n", F.trim("task_id").alias("task_id")).unionByName(listed.filter(F.col("condition") == condition).select("n", F.trim("task_id").alias("task_id")))
    first = ids.filter("task_id <> ''").groupBy("task_id").agg(F.min("n").alias("n"))
    kept = first.orderBy("n") if limit is None else first.orderBy("n").limit(limit)
    return kept.withColumn("place", F.row_number().over(Window.orderBy("n")) - 1).drop("n")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(``path``, ``length``, ``modified``, ``sha256``) of files; contents are hashed on the executors (files up to 2 GB)."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return f.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def file_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(``path``, ``length``, ``modified``) of files, contents unread."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return f.select("path", "length", F.col("modificationTime").alias("modified"))


def checksum_report(spark: SparkSession, manifest: str, root: str) -> DataFrame:
    """(``name``, ``expected``, ``found``, ``ok``) of every line of a checksum list (hash, white space, relative path)."""
    lines = spark.read.text(manifest).filter(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+", 2).alias("p")).select(F.lower(F.col("p")[0]).alias("expected"), F.col("p")[1].alias("name"))
    base = root.rstrip("/") + "/"
    found = file_hashes(spark, root).select(F.element_at(F.split("path", base.replace("file://", ""), 2), -1).alias("name"), F.col("sha256").alias("found"))
    return lines.join(found, "name", "left").select("name", "expected", "found", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)).alias("ok"))


def checkpoint_rows(spark: SparkSession, path: str, schema: str, fingerprint: str) -> DataFrame:
    """Rows of a folder of result files; a row with another run fingerprint is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    ok = F.when(F.col("run_fingerprint").eqNullSafe(fingerprint), F.col("run_fingerprint")).otherwise(F.raise_error(F.lit("a row belongs to another run")).cast("string"))
    return rows.withColumn("run_fingerprint", ok)


def characters(text: Column) -> Column:
    """Characters of a text, in order."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def character_ids(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``ids``): texts as places in the sorted set of all characters.

    The vocabulary is bounded by the number of characters that exist, not by the data.
    """
    chars = texts.select(F.explode(characters(F.col(text))).alias("c")).distinct()
    vocab = chars.agg(F.array_sort(F.collect_set("c")).alias("vocab"))
    return texts.withColumn("vocab", vocab.scalar()).select(key, F.transform(characters(F.col(text)), lambda c: F.array_position("vocab", c).cast("int") - 1).alias("ids"))


def sections(lines: DataFrame, place: str, line: str, mark: str = "__SECTION__") -> DataFrame:
    """(``section``, ``place``, ``line``): a status text cut at its section marks; lines before the first mark have section null.

    One status text is a few hundred lines, so one task orders it.
    """
    w = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("section", F.last(F.when(F.startswith(F.col(line), F.lit(mark)), F.substring(line, len(mark) + 1, 1_000)), ignorenulls=True).over(w))
    return named.filter(~F.startswith(F.col(line), F.lit(mark))).select("section", F.col(place).alias("place"), F.col(line).alias("line"))


def synthetic_records(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(``id``, ``record``): n JSON records of two kinds, the same for the same seed."""
    pick = lambda k, *xs: F.element_at(F.array(*map(F.lit, xs)), (1 + F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(len(xs)))).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("n")), F.lit(1000)).cast("int")
    person = F.to_json(F.struct(F.lit("person").alias("kind"), pick("a", "ada", "bo", "cy").alias("name"), number.alias("age")))
    item = F.to_json(F.struct(F.lit("item").alias("kind"), pick("b", "cup", "pen", "jar").alias("name"), number.alias("price")))
    return spark.range(n).select("id", F.when(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)) == 0, person).otherwise(item).alias("record"))


def catalog(spark: SparkSession, entries: dict[str, dict]) -> DataFrame:
    """A static catalog of datasets with an optional paper."""
    rows = [(k, v.get("url"), v.get("licence"), (v["paper"].get("title"), v["paper"].get("year")) if v.get("paper") else None) for k, v in sorted(entries.items())]
    return spark.createDataFrame(rows, "name string, url string, licence string, paper struct<title: string, year: int>")
