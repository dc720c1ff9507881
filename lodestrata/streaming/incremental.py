"""Resumable and stateful processing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, source: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A stream over the files of a folder, or over one file (read through its folder, as a stream needs one)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.format(fmt).schema(schema)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.load(source)
    return reader.option("pathGlobFilter", path.getName()).load(path.getParent().toString())


def resume(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, fingerprint: str, transform: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet") -> int:
    """Process what is new in a folder once and append it; the number of new rows.

    The checkpoint remembers finished files, so running it again adds nothing; each
    micro-batch is written under its own number, so a repeated batch replaces
    itself.  A row of another run (``run_fingerprint``) is an error before anything
    is written.
    """
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        own = batch.filter(F.col(key).isNotNull())
        if "run_fingerprint" in batch.columns and own.filter(~F.col("run_fingerprint").eqNullSafe(fingerprint)).limit(1).count():
            raise ValueError("the folder holds rows of another run")
        out = transform(own) if transform else own
        out.dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/batch={number}")
        done.append(number)

    q = stream(spark, source, schema, fmt).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(spark.read.parquet(f"{target}/batch={n}").count() for n in done)


def missing_prefix(rows: DataFrame, index: str, total: int) -> DataFrame:
    """(``place``): places of a run that are not done although later ones are; no rows means it can go on."""
    last = rows.agg(F.coalesce(F.max(index), F.lit(-1)).alias("last"))
    want = last.select(F.explode_outer(F.when(F.col("last") >= 0, F.sequence(F.lit(0), F.least(F.col("last"), F.lit(total - 1)).cast("int")))).alias("place")).filter("place is not null")
    return want.join(rows.select(F.col(index).cast("int").alias("place")), "place", "left_anti")


def sealed_counts(batches: DataFrame, key: str, size: str, residual: int) -> DataFrame:
    """Stateful cache of every key: (key, ``appended``, ``sealed_keys``, ``sealed_values``, ``residual_keys``, ``residual_values``) after each append.

    What exceeds the residual is sealed: keys in whole residual-length chunks,
    values one by one.  Works on a stream (update mode) of appends; rows of one key
    in one micro-batch are appended together.
    """
    kind = dict(batches.dtypes)[key]
    schema = f"{key} {kind}, appended long, sealed_keys long, sealed_values long, residual_keys long, residual_values long"

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, keys, values = state.get if state.exists else (0, 0, 0)
        total += sum(int(f[size].fillna(0).sum()) for f in frames)
        over = total - keys - residual
        keys += max(0, over // residual) * residual if residual else max(0, total - keys)
        values = max(values, total - residual)
        state.update((total, keys, values))
        yield pd.DataFrame([(name[0], total, keys, values, total - keys, total - values)], columns=[x.split()[0] for x in schema.split(", ")])

    return batches.groupBy(key).applyInPandasWithState(step, schema, "total long, keys long, values long", "update", GroupStateTimeout.NoTimeout)


def sealed_closed_form(totals: DataFrame, total: str, residual: int) -> DataFrame:
    """The same state from a total, when everything was appended at once."""
    over = F.greatest(F.col(total) - residual, F.lit(0))
    keys = (F.floor(over / residual) * residual).cast("long")
    return totals.withColumn("sealed_keys", keys).withColumn("sealed_values", over.cast("long")).withColumn("residual_keys", F.col(total) - keys).withColumn("residual_values", F.col(total) - over)


def stop_step(tokens: list[str], end: str = "<|END_CODE|>", eos: str = "</s>", every: int = 4, ngram: int = 8, loops: int = 4, limit: int = 2048) -> tuple[int, str]:
    """(steps, reason) at which generation stops: eos, end_code (looked for every few steps), a tail loop, or the limit; (all, '') if none."""
    text = ""
    for i, t in enumerate(tokens, 1):
        if t == eos:
            return i, "eos"
        text += t
        if i % every == 0 and end in text:
            return i, "end_code"
        if i >= ngram * loops and all(tokens[i - ngram * (k + 1) : i - ngram * k] == tokens[i - ngram : i] for k in range(loops)):
            return i, "loop"
        if i >= limit:
            return i, "max_new_tokens"
    return len(tokens), "end_code" if end in text else ""


def status_stream(spark: SparkSession, folder: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 20):
    """A running query that hands every new status file of a folder to ``sink`` about every few seconds."""
    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
