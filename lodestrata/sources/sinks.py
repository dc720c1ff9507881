"""Sinks: atomic documents, JSON lines, CSV without a lonely header, exports, reports, run states."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import tempfile
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_document(value: object, path: str | Path) -> None:
    """One JSON document, whole or not at all: written beside its place, then renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.", suffix=uuid.uuid4().hex)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
        f.write("\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, target)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A folder of JSON lines, replaced as a whole; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, one_part: bool = True) -> int:
    """A folder of CSV (header, ``\\n`` ends) and its number of rows; no rows give an empty file without a header.

    one_part: a single file, for reports, which are small; else one file per
    partition, each with the header.
    """
    rows = df.count()
    out = (df.coalesce(1) if one_part else df).write.mode("overwrite").option("lineSep", "\n").option("quoteAll", False).option("escape", '"').option("emptyValue", "")
    (out.option("header", rows > 0)).csv(path)
    return rows


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the Parquet log does not hold, and their number; running it again adds nothing."""
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
    fresh = df.join(spark.read.parquet(path).select(key), key, "left_anti") if exists else df
    before = spark.read.parquet(path).count() if exists else 0
    fresh.dropDuplicates([key]).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def export(df: DataFrame, folder: str, order: str, example_by: str, preview_rows: int = 20) -> dict[str, int]:
    """A dataset as JSON lines and CSV with a preview, one example per group and a summary document; returns row counts."""
    write_json_lines(df, f"{folder}/rows")
    counts = {"rows": write_csv(_flat(df), f"{folder}/csv", one_part=False)}
    preview = df.orderBy(order).limit(preview_rows)
    write_json_lines(preview, f"{folder}/preview")
    examples = df.groupBy(example_by).agg(F.min_by(F.struct("*"), order).alias("r")).select("r.*").orderBy(example_by)
    write_json_lines(examples, f"{folder}/examples")
    counts |= {"preview": preview.count(), "examples": examples.count()}
    write_document(counts, f"{folder}/summary.json")
    return counts


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])


def write_text(df: DataFrame, column: str, path: str) -> tuple[int, int]:
    """Texts of a column as a text folder, skipped where it is complete; (rows, characters)."""
    if (Path(path.removeprefix("file://")) / "_SUCCESS").exists():
        done = df.sparkSession.read.text(path)
        return done.count(), done.agg(F.coalesce(F.sum(F.length("value")), F.lit(0))).first()[0]
    kept = df.select(F.col(column).cast("string").alias("value")).filter(F.col("value").isNotNull())
    from pyspark.sql import Observation

    seen = Observation("written")
    kept.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("chars")).write.mode("overwrite").text(path)
    return seen.get["rows"], seen.get["chars"]


def _few(df: DataFrame, most_rows: int) -> list:
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report holds at most {most_rows} rows")
    return rows


def console_table(df: DataFrame, most_rows: int = 1000) -> str:
    """A small table with aligned columns for a terminal, numbers to the right; more than ``most_rows`` rows are an error."""
    rows = [[("n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in _few(df, most_rows)]
    widths = [max(len(c), *(len(r[i]) for r in rows)) if rows else len(c) for i, c in enumerate(df.columns)]
    right = [t in ("int", "bigint", "double", "float", "smallint") for _, t in df.dtypes]
    line = lambda cells: "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, widths, right)).rstrip()
    return "\n".join([line(df.columns), "  ".join("-" * w for w in widths), *map(line, rows)]) + "\n"


def markdown_table(df: DataFrame, formats: dict[str, str] | None = None, most_rows: int = 1000) -> str:
    """A small table as Markdown; null is n/a, numbers by the given formats. More than ``most_rows`` rows are an error, so no report is cut."""
    formats = formats or {}
    rows = _few(df, most_rows)
    show = lambda c, v: "n/a" if v is None else format(v, formats[c]) if c in formats else str(v).replace("|", "\\|")
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join(show(c, r[c]) for c in df.columns) + " |" for r in rows)]) + "\n"


def _utc() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def provenance(df: DataFrame, **settings: object) -> dict[str, object]:
    """What a result's readers need to repeat it: engine and interpreter versions, platform, time, the plan's schema, settings and their fingerprint."""
    spark = df.sparkSession
    text = json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str)
    return {"spark": spark.version, "python": platform.python_version(), "platform": platform.platform(), "created": _utc(), "columns": dict(df.dtypes), "settings": settings, "run_fingerprint": hashlib.sha256(text.encode()).hexdigest()}


class RunState:
    """Marker files of a run (STARTED on entry, COMPLETE on success, FAILED with the error else) and its ``status.json``: running, complete or failed, with times and progress."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def _mark(self, name: str, text: str = "") -> None:
        part = self.folder / f".{name}.{uuid.uuid4().hex}"
        part.write_text(text)
        os.replace(part, self.folder / name)

    def __enter__(self) -> RunState:
        self.folder.mkdir(parents=True, exist_ok=True)
        for old in ("COMPLETE", "FAILED"):
            (self.folder / old).unlink(missing_ok=True)
        self._mark("STARTED")
        self.began = _utc()
        self.progress()
        return self

    def progress(self, **figures: object) -> None:
        """Rewrite ``status.json`` whole, with figures of the run so far."""
        write_document({"state": "running", "started": self.began, "updated": _utc(), **figures}, self.folder / "status.json")

    def __exit__(self, kind, error, _) -> None:
        write_document({"state": "failed" if kind else "complete", "started": self.began, "updated": _utc(), **({"error": f"{kind.__name__}: {error}"} if kind else {})}, self.folder / "status.json")
        self._mark("FAILED" if kind else "COMPLETE", f"{kind.__name__}: {error}\n" if kind else "")
