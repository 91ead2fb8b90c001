"""File sources and sinks: JSON lines, CSV, Parquet, metric files, window tensors."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions import as_column
from dayloom.schemas import METRICS


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema (no inference pass over the data)."""
    return spark.read.schema(schema).json(path)


def explode_metrics(payload: Column | str) -> Column:
    """Map of model to metric struct from JSON text."""
    return F.from_json(as_column(payload), METRICS)


def metrics_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Rows (model, mae, rmse, mape) of JSON metric objects, models with an error left out."""
    entries = payloads.select(F.explode(explode_metrics(column)).alias("model", "m"))
    return entries.filter(F.col("m").isNotNull() & F.col("m.error").isNull()).select(
        "model", "m.mae", "m.rmse", "m.mape"
    )


def metrics_json(metrics: DataFrame) -> DataFrame:
    """The inverse of :func:`metrics_rows`: one JSON object over all models (a bounded list)."""
    fields = [c for c in ("mae", "rmse", "mape", "error") if c in metrics.columns]
    return metrics.agg(
        F.to_json(
            F.map_from_entries(F.collect_list(F.struct("model", F.struct(*fields))))
        ).alias("payload")
    )


def read_metrics(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Metric rows chosen by suffix: ``.csv``, ``.jsonl``, or ``.json`` (object or list)."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".csv":
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=True)
    if suffix == ".jsonl":
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.json(path)
    if suffix != ".json":
        raise ValueError("metric files end in .csv, .json or .jsonl")
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("payload"))
    head = text.select(F.substring("payload", 1, 1)).first()[0]
    if head == "[":
        row = schema or METRICS.valueType.add("model", T.StringType())
        return text.select(F.inline(F.from_json("payload", T.ArrayType(row))))
    if head != "{":
        raise ValueError("a metric file holds one JSON object or a list of objects")
    named = metrics_rows(text)
    if not named.isEmpty():
        return named
    return text.select(F.from_json("payload", METRICS.valueType).alias("m")).select(
        "m.mae", "m.rmse", "m.mape"
    )


def write_dataset(df: DataFrame, base: str, name: str, fmt: str = "parquet") -> dict[str, str]:
    """Overwrite ``base/name`` as ``parquet``, ``jsonl``, ``csv`` or ``both`` (jsonl and csv).

    Each executor writes its own part files; the output committer makes the result visible
    only once the job has succeeded.
    """
    if fmt not in ("parquet", "jsonl", "csv", "both"):
        raise ValueError(f"unknown format {fmt!r}")
    formats = ("jsonl", "csv") if fmt == "both" else (fmt,)
    written = {}
    for f in formats:
        target = f"{base}/{name}.{f}"
        writer = df.write.mode("overwrite")
        if f == "parquet":
            writer.parquet(target)
        elif f == "jsonl":
            writer.option("ignoreNullFields", "false").json(target)
        else:
            writer.option("header", True).csv(target)
        written[f] = target
    return written


def write_datasets(tables: Mapping[str, DataFrame], base: str, fmt: str = "parquet") -> dict:
    """Several named tables in one call (orders, ad spends, events)."""
    return {name: write_dataset(df, base, name, fmt) for name, df in tables.items()}


def write_record(df: DataFrame, path: str) -> str:
    """A result of exactly one row as a single JSON file, committed atomically."""
    if len(df.take(2)) != 1:
        raise ValueError("a record is exactly one row")
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_windows(windows: DataFrame, path: str, features: list[str]) -> str:
    """Window tensors as Parquet; the feature order travels in the column metadata."""
    # The finite mark stays behind: what a file holds is checked again when it is read.
    tagged = windows.withMetadata("X", {"feature_columns": list(features)})
    tagged.write.mode("overwrite").parquet(path)
    return path


def read_windows(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Window tensors with every value finite, plus the feature order."""
    windows = spark.read.parquet(path)
    features = windows.schema["X"].metadata.get("feature_columns", [])
    return finite_windows(windows), list(features)


def finite_windows(windows: DataFrame) -> DataFrame:
    """Windows whose inputs and target hold no NULL, NaN or infinity."""
    limit = F.lit(float("inf"))
    sound = F.forall(F.flatten("X"), lambda v: F.coalesce(F.abs(v) < limit, F.lit(False)))
    return windows.filter(sound & (F.abs("y") < limit))
