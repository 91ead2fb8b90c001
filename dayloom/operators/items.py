"""Nested line items and the timestamp forms they arrive with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions import clean_number, day_of, weekday_of, whole_number

_ITEM_FIELDS = ("productId", "title", "quantity")


def item_array(column: str, dtype: T.DataType) -> Column:
    """An array of item structs from any accepted form.

    Accepted: an array of structs, one struct, or JSON text holding an array or one object.
    Anything else becomes an empty array; non-object members of a JSON array are dropped.
    """
    c = F.col(column)
    if isinstance(dtype, T.ArrayType):
        return F.filter(c, lambda e: e.isNotNull())
    if isinstance(dtype, T.StructType):
        return F.when(c.isNotNull(), F.array(c))
    text = F.trim(c.cast("string"))
    members = F.from_json(
        F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text),
        "array<string>",
    )
    return F.transform(
        F.filter(members, lambda e: e.startswith("{")),
        lambda e: F.from_json(e, "productId string, title string, quantity string"),
    )


def explode_items(df: DataFrame, items: str, keep: Sequence[Column | str]) -> DataFrame:
    """``keep`` columns plus the raw item fields, one row per item (empty arrays vanish)."""
    dtype = df.schema[items].dataType
    element = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype
    present = element.names if isinstance(element, T.StructType) else list(_ITEM_FIELDS)
    exploded = df.select(*keep, F.explode(item_array(items, dtype)).alias("_item"))
    fields = [
        (F.col("_item")[f] if f in present else F.lit(None).cast("string")).alias(f)
        for f in _ITEM_FIELDS
    ]
    return exploded.select("*", *fields).drop("_item")


def item_numbers(lines: DataFrame) -> DataFrame:
    """Numeric product id and whole quantity; unreadable values become 0."""
    return lines.withColumns(
        {"productId": whole_number("productId"), "quantity": whole_number("quantity")}
    )


def item_labels(lines: DataFrame) -> DataFrame:
    """``product_label`` = title, else product id; quantity NULL as 0; undated rows dropped."""
    return lines.withColumns(
        {
            "quantity": F.coalesce(clean_number("quantity"), F.lit(0.0)),
            "product_label": F.coalesce(F.col("title"), F.col("productId").cast("string")),
        }
    ).dropna(subset=["created", "product_label"])


def _median_reaches(stats: Column, cut: float) -> Column:
    """Whether the exact median is at least ``cut``, from counts and the two neighbours of it."""
    name = f"c{cut:.0e}".replace("+", "")
    n, below = stats["n"], stats[f"{name}_below"]
    lower_rank, upper_rank = F.ceil(n / 2), F.floor(n / 2) + 1
    middle = (stats[f"{name}_left"] + stats[f"{name}_right"]) / 2
    return (
        F.when(below < lower_rank, F.lit(True))
        .when(below >= upper_rank, F.lit(False))
        .otherwise(middle >= F.lit(cut))
    )


def normalize_created(df: DataFrame, column: str = "created") -> DataFrame:
    """Timestamps from ISO text, timestamps or epoch numbers; adds day, weekday and month.

    The unit of epoch numbers follows the size of their median: from 1e12 milliseconds, from
    1e9 seconds, else nanoseconds. Deciding that needs no sort of the table: counts below each
    limit and the values next to it say on which side the exact median lies, and all of them
    combine map-side into one row.
    """
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.NumericType):
        size = F.abs(F.col(column).cast("double"))
        parts = [F.count(column).alias("n")]
        for cut in (1e12, 1e9):
            name = f"c{cut:.0e}".replace("+", "")
            parts += [
                F.count_if(size < cut).alias(f"{name}_below"),
                F.max(F.when(size < cut, size)).alias(f"{name}_left"),
                F.min(F.when(size >= cut, size)).alias(f"{name}_right"),
            ]
        stats = df.agg(F.struct(*parts)).scalar()
        micros = (
            F.when(_median_reaches(stats, 1e12), F.lit(1e3))
            .when(_median_reaches(stats, 1e9), F.lit(1e6))
            .otherwise(F.lit(1e-3))
        )
        stamp = F.timestamp_micros((F.col(column) * micros).cast("bigint"))
    else:
        stamp = F.col(column).try_cast("timestamp")
    out = df.withColumn("created_dt", stamp).withColumn("created", day_of("created_dt"))
    return out.withColumns(
        {"created_weekday": weekday_of("created"), "created_month": F.month("created")}
    )
