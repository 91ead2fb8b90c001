"""Future values supplied by the caller as JSON, and covariates for days to come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayloom.functions import threshold_flag

_ENTRIES = "array<struct<date: string, value: string>>"


def parse_overrides(
    df: DataFrame, column: str, keys: Sequence[str] = (), *, strict: bool = True
) -> DataFrame:
    """(keys, created, value) from JSON arrays of ``{"date", "value"}``.

    Only the first ten characters of a date count and the last entry of a day wins. Blank text
    gives no rows. With ``strict`` an unreadable entry fails the query, otherwise it is dropped.
    """
    text = F.trim(F.col(column))
    entries = F.from_json(text, _ENTRIES)
    read = df.filter(text.isNotNull() & (text != "") & (text != "null"))
    if strict:
        read = read.select(
            *keys,
            F.when(
                text.startswith("[") & entries.isNotNull(), entries
            ).otherwise(F.raise_error(F.lit(f"{column}: a JSON array is expected"))).alias("e"),
        )
    else:
        read = read.select(*keys, entries.alias("e"))
    rows = read.select(*keys, F.posexplode("e").alias("pos", "item"))
    day = F.substring(F.trim("item.date"), 1, 10).try_cast("date")
    number = F.col("item.value").try_cast("double")
    sound = day.isNotNull() & F.coalesce(F.abs(number) < F.lit(float("inf")), F.lit(False))
    if strict:
        problem = F.concat(
            F.lit(f"{column}["), F.col("pos"), F.lit("]: a date and a finite value are expected")
        )
        number = F.when(sound, number).otherwise(F.raise_error(problem))
    else:
        rows = rows.filter(sound)
    typed = rows.select(*keys, "pos", day.alias("created"), number.alias("value"))
    return typed.groupBy(*keys, "created").agg(F.max_by("value", "pos").alias("value"))


def overrides_from_text(spark: SparkSession, text: str | None, name: str) -> DataFrame | None:
    """One request parameter; ``None`` when it is missing, blank or an empty list."""
    if text is None or text.strip() in ("", "null", "[]"):
        return None
    return parse_overrides(spark.createDataFrame([(text,)], f"{name} string"), name)


def future_covariates(
    last: DataFrame,
    days: int,
    *,
    keys: Sequence[str] = (),
    ad_spend: DataFrame | None = None,
    events: DataFrame | None = None,
) -> DataFrame:
    """Known inputs of the ``days`` days after each series' last day.

    ``last`` holds one row per series (keys, created, adSpend). Spend of a day without an
    override is that of the day before; an event is 1 only where an override reaches 0.5.
    Overrides are (created, value) rows, optionally per key.
    """
    horizon = last.select(
        *keys,
        F.col("adSpend").alias("_last_spend"),
        F.explode(
            F.sequence(F.date_add("created", 1), F.date_add("created", days))
        ).alias("created"),
    )
    out = horizon
    for name, table in (("_spend", ad_spend), ("_event", events)):
        if table is None:
            out = out.withColumn(name, F.lit(None).cast("double"))
            continue
        on = [k for k in keys if k in table.columns] + ["created"]
        out = out.join(table.select(*on, F.col("value").alias(name)), on, "left")
    so_far = W.partitionBy(*keys).orderBy("created").rowsBetween(W.unboundedPreceding, 0)
    flag = threshold_flag(F.coalesce("_event", F.lit(0.0)))
    out = out.select(
        *keys,
        "created",
        F.coalesce(F.last("_spend", ignorenulls=True).over(so_far), "_last_spend").alias("adSpend"),
        flag.alias("event_start"),
    )
    ahead = W.partitionBy(*keys).orderBy("created")
    return out.withColumn(
        "event_start_next_1", F.coalesce(F.lead("event_start").over(ahead), F.lit(0.0))
    )
