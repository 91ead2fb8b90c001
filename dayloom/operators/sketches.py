"""Distinct customers of any days from sketches stored once per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = "created"
LOG_REGISTERS = 14


def error_bound(log_registers: int = LOG_REGISTERS, deviations: float = 4.0) -> float:
    """Relative error that an estimate keeps within, at so many standard deviations."""
    return deviations * 1.04 / 2 ** (log_registers / 2)


def customer_sketches(
    lines: DataFrame,
    keys: Sequence[str] = (),
    *,
    customer: str = "customerId",
    log_registers: int = LOG_REGISTERS,
) -> DataFrame:
    """(keys, created, sketch): a HyperLogLog sketch of the customers of each day.

    Sketches are built before the shuffle and merged after it, so a hot day moves a few kilobytes a
    task. Store them once; later days only add rows. NULL customers are nobody, but their days count.
    """
    who = F.col(customer).cast("string")
    sketch = F.hll_sketch_agg(who, F.lit(log_registers)).alias("sketch")
    return lines.filter(F.col(DAY).isNotNull()).groupBy(*keys, DAY).agg(sketch)


def customers_between(sketches: DataFrame, ranges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``ranges`` (name, first, last: days, both included) with the estimated number of distinct
    customers by keys as ``unique_customers``; one scan of the sketches serves all ranges.

    Every range unfolds into its days, which join the sketches by day. Ranges may overlap. A range
    without any day in the sketches is left out.
    """
    days = ranges.filter("first <= last").select("name", F.explode(F.sequence("first", "last")).alias(DAY))
    united = F.hll_union_agg("sketch", F.lit(False))
    return (
        sketches.join(days, DAY)
        .groupBy("name", *keys)
        .agg(F.hll_sketch_estimate(united).alias("unique_customers"))
    )
