"""Sliding windows of the feature panel and their standardisation.

:func:`sliding_windows` slides over whole series, one task a series. :func:`training_vectors` slides
over halo blocks: runs of consecutive rows together with the ``window`` rows before them, so that a
single long series fills many tasks. Blocks, split and row numbers follow from counts of day ranges;
no series is gathered, and only compact panel rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayloom.functions import day_number
from dayloom.operators.calendar import by_day
from dayloom.operators.features import numeric_columns
from dayloom.operators.split import cut_index

DAY = "created"
RANGE_DAYS = 512  # days numbered together
BLOCK_ROWS = 256  # rows whose windows are built together
TASK_ROWS = 1024  # rows of panel from which one more task builds windows


def sliding_windows(
    panel: DataFrame,
    features: Sequence[str] | None = None,
    *,
    target: str = "orders",
    window: int = 28,
    keys: Sequence[str] = (),
    day: str = DAY,
) -> DataFrame:
    """(keys, day, X, y): the ``window`` rows before each day, and that day's target.

    Rows with a NULL feature are left out beforehand, windows touching an infinity afterwards
    (judged row by row, not window by window; the metadata of ``X`` says so). Series too short
    for one window give no row; :func:`require_windows` turns an empty result into an error.
    """
    if window <= 0:
        raise ValueError("window must be positive")
    if target not in panel.columns:
        raise ValueError(f"no column {target!r}")
    features = list(features or numeric_columns(panel, without=keys))
    sound = panel.dropna(subset=[*features, target])
    frame = by_day(keys, day).rowsBetween(-window, -1)
    values = [F.col(c).cast("double") for c in features]
    y = F.col(target).cast("double")
    limit = F.lit(float("inf"))
    largest = F.greatest(F.lit(0.0), *[F.abs(v) for v in values])
    marks = {"finite": True, "feature_columns": features}
    framed = sound.select(
        *keys,
        day,
        F.collect_list(F.array(*values)).over(frame).alias("X", metadata=marks),
        y.alias("y"),
        F.bool_and(largest < limit).over(frame).alias("_finite"),
    )
    whole = framed.filter((F.size("X") == window) & F.col("_finite") & (F.abs("y") < limit))
    return whole.drop("_finite")


def _joined(rows: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which a NULL key is a key of its own, as it is for windows."""
    renamed = table.withColumnsRenamed({c: f"_on_{i}" for i, c in enumerate(on)})
    same = None
    for i, c in enumerate(on):
        one = F.col(c).eqNullSafe(F.col(f"_on_{i}"))
        same = one if same is None else same & one
    return rows.join(renamed, same).drop(*[f"_on_{i}" for i in range(len(on))])


def numbered_rows(
    rows: DataFrame, keys: Sequence[str] = (), day: str = DAY, *, range_days: int = RANGE_DAYS
) -> DataFrame:
    """Adds ``_at``: a row's number from 0 in its series by day (one row a day).

    Rows are numbered inside ranges of days; the counts of the ranges, one row each, give the offsets.
    """
    ranged = rows.filter(F.col(day).isNotNull()).withColumn("_range", F.floor(day_number(day) / range_days))
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(day)) - 1
    joined = _joined(ranged.withColumn("_inside", inside), offsets, [*keys, "_range"])
    return joined.withColumn("_at", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def training_vectors(
    panel: DataFrame,
    features: Sequence[str] | None = None,
    *,
    target: str = "orders",
    window: int = 28,
    ratio: float = 0.2,
    keys: Sequence[str] = (),
    day: str = DAY,
    block_rows: int = BLOCK_ROWS,
    tasks: int | None = None,
) -> DataFrame:
    """(keys, day, split, features, y): what :func:`sliding_windows` and ``flat_split`` give, built in
    halo blocks of ``block_rows`` rows.

    A row is copied into every later block whose windows reach back to it. The split needs the number
    of whole windows before a block, so the blocks are counted before anything slides; vectors are
    built last and never shuffled. Rows without a day take no part. ``tasks`` build them, one for TASK_ROWS rows by default. Build it
    on a stored panel: its rows are read for the counts and for the windows.
    """
    if window <= 0:
        raise ValueError("window must be positive")
    if target not in panel.columns:
        raise ValueError(f"no column {target!r}")
    features = list(features or numeric_columns(panel, without=keys))
    values = [F.col(c).cast("double") for c in features]
    limit = F.lit(float("inf"))
    sound = panel.dropna(subset=[*features, target]).select(
        *keys,
        day,
        F.array(*values).alias("_x"),
        F.col(target).cast("double").alias("y"),
        (F.greatest(F.lit(0.0), *[F.abs(v) for v in values]) < limit).alias("_finite"),
    )
    if tasks is None:
        most = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(1, min(most, -(-panel.count() // TASK_ROWS)))
    own = F.floor(F.col("_at") / block_rows)
    reach = F.sequence(own, F.floor((F.col("_at") + window) / block_rows))
    blocks = numbered_rows(sound, keys, day).withColumns({"_own": own, "_block": F.explode(reach)})
    inside = W.partitionBy(*keys, "_block").orderBy("_at")
    before = inside.rowsBetween(-window, -1)
    whole = (
        (F.col("_own") == F.col("_block"))
        & (F.col("_at") >= window)
        & F.bool_and("_finite").over(before)
        & (F.abs("y") < limit)
    )
    counts = blocks.withColumn("_whole", whole).groupBy(*keys, "_block").agg(F.count_if("_whole").alias("_n"))
    series, earlier = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_block")
    offsets = counts.select(
        *keys,
        "_block",
        F.coalesce(F.sum("_n").over(earlier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(series).alias("_windows"),
    )
    number = F.col("_before") + F.count_if("_whole").over(inside) - 1
    train = number < cut_index(F.col("_windows"), ratio)
    placed = _joined(blocks, offsets, [*keys, "_block"]).repartition(tasks, *keys, "_block")
    slid = placed.withColumn("_whole", whole).withColumns(
        {
            "split": F.when(train, F.lit("train")).otherwise(F.lit("val")),
            "_rows": F.collect_list("_x").over(before),
        }
    )
    marks = {"finite": True, "feature_columns": features}
    vector = array_to_vector(F.flatten("_rows")).alias("features", metadata=marks)
    return slid.filter("_whole").select(*keys, day, "split", vector, "y")


def require_windows(windows: DataFrame) -> DataFrame:
    if windows.isEmpty():
        raise ValueError("not enough rows to build a window")
    return windows


def flatten_windows(windows: DataFrame, name: str = "features") -> DataFrame:
    """Adds the time-major ML vector of ``X``."""
    return windows.withColumn(name, array_to_vector(F.flatten("X")))


def window_scaler(
    panel: DataFrame,
    features: Sequence[str],
    *,
    target: str = "orders",
    window: int = 28,
    ratio: float = 0.2,
    keys: Sequence[str] = (),
    day: str = DAY,
) -> DataFrame:
    """(keys, column, mean, std) over all training windows: population std, 0 replaced by 1.

    A panel row counts once for every training window that contains it. That number follows
    from the row's position, so the statistics come from weighted panel rows and the windows
    themselves (``window`` times the data) are never built.
    """
    whole = W.partitionBy(*keys)
    goal = "(target)"
    placed = panel.dropna(subset=[*features, target]).select(
        *keys,
        *[F.col(c).cast("double").alias(c) for c in features],
        F.col(target).cast("double").alias(goal),
        (F.row_number().over(by_day(keys, day)) - 1).alias("_at"),
        F.count(F.lit(1)).over(whole).alias("_rows"),
    )
    train = cut_index(F.col("_rows") - window, ratio)
    first = F.greatest(F.lit(window), F.col("_at") + 1)
    last = F.least(F.col("_at") + window, train + window - 1)
    is_target = (F.col("_at") >= window) & (F.col("_at") < train + window)
    columns = [*features, goal]
    # Sums of squares around a value of the series itself stay free of cancellation.
    weighted = placed.withColumns(
        {
            "_w": F.greatest(last - first + 1, F.lit(0)).cast("double"),
            "_t": is_target.cast("double"),
            "_c": F.first(F.struct(*columns)).over(whole.orderBy("_at")),
        }
    )
    moments = []
    for i, c in enumerate(columns):
        w = F.col("_t") if c == goal else F.col("_w")
        v = F.col(c) - F.col("_c")[c]
        mean, square = F.sum(w * v) / F.sum(w), F.sum(w * v * v) / F.sum(w)
        moments.append(
            F.struct(
                F.lit(c).alias("column"),
                (F.max(F.col("_c")[c]) + mean).alias("mean"),
                F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"),
            ).alias(f"_{i}")
        )
    stats = weighted.groupBy(*keys).agg(*moments)
    listed = stats.select(
        *keys, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))]))
    )
    return listed.withColumn("std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


def standardize_windows(
    windows: DataFrame, scaler: DataFrame, features: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Apply :func:`window_scaler` to ``X`` and ``y`` (one scaler row per series joins in)."""
    stats = scaler.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct("mean", "std")))).alias("_s")
    )
    if keys:
        joined = windows.join(stats, list(keys))
    else:
        joined = windows.withColumn("_s", stats.select("_s").scalar())
    order = F.array(*[F.lit(c) for c in features])
    means = F.transform(order, lambda c: F.col("_s")[c]["mean"])
    stds = F.transform(order, lambda c: F.col("_s")[c]["std"])
    goal = F.col("_s")["(target)"]
    ready = joined.withColumns({"_m": means, "_d": stds})
    scaled = F.transform(
        "X",
        lambda row: F.transform(
            F.arrays_zip(row.alias("v"), F.col("_m").alias("m"), F.col("_d").alias("d")),
            lambda z: (z["v"] - z["m"]) / z["d"],
        ),
    )
    return ready.withColumns(
        {"X": scaled, "y": (F.col("y") - goal["mean"]) / goal["std"]}
    ).drop("_s", "_m", "_d")
