import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dayloom.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n: int, start: str = "2024-01-01") -> dt.date:
    """The n-th day (from 0) after ``start``; 2024-01-01 is a Monday."""
    return dt.date.fromisoformat(start) + dt.timedelta(days=n)


@pytest.fixture(scope="session")
def series_of(spark):
    """Daily series (created, y) from values starting on day 0; ``...`` leaves a day out."""

    def build(values, start="2024-01-01"):
        rows = [
            (day(i, start), None if v is None else float(v))
            for i, v in enumerate(values)
            if v is not ...
        ]
        return spark.createDataFrame(rows, "created date, y double")

    return build


def column(df, name, order="created"):
    return [r[name] for r in df.orderBy(order).collect()]
