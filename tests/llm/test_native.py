"""Plans of the native operators hold no Python, and hot keys are spread."""

import pytest

from dayloom.llm import chat, sharding


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["sharding", "chat"])
def test_native_plans(spark, kind):
    if kind == "sharding":
        df = sharding.shard_report(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    else:
        frame = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
        df = chat.chat_report(chat.with_hostile(frame))
    assert not any(x in plan_of(df) for x in ("Python", "Arrow", "Pandas", "Cartesian"))
