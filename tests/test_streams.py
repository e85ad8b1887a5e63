"""Streams over files: replies in time, entries new within their time to live."""

import datetime as dt

from quillspark.session import shared_folder
from quillspark.streaming import flows

T0 = dt.datetime(2024, 1, 1)


def at(seconds: int) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def streamed(spark, rows, schema):
    path = shared_folder(spark, "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def caught_up(spark, df):
    out = shared_folder(spark, "out")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out).collect()


def test_replies_match_within_the_time(spark):
    asked = streamed(spark, [("s", 1, at(0)), ("s", 2, at(0)), ("t", 1, at(0))], "session string, id int, asked_at timestamp")
    replied = streamed(spark, [("s", 1, at(599), "in time"), ("s", 2, at(601), "late"), ("u", 1, at(1), "nobody asked")], "session string, id int, replied_at timestamp, body string")
    assert [(r.session, r.id, r.body) for r in caught_up(spark, flows.matched(asked, replied))] == [("s", 1, "in time")]


def test_first_entry_of_a_key(spark):
    rows = [("a", at(0), 1), ("a", at(60), 2), ("b", at(5), 3)]
    got = caught_up(spark, flows.first_in_window(streamed(spark, rows, "key string, ts timestamp, v int")))
    assert sorted(r.key for r in got) == ["a", "b"]
