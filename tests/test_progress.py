"""Progress in keyed state over restarts of its stream."""

from __future__ import annotations

import datetime
import sys

import pytest
from pyspark import cloudpickle

from papyra.streaming import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SCHEMA = "document_id string, source string, payload string, updated_at timestamp"


def at(second):
    return datetime.datetime(2024, 1, 1, 0, 0, second)


@pytest.fixture
def keyed(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ingest.use_keyed_state(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_progress_survives_two_restarts(keyed, tmp_path):
    spark, came = keyed, tmp_path / "in"
    out: dict[int, list] = {}

    def run(batch, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(came))
        stream = spark.readStream.schema(SCHEMA).parquet(str(came))

        def keep(df, number):
            out[batch] = out.get(batch, []) + sorted((r.document_id, r.source, r.payload, r.expired) for r in df.collect())

        query = ingest.tracked_progress(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(100)
        assert query.exception() is None

    run(0, [("a", "tree", "t1", at(5)), ("a", "md", "m1", at(1)), ("b", "tree", "t2", at(1)), (None, "md", "x", at(1)), ("c", "elsewhere", "x", at(1)), ("d", "md", "x", None)])
    assert out[0] == [("a", "md", "m1", False), ("b", "tree", "t2", False)]
    # memory comes before the others, an older update changes nothing, and equal rows say nothing new
    run(1, [("a", "memory", "mem", at(0)), ("b", "tree", "late", at(0)), ("b", "tree", "t2", at(1))])
    assert out[1] == [("a", "memory", "mem", False)]
    run(2, [("b", "extract", None, at(9)), ("a", "md", "m2", at(9)), ("e", "md", "new", at(1))])
    assert out[2] == [("a", "memory", "mem", False), ("b", "extract", "", False), ("e", "md", "new", False)]


def test_silent_documents_are_forgotten(keyed, tmp_path):
    spark, came, out = keyed, tmp_path / "in", []
    later = at(1) + datetime.timedelta(days=3)

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(came))
        stream = spark.readStream.schema(SCHEMA).parquet(str(came))
        query = ingest.tracked_progress(stream, keep_ms=1000).writeStream.foreachBatch(lambda df, n: out.extend((r.document_id, r.payload, r.expired) for r in df.collect()))
        query.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(100)

    run([("a", "md", "one", at(1))])
    run([("b", "md", "two", later)])
    run([("a", "tree", "again", later)])
    assert out[:3] == [("a", "one", False), ("b", "two", False), ("a", "one", True)] and ("a", "again", False) in out[3:]
