"""Streams over files that come one by one."""

import pytest

from quillon.sources import published
from quillon.streaming.publish import keep_last, publish_stream

SCHEMA = "k long, at long, v string"


def test_stream_is_published_batch_by_batch(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    parts = [[(1, 1, "a"), (2, 1, "b"), (1, 3, "c")], [(1, 2, "late"), (3, 1, "d"), (2, 1, "same"), (4, None, "none")], [(2, 5, "e"), (4, 0, "f")]]
    best = {}
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        publish_stream(stream, root, checkpoint, keep_last("k", "at")).awaitTermination()
        for k, at, v in rows:
            if k not in best or (at is not None, at or 0) > (best[k][0] is not None, best[k][0] or 0):
                best[k] = (at, v)
        assert {r["k"]: (r["at"], r["v"]) for r in published.read(spark, root, "rows").collect()} == best
        assert published.current(spark, root).note == {"batch": n}
    before = published.current(spark, root)

    # the same batches again, from a lost checkpoint: nothing is published twice
    publish_stream(spark.readStream.schema(SCHEMA).parquet(source), root, str(tmp_path / "again"), keep_last("k", "at")).awaitTermination()
    assert published.current(spark, root) == before

    spark.createDataFrame([(9, 9, "bad")], SCHEMA).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="not published"):
        publish_stream(spark.readStream.schema(SCHEMA).parquet(source), root, checkpoint, keep_last("k", "at"), lambda t: t["rows"].where("v = 'bad'")).awaitTermination()
    assert published.current(spark, root) == before
    with pytest.raises(ValueError, match="not a stream"):
        publish_stream(spark.createDataFrame([], SCHEMA), root, checkpoint, keep_last("k", "at"))
