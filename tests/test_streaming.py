"""Rows delivered twice, in one file and across files, arrive once."""

from evigraph.streaming.replay import once


def test_replay_keeps_each_key_once(spark, tmp_path):
    source, schema = tmp_path / "in", "id bigint, v string"
    run = lambda: once(spark.readStream.schema(schema).parquet(str(source)), ["id"], str(tmp_path / "out"), str(tmp_path / "ck")).start().awaitTermination()
    for rows in ([(1, "a"), (1, "a"), (2, "b")], [(2, "late"), (3, "c")], []):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        run()
    got = sorted((r.id, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "a"), (2, "b"), (3, "c")]
