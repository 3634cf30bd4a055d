"""Structured Streaming against the batch operators over the same edges."""

from edgeloom.operators import deltas, online
from edgeloom.streaming import chunks
from edgeloom.streaming import online as live
from test_graphs import online_case


def parts(test, folder):
    for k in range(3):
        test.filter(f"seq % 700 between {k * 170} and {k * 170 + 169}").coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch(spark, tmp_path):
    config, test, fold, _ = online_case(spark)
    folder = str(tmp_path / "edges")
    parts(test, folder)
    batch = deltas.chunk_deltas(test, config)
    columns = ["seq", "gid", "n", "in_chunk", "out_chunk", "full_chunk"]
    moved = chunks.stream_chunk_deltas(chunks.read_edge_stream(spark, folder), config)
    query = live.start_online(moved, fold, f"file://{tmp_path}/state", str(tmp_path / "states"))
    assert query.awaitTermination(120) and query.exception() is None
    states = spark.read.parquet(str(tmp_path / "states")).select("seq", "gid", "cluster_id", "score")
    expected = online.online_clusters(batch, fold)
    assert states.count() == test.count()
    assert sorted(map(tuple, states.collect())) == sorted(map(tuple, expected.collect()))

    again = chunks.stream_chunk_deltas(chunks.read_edge_stream(spark, folder), config)
    table = again.writeStream.format("memory").queryName("moved").outputMode("append").trigger(availableNow=True).start()
    assert table.awaitTermination(120)
    assert sorted(map(repr, spark.table("moved").select(columns).collect())) == sorted(map(repr, batch.select(columns).collect()))


def test_streamed_clusters_equal_the_fold(spark, data):
    from edgeloom.plans import registry

    batch = registry.QUERIES["online_clusters"](spark, data).collect()
    streamed = registry.QUERIES["streamed_online_clusters"](spark, data).collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch))
