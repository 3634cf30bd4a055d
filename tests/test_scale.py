"""Plans that do not depend on how the rows are spread over keys, blocks and micro-batches."""

import random
import shutil

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom import storage
from edgeloom.config import Config
from edgeloom.operators import centroids, deltas, online, selection
from edgeloom.operators.shingles import NODE
from edgeloom.sources.edges import read_edges, write_edges
from edgeloom.streaming import chunks
from edgeloom.streaming import online as live
from test_graphs import online_case

EDGES = "seq long, src_id long, src_type string, dst_id long, dst_type string, e_type string, gid int"


def hot_edges(spark, n=400, seed=2):
    """One source node has most of a stream's edges."""
    rng = random.Random(seed)
    rows = [(i, 1 if rng.random() < 0.8 else rng.randrange(2, 5), "a", rng.randrange(9), rng.choice("xyz"), rng.choice("pq"), 0 if rng.random() < 0.9 else 10) for i in range(n)]
    return spark.createDataFrame(rows, EDGES)


@pytest.mark.parametrize("most", [None, 1, 7, 60])
def test_hot_nodes_by_blocks(spark, monkeypatch, most):
    edges, config = hot_edges(spark), Config(chunk_length=5, max_edges=most, odd_chunk_mode="consistent")
    columns = ["seq", "gid", "n", "in_chunk", "out_chunk", "full_chunk"]
    whole = sorted(map(repr, deltas.chunk_deltas(edges, config).select(columns).collect()))
    monkeypatch.setattr(deltas, "BLOCK", 16)
    monkeypatch.setattr(deltas, "RANKS", 16)
    assert sorted(map(repr, deltas.chunk_deltas(edges, config).select(columns).collect())) == whole
    node = W.partitionBy(*NODE).orderBy("seq")
    plain = edges.withColumn("n", F.count("*").over(node if most is None else node.rangeBetween(-(most - 1), 0)))
    assert sorted((r["seq"], r["n"]) for r in plain.collect()) == sorted((r["seq"], r["n"]) for r in deltas.live_counts(edges, most).collect())


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_distances_by_blocks_of_centroids(spark, monkeypatch, limit):
    rng = random.Random(1)
    words = [(g, [rng.getrandbits(63)]) for g in range(9)]
    centers = [(k, [rng.getrandbits(63)]) for k in range(20)]
    monkeypatch.setattr(centroids, "BLOCK", 6)
    found = centroids.distances(spark.createDataFrame(words, "gid int, words array<bigint>"), spark.createDataFrame(centers, "cluster_id int, center array<bigint>"), 64, limit)
    fold = lambda a, b: 1 - bin(a ^ b).count("1") / 64
    from math import cos

    expected = {(g, k): 1 - cos(3.1415926535897 * (1 - fold(w[0], c[0]))) for g, w in words for k, c in centers}
    assert {(r["gid"], r["cluster_id"]): pytest.approx(r["distance"]) for r in found.collect()} == expected


def test_edge_files_of_a_folder_keep_their_order(spark, tmp_path):
    edges = hot_edges(spark, 900)
    write_edges(edges, str(tmp_path / "edges"), 5)
    assert len(list((tmp_path / "edges").glob("part-*"))) > 1
    assert sorted(map(tuple, read_edges(spark, str(tmp_path / "edges")).collect())) == sorted(map(tuple, edges.collect()))
    assert read_edges(spark, str(tmp_path / "edges")).count() == 900


def test_labels_of_an_empty_table(spark):
    edges = hot_edges(spark)
    assert selection.attack_labels(edges.limit(0)).collect() == []
    assert sorted(map(tuple, selection.attack_labels(edges).collect())) == [(0, "normal"), (10, "attack")]


def test_intermediate_tables_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: None)

    with pytest.raises(ValueError, match="share"):
        storage.shared_dir(Session())


# ---------------------------------------------------------------------------------------------- streams


def test_a_batch_that_is_run_again_gives_the_same(spark, tmp_path):
    """Each micro-batch is folded twice, as after a failure between its rows and its commit; states and snapshots are as from one pass."""
    config, test, fold, scores = online_case(spark)
    moved = deltas.chunk_deltas(test, config).persist()
    folder, last = f"file://{tmp_path}/state", test.agg(F.max("seq")).first()[0]
    periodic = live.Periodic(50, {}, [])
    live.write_file(live.state_path(folder, -1), __import__("pickle").dumps(fold))
    out, step = [], last // 3 + 1
    for batch in range(3):
        part = moved.filter(F.col("seq").between(batch * step, batch * step + step - 1))
        first = sorted(map(repr, live.fold_batch(part, batch, folder, periodic).collect()))
        again = live.fold_batch(part, batch, folder, periodic).collect()
        assert sorted(map(repr, again)) == first
        out += again
    states = sorted((r["seq"], r["gid"], r["cluster_id"], r["score"]) for r in out if r["interval"] is None)
    assert states == sorted(map(tuple, online.online_clusters(moved, fold).collect()))
    assert {r["interval"] for r in out if r["interval"] is not None} == set(range(last // 50 + 1))
    moved.unpersist()


def test_a_stream_that_fails_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    config, test, fold, _ = online_case(spark)
    folder, last = str(tmp_path / "edges"), test.agg(F.max("seq")).first()[0]
    for k in range(3):
        test.filter(F.col("seq").between(k * (last // 3 + 1), (k + 1) * (last // 3 + 1) - 1)).coalesce(1).write.mode("append").parquet(folder)
    state, out, whole = f"file://{tmp_path}/state", str(tmp_path / "out"), live.fold_batch

    def broken(rows, batch, *more):
        if batch == 1:
            whole(rows, batch, *more).collect()  # the state after it is written, its rows are not
            raise RuntimeError("lost")
        return whole(rows, batch, *more)

    run = lambda: live.start_online(chunks.stream_chunk_deltas(chunks.read_edge_stream(spark, folder), config), fold, state, out)
    monkeypatch.setattr(live, "fold_batch", broken)
    with pytest.raises(Exception, match="lost"):
        run().awaitTermination(120)
    monkeypatch.setattr(live, "fold_batch", whole)
    assert run().awaitTermination(120)
    expected = online.online_clusters(deltas.chunk_deltas(test, config), fold)
    assert sorted(map(tuple, live.read_states(spark, out).collect())) == sorted(map(tuple, expected.collect()))


def test_state_of_dead_edges_is_dropped(spark, tmp_path):
    """Nodes that get no further edge leave nothing behind once their edges are dead."""
    folder, config = str(tmp_path / "edges"), Config(chunk_length=4, max_edges=5)
    for k in range(4):
        rows = [(10 * k + i, 100 * k + i, "a", 1, "x", "p", 0) for i in range(10)]
        spark.createDataFrame(rows, EDGES).coalesce(1).write.mode("append").parquet(folder)
    moved = chunks.stream_chunk_deltas(chunks.read_edge_stream(spark, folder), config)
    query = moved.writeStream.format("memory").queryName("dead").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and spark.table("dead").count() == 40
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 30 and held[-1] <= 20
    shutil.rmtree(folder)
