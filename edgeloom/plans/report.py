"""The report of a run as text, and the run from files to report."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.config import Config
from edgeloom.operators import centroids, deltas, interleave, online, selection, shingles, sketches, snapshots
from edgeloom.operators.ordering import dense_seq
from edgeloom.sources.edges import checked_bootstrap
from edgeloom.storage import stored


@dataclass
class Result:
    config: Config
    sizes: DataFrame  # gid, size
    snapshots: DataFrame  # interval, gid, cluster_id, score
    states: DataFrame  # seq, gid, cluster_id, score
    scores: DataFrame  # gid, cluster_id, score of listed graphs
    seconds: dict[str, float]
    edges: int

    @property
    def timings(self) -> DataFrame:
        """phase, seconds, edges, us_per_edge: each phase reads and writes stored tables, so none does another's work."""
        rows = [(name, s, self.edges, 1e6 * s / self.edges) for name, s in self.seconds.items()]
        return self.states.sparkSession.createDataFrame(rows, "phase string, seconds double, edges long, us_per_edge double")


def run(edges: DataFrame, members: DataFrame, thresholds: DataFrame, global_threshold: float, config: Config, shuffled: bool = True, allow_duplicates: bool = False) -> Result:
    """Bootstrap clusters from the listed graphs, then stream all others. shuffled: draw the order of arrival; else the edges' own seq is it. Stages are timed as wholes, in seconds."""
    members = checked_bootstrap(members, thresholds, allow_duplicates)
    edges = selection.of_dataset(edges, config)
    train, test = selection.train_edges(edges, members), selection.test_edges(edges, members)
    seconds, at = {}, time.perf_counter()

    def lap(name: str) -> None:
        nonlocal at
        now = time.perf_counter()
        seconds[name], at = now - at, now

    test = stored(interleave.interleave(test, config.parallel_graphs, config.seed) if shuffled else dense_seq(test))
    n = test.count()
    if not n:
        raise ValueError("no edges to stream")
    lap("order")
    projected = stored(sketches.projections(shingles.chunk_bag(train, config.chunk_length), config))
    centers = stored(centroids.centroids(projected, members, config.sketch_bits))
    scores = stored(centroids.train_scores(sketches.sketch_words(projected), members, centroids.centroid_words(centers), config.sketch_bits))
    lap("bootstrap")
    counted = stored(deltas.live_counts(test, config.max_edges))
    lap("graphs")
    moved = stored(deltas.deltas_of(counted, config))
    lap("shingles")
    states = stored(online.online_clusters(moved, online.start(config, members, centers, thresholds, global_threshold)))
    lap("sketches and clusters")
    gids = test.select("gid").distinct()
    return Result(config, shingles.graph_sizes(test, config.max_edges), snapshots.snapshots(states, scores, gids, config.snapshot_interval), states, scores, seconds, n)


def lines(result: Result) -> Iterator[str]:
    """The report, line by line: parameters, seconds per edge, graph sizes, and scores and clusters of each snapshot. Rows come to the driver one at a time."""
    c = result.config
    yield f"Streaming clusters: chunk length {c.chunk_length}, {c.sketch_bits} sketch bits, {c.parallel_graphs} graphs at a time, {c.max_edges or 'all'} edges live, dataset {c.dataset}"
    for name, s in result.seconds.items():
        yield f"{name}: {s:.3f} s, {1e6 * s / result.edges:.3f} us/edge"
    yield "Graph sizes:"
    for r in result.sizes.orderBy("gid").toLocalIterator():
        yield f"{r['gid']},{r['size']}"
    row = result.snapshots.groupBy("interval").agg(F.array_sort(F.collect_list(F.struct("gid", "score", "cluster_id"))).alias("x"))
    last = result.states.agg(F.max("seq")).first()[0]
    yield f"Iterations {last // c.snapshot_interval + 1}"
    for r in row.orderBy("interval").toLocalIterator():
        yield " ".join(f"{x['score']:g}" for x in r["x"])
        yield " ".join(str(x["cluster_id"]) for x in r["x"])


def write(result: Result, folder: str) -> None:
    """The same as Parquet tables."""
    for name in ("sizes", "snapshots", "states", "scores", "timings"):
        getattr(result, name).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def session(name: str = "edgeloom", work_dir: str | None = None) -> SparkSession:
    """work_dir: the folder for tables between stages, which all machines share; a local master can do without."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    return (builder.config("spark.checkpoint.dir", work_dir) if work_dir else builder).getOrCreate()
