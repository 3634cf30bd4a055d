"""The queries of the graph operators by name, and SQL for each that SQL can express.

They run over the events table, whose rows are read as edges (sources.edges), with bootstrap clusters of the graphs whose gid is a multiple of 20.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.config import DATASETS, Config
from edgeloom.operators import centroids, deltas, hashing, interleave, lsh, online, selection, shingles, similarity, sketches, snapshots
from edgeloom.operators.ordering import dense_seq, rank_within
from edgeloom.plans import oracles as o
from edgeloom.sources.edges import bootstrap_of_edges, edges_of_events, read_bootstrap, read_edges, write_bootstrap, write_edges
from edgeloom.storage import stored
from edgeloom.streaming import replay

#: Parameters of the queries; the bench takes 1000 components.
CONFIG = Config(chunk_length=6, sketch_bits=64, bands=16, band_rows=4, max_edges=150, snapshot_interval=1000)
SMALL = replace(CONFIG, sketch_bits=16, bands=4)
ODD = replace(CONFIG, chunk_length=5)
SIZE_EDGES, GLOBAL_THRESHOLD, THRESHOLD = 2000, 0.6, 0.5
#: The scenario whose graphs are attacks.
ATTACKS = 3
C, L = CONFIG.chunk_length, CONFIG.sketch_bits

Query = Callable[[SparkSession, str], DataFrame]


class Run:
    """The intermediate tables of one run; each is built when a query asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str, config: Config = CONFIG):
        self.spark, self.sf_dir, self.config = spark, sf_dir, config

    @property
    def edges(self) -> DataFrame:
        return edges_of_events(self.spark.read.parquet(f"{self.sf_dir}/events.parquet"))

    @property
    def boot(self) -> DataFrame:
        return bootstrap_of_edges(self.edges)

    @property
    def test(self) -> DataFrame:
        return dense_seq(selection.test_edges(self.edges, self.boot))

    @property
    def bag(self) -> DataFrame:
        return shingles.chunk_bag(self.edges, self.config.chunk_length)

    @property
    def vocab(self) -> DataFrame:
        return shingles.vocabulary(self.bag)

    @property
    def vectors(self) -> DataFrame:
        bag = self.bag
        return shingles.shingle_vectors(bag, shingles.vocabulary(bag))

    @property
    def projected(self) -> DataFrame:
        return sketches.projections(self.bag, self.config)

    @property
    def thresholds(self) -> DataFrame:
        return self.boot.select("cluster_id").distinct().withColumn("threshold", F.lit(THRESHOLD))

    def clusters(self) -> tuple[DataFrame, DataFrame]:
        """Projections and centroids, both used more than once and small: a row per graph, or cluster, and component."""
        projected = stored(self.projected)
        return projected, stored(centroids.centroids(projected, self.boot, self.config.sketch_bits))

    def measured(self) -> DataFrame:
        projected, centers = self.clusters()
        return centroids.distances(sketches.sketch_words(projected), centroids.centroid_words(centers), self.config.sketch_bits)

    def simhash(self) -> DataFrame:
        return sketches.simhash_projections(self.vectors, self.vocab, self.config)

    def labelled_bands(self) -> tuple[DataFrame, DataFrame]:
        """Bands, and which graphs are normal: here all but the scenario of attacks."""
        banded = stored(lsh.bands(sketches.sketch_bits(self.projected), self.config))
        return banded, banded.select("gid", F.when(selection.in_scenarios((ATTACKS,)), "attack").otherwise("normal").alias("label")).distinct()

    def fold(self) -> online.Fold:
        return online.start(self.config, self.boot, self.clusters()[1], self.thresholds, GLOBAL_THRESHOLD)

    def online(self) -> tuple[DataFrame, DataFrame]:
        """States after each edge, and the scores of the listed graphs before."""
        projected, centers = self.clusters()
        boot = self.boot
        fold = online.start(self.config, boot, centers, self.thresholds, GLOBAL_THRESHOLD)
        scores = centroids.train_scores(sketches.sketch_words(projected), boot, centroids.centroid_words(centers), self.config.sketch_bits)
        return online.online_clusters(deltas.chunk_deltas(self.test, self.config), fold), scores


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, config: Config = CONFIG):
    """Registers a function of a Run under its own name, and its SQL."""

    def register(f: Callable[[Run], DataFrame]) -> Callable[[Run], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Run(spark, sf_dir, config))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _round(name: str, alias: str | None = None):
    return (F.round(name, 6) + F.lit(0.0)).alias(alias or name)


SKETCHED = (o.EDGES, o.SHINGLES, o.chunks(C), o.family(L, C), o.signs("bag"), o.PROJECTED)

# ---------------------------------------------------------------------------------------------- scans and selection


@query(o.of(o.EDGES, "SELECT seq, src_id, src_type, dst_id, dst_type, e_type, gid FROM edges"))
def edge_scan(run: Run) -> DataFrame:
    return run.edges


@query(o.of(o.EDGES, "SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, src_id, src_type, dst_id, dst_type, e_type, gid FROM edges"))
def edge_file(run: Run) -> DataFrame:
    """The edges written as tab-separated files, and read back in their order."""
    folder = replay.own_folder(run.edges)
    write_edges(run.edges, f"{folder}/edges")
    return read_edges(run.spark, f"{folder}/edges")


@query(o.of(o.EDGES, f"SELECT cluster_id, gid, CAST({THRESHOLD} AS DOUBLE) AS threshold, CAST({GLOBAL_THRESHOLD} AS DOUBLE) AS global_threshold FROM boot"))
def bootstrap_file(run: Run) -> DataFrame:
    """The bootstrap clusters written as a file, and read back."""
    path = f"{replay.own_folder(run.edges)}/clusters"
    write_bootstrap(run.boot, run.thresholds, GLOBAL_THRESHOLD, path)
    members, thresholds, global_threshold = read_bootstrap(run.spark, path)
    return members.join(thresholds, "cluster_id").withColumn("global_threshold", F.lit(global_threshold))


def _scenario_filter(name: str) -> None:
    scenarios = ", ".join(map(str, DATASETS[name]))

    def f(run: Run) -> DataFrame:
        return selection.of_dataset(run.edges, replace(run.config, dataset=name)).select("seq", "gid", selection.scenario().alias("scenario"))

    f.__name__ = f"scenario_filter_{name}"
    query(o.of(o.EDGES, f"SELECT seq, gid, CAST(gid // 100 AS INTEGER) AS scenario FROM edges WHERE gid // 100 IN ({scenarios})"))(f)


for _name in DATASETS:
    _scenario_filter(_name)


@query(o.of(o.EDGES, "SELECT gid, gid IN (SELECT gid FROM boot) AS train, count(*) AS edges FROM edges GROUP BY gid"))
def train_split(run: Run) -> DataFrame:
    edges, boot = run.edges, run.boot
    train, test = selection.train_edges(edges, boot), selection.test_edges(edges, boot)
    both = train.select("gid", F.lit(True).alias("train")).unionByName(test.select("gid", F.lit(False).alias("train")))
    return both.groupBy("gid", "train").agg(F.count("*").alias("edges"))


@query(o.of(o.EDGES, "SELECT DISTINCT gid FROM test"))
def test_gids(run: Run) -> DataFrame:
    return selection.test_gids(run.edges, run.boot)


@query(
    o.of(
        o.EDGES,
        "SELECT CAST(max(gid) + 1 AS BIGINT) AS num_graphs, count(*) FILTER (k AND t) AS train_edges, count(*) FILTER (k AND NOT t) AS test_edges, count(*) FILTER (NOT k) AS dropped_edges"
        " FROM (SELECT gid, gid // 100 IN (1, 2, 3, 5) AS k, gid IN (SELECT gid FROM boot) AS t FROM edges)",
    )
)
def edge_counters(run: Run) -> DataFrame:
    return selection.counters(run.edges, run.boot, replace(run.config, dataset="gfc"))


@query(o.of(o.EDGES, "SELECT gid, CASE WHEN n = 600 THEN CASE WHEN gid BETWEEN 300 AND 399 THEN 'attack' ELSE 'normal' END ELSE CASE WHEN gid >= n // 2 THEN 'attack' ELSE 'normal' END END AS label FROM (SELECT DISTINCT gid, max(gid) OVER () + 1 AS n FROM edges)"))
def normal_attack_labels(run: Run) -> DataFrame:
    return selection.attack_labels(run.edges)


# ---------------------------------------------------------------------------------------------- shingles


@query(o.of(o.EDGES, "SELECT gid, src_id, src_type, count(*) AS degree FROM edges GROUP BY gid, src_id, src_type"))
def adjacency_sizes(run: Run) -> DataFrame:
    return run.edges.groupBy(*shingles.NODE).agg(F.count("*").alias("degree"))


@query(o.of(o.EDGES, f"SELECT gid, CAST(count(*) FILTER (seq > (SELECT max(seq) FROM test) - {SIZE_EDGES}) AS BIGINT) AS size FROM test GROUP BY gid"))
def graph_size_evicted(run: Run) -> DataFrame:
    return shingles.graph_sizes(run.test, SIZE_EDGES)


@query(o.of(o.EDGES, o.SHINGLES, "SELECT gid, src_id, src_type, shingle FROM shingles"))
def node_shingles(run: Run) -> DataFrame:
    return shingles.node_shingles(run.edges)


@query(o.of(o.EDGES, o.SHINGLES, o.chunks(C), "SELECT gid, src_id, src_type, chunk_no, chunk FROM chunks"))
def shingle_chunks(run: Run) -> DataFrame:
    return shingles.node_chunks(run.edges, C)


@query(o.of(o.EDGES, o.SHINGLES, o.chunks(5), "SELECT gid, src_id, src_type, chunk_no, chunk FROM chunks"))
def shingle_chunks_odd(run: Run) -> DataFrame:
    return shingles.node_chunks(run.edges, 5)


@query(o.of(o.EDGES, o.SHINGLES, o.chunks(C), "SELECT gid, src_id, src_type, chunk_no, chunk FROM chunks"))
def shingle_chunks_whole(run: Run) -> DataFrame:
    """The same chunks cut from whole shingles."""
    cut = shingles.node_shingles(run.edges).select(*shingles.NODE, F.posexplode(shingles.chunks_of(F.col("shingle"), C)).alias("chunk_no", "chunk"))
    return cut.withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query(o.of(o.EDGES, o.SHINGLES, o.chunks(C), "SELECT gid, chunk, cnt FROM bag"))
def chunk_bag(run: Run) -> DataFrame:
    return run.bag


@query(o.of(o.EDGES, o.SHINGLES, o.chunks(C), o.VOCABULARY, "SELECT chunk, chunk_id FROM vocab"))
def shingle_vocab(run: Run) -> DataFrame:
    return run.vocab


@query(o.of(o.EDGES, o.SHINGLES, o.chunks(C), o.VOCABULARY, "SELECT gid, chunk_id, cnt FROM vectors"))
def shingle_vectors(run: Run) -> DataFrame:
    return run.vectors


# ---------------------------------------------------------------------------------------------- sketches


@query(o.of(o.family(L, C), "SELECT i, j, hi, lo FROM family"))
def hash_family(run: Run) -> DataFrame:
    return hashing.hash_family(run.spark, run.config)


@query(o.of(o.EDGES, o.SHINGLES, o.chunks(C), o.family(L, C), o.signs("bag"), "SELECT chunk, i, sign FROM signs"))
def chunk_signs(run: Run) -> DataFrame:
    return hashing.chunk_signs(run.bag, run.config)


@query(o.of(*SKETCHED, "SELECT gid, i, p FROM projected"))
def projections(run: Run) -> DataFrame:
    return run.projected


@query(o.of(*SKETCHED, "SELECT gid, i, p FROM projected"))
def projections_by_join(run: Run) -> DataFrame:
    bag = run.bag
    return sketches.projections_by_join(bag, hashing.chunk_signs(bag, run.config))


@query(o.of(*SKETCHED, "SELECT gid, i, bit FROM bits"))
def sketch_bits(run: Run) -> DataFrame:
    return sketches.sketch_bits(run.projected)


@query(o.of(o.EDGES, o.SHINGLES, o.chunks(C), o.VOCABULARY, o.random(L), "SELECT i, chunk_id, r FROM random"))
def simhash_vectors(run: Run) -> DataFrame:
    return hashing.random_vectors(run.vocab, run.config)


@query(o.of(o.EDGES, o.SHINGLES, o.chunks(C), o.VOCABULARY, o.random(L), "SELECT gid, i, bit FROM rbits"))
def simhash_sketch(run: Run) -> DataFrame:
    return sketches.sketch_bits(run.simhash())


# ---------------------------------------------------------------------------------------------- similarity


@query(o.of(o.EDGES, o.SHINGLES, o.chunks(C), o.VOCABULARY, o.COSINES, "SELECT gid_a, gid_b, round(cosine, 6) + 0.0 AS cosine FROM cosines"))
def cosine_pairs(run: Run) -> DataFrame:
    return similarity.cosines(run.vectors).select("gid_a", "gid_b", _round("cosine"))


@query(o.of(o.EDGES, o.SHINGLES, o.chunks(C), o.VOCABULARY, o.COSINES, f"SELECT gid_a, gid_b, round(1 - acos(cosine) / {o.PI}, 6) + 0.0 AS angular FROM cosines"))
def angular_pairs(run: Run) -> DataFrame:
    found = similarity.cosines(run.vectors)
    return found.select("gid_a", "gid_b", similarity.angular(F.col("cosine")).alias("angular")).select("gid_a", "gid_b", _round("angular"))


@query(o.of(*SKETCHED, o.similar(L), "SELECT gid_a, gid_b, stream FROM pairs"))
def sketch_similarity(run: Run) -> DataFrame:
    pairs = similarity.all_pairs(stored(sketches.sketch_words(run.projected)))
    return pairs.select("gid_a", "gid_b", similarity.sketch_similarity(F.col("words_a"), F.col("words_b"), run.config.sketch_bits).alias("stream"))


@query(
    o.of(
        *SKETCHED,
        o.VOCABULARY,
        o.random(L),
        o.similar(L),
        o.COSINES,
        f"""
rpairs AS (SELECT a.gid AS gid_a, b.gid AS gid_b, sum(CASE WHEN a.bit = b.bit THEN 1 ELSE 0 END) / {float(L)} AS simhash FROM rbits a JOIN rbits b USING (i) GROUP BY a.gid, b.gid),
every AS (SELECT gid_a, gid_b, coalesce(cosine, 0.0) AS cosine, simhash, stream FROM pairs JOIN rpairs USING (gid_a, gid_b) LEFT JOIN cosines USING (gid_a, gid_b)),
angles AS (SELECT *, 1 - acos(cosine) / {o.PI} AS angular FROM every)""",
        f"""SELECT gid_a, gid_b, round(cosine, 6) + 0.0 AS cosine, round(angular, 6) + 0.0 AS angular, simhash, round(cos({o.PI} * (1 - simhash)), 6) + 0.0 AS simhash_cosine,
  stream, round(cos({o.PI} * (1 - stream)), 6) + 0.0 AS stream_cosine, round(stream - angular, 6) + 0.0 AS error FROM angles""",
    )
)
def similarity_report(run: Run) -> DataFrame:
    vectors = stored(run.vectors)
    stream, random = stored(sketches.sketch_words(run.projected)), stored(sketches.sketch_words(run.simhash()))
    found = similarity.similarity_report(vectors, stream, random, run.config.sketch_bits)
    return found.select("gid_a", "gid_b", _round("cosine"), _round("angular"), "simhash", _round("simhash_cosine"), "stream", _round("stream_cosine"), _round("error"))


# ---------------------------------------------------------------------------------------------- clusters

CLUSTERED = (*SKETCHED, o.centers(L))


@query(o.of(*CLUSTERED, "SELECT cluster_id, size FROM sizes"))
def cluster_sizes(run: Run) -> DataFrame:
    return centroids.cluster_sizes(run.boot)


@query(o.of(*CLUSTERED, "SELECT cluster_id, i, round(c, 6) + 0.0 AS c FROM centers"))
def centroid_projections(run: Run) -> DataFrame:
    return centroids.centroids(stored(run.projected), run.boot, run.config.sketch_bits).select("cluster_id", "i", _round("c"))


@query(o.of(*CLUSTERED, "SELECT cluster_id, i, bit FROM cbits"))
def centroid_sketches(run: Run) -> DataFrame:
    return centroids.centroid_bits(run.clusters()[1])


@query(o.of(*CLUSTERED, "SELECT gid, cluster_id, round(distance, 6) + 0.0 AS score FROM measured JOIN boot USING (gid, cluster_id)"))
def train_scores(run: Run) -> DataFrame:
    projected, centers = run.clusters()
    found = centroids.train_scores(sketches.sketch_words(projected), run.boot, centroids.centroid_words(centers), run.config.sketch_bits)
    return found.select("gid", "cluster_id", _round("score"))


@query(o.of(*CLUSTERED, "SELECT gid, cluster_id, round(distance, 6) + 0.0 AS distance, CAST(row_number() OVER (PARTITION BY gid ORDER BY distance, cluster_id) AS INTEGER) AS rank FROM measured"))
def centroid_distances(run: Run) -> DataFrame:
    return centroids.ranked(run.measured()).withColumn("distance", _round("distance"))


@query(o.of(*CLUSTERED, "SELECT gid, cluster_id, round(distance, 6) + 0.0 AS distance FROM nearest"))
def nearest_cluster(run: Run) -> DataFrame:
    return centroids.nearest(run.measured()).select("gid", "cluster_id", _round("distance"))


@query(o.of(*CLUSTERED, f"SELECT gid, cluster_id, round(distance, 6) + 0.0 AS distance, distance > least({GLOBAL_THRESHOLD}, {THRESHOLD}) AS anomaly FROM nearest"))
def anomaly_flags(run: Run) -> DataFrame:
    found = centroids.anomaly_flags(centroids.nearest(run.measured()), run.thresholds, GLOBAL_THRESHOLD)
    return found.withColumn("distance", _round("distance"))


# ---------------------------------------------------------------------------------------------- streams


@query(o.of(o.EDGES, f"SELECT seq, gid, count(*) OVER w AS n, min(seq) OVER w AS oldest FROM test WINDOW w AS {o.live(CONFIG.max_edges)}"))
def window_adjacency(run: Run) -> DataFrame:
    frame = W.partitionBy(*shingles.NODE).orderBy("seq").rangeBetween(-(run.config.max_edges - 1), 0)
    return deltas.live_counts(run.test, run.config.max_edges).select("seq", "gid", "n", F.min("seq").over(frame).alias("oldest"))


@query(o.of(o.EDGES, o.deltas(C, CONFIG.max_edges), "SELECT seq, gid, n, in_chunk, out_chunk FROM deltas"))
def chunk_delta(run: Run) -> DataFrame:
    return deltas.chunk_deltas(run.test, run.config).drop("full_chunk")


@query(o.of(o.EDGES, o.deltas(5, CONFIG.max_edges), "SELECT seq, gid, n, in_chunk, out_chunk FROM deltas"), ODD)
def chunk_delta_odd(run: Run) -> DataFrame:
    return deltas.chunk_deltas(run.test, run.config).drop("full_chunk")


STREAMED = (o.EDGES, o.deltas(C, CONFIG.max_edges), "\nmoved AS (SELECT seq, gid, in_chunk AS chunk, 1 AS s FROM deltas UNION ALL SELECT seq, gid, out_chunk, -1 FROM deltas WHERE out_chunk IS NOT NULL)")


@query(
    o.of(
        *STREAMED,
        o.family(16, C),
        o.signs("moved"),
        "\nsteps AS (SELECT seq, gid, i, CAST(sum(s * sign) AS BIGINT) AS delta FROM moved JOIN signs USING (chunk) GROUP BY seq, gid, i)",
        "SELECT seq, gid, i, delta, CAST(sum(delta) OVER (PARTITION BY gid, i ORDER BY seq) AS BIGINT) AS p FROM steps",
    ),
    SMALL,
)
def running_projection(run: Run) -> DataFrame:
    return deltas.running_projections(deltas.chunk_deltas(run.test, run.config), run.config)


@query(o.of(*STREAMED, o.family(L, C), o.signs("moved"), "SELECT gid, i, CAST(sum(s * sign) AS BIGINT) AS p FROM moved JOIN signs USING (chunk) GROUP BY gid, i"))
def final_projection(run: Run) -> DataFrame:
    return deltas.final_projections(deltas.chunk_deltas(run.test, run.config), run.config)


@query(o.of(o.EDGES, o.deltas(C, CONFIG.max_edges), "SELECT seq, gid, n, in_chunk, out_chunk FROM deltas"))
def streamed_chunk_delta(run: Run) -> DataFrame:
    """The deltas by Structured Streaming, the edges arriving in several micro-batches."""
    return replay.streamed_chunk_deltas(run.test, run.config).drop("full_chunk")


FOLDED = (*CLUSTERED, o.fold(L, C, CONFIG.max_edges, min(GLOBAL_THRESHOLD, THRESHOLD)))
STATES = o.of(*FOLDED, "SELECT seq, gid, cluster_id, round(score, 6) + 0.0 AS score FROM fold WHERE seq >= 0", recursive=True)
SNAPSHOTS = o.of(*FOLDED, o.snapshots(CONFIG.snapshot_interval), 'SELECT "interval", gid, cluster_id, score FROM snaps', recursive=True)


@query(STATES)
def online_clusters(run: Run) -> DataFrame:
    return run.online()[0].withColumn("score", _round("score"))


@query(STATES)
def streamed_online_clusters(run: Run) -> DataFrame:
    """The states of online_clusters by Structured Streaming."""
    return replay.streamed_online_clusters(run.test, run.fold()).withColumn("score", _round("score"))


@query(SNAPSHOTS)
def cluster_snapshots(run: Run) -> DataFrame:
    states, scores = run.online()
    found = snapshots.snapshots(stored(states), scores, selection.test_gids(run.edges, run.boot), run.config.snapshot_interval)
    return found.withColumn("score", _round("score"))


@query(SNAPSHOTS)
def streamed_snapshots(run: Run) -> DataFrame:
    """The same, emitted by Structured Streaming every so many edges."""
    return replay.streamed_snapshots(run.test, run.fold(), run.online()[1]).withColumn("score", _round("score"))


@query(o.of(o.EDGES, "SELECT gid, place, CAST(place // 10 AS INTEGER) AS \"group\" FROM (SELECT gid, row_number() OVER (ORDER BY md5('23:' || gid), gid) - 1 AS place FROM (SELECT DISTINCT gid FROM test))"))
def stream_groups(run: Run) -> DataFrame:
    return interleave.stream_groups(selection.test_gids(run.edges, run.boot), run.config.parallel_graphs, run.config.seed)


@query()
def interleaved_stream(run: Run) -> DataFrame:
    return interleave.interleave(selection.test_edges(run.edges, run.boot), run.config.parallel_graphs, run.config.seed)


@query(o.of(o.EDGES, "SELECT gid, count(*) AS edges, true AS in_order, true AS in_group FROM test GROUP BY gid"))
def interleaved_contract(run: Run) -> DataFrame:
    """What an interleaved stream keeps: every edge once, each graph's edges in their order, and seq dense and by groups of graphs, one after another."""
    before = selection.test_edges(run.edges, run.boot)
    after = stored(interleave.interleave(before, run.config.parallel_graphs, run.config.seed))
    groups = interleave.stream_groups(before, run.config.parallel_graphs, run.config.seed)
    both = rank_within(before, ["gid"]).join(rank_within(after, ["gid"]).withColumnsRenamed({c: f"{c}_after" for c in before.columns if c != "gid"}), ["gid", "k"], "full")
    same = F.lit(True)
    for c in before.columns:
        if c not in ("gid", "seq"):
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_after"))
    sizes = before.groupBy("gid").count().join(groups, "gid").groupBy("group").agg(F.sum("count").alias("n"))
    places = sizes.select("group", (F.sum("n").over(W.orderBy("group")) - F.col("n")).alias("first"), "n")
    placed = both.join(groups.select("gid", "group"), "gid").join(places, "group")
    inside = (F.col("seq_after") >= F.col("first")) & (F.col("seq_after") < F.col("first") + F.col("n"))
    kept = placed.groupBy("gid").agg(F.count("seq_after").alias("edges"), F.min(same).alias("in_order"), F.min(F.coalesce(inside, F.lit(False))).alias("inside"))
    dense = after.agg((F.countDistinct("seq") == F.max("seq") + 1).alias("dense"), F.min("seq").alias("least"))
    return kept.join(F.broadcast(dense)).select("gid", "edges", "in_order", (F.col("inside") & F.col("dense") & (F.col("least") == 0)).alias("in_group"))


# ---------------------------------------------------------------------------------------------- banding

BANDED = (*SKETCHED, o.banded(CONFIG.band_rows))


@query(o.of(*BANDED, "SELECT gid, band, bucket FROM banded"))
def lsh_bands(run: Run) -> DataFrame:
    return lsh.bands(sketches.sketch_bits(run.projected), run.config)


@query(o.of(*BANDED, "SELECT gid_a, gid_b FROM near"))
def lsh_neighbors(run: Run) -> DataFrame:
    return lsh.neighbors(stored(lsh.bands(sketches.sketch_bits(run.projected), run.config)))


@query(o.of(*BANDED, "\nreach AS (SELECT gid_a, gid_b FROM near UNION SELECT r.gid_a, n.gid_b FROM reach r JOIN near n ON r.gid_b = n.gid_a)", "SELECT gid_a AS gid, min(gid_b) AS component FROM reach GROUP BY gid_a", recursive=True))
def lsh_components(run: Run) -> DataFrame:
    return lsh.lsh_components(stored(lsh.bands(sketches.sketch_bits(run.projected), run.config)))


@query(o.of(*BANDED, "SELECT gid, band, bucket FROM banded WHERE gid NOT BETWEEN 300 AND 399"))
def lsh_tables(run: Run) -> DataFrame:
    """The buckets that the normal graphs alone are put into."""
    banded, labels = run.labelled_bands()
    return lsh.labelled(banded, labels, "normal")


@query(o.of(*BANDED, "SELECT gid, NOT bool_or(hit) AS isolated FROM (SELECT b.gid, EXISTS (SELECT 1 FROM banded x WHERE x.band = b.band AND x.bucket = b.bucket AND x.gid NOT BETWEEN 300 AND 399) AS hit FROM banded b) GROUP BY gid"))
def isolation_test(run: Run) -> DataFrame:
    banded, labels = run.labelled_bands()
    return lsh.isolated(banded, lsh.labelled(banded, labels, "normal"))
