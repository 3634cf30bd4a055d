"""Graph operators against small literal restatements of their rules."""

import math
import random
from collections import Counter, deque

import numpy as np
import pytest

from edgeloom.config import Config
from edgeloom.operators import centroids, deltas, hashing, interleave, lsh, online, ordering, selection, shingles, sketches, snapshots
from edgeloom.operators.components import components
from edgeloom.plans import report
from edgeloom.sources import edges as sources

EDGES = "seq long, src_id long, src_type string, dst_id long, dst_type string, e_type string, gid int"
#: Four graphs of nodes a, b, p, q and r; edges of type t.
SAMPLE = "0\ta\t1\tb\tt\t0\n2\ta\t3\tb\tt\t1\n4\tp\t3\tb\tt\t1\n3\tb\t5\tq\tt\t1\n3\tb\t6\tr\tt\t1\n7\ta\t8\tb\tt\t2\n9\tp\t8\tb\tt\t2\n8\tb\t10\tq\tt\t2\n8\tb\t11\tr\tt\t2\n12\ta\t13\tb\tt\t3\n13\tb\t14\tp\tt\t3\n13\tb\t15\tq\tt\t3\n"
BAGS = {0: {" atb": 1}, 1: {" atb": 1, " ptb": 1, " btqtr": 1}, 2: {" atb": 1, " ptb": 1, " btqtr": 1}, 3: {" atb": 1, " btptq": 1}}


def stream(n, graphs=3, nodes=2, seed=1):
    rng = random.Random(seed)
    return [(i, rng.randrange(nodes), rng.choice("ab"), rng.randrange(5), rng.choice("xyz"), rng.choice("uvw"), rng.randrange(graphs)) for i in range(n)]


def chunks(text, c):
    return [text[i : i + c] for i in range(0, len(text), c)]


def bags(rows, c):
    text = {}
    for _, src, kind, _, to, e, gid in rows:
        text[gid, src, kind] = text.get((gid, src, kind), f" {kind}") + e + to
    out = {}
    for (gid, *_), s in text.items():
        out.setdefault(gid, Counter()).update(chunks(s, c))
    return out


def bag_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["gid"], {})[r["chunk"]] = r["cnt"]
    return out


@pytest.fixture
def sample(tmp_path):
    (tmp_path / "edges.tsv").write_text(SAMPLE)
    (tmp_path / "boot.txt").write_text("2\t0.6\n0.5\t0\n0.5\t1\n")
    return tmp_path


def test_sample_bags(spark, sample):
    rows = sources.read_edges(spark, str(sample / "edges.tsv"))
    assert [r["seq"] for r in rows.orderBy("seq").collect()] == list(range(12))
    assert bag_of(shingles.chunk_bag(rows, 10)) == BAGS
    members, clusters, threshold = sources.read_bootstrap(spark, str(sample / "boot.txt"))
    assert sorted(map(tuple, members.collect())) == [(0, 0), (1, 1)] and threshold == 0.6 and clusters.count() == 2


def test_sample_report(spark, sample):
    rows = sources.read_edges(spark, str(sample / "edges.tsv"))
    found = report.run(rows, *sources.read_bootstrap(spark, str(sample / "boot.txt")), Config(chunk_length=10, max_edges=10))
    assert found.edges == 7
    assert sorted(map(tuple, found.sizes.collect())) == [(2, 4), (3, 3)]
    # graph 2 has the bag of graph 1, so after the stream it sits on the centroid that it started as
    last = {r["gid"]: r for r in found.snapshots.collect()}
    assert last[2]["cluster_id"] == 1
    text = list(report.lines(found))
    assert "Iterations 1" in text and "2,4" in text
    report.write(found, str(sample / "out"))
    assert spark.read.parquet(str(sample / "out" / "snapshots")).count() == 4


def test_edges_round_trip(spark, sample):
    rows = sources.read_edges(spark, str(sample / "edges.tsv"))
    sources.write_edges(rows, str(sample / "copy"))
    back = "".join(p.read_text() for p in sorted((sample / "copy").glob("part-*")))
    assert back == SAMPLE


@pytest.mark.parametrize("c", [4, 5, 6, 7, 10, 50])
def test_chunk_bags(spark, c):
    rows = stream(400, seed=c) + [(400, 7, "a", 7, "a", "u", 9), (401, 7, "b", 7, "a", "u", 9), (402, 7, "a", 7, "a", "u", 9)]
    assert bag_of(shingles.chunk_bag(spark.createDataFrame(rows, EDGES), c)) == bags(rows, c)


def test_ranks_and_dense_order_over_blocks(spark):
    rows = [(3 * i, *r[1:]) for i, r in enumerate(stream(300))]
    df = spark.createDataFrame(rows, EDGES)
    dense = ordering.dense_seq(df, block=37)
    assert [r["seq"] for r in dense.orderBy("seq").collect()] == list(range(300))
    got = {(r["gid"], r["k"]): r["seq"] for r in ordering.rank_within(df, ["gid"], block=37).collect()}
    for gid in range(3):
        for k, seq in enumerate(r[0] for r in rows if r[6] == gid):
            assert got[gid, k] == seq


def test_signs_by_column_and_by_numpy(spark):
    config = Config(chunk_length=7, sketch_bits=100, bands=10, band_rows=10)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcxyz ") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    found = {(r["chunk"], r["i"]): r["sign"] for r in hashing.chunk_signs(spark.createDataFrame([(w,) for w in words], "chunk string"), config).collect()}
    ours = hashing.signs(words, 23, 100, 7)
    family = hashing.family_words(23, 100, 7)
    for row, w in enumerate(words):
        for i in range(100):
            total = (int(family[i, 0]) + sum(int(family[i, j + 1]) * ord(ch) for j, ch in enumerate(w))) % 2**64
            assert found[w, i] == ours[row, i] == (1 if total >> 63 else -1)


def literal_deltas(rows, c, most):
    """A queue of live edges and adjacency lists, edge by edge."""
    live, lists, out = deque(), {}, []
    for row in rows:
        seq, src, kind, _, to, e, gid = row
        if most and len(live) == most:
            old = live.popleft()
            node = lists[old[6], old[1], old[2]]
            node.remove((old[3], old[4], old[5]))
        live.append(row)
        node = lists.setdefault((gid, src, kind), [])
        node.append((row[3], to, e))
        s = f" {kind}" + "".join(x[2] + x[1] for x in node)
        ll = len(s) % c or c
        last, before = s[-ll:], s[-ll - c : -ll]
        going = None
        if len(node) > 1:
            going = before[:-1] if ll == 1 else None if ll == 2 else last[:-2]
        out.append((seq, gid, len(node), last, going))
    return out


@pytest.mark.parametrize(("c", "most"), [(4, 3), (6, 20), (5, 30), (7, 11), (10, None), (6, 1)])
def test_deltas_equal_a_queue(spark, c, most):
    rows = stream(350, seed=c)
    config = Config(chunk_length=c, max_edges=most)
    found = deltas.chunk_deltas(spark.createDataFrame(rows, EDGES), config).orderBy("seq").collect()
    assert [(r["seq"], r["gid"], r["n"], r["in_chunk"], r["out_chunk"]) for r in found] == literal_deltas(rows, c, most)


@pytest.mark.parametrize(("c", "mode"), [(6, "reference"), (5, "consistent"), (7, "consistent")])
def test_running_sums_end_in_the_batch_projection(spark, c, mode):
    config = Config(chunk_length=c, sketch_bits=32, bands=8, band_rows=4, odd_chunk_mode=mode)
    df = spark.createDataFrame(stream(200, seed=9), EDGES)
    batch = {(r["gid"], r["i"]): r["p"] for r in sketches.projections(shingles.chunk_bag(df, c), config).collect()}
    moved = deltas.chunk_deltas(df, config)
    final = {(r["gid"], r["i"]): r["p"] for r in deltas.final_projections(moved, config).collect()}
    assert final == batch
    last = {}
    for r in deltas.running_projections(moved, config).orderBy("seq").collect():
        last[r["gid"], r["i"]] = r["p"]
    assert last == batch


class Literal:
    """The clusters' rules, one graph, centroid and component at a time."""

    def __init__(self, bits, centers, sizes, thresholds, whole, members):
        self.bits, self.centers, self.sizes, self.thresholds, self.whole = bits, [list(c) for c in centers], list(sizes), thresholds, whole
        self.map, self.p = dict(members), {}

    def dist(self, gid, k):
        same = sum((x >= 0) == (y >= 0) for x, y in zip(self.p[gid], self.centers[k]))
        return 1 - math.cos(3.1415926535897 * (1 - same / self.bits))

    def leave(self, k, before):
        old = self.sizes[k]
        self.sizes[k] -= 1
        self.centers[k] = [(x * old - y) / (old - 1) for x, y in zip(self.centers[k], before)]

    def step(self, gid, delta):
        before = self.p.get(gid, [0] * self.bits)
        self.p[gid] = [x + y for x, y in zip(before, delta)]
        all_d = [self.dist(gid, k) for k in range(len(self.centers))]
        near = all_d.index(min(all_d))
        score, cur = all_d[near], self.map.get(gid, -2)
        if score > min(self.whole, self.thresholds[near]):
            self.map[gid] = -1
            if cur >= 0:
                self.leave(cur, before)
                if cur == near:
                    score = self.dist(gid, cur)
        elif cur != near:
            self.map[gid] = near
            if cur >= 0:
                self.leave(cur, before)
            old = self.sizes[near]
            self.sizes[near] += 1
            self.centers[near] = [(x * old + y) / (old + 1) for x, y in zip(self.centers[near], self.p[gid])]
            score = self.dist(gid, near)
        else:
            self.centers[near] = [x + y / self.sizes[near] for x, y in zip(self.centers[near], delta)]
            score = self.dist(gid, near)
        return self.map[gid], score


def online_case(spark, thresholds=(0.4, 0.7), seed=4):
    config = Config(chunk_length=6, sketch_bits=40, bands=10, band_rows=4, max_edges=60)
    rows = stream(700, graphs=9, seed=seed)
    df = spark.createDataFrame(rows, EDGES)
    members = spark.createDataFrame([(0, 0), (0, 1), (1, 2)], "cluster_id int, gid int")
    limits = spark.createDataFrame(list(enumerate(thresholds)), "cluster_id int, threshold double")
    test = ordering.dense_seq(selection.test_edges(df, members))
    bag = shingles.chunk_bag(selection.train_edges(df, members), 6)
    centers = centroids.centroids(sketches.projections(bag, config), members, 40)
    fold = online.start(config, members, centers, limits, 0.6)
    return config, test, fold, members


def test_online_fold_equals_its_rules(spark):
    config, test, fold, _ = online_case(spark)
    literal = Literal(40, fold.centers.tolist(), fold.sizes, [0.4, 0.7], 0.6, fold.cluster)
    moved = deltas.chunk_deltas(test, config)
    expected = []
    for r in moved.orderBy("seq").collect():
        delta = hashing.signs([r["in_chunk"]], 23, 40, 6)[0].astype(int)
        if r["out_chunk"] is not None:
            delta = delta - hashing.signs([r["out_chunk"]], 23, 40, 6)[0].astype(int)
        expected.append((r["seq"], r["gid"], *literal.step(r["gid"], delta.tolist())))
    found = online.online_clusters(moved, fold).orderBy("seq").collect()
    assert [tuple(r)[:3] for r in found] == [x[:3] for x in expected]
    assert np.allclose([r["score"] for r in found], [x[3] for x in expected], atol=1e-9)
    assert {x[2] for x in expected} >= {-1, 0}  # graphs leave clusters and join them


@pytest.mark.parametrize("m", [1, 99, 100, 101, 200, 205])
def test_snapshot_rule(spark, m):
    states = [(s, s % 3, s % 5 - 1, s / 7) for s in range(m)]
    df = spark.createDataFrame(states, "seq long, gid int, cluster_id int, score double")
    listed = spark.createDataFrame([(9, 0, 0.25)], "gid int, cluster_id int, score double")
    gids = spark.createDataFrame([(0,), (1,), (2,)], "gid int")
    found = {(r["interval"], r["gid"]): (r["cluster_id"], r["score"]) for r in snapshots.snapshots(df, listed, gids, 100).collect()}
    n = math.ceil(m / 100)
    expected = {}
    now = {0: (-2, -2.0), 1: (-2, -2.0), 2: (-2, -2.0), 9: (0, 0.25)}
    for seq, gid, k, s in states:
        now[gid] = (k, s)
        for i in range(n):
            if seq == (m - 1 if i == n - 1 else 100 * i):
                expected |= {(i, g): v for g, v in now.items()}
    assert found == expected


def test_interleaving_keeps_graph_order(spark):
    rows = stream(500, graphs=12, seed=6)
    df = spark.createDataFrame(rows, EDGES)
    out = interleave.interleave(df, 5, 23).orderBy("seq").collect()
    assert [r["seq"] for r in out] == list(range(500))
    for gid in range(12):
        assert [tuple(r)[1:6] for r in out if r["gid"] == gid] == [r[1:6] for r in rows if r[6] == gid]
    group = {r["gid"]: r["group"] for r in interleave.stream_groups(df.select("gid"), 5, 23).collect()}
    order = [group[r["gid"]] for r in out]
    assert order == sorted(order)
    assert [tuple(r) for r in out] == [tuple(r) for r in interleave.interleave(df, 5, 23).orderBy("seq").collect()]


def test_nearest_takes_the_lowest_id_of_a_tie(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (1, 0, 0.5), (1, 1, 0.7)], "gid int, cluster_id int, distance double")
    assert [tuple(r) for r in centroids.nearest(df).collect()] == [(1, 0, 0.5)]


def test_listed_graph_without_edges_counts_as_zero(spark):
    config = Config(chunk_length=6, sketch_bits=70, bands=7, band_rows=10)
    df = spark.createDataFrame(stream(50, graphs=1), EDGES)
    members = spark.createDataFrame([(0, 0), (0, 55)], "cluster_id int, gid int")
    projected = sketches.projections(shingles.chunk_bag(df, 6), config)
    half = {r["i"]: r["c"] for r in centroids.centroids(projected, members, 70).collect()}
    assert half == {r["i"]: r["p"] / 2 for r in projected.collect()}
    centers = centroids.centroid_words(centroids.centroids(projected, members, 70))
    scores = {r["gid"]: r["score"] for r in centroids.train_scores(sketches.sketch_words(projected), members, centers, 70).collect()}
    ones = sum(c >= 0 for c in half.values()) / 70
    assert scores[0] == pytest.approx(0.0, abs=1e-12)
    assert scores[55] == pytest.approx(1 - math.cos(math.pi * (1 - ones)), abs=1e-6)


def test_sketch_error_shrinks_with_bits(spark):
    from edgeloom.operators import similarity

    df = spark.createDataFrame(stream(400, graphs=6, nodes=30, seed=2), EDGES)
    errors = []
    for bits in (64, 1024):
        config = Config(chunk_length=6, sketch_bits=bits, bands=bits // 16, band_rows=16)
        bag = shingles.chunk_bag(df, 6)
        vocab = shingles.vocabulary(bag)
        vectors = shingles.shingle_vectors(bag, vocab)
        words = sketches.sketch_words(sketches.projections(bag, config))
        random_words = sketches.sketch_words(sketches.simhash_projections(vectors, vocab, config))
        rows = similarity.similarity_report(vectors, words, random_words, bits).collect()
        assert len(rows) == 36
        errors.append((np.mean([abs(r["error"]) for r in rows]), np.mean([abs(r["simhash"] - r["angular"]) for r in rows])))
    # random vectors are independent; hashes of chunks with common bytes are not quite
    assert errors[1][0] < 0.8 * errors[0][0] and errors[1][0] < 0.04
    assert errors[1][1] < 0.5 * errors[0][1]


def test_components_of_a_long_chain(spark):
    n = 300
    nodes = spark.createDataFrame([(i, 1000 - i) for i in range(n)] + [(n, 5)], "node long, label long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    found = {r["node"]: r["label"] for r in components(nodes, edges).collect()}
    assert found == {**{i: 1000 - (n - 1) for i in range(n)}, n: 5}


def test_isolation(spark):
    bits = spark.createDataFrame([(g, i, int(b)) for g, s in ((1, "11110000"), (2, "11111111"), (3, "01010101")) for i, b in enumerate(s)], "gid int, i int, bit int")
    banded = lsh.bands(bits, Config(chunk_length=6, sketch_bits=8, bands=2, band_rows=4))
    found = {r["gid"]: r["isolated"] for r in lsh.isolated(banded, banded.filter("gid <> 3")).collect()}
    assert found == {1: False, 2: False, 3: True}


@pytest.mark.parametrize("bad", [{"chunk_length": 3}, {"chunk_length": 6, "bands": 100}, {"chunk_length": 6, "dataset": "x"}, {"chunk_length": 6, "hops": 2}, {"chunk_length": 6, "odd_chunk_mode": "x"}])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        Config(**bad)


def test_bootstrap_is_checked(spark):
    clusters = spark.createDataFrame([(0, 0.5), (1, 0.5)], "cluster_id int, threshold double")
    make = lambda rows: spark.createDataFrame(rows, "cluster_id int, gid int")
    with pytest.raises(ValueError, match="no graph"):
        sources.checked_bootstrap(make([(0, 1)]), clusters)
    with pytest.raises(ValueError, match="two bootstrap"):
        sources.checked_bootstrap(make([(0, 1), (1, 1)]), clusters)
    assert sources.checked_bootstrap(make([(0, 1), (1, 1)]), clusters, allow_duplicates=True).count() == 2


def test_scenario_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(stream(20), EDGES).write.parquet(str(tmp_path / "e"))
    plan = selection.of_dataset(spark.read.parquet(str(tmp_path / "e")), Config(chunk_length=6, dataset="gfc"))._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(" in plan and "GreaterThanOrEqual(gid,100)" in plan
