"""The operators that compare rows with one another, and the pipeline, against brute force."""

import base64
import hashlib
import io
import random
import struct
import zipfile
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from edgeloom.llm import bpe, queries, secret_scan, simhash, templates, warc_zip
from edgeloom.operators import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write_docs(spark, folder, texts, start=0):
    rows = [(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(5).write.mode("append").parquet(f"{folder}/documents.parquet")
    return rows


# ---------------------------------------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, distance=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return [least[find(i)] for i in range(len(ids))]


def near_texts(n=260, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 200))] for _ in range(40)]
    out = []
    for _ in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append(rng.choice([" ", "  ", "\n"]).join(text))
    return out + [None, "", " \t", "one two", "ONE two", "one two three four", "É x", "é x", "x" * 20_000] + out[:5]


@pytest.mark.parametrize("hot", [1, 16])
def test_near_duplicates_equal_brute_force(spark, tmp_path, hot):
    rows = write_docs(spark, tmp_path, near_texts(), start=7)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({"fp": F.lit(1), "component_id": F.lit("x")})
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs, hot=hot).collect()}
    fps = [brute_fingerprint(t or "") for _, t, *_ in rows]
    assert [found[r[0]]["fp"] & (2**64 - 1) for r in rows] == fps
    assert [found[r[0]]["component_id"] for r in rows] == brute_components([r[0] for r in rows], fps)


def test_simhash_query_form(spark, tmp_path):
    rows = write_docs(spark, tmp_path, ["", "a b c d e", "a b c d e", None])
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op7_simhash(spark, str(tmp_path)).collect()}
    assert got[0] == got[3] == ("0" * 16, 0) and got[1] == got[2] == (f"{brute_fingerprint(rows[1][1]):016x}", 1)
    assert queries.op7_simhash(spark, str(tmp_path)).columns[:3] == ["doc_id", "fingerprint", "component_id"]


@pytest.mark.parametrize("seed", range(3))
def test_partition_covers_every_pair_within_the_distance(seed):
    rng = np.random.default_rng(seed)
    sample = rng.integers(0, 2**63, 300, dtype=np.uint64) & np.uint64(rng.integers(2**62, 2**63))
    for total in (10, 10**4, 10**7, 10**10):
        plan = simhash.plan_parts(sample, total)
        assert sum(t + 1 for _, t in plan) == 5 and len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)
        for _ in range(300):
            x = int(rng.integers(0, 2**63))
            y = x
            for b in rng.choice(64, 4, replace=False):
                y ^= 1 << int(b)
            assert any(bin((x ^ y) & sum(1 << b for b in g)).count("1") <= t for g, t in plan)


def test_thresholds_are_the_cheapest():
    rng = random.Random(1)
    from itertools import product

    for _ in range(30):
        costs = [[rng.random() for _ in range(5)] for _ in range(rng.randint(1, 4))]
        brute = min(sum(c[k] for c, k in zip(costs, ks)) for ks in product(range(5), repeat=len(costs)) if sum(ks) == 4)
        cost, chosen = simhash.allocate(costs, 3)
        assert cost == pytest.approx(brute) and sum(t + 1 for t in chosen) == 4


def dense_group(n):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 2**63))
    fps = {center}
    while len(fps) < n:  # within three bits of the center, or of another
        x = int(rng.choice(sorted(fps)[:300])) if rng.random() < 0.2 else center
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            x ^= 1 << int(b)
        fps.add(x & (2**63 - 1))
    return sorted(fps) + [0, 1, 2**62 - 1]


def test_a_large_dense_group(spark):
    counts = []
    for n in (750, 3000):
        fps = dense_group(n)
        df = spark.createDataFrame([(f,) for f in fps], "fp long")
        plan = simhash.plan_parts(np.array(fps, np.uint64), 10**7)
        edges = [tuple(r) for r in simhash.links(df, plan, len(fps)).collect()]
        counts.append(len(edges))
    assert counts[1] < 5 * counts[0]  # all pairs would be 16 times as many
    assert all(bin(a ^ b).count("1") <= 4 for a, b in edges)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    ids = list(range(len(fps)))
    u = np.array(fps, np.uint64)
    whole = list(ids)

    def top(x):
        while whole[x] != x:
            whole[x] = whole[whole[x]]
            x = whole[x]
        return x

    for i in ids:
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 4):
            whole[top(i)] = top(int(j))
    ours, theirs = {}, {}
    for i, f in enumerate(fps):
        ours.setdefault(find(f), set()).add(i)
        theirs.setdefault(top(i), set()).add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def family(n, p, seed=5):
    """Distinct fingerprints about a center, each bit flipped with probability p."""
    rng = np.random.default_rng(seed)
    center, found = np.uint64(rng.integers(0, 2**63)), np.zeros(0, np.uint64)
    while len(found) < n:
        flips = np.packbits(rng.random((n, 64)) < p, axis=1, bitorder="little").view(np.uint64).ravel()
        found = np.unique(np.concatenate([found, flips ^ center]))
    return rng.permutation(found)[:n]


def groups_of(fps, edges):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    return [find(i) for i in range(len(fps))]


def same_groups(ours, theirs):
    return len(set(ours)) == len(set(theirs)) == len(set(zip(ours, theirs, strict=True)))


@pytest.mark.parametrize("n,p,size,hubs", [(2500, 0.04, 200, 16), (2500, 0.07, 300, 4), (2500, 0.12, 100, 32), (900, 0.03, 50, 1)])
def test_crowds_around_hubs_equal_brute_force(spark, n, p, size, hubs):
    fps = np.concatenate([family(n, p), family(200, 0.05, seed=8), np.random.default_rng(2).integers(0, 2**63, 50, np.uint64)])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    found = simhash.links(df, simhash.plan_parts(fps, 10**7), len(fps), size=size, hubs=hubs).collect()
    brute = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)]
    assert same_groups(groups_of(fps, [(place[a], place[b]) for a, b in found]), groups_of(fps, brute))


def test_rows_of_crowds_follow_the_fingerprints(spark):
    """What is dealt to tasks for a family of near copies is bounded by its fingerprints: each has 46 values at most, and few visit other blocks."""
    for n in (2000, 10_000, 50_000):
        fps = family(n, 0.05)
        df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
        plan = simhash.plan_parts(fps[:2048], 10**7)
        values = sum(len(simhash._flips(bits, t)) for bits, t in plan)
        index = simhash._index(df, plan)
        crowded = index.groupBy("part", "key").count().filter("count > 16").select("part", "key")
        members = simhash._members(index, crowded, plan)
        stars, dealt = simhash._dealt(members, 4, simhash.BLOCK, simhash.HUBS)
        assert members.count() <= values * n and dealt.count() <= 1.5 * values * n and stars.count() <= 2 * values * n


def sends_exploded_rows(df):
    """Whether a join of the plan sends rows that an explode makes to every task. What a join has made of them first is estimated by the product of its sides."""
    above = []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        above = [x for x in above if x[0] < depth] + [(depth, line)]
        nearest = [x for _, x in above if "BroadcastExchange" in x or "Join" in x][-1:]
        if "Generate " in line and nearest and "BroadcastExchange" in nearest[0]:
            return True
    return False


def test_exploded_rows_do_not_pass_the_driver(spark, monkeypatch):
    """The probes of a small table are many; neither they nor the many values around crowds are sent to every task, whatever Spark takes their size for."""
    fps = np.random.default_rng(4).integers(0, 2**63, 3000, np.uint64)
    df = simhash.stored(spark.createDataFrame([(int(x),) for x in fps], "fp long"))
    plan = simhash.plan_parts(fps[:2048], 10**7)
    assert not sends_exploded_rows(simhash.links(df, plan, len(fps)))
    near = family(400, 0.05)
    index = simhash.stored(simhash._index(spark.createDataFrame([(int(x),) for x in near.view(np.int64)], "fp long"), plan))
    crowded = simhash.stored(index.groupBy("part", "key").count().filter("count > 4").select("part", "key"))
    few = simhash._members(index, crowded, plan)
    monkeypatch.setattr(simhash, "SENT", 10)
    many = simhash._members(index, crowded, plan)
    assert sends_exploded_rows(few) and not sends_exploded_rows(many)
    assert few.count() > 0 and sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_op7_sends_no_exploded_rows(spark, tmp_path, monkeypatch):
    """Over the whole operator of op7, with crowds: no table that it stores on its way is made with exploded rows sent to every task."""
    rows = write_docs(spark, tmp_path, near_texts())
    sent, store = [], simhash.stored

    def watched(df):
        sent.append(sends_exploded_rows(df))
        return store(df)

    monkeypatch.setattr(simhash, "stored", watched)
    monkeypatch.setattr(simhash, "SENT", 0, raising=False)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, hot=1).collect()}
    assert len(sent) > 5 and not any(sent)
    assert [got[r[0]] for r in rows] == brute_components([r[0] for r in rows], [brute_fingerprint(t or "") for _, t, *_ in rows])


def test_op7_sends_no_table_that_grows(spark, tmp_path, monkeypatch):
    """A stored table is small beside what its rows take in the driver's memory, so more than SENT rows are never sent to every task, whatever their bytes."""
    rows = write_docs(spark, tmp_path, near_texts())
    sent, store = [], simhash.stored

    def watched(df):
        sent.append("Broadcast" in df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    for module in (simhash, components):
        monkeypatch.setattr(module, "stored", watched)
    monkeypatch.setattr(simhash, "SENT", 0)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = simhash.near_duplicates(docs, hot=1)
    sent.append("Broadcast" in found._jdf.queryExecution().executedPlan().toString())
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert [got[r[0]] for r in rows] == brute_components([r[0] for r in rows], [brute_fingerprint(t or "") for _, t, *_ in rows])
    fps = family(200, 0.05)
    df = simhash.stored(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"))
    around = simhash.links(df, simhash.plan_parts(fps, 10**7), len(fps), hot=1, size=16, hubs=2)
    sent.append("Broadcast" in around._jdf.queryExecution().executedPlan().toString())
    assert len(sent) > 15 and not any(sent)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, "other words stand here now"), (3, "a b c d e f")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == [("3", "3"), ("5", "3"), ("None", "3"), ("None", "None")]
    assert 3 in {r["doc_id"] for r in simhash.keep_one(docs).collect()} and 5 not in {r["doc_id"] for r in simhash.keep_one(docs).collect()}


def test_one_row_of_a_group_stays_whatever_its_ids(spark):
    a, near, b = "one two three four five six seven", "ONE two three four  five six seven", "quite other words stand in this one here"
    rows = [(None, a, "x"), (4, a, "y"), (4, a, "z"), (4, b, "p"), (9, near, "q"), (None, b, "r"), (None, "alone among the rows without an id", "s"), (None, None, "t"), (7, "", "u"), (7, None, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    groups = [{"x", "y", "z", "q"}, {"p", "r"}, {"s"}, {"t", "u", "v"}]
    assert simhash.keep_one(docs).columns == docs.columns and sorted(len(g & {r[2] for r in kept}) for g in groups) == [1, 1, 1, 1] and len(kept) == 4
    assert {(r[0], r[1]) for r in kept} >= {(4, a), (4, b), (None, "alone among the rows without an id")}


def test_ids_to_be_taken_out_by_a_shuffle(spark, monkeypatch):
    from edgeloom.llm import common

    docs = spark.createDataFrame([(i if i else None, f"words of text {i} and some more", "s") for i in range(40)], "doc_id long, text string, _id string")
    out = spark.createDataFrame([(None,), (3,), (17,)], "_id long")
    left = []
    for bound in (10, 0):
        monkeypatch.setattr(common, "BROADCAST_IDS", bound)
        left.append(sorted(r["doc_id"] for r in common.without_keys(docs, out, {"_id": docs["doc_id"]}).collect()))
    assert left[0] == left[1] == [i for i in range(1, 40) if i not in (3, 17)]


# ---------------------------------------------------------------------------------------------- WARC


def pages_of(spark, folder):
    htmls = ["<p>a</p>", "<p>a</p>", None, "", "é" * 50, "x" * 100_000, "<p>a</p>", "é" * 50, "unique \r\n\r\n body"]
    rows = [(100 - i, f"http://e.org/{i} ä\n" if i != 3 else None, h) for i, h in enumerate(htmls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(f"{folder}/pages.parquet")
    return rows


def test_warc_equals_sql(spark, tmp_path):
    rows = pages_of(spark, tmp_path)
    found = {r["page_id"]: tuple(r)[1:] for r in queries.op4_warc(spark, str(tmp_path)).collect()}
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = {r[0]: r[1:] for r in con.execute(queries.ORACLES["op4_warc"]).fetchall()}
    assert {p: x[1] for p, x in expected.items()} == {p: base64.b32encode(hashlib.sha1(t).digest()).decode() for p, t in texts.items()}
    assert found == expected


def test_warc_payloads_round_trip_and_bounds(spark, tmp_path):
    rows = pages_of(spark, tmp_path)
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet").withColumns({"first": F.lit(1), "sha1": F.lit("x")})
    archives = warc_zip.write(pages, archive=64)
    assert archives.count() == len(rows) == archives.agg(F.sum("records")).first()[0]
    back = {r["page_id"]: r for r in warc_zip.read(archives, with_payload=True).collect()}
    for page_id, url, html in rows:
        r = back[page_id]
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == (html or "").encode()
        assert r["target_uri"] == (None if url is None else url.replace(" ", "%20").replace("ä", "%C3%A4").replace("\n", "%0A"))
    large = {r["page_id"]: r["record_type"] for r in warc_zip.read(warc_zip.write(pages, smallest=50)).collect()}
    assert large[98] == large[97] == large[99] == "response" and sorted(large[p] for p in (96, 93)) == ["response", "revisit"]
    assert warc_zip.read(warc_zip.write(pages.limit(0))).count() == 0


@pytest.mark.parametrize("broadcast", [0, 10])
def test_warc_with_a_hot_payload(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc_zip, "BROADCAST", broadcast)
    huge = "x" * 9_000_000
    rows = [(i, "http://e.org/", "<p>hot</p>" if i % 3 else f"own {i}") for i in range(300)] + [(500, "http://e.org/", huge), (501, "http://e.org/", huge)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: r for r in queries.op4_warc(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows) and found[501]["refers_to"] == 500 and found[500]["payload_bytes"] == len(huge)
    assert all((found[i]["record_type"], found[i]["refers_to"]) == (("revisit", 1) if i % 3 and i > 1 else ("response", None)) for i in range(300))


def test_zip64_directories_and_comments(tmp_path):
    body = b"stored bytes " * 50
    offset, name = 0, b"archive/data.warc.gz"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), offset)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, len(local) + len(entry), 1)
    comment = b"a comment with PK\x05\x06 in it"
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment
    path = tmp_path / "a b.zip"
    path.write_bytes(local + entry + end64 + locator + end)
    for uri in (str(path), path.as_uri()):
        with warc_zip.opened(uri) as (read, size):
            members = warc_zip.directory(read, size)
            start, length = warc_zip.stored_member(read, members[name.decode()])
            assert read(start, length) == body and length == len(body)


def test_plain_zip_directory_equals_zipfile(tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/é.txt", b"one")
        z.writestr(zipfile.ZipInfo("b"), b"")
        z.writestr("deflated", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"hello"
    path = tmp_path / "x.zip"
    path.write_bytes(out.getvalue())
    with warc_zip.opened(str(path)) as (read, size):
        ours = warc_zip.directory(read, size)
        assert {i.filename: (i.compress_type, i.header_offset, i.compress_size, i.file_size) for i in zipfile.ZipFile(path).infolist()} == ours
        with pytest.raises(ValueError, match="ranges"):
            warc_zip.stored_member(read, ours["deflated"])
    (tmp_path / "no.zip").write_bytes(b"nothing")
    with warc_zip.opened(str(tmp_path / "no.zip")) as (read, size), pytest.raises(ValueError, match="not a ZIP"):
        warc_zip.directory(read, size)


def test_a_changed_payload_is_found():
    data = b"<p>x</p>"
    good = warc_zip.record(1, None, data, warc_zip.base32_sha1(data), None)
    assert warc_zip.payload_of(*warc_zip.parse(good))[2] == data
    with pytest.raises(ValueError, match="isn't the one"):
        warc_zip.payload_of(*warc_zip.parse(warc_zip.record(1, None, data, warc_zip.base32_sha1(b"y"), None)))


# ---------------------------------------------------------------------------------------------- decontamination

ITEM = "A farmer named Alice has 12 apples and gives 5 apples to Bob every day before lunch starts at noon. How many apples does Alice have left after 3 days?"


def bench(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def leaks(spark, docs, items, **more):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumns({"hash": F.lit(1), "pos": F.lit(2), "item_id": F.lit(3)})
    return {(r["doc_id"], r["item_id"]): r for r in templates.contaminated(df, bench(spark, items), **more).collect()}


def test_leaks_as_they_are_and_reparameterised(spark):
    other = ITEM.replace("Alice", "Carol").replace("12", "340").replace("Bob", "Dave").replace("5 apples", "77 apples")
    mixed = ITEM.replace("named Alice", "named Carol").replace("does Alice", "does Erin")
    docs = [f"Text before. {ITEM} Text after.", f"say {ITEM.lower()} ok", other, "An unrelated text about farmers and apples that has no passage of it at all, only words.", None, "", ITEM.split(" before")[0]]
    found = leaks(spark, docs, [ITEM, "tiny item", None, ""])
    assert set(found) == {(0, 0), (1, 0), (2, 0), (6, 0)}
    assert found[0, 0]["exact"] and found[0, 0]["coverage"] == 1.0 and not found[2, 0]["exact"]
    slots = leaks(spark, [mixed], [ITEM])
    assert (0, 0) not in slots or slots[0, 0]["matched_words"] < 29


def test_inconsistent_slots_do_not_match(spark):
    item = "so then Alice saw 4 boats while walking home and later Alice saw 9 trains while riding south again"
    same = item.replace("Alice", "Carol")
    broken = item.replace("Alice", "Carol", 1).replace("Alice", "Erin")
    found = leaks(spark, [same, broken], [item], enough=100, covered=0.9)
    assert set(found) == {(0, 0)}


def brute_exact(docs, items, n=13):
    clean = lambda t: [w for w in (templates.classify(x)[0] for x in (t or "").split()) if w]
    out = set()
    for d, t in enumerate(docs):
        words = clean(t)
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        for k, item in enumerate(items):
            w = clean(item)
            if any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1)):
                out.add((d, k))
    return out


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_exact_leaks_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(templates, "BROADCAST", broadcast)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5)))
    items = [" ".join(word() for _ in range(rng.randint(40, 60))) for _ in range(12)]
    docs = []
    for i in range(80):
        text = [word() for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            w = rng.choice(items).split()
            a = rng.randrange(0, 20)
            text[len(text) // 2 : len(text) // 2] = w[a : a + rng.choice([6, 7, 13, 20, 40])]
        docs.append(rng.choice([" ", "\n", " , "]).join(text))
    assert set(leaks(spark, docs, items)) == brute_exact(docs, items)


def test_decontamination_of_the_test_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    found = {(r["doc_id"], r["item_id"]) for r in queries.op5_decontamination(spark, data).collect()}
    brute = brute_exact([r["text"] for r in docs], [r["text"] for r in items])
    assert found == {(docs[d]["doc_id"], items[k]["item_id"]) for d, k in brute}


def test_decontamination_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert templates.contaminated(empty, bench(spark, [ITEM])).count() == 0
    assert leaks(spark, ["a b c"], []) == {}
    docs = spark.createDataFrame([(1, ITEM, "x"), (1, "fine words", "y"), (2, "fine words", "z"), (3, None, "n")], "doc_id long, text string, source string")
    kept = templates.keep_clean(docs, bench(spark, [ITEM]))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_renamed_people_at_sentence_starts(spark):
    item = "Nina brought the old red bicycle to the market in the morning. Tom paid for the bicycle with a bag of silver coins. Nina went home along the river before it was dark."
    doc = item.replace("Nina", "Paula").replace("Tom", "Erik")
    found = leaks(spark, [f"some words before. {doc} and after", "Paris is the capital of France"], [item, "What is the capital of Spain?"])
    assert found.keys() == {(0, 0)} and found[0, 0]["matched_words"] == found[0, 0]["item_words"] and not found[0, 0]["exact"]


def test_questions_rich_in_numbers_and_names(spark):
    items = ["A train goes 60 miles in 2 hours, then 45 miles in 3 hours, then 30 miles in 1 hours. What is its speed?", "Tom has 5 red marbles. Anna gives Tom 7 more marbles. Tom loses 2 marbles. How many marbles does Tom have now?", "Der Bauer kauft am Montag 12 Kisten Birnen und 4 Kisten Trauben vom Markt in Ulm und gibt dem Nachbarn 3 Birnen."]
    docs = [items[0].translate(str.maketrans("645321", "879467")), items[1].replace("Tom", "Ben").replace("Anna", "Lucy").translate(str.maketrans("572", "864")), items[2].replace("Bauer", "Maler").replace("Birnen", "Nüsse").replace("12", "31"), items[1].replace("Tom", "Ben", 1).replace("Tom", "Lea", 1).replace("marbles", "coins"), "Anna Berg und Tom Hill 5 6 7 8 Ulm Bonn in Rom Wien 9"]
    found = leaks(spark, docs, items)
    assert found.keys() == {(0, 0), (1, 1), (2, 2)} and all(r["coverage"] == 1.0 and not r["exact"] for r in found.values())


def test_a_leak_without_id_leaves_other_rows_without_id(spark):
    half = ITEM.split()
    docs = [(None, ITEM), (None, "fine words"), (None, None), (None, ""), (None, " ".join(half[:10])), (None, " ".join(["x"] * 10 + half[10:20])), (7, ITEM), (8, "fine words")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    kept = templates.keep_clean(docs, bench(spark, [ITEM]))
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["text"] != ITEM)
    assert sorted(str(r["doc_id"]) for r in templates.contaminated(docs, bench(spark, [ITEM])).collect()) == ["7", "None"]


def reparameterised(rng):
    """An item of some sentences whose numbers, names (of one word and of two) and units are parameters, and the same with others."""
    plain = "bought carried wanted found painted baskets ladders ribbons candles from near behind along quiet garden harbour market before after supper winter again because nobody could count them all slowly".split()
    names, places = ["Anna", "Bruno", "Clara", "Dario", "Edith", "Frank", "Greta", "Hugo"], ["New Haven", "Green Hill", "North Bay", "Old Town", "Black Rock"]
    units = [("km", "miles"), ("kg", "pounds"), ("hours", "days"), ("liters", "gallons")]
    who, to, at, unit = rng.sample(names, 4), rng.sample(places, 4), [rng.randrange(2, 990) for _ in range(6)], rng.choice(units)
    words = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    form = f"{{a}} {words(4)} {{n0}} {{u}} {words(5)} in {{p}} and {words(3)} {{n1}} {words(4)}. Then {{b}} {words(3)} {{n2}} {{u}} {words(6)} until {{a}} {words(4)}. How many {words(2)} does {{b}} have?"
    fill = lambda k: form.format(a=who[k], b=who[k + 2], p=to[k], u=unit[k], n0=at[3 * k], n1=at[3 * k + 1], n2=at[3 * k + 2])
    return fill(0), fill(1)


def test_recall_of_reparameterised_items(spark):
    rng = random.Random(21)
    pairs = [reparameterised(rng) for _ in range(150)]
    fill = "some other words stand around the question in this text and they are of no use to anyone who reads it. "
    docs = [f"{fill * rng.randrange(3)}{changed} {fill}" for _, changed in pairs] + [reparameterised(rng)[0] for _ in range(150)]
    found = set(leaks(spark, docs, [item for item, _ in pairs]))
    right = {(i, i) for i in range(len(pairs))}
    assert len(found & right) >= 0.9 * len(right) and not found - right


def test_words_of_letters_and_a_mark_are_as_by_the_patterns(monkeypatch):
    words = ["Tom", "tom.", "TOM", "ten", "Ten,", "km", "hours!", "x", "É", "Éa:", "ß?", "a1", "12km", "3", "...", ".", "", "o'clock,", "tom.)", "don't", "Zwölf;", "ªb", "²", "McDonald", "$5", "-"]
    quick = [templates.classify(w) for w in words]
    monkeypatch.setattr(templates, "_MARKS", frozenset())
    assert [templates.classify(w) for w in words] == quick


def test_short_items_are_compared_whole(spark):
    docs = ["Yes, no!", "yes no and more", "say yes no", "One two three four", "one two three 5", "", "..."]
    assert set(leaks(spark, docs, ["yes no", "one two three four", "...", "tiny"])) == {(0, 0), (3, 1)}


def test_very_long_and_repeated_documents(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(120_000))
    docs = spark.createDataFrame([(1, f"{text} {ITEM} {text[:1000]}"), (2, text), (3, ITEM), (3, ITEM)], "doc_id long, text string")
    found = templates.contaminated(docs, bench(spark, [ITEM, ITEM])).collect()
    assert sorted((r["doc_id"], r["item_id"], r["matched_words"]) for r in found) == [(d, i, found[0]["item_words"]) for d in (1, 3) for i in (0, 1)]


def test_the_filter_passes_all_that_meet(spark):
    rng = random.Random(5)
    items = [" ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(50)) for _ in range(30)) for _ in range(400)]
    windows = templates.benchmark_windows(bench(spark, items))
    own = bench(spark, items).withColumnRenamed("item_id", "doc_id")
    passed = templates.document_windows(own, windows)
    assert {r["hash"] for r in windows.collect()} <= {r["hash"] for r in passed.collect()}
    other = spark.createDataFrame([(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(400))) for i in range(50)], "doc_id long, text string")
    assert templates.document_windows(other, windows).count() < 0.05 * 50 * 393


# ---------------------------------------------------------------------------------------------- pipeline


def test_pipeline_equals_brute_force(spark, tmp_path, data):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from edgeloom.llm.common import tokenizer_path

    source = spark.read.parquet(f"{data}/documents.parquet")
    base = source.collect()
    extra = [(100_000, None, None, "s", 0), (100_001, "12345 ...", "en", "s", 9), (100_002, base[3]["text"], "fr", "s", 1), (100_003, f"the and of to {base[1]['text']} password=abcdef99", "en", "s", 1)]
    source.unionByName(spark.createDataFrame(extra, DOCS)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in base] + [(e[0], e[1]) for e in extra]
    rows = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    fps = [brute_fingerprint(t) for _, t in rows]
    rows = [r for r, c in zip(rows, brute_components([i for i, _ in rows], fps), strict=True) if r[0] == c]
    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    dirty = {d for d, _ in brute_exact([t for _, t in rows], items)}
    rows = [r for k, r in enumerate(rows) if k not in dirty]
    tokenizer = Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))
    expected = {i: tokenizer.encode(secret_scan._replaced(t, secret_scan.findings(t), "<secret>"), add_special_tokens=False).ids for i, t in rows}
    found = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == expected
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_id" and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline_edges(spark, tmp_path):
    """No rows at all; and very long, repeated and null rows beside a column whose name the operators use."""
    import corpus_pipeline

    import hashlib

    rng = random.Random(4)
    words = {"en": "the river and morning was over this bridge with three windows".split(), "de": "der Fluss und Morgen war über diese Brücke mit drei Fenstern".split()}
    prose = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, prose(lang, 30), lang, "s", 0, "k") for i, lang in enumerate(["en", "de"] * 30)]
    long, twice = prose("en", 150_000), prose("de", 40)
    rows += [(100, long, "en", "s", 0, "k"), (101, twice, "de", "s", 0, "k"), (101, twice, "de", "s", 0, "k"), (102, None, None, "s", 0, "k"), (None, prose("en", 50), None, "s", 0, "k")]
    docs = spark.createDataFrame(rows, DOCS + ", hash string")
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for folder in ("full", "empty"):
        bench(spark, [ITEM]).write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    found = [(r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, f"{tmp_path}/full").collect()]
    ids = [i for i, _ in found]
    assert ids.count(100) == ids.count(101) == ids.count(None) == 1 and 102 not in ids
    assert dict(found)[100] == hashlib.sha256(long.encode()).hexdigest()


def test_entry_lists_every_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {"pipeline"} <= set(names) and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert Path(__spark_entry__.__file__).name == "__spark_entry__.py"
