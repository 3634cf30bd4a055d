"""SimHash near-duplicates by a generalised pigeonhole.

Two 64-bit fingerprints that differ in at most t bits must, for any partition of the bits into m parts with thresholds
t_1..t_m where sum(t_i + 1) = t + 1, differ in at most t_i bits of some part i (a threshold of -1 leaves the part out).
Correlated bits are put in one part, so that each part's values spread as widely as they can; a dynamic programme gives
each part its threshold from the candidates estimated from a bounded sample. Each fingerprint is indexed once per part
and probes every value within t_i bits; what shares a value is verified on all 64 bits.

Distinct fingerprints alone are joined, so exact copies cost nothing. A value shared by more fingerprints than chance would give (HOT of them, or
CROWD times what uniform bits have) is a crowd: it emits a spanning forest of its links (at most one row a member and block), never all
pairs, and a large one is reduced by hubs first (see `links`). Components come from label propagation with pointer jumping over tables stored in the shared folder.

Results: a null or empty text (or one of white space) has fingerprint zero and is linked like any other; an empty table gives
an empty result; repeated rows are kept, each with its fingerprint; very long texts are hashed whole, some thousand shingles at a time; ties of labels cannot occur
(labels are ids); null ids take part as copies but never name a component that has another id. `keep_one` leaves one row of a group, whatever ids its rows have.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import id_and_text, map_batches, stored, without_keys
from edgeloom.operators.components import components
from edgeloom.shipping import ship
from edgeloom.storage import SENT, unsent

BITS, SEED, SHINGLE, DISTANCE = 64, 42, 4, 4
#: Fingerprints drawn to estimate how bits correlate and how many candidates a part yields. It bounds what the driver sees; results do not depend on it.
SAMPLE = 2048
#: A part value shared by more fingerprints than HOT, and than CROWD times what uniform bits would give, is a crowd; one of more than BLOCK members is worked off
#: in blocks of about so many, around HUBS of them.
HOT, CROWD, BLOCK, HUBS = 16, 4, 8192, 32
#: What a probe row costs, in verified candidates.
PROBE_COST = 4.0
#: Distinct fingerprints that the partition is planned for at least: small inputs get the plan of large ones, so work grows in proportion.
PLANNED_FOR = 10_000_000
#: Fingerprints this near are of one family of copies; of uniform ones, a pair in 500 is.
FAMILY = 20

_XX = xxhash.xxh64_intdigest


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Words are what ASCII white space parts; A-Z is lower-cased. bytes.split and bytes.lower know ASCII only, as is wanted here."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return _XX(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([_XX(joined[a:z], SEED) for a, z in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, digest (of the text, to tell texts of one id apart), fp (the 64 bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t or "", shingle) for t in batch.column(2).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "digest", "fp"])

    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("digest"), "text")
    return map_batches(rows, run, "doc_id long, digest long, fp long")


# ---------------------------------------------------------------------------------------------- the partition


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to parts of near-equal width, each next to the bits it correlates with most."""
    if len(sample) < 2:
        order = list(range(BITS))
        return [order[i * BITS // parts : (i + 1) * BITS // parts] for i in range(parts)]
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    norm[norm == 0] = 1
    corr = np.abs((bits / norm).T @ (bits / norm))
    left, out = set(range(BITS)), []
    for i in range(parts):
        width = (i + 1) * BITS // parts - i * BITS // parts
        rest = sorted(left)
        start = rest[int(np.argmax(corr[np.ix_(rest, rest)].sum(axis=1)))]
        part = [start]
        left.discard(start)
        while len(part) < width:
            rest = sorted(left)
            part.append(best := rest[int(np.argmax(corr[np.ix_(rest, part)].sum(axis=1)))])
            left.discard(best)
        out.append(sorted(part))
    return out


def estimates(sample: np.ndarray, part: list[int], most: int, total: int) -> list[float]:
    """Cost per fingerprint of a part at the thresholds -1 to `most`: its probes, and its candidates among `total` fingerprints as the pairs of the
    sample have them. Pairs of one family of copies (FAMILY bits or fewer apart) do not count: they meet in any partition, and are worked off in blocks."""
    mask = np.uint64(sum(1 << b for b in part))
    own, near = sample & mask, np.zeros(BITS + 1, np.int64)
    for at in range(0, len(own), 512):
        apart = np.bitwise_count(sample[at : at + 512, None] ^ sample[None, :]) > FAMILY
        near += np.bincount(np.bitwise_count(own[at : at + 512, None] ^ own[None, :])[apart], minlength=BITS + 1)
    out = [0.0]
    for t in range(most + 1):
        probes = sum(math.comb(len(part), k) for k in range(t + 1))
        chance = max(probes / 2.0 ** len(part), near[: t + 1].sum() / max(1.0, len(own) * (len(own) - 1.0)))
        out.append(PROBE_COST * probes + chance * total)
    return out


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """costs[i][t + 1]: cost of part i at threshold t >= -1. The thresholds with sum(t + 1) = distance + 1 of least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t1, more in enumerate(part):
                if used + t1 <= distance + 1 and (used + t1 not in then or cost + more < then[used + t1][0]):
                    then[used + t1] = (cost + more, [*chosen, t1 - 1])
        best = then
    return best[distance + 1]


def plan_parts(sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed; the number of parts is the cheapest of 2 to distance + 1."""
    found = []
    for parts in range(min(2, distance + 1), distance + 2):
        groups = group_bits(sample, parts)
        costs = [estimates(sample, g, min(distance, 3), total) for g in groups]
        cost, chosen = allocate(costs, distance)
        found.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# ---------------------------------------------------------------------------------------------- links


def _flips(bits: list[int], t: int) -> list[int]:
    """The masks of at most t of the bits, none first."""
    return [0] + [_signed(sum(1 << b for b in c)) for k in range(1, t + 1) for c in combinations(bits, k)]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in values])


def _index(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """b, part, key: each fingerprint under its own value of every part."""
    rows = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits)))).alias("key")) for i, (bits, _) in enumerate(plan)]
    return fps.select(F.col("fp").alias("b"), F.explode(F.array(*rows)).alias("k")).select("b", "k.part", "k.key")


def _probes(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """a, part, key: each fingerprint under all values within the threshold of every part."""

    def under(part: int, own: Column):
        return lambda flip: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(flip).alias("key"))

    # the flips of a part are one literal array, so the plan stays small whatever the threshold
    rows = [F.transform(_longs(_flips(bits, t)), under(i, F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits)))))) for i, (bits, t) in enumerate(plan)]
    return fps.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*rows))).alias("k")).select("a", "k.part", "k.key")


def links(fps: DataFrame, plan: list[tuple[list[int], int]], total: int, distance: int = DISTANCE, hot: int = HOT, size: int = BLOCK, hubs: int = HUBS) -> DataFrame:
    """a, b: links between the `total` distinct fingerprints, enough to connect whatever is linked.

    Values that few share give all their links by a join of the probes with the index. Of a value that many share (of its fingerprints, and those
    that probe it), up to `size` are worked off together into a spanning forest. Where there are more, `hubs` of them are drawn first: whoever is within the distance of a
    hub is linked to it, and those whose hubs are linked need not be compared among themselves. They stand in one block each; only the rest, which no such hub
    reaches, visit every block. So the rows that are shuffled follow the fingerprints, not their pairs.
    """
    spark = fps.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fps = fps.repartition(width)  # a small table's few files would be exploded in as few tasks
    index = stored(_index(fps, plan))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    most = F.element_at(_longs([max(hot, CROWD * total // 2 ** len(bits)) for bits, _ in plan]), F.col("part") + 1)
    crowded = stored(index.groupBy("part", "key").count().filter(F.col("count") > most).select("part", "key"))
    crowds = _by_part(crowded)
    # probes of a crowded value meet nothing here, as its own fingerprints are left out
    cold_index = index.join(_sent(crowded, sum(crowds.values())), ["part", "key"], "left_anti")
    cold = _probes(fps, plan).hint("merge").join(cold_index, ["part", "key"]).filter((F.col("a") != F.col("b")) & near).select("a", "b")
    if not crowds:
        return cold.distinct()
    stars, dealt = _dealt(_members(index, crowded, plan, crowds), distance, size, hubs, sum(crowds.values()))
    ship(spark)
    warm = dealt.repartition("part", "key", "block", "visit").sortWithinPartitions("part", "key", "block", "visit").mapInArrow(_forests(distance), "a long, b long")
    return cold.unionByName(stars).unionByName(warm).distinct()


def _dealt(members: DataFrame, distance: int, size: int, hubs: int, n: int = 0) -> tuple[DataFrame, DataFrame]:
    """Links to hubs; and the rows that are worked off, by group: part, key, block, visit, fp, whether it is compared (visits) with those that stay, and known.
    n: how many crowds there are."""
    sizes = members.groupBy("part", "key").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("own_n"))
    crowds = stored(members.join(unsent(sizes, n, SENT), ["part", "key"]))
    small = crowds.filter(F.col("n") <= size).select("part", "key", F.lit(0).alias("block"), F.lit(0).alias("visit"), "fp", F.col("own").alias("visits"), F.lit(True).alias("stays"), F.lit(False).alias("known"))
    large = crowds.filter(F.col("n") > size)
    n_large = large.select("part", "key").distinct().count()
    if not n_large:
        return small.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0), small
    stars, marked = _around_hubs(large, distance, hubs, n_large)
    return stars, small.unionByName(_blocks(marked, size, n_large))


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of one side of a join: sent to every task if they are few, else dealt out with the other side. Spark's own estimate of a table that is
    exploded takes no account of how many rows that makes, so the probes of a small table would be sent through the driver."""
    return F.broadcast(rows) if n <= SENT else rows.hint("merge")


def _by_part(crowded: DataFrame) -> dict[int, int]:
    return {r["part"]: r["count"] for r in crowded.groupBy("part").count().collect()}


def _members(index: DataFrame, crowded: DataFrame, plan: list[tuple[list[int], int]], crowds: dict[int, int] | None = None) -> DataFrame:
    """part, key, fp, own: the fingerprints that have a crowded value (own), and those within the part's threshold of it. crowds: how many such values each part has."""
    crowds = _by_part(crowded) if crowds is None else crowds
    around, n = None, 0
    for i, (bits, t) in enumerate(plan):
        flips = _flips(bits, t)
        n += crowds.get(i, 0) * len(flips)
        one = F.when(F.col("part") == i, _longs(flips))
        around = one if around is None else F.coalesce(around, one)
    values = crowded.select("part", "key", F.explode(around).alias("flip")).select("part", F.col("key").alias("crowd"), F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    return index.join(_sent(values, n), ["part", "key"]).select("part", F.col("crowd").alias("key"), F.col("b").alias("fp"), (F.col("key") == F.col("crowd")).alias("own"))


def _around_hubs(large: DataFrame, distance: int, hubs: int, n: int = 0) -> tuple[DataFrame, DataFrame]:
    """Of n crowds: the links of the members of large crowds to their hubs; and the members with whether the hubs of the largest group that hubs link reach them (known)."""
    drawn = F.pmod(F.xxhash64("fp", "part"), F.col("own_n")) < hubs
    chosen = large.filter(F.col("own") & drawn).groupBy("part", "key").agg(F.slice(F.array_sort(F.collect_set("fp")), 1, 62).alias("hubs"))
    met = large.join(unsent(chosen, n * hubs, SENT), ["part", "key"], "left")
    reach = F.aggregate(
        F.sequence(F.lit(1), F.size("hubs")), F.lit(0).cast("long"), lambda mask, i: mask.bitwiseOR(F.when(F.bit_count(F.element_at("hubs", i).bitwiseXOR(F.col("fp"))) <= distance, F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)).otherwise(F.lit(0).cast("long")))
    )
    met = stored(met.withColumn("mask", F.when(F.col("hubs").isNull() | (F.size("hubs") == 0), F.lit(0).cast("long")).otherwise(reach)))
    first = F.filter(F.sequence(F.lit(1), F.size("hubs")), lambda i: F.call_function("shiftright", F.col("mask"), i - 1).bitwiseAND(F.lit(1)) == 1)[0]
    reached = met.filter("mask <> 0").withColumn("first", first)
    stars = reached.select(F.col("fp").alias("a"), F.element_at("hubs", F.col("first")).alias("b")).filter("a <> b")
    # what the members of a hub have in common with other hubs: at most a row a hub, taken together before the shuffle
    joint = reached.groupBy("part", "key", "first").agg(F.bit_or("mask").alias("mask"), F.count("*").alias("n"), F.first("hubs").alias("hubs"))
    joint = stored(joint)
    between = joint.select(F.element_at("hubs", F.col("first")).alias("a"), F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size("hubs")), lambda i: F.when(F.call_function("shiftright", F.col("mask"), i - 1).bitwiseAND(F.lit(1)) == 1, F.element_at("hubs", i))), lambda h: h.isNotNull())).alias("b")).filter("a <> b")
    # passes over the masks add those that share a hub; one that is left out is compared with all others, which costs time and no link
    masks = F.col("masks")
    one_pass = lambda start: F.aggregate(masks, start, lambda got, m: F.when(got.bitwiseAND(m["mask"]) != 0, got.bitwiseOR(m["mask"])).otherwise(got))
    grouped = joint.groupBy("part", "key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "mask"))).alias("masks"))
    group = masks[0]["mask"]
    for _ in range(4):
        group = one_pass(group)
    grouped = grouped.select("part", "key", group.alias("group"))
    marked = met.join(unsent(grouped, n, SENT), ["part", "key"], "left").select("part", "key", "fp", "n", (F.col("mask").bitwiseAND(F.coalesce("group", F.lit(0).cast("long"))) != 0).alias("known"))
    return stars.unionByName(between), stored(marked)


def _blocks(marked: DataFrame, size: int, n: int = 0) -> DataFrame:
    """Members dealt to blocks of about `size`: each stays in one, and those that are not known visit every block, in groups of about `size` too."""
    visitors = marked.groupBy("part", "key").agg(F.sum((~F.col("known")).cast("long")).alias("v"))
    held = marked.join(unsent(visitors, n, SENT), ["part", "key"]).filter("v > 0")
    blocks, groups = (F.ceil(F.col(c) / F.lit(size)).cast("int") for c in ("n", "v"))
    deal = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), n.cast("long")).cast("int")
    columns = lambda rows, visits: rows.select("part", "key", "block", "visit", "fp", F.lit(visits).alias("visits"), F.lit(not visits).alias("stays"), "known")
    stay = held.withColumn("block", deal(blocks, 1)).withColumn("visit", F.explode(F.sequence(F.lit(0), groups - 1)))
    visit = held.filter("not known").withColumn("visit", deal(groups, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return columns(stay, False).unionByName(columns(visit, True))


def _forest(fps: np.ndarray, visits: np.ndarray, stays: np.ndarray, known: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between those that visit and those that stay. Who stays and is known is of one tree already."""
    nodes, at = np.unique(fps, return_inverse=True)
    visitor, resident, tree = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool), np.arange(len(nodes))
    visitor[at[visits]] = True
    resident[at[stays]] = True
    if known.any():
        tree[at[known]] = at[known].min()
    a, b = [], []
    others, theirs = nodes[resident], np.flatnonzero(resident)
    for i in np.flatnonzero(visitor):
        # those of its own tree are never looked at again, so a dense crowd, which soon is one tree, costs little
        apart = tree[theirs] != tree[i]
        if not apart.any():
            continue
        near = theirs[apart][np.bitwise_count(others[apart] ^ nodes[i]) <= distance]
        if len(near):
            trees, one_each = np.unique(tree[near], return_index=True)
            a.append(np.full(len(one_each), nodes[i]))
            b.append(nodes[near[one_each]])
            tree[np.isin(tree, trees)] = tree[i]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _forests(distance: int):
    """Over rows sorted by part, key, block and visit: the forest of each of these groups, of which one at a time is in memory."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done():
            rows = pa.Table.from_batches(held)
            fp, visits, stays, known = (rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("fp", "visits", "stays", "known"))
            a, b = _forest(fp.view(np.uint64), visits, stays, known, distance)
            held.clear()
            if len(a):
                return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
            return None

        last = None
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(4)]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if s == e:
                    continue
                key = tuple(int(k[s]) for k in keys)
                if held and key != last and (out := done()):
                    yield out
                last = key
                held.append(batch.slice(s, e - s))
        if held and (out := done()):
            yield out

    return run


# ---------------------------------------------------------------------------------------------- groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest doc_id reachable over links of at most `distance` bits."""
    prints, named = _named(docs, id_col, text_col, distance, shingle, hot)
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def _named(docs: DataFrame, id_col: str, text_col: str, distance: int = DISTANCE, shingle: int = SHINGLE, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """doc_id, digest (of the text), fp of every row; and fp, component_id, root (a fingerprint that tells the component, if it has no id) of every fingerprint."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("label")))
    total = nodes.count()
    seen = nodes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    sample = np.array([r[0] for r in seen], np.int64).view(np.uint64)
    plan = plan_parts(sample, max(total, PLANNED_FOR), distance)
    edges = stored(links(nodes.select("fp"), plan, total, distance, hot))
    touched = edges.select(F.col("a").alias("fp")).unionByName(edges.select(F.col("b").alias("fp"))).distinct()
    linked = nodes.join(unsent(touched, total, SENT), "fp", "left_semi").select(F.col("fp").alias("node"), F.coalesce("label", F.lit(_LAST)).alias("label"))
    found = components(linked, edges, SENT).select(F.col("node").alias("fp"), F.col("label").alias("reached"), "root")
    named = nodes.join(unsent(found, total, SENT), "fp", "left").select("fp", F.nullif(F.coalesce("reached", "label"), F.lit(_LAST)).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return prints, unsent(stored(named), total, SENT)


_LAST = (1 << 63) - 1


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each group: that of the smallest id, null last, and of several texts under it that of the smallest digest; of rows that repeat both, any one. All columns stay."""
    prints, named = _named(docs, id_col, text_col)
    texts = prints.join(named.select("fp", "root"), "fp").groupBy("doc_id", "digest", "root").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    first = texts.groupBy("root").agg(F.min(order).alias("best"), F.sum("n").alias("rows")).filter("rows > 1")
    judged = stored(texts.join(first, "root").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "n", (order == F.col("best")).alias("best")))
    keys = {"_id": docs[id_col].cast("long"), "_digest": F.xxhash64(docs[text_col].cast("string"))}
    kept = without_keys(docs, judged.filter("not best").select("_id", "_digest"), keys)
    repeated = judged.filter("best and n > 1").select("_id", "_digest")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, [key.eqNullSafe(repeated[name]) for name, key in keys.items()], "left_semi").dropDuplicates([id_col, text_col])
    return without_keys(kept, repeated, keys).unionByName(once)


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
