"""The learned operators against plain versions: dense matrices, loops, and the conditions of an optimum."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import langid, rule_ensemble, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the river and morning was over this bridge with three windows", "de": "der Fluss und Morgen war über diese Brücke mit drei Fenstern", "fr": "le fleuve et matin était sur ce pont avec trois fenêtres"}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


# ---------------------------------------------------------------------------------------------- language


def grams(text):
    """The set of n-grams (n = 1..3) over the classes of characters, one by one."""
    kinds = [int(langid._CLASS[ord(c) if ord(c) < 1 << 16 else ord(c) & 0x7FFF]) for c in text]
    return {tuple(kinds[i : i + n]) for n in (1, 2, 3) for i in range(len(kinds) - n + 1)}


def test_language_equals_dense_kernel_ridge():
    """Kernel ridge regression with every kernel value counted from sets, solved by dense matrices."""
    rng = random.Random(5)
    rows = [(prose(rng, lang, rng.randrange(3, 15)), lang) for lang in WORDS for _ in range(20)]
    rng.shuffle(rows)
    texts, langs = [t for t, _ in rows], [x for _, x in rows]
    model = langid.fit_samples([langid.ngrams(t) for t in texts], langs, 8)
    names = sorted(WORDS)
    chosen = [i for n in names for i in [k for k, x in enumerate(langs) if x == n][:8]]
    sets = [grams(t) for t in texts]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, sets[j]) for j in chosen] for a in sets])
    gram = k[chosen]
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs])
    w = np.diag([1 / langs.count(x) for x in langs])
    alpha = np.linalg.solve(k.T @ w @ k + langid.RIDGE * (gram + 1e-6 * np.eye(len(chosen))), k.T @ w @ y)
    new = [prose(rng, lang, 6) for lang in WORDS for _ in range(5)] + ["über the pont", "x"]
    values = np.array([[kernel(grams(t), sets[j]) for j in chosen] for t in new]) @ alpha
    likely = np.exp(langid.SHARPNESS * (values - values.max(axis=1, keepdims=True)))
    likely /= likely.sum(axis=1, keepdims=True)
    found, scores = model.predict(new)
    assert found == [names[i] for i in likely.argmax(axis=1)]
    assert scores == pytest.approx(likely.max(axis=1), abs=5e-3)
    assert model.scores(new) == pytest.approx(values, abs=5e-3)


def test_language_long_repeated_and_empty(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, lang, 12), lang, "s", 0) for i, lang in enumerate(["en", "de", "fr"] * 30)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs, F.lit(True))
    more = [(0, prose(rng, "de", 200_000), None, "s", 0), (1, "der Fluss und", None, "s", 0), (1, "der Fluss und", None, "s", 0)]
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(spark.createDataFrame(more, DOCS), model).collect()]
    assert sorted(got) == [(0, "de"), (1, "de"), (1, "de")]
    assert langid.predict(docs.limit(0), model).count() == 0 and langid.keep_known(docs.limit(0), model).count() == 0


# ---------------------------------------------------------------------------------------------- toxicity


def plain_terms(text):
    words = re.findall(r"\w+", text.lower())
    found = {}
    for w in words:
        for t in [w] + ([w[:5] + "*"] if len(w) > 5 else []):
            found[t] = found.get(t, 0) + 1
    return found, len(words)


def toxic_rows(n=240, seed=3):
    rng = random.Random(seed)
    rude = ["idiot", "scum", "blorptard", "grimwad"]
    rows = []
    for i in range(n):
        words = prose(rng, "en", 40).split()
        if i % 3 == 0:
            k = rng.randrange(2)
            for _ in range(rng.randrange(1, 3)):
                words[rng.randrange(40)] = rude[k + 2 * rng.randrange(2)]
        rows.append((" ".join(words), int(i % 3 == 0)))
    return rows


def fitted(rows):
    found = [toxicity.terms(t) for t, _ in rows]
    lists = [sorted(c) for c, _ in found]
    return toxicity.fit_samples(pa.array(lists, pa.list_(pa.string())), pa.array([[c[t] for t in ts] for ts, (c, _) in zip(lists, found)], pa.list_(pa.int32())), np.array([n for _, n in found]), np.array([y for _, y in rows]))


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30, min(30, x))))


def test_chain_predictions_equal_plain_loops():
    rows = toxic_rows()
    chain = fitted(rows)
    rng = random.Random(1)
    texts = [t for t, _ in rows[:30]] + ["", "IDIOT", prose(rng, "en", 900) + " scum " + prose(rng, "en", 700)]
    for text, got in zip(texts, chain.predict(texts)):
        words = re.findall(r"\w+", text.lower())
        best = None
        starts = sorted({*range(0, max(0, len(words) - 300), 150), max(0, len(words) - 300)})
        for at in starts:
            counts, n = plain_terms(" ".join(words[at : at + 300]))
            p = []
            for w, b in zip(chain.weights, chain.biases):
                value = b
                for term, i in chain.vocabulary.items():
                    if term in counts:
                        value += w[i] * min(1, counts[term] / (0.01 * n))
                for k, earlier in enumerate(p):
                    value += w[len(chain.vocabulary) + k] * earlier
                p.append(sigmoid(value))
            if best is None or p[-1] > best[-1]:
                best = p
        assert got == pytest.approx(best, abs=1e-9)


def test_chain_is_fitted_to_the_optimum_with_out_of_fold_links():
    """Vocabulary by loops; the kinds from the operator's own clusters; every model solved by plain projected gradients over a dense matrix."""
    rows = toxic_rows(120)
    chain = fitted(rows)
    terms = [plain_terms(t) for t, _ in rows]
    toxic = np.array([y for _, y in rows], float)
    n, n1 = len(rows), int(toxic.sum())
    scores = {}
    for term in sorted({t for c, _ in terms for t in c}):
        with_1 = sum(1 for (c, _), y in zip(terms, toxic) if term in c and y)
        with_0 = sum(1 for (c, _), y in zip(terms, toxic) if term in c and not y)
        score = (with_1 / n1 - with_0 / (n - n1)) / math.sqrt(with_0 + with_1 + 1)
        if with_0 + with_1 >= 3 and score > 0:
            scores[term] = score
    vocabulary = sorted(scores, key=lambda t: (-scores[t], t))[:400]
    assert vocabulary == list(chain.vocabulary)
    x = np.array([[min(1, c.get(t, 0) / (0.01 * m)) for t in vocabulary] for c, m in terms])

    def solve(x, y, rows):
        weight = rows * np.where(y > 0, 0.5 / max(1, (rows * y).sum()), 0.5 / max(1, (rows * (1 - y)).sum()))
        ridge, w, b = toxicity.RIDGE / rows.sum(), np.zeros(x.shape[1]), 0.0
        lip = 0.25 * (np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + 1) + ridge
        for _ in range(40_000):
            r = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
            w, b = np.maximum(0, w - (x.T @ r + ridge * w) / lip), b - r.sum() / lip
        return w, b

    dense = x * np.array([scores[t] for t in vocabulary]) ** 2
    starts = [np.array([i for i, t in enumerate(vocabulary) if t in seeds or t in {s[:5] + "*" for s in seeds}], int) for seeds in toxicity.CATEGORIES.values()]
    kinds = np.zeros((n, 2))
    kinds[toxic > 0] = toxicity.kinds_of(dense[toxic > 0], starts)
    loss = lambda x, y, w, b: -np.mean(np.where(y > 0, np.log(1 / (1 + np.exp(-(x @ w + b)))), np.log(1 - 1 / (1 + np.exp(-(x @ w + b))))))
    fold = np.arange(n) % 3
    for k, y in enumerate([*kinds.T, toxic]):
        w, b = solve(x, y, np.ones(n))
        assert 1 / (1 + np.exp(-(x @ chain.weights[k] + chain.biases[k]))) == pytest.approx(1 / (1 + np.exp(-(x @ w + b))), abs=0.08), k
        assert abs(loss(x, y, chain.weights[k], chain.biases[k]) - loss(x, y, w, b)) < 0.02
        out = np.zeros(n)
        for f in range(3):
            fw, fb = solve(x, y, (fold != f).astype(float))
            out[fold == f] = (1 / (1 + np.exp(-(x @ fw + fb))))[fold == f]
        x = np.hstack([x, out[:, None]])


def test_kinds_are_clusters_of_toxic_rows():
    """Rows without any seed word join the kind whose rows they share terms with."""
    columns = ["idiot", "blorp", "scum", "grim", "lone"]
    rows = np.array([[1, 1, 0, 0, 0]] * 5 + [[0, 1, 0, 0, 0]] * 3 + [[0, 0, 1, 1, 0]] * 4 + [[0, 0, 0, 1, 0]] * 2 + [[0, 0, 0, 0, 0]], float)
    found = toxicity.kinds_of(rows, [np.array([columns.index("idiot")]), np.array([columns.index("scum")])])
    assert found.tolist() == [[True, False]] * 8 + [[False, True]] * 6 + [[False, False]]
    unseeded = toxicity.kinds_of(rows, [np.array([columns.index("idiot")]), np.array([], int)])
    assert unseeded.tolist() == found.tolist()
    assert toxicity.kinds_of(np.zeros((0, 5)), [np.array([0]), np.array([2])]).shape == (0, 2)


def test_toxicity_repeated_rows_and_empty_tables(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, (t, _) in enumerate(rows)], DOCS)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels, F.lit(True))
    twice = toxicity.fit(docs.unionByName(docs), labels, F.lit(True))
    assert list(chain.vocabulary) == list(twice.vocabulary) and all(np.allclose(a, b) for a, b in zip(chain.weights, twice.weights))
    assert toxicity.predict(docs.limit(0), chain).count() == 0
    assert toxicity.fit(docs.limit(0), labels, F.lit(True)) is None
    got = toxicity.predict(docs.limit(1).unionByName(docs.limit(1)), chain).collect()
    assert len(got) == 2 and got[0] == got[1]


# ---------------------------------------------------------------------------------------------- quality


def plain_statistics(text):
    """Character by character and word by word, for ASCII texts."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    solid = [c for c in text if not c.isspace()]
    share = lambda chars: sum(c in chars for c in solid) / len(solid)
    up, low = sum(c.isupper() for c in text), sum(c.islower() for c in text)
    pairs = list(zip(words, words[1:]))
    return [
        math.log(1 + len(text)),
        math.log(1 + len(words)),
        len(solid) / len(words),
        share("#*$%&|<>@^~=+_\\{}[]/"),
        share(".,;:!?'\"()-"),
        up / max(1, up + low),
        share("0123456789"),
        0.0,
        len(set(words)) / len(words),
        len(set(pairs)) / max(1, len(pairs)),
        max(map(words.count, words)) / len(words),
        sum(len(w) == 1 and not w.isalnum() for w in words) / len(words),
        sum(len(w) < 4 for w in words) / len(words),
        1 - len(set(lines)) / len(lines),
        math.log(1 + len(words) / len(lines)),
    ]


def quality_rows(n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, "en", rng.randrange(5, 60)) + "."
        if i % 4 == 0:
            text = " ".join(w + rng.choice(["##", "$", " |"]) for w in text.split())
        rows.append((text + rng.choice(["", "\nand the last Line 12"]), int(i % 4 > 0)))
    return rows


def test_statistics_equal_plain_counts():
    for text, _ in quality_rows(60) + [("a", 1), ("A b\n\nA b\n", 0)]:
        assert rule_ensemble.statistics_of(text) == pytest.approx(plain_statistics(text))


def test_quality_scores_equal_rules_by_enumeration(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, (t, _) in enumerate(rows)], DOCS)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int")
    model = rule_ensemble.fit(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in rule_ensemble.score(docs, model).collect()}
    for i, (text, y) in enumerate(rows):
        x, total = plain_statistics(text), model.bias
        for rule, weight in zip(model.rules, model.weights):
            if all((x[at] > bound) == above for at, bound, above in rule):
                total += weight
        assert got[i] == pytest.approx(sigmoid(total), abs=1e-6)
        assert (got[i] >= 0.5) == (y == 1)


def test_lasso_weights_meet_the_conditions_of_the_optimum():
    rows = quality_rows()
    x = np.array([rule_ensemble.statistics_of(t) for t, _ in rows])
    y = np.array([y for _, y in rows], float)
    y[::17] = 1 - y[::17]
    rules = rule_ensemble.tree_paths(x, y, np.random.default_rng(1))
    z = rule_ensemble.hold(rules, x)
    for i, rule in enumerate(rules[:50]):
        assert [all((row[at] > bound) == above for at, bound, above in rule) for row in x] == [v == 1 for v in z[:, i]]
    w, b = rule_ensemble.lasso_logistic(z, y, steps=20_000)
    slope = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / len(y)
    assert np.abs(slope).max() <= rule_ensemble.LASSO + 1e-4
    assert slope[np.abs(w) > 1e-3] == pytest.approx(-rule_ensemble.LASSO * np.sign(w[np.abs(w) > 1e-3]), abs=1e-4)
    short, c = rule_ensemble.lasso_logistic(z, y)
    assert 1 / (1 + np.exp(-(z @ short + c))) == pytest.approx(1 / (1 + np.exp(-(z @ w + b))), abs=0.05)


def test_the_first_split_is_the_best_of_all():
    """Every statistic and every bound between bins tried by loops."""
    rng = np.random.default_rng(4)
    x, y = rng.random((300, len(rule_ensemble.STATISTICS))), rng.integers(0, 2, 300).astype(float)
    y[x[:, 6] > 0.4] = 1

    class All:
        random = staticmethod(lambda n: np.zeros(n))  # all rows in every tree

    first = rule_ensemble.tree_paths(x, y, All())[0][0]
    p = y.mean()
    best = None
    for i in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, i], np.linspace(0, 1, rule_ensemble.BINS + 1)[1:-1])):
            gain = 0.0
            for side in (x[:, i] <= cut, x[:, i] > cut):
                g, h = (y[side] - p).sum(), side.sum() * p * (1 - p)
                gain += g * g / (h + 1)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, i, cut)
    assert first[0] == best[1] == 6 and first[1] == pytest.approx(best[2])


def test_quality_long_ties_and_empty(spark):
    rows = quality_rows(80)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, (t, _) in enumerate(rows)], DOCS)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int")
    model = rule_ensemble.fit(docs, labels, F.lit(True))
    rng = random.Random(1)
    more = spark.createDataFrame([(0, prose(rng, "en", 150_000) + ".", "en", "s", 0), (1, "the river", "en", "s", 0), (1, "the river", "en", "s", 0)], DOCS)
    got = rule_ensemble.score(more, model).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert rule_ensemble.score(docs.limit(0), model).count() == 0 and rule_ensemble.fit(docs.limit(0), labels, F.lit(True)).rules == []
    both = labels.unionByName(labels.withColumn("quality", F.lit(0)))  # of labels that contradict one another the largest counts
    assert rule_ensemble.fit(docs, both, F.lit(True)).rules == model.rules


# ---------------------------------------------------------------------------------------------- batches


def test_parts_of_batches_are_bounded_in_rows_and_bytes():
    from edgeloom.llm import common

    texts = ["x" * 1_000_000] * 150 + ["y" * 20_000_000] + ["short"] * 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(common.slices(batch, 512))
    assert sum(p.num_rows for p in parts) == len(texts) and [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or (p.num_rows <= 512 and p.nbytes <= common.BATCH_BYTES) for p in parts)
    assert list(common.slices(batch.slice(0, 0), 5)) == []


def test_operators_leave_the_session_as_it_is(spark, data):
    from edgeloom.llm import queries

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"]
    before = [spark.conf.get(n) for n in names]
    for name in ("op1_secrets", "op4_warc", "op9_fertility", "op10_licenses"):
        queries.QUERIES[name](spark, data).count()
        assert [spark.conf.get(n) for n in names] == before, name
