"""Toxicity by a classifier chain.

The categories are predicted one after another by linear models over the words of the whole text (each word's share of them); each model also sees the probabilities that the
earlier ones gave. In training these are out-of-fold predictions, so that a later model learns how the earlier ones do on rows they have not seen.
Categories before the last are kinds of insult, which are learned as clusters of the toxic rows by their terms: a kind's seed words only name it and say where its
cluster starts, and rows without any of them join the cluster whose terms they share. The last category is the table's own label.

A longer text is scored by overlapping parts of PART words, and has the probabilities of the part whose last one is the largest, so what stands round a passage
never hides it.

Only words that toxic rows have more often are features, and weights are not negative: what a text lacks never makes it toxic.

Results: a null or empty text has no words and gets the models' base rates; rows are flagged at THRESHOLD of the last category; labels that are null
are not learned from, and of several for an id the largest counts; without labels of both classes nothing is flagged. Very long texts are scored whole, part by
part; of parts with equal probabilities the first counts; repeated rows are each scored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import id_and_text, map_batches, texts_of

#: Bounds of the sample that is fitted: toxic and other labelled rows (of least hash of the id), and words that are features.
TOXIC_ROWS, OTHER_ROWS, FEATURES = 1200, 3000, 400
FOLDS, RIDGE, STEPS, THRESHOLD = 3, 0.01, 300, 0.6
#: A word is a feature from this many rows of the sample on.
LEAST = 3
STEM = 5
#: Words of a part of a text that is scored by itself; the next begins half of them on.
PART = 300
#: Share of a text's words at which a term counts in full.
SHARE = 0.01

#: Rounds in which the clusters of toxic rows settle, and the share of its best cluster's likeness from which on a row is of another kind too.
ROUNDS, ALSO = 10, 0.8

#: Kinds of insult and the words that their clusters start from, in the order of the chain.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "insult": ("idiot", "moron", "stupid", "dumb", "fool", "clown", "loser"),
    "contempt": ("pathetic", "worthless", "disgusting", "scum", "trash", "garbage", "vermin"),
}
LAST = "toxic"
_WORD = re.compile(r"\w+")


def terms(text: str) -> tuple[Counter, int]:
    """How often a text has each word, lower-cased, and each stem (first letters) of the longer ones; and its number of words."""
    return terms_of_words(_WORD.findall(text.lower()))


def parts(text: str) -> list[list[str]]:
    """The words of a text, in overlapping parts of PART of them; the last ends with the text."""
    words = _WORD.findall(text.lower())
    last = max(0, len(words) - PART)
    return [words[at : at + PART] for at in (*range(0, last, PART // 2), last)]


def terms_of_words(words: list[str]) -> tuple[Counter, int]:
    counts = Counter(words)
    for w, n in list(counts.items()):
        if len(w) > STEM:
            counts[w[:STEM] + "*"] += n
    return counts, len(words)


def rate(count: int, words: int) -> float:
    """The value of a term for a text: its share of the words, SHARE or more of them being 1."""
    return min(1.0, count / (SHARE * max(1, words)))


@dataclass
class Chain:
    names: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]  # of each category: words, then earlier categories
    biases: list[float]

    def predict(self, texts: list[str]) -> np.ndarray:
        """Probabilities, texts by categories."""
        return np.array([max((self._predict(*terms_of_words(words)) for words in parts(text)), key=lambda p: p[-1]) for text in texts]).reshape(len(texts), len(self.names))

    def _predict(self, counts: Counter, words: int) -> np.ndarray:
        out, n = np.zeros(len(self.names)), len(self.vocabulary)
        found = counts.keys() & self.vocabulary.keys()
        rows, values = [self.vocabulary[t] for t in found], np.array([rate(counts[t], words) for t in found])
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            out[k] = 1 / (1 + np.exp(-np.clip(w[rows] @ values + out[:k] @ w[n:] + b, -30, 30)))
        return out


@dataclass
class Sparse:
    """A matrix by its values that are not zero."""

    rows: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * v[self.cols], self.shape[0])

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, self.values * r[self.rows], self.shape[1])

    def with_column(self, column: np.ndarray) -> Sparse:
        n, d = self.shape
        return Sparse(np.concatenate([self.rows, np.arange(n)]), np.concatenate([self.cols, np.full(n, d)]), np.concatenate([self.values, column]), (n, d + 1))


def logistic(x: Sparse, y: np.ndarray, among: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Ridge logistic regression with weights of 0 at least, by accelerated projected gradients, over the rows `among`, the classes weighted alike."""
    weight = among * np.where(y > 0, 0.5 / max(1, (among & (y > 0)).sum()), 0.5 / max(1, (among & (y <= 0)).sum()))
    top, v = 0.0, np.ones(x.shape[1])
    for _ in range(30):  # power iteration for the largest eigenvalue of the weighted Gram matrix
        v = x.transposed_times(weight * x.times(v))
        top = float(np.linalg.norm(v))
        v = v / max(top, 1e-12)
    ridge = ridge / max(1, among.sum())
    lip = 0.25 * (1.1 * top + 1) + ridge
    w = v = np.zeros(x.shape[1])
    b = c = 0.0
    t = 1.0
    for _ in range(steps):
        r = weight * (1 / (1 + np.exp(-np.clip(x.times(v) + c, -30, 30))) - y)
        w2, b2 = np.maximum(0, v - (x.transposed_times(r) + ridge * v) / lip), c - float(r.sum()) / lip
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def kinds_of(x: np.ndarray, starts: list[np.ndarray]) -> np.ndarray:
    """Rows by kinds, 1 where a row is of the kind: spherical k-means of rows that hold weights of terms. starts: the columns that a kind begins with.

    A kind none of whose columns is in any row begins with the heaviest column of the rows that no other kind has. A row without likeness to any kind is of none.
    """
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    rows = x / np.where(norms > 0, norms, 1)
    centers = np.zeros((len(starts), x.shape[1]))
    for k, columns in enumerate(starts):
        held = x[:, columns].sum(axis=1) > 0 if len(columns) else np.zeros(len(x), bool)
        if held.any():
            centers[k, columns] = rows[held][:, columns].sum(axis=0)
    for k in range(len(starts)):
        if not centers[k].any():
            free = x[(rows @ centers.T <= 0).all(axis=1)].sum(axis=0) if len(x) else np.zeros(0)
            if free.size and free.max() > 0:
                centers[k, int(free.argmax())] = 1
    for _ in range(ROUNDS):
        size = np.linalg.norm(centers, axis=1, keepdims=True)
        likeness = rows @ (centers / np.where(size > 0, size, 1)).T
        best = likeness.max(axis=1, initial=0)
        own = (likeness == best[:, None]) & (best > 0)[:, None]
        fresh = own.astype(np.float64).T @ rows
        centers = np.where(fresh.any(axis=1, keepdims=True), fresh, centers)
    return (likeness >= ALSO * best[:, None]) & (likeness > 0)


def fit_samples(terms_of: pa.Array, counts: pa.Array, lengths: np.ndarray, toxic: np.ndarray, categories: dict[str, tuple[str, ...]] | None = None) -> Chain | None:
    """terms_of, counts: lists of each row's terms and how often it has them; lengths: words of each row; toxic: 0 or 1."""
    categories = CATEGORIES if categories is None else categories
    n = len(toxic)
    if n == 0 or toxic.min() == toxic.max():
        return None
    owner = np.repeat(np.arange(n), np.asarray(pa.compute.list_value_length(terms_of)))
    words = terms_of.flatten().dictionary_encode()
    names, code = words.dictionary, words.indices.to_numpy()
    n1 = int(toxic.sum())
    with_1 = np.bincount(code, toxic[owner], len(names))
    with_0 = np.bincount(code, minlength=len(names)) - with_1
    # the words whose share is most above that of the other rows, by a two-proportion score; ties go to the first by name
    score = (with_1 / n1 - with_0 / (n - n1)) / np.sqrt(with_0 + with_1 + 1)
    able = np.flatnonzero((with_0 + with_1 >= LEAST) & (score > 0))
    chosen = sorted(((-score[i], names[int(i)].as_py()) for i in able[np.argsort(-score[able], kind="stable")[: 2 * FEATURES]]))[:FEATURES]
    vocabulary = {w: i for i, (_, w) in enumerate(chosen)}
    place = np.full(len(names), -1)
    for i in able:
        place[i] = vocabulary.get(names[int(i)].as_py(), -1)
    held = place[code] >= 0
    x = Sparse(owner[held], place[code[held]], np.minimum(1, counts.flatten().to_numpy()[held] / (SHARE * np.maximum(1, lengths[owner[held]]))), (n, len(vocabulary)))
    # what a toxic row holds of each term, by how much more toxic rows have the term
    weight = np.array([-v for v, _ in chosen]) ** 2
    dense = np.zeros((n, len(vocabulary)))
    dense[x.rows, x.cols] = x.values * weight[x.cols]
    starts = [np.array(sorted({vocabulary[t] for w in seeds for t in (w, w[:STEM] + "*") if t in vocabulary}), np.int64) for seeds in categories.values()]
    kinds = np.zeros((n, len(categories)))
    kinds[toxic > 0] = kinds_of(dense[toxic > 0], starts)
    targets = list(kinds.T)
    targets.append(toxic.astype(np.float64))
    names = [*categories, LAST]
    fold = np.arange(n) % FOLDS
    weights, biases, every = [], [], np.ones(n, bool)
    for y in targets:
        w, b = logistic(x, y, every)
        weights.append(w)
        biases.append(b)
        out = np.zeros(n)
        for k in range(FOLDS):
            fw, fb = logistic(x, y, fold != k)
            out[fold == k] = (1 / (1 + np.exp(-np.clip(x.times(fw) + fb, -30, 30))))[fold == k]
        x = x.with_column(out)
    return Chain(names, vocabulary, weights, biases)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    """A chain of at most TOXIC_ROWS and OTHER_ROWS labelled rows for which `learn` (over the labels) holds, copies counting once; their words' counts come to the driver."""
    known = labels.filter(learn & labels[label_col].isNotNull() & labels[id_col].isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    known = known.filter("_label = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(known.filter("_label = 0").orderBy(*order).limit(OTHER_ROWS))
    rows = docs.join(F.broadcast(known), docs[id_col] == known["_id"]).select(known["_id"].alias("doc_id"), docs[text_col].alias("text"), "_label")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [terms(t) for t in texts_of(batch)]
        lists = [sorted(c) for c, _ in found]
        columns = [pa.array(lists, pa.list_(pa.string())), pa.array([[c[t] for t in ts] for ts, (c, _) in zip(lists, found, strict=True)], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.int32())]
        digests = pa.array(np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) for t in texts_of(batch)], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns, digests], names=["doc_id", "label", "terms", "counts", "words", "digest"])

    sample = map_batches(rows, run, "doc_id long, label int, terms array<string>, counts array<int>, words int, digest long").orderBy(F.xxhash64("doc_id"), "doc_id", "terms", "counts").limit(2 * (TOXIC_ROWS + OTHER_ROWS)).toArrow()
    # copies of a text are one example of a label, or their words would count as toxic by their number
    once = np.unique(np.stack([sample["digest"].to_numpy(), sample["label"].to_numpy()]), axis=1, return_index=True)[1]
    sample = sample.take(np.sort(once)).combine_chunks()
    column = lambda name: sample[name].combine_chunks() if sample.num_rows else pa.array([], sample.schema.field(name).type)
    return fit_samples(column("terms"), column("counts"), sample["words"].to_numpy(), sample["label"].to_numpy())


def predict(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the probability of each category, and `toxic` (whether the last is at THRESHOLD or above), for every row."""
    names = chain.names if chain else [*CATEGORIES, LAST]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = chain.predict(texts_of(batch)) if chain else np.zeros((batch.num_rows, len(names)))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= THRESHOLD)], names=["doc_id", *(f"p_{n}" for n in names), "toxic"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, " + "".join(f"p_{n} double, " for n in names) + "toxic boolean")
