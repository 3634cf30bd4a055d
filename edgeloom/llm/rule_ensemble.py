"""Quality classifier: a sparse ensemble of rules.

Statistics of every whole text are columns. Boosted regression trees over a bounded sample of labelled rows give paths; each path is a conjunction
of comparisons, a rule. A lasso logistic regression over all rules leaves few with a weight, and those are compiled into one
Spark column expression over the statistics, which scores every row.

Results: a null or empty text has statistics of zero and is scored like any other; labels that are null, or contradict one another for one id, count as their largest;
without labels of both classes the score is the share of label 1 (0.5 where there is none). Repeated rows are each scored; the statistics of very long texts are of
all of them; of splits with equal gain the first statistic and bound count; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import id_and_text, map_batches, texts_of

#: Bound of the labelled rows that are fitted: those of least hash of their id.
SAMPLE = 6000
TREES, DEPTH, BINS, SHRINK = 40, 3, 32, 0.3
LASSO, STEPS = 0.003, 400

STATISTICS = ("log_chars", "log_words", "word_len", "symbol_share", "mark_share", "upper_share", "digit_share", "other_share", "unique_words", "unique_pairs", "top_word", "bare_marks", "short_words", "dup_lines", "line_words")


def statistics_of(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [float(np.log1p(len(text)))] + [0.0] * (len(STATISTICS) - 1)
    n, size = len(words), len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    low, up, digit = counts[97:123].sum(), counts[65:91].sum(), counts[48:58].sum()
    white = counts[9:14].sum() + counts[32]
    symbols = sum(counts[ord(c)] for c in "#*$%&|<>@^~=+_\\{}[]/")
    marks = sum(counts[ord(c)] for c in ".,;:!?'\"()-")
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    solid = max(1, size - white)
    return [
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        solid / n,
        symbols / solid,
        marks / solid,
        up / max(1, low + up),
        digit / solid,
        counts[128:].sum() / solid,
        len(seen) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        max(seen.values()) / n,
        sum(k for w, k in seen.items() if not w.isalnum() and len(w) == 1) / n,
        sum(k for w, k in seen.items() if len(w) < 4) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(np.log1p(n / max(1, len(lines)))),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a column for each of STATISTICS."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([statistics_of(t) for t in texts_of(batch)], np.float64).reshape(-1, len(STATISTICS))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(rows.shape[1]))], names=["doc_id", *STATISTICS])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


Condition = tuple[int, float, bool]  # statistic, bound, whether above it


@dataclass
class Ensemble:
    rules: list[tuple[Condition, ...]]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The score as a Spark column over the statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = None
            for at, bound, above in rule:
                one = F.col(STATISTICS[at]) > bound if above else F.col(STATISTICS[at]) <= bound
                holds = one if holds is None else holds & one
            total = total + F.when(holds, float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + hold(self.rules, x) @ np.array(self.weights))))


def hold(rules: list[tuple[Condition, ...]], x: np.ndarray) -> np.ndarray:
    """Rows by rules: 1 where all of a rule's conditions hold."""
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for at, bound, above in rule:
            out[:, j] *= (x[:, at] > bound) if above else (x[:, at] <= bound)
    return out


def tree_paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[tuple[Condition, ...]]:
    """Paths, inner ones too, of trees boosted on the logistic loss, each on half the rows."""
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1)
    value, paths = np.full(len(x), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []

    def grow(rows: np.ndarray, every: np.ndarray, path: tuple[Condition, ...]) -> None:
        g, h = residual[rows], curve[rows]
        if path:
            paths.append(path)
        best = (1e-6, None, None)
        if len(path) < DEPTH and len(rows) >= 20:
            all_g, all_h = g.sum(), h.sum()
            for i, c in enumerate(cuts):
                if len(c):
                    sg = np.cumsum(np.bincount(binned[rows, i], g, len(c) + 1))[:-1]
                    sh = np.cumsum(np.bincount(binned[rows, i], h, len(c) + 1))[:-1]
                    gain = sg**2 / (sh + 1) + (all_g - sg) ** 2 / (all_h - sh + 1) - all_g**2 / (all_h + 1)
                    gain[(sh < 1) | (all_h - sh < 1)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], i, k)
        if best[1] is None:
            value[every] += SHRINK * g.sum() / (h.sum() + 1)
            return
        _, i, k = best
        bound = float(cuts[i][k])
        for above in (False, True):
            grow(rows[(binned[rows, i] > k) == above], every[(binned[every, i] > k) == above], (*path, (i, bound, above)))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-value))
        residual, curve = y - p, p * (1 - p)
        grow(np.flatnonzero(rng.random(len(x)) < 0.5), np.arange(len(x)), ())
    return list(dict.fromkeys(paths))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradients."""
    center = z.mean(axis=0)
    z = z - center
    step = 4.0 / (np.linalg.eigvalsh(z.T @ z / len(z))[-1] + 1)
    w = v = np.zeros(z.shape[1])
    b = c = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ v + c)))
        w2 = v - step * (z.T @ (p - y)) / len(z)
        w2 = np.sign(w2) * np.maximum(0, np.abs(w2) - step * penalty)
        b2 = c - step * float((p - y).mean())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b - float(center @ w)


def fit_samples(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ensemble:
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Ensemble([], [], float(np.log(share / (1 - share))))
    rules = tree_paths(x, y.astype(np.float64), np.random.default_rng(seed))
    w, b = lasso_logistic(hold(rules, x), y.astype(np.float64))
    kept = [i for i in np.argsort(-np.abs(w)) if abs(w[i]) > 1e-6]
    return Ensemble([rules[i] for i in kept], [float(w[i]) for i in kept], b)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Ensemble:
    """An ensemble of at most SAMPLE labelled rows for which `learn` (over the labels) holds; only their statistics come to the driver."""
    known = labels.filter(learn & labels[label_col].isNotNull() & labels[id_col].isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    rows = docs.join(F.broadcast(known), docs[id_col] == known["_id"]).select(docs[id_col].alias("_doc"), docs[text_col].alias("_text"))
    found = statistics(rows, "_doc", "_text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    sample = found.select(*STATISTICS, "_label", "doc_id").orderBy("doc_id", *STATISTICS).limit(2 * SAMPLE).toPandas()
    return fit_samples(sample[list(STATISTICS)].to_numpy(np.float64).reshape(-1, len(STATISTICS)), sample["_label"].to_numpy())


def score(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and the statistics."""
    return statistics(docs, id_col, text_col).select("doc_id", model.column().alias("score"), *STATISTICS)
