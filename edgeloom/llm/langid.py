"""Language identification by string kernels.

The blended-spectrum presence kernel counts the n-grams (n = 1..3) that two whole texts share, normalised by the n-grams each
has. Landmarks give its Nyström approximation, on which one-versus-rest kernel ridge regression is fitted; prediction is
a product of matrices per batch. As the kernel is linear in presence, the product of the landmarks' presences and
the regression's weights is formed once (n-grams by languages), and a batch needs one product of its presences with that.

Characters are lower-cased and put into 64 classes (a-z their own, white space, digits, ASCII punctuation, all others by a rule), so an
n-gram is a code below 64^n.

Results: a null text, or one without a letter, is `und` with score 0; so is every text where nothing could be learned.
Ties go to the first language by name. Rows with a null id or language are never learned from. Very long texts are read whole: presence needs no more
than their distinct n-grams. Repeated rows are each told; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import id_and_text, map_batches, texts_of

UNDETERMINED = "und"
#: Bounds of the sample that is fitted: rows and landmarks per language, and both in all. A language has a landmark at least, so ALL_LANDMARKS is how many languages (the
#: most frequent labels) the sample has room for.
ROWS, LANDMARKS, ALL_ROWS, ALL_LANDMARKS = 300, 64, 6000, 1024
RIDGE, SHARPNESS = 1e-4, 5.0
_SIZES = (64, 64**2, 64**3)
_DIMS = sum(_SIZES)
_LETTER = re.compile(r"[^\W\d_]")


def _classes() -> np.ndarray:
    out = np.empty(1 << 16, np.uint8)
    for c in range(1 << 16):
        low = chr(c).lower()[0]
        if "a" <= low <= "z":
            out[c] = 1 + ord(low) - ord("a")
        elif low.isspace() or c < 32:
            out[c] = 0
        elif low.isdigit():
            out[c] = 27
        elif c < 128:
            out[c] = 28
        else:
            out[c] = 29 + ord(low) * 2654435761 % (1 << 32) * 35 // (1 << 32)
    return out


_CLASS = _classes()
_flags = np.zeros(_DIMS, bool)


def ngrams(text: str) -> np.ndarray:
    """The codes of the n-grams a text has, each once, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _CLASS[np.where(points < 1 << 16, points, points & 0x7FFF)].astype(np.int32)
    if not len(c):
        return np.zeros(0, np.int32)
    _flags[c] = True
    pairs = c[:-1] * 64 + c[1:]
    _flags[pairs + 64] = True
    _flags[pairs[:-1] * 64 + c[2:] + (64 + 64**2)] = True
    found = np.flatnonzero(_flags)
    _flags[found] = False
    return found.astype(np.int32)


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text)) if text else False


@dataclass
class Model:
    languages: list[str]
    row: np.ndarray  # of each n-gram code, its row in weights, or -1
    weights: np.ndarray  # n-grams of the landmarks by languages
    landmarks: np.ndarray | None = None  # presences of the landmarks, normalised (n-grams by landmarks)
    alpha: np.ndarray | None = None  # landmarks by languages

    def scores(self, texts: list[str]) -> np.ndarray:
        """Regression values, texts by languages."""
        codes = [ngrams(t) for t in texts]
        norms = np.sqrt(np.maximum(1, np.array([len(c) for c in codes])))
        present = np.zeros((len(texts), len(self.weights)), np.float32)
        for i, c in enumerate(codes):
            rows = self.row[c]
            present[i, rows[rows >= 0]] = 1
        return (present @ self.weights) / norms[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        values = self.scores(texts)
        likely = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True)))
        likely /= likely.sum(axis=1, keepdims=True)
        best = likely.argmax(axis=1)
        return [self.languages[i] for i in best], likely[np.arange(len(texts)), best].astype(np.float64)


def fit_samples(codes: list[np.ndarray], languages: list[str], landmarks: int = LANDMARKS) -> Model | None:
    """Kernel ridge regression over the landmarks: the first `landmarks` texts of each language."""
    names = sorted(set(languages))
    if not names:
        return None
    lang = np.array(languages)
    chosen = np.concatenate([np.flatnonzero(lang == n)[:landmarks] for n in names])
    vocabulary = np.unique(np.concatenate([codes[i] for i in chosen])) if len(chosen) else np.zeros(0, np.int32)
    row = np.full(_DIMS, -1, np.int32)
    row[vocabulary] = np.arange(len(vocabulary))
    norm = np.sqrt(np.maximum(1, np.array([len(c) for c in codes])))
    marks = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[row[codes[i]], j] = 1 / norm[i]
    kernel = np.empty((len(codes), len(chosen)), np.float64)
    for i, c in enumerate(codes):
        rows = row[c]
        kernel[i] = marks[rows[rows >= 0]].sum(axis=0) / norm[i]
    target = np.where(lang[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = np.array([1 / max(1, (lang == x).sum()) for x in lang])  # each language counts alike
    weighted = kernel * weight[:, None]
    gram = kernel[chosen]
    alpha = np.linalg.lstsq(weighted.T @ kernel + RIDGE * (gram + 1e-6 * np.eye(len(chosen))), weighted.T @ target, rcond=None)[0]
    return Model(names, row, (marks @ alpha).astype(np.float32), marks, alpha)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the rows of docs for which `learn` holds and the language is known; None where there are none.

    The rows that are fitted are those of least hash of their id, a bounded number per language; their n-grams, not their texts, come to the driver.
    """
    rows = docs.filter(learn & docs[lang_col].isNotNull()).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = rows.filter("text is not null and doc_id is not null")
    known = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(ALL_LANDMARKS).collect()
    if not known:
        return None
    each = max(1, min(ROWS, ALL_ROWS // len(known)))
    share = F.create_map(*[F.lit(x) for r in known for x in (r["lang"], min(1 << 30, 1 + (1 << 31) * each // r["count"]))])
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    drawn = rows.filter(order < F.element_at(share, F.col("lang")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = [ngrams(t) if has_letter(t) else np.zeros(0, np.int32) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.list_(pa.int32()))], names=["doc_id", "lang", "codes"])

    sample = map_batches(drawn, run, "doc_id long, lang string, codes array<int>").filter("size(codes) > 0").orderBy(F.xxhash64("doc_id"), "doc_id", "codes").limit(3 * each * len(known)).toArrow()
    seen: dict[str, int] = {}
    codes, languages = [], []
    for lang, found in zip(sample["lang"].to_pylist(), sample["codes"], strict=True):
        if seen.get(lang, 0) < each:
            seen[lang] = seen.get(lang, 0) + 1
            codes.append(found.values.to_numpy())
            languages.append(lang)
    return fit_samples(codes, languages, max(1, min(LANDMARKS, ALL_LANDMARKS // len(known))))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for every row."""
    light = Model(model.languages, model.row, model.weights) if model else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if light and (told := [i for i, t in enumerate(texts) if has_letter(t)]):
            found, likely = light.predict([texts[i] for i in told])
            score[told] = likely
            for i, x in zip(told, found, strict=True):
                lang[i] = x
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double", rows=128)


def keep_known(docs: DataFrame, model: Model | None, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is told with a score of `least` or more; all columns stay as they are."""
    at = docs.columns.index(text_col)
    light = Model(model.languages, model.row, model.weights) if model else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.select([at]), text_col)
        keep = np.zeros(len(texts), bool)
        if light and (told := [i for i, t in enumerate(texts) if has_letter(t)]):
            keep[told] = light.predict([texts[i] for i in told])[1] >= least
        return batch.filter(pa.array(keep))

    return map_batches(docs, run, docs.schema, rows=128)
