"""Byte-level BPE over a distinct-word table.

Each task splits its texts into the tokenizer's words and keeps a table of the distinct ones it has met: a word is encoded once, when it
first comes, and every occurrence takes its ids from the table by position. Decoding joins each id to its piece by position and
concatenates the bytes. The table is kept per task, with a fixed bound, because a table over all tasks would have to shuffle every
occurrence of every word to join the ids back (see the README for figures); `encode_by_join` has that form, for comparison.

Results equal the tokenizers library's encode(add_special_tokens=False, truncation and padding unused) and decode(skip_special_tokens=False).
A null or empty text has no ids and decodes to the empty text; repeated rows are each encoded; very long texts are worked off in
pieces cut where no word can span; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import id_and_text, keeps, map_batches, stored, texts_of, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
#: Distinct words that a task keeps; at the bound it starts anew. It bounds memory only.
WORDS = 250_000
#: Characters worked off at once.
CHUNK = 1 << 20

_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Outside these characters, Unicode versions might class characters differently: there the library itself splits.
_UNSURE = re.compile("[^\t\n\r -~\xa1-ɏ]")
#: No word spans such a place: a space before a letter begins one, a letter before a space ends one.
_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


class Words(dict):
    """word -> its row in a table of ids; a word that is new gets a row whose ids are filled in by `settle`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex", True) or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        added = [t for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has added tokens that take white space or need word bounds")
        self.special = {t["content"]: t["id"] for t in added}
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.pending: list[str] = []
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.pending.append(word)
        return at

    def settle(self) -> None:
        """Encodes each word that has come since, once."""
        if not self.pending:
            return
        ids = [[self.special[w]] if w in self.special else None for w in self.pending]
        plain = [w for w, x in zip(self.pending, ids, strict=True) if x is None]
        found = iter(self.tokenizer.encode_batch_fast(plain, add_special_tokens=False))
        ids = [next(found).ids if x is None else x for x in ids]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(lens.sum()))])
        self.lens = np.concatenate([self.lens, lens])
        self.pending = []

    def split(self, text: str) -> list[str]:
        """The tokenizer's words; a special token's own text is a word of its own."""
        if self.split_special and any(s in text for s in self.special):
            return [w for piece in self.split_special.split(text) if piece for w in ([piece] if piece in self.special else self._split(piece))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if _UNSURE.search(text):
            return [text[a:z] for _, (a, z) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return _WORD.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        ids, counts, rows, owners, size = [], np.zeros(len(texts), np.int64), [], [], 0

        def flush() -> None:
            nonlocal rows, owners, size
            if not rows:
                return
            self.settle()
            at = np.concatenate(rows)
            lens = self.lens[at]
            ends = np.cumsum(lens)
            ids.append(self.flat[np.repeat(self.starts[at] - ends + lens, lens) + np.arange(ends[-1])])
            per = np.add.reduceat(lens, np.cumsum([0] + [len(r) for r in rows[:-1]]))
            np.add.at(counts, owners, per)
            rows, owners, size = [], [], 0
            if len(self) > WORDS:
                self.forget()

        for i, text in enumerate(texts):
            for piece in pieces(text):
                if words := self.split(piece):
                    rows.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
                    owners.append(i)
                    size += len(piece)
                    if size > CHUNK:
                        flush()
        flush()
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts


def pieces(text: str, size: int = CHUNK) -> list[str]:
    """A long text in pieces of about `size` characters that no word spans."""
    out, at = [], 0
    while len(text) - at > 2 * size and (cut := _CUT.search(text, at + size)):
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:] if at else text)
    return [p for p in out if p]


@functools.lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> pa.Array:
    """Row i: the bytes of id i."""
    # read from the file: a task that decodes needs no tokenizer beside them
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = {c: b for b, c in byte_chars().items()}
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return pa.array(out, pa.large_binary())


def _forget() -> None:
    words_of.cache_clear()
    pieces_of.cache_clear()


keeps(__name__, _forget)


def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest is moved above 255 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def ids_of(texts: list[str], file: str) -> pa.ListArray:
    """The ids of each text."""
    ids, counts = words_of(file).encode(texts)
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))


def texts_of_ids(ids: pa.ListArray, file: str) -> list[str]:
    """Each id joined to its piece by position, the pieces' bytes read as UTF-8 (what is none becomes U+FFFD). Null ids are none."""
    flat = ids.flatten()
    ends = np.concatenate(([0], np.cumsum(np.array([n or 0 for n in pa.compute.list_value_length(ids).to_pylist()], np.int64))))
    texts = []
    for first in range(0, len(ids), 64):  # a few texts' pieces at a time
        last = min(first + 64, len(ids))
        taken = pieces_of(file).take(flat.slice(ends[first], ends[last] - ends[first]))
        offsets, data = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1), taken.buffers()[2]
        for i in range(first, last):
            a, z = (int(offsets[e - ends[first]]) for e in (ends[i], ends[i + 1]))
            texts.append(data[a:z].to_pybytes().decode("utf-8", "replace") if z > a else "")
    return texts


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the ids of every whole text."""
    file = path or tokenizer_path(VOCABULARY)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), ids_of(texts_of(batch), file)], names=["doc_id", "ids"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids -> doc_id, ids, text: what the ids stand for."""
    file = path or tokenizer_path(VOCABULARY)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts_of_ids(batch.column(1), file), pa.string())], names=["doc_id", "ids", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded_sha256: the ids of every whole text, and the digest of what they decode to. Both are done where the text is, so neither ids nor decoded texts
    go from one worker to another."""
    file = path or tokenizer_path(VOCABULARY)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = ids_of(texts_of(batch), file)
        digests = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts_of_ids(ids, file)]
        return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(digests, pa.string())], names=["doc_id", "ids", "decoded_sha256"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, ids array<int>, decoded_sha256 string")


def encode_by_join(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The same by one distinct-word table over all tasks: words with their positions are exploded, the distinct ones encoded once, and the ids
    joined back by word (words that come often are salted) and put in order by position. It shuffles every occurrence twice; a document's
    words meet in one row, as its ids must. Ids of documents must be distinct here."""
    file = path or tokenizer_path(VOCABULARY)

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(i, w) for i, t in enumerate(texts_of(batch)) for w in enumerate(x for p in pieces(t) for x in words_of(file).split(p))]
        own = batch.column(0).to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([own[i] for i, _ in found], pa.int64()), pa.array([w[0] for _, w in found], pa.int64()), pa.array([w[1] for _, w in found], pa.string())], names=["doc_id", "pos", "word"])

    def of_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = words_of(file)
        rows = []
        for w in batch.column(0).to_pylist():
            at = table[w]
            table.settle()
            rows.append(table.flat[table.starts[at] : table.starts[at] + table.lens[at]].tolist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["word", "ids"])

    base = id_and_text(docs, id_col, text_col)
    words = stored(map_batches(base, split, "doc_id long, pos long, word string"))
    known = map_batches(words.select("word").distinct(), of_words, "word string, ids array<int>")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    got = words.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(salts)).cast("int")).join(salted, ["word", "salt"])
    ids = got.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))
    return base.select("doc_id").join(ids, "doc_id", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
