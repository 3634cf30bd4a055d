"""Quality rules with tokeniser fertility.

Every word of a text is encoded by public vocabularies of two kinds, a sentence-piece one with byte fallback and a byte-level one, each distinct word once per task (anew after
WORDS). Byte-level ids are the tokenizers library's; tiktoken, where it is installed, works out most of them (`ByteLevel`). By each, a text's characters per token, the
share of its tokens that are bytes of characters without pieces, and the entropy of its tokens are held against bands of the script that most of its letters have; a text
that any of them is outside of is rejected. The base rules (word count, repeated windows) reject first.

Words are what ASCII white space parts. Results: a null or empty text has no words, fails the base and is not kept; texts without
tokens have measures of 0; texts of fewer tokens than the entropy band begins with are not held against it; very long texts are measured whole; of scripts with as many
letters the first of the list counts. Repeated rows are each measured; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from edgeloom.llm.bpe import _WORD, byte_chars
from edgeloom.llm.common import id_and_text, keeps, map_batches, texts_of, tokenizer_path

VOCABULARY, SECOND = "piece_bpe_32k.model", "byte_bpe_50k.json"
WORDS = 400_000
#: Words of up to 256 characters that every Unicode version classes alike: Latin, Greek, Cyrillic, Japanese, Han and Hangul as they have long been encoded, and common punctuation.
_SURE_WORD = re.compile("[!-~\xa1-ɏΑ-ΡΣ-ώЀ-ҁҊ-ӿ‐-‧、。ぁ-ゖァ-ヺ一-龥가-힣]{0,256}")
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class Band:
    """What a text's measures may be."""

    chars_low: float  # characters per token
    chars_high: float
    bytes_high: float  # share of byte-fallback tokens
    entropy: tuple[tuple[int, float], ...]  # tokens, and the bits per token that a text of so many has at least; between, by the logarithm of the tokens

    def entropy_low(self, tokens: int) -> float:
        """0 below the first point: short texts say nothing here."""
        if tokens < self.entropy[0][0]:
            return 0.0
        return float(np.interp(np.log2(tokens), *self._line))

    @functools.cached_property
    def _line(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([np.log2(n) for n, _ in self.entropy]), np.array([h for _, h in self.entropy], float)


#: Bands by script. Entropy grows with a text's length, so its bound does too: texts that are padded with the same marks or words stay below it.
#: Byte fallback is normal for scripts that the vocabulary has few pieces of, whose bytes also lower the entropy.
BANDS = {
    "latin": Band(1.60, 9.0, 0.10, ((64, 4.6), (80, 4.85), (125, 5.35), (200, 5.5), (320, 5.85), (550, 6.03), (950, 6.2), (1800, 6.33), (3700, 6.46), (8000, 6.55))),
    "cyrillic": Band(1.0, 8.0, 0.30, ((64, 3.5), (1000, 4.5))),
    "greek": Band(0.6, 6.0, 0.60, ((64, 3.0), (1000, 4.0))),
    "cjk": Band(0.3, 4.0, 0.90, ((64, 3.0), (1000, 4.0))),
    "arabic": Band(0.4, 5.0, 0.70, ((64, 3.0), (1000, 4.0))),
    "other": Band(0.2, 6.0, 0.98, ((64, 2.5), (1000, 3.0))),
}
#: The same for the byte-level vocabulary, which writes most scripts other than Latin in bytes. The entropy points of Latin letters are those of fit_band.
SECOND_BANDS = {
    "latin": Band(1.60, 9.0, 0.10, ((152, 5.47), (215, 5.51), (304, 5.75), (431, 5.77), (609, 5.96), (861, 6.03), (1218, 6.16), (1722, 6.23), (2435, 6.30), (3444, 6.34))),
    "cyrillic": Band(0.8, 8.0, 0.90, ((64, 3.0), (1000, 4.0))),
    "greek": Band(0.4, 6.0, 1.0, ((64, 2.5), (1000, 3.5))),
    "cjk": Band(0.2, 4.0, 1.0, ((64, 2.5), (1000, 3.5))),
    "arabic": Band(0.4, 5.0, 1.0, ((64, 2.5), (1000, 3.5))),
    "other": Band(0.1, 6.0, 1.0, ((64, 2.0), (1000, 2.5))),
}
_SCRIPTS = [
    ("latin", re.compile("[A-Za-z\xaa\xba\xc0-\xd6\xd8-\xf6\xf8-ɏḀ-ỿ]")),
    ("cyrillic", re.compile("[Ѐ-ԯ]")),
    ("greek", re.compile("[Ͱ-Ͽἀ-῿]")),
    ("cjk", re.compile("[぀-ヿ㐀-鿿가-힯]")),
    ("arabic", re.compile("[؀-ۿݐ-ݿ]")),
]
_NOT_PLAIN = re.compile("[^\\x00-ɏḀ-ỿ‐-⁯₠-⃏]")


def script_of(text: str) -> str:
    """The script of most letters; `latin` where nothing but Latin letters and common signs occurs, `other` without letters of a known script."""
    if not _NOT_PLAIN.search(text):
        return "latin"
    counts = {name: len(pattern.findall(text)) for name, pattern in _SCRIPTS}
    rest = sum(map(str.isalpha, text)) - sum(counts.values())
    best = max(counts, key=counts.get)
    return best if counts[best] > 0 and counts[best] >= rest else "other"


def ranks_of(path: str, model) -> dict[bytes, int] | None:
    """The bytes of each token of a byte-level vocabulary with its id, if joining always the two neighbours whose union has the least id gives what the tokenizers library gives.

    It does if ids grow along the merges and every token comes out of its own bytes as itself: what happens inside of a token's bytes doesn't depend on what is around them
    until a merge crosses their bounds, so neighbours that make up a token are those of its merge."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    own, before = spec["model"], spec.get("pre_tokenizer") or {}
    if own.get("type") != "BPE" or any(own.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) or spec.get("normalizer"):
        return None
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        return None
    byte, vocab = {c: b for b, c in byte_chars().items()}, own["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in own["merges"]]
    added = {t["content"] for t in spec["added_tokens"]}
    tokens = {t: i for t, i in vocab.items() if t not in added}
    if made != sorted(set(made)) or not byte.keys() <= tokens.keys() or any(not byte.keys() >= set(t) or [x.id for x in model.model.tokenize(t)] != [i] for t, i in tokens.items()):
        return None
    return {bytes(byte[c] for c in t): i for t, i in tokens.items()}


class ByteLevel:
    """Words, with a space before, to ids of a byte-level vocabulary as the tokenizers library gives them. By far most words go to tiktoken, all in one call, which takes a quarter of
    the time; the library itself has those with characters that Unicode versions might class differently, with an added token's text, and those that are very long."""

    def __init__(self, path: str, model):
        self.model, self.added = model, [t.content for t in model.get_added_tokens_decoder().values()]
        self.bound = max(model.get_vocab(with_added_tokens=True).values()) + 1
        self.fast = None
        try:
            import tiktoken
        except ModuleNotFoundError:
            return
        if ranks := ranks_of(path, model):
            # a line's end is in no word, so as a token of its own it parts them
            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=_WORD.pattern, mergeable_ranks=ranks, special_tokens={"\n": self.bound})

    def plain(self, words: list[str]) -> list[bool]:
        """Which words are for tiktoken."""
        text, is_sure = "\n".join(words), _SURE_WORD.fullmatch
        if any(t in text for t in self.added):
            return [is_sure(w) is not None and not any(t in w for t in self.added) for w in words]
        return [is_sure(w) is not None for w in words]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each word has."""
        if not self.fast:
            return joined([x.ids for x in self.model.encode_batch_fast([f" {w}" for w in words], add_special_tokens=False)])
        plain = self.plain(words)
        if all(plain):
            return self.by_ranks(words)
        fast = np.array(plain)
        lens, parts = np.zeros(len(words), np.int64), []
        for mine, (flat, own) in (
            (fast, self.by_ranks([w for w, x in zip(words, plain, strict=True) if x])),
            (~fast, joined([x.ids for x in self.model.encode_batch_fast([f" {w}" for w, x in zip(words, plain, strict=True) if not x], add_special_tokens=False)])),
        ):
            lens[mine] = own
            parts.append((mine, flat))
        out = np.zeros(int(lens.sum()), np.int32)
        for mine, flat in parts:
            out[np.repeat(mine, lens)] = flat
        return out, lens

    def by_ranks(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return joined([])
        ids = self.fast.encode_to_numpy("\n ".join(["", *words]), allowed_special="all").astype(np.int32)
        cuts = np.flatnonzero(ids == self.bound)
        return np.delete(ids, cuts), np.diff(np.append(cuts, len(ids))) - 1


def joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after another, and their lengths."""
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum())), lens


class Grown:
    """An array that grows at its end; its room doubles, so adding a little doesn't copy what is there."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.room):
            room = np.zeros(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : end] = more
        self.size = end


class Vocabulary:
    """A public vocabulary, and the tokens of a table's words by rows."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
            self.encode = lambda words: joined(model.encode(words, num_threads=1))
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            model = Tokenizer.from_file(path)
            ids = model.get_vocab(with_added_tokens=True)
            self.is_byte = np.zeros(max(ids.values()) + 1, bool)
            # the stand-ins of the bytes from 128 on, which are no characters by themselves
            for byte, char in byte_chars().items():
                if byte >= 128 and char in ids:
                    self.is_byte[ids[char]] = True
            # a word as it stands in running text, with the space before
            self.encode = ByteLevel(path, model)
        self.forget()

    def forget(self) -> None:
        self.flat, self.starts, self.lens = Grown(np.int32), Grown(np.int64), Grown(np.int64)

    def learn(self, words: list[str]) -> None:
        flat, lens = self.encode(words)
        self.starts.add(self.flat.size + np.cumsum(lens) - lens)
        self.flat.add(flat)
        self.lens.add(lens)

    def measures(self, rows: np.ndarray, sizes: np.ndarray, chars: list[int]) -> list[tuple[float, float, float, int]]:
        """Of each text, characters per token, share of byte tokens, entropy in bits, and number of tokens. rows: the rows of all texts' words, one text after another;
        sizes: how many each text has."""
        lens, bounds = self.lens.room[rows], np.concatenate(([0], np.cumsum(sizes)))
        ends = np.cumsum(lens)
        ids = self.flat.room[np.repeat(self.starts.room[rows] - ends + lens, lens) + np.arange(len(lens) and ends[-1])]
        cuts = np.concatenate(([0], ends))[bounds]
        high = np.searchsorted(np.flatnonzero(self.is_byte[ids]), cuts)
        totals = np.diff(cuts)
        # one sort for all texts: each text's ids lie beyond those of the text before
        kind = np.int32 if len(sizes) * len(self.is_byte) < 1 << 31 else np.int64
        keys = np.repeat(np.arange(len(sizes), dtype=kind) * kind(len(self.is_byte)), totals)
        keys += ids
        keys.sort()
        firsts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        own = np.searchsorted(firsts, cuts)
        p = np.diff(np.append(firsts, len(keys))) / np.repeat(totals, np.diff(own))
        bits, own = p * np.log2(p), own.tolist()
        return [(c / t, h / t, float(-bits[a:z].sum()) + 0.0, t) if t else (0.0, 0.0, 0.0, 0) for c, t, h, a, z in zip(chars, totals.tolist(), np.diff(high).tolist(), own[:-1], own[1:], strict=True)]


class Pieces(dict):
    """word (bytes) -> row of its tokens in each vocabulary; encoded once when it first comes."""

    def __init__(self, *paths: str):
        self.vocabularies = [Vocabulary(p) for p in paths]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.pending: list[bytes] = []
        for v in self.vocabularies:
            v.forget()

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.pending.append(word)
        return at

    def settle(self) -> None:
        if self.pending:
            words = [w.decode("utf-8", "replace") for w in self.pending]
            for v in self.vocabularies:
                v.learn(words)
            self.pending = []


@functools.lru_cache(maxsize=2)
def pieces_of(*paths: str) -> Pieces:
    return Pieces(*paths)


keeps(__name__, pieces_of.cache_clear)


def windows_mixed(rows: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A hash of the rows of each window."""
    n = max(0, len(rows) - window + 1)
    mixed, own = np.zeros(n, np.uint64), rows.astype(np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for k in range(window):
        mixed ^= own[k : k + n]
        mixed *= factor
        mixed ^= mixed >> np.uint64(29)
    return mixed


def repeated_words(rows: np.ndarray, window: int = WINDOW, mixed: np.ndarray | None = None) -> int:
    """Words inside a window of `window` words that the text has twice or more; rows: one number per distinct word; mixed: windows_mixed of them."""
    if len(rows) <= window:
        return 0
    mixed = windows_mixed(rows, window) if mixed is None else mixed
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    doubtful = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(rows, window)[doubtful])  # equal hashes are checked on the words
    _, inverse, counts = np.unique(windows.view([("", windows.dtype)] * window).ravel(), return_inverse=True, return_counts=True)
    covered = np.zeros(len(rows) + 1, np.int64)
    twice = doubtful[counts[inverse] > 1]
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    return len(lines) - len(set(lines))


_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("script", pa.string()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64())]


_MEASURES = ("chars_per_token", "byte_share", "token_entropy")


def fields(vocabularies: int) -> list[tuple[str, pa.DataType]]:
    """_FIELDS, and the measures by the vocabularies after the first under their names with a number."""
    return _FIELDS + [(f"{m}_{k}", pa.float64()) for k in range(2, vocabularies + 1) for m in _MEASURES]


def measure(texts: list[str], table: Pieces, *bands: dict[str, Band]) -> list[tuple]:
    """A row of fields for each text. bands: those of each vocabulary."""
    words = [np.fromiter(map(table.__getitem__, w), np.int64, len(w)) for w in (t.encode("utf-8", "surrogatepass").split() for t in texts)]  # bytes.split parts at ASCII white space, as is wanted here
    table.settle()
    sizes, rows = np.fromiter(map(len, words), np.int64, len(words)), np.concatenate([np.zeros(0, np.int64), *words])
    chars = [len(t) - sum(t.count(c) for c in _WHITE) for t in texts]
    found = [v.measures(rows, sizes, chars) for v in table.vocabularies]
    mixed, at, out = windows_mixed(rows), 0, []
    for t, own, n, *measures in zip(texts, words, chars, *found, strict=True):
        out.append(_row(t, own, mixed[at : at + max(0, len(own) - WINDOW + 1)], n, measures, bands))
        at += len(own)
    if len(table) > WORDS:
        table.forget()
    return out


def _row(text: str, rows: np.ndarray, mixed: np.ndarray, chars: int, measures: list[tuple[float, float, float, int]], bands: tuple[dict[str, Band], ...]) -> tuple:
    n = len(rows)
    repeated = repeated_words(rows, mixed=mixed)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    script = script_of(text)
    good, found = True, []
    for (per, share, entropy, total), own in zip(measures, bands, strict=True):
        band = own.get(script) or own["other"]
        good &= band.chars_low <= per <= band.chars_high and share <= band.bytes_high and entropy >= band.entropy_low(total)
        found += [per, share, entropy]
    return n, chars, sum(text.count(c) for c in SYMBOLS), duplicate_lines(text), repeated, failed, bool(not failed and good), script, *found


def fit_band(per: np.ndarray, share: np.ndarray, entropy: np.ndarray, tokens: np.ndarray, tail: float = 0.0005, slack: float = 0.03) -> Band:
    """The band that all but `tail` of some good texts of a script lie in, with `slack` of each bound beyond. The entropy band has a point for each half octave of tokens from 64 on
    that has 50 texts or more, and never falls with them. Labelled rows of quality 1 whose crc32 modulo 5 is not 0 give SECOND_BANDS' points of Latin letters; bounds on characters per
    token are left wider than what it finds, for texts with other words than these."""
    points, at = [], np.floor(2 * np.log2(np.maximum(tokens, 1))).astype(int)
    for k in range(12, int(at.max(initial=0)) + 1):
        if (at == k).sum() >= 50:
            low = float(np.quantile(entropy[at == k], tail)) * (1 - slack)
            points.append((int(round(2 ** ((k + 0.5) / 2))), max([low, *(h for _, h in points)])))
    return Band(float(np.quantile(per, tail)) * (1 - slack), float(np.quantile(per, 1 - tail)) * (1 + slack), max(0.02, float(np.quantile(share, 1 - tail)) * (1 + slack)), tuple(points) or ((1 << 62, 0.0),))


def assess(docs: DataFrame, paths: tuple[str, ...] | None = None, bands: tuple[dict[str, Band], ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with the base counts, the method's measures, and the verdict, for every whole text. bands: those of each vocabulary's file."""
    files, bands = paths or (tokenizer_path(VOCABULARY), tokenizer_path(SECOND)), bands or (BANDS, SECOND_BANDS)
    columns = fields(len(files))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = pieces_of(*files)
        texts = texts_of(batch)
        found = [row for at in range(0, len(texts), 64) for row in measure(texts[at : at + 64], table, *bands)]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(zip(*found, strict=True), columns, strict=True))], names=["doc_id", *(f for f, _ in columns)])

    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double"}
    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, " + ", ".join(f"{f} {kinds[k]}" for f, k in columns))
