"""Benchmark decontamination by template canonicalisation.

Words are what white space parts, lower-cased and without the marks around them. In a template, numbers, quantities, units and names are typed
placeholders. A document's windows of WINDOW words, once as they are and once as templates, are hash-joined with those of the
benchmark; what the placeholders stand for must be consistent along an alignment (one value of the item has one value in
the document), so a question with other numbers and names is found, and chance meetings of templates are not. A filter over the benchmark's
hashes, as large as these need, decides which windows of a document leave its task at all.

A capitalised word that begins a sentence is a word in one form of a template and a name in another, unless it is one of STARTERS, as no
capital tells which it is; windows of either form meet those of either.

An item is reported for a document if at least ENOUGH of its words, or the share COVERED of them, lie in such windows. A window with more than
SLOTS placeholders says little alone: it needs FIXED words that are none, and such windows count where an alignment has as many words besides names as a window
with SLOTS of them. Items of fewer words than a window are one window; those under LEAST
words say nothing within a text, and are compared whole: with documents of just their words, as they are.

Results: null and empty texts match nothing, nor do texts without words that have a core; very long texts are looked through whole; rows with one id are one document, and
those with a null id are documents by their texts; repeated rows of a document change nothing; repeated items are each reported; ties do not occur,
as every item is reported; empty tables give an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import id_and_text, keeps, map_batches, stored, texts_of, without_keys

WINDOW, LEAST, SLOTS, FIXED = 8, 5, 3, 2
ENOUGH, COVERED = 13, 0.6
#: Bits of the filter for each of the benchmark's windows, which sets those at these shifts of its hash: about one foreign window in 2,000 passes. And windows up to which
#: the benchmark is sent to every task instead of being shuffled.
BITS_EACH, SHIFTS, BROADCAST = 24, (0, 13, 26, 39), 200_000
#: Distinct words that a task keeps.
WORDS = 250_000

#: Words for numbers and units.
NUMBER_WORDS = frozenset("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
UNIT_WORDS = frozenset("mm cm km kg mg lb lbs oz ml mph kph inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons hour hours minute minutes seconds day days week weeks month months year years dollar dollars euro euros cent cents percent degrees watts volts joules newtons".split())
#: Words that begin sentences and are no names.
STARTERS = frozenset("the a an this that these those it its he she they we you i his her their our your my there here what who whom whose which when where why how if in on at by for from to of with and but or so as is are was were do does did can could would should has have had not no all each every some many most after before then while during since because although however thus der die das den dem des ein eine einen einem einer eines er sie es wir ihr ich du was wer wen wem wie wo wann warum welche welcher welches wenn und oder aber in im am an auf aus bei mit nach von vom zu zum zur für durch ist sind war waren hat haben nicht kein keine alle jede jeder jedes dann le la les l un une des du de il elle ils elles on nous vous je tu ce cet cette ces que qui quoi quel quelle quels quelles quand où pourquoi comment combien si et ou mais dans en sur par pour avec est sont a ont ne pas tous chaque el los las uno una unos unas lo yo él ella ellos nosotros este esta estos estas qué quién cuál cuándo dónde cómo cuánto cuántos cuántas si y o pero en con por para es son fue tiene no todos cada".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_QUANTITY = re.compile(r"[+-]?[$€£]?\d[\d.,]*(?:%s)" % "|".join(sorted(UNIT_WORDS, key=len, reverse=True)))
_EDGES = re.compile(r"^[^\w$€£+-]+|[^\w%]+$|^[+-]+(?!\d)|^\W+$")
_ENDS = re.compile(r"[.!?:][\"'”’)\]]*$")
_STOPS, _MARKS = frozenset(".!?:"), frozenset(["", *".!?:,;"])
NONE, PLAIN, NUMBER, QUANTITY, UNIT, CAPITAL = range(6)
#: Forms of a window: as it is, a template, a template in which a sentence begins with a name, either of them with more than SLOTS placeholders.
AS_IS, TEMPLATE, BEGUN, RICH = FORMS = (0, 1, 2, 3)
_RICH_BEGUN = 4
_CODE = {k: np.uint64(xxhash.xxh64_intdigest(f"<{k}>", 11)) for k in (NUMBER, QUANTITY, UNIT, CAPITAL)}
_FACTORS = np.array([xxhash.xxh64_intdigest(str(i), 12) | 1 for i in range(WINDOW)], np.uint64)


def classify(word: str) -> tuple[str, int, bool]:
    """The core of a word, what it is, and whether a sentence ends with it. CAPITAL: a name unless it begins a sentence."""
    # letters alone, or with one mark behind them, need none of the patterns
    letters, mark = (word, "") if word.isalpha() else (word[:-1], word[-1:])
    if mark in _MARKS and letters.isalpha():
        low = letters.lower()
        kind = NUMBER if low in NUMBER_WORDS else UNIT if low in UNIT_WORDS else CAPITAL if letters[0].isupper() and letters[1:].islower() else PLAIN
        return low, kind, mark in _STOPS
    ends = bool(_ENDS.search(word))
    core = word
    while (less := _EDGES.sub("", core)) != core:
        core = less
    low = core.lower()
    if not low:
        return "", NONE, ends
    if _NUMBER.fullmatch(low) or low in NUMBER_WORDS:
        return low, NUMBER, ends
    if low in UNIT_WORDS:
        return low, UNIT, ends
    if low[-1:].isalpha() and _QUANTITY.fullmatch(low):
        return low, QUANTITY, ends
    return low, CAPITAL if core[0].isupper() and core[1:].islower() else PLAIN, ends


class Table(dict):
    """word -> row of its code, kind, whether it ends a sentence and whether it is one of STARTERS; worked out once when it first comes."""

    def __init__(self):
        self.codes: list[int] = []
        self.kinds: list[int] = []
        self.ends: list[bool] = []
        self.starters: list[bool] = []
        self.arrays = (np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(0, bool))

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        core, kind, ends = classify(word.decode("utf-8", "replace"))
        self.codes.append(xxhash.xxh64_intdigest(core, 13))
        self.kinds.append(kind)
        self.ends.append(ends)
        self.starters.append(core in STARTERS)
        return at

    def settled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        done = len(self.arrays[0])
        if done < len(self):
            more = (np.array(self.codes[done:], np.uint64), np.array(self.kinds[done:], np.int8), np.array(self.ends[done:], bool), np.array(self.starters[done:], bool))
            self.arrays = tuple(np.concatenate(x) for x in zip(self.arrays, more, strict=True))
        return self.arrays


_table = Table()


def _forget() -> None:
    global _table
    _table = Table()


keeps(__name__, _forget)


def split_all(texts: list[str]) -> list[tuple[list[bytes], np.ndarray]]:
    """Words and their rows in the task's table."""
    if len(_table) > WORDS:
        _forget()
    words = [t.encode("utf-8", "replace").split() for t in texts]
    return [(w, np.fromiter(map(_table.__getitem__, w), np.int64, len(w))) for w in words]


def tokens_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words that have a core: which they are, their codes as they are, their codes in templates, their kinds, which are slots, and which begin a sentence and may be names."""
    codes, kinds, ends, starters = (a[rows] for a in _table.settled())
    before = np.concatenate(([True], ends[:-1]))
    begun = (kinds == CAPITAL) & before
    slot = (kinds >= NUMBER) & ~begun
    begun &= ~starters
    shaped = codes.copy()
    for k, code in _CODE.items():
        shaped[slot & (kinds == k)] = code
    real = np.flatnonzero(kinds != NONE)
    return real, codes[real], shaped[real], kinds[real], slot[real], begun[real]


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out += codes[k : k + n] * _FACTORS[k]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0x9E3779B97F4A7C15)


def windows_of(rows: np.ndarray, widths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """position, width, form and hash of every window; then which words have cores, their kinds, and which of these are slots (2: where a sentence begins with a name)."""
    real, plain, shaped, kinds, slot, begun = tokens_of(rows)
    filled = np.concatenate(([0], np.cumsum(slot)))
    starts = np.concatenate(([0], np.cumsum(begun)))
    named = np.where(begun, _CODE[CAPITAL], shaped)
    found = []
    for width in widths:
        n = len(real) - width + 1
        if n > 0:
            found.append((np.arange(n), np.full(n, width), np.zeros(n, np.int8), window_hashes(plain, width)))
            slots, names = filled[width:] - filled[:-width], starts[width:] - starts[:-width]
            for form, rich, codes, held, any_held in ((TEMPLATE, RICH, shaped, slots, slots > 0), (BEGUN, _RICH_BEGUN, named, slots + names, names > 0)):
                at = np.flatnonzero(any_held & ((held <= SLOTS) | (held <= width - FIXED)))
                if len(at):
                    found.append((at, np.full(len(at), width), np.where(held[at] <= SLOTS, form, rich).astype(np.int8), window_hashes(codes, width)[at] ^ np.uint64(1)))
    kinds_of = slot + 2 * begun.astype(np.int8)
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.int8), none.astype(np.uint64), real, kinds, kinds_of
    return *(np.concatenate(x) for x in zip(*found, strict=True)), real, kinds, kinds_of


_HIT = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("width", pa.int32()), ("form", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.string())), ("names", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("of_text", pa.int64())])
_HIT_SQL = "id long, pos int, width int, form int, hash long, slots array<string>, names array<int>, n_tokens int, of_text long"


def of_text(id_col: Column, text_col: Column) -> Column:
    """What tells rows with a null id from each other: a hash of the text; 0 for the others."""
    return F.when(id_col.cast("long").isNull(), F.xxhash64(text_col.cast("string"))).otherwise(F.lit(0))


def _hits(ids: list, of_texts: list, texts: list[str], widths: list[int] | None, wanted) -> pa.RecordBatch | None:
    """The windows whose hash is wanted; widths of None: those of an item (a short item is one window). Windows of under LEAST words are whole texts, as they are."""
    out = tuple([] for _ in _HIT)
    for own, of, (words, rows) in zip(ids, of_texts, split_all(texts), strict=True):
        if not len(rows):
            continue
        n = int((_table.settled()[1][rows] != NONE).sum())
        if not n:
            continue
        own_widths = [min(n, WINDOW)] if widths is None else [w for w in widths if w >= LEAST or w == n]
        pos, width, form, hashes, real, kinds, slot = windows_of(rows, own_widths)
        for i in wanted(hashes) if wanted else range(len(hashes)):
            p, w, f = int(pos[i]), int(width[i]), int(form[i])
            if f and w < LEAST:
                continue
            at = [p + k for k in range(w) if slot[p + k] == 1 or (slot[p + k] and f in (BEGUN, _RICH_BEGUN))] if f else []
            names = [k for k in at if kinds[k] == CAPITAL]
            slots = [classify(words[real[k]].decode("utf-8", "replace"))[0] for k in at]
            for column, value in zip(out, (own, p, w, min(f, RICH), int(hashes[i].view(np.int64)), slots, names, len(real), of), strict=True):
                column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _HIT, strict=True)], schema=_HIT) if out[0] else None


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    run = lambda batch: _hits(batch.column(0).to_pylist(), [0] * batch.num_rows, texts_of(batch), None, None)
    return map_batches(id_and_text(benchmark, id_col, text_col), run, _HIT_SQL)


def document_windows(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The windows of docs that pass the filter of the benchmark's hashes: all that meet one, and few others."""
    n = windows.select("hash").distinct().count()
    size = 1 << max(16, (BITS_EACH * n - 1).bit_length())
    at = windows.select(F.explode(F.array(*(F.shiftright("hash", k).bitwiseAND(F.lit(size - 1)) for k in SHIFTS))).alias("at"))
    filled = at.groupBy(F.shiftright("at", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(at & 7 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 8, np.uint8)
    bits[filled["byte"].to_numpy()] = filled["bits"].to_numpy().astype(np.uint8)
    widths = sorted({r["width"] for r in windows.select("width").distinct().collect()})  # WINDOW and what is shorter

    def wanted(hashes: np.ndarray) -> np.ndarray:
        """Which may be the benchmark's: those whose every bit is set."""
        found, left = np.arange(len(hashes)), hashes.view(np.int64)
        for k in SHIFTS:
            at = (left >> k) & (size - 1)
            held = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            found, left = found[held], left[held]
        return found

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        return _hits(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts_of(batch), widths, wanted) if widths else None

    return map_batches(id_and_text(docs, id_col, text_col).select("doc_id", "text", of_text(F.col("doc_id"), F.col("text")).alias("of_text")), run, _HIT_SQL)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", enough: int = ENOUGH, covered: float = COVERED) -> DataFrame:
    """doc_id, item_id, matched_words, item_words, coverage, exact (all of it as it is, without other slot values): each benchmark item that a document has."""
    return _contaminated(docs, benchmark, id_col, text_col, item_col, enough, covered).drop("of_text")


def _contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", enough: int = ENOUGH, covered: float = COVERED) -> DataFrame:
    """What contaminated returns, and of_text."""
    items = stored(benchmark_windows(benchmark, item_col))
    shaped = (F.col("form") > AS_IS).alias("shaped")
    hits = document_windows(docs, items, id_col, text_col).select(F.col("id").alias("doc_id"), "of_text", F.col("pos").alias("at"), "hash", "width", shaped, F.col("form").alias("own_form"), F.col("slots").alias("values"))
    known = items.select(F.col("id").alias("item_id"), "pos", "hash", "width", shaped, "form", "slots", "names", "n_tokens")
    keys = ["hash", "width", "shaped"]
    if items.count() <= BROADCAST:
        met = hits.join(F.broadcast(known), keys)
    else:
        met = hits.join(known, keys)  # a window that many documents have is split by adaptive execution, by its size
    met = met.withColumn("form", F.greatest("form", "own_form"))
    pairs = F.arrays_zip(F.col("slots"), F.col("values"))
    along = met.groupBy("doc_id", "of_text", "item_id", (F.col("at") - F.col("pos")).alias("shift"), "n_tokens").agg(
        *(F.collect_set(F.when(F.col("form") == f, F.struct("pos", "width"))).alias(f"spans_{f}") for f in FORMS),
        *(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("form") == f, pairs)))).alias(f"pairs_{f}") for f in FORMS[1:]),
        F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"),
    )
    spread = lambda spans: F.flatten(F.transform(spans, lambda s: F.sequence(s["pos"], s["pos"] + s["width"] - 1)))
    # a form's windows count if what they and those of the forms before stand for is consistent: a stricter form is never undone by a looser one
    told = F.size(F.array_except(F.array_distinct(F.concat(*(spread(F.col(f"spans_{f}")) for f in FORMS))), "names")) >= F.least(F.lit(WINDOW), "n_tokens") - SLOTS
    known_pairs, words = None, []
    for f in FORMS[1:]:
        known_pairs = F.col(f"pairs_{f}") if known_pairs is None else F.array_union(known_pairs, F.col(f"pairs_{f}"))
        consistent = F.size(known_pairs) == F.size(F.array_distinct(F.transform(known_pairs, lambda p: p["slots"])))
        words.append(F.when(consistent & told if f == RICH else consistent, spread(F.col(f"spans_{f}"))).otherwise(F.array().cast("array<int>")))
    along = along.select("doc_id", "of_text", "item_id", "n_tokens", spread(F.col(f"spans_{AS_IS}")).alias("plain"), F.concat(*words).alias("shaped"))
    found = along.groupBy("doc_id", "of_text", "item_id", "n_tokens").agg(F.array_distinct(F.flatten(F.collect_list("plain"))).alias("plain"), F.array_distinct(F.flatten(F.collect_list("shaped"))).alias("shaped"))
    found = found.select("doc_id", "of_text", "item_id", F.size(F.array_union("plain", "shaped")).alias("matched_words"), F.col("n_tokens").alias("item_words"), F.size("plain").alias("_plain"))
    share = F.col("matched_words") / F.col("item_words")
    return found.filter((F.col("matched_words") >= enough) | (share >= covered)).select("doc_id", "of_text", "item_id", "matched_words", "item_words", share.alias("coverage"), (F.col("_plain") >= F.col("matched_words")).alias("exact"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without any benchmark item; all columns stay."""
    leaks = _contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("of_text").alias("_of_text")).distinct()
    return without_keys(docs, leaks, {"_id": docs[id_col].cast("long"), "_of_text": of_text(docs[id_col], docs[text_col])})
