"""Secret scan by dictionary-primed zstandard novelty.

Candidates are the fixed shapes below (the base) and, beyond them, strings of credential characters on either side of a sensitive word
(whatever stands between, line ends too), private keys, and credentials in addresses. Each is measured by its marginal compressed bytes: what zstandard, primed
with a dictionary of public identifiers and code words, needs for the surrounding text with the candidate, less what it needs without. Base candidates are
always reported, with that measure. The others are where they cost at least SHARE of what random characters of the same alphabet and number cost in the same
place: the dictionary and the surroundings know words of prose and code, whatever characters these have, and know no secret. Strings that could not hold
STRENGTH bits even if they were random (short runs of digits, say) are no candidates.

Results: a null or empty text has no findings; spans are in code points of the whole text, end exclusive, ordered by start and then
kind; findings of the method never overlap base ones, and of two of its own that overlap the first stays, the longer one where both start alike. Long texts are
looked through whole, each candidate with AROUND code points on either side. Repeated rows are each scanned; an empty table gives an empty result.
"""

from __future__ import annotations

import builtins
import functools
import importlib
import keyword
import math
import random
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import id_and_text, keeps, map_batches, texts_of

KINDS = ("assign", "access", "hex", "novel")
#: Code points of surrounding text on each side that prime the compressor.
AROUND = 512
#: Share of the cost of random characters, as the mean over RANDOM draws, that a candidate beyond the base has at least; and the bits that it could hold.
SHARE, RANDOM, STRENGTH = 0.8, 3, 56
#: Bits a character below which random ones of any alphabet stay out of reach, so they need not be drawn.
PLAIN = 2.5
#: Characters that such a candidate has at least, and how many may stand between it and the sensitive word.
LEAST, REACH = 12, 50
#: zstandard's level: from here on it looks for matches of three characters, which words are made of.
LEVEL = 19

# The base shapes.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINT = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_SENSITIVE = re.compile(
    r"pass(?:word|wd|phrase|code)|pwd|secret|token|credential|(?:api|private|access|secret|account|encryption|signing)[-_\x20]?key|client[-_\x20]?id|bearer|auth|signature|cookie|session|connection[-_\x20]?string|webhook|salt|nonce",
    re.IGNORECASE | re.ASCII,
)
#: Credential-like strings; = is part of one at its end only.
_CREDENTIAL = re.compile(r"[A-Za-z0-9+/_~][A-Za-z0-9+/_.~-]{%d,}[A-Za-z0-9+/_~-]={0,2}" % (LEAST - 2))
#: What such strings are in addresses, where / and . part words.
_PART = re.compile(r"[A-Za-z0-9+_~-]{%d,}={0,2}" % LEAST)
_ADDRESS = re.compile(r"://[^\s\"'<>]*\Z")
_SENSITIVE_HINT = ("pass", "pwd", "secret", "token", "key", "credential", "client", "bearer", "auth", "signature", "cookie", "session", "connection", "webhook", "salt", "nonce")

#: Code words that the rule below does not give.
_CODE_WORDS = """
abstract assert async await boolean break byte case catch char class const continue default delete double else enum export extends false final
finally float for from function global goto if implements import include inline instanceof int interface lambda let long module namespace native
new none null object operator override package private protected public raise register return self short signed sizeof static string struct super
switch template this throw throws true try typedef undefined union unsigned using virtual void volatile while yield
application authorization bearer button callback client config configuration connection console container content context controller cookie
counter create database default description directory document element encoding endpoint environment error event example exception execute
factory filename handler header height hostname identifier index initialize instance iterator length listener localhost location logger manager
message method middleware number option parameter parser password pathname pattern payload permission placeholder pointer port prefix process
property protocol provider query queue reader reference register repository request resource response result router schema secret select
selector sequence serializer server service session settings signature source status storage stream string subscribe suffix target template
test_ thread timeout timestamp token transaction transform undefined update upload user_id username validate value variable version warning
width window wrapper your_ your-api-key-here changeme example.com http://www. https:// .html .json .yaml .properties node_modules index.js
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX 1234567890 ----------------
""".strip()


#: Modules whose public names are the identifiers of the dictionary.
_MODULES = "argparse ast asyncio base64 collections configparser datetime email.message hashlib hmac http.client http.cookies inspect json logging os pathlib random re secrets shutil signal smtplib socket sqlite3 ssl statistics string subprocess sys tarfile tempfile threading typing unittest urllib.parse urllib.request xml.etree.ElementTree zipfile".split()


def identifiers() -> str:
    """The words and names of the standard library's interfaces, in order, and code words: what primes the compressor."""
    names = {*keyword.kwlist, *dir(builtins)}
    for module in map(importlib.import_module, _MODULES):
        for name in dir(module):
            names.add(name)
            if isinstance(held := getattr(module, name), type):
                names.update(vars(held))
    names = sorted(n for n in names if len(n) > 3 and not n.startswith("__"))
    words = sorted({w.lower() for n in names for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", n) if len(w) > 3})
    return "\n".join((" ".join(words), " ".join(names), _CODE_WORDS))


IDENTIFIERS = identifiers()


@functools.lru_cache(maxsize=4)
def _compressor(dictionary: str) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)


keeps(__name__, _compressor.cache_clear)


def marginal_sizes(text: str, start: int, end: int, others: list[str], dictionary: str = IDENTIFIERS) -> list[int]:
    """What text[start:end], and each of the others in its place, adds to the compressed size of its surroundings."""
    press = _compressor(dictionary).compress
    around = (text[end : end + AROUND] + text[max(0, start - AROUND) : start]).encode("utf-8", "replace")
    plain = len(press(around))
    return [len(press(around + x.encode("utf-8", "replace"))) - plain for x in (text[start:end], *others)]


def marginal_bytes(text: str, start: int, end: int, dictionary: str = IDENTIFIERS) -> int:
    """What text[start:end] adds to the compressed size of its surroundings."""
    return marginal_sizes(text, start, end, [], dictionary)[0]


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def alphabet(word: str) -> str:
    """The characters that a random string of this kind would be drawn from."""
    for hexadecimal in (_DIGITS + "abcdef", _DIGITS + "ABCDEF"):
        if set(word) <= set(hexadecimal) and not word.isdigit():
            return hexadecimal
    held = set(word)
    return "".join(part for part in (_LOWER, _UPPER, _DIGITS) if held & set(part)) + "".join(sorted(held - set(_LOWER + _UPPER + _DIGITS)))


def random_like(word: str, n: int = RANDOM) -> list[str]:
    """n strings as long, of characters drawn from its alphabet; the same for the same length and alphabet."""
    letters = alphabet(word)
    return ["".join(random.Random(f"{i}:{len(word)}:{letters}").choices(letters, k=len(word))) for i in range(n)]


def novelty(text: str, start: int, end: int, share: float = SHARE, dictionary: str = IDENTIFIERS) -> int | None:
    """The marginal bytes of a candidate that is novel, or None."""
    word = text[start:end]
    if len(word) * math.log2(len(alphabet(word))) < STRENGTH:
        return None
    cost = marginal_bytes(text, start, end, dictionary)
    if cost * 8 < PLAIN * len(word):
        return None
    drawn = marginal_sizes(text, start, end, random_like(word), dictionary)[1:]
    return cost if cost >= share * sum(drawn) / len(drawn) else None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed shapes, leftmost and non-overlapping within each kind."""
    found = []
    low = text.lower() if not text.isascii() else text.casefold()
    if any(h in low for h in _ASSIGN_HINT):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


#: Where else sensitive strings stand, each with what a text must hold for it: private keys, and credentials in addresses.
_PLACES = (
    ("PRIVATE KEY", re.compile(r"PRIVATE KEY(?: BLOCK)?-----\s{1,8}(?:[A-Za-z][A-Za-z-]{0,40}:[^\n]{0,1000}\n\s{0,8})*([A-Za-z0-9+/=][A-Za-z0-9+/=\s]{38,}[A-Za-z0-9+/=])\s{0,8}-----END")),
    ("://", re.compile(r"://[^\s:/@]+:([^\s:/@]{8,})@")),
)


def near_sensitive(text: str) -> list[tuple[int, int]]:
    """The credential-like strings that a sensitive word stands within REACH of, on either side; the word may not be in the string itself."""
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    out, k = [], 0
    for m in _CREDENTIAL.finditer(text) if words else ():
        s, e = m.span()
        while k < len(words) and words[k][1] < s - REACH:
            k += 1
        at = k
        while at < len(words) and words[at][0] <= e + REACH:
            if words[at][1] <= s or words[at][0] >= e:
                out += [p.span() for p in _PART.finditer(text, s, e)] if _ADDRESS.search(text, max(0, s - AROUND), s + 2) else [(s, e)]
                break
            at += 1
    return out


def novel_spans(text: str, base: list[tuple[int, int, str]], share: float = SHARE, dictionary: str = IDENTIFIERS) -> list[tuple[int, int, str, int]]:
    """Strings in sensitive places that neither the dictionary nor the surroundings know."""
    low = text.lower()
    spans = near_sensitive(text) if any(h in low for h in _SENSITIVE_HINT) else []
    for hint, pattern in _PLACES:
        if hint in text:
            spans += [m.span(1) for m in pattern.finditer(text)]
    out, taken, end, k = [], sorted((s, e) for s, e, _ in base), 0, 0
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s < end or any(a < e and s < z for a, z in taken[k : k + 8]):
            continue
        if (cost := novelty(text, s, e, share, dictionary)) is not None:
            out.append((s, e, "novel", cost))
            end = e
    return out


def findings(text: str, share: float = SHARE, dictionary: str = IDENTIFIERS) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, marginal bytes) of every secret in a text, by start and then kind."""
    base = base_spans(text)
    found = [(s, e, k, marginal_bytes(text, s, e, dictionary)) for s, e, k in base] + novel_spans(text, base, share, dictionary)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


_FOUND = "findings array<struct<kind:string,start:int,end:int,marginal_bytes:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("marginal_bytes", pa.int32())]))


def _as_structs(found: list[tuple[int, int, str, int]]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e, "marginal_bytes": c} for s, e, k, c in found]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, dictionary: str = IDENTIFIERS) -> DataFrame:
    """doc_id, findings: one row per document, clean ones with an empty list."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_as_structs(findings(t, share, dictionary)) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _ARROW)], names=["doc_id", "findings"])

    return map_batches(id_and_text(docs, id_col, text_col), run, f"doc_id long, {_FOUND}")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<secret>", share: float = SHARE, dictionary: str = IDENTIFIERS) -> DataFrame:
    """docs with every secret replaced by `mark`; all rows and columns stay. Overlapping spans are replaced as one; a null text stays null; n_chars, where there is such a column, is counted anew."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None else _replaced(t, findings(t, share, dictionary), mark) for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    out = map_batches(docs, run, docs.schema)
    if "n_chars" in docs.columns and text_col in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out


def _replaced(text: str, found: list[tuple[int, int, str, int]], mark: str) -> str:
    out, at = [], 0
    for s, e, *_ in found:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if found else text


def joined(found: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
