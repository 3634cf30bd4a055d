"""Any text at all: the text operators against their statements."""

from hypothesis import example, given, settings
from hypothesis import strategies as st
from test_corpus_operators import brute_fingerprint
from test_text_operators import brute_base, brute_quality
from tokenizers import Tokenizer

from edgeloom.llm import bpe, common, fertility, langid, licenses, rule_ensemble, secret_scan, simhash, templates, toxicity

ANY = st.text(st.characters(exclude_categories=["Cs"]), max_size=80)
NEAR = st.text(st.sampled_from("aAbé  \t\n\x0b\x1c\x85\xa0'.#:=\"-09sSkKſKAKIAtoken"), max_size=120)
TEXT = ANY | NEAR
TOKENIZER = Tokenizer.from_file(common.tokenizer_path(bpe.VOCABULARY))
WORDS = bpe.words_of(common.tokenizer_path(bpe.VOCABULARY))
PIECES = fertility.pieces_of(common.tokenizer_path(fertility.VOCABULARY))


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT | TEXT.map(lambda t: f"{t}<|endoftext|>{t}"), max_size=4))
@example(["  　a", "\x1f \x1f", "'ſ", "İ'S"])
def test_bpe(texts):
    ids, counts = WORDS.encode(texts)
    assert ids.tolist() == [i for t in texts for i in TOKENIZER.encode(t, add_special_tokens=False).ids]
    assert counts.sum() == len(ids)


@settings(max_examples=400, deadline=None)
@given(TEXT)
@example("secret:token = \"abcdefgh\"")
@example("toKen=abcdef ſecret=abcdef")
def test_base_spans(text):
    assert [f"{k}:{s}:{e}" for s, e, k in secret_scan.base_spans(text)] == brute_base(text)
    found = secret_scan.findings(text)
    assert [x[0] for x in found] == sorted(x[0] for x in found) and all(0 <= s < e <= len(text) for s, e, *_ in found)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(0, 3))
def test_quality_counts(text, more):
    text = f"{text}\n" * more + text
    assert fertility.measure([text], PIECES, fertility.BANDS)[0][:6] == brute_quality(text)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_fingerprints(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_nothing_breaks(text):
    assert len(rule_ensemble.statistics_of(text)) == len(rule_ensemble.STATISTICS)
    assert len(langid.ngrams(text)) == len(set(langid.ngrams(text).tolist()))
    assert langid.has_letter(text) == any(map(str.isalpha, text))
    assert toxicity.terms(text)[1] >= 0
    licenses.licenses_of(f"licensed {text} under the license")
    for words, rows in templates.split_all([text]):
        assert len(words) == len(rows)
        templates.windows_of(rows, [8])
