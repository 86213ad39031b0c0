import re
from collections import Counter

import numpy as np
import sentencepiece

from codestrata.llm import models
from codestrata.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, lang, model):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    ids = [i for w in words for i in model.encode(w)]
    counts = np.array(list(Counter(ids).values())) / max(len(ids), 1)
    per_token = (sum(map(len, words)) - symbols) / max(len(ids), 1)
    fallback = sum(model.is_byte(i) for i in ids) / max(len(ids), 1)
    entropy = float(-(counts * np.log2(counts)).sum()) if len(ids) else 0.0
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    band = Q.BANDS.get(lang, Q.DEFAULT)
    fits = band.chars_per_token[0] <= per_token <= band.chars_per_token[1] and fallback <= band.fallback_share and band.entropy[0] <= entropy <= band.entropy[1]
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed, not failed and fits), (per_token, fallback, entropy)


def test_measures_equal_brute_force(odd_docs, odd_rows):
    model = sentencepiece.SentencePieceProcessor(model_file=models.MODEL)
    symbols = "a## b** $x%y & | <p> ♥日本 naïve\x0bz\x0c " * 20
    docs = odd_docs.unionByName(odd_docs.limit(1).selectExpr("99L as doc_id", f"'{symbols}' as text", "'en' as lang", "source", "n_chars", "id", "n", "kept", "row", "value"))
    rows = [*odd_rows, (99, symbols, "en")]
    want = sorted(((r[0] is None, r[0] or 0), *brute(r[1], r[2], model)) for r in rows)
    got = sorted(
        ((r.doc_id is None, r.doc_id or 0), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept), (r.chars_per_token, r.fallback_share, r.token_entropy))
        for r in Q.measure(docs).collect()
    )
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)


def test_keep_returns_the_rows_that_pass(odd_docs, no_docs):
    kept = Q.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == Q.measure(odd_docs).where("kept").count() > 0
    assert Q.measure(no_docs).count() == 0 == Q.keep(no_docs).count()
