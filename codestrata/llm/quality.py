"""Quality rules on what a public tokeniser makes of a text.

Base rules count words, symbols and repetition. The rules of this operator measure
the vocabulary's fertility: characters (other than symbols) per token, the share of
tokens that are bare bytes (byte fallback), and the entropy of the token distribution.
Each has a band per language, and a text outside any band is rejected.

Defined results: a null text counts as empty; an empty text has no words and fails
the base rules; an unknown or null language takes the band ``DEFAULT``; repeated rows
are judged one by one. A text is measured whole, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import words as W
from codestrata.llm.models import MODEL, model_bytes

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words


@dataclass(frozen=True)
class Band:
    """What a kept text may measure. Entropy is in bits per token."""

    chars_per_token: tuple[float, float]
    fallback_share: float
    entropy: tuple[float, float]


# Labelled prose measures 1.70 characters per token at least and 5.5 bits at least; labelled junk, whose
# symbols cost tokens and give no characters, mostly less. The bands stay outside all labelled prose.
DEFAULT = Band((0.8, 8.0), 0.35, (2.5, 13.0))
BANDS: dict[str, Band] = {
    "en": Band((1.78, 6.0), 0.05, (4.9, 13.0)),
    "de": Band((1.80, 6.0), 0.05, (4.9, 13.0)),
    "fr": Band((1.65, 6.0), 0.05, (4.9, 13.0)),
    "es": Band((1.65, 6.0), 0.05, (4.9, 13.0)),
}
COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, chars_per_token double, fallback_share double, token_entropy double"
)
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def measure(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", model: str = MODEL, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """One row per document: its id and the columns named in ``COLUMNS``."""
    judge = _Judge(model_bytes(docs.sparkSession, model), dict(bands))
    wanted = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge(batch.column("text"), batch.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *found.values()], names=[id, *found])

    return wanted.mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, {COLUMNS}")


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", model: str = MODEL, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """The documents that pass, with their own columns only."""
    judge = _Judge(model_bytes(docs.sparkSession, model), dict(bands))
    at_text, at_lang = docs.columns.index(text), docs.columns.index(lang)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(judge(batch.column(at_text), batch.column(at_lang).to_pylist())["kept"])

    return docs.mapInArrow(run, docs.schema)


class _Judge:
    """Measures columns of texts; the vocabulary is loaded once per task."""

    def __init__(self, model: bytes, bands: dict[str, Band]):
        self.model, self.bands, self._pieces = model, bands, None

    def __getstate__(self) -> dict:
        return {"model": self.model, "bands": self.bands, "_pieces": None}

    def __call__(self, column: pa.Array, langs: list[str | None]) -> dict[str, pa.Array]:
        self._pieces = self._pieces or _Pieces(self.model)
        rows = [t or b"" for t in W.texts(column)]
        parts = [_base(run) | self._pieces.fertility(run) for _, run in W.blocks(rows)]
        m = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_fallback", "entropy")}
        tokens = np.maximum(m["n_tokens"], 1)
        per_token, fallback = (m["word_chars"] - m["n_symbols"]) / tokens, m["n_fallback"] / tokens
        failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
        fits = np.array([_fits(self.bands.get(g or "", DEFAULT), *v) for g, *v in zip(langs, per_token, fallback, m["entropy"], strict=True)], dtype=bool)
        counts = [pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        rest = [pa.array(failed), pa.array(~failed & fits), pa.array(m["n_tokens"].astype(np.int64)), pa.array(per_token), pa.array(fallback), pa.array(m["entropy"].astype(float))]
        return dict(zip(_NAMES, counts + rest, strict=True))


def _fits(band: Band, per_token: float, fallback: float, entropy: float) -> bool:
    (low, high), (least, most) = band.chars_per_token, band.entropy
    return low <= per_token <= high and fallback <= band.fallback_share and least <= entropy <= most


def _base(rows: list[bytes]) -> dict[str, np.ndarray]:
    out = {k: np.zeros(len(rows), dtype=np.int64) for k in ("word_chars", "n_symbols", "n_dup_lines")}
    for at, data in enumerate(rows):
        a = np.frombuffer(data, dtype=np.uint8)
        spaces = (a == 32) | ((a >= 9) & (a <= 13))
        out["word_chars"][at] = np.count_nonzero((a & 0xC0) != 0x80) - np.count_nonzero(spaces)
        out["n_symbols"][at] = sum(map(data.count, (SYMBOLS[k : k + 1] for k in range(len(SYMBOLS)))))
        lines = [x for x in data.split(b"\n") if x.strip()]
        out["n_dup_lines"][at] = len(lines) - len(set(lines))
    return out


class _Pieces:
    """Tokens of single words, remembered between texts up to a bound."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.encoder.is_byte(i) for i in range(self.encoder.vocab_size())])
        self._forget()

    def _forget(self) -> None:
        self.words = W.Vocabulary()
        self.tokens, self.ends = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def _learn(self) -> None:
        new = list(self.words)[len(self.ends) - 1 :]
        if not new:
            return
        made = self.encoder.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(list(map(len, made)), dtype=np.int64)])
        self.tokens = np.concatenate([self.tokens, np.fromiter((t for ids in made for t in ids), dtype=np.int32)])

    def fertility(self, rows: list[bytes]) -> dict[str, np.ndarray]:
        if len(self.words) > W.VOCABULARY:
            self._forget()
        split = [r.split() for r in rows]
        sizes = np.array(list(map(len, split)))
        at = np.fromiter((self.words[w] for ws in split for w in ws), dtype=np.int64, count=int(sizes.sum()))
        doc = np.repeat(np.arange(len(rows)), sizes)
        self._learn()
        lengths = np.diff(self.ends)[at]
        token = self.tokens[np.repeat(self.ends[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(at) else at, lengths) + np.arange(lengths.sum())]
        of = np.repeat(doc, lengths)
        key, count = np.unique(of * len(self.is_byte) + token, return_counts=True)
        n = np.bincount(of, minlength=len(rows))
        owner = key // len(self.is_byte)
        share = count / n[owner]
        return {
            "n_words": sizes, "n_tokens": n, "n_fallback": np.bincount(of, weights=self.is_byte[token], minlength=len(rows)),
            "entropy": np.bincount(owner, weights=-share * np.log2(share), minlength=len(rows)), "n_repeat_words": _repeated(self.words.hashes()[at], doc, len(rows)),
        }


def _repeated(hashes: np.ndarray, doc: np.ndarray, n: int, width: int = 3) -> np.ndarray:
    """Words inside windows of ``width`` words that occur twice or more in their own text."""
    windows = W.window_hashes(hashes, width)
    if not len(windows):
        return np.zeros(n, dtype=np.int64)
    inside = doc[: len(windows)] == doc[width - 1 :]
    keys = W.mix(windows ^ W.mix(doc[: len(windows)].astype(np.uint64) + np.uint64(1)))
    _, back, count = np.unique(np.where(inside, keys, 0), return_inverse=True, return_counts=True)
    twice = inside & (count[back] > 1)
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(width):
        covered[k : k + len(windows)] |= twice
    return np.bincount(doc[covered], minlength=n)
