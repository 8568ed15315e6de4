"""Whole-text statistics of documents, counted with numpy over Arrow batches, and ratios of them as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import U64, gram_starts, grams, mapped, mix, pieces, record, span_hashes, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits",
          "n_stops", "n_shouts", "n_pipes", "n_punct", "n_long", "n_short")
#: Names of the ratios, in order.
FEATURES = ("log_words", "word_len", "symbols", "dup_lines", "repeats", "line_words", "distinct", "upper", "digits",
            "stops", "shouts", "pipes", "punct", "long", "short")
_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])
DDL = ", ".join(["doc_id bigint", *(f"{c} bigint" for c in COUNTS)])

_CLASS = np.zeros(256, np.uint8)  # 0: any other first byte of a character
_CLASS[0x80:0xC0] = 1
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
for _c in b"#*$%&<>":
    _CLASS[_c] = 5
_CLASS[ord("|")] = 6
for _c in b".?":
    _CLASS[_c] = 7
_CLASS[ord("!")] = 8
for _c in b",;:()\"'-/":
    _CLASS[_c] = 9
_KINDS = 10


def _same(keys: np.ndarray, doc: np.ndarray, keep) -> np.ndarray:
    """Which keys occur before (keep='first') or elsewhere (keep=False) in their document."""
    return pd.Series(mix(keys + doc.astype(U64) * U64(0xA0761D6478BD642F))).duplicated(keep=keep).to_numpy()


def measure(arr: pa.Array) -> list[np.ndarray]:
    """The counts of each text, in the order of COUNTS; a null text counts as an empty one.

    Words are runs of non-white-space; symbols are ``#*$%&|<>``; a line counts if it has a word, and is a
    duplicate if an earlier line equals it; repeated words lie in a 5-word window that the text has twice.
    """
    w = words(arr)
    n = len(w.first) - 1
    size = np.diff(w.off)
    kinds = np.bincount(np.repeat(np.arange(n, dtype=np.int64) * _KINDS, size) + _CLASS[w.data], minlength=n * _KINDS).reshape(n, _KINDS)
    doc, h = w.doc(), w.hashes()
    per = lambda at: np.bincount(at, minlength=n)
    # lines: spans between newlines and document ends
    nl = np.flatnonzero(w.data == 0x0A)
    lo = np.unique(np.concatenate([w.off[:-1], nl + 1]))
    lo = lo[lo < len(w.data)]
    hi = np.concatenate([lo[1:], [len(w.data)]])[: len(lo)]
    ldoc = np.searchsorted(w.off, lo, side="right") - 1
    hi = np.where(w.data[hi - 1] == 0x0A, hi - 1, hi) if len(lo) else hi
    has = np.searchsorted(w.start, hi) > np.searchsorted(w.start, lo) if len(lo) else np.zeros(0, bool)
    lo, hi, ldoc = lo[has], hi[has], ldoc[has]
    line = span_hashes(w.data, lo, hi)
    dup = per(ldoc[_same(line, ldoc, "first")])
    # 5-word windows that occur twice
    at = gram_starts(w.first, 5)
    twice = at[_same(grams(h, 5)[at], doc[at], False)] if len(at) else at
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 5, -1)
    chars = w.end - w.start
    return [
        w.counts, kinds.sum(1) - kinds[:, 1] - kinds[:, 2], kinds[:, 5] + kinds[:, 6], dup, per(doc[np.cumsum(edge[:-1]) > 0]),
        per(ldoc), w.counts - per(doc[_same(h, doc, "first")]), kinds[:, 3], kinds[:, 4], kinds[:, 7], kinds[:, 8], kinds[:, 6], kinds[:, 9],
        per(doc[chars > 20]), per(doc[chars <= 2]),
    ]


def ratio_matrix(counts: list[np.ndarray]) -> np.ndarray:
    """``ratios`` of the counts that ``measure`` gives, a row a text, in the order of FEATURES."""
    c = {k: v.astype(float) for k, v in zip(COUNTS, counts)}
    over = lambda a, b: c[a] / np.maximum(c[b], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), over("word_chars", "n_words"), over("n_symbols", "n_words"), over("n_dup_lines", "n_lines"), over("n_repeat_words", "n_words"),
        np.log1p(over("n_words", "n_lines")), over("n_distinct", "n_words"), over("n_upper", "word_chars"), over("n_digits", "word_chars"),
        over("n_stops", "n_words"), over("n_shouts", "n_words"), over("n_pipes", "n_words"), over("n_punct", "n_words"), over("n_long", "n_words"), over("n_short", "n_words"),
    ])


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS, one row a document, whatever its id; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text"):
                yield record(_OUT, p.column(0), *measure(p.column(1)))

    return mapped(docs, ["doc_id", "text"], run, DDL)


def ratios() -> dict[str, Column]:
    """Named features of a row of COUNTS, each defined for empty texts too."""
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "log_words": F.log1p("n_words"),
        "word_len": over("word_chars", "n_words"),
        "symbols": over("n_symbols", "n_words"),
        "dup_lines": over("n_dup_lines", "n_lines"),
        "repeats": over("n_repeat_words", "n_words"),
        "line_words": F.log1p(over("n_words", "n_lines")),
        "distinct": over("n_distinct", "n_words"),
        "upper": over("n_upper", "word_chars"),
        "digits": over("n_digits", "word_chars"),
        "stops": over("n_stops", "n_words"),
        "shouts": over("n_shouts", "n_words"),
        "pipes": over("n_pipes", "n_words"),
        "punct": over("n_punct", "n_words"),
        "long": over("n_long", "n_words"),
        "short": over("n_short", "n_words"),
    }
