"""Token counts by section, from one encoding of the whole document.

Each text is encoded once. The byte lengths of its ids give each token's character
span; a character that several tokens share belongs to the first of them. Token
spans are joined with the sections' intervals, both sorted. A token that crosses a
boundary goes whole to the section that holds most of its characters, to the first
of them if equal; one without a character of its own goes where the character it
completes is. A token outside all sections is counted under section -1.

``sections`` maps a text to sorted, disjoint (start, end) character offsets; the
default are its lines, each with its line feed. Null text counts as empty and has
one section of no tokens. Rows that repeat a doc_id are counted each by itself.
Other columns are ignored. Texts are read whole; no row is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import encoder

RESULT = "doc_id long, section long, start long, n_chars long, n_tokens long, n_boundary long"


def lines(text: str) -> np.ndarray:
    """(start, end) of each line, with its line feed."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    starts = np.concatenate([[0], ends])
    ends = np.concatenate([ends, [len(text)]])
    keep = (starts < ends) | (np.arange(len(starts)) == 0)
    return np.stack([starts[keep], ends[keep]], 1)


def spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of tokens of the given byte lengths."""
    data = np.frombuffer(text.encode(), np.uint8)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edges = chars[np.concatenate([[0], np.cumsum(lengths)])]
    return edges[:-1], edges[1:]


def allocate(start: np.ndarray, end: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none), and whether it crosses a boundary."""
    if not len(sections):
        return np.full(len(start), -1), np.zeros(len(start), bool)
    at = np.where(end > start, start, np.maximum(start - 1, 0))  # one without a character: where the one before is
    to = np.maximum(end, at + 1)
    first = np.searchsorted(sections[:, 1], at, side="right")
    last = np.searchsorted(sections[:, 0], to - 1, side="right") - 1
    inside = np.minimum(first, len(sections) - 1)
    best = np.where(first <= last, first, -1)
    crossing = (last > first) | ((first <= last) & ((sections[inside, 0] > at) | (sections[np.maximum(np.minimum(last, len(sections) - 1), 0), 1] < to)))
    for k in np.flatnonzero(last > first):  # few: tokens over several sections
        s = sections[first[k] : last[k] + 1]
        best[k] = first[k] + int(np.argmax(np.minimum(s[:, 1], to[k]) - np.maximum(s[:, 0], at[k])))
    return best, crossing


def count(docs: DataFrame, sections=lines, model: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, section, start, n_chars, n_tokens, n_boundary: one row a section."""

    def run(batches):
        enc = encoder(model, ranks)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                parts = sections(text)
                where, crossing = allocate(*spans(text, enc.lengths[enc.ids(text)]), parts)
                n = np.bincount(where + 1, minlength=len(parts) + 1)
                edge = np.bincount(where[crossing] + 1, minlength=len(parts) + 1)
                rows = np.stack([np.arange(-1, len(parts)), np.append(0, parts[:, 0]), np.append(0, parts[:, 1] - parts[:, 0]), n, edge], 1)
                out.append((doc, rows[0 if n[0] else 1 :]))
            if out:
                ids = pa.array([d for d, r in out for _ in range(len(r))], pa.int64())
                table = np.concatenate([r for _, r in out]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(5))], names=["doc_id", "section", "start", "n_chars", "n_tokens", "n_boundary"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)
