"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks (``html_leaves``). Each block is a vector:
the tags, classes, ids and roles on its path, hashed to PATH fields; its words, hashed to
WORDS fields; and a few figures such as its length and the share of link text. A bidirectional
LSTM (``block_lstm``) reads the whole page and labels every block with all of the page as
context. The text is that of the blocks labelled main, in page order, joined by an empty line.

The model is trained once a process, on TRAINING_PAGES labelled pages whose layouts are drawn from a fixed seed
(``page_layouts``); it doesn't depend on the table, and its size is fixed. Pages are then labelled where
they are: no shuffle, and nothing but the model leaves the driver.

Null and empty pages, and pages without main text, give an empty text. Line breaks and
inline elements stay within a block; white space is that of Unicode. Very long pages are read
whole (a page of over BLOCKS_AT_ONCE blocks is labelled alone). Repeated rows are rows of their own. Other columns
are kept, whatever their names; columns named as the results are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import block_lstm, page_layouts
from .common import bounded_batches, slices, utf8, word_hashes
from .html_leaves import PATH, Block, leaves

WORDS, FIGURES = 512, 9
TRAINING_PAGES, EPOCHS, SEED = 1500, 6, 13
BLOCKS_AT_ONCE = 4096


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """One row a block, of all pages in order."""
    blocks = [b for page in pages for b in page]
    out = np.zeros((len(blocks), PATH + WORDS + FIGURES), np.float32)
    if not blocks:
        return out
    out[np.repeat(np.arange(len(blocks)), [len(b.path) for b in blocks]), [k for b in blocks for k in b.path]] = 1
    words, first = word_hashes(*utf8(pa.array([b.text for b in blocks])))
    n_words = np.diff(first)
    row = np.repeat(np.arange(len(blocks)), n_words)
    counts = np.bincount(row * WORDS + (words >> np.uint64(40)).astype(np.int64) % WORDS, minlength=len(blocks) * WORDS).reshape(-1, WORDS)
    out[:, PATH : PATH + WORDS] = counts / np.maximum(np.sqrt((counts.astype(np.float64) ** 2).sum(1)), 1)[:, None]
    chars = np.array([len(b.text) for b in blocks])
    place = np.concatenate([np.arange(len(p)) / max(1, len(p) - 1) for p in pages])
    size = np.concatenate([np.full(len(p), np.log1p(len(p))) for p in pages])
    figures = [
        np.log1p(n_words) / 3, np.log1p(chars) / 5, np.minimum(1, np.array([b.link_chars for b in blocks]) / chars), [b.text[-1] in ".!?…:;\"”»" for b in blocks],
        np.array([sum(map(b.text.count, ".,;")) for b in blocks]) / np.maximum(n_words, 1), np.array([b.text[:1].isupper() for b in blocks]), np.array([b.depth for b in blocks]) / 10, place, size / 5,
    ]
    out[:, PATH + WORDS :] = np.stack([np.asarray(f, np.float32) for f in figures], 1)
    return out


def labelled(html: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of pages whose elements carry the mark."""
    pages = [page for page in (leaves(h, page_layouts.MARK) for h in html) if page]
    return [(vectors([page]).astype(np.float16), np.array([b.mark == "1" for b in page], np.float32)) for page in pages]


@functools.lru_cache(maxsize=2)
def model(n_pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    return block_lstm.train(labelled(page_layouts.pages(n_pages, seed)), epochs, seed)


def label(weights: dict[str, np.ndarray], pages: list[list[Block]]) -> list[np.ndarray]:
    """The probability of each block of each page to be main text."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order, at = sorted(range(len(pages)), key=lambda k: len(pages[k])), 0
    while at < len(order):
        group, most = [order[at]], len(pages[order[at]])
        at += 1
        while at < len(order) and (len(group) + 1) * len(pages[order[at]]) <= max(most, BLOCKS_AT_ONCE):
            group.append(order[at])
            at += 1
        rows = vectors([pages[k] for k in group])
        ends = np.cumsum([len(pages[k]) for k in group])
        if not ends[-1]:
            continue
        x, lengths = block_lstm.padded(np.split(rows, ends[:-1]))
        for k, p in zip(group, block_lstm.sigmoid(block_lstm.logits(weights, x, lengths)), strict=True):
            out[k] = p[: len(pages[k])]
    return out


def texts(weights: dict[str, np.ndarray], html: list[str | None]) -> list[str]:
    pages = [leaves(h) for h in html]
    return ["\n\n".join(b.text for b, p in zip(page, chances, strict=True) if p > 0.5) for page, chances in zip(pages, label(weights, pages), strict=True)]


def extract(pages: DataFrame, html: str = "html", weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """All columns of ``pages`` with ``text`` and ``n_chars`` (code points of text)."""
    shared = pages.sparkSession.sparkContext.broadcast(weights or model())
    own = [c for c in pages.columns if c not in ("text", "n_chars")]
    nested = pages.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(f"`{html}`").alias("html"))

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "html"):
                found = texts(shared.value, piece.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["row", "text", "n_chars"])

    done = bounded_batches(nested).mapInArrow(run, T.StructType([nested.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
    return done.select("row.*", "text", "n_chars")
