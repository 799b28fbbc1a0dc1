"""Quality rules: line-first cleaning.

Every line of a text is judged by itself; lines that fail are removed; a document
that loses too much of its text, or that fails a rule on the whole text, is
rejected. A line fails if it

* has no word (blank lines only leave, they count as no loss),
* reads as navigation: at least ``nav_separators`` separators (| > » · •) anywhere,
  or short (``nav_words`` words at most), without an end mark, and without a
  word of lower-case letters alone,
* has ``phrase_words`` words at most and holds a boilerplate phrase (BOILERPLATE,
  compared in lower case, with no letter or digit of ASCII on either side),
* has a share of symbols (# * $ % & | < >) by characters above ``max_symbols``,
* equals an earlier line of the text (of ``min_dup_words`` words at least),
* lacks an end mark (END) and has fewer than ``min_words`` words.

Whole-text counts are exact: words are runs of anything but ASCII white space.
Null text counts as empty: no words, hence base_failed. Rows that repeat a doc_id,
or have none, are judged each by itself. Texts, very long ones too, are read whole; no row is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# Marks that end a sentence (a closing quote or bracket may follow).
END = ".!?…:;。！？"
CLOSING = "\"'”’»)]"
# Phrases of site furniture.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "follow us on", "lorem ipsum",
    "powered by", "privacy policy", "read more", "sign in", "sign up", "skip to content", "subscribe to our", "terms of service", "terms of use",
    "this site uses cookies", "use of cookies",
)

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_lines_removed long, chars_removed long"

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_symbols = re.compile(r"[#*$%&|<>]").findall
_separators = re.compile(r"[|>»·•]").findall
PHRASE = "(^|[^a-z0-9])(" + "|".join(BOILERPLATE) + ")($|[^a-z0-9])"
_boilerplate = re.compile(PHRASE).search


def repeated_words(words: list[str], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more, the first included."""
    windows = list(zip(*(words[k:] for k in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + size - max(at, end)
            end = at + size
    return covered


def line_fails(line: str, words: list[str], seen: set[str], nav_separators: int, nav_words: int, max_symbols: float, min_dup_words: int, min_words: int, phrase_words: int) -> bool:
    if len(_separators(line)) >= nav_separators:
        return True
    if len(_symbols(line)) > max_symbols * len(line):
        return True
    if len(words) >= min_dup_words and line in seen:
        return True
    ended = words[-1].rstrip(CLOSING)[-1:] in END and words[-1].rstrip(CLOSING) != ""
    if not ended and (len(words) < min_words or len(words) <= nav_words and not any(w.islower() for w in words)):
        return True
    return len(words) <= phrase_words and _boilerplate(line.lower()) is not None


def judge(text: str, max_loss: float = 0.5, **rules) -> tuple[tuple, str]:
    """The result columns for one text, and the text without the lines that fail."""
    rules = {"nav_separators": 2, "nav_words": 8, "max_symbols": 0.1, "min_dup_words": 3, "min_words": 3, "phrase_words": 12} | rules
    words = _words(text)
    kept, seen, n_dup, n_lines, removed, lost = [], set(), 0, 0, 0, 0
    for line in text.split("\n"):
        own = _words(line)
        if not own:
            kept.append(line)
            continue
        n_lines += 1
        n_dup += line in seen
        if line_fails(line, own, seen, **rules):
            removed += 1
            lost += sum(map(len, own))
        else:
            kept.append(line)
        seen.add(line)
    chars = sum(map(len, words))
    n_repeat = repeated_words(words)
    failed = len(words) < 50 or 100 * n_repeat > 50 * len(words)
    return (len(words), chars, len(_symbols(text)), n_dup, n_repeat, failed, not failed and lost <= max_loss * chars, n_lines, removed, lost), "\n".join(kept) if removed else text


def _column(values: list, name: str) -> pa.Array:
    return pa.array(values, pa.bool_() if name in ("base_failed", "kept") else pa.int64())


NAMES = [x.split()[0] for x in RESULT.split(", ")]


def assess(docs: DataFrame, **how) -> DataFrame:
    """doc_id and the result columns, one row a document."""

    def run(batches):
        for batch in batches:
            rows = [judge(text or "", **how)[0] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(_column([r[k] for r in rows], name) for k, name in enumerate(NAMES))], names=["doc_id", *NAMES])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {RESULT}")


def clean(docs: DataFrame, **how) -> DataFrame:
    """The documents kept, with all their columns (whatever their names); text without the lines that fail."""
    rest = F.struct(F.lit(None).cast("int").alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"))
    nested = docs.select(rest.alias("rest"), "text")

    def run(batches):
        for batch in batches:
            judged = [judge(text or "", **how) for text in batch.column(1).to_pylist()]
            texts = pa.array([text for _, text in judged], batch.schema.field(1).type)
            kept = pa.array([row[NAMES.index("kept")] for row, _ in judged], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], schema=batch.schema).filter(kept)

    done = bounded_batches(nested).mapInArrow(run, nested.schema)
    return done.select(*(F.col("text") if c == "text" else F.col("rest")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)))
