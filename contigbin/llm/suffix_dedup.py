"""Suffix-array dedup: repeated byte strings of ``length`` or more, by a logarithmic index family.

Every byte covered by a ``length``-byte string that also starts earlier (in a smaller
doc_id, or before in the same document) is removed. Equality is that of bytes.

1. Sifting. Neighbouring starts whose first ``length`` bytes have the same leftmost
   least GRAM-byte gram (by hash) are a run. Equal strings have equal least grams at
   equal offsets, so suffixes of a gram that one run alone has repeat nothing and
   are left out. All others go on; no match is decided here.
2. Index. Suffixes are dealt by their run's gram, with their bytes. Of runs of equal
   bytes in a task the first one's suffixes are indexed, the others are removed whole. A batch gets a
   suffix array (its suffixes sorted by their first ``length`` bytes), is
   scanned against the levels for matches of that length, where the later of two
   starts is removed, and becomes a level; levels of about equal size merge. A level
   holds each prefix once, with its first start. Suffixes of a gram with more than
   HOT runs are dealt one by one, by prefix, after each task has kept its own first of
   each, so a line that many documents share is spread over all tasks.
3. Spans are united by document and cut from the text.

How many buckets there are follows from the counted bytes (BUCKET_BYTES of input for
step 1, INDEX_BYTES of suffixes for step 2), so what a task holds does not grow with
the input. Levels of a run live in the task of their bucket; a lost one is built again from
its shuffled input. ``suffix_family`` keeps levels between batches. What goes through a shuffle in steps 1 and 2 is packed: byte
planes of whole columns, compressed, a row a task, bucket and flush.

Null and short texts lose nothing. Very long texts are read in chunks of CHUNK bytes
that overlap. Rows that repeat a doc_id with the same text are one document and get
equal results; with different texts they are documents of their own, ordered by a
hash of the text. A null doc_id comes before all others. Other columns are ignored
(``cut`` keeps them).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, byte_codes, materialize, maybe_broadcast, mix, powers, slices, utf8

LENGTH = 100
GRAM = 24
CHUNK = 1 << 18
FLUSH = 1 << 18
BATCH = 1 << 16
HOT = 8_192
BUCKET_BYTES = 32 << 20
INDEX_BYTES = 48 << 20
QUERY, NOTICE, INDEX, REMOVED = range(4)
NULL_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15
_LONGEST = 4096
_CODES, _UP, _DOWN = byte_codes(80), powers(_BASE, CHUNK + _LONGEST), powers(pow(_BASE, -1, 1 << 64), CHUNK + _LONGEST)
_START = 16  # bits of a run's count below its start


def _checked(length: int) -> int:
    if not GRAM <= length <= _LONGEST:
        raise ValueError(f"length must be from {GRAM} to {_LONGEST}, not {length}")
    return length


def _count(pos: np.ndarray) -> np.ndarray:
    return pos & ((1 << _START) - 1)


def _prints(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * _UP[: len(data)])])
    n = len(sums) - size
    return mix((sums[size:] - sums[:n]) * _DOWN[:n]) if n > 0 else sums[:0]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :])


def _chunks(data: np.ndarray, offsets: np.ndarray, length: int):
    """Start of each chunk, its bytes, and which of its starts have ``length`` bytes of their text; texts' first starts."""
    short = np.zeros(len(data) + 1, np.int32)
    np.add.at(short, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(short, offsets[1:], -1)
    valid = np.cumsum(short[:-1]) == 0
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        n = min(CHUNK, len(part) - length + 1)
        if n > 0:
            yield at, part, valid[at : at + n], first[at : at + n]


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """text (row), start, count, gram of each run of suffixes."""
    out = []
    for at, part, valid, first in _chunks(data, offsets, length):
        g = _prints(part, gram)
        least = _least(g, length - gram + 1)[: len(valid)]
        new = first | ~valid
        new[0] = True
        new[1:] |= (least[1:] != least[:-1]) | (g[: len(valid) - 1] == least[:-1]) | ~valid[:-1]
        starts = np.flatnonzero(new & valid)
        if not len(starts):
            continue
        count = np.diff(np.append(np.flatnonzero(new), len(valid)))[valid[new]]
        text = np.searchsorted(offsets, at + starts, side="right") - 1
        out.append((text, at + starts - offsets[text], count, least[starts]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else None


def _united(doc: np.ndarray, th: np.ndarray, start: np.ndarray, n: np.ndarray):
    """Spans of n bytes from ``start``, united where they touch."""
    order = np.lexsort((start, th, doc))
    doc, th, start, end = doc[order], th[order], start[order], start[order] + n[order]
    if not len(doc):
        return doc, th, start, end
    other = _heads(doc, th)
    edges = np.append(np.flatnonzero(other), len(doc))
    # reach only rises within a text: lift each text above the one before by more than any end
    lift = (np.cumsum(other) - 1).astype(np.float64)
    reach = end.copy()
    if len(edges) > 2 and lift[-1] * (float(end.max()) + 1) < 1 << 62:
        step = int(end.max()) + 1
        shift = (np.cumsum(other) - 1) * step
        reach = np.maximum.accumulate(end + shift) - shift
    else:
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            np.maximum.accumulate(end[a:b], out=reach[a:b])
    new = other.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], th[at], start[at], reach[last] - start[at]


def pack(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Columns of 64-bit values of one length (and bytes at the end) as compressed byte planes."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.compress(b"".join([len(columns[0]).to_bytes(8, "little"), *planes, tail]), 1)


def unpack(payload: bytes, n_columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    data = np.frombuffer(zstandard.decompress(payload), np.uint8)
    n = int(data[:8].view(np.int64)[0])
    planes = data[8 : 8 + 8 * n * n_columns].reshape(n_columns, 8, n)
    return [np.ascontiguousarray(x.T).reshape(-1).view(np.int64) for x in planes], data[8 + 8 * n * n_columns :]


PACKED = "bucket int, kind byte, payload binary"


def _deal(kind: int, bucket: np.ndarray, *columns: np.ndarray, sizes: np.ndarray | None = None, data: np.ndarray | None = None):
    """One packed row a bucket; ``sizes``: the bytes of ``data`` that go with each row."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    if data is not None:
        at = np.cumsum(sizes) - sizes
        sizes, at = sizes[order], at[order]
        data = data[np.arange(sizes.sum()) + np.repeat(at - np.cumsum(sizes) + sizes, sizes)]
        edges = np.append(0, np.cumsum(sizes))
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    rows = [(bucket[a], pack(*(c[a:b] for c in columns), tail=b"" if data is None else data[edges[a] : edges[b]].tobytes())) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int8()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "kind", "payload"])


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes.view(np.uint64) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _by_doc(doc: np.ndarray, th: np.ndarray, n: int) -> np.ndarray:
    return _bucket(mix((doc ^ th).view(np.uint64) * np.uint64(_BASE)), n)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _several(gram: np.ndarray, *runs_: np.ndarray) -> np.ndarray:
    """Which rows, sorted by gram and run, are of a gram that more than one run has."""
    at = np.flatnonzero(_heads(gram))
    many = np.add.reduceat(_heads(gram, *runs_).astype(np.int64), at) > 1
    return np.repeat(many, np.diff(np.append(at, len(gram))))


def _gather(pieces: list, settle):
    if pieces:
        yield from settle(*(np.concatenate(c) for c in zip(*pieces, strict=True)))


def sample(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Step 1: packed rows from doc_id, th, text. What shares a gram within a flush is known to go on; the rest is asked for."""

    def settle(doc, th, pos, gram):
        order = np.lexsort((pos, th, doc, gram))
        doc, th, pos, gram = doc[order], th[order], pos[order], gram[order]
        many = _several(gram, doc, th, pos)
        alone = np.flatnonzero(~many)[np.argsort(order[~many])]  # in the order of the texts, which packs best
        yield from _deal(QUERY, _bucket(gram[alone], buckets), gram[alone], doc[alone], th[alone], pos[alone])
        if many.any():
            doc, th, pos, gram = doc[many], th[many], pos[many], gram[many]
            yield from _deal(INDEX, _by_doc(doc, th, buckets), doc, th, pos, gram)
            told = gram[_heads(gram)]
            yield from _deal(NOTICE, _bucket(told, buckets), told)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                found = runs(*utf8(part.column(2)), length)
                if found is None:
                    continue
                text, start, count, gram = found
                held.append((part.column(0).to_numpy()[text], part.column(1).to_numpy()[text], (start << _START) | count, gram))
                n += len(text)
                if n >= FLUSH:
                    yield from _gather(held, settle)
                    held, n = [], 0
        yield from _gather(held, settle)

    return docs.mapInArrow(run, PACKED)


def sifted(sampled: DataFrame, buckets: int) -> DataFrame:
    """Step 1: doc_id, th, pos, gram of the runs whose gram another run has too."""

    def out(doc, th, pos, gram):
        for at in range(0, len(doc), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 17)]) for c in (doc, th, pos, gram)], names=["doc_id", "th", "pos", "gram"])

    def run(batches):
        asked, told = [], []
        for batch in batches:
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == QUERY:
                    asked.append(unpack(payload, 4)[0])
                elif kind == NOTICE:
                    told.append(unpack(payload, 1)[0][0])
                else:
                    yield from out(*unpack(payload, 4)[0])
        if asked:
            gram, doc, th, pos = (np.concatenate(c) for c in zip(*asked, strict=True))
            asked.clear()
            order = np.lexsort((pos, th, doc, gram))
            gram, doc, th, pos = gram[order], doc[order], th[order], pos[order]
            many = _several(gram, doc, th, pos)
            if told:
                many |= np.isin(gram, np.concatenate(told))
            yield from out(doc[many], th[many], pos[many], gram[many])

    return sampled.repartitionById(buckets, "bucket").mapInArrow(run, "doc_id long, th long, pos long, gram long")


def _before(doc, th, start, of, at) -> np.ndarray:
    """Whether suffixes start before those at ``at`` of the columns ``of``."""
    d, t, s = (c[at] for c in of)
    return (doc < d) | (doc == d) & ((th < t) | (th == t) & (start < s))


class SuffixLevels:
    """Suffix arrays of geometrically growing size, in the order of bytes; every prefix is held once, with its first start."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def add(self, prefix: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
        """Index a batch of suffixes (``prefix``: their first bytes, of one length); doc, th, start of those now known to repeat an earlier one."""
        order = np.lexsort((start, th, doc))
        order = order[np.argsort(prefix[order], kind="stable")]
        batch = [x[order] for x in (prefix, doc, th, start)]
        new = _heads(batch[0])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = ~new & ~np.logical_and.reduce([c == c[head] for c in batch[1:]])
        removed = [[c[gone] for c in batch[1:]]]
        batch = [x[new] for x in batch]
        for level in self.levels:
            at = np.minimum(np.searchsorted(level[0], batch[0]), len(level[0]) - 1)
            same = level[0][at] == batch[0]
            if same.any():
                at, mine = at[same], [x[same] for x in batch[1:]]
                first = _before(*mine, level[1:], at)
                again = ~first & ~np.logical_and.reduce([x == c[at] for x, c in zip(mine, level[1:], strict=True)])
                removed += [[x[again] for x in mine], [c[at[first]] for c in level[1:]]]
                for c, x in zip(level[1:], mine, strict=True):
                    c[at[first]] = x[first]
                batch = [x[~same] for x in batch]
        if len(batch[0]):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            a, b = self.levels.pop(-2), self.levels.pop()
            order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")  # two sorted runs: a merge
            self.levels.append([np.concatenate(x)[order] for x in zip(a, b, strict=True)])
        return [np.concatenate(x) for x in zip(*removed, strict=True)]


def _suffixes(doc: np.ndarray, th: np.ndarray, pos: np.ndarray, data: np.ndarray, length: int):
    """prefix, doc, th, start of the suffixes of runs whose bytes stand one after the other in ``data``, BATCH at most at a time."""
    edges = np.append(0, np.cumsum(_count(pos) + length - 1))
    for c, chunk, valid, _ in _chunks(data, edges, length):
        here = np.flatnonzero(valid)
        views = np.lib.stride_tricks.sliding_window_view(chunk, length)
        for k in range(0, len(here), BATCH):
            some = here[k : k + BATCH]
            r = np.searchsorted(edges, c + some, side="right") - 1
            yield views[some].view(f"S{length}").ravel(), doc[r], th[r], (pos[r] >> _START) + (c + some - edges[r])


def _first_of_equal(doc: np.ndarray, th: np.ndarray, pos: np.ndarray, data: np.ndarray, length: int):
    """The first of each group of runs of equal bytes (doc, th, pos, data), and the spans of the others (doc, th, start, n)."""
    sizes = _count(pos) + length - 1
    edges = np.append(0, np.cumsum(sizes))
    raw, ends, seen = data.tobytes(), edges.tolist(), {}
    head = np.empty(len(doc), np.int64)
    for k in np.lexsort((pos, th, doc)).tolist():
        head[k] = seen.setdefault(raw[ends[k] : ends[k + 1]], k)
    first = head == np.arange(len(doc))
    gone = (doc != doc[head]) | (th != th[head]) | (pos != pos[head])
    kept = data[np.repeat(first, sizes)]
    return (doc[first], th[first], pos[first], kept), (doc[gone], th[gone], pos[gone] >> _START, sizes[gone])


def dealt_suffixes(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """Step 2, from doc_id, th, text, runs (array of pos, gram; gram 0: one with many runs): packed rows."""

    def spread(doc, th, pos, data):
        levels = SuffixLevels()
        distinct, again = _first_of_equal(doc, th, pos, data, length)
        held = [again]
        for found in _suffixes(*distinct, length):
            held.append(_of_length(levels.add(*found), length))
        d, t, s, n = _united(*(np.concatenate(c) for c in zip(*held, strict=True)))
        if len(d):
            yield from _deal(REMOVED, _by_doc(d, t, buckets), d, t, s, n)
        for prefix, d, t, s in levels.levels:
            data = prefix.view(np.uint8).reshape(-1, length)
            # by the bytes of the whole prefix
            yield from _deal(QUERY, _bucket(_rows_hash(data), buckets), d, t, s, sizes=np.full(len(d), length, np.int64), data=data.ravel())

    def whole(doc, th, pos, gram, data):
        yield from _deal(INDEX, _bucket(gram, buckets), doc, th, pos, sizes=_count(pos) + length - 1, data=data)

    def run(batches):
        many, n_many, held, n_held = [], 0, [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column(2))
                lists = part.column(3)
                of, row = lists.flatten(), np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                at, gram = of.field(0).to_numpy(), of.field(1).to_numpy()
                docs, ths = part.column(0).to_numpy(), part.column(1).to_numpy()
                start, size = at >> _START, _count(at) + length - 1
                for is_hot in (True, False):
                    k = (gram == 0) == is_hot
                    if not k.any():
                        continue
                    edges = np.append(0, np.cumsum(size[k]))
                    pieces = data[np.arange(edges[-1]) + np.repeat(offsets[row[k]] + start[k] - edges[:-1], size[k])]
                    if is_hot:
                        many.append((docs[row[k]], ths[row[k]], at[k], pieces))
                        n_many += len(pieces)
                    else:
                        held.append((docs[row[k]], ths[row[k]], at[k], gram[k], pieces))
                        n_held += len(pieces)
                if n_many >= FLUSH:
                    yield from _gather(many, spread)
                    many, n_many = [], 0
                if n_held >= 8 * FLUSH:
                    yield from _gather(held, whole)
                    held, n_held = [], 0
        yield from _gather(many, spread)
        yield from _gather(held, whole)

    return texts.mapInArrow(run, PACKED)


def _of_length(found: list[np.ndarray], length: int) -> tuple:
    """Spans of ``length`` bytes."""
    return *found, np.full(len(found[0]), length, np.int64)


def _rows_hash(data: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    out = np.zeros(len(data), np.uint64)
    for at in range(0, len(data), 1 << 14):
        part = data[at : at + (1 << 14)]
        out[at : at + (1 << 14)] = (_CODES[part] * _UP[: part.shape[1]]).sum(1, dtype=np.uint64)
    return mix(out)


def index(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Step 2: doc_id, th, pos (start), n of what is removed."""

    def out(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "th", "pos", "n"])

    def run(batches):
        levels, runs_, held, n = SuffixLevels(), [], [], 0
        for batch in batches:
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == REMOVED:
                    yield out(*unpack(payload, 4)[0])
                elif kind == INDEX:
                    (doc, th, pos), data = unpack(payload, 3)
                    runs_.append((doc, th, pos, data))
                else:
                    (doc, th, start), data = unpack(payload, 3)
                    held.append((data.view(f"S{length}"), doc, th, start))
                    n += len(doc)
                    if n >= BATCH:
                        yield from _gather(held, lambda *x: scan(levels, *x))
                        held, n = [], 0
        yield from _gather(held, lambda *x: scan(levels, *x))
        if runs_:
            distinct, again = _first_of_equal(*(np.concatenate(c) for c in zip(*runs_, strict=True)), length)
            runs_.clear()
            yield out(*_united(*again))
            for found in _suffixes(*distinct, length):
                yield from scan(levels, *found)

    def scan(levels, *batch):
        gone = levels.add(*batch)
        if len(gone[0]):
            yield out(*_united(*_of_length(gone, length)))

    return rows.repartitionById(buckets, "bucket").mapInArrow(run, "doc_id long, th long, pos long, n long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, th, text; dealt by the first two) and, by these, the list of what is removed (pos, n)."""
    _checked(length)
    texts = _texts(bounded_batches(docs))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(least, math.ceil(n_bytes / BUCKET_BYTES))
    found = materialize(sifted(sample(texts, length, buckets), buckets), "runs")
    dealt = texts.repartition("doc_id", "th")
    return dealt, settled(dealt, found, length)


def settled(dealt: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """doc_id, th, gone (list of pos, n): step 2 over the runs ``found`` (doc_id, th, pos, gram) of the texts ``dealt`` (by doc_id, th)."""
    least = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_suffixes = found.agg(F.sum(F.col("pos").bitwiseAND((1 << _START) - 1))).first()[0] or 0
    buckets = max(least, math.ceil(n_suffixes * (length + 24) / INDEX_BYTES))
    hot = materialize(found.groupBy("gram").agg(F.count("*").alias("hot")).filter(F.col("hot") > HOT).select("gram", F.lit(True).alias("hot")), "hot")
    marked = found.join(maybe_broadcast(hot, hot.count(), 16), "gram", "left").withColumn("gram", F.when(F.col("hot"), F.lit(0)).otherwise(F.col("gram")))
    wanted = marked.groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "gram")).alias("runs"))
    joined = dealt.join(wanted.hint("shuffle_hash"), ["doc_id", "th"]).select("doc_id", "th", "text", "runs")
    removed = index(dealt_suffixes(joined, length, buckets), length, buckets)
    return removed.groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "n")).alias("gone"))


def _cut(text: bytes, gone: pa.Scalar) -> tuple[np.ndarray, int]:
    """Which bytes of a text go, and in how many spans."""
    if not gone.is_valid:
        return np.zeros(len(text), bool), 0
    start, n = (gone.values.field(k).to_numpy() for k in (0, 1))
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, np.minimum(start, len(text)), 1)
    np.add.at(change, np.minimum(start + n, len(text)), -1)
    out = np.cumsum(change[:-1]) > 0
    return out, int((out[1:] & ~out[:-1]).sum() + out[:1].sum())


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row a document."""
    return reported(*spans(docs, length))


def reported(dealt: DataFrame, removed: DataFrame) -> DataFrame:
    """The result of ``dedup`` from texts (doc_id, th, text) and what goes from them (doc_id, th, gone)."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, gone in zip(batch.column(1), batch.column(2), strict=True):
                text = (text.as_py() or "").encode()
                out, n_spans = _cut(text, gone)
                left = np.frombuffer(text, np.uint8)[~out].tobytes() if n_spans else text
                rows.append((len(text), len(text) - len(left), n_spans, hashlib.sha256(left).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = dealt.join(removed.hint("shuffle_hash"), ["doc_id", "th"], "left").select("doc_id", "text", "gone")
    done = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut from text; a character that loses a byte goes whole. All columns stay."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = F.struct(F.lit(None).cast("int").alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)))
    named = docs.select("doc_id", "text", own.alias("_rest"))
    texts = named.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("th"), "doc_id", "_rest", "text")
    _, removed = spans(docs, length)
    joined = texts.join(removed.withColumnRenamed("doc_id", "doc").hint("shuffle_hash"), ["doc", "th"], "left").select("doc_id", "_rest", "text", "gone")
    schema = joined.select("doc_id", "_rest", "text").schema

    def run(batches):
        for batch in batches:
            new = []
            for text, gone in zip(batch.column(2), batch.column(3), strict=True):
                text = text.as_py()
                if text is not None and gone.is_valid:
                    data = text.encode()
                    out, _ = _cut(data, gone)
                    data = np.frombuffer(data, np.uint8)
                    char = np.cumsum((data & 0xC0) != 0x80) - 1
                    hit = np.zeros(char[-1] + 1 if len(char) else 0, bool)
                    hit[char[out]] = True
                    text = data[~hit[char]].tobytes().decode()
                new.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(new, batch.schema.field(2).type)], names=["doc_id", "_rest", "text"])

    done = joined.mapInArrow(run, schema)
    return done.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_rest")[f"c{rest.index(c)}"].alias(c) for c in docs.columns))
