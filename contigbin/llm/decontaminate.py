"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

1. Texts and items are words (lower case); shingles are SHINGLE words (an item of
   fewer words has its whole sequence as one). The windows are all runs of as many
   words as an item has (or the whole text, if that is shorter). A window that holds
   no shingle of any item of its size has similarity 0 to each of them, so those are
   passed over; every other window gets a fingerprint. Such windows are found in
   chunks of CHUNK starts, around the shingles that a text has in common with items.
2. Each window and item has a 64-bit SimHash of its features: a shingle's first occurrence
   in it, its second, and so on are features of their own, so that a repeated shingle
   weighs no more than others at once and the similarity of step 3 is the plain Jaccard
   similarity of features. A window's bit sums are the difference of two running sums over its
   chunk (counters of ``field_width`` bits, packed into longs); shingles that the chunk
   repeats stand outside these sums and are numbered and added window by window. The fingerprint is cut into
   BLOCKS blocks; the index holds every item under all values within FLIPS bits of
   each block. Two fingerprints within RADIUS = BLOCKS * (FLIPS + 1) - 1 bits agree to
   FLIPS bits in one block at least, so none within the radius is missed. At similarity
   0.8 the expected distance is 10 bits.
3. Candidates are verified by exact weighted Jaccard similarity of the shingle
   multisets: the sum of the lesser counts over the sum of the greater.

DataFrame expressions only. Null and short texts match nothing; items without
words match nothing. Very long texts are read whole; what leaves them are rows of a
chunk or a window. Rows that repeat a doc_id count as one document (the best of
their matches; of windows equally similar the first); repeated items give the same
rows once each. A null doc_id or item_id is kept as such. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, maybe_broadcast

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, FLIPS = 64, 5, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
CHUNK = 128
NULL_ID = -(1 << 63)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE, -1), "")


def shingle_at(w: Column, i: Column, k: int) -> Column:
    """Hash of the k words from place i (from 0)."""
    return F.xxhash64(*(F.get(w, i + j) for j in range(k)))


def shingles(w: Column, start: Column, n: Column, k: int) -> Column:
    """Hashes of the n - k + 1 shingles of the n words from ``start``; none if n < k."""
    return F.when(n >= k, F.transform(F.sequence(start, start + n - k), lambda i: shingle_at(w, i, k))).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, then) -> Column:
    """``then(value)`` with the value made once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeated(hashes: Column) -> Column:
    """The distinct hashes that occur more than once."""
    return F.array_distinct(let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))


def feature(h: Column, occurrence: Column) -> Column:
    return F.when(occurrence == 1, h).otherwise(F.xxhash64(h, occurrence))


def features(hashes: Column) -> Column:
    """One feature for each place: the hash, or that of hash and number if it occurred before."""

    def numbered(again: Column) -> Column:
        so_far = lambda h, i: F.size(F.filter(F.slice(hashes, 1, i + 1), lambda x: x == h))
        each = F.transform(hashes, lambda h, i: F.when(F.array_contains(again, h), feature(h, so_far(h, i))).otherwise(h))
        return F.when(F.size(again) == 0, hashes).otherwise(each)

    return let(repeated(hashes), numbered)


def simhash(hashes: Column) -> Column:
    """Bit b is set if most of the (repeated) hashes have it."""
    half = F.size(hashes) / 2

    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
        return F.when(ones > half, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(bit(b)))


def field_width(most: int) -> int:
    """Bits of a counter for windows of at most ``most`` shingles: two are spare, so that no sum reaches the sign."""
    return 16 if most + CHUNK < 1 << 14 else 32


def _fields(value: int, width: int) -> int:
    return sum(value << at for at in range(0, BITS, width))


def running_sums(hashes: Column, width: int) -> Column:
    """For each prefix of ``hashes``, ``width`` longs: counter t of long j holds how many hashes have bit t * width + j."""
    one = F.lit(_fields(1, width))
    none = F.array_repeat(F.lit(0).cast("bigint"), width)

    def add(sums: Column, h: Column) -> Column:
        more = F.transform(F.element_at(sums, -1), lambda x, j: x + F.call_function("shiftrightunsigned", h, j).bitwiseAND(one))
        return F.array_append(sums, more)

    return F.aggregate(hashes, F.array(none), add)


def counters(hashes: Column, width: int) -> Column:
    """The sums of ``running_sums`` over all of ``hashes``."""
    one, none = F.lit(_fields(1, width)), F.array_repeat(F.lit(0).cast("bigint"), width)
    return F.aggregate(hashes, none, lambda sums, h: F.transform(sums, lambda x, j: x + F.call_function("shiftrightunsigned", h, j).bitwiseAND(one)))


def numbered_within(repeats: Column, at: Column, n: Column) -> Column:
    """Features of the repeated shingles (p, h) at places at .. at + n - 1, numbered from there."""
    inside = F.filter(repeats, lambda e: (e["p"] >= at) & (e["p"] < at + n))
    so_far = lambda own, e, i: F.size(F.filter(F.slice(own, 1, i + 1), lambda x: x["h"] == e["h"]))
    return let(inside, lambda own: F.transform(own, lambda e, i: feature(e["h"], so_far(own, e, i))))


def window_simhash(sums: Column, at: Column, n: Column, width: int, more: Column | None = None) -> Column:
    """The SimHash of hashes at .. at + n - 1, from the running sums, and ``more``, sums that are added to them."""
    top = width - 2
    pad = (F.lit((1 << top) - 1).cast("bigint") - F.floor(n / 2)) * F.lit(_fields(1, width))
    before, after = F.get(sums, at), F.get(sums, at + n)

    def lane(acc: Column, j: Column) -> Column:
        found = F.get(after, j) - F.get(before, j) + (pad if more is None else pad + F.get(more, j))
        most = found.bitwiseAND(F.lit(_fields(1 << top, width)))
        return acc.bitwiseOR(F.call_function("shiftleft", F.shiftrightunsigned(most, top), j))

    return F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0).cast("bigint"), lane)


def _blocks() -> list[tuple[int, int]]:
    """Start and width of each block of a fingerprint."""
    edges = [round(BITS * k / BLOCKS) for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def block_values(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, a).bitwiseAND((1 << width) - 1).cast("int") for a, width in _blocks()]


def item_index(items: DataFrame) -> DataFrame:
    """``items`` (item, fp, ..), each under all values within FLIPS bits of its blocks: block, value."""

    def block(k: int, width: int, value: Column) -> Column:
        masks = F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda m: F.bit_count(m) <= FLIPS)
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(m).alias("value")))

    rows = [block(k, width, value) for k, ((_, width), value) in enumerate(zip(_blocks(), block_values(F.col("fp")), strict=True))]
    return items.select("*", F.explode(F.concat(*rows)).alias("at")).select(*items.columns, "at.block", "at.value")


def slot(size: Column, block: Column, value: Column) -> Column:
    """One number for an item's size, a block and its value."""
    return (size.cast("bigint") * BLOCKS + block) * (1 << 16) + value


def first_block(distance: Column) -> Column:
    """The first block in which fingerprints of this difference (XOR) are within FLIPS bits."""
    masks = [((1 << width) - 1) << a for a, width in _blocks()]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    return F.coalesce(*(F.when(F.bit_count(distance.bitwiseAND(F.lit(m))) <= FLIPS, F.lit(k)) for k, m in enumerate(signed)))


def similarity(x: Column, y: Column) -> Column:
    """Weighted Jaccard similarity of two multisets of hashes."""
    single = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
    count = lambda c, v: F.size(F.filter(c, lambda e: e == v))
    both = F.when(single, F.size(F.array_intersect(x, y))).otherwise(F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, v: n + F.least(count(x, v), count(y, v))))
    return both / (F.size(x) + F.size(y) - both)


def _texts(docs: DataFrame) -> DataFrame:
    """doc, th (two texts under one doc_id are told apart by it), text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("th"), "text")


def _items(benchmark: DataFrame) -> tuple[DataFrame, list[int], int]:
    """item, item_id, m (words), k (words a shingle), hs, fp; the values of k; the most shingles of an item."""
    own = benchmark.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0").withColumn("m", F.size("w")).withColumn("k", F.least("m", F.lit(SHINGLE)))
    found = own.groupBy("k").agg(F.max("m").alias("m")).collect()  # SHINGLE rows at most
    sizes = sorted(r["k"] for r in found) or [SHINGLE]
    hashes = F.coalesce(*(F.when(F.col("k") == k, shingles(F.col("w"), F.lit(0), F.col("m"), k)) for k in sizes))
    items = own.select(F.monotonically_increasing_id().alias("item"), "item_id", "m", "k", hashes.alias("hs")).withColumn("fp", let(features(F.col("hs")), simhash))
    return materialize(items, "items"), sizes if found else [], max((r["m"] for r in found), default=0)


def shared(texts: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """doc, th, nw, k, p, sizes: places of shingles that items of these sizes have too (nw: the text's words)."""
    anchors = materialize(items.select("k", "m", F.explode("hs").alias("h")).groupBy("k", "h").agg(F.collect_set("m").alias("sizes")), "anchors")
    split = texts.select("doc", "th", words(F.col("text")).alias("w"))

    def spots_of(k: int) -> Column:
        return F.transform(shingles(F.col("w"), F.lit(0), F.size("w"), k), lambda h, p: F.struct(F.lit(k).alias("k"), p.alias("p"), h.alias("h")))

    if len(sizes) > 1:
        spots = F.concat(*map(spots_of, sizes))
        rows = split.select("doc", "th", F.size("w").alias("nw"), F.explode(spots).alias("s")).select("doc", "th", "nw", "s.k", "s.p", "s.h")
    else:
        rows = split.select("doc", "th", F.size("w").alias("nw"), F.posexplode(shingles(F.col("w"), F.lit(0), F.size("w"), sizes[0])).alias("p", "h")).withColumn("k", F.lit(sizes[0]))
    n = anchors.agg(F.count("*"), F.sum(F.size("sizes"))).first()
    return rows.join(maybe_broadcast(anchors, n[0] or 0, 40 + 4 * ((n[1] or 0) // max(1, n[0] or 0))), ["k", "h"]).select("doc", "th", "nw", "k", "p", "sizes")


def regions(hits: DataFrame) -> DataFrame:
    """doc, th, regions: array of (k, base, last, at); ``at``: of each size m in a chunk, its n words a window and its first and last start."""
    near = hits.repartition("doc", "th").select("doc", "th", "nw", "k", "p", F.explode("sizes").alias("m")).withColumn("n", F.least("m", "nw"))
    near = near.withColumns({"lo": F.greatest(F.lit(0), F.col("p") - (F.col("n") - F.col("k"))), "hi": F.least("p", F.col("nw") - F.col("n"))})
    chunk = lambda c: F.floor(F.col(c) / CHUNK).cast("int")
    near = near.withColumn("c", F.explode(F.sequence(chunk("lo"), chunk("hi"))))
    starts = near.groupBy("doc", "th", "nw", "k", "c", "m", "n").agg(F.min(F.greatest("lo", F.col("c") * CHUNK)).alias("lo"), F.max(F.least("hi", F.col("c") * CHUNK + (CHUNK - 1))).alias("hi"))
    chunks = starts.groupBy("doc", "th", "nw", "k", "c").agg(F.min("lo").alias("base"), F.max(F.col("hi") + F.col("n") - 1).alias("last"), F.collect_list(F.struct("m", "n", "lo", "hi")).alias("at"))
    return chunks.groupBy("doc", "th").agg(F.collect_list(F.struct("k", "base", "last", "at")).alias("regions"))


def windows(texts: DataFrame, spots: DataFrame, sizes: list[int], width: int) -> DataFrame:
    """doc, th, k, start, m, n, wfp: the fingerprints of all windows in ``spots`` (rows of ``regions``)."""
    read = texts.join(spots, ["doc", "th"]).select("doc", "th", words(F.col("text")).alias("w"), "regions")

    def hashed(r: Column) -> Column:
        n = r["last"] - r["base"] + 1
        hs = F.coalesce(*(F.when(r["k"] == k, shingles(F.col("w"), r["base"], n, k)) for k in sizes))
        return F.struct(r["k"].alias("k"), r["base"].alias("base"), r["at"].alias("at"), hs.alias("hs"))

    parts = read.select("doc", "th", F.explode(F.transform("regions", hashed)).alias("r")).select("doc", "th", "r.*").withColumn("again", repeated(F.col("hs")))
    once = F.when(F.size("again") == 0, F.col("hs")).otherwise(F.transform("hs", lambda h: F.when(F.array_contains("again", h), F.lit(0).cast("bigint")).otherwise(h)))
    placed = F.transform("hs", lambda h, p: F.struct(p.alias("p"), h.alias("h")))
    repeats = F.when(F.size("again") > 0, F.filter(placed, lambda e: F.array_contains("again", e["h"])))

    def prints(x: Column) -> Column:
        def one(start: Column, a: Column) -> Column:
            at, n = start - F.col("base"), a["n"] - F.col("k") + 1
            plain = window_simhash(x["sums"], at, n, width)
            fp = F.when(x["repeats"].isNull(), plain).otherwise(let(counters(numbered_within(x["repeats"], at, n), width), lambda more: window_simhash(x["sums"], at, n, width, more)))
            return F.struct(start.alias("start"), a["m"].alias("m"), a["n"].alias("n"), fp.alias("wfp"))

        return F.flatten(F.transform("at", lambda a: F.transform(F.sequence(a["lo"], a["hi"]), lambda start: one(start, a))))

    # as an array of one, the sums are made once a chunk and not once a window
    made = F.flatten(F.transform(F.array(F.struct(running_sums(once, width).alias("sums"), repeats.alias("repeats"))), prints))
    return parts.select("doc", "th", "k", F.explode(made).alias("x")).select("doc", "th", "k", "x.*")


def near_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """doc, th, k, start, n, item, hamming: windows and items of one size within RADIUS bits, each pair once."""
    block, value = F.col("block"), F.col("value")
    index = materialize(item_index(items.select("item", "m", "fp")).select(slot(F.col("m"), block, value).alias("slot"), "item", "fp"), "index")
    probes = found.select("*", F.posexplode(F.array(*block_values(F.col("wfp")))).alias("b", "value")).withColumn("slot", slot(F.col("m"), F.col("b"), value))
    met = probes.join(maybe_broadcast(index, index.count(), 24), "slot").withColumn("apart", F.col("fp").bitwiseXOR(F.col("wfp")))
    met = met.withColumn("hamming", F.bit_count("apart")).filter((F.col("hamming") <= RADIUS) & (first_block(F.col("apart")) == F.col("b")))
    return met.select("doc", "th", "k", "start", "n", "item", "hamming")


def verified(texts: DataFrame, near: DataFrame, items: DataFrame, sizes: list[int], least: float) -> DataFrame:
    """doc, th, item_id, start, n, hamming, similarity of the candidates that are similar enough."""
    grouped = materialize(near.groupBy("doc", "th").agg(F.collect_list(F.struct("k", "start", "n", "item", "hamming")).alias("near")), "candidates")
    n = grouped.agg(F.count("*"), F.sum(F.size("near"))).first()
    read = texts.join(maybe_broadcast(grouped, n[0], 40 + 48 * (n[1] or 0) // max(1, n[0])), ["doc", "th"]).select("doc", "th", words(F.col("text")).alias("w"), "near")

    def cut(c: Column) -> Column:
        ws = F.coalesce(*(F.when(c["k"] == k, shingles(F.col("w"), c["start"], c["n"], k)) for k in sizes))
        return F.struct(c["start"].alias("start"), c["n"].alias("n"), c["item"].alias("item"), c["hamming"].alias("hamming"), ws.alias("ws"))

    pairs = read.select("doc", "th", F.explode(F.transform("near", cut)).alias("c")).select("doc", "th", "c.*")
    n = items.agg(F.count("*"), F.sum(F.size("hs"))).first()
    full = pairs.join(maybe_broadcast(items.select("item", "item_id", "hs"), n[0], 40 + 8 * (n[1] or 0) // max(1, n[0])), "item")
    return full.withColumn("similarity", similarity(F.col("ws"), F.col("hs"))).filter(F.col("similarity") >= least - 1e-9).select("doc", "th", "item_id", "start", "n", "hamming", "similarity")


def _found(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    texts = _texts(docs)
    items, sizes, most = _items(benchmark)
    width = field_width(most)
    none = texts.select("doc", "th", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("hamming"), F.lit(0.0).alias("similarity")).filter("false")
    if not sizes:
        return none
    hits = materialize(shared(texts, items, sizes), "hits")
    spots = materialize(regions(hits), "regions")
    n = spots.agg(F.count("*"), F.sum(F.aggregate("regions", F.lit(0), lambda s, r: s + 32 + 16 * F.size(r["at"])))).first()
    if not n[0]:
        return none
    near = near_items(windows(texts, maybe_broadcast(spots, n[0], 40 + n[1] // n[0]), sizes, width), items)
    return verified(texts, near, items, sizes, least)


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity: the best window of each pair."""
    best = _found(docs, benchmark, least).groupBy("doc", "item_id").agg(F.max_by(F.struct("start", "n", "hamming", "similarity"), F.struct("similarity", -F.col("start"))).alias("best"))
    doc = F.when(F.col("doc") != NULL_ID, F.col("doc"))
    return best.select(doc.alias("doc_id"), "item_id", F.col("best.start").cast("long").alias("start_word"), F.col("best.n").cast("long").alias("n_words"), F.col("best.hamming").cast("long").alias("hamming"), F.col("best.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all columns."""
    found = materialize(_found(docs, benchmark, least).select("doc", "th").distinct(), "found")
    doc, th = F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), F.xxhash64(docs["text"])
    return docs.join(maybe_broadcast(found, found.count(), 16), (doc == found["doc"]) & (th == found["th"]), "left_anti")
