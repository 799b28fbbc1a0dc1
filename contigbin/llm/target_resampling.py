"""Target-distribution importance resampling over an integer word dictionary.

Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. The
features of a text are its runs of 1 to ``n`` words, joined by a space, repeats counted.

1. Texts are gathered into parts of about PART bytes (a longer text is a part alone). A part holds its
   distinct words with their counts once, its distinct longer runs as places of words, and its
   texts as numbers of these.
2. The dictionary gives each distinct word of all parts an id, with its counts: a word crosses the
   network once a part, however often it occurs. A single word is the tuple of its id alone.
3. Longer runs become tuples of ids by a join with the dictionary; distinct tuples leave a part with their counts.
4. Each distinct tuple of the whole corpus is spelled out and hashed once: its bucket is
   the CRC-32 of its bytes modulo BUCKETS. Counts are joined to it and summed by bucket.
5. A bucket's gain is floor(1000 * log ratio of its smoothed shares in target and raw). The
   buckets are joined back to the parts; a text's weight is the floored mean of its gains.
6. The score adds Gumbel noise from the SHA-256 of seed and id. Of the N texts of
   LEAST_WORDS words or more, floor(share * N / 100) of greatest score are drawn, ties to the
   lesser id. Scores are integers of a bounded range, so counts by score (at most some ten thousand
   numbers) rank without one ordered task: texts are ordered within their score alone.

Null and empty texts have no features, weight 0. Ids may be of any type that can be ordered and cast to
text; a null id draws the noise of an empty one and comes first among ties, as Spark orders. Rows that repeat an id are
rows of their own, which draw the same noise. Very long texts are read whole. Empty tables:
without target texts all buckets have the smoothed share; without documents there are
no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _LOWER, bounded_batches, columns, discard, materialize, maybe_broadcast, slices, utf8

N, BUCKETS, SEED, SHARE, LEAST_WORDS = 1, 10_000, 2024, 10, 20
PART = 16 << 20

_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def word_array(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts in order, and how many each text has."""
    data, offsets = utf8(column)
    data = _LOWER[data]
    inside = _INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    breaks = offsets[1:-1]
    breaks = breaks[(breaks < len(data)) & (breaks > 0)]
    first[breaks] = inside[breaks]
    starts = np.flatnonzero(first)
    kept = np.append(0, np.cumsum(inside))
    at = np.append(kept[starts], kept[-1]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[inside])])
    return words, np.diff(np.searchsorted(starts, offsets))


def runs(at: np.ndarray, n_words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[list[int]], np.ndarray]:
    """Of texts as word numbers: all features text by text, how many each text has, the distinct runs of 2 words or more, and their counts.

    Feature k below the number of words is word k alone, beyond that a longer run.
    """
    done = int(at.max(initial=-1)) + 1
    text = np.repeat(np.arange(len(n_words)), n_words)
    left = np.repeat(np.cumsum(n_words), n_words) - np.arange(len(at))
    start, codes, found, of, longer, counts = np.arange(len(at)), at.astype(np.int64), [at.astype(np.int64)], [text], [], [np.zeros(0, np.int64)]
    for k in range(2, n + 1):
        inside = left[start] >= k
        start = start[inside]
        pair = codes[inside] * (int(at.max(initial=0)) + 1) + at[start + k - 1]
        _, first, codes, many = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        found.append(codes + done + len(longer))
        longer += at[start[first][:, None] + np.arange(k)].tolist()
        of.append(text[start])
        counts.append(many)
    of = np.concatenate(of)
    return np.concatenate(found)[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(n_words)), longer, np.concatenate(counts)


def parts_of(texts: DataFrame, n: int) -> DataFrame:
    """From rows (id, text, target): part, target; ids, n_words, n_features, at (the features of its texts, packed); words, counts; longer, longer_counts."""
    id_type = texts.schema["id"].dataType

    def part_row(part: int, target: bool, pieces: list[tuple[pa.Array, pa.Array, np.ndarray]]) -> pa.RecordBatch:
        n_words = np.concatenate([x[2] for x in pieces])
        coded = pa.chunked_array([x[1] for x in pieces]).combine_chunks().dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary
        counts = np.bincount(at, minlength=len(words))
        order = np.argsort(-counts, kind="stable")  # frequent words have small numbers, which pack well
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        features, n_features, longer, longer_counts = runs(place[at], n_words, n)
        lists = [pa.concat_arrays([x[0] for x in pieces]), pa.array(n_words.astype(np.int32)), pa.array(n_features.astype(np.int32))]
        spelled = [words.take(pa.array(order)).cast(pa.string()), pa.array(counts[order]), pa.array(longer, pa.list_(pa.int32())), pa.array(longer_counts.astype(np.int64))]
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        packed = pa.array([pa.compress(features.astype(np.int32).tobytes(), "zstd", asbytes=True)], pa.binary())
        columns = [pa.array([part], pa.int64()), pa.array([target]), *map(one, lists), packed, *map(one, spelled)]
        return pa.RecordBatch.from_arrays(columns, names=["part", "target", "ids", "n_words", "n_features", "at", "words", "counts", "longer", "longer_counts"])

    def run(batches):
        part, held, size = TaskContext.get().partitionId() << 32, {False: [], True: []}, {False: 0, True: 0}
        for batch in batches:
            for mine in slices(batch, "text"):
                for target in (False, True):
                    piece = mine.filter(mine.column("target") if target else pc.invert(mine.column("target")))
                    if piece.num_rows:
                        held[target].append((piece.column("id"), *word_array(piece.column("text"))))
                        size[target] += pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
                    if size[target] >= PART:
                        yield part_row(part, target, held[target])
                        part, held[target], size[target] = part + 1, [], 0
        for target, pieces in held.items():
            if pieces:
                yield part_row(part, target, pieces)
                part += 1

    of = lambda name, kind: T.StructField(name, T.ArrayType(kind))
    own = [T.StructField("part", T.LongType()), T.StructField("target", T.BooleanType()), of("ids", id_type), of("n_words", T.IntegerType()), of("n_features", T.IntegerType()), T.StructField("at", T.BinaryType())]
    spelled = [of("words", T.StringType()), of("counts", T.LongType()), of("longer", T.ArrayType(T.IntegerType())), of("longer_counts", T.LongType())]
    return bounded_batches(texts).mapInArrow(run, T.StructType(own + spelled))


def by_side(name: str) -> list[Column]:
    """Sums of a count over raw and over target texts."""
    return [F.sum(F.when(F.col("target") == side, F.col(name)).otherwise(0)).alias(to) for side, to in ((False, "raw"), (True, "wanted"))]


def bucket(text: Column, buckets: int) -> Column:
    return (F.crc32(F.encode(text, "UTF-8")) % buckets).cast("int")


def occurrences(parts: DataFrame) -> DataFrame:
    """part, target, pos, word, n: each part's distinct words."""
    return parts.select("part", "target", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x")).select("part", "target", "pos", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))


def dictionary_of(parts: DataFrame, buckets: int) -> DataFrame:
    """word, id, bucket, raw, wanted: each distinct word once."""
    words = occurrences(parts).groupBy("word").agg(*by_side("n"))
    return words.select("word", F.monotonically_increasing_id().alias("id"), bucket(F.col("word"), buckets).alias("bucket"), "raw", "wanted")


def tuples_of(parts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """part, target, pos, tuple, n: each part's distinct longer runs as tuples of ids."""
    coded = occurrences(parts).join(dictionary.select("word", "id"), "word")
    ids = coded.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("own"))
    tuples = F.transform(F.arrays_zip("longer", "longer_counts"), lambda x: F.struct(F.transform(x["longer"], lambda w: F.get("own", w)).alias("tuple"), x["longer_counts"].alias("n")))
    return parts.select("part", "target", "longer", "longer_counts").join(ids, "part").select("part", "target", F.posexplode(tuples).alias("pos", "x")).select("part", "target", "pos", "x.tuple", "x.n")


def hashed(tuples: DataFrame, dictionary: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """tuple, bucket, raw, wanted: each distinct tuple once, with its counts."""
    sums = tuples.groupBy("tuple").agg(*by_side("n"))
    words = sums.select("tuple", "raw", "wanted", F.posexplode("tuple").alias("pos", "id")).join(dictionary.select("id", "word"), "id")
    spelled = words.groupBy("tuple", "raw", "wanted").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"))
    return spelled.select("tuple", bucket(F.col("text"), buckets).alias("bucket"), "raw", "wanted")


def listed(pairs: DataFrame, name: str) -> DataFrame:
    """Of rows (part, pos, bucket): each part's buckets behind their places, as numbers pos * 2**32 + bucket in any order."""
    return pairs.groupBy("part").agg(F.collect_list(F.shiftleft(F.col("pos").cast("long"), 32) + F.col("bucket")).alias(name))


def gains(hashes: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, from rows (bucket, raw, wanted)."""
    sums = columns(hashes.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("wanted").alias("wanted")))  # ``buckets`` rows at most
    raw, target = [0] * buckets, [0] * buckets
    for b, s, t in zip(sums["bucket"].tolist(), sums["raw"].tolist(), sums["wanted"].tolist(), strict=True):
        raw[b], target[b] = s, t
    all_raw, all_target = sum(raw) + buckets, sum(target) + buckets
    return np.array([math.floor(1000 * math.log(float(t + 1) * all_raw / (float(s + 1) * all_target))) for s, t in zip(raw, target, strict=True)], np.int64)


def weights(parts: DataFrame, lists: list[DataFrame], gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features, weight of the raw texts. ``lists``: the buckets of words and of longer runs."""
    shared = parts.sparkSession.sparkContext.broadcast(gain)
    given = bounded_batches(parts).filter(~F.col("target")).select("part", "ids", "n_words", "n_features", "at")
    names = [f"buckets{k}" for k in range(len(lists))]
    for name, own in zip(names, lists, strict=True):
        given = given.join(own.withColumnRenamed(own.columns[1], name), "part", "left")

    def run(batches):
        for batch in batches:
            for row in (batch.slice(k, 1) for k in range(batch.num_rows)):
                n = row.column("n_features").flatten().to_numpy().astype(np.int64)
                numbers = np.concatenate([np.sort(row.column(x).flatten().to_numpy().astype(np.int64)) for x in names])
                size = 4 * int(n.sum())
                at = np.frombuffer(pa.decompress(row.column("at")[0].as_buffer(), size, "zstd") if size else b"", np.int32)
                total = np.append(0, np.cumsum(shared.value[numbers & 0xFFFFFFFF][at]))
                ends = np.cumsum(n)
                weight = (total[ends] - total[ends - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), row.column("n_words").flatten().cast(pa.int64()), pa.array(n), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    long, id_type = T.LongType(), parts.schema["ids"].dataType.elementType
    return given.mapInArrow(run, T.StructType([T.StructField("id", id_type), T.StructField("n_words", long), T.StructField("n_features", long), T.StructField("weight", long)]))


def noise(of: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(of.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """Adds rank: 1 for the greatest score, null for texts that aren't drawn."""
    may = F.col("n_words") >= least_words
    counts = sorted(((r[0], r[1]) for r in scored.filter(may).groupBy("score").count().collect()), reverse=True)
    k, above, before = share * sum(n for _, n in counts) // 100, [], 0
    for score, n in counts:
        if before >= k:
            break
        above.append((score, before))
        before += n
    marks = scored.sparkSession.createDataFrame(above, "score long, before long")
    marks = maybe_broadcast(marks, len(above), 16)
    high = scored.filter(may).join(marks, "score")
    within = F.row_number().over(Window.partitionBy("score").orderBy("id", "n_features", "weight"))
    rank = F.col("before") + within
    high = high.withColumn("rank", F.when(rank <= k, rank)).drop("before")
    low = scored.filter(may).join(marks.select("score"), "score", "left_anti").unionByName(scored.filter(~may)).withColumn("rank", F.lit(None).cast("long"))
    return high.unionByName(low.select(high.columns))


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = N, buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """id, n_words, n_features, weight, score, rank: one row a document; ``target`` (column ``text``) is the distribution to come near to."""
    key, own = F.col(f"`{id_column}`"), F.col(f"`{text}`")
    raw = docs.select(key.alias("id"), own.alias("text"), F.lit(False).alias("target"))
    wanted = target.select(F.lit(None).cast(raw.schema["id"].dataType).alias("id"), own.alias("text"), F.lit(True).alias("target"))
    parts = materialize(parts_of(raw.unionByName(wanted), n), "parts")
    dictionary = materialize(dictionary_of(parts, buckets), "dictionary")
    hashes, lists, done = dictionary.select("bucket", "raw", "wanted"), [listed(occurrences(parts.filter(~F.col("target"))).join(dictionary.select("word", "bucket"), "word"), "words")], [parts, dictionary]
    if n > 1:
        tuples = materialize(tuples_of(parts, dictionary), "tuples")
        longer = materialize(hashed(tuples, dictionary, buckets), "hashed")
        hashes, done = hashes.unionByName(longer.drop("tuple")), [*done, tuples, longer]
        lists.append(listed(tuples.filter(~F.col("target")).join(longer.select("tuple", "bucket"), "tuple"), "runs"))
    weighed = weights(parts, lists, gains(hashes, buckets))
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    for written in done:
        discard(written)
    return drawn(scored, share, least_words)
