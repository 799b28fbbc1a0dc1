"""MinHash near-dedup: an inverted join on signature coordinates.

1. Each text's set of word shingles gets a 128-bit fingerprint and a MinHash
   signature. Texts of equal sets form a class; one of each goes on.
2. A class is posted under its rarest coordinate-value pairs: two signatures that
   agree in MIN_POSTED of the POSTED coordinates share one of the
   POSTED - MIN_POSTED + 1 rarest of either (prefix merging; rarity is counted over all
   classes in a table of fixed size). Lists with the same members count once.
3. In each list collisions are counted over all coordinates; pairs of MIN_MATCHES
   or more go on. At similarity 0.8 either bound loses about one pair in a million.
   A list of over SMALL members first proposes its two central members with each
   other member; after these are confirmed and linked, only pairs in different
   components are compared (skip merging), on the full sets at once, so that members
   with no link make no rows. Lists of over BLOCK members, or over BLOCK_BYTES of
   full sets, are dealt out as pairs of blocks within these bounds. No list is cut.
4. Pairs are confirmed on the full sets; components are those of the confirmed links.

Words are runs of anything but ASCII white space, A-Z in lower case. A text of
fewer words than a shingle has its whole word sequence as one; one without words
(or null) has none and is linked with nothing. Very long texts are read whole. Rows
that repeat a doc_id with one text are one document (``keep_one`` keeps one of them), with
several texts one that is linked where any of them is; a null doc_id stands alone, kept.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns, discard, materialize, maybe_broadcast, mix, slices
from .components import components
from .signatures import COMPARED, POSTED, fingerprint, minhash, shingle_sets

MIN_POSTED = 34
MIN_MATCHES = 126
RARITY_BITS = 18
SMALL, BLOCK, HUBS = 64, 2048, 2
BLOCK_BYTES = 16 << 20


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, fp_a, fp_b, posted, compared: one row a document (null signature: no shingle)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for s in shingle_sets(part.column(1), size):
                    if len(s):
                        h = minhash(s)
                        rows.append((len(s), *fingerprint(s), h[:POSTED].tobytes(), h.astype(np.uint16).tobytes()))
                    else:
                        rows.append((0, 0, 0, None, None))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()] * 2, strict=True))], names=["doc_id", "th", "n_shingles", "fp_a", "fp_b", "posted", "compared"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, n_shingles long, fp_a long, fp_b long, posted binary, compared binary")


def _token_table(column) -> np.ndarray:
    """Hashes of the coordinate-value pairs, a row a signature."""
    values = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, POSTED)
    return mix((np.arange(POSTED, dtype=np.uint64) << np.uint64(32))[None] | values.astype(np.uint64))


def postings(classes: DataFrame) -> DataFrame:
    """token, rep, size: each class under its rarest coordinate-value pairs."""
    mask = np.uint64((1 << RARITY_BITS) - 1)

    def tally(batches):
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            if batch.num_rows:
                counts += np.bincount((_token_table(batch.column(0)) & mask).astype(np.int64).ravel(), minlength=len(counts))
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    # 2**RARITY_BITS rows at most
    sums = columns(classes.select("posted").mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    rarity = np.zeros(1 << RARITY_BITS, np.uint64)
    rarity[sums["bucket"]] = np.minimum(sums["n"], 2**31)
    shared = classes.sparkSession.sparkContext.broadcast(rarity)

    def post(batches):
        rarity, n = shared.value, POSTED - MIN_POSTED + 1
        for batch in batches:
            if batch.num_rows:
                tokens = _token_table(batch.column(0))
                order = np.argsort((rarity[(tokens & mask).astype(np.int64)] << np.uint64(32)) | (tokens >> np.uint64(32)), axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(tokens, order, 1).ravel().view(np.int64)), *(pa.array(np.repeat(batch.column(k).to_numpy(), n)) for k in (1, 2))], names=["token", "rep", "size"])

    return classes.select("posted", "rep", "size").mapInArrow(post, "token long, rep long, size long")


def _lists(batches):
    """The rows of one list (or pair of blocks of one) at a time, from batches sorted by its key."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if key != (now := tuple(keys[a].tolist())) and held:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows["compared"].to_pylist()), np.uint16).reshape(-1, COMPARED)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _hubs(sig: np.ndarray) -> list[int]:
    """The members that agree most with the commonest value of each coordinate."""
    ordered = np.sort(sig, axis=0)
    common = np.empty(COMPARED, sig.dtype)
    for c in range(COMPARED):
        edge = np.flatnonzero(np.diff(ordered[:, c])) + 1
        edges = np.concatenate([[0], edge, [len(sig)]])
        common[c] = ordered[edges[np.argmax(np.diff(edges))], c]
    return np.argsort(-(sig == common).sum(1), kind="stable")[:HUBS].tolist()


def _pairs(rows: pa.Table, percent: int, later: bool):
    """Pairs of a list whose signatures agree enough; ``later``: links among what the first round has left."""
    sig, size, rep, block = _matrix(rows), rows["size"].to_numpy(), rows["rep"].to_numpy(), rows["block"].to_numpy()
    label = rows["label"].to_numpy() if later else None
    token, bi, bj, n = (rows[k][0].as_py() for k in ("token", "bi", "bj", "n"))
    hubs = _hubs(sig) if n > SMALL else []
    own = None

    def agree(i: int, with_: np.ndarray) -> np.ndarray:
        if bi != bj:
            with_ = with_[block[with_] != block[i]]
        with_ = with_[(100 * np.minimum(size[i], size[with_]) >= percent * np.maximum(size[i], size[with_]))]
        return with_[(sig[with_] == sig[i]).sum(1) >= MIN_MATCHES]

    everyone = np.arange(len(rep))
    if n > SMALL and not later:
        for i in hubs:
            for j in agree(i, everyone[everyone != i]):
                yield rep[i], rep[j]
        return
    if later:
        if (label == label[0]).all():
            return
        own = [set(x) for x in rows["hot"].to_pylist()]
        sets = [np.frombuffer(x, np.uint64) for x in rows["set"].to_pylist()]
    for i in everyone[:-1]:
        if later and i in hubs:
            continue
        rest = everyone[i + 1 :]
        for j in agree(i, rest[label[rest] != label[i]] if later else rest):
            # a pair belongs to the least of the lists that hold both
            if not later or j not in hubs and min(own[i] & own[j]) == token and similar(sets[i], sets[j], percent):
                yield rep[i], rep[j]


def candidates(lists: DataFrame, percent: int, later: bool) -> DataFrame:
    def run(batches):
        for rows in _lists(batches):
            found = list(_pairs(rows, percent, later))
            for at in range(0, len(found), 50_000):
                x, y = (np.array(c, np.int64) for c in zip(*found[at : at + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return lists.repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj", "rep").mapInArrow(run, "a long, b long").distinct()


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, set: the shingle hashes of the documents in ``ids`` (id)."""
    ids = materialize(ids.distinct(), "ids")
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(maybe_broadcast(ids, ids.count(), 16), "id")

    def collect(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), size)], pa.binary())], names=["id", "set"])

    return materialize(wanted.mapInArrow(collect, "id long, set binary"), "sets")


def confirm(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b of the pairs whose full sets are similar enough."""
    sets = full_sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), size)

    def check(batches):
        for batch in batches:
            good = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")
    links = materialize(both.mapInArrow(check, "a long, b long").distinct(), "links")
    discard(sets)
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    return _labelled(docs, size, percent).drop("th")


def _labelled(docs: DataFrame, size: int, percent: int) -> DataFrame:
    base = materialize(signatures(docs, size), "signatures")
    found = base.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fp_a", "fp_b")
    # all of a class have the same set, so any member's signature is the class's
    classes = materialize(found.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("posted").alias("posted"), F.first("compared").alias("compared")), "classes")
    reps = classes.select("fp_a", "fp_b", "rep")

    posted = postings(classes)
    counts = posted.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("members"), F.sum(8 * F.col("size")).alias("bytes")).filter("n > 1")
    # lists with the same members give the same pairs: one of them stays
    counts = counts.groupBy("n", "members").agg(F.min("token").alias("token"), F.max("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.when(F.col("n") > SMALL, F.col("bytes") / BLOCK_BYTES).otherwise(1))).cast("int")
    lists = materialize(posted.select("token", "rep").join(counts.select("token", "n", blocks.alias("blocks")), "token"), "lists")

    blocks = F.col("blocks")
    lists = lists.withColumn("block", F.when(blocks > 1, F.pmod(F.xxhash64("rep"), blocks)).otherwise(0).cast("int"))
    spread = lists.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("token", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "n", "rep", "block")
    full = spread.join(classes.select("rep", "size", "compared"), "rep")
    carried = ["token", "bi", "bj", "n", "rep", "block", "size", "compared"]
    links = confirm(docs, materialize(candidates(full.select(*carried), percent, later=False), "pairs"), size, percent)
    labels = materialize(components(links.select("a", "b")), "labels")

    hot = lists.filter(F.col("n") > SMALL).join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    mixed = hot.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("token")
    mixed = materialize(mixed, "mixed")
    hot = materialize(hot.join(maybe_broadcast(mixed, mixed.count(), 16), "token"), "hot")
    if hot.take(1):
        sets = full_sets(docs, hot.select(F.col("rep").alias("id")), size)
        own = hot.groupBy("rep").agg(F.collect_set("token").alias("hot"))
        left = full.join(hot.select("token", "rep", "label"), ["token", "rep"]).join(own, "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
        more = materialize(candidates(left.select(*carried, "label", "hot", "set"), percent, later=True), "links")
        labels = materialize(components(links.select("a", "b").union(more.select("a", "b"))), "labels")

    named = base.select("doc_id", "th", "n_shingles", "fp_a", "fp_b").join(reps, ["fp_a", "fp_b"], "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return named.select("doc_id", "th", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents of ``docs``, one of each group of near duplicates, with all columns; of rows of one doc_id and text, one."""
    named = materialize(_labelled(docs, size, percent).filter("doc_id IS NOT NULL").groupBy("doc_id", "th").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).filter("NOT kept OR n > 1"), "named")
    gone, again = named.filter("NOT kept").select("doc_id", "th"), named.filter("kept").select("doc_id", "th")
    n = named.agg(F.count_if("kept"), F.count_if(~F.col("kept"))).first()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    left = whole.join(maybe_broadcast(gone, n[1], 16), ["doc_id", "th"], "left_anti")
    if n[0]:  # rows that repeat: the least as JSON stays
        again = maybe_broadcast(again, n[0], 16)
        first = left.join(again, ["doc_id", "th"]).groupBy("doc_id", "th").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
        left = left.join(again, ["doc_id", "th"], "left_anti").select("row").union(first)
    return left.select(*(F.col("row")[c].alias(c) for c in docs.columns))
