"""Vector code compression by delta-maintained Lloyd rounds.

Vectors become integers, floor(SCALE * x), and are cut into PARTS equal consecutive
parts, each with a codebook of its own. The codebooks start as the parts of the
ENTRIES vectors of least id. A round assigns every part to the nearest entry of its
codebook (squared Euclidean distance, ties to the lower index) and writes the
assignments; the sums and counts of the entries are kept from round to round, and
only the parts whose assignment changed are shuffled, with plus for the new entry and
minus for the old one (partial sums first: PARTS * ENTRIES rows leave a task). An entry
becomes the floored mean of its parts; one without parts stays. All sums are of integers, so
results don't depend on the order of rows.

The driver holds codebooks, sums and counts alone, whose size depends on the parameters.

Rows whose vector is null or holds a null, NaN, infinite or enormous component (LIMIT or
more after scaling, beyond which errors would not fit 64 bits) are dropped, and so are
vectors of another length than the commonest (ties: the longer). A length that the parts
don't divide is filled up with zeros. Fewer vectors than ENTRIES give as many entries.
Ids may be of any type that can be ordered; null ids come last; rows that repeat an id are rows of their own, and
of those at the start the lesser vector comes first. Null labels count as one label. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 26
#: Labels with more than this share of the rows are joined by broadcast, of which there are so many at most.
HOT_LABELS = 4096
#: Rows whose distances are held at once.
CHUNK = 4096


@dataclass
class State:
    """Between rounds: rows (id, label, v, code as of the last round) and, for each part and entry, codebook, sum and count."""

    rows: DataFrame
    books: np.ndarray
    sums: np.ndarray
    counts: np.ndarray


def integers(vectors: DataFrame, id_column: str, vector: str, label: str, parts: int) -> DataFrame:
    """id, label, v: the kept rows as integers."""
    x = F.col(f"`{vector}`")
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    fits = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT / SCALE, F.lit(False)))
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label}`").alias("label"), F.when(fits, scaled).alias("v")).filter("size(v) > 0")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return rows.select("id", "label", F.col("v").cast("array<int>"))
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), -lengths["n"] % parts))
    return rows.filter(F.size("v") == lengths["n"]).select("id", "label", filled.cast("array<int>").alias("v"))


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of integer rows (rows, parts, width): entry of each part, and squared distances summed over the parts. Exact."""
    code, error = np.zeros(x.shape[:2], np.int32), np.zeros(len(x), np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)), 1)
    exact = np.float64 if 4 * most * most * x.shape[2] < 2**53 else np.int64  # float products are exact below that, and much faster
    x, books = x.astype(exact), books.astype(exact)
    for p, book in enumerate(books):
        rest = (book * book).sum(1) - 2 * (x[:, p] @ book.T)
        code[:, p] = rest.argmin(1)
        error += ((x[:, p] * x[:, p]).sum(1) + rest[np.arange(len(x)), code[:, p]]).astype(np.int64)
    return code, error


def assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, v, old (the code so far), code, error."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(at, CHUNK)
                x = piece.column("v").flatten().to_numpy().reshape(-1, parts, width).astype(np.int64)
                code, error = nearest(x, shared.value)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts, pa.int32()), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([*piece.columns, codes, pa.array(error)], names=[*piece.schema.names, "code", "error"])

    given = rows.withColumnRenamed("code", "old")
    schema = T.StructType([*given.schema.fields, T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    return bounded_batches(given).mapInArrow(run, schema)


def changes(assigned: DataFrame, parts: int, width: int) -> DataFrame:
    """part, entry, n, s0, s1, ...: what the changed parts add to each entry and take from it."""
    moved = F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.col("old").isNull() | (F.get("old", p) != F.get("code", p)))
    part = assigned.select("old", "code", "v", F.explode(moved).alias("part"))
    sides = F.filter(F.array(F.struct(F.get("code", "part").alias("entry"), F.lit(1).alias("sign")), F.struct(F.get("old", "part").alias("entry"), F.lit(-1).alias("sign"))), lambda s: s["entry"].isNotNull())
    signed = part.select("part", F.slice("v", F.col("part") * width + 1, width).alias("x"), F.inline(sides))
    component = lambda k: F.sum((F.get("x", F.lit(k)) * F.col("sign")).cast("long")).alias(f"s{k}")
    return signed.groupBy("part", "entry").agg(F.sum(F.col("sign").cast("long")).alias("n"), *(component(k) for k in range(width)))


def start(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES) -> State:
    rows = materialize(integers(vectors, id_column, vector, label, parts), "vectors")
    first = [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    width = len(first[0]) // parts if first else 1
    books = np.array(first, np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    return State(rows.withColumn("code", F.lit(None).cast("array<int>")), books, np.zeros_like(books), np.zeros(books.shape[:2], np.int64))


def advance(state: State) -> State:
    """One round."""
    parts, entries, width = state.books.shape
    if not entries:
        return state
    assigned = materialize(assign(state.rows, state.books), "assigned")
    discard(state.rows)
    sums, counts = state.sums.copy(), state.counts.copy()
    for r in changes(assigned, parts, width).collect():  # parts * entries rows at most
        counts[r["part"], r["entry"]] += r["n"]
        sums[r["part"], r["entry"]] += np.array(r[3:], np.int64)
    means = np.floor_divide(sums, np.maximum(counts, 1)[:, :, None])
    return State(assigned.select("id", "label", "v", "code"), np.where(counts[:, :, None] > 0, means, state.books), sums, counts)


def fit(vectors: DataFrame, rounds: int = ROUNDS, **options) -> State:
    """The state after ``rounds`` rounds. ``options``: of ``start``."""
    state = start(vectors, **options)
    for _ in range(rounds):
        state = advance(state)
    return state


def digest(books: np.ndarray) -> str:
    """Hash of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error of all rows of the label. Labels of many rows are joined by broadcast, the others by shuffle."""
    totals = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    rows = totals.agg(F.sum("n")).first()[0] or 0
    side = totals.select(F.col("label").alias("of"), "label_error", "n")
    hot, rest = F.broadcast(side.filter(F.col("n") * HOT_LABELS > rows)), side.filter(F.col("n") * HOT_LABELS <= rows)
    match = same(F.col("label"), F.col("of"))
    joined = [coded.join(hot, match), coded.join(hot, match, "left_anti").join(rest, match)]
    return joined[0].unionByName(joined[1]).drop("of", "n")


def encode(state: State) -> DataFrame:
    """id, label, code (array of entries), error: all rows under the state's codebooks."""
    if not state.books.shape[1]:
        return state.rows.select("id", "label", "code", F.lit(0).cast("long").alias("error"))
    return assign(state.rows, state.books).select("id", "label", "code", "error")


def compress(vectors: DataFrame, rounds: int = ROUNDS, **options) -> DataFrame:
    """id, label, code (hex), error, label_error, codebooks_sha256. ``options``: of ``start``."""
    state = fit(vectors, rounds, **options)
    coded = materialize(encode(state), "codes")
    discard(state.rows)
    hexed = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return with_label_error(coded).withColumn("code", hexed).withColumn("codebooks_sha256", F.lit(digest(state.books)))
