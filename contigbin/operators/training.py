"""Training of the masked graph autoencoder over executors (ML-6, ML-7, ML-10..12, AGG-42).

Nodes are dealt into parts of PART nodes, each with the neighbours that its two layers
read: up to FANOUT[0] of a node and FANOUT[1] of each of these, taken by hash; what is
left out is made up for by larger weights. Every epoch is one job: a part gives the sums of its
gradients over its own masked nodes, tasks add these up, and the driver, which holds the
weights alone, takes one step. A node is masked in an epoch, or held out for good, by a hash of its id, so all
parts that hold it agree. A part works out no more than its own nodes' loss needs, and batch statistics are those of the nodes that a layer is worked out for. At a check the held-out loss, the embedding,
its effective rank and the rebuilt graph are jobs of their own. The method is the same at every size;
with one part and no node of more neighbours than FANOUT it is full-batch training.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..sources.store import Tables
from . import evidence, graph, model, neighbours, partition, streamed

PART, FANOUT = 1024, (24, 8)
#: Sums of so many tasks at most come to the driver at once; those of more are added up by tasks first.
TASKS = 32


def hashed_share(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) from each id."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def sampled(adjacency: DataFrame, fanout: int, seed: int) -> DataFrame:
    """src, dst, weight of at most ``fanout`` neighbours of each node (loops aside), their weights scaled so that sums keep their mean."""
    by = Window.partitionBy("src")
    ranked = adjacency.withColumns({"r": F.row_number().over(by.orderBy(F.xxhash64("src", "dst", F.lit(seed)))), "n": F.count("*").over(by)})
    return ranked.filter(F.col("r") <= fanout).select("src", "dst", (F.col("weight") * F.greatest(F.col("n") / fanout, F.lit(1.0))).alias("weight"))


def parts_of(rows: DataFrame, edges: DataFrame, seed: int, size: int = PART, fanout: tuple[int, int] = FANOUT, of: Tables | None = None, held: list[str] | None = None) -> DataFrame:
    """part, data: each part's nodes and sampled links as arrays. ``rows``: id, u; ``held``: their files, if they are written already; ``of``: the tables that the parts go with.

    Written are the links of each part's own nodes and, once for all parts, the sampled links of every node. The task that
    uses a part looks up what its neighbours link to, and all vectors: together these are many times the table.
    """
    spark, n = rows.sparkSession, rows.count()
    of, tables = Tables(spark, "parts") if of is None else of, Tables(spark, "links")
    paths = streamed.files(streamed.kept(rows, of)) if held is None else held
    adjacency = tables.keep(graph.normalized_adjacency(rows, edges))
    number = max(1, math.ceil(n / size))
    tasks = min(number, 4 * spark.sparkContext.defaultParallelism)
    part_of = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(number))
    loops, links = adjacency.filter("src = dst").select(F.col("src").alias("id"), F.col("weight").alias("loop")), adjacency.filter("src <> dst")
    core = loops.select(part_of("id").alias("part"), "id").repartition(tasks, "part")
    first = sampled(links, fanout[0], seed).select(part_of("src").alias("of"), F.col("src").alias("i"), F.col("dst").alias("j"), "weight").repartition(tasks, "of")

    def gather(key, nodes: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values(["i", "j"])
        return pd.DataFrame({"part": [key[0]], "own": [np.sort(nodes["id"].to_numpy())], **{c: [near[c].to_numpy()] for c in ("i", "j", "weight")}})

    own = of.keep(core.groupBy("part").cogroup(first.groupBy("of")).applyInPandas(gather, "part long, own array<long>, i array<long>, j array<long>, weight array<double>"))
    second = sampled(links, fanout[1], seed + 1).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("to"))
    named = lambda c, kind: F.coalesce(F.col(f"to.{c}"), F.array().cast(f"array<{kind}>")).alias(c)
    hops = streamed.files(of.keep(loops.join(second, "id", "left").select("id", "loop", named("dst", "long"), named("weight", "double"))))
    tables.drop()

    def put_together(ids: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> bytes:
        halo = np.setdiff1d(j, ids)
        found = [(i, j, w)]
        for have, dst, weight in streamed.batches(hops, ("id", "dst", "weight"), ragged=("dst", "weight")):
            at, where = streamed.placed(halo, have)
            to, x = (c.take(pa.array(where)) for c in (dst, weight))
            found.append((np.repeat(halo[at], to.value_lengths().to_numpy()), *(c.flatten().to_numpy() for c in (to, x))))
        i, j, w = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.unique(np.concatenate([ids, j]))  # the halo is among what the own nodes link to
        loop, x, known = np.zeros(len(by)), None, 0
        for have, own in streamed.batches(hops, ("id", "loop")):
            at, where = streamed.placed(by, have)
            loop[at] = own[where]
        for have, u in streamed.batches(paths, ("id", "u")):
            x = np.zeros((len(by), u.shape[1])) if x is None else x
            at, where = streamed.placed(by, have)
            x[at], known = u[where], known + len(at)
        if known != len(by):
            raise ValueError("every node needs one vector")
        # the part's own nodes come first, then the neighbours that their second layer reads, then those that only the first layer of these reads
        level = np.where(np.isin(by, ids), 0, np.where(np.isin(by, halo), 1, 2))
        turn = np.lexsort((by, level))
        place = np.empty(len(by), np.int64)
        place[turn] = np.arange(len(by))
        i, j = (np.concatenate([place[np.searchsorted(by, e)], np.arange(len(by))]) for e in (i, j))
        w = np.concatenate([w, loop[turn]])
        order = np.lexsort((j, i))
        out = io.BytesIO()
        np.savez(out, ids=by[turn], core=level[turn] == 0, known=np.array([(level == 0).sum(), (level < 2).sum()]), x=x[turn], i=i[order].astype(np.int32), j=j[order].astype(np.int32), w=w[order])
        return out.getvalue()

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, *arrays = (batch.column(c)[row] for c in ("part", "own", "i", "j", "weight"))
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()]), pa.array([put_together(*(x.values.to_numpy() for x in arrays))], pa.binary())], names=["part", "data"])

    return own.mapInArrow(run, "part long, data binary")


def gatherer(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray):
    """x -> y with y[i] the sum of w * x[j]; ``.back`` is the transpose. Every node has a loop."""

    def one(i, j):
        order = np.argsort(i, kind="stable")
        starts = np.searchsorted(i[order], np.arange(n))
        return lambda x: np.add.reduceat(x[j[order]] * w[order, None], starts, axis=0)

    there = one(i, j)
    there.back = one(j, i)
    return there


def layered(part):
    """What the two layers read of a part: the first is worked out for its own nodes and their neighbours, the second for its own nodes. What these need of others is no more."""

    def one(rows: int, have: int):
        here = part["i"] < rows
        i, j, w = part["i"][here], part["j"][here], part["w"][here]
        starts, turned = np.searchsorted(i, np.arange(rows)), np.argsort(j, kind="stable")
        ends = np.searchsorted(j[turned], np.arange(have))
        there = lambda x: np.add.reduceat(x[j] * w[:, None], starts, axis=0)
        # every node that is read has a link from one that reads it, or its loop
        there.back = lambda x: np.add.reduceat(x[i[turned]] * w[turned, None], ends, axis=0)
        return there

    own, near = part["known"]
    spread = lambda x: x
    spread.layers = one(near, len(part["ids"])), one(own, near)
    return spread


def _sums(parts: DataFrame, work) -> list[np.ndarray]:
    """Sums over all parts of the vectors that ``work`` gives for a part: tasks add up their own, then at most TASKS rows come here."""

    def total(arrays):
        found = None
        for a in arrays:
            found = a if found is None else found + a
        return [] if found is None else [pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["sums"])]

    def first(batches):
        yield from total(work(dict(np.load(io.BytesIO(data)))) for batch in batches for data in batch.column(0).to_pylist())

    def more(batches):
        yield from total(np.frombuffer(data) for batch in batches for data in batch.column(0).to_pylist())

    sums = parts.select("data").mapInArrow(first, "sums binary")
    if sums.rdd.getNumPartitions() > TASKS:
        sums = sums.repartition(TASKS).mapInArrow(more, "sums binary")
    return [np.frombuffer(r["sums"]) for r in sums.collect()]


def _flat(values: dict) -> np.ndarray:
    return np.concatenate([np.ravel(values[k]).astype(float) for k in sorted(values)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def gradients(parts: DataFrame, net: model.Autoencoder, how, seed: int, epoch: int) -> tuple[float, dict, dict] | None:
    """Mean loss over the masked nodes of all parts, its gradients, and the running statistics after the epoch; None if no node is masked."""
    shared = parts.sparkSession.sparkContext.broadcast(model._packed(net))

    def work(part) -> np.ndarray:
        own = model._unpacked(shared.value)
        ids, core, x = part["ids"], part["core"], part["x"]
        masked = (hashed_share(ids, seed) >= how.held_out) & (hashed_share(ids, seed + 7919 * epoch) < how.masked)
        scored = np.flatnonzero(masked & core)
        if not len(scored):
            return np.zeros(2 + sum(w.size for w in own.w.values()) + sum(r.size for r in own.running.values()))
        loss, grads = own.step(x, layered(part), np.flatnonzero(masked), scored)
        return len(scored) * np.concatenate([[loss, 1], _flat(grads), _flat(own.running)])

    found = sum(_sums(parts, work))
    shared.destroy()
    if np.ndim(found) == 0 or not found[1]:
        return None
    found = found / found[1]
    cut = 2 + sum(w.size for w in net.w.values())
    return float(found[0]), _shaped(found[2:cut], net.w), _shaped(found[cut:], net.running)


def held_out_loss(parts: DataFrame, net: model.Autoencoder, how, seed: int) -> float | None:
    """Mean of 1 - cosine over the held-out nodes, masked all at once; None if there is none."""
    shared = parts.sparkSession.sparkContext.broadcast(model._packed(net))

    def work(part) -> np.ndarray:
        own, x = model._unpacked(shared.value), part["x"]
        held = hashed_share(part["ids"], seed) < how.held_out
        scored = np.flatnonzero(held & part["core"])
        if not len(scored):
            return np.zeros(2)
        made = own.reconstruct(x, layered(part), np.flatnonzero(held))
        return len(scored) * np.array([model.masked_cosine_loss(made, x, scored)[0], 1])

    found = sum(_sums(parts, work))
    return float(found[0] / found[1]) if np.ndim(found) and found[1] else None


def embedded(parts: DataFrame, net: model.Autoencoder) -> DataFrame:
    """id, z, and u of every node, from its part."""
    shared = parts.sparkSession.sparkContext.broadcast(model._packed(net))

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                part, own = dict(np.load(io.BytesIO(data))), model._unpacked(shared.value)
                z, core = own.encode(part["x"], layered(part))[0], part["core"]
                yield pa.RecordBatch.from_arrays([pa.array(part["ids"][core]), streamed.lists(z), streamed.lists(part["x"][core])], names=["id", "z", "u"])

    return parts.select("data").mapInArrow(run, "id long, z array<double>, u array<double>")


def moments(rows: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and sum of outer products of the vectors of a column, added up over tasks and then over sixteen."""

    def total(batches, unpack):
        found = None
        for batch in batches:
            for own in unpack(batch):
                found = own if found is None else found + own
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["sums"])

    def outer(batch):
        values = batch.column(0)
        if len(values):
            x = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)
            yield np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    first = rows.select(column).filter(F.col(column).isNotNull()).mapInArrow(lambda b: total(b, outer), "sums binary")
    again = first.repartition(16).mapInArrow(lambda b: total(b, lambda batch: map(np.frombuffer, batch.column(0).to_pylist())), "sums binary")
    found = sum(np.frombuffer(r["sums"]) for r in again.collect())
    if np.ndim(found) == 0:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = round(math.sqrt(len(found) - 0.75) - 0.5)  # 1 + d + d * d numbers
    return int(found[0]), found[1 : 1 + d], found[1 + d :].reshape(d, d)


def effective_rank(rows: DataFrame, column: str) -> float:
    """exp of the entropy of the singular values of all centred rows, over the smaller dimension (AGG-42): from the eigenvalues of d x d sums. 0 without rows."""
    n, total, gram = moments(rows, column)
    if not n:
        return 0.0
    values = np.linalg.eigvalsh(gram - np.outer(total, total) / n)
    s = np.sqrt(np.maximum(values, 1e-12 * max(values.max(), 0)))[-min(n, len(total)) :]
    p = s / max(s.sum(), 1e-12)
    return math.exp(-(p * np.log(p + 1e-12)).sum()) / max(min(n, len(total)), 1)


def _null_fit(view: DataFrame, config, prior: float | None = None) -> tuple[dict, float]:
    """The mixture fitted to random pairs of a view that is kept in files (with its own prior, if none is given), and that prior."""
    tables = Tables(view.sparkSession, "null")
    scores = partition.null_scores(view, config.evidence.null_draws, config.seed, streamed.files(view), tables)
    null = evidence.robust_null(scores).first()
    own = evidence.upper_tail_prior(scores, 2_000, null=null).first()[0] if prior is None else prior
    fit = evidence.fit_mixture(scores, own, null=null) | {"null_is_flat": null["scale"] < 1e-3}
    tables.drop()
    return fit, own


class Rebuilder:
    """The graph of a check (ML-6): mutual neighbours in attributes with the weighted embedding, or in coverage, whose evidence is positive, of limited degree, and the supported links."""

    def __init__(self, rows: DataFrame, supported: DataFrame, config):
        self.rows, self.supported, self.config, self.n = rows, supported, config, rows.count()
        self.tables, self.base = Tables(rows.sparkSession, "graph"), Tables(rows.sparkSession, "coverage")
        self.b = streamed.kept(rows.select("id", F.col("b").alias("u")), self.base)
        fit, prior = _null_fit(self.b, config)
        self.fit_b, self.prior = fit, None if fit["null_is_flat"] else prior
        own = Tables(rows.sparkSession, "buckets")
        self.near_b = self.base.keep(self._near(self.b, own))  # coverage stays as it is
        own.drop()

    def _near(self, view: DataFrame, own: Tables) -> DataFrame:
        how = self.config.search
        return neighbours.reciprocal_knn(view, min(how.neighbours, self.n - 1), how.exact_rows, own).select("src", "dst")

    def __call__(self, embedding: DataFrame) -> DataFrame:
        """``embedding``: id, z, and u if it is at hand."""
        weight = self.config.training.embedding_weight
        wide = F.concat("u", F.transform("z", lambda x: x * weight))
        own = Tables(self.rows.sparkSession, "views")
        both = embedding if "u" in embedding.columns else self.rows.select("id", "u").join(embedding, "id")
        a = streamed.kept(both.select("id", unit(wide).alias("u")), own)
        fit_a, prior = _null_fit(a, self.config, self.prior)
        fit_b = self.fit_b if self.prior is not None else _null_fit(self.b, self.config, prior)[0]
        pairs = own.keep(self._near(a, own).union(self.near_b).distinct())
        dots = streamed.pair_dots(pairs, {"a": streamed.files(a), "b": streamed.files(self.b)}, own)
        kept = own.keep(evidence.positive_edges(dots, {"a": fit_a, "b": fit_b}).select("src", "dst", "a", "b"))
        found = self.tables.keep(graph.limit_degree(self.rows, kept, self.config.search.exact_rows).union(self.supported.select("src", "dst")).distinct())
        self.tables.drop(1)
        own.drop()
        return found

    def drop(self) -> None:
        for tables in (self.tables, self.base):
            tables.drop()


def train(rows: DataFrame, edges: DataFrame, config, regraph=None, size: int = PART, fanout: tuple[int, int] = FANOUT) -> tuple[model.Autoencoder, DataFrame, dict]:
    """The model, the graph (src < dst) of its best state, and the run's statistics. ``rows``: id, u; ``regraph``: embedding (id, z) -> edges, at every check."""
    how, n = config.training, rows.count()
    if n < 2:
        raise ValueError("training requires at least two nodes")
    width = len(rows.select("u").first()["u"])
    net = model.Autoencoder(width, how.hidden, how.latent, how.graph_gate, config.seed)
    m, v = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2))
    tables, graphs, vectors = (Tables(rows.sparkSession, name) for name in ("parts", "graphs", "vectors"))
    paths = streamed.files(streamed.kept(rows, vectors))
    edges = graphs.keep(neighbours.canonical_edges(edges))
    parts = parts_of(rows, edges, config.seed, size, fanout, tables, paths)
    (least, most), best, stale, stats, step, loss = how.epochs, (math.inf, None), 0, {"stop": "all epochs"}, 0, math.inf
    for epoch in range(1, most + 1):
        found = gradients(parts, net, how, config.seed, epoch)
        if found:
            loss, grads, net.running = found
            step += 1
            for k, g in grads.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net.w[k] = net.w[k] * (1 - how.rate * how.decay) - how.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if epoch % how.check_every:
            continue
        held = held_out_loss(parts, net, how, config.seed)
        held = loss if held is None else held  # so few nodes that none is held out
        z = Tables(rows.sparkSession, "embedding")
        embedding = z.keep(embedded(parts, net))
        rank, new = effective_rank(embedding, "z"), edges if regraph is None else graphs.keep(regraph(embedding))
        z.drop()
        jaccard = graph.merge_stats(edges, new).first()["jaccard"]
        if held < best[0] - 1e-4:
            best, stale = (held, ({k: w.copy() for k, w in net.w.items()}, {k: w.copy() for k, w in net.running.items()}, new, epoch)), 0
        else:
            stale += 1
        stats |= {"epochs": epoch, "effective_rank": rank, "edge_jaccard": 1.0 if jaccard is None else jaccard}
        if epoch >= least and stale >= how.patience and rank >= how.least_rank:
            stats["stop"] = "loss and graph settled" if stats["edge_jaccard"] >= how.settled_graph else "loss settled"
            break
        if new is not edges:
            edges, parts = new, parts_of(rows, new, config.seed, size, fanout, tables, paths)
            tables.drop(2)  # the links of the parts' own nodes, and those of all nodes
    tables.drop()
    vectors.drop()
    if best[1] is not None:
        net.w, net.running, edges, stats["selected_epoch"] = best[1]
    degrees = graph.degree_stats(rows, edges).first()
    stats |= {"held_out_loss": best[0], "identity_gate": net.gates()[0], "graph_gate": net.gates()[1], "edges": degrees["edges"] or 0, "mean_degree": degrees["mean_degree"] or 0.0, "linked_nodes": degrees["touched"], "nodes": n}
    return net, edges, stats


def embed(rows: DataFrame, edges: DataFrame, config, supported: DataFrame | None = None, size: int = PART) -> tuple[DataFrame, dict]:
    """id, z of every row of ``rows``, and the statistics of the training.

    ``rows``: id, u (attributes), b (coverage; the graph is rebuilt at every check if it is there); ``edges``: the seed
    graph (src, dst); ``supported``: links that every graph has. The encoder reads all neighbours of the best state's graph.
    """
    base = Tables(rows.sparkSession, "nodes")
    rows = base.keep(rows)
    always = edges.limit(0) if supported is None else supported
    seeds = edges.select("src", "dst").union(always.select("src", "dst"))
    regraph = Rebuilder(rows, neighbours.canonical_edges(always).checkpoint(), config) if "b" in rows.columns else None
    net, final, stats = train(rows, seeds, config, regraph, size)
    z = model.encode_all(rows, final, model._packed(net))
    for tables in (base, *([regraph] if regraph else [])):
        tables.drop()
    return z, {k: str(x) for k, x in stats.items()}
