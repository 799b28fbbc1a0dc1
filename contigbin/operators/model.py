"""Masked graph autoencoder (ML-6, ML-8..12, AGG-42): an optional embedding of the attribute view.

Encoder: (1 - g) * x P + g * layer2(layer1(x)), at unit length, with a learned gate g;
a layer is gelu(batchnorm(x W + A x V + b)). Decoder: two dense layers. Training masks
part of the training nodes and reconstructs them by cosine; it is checked on held-out
nodes, where the graph is rebuilt from attributes and embedding, and
keeps the best state. ``operators.training`` runs it over executors; ``train`` is the plain
form on arrays that tests hold it against. The encoder is applied to all rows in Arrow batches (``operators.streamed``).
GELU is its tanh form. Gradients are written out by hand below.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.store import Tables
from . import graph, streamed


def gelu(x):
    t = np.tanh(0.7978845608 * (x + 0.044715 * x**3))
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * 0.7978845608 * (1 + 3 * 0.044715 * x * x)


def unit_rows(x):
    n = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x / n, n


def masked_cosine_loss(predicted, target, masked) -> tuple[float, np.ndarray]:
    """Mean of 1 - cosine on the masked rows, and its gradient. Raises if none is masked."""
    if not len(masked):
        raise ValueError("at least one masked node is required")
    p, n = unit_rows(predicted[masked])
    t, _ = unit_rows(target[masked])
    c = (p * t).sum(1, keepdims=True)
    grad = np.zeros_like(predicted)
    grad[masked] = -(t - c * p) / n / len(masked)
    return float(1 - c.mean()), grad


def effective_rank(x: np.ndarray, most: int = 4_096) -> float:
    """exp of the entropy of the singular values, over the smaller dimension (AGG-42)."""
    if len(x) > most:
        x = x[np.linspace(0, len(x) - 1, most, dtype=int)]
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    p = s / max(s.sum(), 1e-12)
    return math.exp(-(p * np.log(p + 1e-12)).sum()) / max(min(x.shape), 1)


class Autoencoder:
    def __init__(self, width: int, hidden: int, latent: int, gate: float, seed: int):
        rng = np.random.default_rng(seed)

        def dense(a, b):
            return rng.uniform(-1, 1, (a, b)) / math.sqrt(a)

        self.w = {
            "P": dense(width, latent), "W1": dense(width, hidden), "V1": dense(width, hidden), "b1": np.zeros(hidden), "s1": np.ones(hidden), "o1": np.zeros(hidden),
            "W2": dense(hidden, latent), "V2": dense(hidden, latent), "b2": np.zeros(latent), "s2": np.ones(latent), "o2": np.zeros(latent), "gate": np.array(math.log(gate / (1 - gate))),
            "mask": np.zeros(width), "D1": dense(latent, hidden), "c1": np.zeros(hidden), "D2": dense(hidden, width), "c2": np.zeros(width),
        }
        self.running = {k: np.zeros(n) if "m" in k else np.ones(n) for k, n in (("m1", hidden), ("v1", hidden), ("m2", latent), ("v2", latent))}

    def gates(self) -> tuple[float, float]:
        g = 1 / (1 + math.exp(-float(self.w["gate"])))
        return 1 - g, g

    def _layer(self, k, x, ax, train):
        z = x @ self.w[f"W{k}"] + ax @ self.w[f"V{k}"] + self.w[f"b{k}"]
        if train:
            m, v = z.mean(0), z.var(0)
            for name, value in ((f"m{k}", m), (f"v{k}", v * len(z) / max(1, len(z) - 1))):
                self.running[name] = 0.9 * self.running[name] + 0.1 * value
        else:
            m, v = self.running[f"m{k}"], self.running[f"v{k}"]
        scale = 1 / np.sqrt(v + 1e-5)
        n = (z - m) * scale
        y, slope = gelu(n * self.w[f"s{k}"] + self.w[f"o{k}"])
        return y, (x, ax, n, scale, slope)

    def _layer_back(self, k, dy, cache, grads):
        x, ax, n, scale, slope = cache
        d = dy * slope
        grads[f"s{k}"], grads[f"o{k}"] = (d * n).sum(0), d.sum(0)
        d = d * self.w[f"s{k}"]
        dz = scale * (d - d.mean(0) - n * (d * n).mean(0))
        grads[f"W{k}"], grads[f"V{k}"], grads[f"b{k}"] = x.T @ dz, ax.T @ dz, dz.sum(0)
        return dz

    def encode(self, x, spread, train=False):
        """Rows of the embedding. ``spread`` may have ``layers``: a spread for each layer, which gives the first rows of what it reads, as many as the next one needs."""
        first, second = getattr(spread, "layers", (spread, spread))
        ax = first(x)
        h, c1 = self._layer(1, x[: len(ax)], ax, train)
        ah = second(h)
        y, c2 = self._layer(2, h[: len(ah)], ah, train)
        keep, g = self.gates()
        x = x[: len(ah)]
        own = x @ self.w["P"]
        z, n = unit_rows(keep * own + g * y)
        return z, (x, own, y, n, z, c1, c2)

    def step(self, x, spread, masked, scored=None) -> tuple[float, dict]:
        """Loss over the rows ``scored`` (all masked ones) and gradients, with the rows ``masked`` replaced by the mask token."""
        first, second = (getattr(s, "back", s) for s in getattr(spread, "layers", (spread, spread)))  # the whole adjacency is its own transpose
        seen = x.copy()
        seen[masked] = self.w["mask"]
        z, (seen, own, y, n, z, c1, c2) = self.encode(seen, spread, train=True)
        h, slope = gelu(z @ self.w["D1"] + self.w["c1"])
        loss, d = masked_cosine_loss(h @ self.w["D2"] + self.w["c2"], x, masked if scored is None else scored)
        g = {"D2": h.T @ d, "c2": d.sum(0)}
        d = (d @ self.w["D2"].T) * slope
        g["D1"], g["c1"] = z.T @ d, d.sum(0)
        d = d @ self.w["D1"].T
        d = (d - z * (z * d).sum(1, keepdims=True)) / n
        keep, gate = self.gates()
        g["gate"] = np.array(((y - own) * d).sum() * gate * keep)
        g["P"] = seen.T @ (keep * d)
        dz = self._layer_back(2, gate * d, c2, g)
        dh = second(dz @ self.w["V2"].T)
        dh[: len(dz)] += dz @ self.w["W2"].T
        dz = self._layer_back(1, dh, c1, g)
        dx = first(dz @ self.w["V1"].T)
        dx[: len(dz)] += dz @ self.w["W1"].T
        dx[: len(d)] += (keep * d) @ self.w["P"].T
        g["mask"] = dx[masked].sum(0)
        return loss, g

    def reconstruct(self, x, spread, masked):
        seen = x.copy()
        seen[masked] = self.w["mask"]
        h, _ = gelu(self.encode(seen, spread)[0] @ self.w["D1"] + self.w["c1"])
        return h @ self.w["D2"] + self.w["c2"]


def spreader(n: int, src: np.ndarray, dst: np.ndarray):
    """x -> A x for the normalised adjacency with self loops."""
    a, b = np.concatenate([src, dst, np.arange(n)]), np.concatenate([dst, src, np.arange(n)])
    degree = np.bincount(a, minlength=n)
    weight = 1 / np.sqrt(np.maximum(degree[a] * degree[b], 1))
    order = np.argsort(a, kind="stable")
    a, b, weight = a[order], b[order], weight[order]
    starts = np.searchsorted(a, np.arange(n))
    return lambda x: np.add.reduceat(x[b] * weight[:, None], starts, axis=0)


def train(x: np.ndarray, edges: np.ndarray, config, regraph=None) -> tuple[Autoencoder, np.ndarray, dict]:
    """The model, the graph (i < j) of its best state, and the run's statistics. ``regraph``: embedding -> edges, at every check."""
    n, how = len(x), config.training
    if n < 2:
        raise ValueError("training requires at least two nodes")
    rng = np.random.default_rng(config.seed)
    model = Autoencoder(x.shape[1], how.hidden, how.latent, how.graph_gate, config.seed)
    spread = spreader(n, *edges.T)
    held = rng.choice(n, min(n - 1, max(1, round(n * how.held_out))), replace=False)
    pool = np.setdiff1d(np.arange(n), held)
    m, v = ({k: np.zeros_like(w) for k, w in model.w.items()} for _ in range(2))
    least, most = how.epochs
    best, stale, stats = (math.inf, None), 0, {"stop": "all epochs"}
    for epoch in range(1, most + 1):
        masked = rng.choice(pool, min(len(pool), max(1, round(len(pool) * how.masked))), replace=False)
        _, grads = model.step(x, spread, masked)
        for k, g in grads.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            model.w[k] = model.w[k] * (1 - how.rate * how.decay) - how.rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.999**epoch)) + 1e-8)
        if epoch % how.check_every:
            continue
        loss, _ = masked_cosine_loss(model.reconstruct(x, spread, held), x, held)
        z = model.encode(x, spread)[0]
        rank = effective_rank(z)
        new = edges if regraph is None else regraph(z)
        old, codes = (set(map(tuple, e.tolist())) for e in (edges, new))
        jaccard = len(old & codes) / max(len(old | codes), 1)
        if loss < best[0] - 1e-4:
            best, stale = (loss, ({k: w.copy() for k, w in model.w.items()}, {k: w.copy() for k, w in model.running.items()}, new, epoch)), 0
        else:
            stale += 1
        edges, spread = new, spreader(n, *new.T)
        stats |= {"epochs": epoch, "effective_rank": rank, "edge_jaccard": jaccard}
        if epoch >= least and stale >= how.patience and rank >= how.least_rank:
            stats["stop"] = "loss and graph settled" if jaccard >= how.settled_graph else "loss settled"
            break
    if best[1] is not None:
        model.w, model.running, edges, stats["selected_epoch"] = best[1]
    degree = np.bincount(edges.ravel(), minlength=n)
    stats |= {"held_out_loss": best[0], "identity_gate": model.gates()[0], "graph_gate": model.gates()[1], "edges": len(edges), "mean_degree": float(degree.mean()), "linked_nodes": int((degree > 0).sum())}
    return model, edges, stats


def _packed(model: Autoencoder) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"w_{k}": w for k, w in model.w.items()}, **{f"r_{k}": w for k, w in model.running.items()})
    return out.getvalue()


def _unpacked(data: bytes) -> Autoencoder:
    model, kept = Autoencoder.__new__(Autoencoder), np.load(io.BytesIO(data))
    model.w, model.running = ({k[2:]: kept[k] for k in kept.files if k[0] == side} for side in "wr")
    return model


def encode_all(rows: DataFrame, edges: DataFrame, weights: bytes) -> DataFrame:
    """id, z of every row of ``rows`` (id, u) on the graph ``edges`` (src, dst): for each layer, tasks that hold some nodes' links read all rows past them."""
    spark, n = rows.sparkSession, rows.count()
    shared = spark.sparkContext.broadcast(weights)
    tables, out = Tables(spark, "encoder"), Tables(spark, "encoded")
    adjacency = tables.keep(graph.normalized_adjacency(rows, edges))
    start = streamed.files(streamed.kept(rows, tables))

    def first(ids, u, au):
        h, _ = _unpacked(shared.value)._layer(1, u, au, train=False)
        return pa.RecordBatch.from_arrays([pa.array(ids), streamed.lists(h), streamed.lists(u)], names=["id", "h", "u"])

    def second(ids, h, ah, u):
        model = _unpacked(shared.value)
        y, (keep, g) = model._layer(2, h, ah, train=False)[0], model.gates()
        return pa.RecordBatch.from_arrays([pa.array(ids), streamed.lists(unit_rows(keep * (u @ model.w["P"]) + g * y)[0])], names=["id", "z"])

    hidden = streamed.files(tables.keep(streamed.link_sums(adjacency, n, start, "u", first, "id long, h array<double>, u array<double>")))
    z = out.keep(streamed.link_sums(adjacency, n, hidden, "h", second, "id long, z array<double>", ("u",)))
    tables.drop()
    return z
