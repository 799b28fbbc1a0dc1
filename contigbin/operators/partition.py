"""Partition by the constant Potts model, and the loop that finds the number of bins (ML-13, ML-14).

The objective is the weight inside communities less gamma * n * (n - 1) / 2 of each.
With weights and gamma above 0 an optimum never joins what no path joins, so each
connected component is solved by itself: small ones whole in a task (local moving,
refinement, aggregation, after Traag, Waltman and van Eck 2019). Ones of over LIMIT
nodes are first contracted: rounds of moves as joins over all tasks, then each connected
part of a community becomes a node with its size, until a task can hold the contracted component and solves it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..sources.store import Tables
from . import completeness, evidence, features, graph, metrics, neighbours, streamed

LIMIT = 50_000
PRIME = (1 << 31) - 1


def _neighbours(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
    a, b, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(n + 1)), b[order], w[order]


def _move(label: np.ndarray, sizes: np.ndarray, adjacency, gamma: float, within: np.ndarray | None = None) -> bool:
    """Move nodes to the neighbouring (or an empty) community of greatest gain until none gains.

    ``within``: only single nodes move, and only inside these communities (refinement).
    """
    at, other, weight = adjacency
    total = np.bincount(label, sizes, len(label)).astype(float)
    count = np.bincount(label, minlength=len(label))
    queue, queued, moved = list(range(len(label))), np.ones(len(label), bool), False
    for v in queue:
        queued[v] = False
        if within is not None and count[label[v]] > 1:
            continue
        near, w = other[at[v] : at[v + 1]], weight[at[v] : at[v + 1]]
        keep = near != v
        if within is not None:
            keep &= within[near] == within[v]
        near, w = near[keep], w[keep]
        own = label[v]
        communities, inverse = np.unique(label[near], return_inverse=True)
        gains = np.bincount(inverse, w, len(communities)) - gamma * sizes[v] * (total[communities] - sizes[v] * (communities == own))
        stay = float(gains[communities == own].sum()) if (communities == own).any() else -gamma * sizes[v] * (total[own] - sizes[v])
        best, to = stay, own
        if len(gains) and gains.max() > best + 1e-12:
            best, to = float(gains.max()), int(communities[np.argmax(gains)])
        if best < -1e-12 and within is None:  # alone is better
            to = int(np.flatnonzero(count == 0)[0])
        if to != own:
            total[own] -= sizes[v]
            total[to] += sizes[v]
            count[own] -= 1
            count[to] += 1
            label[v] = to
            moved = True
            if within is None:
                wake = near[(label[near] != to) & ~queued[near]]
                queued[wake] = True
                queue.extend(wake.tolist())
    return moved


def cpm_labels(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, gamma: float, initial: np.ndarray | None = None, rounds: int = 3, weights: np.ndarray | None = None) -> np.ndarray:
    """Communities of nodes 0..n - 1, dense from 0. ``weights``: how many nodes each stands for (1)."""
    label = np.arange(n) if initial is None else np.unique(initial, return_inverse=True)[1].copy()
    for _ in range(rounds):
        before, groups, sizes = label.copy(), np.arange(n), np.ones(n) if weights is None else weights.astype(float)
        s, d, x, part = src, dst, w, label.copy()
        while True:
            adjacency = _neighbours(len(sizes), s, d, x)
            moved = _move(part, sizes, adjacency, gamma)
            label = np.unique(part, return_inverse=True)[1][groups]
            if not moved or len(np.unique(part)) == len(sizes):
                break
            fine = np.arange(len(sizes))
            _move(fine, sizes, adjacency, gamma, within=part)
            new, fine = np.unique(fine, return_inverse=True)
            if len(new) == len(sizes):
                break
            coarse = np.zeros(len(new), np.int64)
            coarse[fine] = np.unique(part, return_inverse=True)[1]
            groups, sizes = fine[groups], np.bincount(fine, sizes, len(new))
            keys, inverse = np.unique(np.minimum(fine[s], fine[d]) * len(new) + np.maximum(fine[s], fine[d]), return_inverse=True)
            x = np.bincount(inverse, x, len(keys))
            s, d = keys // len(new), keys % len(new)
            part = coarse
        if (np.unique(label, return_inverse=True)[1] == np.unique(before, return_inverse=True)[1]).all():
            break
    return np.unique(label, return_inverse=True)[1]


def _moves(nodes: DataFrame, edges: DataFrame, gamma: float, tables: Tables, rounds: int = 8) -> DataFrame:
    """id, size, label after rounds in which half of the nodes (by hash) take their best community, until two rounds move nothing. ``nodes``: id, size, label.

    A node's choices are its neighbours' communities, its own, and its id as a label of its own if no community has it.
    """
    both = tables.keep(edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")))
    own_tables = Tables(nodes.sparkSession, "labels")
    label, still = own_tables.keep(nodes.select("id", "size", "label")), 0
    for k in range(rounds):
        sizes = label.groupBy(F.col("label").alias("to")).agg(F.sum("size").alias("n"))
        near = both.join(label.select(F.col("id").alias("dst"), F.col("label").alias("to")), "dst").select(F.col("src").alias("id"), "to", "weight")
        choices = near.union(label.select("id", "label", F.lit(0.0))).union(label.select("id", "id", F.lit(0.0))).groupBy("id", "to").agg(F.sum("weight").alias("w"))
        scored = choices.join(label, "id").join(sizes, "to", "left")
        own = F.col("to") == F.col("label")
        others = F.coalesce("n", F.lit(0.0)) - F.when(own, F.col("size")).otherwise(0.0)
        gain = F.round(F.col("w") - gamma * F.col("size") * others, 9)
        best = scored.groupBy("id").agg(F.first("size").alias("size"), F.first("label").alias("label"), F.max(F.struct(gain.alias("gain"), own.alias("stay"), F.col("to"))).alias("best"))
        turn = F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)) == 0
        new = own_tables.keep(best.select("id", "size", "label", F.when(turn, F.col("best.to")).otherwise(F.col("label")).alias("new")))
        own_tables.drop(1)
        still = 0 if new.filter("new <> label").limit(1).count() else still + 1
        label = new.select("id", "size", F.col("new").alias("label"))
        if still == 2:
            break
    tables.paths += own_tables.paths
    return label


def _whole(nodes: DataFrame, edges: DataFrame, gamma: float) -> DataFrame:
    """id, bin: each component in a task. ``nodes``: id, size, label, component; ``edges``: src, dst, weight, component."""

    def solve(key, members: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("id")
        ids = members["id"].to_numpy()
        s, d = (np.searchsorted(ids, links[e]) for e in ("src", "dst"))
        labels = cpm_labels(len(ids), s, d, links["weight"].to_numpy(), gamma, members["label"].to_numpy(), weights=members["size"].to_numpy())
        least = np.zeros(labels.max() + 1, np.int64)
        least[labels[::-1]] = ids[::-1]
        return pd.DataFrame({"id": ids, "bin": least[labels]})

    nodes, edges = nodes.select("component", "id", "size", "label"), edges.select(F.col("component").alias("part"), "src", "dst", "weight")
    return nodes.groupBy("component").cogroup(edges.groupBy("part")).applyInPandas(solve, "id long, bin long")


def _contracted(nodes: DataFrame, edges: DataFrame, gamma: float, limit: int, tables: Tables) -> DataFrame:
    """id, bin of components of any size. Columns as in ``_whole``; labels do not cross components."""
    moved = _moves(nodes, edges, gamma, tables)
    ends = [moved.select(F.col("id").alias(e), F.col("label").alias(f"{e}_label")) for e in ("src", "dst")]
    inner = edges.join(ends[0], "src").join(ends[1], "dst").filter("src_label = dst_label").select("src", "dst")
    # the connected parts of a community are contracted apart: the solver may join them again, moves cannot part them
    into = tables.keep(graph.connected_components(moved.select("id"), inner, tables).select("id", F.col("component").alias("to")))
    groups = tables.keep(nodes.select("id", "size", "component").join(into, "id").groupBy("component", F.col("to").alias("id")).agg(F.sum("size").alias("size")).withColumn("label", F.col("id")))
    ends = [into.select(F.col("id").alias(e), F.col("to").alias(f"{e}_to")) for e in ("src", "dst")]
    crossing = edges.join(ends[0], "src").join(ends[1], "dst").filter("src_to <> dst_to")
    links = tables.keep(crossing.groupBy("component", F.least("src_to", "dst_to").alias("src"), F.greatest("src_to", "dst_to").alias("dst")).agg(F.sum("weight").alias("weight")))
    sizes = groups.groupBy("component").agg(F.count("*").alias("m"))
    fit, rest = (sizes.filter(c).select("component") for c in (F.col("m") <= limit, F.col("m") > limit))
    found = _whole(groups.join(fit, "component", "left_semi"), links.join(fit, "component", "left_semi"), gamma)
    if rest.limit(1).count():
        left, far = groups.join(rest, "component", "left_semi"), links.join(rest, "component", "left_semi")
        before = nodes.join(rest, "component", "left_semi").count()
        # communities that no move has joined stay as they are: nothing is left to contract
        found = found.union(_contracted(left, far, gamma, limit, tables) if left.count() < before else left.select("id", F.col("id").alias("bin")))
    return into.join(found.withColumnRenamed("id", "to"), "to").select("id", "bin")


def cpm_partition(nodes: DataFrame, edges: DataFrame, gamma: float, limit: int = LIMIT, passes: int = 2) -> DataFrame:
    """id, bin of every node. ``edges``: src, dst, weight above 0; ``nodes``: id, and a label to start from, if any.

    Components of over ``limit`` nodes are contracted and solved ``passes`` times, each pass starting its moves of
    single nodes from the bins of the one before.
    """
    tables = Tables(nodes.sparkSession, "parts")
    edges = tables.keep(edges.filter("weight > 0 AND src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight")))
    start = nodes.select("id", (F.col("label") if "label" in nodes.columns else F.col("id")).alias("label"), F.lit(1.0).alias("size"))
    placed = tables.keep(start.join(graph.connected_components(nodes, edges, tables), "id"))
    sizes = tables.keep(placed.groupBy("component").agg(F.count("*").alias("n")))
    parts = edges.join(placed.select(F.col("id").alias("src"), "component"), "src").join(sizes, "component")
    whole = sizes.filter((F.col("n") > 1) & (F.col("n") <= limit)).select("component")
    alone = placed.join(sizes.filter("n = 1"), "component").select("id", F.col("id").alias("bin"))
    out = _whole(placed.join(whole, "component"), parts.filter(F.col("n") <= limit), gamma).union(alone)
    if sizes.filter(F.col("n") > limit).limit(1).count():
        big = placed.join(sizes.filter(F.col("n") > limit).select("component"), "component")
        far = tables.keep(parts.filter(F.col("n") > limit).select("component", "src", "dst", "weight"))
        for _ in range(passes):
            own = Tables(nodes.sparkSession, "pass")
            least = big.groupBy("component", "label").agg(F.min("id").alias("least"))  # labels to start from may cross components
            big = own.keep(big.join(least, ["component", "label"]).select("id", "size", "component", F.col("least").alias("label")))
            found = _contracted(big, far, gamma, limit, own)
            big = tables.keep(big.drop("label").join(found.withColumnRenamed("bin", "label"), "id"))
            own.drop()
        out = out.union(big.select("id", F.col("label").alias("bin")))
    bins = Tables(nodes.sparkSession, "bins").keep(out)
    tables.drop()
    return bins


def density_scale(n: int, mean_degree: float, coverage_active: bool, coverage_share: float, config) -> float:
    """Factor of the resolution (FN-21); every branch times 1.05."""
    if n <= config.search.exact_rows:
        s = config.evidence.resolution
    elif coverage_active:
        s = min(max(mean_degree / 8.0, 1.0), 1.75)
    else:
        s = min(max(mean_degree / 10.0, 0.35), 0.85) if coverage_share >= 0.98 else 1.25
    return s * 1.05


def unknown_k(views: DataFrame, pairs: DataFrame, nulls: dict[str, DataFrame], config, locked: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Bins without a preset number (ML-14): id, bin, and the statistics of the run.

    ``views``: id, a, b (unit rows: embedding and coverage); ``pairs``: src < dst;
    ``nulls``: for a and b, scores of pairs at random; ``locked``: ids to keep alone (contig, locked).
    """
    tables = Tables(views.sparkSession, "evidence")
    nodes = tables.keep(views.select("id"))
    n = nodes.count()
    if locked is not None:
        shut = locked.filter("locked").select(F.col("contig").alias("id"))
        pairs = pairs.join(shut.select(F.col("id").alias("src")), "src", "left_anti").join(shut.select(F.col("id").alias("dst")), "dst", "left_anti")
    own = Tables(views.sparkSession, "views")
    scored = streamed.pair_dots(pairs.select("src", "dst"), {k: streamed.files(streamed.kept(views.select("id", F.col(k).alias("u")), own)) for k in ("a", "b")}, tables)
    own.drop()
    label, stats = nodes.withColumn("label", F.col("id")), {"rounds": 0, "candidate_edges": scored.count(), "mean_degree": 0.0, "density_scale": 1.0, "active": ""}
    null = {k: evidence.robust_null(s).first() for k, s in nulls.items()}
    tail = "b" if null["b"]["scale"] >= 1e-3 else "a"
    prior = evidence.upper_tail_prior(nulls[tail], 2_000 if n > 10 else 100, null=null[tail]).first()[0]
    share = views.agg(F.avg((dot(F.col("b"), F.col("b")) > 1e-16).cast("int"))).first()[0] or 0.0
    for k in range(config.evidence.rounds if stats["candidate_edges"] else 0):
        fits = {x: evidence.fit_mixture(nulls[x], prior, null=null[x]) for x in ("a", "b")}
        odds = scored.withColumns({f"e_{x}": evidence.log_odds(F.col(x), fits[x]) for x in ("a", "b")})
        top = odds.agg(F.max("e_a").alias("a"), F.max("e_b").alias("b")).first()
        active = [x for x in ("a", "b") if evidence.informative(fits[x]) and top[x] > 0] or ["a"]
        weight = sum((F.col(f"e_{x}") for x in active), F.lit(0.0))
        if len(active) == 2:
            weight = weight - config.evidence.disagreement * F.abs(F.col("e_a") - F.col("e_b"))
        cosine = lambda s: 2.0 / (1.0 + F.exp(-s)) - 1.0  # noqa: E731  (scores are clipped log-odds)
        middle = [evidence.quantiles(nulls[x].select(evidence.log_odds(cosine(F.col("score")), fits[x]).alias("e")), "e", [0.5])[0] for x in active]
        omitted = min(-1e-6, sum(middle))
        own = Tables(views.sparkSession, "kept")
        kept = own.keep(odds.select("src", "dst", (weight - omitted).alias("weight")).filter("weight > 0 AND NOT isnan(weight)"))
        m = kept.count()
        if not m:
            label = nodes.withColumn("label", F.col("id"))
            stats |= {"rounds": k + 1, "mean_degree": 0.0, "density_scale": 1.0}
            break
        degree = 2.0 * m / max(n, 1)
        scale = density_scale(n, degree, "b" in active, share, config)
        label = cpm_partition(label, kept, max(-omitted * scale, 1e-6)).withColumnRenamed("bin", "label")
        own.drop()
        stats |= {"rounds": k + 1, "mean_degree": degree, "density_scale": scale, "omitted_evidence": omitted, "active": "+".join(active), "pair_prior": prior}
        implied = metrics.pair_prior(label.withColumnRenamed("label", "bin")).first()[0]
        if abs(math.log(implied) - math.log(prior)) < config.evidence.settled:
            break
        prior = math.sqrt(prior * implied)
    state = label.select(F.col("id").alias("contig"), "label")
    shut = locked.select("contig", "locked") if locked is not None else state.select("contig", F.lit(False).alias("locked"))
    bins = completeness.isolate(state.join(shut, "contig", "left").withColumn("locked", F.coalesce("locked", F.lit(False))))
    return bins.withColumnRenamed("contig", "id"), stats


def null_scores(rows: DataFrame, samples: int, seed: int, held: list[str] | None = None, of: Tables | None = None) -> DataFrame:
    """i, j, score of random pairs of different rows (by rank of id), with replacement (JN-11): min(samples, max(1000, 200 n)) draws.

    ``rows``: id, u; ``held``: their files, if they are written already; ``of``: the tables that the result goes with.

    A draw is a fixed function of its number and the seed: residues modulo a prime, squared between two factors.
    """
    from ..functions.vectors import logit_of_cosine

    placed = features.dense_index(rows.select("id"), "id", "at").select("at", "id")
    n = placed.count()
    if n < 2:
        return rows.limit(0).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0.0).alias("score"))
    draws = rows.sparkSession.range(min(samples, max(1_000, 200 * n)))

    def pick(k: int):
        x = (2 * F.col("id") + (k + 1 + 1_000_003 * seed)) % PRIME * 48_271 % PRIME
        return x * x % PRIME * 69_621 % PRIME % n

    drawn = draws.select(pick(0).alias("i"), pick(1).alias("j")).filter("i <> j")
    a, b = (placed.select(F.col("at").alias(k), F.col("id").cast("long").alias(e)) for k, e in (("i", "src"), ("j", "dst")))
    own, of = Tables(rows.sparkSession, "views"), Tables(rows.sparkSession, "draws") if of is None else of
    scored = streamed.pair_dots(drawn.join(a, "i").join(b, "j"), {"c": streamed.files(streamed.kept(rows, own)) if held is None else held}, of)
    own.drop()
    return scored.select("i", "j", logit_of_cosine(F.col("c")).alias("score"))
