"""Training over executors against the plain trainer on arrays."""

import numpy as np
import pytest

from contigbin.config import BinningConfig, Search, Training
from contigbin.operators import model, training
from pyspark.sql import functions as F

HOW = Training(epochs=(10, 20), check_every=5, hidden=8, latent=4)


def planted(n=90, groups=3, width=6, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    x = model.unit_rows(centres[np.arange(n) % groups] + 0.2 * rng.normal(size=(n, width)))[0]
    return x, np.array([(i, i + groups) for i in range(n - groups)] + [(i, i + 2 * groups) for i in range(n - 2 * groups)])


def frames(spark, x, edges):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, u array<double>").repartition(3), spark.createDataFrame(edges.tolist(), "src long, dst long")


def masks(n, how, seed, epoch):
    ids = np.arange(n)
    share = training.hashed_share
    return np.flatnonzero((share(ids, seed) >= how.held_out) & (share(ids, seed + 7919 * epoch) < how.masked)), np.flatnonzero(share(ids, seed) < how.held_out)


def test_one_part_is_full_batch_training(spark):
    """With all neighbours and one part: the gradients, losses and embeddings of the plain model."""
    x, edges = planted()
    rows, links = frames(spark, x, edges)
    parts = training.parts_of(rows, links, 0)
    net, twin = (model.Autoencoder(6, 8, 4, 1 / 11, 0) for _ in range(2))
    spread = model.spreader(90, *edges.T)
    masked, held = masks(90, HOW, 0, 1)
    loss, grads, running = training.gradients(parts, net, HOW, 0, 1)
    want, own = twin.step(x, spread, masked)
    assert loss == pytest.approx(want) and all(np.allclose(grads[k], own[k]) for k in own) and all(np.allclose(running[k], twin.running[k]) for k in running)
    assert training.held_out_loss(parts, twin, HOW, 0) == pytest.approx(model.masked_cosine_loss(twin.reconstruct(x, spread, held), x, held)[0])
    z = {r["id"]: r["z"] for r in training.embedded(parts, twin).collect()}
    assert np.allclose([z[k] for k in range(90)], twin.encode(x, spread)[0])


def test_many_parts_cover_every_node_once_and_agree_on_masks(spark):
    x, edges = planted()
    rows, links = frames(spark, x, edges)
    parts = training.parts_of(rows, links, 0, size=20, fanout=(2, 1))
    import io

    found = [np.load(io.BytesIO(r["data"])) for r in parts.collect()]
    assert len(found) > 3 and sorted(np.concatenate([p["ids"][p["core"]] for p in found]).tolist()) == list(range(90))
    for p in found:
        out = np.bincount(p["i"], minlength=len(p["ids"]))
        assert np.allclose(p["x"], x[p["ids"]]) and (out[p["core"]] <= 3).all() and (out >= 1).all()
    # sampled weights keep their sum on average
    full = model.spreader(90, *edges.T)(np.ones((90, 1))).sum()
    kept = sum(training.gatherer(len(p["ids"]), p["i"], p["j"], p["w"])(np.ones((len(p["ids"]), 1)))[p["core"]].sum() for p in found)
    assert kept == pytest.approx(full, rel=0.1)


def test_loss_is_near_that_of_the_plain_trainer(spark):
    """The margin that is promised: a held-out loss within 0.05 (cosine) of full-batch training, with parts of a quarter of the nodes."""
    x, edges = planted(200)
    rows, links = frames(spark, x, edges)
    config = BinningConfig(search=Search(neighbours=5), training=HOW)
    _, _, plain = model.train(x, edges, config)
    _, final, told = training.train(rows, links, config, size=50, fanout=(3, 2))
    assert abs(told["held_out_loss"] - plain["held_out_loss"]) < 0.05 and told["epochs"] == plain["epochs"]
    assert final.count() == len(edges) == told["edges"]


def test_graph_is_rebuilt_from_evidence_and_every_row_embedded(spark):
    rng = np.random.default_rng(3)
    centres, group = rng.normal(size=(6, 12)), np.arange(120) % 6
    a, b = (model.unit_rows(centres[group] + 0.15 * rng.normal(size=(120, 12)))[0] for _ in range(2))
    rows = spark.createDataFrame([(i, u.tolist(), v.tolist()) for i, (u, v) in enumerate(zip(a, b, strict=True))], "id long, u array<double>, b array<double>")
    config = BinningConfig(search=Search(neighbours=10), training=Training(epochs=(5, 10), check_every=5, hidden=8, latent=4))
    supported = spark.createDataFrame([(0, 1)], "src long, dst long")
    rebuild = training.Rebuilder(rows, supported, config)
    pairs = np.array(rebuild(rows.select("id", F.col("u").alias("z"))).collect())
    inside = group[pairs[:, 0]] == group[pairs[:, 1]]
    assert [0, 1] in pairs.tolist() and (pairs[:, 0] < pairs[:, 1]).all() and inside.sum() > 300 and (~inside).sum() == 1
    z, told = training.embed(rows, supported, config, supported, size=40)
    out = {r["id"]: r["z"] for r in z.collect()}
    assert len(out) == 120 and np.allclose(np.linalg.norm(list(out.values()), axis=1), 1) and told["nodes"] == "120"


def test_effective_rank_of_all_rows(spark):
    x = np.random.default_rng(5).normal(size=(300, 7)) * [1, 2, 3, 4, 5, 0.1, 0]
    rows = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "z array<double>").repartition(4)
    assert training.effective_rank(rows, "z") == pytest.approx(model.effective_rank(x), abs=1e-4)
    few = spark.createDataFrame([(v.tolist(),) for v in x[:4]], "z array<double>")
    assert training.effective_rank(few, "z") == pytest.approx(model.effective_rank(x[:4]), abs=1e-3)
    assert training.effective_rank(rows.limit(0), "z") == 0


def test_training_needs_two_nodes(spark):
    rows, links = frames(spark, np.eye(2)[:1], np.array([[0, 0]]))
    with pytest.raises(ValueError, match="at least two"):
        training.train(rows, links, BinningConfig(training=HOW))


def test_a_part_works_out_what_its_own_nodes_need(spark):
    """Before, both layers and the decoder ran over all neighbours of neighbours: with the statistics held, the embedding is the same from fewer rows."""
    import io

    rows, links = frames(spark, *planted())
    parts = [dict(np.load(io.BytesIO(r["data"]))) for r in training.parts_of(rows, links, 0, size=20, fanout=(2, 1)).collect()]
    net = model.Autoencoder(parts[0]["x"].shape[1], 8, 4, 1 / 11, 0)
    counted = {1: 0, 2: 0}
    for part in parts:
        n, (own, near) = len(part["ids"]), part["known"]
        assert part["core"][:own].all() and not part["core"][own:].any() and own <= near <= n
        z, (*_, first, second) = net.encode(part["x"], training.layered(part))
        counted[1] += len(first[0])
        counted[2] += len(second[0])
        assert len(z) == own and np.allclose(z, net.encode(part["x"], training.gatherer(n, part["i"], part["j"], part["w"]))[0][:own])
    assert counted[2] == rows.count() and counted[1] < sum(len(p["ids"]) for p in parts)
