"""Fixtures A1-A27 and hand-checked cases of the operators."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contigbin.config import BinningConfig, Search, Training
from contigbin.functions import dna, vectors
from contigbin.operators import completeness, evidence, features, graph, labelling, metrics, model, neighbours, partition, simulate
from contigbin.plans import binning
from contigbin.sources import fasta, gfa, tables
from contigbin.streaming.ingest import ingest


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def turned(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def test_reverse_complement(spark):
    assert one(spark, dna.reverse_complement(F.lit("AACGTN"))) == "NACGTT"
    assert len(dna.canonical_kmers(4)) == 136


def repeats_by_hand(s, k):
    """Every length is tried: the shortest suffix that begins like the sequence, and the longest start that it has in common with its other strand."""
    lengths = range(k, len(s)) if len(s) >= 4 * k else ()
    begins = [m for m in lengths if s[-m:].startswith(s[:k])][:1]
    common = [m for m in lengths if 2 * m <= len(s) and turned(s).startswith(s[:m])]
    return max((m for m in begins if 2 * m <= len(s) and s.startswith(s[-m:])), default=0), max(common, default=0)


def test_terminal_repeats(spark):
    rng = random.Random(1)
    unit = "".join(rng.choice("ACGT") for _ in range(21))
    cases = [unit + "G" * 80 + unit, unit + "A" * 60 + turned(unit), unit * 4, "ACGT" * 30, "A" * 10, ""]
    for _ in range(120):
        s = "".join(rng.choice("AC") for _ in range(rng.randint(10, 60)))
        cases.append(s + s[: rng.randint(0, 9)] if rng.random() < 0.5 else s + turned(s[: rng.randint(0, 9)]))
    for k in (3, 21):
        got = {r["contig"]: (r["direct_repeat"], r["inverted_repeat"]) for r in completeness.terminal_repeats(frame(spark, list(enumerate(cases)), "contig long, sequence string"), k).collect()}
        assert got == {i: repeats_by_hand(s, k) for i, s in enumerate(cases)}
    assert repeats_by_hand(cases[0], 21) == (21, 0)


def test_gate_and_isolation(spark):
    rows = frame(spark, [(0, 0, False), (1, 0, True), (2, 1, False), (3, 1, False)], "contig long, label long, locked boolean")
    bins = {r["contig"]: r["bin"] for r in completeness.isolate(rows).collect()}
    assert bins[0] != bins[1] and bins[2] == bins[3] and sorted(set(bins.values())) == [0, 1, 2]
    gated = completeness.gate(frame(spark, [(0, 1000, 50, 0), (1, 1000, 19, 0), (2, 100, 0, 40)], "contig long, length long, direct_repeat long, inverted_repeat long"))
    assert [r["locked"] for r in gated.orderBy("contig").collect()] == [True, False, False]


def test_unit_rows_and_logit(spark):
    rows = frame(spark, [([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 2.0],)], "x array<double>").select(vectors.unit(F.col("x")).alias("u")).collect()
    assert [math.hypot(*r["u"]) for r in rows] == [1.0, 0.0, 1.0]
    scores = [one(spark, vectors.logit_of_cosine(F.lit(c))) for c in (-1.0, 0.0, 1.0)]
    assert scores == sorted(scores) and all(map(math.isfinite, scores))
    for z in (-3.0, -0.5, 0.0, 0.7, 2.5):
        assert one(spark, vectors.upper_tail(F.lit(z))) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=2e-7)


def test_neighbours_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 5))
    x[40] = x[7]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = frame(spark, [(i, v.tolist()) for i, v in enumerate(u)], "id long, u array<double>")
    c = np.round(u @ u.T, 9)
    np.fill_diagonal(c, -9)
    want = {(i, j) for i in range(90) for j in np.argsort(-c[i], kind="stable")[:4].tolist()}
    for block in (2048, 20):
        assert {(r["i"], r["j"]) for r in neighbours.top_k(rows, 4, block=block).collect()} == want
    pairs = {(r["src"], r["dst"]) for r in neighbours.reciprocal_knn(rows, 4).collect()}
    assert pairs == {(i, j) for i, j in want if i < j and (j, i) in want}
    near = {(r["src"], r["dst"]) for r in neighbours.reciprocal_knn(rows, 4, exact_limit=10).collect()}
    assert all(a < b for a, b in near) and len(near & pairs) >= 0.8 * len(pairs)


def test_reciprocal_neighbours_are_exact_above_4000_rows(spark):
    x = np.random.default_rng(3).normal(size=(4_100, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 9)
    np.fill_diagonal(c, -9)
    near = {(i, j) for i, row in enumerate(np.argsort(-c, axis=1, kind="stable")[:, :8].tolist()) for j in row}
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(u)), "u": u.tolist()}))
    got = {(r["src"], r["dst"]) for r in neighbours.reciprocal_knn(rows, 8).select("src", "dst").collect()}
    assert got == {(i, j) for i, j in near if i < j and (j, i) in near}


def test_graph_merge_adjacency_components(spark):
    a, b = (frame(spark, e, "src long, dst long") for e in ([(0, 1), (1, 2)], [(1, 2), (2, 3)]))
    s = graph.merge_stats(a, b).first()
    assert (s["n_union"], s["n_added"], s["n_both"]) == (3, 1, 1)
    nodes = frame(spark, [(0,), (1,), (2,), (9,)], "id long")
    adj = {(r["src"], r["dst"]): r["weight"] for r in graph.normalized_adjacency(nodes, a).collect()}
    assert all(adj[i, j] == adj[j, i] for i, j in adj) and all(adj[i, i] > 0 for i in (0, 1, 2, 9))
    assert {r["id"]: r["component"] for r in graph.connected_components(nodes, a).collect()} == {0: 0, 1: 0, 2: 0, 9: 9}
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    root = list(range(200))
    for _ in range(200):
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.range(200), frame(spark, edges, "src long, dst long")).collect()}
    assert got == dict(enumerate(root))


def test_degree_is_limited_above_the_exact_limit(spark):
    x = np.abs(np.random.default_rng(8).normal(size=(2, 40, 3)))
    u, v = x / np.linalg.norm(x, axis=2, keepdims=True)
    v[:5] = 0
    views = frame(spark, [(i, u[i].tolist(), v[i].tolist()) for i in range(40)], "id long, a array<double>, b array<double>")
    pairs = [(i, j) for i in range(40) for j in range(i + 1, 40)]
    score = {(i, j): u[i] @ u[j] + v[i] @ v[j] for i, j in pairs}
    top = {k: set(sorted((p for p in pairs if k in p), key=lambda p: -score[p])[:8]) for k in range(40)}
    given = frame(spark, pairs, "src long, dst long")
    got = lambda limit: {(r["src"], r["dst"]) for r in graph.limit_degree(views, given, limit).collect()}
    assert got(40) == set(pairs) and got(39) == {p for p in pairs if p in top[p[0]] and p in top[p[1]]}


def test_unknown_k_query_takes_the_configured_neighbours(spark, tmp_path, monkeypatch):
    from contigbin.plans import queries

    x = np.random.default_rng(9).normal(size=(80, 64))
    spark.createDataFrame([(i, i % 4, r.tolist()) for i, r in enumerate(x)], "vec_id long, label long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    seen = []
    monkeypatch.setattr(partition, "unknown_k", lambda views, pairs, *_: (seen.append(pairs), None))
    queries.QUERIES["unknown_k_binning"](spark, str(tmp_path))
    want = set()
    for part in (x[:, :32], x[:, 32:]):
        u = part / np.linalg.norm(part, axis=1, keepdims=True)
        c = np.round(u @ u.T, 9)
        np.fill_diagonal(c, -9)
        near = {(i, j) for i, row in enumerate(np.argsort(-c, axis=1, kind="stable")[:, : BinningConfig().search.neighbours].tolist()) for j in row}
        want |= {(i, j) for i, j in near if i < j and (j, i) in near}
    assert {(r["src"], r["dst"]) for r in seen[0].collect()} == want


def test_unknown_k_query_weighs_every_mutual_pair_above_the_exact_limit(spark, tmp_path, monkeypatch):
    """Before, pairs over a ceiling by node were dropped unseen where a table has more rows than are compared exactly."""
    from contigbin import config
    from contigbin.plans import queries

    x = np.random.default_rng(9).normal(size=(120, 64))
    spark.createDataFrame([(i, i % 4, r.tolist()) for i, r in enumerate(x)], "vec_id long, label long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    seen, limited = [], BinningConfig(search=config.Search(exact_rows=60))
    monkeypatch.setattr(partition, "unknown_k", lambda views, pairs, *_: (seen.append(pairs), None))
    for how in (BinningConfig(), limited):
        monkeypatch.setattr(config, "BinningConfig", lambda how=how: how)
        queries.QUERIES["unknown_k_binning"](spark, str(tmp_path))
    all_pairs, above = ({(r["src"], r["dst"]) for r in pairs.collect()} for pairs in seen)
    assert above == all_pairs and len(all_pairs) > 120 * graph.degree_ceiling(120) // 2


def test_metrics(spark):
    perfect = frame(spark, [(i, b, t) for i, (b, t) in enumerate([("a", "4"), ("a", "4"), ("b", "8"), ("b", "8")])], "contig long, bin string, truth string")
    assert tuple(metrics.precision_recall(perfect).first())[:3] == (1.0, 1.0, 1.0) and tuple(metrics.ari_nmi(perfect).first()) == (1.0, 1.0)
    none = metrics.precision_recall(perfect.withColumn("truth", F.lit(None).cast("string"))).first()
    assert math.isnan(none["f1"])
    same = lambda x, y: metrics.equivalent(frame(spark, list(zip(x, y, strict=True)), "a string, b string"), "a", "b").first()["equivalent"]
    assert same("00122", "azzqq".replace("a", "a")) is False and same("00122", "aazqq") is True and same("001", "abb") is False
    hq = frame(spark, [(i, "x", "g") for i in range(9)] + [(9, None, "g")], "contig long, bin string, truth string")
    assert metrics.high_quality_bins(hq).count() == 1
    sizes = metrics.size_stats(hq).first()
    assert (sizes["bins"], sizes["largest"]) == (1, 9)


def test_labelling(spark):
    spans = frame(spark, [("q", 0, 10), ("q", 10, 15), ("q", 20, 25), ("q", 21, 22)], "k string, start long, end long")
    assert labelling.interval_union(spans, "k").first()["covered"] == 20
    assert labelling.n50(frame(spark, [("a", x) for x in (5, 4, 3, 2, 1)], "g string, length long"), "g").first()["n50"] == 4
    assert one(spark, labelling.cigar_length(F.lit("10M2I3=4D5X1S"))) == 18
    hits = frame(spark, [("c", "J2", 98), ("c", "J1", 100), ("d", "K", 5)], "query string, target string, matches long").withColumn("block", F.col("matches") + 1)
    scored = labelling.identities(hits)
    assert {(r["query"], r["target"], r["n_tied"]) for r in labelling.best_targets(scored).collect()} == {("c", "J1", 2), ("d", "K", 1)}
    assert [tuple(r) for r in labelling.tied_pairs(scored).collect()] == [("J1", "J2")]
    ranks = labelling.average_ranks(frame(spark, [("s", v) for v in (1.0, 2.0, 2.0, 3.0)], "s string, v double"), "s", "v")
    assert sorted(r["rank_avg"] for r in ranks.collect()) == [1.0, 2.5, 2.5, 4.0]


def test_mixture(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.3, 4_000), rng.normal(3, 0.5, 400)])
    scores = frame(spark, [(float(v),) for v in x], "score double")
    fit = evidence.fit_mixture(scores, 0.1)
    assert fit["alt_mean"] == pytest.approx(3, abs=0.15) and fit["null_mean"] == pytest.approx(0, abs=0.1) and evidence.informative(fit)
    far = evidence.fit_mixture(scores, 0.1, rounds=5, local=0)
    near = evidence.fit_mixture(scores, 0.1, rounds=5)
    assert {k: pytest.approx(v, rel=1e-6) for k, v in far.items()} == near
    assert 1e-9 <= evidence.upper_tail_prior(scores).first()[0] <= 0.5
    none = scores.limit(0)
    assert evidence.fit_mixture(none, 0.1)["null_scale"] == 1e-9 and evidence.upper_tail_prior(none).first()[0] == 1e-9


def quality_of(labels, edges, gamma):
    inside = sum(w for a, b, w in edges if labels[a] == labels[b])
    return inside - gamma * sum(n * (n - 1) / 2 for n in np.bincount(labels))


def test_partition_finds_planted_groups(spark):
    rng = random.Random(4)
    edges = [(a, b, 1.0) for a in range(60) for b in range(a + 1, 60) if rng.random() < (0.6 if a // 20 == b // 20 else 0.02)]
    s, d, w = (np.array(x) for x in zip(*edges, strict=True))
    labels = partition.cpm_labels(60, s, d, w, 0.25)
    planted = np.arange(60) // 20
    assert quality_of(labels, edges, 0.25) >= quality_of(planted, edges, 0.25) - 1e-9 and len({(a, b) for a, b in zip(labels, planted, strict=True)}) <= 5
    rows = frame(spark, edges, "src long, dst long, weight double")
    got = {r["id"]: r["bin"] for r in partition.cpm_partition(spark.range(62), rows, 0.25).collect()}
    assert len(got) == 62 and got[60] == 60 and got[61] == 61
    again = np.unique([got[k] for k in range(60)], return_inverse=True)[1]
    assert quality_of(again, edges, 0.25) == pytest.approx(quality_of(labels, edges, 0.25))


def test_partition_of_contracted_components(spark):
    """Components over the limit, the contracted one too, from labels that cross components: the cliques."""
    cliques = [(a, b, 1.0) for a in range(24) for b in range(a + 1, 24) if a // 4 == b // 4]
    bridges = [(3, 4, 0.1), (7, 8, 0.1), (15, 16, 0.1), (19, 20, 0.1)]
    nodes = spark.range(25).withColumn("label", F.col("id") % 2)
    got = {r["id"]: r["bin"] for r in partition.cpm_partition(nodes, frame(spark, cliques + bridges, "src long, dst long, weight double"), 0.25, limit=2, passes=1).collect()}
    assert got == {k: k // 4 * 4 for k in range(25)}


def test_autoencoder_gradients():
    rng = np.random.default_rng(5)
    x = model.unit_rows(rng.normal(size=(12, 6)))[0]
    spread = model.spreader(12, np.array([0, 1, 5]), np.array([1, 2, 7]))
    net = model.Autoencoder(6, 5, 4, 1 / 11, 0)
    masked = np.array([0, 3, 4])
    net.w["mask"] = rng.normal(size=6) * 0.1
    _, grads = net.step(x, spread, masked)
    for k, g in grads.items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        old = net.w[k].copy()
        sides = []
        for e in (1e-5, -1e-5):
            net.w[k] = old.copy()
            net.w[k][at] += e
            sides.append(net.step(x, spread, masked)[0])
        net.w[k] = old
        assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=2e-3, abs=1e-6), k
    z = net.encode(x, spread)[0]
    assert sum(net.gates()) == pytest.approx(1) and np.allclose(np.linalg.norm(z, axis=1), 1)
    with pytest.raises(ValueError, match="masked node"):
        model.masked_cosine_loss(x, x, np.array([], int))


def test_config():
    with pytest.raises(ValueError, match="epochs.*masked"):
        BinningConfig(training=Training(epochs=(10, 5), masked=1.0))
    with pytest.raises(ValueError, match="neighbours"):
        BinningConfig(search=Search(neighbours=0))
    assert BinningConfig().training.graph_gate == pytest.approx(1 / 11) and BinningConfig().told()["training"]["settled_graph"] == 0.9


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.fixture
def inputs(tmp_path):
    rng = random.Random(3)
    probs = {0: "AAAC", 1: "GGGT"}
    seqs = ["".join(rng.choice(probs[k // 3]) for _ in range(2500)) for k in range(6)]
    records = "".join(f">contig_{k} an > example\n{s[:1000]}\n{s[1000:]}\n" for k, s in enumerate(seqs)) + ">short x\nACGT\n"
    depth = list(zip((100, 95, 90, 2, 2, 1), (1, 2, 2, 90, 95, 100), strict=True))
    table = "contig\tsample_a\tsample_b\n" + "".join(f"contig_{k}\t{a}\t{b}\n" for k, (a, b) in enumerate(depth))
    graph_text = "H\tVN:Z:1.0\n" + "".join(f"S\tcontig_{k}\t*\tLN:i:2500\tDP:f:3.5\n" for k in range(6)) + "L\tcontig_0\t+\tcontig_1\t+\t10M\nL\tcontig_3\t+\tcontig_4\t-\t5M2I3=\n"
    return {"seqs": seqs, "fasta": write(tmp_path / "x.fasta", records), "coverage": write(tmp_path / "c.tsv", table), "gfa": write(tmp_path / "g.gfa", graph_text), "dir": tmp_path}


def test_fasta(spark, inputs):
    got = fasta.read_fasta(spark, inputs["fasta"]).orderBy("position").collect()
    assert [r["contig"] for r in got] == [f"contig_{k}" for k in range(6)] + ["short"] and got[2]["sequence"] == inputs["seqs"][2] and got[0]["description"] == "contig_0 an > example"
    spark.dataSource.register(fasta.FastaSource)
    own = spark.read.format("fasta").option("path", inputs["fasta"]).load().orderBy("position").collect()
    assert [(r["contig"], r["sequence"]) for r in own] == [(r["contig"], r["sequence"]) for r in got]
    assert fasta.fasta_ids(spark, inputs["fasta"]).count() == 7
    for text, message in ((">a\nAC\n>a\nGT\n", "repeat"), (">a\n>b\nAC\n", "without"), ("AC\n>b\nAC\n", "without")):
        with pytest.raises(ValueError, match=message):
            fasta.checked(fasta.read_fasta(spark, write(inputs["dir"] / "bad.fa", text)))
    counts = features.dense_kmers(*(lambda c: (c, features.kmer_counts(c)))(fasta.checked(fasta.read_fasta(spark, inputs["fasta"])).filter("length(sequence) > 4")))
    assert counts.count() == 6 * 136 and counts.agg(F.sum("cnt")).first()[0] == 6 * 2497
    records = fasta.read_fasta(spark, inputs["fasta"])
    bins = records.select("contig", F.lit("b/1").alias("bin")).filter("contig <> 'short'")
    linked, missing = fasta.link_bins(records, bins.union(frame(spark, [("gone", "b/1")], "contig string, bin string")))
    row = linked.first()
    assert row["bin"] == "b_1" and len(row["sequence"]) == 6 * 2500 + 5 * 1500 and missing.first()[0] == "gone"
    assert one(spark, dna.wrapped(F.lit("A" * 170), 80)) == "\n".join(["A" * 80, "A" * 80, "A" * 10]) and one(spark, dna.wrapped(F.lit("A" * 160), 80)).count("\n") == 1


def test_graph_files(spark, inputs, tmp_path):
    contigs = frame(spark, [(f"contig_{k}",) for k in range(6)], "contig string")
    edges = gfa.contig_edges(gfa.read_links(spark, inputs["gfa"]), contigs)
    assert sorted(map(tuple, edges.collect())) == [("contig_0", "contig_1"), ("contig_3", "contig_4")]
    s = gfa.read_segments(spark, inputs["gfa"]).first()
    assert (s["length"], s["depth"]) == (2500, 3.5) and {r["overlap"] for r in gfa.read_links(spark, inputs["gfa"]).collect()} == {10, 8}
    two = frame(spark, [("contig_0",), ("contig_1",)], "contig string")
    text = "S\ta\tACG\nS\tb\t*\nP\tcontig_0\ta+\t*\nP\tcontig_1\tb+,a-\t*\nL\ta\t+\tb\t+\t0M\n"
    path = write(tmp_path / "p.gfa", text)
    assert [tuple(r) for r in gfa.contig_edges(gfa.read_links(spark, path), two, gfa.read_paths(spark, path)).collect()] == [("contig_0", "contig_1")]
    with pytest.raises(ValueError, match="do not map"):
        gfa.contig_edges(gfa.read_links(spark, path), two)
    with pytest.raises(ValueError, match="invalid L"):
        gfa.read_links(spark, write(tmp_path / "bad.gfa", "L\ta\t+\tb\n"), strict=True)
    walks = gfa.read_contig_paths(spark, write(tmp_path / "contigs.paths", "contig_0\na+,b-;\nc+\ncontig_0'\nb+\nother\nz+\ncontig_1\nb+\n"), two)
    assert [tuple(r) for r in walks.orderBy("contig", "pos").collect()] == [("contig_0", 0, "a", "+"), ("contig_0", 1, "b", "-"), ("contig_0", 2, "c", "+"), ("contig_1", 0, "b", "+")]
    info = write(tmp_path / "info.txt", "#seq_name\tlength\tgraph_path\ncontig_0\t5\t*,1,-2,??\n")
    assert [tuple(r) for r in gfa.read_path_table(spark, info, two).collect()] == [("contig_0", 0, "edge_1", "+"), ("contig_0", 1, "edge_2", "-")]
    fg = gfa.read_fastg(frame(spark, [("n1:n2',n3;",), ("n2';",)], "description string"))
    assert [tuple(r) for r in fg.collect()] == [("n1", "+", "n2", "-"), ("n1", "+", "n3", "+")]


def test_tables(spark, inputs, tmp_path):
    contigs = frame(spark, [(f"contig_{k}",) for k in range(7)], "contig string")
    assert tables.read_coverage(spark, inputs["coverage"]).count() == 12
    with pytest.raises(ValueError, match="missing 1 contigs"):
        tables.read_coverage(spark, inputs["coverage"], contigs)
    with pytest.raises(ValueError, match="finite"):
        tables.read_coverage(spark, write(tmp_path / "n.csv", "contig,s\na,-1\n"))
    lines = frame(spark, [("# x",), ("bin1\tcontig_0",), ("contig_1,bin2",), ("contig_0 bin1",)], "value string")
    assert sorted(map(tuple, tables.read_assignments(lines, contigs).collect())) == [("contig_0", "bin1"), ("contig_1", "bin2")]
    with pytest.raises(Exception, match="occurs in two bins"):
        tables.read_assignments(lines.union(frame(spark, [("contig_0 bin9",)], "value string")), contigs).collect()
    for text in ("cluster\tname\nb1\tx\nb1\ty\n", "b1\tx\nb1\ty\n"):
        assert sorted(map(tuple, tables.read_bins(spark, write(tmp_path / "bins.tsv", text)).collect())) == [("x", "b1"), ("y", "b1")]
    files = frame(spark, [(f"/r/{n}.fastq.gz",) for n in ("b_R1", "b_R2", "a_1", "a_2", "c")] + [("/r/x.txt",)], "path string")
    assert sorted(map(tuple, tables.read_pairs(files).select("sample", "stem", (F.col("r2").isNotNull()).alias("p")).collect())) == [("sample0", "a", True), ("sample1", "b", True), ("sample2", "c", False)]
    records, truth = frame(spark, [("contig_0", "A" * 2500), ("contig_1", "C" * 2500), ("x", "A")], "contig string, sequence string"), frame(spark, [("contig_0", "g1_s2"), ("contig_1", "unbinned")], "contig string, strain string")
    assert tables.export_cohort(records, truth, tables.read_coverage(spark, inputs["coverage"]), str(tmp_path / "cohort")) == 1
    assert spark.read.csv(str(tmp_path / "cohort/truth.tsv"), sep="\t", header=True).first()["species"] == "g1"
    old, new = (frame(spark, r, "k long, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], True).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], False).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    registry = tables.read_registry(spark, write(tmp_path / "r.tsv", "# note\ndataset\tstudy\nx\t-\n\ny\tz\n"))
    assert [tuple(r) for r in registry.collect()] == [("x", None), ("y", "z")]
    paf = tables.read_paf(spark, write(tmp_path / "a.paf", "q\t100\t0\t50\t+\tt\t200\t10\t60\t45\t50\t60\nbroken\n"))
    assert paf.count() == 1 and paf.first()["matches"] == 45


def test_binning_end_to_end(spark, inputs, tmp_path):
    config = BinningConfig(search=Search(neighbours=2, seed_neighbours=2), training=Training(epochs=(2, 2), check_every=2, hidden=8, latent=4))
    bins = binning.run(spark, inputs["fasta"], inputs["coverage"], inputs["gfa"], str(tmp_path / "out"), config=config)
    rows = bins.collect()
    assert len(rows) == 6 and {r["length"] for r in rows} == {2500}
    told = json.loads(spark.read.text(str(tmp_path / "out/run.json")).first()[0])
    assert told["contigs"] == 6 and told["assembly"]["candidates"] == 2
    written = spark.read.csv(str(tmp_path / "out/assignments.tsv"), sep="\t", header=True)
    assert written.columns == ["contig_id", "bin_id", "length"] and written.count() == 6


def test_prepared_dataset_is_binned(spark, inputs, tmp_path):
    from contigbin.sources import dataset, gfa

    config = BinningConfig(search=Search(neighbours=2, seed_neighbours=2))
    records = fasta.checked(fasta.read_fasta(spark, inputs["fasta"]))
    kept = records.filter("length(sequence) >= 2000").select("contig")
    edges = gfa.contig_edges(gfa.read_links(spark, inputs["gfa"]), kept, gfa.read_paths(spark, inputs["gfa"]))
    path = str(tmp_path / "prepared")
    dataset.write_dataset(records, tables.read_coverage(spark, inputs["coverage"]), edges, path)
    # stored counts give the views that the sequences give
    coverage = tables.read_coverage(spark, inputs["coverage"])
    own = records.join(kept, "contig", "left_semi")
    a, b = ({r["contig"]: (r["a"], r["b"]) for r in v.collect()} for v in (binning.feature_views(own, coverage), binning.feature_views(kept, coverage, dataset.read_dataset(spark, path)["kmers"])))
    assert a.keys() == b.keys() and all(np.allclose(x, y) for k in a for x, y in zip(a[k], b[k], strict=True))
    bins = binning.run_prepared(spark, path, str(tmp_path / "b"), config=config, learn=False)
    told = json.loads(spark.read.text(str(tmp_path / "b/run.json")).first()[0])
    assert bins.count() == 6 and (told["locked"], told["withheld_edges"]) == (0, 0) and not (tmp_path / "b/bins").exists()
    with pytest.raises(FileNotFoundError):
        binning.run_prepared(spark, str(tmp_path / "none"), str(tmp_path / "c"))


def test_command_line(capsys):
    from contigbin import __version__, cli

    with pytest.raises(SystemExit) as end:
        cli.main(["--version"])
    assert end.value.code == 0 and capsys.readouterr().out == f"contigbin {__version__}\n"
    assert cli.main(["doctor"]) == 0 and "all packages found" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["bin", "only-one"])


def test_length_filter_makes_dense_ids(spark):
    rows = frame(spark, [(n, l) for n, l in zip("abcde", (1000, 2500, 1500, 2500, 2500), strict=True)], "contig string, length long")
    assert [tuple(r) for r in features.retained(rows, 2000).orderBy("contig").select("contig", "node_index").collect()] == [("b", 0), ("d", 1), ("e", 2)]


def test_simulation(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(400)) for _ in range(4)]
    genomes = frame(spark, [("gut", f"g{k}", s) for k, s in enumerate([*seqs, seqs[0], "ACGT"])], "biome string, source_id string, sequence string")
    pool = simulate.genome_pool(genomes, 100)
    assert sorted(r["genome_id"] for r in pool.collect()) == ["gut_001", "gut_002", "gut_003", "gut_004"]
    made = simulate.strains(pool, 3, 0.9).collect()
    assert len(made) == 12 and all(r["ani_to_base"] == 1 for r in made if r["strain_id"].endswith("_s1")) and 0.8 < np.mean([r["ani_to_base"] for r in made if not r["strain_id"].endswith("_s1")]) < 0.96
    shares = simulate.abundances(frame(spark, [(f"s{k}",) for k in range(20)], "strain_id string"), 3)
    assert all(r[1] == pytest.approx(1) for r in shares.groupBy("sample").agg(F.sum("share")).collect())
    lengths = frame(spark, [(f"s{k}", 100 + k) for k in range(20)], "strain string, length long")
    assert all(r[1] == pytest.approx(1) for r in simulate.depths(shares, lengths).filter("depth > 0").groupBy("sample").agg(F.avg("depth")).collect())
    with pytest.raises(ValueError, match="without a length"):
        simulate.depths(shares, lengths.limit(5))


def test_ingest_takes_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.fa", ">x one\nac\ngt\n>y\nTT\n")
    for expected in (2, 3):
        ingest(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "table")).count() == expected
        write(folder / "b.fa", ">z\nGG\n")
    assert {r["contig"]: r["sequence"] for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {"x": "ACGT", "y": "TT", "z": "GG"}


def test_reports(spark):
    names = {"Alfalfa_mosaic_virus_RNA1_MZ405653": "Alfalfa_mosaic_virus", "Banana_bunchy_top_virus_DNA-C": "Banana_bunchy_top_virus", "Phage_X": "Phage_X", "NC_001416.1": "NC_001416.1"}
    assert {n: one(spark, labelling.agent_name(F.lit(n))) for n in names} == names | {"NC_001416.1": one(spark, labelling.agent_name(F.lit("NC_001416.1")))}
    genes = frame(spark, [("a", 0, 300, "+", 0.5, 11), ("a", 400, 500, "-", 0.3, 11), ("a", 600, 700, "-", 0.4, 4)], "contig string, start long, end long, strand string, gc double, table long")
    rows = {r["contig"]: r for r in labelling.gene_architecture(genes, frame(spark, [("a", 1000), ("b", 500)], "contig string, length long")).collect()}
    assert (rows["a"]["n_orfs"], rows["a"]["coding_density"], rows["a"]["strand_switch_rate"], rows["a"]["translation_table"]) == (3, 0.5, 0.5, 11) and rows["b"]["n_orfs"] == 0
    clusters = labelling.protein_clusters(frame(spark, [("p1", "a", "x"), ("p2", "b", "x"), ("p3", "a", None)], "protein string, contig string, cluster string"))
    assert sorted(map(tuple, clusters.collect())) == [("a", "p3", 1, 1, 1), ("a", "x", 1, 2, 2), ("b", "x", 1, 2, 2)]
    assert [r[0] for r in labelling.dead_samples(frame(spark, [("s", 1.0), ("s", 1.0), ("t", 1.0), ("t", 2.0)], "sample string, depth double")).collect()] == ["s"]
    pairs = labelling.reachable_pairs(frame(spark, [("a", 1), ("b", 1), ("c", 1)], "contig string, label long"), frame(spark, [("a", 0), ("b", 0), ("c", 2)], "id string, component long"))
    assert tuple(pairs.first()) == (3, 1)


def test_quantiles_are_exact_beyond_what_is_brought_to_the_driver(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=4_000), np.full(3_000, 0.25), rng.normal(size=2_000) * 1e-3])
    rows = spark.createDataFrame(pd.DataFrame({"x": x})).union(spark.createDataFrame([(None,)], "x double"))
    levels = [0.0, 0.1, 0.5, 0.77, 0.999, 1.0]
    for local in (50, 700, 100_000):
        assert evidence.quantiles(rows, "x", levels, local) == pytest.approx(np.quantile(x, levels).tolist(), abs=1e-12)


def test_quantile_levels_share_one_count(spark, monkeypatch):
    rows = spark.range(1_001).select(F.col("id").cast("double").alias("x"))
    real, calls = type(rows).count, []
    monkeypatch.setattr(type(rows), "count", lambda df: (calls.append(1), real(df))[1])
    levels = np.linspace(0, 1, 200).tolist()
    assert evidence.quantiles(rows, "x", levels) == pytest.approx([1_000 * q for q in levels])
    assert len(calls) == 1


def test_encoder_of_all_rows_equals_that_of_one_task(spark):
    """The distributed layers give what the model gives in memory."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(3, 6))
    x = model.unit_rows(centres[np.arange(45) % 3] + 0.2 * rng.normal(size=(45, 6)))[0]
    edges = np.array([(i, i + 3) for i in range(42)])
    config = BinningConfig(search=Search(neighbours=5), training=Training(epochs=(10, 20), check_every=5, hidden=8, latent=4))
    net, _, stats = model.train(x, edges, config)
    rows = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, u array<double>")
    links = frame(spark, edges.tolist(), "src long, dst long")
    got = {r["id"]: r["z"] for r in model.encode_all(rows, links, model._packed(net)).collect()}
    assert np.allclose([got[k] for k in range(45)], net.encode(x, model.spreader(45, *edges.T))[0])


def digits_of_size(rows):
    """Binary digits of the size that the planner takes a table to have."""
    return rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_rounds_do_not_multiply_the_estimated_size(spark):
    """A checkpoint keeps its estimate and every join multiplies it: after ten rounds it took the driver's whole memory."""
    chain = frame(spark, [(k, k + 1, 1.0) for k in range(300)], "src long, dst long, weight double")
    found = graph.connected_components(spark.range(301), chain)
    assert digits_of_size(found) < 150 and {r["component"] for r in found.collect()} == {0}
    bins = partition.cpm_partition(spark.range(301), chain, 0.25, limit=40, passes=1)
    assert digits_of_size(bins) < 150 and bins.count() == 301


def test_tables_of_rounds_are_removed(spark, tmp_path):
    from pathlib import Path

    from contigbin.sources.store import Tables

    tables = Tables(spark, "test")
    kept = [tables.keep(spark.range(k)) for k in (3, 4)]
    first, last = (Path(p.removeprefix("file:")) for p in tables.paths)
    tables.drop(1)
    assert kept[1].count() == 4 and not first.exists() and last.exists()
    tables.drop()
    assert not last.exists()
