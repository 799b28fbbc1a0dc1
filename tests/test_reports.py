"""Mock labels and dataset reports against plain versions."""

import random

import pytest

from contigbin.operators import acceptance, features, mock

HITS = "query string, target string, query_start long, query_end long, target_start long, target_end long, target_length long, matches long, block long"


def community(seed=1):
    """Contigs of one genome, of two that cannot be told apart, of two on different ends, and of none."""
    rng, hits, lengths = random.Random(seed), [], {}
    refs = [(f"r{k}", f"g{k // 2}", f"m{k}") for k in range(12)]
    for c in range(80):
        name, n = f"c{c}", rng.randint(800, 1200)
        lengths[name] = n
        kind, r = rng.random(), rng.randrange(10)
        hit = lambda t, a, b, m=0.97: hits.append((name, t, a, b, a, b, 1500, round((b - a) * m), b - a))  # noqa: B023, E731
        if kind < 0.4:
            hit(f"r{r}", 0, n // 2 + 60)
            hit(f"r{r}", n // 2, n)
        elif kind < 0.55:
            hit("r2", 0, n)
            hit("r5", 0, n, 0.965)
        elif kind < 0.7:
            hit(f"r{r}", 0, round(0.6 * n))
            hit(f"r{(r + 4) % 10}", round(0.45 * n), n, 0.95)
        elif kind < 0.8:
            hit(f"r{r}", 0, n, 0.8)
        elif kind < 0.9:
            hit(f"r{r}", 0, n // 3)
    hits += [("unknown", "r0", 0, 900, 0, 900, 1500, 890, 900), ("c0", "elsewhere", 0, 5, 0, 5, 90, 0, 0)]
    return hits, refs, lengths


def plain(hits, refs, lengths):
    agent, molecule = {t: a for t, a, _ in refs}, {t: m for t, _, m in refs}
    pairs = {}
    for q, t, a, b, *_, m, block in hits:
        if q in lengths and block:
            p = pairs.setdefault(q, {}).setdefault(t, [0, 0, set()])
            p[0], p[1] = p[0] + m, p[1] + block
            p[2] |= set(range(a, b))
    scored = {q: sorted(((-m, t, m / b, len(s) / lengths[q], s) for t, (m, b, s) in ts.items() if m / b >= 0.9 and len(s) / lengths[q] >= 0.5)) for q, ts in pairs.items()}
    groups = []
    for rows in scored.values():
        tied = {agent.get(r[1], r[1]) for r in rows if -r[0] >= -rows[0][0] * 0.98}
        touching = [g for g in groups if g & tied]
        groups = [g for g in groups if not g & tied] + [set().union(tied, *touching)]
    truth = {a: "|".join(sorted(g)) for g in groups if len(g) > 1 for a in g}
    out = {q: (None, None, None, None, "unlabelled") for q in lengths}
    for q, rows in scored.items():
        if rows:
            name = lambda r: truth.get(agent.get(r[1], r[1]), agent.get(r[1], r[1]))
            best = rows[0]
            if any(name(r) != name(best) and len(r[4] - best[4]) >= 0.25 * lengths[q] for r in rows):
                out[q] = (None, None, None, None, "chimeric")
            else:
                out[q] = (name(best), molecule[best[1]], best[2], best[3], "merged" if "|" in name(best) else "labelled")
    return out, truth


def test_mock_labels(spark):
    hits, refs, lengths = community()
    want, truth = plain(hits, refs, lengths)
    got = mock.label(spark.createDataFrame(hits, HITS).repartition(3), spark.createDataFrame(refs, "target string, agent string, molecule string"), spark.createDataFrame(list(lengths.items()), "query string, length long"))
    rows = {r["query"]: tuple(r)[1:] for r in got["labels"].collect()}
    assert {s for *_, s in want.values()} == {"labelled", "merged", "chimeric", "unlabelled"} and set(rows) == set(want)
    for q, r in want.items():
        assert rows[q][:2] == r[:2] and rows[q][4] == r[4] and rows[q][2:4] == pytest.approx(r[2:4])
    for r in got["references"].collect():
        spans = {p for h in hits if h[1] == r["target"] for p in range(h[4], h[5])}
        own = [q for q, w in want.items() if w[0] == r["truth"]]
        assert r["truth"] == truth.get(r["agent"], r["agent"]) and r["covered"] == len(spans) and r["fraction"] == pytest.approx(len(spans) / 1500) and (r["contigs"], r["bases"]) == (len(own), sum(lengths[q] for q in own))
    s = got["summary"].first()
    of = lambda *kinds: sum(w[4] in kinds for w in want.values())
    assert (s["contigs_total"], s["contigs_labelled"], s["contigs_labelled_merged"], s["contigs_chimeric"], s["contigs_unlabelled"]) == (80, of("labelled", "merged"), of("merged"), of("chimeric"), of("unlabelled"))
    assert (s["references"], s["agents"], s["truth_genomes"], s["merged_truth_genomes"], s["level"]) == (12, 6, len({w[0] for w in want.values()} - {None}), sorted(set(truth.values())), "agent")


def test_mock_labels_without_hits(spark):
    got = mock.label(spark.createDataFrame([], HITS), spark.createDataFrame([("r", "g", "m")], "target string, agent string, molecule string"), spark.createDataFrame([("c", 5)], "query string, length long"))
    assert [r["status"] for r in got["labels"].collect()] == ["unlabelled"]
    r, s = got["references"].first(), got["summary"].first()
    assert (r["covered"], r["fraction"], r["contigs"]) == (0, 0.0, 0) and (s["references_half_covered"], s["merged_truth_genomes"]) == (0, [])


def test_acceptance_report(spark):
    lengths = spark.createDataFrame([("a", 1000), ("b", 3000), ("c", 4000), ("d", 12000), ("e", 6000)], "contig string, length long")
    coverage = spark.createDataFrame([(c, s, d) for k, c in enumerate("abcde") for s, d in (("x", k + 1.0), ("y", 9.0 - k * k), ("flat", 2.0))], "contig string, sample string, depth double")
    edges = spark.createDataFrame([("a", "b"), ("b", "b")], "src string, dst string")
    members = spark.createDataFrame([("d", "k1"), ("d", "k1"), ("c", "k2"), ("a", "k2"), ("e", None)], "contig string, cluster string")
    r = acceptance.report(lengths, coverage, edges, members).first()
    assert (r["contigs"], r["cohort"], r["bases"], r["shortest"], r["median_length"], r["longest"], r["n50"]) == (5, 4, 26000, 1000, 4000, 12000, 6000)
    assert (r["short"], r["medium"], r["long"], r["dead_samples"], r["edges"], r["linked_contigs"], r["components"], r["largest_component"]) == (3, 1, 1, 1, 1, 2, 1, 2)
    assert (r["joinable"], r["joinable_fraction"], r["verdict"]) == (2, 0.5, "strong") and not r["samples_alike"]
    alone = acceptance.report(lengths, coverage, edges.limit(0)).first()
    assert (alone["joinable"], alone["edges"], alone["largest_component"], alone["verdict"]) == (0, 0, 0, "weak")


def test_shares_caps_and_withheld_edges(spark):
    contigs = spark.createDataFrame([("a", 10), ("b", 20), ("c", 70)], "contig string, length long")
    bins = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("z", "y")], "contig string, bin string")
    r = acceptance.assigned_share(contigs, bins).first()
    assert (r["contigs"], r["assigned_contigs"], r["bases"], r["assigned_bases"]) == (3, 2, 100, 30) and (r["contig_share"], r["base_share"]) == pytest.approx((2 / 3, 0.3))
    assert acceptance.assigned_share(contigs.limit(0), bins).first()["base_share"] == 0
    assert sorted(map(tuple, acceptance.capped(bins, 1).collect()), key=str) == [("c", None), ("z", "y")]
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.6), (3, 4, 0.7)], "src long, dst long, w double")
    free, n = acceptance.withheld(edges, spark.createDataFrame([(1,), (1,), (2,)], "id long"))
    assert [tuple(x) for x in free.collect()] == [(3, 4, 0.7)] and n == 2


def test_left_fill(spark, monkeypatch):
    contigs = spark.createDataFrame([("a",), ("b",)], "contig string")
    coverage = spark.createDataFrame([("a", "s", 1.0), ("z", "t", 2.0)], "contig string, sample string, depth double")
    assert sorted(map(tuple, features.left_fill(contigs, coverage).collect())) == [("a", "s", 1.0), ("a", "t", 0.0), ("b", "s", 0.0), ("b", "t", 0.0)]
    assert features.left_fill(contigs, coverage.limit(0)).count() == 0
    monkeypatch.setattr(features, "SAMPLES", 1)
    with pytest.raises(ValueError, match="samples"):
        features.left_fill(contigs, coverage)
