"""Depth and unions over tiles, totals over range partitions, and BAM in ranges, each against a brute-force version."""

import random
import struct
import zlib
from collections import Counter

import pytest

from contigbin.operators import pileup, ranks
from contigbin.sources import bam

SPANS = "contig string, sample string, start long, end long"


def spans(n=600, seed=1):
    """Half of all spans lie on one contig; some are empty, repeated, touching, over tile borders, or without keys."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        start = rng.randint(-20, 900)
        out.append((rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice(["s", "t", None]), start, start + rng.choice([0, 1, 7, 64, 64, 200])))
    return [*out, ("far", "s", 5, 6), ("far", "s", 100_000, 100_010), ("none", "s", 3, 3), ("back", "s", 9, 4), *out[:30]]


@pytest.mark.parametrize("tile", [1, 64, 1 << 16])
def test_depth_runs_and_union(spark, tile):
    rows, depth = spans(), Counter()
    for contig, sample, a, b in rows:
        for p in range(a, b):
            depth[contig, sample, p] += 1
    df = spark.createDataFrame(rows, SPANS).repartition(5)
    runs = pileup.depth_runs(df, "contig", "sample", tile=tile).filter("depth <> 0").collect()
    got = Counter()
    for r in runs:
        for p in range(r["start"], r["end"]):
            assert (r["contig"], r["sample"], p) not in got
            got[r["contig"], r["sample"], p] = r["depth"]
    assert got == depth
    covered = {(r["contig"], r["sample"]): r["covered"] for r in pileup.interval_union(df, "contig", "sample", tile=tile).collect()}
    assert covered == {k: sum(1 for c, s, _ in depth if (c, s) == k) for k in {(c, s) for c, s, *_ in rows}}
    assert pileup.interval_union(df.limit(0), "contig").count() == 0


def test_a_hot_target_is_many_tasks(spark):
    """No task of the windows holds the rows of one target: partitions are by target and tile."""
    plan = pileup.depth_runs(spark.createDataFrame(spans(), SPANS), "contig", tile=64)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert sum("tile" in x for x in windows) >= 2 and not any("pos" in x and "tile" not in x for x in windows)


def test_depth_summary(spark):
    rows = [(*r, flag, q) for r in spans(200, 5) for flag, q in ((0, 60), (0x100, 60), (16, 5))]
    lengths = {"hot": 700, "a": 950, "far": 100_005, "none": 10, "unused": 5}
    df = spark.createDataFrame(rows, SPANS + ", flag int, quality int").repartition(4)
    got = {(r["contig"], r["sample"]): r for r in pileup.depth_summary(df, spark.createDataFrame(list(lengths.items()), "contig string, length long"), 10, tile=64).collect()}
    depth, keys = Counter(), set()
    for contig, sample, a, b, flag, q in rows:
        if flag != 0x100 and q >= 10 and contig in lengths:
            keys.add((contig, sample))
            depth.update((contig, sample, p) for p in range(max(a, 0), min(b, lengths[contig])))
    assert set(got) == keys
    for (contig, sample), r in got.items():
        own = [n for (c, s, _), n in depth.items() if (c, s) == (contig, sample)]
        assert r["depth"] == pytest.approx(sum(own) / lengths[contig]) and r["zero_share"] == pytest.approx(1 - len(own) / lengths[contig]) and r["deepest"] == max(own, default=0)


def test_totals_before(spark):
    rng = random.Random(2)
    counts = {(rng.choice(["hot", "hot", "hot", "x", None]), rng.randint(-500, 500) / 7): rng.randint(1, 9) for _ in range(900)}
    rows = [(*k, n) for k, n in counts.items()]
    got = ranks.totals_before(spark.createDataFrame(rows, "g string, v double, n long").repartition(6), "g", "v", "n").collect()
    assert len(got) == len(rows)
    for r in got:
        own = [(v, n) for g, v, n in rows if g == r["g"]]
        assert r["before"] == sum(n for v, n in own if v < r["v"]) and r["total"] == sum(n for _, n in own)


def test_attach_keeps_null_keys(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, x int")
    sums = spark.createDataFrame([("a", 10), (None, 20)], "k string, s int")
    for few in (ranks.FEW, 1):
        monkeypatch.setattr(ranks, "FEW", few)
        assert sorted(map(tuple, ranks.attach(rows, sums, "k").collect()), key=str) == sorted([("a", 1, 10), ("a", 2, 10), (None, 3, 20)], key=str)


def bgzf(data: bytes, size: int) -> bytes:
    out = b""
    for at in range(0, len(data), size):
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(data[at : at + size]) + z.flush()
        out += bam.MAGIC + struct.pack("<IBBH2sHH", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data[at : at + size]), len(data[at : at + size]))
    return out


def record(name, contig, start, quality, flag, ops, seq):
    packed = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", contig, start, len(name) + 1, quality, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += struct.pack(f"<{len(ops)}I", *(n << 4 | "MIDNSHP=X".index(op) for n, op in ops)) + bytes(a << 4 | b for a, b in zip(packed[::2], packed[1::2], strict=True)) + b"\xff" * len(seq)
    return struct.pack("<i", len(body)) + body


def alignments(n=400, seed=4):
    rng, out = random.Random(seed), []
    for k in range(n):
        ops = [(rng.randint(0, 5), "S")] + [(rng.randint(1, 30), rng.choice("M=XIDN")) for _ in range(rng.randint(1, 5))] + [(rng.randint(0, 4), "H")]
        seq = "".join(rng.choice("ACGTACGTACGTN") for _ in range(sum(m for m, op in ops if op in "MIS=X")))
        mapped = rng.random() < 0.95
        out.append((f"read{k}", rng.randint(0, 2) if mapped else -1, rng.randint(0, 800) if mapped else -1, rng.choice([0, 5, 60]), 16 if mapped else 4, ops, seq))
    return out


def expected(reads, names):
    rows = []
    for name, contig, start, quality, flag, ops, seq in reads:
        at, read, hit = start, 0, []
        for n, op in ops:
            if op in "M=X":
                hit += [at + k for k in range(n) if seq[read + k] in "ACGT"]
            at, read = at + n * (op in "MDN=X"), read + n * (op in "MIS=X")
        if contig < 0:
            rows.append((name, None, None, flag, quality))
            continue
        rows += [(name, names[contig], p, flag, quality) for p in hit]
    return sorted(rows, key=str)


@pytest.mark.parametrize("block,size", [(300, 400), (1000, 700), (60_000, 1 << 20)])
def test_bam_in_ranges(spark, tmp_path, block, size):
    """Records over block borders, blocks over range borders, a header of several blocks."""
    names, reads = ["c0", "c1", "c2"], alignments()
    text = b"@HD\tVN:1.6\n" + b"@CO\tnothing\n" * 60
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 3) + b"".join(struct.pack("<i", 3) + x.encode() + b"\0" + struct.pack("<i", 1000) for x in names)
    for part, own in (("a.bam", reads[:250]), ("b.bam", reads[250:]), ("empty.bam", [])):
        (tmp_path / part).write_bytes(bgzf(head + b"".join(record(*r) for r in own), block) + bgzf(b"", 1) + bam.MAGIC + bytes.fromhex("0000000000ff0600424302001b0003000000000000000000"))
    spark.dataSource.register(bam.BamSource)
    df = spark.read.format("bam").option("path", str(tmp_path)).option("range", str(size)).load()
    assert block > 2000 or df.rdd.getNumPartitions() > 10
    rows = df.collect()
    got = sorted(((r["name"], r["contig"], p, r["flag"], r["quality"]) for r in rows for p in (range(r["start"], r["end"]) if r["contig"] else [None])), key=str)
    assert got == expected(reads, names)
    depth = pileup.depth_summary(df.filter("contig is not null").withColumnRenamed("file", "sample"), spark.createDataFrame([(x, 1000) for x in names], "contig string, length long"), 5)
    bases = Counter(c for _, c, p, flag, q in expected(reads, names) if p is not None and p < 1000 and q >= 5)
    assert {x: round(sum(r["depth"] for r in depth.collect() if r["contig"] == x) * 1000) for x in names} == {x: bases[x] for x in names}
