"""One file a bin and nothing half written; keyed tables under several writers; the bidirected graph against brute force."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from contigbin.operators import assembly
from contigbin.sources import fasta, keyed, tables
from contigbin.sources.store import GroupFileSource

RECORDS = [(f"c{k}", "ACGT" * (k + 1) * 9) for k in range(40)]


def records(spark):
    return spark.createDataFrame(RECORDS, "contig string, sequence string").repartition(5)


def test_one_fasta_a_bin(spark, tmp_path):
    path = str(tmp_path / "bins")
    bins = spark.createDataFrame([(c, f"b{k % 4}" if k < 30 else "b/4") for k, (c, _) in enumerate(RECORDS)], "contig string, bin string")
    fasta.write_bins(records(spark), bins.filter("bin = 'b1'").withColumn("bin", F.lit("old")), path)
    assert os.listdir(path) == ["old.fa"]
    fasta.write_bins(records(spark), bins, path)
    assert sorted(os.listdir(path)) == ["b0.fa", "b1.fa", "b2.fa", "b3.fa", "b_4.fa"] and os.listdir(tmp_path) == ["bins"]
    read = fasta.checked(fasta.read_fasta(spark, path)).select("contig", "sequence")
    assert sorted(map(tuple, read.collect())) == sorted(RECORDS)
    assert all(len(line) <= 80 for line in (tmp_path / "bins" / "b_4.fa").read_text().split("\n"))
    got = {r["contig"]: r["bin"] for r in tables.assignments_from_folder(spark, path, bins).collect()}
    assert got == {r["contig"]: r["bin"].replace("/", "_") for r in bins.collect()}
    with pytest.raises(ValueError, match="without a sequence"):
        fasta.write_bins(records(spark).limit(3), bins, path)
    with pytest.raises(ValueError, match="one file name"):
        fasta.write_bins(records(spark), spark.createDataFrame([("c1", "a/b"), ("c2", "a_b")], "contig string, bin string"), path)
    assert len(os.listdir(path)) == 5


def test_a_failed_write_leaves_the_old_files(spark, tmp_path):
    path = str(tmp_path / "bins")
    spark.dataSource.register(GroupFileSource)
    write = lambda df: df.write.format("group_files").option("path", path).mode("append").save()
    write(spark.createDataFrame([("a", "x")], "name string, value string"))
    bad = spark.createDataFrame([("b", 1), ("c", 0)], "name string, n int").repartition(2).select("name", F.when(F.col("n") == 0, F.raise_error(F.lit("lost"))).otherwise("y").alias("value"))
    with pytest.raises(Exception, match="lost"):
        write(bad)
    assert os.listdir(tmp_path) == ["bins"] and os.listdir(path) == ["a.fa"]
    with pytest.raises(Exception, match="not together"):
        write(spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "name string, value string").coalesce(1))
    assert os.listdir(path) == ["a.fa"]


def test_folders_of_bins_at_any_depth(spark, tmp_path):
    for name, text in (("one.fa", ">a x\nAC\n>b\nG\n"), ("sub/two 2.fasta", ">c\nAC\n"), ("sub/no.txt", ">d\nA\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "contig string")
    assert {tuple(r) for r in tables.assignments_from_folder(spark, str(tmp_path), known).collect()} == {("a", "one"), ("b", "one"), ("c", "sub/two 2")}
    (tmp_path / "three.fna").write_text(">a\nAC\n")
    with pytest.raises(Exception, match="two bins"):
        tables.assignments_from_folder(spark, str(tmp_path), known).collect()


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "keyed")
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    assert keyed.upsert(frame([(1, "a"), (2, "a")]), path, ["k"], replace=False) == 1
    real, barrier, first = keyed._claim, threading.Barrier(2, timeout=120), threading.local()

    def together(*args):
        if not getattr(first, "done", False):  # both have merged with version 1 before either claims version 2
            first.done = True
            barrier.wait()
        return real(*args)

    monkeypatch.setattr(keyed, "_claim", together)
    made = []
    threads = [threading.Thread(target=lambda rows=rows: made.append(keyed.upsert(frame(rows), path, ["k"], replace=True))) for rows in ([(2, "b"), (3, "b")], [(2, "c"), (4, "c")])]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(made) == [2, 3] == keyed.versions(spark, path)[1:]
    got = {r["k"]: r["v"] for r in keyed.read(spark, path).collect()}
    assert got | {2: "x"} == {1: "a", 2: "x", 3: "b", 4: "c"} and got[2] in "bc"
    assert {r["k"] for r in keyed.read(spark, path, 1).collect()} == {1, 2}


def test_keyed_tables_refuse(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "keyed")
    keyed.upsert(spark.createDataFrame([(1, "a")], "k int, v string"), path, ["k"], replace=False)
    keyed.upsert(spark.createDataFrame([(1, "b"), (None, "n")], "k int, v string"), path, ["k"], replace=False)
    assert {(r["k"], r["v"]) for r in keyed.read(spark, path).collect()} == {(1, "a"), (None, "n")}
    for rows, schema in (([(1, 2)], "k int, v int"), ([("a", 1)], "v string, k int")):
        with pytest.raises(ValueError, match="columns differ"):
            keyed.upsert(spark.createDataFrame(rows, schema), path, ["k"], replace=True)
    with pytest.raises(ValueError, match="repeat"):
        keyed.upsert(spark.createDataFrame([(5, "a"), (5, "b")], "k int, v string"), path, ["k"], replace=True)
    monkeypatch.setattr(keyed, "_claim", lambda *a: False)
    with pytest.raises(RuntimeError, match="first"):
        keyed.upsert(spark.createDataFrame([(9, "a")], "k int, v string"), path, ["k"], replace=True, retries=2)
    assert keyed.versions(spark, path) == [1, 2] and len(os.listdir(tmp_path / "keyed" / "snapshots")) == 2
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, str(tmp_path / "none"))


def test_components_with_strands(spark):
    """Parity by walking the graph; chains, twisted cycles, loops, lone segments, links both ways."""
    rng = random.Random(6)
    links = [(rng.randrange(60), rng.choice("+-"), rng.randrange(60), rng.choice("+-")) for _ in range(45)] + [(100, "+", 101, "-"), (101, "+", 100, "-"), (102, "+", 102, "-"), (103, "+", 103, "+")]
    segments = [*range(60), 100, 101, 102, 103, 104]
    near = {s: [] for s in segments}
    for a, ao, b, bo in links:
        turn = ao != bo
        near[a].append((b, turn))
        near[b].append((a, turn))
    want, seen = {}, {}
    for s in segments:
        if s in seen:
            continue
        seen[s], stack, members, twisted = False, [s], [s], False
        while stack:
            x = stack.pop()
            for y, turn in near[x]:
                if y not in seen:
                    seen[y] = seen[x] ^ turn
                    members.append(y)
                    stack.append(y)
                twisted |= seen[y] != seen[x] ^ turn
        for x in members:
            want[x] = (s, None if twisted else "-" if seen[x] else "+", twisted)
    raw = spark.createDataFrame(links, "a int, ao string, b int, bo string").repartition(3)
    got = {r["segment"]: (r["component"], r["strand"], r["twisted"]) for r in assembly.components(spark.createDataFrame([(s,) for s in segments], "segment int"), raw).collect()}
    assert got == want and any(t for *_, t in want.values()) and any(s == "-" for _, s, _ in want.values())


def test_links_stand_on_both_strands(spark):
    raw = spark.createDataFrame([("a", "+", "b", "-", 5), ("a", "+", "b", "-", 9), ("b", "+", "a", "-", 7), ("c", "+", "c", "-", 1)], "a string, ao string, b string, bo string, overlap int")
    segments = spark.createDataFrame([("a",), ("b",), ("c",)], "segment string")
    got = sorted(map(tuple, assembly.links(raw, segments).collect()))
    assert got == sorted([("a", "+", "b", "-", 9, 2, 0), ("b", "+", "a", "-", 9, 2, 1), ("b", "+", "a", "-", 7, 1, 0), ("a", "+", "b", "-", 7, 1, 1), ("c", "+", "c", "-", 1, 1, 0), ("c", "+", "c", "-", 1, 1, 1)])
    with pytest.raises(ValueError, match="unknown"):
        assembly.links(raw, segments.limit(2))
