"""One file cut into many byte ranges gives what it gives whole."""

import random

import pytest
from pyspark.sql import functions as F

from contigbin.sources import fasta, gfa, splits


@pytest.fixture
def cut(spark):
    """Files are read in ranges of 300 bytes."""
    key = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "40"}
    old = {k: spark.conf.get(k, None) for k in key}
    for k, v in key.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lines_are_numbered_and_filled_over_ranges(spark, cut, tmp_path):
    rng, want = random.Random(1), []
    for name in ("a", "b"):
        head, lines = None, []
        for k in range(400):
            line = f"#head{k}" if rng.random() < (0.02 if name == "a" else 0.3) else "x" * rng.randint(0, 40)
            head = line if line.startswith("#") else head
            lines.append(line)
            want.append((name, k, line, head))
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    lines = splits.scan(spark, str(tmp_path), F.when(F.col("value").startswith("#"), F.col("value")))
    assert lines.rdd.getNumPartitions() > 20
    got = splits.numbered(splits.filled(lines)).select(F.substring_index("file", "/", -1), "number", "value", "above").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_fasta_is_read_in_ranges(spark, cut, tmp_path):
    rng, want, out = random.Random(2), [], []
    for k in range(60):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 700)))
        want.append((f">c{k}" if k % 7 == 3 else f"c{k}", f"{'>' if k % 7 == 3 else ''}c{k} a > b {k}", seq))
        out.append(f">{want[-1][1]}\n" + "\n".join(seq[i : i + 70] for i in range(0, len(seq), 70)) + ("\r\n" if k % 2 else "\n"))
    (tmp_path / "one.fa").write_text("".join(out), newline="")
    (tmp_path / "two.fa").write_text("﻿\nACG\n>late x\nAC\n\nGT\n", newline="")
    records = fasta.read_fasta(spark, str(tmp_path))
    rows = records.orderBy("file", "position").collect()
    assert [(r["contig"], r["description"], r["sequence"]) for r in rows] == [*want, (None, None, "ACG"), ("late", "late x", "ACGT")]
    assert records.rdd.getNumPartitions() > 20 and "Exchange" not in records._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("encoding", ["utf-16-le", "latin-1"])
def test_fasta_of_other_encodings(spark, tmp_path, encoding):
    text = "﻿>a ünï\nACGT\nAC\n>b\nGG\n" if encoding == "utf-16-le" else ">a ünï\nACGT\nAC\n>b\nGG\n"
    (tmp_path / "x.fa").write_bytes(text.encode(encoding))
    name = {"utf-16-le": "UTF-16LE", "latin-1": "ISO-8859-1"}[encoding]
    rows = fasta.read_fasta(spark, str(tmp_path), name).orderBy("position").collect()
    assert [(r["contig"], r["description"], r["sequence"]) for r in rows] == [("a", "a ünï", "ACGTAC"), ("b", "b", "GG")]


def test_contig_paths_in_ranges(spark, cut, tmp_path):
    rng, want, out = random.Random(3), [], []
    for k in range(50):
        lines = [[(str(rng.randint(1, 999)), rng.choice("+-")) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 3))]
        body = "".join(",".join(s + o for s, o in line) + (";" if rng.random() < 0.5 else "") + "\n" for line in lines)
        out.append(f"w{k}\n{body}w{k}'\n{body}" + ("\n" if k % 5 == 0 else ""))
        if k % 3:
            want += [(f"w{k}", pos, s, o) for pos, (s, o) in enumerate(x for line in lines for x in line)]
    (tmp_path / "contigs.paths").write_text("".join(out))
    known = spark.createDataFrame([(f"w{k}",) for k in range(50) if k % 3], "contig string")
    got = gfa.read_contig_paths(spark, str(tmp_path / "contigs.paths"), known).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_read_length_takes_the_first_reads_of_a_cut_file(spark, cut, tmp_path):
    lengths = [10 + k % 50 for k in range(300)]
    (tmp_path / "r.fq").write_text("".join(f"@r{k}\n{'A' * n}\n+\n{'@' * n}\n" for k, n in enumerate(lengths)))
    assert fasta.read_length(spark, str(tmp_path / "r.fq"), 120) == pytest.approx(sum(lengths[:120]) / 120)
    assert fasta.read_length(spark, str(tmp_path / "r.fq")) == pytest.approx(sum(lengths) / 300)
    (tmp_path / "none.fq").write_text("")
    assert fasta.read_length(spark, str(tmp_path / "none.fq")) == 0.0
