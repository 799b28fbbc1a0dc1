"""Batches against an index that outlives them give what one run over all of them gives."""

import pytest
from cases import DOCS, documents, repeats

from contigbin.llm import suffix_dedup, suffix_family

ROWS = documents()


def digests(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("cuts", [[45], [20, 40, 60]])
def test_batches_equal_one_run(spark, tmp_path, cuts):
    edges, got = [0, *cuts, len(ROWS)], {}
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        family = suffix_family.SuffixFamily(spark, str(tmp_path / "family"))  # opened anew for each batch
        got |= digests(family.add(spark.createDataFrame(ROWS[a:b], DOCS).repartition(3)))
    assert got == {d: v[:4] for d, v in repeats(ROWS).items()}
    assert got == digests(suffix_dedup.dedup(spark.createDataFrame(ROWS, DOCS)))
    sizes = [x["runs"] for x in family.state["levels"]]
    assert family.state["version"] == len(cuts) + 1 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    level = family.level(family.state["levels"][0]["folder"])
    parts = level.rdd.mapPartitions(lambda rows: [[r["gram"] for r in rows]]).collect()
    assert all(p == sorted(p) for p in parts)


def test_levels_stay_few(spark, tmp_path):
    family = suffix_family.SuffixFamily(spark, str(tmp_path / "family"))
    for k in range(5):
        family.add(spark.createDataFrame(ROWS[12 * k : 12 * k + 12], DOCS))
    assert len(family.state["levels"]) <= 3
    import os

    there = {x for x in os.listdir(tmp_path / "family") if x.startswith("level-")}
    assert {x["folder"] for x in family.state["levels"]} <= there


def test_a_batch_that_cannot_be_added_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "family")
    family = suffix_family.SuffixFamily(spark, path)
    family.add(spark.createDataFrame(ROWS[:20], DOCS))
    before = dict(family.state)
    with pytest.raises(ValueError, match="greater than 19"):
        family.add(spark.createDataFrame(ROWS[10:30], DOCS))
    monkeypatch.setattr(suffix_family, "settled", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        family.add(spark.createDataFrame(ROWS[20:30], DOCS))
    monkeypatch.undo()
    again = suffix_family.SuffixFamily(spark, path)
    assert again.state == before == family.state
    with pytest.raises(ValueError, match="of length 100"):
        suffix_family.SuffixFamily(spark, path, 50)
    assert family.add(spark.createDataFrame([], DOCS)).count() == 0
    want = repeats(ROWS[:30])
    assert digests(again.add(spark.createDataFrame(ROWS[20:30], DOCS))) == {d: want[d][:4] for d in range(20, 30)}
