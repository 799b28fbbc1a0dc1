"""A logarithmic family of suffix indexes that outlives a run: new batches of documents against all earlier ones.

The family is a folder that all executors share. Each batch adds its texts and a level: its suffixes as
runs (``suffix_dedup.runs``: neighbouring starts that share the leftmost least gram of their first ``length``
bytes), in the order of these grams, so a level is a sparse suffix array over the texts beside it. A new batch

1. gets its own runs in that order,
2. is merge-scanned against every level: a sort-merge join by gram finds the earlier runs that may match, and these
   alone bring their texts,
3. is settled together with them (``suffix_dedup.settled``: exact bytes in suffix arrays), where the later of two
   equal strings is removed, and
4. becomes a level; of the last two levels, one of less than twice the other's runs is merged with it, so n batches of equal size
   leave about log2(n) levels.

The result of all batches equals that of one run over them. A batch's ids must therefore be greater than those of earlier
batches, or ValueError is raised (rows without an id come first, so only the first batch may have them). A manifest
names the levels; it is written last, so a batch that fails leaves the family as it was. Two batches must not be added at once.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.dataset import exists
from .common import _remove, bounded_batches, slices, utf8
from .suffix_dedup import _START, LENGTH, _texts, reported, runs, settled


def runs_of(texts: DataFrame, length: int) -> DataFrame:
    """gram, doc_id, th, pos (start and count) of all runs of texts (doc_id, th, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = runs(*utf8(part.column(2)), length)
                if found is not None:
                    text, start, count, gram = found
                    columns = gram.view("int64"), part.column(0).to_numpy()[text], part.column(1).to_numpy()[text], (start << _START) | count
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "doc_id", "th", "pos"])

    return bounded_batches(texts).mapInArrow(run, "gram long, doc_id long, th long, pos long")


def in_order(level: DataFrame) -> DataFrame:
    return level.repartitionByRange("gram").sortWithinPartitions("gram", "doc_id", "th", "pos")


class SuffixFamily:
    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH):
        self.spark, self.path = spark, path.rstrip("/")
        self.state = {"length": length, "version": 0, "last": None, "levels": [], "texts": []}
        if exists(spark, f"{self.path}/latest"):
            newest = max(json.loads(r["value"])["version"] for r in spark.read.text(f"{self.path}/latest").collect())
            self.state = json.loads(spark.read.text(f"{self.path}/manifests/{newest}").first()["value"])
            if self.state["length"] != length:
                raise ValueError(f"the family is of length {self.state['length']}, not {length}")

    def _write(self, df: DataFrame, name: str) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, state: dict) -> None:
        line = lambda value: self.spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1)
        line(state).write.mode("overwrite").text(f"{self.path}/manifests/{state['version']}")
        line({"version": state["version"]}).write.mode("append").text(f"{self.path}/latest")
        old = [level["folder"] for level in self.state["levels"] if level not in state["levels"]]
        self.state = state
        for folder in old:
            _remove(self.spark, f"{self.path}/{folder}")

    def level(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def earlier(self, own: DataFrame) -> DataFrame:
        """The runs of all levels whose gram the batch has too: one merge-scan a level."""
        grams = own.select("gram").distinct().hint("merge")
        found = [self.level(x["folder"]).join(grams, "gram", "left_semi") for x in self.state["levels"]]
        out = own.limit(0)
        for rows in found:
            out = out.unionByName(rows)
        return out

    def add(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the batch's documents, as ``suffix_dedup.dedup`` gives them for all batches together."""
        length, known = self.state["length"], self.state["texts"]
        texts_folder = self._write(_texts(docs), "texts")
        texts = self.level(texts_folder)
        ids = texts.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
        last = self.state["last"]
        if last is not None and ids["least"] is not None and ids["least"] <= last:
            _remove(self.spark, f"{self.path}/{texts_folder}")
            raise ValueError(f"ids must be greater than {last}, that of the last batch")
        level_folder = self._write(in_order(runs_of(texts, length)), "level")
        own = self.level(level_folder)
        before = self.earlier(own)
        several = own.select("gram", "doc_id", "th", "pos").unionByName(before)
        shared = several.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
        found_folder = self._write(several.join(shared, "gram", "left_semi").select("doc_id", "th", "pos", "gram"), "found")
        found = self.level(found_folder)
        all_texts = texts
        if known:
            old = self.spark.read.parquet(*(f"{self.path}/{x}" for x in known))
            needed = found.filter(F.col("doc_id") < F.lit(ids["least"])).select("doc_id", "th").distinct()
            all_texts = texts.unionByName(old.join(needed, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"]))
        removed = settled(all_texts.repartition("doc_id", "th"), found, length).filter(F.col("doc_id") >= F.lit(ids["least"]))
        result_folder = self._write(reported(texts.repartition("doc_id", "th"), removed), "result")
        levels = [*self.state["levels"], {"folder": level_folder, "runs": own.count()}]
        while len(levels) > 1 and levels[-2]["runs"] < 2 * levels[-1]["runs"]:
            a, b = levels.pop(-2), levels.pop()
            merged = self._write(in_order(self.level(a["folder"]).unionByName(self.level(b["folder"]))), "level")
            levels.append({"folder": merged, "runs": a["runs"] + b["runs"]})
            if level_folder in (a["folder"], b["folder"]):
                level_folder = merged
        most = last if ids["most"] is None else ids["most"]
        self._commit(self.state | {"version": self.state["version"] + 1, "last": most, "levels": levels, "texts": [*known, texts_folder]})
        _remove(self.spark, f"{self.path}/{found_folder}")
        return self.level(result_folder)
