"""New FASTA records appended to a Parquet table of contigs, each file once (extension)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str):
    """Starts a query that takes the files now in ``folder`` and ends: contig, sequence, source are appended to ``table``."""
    raw = spark.readStream.option("lineSep", "\n>").format("text").load(folder)
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    head = F.substring_index(body, "\n", 1)
    rows = raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("contig"), F.upper(F.regexp_replace(F.substr(body, F.length(head) + 2), r"\s", "")).alias("sequence"), F.col("_metadata.file_path").alias("source"))
    return rows.filter("contig <> '' AND sequence <> ''").writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
