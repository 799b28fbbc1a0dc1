"""Expressions on names (FN-7..9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alphanumeric(text: Column) -> Column:
    """Lower-case letters a-z and digits alone (FN-7)."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def version_in(text: Column) -> Column:
    """The first commit id, else the first dotted number, of a text (FN-8); null without one."""
    commit = F.regexp_extract(text, r"\b([0-9a-f]{7,40})\b", 1)
    number = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)+)", 1)
    return F.nullif(F.when(commit.rlike("[a-f]"), commit).otherwise(number), F.lit(""))


def run_name(dataset: Column, assembler: Column, tag: Column) -> Column:
    """dataset__coasm__assembler__tag; without a tag that part is left out (FN-9)."""
    return F.concat_ws("__", dataset, F.lit("coasm"), assembler, F.nullif(tag, F.lit("")))
