"""Diffs derived from the ``documents`` table, for queries and benchmarks.

200 documents in a row make one diff with a file each. Documents with an even id
are removed files, odd ones added; the suffix follows from the id, and so do the
import rows that are put before the document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes in turn, with the import rows of each.
FILES = {
    "go": ['import "fmt"'],
    "py": ["import os", "try:", "    import json", "except ImportError:", "    import simplejson"],
    "ts": ['import { a } from "a";'],
    "js": ['const b = require("b");'],
    "rs": ["use std::fmt;"],
    "c": ["#include <stdio.h>"],
    "java": ["import java.util.List;"],
    "txt": [],
}
DOCS_PER_DIFF = 200


def _choose(of: Column, values: list[Column]) -> Column:
    out = F.when(of == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(of == i, v)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sections(docs: DataFrame) -> DataFrame:
    """``diff_id, doc_id, path, marker, rows``: a file of each document; rows without markers."""
    turn = F.expr("(doc_id div 2) % 8")
    suffix = _choose(turn, [F.lit(s) for s in FILES])
    imports = _choose(turn, [F.array(*map(F.lit, rows)) if rows else F.array().cast("array<string>") for rows in FILES.values()])
    return docs.where("doc_id is not null").select(
        F.expr(f"doc_id div {DOCS_PER_DIFF}").alias("diff_id"),
        "doc_id",
        F.concat(F.lit("d"), F.col("doc_id"), F.lit("."), suffix).alias("path"),
        F.when(F.col("doc_id") % 2 == 0, "-").otherwise("+").alias("marker"),
        F.concat(imports, F.split(F.coalesce("text", F.lit("")), "\n")).alias("rows"),
    )


def section_text() -> Column:
    n = F.size("rows")
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"))
    ranges = F.when(F.col("marker") == "-", F.concat(F.lit("@@ -1,"), n, F.lit(" +0,0 @@\n"))).otherwise(F.concat(F.lit("@@ -0,0 +1,"), n, F.lit(" @@\n")))
    marked = F.concat("marker", F.expr("array_join(rows, concat('\n', marker))"), F.lit("\n"))
    return F.concat(head, ranges, marked)


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``diff_id, raw`` of all documents; a diff's rows meet in one aggregate of bounded size."""
    files = sections(documents(spark, sf_dir)).select("diff_id", F.struct("doc_id", section_text().alias("text")).alias("s"))
    return files.groupBy("diff_id").agg(F.expr("array_join(transform(array_sort(collect_list(s)), x -> x.text), '')").alias("raw"))
