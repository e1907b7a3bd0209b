"""Relational operators over rows and layouts, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.functions import columns as C
from hunkwise.functions import moves


def numbered(rows: DataFrame) -> DataFrame:
    """``diff_id, numbered``: each diff with a gutter of row numbers."""
    per = rows.groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("r"))
    pad = F.length(F.size("r").cast("string"))
    row = lambda x: F.concat(F.lpad(x["line_no"].cast("string"), pad, F.lit(" ")), F.lit("|"), x["text"], F.lit("\n"))
    return per.select("diff_id", F.array_join(F.transform("r", row), "").alias("numbered"))


def sizes(rows: DataFrame) -> DataFrame:
    """``diff_id, n_rows, raw_bytes, numbered_bytes, fits``."""
    per = rows.groupBy("diff_id").agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("text")).alias("t"), F.sum(F.octet_length("text") + F.octet_length("eol")).alias("raw_bytes"))
    return per.select("diff_id", "n_rows", "raw_bytes", C.numbered_size(F.col("t"), F.col("n_rows")).alias("numbered_bytes"), C.fits(F.col("raw_bytes"), F.col("t"), F.col("n_rows")).alias("fits"))


def row_slice(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last``; a first below 1 is 1, a last below 1 or past the end is the end."""
    out = rows.where(F.col("line_no") >= max(1, first))
    return out.where(F.col("line_no") <= last) if last >= 1 else out


def grep(rows: DataFrame, pattern: str, key: str = "diff_id", most: int = 200) -> DataFrame:
    """The first ``most`` rows of each ``key`` that match, in order."""
    hits = rows.where(F.col("text").rlike(pattern))
    place = F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    return hits.withColumn("place", place).where(F.col("place") <= most)


def diff_stats(layout: DataFrame) -> DataFrame:
    """``diff_id, changed, files, hunks`` and changed rows by language."""
    count = lambda c: F.count_if(c).cast("long")
    change = F.col("kind") == "change"
    by_language = [count(change & (F.col("language") == x)).alias(f"changed_{x}") for x in ("go", "python", "typescript", "javascript", "rust", "c", "java")]
    return layout.groupBy("diff_id").agg(
        count(change).alias("changed"), count(F.col("kind") == "header").alias("files"), count(F.col("kind") == "hunk_header").alias("hunks"),
        *by_language, count(change & F.col("language").isNull()).alias("changed_other"),
    )


def hunks(layout: DataFrame) -> DataFrame:
    """One row per hunk: its header's ranges and heading, and its rows by marker."""
    at = lambda n: F.regexp_extract("text", r"\A@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)\z", n)
    number = lambda n: F.when(at(n) == "", 1).otherwise(at(n).try_cast("int"))
    heads = layout.where("kind = 'hunk_header'").select(
        "diff_id", "hunk_id", F.col("line_no").alias("header_line"), number(1).alias("old_start"), number(2).alias("old_count"),
        number(3).alias("new_start"), number(4).alias("new_count"), F.trim(at(5)).alias("heading"),
    )
    marker = F.substring("text", 1, 1)
    rows = layout.where(F.col("kind").isin("context", "change")).groupBy("diff_id", "hunk_id").agg(
        F.count_if(marker == "-").alias("removed"), F.count_if(marker == "+").alias("added"), F.count_if(marker == " ").alias("context"), F.max("line_no").alias("last_line"),
    )
    return heads.join(rows, ["diff_id", "hunk_id"], "left")


def file_sections(layout: DataFrame) -> DataFrame:
    """``diff_id, file_id, start_line, end_line, language`` of each file."""
    return layout.where("file_id is not null").groupBy("diff_id", "file_id").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.max("language").alias("language")
    )


def mask_ranges(flagged: DataFrame) -> DataFrame:
    """Runs of consecutive ``line_no`` of each diff: ``diff_id, start_line, end_line``."""
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("diff_id").orderBy("line_no"))
    return flagged.withColumn("island", island).groupBy("diff_id", "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).drop("island")


def range_rows(ranges: DataFrame) -> DataFrame:
    """The rows of ranges: ``diff_id, line_no``."""
    return ranges.select("diff_id", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))


def move_anchors(layout: DataFrame) -> DataFrame:
    """Substantive row texts that occur once removed and once added, in different hunks, and nowhere else."""
    body = F.expr("substr(text, 2)")
    rows = layout.where(F.col("kind").isin("context", "change")).select(
        "diff_id", "line_no", "hunk_id", F.substring("text", 1, 1).alias("marker"), C.normalised(body).alias("norm"), C.indent_columns(F.regexp_replace(body, r"[ \t]+\z", "")).alias("indent")
    )
    rows = rows.where(C.substantive(F.col("norm")))
    side = lambda m, c: F.max(F.when(F.col("marker") == m, F.col(c)))
    pairs = rows.groupBy("diff_id", "norm").agg(
        F.count("*").alias("n"), *[side(m, c).alias(f"{w}_{c}") for m, w in (("-", "removed"), ("+", "added")) for c in ("line_no", "hunk_id", "indent")]
    )
    return pairs.where("n = 2 and removed_hunk_id <> added_hunk_id").select(
        "diff_id", F.col("removed_line_no").alias("removed_line"), F.col("added_line_no").alias("added_line"), (F.col("added_indent") - F.col("removed_indent")).alias("indent_offset"), F.octet_length("norm").alias("bytes")
    )


def aligned_anchors(anchors: DataFrame) -> DataFrame:
    """Maximal runs of anchors that follow each other on both sides with one indent offset, large enough for a move."""
    w = Window.partitionBy("diff_id", "delta", "indent_offset").orderBy("removed_line")
    rows = anchors.withColumn("delta", F.col("removed_line") - F.col("added_line"))
    rows = rows.withColumn("island", F.col("removed_line") - F.row_number().over(w))
    runs = rows.groupBy("diff_id", "delta", "indent_offset", "island").agg(
        F.min("removed_line").alias("removed_start"), F.max("removed_line").alias("removed_end"), F.min("added_line").alias("added_start"), F.max("added_line").alias("added_end"),
        F.count("*").alias("anchor_rows"), F.sum("bytes").alias("b"),
    )
    return runs.where((F.col("anchor_rows") >= moves.LEAST_ROWS) & (F.col("b") >= moves.LEAST_BYTES)).drop("delta", "island", "indent_offset", "b")


def transcript(rows: DataFrame) -> DataFrame:
    """``conv_id, turns, prompt``: each conversation as one text, its turns in order."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    per = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    said = F.transform("t", lambda x: F.concat(F.lit("["), x["role"], F.lit("]\n"), x["text"]))
    return per.select("conv_id", F.size("t").cast("long").alias("turns"), F.array_join(said, "\n\n").alias("prompt"))


def with_cache(keyed: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits with their cached result, and the misses, by ``cache_key``."""
    return keyed.join(cache, "cache_key"), keyed.join(cache, "cache_key", "left_anti")
