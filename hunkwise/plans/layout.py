"""Rows and structure of well-formed diffs as window expressions, without Python.

``lines`` is exact for any text. ``layout`` needs counted hunk headers and bodies
that agree with them; ``hunkwise.operators.diffs.layout`` reads everything. All windows
are partitioned by diff, and a diff is at most a few MB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.functions.diff import META_PREFIXES, NO_NEWLINE, SIGNATURE, SUFFIXES


def lines(diffs: DataFrame) -> DataFrame:
    """``diff_id, line_no, text, eol``: physical rows with their exact ends."""
    # Each match is a row with its end, so nothing but the matches leaves the explode.
    rows = diffs.select("diff_id", F.posexplode(F.regexp_extract_all("raw", F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))).alias("at", "part"))
    crlf, ended = F.col("part").endswith("\r\n"), F.col("part").endswith("\n")
    return rows.select(
        "diff_id",
        (F.col("at") + 1).alias("line_no"),
        F.when(crlf, F.expr("left(part, length(part) - 2)")).when(ended, F.expr("left(part, length(part) - 1)")).otherwise(F.col("part")).alias("text"),
        F.when(crlf, "\r\n").when(ended, "\n").otherwise("").alias("eol"),
    )


def path_language(path: Column) -> Column:
    """The language of a path by its suffix, null if unknown."""
    low = F.lower(F.btrim(path, F.lit('"')))
    out = None
    for name, ends in SUFFIXES.items():
        hit = low.rlike("(" + "|".join(e.replace(".", r"\.") for e in ends) + r")\z")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _count(group: int) -> Column:
    """A count of a hunk header; 1 where it isn't stated."""
    found = F.regexp_extract("text", r"\A@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", group)
    return F.when(found == "", F.lit(1)).otherwise(found.try_cast("int"))


def layout(diffs: DataFrame) -> DataFrame:
    """``diff_id, line_no, text, eol, kind, file_id, hunk_id, language`` of well-formed diffs."""
    # Every window has the same partitioning and order, so rows are shuffled and sorted once.
    by_row = Window.partitionBy("diff_id").orderBy("line_no")
    before = by_row.rowsBetween(Window.unboundedPreceding, -1)
    text, marker = F.col("text"), F.col("marker")
    path = lambda row: path_language(F.split(F.trim(F.substr(row, F.lit(5))), "\t")[0])
    rows = lines(diffs).withColumn("marker", F.substring("text", 1, 1))
    plus = text.rlike(r"\A\+\+\+[ \t]")
    rows = rows.withColumns({
        "old_before": F.coalesce(F.count_if(marker.isin(" ", "-")).over(before), F.lit(0)),
        "new_before": F.coalesce(F.count_if(marker.isin(" ", "+")).over(before), F.lit(0)),
        "plus_next": F.coalesce(F.lead(plus).over(by_row), F.lit(False)),
        "plus_language": F.lead(F.when(plus, path(text))).over(by_row),
    })
    # A row that can't be source ends a stretch; a stretch that begins at a counted header is a hunk.
    breaks = ~marker.isin(" ", "+", "-") & (text != NO_NEWLINE)
    counted = F.when(text.startswith("@@"), F.struct((_count(1) + F.col("old_before")).alias("old"), (_count(2) + F.col("new_before")).alias("new")))
    rows = rows.withColumn("open", F.last(F.when(breaks, F.struct(counted.alias("ends"))), ignorenulls=True).over(by_row))
    # The header itself is not source, whatever it starts with.
    source = ((F.col("open.ends.old") > F.col("old_before")) | (F.col("open.ends.new") > F.col("new_before"))) & marker.isin(" ", "+", "-")
    rows = rows.withColumn("source", F.coalesce(source, F.lit(False)))
    rows = rows.withColumn("pair", ~F.col("source") & text.rlike(r"\A---[ \t]") & F.col("plus_next"))
    git = ~F.col("source") & text.startswith("diff --git ")
    rows = rows.withColumns({"git": git, "second": F.coalesce(F.lag("pair").over(by_row), F.lit(False)) & ~F.col("source")})
    sign = ~F.col("source") & (F.col("text") == SIGNATURE)
    rows = rows.withColumn("gits", F.last(F.when(F.col("git"), True).when(sign, False), ignorenulls=True).over(before))
    starts = F.col("git") | (F.col("pair") & ~F.coalesce("gits", F.lit(False)))
    kind = F.when(F.col("source"), F.when(F.col("marker") == " ", "context").otherwise("change")).when(F.col("text") == NO_NEWLINE, "no_newline")
    kind = kind.when(F.col("second"), "new_file").when(sign, "mail_signature").when(F.col("git"), "header")
    for prefix, name in META_PREFIXES.items():
        kind = kind.when(F.col("text").startswith(prefix), name)
    kind = kind.when(F.col("pair"), "old_file").when(F.col("text").startswith("@@"), "hunk_header").otherwise("other")
    rows = rows.withColumns({"kind": kind, "file_no": F.sum(starts.cast("int")).over(by_row)})
    hunks = F.sum((F.col("kind") == "hunk_header").cast("int")).over(by_row)
    in_hunk = F.col("kind").isin("hunk_header", "context", "change", "no_newline")
    fields = F.split("text", r"\s+")
    of_row = F.when(F.col("git"), F.coalesce(path_language(F.get(fields, F.lit(3))), path_language(F.get(fields, F.lit(2)))))
    of_row = of_row.when(F.col("pair"), F.coalesce("plus_language", path(text)))
    known = F.last(F.when(F.col("git"), F.coalesce(of_row, F.lit(""))).otherwise(of_row), ignorenulls=True).over(by_row)
    return rows.select(
        "diff_id", "line_no", "text", "eol", "kind",
        F.when(F.col("file_no") > 0, F.col("file_no") - 1).cast("int").alias("file_id"),
        F.when(in_hunk, hunks - 1).cast("int").alias("hunk_id"),
        F.when(known != "", known).alias("language"),
    )
