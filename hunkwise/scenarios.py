"""Written cases of diffs and plans, dealt to the rows of ``documents``, for queries and tests.

Every document makes one small diff: the case is chosen by its id, and ``§`` in a case's text
stands for a name made of the document's id and first letters. What must come out is
written here by hand, and is compared as a table of values in SQL.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.operators import diffs as D

NONE = "\\ No newline at end of file"


def hunk(*rows: str, heading: str = "", old: int = 1, new: int = 1) -> str:
    """A hunk with counts that fit its rows."""
    a, b = (sum(r[:1] in (" ", m) for r in rows) for m in "-+")
    return f"@@ -{old},{a} +{new},{b} @@{heading}\n" + "".join(r + "\n" for r in rows)


def file(path: str, *hunks: str) -> str:
    """A changed file: its first hunk header is row 5, the hunk's first row row 6."""
    return f"diff --git a/{path} b/{path}\nindex 1..2 100644\n--- a/{path}\n+++ b/{path}\n" + "".join(hunks)


def plan(remove=(), fold=(), replace=()) -> dict:
    span = lambda xs: [{"start_line": a, "end_line": b} for a, b in xs]
    return {"remove": span(remove), "replace": [{"line": n, "old": o, "new": w} for n, o, w in replace], "fold": span(fold)}


@dataclass(frozen=True)
class Case:
    """A diff; with a plan either the (rule, place) of each refusal or the rows that stay, with their elision line."""

    raw: str
    plan: dict | None = None
    refused: tuple = ()
    kept: tuple = ()  # first and last rows that stay, or a row's new text
    elision: str = ""
    layout: tuple = ()  # kind, file, hunk, language, owner of each row
    unreadable: tuple = ()
    imports: tuple | None = None
    mandatory: tuple | None = None
    moves: tuple | None = None
    literals: tuple | None = None
    nets: tuple | None = None  # hunk, side, language, round, square, curly, angle
    chunks: tuple | None = None  # text, section, continuation

    @property
    def reading(self) -> str:
        rows = self.raw.split("\n")
        out = []
        for k in self.kept:
            out += [k] if isinstance(k, str) else rows[k[0] - 1 : k[1]]
        return "".join(r + "\n" for r in out)


_MOVED = ["§ is the first row of a moved block", "§ is the second row of a moved block", "§ is the third row of a moved block"]
_MOVE = file("a.txt", hunk(*["-" + r for r in _MOVED])) + file("b.txt", hunk(*["+" + r for r in _MOVED]))
_TXT = file("a.txt", hunk("-a §", "+b §"))
_FUNC = ("+func §() {", "+\tgo()", "+}")
_CLASS = ("+@§()", "+export class A {", "+  x = 1;", "+}")
_TS = ("+function §() {", "+  go();", "+  if (x) {", "+    y();", "+  }", "+}")
_LONG = ["+§ " + c * 100 for c in "abcde"]

CASES = [
    # --- plans on Python ---
    Case(file("a.py", hunk("+@§", "+def f():", "+    return 1")), plan(remove=[(6, 6)]), (("python-decorator", "line 6"),)),
    Case(file("a.py", hunk("+@§", "+@more(", "+    1)", "+def f():", "+    return 1")), plan(remove=[(9, 10)]), (("python-decorator", "line 6"), ("python-decorator", "line 7"))),
    Case(file("a.py", hunk("+def §():", "+    return 1")), plan(remove=[(6, 6)]), (("python-suite", "line 6"),)),
    Case(file("a.py", hunk("+def §(", "+    a,", "+):", "+    return 1", "+x = 2")), plan(remove=[(9, 9)]), (("python-suite", "line 6"),)),
    Case(file("a.py", hunk("+x = [", "+    §,", "+]", "+y = 1")), plan(remove=[(6, 6)]), (("python-region", "lines 6-6"), ("python-brackets", "line 5"))),
    Case(file("a.py", hunk("+s = '''", "+§", "+'''", "+z = 1")), plan(remove=[(8, 8)]), (("python-region", "lines 8-8"), ("python-quotes", "line 5"))),
    Case(file("a.py", hunk("+§ = 3", "+def g():", "+    return §")), plan(remove=[(6, 6)]), (("python-reference", "line 6"),)),
    Case(file("a.py", hunk("+§ = 3", "+x = '§'  # §")), plan(remove=[(6, 6)]), kept=((1, 5), (7, 7)), elision="kept 1/2 changed lines in 1/1 files"),
    Case(file("a.py", hunk("+x = 1 + \\", "+    §", "+y = 3")), plan(remove=[(7, 7)]), (("python-backslash", "lines 6-7"),)),
    Case(file("a.py", hunk("+def f():", "+    a = §", "+    return a")), plan(fold=[(6, 8)]), (("fold-anchor", "fold 0"),)),
    Case(file("a.py", hunk("+def f():", "+    a = §", "+", "+    if x:", "+        b = 1")), plan(fold=[(7, 8)]), kept=((1, 6), "+    ...", (9, 10)), elision="kept 4/5 changed lines in 1/1 files"),
    Case(file("a.py", hunk("+x = f(§)")), plan(replace=[(6, "f(§)", "f...")]), (("replace", "replace 0"),)),
    Case(file("a.py", hunk("+def §():", "+    return 1")), plan(replace=[(6, "def §", "...§")]), (("replace", "replace 0"),)),
    Case(file("a.py", hunk("+x = f(§, 1)", "+y = '''§", "+'''")), plan(replace=[(6, "§, 1", "...")]), kept=((1, 5), "+x = f(...)", (7, 8)), elision="kept 3/3 changed lines in 1/1 files"),
    Case(file("a.py", hunk("+def f():", "+    import os", "+", "+y = §")), plan(), kept=((1, 6), "+    ...", (8, 9)), elision="kept 4/4 changed lines in 1/1 files"),
    Case(file("a.py", hunk("+import os", "+import sys", "+x = §", "+y = 1")), plan(fold=[(7, 8)]), (("fold-imports", "fold 0"),)),
    # --- plans on Go and TypeScript ---
    Case(file("a.go", hunk(*_FUNC)), plan(remove=[(8, 8)]), (("go-structure", "line 5"),)),
    Case(file("a.go", hunk(*_FUNC)), plan(remove=[(6, 6), (8, 8)]), (("go-owner", "line 6"),)),
    Case(file("a.go", hunk(*_FUNC)), plan(replace=[(6, "func §() {", "func...")]), (("replace", "replace 0"),)),
    Case(file("a.go", hunk("+func f() {", "+\tif § {", "+\t\tgo()", "+\t}", "+}")), plan(fold=[(7, 9)]), kept=((1, 6), "+\t...", (10, 10)), elision="kept 3/5 changed lines in 1/1 files"),
    Case(file("a.go", hunk("+a := \"{\" // § {", "+b := '}'", "+c := `{", "+{`")), plan(remove=[(6, 7)]), kept=((1, 5), (8, 9)), elision="kept 2/4 changed lines in 1/1 files"),
    Case(file("a.ts", hunk(*_CLASS)), plan(remove=[(6, 6)]), (("typescript-decorator", "line 6"),)),
    Case(file("a.ts", hunk(*_CLASS)), plan(remove=[(7, 7), (9, 9)]), (("typescript-owner", "line 7"),)),
    Case(file("a.ts", hunk(*_TS)), plan(fold=[(7, 8)]), (("typescript-structure", "line 5"), ("typescript-fold", "lines 7-8"))),
    Case(file("a.ts", hunk(*_TS)), plan(fold=[(8, 10)]), kept=((1, 7), "+  ...", (11, 11)), elision="kept 4/6 changed lines in 1/1 files"),
    Case(file("a.ts", hunk("+let §: Map<string, X> = a;")), plan(replace=[(6, "Map<string, X>", "Map...")]), (("replace", "replace 0"),)),
    # --- moves ---
    Case(_MOVE, plan(remove=[(6, 6)]), (("move-symmetry", "lines 6-8"),), moves=((6, 8, 14, 16),)),
    Case(_MOVE, plan(replace=[(7, "second row of", "second ... of")]), (("move-elision", "line 7"),)),
    Case(_MOVE, plan(fold=[(6, 7), (15, 16)]), (("move-symmetry", "lines 6-8"),) * 3),
    Case(_MOVE, plan(fold=[(6, 8), (14, 16)]), kept=((1, 5), "-...", (9, 13), "+..."), elision="kept 2/6 changed lines in 2/2 files"),
    Case(file("a.txt", hunk("-above", *["-" + r for r in _MOVED], "-")) + file("b.txt", hunk(" c", *["+\t" + r for r in _MOVED], "+", "+below")), moves=((7, 10, 17, 20),)),
    Case(_MOVE + file("c.txt", hunk(*[" " + r for r in _MOVED])), moves=()),
    Case(file("a.txt", hunk("-import os  # §", "-x = compute(§, 'first')", "-y = compute(§, 'second')")) + file("b.py", hunk("+import os  # §", "+x = compute(§, 'first')", "+y = compute(§, 'second')")), imports=((14, 14),), mandatory=((6, 6), (14, 14)), moves=((6, 8, 14, 16),)),
    # --- frames ---
    Case(_TXT, plan(remove=[(1, 1)]), (("file-header", "line 1"),)),
    Case(_TXT, plan(remove=[(3, 3)]), (("pair-split", "lines 3-4"), ("pair-header", "lines 3-4"))),
    Case(_TXT, plan(remove=[(5, 5)]), (("hunk-rows", "line 5"), ("hunk-header", "line 5"))),
    Case(_TXT, plan(remove=[(6, 7)]), (("hunk-header", "line 5"),)),
    Case(_TXT, plan(remove=[(5, 7)]), (("pair-header", "lines 3-4"),)),
    Case(_TXT, plan(remove=[(3, 7)]), (("file-metadata", "line 1"), ("file-header", "line 1"))),
    Case(_TXT, plan(remove=[(1, 7)]), elision="elided all 2 changed lines in 1 files"),
    Case(file("a.txt", hunk("-a §", NONE, "+b §")), plan(remove=[(6, 6)]), (("no-newline", "line 7"),)),
    Case(f"diff --git a/x§ b/y§\nsimilarity index 90%\nrename from x§\nrename to y§\n--- a/x§\n+++ b/y§\n{hunk('-a', '+b')}", plan(remove=[(3, 3)]), (("rename-pair", "lines 3-4"),)),
    Case(_TXT, plan(remove=[(7, 6), (6, 6), (6, 7)]), (("remove-range", "remove 0"), ("remove-overlap", "remove 2"))),
    Case(_TXT, plan(fold=[(6, 7), (3, 4), (6, 6), (9, 99)]), (("fold-marker", "fold 0"), ("fold-source", "fold 1"), ("fold-range", "fold 2"), ("fold-range", "fold 3"))),
    Case(file("a.txt", hunk("+", "+\t", "+x §", "+y")), plan(remove=[(8, 8)], fold=[(6, 7), (8, 9)]), (("fold-blank", "fold 0"), ("fold-overlap", "fold 1"))),
    Case(file("a.txt", hunk("+alpha beta gamma §")), plan(replace=[(6, "alpha beta", "alpha ..."), (6, "beta gamma", "... gamma")]), (("replace", "replace 1"),)),
    Case(file("a.txt", hunk("+alpha beta beta §")), plan(replace=[(6, "beta", "b..."), (6, "§", "§"), (6, "alpha", "al...x"), (5, "@@", "..."), (66, "a", "..."), (6, "", "...")]), tuple(("replace", f"replace {i}") for i in range(6))),
    # --- structure ---
    Case(
        f"note §\ndiff --git a/§.go b/§.py\nold mode 100644\nnew mode 100755\nsimilarity index 90%\nrename from §.go\nrename to §.py\nindex 1..2\n--- a/§.go\t2020\n+++ b/§.py\t2020\n@@ -1,2 +1,2 @@ def f():\n a\n-b\r\n{NONE}\n+c\n-- \n2.40\n",
        layout=(
            ("other", None, None, None, None), ("header", 0, None, "python", None), ("other", 0, None, "python", None), ("other", 0, None, "python", None), ("index", 0, None, "python", None),
            ("rename_from", 0, None, "python", None), ("rename_to", 0, None, "python", None), ("index", 0, None, "python", None), ("old_file", 0, None, "python", None), ("new_file", 0, None, "python", None),
            ("hunk_header", 0, 0, "python", None), ("context", 0, 0, "python", None), ("change", 0, 0, "python", None), ("no_newline", 0, 0, "python", 13), ("change", 0, 0, "python", None),
            ("mail_signature", 0, None, "python", None), ("other", 0, None, "python", None),
        ),
    ),
    Case(
        "--- a/§.ts\n+++ b/§.ts\n@@ -1 +1 @@\n-a\n+b\n--- a/§.rs\n+++ b/§.rs\n@@ -0,0 +1,2 @@\n+--- x\n++++ y\n",
        layout=(
            ("old_file", 0, None, "typescript", None), ("new_file", 0, None, "typescript", None), ("hunk_header", 0, 0, "typescript", None), ("change", 0, 0, "typescript", None), ("change", 0, 0, "typescript", None),
            ("old_file", 1, None, "rust", None), ("new_file", 1, None, "rust", None), ("hunk_header", 1, 1, "rust", None), ("change", 1, 1, "rust", None), ("change", 1, 1, "rust", None),
        ),
    ),
    Case(
        "@@\n+a §\n--- x\n+++ y.c\n@@ -1 +1 @@ f(§)\n-a\n+b\n",
        layout=(
            ("hunk_header", None, 0, None, None), ("change", None, 0, None, None), ("old_file", 0, None, "c", None), ("new_file", 0, None, "c", None),
            ("hunk_header", 0, 1, "c", None), ("change", 0, 1, "c", None), ("change", 0, 1, "c", None),
        ),
    ),
    Case(file("a.c", "@@ -1,1 +1,1 @@\n-a §\n+b\n+c\n+d\n"), unreadable=(("hunk-counts", "line 5"),)),
    Case(file("a.c", "@@ -1,3 +1,1 @@\n-a §\n+b\n"), unreadable=(("hunk-counts", "line 5"),)),
    Case("diff --cc §\n", unreadable=(("combined", "line 1"),)),
    Case("diff --git a/§ b/§\n@@@ -1 -1 +1 @@@\n", unreadable=(("combined", "line 2"),)),
    # --- imports ---
    Case(file("a.go", hunk("+import (", '+\t"fmt"', "+", '+\tx "os" // §', "+)", "+func §() {}")), imports=((6, 10),)),
    Case(file("a.py", hunk("+try:", "+    from a import (", "+        b,  # §", "+    )", "+except ImportError:", "+    b = None")), imports=((7, 9),)),
    Case(file("a.py", hunk("+if §:", "+    import a, \\", "+        b", "+elif x:", "+    from . import c", "+else:", "+    import d", "+", "+go()")), imports=((6, 13),)),
    Case(file("a.ts", hunk("+import {", "+  a as b,", "+} from '§';", "+const { c,", "+  d } = require('§');", "+b();")), imports=((6, 10),)),
    Case(file("a.rs", hunk("+pub use a::{", "+    §,", "+};", "+fn f() {}")), imports=((6, 8),)),
    Case(file("a.h", hunk("+#include <§.h>", "+# include_next \\", "+  <b.h>", "+int x;")), imports=((6, 8),)),
    Case(file("a.go", hunk(' \t"a"', '+\t"§"', " )", heading=" import (")), imports=((1, 8),)),
    Case(file("a.py", hunk("+src = '''", "+import §", "+", "+go()", "+'''")), imports=((7, 8),)),
    Case(file("a.go", hunk("+package §", "+", '+import "fmt"')), imports=((1, 8),)),
    Case(file("a.go", hunk("-x", "+package §", '+import "fmt"')), imports=((8, 8),)),
    Case(file("a.java", hunk("+import static a.§.*;", "+import a.b as c", "+class X {}")), imports=((6, 7),)),
    # --- literals and delimiters ---
    Case(file("a.py", hunk("+s = '''", "+a §", "+'''", "+x = [", "+  1,", "+]", "+y = 1 \\", "+  + 2")), literals=((7, 8), (10, 11), (13, 13)), nets=((0, "-", "python", 0, 0, 0, 0), (0, "+", "python", 0, 0, 0, 0))),
    Case(file("a.go", hunk("+s := `a", "+b §", "+c`", "+d()")), literals=((7, 8),), nets=((0, "-", "go", 0, 0, 0, 0), (0, "+", "go", 0, 0, 0, 0))),
    Case(file("a.py", hunk("+f(§[", "+{  # (", "-) + '('")), literals=((7, 8),), nets=((0, "-", "python", -1, 0, 0, 0), (0, "+", "python", 1, 1, 1, 0))),
    Case(file("a.go", hunk('+a := "{" // (', "+if § {", "+\tb := `[` + f(")), literals=(), nets=((0, "-", "go", 0, 0, 0, 0), (0, "+", "go", 1, 0, 1, 0))),
    Case(file("a.ts", hunk("+let §: Map<string> = `{`; // [", "+f(() => { /[(]/.test(a < b);")), literals=(), nets=((0, "-", "typescript", 0, 0, 0, 0), (0, "+", "typescript", 1, 0, 1, 0))),
    # --- chunks of at most 400 bytes ---
    Case(file("a.txt", hunk(*_LONG[:2])) + file("b.txt", hunk(*_LONG[2:4])), chunks=((file("a.txt", hunk(*_LONG[:2])), -1, False), (file("b.txt", hunk(*_LONG[2:4])), -1, False))),
    Case(
        file("a.txt", hunk(*_LONG[:2]), hunk(*_LONG[2:4], new=9)),
        chunks=((file("a.txt", hunk(*_LONG[:2])), 0, False), (file("a.txt", hunk(*_LONG[2:4], new=9)), 0, True)),
    ),
    Case(
        file("a.txt", hunk(*_LONG[:5], heading=" §")),
        chunks=((file("a.txt", hunk(*_LONG[:2], heading=" §")), 0, False), (file("a.txt", hunk(*_LONG[2:4], new=3)), 0, True), (file("a.txt", hunk(_LONG[4], new=5)), 0, True)),
    ),
]
BUDGET = 400


def _of(cases: str) -> str:
    return f"coalesce({cases}, -1)"


#: The case of each document in DuckDB, with its name.
BASE = f"d AS (SELECT {_of('doc_id')} AS doc_id, (({_of('doc_id')} % {len(CASES)}) + {len(CASES)}) % {len(CASES)} AS n, 'd' || {_of('doc_id')} || '_' || substr(regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g'), 1, 12) AS name FROM documents)"


def dealt(spark: SparkSession, sf_dir: str, **given) -> DataFrame:
    """``diff_id, raw, json`` of the documents whose case says something of ``given``."""
    rows = [(n, c.raw, json.dumps(c.plan, ensure_ascii=False) if c.plan else None) for n, c in enumerate(CASES) if all(getattr(c, k) not in (None, ()) or (getattr(c, k) == () and empty) for k, empty in given.items())]
    cases = F.broadcast(spark.createDataFrame(rows, "n long, template string, plan string"))  # one row a case
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("doc_id", F.lit(-1)).alias("diff_id"), "text")
    name = F.concat(F.lit("d"), "diff_id", F.lit("_"), F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]", ""), 1, 12))
    docs = docs.withColumns({"n": F.pmod("diff_id", F.lit(len(CASES))), "name": name}).join(cases, "n")
    fill = lambda c: F.replace(c, F.lit("§"), F.col("name"))
    return docs.select("diff_id", "n", fill(F.col("template")).alias("raw"), fill(F.col("plan")).alias("json"))


def planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The diffs of cases with plans, and the plans compiled."""
    diffs = dealt(spark, sf_dir, plan=False)
    plans = D.decoded_plans(diffs.select("diff_id", F.lit(1).cast("long").alias("plan_id"), "json"))
    return diffs, D.compiled(diffs, plans.select("diff_id", "plan_id", "remove", "replace", "fold"))


def _text(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"


def values(names: str, rows: list[tuple]) -> str:
    """A table of values in SQL."""
    return f"c({names}) AS (VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows) + ")"


def spread(names: str, rows: list[tuple], select: str) -> str:
    """SQL for what each document's case says: ``rows`` begin with the number of their case."""
    return f"WITH {BASE}, {values('n, ' + names, rows)} SELECT {select} FROM d JOIN c USING (n)"


def said(field: str) -> list[tuple]:
    """Rows of all cases that say something of ``field``."""
    return [(n, *x) for n, c in enumerate(CASES) for x in getattr(c, field) or ()]
