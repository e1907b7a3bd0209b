"""The per-diff core: structure, imports, moves, plans, elision, chunks."""

import pytest

from hunkwise.functions import chunks as ch
from hunkwise.functions import lexers as lx
from hunkwise.functions.diff import Diff, check, hunk_counts, mask_ranges, numbered, path_language, split_rows
from hunkwise.functions.elision import elision_line, kept_counts
from hunkwise.functions.imports import import_mask, side_imports
from hunkwise.functions.moves import Move, columns, extend_mask, find_moves, format_moves
from hunkwise.functions.plans import PlanError, Stats, compile_plan, compile_submission, decode_plan, feedback, is_elision, line_problem, only_place


def file(path, *hunks):
    return f"diff --git a/{path} b/{path}\nindex 1..2 100644\n--- a/{path}\n+++ b/{path}\n" + "".join(hunks)


def hunk(rows, old=1, new=1, heading=""):
    rows = rows if isinstance(rows, list) else rows.splitlines()
    a = sum(r[:1] in " -" for r in rows)
    b = sum(r[:1] in " +" for r in rows)
    return f"@@ -{old},{a} +{new},{b} @@{heading}\n" + "".join(r + "\n" for r in rows)


def plan(remove=(), replace=(), fold=()):
    span = lambda xs: [{"start_line": a, "end_line": b} for a, b in xs]
    return {"remove": span(remove), "replace": [{"line": n, "old": o, "new": w} for n, o, w in replace], "fold": span(fold)}


def refused(raw, **ops):
    with pytest.raises(PlanError) as e:
        compile_plan(raw, plan(**ops))
    return str(e.value)


@pytest.mark.parametrize(
    ("text", "rows", "ends"),
    [("", [], []), ("a", ["a"], [""]), ("a\n", ["a"], ["\n"]), ("a\r\nb\r", ["a", "b\r"], ["\r\n", ""]), ("\n\n", ["", ""], ["\n", "\n"])],
)
def test_split_rows(text, rows, ends):
    assert split_rows(text) == (rows, ends)


def test_structure_kinds():
    raw = "note\n" + file("a.go", hunk([" x", "-old", "+new"]), "\\ No newline at end of file\n") + "-- \n2.1\n"
    d = Diff(raw)
    assert d.kind == ["other", "header", "index", "old_file", "new_file", "hunk_header", "context", "change", "change", "no_newline", "mail_signature", "other"]
    assert d.owner[9] == 8
    assert d.language[7] == "go"
    assert d.file[0] is None
    assert d.file[5] == 0
    assert not check(d)


def test_source_that_looks_like_headers():
    raw = file("a.sql", hunk(["--- counter", "+++ counter", "-- x", "+y"]))
    d = Diff(raw)
    assert d.kind[5:] == ["change"] * 4


def test_raw_pairs_begin_files_of_their_own():
    one = lambda p: f"--- a/{p}\n+++ b/{p}\n" + hunk(["-a", "+b"])
    d = Diff(one("x.py") + one("y.ts"))
    assert [d.file[i] for i in (0, 4, 5, 9)] == [0, 0, 1, 1]
    assert d.language[7] == "typescript"
    assert d.sections == [(0, 5), (5, 10)]


def test_bare_hunk_header_is_open_until_a_pair():
    d = Diff("@@\n+a\n+b\n--- a/x.c\n+++ b/x.c\n@@ -1 +1 @@\n-a\n+b\n")
    assert d.kind == ["hunk_header", "change", "change", "old_file", "new_file", "hunk_header", "change", "change"]
    assert not d.problems


def test_wrong_counts_are_reported_once():
    d = Diff(file("a.c", "@@ -1,1 +1,1 @@\n-a\n+b\n+c\n+d\n"))
    assert len(d.problems) == 1
    assert "hunk-counts (line 5)" in d.problems[0]
    assert "line 8 shows" in d.problems[0]
    short = Diff(file("a.c", "@@ -1,3 +1,1 @@\n-a\n"))
    assert len(short.problems) == 1


@pytest.mark.parametrize(
    ("row", "counts"),
    [("@@ -1 +1 @@", (1, 1)), ("@@ -1,0 +1,7 @@ f", (0, 7)), ("@@ -1,2 +a @@", None), ("@@ -1,-2 +1 @@", None), ("@@", None), ("@@ +1 -1 @@", None)],
)
def test_hunk_counts(row, counts):
    assert hunk_counts(row) == counts


def test_combined_diffs_are_refused():
    assert "combined (line 1)" in check(Diff("diff --cc a\n"))[0]
    assert "combined (line 2)" in check(Diff("diff --git a/x b/x\n@@@ -1 -1 +1 @@@\n"))[0]


@pytest.mark.parametrize(("path", "language"), [("a.PYI", "python"), ('"b/x.Tsx"', "typescript"), ("x.kts", "java"), ("x.hxx", "c"), ("x", None), ("x.mjs", "javascript")])
def test_path_language(path, language):
    assert path_language(path) == language


def test_numbered_and_ranges():
    assert numbered("a\n" * 10).splitlines()[8:] == [" 9|a", "10|a"]
    assert mask_ranges([True, True, False, True]) == [(1, 2), (4, 4)]


IMPORTS = [
    ("go", ["import (", '\t"fmt"', "", '\tx "os" // c', ")", "func f() {}"], 5),
    ("go", ['import . "fmt"', "x := 1"], 1),
    ("python", ["from a.b import (", "    c,  # why", "    d as e,", ")", "x = 1"], 4),
    ("python", ["import a, \\", "    b", "x"], 2),
    ("python", ["from . import x"], 1),
    ("typescript", ["import {", "  a,", "  b as c,", "} from 'x';", "f()"], 4),
    ("javascript", ["const { a,", "  b } = require('x');", "y"], 2),
    ("javascript", ["import 'x';", "import('y')"], 1),
    ("rust", ["pub use a::{", "    b,", "};", "fn f() {}"], 3),
    ("c", ["#include <a.h>", "# include_next <b>", "int x;"], 2),
    ("java", ["import static a.b.*;", "import a.b as c", "class X {}"], 2),
]


@pytest.mark.parametrize(("language", "rows", "n"), IMPORTS)
def test_import_statements(language, rows, n):
    assert side_imports(rows, language, False) == [i < n for i in range(len(rows))]


@pytest.mark.parametrize(("language", "row"), [("python", "import_x = 1"), ("python", "from x import y()"), ("go", 'imported "x"'), ("rust", "user::x;"), ("java", "importer();"), ("typescript", "important('x')"), ("c", "#define include")])
def test_not_imports(language, row):
    assert side_imports([row], language, False) == [False]


def test_guard_suites_and_gaps():
    rows = ["try:", "    import a", "except ImportError:", "    import b", "", "import c", "x = 1"]
    assert side_imports(rows, "python", False) == [True] * 6 + [False]
    assert side_imports(["try:", "    import a", "    go()"], "python", False) == [False, True, False]


def test_imports_in_literals():
    rows = ["src = '''", "import os", "", "go()", "'''"]
    assert side_imports(rows, "python", False) == [False, True, True, False, False]
    assert side_imports(["x := `", "use a::b;", "`"], "go", False) == [False, True, False]


def test_import_only_hunk_and_file_vanish():
    raw = file("a.py", hunk([" x", "-import a", "+import b", "+"]))
    assert all(import_mask(Diff(raw)))
    kept = file("a.py", hunk(["-import a", "+x = 1"]))
    assert mask_ranges(import_mask(Diff(kept))) == [(6, 6)]
    assert compile_plan(raw, plan()).text == ""


def test_package_row_frames_only_one_sided_hunks():
    assert all(import_mask(Diff(file("a.go", hunk(["+package a", "+", '+import "fmt"'])))))
    assert not all(import_mask(Diff(file("a.go", hunk(["-x", "+package a", '+import "fmt"'])))))


def test_hunk_heading_continues_an_import():
    raw = file("a.go", hunk([' \t"a"', '+\t"b"', " )"], heading=" import ("))
    assert all(import_mask(Diff(raw)))


BLOCK = ["def total(rows):", "    count = sum(len(row.cells) for row in rows)", "    return count * 100 // max(1, len(rows))"]


def moved(shift="", more=(), extra=""):
    return file("a.txt", hunk(["-" + x for x in [*BLOCK, *more]])) + file("b.txt", hunk(["+" + shift + x for x in [*BLOCK, *more]] + ([extra] if extra else [])))


def test_moves():
    assert find_moves(Diff(moved())) == [Move(6, 8, 14, 16)]
    assert find_moves(Diff(moved("    "))) == [Move(6, 8, 14, 16)]
    assert find_moves(Diff(moved(more=["", ""]))) == [Move(6, 10, 16, 20)]
    third = moved() + file("c.txt", hunk([" " + x for x in BLOCK]))
    assert find_moves(Diff(third)) == []
    same = file("a.txt", hunk(["-" + x for x in BLOCK] + [" x"] + ["+" + x for x in BLOCK]))
    assert find_moves(Diff(same)) == []
    assert columns(" \t ") == 9
    assert format_moves([Move(1, 2, 3, 4)] * 13).endswith("and 1 more")


def test_moves_must_be_treated_alike():
    raw = moved()
    assert "move-symmetry (lines 6-8)" in refused(raw, remove=[(1, 8)])
    assert compile_plan(raw, plan(fold=[(6, 8), (14, 16)])).stats.fold_count == 2
    assert "have other ends" in refused(moved(more=["one more row"]), fold=[(6, 8), (15, 18)])
    assert "move-elision (line 7)" in refused(raw, replace=[(7, "len(row.cells) for row", "len(...) for row")])
    assert extend_mask([Move(1, 2, 3, 4)], [True, False, False, False]) == [True, False, True, False]


C = file("a.c", hunk([" int x;", "-int a = 1;", "-int b = 2;", "+int c = 3;", "+", "+int d = 4;"]))


def test_render_and_stats():
    out = compile_plan(C, plan(remove=[(8, 8)], fold=[(9, 11)]))
    assert out.text.splitlines()[5:] == [" int x;", "-int a = 1;", "+..."]
    assert out.stats == Stats(1, 1, 5, 2, 1, 3, 1)
    assert compile_plan(C, plan(remove=[(1, 11)])).text == ""
    assert compile_plan(C, plan()).text == C


@pytest.mark.parametrize(
    ("ops", "said"),
    [
        ({"remove": [(3, 2)]}, "remove-range (remove 0): 3-2"),
        ({"remove": [(7, 99)]}, "remove-range (remove 0): row 99 of"),
        ({"remove": [(7, 8), (8, 8)]}, "remove-overlap (remove 1): row 8"),
        ({"fold": [(7, 7)]}, "fold-range (fold 0)"),
        ({"fold": [(8, 9)]}, "fold-marker (fold 0)"),
        ({"fold": [(4, 6)]}, "fold-source (fold 0): row 4"),
        ({"remove": [(7, 7)], "fold": [(7, 8)]}, "fold-overlap (fold 0): row 7 is removed"),
        ({"fold": [(7, 8), (7, 8)]}, "fold-overlap (fold 1): row 7 is folded"),
        ({"remove": [(5, 5)]}, "hunk-rows (line 5)"),
        ({"remove": [(1, 1)]}, "file-header (line 1)"),
        ({"remove": [(3, 3)]}, "pair-split (lines 3-4)"),
        ({"remove": [(7, 11)]}, "hunk-header (line 5)"),
        ({"replace": [(7, "int a", "...")], "remove": [(7, 7)]}, "replace (replace 0): row 7 is removed"),
        ({"replace": [(7, "", "...")]}, "old: missing"),
        ({"replace": [(7, "int a", "int b")]}, "new: doesn't stand for old"),
        ({"replace": [(7, "int a", "int a")]}, "new: elides nothing"),
        ({"replace": [(5, "@@ -1", "...1")]}, "row 5: not a source row"),
        ({"replace": [(7, "zzz", "...z")]}, "old: not just once in row 7"),
        ({"replace": [(77, "zzz", "...z")]}, "replace (replace 0): row 77 of"),
        ({"replace": [(7, "int a = 1", "int ... 1"), (7, "a = 1;", "...;")]}, "replace (replace 1): meets replace 0 in row 7"),
        ({"replace": [(7, "int\x07a", "...a")]}, "old: holds a control character"),
    ],
)
def test_refusals(ops, said):
    assert said in refused(C, **ops)


def test_replacement():
    assert "-int ... 1;" in compile_plan(C, plan(replace=[(7, "a =", "...")])).text


def test_elision_predicate():
    assert is_elision("user.name", "u...e")
    assert is_elision("abc", "…c")
    assert not is_elision("user", "user...")
    assert not is_elision("abcd", "a....")
    assert not is_elision("abcd", "...…")
    assert is_elision("a b c d", "...…d", strict=False)
    assert not is_elision("a\nb", "a...b")
    assert only_place("aaa", "aa") is None
    assert only_place("xab", "ab") == 1
    assert line_problem("x", "a\u2028b", 9)
    assert line_problem("x", "é" * 5, 9)
    assert line_problem("x", "a\tb", 9) is None


PY = file("a.py", hunk([" import os", "+@dec", "+def f(", "+    a,", "+):", "+    '''", "+    text (", "+    '''", "+    x = [", "+        1,", "+    ]", "+    return x", "+", "+LIMIT = 3", "+def g():", "+    return LIMIT"]))


def test_python_rules():
    assert "python-decorator (line 7)" in refused(PY, remove=[(7, 7)])
    assert "python-suite (line 8): the header goes" in refused(PY, remove=[(7, 10)])
    assert "the header stays without its suite" in refused(PY, remove=[(11, 18)])
    assert "python-region (lines 11-11): on the new side" in refused(PY, remove=[(11, 11)])
    assert "python-brackets (line 5)" in refused(PY, remove=[(16, 16)])
    assert "python-reference (line 19): LIMIT" in refused(PY, remove=[(19, 19)])
    assert "fold-anchor (fold 0): row 20" in refused(PY, fold=[(20, 21)])
    assert "begins a Python suite" in refused(PY, replace=[(20, "def g", "...g")])
    assert "other Python brackets" in refused(PY, replace=[(14, "x = [", "x...")])
    out = compile_plan(PY, plan(fold=[(11, 17)])).text
    assert "+    ...\n" in out
    assert "import os" not in out


def test_python_backslashes_and_placeholders():
    raw = file("a.py", hunk(["+x = 1 + \\", "+    2", "+y = 3"]))
    assert "python-backslash (lines 6-7)" in refused(raw, remove=[(7, 7)])
    lazy = file("a.py", hunk(["+def f():", "+    import os", "+", "+y = 3"]))
    assert compile_plan(lazy, plan()).text.splitlines()[5:7] == ["+def f():", "+    ..."]


GO = file("a.go", hunk(["+func f() {", "+\tx := `{`", "+\tif x {", "+\t\tgo()", "+\t}", "+}", "+// done"]))


def test_go_rules():
    assert "go-structure (line 5): delimiters of the new side" in refused(GO, remove=[(6, 6)])
    assert "go-owner (line 6): the block" in refused(GO, remove=[(6, 6), (11, 11)])
    assert "other Go braces" in refused(GO, replace=[(6, "func f() {", "func...")])
    assert compile_plan(GO, plan(fold=[(8, 10)])).text.count("...") == 1
    assert lx.go_tokens([(0, "a := '{' // }")])[-1] == ("comment", 0)


TS = file("a.ts", hunk(["+@Injectable()", "+export class A<T> {", "+  run(x: Map<string, T>): number {", "+    return x.size > 0 ? /[}]/.test('a') ? 1 : 2 : 3;", "+  }", "+}"]))


def test_typescript_rules():
    assert "detached" not in compile_plan(TS, plan(fold=[(8, 10)])).text
    assert "typescript-decorator (line 6)" in refused(TS, remove=[(6, 6)])
    assert "typescript-structure (line 5)" in refused(TS, remove=[(7, 7)])
    assert "typescript-owner (line 7): the export" in refused(TS, remove=[(6, 7), (11, 11)])
    assert "typescript-fold (lines 8-9): what it hides is open by {+1}" in refused(TS, fold=[(8, 9)])
    assert "other TypeScript braces" in refused(TS, replace=[(7, "export class A<T> {", "export class A... {")])
    assert lx.ts_tokens([(0, "a > b; x => y; `${z}{`; // {")]) == [(";", 0), (";", 0), (";", 0)]
    assert [t for t, _ in lx.ts_tokens([(0, "return <Tag>{x}</Tag>")])] == ["<", ">", "<", ">"]


def test_elision_line():
    assert elision_line(C, compile_plan(C, plan(remove=[(8, 8)], fold=[(9, 11)])).text) == "kept 2/5 changed lines in 1/1 files"
    assert elision_line(C, "") == "elided all 5 changed lines in 1 files"
    assert elision_line("", "") == ""
    assert elision_line(C, "-int a = 1;\n") == "kept 0/5 changed lines"  # no hunk, no source
    edited = compile_plan(C, plan(replace=[(7, "a =", "...")])).text
    assert kept_counts(Diff(C), Diff(edited)) == (5, 1)


def test_elision_of_many_differing_rows_is_fast():
    a = file("a.txt", hunk([f"+row {i} of the first" for i in range(2000)]))
    b = file("a.txt", hunk([f"+row {i}... of another" for i in range(2000)]))
    assert kept_counts(Diff(a), Diff(b))[0] == 0


def big():
    return "From: me\n\n" + file("a.txt", *[hunk([f"+row {h} {i} " + "x" * 40 for i in range(20)], new=1 + 20 * h) for h in range(6)]) + file("b.py", hunk([f"-old {i} " + "y" * 40 for i in range(60)])) + "-- \n2.1\n"


@pytest.mark.parametrize("budget", [900, 1500, 4000, 100_000])
def test_chunks_fit_and_merge(budget):
    raw = big()
    found = ch.split_diff(raw, budget)
    for c in found:
        assert ch.fits(c.text, budget)
        if not c.verbatim:
            assert not check(Diff(c.text))
            assert len(split_rows(c.text)[0]) == len(c.origins)
    merged = ch.merge([(c, None if c.verbatim else ch.Result(c.text, "s", 1, 2)) for c in found])
    source = lambda t: [r for r in split_rows(t)[0] if not r.startswith("@@")]
    assert source(merged.smart_diff) == source(raw)
    assert merged.summary == "s"


def test_chunk_limits():
    with pytest.raises(PlanError, match="without a file to cut at"):
        ch.split_diff("text\n" * 100, 100)
    with pytest.raises(PlanError, match="rows that belong together"):
        ch.split_diff(file("a.txt", hunk(["+" + "x" * 5000, "+b"])), 900)
    with pytest.raises(PlanError, match="more than 32 would"):
        ch.split_diff(file("a.txt", hunk(["+" + "x" * 300] * 80)), 600)
    assert ch.chunk_moves([Move(1, 2, 5, 6)], [0, 1, -1, 4, 5]) == [Move(1, 2, 4, 5)]
    assert ch.chunk_moves([Move(1, 2, 5, 6)], [0, 4, 5, 1]) == []


def test_strict_json_and_feedback():
    assert decode_plan('{"remove":[],"replace":[],"fold":[]}')["fold"] == []
    for bad in ('{"remove":[],"replace":[]}', '{"remove":[],"replace":[],"fold":[],"x":1}', '{"remove":[],"replace":[],"fold":[]} 1', '{"remove":[{"start":1}],"replace":[],"fold":[]}', "[]"):
        with pytest.raises(PlanError):
            decode_plan(bad)
    said = feedback(compile_plan(C, plan(remove=[(8, 8)])))
    assert "4/5 visible changed rows (80%); 1 removed, 0 hidden by 0 folds; files 1/1." in said
    with pytest.raises(PlanError, match="summary: missing"):
        compile_submission(C, plan() | {"summary": " "})
    assert Stats(raw_changed=100, visible_changed=45).pressure
    assert not Stats(raw_changed=39, visible_changed=39).pressure
