"""Operators over tables: native plans against the exact ones, sources, streaming, the planner loop, the queries."""

import json
import os
import subprocess

import pytest

from hunkwise import fixtures, queries
from hunkwise.functions import chunks as ch
from hunkwise.functions import columns as C
from hunkwise.functions.plans import PlanError
from hunkwise.operators import diffs as D
from hunkwise.operators import native as N
from hunkwise.plans import agent
from hunkwise.plans import layout as L
from hunkwise.sources import diffs as S
from hunkwise.streaming import read_stream, write_stream
from tests.test_core import GO, PY, TS, C as C_DIFF, big, file, hunk, moved, plan

RAWS = [
    "", "no diff\n", C_DIFF, PY, GO, TS, moved(), big(), "a\r\nb",
    file("x.sql", hunk(["--- counter", "+++ counter", " z"]), "\\ No newline at end of file\n") + "-- \n2.1\n" + "--- a/y.py\n+++ b/y.py\n@@ -1 +1 @@\n-a\n+b\n",
    "diff --git a/a b/b\nsimilarity index 90%\nrename from a\nrename to b\ndiff --git a/c.rs b/c.rs\ncopy from c.rs\ncopy to d.rs\n",
]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def diffs(spark):
    return spark.createDataFrame(list(enumerate(RAWS)), "diff_id long, raw string").cache()


def test_native_layout_equals_the_exact_one(diffs):
    exact = D.layout(diffs).drop("marker_owner")
    native = L.layout(diffs)
    assert exact.exceptAll(native).count() == native.exceptAll(exact).count() == 0
    assert L.lines(diffs).count() == sum(len(r.replace("\r\n", "\n").splitlines()) for r in RAWS)


def test_operators(spark, diffs):
    layout = L.layout(diffs)
    stats = {r.diff_id: r for r in N.diff_stats(layout).collect()}
    assert (stats[2].changed, stats[2].files, stats[2].hunks, stats[2].changed_c) == (5, 1, 1, 5)
    heads = {r.diff_id: r for r in N.hunks(layout).where("diff_id = 3").collect()}
    assert (heads[3].new_start, heads[3].new_count, heads[3].added) == (1, 16, 15)
    assert [tuple(r)[1:] for r in D.exact_moves(diffs).where("diff_id = 6").collect()] == [(6, 8, 14, 16)]
    anchors = N.move_anchors(layout).where("diff_id = 6")
    assert anchors.count() == 3
    run = N.aligned_anchors(anchors).head()
    assert (run.removed_start, run.removed_end, run.added_start, run.added_end) == (6, 8, 14, 16)
    assert D.problems(diffs).where("size(errors) > 0").count() == 0
    assert D.delimiter_nets(diffs).where("round <> 0 or square <> 0 or curly <> 0 or angle <> 0").count() == 0
    assert {r.start_line for r in D.literal_rows(diffs).where("diff_id = 3").collect()} >= {9}
    sizes = {r.diff_id: r for r in N.sizes(L.lines(diffs)).collect()}
    assert all(sizes[i].raw_bytes == ch.size(RAWS[i]) and sizes[i].fits == ch.fits(RAWS[i]) for i in sizes)
    assert N.grep(L.lines(diffs), "row 0 1", most=5).where("diff_id = 7").count() == 5
    assert N.row_slice(L.lines(diffs), 0, 2).where("diff_id = 2").count() == 2
    bounds = N.mask_ranges(N.range_rows(D.import_ranges(diffs)))
    assert bounds.exceptAll(D.import_ranges(diffs)).count() == 0
    assert D.mandatory_rows(diffs).where("diff_id = 3").head().start_line == 6


def test_compile_table(spark, diffs):
    empty = plan()
    rows = [(2, 1, *plan(remove=[(8, 8)], fold=[(9, 11)]).values()), (2, 2, *plan(remove=[(5, 5)]).values()), (6, 1, *plan(remove=[(1, 8)]).values()), (3, 1, *empty.values()), (4, 9, None, [], [])]
    kinds = f"diff_id long, plan_id long, remove array<{D.RANGE}>, replace array<struct<line:int,old:string,new:string>>, fold array<{D.RANGE}>"
    table = spark.createDataFrame(rows, kinds)
    got = {(r.diff_id, r.plan_id): r for r in D.compiled(diffs, table).collect()}
    assert got[2, 1].stats.visible_changed == 2
    assert got[2, 1].smart_diff.endswith("+...\n")
    assert got[2, 2].smart_diff is None
    assert "hunk-rows" in got[2, 2].errors[0]
    assert "move-symmetry" in got[6, 1].errors[0]
    assert got[4, 9].errors
    reading = D.compiled(diffs, table).where("plan_id = 1 and diff_id = 2")
    assert D.elisions(diffs, reading).head().elision == "kept 2/5 changed lines in 1/1 files"
    none = table.limit(0)
    assert D.compiled(diffs, none).count() == 0


def test_chunk_table(spark, diffs):
    c = D.chunks(diffs, 1500)
    results = c.where("not passthrough").selectExpr("diff_id", "chunk_no", "text as smart_diff", "'s' as summary", "1L as input_tokens", "2L as output_tokens")
    m = {r.diff_id: r for r in D.merged(c, results).collect()}
    rows = lambda t: [r for r in t.splitlines() if not r.startswith("@@")]
    assert rows(m[7].smart_diff) == rows(RAWS[7])
    assert m[7].output_tokens == 2 * m[7].input_tokens
    assert "without a file to cut at" in c.where("diff_id = 1").head().error


def test_columns(spark):
    rows = [("user.name", "u...e"), ("user", "user..."), ("a(b)c", "a(…c"), ("abcd", "a...…"), ("a+b", "a+b"), ("x.yz", "x....")]
    df = spark.createDataFrame(rows, "old string, new string")
    got = [r[0] for r in df.select(C.is_elision(df.old, df.new)).collect()]
    from hunkwise.functions.plans import is_elision

    assert got == [is_elision(*r) for r in rows]
    one = spark.range(1).select(C.indent_columns(S.F.lit(" \t x")).alias("i"), C.occurs_once(S.F.lit("aaa"), S.F.lit("aa")).alias("o"), C.mentions(S.F.lit("ab.c"), S.F.lit("ab")).alias("m"), C.range_text(S.F.lit(2), S.F.lit(4)).alias("r")).head()
    assert tuple(one) == (9, False, True, "lines 2-4")


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.diff").write_text(C_DIFF)
    assert S.read_files(spark, str(tmp_path / "d")).head().raw == C_DIFF
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    (tmp_path / "r").mkdir()
    git("init", "-q")
    for text in ("one\n", "two\n"):
        (tmp_path / "r" / "f.txt").write_text(text)
        git("add", "-A")
        git("commit", "-qm", "m")
    got = S.read_git(spark, str(tmp_path / "r"), ["HEAD", "HEAD~1..HEAD"]).collect()
    assert all("+two" in r.raw for r in got)
    with pytest.raises(RuntimeError):
        S.read_git(spark, str(tmp_path / "r"), ["nothing"])
    assert S.git_command([], staged=True) == ["diff", "--cached"]
    for bad in (dict(revisions=["a", "b"]), dict(revisions=["a"], staged=True), dict(revisions=[], staged=True, worktree=True), dict(revisions=["-x"])):
        with pytest.raises(ValueError):
            S.git_command(**bad)
    assert S.confined("a/./b/../c") == "a/c"
    for bad in ("../x", "/etc", "a/../../x"):
        with pytest.raises(ValueError):
            S.confined(bad)
    files = S.repo_files(spark, str(tmp_path / "d"))
    assert [(r.path, r.line_no) for r in S.search(files, "int c", "one.diff").collect()] == [("one.diff", 9)]
    with pytest.raises(ValueError):
        S.search(files, "")


def test_results_and_cache(spark, diffs):
    assert S.truncated("é" * 9000).startswith("é" * 8192 + "\n... (truncated, 18000")
    assert S.result_text("", "s", "") == "# s\n\n(no meaningful change to read)\n"
    res = diffs.where("diff_id = 2").selectExpr("diff_id", "raw", "raw as smart_diff", "'s' as summary", "1 as input_tokens", "2 as output_tokens")
    assert json.loads(S.with_elision(res).head().json)["elision"] == "kept 5/5 changed lines in 1/1 files"
    keyed = diffs.withColumn("cache_key", C.cache_key(S.F.lit("p"), S.F.lit("m"), S.F.col("raw")))
    cache = keyed.where("diff_id < 4").selectExpr("cache_key", "'x' as smart_diff", "'s' as summary")
    hits, misses = S.cached(diffs, cache, "p", "m")
    assert (hits.count(), misses.count()) == (4, len(RAWS) - 4)


def test_source_precedence(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    for text in ("one\n", "two\n"):
        (tmp_path / "f.txt").write_text(text)
        git("add", "-A")
        git("commit", "-qm", "m")
    (tmp_path / "f.txt").write_text("three\n")
    git("add", "-A")
    (tmp_path / "f.txt").write_text("four\n")
    read = lambda **k: S.read_diffs(spark, repo=str(tmp_path), **k).head().raw
    assert "+three" in read(staged=True, piped="x")
    assert "+four" in read(worktree=True)
    assert "+two" in read(revisions=["HEAD"], piped="x")
    assert read(piped="x\n") == "x\n"
    assert "+two" in read()
    for bad in (dict(staged=True, worktree=True), dict(staged=True, revisions=["HEAD"]), dict(revisions=["a", "b"])):
        with pytest.raises(ValueError):
            read(**bad)


def test_repo_tools(spark):
    rows = [("a/x.py", i, f"row {i}") for i in range(1, 301)] + [("b.txt", 1, "row of b"), ("a.py", 1, "other")]
    t = S.RepoTools(spark.createDataFrame(rows, "path string, line_no int, text string")).tools
    ask = lambda name, **k: t[name](json.dumps(k))
    assert ask("read_file", path="a/./x.py", start_line=-3, end_line=2) == "1\trow 1\n2\trow 2"
    assert ask("read_file", path="a/x.py", start_line=299).count("\n") == 1
    assert ask("read_file", path="a/x.py", start_line=900) == ""
    assert ask("grep", pattern="^row of") == "b.txt:1:row of b"
    assert ask("grep", pattern="row", path="a").count("\n") == 200
    assert ask("grep", pattern="row", path="a").endswith("... (more matches)")
    assert ask("grep", pattern="row", path="a.py") == "(no matches)"
    for name, k in (("read_file", {"path": "../x"}), ("read_file", {"path": "none"}), ("grep", {"pattern": ""}), ("grep", {"pattern": "x", "path": "/etc"}), ("read_file", {"file": "x"})):
        with pytest.raises(ValueError):
            ask(name, **k)
    script = iter([call("read_file", path="b.txt"), call("read_file", path="/b.txt"), call("submit", summary="ok", **plan())])
    seen = []
    agent.abridge(lambda m: (seen.append(m[-1]), next(script))[1], C_DIFF, tools=t)
    assert [m.results[0][1:] for m in seen[1:]] == [("1\trow of b", False), ("path is outside the repository: /b.txt", True)]


def _counted(folder):
    def planner(messages):
        with open(f"{folder}/asked", "a") as f:
            f.write("x")
        if "b.py" in messages[0].text:
            raise RuntimeError("no answer")
        return call("submit", summary="s", **plan())

    return planner


def test_cache_round_trip(spark, tmp_path):
    asked = lambda: len((tmp_path / "asked").read_text())
    folder = f"file://{tmp_path}/cache"
    diffs = spark.createDataFrame([(1, C_DIFF), (2, C_DIFF), (3, C_DIFF.replace("a.c", "b.py")), (4, None)], "diff_id long, raw string")
    run = lambda: {r.diff_id: (r.summary, r.error) for r in agent.abridge_cached(diffs, _counted(tmp_path), folder, "p", "m").collect()}
    first = run()
    assert first[1] == first[2] == ("s", None)
    assert "no answer" in first[3][1]
    assert first[4][0] == "No changes."
    assert asked() == 2  # one for both copies, one for the failing diff, none for the empty one
    assert run() == first
    assert asked() == 3  # only what failed is asked again
    # What can't be read is a miss; of two results the later counts.
    key = diffs.where("diff_id = 1").withColumn("cache_key", C.cache_key(S.F.lit("p"), S.F.lit("m"), S.F.col("raw"))).select("cache_key")
    S.cache_store(key.selectExpr("cache_key", "'new' as smart_diff", "'later' as summary", "1L as input_tokens", "1L as output_tokens", "cast(null as string) as error"), folder)
    assert run()[1][0] == "later"
    for p in (tmp_path / "cache").glob("entry-*/*.parquet"):
        p.write_bytes(b"broken")
    for p in (tmp_path / "cache").glob("entry-*/.*.crc"):
        p.unlink()
    assert S.cache_load(spark, folder).count() == 0


def test_time_budget():
    with pytest.raises(agent.AbridgeError, match="no submission within 24 turns and 0 seconds"):
        agent.abridge(lambda m: call("preview_plan", **plan()), C_DIFF, seconds=0)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, raw in enumerate((C_DIFF, PY)):
        (tmp_path / "in" / f"{i}.diff").write_text(raw)
    out = str(tmp_path / "out")
    for expected in (2, 3):
        q = write_stream(read_stream(spark, str(tmp_path / "in")), lambda d: D.chunks(d).select("diff_id", "chunk_no", "error"), out, str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert spark.read.parquet(out).count() == expected
        (tmp_path / "in" / "9.diff").write_text(GO)


def call(name, **kw):
    return agent.Answer([agent.ToolCall(name, json.dumps(kw), "1")], input_tokens=10, output_tokens=1)


def test_planner_loop():
    script = iter([agent.Answer(text="hm"), call("nothing"), call("submit", remove=[], replace=[], fold=[], summary=""), call("preview_plan", **plan()), call("submit", summary="ok", **plan(remove=[(8, 8)]))])
    seen = []

    def planner(messages):
        seen.append(messages[-1])
        return next(script)

    r = agent.abridge(planner, C_DIFF)
    assert (r.summary, r.input_tokens) == ("ok", 40)
    assert "-int b" not in r.smart_diff
    assert seen[1].text.startswith("Answer with a tool call")
    assert seen[2].results[0][1:] == ("unknown tool nothing", True)
    assert "summary: missing" in seen[3].results[0][1]
    assert seen[4].results[0][1].startswith("Valid source-derived plan")
    assert agent.abridge(planner, " \n").summary == "No changes."
    with pytest.raises(agent.AbridgeError, match="no submission within 2 turns"):
        agent.abridge(lambda m: agent.Answer(), C_DIFF, most_turns=2)
    with pytest.raises(PlanError):
        agent.abridge(planner, "diff --cc x\n")


def test_model_helpers():
    from hunkwise.plans import model as M

    assert M.plan_schema(True)["required"] == ["remove", "replace", "fold", "summary"]
    assert M.identity("API ", "m") == "api:m"
    assert len(M.protocol_hash("a", "b")) == 16
    tries, waits = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise M.CallFailed(529, "busy")
        return "ok"

    assert M.with_retries(call, sleep=waits.append) == "ok"
    assert waits == [1.0, 2.0]
    with pytest.raises(M.CallFailed, match="API 400"):
        M.with_retries(lambda: (_ for _ in ()).throw(M.CallFailed(400, "bad")), sleep=waits.append)
    body = 'data: {"type":"response.output_item.done","output_index":1,"item":{"a":2}}\n\ndata: {"type":"response.output_item.done",\ndata: "output_index":0,"item":{"a":1}}\n\ndata: {"type":"response.completed","response":{"id":"r"}}\n\ndata: [DONE]\n\n'
    assert M.final_response(body) == {"id": "r", "output": [{"a": 1}, {"a": 2}]}
    with pytest.raises(ValueError):
        M.final_response('data: {"type":"x"}\n')
    assert M.describe(agent.ToolCall("grep", '{"pattern":"f x"}')) == 'grep "f x"'
    said = [agent.Message("user", "hi"), agent.Message("assistant", "", [agent.ToolCall("submit", "{}")]), agent.Message("user", results=[("1", "done", False)])]
    assert [r[3] for r in M.transcript_rows(1, said)] == ["text", "tool_use", "tool_result"]
    assert M.as_prompt("s", said).startswith("s\n\n[user]\nhi")
    assert S.paint("+a", {"new": "<"}) == "<+a\x1b[0m"
    assert S.paint("+++ a", {"new": "<"}) == "+++ a"


def test_refinement_and_fallback():
    raw = file("a.txt", hunk([f"+row {i}" for i in range(90)]))
    answers = [call("submit", summary="draft", **plan()), call("submit", summary="better", **plan(remove=[(10, 90)]))]
    assert agent.abridge(lambda m, a=iter(answers): next(a), raw).summary == "better"

    def fails(messages, a=iter(answers[:1])):
        return next(a)

    assert agent.abridge(fails, raw).summary == "draft"


def _keep_all(messages):
    return call("submit", summary="s", **plan())


def test_abridge_chunks_and_table(diffs):
    merged = agent.abridge(_keep_all, big(), budget=1500)
    assert merged.smart_diff.count("+row") == 120
    got = {r.diff_id: r for r in agent.abridge_all(diffs, _keep_all).collect()}
    assert got[0].summary == "No changes."
    assert got[2].smart_diff == C_DIFF
    assert got[1].error is None


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    r = c.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in r.description)
    at = [[d[0] for d in r.description].index(n) for n in names]
    want = sorted((tuple(row[i] for i in at) for row in r.fetchall()), key=repr)
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == names
    assert sorted((tuple(row) for row in df.select(*names).collect()), key=repr) == want


def test_fixture_shape(spark):
    docs = spark.createDataFrame([(0, "a\nb"), (1, None), (250, "c")], "doc_id long, text string")
    text = {r.doc_id: r.t for r in fixtures.sections(docs).select("doc_id", fixtures.section_text().alias("t")).collect()}
    assert text[0] == 'diff --git a/d0.go b/d0.go\n--- a/d0.go\n+++ b/d0.go\n@@ -1,3 +0,0 @@\n-import "fmt"\n-a\n-b\n'
    assert text[1].endswith('@@ -0,0 +1,2 @@\n+import "fmt"\n+\n')


def test_entry():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
