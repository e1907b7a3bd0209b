"""Operators over ``diffs(diff_id, raw)``: each applies an exact per-diff rule in Arrow batches.

No operator shuffles diffs among each other; ``compiled`` and ``elisions`` join by
``diff_id`` alone. A null ``raw`` counts as empty. Diffs that can't be read have rows
all the same where that makes sense, and their problems in ``errors``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from hunkwise.functions import chunks as ch
from hunkwise.functions import imports, lexers, moves, plans
from hunkwise.functions.diff import Diff, check, mask_ranges
from hunkwise.functions.elision import elision_line, kept_counts

RANGE = "struct<start_line:int,end_line:int>"
MOVE = "struct<removed_start:int,removed_end:int,added_start:int,added_end:int>"
STATS = "struct<raw_files:long,visible_files:long,raw_changed:long,visible_changed:long,removed_changed:long,folded_changed:long,fold_count:long>"
PLAN = f"remove array<{RANGE}>, replace array<struct<line:int,old:string,new:string>>, fold array<{RANGE}>, summary string"


def each(df: DataFrame, columns: list[str], rule: Callable[..., Iterator[tuple]], schema: str, batch: int = 2000) -> DataFrame:
    """Rows that ``rule`` makes of each row's columns."""
    kinds: StructType = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kinds)
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in batches:
            for i in range(b.num_rows):
                for row in rule(*(c[i].as_py() for c in b.columns)):
                    rows.append(row)
                    if len(rows) >= batch:
                        yield made()
                        rows.clear()
        yield made()

    return df.select(*columns).mapInArrow(run, kinds)


def layout(diffs: DataFrame, with_imports: bool = False) -> DataFrame:
    """Every row with its kind, file, hunk, language and, for markers, the row it belongs to.

    ``with_imports`` adds ``import``: whether it is hidden as one.
    """
    names = ["line_no", "text", "eol", "kind", "file_id", "hunk_id", "language", "marker_owner"] + ["import"] * with_imports
    schema = to_arrow_schema(_parse_datatype_string("diff_id long, line_no int, text string, eol string, kind string, file_id int, hunk_id int, language string, marker_owner int" + ", import boolean" * with_imports))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for diff_id, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                d = Diff(raw.as_py() or "")
                n = len(d)
                owner = [None if o is None else o + 1 for o in d.owner]
                columns = [[diff_id] * n, range(1, n + 1), d.text, d.eol, d.kind, d.file, d.hunk, d.language, owner, *([imports.import_mask(d)] if with_imports else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kinds = "diff_id long, line_no int, text string, eol string, kind string, file_id int, hunk_id int, language string, marker_owner int" + ", import boolean" * with_imports
    return diffs.select("diff_id", "raw").mapInArrow(run, kinds).select("diff_id", *names)


def problems(diffs: DataFrame) -> DataFrame:
    """``diff_id, errors``: why diffs can't be read; empty where they can."""
    return each(diffs, ["diff_id", "raw"], lambda i, raw: iter([(i, check(Diff(raw or "")))]), "diff_id long, errors array<string>")


def import_ranges(diffs: DataFrame) -> DataFrame:
    """``diff_id, start_line, end_line``: runs of rows hidden as imports."""

    def rule(diff_id, raw):
        for a, b in mask_ranges(imports.import_mask(Diff(raw or ""))):
            yield diff_id, a, b

    return each(diffs, ["diff_id", "raw"], rule, "diff_id long, start_line int, end_line int")


def exact_moves(diffs: DataFrame) -> DataFrame:
    """``diff_id`` and both sides' rows of each exact move."""

    def rule(diff_id, raw):
        d = Diff(raw or "")
        for m in [] if check(d) else moves.find_moves(d):
            yield diff_id, m.removed_start, m.removed_end, m.added_start, m.added_end

    return each(diffs, ["diff_id", "raw"], rule, "diff_id long, removed_start int, removed_end int, added_start int, added_end int")


def mandatory_rows(diffs: DataFrame) -> DataFrame:
    """``diff_id, start_line, end_line``: imports and the counterparts of moved imports."""

    def rule(diff_id, raw):
        d = Diff(raw or "")
        if not check(d):
            for a, b in mask_ranges(moves.extend_mask(moves.find_moves(d), imports.import_mask(d))):
                yield diff_id, a, b

    return each(diffs, ["diff_id", "raw"], rule, "diff_id long, start_line int, end_line int")


def literal_rows(diffs: DataFrame) -> DataFrame:
    """``diff_id, start_line, end_line``: rows that begin inside a literal, bracket or continued line."""

    def rule(diff_id, raw):
        for a, b in mask_ranges(ch.literal_rows(Diff(raw or ""))):
            yield diff_id, a, b

    return each(diffs, ["diff_id", "raw"], rule, "diff_id long, start_line int, end_line int")


def delimiter_nets(diffs: DataFrame) -> DataFrame:
    """Net delimiters of each side of each Python, Go and TypeScript hunk."""

    def rule(diff_id, raw):
        d = Diff(raw or "")
        for h in d.hunks:
            for side in "-+":
                rows = [(i, d.text[i][1:]) for i in d.side_rows(h, side)]
                if h.language == "python":
                    triple, net = "", lexers.ZERO
                    for _, body in rows:
                        triple, _, more = lexers.py_scan(body, triple)
                        net = lexers.add(net, more)
                    found = dict(zip("([{", net, strict=True))
                elif h.language in ("go", "typescript"):
                    go = h.language == "go"
                    found = dict(lexers.Net.of((lexers.go_tokens if go else lexers.ts_tokens)(rows), lexers.GO_PAIRS if go else lexers.TS_PAIRS).counts)
                else:
                    continue
                yield diff_id, h.number, side, h.language, found.get("(", 0), found.get("[", 0), found.get("{", 0), found.get("<", 0)

    return each(diffs, ["diff_id", "raw"], rule, "diff_id long, hunk_id int, side string, language string, round int, square int, curly int, angle int")


def compiled(diffs: DataFrame, edit_plans: DataFrame, detect_moves: bool = True) -> DataFrame:
    """Plans applied: ``diff_id, plan_id, smart_diff, stats, moves, errors``; errors and a reading diff exclude each other.

    ``edit_plans`` has ``diff_id, plan_id, remove, replace, fold`` and optionally a
    ``summary``, which is then checked, too, and ``moves`` to enforce instead of the
    diff's own. A null list is an error.
    """
    optional = [c for c in ("summary", "moves") if c in edit_plans.columns]

    def rule(diff_id, plan_id, raw, remove, replace, fold, *rest):
        more = dict(zip(optional, rest, strict=True))
        given = more.get("moves")
        enforced = [moves.Move(**m) for m in given] if given is not None else None if detect_moves else []
        plan = {"remove": remove, "replace": replace, "fold": fold}
        try:
            if None in (remove, replace, fold):
                raise plans.PlanError(["remove, replace, and fold must all be there (may be empty)"])
            if "summary" in more:
                c = plans.compile_submission(raw or "", plan | {"summary": more["summary"]}, enforced)
            else:
                c = plans.compile_plan(raw or "", plan, enforced)
        except plans.PlanError as e:
            yield diff_id, plan_id, None, None, None, e.problems
        else:
            yield diff_id, plan_id, c.text, asdict(c.stats), [asdict(m) for m in c.moves], []

    joined = edit_plans.join(diffs.select("diff_id", "raw"), "diff_id")
    return each(joined, ["diff_id", "plan_id", "raw", "remove", "replace", "fold", *optional], rule, f"diff_id long, plan_id long, smart_diff string, stats {STATS}, moves array<{MOVE}>, errors array<string>", batch=64)


def decoded_plans(texts: DataFrame, with_summary: bool = False) -> DataFrame:
    """Plans of strict JSON: ``diff_id, plan_id, remove, replace, fold, summary, error`` of ``diff_id, plan_id, json``."""

    def rule(diff_id, plan_id, text):
        try:
            p = plans.decode_plan(text or "", with_summary)
        except plans.PlanError as e:
            yield diff_id, plan_id, None, None, None, None, e.problems[0]
        else:
            yield diff_id, plan_id, p["remove"], p["replace"], p["fold"], p.get("summary"), None

    return each(texts, ["diff_id", "plan_id", "json"], rule, f"diff_id long, plan_id long, {PLAN}, error string")


def elisions(diffs: DataFrame, readings: DataFrame) -> DataFrame:
    """``diff_id, kept_changed, kept_files, elision`` of reading diffs ``diff_id, smart_diff``."""

    def rule(diff_id, raw, smart):
        raw, smart = raw or "", smart or ""
        yield diff_id, *kept_counts(Diff(raw), Diff(smart)), elision_line(raw, smart)

    joined = diffs.select("diff_id", "raw").join(readings.select("diff_id", "smart_diff"), "diff_id")
    return each(joined, ["diff_id", "raw", "smart_diff"], rule, "diff_id long, kept_changed long, kept_files long, elision string")


def chunks(diffs: DataFrame, budget: int = ch.RUN_BYTES) -> DataFrame:
    """Chunks of each diff within ``budget`` bytes, with the moves that lie within them; or the error."""

    def rule(diff_id, raw):
        d = Diff(raw or "")
        try:
            found = ch.split_diff(d, budget)
        except plans.PlanError as e:
            yield diff_id, None, None, None, None, None, None, None, None, e.problems[0]
            return
        known = moves.find_moves(d)
        for n, c in enumerate(found):
            inside = [asdict(m) for m in ch.chunk_moves(known, c.origins)]
            yield diff_id, n, c.text, c.meta, c.section, c.continued, c.verbatim, c.origins, inside, None

    return each(diffs, ["diff_id", "raw"], rule, f"diff_id long, chunk_no int, text string, meta_prefix string, section_id int, continuation boolean, passthrough boolean, origins array<int>, moves array<{MOVE}>, error string", batch=16)


def merged(chunk_rows: DataFrame, results: DataFrame) -> DataFrame:
    """Results of chunks merged per diff: ``diff_id, smart_diff, summary, input_tokens, output_tokens``.

    ``results`` has ``diff_id, chunk_no, smart_diff, summary, input_tokens,
    output_tokens`` of the chunks that aren't passed through. A diff has 32 chunks at most.
    """
    rows = chunk_rows.where("chunk_no is not null").join(results, ["diff_id", "chunk_no"], "left")
    cols = ["chunk_no", "text", "meta_prefix", "section_id", "continuation", "passthrough", "smart_diff", "summary", "input_tokens", "output_tokens"]
    packed = rows.groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("parts"))

    def rule(diff_id, parts):
        pairs = []
        for p in parts:
            chunk = ch.Chunk(p["text"], p["meta_prefix"], p["section_id"], p["continuation"], p["passthrough"])
            result = None if p["passthrough"] else ch.Result(p["smart_diff"] or "", p["summary"] or "", p["input_tokens"] or 0, p["output_tokens"] or 0)
            pairs.append((chunk, result))
        m = ch.merge(pairs)
        yield diff_id, m.smart_diff, m.summary, m.input_tokens, m.output_tokens

    return each(packed, ["diff_id", "parts"], rule, "diff_id long, smart_diff string, summary string, input_tokens long, output_tokens long", batch=64)
