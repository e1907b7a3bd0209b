"""Queries over the test tables, one per operator or group of them, with DuckDB SQL where SQL can express it.

Diffs are derived from ``documents`` (see ``hunkwise.fixtures``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hunkwise import fixtures
from hunkwise import scenarios as S
from hunkwise.functions import columns as C
from hunkwise.operators import diffs as D
from hunkwise.operators import native as N
from hunkwise.plans import agent
from hunkwise.plans import layout as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_imports = " ".join(f"WHEN {i} THEN [" + ", ".join("'" + r.replace("'", "''") + "'" for r in rows) + "]::VARCHAR[]" for i, rows in enumerate(fixtures.FILES.values()))
_suffix = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(fixtures.FILES))
_languages = {"go": "go", "py": "python", "ts": "typescript", "js": "javascript", "rs": "rust", "c": "c", "java": "java"}
_language = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in _languages.items()) + " END"

#: The derived diffs in SQL: ``r`` has every row with what it is.
BASE = f"""
WITH f AS (
    SELECT doc_id // {fixtures.DOCS_PER_DIFF} AS diff_id, doc_id, CASE (doc_id // 2) % 8 {_suffix} END AS ext,
        CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '+' END AS m,
        CASE (doc_id // 2) % 8 {_imports} END AS imports, string_split(coalesce(text, ''), chr(10)) AS body
    FROM documents
), b AS (
    SELECT diff_id, doc_id, ext, m, list_concat(imports, body) AS lines, len(imports) AS k, len(imports) + len(body) AS n,
        'd' || doc_id || '.' || ext AS path FROM f
), u AS (
    SELECT diff_id, doc_id, ext, m, k, n, 4 + i AS pos, m || lines[i] AS text, 'change' AS kind, i <= k AS import
    FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM b)
    UNION ALL SELECT diff_id, doc_id, ext, m, k, n, 1, 'diff --git a/' || path || ' b/' || path, 'header', false FROM b
    UNION ALL SELECT diff_id, doc_id, ext, m, k, n, 2, '--- a/' || path, 'old_file', false FROM b
    UNION ALL SELECT diff_id, doc_id, ext, m, k, n, 3, '+++ b/' || path, 'new_file', false FROM b
    UNION ALL SELECT diff_id, doc_id, ext, m, k, n, 4,
        CASE WHEN m = '-' THEN '@@ -1,' || n || ' +0,0 @@' ELSE '@@ -0,0 +1,' || n || ' @@' END, 'hunk_header', false FROM b
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY diff_id ORDER BY doc_id, pos) AS INT) AS line_no,
        CAST(dense_rank() OVER (PARTITION BY diff_id ORDER BY doc_id) - 1 AS INT) AS file_id, {_language} AS language
    FROM u
)
"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = BASE + sql if not sql.startswith("WITH") and ("FROM r" in sql or "FROM b" in sql) else sql
        return f

    return register


def _layout(spark, sf_dir) -> DataFrame:
    return L.layout(fixtures.diffs(spark, sf_dir))


@query("diff_lines", "SELECT diff_id, line_no, sha256(text) AS text_sha256, octet_length(encode(text)) AS n_bytes, 1 AS eol_bytes FROM r")
def diff_lines(spark, sf_dir):
    rows = L.lines(fixtures.diffs(spark, sf_dir))
    return rows.select("diff_id", "line_no", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"), F.octet_length("eol").alias("eol_bytes"))


LAYOUT_SQL = "SELECT diff_id, line_no, kind, file_id, CASE WHEN pos >= 4 THEN file_id END AS hunk_id, language FROM r"


@query("diff_layout", LAYOUT_SQL)
def diff_layout(spark, sf_dir):
    return D.layout(fixtures.diffs(spark, sf_dir)).select("diff_id", "line_no", "kind", "file_id", "hunk_id", "language")


@query("diff_layout_native", LAYOUT_SQL)
def diff_layout_native(spark, sf_dir):
    return _layout(spark, sf_dir).select("diff_id", "line_no", "kind", "file_id", "hunk_id", "language")


_by = ", ".join(f"count(*) FILTER (WHERE kind = 'change' AND language = '{x}') AS changed_{x}" for x in _languages.values())


@query("diff_stats", f"SELECT diff_id, count(*) FILTER (WHERE kind = 'change') AS changed, count(*) FILTER (WHERE kind = 'header') AS files, count(*) FILTER (WHERE kind = 'hunk_header') AS hunks, {_by}, count(*) FILTER (WHERE kind = 'change' AND language IS NULL) AS changed_other FROM r GROUP BY diff_id")
def diff_stats(spark, sf_dir):
    return N.diff_stats(_layout(spark, sf_dir))


@query("numbered_view", "SELECT diff_id, sha256(string_agg(lpad(CAST(line_no AS VARCHAR), w, ' ') || '|' || text || chr(10), '' ORDER BY line_no)) AS numbered_sha256 FROM (SELECT *, CAST(length(CAST(max(line_no) OVER (PARTITION BY diff_id) AS VARCHAR)) AS INT) AS w FROM r) GROUP BY diff_id")
def numbered_view(spark, sf_dir):
    return N.numbered(L.lines(fixtures.diffs(spark, sf_dir))).select("diff_id", F.sha2(F.col("numbered").cast("binary"), 256).alias("numbered_sha256"))


@query("run_sizes", "SELECT diff_id, n_rows, raw_bytes, numbered_bytes, raw_bytes <= 409600 AND numbered_bytes <= 409600 AS fits FROM (SELECT diff_id, count(*) AS n_rows, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS raw_bytes, CAST(sum(octet_length(encode(text))) + count(*) * (length(CAST(count(*) AS VARCHAR)) + 2) AS BIGINT) AS numbered_bytes FROM r GROUP BY diff_id)")
def run_sizes(spark, sf_dir):
    return N.sizes(L.lines(fixtures.diffs(spark, sf_dir))).withColumns({c: F.col(c).cast("long") for c in ("n_rows", "raw_bytes", "numbered_bytes")})


@query("hunk_headers", "SELECT diff_id, file_id AS hunk_id, line_no AS header_line, CASE m WHEN '-' THEN 1 ELSE 0 END AS old_start, CAST(CASE m WHEN '-' THEN n ELSE 0 END AS INT) AS old_count, CASE m WHEN '+' THEN 1 ELSE 0 END AS new_start, CAST(CASE m WHEN '+' THEN n ELSE 0 END AS INT) AS new_count, '' AS heading, CAST(CASE m WHEN '-' THEN n ELSE 0 END AS BIGINT) AS removed, CAST(CASE m WHEN '+' THEN n ELSE 0 END AS BIGINT) AS added, CAST(0 AS BIGINT) AS context, CAST(line_no + n AS INT) AS last_line FROM r WHERE kind = 'hunk_header'")
def hunk_headers(spark, sf_dir):
    return N.hunks(_layout(spark, sf_dir))


@query("file_sections", "SELECT diff_id, file_id, min(line_no) AS start_line, max(line_no) AS end_line, max(language) AS language FROM r GROUP BY diff_id, file_id")
def file_sections(spark, sf_dir):
    return N.file_sections(_layout(spark, sf_dir))


@query("import_rows", "SELECT diff_id, line_no FROM r WHERE import")
def import_rows(spark, sf_dir):
    return N.range_rows(D.import_ranges(fixtures.diffs(spark, sf_dir)))


@query("import_ranges", "SELECT diff_id, CAST(min(line_no) AS INT) AS start_line, CAST(max(line_no) AS INT) AS end_line FROM r WHERE import GROUP BY diff_id, doc_id")
def import_ranges(spark, sf_dir):
    return N.mask_ranges(N.range_rows(D.import_ranges(fixtures.diffs(spark, sf_dir))))


# Bodies are normalised once; a tab would widen an indent, but the tables hold none.
_ANCHORS = """
, q AS (SELECT diff_id, line_no, file_id, m, substr(text, 2) AS body, trim(substr(text, 2), chr(32) || chr(9)) AS norm FROM r WHERE kind = 'change'),
p AS (
    SELECT diff_id, norm, max(line_no) FILTER (WHERE m = '-') AS removed_line, max(line_no) FILTER (WHERE m = '+') AS added_line,
        CAST(max(length(body) - length(ltrim(body, chr(32)))) FILTER (WHERE m = '+') - max(length(body) - length(ltrim(body, chr(32)))) FILTER (WHERE m = '-') AS INT) AS indent_offset,
        CAST(octet_length(encode(norm)) AS INT) AS bytes
    FROM q WHERE regexp_matches(norm, '[\\pL\\pN]') GROUP BY diff_id, norm
    HAVING count(*) = 2 AND count(*) FILTER (WHERE m = '-') = 1 AND count(*) FILTER (WHERE m = '+') = 1
)
"""


@query("move_anchors", _ANCHORS + "SELECT diff_id, removed_line, added_line, indent_offset, bytes FROM p -- FROM r")
def move_anchors(spark, sf_dir):
    return N.move_anchors(_layout(spark, sf_dir))


@query("aligned_anchors", _ANCHORS + """, i AS (SELECT *, removed_line - added_line AS d, removed_line - row_number() OVER (PARTITION BY diff_id, removed_line - added_line, indent_offset ORDER BY removed_line) AS g FROM p)
SELECT diff_id, min(removed_line) AS removed_start, max(removed_line) AS removed_end, min(added_line) AS added_start, max(added_line) AS added_end, count(*) AS anchor_rows FROM i GROUP BY diff_id, d, indent_offset, g HAVING count(*) >= 3 AND sum(bytes) >= 48 -- FROM r""")
def aligned_anchors(spark, sf_dir):
    return N.aligned_anchors(N.move_anchors(_layout(spark, sf_dir)))


@query("exact_moves")
def exact_moves(spark, sf_dir):
    return D.exact_moves(fixtures.diffs(spark, sf_dir))


@query("mandatory_rows")
def mandatory_rows(spark, sf_dir):
    return D.mandatory_rows(fixtures.diffs(spark, sf_dir))


@query("delimiter_nets")
def delimiter_nets(spark, sf_dir):
    return D.delimiter_nets(fixtures.diffs(spark, sf_dir))


def fixture_plans(layout: DataFrame) -> DataFrame:
    """A plan per diff: in files without structure rules every seventh row goes, rows 9 to 12 fold.

    ``layout`` has its imports; it is read once, and rows meet by hunk and then by diff.
    """
    free = ~F.col("import") & (F.col("language").isin("rust", "c", "java", "javascript") | F.col("language").isNull())
    rows = layout.where("kind = 'change'").select("diff_id", "hunk_id", "line_no", free.alias("free"), F.expr("substr(text, 2)").rlike(r"\S").alias("says"))
    in_hunk = Window.partitionBy("diff_id", "hunk_id")
    rows = rows.withColumns({"at": F.count_if("free").over(in_hunk.orderBy("line_no")), "n": F.count_if("free").over(in_hunk)})
    one = F.struct(F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"))
    inside = F.expr("free and at between 9 and 12 and n >= 13")
    line = F.when(inside, F.col("line_no"))
    of_hunk = rows.groupBy("diff_id", "hunk_id").agg(
        F.collect_list(F.when(F.expr("free and at % 7 = 0 and n >= 7"), one)).alias("remove"), F.min(line).alias("start_line"), F.max(line).alias("end_line"), F.max(inside & F.col("says")).alias("some")
    )
    fold = F.when(F.col("some"), F.struct("start_line", "end_line"))
    out = of_hunk.groupBy("diff_id").agg(F.array_sort(F.flatten(F.collect_list("remove"))).alias("remove"), F.array_sort(F.collect_list(fold)).alias("fold"))
    empty = F.array().cast("array<struct<line:int,old:string,new:string>>")
    return out.select("diff_id", F.lit(1).cast("long").alias("plan_id"), "remove", empty.alias("replace"), "fold")


def compiled_fixture(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    diffs = fixtures.diffs(spark, sf_dir)
    return diffs, D.compiled(diffs, fixture_plans(D.layout(diffs, with_imports=True)), detect_moves=False)


_PLANNED = """
, a AS (
    SELECT *, row_number() OVER (PARTITION BY diff_id, doc_id ORDER BY line_no) AS nth, count(*) OVER (PARTITION BY diff_id, doc_id) AS cnt
    FROM r WHERE kind = 'change' AND NOT import AND ext IN ('rs', 'c', 'java', 'js', 'txt')
), fo AS (
    SELECT diff_id, doc_id, min(line_no) AS s, max(line_no) AS e,
        min(CASE WHEN trim(substr(text, 2)) <> '' THEN length(substr(text, 2)) - length(ltrim(substr(text, 2), chr(32))) END) AS pad
    FROM a WHERE nth BETWEEN 9 AND 12 AND cnt >= 13 GROUP BY 1, 2 HAVING max(CASE WHEN trim(substr(text, 2)) <> '' THEN 1 ELSE 0 END) = 1
), st AS (
    SELECT r.*, fo.s, fo.pad, CASE WHEN r.import OR a.nth % 7 = 0 AND a.cnt >= 7 THEN 'removed' WHEN fo.s IS NOT NULL THEN 'folded' ELSE 'kept' END AS what
    FROM r LEFT JOIN a ON r.diff_id = a.diff_id AND r.line_no = a.line_no
    LEFT JOIN fo ON r.diff_id = fo.diff_id AND r.line_no BETWEEN fo.s AND fo.e
)
"""


@query("compiled_stats", _PLANNED + """SELECT diff_id, count(*) FILTER (WHERE kind = 'header') AS raw_files, count(*) FILTER (WHERE kind = 'header') AS visible_files,
    count(*) FILTER (WHERE kind = 'change') AS raw_changed, count(*) FILTER (WHERE kind = 'change' AND (what = 'kept' OR what = 'folded' AND line_no = s)) AS visible_changed,
    count(*) FILTER (WHERE kind = 'change' AND what = 'removed') AS removed_changed, count(*) FILTER (WHERE what = 'folded') AS folded_changed,
    count(*) FILTER (WHERE what = 'folded' AND line_no = s) AS fold_count FROM st GROUP BY diff_id -- FROM r""")
def compiled_stats(spark, sf_dir):
    return compiled_fixture(spark, sf_dir)[1].where("size(errors) = 0").select("diff_id", "stats.*")


@query("reading_diffs", _PLANNED + """SELECT diff_id, sha256(string_agg(CASE WHEN what = 'folded' THEN m || repeat(' ', pad) || '...' ELSE text END || chr(10), '' ORDER BY line_no)) AS smart_sha256, 0 AS n_errors
    FROM st WHERE what = 'kept' OR what = 'folded' AND line_no = s GROUP BY diff_id -- FROM r""")
def reading_diffs(spark, sf_dir):
    out = compiled_fixture(spark, sf_dir)[1]
    return out.select("diff_id", F.sha2(F.col("smart_diff").cast("binary"), 256).alias("smart_sha256"), F.size("errors").alias("n_errors"))


@query("elision_lines", _PLANNED + """SELECT diff_id, count(*) FILTER (WHERE kind = 'change') AS kept_changed, count(*) FILTER (WHERE kind = 'header') AS kept_files,
    'kept ' || count(*) FILTER (WHERE kind = 'change') || '/' || any_value(total) || ' changed lines in ' || count(*) FILTER (WHERE kind = 'header') || '/' || any_value(files) || ' files' AS elision
    FROM (SELECT *, count(*) FILTER (WHERE kind = 'change') OVER (PARTITION BY diff_id) AS total, count(*) FILTER (WHERE kind = 'header') OVER (PARTITION BY diff_id) AS files FROM st)
    WHERE what = 'kept' OR what = 'folded' AND line_no = s GROUP BY diff_id -- FROM r""")
def elision_lines(spark, sf_dir):
    return D.elisions(*compiled_fixture(spark, sf_dir))


@query("retention_pressure", _PLANNED + """, v AS (SELECT diff_id, count(*) FILTER (WHERE kind = 'change') AS raw, count(*) FILTER (WHERE kind = 'change' AND (what = 'kept' OR what = 'folded' AND line_no = s)) AS visible FROM st GROUP BY diff_id)
    SELECT diff_id, visible * 100 // raw AS percent, raw >= 40 AND visible >= 20 AND (visible >= 80 OR visible * 100 >= raw * 45) AS pressure FROM v -- FROM r""")
def retention_pressure(spark, sf_dir):
    s = compiled_fixture(spark, sf_dir)[1].where("size(errors) = 0").select("diff_id", "stats.raw_changed", "stats.visible_changed")
    return s.select("diff_id", F.expr("visible_changed * 100 div raw_changed").alias("percent"), C.pressure(F.col("raw_changed"), F.col("visible_changed")).alias("pressure"))


@query("chunked", None)
def chunked(spark, sf_dir):
    c = D.chunks(fixtures.diffs(spark, sf_dir))
    return c.select("diff_id", "chunk_no", "section_id", "continuation", "passthrough", F.octet_length("text").alias("n_bytes"), F.size("origins").alias("n_rows"), F.size("moves").alias("n_moves"), "error")


@query("merged_chunks", "SELECT diff_id, sha256(string_agg(text || chr(10), '' ORDER BY line_no)) AS rows_sha256, 'read' AS summary, count(DISTINCT CASE WHEN kind = 'header' THEN file_id END) AS files FROM r WHERE kind <> 'hunk_header' GROUP BY diff_id")
def merged_chunks(spark, sf_dir):
    """Chunks that are kept whole merge to the diff again, hunk headers of cut hunks aside."""
    c = D.chunks(fixtures.diffs(spark, sf_dir))
    results = c.where("not passthrough").select("diff_id", "chunk_no", F.col("text").alias("smart_diff"), F.lit("read").alias("summary"), F.lit(1).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))
    m = D.merged(c, results)
    rows = F.expr("filter(split(smart_diff, '\n'), x -> not startswith(x, '@@ -'))")
    return m.select("diff_id", F.sha2(F.array_join(rows, "\n").cast("binary"), 256).alias("rows_sha256"), "summary", F.expr("cast(size(filter(split(smart_diff, '\n'), x -> startswith(x, 'diff --git '))) as long)").alias("files"))


@query("path_languages", f"SELECT doc_id, 'd' || doc_id || '.' || ext AS path, {_language} AS language FROM b")
def path_languages(spark, sf_dir):
    s = fixtures.sections(fixtures.documents(spark, sf_dir))
    return s.select("doc_id", "path", L.path_language(F.col("path")).alias("language"))


@query("row_slices", "SELECT diff_id, line_no, line_no || chr(9) || text AS row FROM r WHERE line_no BETWEEN 3 AND 40")
def row_slices(spark, sf_dir):
    rows = N.row_slice(L.lines(fixtures.diffs(spark, sf_dir)), 3, 40)
    return rows.select("diff_id", "line_no", F.concat_ws("\t", F.col("line_no").cast("string"), "text").alias("row"))


@query("grep_rows", "SELECT diff_id, line_no, CAST(place AS INT) AS place FROM (SELECT diff_id, line_no, row_number() OVER (PARTITION BY diff_id ORDER BY line_no) AS place FROM r WHERE regexp_matches(text, 'tion[a-z]* (the|la|der) ')) WHERE place <= 200 -- a tool's output is its first 200 rows")
def grep_rows(spark, sf_dir):
    return N.grep(L.lines(fixtures.diffs(spark, sf_dir)), "tion[a-z]* (the|la|der) ").select("diff_id", "line_no", "place")


@query("elision_predicate", "SELECT doc_id, length(t) > 16 AS elides, strpos(t, left(t, 8)) > 0 AND strpos(substr(t, 2), left(t, 8)) = 0 AND t <> '' AS once FROM (SELECT doc_id, replace(replace(string_split(coalesce(text, ''), chr(10))[1], '.', ','), '…', ',') AS t FROM documents)")
def elision_predicate(spark, sf_dir):
    t = F.translate(F.split(F.coalesce("text", F.lit("")), "\n")[0], ".…", ",,")
    d = fixtures.documents(spark, sf_dir).select("doc_id", t.alias("t"))
    new = F.concat(F.expr("left(t, 8)"), F.lit("..."), F.expr("right(t, 8)"))
    return d.select("doc_id", C.is_elision(F.col("t"), new).alias("elides"), (C.occurs_once(F.col("t"), F.expr("left(t, 8)")) & (F.col("t") != "")).alias("once"))


@query("cache_keys", "SELECT doc_id, sha256('protocol-1' || chr(0) || 'provider:model' || chr(0) || coalesce(text, '')) AS cache_key FROM documents")
def cache_keys(spark, sf_dir):
    return fixtures.documents(spark, sf_dir).select("doc_id", C.cache_key(F.lit("protocol-1"), F.lit("provider:model"), F.coalesce("text", F.lit(""))).alias("cache_key"))


@query("cache_misses", "SELECT d.doc_id FROM documents d LEFT JOIN (SELECT DISTINCT coalesce(text, '') AS t FROM documents WHERE doc_id % 3 = 0) c ON coalesce(d.text, '') = c.t WHERE c.t IS NULL")
def cache_misses(spark, sf_dir):
    keys = cache_keys(spark, sf_dir)
    cache = keys.where("doc_id % 3 = 0").select("cache_key").distinct()
    return N.with_cache(keys, cache)[1].select("doc_id")


@query("transcripts", "SELECT conv_id, count(*) AS turns, sha256(string_agg('[' || role || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text)) AS prompt_sha256 FROM conversations GROUP BY conv_id")
def transcripts(spark, sf_dir):
    t = N.transcript(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return t.select("conv_id", "turns", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"))


@query("plan_json", "SELECT doc_id AS plan_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 0 END AS removes, doc_id % 4 IN (1, 2) AS refused FROM documents")
def plan_json(spark, sf_dir):
    """Plans of strict JSON: unknown fields and missing lists are refused."""
    text = ['{"remove":[{"start_line":1,"end_line":2}],"replace":[],"fold":[]}', '{"remove":[],"replace":[],"fold":[],"note":1}', '{"remove":[],"replace":[]}', '{"remove":[],"replace":[],"fold":[]}']
    turn = F.col("doc_id") % 4
    d = fixtures.documents(spark, sf_dir).select(F.expr(f"doc_id div {fixtures.DOCS_PER_DIFF}").alias("diff_id"), F.col("doc_id").alias("plan_id"), F.when(turn == 0, text[0]).when(turn == 1, text[1]).when(turn == 2, text[2]).otherwise(text[3]).alias("json"))
    out = D.decoded_plans(d)
    return out.select("plan_id", F.size("remove").alias("removes"), F.col("error").isNotNull().alias("refused"))




def _keep_everything(messages) -> agent.Answer:
    """A planner that submits an empty plan: imports go, everything else stays."""
    return agent.Answer([agent.ToolCall("submit", '{"remove":[],"replace":[],"fold":[],"summary":"kept"}', "1")], input_tokens=3, output_tokens=1)


@query("abridged", "SELECT diff_id, sha256(string_agg(text || chr(10), '' ORDER BY line_no)) AS rows_sha256, 'kept' AS summary FROM r WHERE kind <> 'hunk_header' AND NOT import GROUP BY diff_id")
def abridged(spark, sf_dir):
    """The planner loop over all diffs, chunk by chunk, merged; hunk headers aside."""
    out = agent.abridge_all(fixtures.diffs(spark, sf_dir), _keep_everything)
    rows = F.expr("filter(split(smart_diff, '\n'), x -> not startswith(x, '@@ -'))")
    return out.select("diff_id", F.sha2(F.array_join(rows, "\n").cast("binary"), 256).alias("rows_sha256"), F.coalesce("summary", "error").alias("summary"))


@query("diff_problems", "SELECT diff_id, 0 AS n_errors FROM r GROUP BY diff_id")
def diff_problems(spark, sf_dir):
    return D.problems(fixtures.diffs(spark, sf_dir)).select("diff_id", F.size("errors").alias("n_errors"))


@query("plan_symmetry", None)
def plan_symmetry(spark, sf_dir):
    """The fixture's plans with the diffs' own moves enforced: how many reasons speak against each."""
    diffs = fixtures.diffs(spark, sf_dir)
    out = D.compiled(diffs, fixture_plans(D.layout(diffs, with_imports=True)))
    return out.select("diff_id", F.size("errors").alias("n_errors"), F.size("moves").alias("n_moves"), F.octet_length("smart_diff").alias("n_bytes"))


# --- written cases, see ``hunkwise.scenarios`` ---


def _reasons(errors: DataFrame) -> DataFrame:
    """``doc_id, rule, place`` of each problem; rows without one are accepted."""
    one = errors.select(F.col("diff_id").alias("doc_id"), F.explode_outer("errors").alias("e"))
    part = lambda k: F.regexp_extract("e", r"^([a-z-]+) \(([^)]*)\)", k)
    return one.select("doc_id", F.when(F.col("e").isNull(), "accepted").otherwise(part(1)).alias("rule"), F.when(F.col("e").isNull(), "").otherwise(part(2)).alias("place"))


_verdicts = S.said("refused") + [(n, "accepted", "") for n, c in enumerate(S.CASES) if c.plan is not None and not c.refused]


@query("plan_verdicts", S.spread("rule, place", _verdicts, "doc_id, rule, place"))
def plan_verdicts(spark, sf_dir):
    """Plans on Python, Go, TypeScript and plain files, moves enforced: every reason against each."""
    return _reasons(S.planned(spark, sf_dir)[1])


_readings = [(n, c.reading, c.elision) for n, c in enumerate(S.CASES) if c.plan is not None and not c.refused]


@query("plan_readings", S.spread("reading, elision", _readings, "doc_id, sha256(replace(reading, '§', name)) AS smart_sha256"))
def plan_readings(spark, sf_dir):
    out = S.planned(spark, sf_dir)[1].where("size(errors) = 0")
    return out.select(F.col("diff_id").alias("doc_id"), F.sha2(F.col("smart_diff").cast("binary"), 256).alias("smart_sha256"))


@query("plan_elisions", S.spread("reading, elision", _readings, "doc_id, elision"))
def plan_elisions(spark, sf_dir):
    diffs, out = S.planned(spark, sf_dir)
    return D.elisions(diffs, out.where("size(errors) = 0")).select(F.col("diff_id").alias("doc_id"), "elision")


_rows = [(n, i + 1, *x) for n, c in enumerate(S.CASES) for i, x in enumerate(c.layout)]


@query("odd_layouts", S.spread("line_no, kind, file_id, hunk_id, language, marker_owner", _rows, "doc_id, line_no, kind, CAST(file_id AS INT) AS file_id, CAST(hunk_id AS INT) AS hunk_id, language, CAST(marker_owner AS INT) AS marker_owner"))
def odd_layouts(spark, sf_dir):
    """Renames, modes, mail trailers, rows without a newline, pairs without headers, bare hunk headers."""
    out = D.layout(S.dealt(spark, sf_dir, layout=False))
    return out.select(F.col("diff_id").alias("doc_id"), "line_no", "kind", "file_id", "hunk_id", "language", "marker_owner")


@query("unreadable_diffs", S.spread("rule, place", S.said("unreadable"), "doc_id, rule, place"))
def unreadable_diffs(spark, sf_dir):
    return _reasons(D.problems(S.dealt(spark, sf_dir, unreadable=False)))


def _ranges(found: DataFrame) -> DataFrame:
    return found.select(F.col("diff_id").alias("doc_id"), "start_line", "end_line")


def _range_sql(field: str) -> str:
    return S.spread("start_line, end_line", S.said(field), "doc_id, start_line, end_line")


@query("written_imports", _range_sql("imports"))
def written_imports(spark, sf_dir):
    """Statements over several rows, guards, literals, headings that continue one, whole files."""
    return _ranges(D.import_ranges(S.dealt(spark, sf_dir, imports=True)))


@query("written_mandatory", _range_sql("mandatory"))
def written_mandatory(spark, sf_dir):
    return _ranges(D.mandatory_rows(S.dealt(spark, sf_dir, mandatory=True)))


@query("written_moves", S.spread("removed_start, removed_end, added_start, added_end", S.said("moves"), "doc_id, removed_start, removed_end, added_start, added_end"))
def written_moves(spark, sf_dir):
    """Exact moves, extended to blank rows and other indents; a third copy makes them ambiguous."""
    return D.exact_moves(S.dealt(spark, sf_dir, moves=True)).withColumnRenamed("diff_id", "doc_id")


@query("written_literals", _range_sql("literals"))
def written_literals(spark, sf_dir):
    return _ranges(D.literal_rows(S.dealt(spark, sf_dir, literals=True)))


@query("written_delimiters", S.spread("hunk_id, side, language, round, square, curly, angle", S.said("nets"), "doc_id, hunk_id, side, language, round, square, curly, angle"))
def written_delimiters(spark, sf_dir):
    return D.delimiter_nets(S.dealt(spark, sf_dir, nets=True)).withColumnRenamed("diff_id", "doc_id")


_pieces = [(n, i, *x) for n, c in enumerate(S.CASES) for i, x in enumerate(c.chunks or ())]


@query("written_chunks", S.spread("chunk_no, text, section_id, continuation", _pieces, "doc_id, chunk_no, sha256(replace(text, '§', name)) AS text_sha256, CAST(section_id AS INT) AS section_id, continuation"))
def written_chunks(spark, sf_dir):
    """Whole files, hunks with their file's metadata, and cut hunks with headers of their own."""
    out = D.chunks(S.dealt(spark, sf_dir, chunks=False), S.BUDGET)
    return out.select(F.col("diff_id").alias("doc_id"), "chunk_no", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "section_id", "continuation")
