"""Sources of diffs: files, rows, git; a table of repository files; sinks and the result cache."""

from __future__ import annotations

import json
import subprocess
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.functions import columns as C
from hunkwise.functions.diff import Diff, check
from hunkwise.functions.elision import elision_line
from hunkwise.operators import native as N


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``diff_id, source, raw``: a diff per file. The id is a hash of the path, so it is stable."""
    files = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("raw"))
    return files.select(F.xxhash64("source").alias("diff_id"), "source", "raw")


def from_rows(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "diff_id long, raw string")


def is_range(revision: str) -> bool:
    return ".." in revision


def git_command(revisions: list[str], staged: bool = False, worktree: bool = False) -> list[str]:
    """The git call of a selection: the index, the worktree, a range, a commit, else HEAD."""
    if staged and worktree:
        raise ValueError("staged and worktree exclude each other")
    if len(revisions) > 1 or revisions and (staged or worktree):
        raise ValueError("give one revision or range, or one of staged and worktree")
    if staged:
        return ["diff", "--cached"]
    if worktree:
        return ["diff", "HEAD"]
    revision = revisions[0] if revisions else "HEAD"
    if revision.startswith("-"):
        raise ValueError(f"not a revision: {revision}")
    return ["diff", revision] if is_range(revision) else ["show", "--first-parent", "-m", revision]


def read_git(spark: SparkSession, repo: str, revisions: list[str], staged: bool = False, worktree: bool = False) -> DataFrame:
    """A diff per revision, read on the driver (a repository is local to it)."""
    return _git_rows(spark, repo, [git_command([r]) for r in revisions] or [git_command([], staged, worktree)])


def _git_rows(spark: SparkSession, repo: str, commands: list[list[str]]) -> DataFrame:
    rows = []
    for i, command in enumerate(commands):
        done = subprocess.run(["git", "-C", repo, "--no-pager", *command, "--no-color", "--no-ext-diff"], capture_output=True, check=False)
        if done.returncode:
            raise RuntimeError(done.stderr.decode("utf-8", "replace").strip())
        rows.append((i, done.stdout.decode("utf-8", "replace")))
    return from_rows(spark, rows)


def read_diffs(spark: SparkSession, revisions: list[str] = (), staged: bool = False, worktree: bool = False, piped: str | None = None, repo: str = ".") -> DataFrame:
    """One diff by precedence: the index, the worktree, a revision or range, text that was piped in, else HEAD."""
    command = git_command(list(revisions), staged, worktree)
    if piped is not None and not (staged or worktree or revisions):
        return from_rows(spark, [(0, piped)])
    return _git_rows(spark, repo, [command])


def confined(path: str) -> str:
    """A path within the repository; absolute paths and ways out are refused."""
    parts: list[str] = []
    for p in PurePosixPath(path).parts:
        if p == "..":
            if not parts:
                raise ValueError(f"path is outside the repository: {path}")
            parts.pop()
        elif p != ".":
            parts.append(p)
    if path.startswith("/"):
        raise ValueError(f"path is outside the repository: {path}")
    return "/".join(parts)


def repo_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, line_no, text`` of the text files below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    name = F.regexp_replace(F.input_file_name(), r"^file:/*", "/")
    rows = files.select(name.alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "text"))
    base = root.removeprefix("file://").rstrip("/")
    return rows.select(F.regexp_replace("file", "^" + _quoted(base) + "/", "").alias("path"), (F.col("at") + 1).alias("line_no"), "text")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def search(files: DataFrame, pattern: str, under: str = "", most: int = 200) -> DataFrame:
    """The first ``most`` matching rows by path and row, and one more if there are more."""
    if not pattern:
        raise ValueError("pattern must not be empty")
    hits = files.where(F.col("text").rlike(pattern))
    if under:
        inside = confined(under)
        hits = hits.where((F.col("path") == inside) | F.col("path").startswith(inside + "/"))
    return hits.orderBy("path", "line_no").limit(most + 1)


def truncated(text: str, limit: int = 16 * 1024) -> str:
    """A tool's output cut at a character, with its size."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= limit:
        return text
    return data[:limit].decode("utf-8", "ignore") + f"\n... (truncated, {len(data)} total bytes)"


# Rows that git paints as metadata.
_META = (
    "+++", "---", "diff ", "index ", "old mode ", "new mode ", "new file mode ", "deleted file mode ", "similarity index ", "dissimilarity index ",
    "rename from ", "rename to ", "copy from ", "copy to ",
)


def paint(row: str, colours: dict[str, str]) -> str:
    """A row in the colour of its class: meta, frag, new or old."""
    kind = "meta" if row.startswith(_META) else "frag" if row.startswith("@@") else {"+": "new", "-": "old"}.get(row[:1])
    colour = colours.get(kind or "")
    return f"{colour}{row}\x1b[0m" if colour else row


def result_text(smart_diff: str, summary: str, elision: str, colours: dict[str, str] | None = None) -> str:
    """Summary and elision as comments, then the reading diff."""
    notes = "".join(f"# {x}\n" for x in (summary, elision) if x)
    rows = smart_diff.rstrip("\n").split("\n") if smart_diff.strip() else ["(no meaningful change to read)"]
    return notes + "\n" * bool(notes) + "".join(paint(r, colours or {}) + "\n" for r in rows)


def with_elision(results: DataFrame) -> DataFrame:
    """Results ``diff_id, raw, smart_diff, summary, ...`` with their elision line and as one JSON object each."""
    from hunkwise.operators.diffs import each

    lines = each(results, ["diff_id", "raw", "smart_diff"], lambda i, raw, smart: iter([(i, elision_line(raw or "", smart or "") or None)]), "diff_id long, elision string")
    out = results.join(lines, "diff_id")
    return out.withColumn("json", F.to_json(F.struct("smart_diff", "summary", "input_tokens", "output_tokens", "elision")))


CACHE = "cache_key string, smart_diff string, summary string, input_tokens long, output_tokens long, error string, stored_at timestamp"


def _folder(spark: SparkSession, path: str):
    """The file system of a path, the path, and the constructor of paths."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def cache_store(results: DataFrame, folder: str) -> None:
    """Add results by ``cache_key``: written aside, then renamed, so that readers see all of them or none."""
    spark = results.sparkSession
    name = uuid.uuid4().hex
    results.withColumn("stored_at", F.current_timestamp()).select(*[c.split()[0] for c in CACHE.split(", ")]).write.parquet(f"{folder}/.new-{name}")
    files, _, path = _folder(spark, folder)
    if not files.rename(path(f"{folder}/.new-{name}"), path(f"{folder}/entry-{name}")):
        raise OSError(f"can't add to the cache in {folder}")


def cache_load(spark: SparkSession, folder: str, with_errors: bool = False) -> DataFrame:
    """The newest result of each ``cache_key``; what is missing or can't be read is a miss, and so is an error."""
    files, at, path = _folder(spark, folder)
    entries = [str(f.getPath()) for f in files.globStatus(path(f"{folder}/entry-*")) or []] if files.exists(at) else []
    if not entries:
        return spark.createDataFrame([], CACHE)
    found = spark.read.schema(CACHE).option("ignoreCorruptFiles", "true").parquet(*entries)
    return newest(found if with_errors else found.where("error is null"))


def newest(cache: DataFrame) -> DataFrame:
    """One result of each key: the one that was stored last, or where that isn't known any."""
    if "stored_at" not in cache.columns:
        return cache.dropDuplicates(["cache_key"])
    rest = [c for c in cache.columns if c != "cache_key"]
    return cache.groupBy("cache_key").agg(F.max_by(F.struct(*rest), F.struct("stored_at", F.xxhash64(*rest))).alias("r")).select("cache_key", "r.*")


def cached(diffs: DataFrame, cache: DataFrame, protocol: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Hits with their results, and the diffs to compute; both with ``cache_key``."""
    keyed = diffs.withColumn("cache_key", C.cache_key(F.lit(protocol), F.lit(model), F.coalesce("raw", F.lit(""))))
    known = newest(cache)
    return keyed.join(known, "cache_key"), keyed.join(known, "cache_key", "left_anti")


class RepoTools:
    """What a planner may ask of a repository, over a table ``path, line_no, text`` of its files.

    Each tool takes JSON and returns text. A file's rows meet by path, and what is collected is cut
    at as many rows as a tool's output may have characters.
    """

    def __init__(self, files: DataFrame, most: int = 200, limit: int = 16 * 1024):
        self.files, self.most, self.limit = files, most, limit

    @property
    def tools(self) -> dict:
        return {"read_file": self.read_file, "grep": self.grep}

    def _given(self, text: str, **kinds: type) -> dict:
        given = json.loads(text)
        if not isinstance(given, dict) or given.keys() - kinds or any(not isinstance(v, kinds[k]) for k, v in given.items()):
            raise ValueError(f"expected an object with {', '.join(kinds)}")
        return given

    def read_file(self, text: str) -> str:
        """``path`` and optionally ``start_line`` and ``end_line``: rows with their numbers."""
        given = self._given(text, path=str, start_line=int, end_line=int)
        path = confined(given.get("path", ""))
        rows = self.files.where(F.col("path") == path)
        if rows.isEmpty():
            raise ValueError(f"no file {path}")
        part = N.row_slice(rows, given.get("start_line", 1), given.get("end_line", 0))
        return "\n".join(f"{r.line_no}\t{r.text}" for r in part.orderBy("line_no").limit(self.limit).select("line_no", "text").collect())

    def grep(self, text: str) -> str:
        """``pattern`` and optionally ``path``: matching rows as ``path:row:text``."""
        given = self._given(text, pattern=str, path=str)
        found = search(self.files, given.get("pattern", ""), given.get("path", ""), self.most).collect()
        rows = [f"{r.path}:{r.line_no}:{r.text}" for r in found[: self.most]]
        return "\n".join(rows + ["... (more matches)"] * (len(found) > self.most)) or "(no matches)"


def readable(raw: str) -> bool:
    return not check(Diff(raw))
