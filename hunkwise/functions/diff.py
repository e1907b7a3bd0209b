"""Structure of one unified diff: rows, kinds, files, hunks.

A diff is at most a few MB, so its ordered rules run in one place, per diff; Spark
distributes over diffs. ``hunkwise.plans.layout`` has the same classification
as window expressions for well-formed diffs.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property

# Row kinds, languages by file suffix, markers.
KINDS = (
    "other", "header", "index", "rename_from", "rename_to", "copy_from", "copy_to",
    "mail_signature", "old_file", "new_file", "hunk_header", "context", "change", "no_newline",
)
SUFFIXES = {
    "go": (".go",),
    "python": (".py", ".pyi"),
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "rust": (".rs",),
    "c": (".c", ".h", ".cc", ".hh", ".cpp", ".hpp", ".cxx", ".hxx"),
    "java": (".java", ".kt", ".kts"),
}
NO_NEWLINE = "\\ No newline at end of file"
SIGNATURE = "-- "
META_PREFIXES = {
    "index ": "index",
    "similarity index ": "index",
    "dissimilarity index ": "index",
    "rename from ": "rename_from",
    "rename to ": "rename_to",
    "copy from ": "copy_from",
    "copy to ": "copy_to",
}

SOURCE = frozenset(("context", "change"))
_FRAME = frozenset(("header", "old_file", "hunk_header", "mail_signature"))
_OF_MARKER = {" ": "context", "+": "change", "-": "change"}
_RANGE = re.compile(r"([-+])([-+]?\d+)(?:,([-+]?\d+))?")


def split_rows(text: str) -> tuple[list[str], list[str]]:
    """Row texts and their exact line ends; a final line end begins no row."""
    texts = text.split("\n")
    ends = ["\n"] * (len(texts) - 1) + [""]
    if not texts[-1]:
        texts.pop()
        ends.pop()
    for i, t in enumerate(texts):
        if ends[i] and t.endswith("\r"):
            texts[i], ends[i] = t[:-1], "\r\n"
    return texts, ends


def path_language(path: str) -> str | None:
    path = path.strip('"').lower()
    return next((name for name, ends in SUFFIXES.items() if path.endswith(ends)), None)


def header_language(row: str) -> str | None:
    """The last language that a file header's paths name."""
    fields = row.split()
    found = [x for x in map(path_language, fields[2:]) if x] if len(fields) >= 4 else []
    return found[-1] if found else None


def marker_language(row: str) -> str | None:
    return path_language(row[4:].strip().split("\t")[0])


def hunk_counts(row: str) -> tuple[int, int] | None:
    """Old and new count of a hunk header, None if it states none."""
    fields = row.split()
    if len(fields) < 4 or fields[0] != "@@" or fields[3] != "@@":
        return None
    counts = []
    for sign, f in zip("-+", fields[1:3], strict=True):
        m = _RANGE.fullmatch(f)
        if not m or m[1] != sign or int(m[3] or 1) < 0:
            return None
        counts.append(1 if m[3] is None else int(m[3]))
    return counts[0], counts[1]


def is_file_marker(row: str, marker: str) -> bool:
    return row.startswith((marker + " ", marker + "\t"))


@dataclass
class Hunk:
    """Rows ``start`` to ``end`` (exclusive) follow the header at ``header``."""

    header: int
    end: int
    language: str | None
    number: int

    @property
    def start(self) -> int:
        return self.header + 1

    @property
    def rows(self) -> range:
        return range(self.header + 1, self.end)


class _Counter:
    """What an open hunk still expects."""

    def __init__(self, header: int, counts: tuple[int, int] | None):
        self.header, self.known, self.reported = header, counts is not None, False
        self.left = dict(zip("-+", counts or (0, 0), strict=True))

    @property
    def done(self) -> bool:
        return self.known and not any(self.left.values())

    def take(self, marker: str) -> bool:
        """Count a source row; false if it is one too many."""
        sides = "-+" if marker == " " else marker
        if not self.known:
            return True
        if all(self.left[s] > 0 for s in sides):
            for s in sides:
                self.left[s] -= 1
            return True
        return False


@dataclass
class Diff:
    """The rows of a diff with what they are. Row numbers are 0-based here, 1-based in plans."""

    raw: str
    text: list[str] = field(default_factory=list)
    eol: list[str] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    language: list[str | None] = field(default_factory=list)
    file: list[int | None] = field(default_factory=list)
    hunk: list[int | None] = field(default_factory=list)
    owner: list[int | None] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.text, self.eol = split_rows(self.raw)
        n = len(self.text)
        self.kind = ["other"] * n
        self.language, self.file, self.hunk, self.owner = [None] * n, [None] * n, [None] * n, [None] * n
        self._classify()

    def __len__(self) -> int:
        return len(self.text)

    def pair_at(self, i: int) -> bool:
        """Whether a ``---`` row with its ``+++`` row begins here."""
        return i + 1 < len(self.text) and is_file_marker(self.text[i], "---") and is_file_marker(self.text[i + 1], "+++")

    def _report(self, open_: _Counter, at: int) -> None:
        if not open_.reported:
            self.problems.append(f"hunk-counts (line {open_.header + 1}): the counts don't fit the rows, as line {at + 1} shows")
            open_.reported = True

    def _in_hunk(self, i: int, open_: _Counter) -> str | None:
        """The kind of row ``i`` within the open hunk, None where the hunk is over."""
        row = self.text[i]
        if row == NO_NEWLINE:
            return "no_newline"
        if not open_.known and self.pair_at(i):
            return None
        kind = _OF_MARKER.get(row[:1])
        if open_.done:
            if kind is None or row == SIGNATURE or self.pair_at(i):
                return None
            self._report(open_, i)
            return kind
        if kind is None:
            if open_.known:
                self._report(open_, i)
            return None
        if not open_.take(row[0]):
            self._report(open_, i)
        return kind

    def _classify(self) -> None:
        file = hunk = -1
        language: str | None = None
        in_file = git_file = False
        open_: _Counter | None = None
        second = False  # this row is the +++ of a pair
        for i, row in enumerate(self.text):
            kind = None
            if second:
                second, kind = False, "new_file"
            elif open_:
                kind = self._in_hunk(i, open_)
                if kind is None:
                    open_ = None
                else:
                    self.hunk[i] = hunk
                    if kind == "no_newline" and i and self.kind[i - 1] in SOURCE:
                        self.owner[i] = i - 1
            if kind is None:
                git, pair = row.startswith("diff --git "), self.pair_at(i)
                if git:
                    file, git_file, in_file, language = file + 1, True, True, header_language(row)
                elif pair:
                    file += not git_file
                    in_file = True
                    language = marker_language(self.text[i + 1]) or marker_language(row) or language
                meta = next((k for p, k in META_PREFIXES.items() if row.startswith(p)), None) if in_file else None
                if row == SIGNATURE:
                    kind, in_file, git_file = "mail_signature", False, False
                elif git:
                    kind = "header"
                elif meta:
                    kind = meta
                elif pair:
                    kind, second = "old_file", True
                elif row.startswith("@@") and (in_file or row == "@@" or row.startswith("@@ ")):
                    kind, hunk = "hunk_header", hunk + 1
                    self.hunk[i] = hunk
                    open_ = _Counter(i, hunk_counts(row))
                else:
                    kind = "other"
            self.kind[i] = kind
            self.language[i] = language
            self.file[i] = file if file >= 0 else None
        if open_ and open_.known and not open_.done:
            self._report(open_, len(self.text) - 1)

    @cached_property
    def unsupported(self) -> str | None:
        """Why the diff is of a form that isn't read here."""
        in_patch = False
        for i, row in enumerate(self.text):
            if row == SIGNATURE:
                in_patch = False
            elif row.startswith(("diff --cc ", "diff --combined ")):
                return f"combined (line {i + 1}): diffs against several parents aren't read, take one against one of them"
            elif row.startswith("diff --git ") or self.pair_at(i):
                in_patch = True
            if in_patch and row.startswith("@@@"):
                return f"combined (line {i + 1}): hunks against several parents aren't read, take a diff against one of them"
        return None

    @cached_property
    def frames(self) -> list[int]:
        """Rows at which a file, a file pair, a hunk or a mail trailer begins."""
        return [i for i, k in enumerate(self.kind) if k in _FRAME]

    def next_frame(self, i: int, kinds: frozenset | None = None) -> int:
        """The first frame row at or after ``i``, of the given kinds."""
        frames = self.frames
        for at in range(bisect_right(frames, i - 1), len(frames)):
            if kinds is None or self.kind[frames[at]] in kinds:
                return frames[at]
        return len(self.text)

    @cached_property
    def hunks(self) -> list[Hunk]:
        return [Hunk(i, self.next_frame(i + 1), self.language[i], self.hunk[i]) for i, k in enumerate(self.kind) if k == "hunk_header"]

    def hunk_of(self, i: int) -> Hunk:
        return self.hunks[self.hunk[i]]

    def is_source(self, i: int) -> bool:
        return self.kind[i] in SOURCE

    def side_rows(self, hunk: Hunk, side: str) -> list[int]:
        """Source rows of the hunk that one side of the diff has."""
        return [i for i in hunk.rows if self.kind[i] in SOURCE and self.text[i][:1] in (" ", side)]

    @cached_property
    def sections(self) -> list[tuple[int, int]]:
        """File sections: from a file's first header row to the next file or mail trailer."""
        out = []
        for i, k in enumerate(self.kind):
            first_pair = k == "old_file" and not (i and self.file[i - 1] == self.file[i] and self.kind[i - 1] != "mail_signature")
            if k == "header" or first_pair:
                end = i + 1
                while end < len(self.text) and self.file[end] == self.file[i] and self.kind[end] != "mail_signature":
                    end += 1
                out.append((i, end))
        return out


def check(diff: Diff) -> list[str]:
    """What keeps a diff from being read."""
    return [diff.unsupported] if diff.unsupported else list(diff.problems)


def numbered(raw: str) -> str:
    """The diff with a gutter of row numbers."""
    rows, _ = split_rows(raw)
    width = len(str(len(rows)))
    return "".join(f"{i:>{width}}|{row}\n" for i, row in enumerate(rows, 1))


def numbered_size(text_bytes: int, rows: int) -> int:
    return text_bytes + rows * (len(str(rows)) + 2) if rows else 0


def mask_ranges(mask: list[bool]) -> list[tuple[int, int]]:
    """First and last row, 1-based, of each run of set rows."""
    out: list[list[int]] = []
    for i, on in enumerate(mask, 1):
        if on and out and out[-1][1] == i - 1:
            out[-1][1] = i
        elif on:
            out.append([i, i])
    return [(a, b) for a, b in out]
