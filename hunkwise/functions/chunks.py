"""Cutting an oversized diff into chunks that are diffs of their own, and merging results."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import accumulate

from hunkwise.functions import lexers as lx
from hunkwise.functions.diff import SOURCE, Diff, check, numbered_size, split_rows
from hunkwise.functions.imports import import_mask
from hunkwise.functions.moves import Move, extend_mask, find_moves
from hunkwise.functions.plans import PlanError, State, Suites, add_placeholders

# Bytes of a single run and of a whole diff, and chunks of a diff.
RUN_BYTES, TOTAL_BYTES, MOST_CHUNKS = 400 * 1024, 4 * 1024 * 1024, 32

_START = re.compile(r"([-+])([+]?\d+)(?:,(.*))?", re.S)


@dataclass
class Chunk:
    """``origins``: of each row, the row of the whole diff (0-based), -1 if it was made here."""

    text: str
    meta: str = ""
    section: int = -1
    continued: bool = False
    verbatim: bool = False  # no hunk: copied as it is
    origins: list[int] = field(default_factory=list)


def size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def fits(raw: str, budget: int = RUN_BYTES) -> bool:
    """Whether a diff, also with its row numbers, is within a run's size."""
    rows, _ = split_rows(raw)
    return size(raw) <= budget and numbered_size(sum(map(size, rows)), len(rows)) <= budget


@dataclass(frozen=True)
class Size:
    text: int = 0
    raw: int = 0
    rows: int = 0

    def __add__(self, other: Size) -> Size:
        return Size(self.text + other.text, self.raw + other.raw, self.rows + other.rows)

    def within(self, budget: int) -> bool:
        return self.raw <= budget and numbered_size(self.text, self.rows) <= budget


def literal_rows(diff: Diff) -> list[bool]:
    """Rows that begin, on either side, inside a string, bracket or continued line."""
    out = [False] * len(diff)
    for hunk in diff.hunks:
        sides = {"-": _Position(), "+": _Position()}
        for i in hunk.rows:
            if not hunk.language or not diff.is_source(i):
                continue
            out[i] = any(p.inside for p in sides.values())
            for side, p in sides.items():
                if diff.text[i][0] in (" ", side):
                    p.read(diff.text[i][1:], hunk.language)
    return out


@dataclass
class _Position:
    triple: str = ""
    backtick: bool = False
    continued: bool = False
    open: tuple = lx.ZERO

    @property
    def inside(self) -> bool:
        return bool(self.triple) or self.backtick or self.continued or any(self.open)

    def read(self, row: str, language: str) -> None:
        if language in ("python", "java"):
            before = self.triple
            self.triple, _, net = lx.py_scan(row, before)
            if language == "python":
                self.open = lx.clamp(lx.add(self.open, net))
                self.continued = not before and not self.triple and lx.py_continues(row)
        elif language in ("go", "javascript", "typescript"):
            self.backtick ^= lx.count_backticks(row) % 2 == 1


def header_parts(row: str) -> tuple[dict[str, tuple[int, bool]], str]:
    """Of either side the start and whether its count is zero; and the heading."""
    starts = {"-": (1, False), "+": (1, False)}
    ranges, close, heading = row[3:].partition(" @@") if row.startswith("@@ ") else ("", "", "")
    if not close:
        return starts, ""
    fields = ranges.split()
    if len(fields) == 2:
        for sign, f in zip("-+", fields, strict=True):
            m = _START.fullmatch(f)
            if m and m[1] == sign:
                starts[sign] = int(m[2]), m[3] == "0"
    return starts, heading


def make_header(starts: dict[str, tuple[int, bool]], done: dict[str, int], counts: dict[str, int], heading: str) -> str:
    """A hunk header for rows after ``done`` ones; an empty side names the row before the gap."""
    at = {}
    for s in "-+":
        start, zero = starts[s]
        at[s] = start + done[s]
        if not counts[s] and not zero:
            at[s] = max(0, at[s] - 1)
    return f"@@ -{at['-']},{counts['-']} +{at['+']},{counts['+']} @@{heading}"


class Splitter:
    """Greedy packing of whole files, else of hunks, else of pieces of hunks."""

    def __init__(self, diff: Diff, budget: int):
        self.diff, self.budget = diff, budget
        own = import_mask(diff)
        self.hidden = extend_mask(find_moves(diff), own)
        self.moved = [h and not o for h, o in zip(self.hidden, own, strict=True)]  # hidden only as a counterpart
        self.state = State(list(self.hidden))
        add_placeholders(Suites(diff), self.state, self.hidden)
        self.literal = literal_rows(diff)
        self.text_sums = [0, *accumulate(map(size, diff.text))]
        self.raw_sums = [0, *accumulate(size(t) + len(e) for t, e in zip(diff.text, diff.eol, strict=True))]
        self.chunks: list[Chunk] = []

    def size(self, a: int, b: int) -> Size:
        return Size(self.text_sums[b] - self.text_sums[a], self.raw_sums[b] - self.raw_sums[a], b - a)

    def text(self, a: int, b: int) -> str:
        return "".join(t + e for t, e in zip(self.diff.text[a:b], self.diff.eol[a:b], strict=True))

    def add(self, chunk: Chunk) -> None:
        if len(self.chunks) >= MOST_CHUNKS:
            raise PlanError([f"chunks (diff): more than {MOST_CHUNKS} would be needed; a narrower range needs fewer"])
        self.chunks.append(chunk)

    def file_spans(self) -> list[tuple[int, int]]:
        """A span per file; rows before the first file belong to it."""
        starts = [i for i, f in enumerate(self.diff.file) if f is not None and (not i or self.diff.file[i - 1] != f)]
        return list(zip([0, *starts[1:]], [*starts[1:], len(self.diff)], strict=True)) if starts else []

    def pack(self, spans: list[tuple[int, int]], room: Callable[[], Size], whole: Callable[[int, int], None], cut: Callable[[int, int, int], None]) -> None:
        """Pack consecutive spans while they fit; what doesn't fit, or can't be copied, is cut."""
        run: tuple[int, int] | None = None

        def close() -> None:
            nonlocal run
            if run:
                whole(*run)
            run = None

        for n, (a, b) in enumerate(spans):
            if all(self.hidden[a:b]):
                if room is Size:  # a file that vanishes ends a run, a hunk doesn't
                    close()
            elif any(self.moved[a:b]):
                close()
                cut(n, a, b)
            elif run and (room() + self.size(run[0], b)).within(self.budget):
                run = run[0], b
            else:
                close()
                if (room() + self.size(a, b)).within(self.budget):
                    run = a, b
                else:
                    cut(n, a, b)
        close()

    def split(self) -> list[Chunk]:
        spans = self.file_spans()
        if not spans:
            raise PlanError([f"chunks (diff): {size(self.diff.raw) >> 10} KB without a file to cut at"])
        self.pack(spans, Size, lambda a, b: self.add(Chunk(self.text(a, b), origins=list(range(a, b)))), self.split_file)
        return self.chunks

    def split_file(self, number: int, a: int, b: int) -> None:
        """A file's hunks, each piece with the file's metadata."""
        diff = self.diff
        first = next((i for i in range(a, b) if diff.kind[i] == "hunk_header"), None)
        if first is None:
            raise PlanError([f"chunks (line {a + 1}): a file of {self.size(a, b).raw >> 10} KB without a hunk to cut at"])
        meta = next((i for i in range(a, first) if diff.file[i] is not None), first)
        tail = next((i + 1 for i in range(b - 1, first - 1, -1) if diff.kind[i] in (*SOURCE, "no_newline", "hunk_header")), first)
        heads = [i for i in range(first, tail) if diff.kind[i] == "hunk_header"]
        pieces = 0

        def begin() -> int:
            return meta if pieces else a

        def emit(body: str, origins: list[int]) -> None:
            nonlocal pieces
            self.add(Chunk(self.text(begin(), first) + body, self.text(meta, first), number, pieces > 0, False, [*range(begin(), first), *origins]))
            pieces += 1

        room = lambda: self.size(begin(), first)
        hunks = list(zip(heads, [*heads[1:], tail], strict=True))
        self.pack(hunks, room, lambda x, y: emit(self.text(x, y), list(range(x, y))), lambda _, x, y: self.split_hunk(x, y, room, emit))
        rest = self.text(tail, b)
        if rest and pieces:
            last = self.chunks[-1]
            if fits(last.text + rest, self.budget):
                last.text += rest
                last.origins += range(tail, b)
                rest = ""
        if not pieces:
            rest = self.text(a, meta) + rest
        if rest:
            if not fits(rest, self.budget):
                raise PlanError([f"chunks (line {tail + 1}): what follows the last hunk is too large for a chunk"])
            self.add(Chunk(rest, verbatim=True))

    def emitted(self, i: int) -> tuple[str, str, int] | None:
        """Text, line end and origin with which a row comes out, None if it doesn't."""
        if not self.hidden[i]:
            return self.diff.text[i], self.diff.eol[i], i
        if i in self.state.fold_at:
            fold = self.state.folds[self.state.fold_at[i]]
            return fold.row, fold.eol, -1
        return None

    def _with_followers(self, j: int, end: int) -> int:
        while j < end and (self.diff.kind[j] == "no_newline" or self.literal[j]):
            j += 1
        return j

    def _owns(self, i: int) -> bool:
        row = self.diff.text[i]
        if self.diff.language[i] != "python" or self.hidden[i] or not self.diff.is_source(i) or len(row) < 2 or row[0] == "-" or self.literal[i]:
            return False
        code = lx.py_code(row[1:])
        return code.startswith("@") or lx.py_owns_suite(code)

    def _is_body(self, i: int) -> bool:
        if self.diff.text[i][0] == "-":
            return False
        return i in self.state.fold_at if self.hidden[i] else bool(lx.py_code(self.diff.text[i][1:]))

    def unit_end(self, i: int, end: int) -> int:
        """The end of the rows that stay with row ``i``: literals' insides, an owner's first body row."""
        j, last = self._with_followers(i + 1, end), i
        while self._owns(last):
            before = j
            while j < end and self.diff.is_source(j):
                last = j
                j = self._with_followers(j + 1, end)
                if self._is_body(last):
                    break
            if j == before:
                break
        return j

    def split_hunk(self, a: int, b: int, room: Callable[[], Size], emit: Callable[[str, list[int]], None]) -> None:
        """Segments of a hunk with headers of their own; hidden rows are left out."""
        diff = self.diff
        starts, heading = header_parts(diff.text[a])
        eol = diff.eol[a] or "\n"
        passed = {"-": 0, "+": 0}
        units = []
        i = a + 1
        while i < b:
            units.append((i, self.unit_end(i, b)))
            i = units[-1][1]
        at = 0
        while at < len(units):
            rows: list[tuple[str, str, int]] = []
            counts, began, total, changed, head = {"-": 0, "+": 0}, None, Size(), False, ""
            while at < len(units):
                x, y = units[at]
                out = [(i, self.emitted(i)) for i in range(x, y)]
                kept = [o for _, o in out if o]
                both = {s: sum(diff.is_source(i) and diff.text[i][0] in (" ", s) for i in range(x, y)) for s in "-+"}
                seen = {s: sum(diff.is_source(i) and diff.text[i][0] in (" ", s) for i, o in out if o) for s in "-+"}
                if kept:
                    if began is None:
                        began = dict(passed)
                        head = heading if at == 0 else ""
                    more = Size(sum(size(t) for t, _, _ in kept), sum(size(t) + len(e) for t, e, _ in kept), len(kept))
                    header = make_header(starts, began, {s: counts[s] + seen[s] for s in "-+"}, head)
                    front = Size(size(header), size(header) + len(eol), 1)
                    if not (room() + front + total + more).within(self.budget):
                        break
                    total += more
                    counts = {s: counts[s] + seen[s] for s in "-+"}
                    rows += kept
                    changed = changed or any(o and diff.kind[i] == "change" for i, o in out)
                passed = {s: passed[s] + both[s] for s in "-+"}
                at += 1
            if began is None:
                return
            if not rows:
                raise PlanError([f"chunks (line {units[at][0] + 1}): rows that belong together are too large for a chunk"])
            if changed:
                header = make_header(starts, began, counts, head)
                emit(header + eol + "".join(t + e for t, e, _ in rows), [-1, *(o for _, _, o in rows)])


def split_diff(source: str | Diff, budget: int = RUN_BYTES) -> list[Chunk]:
    diff = source if isinstance(source, Diff) else Diff(source)
    if check(diff):
        raise PlanError(check(diff))
    return Splitter(diff, budget).split()


def chunk_moves(moves: list[Move], origins: list[int]) -> list[Move]:
    """The moves whose sides both lie whole and in one piece in a chunk, in its rows."""
    place = {o: i + 1 for i, o in enumerate(origins) if o >= 0}

    def inside(a: int, b: int) -> int | None:
        start = place.get(a - 1)
        return start if start and all(place.get(x) == start + x - a + 1 for x in range(a - 1, b)) else None

    out = []
    for m in moves:
        old, new = inside(m.removed_start, m.removed_end), inside(m.added_start, m.added_end)
        if old and new:
            out.append(Move(old, old + m.removed_end - m.removed_start, new, new + m.added_end - m.added_start))
    return out


def without_meta(text: str, meta: str) -> str:
    """The text without the leading rows that repeat rows of ``meta`` in order."""
    rows, ends = split_rows(text)
    left = iter(split_rows(meta)[0])
    drop = 0
    while drop < len(rows) and rows[drop] in left:  # ``in`` moves the iterator past the match
        drop += 1
    return "".join(t + e for t, e in zip(rows[drop:], ends[drop:], strict=True))


@dataclass
class Result:
    smart_diff: str
    summary: str
    input_tokens: int = 0
    output_tokens: int = 0


def merge(pairs: list[tuple[Chunk, Result | None]]) -> Result:
    """The chunks' results in order; verbatim chunks have none."""
    if all(r is None for _, r in pairs):
        return Result("", "Only imports and unchanged context; nothing to read.")
    parts: list[str] = []
    surfaced: set[int] = set()
    for chunk, result in pairs:
        piece = chunk.text if result is None else result.smart_diff
        if result is not None and not piece.strip():
            continue
        if result is not None and chunk.section >= 0:
            first = split_rows(chunk.meta)[0][:1]
            if chunk.section in surfaced:
                piece = without_meta(piece, chunk.meta)
            elif (first[0] if first else "") in split_rows(piece)[0]:
                surfaced.add(chunk.section)
            if not piece:
                continue
        if parts and not parts[-1].endswith("\n"):
            parts[-1] += "\n"
        parts.append(piece)
    results = [r for _, r in pairs if r is not None]
    said = list(dict.fromkeys(s for r in results if (s := r.summary.strip())))
    return Result("".join(parts), " ".join(said), sum(r.input_tokens for r in results), sum(r.output_tokens for r in results))
