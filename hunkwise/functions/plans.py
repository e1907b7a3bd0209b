"""Edit plans: remove, fold and elide rows of one diff, checked against its immutable rows.

``compile_plan`` returns the reading diff, or every reason why the plan is refused.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, groupby

from hunkwise.functions import lexers as lx
from hunkwise.functions.diff import SOURCE, Diff, Hunk, check
from hunkwise.functions.imports import import_mask
from hunkwise.functions.moves import Move, MoveRow, extend_mask, find_moves, format_moves, format_range

# Limits of plan texts, and when a reading diff is too full.
REPLACEMENT_BYTES, SUMMARY_BYTES = 4 * 1024, 500
PRESSURE_RAW, PRESSURE_VISIBLE, PRESSURE_HIGH, PRESSURE_PERCENT = 40, 20, 80, 45
PLACEHOLDERS = ("...", "…")

_FILE_BODY = frozenset(("header", "mail_signature"))
_PAIR_BODY = frozenset(("header", "old_file", "mail_signature"))
_PLACEHOLDER = re.compile(r"…|\.{3,}")


class PlanError(ValueError):
    """A refused plan; ``problems`` has each reason, as ``rule (place): words``."""

    def __init__(self, problems: list[str]):
        self.problems = problems
        super().__init__(problems[0] if len(problems) == 1 else "\n".join([f"{len(problems)} reasons against the plan:", *(f"- {p}" for p in problems)]))


# --- elision --------------------------------------------------------------


def elision_pattern(new: str, strict: bool = True) -> re.Pattern | None:
    """What a text with placeholders stands for; each hides at least one character.

    Strict: placeholders are of exactly three dots or one ellipsis and never adjoin.
    """
    parts: list[str] = []
    at = 0
    for m in _PLACEHOLDER.finditer(new):
        if m.start() > at or not parts:
            parts.append(re.escape(new[at : m.start()]))
        elif strict:
            return None
        if strict and len(m[0]) > 3:
            return None
        if m.start() > at or len(parts) == 1:
            parts.append(".+")
        at = m.end()
    if not parts:
        return None
    return re.compile("".join(parts) + re.escape(new[at:]))


def is_elision(old: str, new: str, strict: bool = True) -> bool:
    pattern = elision_pattern(new, strict)
    return pattern is not None and pattern.fullmatch(old) is not None


def line_problem(name: str, text: str, limit: int) -> str | None:
    """Why a text is no single printable line."""
    try:
        size = len(text.encode())
    except UnicodeEncodeError:
        return f"{name}: not encodable as UTF-8"
    if size > limit:
        return f"{name}: {size} bytes, {limit} are allowed"
    for c in text:
        if c in "\n\r\0\x1b\u2028\u2029":
            return f"{name}: more than one line, or not printable"
        if unicodedata.category(c) == "Cc" and c != "\t":
            return f"{name}: holds a control character"
    return None


def summary_problem(text: str) -> str | None:
    if not text.strip():
        return "summary: missing"
    return line_problem("summary", text, SUMMARY_BYTES)


def only_place(text: str, part: str) -> int | None:
    """Where a text holds a part, if it does so once; overlaps count."""
    first = text.find(part)
    return first if first >= 0 and text.find(part, first + 1) < 0 else None


# --- state ----------------------------------------------------------------


@dataclass(frozen=True)
class Fold:
    start: int  # 1-based, inclusive
    end: int
    marker: str
    indent: str
    eol: str

    @property
    def row(self) -> str:
        return f"{self.marker}{self.indent}..."


@dataclass(frozen=True)
class Edit:
    start: int
    end: int
    new: str
    index: int


@dataclass
class State:
    """What becomes of each row."""

    hidden: list[bool]
    fold_of: dict[int, int] = field(default_factory=dict)  # row to fold
    fold_at: dict[int, int] = field(default_factory=dict)  # first row to fold
    folds: list[Fold] = field(default_factory=list)

    def shown(self, i: int) -> bool:
        """Whether a row is there, be it within a fold."""
        return not self.hidden[i] or i in self.fold_of

    def any_shown(self, rows: range) -> bool:
        return any(self.shown(i) for i in rows)

    def fold(self, fold: Fold) -> None:
        self.fold_at[fold.start - 1] = len(self.folds)
        for i in range(fold.start - 1, fold.end):
            self.fold_of[i] = len(self.folds)
            self.hidden[i] = True
        self.folds.append(fold)

    def treatment(self, row: int, mandatory: list[bool]) -> str:
        """kept, removed, or the place within a fold; rows are 1-based."""
        i = row - 1
        if mandatory[i] or self.hidden[i] and i not in self.fold_of:
            return "removed"
        if not self.hidden[i]:
            return "kept"
        f = self.folds[self.fold_of[i]]
        return "fold start" if row == f.start else "fold end" if row == f.end else "fold middle"


@dataclass
class Stats:
    raw_files: int = 0
    visible_files: int = 0
    raw_changed: int = 0
    visible_changed: int = 0
    removed_changed: int = 0
    folded_changed: int = 0
    fold_count: int = 0

    @property
    def pressure(self) -> bool:
        """Whether so much is left that a second look pays."""
        if self.raw_changed < PRESSURE_RAW or self.visible_changed < PRESSURE_VISIBLE:
            return False
        return self.visible_changed >= PRESSURE_HIGH or self.visible_changed * 100 >= self.raw_changed * PRESSURE_PERCENT


@dataclass
class Compiled:
    text: str
    stats: Stats
    moves: list[Move]


def with_edits(body: str, edits: list[Edit]) -> str:
    """The body with non-overlapping spans replaced."""
    out, at = [], 0
    for e in sorted(edits, key=lambda e: e.start):
        out += [body[at : e.start], e.new]
        at = e.end
    return "".join([*out, body[at:]])


# --- Python suites --------------------------------------------------------


class Suites:
    """The new side of a diff's Python hunks: what is inside strings, what owns what."""

    def __init__(self, diff: Diff):
        self.diff = diff
        self.triple: dict[int, str] = {}  # the string open before a row
        self.depth: dict[int, int] = {}  # the brackets open before a new-side row
        for hunk in diff.hunks:
            if hunk.language != "python":
                continue
            triple, net = "", lx.ZERO
            for i in hunk.rows:
                self.triple[i] = triple
                if self.on_new_side(i):
                    self.depth[i] = sum(net)
                    triple, _, more = lx.py_scan(diff.text[i][1:], triple)
                    net = lx.clamp(lx.add(net, more))

    def on_new_side(self, i: int) -> bool:
        return self.diff.is_source(i) and len(self.diff.text[i]) > 1 and self.diff.text[i][0] != "-"

    def code_rows(self) -> Iterator[tuple[int, str, str]]:
        """New-side Python rows outside strings: row, body, code."""
        for i, language in enumerate(self.diff.language):
            if language == "python" and self.on_new_side(i) and not self.triple.get(i):
                body = self.diff.text[i][1:]
                yield i, body, lx.py_code(body)

    def following(self, i: int, state: State | None) -> Iterator[tuple[int, Fold | None, str, str]]:
        """Rows from ``i`` to the hunk's end that say something: row, fold, body, code."""
        for j in range(i, self.diff.hunk_of(i).end):
            if state and j in state.fold_at:
                yield j, state.folds[state.fold_at[j]], "", ""
            elif self.on_new_side(j) and not (state and state.hidden[j]):
                body = self.diff.text[j][1:]
                code = lx.py_code(body)
                if code:
                    yield j, None, body, code

    def header_end(self, i: int, state: State | None) -> int | None:
        """The row on which the suite header that begins at ``i`` ends."""
        depth = 0
        for j, fold, body, code in self.following(i, state):
            if fold:
                continue
            depth += lx.py_depth(body)
            if depth < 0:
                return None
            if not depth and code.endswith(":"):
                return j
        return None

    def has_body(self, i: int, indent: int, state: State | None) -> bool:
        """Whether what follows a header's last row is deeper."""
        for j, fold, body, _ in self.following(i, state):
            if j == i or fold and fold.marker == "-":
                continue
            return len(fold.indent if fold else lx.indent_of(body)) > indent
        return False

    def has_definition(self, i: int, indent: int, state: State | None) -> bool:
        """Whether a decorator is followed, past others, by a definition."""
        depth = lx.py_depth(self.diff.text[i][1:])
        for j, fold, body, code in self.following(i, state):
            if j == i or fold:
                continue
            if depth > 0:
                depth += lx.py_depth(body)
                if depth < 0:
                    return False
            elif len(lx.indent_of(body)) != indent:
                return False
            elif code.startswith("@"):
                depth = lx.py_depth(body)
            else:
                return lx.py_defines(code)
        return False

    def is_anchor(self, i: int, code: str) -> bool:
        return self.diff.language[i] == "python" and not self.triple.get(i) and (code.startswith("@") or lx.py_owns_suite(code))


def add_placeholders(suites: Suites, state: State, mandatory: list[bool]) -> None:
    """A suite that only imported keeps one ``...`` row, so that its owner stays readable."""
    diff = suites.diff
    for i, body, code in list(suites.code_rows()):
        if state.hidden[i] or not lx.py_owns_suite(code):
            continue
        end, indent = suites.header_end(i, None), len(lx.indent_of(body))
        if end is None or not suites.has_body(end, indent, None) or suites.has_body(end, indent, state):
            continue
        for j in range(end + 1, diff.hunk_of(i).end):
            deeper = suites.on_new_side(j) and len(lx.indent_of(diff.text[j][1:])) > indent
            if mandatory[j] and state.hidden[j] and deeper and lx.py_code(diff.text[j][1:]):
                state.fold(Fold(j + 1, j + 1, diff.text[j][0], lx.indent_of(diff.text[j][1:]), diff.eol[j]))
                break


def with_imports_shown(diff: Diff, state: State, mandatory: list[bool]) -> State:
    """The state in which hidden imports of partly shown hunks count as there."""
    out = State(list(state.hidden), dict(state.fold_of), dict(state.fold_at), state.folds)
    for hunk in diff.hunks:
        if any(diff.is_source(i) and not mandatory[i] and state.shown(i) for i in hunk.rows):
            for i in hunk.rows:
                if mandatory[i]:
                    out.hidden[i] = False
                    out.fold_of.pop(i, None)
                    out.fold_at.pop(i, None)
    return out


def python_anchor_problems(suites: Suites, state: State) -> Iterator[str]:
    """Owners and decorators must be hidden or kept with what they own."""
    for hidden_ones in (True, False):
        for i, body, code in suites.code_rows():
            if state.hidden[i] != hidden_ones:
                continue
            indent = len(lx.indent_of(body))
            if code.startswith("@"):
                if suites.has_definition(i, indent, None):
                    attached = suites.has_definition(i, indent, state)
                    if hidden_ones and attached:
                        yield f"python-decorator (line {i + 1}): it goes, the definition that it decorates stays"
                    if not hidden_ones and not attached:
                        yield f"python-decorator (line {i + 1}): it stays, the definition that it decorates goes"
            elif lx.py_owns_suite(code):
                end = suites.header_end(i, None)
                if end is None or not suites.has_body(end, indent, None):
                    continue
                if hidden_ones:
                    if suites.has_body(end, indent, state):
                        yield f"python-suite (line {i + 1}): the header goes, rows of its suite stay"
                else:
                    kept = suites.header_end(i, state)
                    if kept is None or not suites.has_body(kept, indent, state):
                        yield f"python-suite (line {i + 1}): the header stays without its suite, of which a row or a fold is needed"


def _shown_change(diff: Diff, state: State, hunk: Hunk) -> bool:
    return any(diff.kind[i] == "change" and state.shown(i) for i in hunk.rows)


class SideScan:
    """One side of a Python hunk, read once: the string open before each row, how often strings opened or closed so far."""

    def __init__(self, diff: Diff, hunk: Hunk, side: str):
        self.rows = [i for i in diff.side_rows(hunk, side) if len(diff.text[i]) > 1]
        self.body = [diff.text[i][1:] for i in self.rows]
        self.open, self.turns = [""], [0]
        for body in self.body:
            triple, turns, _ = lx.py_scan(body, self.open[-1])
            self.open.append(triple)
            self.turns.append(self.turns[-1] + turns)

    def whole(self, first: int, end: int) -> bool:
        """Whether the rows from ``first`` up to ``end`` can go without cutting a string or bracket.

        They can if they lie within one string. Otherwise they are read as code: they must not begin with
        bare quotes that close a string, nor leave one open, and no bracket may close that didn't open here.
        """
        a, b = bisect_left(self.rows, first), bisect_left(self.rows, end)
        if a == b or self.open[a] and self.turns[a] == self.turns[b]:
            return True
        if self.open[a] and self.body[a].strip() in lx.TRIPLES:
            return False
        read = list(accumulate(self.body[a:b], _read_on, initial=("", lx.ZERO)))
        return read[-1] == ("", lx.ZERO) and all(min(net) >= 0 for _, net in read)


def _read_on(at: tuple[str, tuple], body: str) -> tuple[str, tuple]:
    triple, _, net = lx.py_scan(body, at[0])
    return triple, lx.add(at[1], net)


def python_region_problems(diff: Diff, state: State) -> Iterator[str]:
    """What each hidden region takes from either side must be whole."""
    for hunk in diff.hunks:
        if hunk.language != "python" or not _shown_change(diff, state, hunk):
            continue
        sides = [(name, SideScan(diff, hunk, side)) for side, name in (("-", "old"), ("+", "new"))]
        for gone, region in groupby(hunk.rows, lambda i: state.hidden[i] and diff.is_source(i)):
            rows = list(region)
            for name, side in sides if gone else ():
                if not side.whole(rows[0], rows[-1] + 1):
                    yield f"python-region (lines {rows[0] + 1}-{rows[-1] + 1}): on the {name} side a string or bracket is cut; hide only what is inside of it"


def reference_problems(suites: Suites, state: State) -> Iterator[str]:
    """A hidden top-level assignment must not be used by a row that stays."""
    diff = suites.diff
    kept: dict[int | None, list[tuple[int, str]]] = defaultdict(list)
    hidden = []
    for i, row in enumerate(diff.text):
        if not diff.is_source(i) or len(row) < 2:
            continue
        inside = i in suites.depth and suites.triple.get(i) and diff.hunk_of(i).language == "python"
        if not state.hidden[i]:
            if not inside:
                kept[diff.file[i]].append((i, row))
        elif diff.language[i] == "python" and row[0] != "-" and not inside and not suites.depth.get(i):
            name = lx.py_assigned(lx.py_bare(row[1:]))
            if name:
                hidden.append((i, name))
    bare: dict[int, str] = {}
    for i, name in hidden:
        for j, row in kept[diff.file[i]]:
            if diff.text[i][0] == "+" and row[0] == "-" or name not in row:
                continue
            if j not in bare:
                bare[j] = lx.py_bare(row[1:])
            if lx.mentions(bare[j], name):
                yield f"python-reference (line {i + 1}): {name} goes, line {j + 1} stays and uses it"
                break


def python_side_problems(diff: Diff, state: State, edits: dict[int, list[Edit]]) -> Iterator[str]:
    """Strings, brackets and continuations of a partly shown hunk must come out as they went in."""
    for hunk in diff.hunks:
        if hunk.language != "python" or not _shown_change(diff, state, hunk):
            continue
        ends: dict[str, list] = {"triple": [], "net": []}
        broken = []
        for side in "-+":
            raw, left = ("", lx.ZERO), ("", lx.ZERO)
            rows = diff.side_rows(hunk, side)
            for i in rows:
                body = diff.text[i][1:]
                t, _, n = lx.py_scan(body, raw[0])
                before, raw = raw[0], (t, lx.add(raw[1], n))
                if not state.hidden[i]:
                    t, _, n = lx.py_scan(with_edits(body, edits.get(i + 1, [])), left[0])
                    left = t, lx.add(left[1], n)
                if before or not lx.py_continues(body) or len(diff.text[i]) < 2:
                    continue
                after = next((j for j in rows if j > i and len(diff.text[j]) > 1), None)
                if after is None or not state.hidden[i] and not lx.py_continues(with_edits(body, edits.get(i + 1, []))):
                    continue
                if state.hidden[i] != state.hidden[after]:
                    broken.append(f"python-backslash (lines {i + 1}-{after + 1}): one continued line, of which a part goes")
            ends["triple"].append(raw[0] == left[0])
            ends["net"].append(raw[1] == left[1])
        if not all(ends["triple"]):
            yield f"python-quotes (line {hunk.header + 1}): a long string of the hunk is left open or closed by what goes"
        if not all(ends["net"]):
            yield f"python-brackets (line {hunk.header + 1}): brackets of the hunk no longer come out as they did"
        yield from broken


# --- Go and TypeScript ----------------------------------------------------


def _side(diff: Diff, hunk: int, language: str, side: str, state: State | None, edits: dict[int, list[Edit]]) -> list[tuple[int, str]]:
    rows = [i for i in diff.side_rows(diff.hunks[hunk], side) if diff.language[i] == language]
    if state is None:
        return [(i, diff.text[i][1:]) for i in rows]
    return [(i, with_edits(diff.text[i][1:], edits.get(i + 1, []))) for i in rows if not state.hidden[i]]


def _detached(tokens: list[tuple[str, int]], owner_of, body_shows, state: State) -> Iterator[tuple[str, int]]:
    """Hidden owners of brace blocks whose bodies show."""
    stack: list[tuple[int, str | None]] = []
    for mark, row in tokens:
        if mark == "{":
            stack.append((row, owner_of(row)))
        elif mark == "}" and stack:
            opened, owner = stack.pop()
            if owner and not state.shown(opened) and any(state.shown(i) and body_shows(i) for i in range(opened + 1, row)):
                yield owner, opened


def structure_problems(diff: Diff, state: State, edits: dict[int, list[Edit]], language: str) -> Iterator[str]:
    """Delimiters and block owners of Go and TypeScript hunks."""
    go = language == "go"
    scan, pairs = (lx.go_tokens, lx.GO_PAIRS) if go else (lx.ts_tokens, lx.TS_PAIRS)
    for hunk in diff.hunks:
        if hunk.language != language:
            continue
        for side, name in (("-", "old"), ("+", "new")):
            raw = _side(diff, hunk.number, language, side, None, edits)
            if not raw:
                continue
            tokens = scan(raw)
            left = scan(_side(diff, hunk.number, language, side, state, edits))
            if lx.Net.of(tokens, pairs) != lx.Net.of(left, pairs):
                yield f"{language}-structure (line {hunk.header + 1}): delimiters of the {name} side no longer come out as they did"
            by_row: dict[int, list[str]] = defaultdict(list)
            for t, row in tokens:
                by_row[row].append(t)
            texts = dict(raw)
            if go:
                owner_of = lambda i: "block" if lx.go_owns(by_row[i]) else None  # noqa: E731, B023
                body = lambda i: any(t not in ("comment", ";", "{", "}") for t in by_row.get(i, ()))  # noqa: E731, B023
            else:
                yield from _ts_fold_problems(diff, hunk, side, state)
                yield from _ts_decorator_problems(raw, state)
                owner_of = lambda i: lx.ts_owner(texts[i], texts.get(i - 1))  # noqa: E731, B023
                body = lambda i: bool(texts.get(i, "").strip()) or any(t not in "{};," for t in by_row.get(i, ()))  # noqa: E731, B023
            for owner, i in _detached(tokens, owner_of, body, state):
                yield f"{language}-owner (line {i + 1}): the {owner} goes, rows of its block stay"


def _ts_fold_problems(diff: Diff, hunk: Hunk, side: str, state: State) -> Iterator[str]:
    for n, f in enumerate(state.folds):
        if diff.hunk[f.start - 1] != hunk.number or diff.language[f.start - 1] != "typescript" or f.marker != side:
            continue
        net = lx.Net.of(lx.ts_tokens([(-1, diff.text[i][1:]) for i in range(f.start - 1, f.end) if diff.is_source(i)]), lx.TS_PAIRS)
        if net:
            close = dict(p for p in lx.TS_PAIRS)
            what = ",".join(f"{mark}{n_:+d}{close[mark]}" for mark, n_ in net.counts if n_)
            yield f"typescript-fold (lines {f.start}-{f.end}): what it hides is open by {what}"


def _ts_decorator_problems(raw: list[tuple[int, str]], state: State) -> Iterator[str]:
    codes = [(i, lx.ts_code(t)) for i, t in raw]
    codes = [(i, c) for i, c in codes if c]
    for (i, code), (j, _) in zip(codes, codes[1:], strict=False):
        if state.hidden[i] and code.startswith("@") and state.shown(j):
            yield f"typescript-decorator (line {i + 1}): it goes, its declaration on line {j + 1} stays"


# --- moves ----------------------------------------------------------------


def move_problems(moves: list[Move], state: State, mandatory: list[bool]) -> Iterator[str]:
    """Corresponding rows of a move must be treated alike."""
    coarse = lambda t: "folded" if t.startswith("fold") else t
    for m in moves:
        pending: list[tuple[int, int, str, str]] = []
        for a, b in [*m.rows, (0, 0)]:
            ta, tb = (state.treatment(a, mandatory), state.treatment(b, mandatory)) if a else ("", "")
            kinds = coarse(ta), coarse(tb)
            if pending and (ta == tb or kinds != pending[0][2:]):
                yield _asymmetry(m, pending)
                pending = []
            if ta != tb:
                pending.append((a, b, *kinds))


def _asymmetry(m: Move, rows: list[tuple[int, int, str, str]]) -> str:
    a, b = (rows[0][0], rows[-1][0]), (rows[0][1], rows[-1][1])
    old, new = rows[0][2:]
    verb = lambda r: "is" if r[0] == r[1] else "are"
    if old == new == "folded":
        detail = f"the folds of removed {format_range(*a)} and added {format_range(*b)} have other ends"
    else:
        detail = f"removed {format_range(*a)} {verb(a)} {old} while added {format_range(*b)} {verb(b)} {new}"
    return (
        f"move-symmetry (lines {m.removed_start}-{m.removed_end}): moved to {format_range(m.added_start, m.added_end)}, where rows must be treated as here; {detail}"
    )


def move_edit_problems(diff: Diff, moves: list[Move], state: State, mandatory: list[bool], edits: dict[int, list[Edit]]) -> Iterator[str]:
    for m in moves:
        for a, b in m.rows:
            if not (a in edits or b in edits) or state.treatment(a, mandatory) != "kept" or state.treatment(b, mandatory) != "kept":
                continue
            old, new = (MoveRow.of(with_edits(diff.text[r - 1][1:], edits.get(r, []))).text for r in (a, b))
            if old != new:
                yield (
                    f"move-elision (line {a}): it moved to line {b}, and the two no longer read alike; elide both in the same way or none"
                )


# --- retained structure ---------------------------------------------------


def complete_shells(diff: Diff, state: State, mandatory: list[bool]) -> None:
    """Hide hunks and files of which, imports aside, nothing is left."""

    def hide(rows: range) -> None:
        for i in rows:
            state.hidden[i] = True

    imports = lambda rows: any(mandatory[i] and diff.is_source(i) for i in rows)
    for hunk in diff.hunks:
        if imports(hunk.rows) and not _shown_change(diff, state, hunk):
            hide(range(hunk.header, hunk.end))
    for a, b in diff.sections:
        headers = [i for i in range(a, b) if diff.kind[i] == "hunk_header"]
        if headers and imports(range(a, b)) and not any(state.shown(i) for i in headers):
            hide(range(a, b))


def frame_problems(diff: Diff, state: State) -> Iterator[str]:
    """Metadata stays exactly with what it describes."""
    meaningful = lambda rows: any(state.shown(i) and diff.kind[i] not in ("no_newline", "index") for i in rows)
    for i, kind in enumerate(diff.kind):
        shown = state.shown(i)
        if kind == "no_newline" and shown and (diff.owner[i] is None or not state.shown(diff.owner[i])):
            yield f"no-newline (line {i + 1}): the marker stays, the row that it is about goes"
        elif kind == "header":
            body = range(i + 1, diff.next_frame(i + 1, _FILE_BODY))
            if not meaningful(body) and state.any_shown(body):
                yield f"file-metadata (line {i + 1}): of the file only metadata stays, so all of it must go"
            if shown != meaningful(body):
                yield f"file-header (line {i + 1}): the header stays if the file's rows do, and only then"
        elif kind == "old_file":
            if shown != state.shown(i + 1):
                yield f"pair-split (lines {i + 1}-{i + 2}): the two path rows stay or go as one"
            if shown != meaningful(range(i + 2, diff.next_frame(i + 2, _PAIR_BODY))):
                yield f"pair-header (lines {i + 1}-{i + 2}): the path rows stay if the file's rows do, and only then"
        elif kind in ("rename_from", "copy_from"):
            word = kind.split("_")[0]
            if i + 1 >= len(diff) or diff.kind[i + 1] != f"{word}_to":
                yield f"{word}-pair (line {i + 1}): the row that says where to is missing"
            elif shown != state.shown(i + 1):
                yield f"{word}-pair (lines {i + 1}-{i + 2}): the two rows stay or go as one"
        elif kind == "hunk_header":
            hunk = diff.hunk_of(i)
            if not shown and any(state.shown(j) and diff.kind[j] in SOURCE for j in hunk.rows):
                yield f"hunk-rows (line {i + 1}): the header goes, rows of its hunk stay"
            if shown != _shown_change(diff, state, hunk):
                yield f"hunk-header (line {i + 1}): the header stays if a change of its hunk does, and only then"


# --- the compiler ---------------------------------------------------------


def _removals(plan: dict, n: int, state: State) -> Iterator[str]:
    seen: set[int] = set()
    for k, r in enumerate(plan["remove"]):
        a, b = r["start_line"], r["end_line"]
        if a < 1 or b < 1 or a > b:
            yield f"remove-range (remove {k}): {a}-{b} is no range of rows"
        elif b > n:
            yield f"remove-range (remove {k}): row {b} of {n}"
        else:
            twice = [x for x in range(a, b + 1) if x in seen]
            seen.update(range(a, b + 1))
            for x in range(a, b + 1):
                state.hidden[x - 1] = True
            if twice:
                yield f"remove-overlap (remove {k}): row {twice[0]} is in an earlier range"


def make_fold(diff: Diff, suites: Suites, a: int, b: int, k: int) -> Fold | str:
    """The fold of a range, or why there is none."""
    if a < 1 or b < 1 or a >= b:
        return f"fold-range (fold {k}): {a}-{b} is no range of two rows and more"
    if b > len(diff):
        return f"fold-range (fold {k}): row {b} of {len(diff)}"
    indents = []
    marker = ""
    for x in range(a, b + 1):
        row = diff.text[x - 1]
        if not diff.is_source(x - 1):
            return f"fold-source (fold {k}): row {x} isn't a source row of a hunk"
        marker = marker or row[0]
        if row[0] != marker:
            return f"fold-marker (fold {k}): rows of '{marker}' and of '{row[0]}'"
        code = row[1:].strip()
        if marker != "-" and suites.is_anchor(x - 1, code):
            return f"fold-anchor (fold {k}): row {x} begins a Python suite or decorates; only what it owns may fold"
        if code:
            indents.append(lx.indent_of(row[1:]))
    if not indents:
        return f"fold-blank (fold {k}): all its rows are blank"
    low, high = min(indents), max(indents)
    same = next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
    return Fold(a, b, marker, low[:same], diff.eol[b - 1])


def _folds(plan: dict, diff: Diff, suites: Suites, state: State, mandatory: list[bool]) -> Iterator[str]:
    for k, r in enumerate(plan["fold"]):
        a, b = r["start_line"], r["end_line"]
        fold = make_fold(diff, suites, a, b, k)
        if isinstance(fold, str):
            yield fold
            continue
        imports = sum(mandatory[a - 1 : b])
        if imports:
            if imports != b - a + 1:
                yield f"fold-imports (fold {k}): some of its rows go anyway, as imports; leave them out"
            continue  # a fold of imports alone is needless
        clash = next((i for i in range(a - 1, b) if state.hidden[i]), None)
        if clash is not None:
            yield f"fold-overlap (fold {k}): row {clash + 1} is {'folded' if clash in state.fold_of else 'removed'} already"
        else:
            state.fold(fold)


def _edit_problem(diff: Diff, suites: Suites, row: int, old: str, new: str) -> str | Edit:
    """The checked span of a replacement, or what is wrong with it."""
    i = row - 1
    body = diff.text[i][1:]
    if not old:
        return "old: missing"
    wrong = line_problem("old", old, REPLACEMENT_BYTES) or line_problem("new", new, REPLACEMENT_BYTES)
    if wrong:
        return wrong
    if new == old:
        return "new: elides nothing"
    if not is_elision(old, new):
        return "new: doesn't stand for old, with ... or … for what is left out"
    if not diff.is_source(i):
        return f"row {row}: not a source row of a hunk"
    if suites.is_anchor(i, lx.py_code(body)):
        return f"row {row}: begins a Python suite or decorates, which stays as it is"
    if diff.language[i] == "python" and any(old.count(t) != new.count(t) for t in lx.BOUNDARY_TOKENS):
        return "new: has other Python brackets or quotes than old"
    at = only_place(body, old)
    if at is None:
        return f"old: not just once in row {row}"
    after = body[:at] + new + body[at + len(old) :]
    marks = lambda scan, text, kept: [t for t, _ in scan([(-1, text)]) if t in kept]
    if diff.language[i] == "go" and marks(lx.go_tokens, body, "{}") != marks(lx.go_tokens, after, "{}"):
        return "new: has other Go braces than old"
    if diff.language[i] == "typescript" and (marks(lx.ts_tokens, body, "{}<>") != marks(lx.ts_tokens, after, "{}<>") or lx.ts_owner(body) and not lx.ts_owner(after)):
        return "new: has other TypeScript braces, angles or owner than old"
    return Edit(at, at + len(old), new, -1)


def _edits(plan: dict, diff: Diff, suites: Suites, state: State, mandatory: list[bool], edits: dict[int, list[Edit]]) -> Iterator[str]:
    for k, r in enumerate(plan["replace"]):
        row = r["line"]
        if row < 1 or row > len(diff):
            yield f"replace (replace {k}): row {row} of {len(diff)}"
        elif mandatory[row - 1]:
            continue  # imports are hidden anyway
        elif state.hidden[row - 1]:
            yield f"replace (replace {k}): row {row} is {'folded' if row - 1 in state.fold_of else 'removed'}, too"
        else:
            found = _edit_problem(diff, suites, row, r["old"], r["new"])
            if isinstance(found, str):
                yield f"replace (replace {k}): {found}"
            else:
                edits[row].append(Edit(found.start, found.end, found.new, k))


def _edit_overlaps(edits: dict[int, list[Edit]]) -> Iterator[str]:
    for row in sorted(edits):
        edits[row].sort(key=lambda e: e.start)
        for a, b in zip(edits[row], edits[row][1:], strict=False):
            if b.start < a.end:
                yield f"replace (replace {b.index}): meets replace {a.index} in row {row}"


def mandatory_state(diff: Diff, moves: list[Move]) -> tuple[State, list[bool], Suites]:
    """What is hidden before any plan: imports and their moved counterparts."""
    mandatory = extend_mask(moves, import_mask(diff))
    return State(list(mandatory)), mandatory, Suites(diff)


def compile_plan(source: str | Diff, plan: dict, moves: list[Move] | None = None) -> Compiled:
    """Apply a plan. Given ``moves`` are enforced instead of the diff's own (for chunks)."""
    diff = source if isinstance(source, Diff) else Diff(source)
    if check(diff):
        raise PlanError(check(diff))
    if moves is None:
        moves = find_moves(diff)
    state, mandatory, suites = mandatory_state(diff, moves)
    problems = list(_removals(plan, len(diff), state))
    problems += _folds(plan, diff, suites, state, mandatory)
    sound = not problems
    judged = state
    if sound:
        add_placeholders(suites, state, mandatory)
        problems += move_problems(moves, state, mandatory)
        judged = with_imports_shown(diff, state, mandatory)
        problems += python_anchor_problems(suites, judged)
        problems += python_region_problems(diff, judged)
        problems += reference_problems(suites, judged)
    edits: dict[int, list[Edit]] = defaultdict(list)
    problems += _edits(plan, diff, suites, state, mandatory, edits)
    overlaps = list(_edit_overlaps(edits))
    problems += overlaps
    edits = dict(edits)
    if sound and not overlaps:
        if not problems:
            problems += move_edit_problems(diff, moves, state, mandatory, edits)
        problems += python_side_problems(diff, judged, edits)
        problems += structure_problems(diff, state, edits, "go")
        problems += structure_problems(diff, state, edits, "typescript")
        complete_shells(diff, state, mandatory)
        problems += frame_problems(diff, state)
    if problems:
        raise PlanError(problems)
    return Compiled(render(diff, state, edits), count(diff, state), moves)


def render(diff: Diff, state: State, edits: dict[int, list[Edit]]) -> str:
    out = []
    for i, row in enumerate(diff.text):
        if i in state.fold_at:
            fold = state.folds[state.fold_at[i]]
            out += [fold.row, fold.eol]
        elif not state.hidden[i]:
            out += [row[:1] + with_edits(row[1:], edits[i + 1]) if i + 1 in edits else row, diff.eol[i]]
    return "".join(out)


def count(diff: Diff, state: State) -> Stats:
    s = Stats(fold_count=len(state.folds))
    for i, kind in enumerate(diff.kind):
        if kind == "header":
            s.raw_files += 1
            s.visible_files += state.shown(i)
        elif kind == "change":
            s.raw_changed += 1
            s.folded_changed += i in state.fold_of
            s.removed_changed += state.hidden[i] and i not in state.fold_of
            s.visible_changed += not state.hidden[i]
    s.visible_changed += sum(f.marker in "+-" for f in state.folds)
    return s


# --- plans as JSON --------------------------------------------------------

_RANGE_KEYS, _REPLACE_KEYS = {"start_line": int, "end_line": int}, {"line": int, "old": str, "new": str}
_ITEM_KEYS = {"remove": _RANGE_KEYS, "replace": _REPLACE_KEYS, "fold": _RANGE_KEYS}


def decode_plan(text: str, with_summary: bool = False) -> dict:
    """A plan from strict JSON: no unknown fields, nothing after it, all three lists there."""
    try:
        plan = json.loads(text)
    except ValueError as e:
        raise PlanError([f"json: {e}"]) from None
    allowed = {*_ITEM_KEYS, *(["summary"] if with_summary else [])}
    if not isinstance(plan, dict) or plan.keys() - allowed:
        unknown = sorted(plan.keys() - allowed) if isinstance(plan, dict) else "no object"
        raise PlanError([f"json: not a plan, by {unknown}"])
    if any(plan.get(k) is None for k in _ITEM_KEYS):
        raise PlanError(["json: remove, replace and fold are lists, be they empty"])
    for key, fields in _ITEM_KEYS.items():
        for item in plan[key]:
            if not isinstance(item, dict) or item.keys() - fields:
                raise PlanError([f"json: a field of {key} isn't known"])
            for name, kind in fields.items():
                value = item.setdefault(name, kind())
                if not isinstance(value, kind) or isinstance(value, bool):
                    raise PlanError([f"json: {key}.{name} is no {kind.__name__}"])
    if with_summary:
        plan["summary"] = plan.get("summary") or ""
    return plan


def compile_submission(source: str | Diff, plan: dict, moves: list[Move] | None = None) -> Compiled:
    """``compile_plan`` for a plan with a summary."""
    wrong = summary_problem(plan.get("summary") or "")
    if wrong:
        raise PlanError([wrong])
    return compile_plan(source, plan, moves)


def feedback(compiled: Compiled) -> str:
    """What a plan keeps, in words, with the reading diff."""
    s = compiled.stats
    percent = s.visible_changed * 100 // s.raw_changed if s.raw_changed else 0
    head = f"Valid source-derived plan.\nRetention: {s.visible_changed}/{s.raw_changed} visible changed rows ({percent}%); {s.removed_changed} removed, {s.folded_changed} hidden by {s.fold_count} folds"
    if s.raw_files:
        head += f"; files {s.visible_files}/{s.raw_files}"
    lines = [head + "."]
    if compiled.moves:
        lines.append(f"Moves: {len(compiled.moves)} exact cross-hunk/cross-file span(s) treated symmetrically ({format_moves(compiled.moves)}).")
    lines.append("Pressure: high retention." if s.pressure else "Pressure: acceptable.")
    return "\n".join([*lines, "Preview (revised plans still use ORIGINAL line coordinates):", compiled.text])
