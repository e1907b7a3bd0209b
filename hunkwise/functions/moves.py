"""Exact moves: changed rows that reappear, but for their indentation, in another hunk."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import groupby

from hunkwise.functions.diff import Diff
from hunkwise.functions.lexers import indent_of

# What makes a move worth telling, and how many are told.
LEAST_ROWS, LEAST_BYTES, HINTS = 3, 48, 12


@dataclass(frozen=True, order=True)
class Move:
    """1-based inclusive rows of both sides, equally many."""

    removed_start: int
    removed_end: int
    added_start: int
    added_end: int

    @property
    def rows(self) -> list[tuple[int, int]]:
        return list(zip(range(self.removed_start, self.removed_end + 1), range(self.added_start, self.added_end + 1), strict=True))


@dataclass(frozen=True)
class MoveRow:
    text: str
    indent: int
    substantive: bool

    @classmethod
    def of(cls, body: str) -> MoveRow:
        body = body.rstrip(" \t")
        blank = indent_of(body)
        text = body[len(blank) :]
        return cls(text, columns(blank), any(c.isalnum() for c in text))

    def matches(self, other: MoveRow, shift: int) -> bool:
        return self.text == other.text and (not self.text or other.indent - self.indent == shift)


def columns(indent: str) -> int:
    """Width of an indentation with tab stops every eight columns."""
    return len(indent.expandtabs(8))


def overlap(a: tuple[int, int], b: tuple[int, int]) -> bool:
    return a[0] <= b[1] and b[0] <= a[1]


def _ambiguous(spans: list[tuple[int, int]]) -> set[int]:
    """Indices of the spans that overlap another one, by a sweep."""
    out: set[int] = set()
    reach, owner = -1, -1
    for i in sorted(range(len(spans)), key=lambda i: spans[i]):
        if spans[i][0] <= reach:
            out |= {i, owner}
        if spans[i][1] > reach:
            reach, owner = spans[i][1], i
    return out


def find_moves(diff: Diff) -> list[Move]:
    rows = {i: MoveRow.of(diff.text[i][1:]) for i in range(len(diff)) if diff.is_source(i)}
    places = defaultdict(list)
    for i, r in rows.items():
        if r.substantive:
            places[r.text].append(i)
    # Runs of changed rows with one marker in one hunk, consecutive in the diff.
    changed = [i for i in rows if diff.kind[i] == "change"]
    run_of: dict[int, tuple[int, int]] = {}
    for _, group in groupby(enumerate(changed), lambda p: (p[1] - p[0], diff.text[p[1]][0], diff.hunk[p[1]])):
        members = [i for _, i in group]
        for i in members:
            run_of[i] = members[0], members[-1]
    anchors = []
    for found in places.values():
        by = {diff.text[i][0]: i for i in found}
        if len(found) == 2 and by.keys() == {"-", "+"} and diff.hunk[by["-"]] != diff.hunk[by["+"]]:
            anchors.append((by["-"], by["+"]))
    candidates: set[Move] = set()
    reached: dict[tuple, tuple[int, int]] = {}  # by runs and offset: the last stretch
    for old, new in sorted(anchors):
        (old_first, old_last), (new_first, new_last) = run_of[old], run_of[new]
        line = (old_first, new_first, old - new)
        if line in reached and reached[line][0] <= old <= reached[line][1]:
            continue
        shift = rows[new].indent - rows[old].indent
        up = 0
        while old - up > old_first and new - up > new_first and rows[old - up - 1].matches(rows[new - up - 1], shift):
            up += 1
        down = 0
        while old + down < old_last and new + down < new_last and rows[old + down + 1].matches(rows[new + down + 1], shift):
            down += 1
        reached[line] = old - up, old + down
        stretch = [rows[i] for i in range(old - up, old + down + 1)]
        if sum(r.substantive for r in stretch) >= LEAST_ROWS and sum(len("".join(r.text.split()).encode("utf-8", "surrogatepass")) for r in stretch) >= LEAST_BYTES:
            candidates.add(Move(old - up + 1, old + down + 1, new - up + 1, new + down + 1))
    ordered = sorted(candidates)
    dropped = _ambiguous([(m.removed_start, m.removed_end) for m in ordered]) | _ambiguous([(m.added_start, m.added_end) for m in ordered])
    return [m for i, m in enumerate(ordered) if i not in dropped]


def extend_mask(moves: list[Move], mask: list[bool]) -> list[bool]:
    """A hidden row of a move hides its counterpart."""
    mask = list(mask)
    for m in moves:
        for a, b in m.rows:
            if 0 < a <= len(mask) and 0 < b <= len(mask) and (mask[a - 1] or mask[b - 1]):
                mask[a - 1] = mask[b - 1] = True
    return mask


def format_range(a: int, b: int) -> str:
    return f"line {a}" if a == b else f"lines {a}-{b}"


def format_moves(moves: list[Move], limit: int = HINTS) -> str:
    shown = [f"-{m.removed_start}..{m.removed_end} ↔ +{m.added_start}..{m.added_end}" for m in moves[:limit]]
    if len(moves) > limit:
        shown.append(f"and {len(moves) - limit} more")
    return ", ".join(shown)
