"""How much of a diff a reading diff keeps, measured on the two texts."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

from hunkwise.functions.diff import SOURCE, Diff
from hunkwise.functions.plans import PLACEHOLDERS, elision_pattern


def diff_counts(diff: Diff) -> tuple[int, int]:
    """Changed rows and file headers."""
    return diff.kind.count("change"), diff.kind.count("header")


def is_fold_row(row: str) -> bool:
    return row[:1] in ("+", "-", " ") and row[1:].strip() == "..."


def kept_counts(raw: Diff, reading: Diff) -> tuple[int, int]:
    """Changed rows and file headers of ``raw`` that the reading diff's rows stand for.

    Rows are matched in order: each to the next equal row, or to an earlier one that it
    elides.
    """
    places: dict[tuple[str, str], list[int]] = defaultdict(list)
    by_marker: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, row in enumerate(raw.text):
        places[raw.kind[i], row].append(i)
        by_marker[raw.kind[i], row[:1]].append(i)
    following = lambda found, at: found[bisect_left(found, at) :]
    changed = files = at = 0
    for row, kind in zip(reading.text, reading.kind, strict=True):
        if is_fold_row(row):
            changed += row[0] != " "
            continue
        equal = places.get((kind, row), [])
        k = bisect_left(equal, at)
        match = equal[k] if k < len(equal) else None
        if kind in SOURCE and any(p in row[1:] for p in PLACEHOLDERS):
            pattern = elision_pattern(row[1:], strict=False)
            candidates = following(by_marker.get((kind, row[:1]), []), at) if pattern else []
            for i in candidates:
                if match is not None and i >= match:
                    break
                if pattern.fullmatch(raw.text[i][1:]):
                    match = i
                    break
        if match is not None:
            changed += raw.kind[match] == "change"
            files += raw.kind[match] == "header"
            at = match + 1
    return changed, files


def elision_line(raw: str, reading: str) -> str:
    """``kept X/Y changed lines in A/B files`` and its variants; empty without changes."""
    whole = Diff(raw)
    total, files = diff_counts(whole)
    if not total:
        return ""
    if not reading.strip():
        return f"elided all {total} changed lines in {files} files"
    kept, kept_files = kept_counts(whole, Diff(reading))
    where = f" in {kept_files}/{files} files" if kept_files and files else ""
    return f"kept {kept}/{total} changed lines{where}"
