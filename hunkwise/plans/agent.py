"""Abridging with a planner: any callable that proposes plans for a diff.

The planner is the one part that isn't deterministic; it is passed in. It gets a
transcript and answers with tool calls; plans are compiled and refused or accepted
as by ``hunkwise.functions.plans``. ``abridge`` handles one diff, ``abridge_all`` a table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.functions import chunks as ch
from hunkwise.functions import plans
from hunkwise.functions.diff import Diff, check, numbered
from hunkwise.functions.moves import Move, find_moves, format_moves
from hunkwise.sources.diffs import cache_load, cache_store, cached, truncated

#: Turns of a run, and its seconds; a turn that would begin later doesn't.
MOST_TURNS, SECONDS = 24, 240.0


@dataclass
class ToolCall:
    name: str  # preview_plan, submit, or one of the caller's tools
    input: str  # JSON
    id: str = ""


@dataclass
class Answer:
    calls: list[ToolCall] = field(default_factory=list)
    text: str = ""
    input_tokens: int = 0
    output_tokens: int = 0


@dataclass
class Message:
    role: str
    text: str = ""
    calls: list[ToolCall] = field(default_factory=list)
    results: list[tuple[str, str, bool]] = field(default_factory=list)  # id, text, whether it is an error


Planner = Callable[[list[Message]], Answer]
Tool = Callable[[str], str]


class AbridgeError(RuntimeError):
    pass


def prompt(raw: str, moves: list[Move]) -> str:
    hint = f"\nExact moves: {format_moves(moves)}" if moves else ""
    return f"Plan how to abridge this diff; rows are numbered.{hint}\n\n{numbered(raw)}"


class _Session:
    """The tools of one run; at most one submission is accepted."""

    def __init__(self, raw: str, moves: list[Move] | None, tools: dict[str, Tool]):
        self.diff, self.moves, self.tools = Diff(raw), moves, tools
        self.accepted: tuple[plans.Compiled, str] | None = None

    def call(self, c: ToolCall) -> tuple[str, bool]:
        try:
            if c.name == "preview_plan":
                return truncated(plans.feedback(plans.compile_plan(self.diff, plans.decode_plan(c.input), self.moves))), False
            if c.name == "submit":
                if self.accepted:
                    return "a submission has already been accepted", True
                plan = plans.decode_plan(c.input, with_summary=True)
                compiled = plans.compile_submission(self.diff, plan, self.moves)
                self.accepted = compiled, plan["summary"]
                return truncated(plans.feedback(compiled)), False
            if c.name in self.tools:
                return truncated(self.tools[c.name](c.input)), False
        except plans.PlanError as e:
            said = str(e)
            return truncated(said if said.startswith("json:") else f"the plan is refused: {said}"), True
        except (ValueError, OSError) as e:
            return str(e), True
        return f"unknown tool {c.name}", True


def _run(planner: Planner, raw: str, moves: list[Move] | None, tools: dict[str, Tool], most_turns: int, seconds: float) -> ch.Result:
    session = _Session(raw, moves, tools)
    shown = find_moves(session.diff) if moves is None else moves
    messages = [Message("user", prompt(raw, shown))]
    spent = [0, 0]
    draft: ch.Result | None = None
    until = time.monotonic() + seconds
    for turn in range(most_turns):
        if time.monotonic() >= until:
            break
        try:
            answer = planner(messages)
        except Exception:
            if draft:
                break  # a draft that was good enough once is better than nothing
            raise
        spent = [spent[0] + answer.input_tokens, spent[1] + answer.output_tokens]
        messages.append(Message("assistant", answer.text, answer.calls))
        results = [(c.id, *session.call(c)) for c in answer.calls]
        if session.accepted:
            compiled, summary = session.accepted
            found = ch.Result(compiled.text, summary, *spent)
            if draft or turn + 1 == most_turns or not compiled.stats.pressure:
                return found
            draft, session.accepted = found, None  # one more look at a plan that keeps very much
        messages.append(Message("user", "" if results else "Answer with a tool call; submit when done.", results=results))
    if draft:
        return ch.Result(draft.smart_diff, draft.summary, *spent)
    raise AbridgeError(f"no submission within {most_turns} turns and {seconds:g} seconds")


def abridge(planner: Planner, raw: str, tools: dict[str, Tool] | None = None, most_turns: int = MOST_TURNS, budget: int = ch.RUN_BYTES, seconds: float = SECONDS) -> ch.Result:
    """One diff abridged; oversized ones chunk by chunk, each within ``most_turns`` and ``seconds``."""
    if not raw.strip():
        return ch.Result("", "No changes.")
    if ch.size(raw) > ch.TOTAL_BYTES:
        raise AbridgeError(f"diff of {ch.size(raw) >> 20} MB, {ch.TOTAL_BYTES >> 20} MB are read; take a narrower range")
    diff = Diff(raw)
    if check(diff):
        raise plans.PlanError(check(diff))
    if ch.fits(raw, budget):
        return _run(planner, raw, None, tools or {}, most_turns, seconds)
    whole = find_moves(diff)
    parts: list[tuple[ch.Chunk, ch.Result | None]] = []
    chunks = ch.split_diff(diff, budget)
    number = total = sum(not c.verbatim for c in chunks)
    for c in chunks:
        if c.verbatim:
            parts.append((c, None))
            continue
        number -= 1
        try:
            parts.append((c, _run(planner, c.text, ch.chunk_moves(whole, c.origins), tools or {}, most_turns, seconds)))
        except Exception as e:
            raise AbridgeError(f"chunk {total - number}/{total}: {e}") from e
    return ch.merge(parts)


def abridge_all(diffs: DataFrame, planner: Planner, most_turns: int = MOST_TURNS) -> DataFrame:
    """``diff_id, smart_diff, summary, input_tokens, output_tokens, error`` of a table of diffs; the planner must pickle."""
    from hunkwise.operators.diffs import each

    def rule(diff_id, raw) -> Iterator[tuple]:
        try:
            r = abridge(planner, raw or "", most_turns=most_turns)
            yield diff_id, r.smart_diff, r.summary, r.input_tokens, r.output_tokens, None
        except Exception as e:  # noqa: BLE001 a planner may fail in any way; other diffs go on
            yield diff_id, None, None, None, None, str(e)

    return each(diffs, ["diff_id", "raw"], rule, "diff_id long, smart_diff string, summary string, input_tokens long, output_tokens long, error string", batch=8)


def abridge_cached(diffs: DataFrame, planner: Planner, folder: str, protocol: str, model: str, most_turns: int = MOST_TURNS) -> DataFrame:
    """``abridge_all`` with a cache in ``folder``: hits are read, misses computed once and stored, errors not stored.

    Diffs with one key are computed once. The result is read from the cache, so nothing is computed twice.
    """
    cache = cache_load(diffs.sparkSession, folder)
    _, misses = cached(diffs, cache, protocol, model)
    once = misses.groupBy("cache_key").agg(F.min_by("raw", "diff_id").alias("raw"), F.min("diff_id").alias("diff_id"))
    made = abridge_all(once.select("diff_id", "raw"), planner, most_turns).join(once.select("diff_id", "cache_key"), "diff_id")
    cache_store(made.select("cache_key", "smart_diff", "summary", "input_tokens", "output_tokens", "error"), folder)
    hits, failed = cached(diffs, cache_load(diffs.sparkSession, folder, with_errors=True), protocol, model)
    return hits.select("diff_id", "smart_diff", "summary", "input_tokens", "output_tokens", "error")
