"""What surrounds a planner: the plan's schema, identities, retries, event streams, progress."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable
from typing import Any

from hunkwise.plans.agent import Message, ToolCall

# Attempts of a call, statuses worth another one.
ATTEMPTS, FIRST_WAIT = 4, 1.0
RETRIED = frozenset((408, 429))


def _objects(about: str, **fields: dict) -> dict:
    item = {"type": "object", "additionalProperties": False, "properties": fields, "required": list(fields)}
    return {"type": "array", "description": about, "items": item}


def plan_schema(with_summary: bool = False) -> dict:
    """JSON Schema of a plan."""
    row = {"type": "integer", "minimum": 1}
    lists: dict[str, dict] = {
        "remove": _objects("Rows to leave out, as inclusive ranges of original row numbers.", start_line=row, end_line=row),
        "replace": _objects("Spans of one row in which ... or … stands for what is left out.", line=row, old={"type": "string", "minLength": 1}, new={"type": "string"}),
        "fold": _objects("Two or more source rows of one marker, shown as one ... row.", start_line=row, end_line=row),
    }
    if with_summary:
        lists["summary"] = {"type": "string", "description": "What the change does, in one line."}
    return {"type": "object", "additionalProperties": False, "properties": lists, "required": list(lists)}


def protocol_hash(*parts: str) -> str:
    """A short hash of all text that a planner sees, for cache keys."""
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]


def identity(provider: str = "", model: str = "", default: tuple[str, str] = ("api", "")) -> str:
    """``provider:model`` of given, environment's or default values."""
    provider = (provider or os.environ.get("HUNKWISE_PROVIDER") or default[0]).strip().lower()
    model = model or os.environ.get("HUNKWISE_MODEL") or default[1]
    return f"{provider}:{model or 'configured'}"


class CallFailed(RuntimeError):
    def __init__(self, status: int | None, text: str):
        super().__init__(text if status is None else f"API {status}: {text.strip()}")
        self.status = status

    @property
    def worth_retrying(self) -> bool:
        return self.status is None or self.status in RETRIED or self.status >= 500


def with_retries(call: Callable[[], Any], attempts: int = ATTEMPTS, wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The call's value; transport errors, rate limits and server errors are tried again, each time twice as late."""
    last: CallFailed | None = None
    for n in range(attempts):
        if n:
            sleep(wait * 2 ** (n - 1))
        try:
            return call()
        except CallFailed as e:
            if not e.worth_retrying:
                raise
            last = e
    raise CallFailed(None, f"after {attempts} attempts: {last}")


def events(lines: Iterable[str]) -> list[dict]:
    """The JSON events of a server-sent stream: data rows up to a blank row are one event."""
    found, data = [], []
    for line in [*lines, ""]:
        line = line.rstrip("\r\n")
        if line.startswith("data:"):
            data.append(line[5:].strip())
        elif not line and data:
            text = "\n".join(data)
            data = []
            if text != "[DONE]":
                found.append(json.loads(text))
    return found


def final_response(body: str) -> dict:
    """The response of a body that is one JSON object or a stream; items come in their stated order."""
    body = body.strip()
    if not body:
        raise ValueError("empty response")
    if body.startswith("{"):
        return json.loads(body)
    items: dict[int, Any] = {}
    final = None
    for e in events(body.split("\n")):
        kind = e.get("type", "")
        if kind == "response.output_item.done" and e.get("item"):
            items[e.get("output_index", 0)] = e["item"]
        elif kind in ("response.completed", "response.incomplete", "response.failed"):
            final = e.get("response") or final
        elif kind == "error":
            raise ValueError(f"stream error {e.get('code')}: {e.get('message')}")
    if final is None:
        raise ValueError("the stream ended without a final response")
    return final | ({"output": [items[i] for i in sorted(items)]} if items else {})


def describe(call: ToolCall) -> str:
    """A tool call as a word of progress."""
    try:
        given = json.loads(call.input or "{}")
    except ValueError:
        given = {}
    words = {
        "read_file": lambda: f"read_file {given.get('path', '')}",
        "grep": lambda: f"grep {json.dumps(given.get('pattern', ''), ensure_ascii=False)}",
        "preview_plan": lambda: "previewing",
        "submit": lambda: "submitting",
    }
    return words.get(call.name, lambda: call.name)().strip()


def transcript_rows(conv_id: int, messages: list[Message]) -> list[tuple]:
    """Messages as rows ``conv_id, turn, role, type, text, tool_name, tool_input, tool_result, tool_error``."""
    rows: list[tuple] = []
    for turn, m in enumerate(messages):
        if m.text:
            rows.append((conv_id, turn, m.role, "text", m.text, None, None, None, None))
        rows += [(conv_id, turn, m.role, "tool_use", None, c.name, c.input, None, None) for c in m.calls]
        rows += [(conv_id, turn, m.role, "tool_result", None, None, None, text, bad) for _, text, bad in m.results]
    return rows


def as_prompt(system: str, messages: list[Message]) -> str:
    """A transcript as one text, for planners without turns."""
    parts = [system] if system else []
    for m in messages:
        said = [m.text] if m.text else []
        said += [f"<call {c.name}> {c.input}" for c in m.calls] + [f"<{'error' if bad else 'result'}> {text}" for _, text, bad in m.results]
        parts.append(f"[{m.role}]\n" + "\n".join(said))
    return "\n\n".join(parts)
