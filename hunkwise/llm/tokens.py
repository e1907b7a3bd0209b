"""Operator 4, token counts attributed to sections by offsets.

A whole document is encoded once, so that counts add up to the document's; the
byte spans of its tokens are then interval-joined to its sections, both sorted, by
binary search. A token that crosses a section's end goes, by ``rule``, to the
section of its ``first`` byte, of its ``last`` byte, or to the one with ``most`` of
its bytes (of equals the first).

Sections are by default a document's lines, line end included, so they cover it.
``sections`` may instead name fields that are joined by ``\\n`` to one text.

The tokenizer is byte-level: a token is a run of the text's bytes, so the offsets are
exact, also within characters.

Null and empty texts have one empty section with no tokens. Very long texts are encoded
whole. Rows are counted on their own, whatever their ids, null and repeated ones alike. Empty
tables give no rows. Extra columns are ignored. No shuffle; memory is bounded by a batch of texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm._shared import lean

SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, doc_tokens long"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class SpanEncoder:
    """Byte lengths of the tokens of texts."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("spans", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.width = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.width[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        """The token ids of a text."""
        return np.array(self.encoding.encode_ordinary(text), np.int32)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each token."""
        stop = np.cumsum(self.width[self.ids(text)])
        return np.concatenate([[0], stop[:-1]]) if len(stop) else stop, stop


_ENCODERS: dict[tuple[str, str], SpanEncoder] = {}


def span_encoder(ranks: str, pattern: str) -> SpanEncoder:
    if (ranks, pattern) not in _ENCODERS:
        _ENCODERS[ranks, pattern] = SpanEncoder(ranks, pattern)
    return _ENCODERS[ranks, pattern]


def attribute(starts: np.ndarray, stops: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; ``sections`` are the sections' first bytes and the text's end."""
    n = len(sections) - 1
    first = np.searchsorted(sections, starts, "right") - 1
    if rule == "first":
        owner = first
    else:
        last = np.searchsorted(sections, stops - 1, "right") - 1
        owner = last
        if rule == "most":
            owner = first.copy()
            for i in np.flatnonzero(last > first):
                ends = np.minimum(sections[first[i] + 1 : last[i] + 2], stops[i])
                begins = np.maximum(sections[first[i] : last[i] + 1], starts[i])
                owner[i] = first[i] + int(np.argmax(ends - begins))
    # An empty section shares its first byte with the next one and gets nothing.
    return np.bincount(owner, minlength=n)[:n] if n else np.zeros(0, np.int64)


def line_sections(data: bytes) -> np.ndarray:
    """First bytes of the lines, and the end."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    inner = ends[ends < len(data)]
    return np.concatenate([[0], inner, [len(data)]]).astype(np.int64)


def count_tokens(docs: DataFrame, sections: list[str] | None = None, rule: str = "first", ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per section: its place in characters, its tokens and its document's tokens."""
    if rule not in ("first", "last", "most"):
        raise ValueError(f"unknown rule {rule!r}")
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sections or [text_col]]
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.array(*fields).alias("_f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = span_encoder(ranks, pattern)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = "\n".join(parts)
                data = text.encode("utf-8", "surrogatepass")
                starts, stops = enc.spans(text)
                if sections:
                    sizes = [len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts]
                    at = np.minimum(np.concatenate([[0], np.cumsum(sizes)]), len(data))
                else:
                    at = line_sections(data)
                counts = attribute(starts, stops, at, rule)
                # Bytes to characters: what is not a continuation byte begins one.
                points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[at]
                n = len(at) - 1
                for c, x in zip(out, ([doc] * n, range(n), points[:-1].tolist(), points[1:].tolist(), counts.tolist(), [len(starts)] * n), strict=True):
                    c.extend(x)
                if len(out[0]) >= 50_000:
                    yield _rows(out)
                    out = [[], [], [], [], [], []]
            yield _rows(out)

    return rows.mapInArrow(lean(run), SCHEMA)


def _rows(out: list[list]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
