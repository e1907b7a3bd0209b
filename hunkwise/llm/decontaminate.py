"""Operator 6, benchmark decontamination with one Aho-Corasick automaton.

Items (test questions and answers) are normalised to lower-case words; every
window of ``window`` consecutive words (a shorter item: all of it) is a
pattern. The automaton reads word numbers, not characters: overlapping windows then
cost a node or less for each of their words. Its goto table is one sorted array of
``(node, word)``, its failure links are found level by level. Each text is normalised
the same way and scanned once; stretches without a pair of neighbouring words that some
item has leave the automaton at its root, so they are passed over. Hits come back as word
indices and as character spans of the original text.

The automaton is built in each Python worker from the items, which the driver
collects and broadcasts, ``part_bytes`` of normalised item text at a time (4 MB
take about 190 MB in a worker, 480 MB while it builds). A larger benchmark has several automata; a worker reads its texts
once, ``TOGETHER`` bytes at a time, and passes them through one after the other, so that
the rows do not depend on the number of parts. Items of any length are cut into
pieces that overlap by a window less a word.

Null texts have no words and are never contaminated; items without words are
never found; an empty benchmark or table is allowed. Very long texts are numbered by
pieces of ``SEGMENT`` bytes. Repeated rows are judged alike. Items that share an
id count once. Null item ids are found but not listed. Extra columns are ignored by ``find``
and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm._shared import lean, text_bytes

SCHEMA = "doc_id long, n_words long, words array<int>, items array<string>, spans array<struct<start:int,end:int>>"
#: A word: bytes that are no ASCII but letters and digits; upper case is lowered.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
#: Normalised bytes of the items of one automaton.
PART_BYTES = 4 << 20
#: Words of a piece of a long item, bytes of a text numbered at once, bytes of texts scanned together.
PIECE, SEGMENT, TOGETHER = 1 << 15, 1 << 20, 64 << 20
#: Words scanned together, steps of a stretch before it is cut.
WORDS, STEPS = 1 << 20, 256


def normalise(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Automaton:
    """Aho-Corasick over the word numbers of the windows of some items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        found, owner = [], []
        for name, text in items:
            words = normalise(text)
            if not words:
                continue
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words), np.int32, len(words))
            if len(ids) >= window:
                found.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            else:
                found.append(np.pad(ids, (0, window - len(ids)), constant_values=-1)[None])
            owner.append(np.full(len(found[-1]), number.get(name, -1), np.int32))
        self.reach = window - 1
        self.base = np.uint64(len(self.vocabulary) + 1)
        self._build(np.concatenate(found) if found else np.zeros((0, window), np.int32), np.concatenate(owner) if owner else np.zeros(0, np.int32))

    def _build(self, patterns: np.ndarray, owner: np.ndarray) -> None:
        # Nodes are numbered by levels, so the keys (parent, word) of all levels together are sorted.
        node, keys, ends = np.zeros(len(patterns), np.int64), [np.zeros(0, np.uint64)], [0, 1]
        for k in range(patterns.shape[1]):
            live = np.flatnonzero(patterns[:, k] >= 0)
            level, at = np.unique(node[live].astype(np.uint64) * self.base + patterns[live, k].astype(np.uint64), return_inverse=True)
            node[live] = ends[-1] + at
            keys.append(level)
            ends.append(ends[-1] + len(level))
        self.keys = np.concatenate(keys)
        n = len(self.keys) + 1
        self.root = np.zeros(int(self.base), np.int32)  # the last place is the unknown word's
        first = self.keys[: ends[2] - 1] if len(ends) > 2 else self.keys[:0]
        self.root[first.astype(np.int64)] = np.arange(1, len(first) + 1)
        self.depth = np.repeat(np.arange(len(ends) - 1, dtype=np.int16), np.diff(ends))
        self.fail, self.link = np.zeros(n, np.int32), np.zeros(n, np.int32)
        # Owners of the patterns that end at a node, as one array with bounds.
        pair = np.unique(node.astype(np.int64) << 32 | (owner.astype(np.int64) + 1)) if len(node) else np.zeros(0, np.int64)
        self.owners = (pair & 0xFFFFFFFF).astype(np.int32) - 1
        self.bounds = np.searchsorted(pair >> 32, np.arange(n + 1)).astype(np.int32)
        ends_here = np.diff(self.bounds) > 0
        for a, b in zip(ends[2:-1], ends[3:], strict=True):
            key = self.keys[a - 1 : b - 1]
            parent, word = (key // self.base).astype(np.int64), (key % self.base).astype(np.int64)
            fail = self.step(self.fail[parent], word)
            self.fail[a:b] = fail
            self.link[a:b] = np.where(ends_here[fail], fail, self.link[fail])
        self.says = ends_here | (self.link > 0)
        # Which pairs of neighbouring words may be in a pattern, by hash: at times also one that isn't.
        pairs = np.unique(np.concatenate([self._pair(patterns[:, k], patterns[:, k + 1])[patterns[:, k + 1] >= 0] for k in range(patterns.shape[1] - 1)] or [np.zeros(0, np.uint64)]))
        self.bits = np.uint64(min(26, max(10, int(16 * len(pairs)).bit_length())))
        self.pairs = np.zeros(1 << int(self.bits), bool)
        self.pairs[self._place(pairs)] = True

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64).astype(np.uint64) * self.base + b.astype(np.int64).astype(np.uint64)

    def _place(self, pair: np.ndarray) -> np.ndarray:
        x = pair * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> (np.uint64(64) - self.bits)

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The state after one more word: along failure links until a node has it."""
        out, at, now = np.zeros(len(state), np.int64), np.arange(len(state)), state.astype(np.int64)
        while len(at):
            top = now == 0
            out[at[top]] = self.root[word[at[top]]]
            at, now = at[~top], now[~top]
            key = now.astype(np.uint64) * self.base + word[at].astype(np.uint64)
            place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            has = self.keys[place] == key if len(key) else np.zeros(0, bool)
            out[at[has]] = place[has] + 1
            at, now = at[~has], self.fail[now[~has]].astype(np.int64)
        return out

    def ids(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words, -1 for a word that no item has."""
        low, at, out = text.translate(_NORMAL), 0, []
        while at < len(low):
            end = low.find(b" ", at + SEGMENT)
            words = low[at : len(low) if end < 0 else end].split()
            out.append(np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words)))
            at = len(low) if end < 0 else end
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def scan(self, texts: list[np.ndarray]) -> list[tuple[np.ndarray, set[str]]]:
        """Of each text of word numbers the indices of the words that are hit, and the items found."""
        out: list[tuple[np.ndarray, set[str]]] = []
        lo = 0
        while lo < len(texts):
            hi, n = lo + 1, len(texts[lo])
            while hi < len(texts) and n + len(texts[hi]) <= WORDS:
                n += len(texts[hi])
                hi += 1
            out += self._scan(texts[lo:hi])
            lo = hi
        return out

    def _scan(self, texts: list[np.ndarray]) -> list[tuple[np.ndarray, set[str]]]:
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        words = np.concatenate(texts).astype(np.int64)
        state = self.root[words].astype(np.int64)  # of a text's first word, and wherever a stretch begins
        ends, nodes = [], []

        def note(at: np.ndarray, now: np.ndarray) -> None:
            loud = self.says[now]
            at, now = at[loud], now[loud]
            while len(now):
                own = self.bounds[now + 1] > self.bounds[now]
                ends.append(at[own])
                nodes.append(now[own])
                now = self.link[now].astype(np.int64)
                at, now = at[now > 0], now[now > 0]

        note(np.arange(len(words)), state)
        near = np.zeros(len(words) + 1, bool)
        if len(words):
            known = (words[:-1] >= 0) & (words[1:] >= 0)
            near[1:-1][known] = self.pairs[self._place(self._pair(words[:-1][known], words[1:][known]))]
            near[starts[:-1][starts[:-1] < len(words)]] = False
        edge = np.flatnonzero(np.diff(near.astype(np.int8)))
        first, stop = edge[::2] + 1, edge[1::2] + 1
        # Stretches are cut: what comes before the last ``reach`` words has no part in a state.
        many = -(-(stop - first) // STEPS)
        turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begin = np.maximum(np.repeat(first, many) + turn * STEPS - self.reach, np.repeat(first, many))
        until = np.minimum(np.repeat(first, many) + (turn + 1) * STEPS, np.repeat(stop, many))
        now = state[begin - 1]
        while len(begin):
            now = self.step(now, words[begin])
            note(begin, now)
            begin = begin + 1
            live = begin < until
            begin, until, now = begin[live], until[live], now[live]
        at, node = np.concatenate(ends or [words[:0]]), np.concatenate(nodes or [words[:0]])
        turns = np.zeros(len(words) + 1, np.int64)
        np.add.at(turns, at - self.depth[node] + 1, 1)
        np.add.at(turns, at + 1, -1)
        hit = np.cumsum(turns)[:-1] > 0
        text = np.searchsorted(starts, at, "right") - 1
        seen: list[set[str]] = [set() for _ in texts]
        for t, v in np.unique(np.stack([text, node]), axis=1).T.tolist():
            seen[t].update(self.names[i] for i in self.owners[self.bounds[v] : self.bounds[v + 1]].tolist() if i >= 0)
        return [(np.flatnonzero(hit[a:b]), s) for a, b, s in zip(starts[:-1].tolist(), starts[1:].tolist(), seen, strict=True)]


def char_spans(text: bytes, hit: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of hit words as code point spans of the original text."""
    if not len(hit):
        return []
    low = text.translate(_NORMAL)
    places, at = [], 0
    for w in low.split():
        at = low.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    runs: list[list[int]] = []
    for i in hit:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    points = lambda b: len(text[:b].decode("utf-8", "replace"))
    return [(points(places[a][0]), points(places[b][1])) for a, b in runs]


def _piece_task(window: int):
    """Items as normalised words, long ones in pieces that overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bodies = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = normalise(text.as_py())
                for lo in range(0, max(1, len(words) - window + 1) if words else 0, PIECE):
                    names.append(name)
                    bodies.append(b" ".join(words[lo : lo + PIECE + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["name", "body"])

    return run


def _parts(docs: DataFrame, benchmark: DataFrame, window: int, part_bytes: int, item_col: str, item_text_col: str) -> list[tuple]:
    """Broadcasts of about ``part_bytes`` of items each, with a tag of their content."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("name"), text_bytes(item_text_col).alias("body"))
    pieces = rows.mapInArrow(lean(_piece_task(window)), "name string, body binary").distinct()
    total = pieces.agg(F.sum(F.octet_length("body"))).head()[0] or 0
    parts = max(1, -(-total // part_bytes))
    out = []
    for p in range(parts):
        part = pieces.where(F.pmod(F.xxhash64("name", "body"), F.lit(parts)) == p) if parts > 1 else pieces
        held = sorted(((r[0], bytes(r[1])) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        tag = hashlib.sha1(repr((held, window)).encode()).hexdigest()
        out.append((docs.sparkSession.sparkContext.broadcast(held), tag))
    return out


_BUILT: dict[str, Automaton] = {}


def _automaton(held, tag: str, window: int) -> Automaton:
    """The worker's automaton; only the last one is kept."""
    if tag not in _BUILT:
        _BUILT.clear()
        _BUILT[tag] = Automaton(held.value, window)
    return _BUILT[tag]


def _judged(parts: list[tuple], window: int, texts: list[bytes]) -> list[tuple[int, np.ndarray, set[str]]]:
    """Words, hit words and items of each text, by all automata."""
    out: list[tuple[int, np.ndarray, set[str]]] = []
    for held, tag in parts:
        auto = _automaton(held, tag, window)
        ids = [auto.ids(t) for t in texts]
        found = auto.scan(ids)
        if not out:
            out = [(len(i), hit, items) for i, (hit, items) in zip(ids, found, strict=True)]
        else:
            out = [(n, np.union1d(hit, more) if len(more) else hit, items | others) for (n, hit, items), (more, others) in zip(out, found, strict=True)]
    return out


def _groups(batches: Iterator[pa.RecordBatch], at: int, many: bool) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Slices of batches with their texts; with several automata so many together that building them pays."""
    most = TOGETHER if many else TOGETHER >> 3
    held: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        lo = 0
        for i, t in enumerate(batch.column(at)):
            t = t.as_py()
            texts.append(t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= most:
                yield [*held, batch.slice(lo, i + 1 - lo)], texts
                held, texts, size, lo = [], [], 0, i + 1
        if lo < batch.num_rows:
            held.append(batch.slice(lo))
    if texts:
        yield held, texts


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document row: ``doc_id, n_words``, hit word indices, items found, hit spans."""
    parts = _parts(docs, benchmark, window, part_bytes, item_col, item_text_col)
    names = ["doc_id", "n_words", "words", "items", "spans"]
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _groups(batches, 1, len(parts) > 1):
            found = _judged(parts, window, texts)
            spans = [[{"start": a, "end": b} for a, b in char_spans(t, hit.tolist())] for t, (_, hit, _) in zip(texts, found, strict=True)]
            cols = [[n for n, _, _ in found], [hit for _, hit, _ in found], [sorted(items) for _, _, items in found], spans]
            ids = pa.concat_arrays([b.column(0) for b in held])
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("_text")).mapInArrow(lean(run), SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``find`` with the digest columns: n_hit, n_items, items_sha256, contaminated."""
    found = find(docs, benchmark, **options)
    return found.select(
        "doc_id", "n_words", F.size("words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("words") > 0).alias("contaminated"), "spans",
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, part_bytes: int = PART_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without a hit, with all their columns, in the order they come."""
    at = docs.columns.index(text_col)
    parts = _parts(docs, benchmark, window, part_bytes, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _groups(batches, at, len(parts) > 1):
            good = [not len(hit) for _, hit, _ in _judged(parts, window, texts)]
            lo = 0
            for batch in held:
                yield batch.filter(pa.array(good[lo : lo + batch.num_rows], pa.bool_()))
                lo += batch.num_rows

    return docs.mapInArrow(lean(run), docs.schema)
