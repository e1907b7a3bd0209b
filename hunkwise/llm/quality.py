"""Operator 5, quality rules and a hashed n-gram classifier.

Rules count words, symbols, repeated lines and repeated word windows of the whole
text. The classifier is a logistic regression over hashed word one- and two-grams
and character three- to five-grams (means over each kind, so that long texts weigh no
more), trained on labelled rows with both labels weighing alike and calibrated on others by
Platt scaling, with the labels weighing as they occur. It is scored in Arrow batches against the
fixed ``threshold``.

Training uses a bounded sample: about ``per_class`` ids of either label, by a
hash of the id, and at most ``4 * per_class`` rows of different texts with these. Each is learned from
whole: the counts of all its n-grams (some KB; of any text, however long, not over one a place) go
to a table and from there, a part of it at a time, to the driver, which holds up to ``HELD`` bytes in memory
and more in a temporary file. The sample's ids are broadcast. Everything else covers all rows, without a shuffle.

Null texts have no words. Very long texts are read ``SEGMENT`` bytes at a time, n-grams and
words across the seams included. Rows with a null id or label are never learned from. A label
that contradicts another of the same id counts as a row of its own. Repeated rows are learned from
once and judged alike; a probability at the threshold is kept. If the labels
have only one class, or are empty, the verdict is the rules' alone (probability 1).
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import codecs
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm._shared import Scratch, lean, text_bytes

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
#: Places of the hashed n-grams of each kind; bits.
BITS = 15
DIM = 1 << BITS
KINDS = ("word1", "word2", "char3", "char4", "char5")
#: Bytes of a text hashed at once, of counts in a worker's batch, sent to the driver at once, and in its memory.
SEGMENT, BATCH, SENT, HELD = 1 << 20, 16 << 20, 64 << 20, 128 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def rules(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated 3-word windows."""
    data = np.frombuffer(text, np.uint8)
    words = text.split()
    space = int(_SPACE[data].sum())
    chars = int(((data & 0xC0) != 0x80).sum()) - space
    lines, dup = set(), 0
    for line in text.split(b"\n"):
        if line in lines:
            dup += 1
        elif line and line.strip():
            lines.add(line)
    repeated = 0
    if len(words) > 3:
        names: dict[bytes, int] = {}
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
        pair = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
        window = pair[:-1] * len(names) + ids[2:]
        _, place, count = np.unique(window, return_inverse=True, return_counts=True)
        twice = count[place] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeated = int(covered.sum())
    return len(words), chars, int(_SYMBOL[data].sum()), dup, repeated


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)


_BASE = 0x100000001B3


def _powers(n: int, cache: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(cache[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            cache[i] = np.multiply.accumulate(steps)
    return cache[0], cache[1]


def grams(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """The places of a text's n-grams, as (kind, places), segment by segment."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    # What the next segment needs: four characters, a word not yet at its end and its characters, the word before.
    tail, head, size, last = (np.zeros(0, np.uint64),) * 2 + (0, np.zeros(0, np.uint64))
    lo = 0
    while lo < len(text):
        more = lo + SEGMENT < len(text)
        part = np.frombuffer(decoder.decode(text[lo : lo + SEGMENT], not more).encode("utf-32-le"), np.uint32).astype(np.uint64)
        lo += SEGMENT
        if not len(part):
            continue
        old = len(tail)
        part = np.concatenate([tail, part]) if old else part
        n = len(part)
        tail = part[-4:]
        power, back = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * power[:n], out=sums[1:])
        # Words, by the runs between white space.
        new = part[old:]
        edge = np.diff(np.concatenate([[True], (new == 32) | (new >= 9) & (new <= 13), [True]]).astype(np.int8))
        start, stop = np.flatnonzero(edge == -1) + old, np.flatnonzero(edge == 1) + old
        word = (sums[stop] - sums[start]) * back[start]
        goes_on = size > 0 and len(start) > 0 and start[0] == old
        if goes_on:
            word[:1] = head + word[:1] * np.uint64(pow(_BASE, size, 1 << 64))
        elif size:
            word = np.concatenate([head, word])
        if more and len(stop) and stop[-1] == n:
            size = int(stop[-1] - start[-1]) + (size if goes_on and len(start) == 1 else 0)
            head, word = word[-1:], word[:-1]
        else:
            size = 0
        yield 0, _mix(word, 1)
        word = np.concatenate([last, word]) if len(last) else word
        if len(word) > 1:
            yield 1, _mix(word[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:], 2)
        last = word[-1:]
        for width in (3, 4, 5):
            first = max(0, old - width + 1)
            if n - first >= width:
                yield width - 1, _mix((sums[first + width :] - sums[first:-width]) * back[first : n - width + 1], width)


@dataclass
class Model:
    weights: np.ndarray  # kinds x DIM
    slope: float
    offset: float

    def probability(self, text: bytes) -> float:
        total, count = np.zeros(len(KINDS)), np.zeros(len(KINDS))
        for kind, places in grams(text):
            total[kind] += self.weights[kind][places].sum(dtype=np.float64)
            count[kind] += len(places)
        z = float((total / np.maximum(count, 1)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30))))


def _features(text: bytes) -> bytes:
    """The counts of all the text's n-grams: where each kind's end, their places, how often each is there."""
    counts = np.zeros((len(KINDS), DIM), np.int64)
    for kind, places in grams(text):
        counts[kind] += np.bincount(places.astype(np.int64), minlength=DIM)
    at = np.flatnonzero(counts)
    seen = counts.ravel()[at]
    ends = np.searchsorted(at, DIM * np.arange(1, len(KINDS) + 1))
    return ends.astype(np.uint32).tobytes() + (at % DIM).astype(np.uint16).tobytes() + seen.astype(np.min_scalar_type(seen.max(initial=0))).tobytes()


def _shares(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places over all kinds with the share of the kind's n-grams there, of what ``_features`` gave."""
    ends = np.frombuffer(data, np.uint32, len(KINDS))
    n, at = int(ends[-1]), ends.nbytes
    place = np.frombuffer(data, np.uint16, n, at)
    seen = np.frombuffer(data, f"u{(len(data) - at) // max(n, 1) - 2}", n, at + 2 * n) if n else place
    kind = np.repeat(np.arange(len(KINDS)), np.diff(ends, prepend=np.uint32(0)))
    return kind * DIM + place, (seen / np.bincount(kind, seen, len(KINDS))[kind]).astype(np.float32)


class Rows(Sequence):
    """Rows of features on the driver, in the order of their keys: (places, shares, label)."""

    def __init__(self, found: Iterator[tuple[tuple, bytes, int]]):
        self.file = tempfile.SpooledTemporaryFile(max_size=HELD)
        self.at = []
        for key, data, y in found:
            self.at.append((key, self.file.tell(), len(data), y))
            self.file.write(data)
        self.at.sort()

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        _, start, size, y = self.at[i]
        self.file.seek(start)
        return *_shares(self.file.read(size)), y


def fit(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], good: float | None = None, epochs: int = 12, rate: float = 2.0) -> Model | None:
    """Logistic regression by adaptive gradient steps; every third row calibrates it.

    ``good`` is the share of good rows among all that are labelled; by default that of ``rows``.
    """
    labels = np.array([y for *_, y in rows], int)
    every = np.arange(len(rows))
    train, check = (every[every % 3 != 2], every[every % 3 == 2]) if len(rows) >= 30 else (every, every)
    if len(set(labels[train])) < 2 or len(set(labels[check])) < 2:
        return None
    w = np.zeros(len(KINDS) * DIM)
    speed = np.full(len(w), 1e-6)
    bias, bias_speed = 0.0, 1e-6
    share = labels[train].sum() / len(train)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(train)):
            at, x, y = rows[train[i]]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + bias, -30, 30)))
            g = (p - y) * (0.5 / share if y else 0.5 / (1 - share))
            step = g * x
            speed[at] += step * step
            w[at] -= rate * step / np.sqrt(speed[at])
            bias_speed += g * g
            bias -= 0.1 * g / bias_speed**0.5
    z = np.array([w[at] @ x + bias for at, x, _ in (rows[i] for i in check)])
    y = labels[check].astype(float)
    good = y.mean() if good is None else good
    weight = np.where(y == 1, good / y.mean(), (1 - good) / (1 - y.mean()))
    # Platt: targets short of 0 and 1, Newton steps with a little damping.
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    design, ab = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ ab, -30, 30)))
        grad = design.T @ (weight * (p - target))
        hess = design.T @ (design * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]) + 1e-3 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(hess, grad), -2, 2)
    slope = float(max(ab[0], 1e-3))
    return Model(w.reshape(len(KINDS), DIM).astype(np.float32), slope, float(ab[1] + slope * bias))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1200, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Train on about ``per_class`` rows of either label."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("y")).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("y") == 1, F.lit(min(1 << 30, (per_class << 30) // counts[1]))).otherwise(F.lit(min(1 << 30, (per_class << 30) // counts[0])))
    picked = known.where(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30)) < share)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_t")).join(F.broadcast(picked), "_id")
    rows = rows.select("_id", "y", F.xxhash64("_t").alias("_th"), "_t")
    keys = ["_id", "y", "_th"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, begin, size = [], 0, 0
            for end, text in enumerate(batch.column(3), 1):
                found.append(_features(text.as_py()))
                size += len(found[-1])
                if end == batch.num_rows or size > BATCH:
                    part = batch.slice(begin, end - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.binary())], names=[*keys, "counts"])
                    found, begin, size = [], end, 0

    # Each row's counts once, in a table that the driver reads a part of at a time: long texts have MBs of them.
    scratch = Scratch(docs.sparkSession, "quality")
    found = scratch.put(rows.mapInArrow(lean(run), "_id long, y int, _th long, counts binary").dropDuplicates(keys), "counts")
    order = F.xxhash64("_id", "_th", F.lit(6)).alias("_o")
    first = found.select(*keys, order, F.length("counts").alias("_n")).orderBy("_o", "_id", "_th", "y").limit(4 * per_class)
    total = first.agg(F.sum("_n")).first()[0] or 0
    got = found.join(F.broadcast(first), keys).select("_o", "_id", "_th", "y", "counts")
    if total > SENT:  # files of like texts are small, however much is in them
        got = got.repartition(1 + total // SENT)
    held = Rows(((o, i, th, y), data, y) for o, i, th, y, data in got.toLocalIterator())
    scratch.drop("counts")
    return fit(held, counts[1] / (counts[0] + counts[1]))


def judge(docs: DataFrame, model: Model | None, threshold: float = 0.5, least_words: int = 50, most_repeated: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, the rules' result, the probability of good quality, and the verdict of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                found = rules(text)
                failed = found[0] < least_words or 100 * found[4] > most_repeated * found[0]
                p = model.probability(text) if model else 1.0
                rows.append((doc, *found, failed, p, not failed and p >= threshold))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 9, kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_t")).mapInArrow(lean(run), SCHEMA)
