"""Operator 3, language ID with a blended-spectrum string kernel.

A text is the set of its byte n-grams of one to four bytes, hashed to ``DIM``
places (upper-case ASCII lowered). The kernel of two texts is the number of common
n-grams over the root of the product of their numbers. A text of more than ``PART``
bytes is cut into equal parts of at most that, as a longer text's set would fill all
places; its values are the means of its parts' values, over the whole text. ``landmarks`` training texts
span the Nyström features; on them a ridge regression is fitted for each
language against the rest. As the kernel is linear in a text's set up to its norm,
landmarks, Nyström map and weights are multiplied into one matrix; texts
are scored by matrix products of whole batches with it.

Fitting uses a bounded sample: about ``per_lang`` rows of each of the ``most_langs`` most frequent
languages, chosen by a hash of the id; their sets (a few KB each, of a long text those of ``LEARNED`` parts
spread over it) are collected. Everything else covers all rows, without a shuffle.

Null texts and texts without a letter (Unicode category L) are ``und`` with score and value 0. Rows with a
null id or null language, and held-out rows, are never learned from; a null id is not held
out. Repeated rows are learned from as often as they come and predicted alike. Of languages that tie the
first by name is predicted; of languages as frequent the first by name are learned. Without anything to learn
from every row is ``und``. With one language all texts with a letter are of it. Extra columns are ignored by
``predict`` and kept by ``recognised``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm._shared import lean

#: Places of the hashed n-gram sets; bits.
BITS = 14
DIM = 1 << BITS
#: Bytes of a text that share a set, parts of a long text to learn from.
PART, LEARNED = 8192, 8
#: Bytes of a text hashed at once.
SEGMENT = 1 << 20
#: Sharpness of the scores: they are the softmax of this times the regression's values.
SHARPNESS = 6.0

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A letter, as Spark's regular expressions know it.
_LETTER = r"\p{L}"


def gram_set(text: bytes, out: np.ndarray) -> None:
    """Set the places of the text's n-grams in ``out`` to one."""
    data = np.frombuffer(text.translate(_LOWER), np.uint8)
    for lo in range(0, len(data), SEGMENT):
        code = np.zeros(len(data[lo : lo + SEGMENT + 3]) + 1, np.uint32)
        part = data[lo : lo + SEGMENT + 3].astype(np.uint32)
        for n in range(1, 5):
            if len(part) < n:
                break
            code = (code[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
            salted = (code ^ np.uint32(n * 0x3C6EF372)) * np.uint32(2654435761)
            out[(salted ^ (salted >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - BITS)] = 1


def parts(text: bytes) -> list[tuple[int, int]]:
    """The ranges of a text's parts; n-grams that begin in a part belong to it."""
    n = max(1, -(-len(text) // PART))
    ends = [len(text) * i // n for i in range(n + 1)]
    return [(a, min(len(text), b + 3)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


@dataclass
class Model:
    langs: list[str]
    matrix: np.ndarray  # DIM x languages

    def values(self, sets: np.ndarray) -> np.ndarray:
        return (sets @ self.matrix) / np.sqrt(np.maximum(sets.sum(axis=1, keepdims=True), 1))

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Values of each text, the means of its parts', and their softmax."""
        total = np.zeros((len(texts), len(self.langs)))
        todo = [(i, a, b) for i, t in enumerate(texts) for a, b in parts(t)]
        for lo in range(0, len(todo), 128):
            some = todo[lo : lo + 128]
            sets = np.zeros((len(some), DIM), np.float32)
            for row, (i, a, b) in zip(sets, some, strict=True):
                gram_set(texts[i][a:b], row)
            np.add.at(total, [i for i, _, _ in some], self.values(sets))
        total /= np.maximum(np.bincount([i for i, _, _ in todo], minlength=len(texts)), 1)[:, None]
        z = np.exp(SHARPNESS * (total - total.max(axis=1, keepdims=True)))
        return total, z / z.sum(axis=1, keepdims=True)


def _unit_sets(packed: np.ndarray) -> np.ndarray:
    """Sets of packed bits as rows of length one."""
    x = np.unpackbits(packed, axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    return x


def fit(packed: np.ndarray, langs: list[str], landmarks: int = 400, ridge: float = 1e-2) -> Model | None:
    """One-versus-rest kernel ridge regression on Nyström features; a row of ``packed`` has a set's bits."""
    names = sorted(set(langs))
    if not names:
        return None
    # Landmarks: the first rows of each language in turn.
    seen: dict[str, int] = {}
    turn = []
    for i, name in enumerate(langs):
        seen[name] = seen.get(name, 0) + 1
        turn.append((seen[name], i))
    marks = _unit_sets(packed[[i for _, i in sorted(turn)[:landmarks]]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # the landmarks' kernel to the power of -1/2
    # The kernel with the landmarks, by blocks: the sets' bits are never unpacked all at once.
    kernel = [_unit_sets(packed[lo : lo + 256]) @ marks.T for lo in range(0, len(langs), 256)]
    phi = np.concatenate(kernel).astype(np.float64) @ root
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = np.array([1 / seen[name] for name in langs])[:, None]  # languages count alike
    weight /= weight.mean()
    w = np.linalg.solve(phi.T @ (phi * weight) + ridge * len(langs) * np.eye(phi.shape[1]) / 10, phi.T @ (target * weight))
    return Model(names, (marks.T @ (root @ w)).astype(np.float32))


def held_out(id_col: str):
    """Whether the checksum of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _set_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, packed = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text.encode("utf-8", "surrogatepass")
            of = parts(text)
            for a, b in of if len(of) <= LEARNED else [of[len(of) * k // LEARNED] for k in range(LEARNED)]:
                found = np.zeros(DIM, np.uint8)
                gram_set(text[a:b], found)
                langs.append(lang)
                packed.append(np.packbits(found).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(packed, pa.binary())], names=["lang", "bits"])


def learn(docs: DataFrame, per_lang: int = 1000, landmarks: int = 400, most_langs: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on about ``per_lang`` rows of each language that are not held out."""
    usable = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << 30)).alias("dice")
    )
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs)
    share = F.broadcast(counts.select("lang", (F.lit(per_lang << 30) / F.col("count")).alias("share")))  # ``most_langs`` rows
    rows = usable.join(share, "lang").where((F.col("dice") < F.col("share")) & F.col("text").rlike(_LETTER)).select("lang", "text").mapInArrow(lean(_set_task), "lang string, bits binary").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1])[::-1]))
    if not rows:
        return None
    packed = np.frombuffer(b"".join(bytes(r[1]) for r in rows), np.uint8).reshape(len(rows), -1)
    return fit(packed, [r[0] for r in rows], landmarks)


def _predict_task(held):
    """``lang_pred, score, value`` before the columns that follow the text and whether it has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            langs, scores, tops = [], [], []
            for lo in range(0, batch.num_rows, 128):
                part = batch.column(0).slice(lo, 128).to_pylist()
                ok = batch.column(1).slice(lo, 128).to_pylist() if model else [False] * len(part)
                values, chances = model.scores([t.encode("utf-8", "surrogatepass") if good else b"" for t, good in zip(part, ok, strict=True)]) if model else (None, None)
                for i, good in enumerate(ok):
                    best = int(values[i].argmax()) if good else 0
                    langs.append(model.langs[best] if good else "und")
                    scores.append(float(chances[i, best]) if good else 0.0)
                    tops.append(float(values[i, best]) if good else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(tops, pa.float64()), *batch.columns[2:]], names=["lang_pred", "score", "value", *batch.schema.names[2:]])

    return run


def _rows(docs: DataFrame, text_col: str) -> list:
    text = F.col(text_col).cast("string")
    return [text.alias("_t"), F.coalesce(text.rlike(_LETTER), F.lit(False)).alias("_l")]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, value`` of every row; ``value`` is the winning regression's."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIM times languages numbers
    rows = docs.select(*_rows(docs, text_col), F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"))
    return rows.mapInArrow(lean(_predict_task(held)), "lang_pred string, score double, value double, doc_id long, held_out boolean").select("doc_id", "held_out", "lang_pred", "score", "value")


def recognised(docs: DataFrame, model: Model | None, langs: list[str] | None = None, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that a language's regression against the rest claims.

    That is with a winning value over ``least``, in one of ``langs`` if given. Without a model no row is.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*_rows(docs, text_col), *[F.col(c).alias(p) for c, p in zip(docs.columns, place, strict=True)])
    kinds = "".join(f", {p} {f.dataType.simpleString()}" for p, f in zip(place, docs.schema.fields, strict=True))
    found = rows.mapInArrow(lean(_predict_task(held)), "lang_pred string, score double, value double" + kinds).where((F.col("lang_pred") != "und") & (F.col("value") > least))
    if langs is not None:
        found = found.where(F.col("lang_pred").isin(langs))
    return found.select(*[F.col(p).alias(c) for c, p in zip(docs.columns, place, strict=True)])


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learn from the rows that are not held out, then predict every row."""
    return predict(docs, learn(docs, **options))
