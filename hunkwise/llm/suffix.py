"""Operator 2, exact substring dedup by bucket-pointer refinement.

Every byte covered by a ``length``-byte string that also starts anywhere else is
removed. Sorting all suffixes would shuffle many times the input, so the strings
are first dealt to initial q-gram buckets:

1. Each string of ``length`` bytes has one pointer, its least q-gram (by hash; of
   equals the leftmost). Equal strings have equal pointers, and neighbouring strings
   mostly share one, so a text has about ``2 / (length - q)`` pointers a byte.
   A pointer's bucket is its q-gram's hash; its context are the bytes of
   all strings that it stands for.
2. Buckets with one pointer are done. Of the others, contexts that occur as a
   whole at least twice are removed whole; that takes only counts. Pointers of a batch are
   grouped by bucket and context before anything is shuffled, so that a context of many
   copies is a row for each batch, and its copies within a batch need no join.
3. The contexts that remain in a bucket are suffix-sorted together (``refine``): from their first
   bytes on, buckets are refined by sorting on the bucket pointers of a later offset, which
   at once count for the buckets that are still to be refined; neighbours in the order that agree on
   ``length`` bytes are repeats. A bucket of more contexts than a task should take
   (``TASK_CONTEXTS``) is refined by tables in the same sense: contexts are cut by the distance of
   their strings to the pointer, a cut's bucket is that of the bytes that its strings share, and of cuts that
   still differ within a bucket each string gets its own. A bucket is then a key that is counted, aggregated
   before it is shuffled.

Texts join by id and hash. Null texts are empty; texts shorter than ``length`` stay
whole; very long ones are read ``SEGMENT`` bytes at a time. Of equal q-grams the leftmost is the pointer. Rows
equal in id and text (null ids too) get the same result, and each counts as an occurrence. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm._shared import Scratch, lean, row_key, text_bytes

#: Bytes of the initial q-grams.
GRAM = 40
#: Different contexts of a bucket that are refined in one task; in how many turns a pass takes its buckets.
TASK_CONTEXTS, TURNS = 512, 4
#: Strings of a cut of a context in a larger bucket.
CUT = 20
#: Bytes of contexts refined together.
TOGETHER = 1 << 20
#: Bytes of a text handled together (with overlaps), so that memory is bounded.
SEGMENT = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        steps = np.full(size, _BASE, np.uint64)
        back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        steps[0] = back[0] = 1
        _TABLES[size] = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    return _TABLES[size]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram``-byte string of ``data``."""
    power, back = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * back[: len(data) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, from block-wise running minima."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def pointers(text: bytes, length: int, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """``(bucket, context hash, first, last)``: the strings from first to last share a pointer."""
    out: list[tuple[int, int, int, int]] = []
    strings = len(text) - length + 1
    for lo in range(0, strings, SEGMENT):
        hi = min(strings, lo + SEGMENT)
        data = np.frombuffer(text, np.uint8, hi - 1 - lo + length, lo)
        h = gram_hashes(data, gram)
        places = np.arange(len(h), dtype=np.uint64)
        # High bits order the q-grams; of equals the leftmost is least.
        least = _window_min((h & ~np.uint64(0xFFFFFF)) | places, length - gram + 1)
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        last = np.append(first[1:] - 1, len(at) - 1)
        view = memoryview(text)
        for b, a, z in zip(h[at[first]].view(np.int64).tolist(), (first + lo).tolist(), (last + lo).tolist(), strict=True):
            out.append((b, xxhash.xxh3_64_intdigest(view[a : z + length], 7) - (1 << 63), a, z))
    return out


def _heads(data: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The first eight bytes from each place on as a number; what is past its context's end counts as zero."""
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        later = np.zeros(len(data), np.uint64)
        later[: len(data) - k] = data[k:]
        later[room <= k] = 0
        out = out << np.uint64(8) | later
    return out


def suffix_order(data: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """All places of ``data`` in the order of their first ``length`` bytes at least, by bucket pointers.

    ``room`` are the bytes from each place to its context's end. A bucket's pointer is the place of its
    last member in the order, so refining one bucket leaves all other pointers as they are.
    """
    head = _heads(data, room)
    order = np.argsort(head)
    head = head[order]
    ends = np.flatnonzero(np.append(head[1:] != head[:-1], True)) if len(head) else np.zeros(0, np.int64)
    sizes = np.diff(ends, prepend=-1)
    pointer = np.zeros(len(data), np.int64)
    pointer[order] = np.repeat(ends, sizes)
    open_ = np.repeat(sizes > 1, sizes)
    deep = 8
    while deep < length and open_.any():
        places = np.flatnonzero(open_)
        cuts = np.searchsorted(places, [pointer[order[p]] for p in places[len(places) * np.arange(1, TURNS) // TURNS]], "right")
        for turn in np.split(places, cuts):
            if not len(turn):
                continue
            at = order[turn]
            # What an earlier turn refined is sorted deeper already, and so is what points there.
            later = np.where(room[at] > deep, pointer[np.minimum(at + deep, len(data) - 1)], -1)
            key = pointer[at] * (len(data) + 1) + later + 1
            rank = np.argsort(key)
            at, key = at[rank], key[rank]
            ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            order[turn] = at
            sizes = np.diff(ends, prepend=-1)
            pointer[at] = np.repeat(turn[ends], sizes)
            open_[turn] = np.repeat(sizes > 1, sizes)
        deep *= 2
    return order


def refine(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each context, which of its ``length``-byte strings occur at least twice in all contexts."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    order = suffix_order(data, room, length)
    order = order[room[order] >= length]
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    words = np.lib.stride_tricks.sliding_window_view(data, min(8, length)) if len(data) >= min(8, length) else data[:0, None]
    for k in [*range(0, length - 7, 8), length - 8] if length >= 8 else [0]:
        left = np.flatnonzero(same)
        same[left] = (words[a[left] + k] == words[b[left] + k]).all(axis=1)
    twice = np.zeros(len(data), bool)
    twice[a[same]] = twice[b[same]] = True
    strings = np.flatnonzero(room >= length)
    return np.split(twice[strings], np.cumsum(sizes - length + 1)[:-1])


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def covered_spans(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the strings that start in the given ranges."""
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z + length)
        else:
            out.append([a, z + length])
    return [(a, b) for a, b in out]


def _pointer_task(length: int):
    """Rows ``_id, _th, rid`` of the texts, and the pointers of a batch by bucket and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, hashes, found = [], [], []
            for i, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                own = np.array(pointers(text, length) if len(text) >= length else [], np.int64).reshape(-1, 4)
                found.append(np.column_stack([own, np.full(len(own), n + len(ids))]))
                ids.append(i)
                hashes.append(t)
            rows = len(ids)
            yield _pointer_rows(_id=pa.array(ids, pa.int64()), _th=pa.array(hashes, pa.int64()), rid=pa.array(np.arange(n, n + rows)))
            n += rows
            table = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
            if not len(table):
                continue
            table = table[np.lexsort((table[:, 1], table[:, 0]))]
            first = np.flatnonzero(np.append(True, (table[1:, :2] != table[:-1, :2]).any(axis=1)))
            refs = pa.StructArray.from_arrays([pa.array(table[:, 4]), pa.array(table[:, 2].astype(np.int32)), pa.array(table[:, 3].astype(np.int32))], names=["rid", "first", "last"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(table)).astype(np.int32)), refs)
            yield _pointer_rows(bucket=pa.array(table[first, 0]), context=pa.array(table[first, 1]), refs=lists)

    return run


_REF = pa.struct([("rid", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_POINTERS = {"_id": pa.int64(), "_th": pa.int64(), "rid": pa.int64(), "bucket": pa.int64(), "context": pa.int64(), "refs": pa.list_(_REF)}


def _pointer_rows(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([cols[k] if k in cols else pa.nulls(n, t) for k, t in _POINTERS.items()], names=list(_POINTERS))


def _context_task(length: int):
    """The context bytes of the listed pointers of each text; of a large bucket each string's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, refs in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py()
                for r in refs:
                    a, z, rid, b = r["first"], r["last"], r["rid"], r["bucket"]
                    if r["large"]:
                        rows += [(*cut[:1], rid, *cut[1:3], r["edge"], None, *cut[3:]) for cut in _cuts(text, b, a, z, length)]
                    else:
                        rows.append((b, rid, a, z, r["edge"], text[a : z + length], None, None))
                    if len(rows) >= 20_000:
                        yield _contexts(rows)
                        rows = []
            if rows:
                yield _contexts(rows)

    return run


def _cuts(text: bytes, bucket: int, first: int, last: int, length: int) -> Iterator[tuple]:
    """``(bucket, first, last, context hash, string hashes)`` of the cuts of a context."""
    within = np.frombuffer(text, np.uint8, length + last - first, first)
    # The pointer: the leftmost q-gram with the bucket's hash that all strings hold.
    inner = gram_hashes(within[last - first : length], GRAM).view(np.int64)
    pointer = last + int(np.argmax(inner == bucket))
    hash_of = lambda a, b, seed: xxhash.xxh3_64_intdigest(text[a:b], seed) - (1 << 63)
    part = last
    while part >= first:
        # Strings that start ``lo`` to ``lo + CUT - 1`` bytes before the pointer.
        lo = (pointer - part) // CUT * CUT
        a = max(first, pointer - lo - CUT + 1)
        core = hash_of(pointer - lo, pointer - lo - CUT + 1 + length, (bucket ^ lo) % (1 << 64))
        yield core, a, part, hash_of(a, part + length, 7), [hash_of(p, p + length, 11) for p in range(a, part + 1)]
        part = a - 1


def _contexts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "rid": pa.int64(), "first": pa.int32(), "last": pa.int32(), "edge": pa.bool_(), "bytes": pa.binary(), "context": pa.int64(), "strings": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _refine_task(length: int):
    """Ranges of repeated strings of contexts; the buckets of a task come sorted."""

    def done(held: list[tuple]) -> pa.RecordBatch:
        held = list(dict.fromkeys(held))
        rids, a, z = [], [], []
        for (_, rid, first, edge, _), flags in zip(held, refine([h[4] for h in held], length), strict=True):
            if edge:
                for x, y in runs(flags):
                    rids.append(rid)
                    a.append(first + x)
                    z.append(first + y)
        return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(a, pa.int32()), pa.array(z, pa.int32())], names=["rid", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= TOGETHER and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield done(held)

    return run


def _cut_task(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                spans = covered_spans([(r["first"], r["last"]) for r in ranges or []], length)
                at, digest = 0, hashlib.sha256()
                for a, b in [*spans, (len(text), len(text))]:
                    digest.update(text[at:a])
                    at = b
                for c, x in zip(out, (doc, len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"start": a, "end": b} for a, b in spans]), strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeated_ranges(docs: DataFrame, length: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _th, ranges``: where strings of ``length`` bytes start that occur elsewhere, too."""
    keyed = docs.select(*row_key(id_col, text_col), text_bytes(text_col).alias("_t"))
    schema = "_id long, _th long, rid long, bucket long, context long, refs array<struct<rid:long,first:int,last:int>>"
    texts = scratch.put(keyed.mapInArrow(lean(_pointer_task(length)), schema), "pointers")
    docs_of = texts.where("rid is not null").select("_id", "_th", "rid")
    one = texts.where("bucket is not null").select("bucket", "context", "refs")
    many = F.size("refs").cast("long")
    contexts = one.groupBy("bucket", "context").agg(F.sum(many).alias("n"))
    buckets = contexts.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.count("*").alias("kinds"))
    buckets = scratch.put(buckets.where("n > 1").select("bucket", "least", "kinds"), "buckets")
    scratch.release()
    shared = scratch.put(one.join(buckets, "bucket"), "shared")
    scratch.release()
    counts = scratch.put(shared.groupBy("bucket", "context").agg(F.sum(many).alias("n"), F.min(F.element_at("refs", 1)).alias("rep"), F.max("kinds").alias("kinds"), F.min("least").alias("least")), "contexts")
    # What occurs twice in a batch needs no count of the others.
    twice = shared.where(many > 1).select("refs").unionByName(shared.where(many == 1).join(counts.where("n > 1").select("bucket", "context"), ["bucket", "context"]).select("refs"))
    whole = twice.select(F.explode("refs").alias("r")).select("r.*")
    # Of buckets with different contexts, one of them single, one pointer for each context goes on.
    reps = counts.where("kinds > 1 and least = 1").select("bucket", "rep.*", (F.col("n") == 1).alias("edge"), (F.col("kinds") > TASK_CONTEXTS).alias("large"))
    listed = reps.join(docs_of, "rid").groupBy("_id", "_th").agg(F.collect_list(F.struct("rid", "bucket", "first", "last", "edge", "large")).alias("refs"))
    listed = scratch.put(listed, "listed")
    # Repeats of a row give its contexts more than once, which the next steps drop.
    from_text = keyed.join(listed.hint("shuffle_hash"), ["_id", "_th"]).select("_t", "refs")
    got = scratch.put(from_text.mapInArrow(lean(_context_task(length)), "bucket long, rid long, first int, last int, edge boolean, bytes binary, context long, strings array<long>"), "bytes")
    scratch.release()
    small = got.where("bytes is not null").select("bucket", "rid", "first", "edge", "bytes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    refined = small.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_refine_task(length)), "rid long, first int, last int")
    cuts = scratch.put(got.where("bytes is null").select("bucket", "context", "rid", "first", "last", "edge", "strings").dropDuplicates(["bucket", "rid", "first"]), "cuts")
    kept = F.struct("rid", "first", "last", "edge", "strings")
    same = scratch.put(cuts.groupBy("bucket", "context").agg(F.count("*").alias("n"), F.min(kept).alias("rep")), "same")
    again = cuts.where("edge").join(same.where("n > 1").select("bucket", "context"), ["bucket", "context"]).select("rid", "first", "last")
    mixed = scratch.put(same.groupBy("bucket").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("bucket"), "mixed")
    strings = same.join(mixed, "bucket").select("bucket", (F.col("rep.edge") & (F.col("n") == 1)).alias("edge"), "rep.rid", F.posexplode("rep.strings").alias("at", "string"), F.col("rep.first").alias("from"))
    strings = scratch.put(strings.select("bucket", "edge", "rid", (F.col("from") + F.col("at")).alias("first"), "string"), "strings")
    often = scratch.put(strings.groupBy("bucket", "string").agg(F.count("*").alias("n")).where("n > 1").select("bucket", "string"), "often")
    counted = strings.where("edge").join(often, ["bucket", "string"]).select("rid", "first", F.col("first").alias("last"))
    ranges = whole.unionByName(refined).unionByName(again).unionByName(counted).groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    # Rows equal in id and text have equal ranges.
    return ranges.join(docs_of, "rid").groupBy("_id", "_th").agg(F.first("ranges").alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row."""
    scratch = Scratch(docs.sparkSession, "suffix")
    ranges = scratch.put(repeated_ranges(docs, length, scratch, id_col, text_col), "ranges")
    for name in ("pointers", "shared", "bytes", "cuts", "same", "strings"):
        scratch.drop(name)
    scratch.release()
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), text_bytes(text_col).alias("_t"))
    joined = keyed.join(ranges.hint("shuffle_hash"), ["_id", "_th"], "left").select("doc_id", "_t", "ranges")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return joined.mapInArrow(lean(_cut_task(length)), schema)
