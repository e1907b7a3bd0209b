"""Operator 1, SimHash near-dedup with a Gray-order hierarchical index.

1. Each text gets a 64-bit fingerprint (majority bits of its shingles' hashes).
   Equal fingerprints are collapsed to one row with the least id of their
   documents, before anything is shuffled by fingerprint.
2. The 64 bits are cut into ``distance + 2`` fields, so fingerprints within ``distance``
   bits agree on two of them at least. Rows ``(values of two fields, fingerprint)`` are range
   partitioned and sorted by that key, then by Gray rank. A key with more rows than a
   partition should hold is dealt anew by parts of its other bits, which loses no link either.
   Neighbours in Gray order share most bits; runs of them form the index: each upper node keeps the
   bits that all fingerprints below share. The self join walks pairs of
   nodes from the top and drops a pair as soon as the bits shared by both differ
   too often, or as all rows below are in one group already.
3. A key that runs over a partition's end all the same is cut into blocks. Pairs of
   blocks from different partitions are matched as rows of their own, after
   the same test on the blocks' shared bits, so no group must fit in one task.
4. Links become components by star contraction. Within a task links are
   reduced to a spanning forest, never all pairs.

Null and wordless texts have fingerprint zero and are linked like any other; very long texts are
hashed whole, ``1 << 15`` shingles at a time. Rows with a null id are linked, too; the least id that is
known stands for a component, null if there is none. Repeated rows are in one component. Pairs at
exactly ``distance`` bits are linked. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm._shared import NULL_ID, Scratch, lean, row_key, text_bytes
from hunkwise.llm.components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fan-out of the index, rows of a block, pairs of nodes looked at together.
FAN, BLOCK, TOGETHER = 8, 512, 1 << 14
#: Rows of the index that a partition holds at most, about; of how many rows one is looked at to find keys with more.
PARTITION_ROWS, LOOKED_AT = 400_000, 64
#: Rows with one key from which they are joined apart from the others.
HOT_ROWS = 50_000


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = hashes[lo : lo + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; none without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1]).tolist()
    ends = stops[min(shingle, len(words)) - 1 :].tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter((hash_of(joined[a:b], seed) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends))


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text, unsigned; zero without words."""
    return _majority(shingle_hashes(text, shingle, seed))


def wide_fingerprint(text: bytes, shingle: int, lanes: int, seed: int = 42) -> list[int]:
    """Fingerprints of the set of a text's shingles under several hashes, made of one by mixing."""
    hashes = np.unique(shingle_hashes(text, shingle, seed))
    out = []
    for lane in range(lanes):
        x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(x ^ (x >> np.uint64(31))))
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, lanes: int = 0, exact: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long; with ``lanes``, ``f0, f1, ...`` of the shingles' set.

    With ``exact`` also ``_th, node``: hashes of the text and of its exact set of that many words' shingles.
    """
    names = [f"f{i}" for i in range(lanes)] if lanes else ["fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = (lambda t: wide_fingerprint(t, shingle, lanes, seed)) if lanes else (lambda t: [fingerprint(t, shingle, seed)])
            fps = np.array([of(t.as_py()) for t in batch.column(1)], np.uint64).reshape(batch.num_rows, len(names))
            more = []
            if exact:
                sets = np.array([xxhash.xxh3_64_intdigest(np.unique(shingle_hashes(t.as_py(), exact)).tobytes()) for t in batch.column(1)], np.uint64)
                more = [batch.column(2), pa.array(sets.view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(fps[:, i]).view(np.int64)) for i in range(len(names))], *more], names=["doc_id", *names, *["_th", "node"][: len(more)]])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", _th long, node long" * bool(exact)
    key = row_key(id_col, text_col)[1:] if exact else []
    return docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_t"), *key).mapInArrow(lean(run), schema)


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the reflected Gray code."""
    x = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _gray_sql(col: str):
    x = F.col(col)
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


class Forest:
    """Groups of linked rows of one task."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.used: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Link pairs; of pairs that would join the same groups the first counts as used."""
        lab = self.label
        while len(i):
            a, b = lab[i], lab[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(lab, high, low)
            won = np.flatnonzero(lab[high] == low)
            won = won[np.unique(high[won], return_index=True)[1]]
            self.used.append((i[won], j[won]))
            while not np.array_equal(lab, up := lab[lab]):
                lab[:] = up

    def links(self, real: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest: stars, or with ``real`` pairs that were added."""
        if real:
            return tuple(np.concatenate([x[k] for x in self.used] or [np.zeros(0, np.int64)]) for k in (0, 1))
        i = np.flatnonzero(self.label != np.arange(len(self.label)))
        return i, self.label[i]


class GrayIndex:
    """Nodes over rows sorted by (group, Gray rank); a node spans rows of one group.

    ``mask`` has the bits on which all rows below a node agree, ``value`` those
    bits. Level 0 are the rows themselves.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.mask, self.value = [np.full(len(fps), ~np.uint64(0))], [fps]
        self.first: list[np.ndarray] = [np.arange(len(fps))]
        self.size: list[np.ndarray] = [np.ones(len(fps), np.int64)]
        groups = int((np.diff(group) != 0).sum()) + 1 if len(group) else 0
        while len(group) > groups:
            n = len(group)
            start = np.concatenate([[True], group[1:] != group[:-1]])
            within = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
            cut = np.flatnonzero(within % FAN == 0)
            mask, value = self.mask[-1], self.value[-1]
            low = np.bitwise_and.reduceat(value, cut)
            high = np.bitwise_or.reduceat(value, cut)
            shared = np.bitwise_and.reduceat(mask, cut) & ~(low ^ high)
            self.mask.append(shared)
            self.value.append(low & shared)
            self.first.append(cut)
            self.size.append(np.diff(np.append(cut, n)))
            group = group[cut]

    def pairs(self, distance: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs of one group within ``distance`` bits, in batches.

        ``label`` may change while pairs are taken; pairs of nodes whose rows all have one label are dropped.
        """
        top = len(self.mask) - 1
        roots = np.arange(len(self.mask[top]))
        todo = [(top, roots, roots)] if top else []
        work, ends = 0, None
        while todo:
            level, a, b = todo.pop()
            if len(a) > TOGETHER:
                todo += [(level, a[lo : lo + TOGETHER], b[lo : lo + TOGETHER]) for lo in range(0, len(a), TOGETHER)]
                continue
            if label is not None and work > 4 * len(label):
                work, ends = 0, self._labels(label)
            if ends:
                low, high = ends[level]
                open_ = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
                a, b = a[open_], b[open_]
            na, nb = self.size[level][a], self.size[level][b]
            many = na * nb
            at = np.repeat(np.arange(len(a)), many)
            work += len(at)
            within = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            ca = self.first[level][a][at] + within // nb[at]
            cb = self.first[level][b][at] + within % nb[at]
            keep = (ca < cb) if level == 1 else (ca <= cb)
            ca, cb = ca[keep], cb[keep]
            mask, value = self.mask[level - 1], self.value[level - 1]
            # Differences on the bits that both nodes share, those of the levels above included.
            near = np.bitwise_count((value[ca] ^ value[cb]) & mask[ca] & mask[cb]) <= distance
            ca, cb = ca[near], cb[near]
            if not len(ca):
                continue
            if level == 1:
                yield ca, cb
            else:
                todo.append((level - 1, ca, cb))

    def _labels(self, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The least and greatest label below each node, by level."""
        out = [(label.copy(), label.copy())]
        for first in self.first[1:]:
            out.append((np.minimum.reduceat(out[-1][0], first), np.maximum.reduceat(out[-1][1], first)))
        return out


def _nearest_first(i: np.ndarray, j: np.ndarray, lanes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within ``limit`` bits over all lanes, nearest first."""
    far = np.bitwise_count(lanes[:, i] ^ lanes[:, j]).sum(axis=0, dtype=np.int64)
    order = np.argsort(far, kind="stable")
    order = order[far[order] <= limit]
    return i[order], j[order]


def _index_task(distance: int, limit: int | None):
    """Links of the rows of one partition, and blocks of the groups at its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows]
        if not got:
            return
        rows = np.concatenate(got, axis=1)
        key, rep, lanes = rows[0], rows[1], rows[2:].view(np.uint64)
        order = np.lexsort((gray_rank(lanes[0]), key))
        key, rep, lanes = key[order], rep[order], np.ascontiguousarray(lanes[:, order])
        forest = Forest(len(key))
        for i, j in GrayIndex(lanes[0], key).pairs(distance, forest.label):
            forest.add(*(_nearest_first(i, j, lanes, limit) if limit is not None else (i, j)))
        i, j = forest.links(real=limit is not None)
        pid = TaskContext.get().partitionId()
        for lo in range(0, len(i), 50_000):
            yield _out(u=rep[i[lo : lo + 50_000]], v=rep[j[lo : lo + 50_000]])
        for k in dict.fromkeys((int(key[0]), int(key[-1]))):
            a, b = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
            for n, lo in enumerate(range(a, b, BLOCK)):
                f, r = lanes[:, lo : min(b, lo + BLOCK)], rep[lo : min(b, lo + BLOCK)]
                low, high = np.bitwise_and.reduce(f[0]), np.bitwise_or.reduce(f[0])
                mask = ~(low ^ high)
                yield _out(key=[k], block=[pid << 32 | n], mask=[mask.view(np.int64)], value=[(low & mask).view(np.int64)], fps=[f.tobytes()], reps=[r.tobytes()])

    return run


_OUT = {"u": pa.int64(), "v": pa.int64(), "key": pa.int64(), "block": pa.int64(), "mask": pa.int64(), "value": pa.int64(), "fps": pa.binary(), "reps": pa.binary()}


def _out(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in _OUT.items()], names=list(_OUT))


def _block_task(distance: int, limit: int | None):
    """Links between the rows of two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ra, rb = (np.frombuffer(row[k], np.int64) for k in ("ra", "rb"))
                fa, fb = (np.frombuffer(row[k], np.uint64).reshape(-1, len(r)) for k, r in (("fa", ra), ("fb", rb)))
                i, j = np.nonzero(np.bitwise_count(fa[0][:, None] ^ fb[0][None, :]) <= distance)
                i, j = i, j + len(ra)
                if limit is not None:
                    i, j = _nearest_first(i, j, np.concatenate([fa, fb], axis=1), limit)
                forest = Forest(len(ra) + len(rb))
                forest.add(i, j)
                i, j = forest.links(real=limit is not None)
                rep = np.concatenate([ra, rb])
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["u", "v"])

    return run


def masks(distance: int, bits: int = 0) -> list[int]:
    """Bit masks such that fingerprints within ``distance`` bits, equal on ``bits``, agree on one of them.

    Without ``bits`` two of ``distance + 2`` fields each, else ``bits`` and a part of the others each.
    """
    free = [i for i in range(64) if not bits >> i & 1]
    parts = distance + (1 if bits else 2)
    fields = [sum(1 << i for i in free[len(free) * k // parts : len(free) * (k + 1) // parts]) for k in range(parts)]
    return [bits | f for f in fields] if bits else [a | b for a, b in combinations(fields, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _by_masks(distinct: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """``key, rep, l0``: a row for each mask, more for a key that has too many rows."""
    of = {None: masks(distance)}
    rows = distinct.select("rep", F.col("fp").alias("l0"), F.explode(F.array(*[F.lit(_signed(m)) for m in of[None]])).alias("mask"))
    key = F.xxhash64(F.col("l0").bitwiseAND(F.col("mask")), "mask").alias("key")
    whole = rows.select(key, "rep", "l0", "mask")
    # A key with more rows than a partition should hold, by a look at some of them; a miss costs time, no link.
    some = whole.where(F.pmod(F.xxhash64("l0", F.lit(9)), F.lit(LOOKED_AT)) == 0)
    large = some.groupBy("key").count().where(F.col("count") > PARTITION_ROWS / LOOKED_AT).select("key")
    large = scratch.put(large, "large")
    if large.isEmpty():
        return whole.drop("mask")
    finer = F.create_map(*[F.lit(x) for m in of[None] for x in (_signed(m), [_signed(y) for y in masks(distance, m)])])
    again = whole.join(large, "key", "left_semi").select("rep", "l0", F.explode(F.element_at(finer, F.col("mask"))).alias("mask")).select(key, "rep", "l0")
    return whole.join(large, "key", "left_anti").select("key", "rep", "l0").unionByName(again)


def links(distinct: DataFrame, distance: int, scratch: Scratch, lanes: list[str] | None = None, fields: list[tuple[int, int]] | None = None, limit: int | None = None) -> DataFrame:
    """Links ``u, v`` between the ``rep`` of fingerprints within ``distance`` bits, each group spanned.

    ``distinct`` has ``rep`` and one row per fingerprint ``fp``; no link is missed. With several
    ``lanes`` each lane is indexed by the given fields, and a pair also needs at most ``limit``
    differing bits over all lanes; the links are then pairs that were found near, not stars.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    if lanes is None:
        dealt, n = _by_masks(distinct, distance, scratch), n * len(masks(distance))
    else:
        rows = []
        for k, lane in enumerate(lanes):
            turned = [F.col(c) for c in lanes[k:] + lanes[:k]]
            for m, (a, b) in enumerate(fields):
                part = F.shiftrightunsigned(F.shiftleft(lane, 64 - b), 64 - b + a)
                key = part.bitwiseOR(F.lit((k * len(fields) + m) << 48))
                rows.append(F.struct(key.alias("key"), *[c.alias(f"l{j}") for j, c in enumerate(turned)]))
        dealt = distinct.select("rep", F.explode(F.array(*rows)).alias("r")).select("r.key", "rep", *[f"r.l{k}" for k in range(len(lanes))])
        n *= len(rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PARTITION_ROWS))
    dealt = dealt.withColumn("rank", _gray_sql("l0")).repartitionByRange(parts, "key", "rank").drop("rank")
    schema = "u long, v long, key long, block long, mask long, value long, fps binary, reps binary"
    index = scratch.put(dealt.mapInArrow(lean(_index_task(distance, limit)), schema), "index")
    scratch.release()
    blocks = index.where("block is not null")
    heads = blocks.select("key", "block", "mask", "value")
    other = heads.select("key", *[F.col(c).alias(c + "2") for c in ("block", "mask", "value")])
    shared = F.col("value").bitwiseXOR(F.col("value2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2"))
    near = heads.join(other, "key").where((F.shiftright("block", 32) < F.shiftright("block2", 32)) & (F.bit_count(shared) <= distance)).select("key", "block", "block2")
    body = blocks.select("key", "block", "fps", "reps")
    a = body.select("key", "block", F.col("fps").alias("fa"), F.col("reps").alias("ra"))
    b = body.select("key", F.col("block").alias("block2"), F.col("fps").alias("fb"), F.col("reps").alias("rb"))
    across = near.join(a, ["key", "block"]).join(b, ["key", "block2"]).select("fa", "ra", "fb", "rb").mapInArrow(lean(_block_task(distance, limit)), "u long, v long")
    return index.where("u is not null").select("u", "v").unionByName(across)


def joined_apart(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``of`` says of their key; ``of`` has one row per key and the number ``many`` of its rows.

    The keys of more than ``HOT_ROWS`` rows, hence a bounded share of all, are broadcast.
    """
    hot = F.broadcast(of.where(F.col("many") > HOT_ROWS).drop("many"))
    rest = of.where(F.col("many") <= HOT_ROWS).drop("many")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: components of documents linked within ``distance`` bits."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.put(fingerprints(docs, shingle, seed, id_col=id_col, text_col=text_col), "fps")
    distinct = scratch.put(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")), "distinct")
    # A node is a fingerprint, whether or not a document of it has an id.
    comp = components(links(distinct.select(F.col("fp").alias("rep"), "fp"), distance, scratch), scratch)
    of = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "least", "many", F.coalesce("component", "fp").alias("root"))
    of = scratch.put(of, "of")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many"))
    of_fp = scratch.put(joined_apart(of.select("root", "fp", F.col("many").alias("rows")), least, "root").select("fp", F.col("rows").alias("many"), "component_id"), "of_fp")
    out = joined_apart(fps, of_fp, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Fingerprints of word pairs: hashes of 64 bits.
LANES = 4


def near_limits(similarity: float, shingle: int) -> tuple[list[tuple[int, int]], int, int]:
    """Bit fields of a lane, and how many bits may differ in a lane and in all.

    Scattered edits leave more of the word pairs alone than of longer shingles, an edit in one place as much;
    the bits of majority fingerprints differ as the angle between the sets. The fields are
    short enough for 98 of 100 pairs of the first kind to agree on one and 90 of the second, at ``similarity`` itself;
    the limits are some deviations above what is expected of the second.
    """
    angle = lambda edited: math.acos(max(0.0, 1 - edited)) / math.pi
    change = (1 - similarity) / (1 + similarity)  # shingles, as a share of a text's
    found = lambda width, apart: 1 - (1 - (1 - apart) ** width) ** (LANES * (64 // width))
    width = max((w for w in range(4, 25) if found(w, angle(2 * change / shingle)) >= 0.98 and found(w, angle(change)) >= 0.9), default=4)
    apart = angle(change)
    most = lambda bits, deviations: round(bits * apart + deviations * math.sqrt(bits * apart * (1 - apart)))
    return [(i * width, (i + 1) * width) for i in range(64 // width)], most(64, 4.2), most(64 * LANES, 2.95)


def _set_task(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "grams"])

    return run


def _verify_task(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


#: Bytes of shingle sets of a block; two blocks are held against each other together.
SET_BYTES = 1 << 20


def true_pairs(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets from different groups (and sides, if there are two) that share enough.

    Every such pair is counted exactly; of a pair's groups the later is then joined to the earlier.
    """
    size = np.array([len(x) for x in sets])
    places, at = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    marked, label, two = np.zeros(len(places), np.int32), group.copy(), side.any()
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(sets)), size)
    out = []
    for i in np.flatnonzero(side == 0):
        mine = at[ends[i] - size[i] : ends[i]]
        marked[mine] = 1
        # Without a second side the rows after this one are compared.
        lo = 0 if two else ends[i]
        both = np.bincount(owner[lo:], weights=marked[at[lo:]], minlength=len(sets))
        marked[mine] = 0
        near = both >= similarity * (size[i] + size - both)
        near &= (side == 1) if two else (np.arange(len(sets)) > i)
        for j in np.flatnonzero(near & (label != label[i])):
            if label[j] != label[i]:
                out.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return out


def _pair_task(similarity: float):
    """True pairs of two blocks; the rows ``a, b, side, node, group, grams`` come sorted by ``a, b``."""

    def check(rows: list) -> pa.RecordBatch:
        nodes = np.array([r[0] for r in rows], np.int64)
        groups = np.array([r[1] for r in rows], np.int64)
        found = true_pairs([np.frombuffer(r[3], np.uint64) for r in rows], groups, np.array([r[2] for r in rows]), similarity)
        u, v = (nodes[[p[k] for p in found]] if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for a, b, side, node, group, grams in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (a, b) != now:
                    if rows:
                        yield check(rows)
                    now, rows = (a, b), []
                rows.append((node, group, side, grams))
        if rows:
            yield check(rows)

    return run


def _rest(found: DataFrame, true: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Further true pairs ``u, v`` among nodes that candidates ``found`` join, but verified links ``true`` don't.

    Every pair of such a group whose ends are in different verified components is held against the
    exact sets. The sets meet as pairs of blocks of bounded bytes; a verified component of many
    bytes has blocks of its own, which are never compared with each other.
    """
    loose, tight = components(found, scratch, "loose"), components(true, scratch, "tight")
    of = sets.select("node", (F.octet_length("grams") + 64).alias("n"))
    of = of.join(loose.withColumnRenamed("component", "l"), "node", "left").join(tight.withColumnRenamed("component", "t"), "node", "left")
    of = scratch.put(of.select("node", "n", F.coalesce("l", "node").alias("l"), F.coalesce("t", "node").alias("t")), "of")
    held = scratch.put(of.groupBy("l", "t").agg(F.sum("n").alias("bytes")), "held")
    open_ = held.groupBy("l").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("l")
    held = held.join(open_, "l", "left_semi")
    held = scratch.put(held.select("l", "t", "bytes", F.when(F.col("bytes") >= SET_BYTES, F.col("t")).alias("home")), "open")
    if held.isEmpty():
        return true
    # Blocks of a group: those of its large components, and mixed ones of all others.
    cut = held.groupBy("l", "home").agg(F.sum("bytes").alias("all")).select("l", "home", F.ceil(F.col("all") / SET_BYTES).alias("many"))
    same = (F.col("x.l") == F.col("y.l")) & F.col("x.home").eqNullSafe(F.col("y.home"))
    held = held.alias("x").join(cut.alias("y"), same).select("x.l", "x.t", "x.home", "many")
    rows = of.join(held, ["l", "t"]).select("node", "t", "l", "home", F.xxhash64("l", "home", F.pmod(F.xxhash64("node"), "many")).alias("block"))
    rows = scratch.put(rows, "rows")
    blocks = scratch.put(rows.groupBy("l", "home", "block").agg(F.count("*").alias("rows")), "blocks")
    x, y = blocks.select("l", F.col("home").alias("hx"), F.col("block").alias("a")), blocks.select("l", F.col("home").alias("hy"), F.col("block").alias("b"))
    met = x.join(y, "l").where((F.col("a") <= F.col("b")) & (F.col("hx").isNull() | F.col("hy").isNull() | (F.col("hx") != F.col("hy")))).select("a", "b")
    sides = [F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side"))]
    met = met.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(sides[0])).otherwise(F.array(*sides))).alias("s")).select("a", "b", "s.block", "s.side")
    dealt = met.join(rows.select("node", "t", "block"), "block").join(sets, "node").select("a", "b", "side", "node", "t", "grams")
    dealt = dealt.repartition("a", "b").sortWithinPartitions("a", "b")
    more = scratch.put(dealt.mapInArrow(lean(_pair_task(similarity)), "u long, v long"), "more")
    return true.unionByName(more)


def _grouped(docs: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, _th`` of every row, and those of the first row of its group: ``component_id, component_th``."""
    scratch = Scratch(docs.sparkSession, "similar")
    names = [f"f{i}" for i in range(LANES)]
    fps = scratch.put(fingerprints(docs, 2, lanes=LANES, exact=shingle, id_col=id_col, text_col=text_col), "fps")
    # A node is a set of shingles; ``first`` is null if no document of it has an id, ``any`` names a text.
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_th"))).alias("first")
    text = F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("_th").alias("th"))).alias("any")
    known = scratch.put(fps.groupBy("node", *names).agg(first, text, F.count("*").alias("many")), "nodes")
    # One node of each fingerprint is indexed; that others have it makes them candidates only.
    distinct = scratch.put(known.groupBy(*names).agg(F.min("node").alias("rep"), F.count("*").alias("kinds")), "distinct")
    shared = known.join(distinct.where("kinds > 1"), names).where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    fields, of_lane, of_all = near_limits(similarity, shingle)
    found = scratch.put(links(distinct.drop("kinds"), of_lane, scratch, names, fields, of_all).unionByName(shared).distinct(), "found")
    nodes = found.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    keys = known.join(nodes, "node").select("node", F.col("any.id").alias("_id"), F.col("any.th").alias("_th"))
    texts = docs.select(*row_key(id_col, text_col), text_bytes(text_col).alias("_t")).join(keys.hint("shuffle_hash"), ["_id", "_th"]).select("node", "_t")
    sets = scratch.put(texts.mapInArrow(lean(_set_task(shingle)), "node long, grams binary").groupBy("node").agg(F.min("grams").alias("grams")), "sets")
    scratch.release()
    pairs = found.join(sets.select(F.col("node").alias("u"), F.col("grams").alias("gu")), "u").join(sets.select(F.col("node").alias("v"), F.col("grams").alias("gv")), "v")
    true = scratch.put(pairs.select("u", "v", "gu", "gv").mapInArrow(lean(_verify_task(similarity)), "u long, v long"), "true")
    comp = components(_rest(found, true, sets, similarity, scratch), scratch)
    of = scratch.put(known.join(comp, "node", "left").select("node", "first", "many", F.coalesce("component", "node").alias("c")), "component")
    least = scratch.put(of.groupBy("c").agg(F.min("first").alias("least")), "least")
    of = scratch.put(of.join(least, "c").select("node", "many", F.col("least.doc_id").alias("component_id"), F.col("least._th").alias("component_th")), "of_node")
    return joined_apart(fps, of, "node").select("doc_id", "_th", "component_id", "component_th")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id``: groups of documents linked by at least ``similarity`` of their shingles.

    Documents with equal shingle sets are one node. Candidates come from the index over wide
    fingerprints of word pairs; nodes with equal fingerprints are candidates, too. The pairs that
    span a group of candidates are held against their exact shingle sets first; where they
    don't join the whole group, so is every pair of it that is not yet joined.
    """
    return _grouped(docs, similarity, shingle, id_col, text_col).select("doc_id", "component_id")


def without_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, one of each group; rows with a null id stay.

    Rows are told apart by id and text: of rows that share an id each text is in its own group.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    groups = _grouped(docs, similarity, shingle, id_col, text_col).where("doc_id is not null and (doc_id <> component_id or _th <> component_th)")
    gone = scratch.put(groups.select(F.col("doc_id").alias("gone"), F.col("_th").alias("gone_th")).distinct(), "gone")
    # The documents' columns go by place, whatever their names.
    place = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(c).alias(p) for c, p in zip(docs.columns, place, strict=True)], F.col(id_col).cast("long").alias("key"), row_key(id_col, text_col)[1].alias("key_th"))
    kept = rows.join(gone.hint("shuffle_hash"), (F.col("key") == F.col("gone")) & (F.col("key_th") == F.col("gone_th")), "left_anti")
    # Rows equal in id and text are one document, too.
    again = rows.where("key is not null").groupBy(F.col("key").alias("again"), F.col("key_th").alias("again_th")).count().where("count > 1").select("again", "again_th")
    again = scratch.put(again, "again")
    if not again.isEmpty():
        same = (F.col("key") == F.col("again")) & (F.col("key_th") == F.col("again_th"))
        once = kept.join(again, same, "left_semi").dropDuplicates(["key", "key_th"])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.select(*[F.col(p).alias(c) for c, p in zip(docs.columns, place, strict=True)])
