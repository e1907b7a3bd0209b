"""Operator 7, packing: sum-of-squares online packing into token windows.

A document's tokens are placed as they stream by. Of all window fill levels
that still hold the item, the one is chosen for which the sum of the squared
numbers of partially filled windows per level becomes least; ``_Packer.count``
is the level array. Documents of a window and more are first cut into whole
windows. Windows stay open over all batches of a task and close when they are full.
When a task's input ends (or more than ``max_open`` windows are open) the emptiest
windows, just enough of them, are cut up to fill the others; all else stays where it
was placed. The last rest of a task goes to windows whose lengths are powers of two,
which need no padding.

Each input partition packs on its own, without a shuffle, and sequence ids carry
the partition, so a lost task is repeated alone with the same result. A task's
memory is bounded by ``max_open`` windows and one batch of texts.

Null and empty texts count as the end token alone. Very long texts are cut into whole
windows and a rest. Rows with equal or null ids are packed like any other; of levels
that tie the fullest is chosen. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm._shared import lean

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
#: Words are looked up in a table of this many entries per Python worker.
_WORDS_KEPT = 400_000
#: Fixed value: the tokenizer file's pattern of words that the fast path knows.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words handled at once; bounds the memory of a batch of long texts.
_SLICE_WORDS = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Index(dict):
    """Word to its place in the encoder's tables; notes the words that are new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class WordEncoder:
    """Token ids of texts by a tokenizer file with word ends and no white space.

    Such a tokenizer maps each space-separated word on its own, so a distinct word
    is encoded once and texts are put together by array lookups. Words of plain
    letters, digits and punctuation go through the vocabulary's merge ranks in one
    call per batch (a zero byte stands for the word end); words with any other
    character go through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json
        import re
        import unicodedata

        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"]["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        byte_of = {}
        for i in [*range(128), *range(0xC2, 0xF5)]:  # every byte of UTF-8, seen in some character
            for c in ([chr(i)] if i < 128 else []) + ([bytes([i, *[0xA0 if i in (0xE0, 0xF0) else 0x80] + [0x80] * (0 if i < 0xE0 else 1 if i < 0xF0 else 2)])[: 2 + (i >= 0xE0) + (i >= 0xF0)].decode("utf-8", "ignore")] if i >= 128 else []):
                if c:
                    byte_of.update(zip(letters.pre_tokenize_str(c)[0][0], c.encode(), strict=True))
        for i in range(0x80, 0xC0):
            c = chr(i)
            byte_of.update(zip(letters.pre_tokenize_str(c)[0][0], c.encode(), strict=True))
        special = {x["content"] for x in spec["added_tokens"]}
        ranks = {}
        for token, rank in spec["model"]["vocab"].items():
            core = token.removesuffix(suffix)
            if token not in special and all(c in byte_of for c in core):
                ranks[bytes(byte_of[c] for c in core) + b"\0" * (core != token)] = rank
        for i in range(256):  # bytes that UTF-8 never uses still need a rank
            ranks.setdefault(bytes([i]), 1_000_000 + i)
        self.pieces = tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(1_000_300, bool)
        self.ends[[r for b, r in ranks.items() if b.endswith(b"\0") and len(b) > 1]] = True
        # Within these characters, whose class and lower case are beyond doubt, the pattern is spelt out.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x130), *range(0x132, 0x149), *range(0x14A, 0x17F), *range(0x2010, 0x2028), 0x20AC]
        of = lambda kind: "".join(re.escape(chr(i)) for i in plain if unicodedata.category(chr(i))[0] == kind)
        if pattern != _PATTERN:
            raise ValueError(f"{path}: another pattern of words is not supported: {pattern}")
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{of('L')}]+|[{of('N')}]|[^\n{of('L')}{of('N')}]+|\n")
        self.odd = re.compile(f"[^\n{''.join(re.escape(chr(i)) for i in plain)}]|<\\|")
        self._reset()

    def _reset(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Encode the words noted as new."""
        words, self.index.new = self.index.new, []
        if not words:
            return
        odd = self.odd.search
        strange, text = [], "\n".join(words)
        if odd(text):
            strange = [i for i, w in enumerate(words) if odd(w)]
            known = words[:]
            for i in strange:
                known[i] = ""
            text = "\n".join(known)
        lines = "\0".join([*self.split.findall(text.lower()), ""])  # a line break is a piece, too, which has no ids
        ids = np.array(self.pieces.encode_ordinary(lines), np.uint32)
        parts = np.fromiter((x.count("\0") for x in lines.split("\n")), np.int64, len(words))
        parts[1:] -= 1
        last = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])  # tokens up to each piece's end
        stop = last[np.cumsum(parts)]
        count = np.diff(stop, prepend=0)
        first = stop - count + self.used
        if strange:
            found = self.tokenizer.encode_batch_fast([words[i] for i in strange], add_special_tokens=False)
            more = [np.array(e.ids, np.uint32) for e in found]
            count[strange] = [len(x) for x in more]
            first[strange] = self.used + len(ids) + np.concatenate([[0], np.cumsum(count[strange])[:-1]])
            ids = np.concatenate([ids, *more])
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.first = np.concatenate([self.first, first])
        self.count = np.concatenate([self.count, count])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        i = 0
        while i < len(texts):
            if len(self.index) > _WORDS_KEPT:
                self._reset()
            codes, total = [], 0
            while i < len(texts) and total < _SLICE_WORDS:
                words = (texts[i] or "").replace("\n", " ").split(" ")
                codes.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
                total += len(words)
                i += 1
            self._learn()
            for code in codes:
                lens = self.count[code]
                stops = np.cumsum(lens)
                yield self.flat[np.repeat(self.first[code] - (stops - lens), lens) + np.arange(stops[-1])]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class _Packer:
    """The open windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, max_open: int, partition: int):
        self.size, self.max_open = size, max_open
        self.count = np.zeros(size + 1, np.int64)  # the level array
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0
        self.next_id = partition << 36
        self.rows: list[tuple] = []
        self.moved = 0  # tokens that the final filling cut and moved

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc, start, len(ids), crc, total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def _keep(self, level: int, pieces: list[tuple]) -> None:
        if level == self.size:
            self._close(pieces)
            return
        self.open.setdefault(level, []).append(pieces)
        self.count[level] += 1
        self.n_open += 1

    def level_for(self, n: int) -> int:
        """The level whose window gets an item of ``n`` tokens: 0 opens a new one."""
        top = self.size - n
        now, then = self.count[: top + 1], self.count[n:].copy()
        gain = 2 * then + 1
        gain[top] = 0  # a full window is no longer partial
        gain -= np.where(now > 0, 2 * now - 1, 0)
        gain[1:][now[1:] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(gain[::-1]))  # of equals, the fullest

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self._close([(doc, start, ids[start : start + self.size], total)])
            start += self.size
        n = total - start
        if not n:
            return
        piece = (doc, start, ids[start:].copy(), total)
        level = self.level_for(n)
        pieces: list[tuple] = []
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        self._keep(level + n, [*pieces, piece])
        if self.n_open > self.max_open:
            self.finish(last=False)

    def finish(self, last: bool) -> None:
        """Fill the open windows with tokens of the emptiest; ``last``: the rest goes to powers of two."""
        windows = [pieces for level in sorted(self.open) for pieces in self.open[level]]
        fill = [sum(len(p[2]) for p in pieces) for pieces in windows]
        self.open.clear()
        self.count[:] = 0
        self.n_open = 0
        # The fewest windows that fill all others: what they hold against what the others lack.
        spare = np.cumsum(fill, dtype=np.int64) - (self.size * np.arange(len(fill) - 1, -1, -1) - (sum(fill) - np.cumsum(fill, dtype=np.int64)))
        few = int(np.searchsorted(spare, 0)) + 1
        rest = [p for pieces in windows[:few] for p in pieces]

        def take(n: int) -> list[tuple]:
            out = []
            while n:
                doc, start, ids, total = rest.pop()
                if len(ids) > n:
                    rest.append((doc, start + n, ids[n:], total))
                    ids = ids[:n]
                out.append((doc, start, ids, total))
                n -= len(ids)
                self.moved += len(ids)
            return out

        for pieces, held in zip(windows[few:], fill[few:], strict=True):
            self._close([*pieces, *take(self.size - held)])
        left = sum(len(p[2]) for p in rest)
        if left and not last:
            self._keep(left, rest)
        while left and last:
            n = 1 << (left.bit_length() - 1)
            self._close(take(n))
            left -= n

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 4096, end_id: int = 2, max_open: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``size`` tokens."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(size, max_open, TaskContext.get().partitionId())
        enc = encoder(path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    packer.add(doc, np.concatenate([ids, end]))
            if len(packer.rows) >= 5000:
                yield _rows(packer.drain())
        packer.finish(last=True)
        yield _rows(packer.drain())

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(lean(run), SCHEMA)
