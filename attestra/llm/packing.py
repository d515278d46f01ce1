"""Sum-of-squares online packing of tokenised documents into fixed windows.

Every task packs the documents of its own partition, so nothing is shuffled.
``N[h]`` counts the windows now filled to level ``h``. A piece goes to the
level for which the sum of squares of ``N`` comes out smallest; ties go to the
fullest window. Whole windows are cut from long documents first.

Windows that little fits into stay open, so at OPEN_LIMIT open windows a piece that asks for a new one
is cut: its head fills the fullest window, its rest is placed by the sum of squares again. At a task's end
the emptiest windows are dealt out to fill the fullest; what the last one holds is cut into falling powers of two,
which need no padding. A rerun of a task packs the same rows in the same way.

Cases: null or empty text is the closing id alone; equal documents are packed
each on its own; rows with equal or null doc_ids are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, tune

SIZE = 1024
END_ID = 0
#: Open windows of a task; beyond them the fullest is filled by cutting a piece. Bounds its memory, drops nothing.
OPEN_LIMIT = 64
#: Words whose ids a task remembers.
CACHE_WORDS = 300_000
CACHED_LENGTH = 64
VOCABULARY = "byte_bpe_50k"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


def _little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _by_tokenizer(path: str) -> Callable[[str], list[int]]:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor share its cores already
    tokenizer = Tokenizer.from_file(path)
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids


def _by_ranks(path: str) -> Callable[[str], list[int]]:
    """The same vocabulary as byte ranks: the tokenizer's ids of texts without special tokens, in a quarter of its time. A test holds both against each other on all documents and on made-up texts."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Ids(dict):
    """Text between two lone spaces -> its ids as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokeniser always cuts before a lone space that stands
    between two other characters, so texts can be cut there and the parts' ids
    remembered. A word's closing signs are cut off likewise. Texts that hold a
    special token go to the tokenizer itself, as a whole.
    """

    LONE = re.compile(r"(?<=\S) (?=\S)")
    ODD = re.compile(r"\s | \s|^ | $")
    TAIL = re.compile(r"(?<=[A-Za-z0-9])[!-&(-/:-@\[-^`{-~“”…]+\Z")

    def __init__(self, path: str):
        super().__init__()
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.encode = _by_ranks(ranks) if os.path.exists(ranks) else _by_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.whole: Callable[[str], list[int]] | None = None
        self.path = path
        self.tails: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        tail = None if part[-1:].isalnum() else self.TAIL.search(part)
        if tail and len(tail[0]) <= CACHED_LENGTH:
            if (end := self.tails.get(tail[0])) is None:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                end = self.tails[tail[0]] = _little_endian(self.encode(tail[0]))
            ids = self[part[: tail.start()]] + end
        else:
            ids = _little_endian(self.encode(" " + part))
        if len(part) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[part] = ids
        return ids

    def of(self, text: str) -> bytes:
        if self.special.search(text):
            self.whole = self.whole or _by_tokenizer(self.path)
            return _little_endian(self.whole(text))
        parts = self.LONE.split(text) if self.ODD.search(text) else text.split(" ")
        return _little_endian(self.encode(parts[0])) + b"".join(map(self.__getitem__, parts[1:]))

    def all(self, texts: list[str]) -> Iterator[bytes]:
        return map(self.of, texts)


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """The worker's own, kept from task to task."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


class Packer:
    """Levels of one task. add() and flush() return pieces (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, size: int = SIZE, first_sequence: int = 0):
        self.size, self.next = size, first_sequence
        self.counts = np.zeros(size + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(size + 1)]
        self.open = 0
        #: Tokens that filled a window's rest, and not a level chosen by the sum of squares.
        self.cut = 0

    def _closed(self, pieces: list) -> list[tuple]:
        out, at = [], 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, ids, total, self.next, at))
            at += len(ids) // 4
        self.next += 1
        return out

    def level(self, length: int) -> int:
        """The level at which a piece makes the sum of squares smallest; 0 opens a window."""
        n, last = self.counts, self.size - length
        best, gain = 0, 2 * n[length] + 1 if length < self.size else 0
        if last > 0:
            change = np.where(n[1 : last + 1] > 0, 1 - 2 * n[1 : last + 1], np.int64(1) << 60)
            change[:-1] += 2 * n[length + 1 : self.size] + 1
            h = last - 1 - int(np.argmin(change[::-1]))
            if change[h] <= gain:
                best = h + 1
        return best

    def _put(self, h: int, piece: tuple) -> list[tuple]:
        """Put a piece into a window of level h; 0 opens one."""
        pieces = self.windows[h].pop() if h else []
        pieces.append(piece)
        if h:
            self.counts[h] -= 1
            self.open -= 1
        level = h + len(piece[2]) // 4
        if level == self.size:
            return self._closed(pieces)
        self.windows[level].append(pieces)
        self.counts[level] += 1
        self.open += 1
        return []

    def add(self, doc, ids: bytes) -> list[tuple]:
        total, out, start = len(ids) // 4, [], 0
        while total - start >= self.size:
            out += self._closed([(doc, start, ids[4 * start : 4 * (start + self.size)], total)])
            start += self.size
        while start < total:
            length = total - start
            h = self.level(length)
            if not h and self.open >= OPEN_LIMIT:
                h = int(np.flatnonzero(self.counts)[-1])
                length = min(length, self.size - h)
                self.cut += length
            out += self._put(h, (doc, start, ids[4 * start : 4 * (start + length)], total))
            start += length
        return out

    def flush(self) -> list[tuple]:
        """Fill the fullest windows with what the emptiest hold; cut the last into falling powers of two."""
        rest = [w for level in reversed(self.windows) for w in level]
        sizes = [h for h in reversed(range(self.size + 1)) for _ in self.windows[h]]
        out, i, j = [], 0, len(rest) - 1
        while i < j:
            while sizes[i] < self.size and i < j:
                doc, start, ids, total = rest[j].pop()
                keep = max(0, len(ids) // 4 - (self.size - sizes[i]))
                rest[i].append((doc, start + keep, ids[4 * keep :], total))
                if keep:
                    rest[j].append((doc, start, ids[: 4 * keep], total))
                moved = len(ids) // 4 - keep
                sizes[i], sizes[j], self.cut = sizes[i] + moved, sizes[j] - moved, self.cut + moved
                if not rest[j]:
                    j -= 1
            if sizes[i] == self.size:
                out += self._closed(rest[i])
                i += 1
        if i == j:
            out += self._powers(rest[i], sizes[i])
        self.counts[:] = 0
        self.windows = [[] for _ in range(self.size + 1)]
        self.open = 0
        return out

    def _powers(self, pieces: list, left: int) -> list[tuple]:
        out, k, used = [], 0, 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc, start, ids, total = pieces[k]
                take = min(room, len(ids) // 4 - used)
                window.append((doc, start + used, ids[4 * used : 4 * (used + take)], total))
                room, used = room - take, used + take
                if used == len(ids) // 4:
                    k, used = k + 1, 0
            out += self._closed(window)
        return out


SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece, with its ids (little-endian unsigned 32-bit).

    sequence_id: the task's number times 2**40, plus the window's number in the task.
    """
    path = vocabulary
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path or vocabulary_path())
        end = np.array([END_ID], "<u4").tobytes()
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

        for whole in batches:
            for i in range(0, whole.num_rows, 250):
                b = whole.slice(i, 250)
                for doc, found in zip(b.column(0).to_pylist(), ids.all([t.as_py() or "" for t in b.column(1)])):
                    new = packer.add(doc, found + end)
                    held += sum(len(p[2]) for p in new)
                    rows += new
                    if held > 8_000_000:
                        yield batch()
                        rows, held = [], 0
        rows += packer.flush()
        if rows:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(documents(spark, sf_dir)))
