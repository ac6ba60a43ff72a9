"""Sum-of-squares online packing of documents into training sequences (operator 8).

Each document's tokens (with an end token) fill whole windows first. What is left of it, shorter than a
window, is placed online: of all fill levels that have room, and an empty window, it goes to the one after
which the sum of squared counts of partially filled windows by level is least; the counts are an array by
level. A window that lacks fewer than ``slack`` ids counts as full; the head of the next piece is cut off to fill it, so
windows close often and few are open at a time. Each input partition packs its own rows, so nothing is shuffled or
gathered, and a task that is run again gives the same sequences. What is open at the partition's end, or when
``max_open`` windows are, is settled, which the column ``settled`` tells: windows at a power of two stay as they are (they need
no padding), the others' pieces are cut at window borders and, at the very end, at powers of two. No id is lost or
dropped; no padding remains.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; a text of any
length is packed whole; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm import bpe
from cartolith.llm.common import utf8

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, settled boolean"


class Packer:
    """Pieces are (doc_id, start, ids as bytes of 4 each, doc_tokens); emitted with their sequence and offset."""

    def __init__(self, window: int, max_open: int, first_id: int, slack: int = 1):
        self.window, self.max_open, self.next_id = window, max_open, first_id
        #: the highest level that counts as partially filled
        self.most = window - max(1, slack)
        self.count = np.zeros(window + 1, np.int64)
        self.levels: list[list[tuple[int, list]]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.nearly: tuple[int, int, list] | None = None  # level, sequence and pieces of a window that lacks a few ids
        self.out: list[tuple] = []

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def emit(self, sequence: int, pieces: list[tuple], settled: bool = False) -> None:
        offset = 0
        for piece in pieces:
            self.out.append((*piece, sequence, offset, settled))
            offset += len(piece[2]) // 4

    def level_for(self, size: int) -> int:
        """The level (0: an empty window) at which a piece adds least to the sum of squares; of equals the fullest."""
        top = self.window - size
        change = 1 - 2 * self.count[: top + 1]
        change[0] = 0
        partial = max(0, min(top, self.most - size) + 1)
        change[:partial] += 2 * self.count[size : size + partial] + 1  # a full window is no longer counted
        change[1:][self.count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(change[::-1].argmin())

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, w = len(ids) // 4, self.window
        whole = n - n % w
        for s in range(0, whole, w):
            self.emit(self.new_id(), [(doc_id, s, ids[4 * s : 4 * (s + w)], n)])
        if self.nearly and whole < n:
            level, sequence, pieces = self.nearly
            take = min(w - level, n - whole)
            pieces.append((doc_id, whole, ids[4 * whole : 4 * (whole + take)], n))
            whole += take
            self.nearly = (level + take, sequence, pieces) if level + take < w else None
            if not self.nearly:
                self.emit(sequence, pieces)
        if whole == n:
            return
        size = n - whole
        level = self.level_for(size)
        if level:
            sequence, pieces = self.levels[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            sequence, pieces = self.new_id(), []
        pieces.append((doc_id, whole, ids[4 * whole :], n))
        level += size
        if level == w:
            self.emit(sequence, pieces)
        elif level > self.most and not self.nearly:
            self.nearly = (level, sequence, pieces)
        else:
            self.levels[level].append((sequence, pieces))
            self.count[level] += level <= self.most
            self.n_open += 1
            if self.n_open > self.max_open:
                self.settle()

    def settle(self) -> None:
        """Close all open windows without padding."""
        if self.nearly:
            level, *window = self.nearly
            self.levels[level].append(tuple(window))
            self.nearly = None
        rest: list[tuple] = []
        for level, windows in enumerate(self.levels):
            for sequence, pieces in windows:
                if level & (level - 1) == 0:
                    self.emit(sequence, pieces, True)
                else:
                    rest += pieces
            windows.clear()
        self.count[:] = 0
        self.n_open = 0
        left = sum(len(p[2]) for p in rest) // 4
        rest.reverse()
        while left:
            room = take = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            pieces = []
            while room:
                doc_id, start, ids, n = rest.pop()
                if (k := len(ids) // 4) > room:
                    rest.append((doc_id, start + room, ids[4 * room :], n))
                    ids, k = ids[: 4 * room], room
                pieces.append((doc_id, start, ids, n))
                room -= k
            self.emit(self.new_id(), pieces, True)
            left -= take

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(df: DataFrame, path: str, window: int = 2048, end_id: int = 1, max_open: int = 4096, slack: int = 64, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with their sequence and offset; with_ids: and the ids themselves."""
    end = int(end_id).to_bytes(4, "little")

    def make():
        known = bpe.cache(path)
        packer = Packer(window, max_open, TaskContext.get().partitionId() << 40, slack)

        def table() -> pa.RecordBatch | None:
            if not (rows := packer.drain()):
                return None
            doc_id, start, ids, n, sequence, offset, settled = zip(*rows, strict=True)
            long = lambda x: pa.array(x, pa.int64())
            columns = [long(doc_id), long(start), long([len(x) // 4 for x in ids]), long([zlib.crc32(x) for x in ids]), long(n), long(sequence), long(offset), pa.array(settled, pa.bool_())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "settled"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        def rows(own, texts):
            for doc_id, ids in zip(own.to_pylist(), bpe.encode_batch(known, texts), strict=True):
                packer.add(doc_id, ids.astype("<u4").tobytes() + end)
            yield table()

        def close():
            packer.settle()
            yield table()

        rows.close = close
        return rows

    return bpe.in_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), make, SCHEMA + ", ids array<int>" * with_ids)
