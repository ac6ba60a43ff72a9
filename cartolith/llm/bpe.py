"""BPE encoding and decoding by segment trees over adjacent pair ranks (operator 2).

A piece of text is a row of symbols. A segment tree holds, at leaf i, the rank of the pair made of
symbol i and its right neighbour; each inner node holds the least of its children, so the root is the
leftmost pair of lowest rank. A merge changes three leaves (the pair before, the pair itself, the
swallowed symbol), each by a logarithmic point update, until the root holds no mergeable pair.
Short pieces are encoded many at a time, their trees being the rows of one numpy array; pieces of more
than 64 bytes have a tree of their own.

Defined cases: a null or empty text has no ids and decodes to the empty text; texts of only white space
likewise; a text of any length is encoded whole; repeated rows give repeated results; the strings of
special tokens in a text become their ids, as the file's library has it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import ARROW_ROWS, Words, batch, map_arrow, utf8

NONE = np.int32(2**31 - 1)
#: Entries of a worker's cache of encoded chunks; when full it is emptied, so results never depend on it.
CACHE = 400_000
#: Bytes of texts that are encoded at once.
TOGETHER = 4 << 20


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: The parts of a vocabulary file that this encoder has code for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _pattern(spec: dict) -> str:
    """The file's pattern of pieces; raises on a file that asks for what this encoder doesn't do."""
    split, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    model = spec["model"]
    plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    added = all(not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in spec["added_tokens"])
    if spec["normalizer"] != NORMALIZER or rest != [BYTE_LEVEL] or split.get("behavior") != "Removed" or not split.get("invert") or spec["decoder"] or model["type"] != "BPE" or not plain or not added:
        raise ValueError("a vocabulary file with this normalizer, pre-tokenizer, model or decoder is not supported")
    return split["pattern"]["Regex"]


#: Lower case of ASCII, and its classes: 0 letters, 1 digits, 2 all else.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_KIND = np.array([0 if chr(b).isalpha() else 1 if chr(b).isdigit() else 2 for b in range(128)] + [2] * 128, np.uint8)


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of runs that begin at first."""
    ends = np.cumsum(count)
    out = np.arange(ends[-1] if len(ends) else 0)
    out += np.repeat(first - (ends - count), count)
    return out


class PairRanks:
    """Vectorised look-up from a pair of ids to its merge rank: open addressing in two arrays."""

    def __init__(self, pairs: np.ndarray):
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys = pairs[:, 0].astype(np.int64) << 32 | pairs[:, 1]
        self.scalar = {int(k): r for r, k in enumerate(keys)}
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            slots, who = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[who]
            self.keys[slots], self.ranks[slots] = keys[left[won]], left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ranks[at], NONE)
        left = np.flatnonzero((seen != keys) & (seen != -1))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (seen != -1)]
        return out


class SegmentTree:
    """Leftmost minimum of a list under point updates."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(1, (len(values) - 1).bit_length())
        none = int(NONE)
        self.low = [none] * self.size + values + [none] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            self.low[i] = min(self.low[2 * i], self.low[2 * i + 1])

    def set(self, i: int, value: int) -> None:
        low = self.low
        i += self.size
        low[i] = value
        while i > 1:
            i >>= 1
            new = min(low[2 * i], low[2 * i + 1])
            if new == low[i]:
                break
            low[i] = new

    def root(self) -> tuple[int, int]:
        """The least value, and where it is first."""
        least, i = self.low[1], 1
        while i < self.size:
            i = 2 * i + (self.low[2 * i] != least)
        return least, i - self.size


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in (vocab | self.special).items()}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.pairs = PairRanks(np.array([[vocab[a], vocab[b]] for a, b in pairs], np.int64).reshape(-1, 2))
        self.made = np.array([vocab[a + b] for a, b in pairs] + [0], np.int32)
        chars = _byte_chars()
        self.inner = np.array([vocab.get(c, 0) for c in chars], np.int32)
        self.last = np.array([vocab.get(c + self.end, 0) for c in chars], np.int32)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = _pattern(spec)
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}") + r"|\n")
        #: bytes of chunks that are not taken apart by classes of bytes; all if the pattern is not the one this has code for
        self.hard = np.ones(256, bool)
        if pattern == PATTERN:
            self.hard[:128] = False
            self.hard[[39, *(x.encode()[0] for x in self.special)]] = True

    def prepare(self, chunks: list[bytes]) -> list[list[bytes | int]]:
        """The pieces of each chunk in UTF-8; the ids of special tokens in their places."""
        text = b"\n".join(chunks).decode()
        parts = self.splits.split(text) if any(x in text for x in self.special) else [text]
        out: list[list[bytes | int]] = [[]]
        for part in parts:
            if part in self.special:
                out[-1].append(self.special[part])
                continue
            # characters are lower-cased one by one, so a sigma has one form
            part = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            # a byte that UTF-8 never has stands between pieces
            lines = b"\xff".join([p.encode() for p in self.pieces.findall(part)]).split(b"\n")
            out[-1] += filter(None, lines[0].split(b"\xff"))
            out += [list(filter(None, line.split(b"\xff"))) for line in lines[1:]]
        return out

    # -------------------------------------------------------------- one piece, a tree of its own
    def encode_long(self, piece: bytes) -> list[int]:
        ids = [int(x) for x in self.inner[np.frombuffer(piece, np.uint8)]]
        ids[-1] = int(self.last[piece[-1]])
        n, rank, made = len(ids), self.pairs.scalar, self.made
        if n == 1:
            return ids
        none = int(NONE)
        tree = SegmentTree([rank.get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while True:
            least, i = tree.root()
            if least == none:
                break
            j = after[i]
            ids[i] = int(made[least])
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.set(j, none)
            if k < n:
                before[k] = i
            tree.set(i, rank.get(ids[i] << 32 | ids[k], none) if k < n else none)
            if (p := before[i]) >= 0:
                tree.set(p, rank.get(ids[p] << 32 | ids[i], none))
        return [x for x in ids if x >= 0]

    # -------------------------------------------------------------- many short pieces, a row each
    def _encode_rows(self, raw: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: swallowed) of pieces as rows of bytes; the width is a power of two, from 2 on."""
        n, width = raw.shape
        rows = np.arange(n)
        ids = self.inner[raw]
        ids[rows, length - 1] = self.last[raw[rows, length - 1]]
        ids[np.arange(width) >= length[:, None]] = -1
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        # a leaf is rank * width + place, so that equal ranks go to the left
        tree = np.full((n, 2 * width), NONE, np.int32)
        rank = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rank[np.arange(1, width) >= length[:, None]] = NONE
        place = np.arange(width - 1, dtype=np.int32)
        tree[:, width : 2 * width - 1] = np.where(rank == NONE, NONE, np.where(rank == NONE, 0, rank) * np.int32(width) + place)
        size = width
        while size > 1:
            tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
            size //= 2
        flat, fids, fafter, fbefore = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        live = rows[tree[:, 1] != NONE]
        shift = width.bit_length() - 1

        def put(base: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + width
            flat[base + node] = value
            for _ in range(shift):
                node = node >> 1
                pair = base + 2 * node
                flat[base + node] = np.minimum(flat[pair], flat[pair + 1])

        while len(live):
            base, own = live * (2 * width), live * width
            root = flat[base + 1]
            i, least = root & (width - 1), root >> shift
            j = fafter[own + i]
            k = fafter[own + j]
            new = self.made[least]
            fids[own + i], fids[own + j], fafter[own + i] = new, -1, k
            put(base, j, np.full(len(live), NONE, np.int32))
            inside = k < length[live]
            fbefore[(own + k)[inside]] = i[inside]
            follow = np.where(inside, fids[own + np.minimum(k, width - 1)], -1)
            rank = self.pairs.find(new, follow)
            rank[~inside] = NONE
            put(base, i, np.where(rank == NONE, NONE, np.where(rank == NONE, 0, rank) * np.int32(width) + i).astype(np.int32))
            p = fbefore[own + i]
            has = np.flatnonzero(p >= 0)
            if len(has):
                p = p[has]
                rank = self.pairs.find(fids[own[has] + p], new[has])
                put(base[has], p, np.where(rank == NONE, NONE, np.where(rank == NONE, 0, rank) * np.int32(width) + p).astype(np.int32))
            live = live[flat[base + 1] != NONE]
        kept = ids >= 0
        return ids[kept], kept.sum(1)

    def encode_words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has."""
        n, length = len(words.size), words.size.astype(np.int32)
        # the power of two that holds a piece; 1: a single byte, 0: a tree of its own
        width = np.where(length > 64, 0, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
        buf, count = np.frombuffer(words.raw, np.uint8), np.zeros(n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.unique(width).tolist():
            who = np.flatnonzero(width == w)
            if w == 0:
                found = [self.encode_long(words.word(i)) for i in who.tolist()]
                count[who] = [len(f) for f in found]
                done.append((who, np.array([x for f in found for x in f], np.int32)))
                continue
            if w == 1:
                count[who] = 1
                done.append((who, self.last[buf[words.starts[who]]]))
                continue
            step = max(1, (1 << 17) // w)
            for s in range(0, len(who), step):
                some = who[s : s + step]
                inside = np.arange(w) < length[some][:, None]
                raw = np.where(inside, buf[np.minimum(words.starts[some][:, None] + np.arange(w), len(buf) - 1)], 0)
                ids, count[some] = self._encode_rows(raw, length[some])
                done.append((some, ids))
        out = np.empty(count.sum(), np.int32)
        first = np.cumsum(count) - count
        for who, ids in done:
            out[_runs(first[who], count[who])] = ids
        return out, count

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        starts = np.concatenate([[0], ends])[:-1]
        ids, count = self.encode_words(Words(b"".join([*pieces, b" " * 8]), starts, ends))
        raw, at = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
        return [raw[a:z] for a, z in zip([0, *at], at, strict=False)]

    def encode_easy(self, words: Words, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks without hard bytes, one after another, and how many each has. By classes of ASCII bytes: letters
        are a piece together, each digit is one, and all else together."""
        size = words.size[who]
        buf = _LOWER[np.frombuffer(words.raw, np.uint8)[_runs(words.starts[who], size)]]
        kind = _KIND[buf]
        edge = np.ones(len(buf), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        first = np.cumsum(size) - size
        edge[first] = True
        starts = np.flatnonzero(edge)
        pieces = Words(buf.tobytes() + b" " * 8, starts, np.append(starts[1:], len(buf)))
        codes, one = pieces.distinct()
        ids, count = self.encode_words(Words(pieces.raw, pieces.starts[one], pieces.ends[one]))
        at, n = np.cumsum(count) - count, count[codes]
        return ids[_runs(at[codes], n)], np.add.reduceat(n, np.searchsorted(starts, first)) if len(who) else n

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk, a text without white space of ASCII at least. White space ends pieces, so a text's ids
        are those of its chunks in turn."""
        parts = self.prepare(chunks) if chunks else []
        distinct = list({p for ps in parts for p in ps if p.__class__ is bytes})
        known: dict = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
        known |= {i: struct.pack("<I", i) for i in self.special.values()}
        return [known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps]) for ps in parts]

    def encode(self, text: str) -> list[int]:
        return encode_batch(Cache(self), [text.encode()])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: its library puts a space between the tokens' strings."""
        return " ".join([self.strings[i] for i in ids])


def unpacked(ids: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Cache(dict):
    """Ids of hard chunks seen, as bytes; emptied when it is full. One to a worker process, which tasks share."""

    def __init__(self, own: Encoder):
        super().__init__()
        self.encoder = own

    def of(self, chunks: list[bytes]) -> list[bytes]:
        new = [c for c in chunks if c not in self]
        if len(self) + len(new) > CACHE:
            self.clear()
            new = chunks
        self.update(zip(new, self.encoder.encode_chunks(new), strict=True))
        return [self[c] for c in chunks]


@functools.lru_cache(maxsize=4)
def cache(path: str) -> Cache:
    return Cache(encoder(path))


def encode_batch(known: Cache, texts: list[bytes]) -> list[np.ndarray]:
    """Each text's ids. Distinct chunks are encoded once; then their ids are put in a row for all texts at once."""
    words, offsets = Words.of(texts)
    codes, one = words.distinct()
    words = Words(words.raw, words.starts[one], words.ends[one])
    hard = np.concatenate([[0], np.cumsum(known.encoder.hard[np.frombuffer(words.raw, np.uint8)])])
    hard = hard[words.ends] != hard[words.starts]
    easy, other = np.flatnonzero(~hard), np.flatnonzero(hard)
    ids, count = known.encoder.encode_easy(words, easy)
    found = known.of([words.word(i) for i in other.tolist()])
    ids = np.concatenate([ids, np.frombuffer(b"".join(found), "<u4").astype(np.int32)])
    size, first = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
    size[easy], size[other] = count, np.fromiter(map(len, found), np.int64, len(found)) // 4
    order = np.concatenate([easy, other])
    first[order] = np.cumsum(size[order]) - size[order]
    n = size[codes]
    out = ids[_runs(first[codes], n)]
    edges = np.concatenate([[0], np.cumsum(n)])[offsets].tolist()
    return [out[a:z] for a, z in zip(edges, edges[1:], strict=False)]


def in_batches(df: DataFrame, make_rows, schema: str) -> DataFrame:
    """make_rows() gives a function from (ids column, texts) to record batches; it gets about TOGETHER bytes of texts at once."""

    def make():
        rows = make_rows()
        held: list[pa.RecordBatch] = []

        def flush():
            if held:
                one = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                yield from rows(one.column(0).combine_chunks(), one.column(1).to_pylist())

        def run(b: pa.RecordBatch):
            held.append(b)
            if sum(x.nbytes for x in held) >= TOGETHER:
                yield from flush()

        def close():
            yield from flush()
            if hasattr(rows, "close"):
                yield from rows.close()

        run.close = close
        return run

    return map_arrow(df, make, schema)


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row: the operator itself, with real outputs."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        known = cache(path)

        def rows(own, texts):
            ids = encode_batch(known, texts)
            for k in range(0, len(ids), ARROW_ROWS):
                some = ids[k : k + ARROW_ROWS]
                yield batch(id=own.slice(k, ARROW_ROWS), ids=pa.array(some, pa.list_(pa.int32())), decoded=[known.encoder.decode(x.tolist()) for x in some])

        return rows

    return in_batches(df.select(F.col(id_col), utf8(text_col)), make, f"{id_col} {kind}, ids array<int>, decoded string")


def bpe_digest(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what bpe_encode makes, as digests. One narrow stage, no shuffle."""

    def make():
        known = cache(path)
        numbers = [str(i) for i in range(max(known.encoder.strings, default=0) + 1)]
        sha = hashlib.sha256

        def rows(own, texts):
            ids = [x.tolist() for x in encode_batch(known, texts)]
            digest = lambda strings, x: sha(" ".join([strings[i] for i in x]).encode()).hexdigest()
            yield batch(doc_id=own, n_tokens=pa.array([len(x) for x in ids], pa.int64()), ids_sha256=[digest(numbers, x) for x in ids], decoded_sha256=[digest(known.encoder.strings, x) for x in ids])

        return rows

    return in_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
