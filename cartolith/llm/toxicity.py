"""Toxicity by noisy-channel deobfuscation (operator 1).

Disguised words are restored before they are scored. A word is read as a lattice of characters: digits and
signs stand for themselves or for the letters they resemble, a letter that repeats the one before it may be
nothing, and signs or spaces between letters may be nothing or a border between words. The Viterbi path under a
character trigram model, with the channel's costs, is the restored text. The trigrams are counted over all
documents, in a table whose size the alphabet fixes; the words that prove telling are added to the model as
prior, so that ambiguous signs fall to them.

Telling features are whole words, word beginnings, and beginnings that several distinct words of a document share: stems
that are inflected. Words that begin alike are a family, and a word counts by itself only where it is the one of its family.
Counts in toxic and other documents come from at most ``sample`` labelled documents (of the least hash of their id; a
parameter), those of the same set of words counted once; features whose association is significant are kept, and
longer beginnings that clear a word of them. A document's score is one minus the product, over its telling
families, of the probability that it is not toxic despite the family.

Plain words have a lattice of one path, so only disguised ones are decoded: those with signs or digits between or
beside letters, look-alike signs at either end among them, or with repeats. Both the reading with such ends and the one
without count. Digits alone are numbers. Defined cases: a null or empty text
has the share of toxic documents without telling words as its score; without labels every score is 0; texts of
any length are read whole; repeated rows get the same answer; rows with a null doc_id are scored, never learned from.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import batch, crc_mod, distinct_words, map_arrow, utf8, written

# fixed values: the alphabet (a border, the letters of Latin-1, any other letter) and what signs resemble
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
OTHER = len(LETTERS) + 1
SIZE = OTHER + 1
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "h", "£": "l", "¡": "i"}
_ID = {c: i + 1 for i, c in enumerate(LETTERS)}
# channel costs, in natural logarithms
LOOKALIKE, DROPPED_REPEAT, KEPT_REPEAT, JOINED, BORDER, DROPPED_SIGN = -1.5, -1.0, -0.7, -0.5, -1.0, -4.0
PREFIXES = (4, 5, 6, 7)
#: letters that make a family, and those of stems that its words share
FAMILY, STEMS = 5, (5, 6, 7)
#: other documents from which on a longer beginning clears its words
CLEAR = 3
CACHE = 300_000
_RUNS = re.compile(r"[^\W\d_]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SIGNS = "".join(c for c in LOOKS if not c.isdigit())
_OUTER = re.compile(rf"^(?:(?![{re.escape(_SIGNS)}])[\W_])+|(?:(?![{re.escape(_SIGNS)}])[\W_])+$")
_TRIPLE = re.compile(r"(.)\1\1")
_LONG_REPEAT = re.compile(r"(.)\1{3,}", re.S)
_REPEATS = re.compile(r"(.)\1+")
_INSIDE = re.compile(r"[^\W\d_][\d\W_]+[^\W\d_]|[\d@$!|+(€*#£¡][^\W\d_]|[^\W\d_][\d@$|+(€*#£¡]")

_CODES = np.zeros(0x110000, np.uint8)
for _c in range(0x110000):
    if chr(_c).isalpha():
        _l = chr(_c).lower()
        _CODES[_c] = _ID.get(_l, OTHER)


def symbol(c: str) -> int:
    return _ID.get(c) or (OTHER if c.isalpha() else 0)


# ------------------------------------------------------------------ the character model
def trigram_counts(df: DataFrame) -> DataFrame:
    """(gram, n) over all texts; grams are numbers below SIZE ** 3."""

    def make():
        total = np.zeros(SIZE**3, np.int64)

        def run(b: pa.RecordBatch):
            text = "  ".join(["", *(t.decode() for t in b.column(0).to_pylist()), ""])
            s = _CODES[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int32)
            np.add(total, np.bincount((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:], minlength=SIZE**3), out=total)
            return ()

        def close():
            has = np.flatnonzero(total)
            yield batch(gram=pa.array(has, pa.int64()), n=total[has])

        run.close = close
        return run

    return map_arrow(df.select(utf8().alias("text")), make, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities [before, last, next], interpolated with bigrams, unigrams and a uniform share."""
    c = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
    c[0, 0, 0] = 0
    part = lambda x: x / np.maximum(1e-9, x.sum(-1, keepdims=True))
    one = 0.98 * part(c.sum((0, 1))) + 0.02 / SIZE
    two = 0.9 * part(c.sum(0)) + 0.1 * one
    return np.log(0.85 * part(c) + 0.15 * two[None]).astype(np.float32)


def with_words(counts: np.ndarray, words: dict[str, float]) -> np.ndarray:
    """Counts with words added, each at its weight of a part in a thousand of all grams."""
    out = counts.astype(np.float64)
    unit = max(1.0, out.sum()) / 1000
    for w, weight in words.items():
        s = [0, 0, *(symbol(c) for c in w), 0, 0]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            out[(a * SIZE + b) * SIZE + c] += weight * unit
    return out


def decode(raw: str, model: np.ndarray) -> str:
    """The likeliest plain reading of a lower-cased string; words have spaces between."""
    # state: the last two symbols -> (score, (path so far, character))
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    letters_only = {c: (symbol(c), c) for c in set(raw)}
    for i, c in enumerate(raw):
        sym = letters_only[c][0]
        arcs: list[tuple[float, int | None, str]] = []
        if sym:
            if i and raw[i - 1] == c:
                arcs = [(DROPPED_REPEAT, None, ""), (KEPT_REPEAT, sym, c)]
            else:
                arcs = [(0.0, sym, c)]
        else:
            for x in LOOKS.get(c, ""):
                arcs.append((LOOKALIKE, _ID[x], x))
            if i and raw[i - 1] == c and c in LOOKS:
                arcs.append((DROPPED_REPEAT, None, ""))
            joined = JOINED if c in " .-_" else DROPPED_SIGN
            arcs += [(joined, None, ""), (BORDER, 0, " ")]
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for cost, s, out in arcs:
                if s is None or (s == 0 and b == 0):
                    key, value, step = (a, b), score + cost, path
                else:
                    key, value, step = (b, s), score + cost + float(model[a, b, s]), (path, out)
                if key not in new or value > new[key][0]:
                    new[key] = (value, step)
        states = new
    _, path = max((v + float(model[a, b, 0]) if b else v, k) for k, ((a, b), (v, _)) in enumerate(states.items()))
    at = list(states.values())[path][1]
    out: list[str] = []
    while at is not None:
        out.append(at[1])
        at = at[0]
    return "".join(reversed(out)).strip()


class Restorer:
    """Plain words of chunks (texts between white space), disguised ones decoded."""

    def __init__(self, model: np.ndarray, watched: set[str] = frozenset()):
        self.model = model
        #: beginnings of telling words with repeats taken out: what repeats might hide
        self.watched = {_REPEATS.sub(r"\1", w) for w in watched}
        self.lengths = sorted({len(w) for w in self.watched})

    def words(self, chunk: str) -> list[str]:
        """Of a lower-cased chunk."""
        plain = _EDGES.sub("", chunk)
        found = _RUNS.findall(plain)
        if len(chunk) > 64:  # longer than a word: joined words, or one with long repeats
            chunk = _LONG_REPEAT.sub(r"\1\1\1", chunk)
            plain = _EDGES.sub("", chunk)
        outer = _OUTER.sub("", chunk)
        out = list(found)
        if found and self.disguised(plain):
            out += self.read(plain)
        if outer != plain and (found or (len(outer) > 2 and len(set(outer)) > 1)):  # signs at the edges may be letters
            out += self.read(outer)
        return out

    def disguised(self, plain: str) -> bool:
        if _TRIPLE.search(plain) or (not plain.isalpha() and _INSIDE.search(plain)):
            return True
        return bool(self.watched) and (short := _REPEATS.sub(r"\1", plain)) != plain and any(short[:n] in self.watched for n in self.lengths)

    def read(self, raw: str) -> list[str]:
        return decode(raw, self.model).split()


SEPARATORS = (b"-", b".", b"_", b"/", b"~", b",", b"\xc2\xb7")


def spaced_runs(codes: np.ndarray, single: np.ndarray, between: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of runs of at least three chunks of one letter; lone separators may stand between."""
    flag = np.concatenate([[False], (single | between)[codes], [False]])
    letters = np.concatenate([[0], np.cumsum(single[codes])])
    edge = np.flatnonzero(flag[1:] != flag[:-1])
    return [(a, z) for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if letters[z] - letters[a] >= 3]


def documents_words(texts: list[bytes], restorer: Restorer, known: dict):
    """Yields each text's (codes of its chunks, restored words of spaced runs); first a list: words of each chunk.

    known: a cache from chunk to its words."""
    lowered = [" ".join(t.decode().lower().split()).encode() for t in texts]  # all white space of Unicode, not only of ASCII
    chunks, codes, offsets = distinct_words(lowered)
    if len(known) > CACHE:
        known.clear()
    for c in chunks:
        if c not in known:
            known[c] = restorer.words(c.decode())
    yield [known[c] for c in chunks]
    single = np.fromiter(((len(c) == 1 and c.isalnum()) or (len(c) == 2 and c[0] > 127) or c in (b"@", b"$", b"!", b"|", b"+", b"*") for c in chunks), bool, len(chunks))
    between = np.fromiter((c in SEPARATORS for c in chunks), bool, len(chunks))
    at = offsets.tolist()
    for a, z in zip(at, at[1:], strict=False):
        own, extra = codes[a:z], []
        for s, e in spaced_runs(own, single, between):
            extra += restorer.read(" ".join(c.decode() for i in own[s:e].tolist() if (c := chunks[i]) not in SEPARATORS))
        yield own, extra


def features(word: str) -> list[str]:
    """Of a word, the longest first."""
    return ["^" + word + "$"] + ["^" + word[:n] for n in reversed(PREFIXES) if len(word) >= n]


def families(chunks) -> dict[str, dict[str, set[str]]]:
    """Beginning -> distinct words that have it -> their readings. chunks: the words that each chunk may be."""
    out: dict[str, dict[str, set[str]]] = {}
    for words in chunks:
        first: dict[str, str] = {}
        for w in words:
            family = w[:FAMILY]
            out.setdefault(family, {}).setdefault(first.setdefault(family, w), set()).add(w)
    return out


def shared(members) -> list[str]:
    """Features of what several words of a family have in common."""
    stems = Counter(w[:n] for w in members for n in STEMS if len(w) >= n)
    return [f"^{s}+" for s, k in stems.items() if k > 1]


def document_features(chunks) -> set[str]:
    out: set[str] = set()
    for members in families(chunks).values():
        if len(members) > 1:
            out.update(shared(members))
        else:
            for words in members.values():
                out.update(f for w in words for f in features(w))
    return out


def _read(own: np.ndarray, words: list[list[str]], extra: list[str]) -> list:
    """The words of a document's distinct chunks, and of its spaced runs."""
    return [words[i] for i in np.unique(own).tolist()] + [(w,) for w in sorted(set(extra))]


# ------------------------------------------------------------------ learning
def feature_counts(docs: DataFrame, sampled: DataFrame, model) -> DataFrame:
    """(feature, toxic, other): groups of copies that have it. sampled: (doc_id, label), small."""

    def make():
        restorer, known = Restorer(model.value), {}

        def run(b: pa.RecordBatch):
            parts = documents_words(b.column(1).to_pylist(), restorer, known)
            words = next(parts)
            rows = defaultdict(list)
            for label, (own, extra) in zip(b.column(0).to_pylist(), parts, strict=True):
                chunks = _read(own, words, extra)
                have = {w for ws in chunks for w in ws}
                if not have:
                    continue
                group = xxhash.xxh3_64_intdigest("\n".join(sorted(have))) - 2**63  # shared by texts of the same words alone
                for f in document_features(chunks):
                    rows["feature"].append(f)
                    rows["label"].append(int(label > 0))
                    rows["copies"].append(group)
            if rows:
                yield batch(feature=rows["feature"], label=pa.array(rows["label"], pa.int32()), copies=pa.array(rows["copies"], pa.int64()))

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).join(F.broadcast(sampled), "doc_id")
    found = map_arrow(rows.select("label", "text"), make, "feature string, label int, copies long")
    once = found.groupBy("feature", "label", "copies").agg(F.count("*").alias("rows"))
    return once.groupBy("feature").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("other"))


def _likelihood_ratio(k: float, n: float, p: float) -> float:
    """Twice the log-likelihood gained by a rate of its own."""
    q = k / n
    return 2 * ((k * np.log(q / p) if k else 0) + ((n - k) * np.log((1 - q) / (1 - p)) if k < n else 0))


class Lexicon:
    def __init__(self, rows: list[tuple[str, int, int]], base: float, rest: float, cleared: frozenset[str] = frozenset()):
        """rows: telling features with their toxic and other counts; rest: the toxic share where none is found; cleared: what is not telling though a shorter beginning is."""
        self.p = {f: (k + base) / (k + m + 1) for f, k, m in rows}
        self.rest, self.cleared = rest, cleared
        self.stems = {f[1:-1][:FAMILY] for f in self.p if f[-1] == "+"}

    def of(self, word: str) -> float:
        """Of a word by itself: by the longest beginning that is known."""
        for f in features(word):
            if f in self.p:
                return self.p[f]
            if f in self.cleared:
                return 0.0
        return 0.0

    def matters(self, words) -> bool:
        return any(w[:FAMILY] in self.stems or self.of(w) for w in words)

    def left(self, chunks) -> float:
        """The probability that a document with these chunks (those that matter) is not toxic."""
        out = 1 - self.rest
        for _, members in sorted(families(chunks).items()):
            p = max(self.of(w) for words in members.values() for w in words)
            if len(members) > 1:
                p = max([p, *(self.p.get(f, 0.0) for f in shared(members))])
            out *= 1 - p
        return out

    def prior(self) -> dict[str, float]:
        """Whole telling words, and beginnings of which no longer one is telling: in order, a longer one follows."""
        order = sorted(self.p)
        return {f.strip("^$+"): self.p[f] for f, g in zip(order, [*order, ""][1:], strict=True) if f[-1] in "$+" or not g.startswith(f)}


def learn(docs: DataFrame, labels: DataFrame, sample: int, significance: float) -> tuple[Lexicon, np.ndarray]:
    counts = np.zeros(SIZE**3)
    for r in trigram_counts(docs).collect():  # SIZE ** 3 rows at most
        counts[r.gram] = r.n
    model = trigram_model(counts)
    spark = docs.sparkSession
    kept = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    kept = kept.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (crc_mod("doc_id", 4) != 2))
    kept = kept.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    kept = spark.createDataFrame([tuple(r) for r in kept.collect()], "doc_id long, label int")  # sample rows at most
    n, ones = kept.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not ones:
        return Lexicon([], 0.0, 0.0), model
    base = min(ones / n, 0.5)
    least = max(2, int(significance / (2 * np.log(1 / base))) if base < 0.5 else 8)
    found = written(feature_counts(docs, kept, spark.sparkContext.broadcast(model)), "toxicity-features")  # of the sample
    telling = found.where((F.col("toxic") >= least) & (F.col("toxic") >= 3 * F.col("other")))
    rows = [(r.feature, r.toxic, r.other) for r in telling.collect() if _likelihood_ratio(r.toxic, r.toxic + r.other, base) >= significance]
    begun = [F.substring("feature", 1, n + 1).isin([f for f, _, _ in rows if f[-1] not in "$+" and len(f) == n + 1]) for n in PREFIXES]
    clear = found.where((F.col("other") >= CLEAR) & (F.col("other") > F.col("toxic")) & ~F.col("feature").endswith("+") & functools.reduce(lambda a, b: a | b, begun))
    cleared = frozenset(r.feature for r in clear.select("feature").collect())  # of the sample's words
    lexicon = Lexicon(rows, base, 0.0, cleared)
    # what telling words leave unexplained, by the sample's own counts
    covered = Counter()
    restorer = Restorer(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).join(F.broadcast(kept), "doc_id")

    def make():
        known: dict = {}

        def run(b: pa.RecordBatch):
            parts = documents_words(b.column(1).to_pylist(), restorer, known)
            words = next(parts)
            yield batch(label=b.column(0), told=[lexicon.left(ws for ws in _read(own, words, extra) if lexicon.matters(ws)) < 1 for own, extra in parts])

        return run

    for r in map_arrow(texts.select("label", "text"), make, "label int, told boolean").groupBy("label", "told").count().collect():
        covered[r.label, r.told] += r["count"]
    lexicon.rest = covered[1, False] / max(1, covered[1, False] + covered[0, False])
    return lexicon, trigram_model(with_words(counts, lexicon.prior()))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 8000, significance: float = 30.0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; learns from labels of rows whose crc32(doc_id) mod 4 is not 2."""
    lexicon, model = learn(docs, labels, sample, significance)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, model))

    def make():
        lex, lm = shared.value
        restorer, known, rated = Restorer(lm, {f.strip("^$+") for f in lex.p}), {}, {}

        def run(b: pa.RecordBatch):
            parts = documents_words(b.column(2).to_pylist(), restorer, known)
            words = next(parts)
            if len(rated) > CACHE:
                rated.clear()
            matters = np.zeros(len(words), bool)
            for i, ws in enumerate(words):
                for w in ws:
                    if (x := rated.get(w)) is None:
                        x = rated[w] = lex.matters((w,))
                    if x:
                        matters[i] = True
                        break
            score = []
            for own, extra in parts:
                score.append(1 - lex.left(_read(own[matters[own]], words, [w for w in extra if lex.matters((w,))])))
            score = np.array(score)
            yield batch(doc_id=b.column(0), held_out=b.column(1), score=score, predicted=pa.array(score >= threshold).cast(pa.int32()))

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out"), utf8().alias("text"))
    return map_arrow(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def restored_texts(docs: DataFrame, labels: DataFrame, sample: int = 8000, significance: float = 30.0) -> DataFrame:
    """(doc_id, restored): every text as read through the channel, a real output of the operator."""
    lexicon, model = learn(docs, labels, sample, significance)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, model))

    def make():
        lex, lm = shared.value
        restorer = Restorer(lm, {f.strip("^$+") for f in lex.p})

        def run(b: pa.RecordBatch):
            out = []
            for t in b.column(1).to_pylist():
                parts = documents_words([t], restorer, {})
                words = next(parts)
                own, extra = next(parts)
                out.append(" ".join([w for i in own.tolist() for w in words[i]] + extra))
            yield batch(doc_id=b.column(0), restored=out)

        return run

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), make, "doc_id long, restored string")
