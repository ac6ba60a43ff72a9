"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation (operator 3).

1. A narrow stage makes, of each document, the set of its shingles (64-bit hashes), MinHash samples, band
   keys, a fingerprint of the set, and the odd sketch: the samples are hashed into a bitmap of which each bit
   is the parity of what fell on it. The XOR of two sketches has few bits if the sets are alike, and its
   population count estimates their similarity.
2. Documents of equal sets are one class, which the fingerprint names; classes are the nodes from here on.
3. Bands with the same members are one bucket. A bucket of many members is dealt into chunks; a cell is a
   chunk with the first chunk. In a cell sketches and sizes come first: members that agree within a margin of
   five standard errors with one of smaller number hang on it, each class on one over all cells, and full sets
   decide, exactly, of these pairs. In what is then left unconnected, members that sketches and sizes connect
   are groups, equal groups of several cells are one, and full sets decide of the pairs whose sketches agree.
   Only sets of members that sketches let pass are made and moved. Groups give a star of edges for each
   connected part, never all pairs.
4. Of buckets of more than one chunk that still hold several components, the pairs of chunks of different
   components are tried the same way, so no link between components is lost. Only classes whose sizes allow the
   similarity meet there: each is in the bucket of its size level and in that of the next. As only sketches meet
   there, these chunks are of WIDE members, so that a member is repeated once for each WIDE of its bucket; groups that
   come out with more than two chunks' members are dealt into pairs of chunks before their sets are moved.
5. Components are found by large-star and small-star steps over the edges, and over those between the classes of
   an id that has several texts.

With bands of 5 rows, a pair at similarity s is met with probability 1 - (1 - s^5)^25: 0.9999996 at 0.85,
0.99995 at 0.8.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; a null doc_id is
linked with nothing, has a null component and is kept; rows that repeat a doc_id are that document again, with
all its texts, and get the same answer; other columns, of any name, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import BROADCAST_BYTES, batch, has_at_most, map_arrow, mix, released, shingle_hashes, shuffles_removed, utf8, word_hashes, written
from cartolith.operators.components import connected_components

SAMPLES, BANDS, ROWS, BITS, CHUNK = 128, 25, 5, 512, 256
#: Members of a chunk where only sketches are compared.
WIDE = 2048
_RNG = np.random.RandomState(7)
_A = (_RNG.randint(0, 2**31, SAMPLES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.randint(0, 2**32, SAMPLES, dtype=np.int64).astype(np.uint32)
_ROW = _RNG.randint(0, 2**62, ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its runs of n lower-cased words."""
    words, at = word_hashes([t.lower() for t in texts])
    return [np.unique(shingle_hashes(words[a:z], n)) for a, z in zip(at, at[1:], strict=False)]


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES minima of each set, none of them empty."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out, buf = np.empty((len(sets), SAMPLES), np.uint32), np.empty_like(x)
    for i in range(SAMPLES):
        np.multiply(x, _A[i], out=buf)
        np.add(buf, _B[i], out=buf)
        out[:, i] = np.minimum.reduceat(buf, at)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    part = samples[:, : BANDS * ROWS].astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    return mix((mix(part) * _ROW).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """BITS parities of each row's samples, packed."""
    n = len(samples)
    bit = mix(samples.astype(np.uint64) << np.uint64(8) | np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(BITS)
    flat = bit.astype(np.int64) + np.arange(n)[:, None] * BITS
    return np.packbits((np.bincount(flat.ravel(), minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS), axis=1)


def estimated(differing_bits: np.ndarray) -> np.ndarray:
    """Similarity from the population count of the XOR of two odd sketches."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1e-9, 1 - 2 * np.minimum(differing_bits, BITS // 2 - 1) / BITS))


def _most_bits(percent: int) -> int:
    """The largest population count at which a similarity of percent is within five standard errors."""
    s = percent / 100
    low = s - 5 * np.sqrt(s * (1 - s) / SAMPLES + (BITS / (4 * SAMPLES)) ** 2 * 4 / BITS)
    counts = np.arange(BITS // 2)
    return int(counts[estimated(counts) >= low].max())


def _prints(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    """What tells sets apart: their size and two sums over their members."""
    f1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    f2 = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
    return {"n_shingles": pa.array([len(s) for s in sets], pa.int64()), "f1": pa.array(f1), "f2": pa.array(f2)}


def _features(df: DataFrame, n: int) -> DataFrame:
    def make():
        def run(b: pa.RecordBatch):
            sets = shingle_sets(b.column(1).to_pylist(), n)
            full = [s for s in sets if len(s)]
            samples = minhash(full) if full else np.empty((0, SAMPLES), np.uint32)
            keys, sketches = iter(band_keys(samples)), iter(odd_sketch(samples))
            yield batch(
                doc_id=b.column(0), **_prints(sets),
                buckets=pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                sketch=pa.array([next(sketches).tobytes() if len(s) else None for s in sets], pa.binary()),
            )

        return run

    return map_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), make, "doc_id long, n_shingles long, f1 long, f2 long, buckets array<long>, sketch binary")


def _class():
    """The class of a row of features, or of a set: the same number for both."""
    return F.xxhash64("f1", "f2", "n_shingles")


def _sets(df: DataFrame, n: int) -> DataFrame:
    """(rep, shingles): the class and the set of each text."""

    def make():
        def run(b: pa.RecordBatch):
            sets = shingle_sets(b.column(0).to_pylist(), n)
            yield batch(**_prints(sets), shingles=pa.array([s.tobytes() for s in sets], pa.binary()))

        return run

    found = map_arrow(df.select(utf8().alias("text")), make, "n_shingles long, f1 long, f2 long, shingles binary")
    return found.select(_class().alias("rep"), "shingles")


def alike(sketches: np.ndarray, size: np.ndarray, i: int, js: np.ndarray, percent: int, most: int) -> np.ndarray:
    """Those of js whose size and sketch let them be linked with i."""
    js = js[100 * np.minimum(size[i], size[js]) >= percent * np.maximum(size[i], size[js])]
    return js[_ONES[sketches[js] ^ sketches[i]].sum(1) <= most]


def cell_groups(parts: list[int], sketches: np.ndarray, size: np.ndarray, percent: int) -> list[np.ndarray]:
    """Members that sketches and sizes connect, if they are of several parts."""
    n, most = len(parts), _most_bits(percent)
    part, root = np.array(parts), np.arange(n)
    for i in range(n - 1):
        js = np.flatnonzero((root[i + 1 :] != root[i]) & (part[i + 1 :] != part[i])) + i + 1
        for r in np.unique(root[alike(sketches, size, i, js, percent, most)]).tolist():
            root[root == r] = root[i]
    groups = [np.flatnonzero(root == r) for r in np.unique(root).tolist()]
    return [g for g in groups if len(g) > 1]


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def cell_edges(ids: list[int], parts: list[int], sketches: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges, as stars, that connect what is linked in a cell. parts: members of the same part are connected already."""
    n, most = len(ids), _most_bits(percent)
    by_part: dict[int, int] = {}
    root = np.array([by_part.setdefault(p, i) for i, p in enumerate(parts)])
    start = root.copy()
    size = np.fromiter(map(len, sets), np.int64, n)
    for i in range(n - 1):
        js = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if not len(js):
            continue
        for j in alike(sketches, size, i, js, percent, most):
            if root[j] == root[i]:
                continue
            if _linked(sets[i], sets[j], percent):
                root[root == root[j]] = root[i]
    out, first = [], {}
    for i in range(n):
        lead = first.setdefault(int(root[i]), i)
        if lead != i and (start[i] == i):  # one edge for each part that was joined
            out.append((ids[i], ids[lead]))
    return out


def _by_cell(rows: DataFrame, keys: list[str], columns: list[str], found, schema: str) -> DataFrame:
    """What found(list of a cell's rows, one a rep) gives, as record batches. columns begin with rep."""

    def make():
        held: dict = {}
        key: list = [None]

        def done():
            out = found(list(held.values())) if len(held) > 1 else None
            held.clear()
            return [out] if out is not None else []

        def run(b: pa.RecordBatch):
            made: list[pa.RecordBatch] = []
            names = list(zip(*(c.to_pylist() for c in b.columns[: len(keys)]), strict=True))
            for k, row in zip(names, zip(*(c.to_pylist() for c in b.columns[len(keys) :]), strict=True), strict=True):
                if key[0] != k:
                    made += done()
                    key[0] = k
                held[row[0]] = row
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]

        run.close = done
        return run

    return map_arrow(rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, *columns), make, schema)


def _matrix(sketches) -> np.ndarray:
    sketches = list(sketches)
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)


def _groups(cells: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(g, rep, part): groups of classes that sketches connect, each once. cells: (k1, k2, k3, rep, part), of which each cell is small."""

    def found(rows: list[tuple]) -> pa.RecordBatch | None:
        reps, parts, sketches, size = zip(*rows, strict=True)
        groups = cell_groups(list(parts), _matrix(sketches), np.array(size), percent)
        if not groups:
            return None
        who, part = np.array(reps), np.array(parts)
        at = np.concatenate(groups)
        sums = [mix(who[g].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part[g].astype(np.uint64)).sum(dtype=np.uint64) for g in groups]
        return batch(g=np.repeat(np.array(sums, np.uint64).view(np.int64), [len(g) for g in groups]), rep=who[at], part=part[at])

    rows = cells.join(classes.select("rep", "sketch", F.col("n_shingles").alias("n")), "rep")
    return _by_cell(rows, ["k1", "k2", "k3"], ["rep", "part", "sketch", "n"], found, "g long, rep long, part long").dropDuplicates(["g", "rep"])


def cell_stars(reps: list[int], sketches: np.ndarray, size: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Members (places) and what each hangs on: the first, by number, whose sketch and size agree."""
    most, order = _most_bits(percent), np.argsort(reps)
    free = np.ones(len(reps), bool)
    who, on = [], []
    for i in order.tolist():
        if free[i]:
            free[i] = False
            js = alike(sketches, size, i, np.flatnonzero(free), percent, most)
            free[js] = False
            who += js.tolist()
            on += [i] * len(js)
    return who, on


def _stars(cells: DataFrame, classes: DataFrame, df: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links of each class with the one class that it hangs on, where full sets agree."""

    def found(rows: list[tuple]) -> pa.RecordBatch | None:
        reps, sketches, size = zip(*rows, strict=True)
        who, on = cell_stars(list(reps), _matrix(sketches), np.array(size), percent)
        reps = np.array(reps)
        return batch(rep=reps[who], hub=reps[on]) if who else None

    rows = cells.join(classes.select("rep", "sketch", F.col("n_shingles").alias("n")), "rep")
    pairs = _by_cell(rows, ["k1", "k2", "k3"], ["rep", "sketch", "n"], found, "rep long, hub long").groupBy("rep").agg(F.min("hub").alias("hub"))
    hanging = pairs = written(pairs, "neardup-pairs")
    # a hub's members are dealt into parts of about CHUNK, each with the hub's set before them
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    pairs = pairs.join(parts, "hub").select("hub", F.expr("pmod(xxhash64(rep), parts)").alias("part"), "rep", F.lit(1).alias("k"))
    rows = pairs.unionByName(parts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("hub").alias("rep"), F.lit(0).alias("k")))
    sets, met = _sets_of(rows.select("rep").distinct(), classes, df, shingle)

    def make():
        hub: dict = {}

        def run(b: pa.RecordBatch):
            linked = []
            for h, part, rep, k, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.frombuffer(x, np.uint64)
                if k == 0:
                    hub.update(key=(h, part), set=own)
                elif hub["key"] == (h, part) and _linked(hub["set"], own, percent):
                    linked.append((rep, h))
            if linked:
                yield batch(a=pa.array([x[0] for x in linked], pa.int64()), b=pa.array([x[1] for x in linked], pa.int64()))

        return run

    dealt = rows.join(sets.select("rep", "shingles"), "rep").repartition("hub", "part").sortWithinPartitions("hub", "part", "k")
    out = written(map_arrow(dealt.select("hub", "part", "rep", "k", "shingles"), make, "a long, b long"), "neardup-stars")
    released(hanging, met)
    return out


def _sets_of(reps: DataFrame, classes: DataFrame, df: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(rep, sketch, shingles) of these classes, made from the text of the least id of each, dealt by rep; and the written table that it reads."""
    met = written(reps.join(classes, "rep").select("rep", "doc_id", "sketch"), "neardup-met")
    ids = met.select(F.col("doc_id").alias("__id")).distinct()
    texts = df.select(F.col("doc_id").cast("long").alias("__id"), "text")
    texts = texts.join(F.broadcast(ids), "__id") if has_at_most(ids, BROADCAST_BYTES // 32) else texts.join(ids, "__id", "left_semi")
    return _sets(texts, shingle).join(met.select("rep", "sketch"), "rep").dropDuplicates(["rep"]), met


def _edges(cells: DataFrame, classes: DataFrame, df: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links between classes of several parts, as stars; cells as in _groups."""

    def found(rows: list[tuple]) -> pa.RecordBatch | None:
        reps, parts, sketches, sets = zip(*rows, strict=True)
        edges = cell_edges(list(reps), list(parts), _matrix(sketches), [np.frombuffer(x, np.uint64) for x in sets], percent)
        return batch(a=pa.array([x[0] for x in edges], pa.int64()), b=pa.array([x[1] for x in edges], pa.int64())) if edges else None

    groups = written(_groups(cells, classes, percent), "neardup-groups")
    sets, met = _sets_of(groups.select("rep").distinct(), classes, df, shingle)
    large = groups.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > 2 * CHUNK).select("g")
    none = F.lit(0).cast("long")
    dealt = groups.select(F.col("g").alias("k1"), none.alias("k2"), none.alias("k3"), "rep", "part")
    if not large.isEmpty():
        dealt = groups.join(large, "g", "left_anti").select(F.col("g").alias("k1"), none.alias("k2"), none.alias("k3"), "rep", "part")
        dealt = dealt.unionByName(_cross_cells(groups.join(large, "g", "left_semi").withColumnRenamed("g", "bucket"), CHUNK))
    out = written(_by_cell(dealt.join(sets, "rep"), ["k1", "k2", "k3"], ["rep", "part", "sketch", "shingles"], found, "a long, b long"), "neardup-edges")
    released(groups, met)
    return out


def near_duplicates(df: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; links are pairs with 100 * intersection >= percent * union."""
    with shuffles_removed(df.sparkSession):
        return _near_duplicates(df, percent, shingle)


def _near_duplicates(df: DataFrame, percent: int, shingle: int) -> DataFrame:
    features = written(_features(df, shingle).withColumn("rep", F.when(F.col("n_shingles") > 0, _class())), "neardup-features")
    some = features.where("n_shingles > 0 and doc_id is not null")
    classes = written(
        some.groupBy("rep").agg(F.min_by(F.struct("doc_id", "n_shingles", "buckets", "sketch"), "doc_id").alias("x")).select("rep", "x.*"),
        "neardup-classes",
    )
    banded = classes.select("rep", F.explode("buckets").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("m"), F.min("rep").alias("lo"), F.bit_xor(F.xxhash64("rep")).alias("sig")).where("m > 1")
    buckets = written(buckets.groupBy("m", "lo", "sig").agg(F.min("bucket").alias("bucket")).select("bucket", "m"), "neardup-buckets")
    dealt = written(banded.join(buckets, "bucket").withColumn("chunks", F.ceil(F.col("m") / CHUNK)).withColumn("c", F.expr("pmod(xxhash64(rep), chunks)")), "neardup-members")
    cells = dealt.select(F.col("bucket").alias("k1"), F.explode(F.expr("if(c = 0, sequence(0L, chunks - 1), array(c))")).alias("k2"), F.lit(0).cast("long").alias("k3"), "rep")
    several = some.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi").select("doc_id", "lo")
    several = some.join(several, "doc_id").where("rep != lo").select(F.col("rep").alias("a"), F.col("lo").alias("b"))
    edges = _stars(cells, classes, df, shingle, percent).unionByName(written(several, "neardup-several"))
    parts = written(connected_components(edges), "neardup-parts")
    of_parts = parts.select(F.col("node").alias("rep"), "component")
    rest = _edges(cells.join(of_parts, "rep", "left").withColumn("part", F.coalesce("component", "rep")), classes, df, shingle, percent)
    edges = edges.unionByName(rest)
    parts = written(connected_components(edges), "neardup-parts")
    large = dealt.where("chunks > 1").select("bucket", "rep")
    if not large.isEmpty():
        # sizes whose quotient is percent or more are of one level or of neighbours
        level = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(1e-9 - np.log(percent / 100)))
        sized = large.join(classes.select("rep", level.alias("level")), "rep").select(F.explode(F.expr("array(xxhash64(bucket, level), xxhash64(bucket, level + 1))")).alias("bucket"), "rep")
        rest = sized.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("part"))
        more = _edges(_cross_cells(rest, WIDE), classes, df, shingle, percent)
        if not more.isEmpty():
            parts = written(connected_components(edges.unionByName(more).unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))), "neardup-parts")
    # a component is named by the least id in it
    named = classes.select("rep", "doc_id").join(parts.select(F.col("node").alias("rep"), "component"), "rep").select("rep", "doc_id", "component")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = written(named.join(least, "component").select("rep", "component_id"), "neardup-linked")
    names = classes.select("rep", "doc_id").join(linked, "rep", "left").select("rep", F.coalesce("component_id", "doc_id").alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = features.select("doc_id", "n_shingles", "rep").join(names, "rep", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _cross_cells(rest: DataFrame, chunk: int) -> DataFrame:
    """Cells (k1: bucket, k2, k3: chunks) for pairs of different parts. rest: (bucket, rep, part).

    A part of at least half a chunk is dealt into chunks of its own; two of those of the same part make no cell."""
    sizes = written(rest.groupBy("bucket", "part").agg(F.count("*").alias("n")), "neardup-part-sizes")
    buckets = sizes.groupBy("bucket").agg(F.count("*").alias("k"), F.coalesce(F.sum(F.expr(f"if(n < {chunk // 2}, n, 0)")), F.lit(0)).alias("small")).where("k > 1")
    big = F.col("n") >= chunk // 2
    placed = rest.join(sizes, ["bucket", "part"]).join(buckets.select("bucket", "small"), "bucket")
    placed = placed.withColumn("own", F.when(big, F.col("part")).otherwise(F.lit(-1).cast("long")))
    placed = placed.withColumn("chunk", F.when(big, F.xxhash64("part", F.expr(f"pmod(xxhash64(rep), ceil(n / {chunk}))"))).otherwise(F.expr(f"pmod(xxhash64(rep), greatest(1, ceil(small / {chunk})))")))
    placed = written(placed.select("bucket", "rep", "part", "own", "chunk"), "neardup-placed")
    chunks = placed.select("bucket", "own", "chunk").distinct()
    other = chunks.select("bucket", F.col("own").alias("own2"), F.col("chunk").alias("chunk2"))
    pairs = chunks.join(other, "bucket").where("chunk <= chunk2 and (own = -1 or own != own2)")
    halves = pairs.select("bucket", "chunk", "chunk2", F.explode(F.array_distinct(F.array("chunk", "chunk2"))).alias("at"))
    return halves.join(placed.select("bucket", F.col("chunk").alias("at"), "rep", "part"), ["bucket", "at"]).select(F.col("bucket").alias("k1"), F.col("chunk").alias("k2"), F.col("chunk2").alias("k3"), "rep", "part")
