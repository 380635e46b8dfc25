"""MinHash near-dedup with an LSH forest.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets form a
class, of which one goes on. MinHash values are arranged in several orders: a tree's label is a
fixed choice of them, and the classes are sorted by label. In each order a class takes the classes
next to it as candidates, as long as their labels share a least prefix; in a crowded region the
next ones share a longer prefix, so the depth adapts by itself. A run of labels with the least
prefix is also tied to its first class. Range partitioning by label and id splits regions of any
size over tasks, and a class has a bounded number of candidates per order.

Candidates whose signatures agree in too few places go (a linked pair fails this with a
probability below 1e-5); the others are confirmed on full sets, first each class's most frequent
neighbours, then those that still join different components, so that a group of thousands doesn't
compare all its pairs. A confirmation sends a hub's text and those of its candidates to one place
in streams of bounded length. Runs with more classes than a class takes neighbours are crowded, as
are those at the edge of a range: where such a run holds several components, the classes outside
its largest are compared with the whole run in blocks of bounded size, first on signatures, then
on full sets of what is left. So a pair that shares a run is lost to the signatures alone. Links
that are found agree with the exact relation; the components are those of the links.

Cases: a null text or one without words has an empty set and is alone; fewer words than a shingle
make one shingle of the whole sequence; a null id can't be linked and is kept; rows with equal ids
are one document, whose links add up; very long texts are hashed whole, in stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .store import discard, materialize, small_batches

#: MinHash values of a set, orders, values of a label, values that neighbours share at least, neighbours a side.
HASHES, TREES, DEPTH, LEAST_DEPTH, NEXT = 128, 32, 12, 5, 3
CACHED_WORDS = 100_000
STRETCH = 1 << 15
#: Rows and shingles of a block of a crowded run, and texts that meet one copy of a hub's.
BLOCK, BLOCK_SHINGLES, LEAVES = 4_000, 2_000_000, 1_000
#: Places of two signatures, by the low two bits of each, that agree at least: 4.9 deviations under what 80 percent gives.
LEAST_EQUAL = 89
#: Neighbours of a class that are confirmed first.
NEAREST = 3
#: Partners of a class that are listed as compared; more than the orders' neighbours give, so only heads of runs have more.
LISTED = 512
#: Up to so many ids (8 bytes each) are broadcast to find their texts, after they have been counted; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
PLANES = ["l0", "l1", "h0", "h1"]
MIX1, MIX2, MIX3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text."""

    def __init__(self, size: int):
        self.size = size
        self.words = _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(words))
        with np.errstate(over="ignore"):
            total = np.full(len(words) - n + 1, n, np.uint64)
            for k in range(n):
                total = _mix(total * MIX3 + hashes[k : k + len(total)])
        return np.unique(total)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of each permutation's least value."""
    a, b = _permutations_once()
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), STRETCH):
            part = shingles[at : at + STRETCH]
            for k in range(HASHES):
                best[k] = min(best[k], (((part ^ b[k]) * a[k]) >> np.uint64(16)).min())
    return (best & np.uint64(0xFFFF)).astype(">u2")


_made: list = []


def _permutations_once() -> tuple[np.ndarray, np.ndarray]:
    if not _made:
        _made.append(_permutations())
    return _made[0]


def planes(signatures: np.ndarray) -> list[np.ndarray]:
    """The low two bits of each value as four longs: low bits of the first and second half, then the bits above."""
    bits = [np.packbits((signatures >> at & 1).astype(np.uint8), axis=1).view(">i8").astype(np.int64) for at in (0, 1)]
    return [bits[0][:, 0], bits[0][:, 1], bits[1][:, 0], bits[1][:, 1]]


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, signature) for each row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles_of = Shingler(shingle)
        for batch in batches:
            sizes, prints, signatures = [], [], []
            for text in batch.column("text"):
                found = shingles_of(text.as_py())
                sizes.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(minhash(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "set_hash", "signature"]
            )

    return source.mapInArrow(sketch, "doc_id long, n_shingles long, set_hash binary, signature binary")


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b, votes) with a < b: classes next to each other in some order, and in how many.

    Rows with no votes are those of crowded runs, and of runs that a range's edge may have cut: a is
    the run's number, b a class in it.
    """
    rng = np.random.default_rng(11)
    places = [rng.permutation(HASHES)[:DEPTH] for _ in range(TREES)]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), ">u2").reshape(n, HASHES)
            keys = np.zeros((TREES, n, 1 + 2 * DEPTH), np.uint8)
            for tree, chosen in enumerate(places):
                keys[tree, :, 0] = tree
                keys[tree, :, 1:] = np.ascontiguousarray(signatures[:, chosen]).view(np.uint8)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(1 + 2 * DEPTH), TREES * n, [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            ids = pa.concat_arrays([batch.column("id")] * TREES)
            sizes = pa.concat_arrays([batch.column("n_shingles")] * TREES)
            for at in range(0, TREES * n, 20_000):
                yield pa.RecordBatch.from_arrays([flat.slice(at, 20_000), ids.slice(at, 20_000), sizes.slice(at, 20_000)], names=["label", "id", "n"])

    ordered = classes.select("id", "n_shingles", "signature").mapInArrow(label, "label binary, id long, n long")
    ordered = ordered.repartitionByRange("label", "id").sortWithinPartitions("label", "id")
    head = 1 + 2 * LEAST_DEPTH

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((0, head), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        first_key, first_id, first_n = b"", 0, 0
        opening = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            whole = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(n, 1 + 2 * DEPTH)
            keys = np.concatenate([last[0], whole[:, :head]])
            ids = np.concatenate([last[1], batch.column("id").to_numpy()])
            sizes = np.concatenate([last[2], batch.column("n").to_numpy()])
            kept = len(last[1])
            pairs = []
            for k in range(1, NEXT + 1):
                b = np.arange(max(kept, k), len(ids))
                b = b[(keys[b] == keys[b - k]).all(axis=1)]
                pairs.append((ids[b - k], ids[b], sizes[b - k], sizes[b]))
            # Each row's run begins at the last row that differs from the one before it.
            starts = np.ones(len(ids), bool)
            starts[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            run = np.maximum.accumulate(np.where(starts, np.arange(len(ids)), 0))
            rows = np.arange(kept, len(ids))
            heads, head_sizes = ids[run[rows]], sizes[run[rows]]
            carried = (run[rows] == 0) & (keys[0].tobytes() == first_key)
            heads, head_sizes = np.where(carried, first_id, heads), np.where(carried, first_n, head_sizes)
            pairs.append((heads, ids[rows], head_sizes, sizes[rows]))
            if not (run[-1] == 0 and keys[0].tobytes() == first_key):
                first_key, first_id, first_n = keys[-1].tobytes(), int(ids[run[-1]]), int(sizes[run[-1]])
            crowded = np.zeros(len(ids), bool)
            if len(ids) > NEXT + 1:
                same = (keys[NEXT + 1 :] == keys[: -NEXT - 1]).all(axis=1)
                for k in range(NEXT + 2):
                    crowded[k : k + len(same)] |= same
            opening = keys[0].copy() if opening is None else opening
            crowded |= (keys == opening).all(axis=1)
            last = keys[-NEXT - 1 :], ids[-NEXT - 1 :], sizes[-NEXT - 1 :]
            a, b, m, n_ = (np.concatenate(x) for x in zip(*pairs, strict=True))
            good = (a != b) & (5 * np.minimum(m, n_) >= 4 * np.maximum(m, n_))
            a, b = a[good], b[good]
            packed, votes = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0, return_counts=True)
            yield rows_of(packed, votes, keys[crowded], ids[crowded])
        if len(last[1]):
            closing = (last[0] == last[0][-1]).all(axis=1)
            yield rows_of(np.zeros((0, 2), np.int64), np.zeros(0, np.int64), last[0][closing], last[1][closing])

    def rows_of(pairs: np.ndarray, votes: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        import xxhash

        runs = np.array([xxhash.xxh64_intdigest(k) for k in (x.tobytes() for x in keys)], np.uint64).view(np.int64)
        columns = np.concatenate([pairs[:, 0], runs]), np.concatenate([pairs[:, 1], ids]), np.concatenate([votes, np.zeros(len(runs), np.int64)]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "votes"])

    return ordered.mapInArrow(neighbours, "a long, b long, votes long").groupBy("a", "b").agg(F.sum("votes").alias("votes"))


def _equal(a: str, b: str) -> str:
    """SQL for the places in which two structs of planes agree."""
    return " + ".join(f"64 - bit_count(({a}.l{k} ^ {b}.l{k}) | ({a}.h{k} ^ {b}.h{k}))" for k in (0, 1))


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in enough places."""
    bits = classes.select("id", F.struct(*PLANES).alias("bits"))
    both = pairs.join(bits.withColumnsRenamed({"id": "a", "bits": "x"}), "a").join(bits.withColumnsRenamed({"id": "b", "bits": "y"}), "b")
    return both.where(f"{_equal('x', 'y')} >= {LEAST_EQUAL}").select(*pairs.columns).distinct()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the rows with one of the ids, equal rows once."""
    ids = materialize(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL")
    found = materialize(source.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "texts")
    if found.groupBy("id").count().where("count > 1").isEmpty():
        return found
    once = materialize(found.dropDuplicates(["id", "text"]), "texts-once")
    discard(found)
    return once


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """The pairs (hub, leaf) whose sets' similarity is ``similarity`` percent or more, as (a, b).

    A hub's text goes before those of up to ``LEAVES`` or so of its leaves, which stream past its
    set: a task holds the hub's set and one more.
    """
    copies = pairs.groupBy("hub").agg(F.ceil(F.count("*") / LEAVES).alias("n_copies"))
    leaves = pairs.join(copies, "hub").select("hub", F.pmod(F.xxhash64("leaf"), "n_copies").alias("copy"), F.col("leaf").alias("id"))
    hubs = copies.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)).alias("copy"), F.col("hub").alias("id"))
    sent = hubs.unionByName(leaves).join(texts, "id").withColumn("is_leaf", F.col("id") != F.col("hub"))
    sent = sent.select("hub", "copy", "is_leaf", "id", "text").repartition("hub", "copy").sortWithinPartitions("hub", "copy", "is_leaf")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = Shingler(shingle)
        place, held = None, []
        for batch in batches:
            a, b = [], []
            for hub, copy, is_leaf, id_, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "copy", "is_leaf", "id", "text")), strict=True):
                own = shingles_of(text)
                if place != (hub, copy):
                    place, held = (hub, copy), []
                if not is_leaf:
                    held.append(own)
                    continue
                for other in held:
                    shared = len(own) + len(other) - len(np.union1d(own, other))
                    if len(own) and 100 * shared >= similarity * (len(own) + len(other) - shared):
                        a.append(min(hub, id_))
                        b.append(max(hub, id_))
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return sent.mapInArrow(compare, "a long, b long")


def _mixed_runs(crowded: DataFrame, parts: DataFrame) -> DataFrame:
    """(run, id, component): the classes of the crowded runs that hold several components."""
    rows = crowded.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").select("run", "id", F.coalesce("component", "id").alias("component"))
    sizes = rows.groupBy("run", "component").agg(F.lit(1).alias("one"))
    return rows.join(sizes.groupBy("run").agg(F.count("*").alias("n_parts")).where("n_parts > 1").select("run"), "run")


def _in_blocks(mixed: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """``mixed``, or the same rows with more columns, with (query, block, chunk): each class outside its run's largest component meets every class of the run.

    Both sides are cut into blocks, so a group holds ``BLOCK`` rows and ``BLOCK_SHINGLES`` shingles or so of either.
    """
    sizes = mixed.groupBy("run", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    runs = sizes.groupBy("run").agg(F.max(F.struct("n", "s", "component")).alias("most"), F.sum("n").alias("n_all"), F.sum("s").alias("s_all"))
    runs = runs.select(
        "run",
        F.col("most.component").alias("largest"),
        F.ceil(F.greatest(F.col("n_all") / BLOCK, F.col("s_all") / BLOCK_SHINGLES)).alias("n_blocks"),
        F.ceil(F.greatest((F.col("n_all") - F.col("most.n")) / BLOCK, (F.col("s_all") - F.col("most.s")) / BLOCK_SHINGLES)).alias("n_chunks"),
    )
    rows = (mixed if wide is None else wide).join(runs.where("n_chunks > 0"), "run")
    place = lambda query, block, chunk: F.struct(F.lit(query).alias("query"), block.alias("block"), chunk.alias("chunk"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own_block, own_chunk = F.pmod(F.xxhash64("id"), "n_blocks"), F.pmod(F.xxhash64("id"), "n_chunks")
    targets, queries = F.transform(upto("n_chunks"), lambda c: place(0, own_block, c)), F.transform(upto("n_blocks"), lambda b: place(1, b, own_chunk))
    places = F.when(F.col("component") != F.col("largest"), F.concat(targets, queries)).otherwise(targets)
    columns = (mixed if wide is None else wide).columns
    return rows.select(*columns, F.explode(places).alias("place")).select(*columns, "place.*")


def _fits(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each query's row, and the rows of other components whose sizes and signatures allow a link and that it wasn't compared with."""
    query, parts, sizes, ids = (table.column(c).to_numpy() for c in ("query", "component", "n_shingles", "id"))
    bits = [table.column(c).to_numpy().view(np.uint64) for c in PLANES]  # of signed numbers numpy counts the bits of the size
    far = np.flatnonzero(query == 0)
    mine = [b[far] for b in bits]
    known, at = np.unique(ids, return_inverse=True)
    lists = table.column("tried").combine_chunks()
    one, other = np.repeat(at, lists.value_lengths().fill_null(0).to_numpy()), lists.flatten().to_numpy()
    there = np.minimum(np.searchsorted(known, other), len(known) - 1)
    here = known[there] == other
    tried = np.unique(np.minimum(one, there)[here] * len(known) + np.maximum(one, there)[here])
    for i in np.flatnonzero(query == 1):
        equal = HASHES - sum(np.bitwise_count((mine[k] ^ bits[k][i]) | (mine[k + 2] ^ bits[k + 2][i])).astype(np.int64) for k in (0, 1))
        fits = (equal >= LEAST_EQUAL) & (parts[far] != parts[i]) & (5 * np.minimum(sizes[far], sizes[i]) >= 4 * np.maximum(sizes[far], sizes[i]))
        found = far[fits]
        if len(tried) and len(found):
            code = np.minimum(at[found], at[i]) * len(known) + np.maximum(at[found], at[i])
            found = found[tried[np.minimum(np.searchsorted(tried, code), len(tried) - 1)] != code]
        yield i, found


def _tried(pairs: DataFrame) -> DataFrame:
    """(id, tried): up to ``LISTED`` others that each end of the compared pairs (a, b) was compared with.

    The others list it too, so only pairs of two classes that both have more may be compared again.
    """
    sides = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    place = F.row_number().over(Window.partitionBy("id").orderBy("other"))  # Spark limits each id's rows before it shuffles them
    return sides.withColumn("place", place).where(F.col("place") <= LISTED).groupBy("id").agg(F.collect_list("other").alias("tried"))


def _possible(mixed: DataFrame) -> DataFrame:
    """(run, id) of the classes of mixed runs that may be linked with one of another component, by size and signature."""

    def compare(table: pa.Table) -> pa.Table:
        hit = np.zeros(table.num_rows, bool)
        for i, fits in _fits(table):
            hit[i] |= len(fits) > 0
            hit[fits] = True
        return table.select(["run", "id"]).filter(pa.array(hit))

    return _in_blocks(mixed).groupBy("run", "block", "chunk").applyInArrow(compare, "run long, id long").distinct()


def _across_crowded_runs(mixed: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """(a, b) with a < b: links of classes of different components in one crowded run, one to each component of a block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = Shingler(shingle)
        for batch in batches:
            sets = [shingles_of(t).view(np.int64) for t in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "shingles"])

    sets = texts.mapInArrow(build, "id long, shingles array<long>")
    dealt = _in_blocks(mixed, mixed.join(sets, "id"))

    def compare(table: pa.Table) -> pa.Table:
        ids, parts = (table.column(c).to_numpy() for c in ("id", "component"))
        held = table.column("shingles").combine_chunks()
        edges = held.offsets.to_numpy()
        values, codes = np.unique(held.flatten().to_numpy(), return_inverse=True)
        codes = np.concatenate([np.zeros(edges[0], codes.dtype), codes])
        mark, counts = np.zeros(len(values), bool), np.diff(edges)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, fits in _fits(table):
            if not len(fits):
                continue
            own = codes[edges[i] : edges[i + 1]]
            mark[own] = True
            shared = np.array([np.count_nonzero(mark[codes[edges[j] : edges[j + 1]]]) for j in fits])
            mark[own] = False
            linked = fits[100 * shared >= similarity * (counts[fits] + counts[i] - shared)]
            linked = linked[np.unique(parts[linked], return_index=True)[1]]
            a.append(np.minimum(ids[linked], ids[i]))
            b.append(np.maximum(ids[linked], ids[i]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return dealt.groupBy("run", "block", "chunk").applyInArrow(compare, "a long, b long").distinct()


def _classes(linkable: DataFrame) -> DataFrame:
    """(set_hash, id, n_shingles, signature, the planes): a row for each different set, whose id is its least."""
    first = linkable.groupBy("set_hash").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("x")).select("set_hash", F.col("x.doc_id").alias("id"), "x.n_shingles", "x.signature")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), ">u2").reshape(batch.num_rows, HASHES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, planes(signatures))], names=[*batch.schema.names, *PLANES])

    return first.mapInArrow(add, "set_hash binary, id long, n_shingles long, signature binary, " + ", ".join(f"{p} long" for p in PLANES))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; ``similarity`` is 80 percent or more."""
    if similarity < 80:
        raise ValueError("the forest is laid out for a similarity of 80 percent or more")
    small_batches(docs.sparkSession)
    rows = materialize(sketches(docs, shingle), "sketches")
    linkable = rows.where("doc_id IS NOT NULL AND set_hash IS NOT NULL")
    classes = materialize(_classes(linkable), "classes")
    raw = materialize(candidates(classes), "candidates")
    crowded = raw.where("votes = 0").select(F.col("a").alias("run"), F.col("b").alias("id"))
    found = materialize(_alike(raw.where("votes > 0"), classes), "alike")
    texts = _texts(docs, found.select(F.col("a").alias("id")).union(found.select("b")).distinct())

    # First each class's most frequent neighbours, then what still lies between components.
    sides = found.select(F.col("a").alias("hub"), F.col("b").alias("leaf"), "votes").unionByName(found.select(F.col("b").alias("hub"), F.col("a").alias("leaf"), "votes"))
    place = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("votes"), F.desc("hub")))
    nearest = sides.withColumn("place", place).where(F.col("place") <= NEAREST).select("hub", "leaf")
    # Two classes that are each other's are compared once.
    nearest = materialize(nearest.groupBy(F.least("hub", "leaf").alias("a"), F.greatest("hub", "leaf").alias("b")).agg(F.min("hub").alias("hub"), F.max("leaf").alias("other")).select("a", "b", "hub", (F.col("a") + F.col("b") - F.col("hub")).alias("leaf")), "nearest")
    links = materialize(_confirmed(nearest.select("hub", "leaf"), texts, shingle, similarity), "links-nearest")
    parts = connected_components(links)
    label_a = parts.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    label_b = parts.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = found.join(nearest.select("a", "b"), ["a", "b"], "left_anti").join(label_a, "a", "left").join(label_b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    between = materialize(between.select(F.col("a").alias("hub"), F.col("b").alias("leaf")), "between")
    more = materialize(_confirmed(between, texts, shingle, similarity), "links-between")
    parts = connected_components(links.unionByName(more))
    # What of crowded runs lies in different components, and is alike enough, is compared exactly.
    compared = nearest.select("a", "b").unionByName(between.select(F.col("hub").alias("a"), F.col("leaf").alias("b")))
    mixed = _mixed_runs(crowded, parts).join(classes.select("id", "n_shingles", *PLANES), "id").join(_tried(compared), "id", "left")
    mixed = materialize(mixed, "mixed-runs")
    mixed_left = materialize(mixed.join(_possible(mixed), ["run", "id"], "left_semi"), "mixed-left")
    others = _texts(docs, mixed_left.select("id").distinct())
    across = materialize(_across_crowded_runs(mixed_left, others, shingle, similarity), "links-across")
    links = links.unionByName(more).unionByName(across)
    # Rows of one id with different texts are one document: their classes' ids are linked with it.
    twice = linkable.select("doc_id", "set_hash").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not (twice := materialize(twice, "ids-twice")).isEmpty():
        of_twice = linkable.join(twice, "doc_id", "left_semi").join(classes.select("set_hash", "id"), "set_hash")
        links = links.unionByName(materialize(of_twice.where("id <> doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct(), "links-twice"))
    parts = connected_components(links)
    discard(raw, found, texts, nearest, between, more, mixed, mixed_left, others, across, twice)
    of_set = classes.select("set_hash", "id").join(parts.select(F.col("node").alias("id"), "component"), "id", "left").select("set_hash", F.coalesce("component", "id").alias("component"))
    # Written, so that the rows' join has a plain table on the other side and can split a set with very many rows.
    of_set = materialize(of_set, "components")
    discard(parts)
    out = rows.join(of_set, "set_hash", "left").select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
