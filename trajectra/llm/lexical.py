"""Ranked lexical search by WAND over document shards.

A score is a sum over an item's terms of integer impacts: the term's weight times a saturated term
frequency that is damped in long documents. Statistics (documents, terms, document frequencies) are
over all documents.

1. Items are read as sets of terms, in blocks of a bounded number of terms; a block's vocabulary is
   broadcast. One pass over the documents keeps, of each, its length and the block's terms with
   their frequencies (a forward index, far smaller than the texts), which is stored.
2. Document frequencies are counted from it and collected: a number per term of the block.
3. Each task cuts its part of the index into shards of bounded size. A shard has a list of
   (document, impact) per term, by ascending document, and each list's maximum impact. For every
   item the lists' cursors are ordered by document and their maxima added up until they reach what
   the item's heap demands; the document at that cursor is the pivot, and lists before it skip to
   it. Only pivots are scored. All items of a block move on together, a pivot each at a time.
   Heaps are carried from shard to shard, so a task begins each with what it has already found.
4. A task gives ``k`` rows an item at most, and the heaps of all tasks are merged by a window.

Nothing is cut: a document is passed over only if its bound can't beat the ``k`` found.

Cases: null and empty texts have no terms and are not counted; an item without terms has no rows;
rows of one item_id are one item with the terms of all; rows with equal doc_id are documents each;
a null doc_id ranks after all others of its score; empty tables give no rows; other columns are
left aside.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, materialize, small_batches

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Weight, saturation and length damping of the score: SCALE * ln, and 100 - SLOPE + SLOPE * length / mean length.
SCALE, SLOPE, TF_ONE, TF_HALF = 1000, 90, 1_000_000_000, 8
#: Terms of the items that are searched in one pass over the documents.
TERMS_A_BLOCK = 200_000
#: A shard is closed at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 65_536, 2_000_000
#: Items whose cursors move on together.
ITEMS_TOGETHER = 1_024
#: What stands for a null id, and for a free place of a heap.
LAST_ID = np.iinfo(np.int64).max


def terms(text: Column) -> Column:
    """The terms of a text in order, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS, -1), "")


def _byte_table() -> bytes:
    """For texts in UTF-8: letters lower-cased, everything that separates terms a space."""
    table = bytearray(range(256))
    for c in range(128):
        if chr(c) in UPPER:
            table[c] = c + 32
        elif not (chr(c) in LOWER or chr(c).isdigit()):
            table[c] = 32
    return bytes(table)


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", terms_a_block: int = TERMS_A_BLOCK) -> DataFrame:
    """(item, rank, key, score): the ``k`` documents of highest score above 0 for each item, equal scores by ascending key (an integer)."""
    spark = docs.sparkSession
    small_batches(spark)
    wanted = items.select(F.col(item).alias("item"), F.explode(terms(F.col(item_text))).alias("term")).distinct()
    wanted = materialize(wanted.groupBy("item").agg(F.collect_set("term").alias("terms")), "item-terms")
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // terms_a_block))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    found = [_search_block(rows, wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k) for b in range(blocks)]
    discard(wanted)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score")


def _search_block(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(item, rank, id, score) for the items of a block."""
    spark = rows.sparkSession
    queries = wanted.collect()
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for q in queries for t in q.terms}))}
    shared = spark.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, find = _byte_table(), shared.value.get
        for batch in batches:
            lengths, ends, held, often = [], [0], [], []
            for text in batch.column("text").to_pylist():
                found = (text or b"").translate(table).split()
                counts = Counter(map(find, found))
                counts.pop(None, None)
                lengths.append(len(found))
                held.extend(counts.keys())
                often.extend(counts.values())
                ends.append(len(held))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (held, often)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lengths, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    forward = materialize(rows.mapInArrow(index, "id long, n long, terms array<int>, tfs array<int>"), "forward-index")
    n_docs, n_terms = forward.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary) + 1, np.int64)
    for term, df in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per term of the block at most
        weights[term] = math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))
    ids = [vocabulary[t.encode()] for q in queries for t in q.terms]
    sent = spark.sparkContext.broadcast((weights, n_docs, n_terms, np.array(ids, np.int64), np.cumsum([0, *(len(q.terms) for q in queries)])))

    def heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, n_docs, n_terms, ids, ends = sent.value
        best = Heaps(len(ends) - 1, k)
        for shard in _shards(batches):
            search_shard(Shard(*shard, weights, n_docs, n_terms), ids, ends, best)
        for at in range(0, len(ends) - 1, 10_000):
            row, place = np.nonzero(best.scores[at : at + 10_000])
            got = best.ids[at + row, place]
            yield pa.RecordBatch.from_arrays([pa.array(at + row, pa.int64()), pa.array(got, mask=got == LAST_ID), pa.array(best.scores[at + row, place])], names=["q", "id", "score"])

    hits = forward.where("size(terms) > 0").select("id", "n", "terms", "tfs").mapInArrow(heaps, "q long, id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = materialize(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked")
    discard(forward)
    names = spark.createDataFrame([(i, q["item"]) for i, q in enumerate(queries)], f"q long, item {wanted.schema['item'].dataType.simpleString()}")
    return ranked.join(names, "q").select("item", "rank", "id", "score")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, n, ends, terms, tfs) of so many documents that a shard is full."""
    held: list[tuple] = []
    n_docs = n_postings = 0

    def close() -> tuple:
        ids, n, sizes, terms, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
        return ids, n, np.concatenate([[0], np.cumsum(sizes)]), terms, tfs

    for batch in batches:
        lists = batch.column("terms")
        sizes = np.diff(lists.offsets.to_numpy())
        ids = batch.column("id").fill_null(LAST_ID).to_numpy(zero_copy_only=False)
        held.append((ids, batch.column("n").to_numpy(), sizes, lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()))
        n_docs, n_postings = n_docs + len(ids), n_postings + int(sizes.sum())
        if n_docs >= SHARD_DOCS or n_postings >= SHARD_POSTINGS:
            yield close()
            held, n_docs, n_postings = [], 0, 0
    if held:
        yield close()


class Shard:
    """Posting lists of impacts by ascending document, with each list's maximum."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.size = ids[order], len(ids)
        lengths = np.repeat(n, np.diff(ends))
        tfs, terms = tfs.astype(np.int64), terms.astype(np.int64)
        kinds, kind = np.unique(lengths, return_inverse=True)
        damped = np.array([100 - SLOPE + SLOPE * int(x) * n_docs // n_terms for x in kinds], np.int64)[kind]
        impacts = weights[terms] * ((TF_ONE * tfs) // (SCALE * tfs + TF_HALF * damped))
        keys = terms * (self.size + 1) + np.repeat(place, np.diff(ends))
        useful = np.flatnonzero(impacts)
        useful = useful[np.argsort(keys[useful])]
        self.keys, self.impacts = keys[useful], np.append(impacts[useful], 0)
        self.docs = np.append(self.keys % (self.size + 1), self.size)
        bounds = np.searchsorted(self.keys, np.arange(len(weights) + 1) * (self.size + 1))
        self.starts, self.ends = bounds[:-1], bounds[1:]
        self.most = np.zeros(len(weights), np.int64)
        full = np.flatnonzero(self.ends > self.starts)
        if len(full):
            self.most[full] = np.maximum.reduceat(self.impacts[:-1], self.starts[full])


class Heaps:
    """The best ``k`` (score, id) of each item so far, best first; free places have score 0."""

    def __init__(self, n: int, k: int) -> None:
        self.scores, self.ids = np.zeros((n, k), np.int64), np.full((n, k), LAST_ID)

    def push(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Put one document into each of ``rows``, where it beats the last."""
        last_s, last_i = self.scores[rows, -1], self.ids[rows, -1]
        fits = (scores > last_s) | (scores == last_s) & (ids < last_i) & (scores > 0)
        rows, scores, ids = rows[fits], scores[fits, None], ids[fits, None]
        s, i = self.scores[rows], self.ids[rows]
        better = (s > scores) | (s == scores) & (i <= ids)
        place, at = better.sum(axis=1)[:, None], np.arange(s.shape[1])[None]
        moved_s, moved_i = np.roll(s, 1, axis=1), np.roll(i, 1, axis=1)
        self.scores[rows] = np.where(at < place, s, np.where(at == place, scores, moved_s))
        self.ids[rows] = np.where(at < place, i, np.where(at == place, ids, moved_i))


def search_shard(shard: Shard, ids: np.ndarray, ends: np.ndarray, best: Heaps) -> int:
    """Bring the shard's documents into the items' heaps; how many were scored. Item i has the terms ids[ends[i]:ends[i + 1]]."""
    scored, sizes = 0, np.diff(ends)
    by_size = np.argsort(sizes, kind="stable")
    for at in range(0, len(sizes), ITEMS_TOGETHER):
        rows = by_size[at : at + ITEMS_TOGETHER]
        wide = np.full((len(rows), int(sizes[rows].max())), len(shard.most) - 1)  # the last term has no postings
        wide[np.arange(wide.shape[1])[None] < sizes[rows][:, None]] = np.concatenate([ids[ends[r] : ends[r + 1]] for r in rows])
        scored += _walk(shard, rows, wide, best)
    return scored


def _walk(shard: Shard, rows: np.ndarray, terms: np.ndarray, best: Heaps) -> int:
    n, scored = shard.size, 0
    some = (shard.ends[terms] > shard.starts[terms]).any(axis=1)
    rows, terms = rows[some], terms[some]
    at, end, most = shard.starts[terms], shard.ends[terms], shard.most[terms]
    docs = np.where(at < end, shard.docs[at], n)
    while len(rows):
        order = np.argsort(docs, axis=1)
        line = np.arange(len(rows))
        sums = np.cumsum(np.take_along_axis(most, order, axis=1), axis=1)
        first = shard.ids[np.minimum(docs[line, order[:, 0]], n - 1)]
        need = np.maximum(1, best.scores[rows, -1] + (best.ids[rows, -1] < first))
        enough = sums >= need[:, None]
        place = enough.argmax(axis=1)
        pivot = docs[line, order[line, place]]
        goes_on = enough[line, place] & (pivot < n)
        if not goes_on.all():
            rows, terms, at, end, most, docs, pivot = (x[goes_on] for x in (rows, terms, at, end, most, docs, pivot))
            if not len(rows):
                break
        r, c = np.nonzero(docs < pivot[:, None])
        sought = np.minimum(np.searchsorted(shard.keys, terms[r, c] * (n + 1) + pivot[r]), end[r, c])
        at[r, c] = sought
        docs[r, c] = np.where(sought < end[r, c], shard.docs[sought], n)
        r, c = np.nonzero(docs == pivot[:, None])
        here = at[r, c]
        scores = np.add.reduceat(shard.impacts[here], np.searchsorted(r, np.arange(len(rows))))  # each row has its pivot
        best.push(rows, scores, shard.ids[pivot])
        scored += len(rows)
        at[r, c] = here + 1
        docs[r, c] = np.where(here + 1 < end[r, c], shard.docs[here + 1], n)
    return scored
