"""Collocations: phrases whose words stand together more often than their parts do elsewhere.

Texts are cut into pieces at punctuation and line ends, and a phrase is a run of words within a
piece. Phrases of 1 to ``max_n`` words become rows (lang, phrase, count) that are added up within
each task, and then by hash over all tasks.

Most phrases are too rare to be a candidate or a part of one, and are kept out before they become
rows. A phrase needs ``least`` occurrences, and so do both phrases that it has without its last and
its first word. So lengths are taken one after another: phrases whose two shorter ones pass are
hashed to a number of places, the places' counts are added up over all tasks, and a bit map of a
fixed size tells the places with ``least``. Phrases share places, so the map may let one pass that
is rare, which its own count then drops, but keeps none back. A larger corpus makes the map pass
more; results don't depend on it. Only the phrases that reach ``least`` are stored.

Each way to cut a candidate into two joins the counts of both parts; scores are in Decimal, and the
lowest is the candidate's. A candidate inside a longer one that has a given share of its
occurrences goes: that follows from one-word extensions alone, as counts don't grow with length,
so an anti-join with these is enough. Candidates are ranked by a window, whose limit is applied
within each task first.

Cases: a null text is empty; a null language is ``und``, and one with documents of that very name;
empty tables give no rows; repeated rows count each; other columns are left aside; a text or word
of any length is read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, small_batches
from .substring_dedup import Words, mixed

UNKNOWN = "und"
#: What ends a piece, and what else separates words, in UTF-8.
ENDS, SPACES, END = b".,;:!?\n\x0b\x0c\r", b" \t", 10
#: Bytes of a language's texts that are read together: phrases are told apart by 64 bits among so many.
BYTES_TOGETHER = 2 << 20
#: What hashes of words are multiplied by, once for each word after them.
FACTOR = 0x9E3779B97F4A7C15
#: A task gives its counts on when it holds so many phrases.
PHRASES_HELD = 150_000
#: A task gives its marks on when it holds so many.
MARKS_HELD = 400_000
#: Bits of the map: 16 MB.
FILTER_BITS = 1 << 27
#: Bits of the map that are put together in one row.
BLOCK_BITS = 1 << 19
GRAMS = "lang string, phrase string, f long"


def _byte_table() -> bytes:
    table = bytearray(range(256))
    for c in range(256):
        table[c] = END if c in ENDS else 32 if c in SPACES else c + 32 if 65 <= c <= 90 else c
    return bytes(table)


def _bit_map(marks: DataFrame, least: int, bits: int) -> bytes:
    """The places of ``marks`` (bit, f) that reach ``least``: parts of the map are put together on executors, so the driver gets as many bits as it has."""

    def gather(table: pa.Table) -> pa.Table:
        block = np.zeros(min(BLOCK_BITS, bits), np.uint8)
        block[table.column("bit").to_numpy() % BLOCK_BITS] = 1
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(block, bitorder="little").tobytes()], pa.binary())})

    often = marks.groupBy("bit").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("bit", F.expr(f"bit DIV {BLOCK_BITS}").alias("block"))
    out = bytearray(bits // 8)
    for row in often.groupBy("block").applyInArrow(gather, "block long, bits binary").toLocalIterator():
        at = row.block * BLOCK_BITS // 8
        out[at : at + len(row.bits)] = row.bits
    return bytes(out)


class Pieces:
    """Texts of one language that are read together: hashes of their words, and the piece that each word is in."""

    def __init__(self, lang: str, data: bytes) -> None:
        self.words = Words([data], 1)
        self.piece = np.cumsum(self.words.data == END)[self.words.starts]
        self.seed = np.uint64(xxhash.xxh64_intdigest(lang))

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of ``n`` words within a piece begin, and a hash for every place that has so many words after it."""
        w = self.words.hashes[0]
        size = max(0, len(w) - n + 1)
        hashes = np.full(size, self.seed, np.uint64)
        for i in range(n):
            hashes = hashes * np.uint64(FACTOR) + w[i : i + size]
        return np.flatnonzero(self.piece[:size] == self.piece[n - 1 : n - 1 + size]), mixed(hashes)

    def candidates(self, n: int, shorter: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the phrases of ``n`` words whose two shorter ones pass the map."""
        passes = _passes(self.phrases(n - 1)[1], shorter, bits)
        at, hashes = self.phrases(n)
        at = at[passes[at] & passes[at + 1]]
        return at, hashes[at]

    def text(self, at: int, n: int) -> bytes:
        return b" ".join(self.words.data[self.words.starts[at] : self.words.ends[at + n - 1]].tobytes().split())


def _passes(hashes: np.ndarray, bit_map: np.ndarray, bits: int) -> np.ndarray:
    places = hashes % np.uint64(bits)
    return (bit_map[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Pieces]]:
    """Texts, some MB of a language together."""
    table = _byte_table()
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, []).append(text.translate(table))
            sizes[lang] += len(text) + 1
            if sizes[lang] > BYTES_TOGETHER:
                yield lang, Pieces(lang, b"\n".join(held.pop(lang)))
                sizes[lang] = 0
        if sizes.total() > 4 * BYTES_TOGETHER:  # of many languages
            for other in list(held):
                yield other, Pieces(other, b"\n".join(held.pop(other)))
            sizes.clear()
    for lang, texts in held.items():
        yield lang, Pieces(lang, b"\n".join(texts))


def _marked(places: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64)), pa.array(f.astype(np.int64))], names=["bit", "f"])


def _marks(texts: DataFrame, n: int, shorter: Broadcast, bits: int) -> DataFrame:
    """(bit, f): how often a task met each place of the phrases of ``n`` words whose shorter ones pass."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit_map = np.frombuffer(shorter.value, np.uint8)
        held: list[np.ndarray] = []
        for _, pieces in _read(batches):
            held.append(pieces.candidates(n, bit_map, bits)[1] % np.uint64(bits))
            if sum(map(len, held)) > MARKS_HELD:
                yield _marked(*np.unique(np.concatenate(held), return_counts=True))
                held = []
        if held:
            yield _marked(*np.unique(np.concatenate(held), return_counts=True))

    return texts.mapInArrow(mark, "bit long, f long")


def _word_marks(words: DataFrame, bits: int) -> DataFrame:
    """The same of counted words."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[tuple]] = {}
            for lang, phrase, f in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase", "f")), strict=True):
                by.setdefault(lang, []).append((phrase.encode(), f))
            for lang, rows in by.items():
                hashes = Pieces(lang, b"\n".join(p for p, _ in rows)).phrases(1)[1]
                yield _marked(hashes % np.uint64(bits), np.array([f for _, f in rows]))

    return words.mapInArrow(mark, "bit long, f long")


def _counted(texts: DataFrame, n: int, shorter: Broadcast | None, own: Broadcast | None, least: int, bits: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``n`` words with ``least`` occurrences; for single words also a row per language without phrase, whose f counts all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def given() -> pa.RecordBatch:
            names = [lang for lang, c in held.items() for _ in range(len(c))]
            phrases = [None if p is None else p.decode() for c in held.values() for p in c]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(phrases, pa.string()), pa.array([f for c in held.values() for f in c.values()], pa.int64())], names=["lang", "phrase", "f"])

        maps = [np.frombuffer(m.value, np.uint8) if m else None for m in (shorter, own)]
        for lang, pieces in _read(batches):
            counts = held.setdefault(lang, Counter())
            if n == 1:
                at, hashes = pieces.phrases(1)
                counts[None] += len(at)
            else:
                at, hashes = pieces.candidates(n, maps[0], bits)
                passes = _passes(hashes, maps[1], bits)
                at, hashes = at[passes], hashes[passes]
            _, first, f = np.unique(hashes, return_index=True, return_counts=True)
            for i, times in zip(at[first].tolist(), f.tolist(), strict=True):
                counts[pieces.text(i, n)] += times
            if sum(map(len, held.values())) > PHRASES_HELD:
                yield given()
                held = {}
        if held:
            yield given()

    counted = texts.mapInArrow(count, GRAMS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return materialize(counted.where((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases-{n}")


def phrase_counts(docs: DataFrame, max_n: int = 3, least: int = 10, text: str = "text", lang: str = "lang", bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases with ``least`` occurrences, and (lang, n) with the words of each language."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    share = docs.sparkSession.sparkContext.broadcast

    single = _counted(texts, 1, None, None, least, bits)
    totals = single.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    words = single.where("phrase IS NOT NULL")
    grams = words.withColumn("size", F.lit(1))
    own = share(_bit_map(_word_marks(words, bits), least, bits))
    for size in range(2, max_n + 1):
        shorter, own = own, share(_bit_map(_marks(texts, size, own, bits), least, bits))
        grams = grams.unionByName(_counted(texts, size, shorter, own, least, bits).withColumn("size", F.lit(size)))
    return grams, totals


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, inside_percent: int = 50, top: int | None = 2000, text: str = "text", lang: str = "lang", bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``max_n`` words of each language, or all."""
    return scored(*phrase_counts(docs, max_n, least, text, lang, bits), inside_percent, top)


def scored(grams: DataFrame, totals: DataFrame, inside_percent: int, top: int | None) -> DataFrame:
    """Rank the phrases of ``grams`` (lang, phrase, size, f), which has their parts too.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its lowest-scoring cut, ``n`` all
    words; ``score`` is floor(1000000 * a * a / (l * r)), and of equal ones the cut after fewer words
    counts. Products have up to 37 digits, so counts below 10^15 are exact.
    """
    candidates = grams.where("size > 1")
    words = F.split("phrase", " ", -1)
    cuts = candidates.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(words, 1, F.col("k")), " ").alias("first"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    left = grams.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = grams.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    exact = lambda c: f"cast({c} AS decimal(15,0))"
    joined = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    joined = joined.withColumn("score", F.expr(f"(cast(1000000 AS decimal(7,0)) * ({exact('a')} * {exact('a')})) DIV ({exact('l')} * {exact('r')})"))
    best = joined.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = candidates.where("size > 2").select("lang", F.col("f").alias("f"), F.explode(F.array(F.array_join(F.slice(words, 1, F.col("size") - 1), " "), F.array_join(F.slice(words, 2, F.col("size") - 1), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    found = best.alias("c").join(longer.alias("o"), (F.col("c.lang") == F.col("o.lang")) & (F.col("c.phrase") == F.col("o.phrase")) & (100 * F.col("o.held") >= inside_percent * F.col("c.a")), "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").alias("score")).withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
