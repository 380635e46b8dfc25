"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ten consecutive words of an item. Both sides are fingerprinted: 5-grams are hashed and
of every six in a row the least hash is kept. Ten words hold exactly six 5-grams, so every window
that a document shares with an item has a fingerprint in both, and no shared window is missed.
Documents that share a fingerprint are then extended: their windows are compared with the items'
as strings, and overlapping hits are joined into the words that are hit. Items of fewer words have
one window of their own length, whose hash stands for itself.

Fingerprints are a few 64-bit numbers per hundred words. The items' side is broadcast while its
counted rows stay under a limit; beyond it, fingerprints meet by a shuffle. So do the results of the
documents that have hits: while they are few, they are sent to where the documents are read, and the
documents aren't dealt anew. Stored tables get a file for several shuffle partitions, as a task per
file costs more than its few rows, and where files are local Hadoop starts a process for each
file's permissions.

Cases: a null or empty text has no words; an item without words has no window; documents with equal
id and text share their result; an empty benchmark leaves every document clean; other columns are
left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import row_key
from .store import materialize

WINDOW, GRAM = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rows (a number or two, or ten words) are broadcast, after they have been counted.
BROADCAST_ROWS = 300_000
#: Up to so many suspects, the rows of results (under 200 bytes each) are broadcast.
BROADCAST_RESULTS = 100_000
#: Shuffle partitions of hashes, keys or windows that make a file of a stored table.
PARTITIONS_A_FILE = 32


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS, -1), "")


def _gram_hash(at: str, n: int) -> str:
    return f"xxhash64({n}, " + ", ".join(f"w[{at} + {i}]" for i in range(n)) + ")"


def _fingerprints(short: list[int]) -> Column:
    """Of the word array ``w``: window minima of 5-gram hashes, and the hashes of all n-grams of the lengths in ``short``."""
    least = ", ".join(f"g[i + {j}]" for j in range(WINDOW - GRAM + 1))
    parts = [
        f"""CASE WHEN size(w) >= {WINDOW} THEN element_at(transform(array(transform(sequence(0, size(w) - {GRAM}), i -> {_gram_hash("i", GRAM)})),
        g -> transform(sequence(0, size(w) - {WINDOW}), i -> least({least}))), 1) ELSE cast(array() AS array<bigint>) END"""
    ]
    for n in short:
        parts.append(f"CASE WHEN size(w) >= {n} THEN transform(sequence(0, size(w) - {n}), i -> {_gram_hash('i', n)}) ELSE cast(array() AS array<bigint>) END")
    return F.array_distinct(F.expr(f"concat({', '.join(parts)})"))


def _stored(df: DataFrame, label: str) -> DataFrame:
    """``df``, whose rows are small and come from a shuffle, stored in few files."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.coalesce(max(1, partitions // PARTITIONS_A_FILE)), label)


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint where its counted rows allow it; it must be cheap to count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``."""
    items = benchmark.select(F.col(item).alias("item"), words(F.col(item_text)).alias("w")).where("size(w) > 0")
    short = sorted(r[0] for r in items.where(F.size("w") < WINDOW).select(F.size("w")).distinct().collect())  # nine lengths at most
    item_prints = (
        items.select(F.explode(F.when(F.size("w") >= WINDOW, _fingerprints([])).otherwise(F.array(_own_hash(short)))).alias("print")).where("print IS NOT NULL").distinct()
    )
    item_prints = _stored(item_prints, "item-prints")
    item_windows = _stored(
        items.select("item", F.explode(_windows([*short, WINDOW], whole=True)).alias("x")).select(F.col("x.s").alias("s"), "item").distinct(), "item-windows"
    )

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    rows = rows.select("k", "text", row_key("k", "text").alias("row"))
    worded = rows.select("k", "row", words(F.col("text")).alias("w"))
    suspects = worded.select("row", F.explode(_fingerprints(short)).alias("print")).join(_bounded(item_prints), "print", "left_semi").select("row").distinct()
    suspects = _stored(suspects, "suspects")
    n_suspects = suspects.count()

    hits = (
        rows.join(F.broadcast(suspects) if n_suspects <= BROADCAST_ROWS else suspects, "row", "left_semi")
        .dropDuplicates(["row"])
        .select("row", words(F.col("text")).alias("w"))
        .select("row", F.explode(_windows([*short, WINDOW], whole=False)).alias("x"))
        .select("row", "x.at", "x.n", "x.s")
        .join(_bounded(item_windows), "s")
    )
    per_doc = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    covered = F.expr("""aggregate(spans, named_struct('end', 0, 'n', 0),
        (a, s) -> named_struct('end', greatest(a.end, s.at + s.n), 'n', a.n + greatest(0, s.at + s.n - greatest(a.end, s.at))), a -> a.n)""")
    per_doc = per_doc.select("row", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    if n_suspects <= BROADCAST_RESULTS:
        per_doc = F.broadcast(per_doc)
    counted = worded.select("k", "row", F.size("w").cast("long").alias("n_words"))
    return counted.join(per_doc, "row", "left").select(
        F.col("k").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _own_hash(short: list[int]) -> Column:
    """The hash of all words of a short item."""
    cases = " ".join(f"WHEN size(w) = {n} THEN {_gram_hash('0', n)}" for n in short)
    return F.expr(f"CASE {cases} END") if short else F.lit(None).cast("bigint")


def _windows(lengths: list[int], whole: bool) -> Column:
    """(at, n, s) of all runs of so many words of ``w``; ``whole``: a length under ten only where it is that of the whole."""
    parts = []
    for n in dict.fromkeys(lengths):
        fits = f"size(w) = {n}" if whole and n < WINDOW else f"size(w) >= {n}"
        parts.append(f"""CASE WHEN {fits} THEN transform(sequence(0, size(w) - {n}), i -> named_struct('at', i, 'n', {n}, 's', concat_ws(' ', slice(w, i + 1, {n}))))
            ELSE cast(array() AS array<struct<at:int,n:int,s:string>>) END""")
    return F.expr(f"concat({', '.join(parts)})")
