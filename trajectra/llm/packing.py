"""Best-fit packing with bound-certified repacking.

Each document is tokenized and ends in an end token; documents longer than a sequence are cut into
full pieces, the first of which may be shorter. Full pieces are sequences of their own. The rest
are items, dealt by hash into partitions of bounded size; each is packed best-fit decreasing, and
dual feasible functions give a lower bound for the partition's bins. A partition that meets its
bound is certified: no packing of its items has fewer bins, so only its emptiest bin, where the
bound was rounded up, can gain from others, and it keeps the rest. Certified partitions give that
bin's items back and the others those of all their bins with gaps; the items are dealt anew into
fewer, larger partitions, and best-fit decreasing runs again. This goes on while it saves bins and until the total meets
the bound of the whole table, which is computed from a histogram with one row per length, but ``max_exchanges`` times at
most (4 unless asked otherwise), as each doubles what a partition holds. The bins and the bound are given with each row, so
the gap that is left is known.

No task holds more than a partition's (id, length) pairs; the driver holds the histogram and
counts. An exchange that saves nothing is undone.

Cases: a null or empty text is the end token alone; repeated rows are packed each; an empty table
gives no rows; a text of any length is tokenized whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, small_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long"
#: Items a partition holds; a few MB of memory.
ITEMS_PER_PARTITION = 20_000
#: Exchanges at most; each doubles a partition's items, so the last has 320,000.
MAX_EXCHANGES = 4
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of the tokenizer file; texts within Latin-1 go through a faster encoder of the same vocabulary (the tests compare both).

    ``ranks_path`` names the same vocabulary as byte ranks. Both split text by the same pattern; they
    could differ only in their tables of newer Unicode letters, and where a special token's string
    stands in the text, so texts beyond Latin-1 or with such a string take the tokenizer file.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None):
        self.path = tokenizer_path
        self.fast = None
        if ranks_path and pattern:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def full(self):
        """The tokenizer file's own encoder, loaded when a text needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and SPECIAL not in text:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return self.fast.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids


def token_pieces(
    docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, max_tokens: int = 1024, end_id: int = 2, with_ids: bool = False
) -> DataFrame:
    """A row per piece; ``slot`` is a number of its own for each, and with ``with_ids`` there are the ids too."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(tokenizer_path, ranks_path, pattern)
        slot = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                first = len(ids) % max_tokens or max_tokens
                edges = [0, *range(first, len(ids) + 1, max_tokens)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), slot) + ((ids[a:b].tolist(),) if with_ids else ()))
                    slot += 1
            columns = list(zip(*rows, strict=True)) or [()] * (6 + with_ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "slot", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names[: 6 + with_ids])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item and the number of bins; ties go to the bin opened last."""
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    open_by_room: dict[int, list[int]] = {}
    mask, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = mask >> size
        if fitting:
            room = size + ((fitting & -fitting).bit_length() - 1)
            stack = open_by_room[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            open_by_room.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins, offsets, n


def bin_lower_bound(counts: np.ndarray, capacity: int, steps: int = 24) -> int:
    """Bins that items need at least; ``counts[s]`` items have length s.

    Dual feasible functions f map shares of a bin so that what fits a bin sums to 1 at most: the
    identity; u_k, which rounds (k+1)x down to k-ths unless it is whole; and f_e, which sends
    lengths over 1-e to 1 and those under e to 0. f_e of u_k is feasible as well.
    """
    sizes = np.arange(len(counts), dtype=np.int64)
    counts = counts.astype(np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    half = capacity // 2
    total = np.cumsum(counts)
    weight = np.cumsum(counts * sizes)
    for e in range(1, half + 1):
        over = int(total[-1] - total[min(capacity - e, len(counts) - 1)])
        middle = int(weight[min(capacity - e, len(counts) - 1)] - weight[e - 1])
        best = max(best, over + -(-middle // capacity))
    for k in range(1, steps + 1):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        # value * k * capacity, in whole numbers
        value = np.where(whole, sizes * k, (scaled // capacity) * capacity)
        unit = k * capacity
        best = max(best, -(-int((counts * value).sum()) // unit))
        for parts in range(2, 2 * k + 1):  # f_e with e = 1/parts on top
            edge = unit // parts
            again = np.where(value > unit - edge, unit, np.where(value < edge, 0, value))
            best = max(best, -(-int((counts * again).sum()) // unit))
    return best


def _pack_round(items: DataFrame, parts: int, round_no: int, capacity: int) -> DataFrame:
    """Deal items by hash into ``parts`` and pack each: (slot, length, sequence_id, offset, part, bins, bound, gives).

    ``gives``: whether the item's bin goes to the next exchange.
    """
    dealt = items.select("slot", "length", F.pmod(F.xxhash64("slot", F.lit(round_no)), F.lit(parts)).cast("long").alias("part"))

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        slots = table.column("slot").to_numpy()
        order = np.argsort(slots)  # the same packing whatever order the rows come in
        lengths, slots = lengths[order], slots[order]
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        bound = bin_lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        gives = fill < capacity
        if n == bound:
            gives &= np.arange(n) == fill.argmin()
        part = int(table.column("part")[0].as_py())
        base = ((round_no + 1) << 56) + (part << 24)
        same = lambda x: np.full(len(bins), x)
        return pa.table({"slot": slots, "length": lengths, "sequence_id": base + bins, "offset": offsets, "part": same(part), "bins": same(n), "bound": same(bound), "gives": gives[bins]})

    return dealt.groupBy("part").applyInArrow(pack, "slot long, length long, sequence_id long, offset long, part long, bins long, bound long, gives boolean")


def _count_bins(packed: DataFrame) -> int:
    return packed.where("offset = 0").count()


def pack_pieces(pieces: DataFrame, max_tokens: int = 1024, items_per_partition: int = ITEMS_PER_PARTITION, max_exchanges: int = MAX_EXCHANGES, report: list[dict] | None = None) -> DataFrame:
    """``pieces``, which must be materialized, with ``sequence_id``, ``offset``, ``n_sequences`` and ``least_sequences``.

    The last two are the sequences used and the lower bound for them. ``report`` gets, for each round, its partitions, how
    many are certified, their bins and bounds, and the whole table's bins and bound after it.
    """
    items = pieces.where(F.col("length") < max_tokens).select("slot", "length")
    full = pieces.where(F.col("length") == max_tokens).count()
    histogram = np.zeros(max_tokens + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():  # a row per length
        histogram[length] = n
    n_items, bound = int(histogram.sum()), bin_lower_bound(histogram, max_tokens)
    columns = "slot", "length", "sequence_id", "offset", "gives"

    def tell(done: DataFrame, round_no: int, total: int) -> None:
        if report is not None:
            each = done.groupBy("part").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
            row = each.agg(F.count("*").alias("partitions"), F.count_if(F.col("bins") == F.col("bound")).alias("certified"), F.sum("bins").alias("bins"), F.sum("bound").alias("bound")).first()
            report.append({"round": round_no, **row.asDict(), "total": total + full, "total_bound": bound + full})

    if not n_items:
        alone = pieces.select("*", (-F.col("slot") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("slot")
        return alone.select("*", F.lit(full).cast("long").alias("n_sequences"), F.lit(full).cast("long").alias("least_sequences"))
    done = materialize(_pack_round(items, -(-n_items // items_per_partition), 0, max_tokens), "packed-0")
    packed = done.select(*columns)
    bins = _count_bins(packed)
    tell(done, 0, bins)
    for round_no in range(1, max_exchanges + 1):
        if bins <= bound:
            break
        loose = packed.where("gives")
        n_loose, old = loose.count(), _count_bins(loose)
        if not n_loose:
            break
        parts = -(-n_loose // (items_per_partition << round_no))
        done = materialize(_pack_round(loose.select("slot", "length"), parts, round_no, max_tokens), f"packed-{round_no}")
        again = done.select(*columns)
        new = _count_bins(again)
        if new >= old:
            break
        packed = packed.where("NOT gives").unionByName(again)
        bins += new - old
        tell(done, round_no, bins)
    placed = packed.select("slot", "sequence_id", "offset")
    return (
        pieces.join(placed, "slot", "left")
        .withColumn("sequence_id", F.coalesce("sequence_id", -F.col("slot") - 1))
        .withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long"))
        .withColumn("n_sequences", F.lit(bins + full).cast("long"))
        .withColumn("least_sequences", F.lit(bound + full).cast("long"))
        .drop("slot")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, max_tokens: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack: (doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset, n_sequences, least_sequences)."""
    small_batches(docs.sparkSession)
    pieces = materialize(token_pieces(docs, tokenizer_path, ranks_path, pattern, max_tokens, end_id, with_ids), "pieces")
    return pack_pieces(pieces, max_tokens)
