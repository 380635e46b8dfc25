"""Substring dedup by fixed-block anchors.

A window is ``window`` consecutive words of a document. Words in a window that also starts in a
document with a smaller id are removed; all windows are judged on the texts as they came.

1. Anchors. Every document is a reference: it is indexed by its non-overlapping blocks of half a
   window, and it probes the index with every rolling window of a block's length. A window of two
   blocks' length holds a whole block of the reference wherever it starts, so no repeat is missed.
   Rolling hashes meet the blocks by a shuffle on the hash: hashes of a few hundred thousand words
   travel together, each hash once, so a passage in a third of all documents comes once from each
   such slice and not once from each document. Repeats inside a slice need no answer.
2. Extension. Documents with hits are read again: hits are extended by half a window to both sides,
   and the windows in reach are compared by 128 bits. Of a window, each slice sends the least
   document id that has it, and windows that a lesser id has are repeats. Overlapping ones join into
   maximal runs, the spans that are removed.
3. Spans go to their documents, and the words that are left are joined by single spaces.

No pairs of documents are made, and nothing is capped. Anchors are compared by 32 bits beside those
that choose the shuffle's group: a false hit only costs a comparison. A long text is taken in
slices that overlap by a window. Groups are taken in parts by their hash bits, so that sorting
needs bounded memory.

Cases: a null or empty text has no words; fewer words than a window are kept; rows of one id (also
repeated ones) take nothing from each other; a null id is greater than all others; an empty table
gives no rows; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import row_key
from .store import discard, materialize, small_batches

WINDOW = 50
#: Words of a slice, and bytes of text that are read before it is cut.
SLICE_WORDS, SLICE_BYTES = 1 << 19, 3 << 20
#: Groups of hashes for each shuffle partition, and at most; a slice has some entries for each.
GROUPS_A_PARTITION, MOST_GROUPS = 2, 1 << 16
#: Entries that a group sorts at once.
SORTED_AT_ONCE = 1 << 23
#: Tables of ranges and spans up to so many bytes are broadcast, after they have been summed; beyond, texts meet them by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Bytes of a text whose word hashes are made together.
HASHED_BYTES = 1 << 18
LAST_ID = np.iinfo(np.int64).max
#: Odd multipliers of the hashes of words and of runs of words, twice.
WORD_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
RUN_BASES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
MEMBER, ENTRIES, HITS, SAME = range(4)
SENT = "group long, slice long, kind int, a binary, b binary, c binary, d binary"
ANSWER = "slice long, kind int, a binary, b binary, c binary, d binary"


#: Of each worker: tables of powers by base.
_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(base: int, size: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64, so many or more."""
    if base not in _POWERS or len(_POWERS[base][0]) < size:
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            powers = np.full(1 << max(16, (size - 1).bit_length()), x, np.uint64)
            powers[0] = 1
            both.append(np.multiply.accumulate(powers))
        _POWERS[base] = both
    return _POWERS[base]


def mixed(x: np.ndarray) -> np.ndarray:
    for factor in MIX:
        x = (x ^ (x >> np.uint64(33))) * factor
    return x ^ (x >> np.uint64(33))


def _run_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of the runs values[starts:ends], the same wherever a run stands."""
    up, down = _powers(base, len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    return (sums[ends] - sums[starts]) * down[starts]


def _spaces() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, *range(9, 14)]] = True
    return table


class Words:
    """Hashes of the words of several texts, and where each text's words begin."""

    def __init__(self, texts: list[bytes], seeds: int) -> None:
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        edge = np.diff(_spaces()[data].astype(np.int8), prepend=1)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(ends) < len(starts):
            ends = np.append(ends, len(data))
        self.data, self.starts, self.ends = data, starts, ends
        self.bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.hashes = [np.empty(len(starts), np.uint64) for _ in range(seeds)]
        cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), HASHED_BYTES)), len(starts)))
        for a, b in zip(cuts, cuts[1:], strict=False):
            low = starts[a]
            bytes_ = data[low : ends[b - 1]].astype(np.uint64) + np.uint64(1)
            for base, out in zip(WORD_BASES, self.hashes, strict=False):
                sums = _run_sums(bytes_, starts[a:b] - low, ends[a:b] - low, base)
                out[a:b] = mixed(sums + (ends[a:b] - starts[a:b]).astype(np.uint64) * np.uint64(base))


def _slices(batches: Iterator[pa.RecordBatch], seeds: int, ranged: bool) -> Iterator[tuple]:
    """(slice, rows, words, from, to, wanted): rows of texts, their words, and the part of the words that is a slice."""
    first = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []
    size = 0

    def cut() -> Iterator[tuple]:
        nonlocal first
        words = Words([r[3] for r in rows], seeds)
        total = int(words.bounds[-1])
        for a in range(0, total, SLICE_WORDS):
            yield first, rows, words, a, min(total, a + SLICE_WORDS)
            first += 1

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("x", "y", "k", "text", *(["ranges"] if ranged else []))]
        for row in zip(*columns, strict=True):
            rows.append(row)
            size += len(row[3])
            if size >= SLICE_BYTES:
                yield from cut()
                rows, size = [], 0
    if rows:
        yield from cut()


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32, a plane of bytes after the other: the upper ones are mostly zero and cost nothing once compressed."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _batch(rows: list[tuple], names: list[str], schema: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema, strict=True)], names=names)


_SENT_TYPES = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
_SENT_NAMES = ["group", "slice", "kind", "a", "b", "c", "d"]
_ANSWER_TYPES, _ANSWER_NAMES = _SENT_TYPES[1:], _SENT_NAMES[1:]


def _member(slice_: int, rows: list[tuple], words: Words, a: int, b: int) -> tuple:
    """The row that tells which documents a slice has: keys, ids, and where their words begin and end in it."""
    first, last = np.searchsorted(words.bounds, [a, b], side="right") - 1
    last = min(last + 1, len(rows))
    keys = np.array([(r[0], r[1], LAST_ID if r[2] is None else r[2]) for r in rows[first:last]], "<i8")
    return -1 - slice_, slice_, MEMBER, keys.tobytes(), (words.bounds[first : last + 1] - a).astype("<i8").tobytes(), None, None


def _sorted_runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by these keys (the first counts most), and where runs of equal ones begin in it."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    changes = np.zeros(len(order), bool)
    changes[:1] = True
    for key in keys:
        changes[1:] |= key[order][1:] != key[order][:-1]
    return order, np.flatnonzero(changes)


def _anchors(groups: int, window: int):
    block = window // 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slice_, rows, words, a, b in _slices(batches, 1, False):
            end = min(len(words.hashes[0]), b + block - 1)
            places = np.arange(a, max(a, min(b, end - block + 1)))
            row = np.searchsorted(words.bounds, places, side="right") - 1
            fits = (places + block <= words.bounds[row + 1]) & (words.bounds[row + 1] - words.bounds[row] >= window)
            places, row = places[fits], row[fits]
            hashes = mixed(_run_sums(words.hashes[0][a:end], places - a, places - a + block, RUN_BASES[0]))
            aligned = (places - words.bounds[row]) % block == 0
            order, runs = _sorted_runs(hashes)
            count = np.diff(np.append(runs, len(order)))
            out = [_member(slice_, rows, words, a, b)]
            if len(runs):
                several = np.repeat(count > 1, count)
                out.append((-1 - slice_, slice_, HITS, (places[order][several] - a).astype("<u4").tobytes(), None, None, None))
                some = np.maximum.reduceat(aligned[order], runs)
                one = order[runs]
                group = ((hashes[one] >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
                low, place = hashes[one].astype(np.uint32), places[one] - a
                by = np.lexsort((place, group))
                for g, of in _by_group(group[by], by):
                    out.append((g, slice_, ENTRIES, low[of].astype("<u4").tobytes(), _planes(np.diff(place[of], prepend=0)), np.packbits(some[of]).tobytes(), None))
            yield _batch(out, _SENT_NAMES, _SENT_TYPES)

    return send


def _by_group(sorted_group: np.ndarray, by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    starts = np.flatnonzero(np.diff(sorted_group, prepend=-1))
    for s, e in zip(starts, np.append(starts[1:], len(by)), strict=True):
        yield int(sorted_group[s]), by[s:e]


def _payloads(table: pa.Table) -> tuple[list[dict], list[tuple]]:
    """A group's entries, and what only passes through."""
    entries, rest = [], []
    for r in table.to_pylist():
        if r["kind"] == ENTRIES:
            entries.append(r)
        else:
            rest.append(tuple(r[c] for c in _ANSWER_NAMES))
    return entries, rest


def _told(entries: list[dict], hit: np.ndarray) -> list[tuple]:
    """For each slice the places whose entries are hit."""
    out, at = [], 0
    for e in entries:
        places = np.cumsum(_unplaned(e["b"]), dtype=np.uint32)
        mine = hit[at : at + len(places)]
        at += len(places)
        if mine.any():
            out.append((e["slice"], HITS, places[mine].astype("<u4").tobytes(), None, None, None))
    return out


def _answer_anchors(table: pa.Table) -> pa.Table:
    """Entries of a hash in several slices, at least one of which is a block: each slice hears of its own."""
    entries, out = _payloads(table)
    if entries:
        low = np.concatenate([np.frombuffer(e["a"], "<u4") for e in entries])
        block = np.concatenate([np.unpackbits(np.frombuffer(e["c"], np.uint8), count=len(e["a"]) // 4) for e in entries])
        hit = np.zeros(len(low), bool)
        for part in _parts(low):
            order, runs = _sorted_runs(low[part])
            count = np.diff(np.append(runs, len(order)))
            found = (count > 1) & (np.maximum.reduceat(block[part][order], runs) > 0)
            hit[part[order[np.repeat(found, count)]]] = True
        out += _told(entries, hit)
    return pa.Table.from_batches([_batch(out, _ANSWER_NAMES, _ANSWER_TYPES)])


def _parts(low: np.ndarray) -> Iterator[np.ndarray]:
    """Places of entries, in parts that equal hashes share."""
    n = -(-len(low) // SORTED_AT_ONCE)
    for i in range(n):
        yield np.flatnonzero(low % n == i) if n > 1 else np.arange(len(low))


def _gather_ranges(window: int):
    block = window // 2

    def gather(table: pa.Table) -> pa.Table:
        keys, bounds, places, _ = _of_slice(table)
        row = np.searchsorted(bounds, places, side="right") - 1
        low = np.maximum(places - (window - block), bounds[row])
        high = np.minimum(places, bounds[row + 1] - window) + 1
        return _spans_table(keys, bounds, row, low, high)

    return gather


def _gather_spans(window: int):
    def gather(table: pa.Table) -> pa.Table:
        keys, bounds, places, same = _of_slice(table)
        if len(same):
            places = np.unique(np.concatenate([places, same[np.isin(same[:, 0], places), 1]]))
        row = np.searchsorted(bounds, places, side="right") - 1
        return _spans_table(keys, bounds, row, places, places + window)

    return gather


def _of_slice(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and bounds of a slice's documents, the places that are hit, and the pairs of places with equal windows."""
    keys, bounds = np.empty((0, 3), np.int64), np.zeros(1, np.int64)
    hits, same = [np.empty(0, np.int64)], [np.empty((0, 2), np.int64)]
    for r in table.to_pylist():
        if r["kind"] == MEMBER:
            keys, bounds = np.frombuffer(r["a"], "<i8").reshape(-1, 3), np.frombuffer(r["b"], "<i8")
        elif r["kind"] == HITS:
            hits.append(np.frombuffer(r["a"], "<u4").astype(np.int64))
        else:
            same.append(np.frombuffer(r["a"], "<u4").astype(np.int64).reshape(-1, 2))
    return keys, bounds, np.unique(np.concatenate(hits)), np.concatenate(same)


def _spans_table(keys: np.ndarray, bounds: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Table:
    """A row for each document with spans: those that touch are joined, and places count from the document's first word."""
    out = []
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (low[1:] > np.maximum.accumulate(high)[:-1])
        at = np.flatnonzero(new)
        spans = np.stack([low[at], np.maximum.reduceat(high, at)], axis=1) - bounds[row[at]][:, None]
        for r, of in _by_group(row[at], np.arange(len(at))):
            out.append((int(keys[r, 0]), int(keys[r, 1]), spans[of].astype("<i8").tobytes()))
    return pa.Table.from_batches([_batch(out, ["x", "y", "spans"], [pa.int64(), pa.int64(), pa.binary()])])


def _joined(parts: list[bytes]) -> np.ndarray:
    """All spans of a document in order, those that touch joined."""
    spans = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 2) for p in parts])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    at = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[at, 0], np.maximum.reduceat(spans[:, 1], at)], axis=1)


def _expanded(spans: np.ndarray) -> np.ndarray:
    """All places in spans."""
    sizes = spans[:, 1] - spans[:, 0]
    return np.arange(int(sizes.sum())) + np.repeat(spans[:, 0] - np.cumsum(sizes) + sizes, sizes)


def _windows(groups: int, window: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slice_, rows, words, a, b in _slices(batches, 2, True):
            out = [_member(slice_, rows, words, a, b)]
            held = [_expanded(_joined(r[4])) + at for r, at in zip(rows, words.bounds, strict=False)]
            places = np.concatenate(held)
            places = places[(places >= a) & (places < b)]
            row = np.searchsorted(words.bounds, places, side="right") - 1
            ids = np.array([LAST_ID if r[2] is None else r[2] for r in rows], np.int64)[row]
            end = min(len(words.hashes[0]), b + window - 1)
            x, y = (mixed(_run_sums(h[a:end], places - a, places - a + window, base)) for h, base in zip(words.hashes, RUN_BASES, strict=True))
            order, runs = _sorted_runs(x, y)
            count = np.diff(np.append(runs, len(order)))
            if len(runs):
                order = order[np.lexsort((places[order], ids[order], np.repeat(np.arange(len(runs)), count)))]
                one = order[runs]
                least, first = np.repeat(ids[one], count), np.repeat(places[one], count)
                later, twin = ids[order] > least, (ids[order] == least) & (places[order] != first)
                out.append((-1 - slice_, slice_, HITS, (places[order][later] - a).astype("<u4").tobytes(), None, None, None))
                if twin.any():
                    out.append((-1 - slice_, slice_, SAME, (np.stack([first[twin], places[order][twin]], axis=1) - a).astype("<u4").tobytes(), None, None, None))
                group, place = (x[one] % np.uint64(groups)).astype(np.int64), places[one] - a
                by = np.lexsort((place, group))
                for g, of in _by_group(group[by], by):
                    mine = ids[one][of]
                    at = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
                    owners = np.stack([mine[at], np.diff(np.append(at, len(mine)))], axis=1)
                    out.append((g, slice_, ENTRIES, x[one][of].astype("<u8").tobytes(), _planes(np.diff(place[of], prepend=0)), y[one][of].astype("<u8").tobytes(), owners.astype("<i8").tobytes()))
            yield _batch(out, _SENT_NAMES, _SENT_TYPES)

    return send


def _answer_windows(table: pa.Table) -> pa.Table:
    """Entries whose window a document with a smaller id has: each slice hears of its own."""
    entries, out = _payloads(table)
    if entries:
        x, y = (np.concatenate([np.frombuffer(e[c], "<u8") for e in entries]) for c in "ac")
        owners = np.concatenate([np.frombuffer(e["d"], "<i8").reshape(-1, 2) for e in entries])
        ids = np.repeat(owners[:, 0], owners[:, 1])
        hit = np.zeros(len(x), bool)
        for part in _parts(y):
            order, runs = _sorted_runs(x[part], y[part])
            count = np.diff(np.append(runs, len(order)))
            mine = ids[part][order]
            hit[part[order]] = mine > np.repeat(np.minimum.reduceat(mine, runs), count)
        out += _told(entries, hit)
    return pa.Table.from_batches([_batch(out, _ANSWER_NAMES, _ANSWER_TYPES)])


def _spans_of(sent: DataFrame, answer, gather, label: str) -> DataFrame:
    """(x, y, spans) of documents, stored: what slices send is answered by group of hashes, and answers meet by slice."""
    answers = sent.groupBy("group").applyInArrow(answer, ANSWER)
    found = answers.groupBy("slice").applyInArrow(gather, "x long, y long, spans binary")
    return materialize(found.groupBy("x", "y").agg(F.collect_set("spans").alias("spans")), label)


def _meet(rows: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Rows with their documents' spans; these are broadcast while they are few."""
    size = spans.agg(F.sum(F.expr("64 + aggregate(spans, 0L, (a, s) -> a + length(s))"))).first()[0] or 0
    return rows.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, ["x", "y"], how)


def repeated_spans(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(x, y, spans), stored: for each document with repeats its key (see ``row_key``) and, packed, the words that stand in documents with smaller ids."""
    spark = docs.sparkSession
    small_batches(spark)
    groups = min(MOST_GROUPS, GROUPS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _keyed(docs, key, text).where("length(text) > 0")
    ranges = _spans_of(rows.mapInArrow(_anchors(groups, window), SENT), _answer_anchors, _gather_ranges(window), "anchor-ranges")
    again = _meet(rows, ranges, "inner").select("x", "y", "k", "text", F.col("spans").alias("ranges"))
    spans = _spans_of(again.mapInArrow(_windows(groups, window), SENT), _answer_windows, _gather_spans(window), "repeats")
    discard(ranges)
    return spans


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text"))
    rows = rows.select("k", "text", row_key("k", "text").alias("row"))
    return rows.select("row.x", "row.y", "k", F.col("text").cast("binary").alias("text"))


def dedup_passages(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, spans, text) for each row: spans are (start, end) in words, and the text has the words that are left, joined by spaces.

    ``window`` is even, and the key an integer.
    """
    if window < 2 or window % 2:
        raise ValueError("a window is two blocks: an even number of words")
    rows = _meet(_keyed(docs, key, text), repeated_spans(docs, window, key, text), "left").select("k", "text", "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text, parts in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "spans")), strict=True):
                words = (text or b"").split()
                spans, kept, at = [], [], 0
                for s, e in _joined(parts).tolist() if parts else ():
                    spans.append({"start": s, "end": e})
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                out.append((k, len(words), len(words) - len(kept), spans, b" ".join(kept).decode()))
            yield _batch(out, ["k", "n_words", "n_removed", "spans", "text"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()])

    done = rows.mapInArrow(keep, "k long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, text string")
    return done.select(F.col("k").alias(key), "n_words", "n_removed", "spans", "text")
