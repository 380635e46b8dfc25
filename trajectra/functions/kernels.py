"""Dissimilarities of two blocks of sequences, vectorised over all pairs of the blocks.

A block is a :class:`Block`: codes 1..K in rows padded with 0, lengths, and for spell measures the
spells' durations. A kernel returns the raw distances and the three numbers that normalization
needs: the largest possible value and the two sequences' own sizes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Raw = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Block:
    codes: np.ndarray  # (n, L) ints, 0 beyond the length
    lengths: np.ndarray
    durations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @classmethod
    def of(cls, sequences: list[list[int]], durations: list[list[float]] | None = None) -> Block:
        lengths = np.array([len(s) for s in sequences], np.int64)
        width = int(lengths.max()) if len(lengths) else 0
        codes = np.zeros((len(sequences), width), np.int64)
        times = np.zeros((len(sequences), width))
        for i, s in enumerate(sequences):
            codes[i, : len(s)] = s
            if durations is not None:
                times[i, : len(s)] = durations[i]
        return cls(codes, lengths, times)

    def part(self, a: int, b: int) -> Block:
        """Some rows, no wider than they need."""
        lengths = self.lengths[a:b]
        width = int(lengths.max()) if len(lengths) else 0
        return Block(self.codes[a:b, :width], lengths, self.durations[a:b, :width] if self.durations.size else self.durations)

    def take(self, rows: np.ndarray) -> Block:
        """The rows in another order."""
        return Block(self.codes[rows], self.lengths[rows], self.durations[rows] if self.durations.size else self.durations)


def spells_of(sequence: list[int]) -> tuple[list[int], list[int]]:
    """States and durations of the spells."""
    states: list[int] = []
    durs: list[int] = []
    for s in sequence:
        if states and states[-1] == s:
            durs[-1] += 1
        else:
            states.append(s)
            durs.append(1)
    return states, durs


def padded_costs(costs: list[list[float]]) -> np.ndarray:
    """A K x K table with a row and a column of zeros for the padding before it."""
    k = len(costs)
    out = np.zeros((k + 1, k + 1))
    out[1:, 1:] = costs
    return out


def _normalized(raw: Raw, norm: str) -> np.ndarray:
    d, most, a, b = raw
    d = np.where(d < 1e-12, 0.0, d)
    a, b, most = np.broadcast_to(a, d.shape), np.broadcast_to(b, d.shape), np.broadcast_to(most, d.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        if norm == "none":
            return d
        if norm == "maxlength":
            top = np.maximum(a, b)
            return np.where(top > 0, d / top, 0.0)
        if norm == "gmean":
            top = 2 * np.sqrt(a) * np.sqrt(b)
            return np.where(top > 0, 1 - (most - d) / top, np.where(a != b, 1.0, 0.0))
        if norm == "maxdist":
            return np.where(most > 0, d / most, np.where(d > 0, 1.0, 0.0))
        if norm == "YujianBo":
            return np.where(d > 0, 2 * d / (a + b + d), 0.0)
        if norm == "TWED":
            return np.where(most > 0, 2 * d / (d + most), 0.0)
    raise ValueError(f"unknown normalization {norm!r}")


def _collect(out: np.ndarray, row: list[np.ndarray], rows: np.ndarray, lengths: np.ndarray) -> None:
    """Take the results of the rows that have ended, at the columns' own lengths."""
    at = np.flatnonzero(rows)
    for n in np.unique(lengths) if len(at) else ():
        cells = np.ix_(at, np.flatnonzero(lengths == n))
        out[cells] = row[n][cells]


def edit_distances(x: Block, y: Block, substitution: Callable[[int, int], np.ndarray], deletion: Callable[[int, int], np.ndarray], insertion: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """Least edit costs of all pairs: the table's cells one by one, each for all pairs together.

    ``substitution(i, j)`` is (n, m), the cost of x's item i against y's item j; ``deletion(i, j)`` that
    of x's item i after y's first j, and ``insertion(i, j)`` that of y's item j after x's first i, both
    broadcast to (n, m). A cell is an array that stays in the processor's cache.
    """
    n, m, width = len(x.lengths), len(y.lengths), y.codes.shape[1]
    row = [np.zeros((n, m))]
    for j in range(width):
        row.append(row[j] + insertion(0, j))
    out = np.zeros((n, m))
    _collect(out, row, x.lengths == 0, y.lengths)
    spare = np.empty((n, m))
    for i in range(x.codes.shape[1]):
        diagonal = row[0].copy()
        row[0] += deletion(i, 0)
        for j in range(width):
            above = row[j + 1]
            np.add(diagonal, substitution(i, j), out=spare)
            diagonal[...] = above
            above += deletion(i, j + 1)
            np.minimum(above, spare, out=above)
            np.add(row[j], insertion(i + 1, j), out=spare)
            np.minimum(above, spare, out=above)
        _collect(out, row, x.lengths == i + 1, y.lengths)
    return out


def _against(costs: np.ndarray, x: Block, y: Block) -> Callable[[int, int], np.ndarray]:
    """costs[x's item i, y's item j] for all pairs: whole rows of a small table per j."""
    tables = [np.ascontiguousarray(costs[:, y.codes[:, j]]) for j in range(y.codes.shape[1])]
    codes = np.ascontiguousarray(x.codes.T)
    return lambda i, j: tables[j].take(codes[i], axis=0)


def _tokens(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Number the combinations of features that items have: both blocks' numbers, and the features of each number.

    Costs that depend on several features of an item are then a table over few numbers.
    """
    both = [np.concatenate([a.ravel(), b.ravel()]) for a, b in zip(x, y, strict=True)]
    found, inverse = np.unique(np.stack(both, axis=1), axis=0, return_inverse=True) if len(both[0]) else (np.zeros((1, len(both))), np.zeros(0, np.int64))
    inverse = inverse.ravel()
    return inverse[: x[0].size].reshape(x[0].shape), inverse[x[0].size :].reshape(y[0].shape), list(found.T)


#: Bytes of a table's row of cells that stays in the cache.
CACHED = 2_000_000
#: The same for whole gains by item alone, whose rows of cells are passed over in order.
STREAMED = 4_000_000
#: Rows taken together at least.
ROWS = 16
#: By how much costs may be scaled to be whole.
SCALES = (1, 2, 4, 5, 8, 10, 16, 20, 25, 32, 40, 50, 64, 80, 100)


def _whole(values: list[np.ndarray], most: float) -> tuple[type, float]:
    """The narrowest type that holds sums up to ``most`` of the values exactly, and what they are scaled by; doubles where they aren't whole."""
    flat = np.unique(np.concatenate([np.ravel(v) for v in values]))
    for scale in SCALES:
        if most * scale < 2**31 - 1 and (np.abs(flat * scale - np.rint(flat * scale)) <= 1e-12 * scale).all():
            return (np.int16 if most * scale < 2**15 - 1 else np.int32), float(scale)
    return np.float64, 1.0


def _scaled(values: np.ndarray, kind: type, scale: float) -> np.ndarray:
    return np.asarray(values, np.float64) if kind is np.float64 else np.rint(np.asarray(values) * scale).astype(kind)


def _planes(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(columns, rows of the table, m): the table's values at the codes, an array for each of their columns."""
    return np.ascontiguousarray(table[:, codes.T].transpose(1, 0, 2))


def _by_rows(kernel: Callable[[Block, Block], Raw], x: Block, y: Block, step: int) -> Raw:
    """The kernel on some rows of x at a time."""
    parts = [kernel(x.part(a, a + step), y) for a in range(0, len(x.lengths), step)]
    return *(np.concatenate([p[k] for p in parts]) for k in range(3)), parts[0][3]


def least_edits(x: Block, y: Block, costs: np.ndarray, leave: np.ndarray, enter: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Least edit costs of all pairs, where an indel's cost is by item alone: all indels less the greatest gain of matching.

    ``costs``, ``leave`` and ``enter`` are by item, ``real`` tells items from padding, which gains nothing, so that a pair's
    gain is the last cell's. Steps down and to the right are then free. Gains are whole numbers where a scale makes them so.
    """
    leave, enter = np.where(real, leave, 0.0), np.where(real, enter, 0.0)
    gains = np.where(real[:, None] & real[None], np.maximum(leave[:, None] + enter[None] - costs, 0.0), 0.0)
    n, m, deep, width = len(x.lengths), len(y.lengths), x.codes.shape[1], y.codes.shape[1]
    out = leave[x.codes].sum(axis=1)[:, None] + enter[y.codes].sum(axis=1)[None]
    if not n or not m or not deep or not width:
        return out
    kind, scale = _whole([gains], gains.max() * (min(deep, width) + 1))
    if kind is not np.float64:  # no pair gains more than the best matches of either's items
        most = min(best[codes].sum(axis=1).max() for best, codes in ((gains.max(axis=1), x.codes), (gains.max(axis=0), y.codes)))
        kind = np.uint8 if most * scale < 2**8 - 0.5 else kind
    planes, codes = _planes(_scaled(gains, kind, scale), y.codes), np.ascontiguousarray(x.codes.T)
    step = max(ROWS, min(n, (STREAMED if planes.itemsize < 8 else CACHED) // (planes.itemsize * m * width)))
    for a in range(0, n, step):
        part = codes[:, a : a + step]
        row = np.zeros((width + 1, part.shape[1], m), planes.dtype)
        cells = np.empty((width, part.shape[1], m), planes.dtype)
        for items in part:
            planes.take(items, axis=1, out=cells, mode="clip")
            cells += row[:-1]
            np.maximum(cells, row[1:], out=row[1:])
            for j in range(1, width):
                np.maximum(row[j + 1], row[j], out=row[j + 1])
        out[a : a + step] -= row[width] / scale
    return out


def optimal_matching(x: Block, y: Block, costs: np.ndarray, indels: np.ndarray) -> Raw:
    """OM with substitution costs (K+1, K+1) and an indel per state (K+1, index 0 zero)."""
    d = least_edits(x, y, costs, indels, indels, np.arange(len(indels)) > 0)
    top, indel = costs.max(initial=0.0), indels.max(initial=0.0)
    a, b = x.lengths[:, None], y.lengths[None]
    return d, np.abs(a - b) * indel + min(top, 2 * indel) * np.minimum(a, b), a * indel, b * indel


def longest_common_subsequence(x: Block, y: Block) -> Raw:
    """m + n - 2 LCS, by bit masks: 64 positions of x in a word, all pairs together.

    The bits that are zero count the common subsequence; an item of y clears one where it matches and
    carries to the next set bit. Padding has an empty mask and changes nothing.
    """
    n, m = len(x.lengths), len(y.lengths)
    k = int(max(x.codes.max(initial=0), y.codes.max(initial=0)))
    words = -(-x.codes.shape[1] // 64)
    common = np.zeros((n, m), np.int64)
    masks = []
    for w in range(words):
        codes = x.codes[:, 64 * w : 64 * w + 64]
        bit = np.uint64(1) << np.arange(codes.shape[1], dtype=np.uint64)
        masks.append(np.stack([np.where(codes == c, bit, np.uint64(0)).sum(axis=1, dtype=np.uint64) if c else np.zeros(n, np.uint64) for c in range(k + 1)]))
    held = [np.full((m, n), np.iinfo(np.uint64).max, np.uint64) for _ in range(words)]
    for j in range(y.codes.shape[1]):
        carry = None
        for w in range(words):
            v, match = held[w], masks[w][y.codes[:, j]]
            hit = v & match
            total = v + hit
            over = total < hit
            if carry is not None:
                total += carry
                over |= total < carry
            held[w] = total | (v & ~match)
            carry = over.astype(np.uint64)
    for w in range(words):
        used = np.clip(x.lengths - 64 * w, 0, 64)
        keep = np.where(used == 64, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(used, 63).astype(np.uint64)) - np.uint64(1))
        common += np.bitwise_count(~held[w] & keep[None]).T.astype(np.int64)
    a, b = x.lengths[:, None], y.lengths[None]
    return (a + b - 2 * common).astype(float), a + b, a, b


def _common(x: Block, y: Block, backward: bool, gain: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n, m) each: the number of first (last) items in common, and the sum over them of ``gain`` of the two durations.

    Position by position, until no pair goes on.
    """
    p, q = (_reversed(x), _reversed(y)) if backward else (x, y)
    n, m = len(x.lengths), len(y.lengths)
    count, total = np.zeros((n, m)), np.zeros((n, m))
    same = np.ones((n, m), bool)
    for t in range(min(p.codes.shape[1], q.codes.shape[1])):
        a = p.codes[:, t]
        same &= (a[:, None] == q.codes[:, t][None]) & (a > 0)[:, None]
        if not same.any():
            break
        count += same
        if gain is not None:
            total += gain(p.durations[:, t][:, None], q.durations[:, t][None]) * same
    return count, total


def _reversed(x: Block) -> Block:
    at = x.lengths[:, None] - 1 - np.arange(x.codes.shape[1])[None]
    inside = at >= 0
    codes = np.where(inside, np.take_along_axis(x.codes, np.maximum(at, 0), 1), 0) if x.codes.size else x.codes
    times = np.where(inside, np.take_along_axis(x.durations, np.maximum(at, 0), 1), 0.0) if x.durations.size else x.durations
    return Block(codes, x.lengths, times)


def common_prefix(x: Block, y: Block, backward: bool = False) -> Raw:
    """m + n - 2 times the common prefix, or suffix."""
    a, b = x.lengths[:, None], y.lengths[None]
    return a + b - 2.0 * _common(x, y, backward)[0], a + b, a, b


def common_spell_prefix(x: Block, y: Block, backward: bool = False, weight: float = 1.0, reference: float = 1.0) -> Raw:
    """Spells beyond the common ones, plus the common ones' differences in duration over ``reference``."""
    common, gap = _common(x, y, backward, lambda u, v: np.abs(u - v))
    gap /= reference
    a, b = x.lengths[:, None], y.lengths[None]
    return a + b - 2.0 * common + weight * gap, a + b + weight * np.minimum(a, b), a, b


def common_spell_time(x: Block, y: Block, backward: bool = False) -> Raw:
    """Total time less twice the time shared by the common spells."""
    _, shared = _common(x, y, backward, np.minimum)
    a, b = x.durations.sum(axis=1)[:, None], y.durations.sum(axis=1)[None]
    return a + b - 2 * shared, a + b, a, b


def common_spell_product(x: Block, y: Block, backward: bool = False) -> Raw:
    """Squared durations less twice the products of the common spells' durations."""
    _, shared = _common(x, y, backward, np.multiply)
    a, b = (x.durations**2).sum(axis=1)[:, None], (y.durations**2).sum(axis=1)[None]
    return a + b - 2 * shared, a + b, a, b


def bit_planes(codes: np.ndarray, most: int) -> list[np.ndarray]:
    """For each word of positions, an array (bits, n): the bits of the codes, which are ``most`` at most, a position a bit of the word."""
    n, width = codes.shape
    out = []
    for at in range(0, width, 64):
        part = codes[:, at : at + 64]
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if part.shape[1] <= 8 * np.dtype(t).itemsize)
        place = np.left_shift(np.ones(part.shape[1], kind), np.arange(part.shape[1], dtype=kind))
        out.append(np.stack([np.where(part >> bit & 1, place, kind(0)).sum(axis=1, dtype=kind) for bit in range(max(1, int(most).bit_length()))]) if n else np.zeros((max(1, int(most).bit_length()), 0), kind))
    return out


def mismatches(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """(n, m): at how many positions codes differ, from the bit planes of both."""
    total = None
    for p, q in zip(x, y, strict=True):
        differ = p[0][:, None] ^ q[0][None]
        spare = np.empty_like(differ)
        for a, b in zip(p[1:], q[1:], strict=True):
            np.bitwise_xor(a[:, None], b[None], out=spare)
            differ |= spare
        found = np.bitwise_count(differ)
        total = found if len(x) == 1 else found.astype(np.uint32) if total is None else total + found
    return total


def hamming(x: Block, y: Block, costs: np.ndarray) -> Raw:
    """Sum of position-wise costs; ``costs`` is (K+1, K+1), or (T, K+1, K+1) by position. Mismatches that all cost the same are counted in bits."""
    width = x.codes.shape[1]
    most = sum(c.max() for c in costs[:width]) if costs.ndim == 3 else costs.max() * width
    off = costs[1:, 1:][~np.eye(len(costs) - 1, dtype=bool)] if costs.ndim == 2 else np.zeros(0)
    if width and len(off) and (off == off[0]).all() and not np.diagonal(costs).any() and (x.lengths == width).all() and (y.lengths == width).all():
        k = len(costs) - 1
        d = mismatches(bit_planes(x.codes, k), bit_planes(y.codes, k)) * float(off[0])
        return d, np.float64(most), np.float64(most), np.float64(most)
    d = np.zeros((len(x.lengths), len(y.lengths)))
    for t in range(width):
        table = costs[t] if costs.ndim == 3 else costs
        d += table[x.codes[:, t][:, None], y.codes[:, t][None]]
    return d, np.float64(most), np.float64(most), np.float64(most)


def localized(x: Block, y: Block, costs: np.ndarray, expansion: float, context: float) -> Raw:
    """OM whose indels depend on the items that they meet, from x to y: expansion * max cost + context * mean cost to both.

    x's item i is deleted at y's item j > 1 between y's items j - 1 and j. At the first column, and before y, it meets
    y's last item on both sides, but x's first item meets y's first. y's item j is inserted at x's item i between x's
    items i - 1 and i, and before x, and at its first item, between that item and itself. The two directions differ.
    """
    top = costs.max(initial=0.0)
    n, m, wide, width = len(x.lengths), len(y.lengths), x.codes.shape[1], y.codes.shape[1]
    indel = (expansion + context) * top
    a, b = x.lengths[:, None], y.lengths[None]
    most = np.abs(a - b) * indel + top * np.minimum(a, b)
    if not wide or not width:
        return np.broadcast_to(np.maximum(a, b) * indel, (n, m)).astype(float), most, a * indel, b * indel
    meets = (costs[:, None] + costs[None]) * (context / 2) + expansion * top  # by both items met, then state
    kind, scale = _whole([meets, costs], max(meets.max(), top) * (wide + width + 3))
    step = max(ROWS, CACHED // (np.dtype(kind).itemsize * m * width))
    if n > step:
        return _by_rows(lambda part, other: localized(part, other, costs, expansion, context), x, y, step)
    meets, costs = _scaled(meets, kind, scale), _scaled(costs, kind, scale)
    k = len(costs)
    ends = y.codes[np.arange(m), np.maximum(y.lengths - 1, 0)]
    at_first, at_end = meets[y.codes[:, 0], y.codes[:, 0]].T, meets[ends, ends].T
    # Deletions at each column behind the first, by state; insertions at each column, by the two items of x around them.
    last = np.concatenate([y.codes[:, :1], y.codes[:, :-1]], axis=1)
    left = np.ascontiguousarray(meets[last, y.codes].transpose(1, 2, 0))
    left[0] = at_end
    entered, matched = _planes(meets.reshape(k * k, k), y.codes), _planes(costs, y.codes)
    met = np.concatenate([x.codes[:, :1], x.codes[:, :-1]], axis=1) * k + x.codes
    codes, met = np.ascontiguousarray(x.codes.T), np.ascontiguousarray(met.T)
    row = np.zeros((width + 1, n, m), kind)
    np.cumsum(entered.take(met[0], axis=1), axis=0, out=row[1:])
    d = np.zeros((n, m))
    cells, more = np.empty((2, width, n, m), kind)
    for i in range(wide):
        left.take(codes[i], axis=1, out=cells, mode="clip")
        if i == 0:
            cells[0] = at_first.take(codes[0], axis=0)
        cells += row[1:]
        matched.take(codes[i], axis=1, out=more, mode="clip")
        more += row[:-1]
        np.minimum(cells, more, out=row[1:])
        if i == 0:
            row[0] = at_first.take(codes[0], axis=0)
        else:
            row[0] += at_end.take(codes[i], axis=0)
            if i == 1:
                row[0] += at_end.take(codes[0], axis=0) - at_first.take(codes[0], axis=0)
        entered.take(met[i], axis=1, out=cells, mode="clip")
        for j in range(width):
            np.add(row[j], cells[j], out=more[0])
            np.minimum(row[j + 1], more[0], out=row[j + 1])
        _collect(d, row, x.lengths == i + 1, y.lengths)
    d /= scale
    return np.where((a > 0) & (b > 0), d, np.maximum(a, b) * indel), most, a * indel, b * indel


def localized_gaps(x: Block, y: Block, costs: np.ndarray, expansion: float, context: float) -> Raw:
    """The same with each item between the two items around its gap, so that both directions agree."""
    top = costs.max(initial=0.0)
    n, m = len(x.lengths), len(y.lengths)
    width = y.codes.shape[1]

    def around(codes: np.ndarray, lengths: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The items before and after the gap behind the first i."""
        before = codes[np.arange(len(codes)), np.clip(i - 1, 0, np.maximum(lengths - 1, 0))]
        after = codes[np.arange(len(codes)), np.clip(i, 0, np.maximum(lengths - 1, 0))]
        return before, after

    codes = np.ascontiguousarray(x.codes.T)
    gaps_y = [around(y.codes, y.lengths, j) if width else (np.zeros(m, np.int64),) * 2 for j in range(width + 1)]
    leave = [np.ascontiguousarray((costs[p] + costs[q]).T) * (context / 2) + expansion * top for p, q in gaps_y]
    gaps_x = [around(x.codes, x.lengths, i) if x.codes.shape[1] else (np.zeros(n, np.int64),) * 2 for i in range(x.codes.shape[1] + 1)]
    enter = [(costs[p] + costs[q]) * (context / 2) + expansion * top for p, q in gaps_x]
    d = edit_distances(x, y, _against(costs, x, y), lambda i, j: leave[j].take(codes[i], axis=0), lambda i, j: enter[i].take(y.codes[:, j], axis=1))
    indel = (expansion + context) * top
    a, b = x.lengths[:, None], y.lengths[None]
    return d, np.abs(a - b) * indel + top * np.minimum(a, b), a * indel, b * indel


def spell_length_sensitive(x: Block, y: Block, costs: np.ndarray, indels: np.ndarray, power: float, link: str) -> Raw:
    """OM over positions weighted by their spell's duration to the power -h; ``durations`` are those of each position's spell."""
    p, q, (state, dur) = _tokens([x.codes, x.durations], [y.codes, y.durations])
    state = state.astype(np.int64)
    time = np.where(state > 0, np.maximum(dur, 1) ** -power, 0.0)
    u, v = time[:, None], time[None]
    table = costs[state][:, state] * ((u + v) / 2 if link == "mean" else np.sqrt(u * v))
    move = indels[state] * time
    d = least_edits(Block(p, x.lengths), Block(q, y.lengths), table, move, move, state > 0)
    indel, top = indels.max(initial=0.0), costs.max(initial=0.0)
    a, b = x.lengths[:, None], y.lengths[None]
    return d, np.abs(a - b) * indel + min(top, 2 * indel) * np.minimum(a, b), a * indel, b * indel


def spell_matching(x: Block, y: Block, costs: np.ndarray, indels: np.ndarray, weight: float, tokens: np.ndarray | None = None, relative: float | None = None) -> Raw:
    """OM on spells: state costs plus ``weight`` per unit of duration beyond one, or per ``relative`` units.

    ``tokens`` scales the duration's cost by state.
    """
    scale = np.ones(len(costs)) if tokens is None else tokens

    p, q, (state, dur) = _tokens([x.codes, x.durations], [y.codes, y.durations])
    state = state.astype(np.int64)
    time = np.where(state > 0, weight * scale[state] * (dur / relative if relative else dur - 1), 0.0)
    move = np.where(state > 0, indels[state] + time, 0.0)
    u, v = time[:, None], time[None]
    table = np.where(state[:, None] == state[None], np.abs(u - v), costs[state][:, state] + u + v)
    leave, enter = move[p], move[q]
    d = least_edits(Block(p, x.lengths), Block(q, y.lengths), table, move, move, state > 0)
    indel = indels.max(initial=0.0)
    top = min(costs.max(initial=0.0), 2 * indel)
    a, b = x.lengths[:, None], y.lengths[None]
    return d, np.abs(a - b) * indel + np.maximum(a, b) * top, leave.sum(axis=1)[:, None], enter.sum(axis=1)[None]


def time_warp(x: Block, y: Block, costs: np.ndarray, stiffness: float, penalty: float, indel: float) -> Raw:
    """Time-warp edit distance; warps stay within a sequence, and the borders allow them only along the first row and column."""
    n, m, width = len(x.lengths), len(y.lengths), y.codes.shape[1]
    out = np.zeros((n, m))
    deep = x.codes.shape[1]
    _collect(out, [np.full((n, m), j * indel) for j in range(width + 1)], x.lengths == 0, y.lengths)
    before_x = np.concatenate([np.zeros((n, 1), np.int64), x.codes[:, :-1]], axis=1) if deep else x.codes
    before_y = np.concatenate([np.zeros((m, 1), np.int64), y.codes[:, :-1]], axis=1) if width else y.codes
    p, q, (now, last) = _tokens([x.codes, before_x], [y.codes, before_y])
    now, last = now.astype(np.int64), last.astype(np.int64)
    table = costs[now][:, now] + costs[last][:, last]
    np.fill_diagonal(table, 0.0)
    warp = costs[now, last] + stiffness + penalty  # by item and the one before it
    greatest = max(table.max(initial=0.0) + 2 * stiffness * max(deep, width), warp.max(initial=0.0), indel)
    kind, scale = _whole([table, warp, np.array([2 * stiffness, indel])], greatest * (deep + width + 2))
    step = max(ROWS, CACHED // (np.dtype(kind).itemsize * m * max(1, width)))
    if n > step:
        return _by_rows(lambda part, other: time_warp(part, other, costs, stiffness, penalty, indel), x, y, step)
    warp_x, warp_y = _scaled(warp[p].T, kind, scale), _scaled(warp[q].T, kind, scale)
    pair, codes = _planes(_scaled(table, kind, scale), q), np.ascontiguousarray(p.T)
    row = np.zeros((width + 1, n, m), kind)
    row += _scaled(np.arange(width + 1) * indel, kind, scale)[:, None, None]
    cells, more = np.empty((2, width, n, m), kind)
    for i in range(deep if width else 0):
        pair.take(codes[i], axis=1, out=cells, mode="clip")
        cells += row[:-1]
        cells += _scaled(2 * stiffness * np.abs(i - np.arange(width)), kind, scale)[:, None, None]
        if i == 0:
            row[1] = cells[0]
            for j in range(1, width):
                np.add(row[j], warp_y[j][None], out=row[j + 1])
        else:
            np.add(row[1:], warp_x[i][:, None], out=more)
            np.minimum(cells[1:], more[1:], out=row[2:])
            row[1] = more[0]
            for j in range(1, width):
                np.add(row[j], warp_y[j][None], out=more[0])
                np.minimum(row[j + 1], more[0], out=row[j + 1])
        row[0] = _scaled(np.float64((i + 1) * indel), kind, scale)
        _collect(out, row, x.lengths == i + 1, y.lengths)
    if not width:
        out[...] = x.lengths[:, None] * indel
    else:
        out[x.lengths > 0] /= scale
    a, b = x.lengths[:, None], y.lengths[None]
    top = min(costs.max(initial=0.0), 2 * indel)
    return out, np.abs(a - b) * (stiffness + penalty + top) + 2 * (top + stiffness) * np.minimum(a, b), a * indel, b * indel


def _later(h: np.ndarray) -> np.ndarray:
    """Sums over all later places in both directions."""
    total = np.flip(np.cumsum(np.cumsum(np.flip(h, (-2, -1)), axis=-2), axis=-1), (-2, -1))
    out = np.zeros_like(h)
    out[..., :-1, :-1] = total[..., 1:, 1:]
    return out


def _matches(x: Block, y: Block, proximity: np.ndarray | None) -> np.ndarray:
    a, b = x.codes[:, None, :, None], y.codes[None, :, None, :]
    both = (a > 0) & (b > 0)
    return np.where(both, proximity[a, b], 0.0) if proximity is not None else (both & (a == b)).astype(float)


def subsequence_attributes(x: Block, y: Block, weights: list[float] | None, proximity: np.ndarray | None = None, kind: str = "count") -> np.ndarray:
    """(n, m): over common subsequences of each length, weighted sums of their number (``count``), of their least
    shared time (``shared``) or of the product of their times (``product``)."""
    match = _matches(x, y, proximity)
    deepest = min(x.codes.shape[1], y.codes.shape[1])
    e = match
    shared = np.minimum(x.durations[:, None, :, None], y.durations[None, :, None, :]) if kind == "shared" else None
    u, v = (x.durations[:, None, :, None], y.durations[None, :, None, :]) if kind == "product" else (None, None)
    t = match * shared if kind == "shared" else None
    tu, tv, tuv = (match * u, match * v, match * u * v) if kind == "product" else (None, None, None)
    out = np.zeros(match.shape[:2])
    for k in range(deepest):
        w = 1.0 if weights is None else (weights[k] if k < len(weights) else 0.0)
        value = e if kind == "count" else t if kind == "shared" else tuv
        out += w * value.sum(axis=(2, 3))
        if not e.any():
            break
        more = _later(e)
        if kind == "shared":
            t = match * (_later(t) + more * shared)
        elif kind == "product":
            lu, lv = _later(tu), _later(tv)
            tuv = match * (_later(tuv) + u * lv + v * lu + more * u * v)
            tu, tv = match * (lu + u * more), match * (lv + v * more)
        e = match * more
    return out


def subsequence_distance(x: Block, y: Block, weights: list[float] | None = None, proximity: np.ndarray | None = None, kind: str = "count") -> Raw:
    """Square root of I(x) + I(y) - 2 A(x, y)."""
    own = [np.array([subsequence_attributes(s, s, weights, proximity, kind)[0, 0] for s in _each(b)]) for b in (x, y)]
    a, b = own[0][:, None], own[1][None]
    d = np.sqrt(np.maximum(0.0, a + b - 2 * subsequence_attributes(x, y, weights, proximity, kind)))
    return d, np.sqrt(a + b), np.sqrt(a), np.sqrt(b)


def _each(block: Block):
    for i in range(len(block.lengths)):
        yield Block(block.codes[i : i + 1], block.lengths[i : i + 1], block.durations[i : i + 1])


def profile_distance(x: np.ndarray, y: np.ndarray, masses: np.ndarray, n_breaks: int, norm: bool) -> np.ndarray:
    """Distances of profiles (n, blocks * K), squared differences over ``masses``."""
    scale = np.where(masses > 0, 1 / np.sqrt(np.where(masses > 0, masses, 1.0)), 0.0)
    a, b = x * scale, y * scale
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T
    d = np.sqrt(np.maximum(0.0, np.where(squares < 1e-12, 0.0, squares)))
    return d / np.sqrt(n_breaks) if norm else d


normalized = _normalized
