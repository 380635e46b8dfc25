"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All rules are packed into one multiword Shift-And automaton. A rule is a glob over the canonical
URL (host, then path): a literal byte, ``?`` for any byte, ``*`` for any run without a slash and
``**`` for any run at all. Each literal or ``?`` is one state bit; a run is a loop on the state
before it. A batch of URLs is stepped together, one byte position at a time, so a step costs a few
word operations for all rules and all URLs of the batch.

Cases: a null URL or one without ``://`` has an empty host and path and fits only rules for those;
a URL of any length is read whole; repeated rows are judged one by one; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = 63
#: A batch is cut into groups of URLs of like length whose byte matrix stays under so many cells.
CELLS = 4_000_000


@dataclass(frozen=True)
class Rule:
    """A rule by host (and its subdomains) and path prefix; the longest rule that fits decides."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


@dataclass(frozen=True)
class Glob:
    """A free glob with a verdict, used where no host rule fits."""

    verdict: str
    pattern: str

    def globs(self) -> list[str]:
        return [self.pattern]


def parse_glob(pattern: str) -> list[tuple[str, bytes]]:
    """The pattern's items: ("one", byte), ("any", b""), ("run", b"") and ("deep", b"")."""
    items: list[tuple[str, bytes]] = []
    raw = pattern.encode()
    at = 0
    while at < len(raw):
        char = raw[at : at + 1]
        if raw[at : at + 2] == b"**":
            items.append(("deep", b""))
            at += 2
            continue
        items.append(("run", b"") if char == b"*" else ("any", b"") if char == b"?" else ("one", char))
        at += 1
    return items


class Automaton:
    """Shift-And masks of many globs.

    Bit 0 of a glob's block is its start state; bit k is set once k single-byte items have been
    read. A run after item k makes state k loop on its bytes.
    """

    def __init__(self, globs: Sequence[Sequence[str]]):
        """globs: for each rule, the patterns of which any may fit."""
        blocks: list[tuple[int, list[tuple[str, bytes]]]] = [(rule, parse_glob(g)) for rule, each in enumerate(globs) for g in each]
        sizes = [1 + sum(kind in ("one", "any") for kind, _ in items) for _, items in blocks]
        places, word, bit = [], 0, 0
        for size in sizes:
            if size > WORD:  # a long glob starts a word of its own and carries over
                word, bit = word + (bit > 0), 0
            elif bit + size > WORD:
                word, bit = word + 1, 0
            places.append(word * WORD + bit)
            bit += size
            word, bit = word + bit // WORD, bit % WORD
        self.words = max(1, word + (bit > 0))
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.ends: list[tuple[int, int, np.uint64]] = []
        for (rule, items), base in zip(blocks, places, strict=True):
            state = base
            self.start[base // WORD] |= self._bit(base)
            for kind, char in items:
                if kind in ("one", "any"):
                    state += 1
                    bytes_ = [char[0]] if kind == "one" else range(256)
                    for b in bytes_:
                        self.step[b, state // WORD] |= self._bit(state)
                else:
                    for b in range(256):
                        if kind == "deep" or b != 0x2F:
                            self.loop[b, state // WORD] |= self._bit(state)
            self.ends.append((rule, state // WORD, self._bit(state)))
        self.rules = len(globs)

    @staticmethod
    def _bit(state: int) -> np.uint64:
        return np.uint64(1 << (state % WORD))

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """A boolean matrix, texts by rules: whether the rule fits the whole text."""
        out = np.zeros((len(texts), self.rules), bool)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            most = at + 1
            while most < len(order) and (most + 1 - at) * (int(lengths[order[most]]) + 1) <= CELLS:
                most += 1
            self._match_group([texts[i] for i in order[at:most]], lengths[order[at:most]], order[at:most], out)
            at = most
        return out

    def _match_group(self, texts: list[bytes], lengths: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        width = int(lengths[-1]) if len(lengths) else 0
        cells = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
        state = np.tile(self.start, (len(texts), 1))
        done = 0  # texts are sorted by length: those before it have ended
        one, top = np.uint64(1), np.uint64((1 << WORD) - 1)
        for place in range(width):
            first = int(np.searchsorted(lengths, place, side="right"))
            done = max(done, first)
            live = state[done:]
            moved = (live << one) & top
            if self.words > 1:
                moved[:, 1:] |= live[:, :-1] >> np.uint64(WORD - 1)
            here = cells[done:, place]
            state[done:] = (moved & self.step[here]) | (live & self.loop[here])
        for rule, word, bit in self.ends:
            out[rows, rule] |= (state[:, word] & bit) != 0


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    cut = min((p for p in (rest.find(c) for c in "/?#") if p >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((p for p in (rest.find(c) for c in "?#") if p >= 0), default=len(rest))
    return host.translate(LOWER), rest[:cut]


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], globs: Sequence[Glob] = (), default: str = "allow", key: str = "page_id", url: str = "url"
) -> DataFrame:
    """Judge each row's URL: (key, host, path, rule, matched_glob, verdict).

    The longest fitting host rule decides; else the first fitting glob of ``globs``; else ``default``.
    One narrow map over the rows: nothing is shuffled, and the masks travel with the task.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    automaton = Automaton([r.globs() for r in ranked] + [g.globs() for g in globs])
    names = [r.text for r in ranked]
    verdicts = [r.verdict for r in ranked] + [g.verdict for g in globs]
    patterns = [g.pattern for g in globs]
    n_rules = len(ranked)
    key_type = pages.schema[key].dataType
    source = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [canonical(u) for u in batch.column("u").to_pylist()]
            hits = automaton.match([(h + p).encode() for h, p in parts])
            fits = np.column_stack([hits, np.ones(len(parts), bool)])
            first = fits.argmax(axis=1)
            rule_hit = first < n_rules
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([names[i] if r else None for i, r in zip(first, rule_hit, strict=True)], pa.string()),
                    pa.array([patterns[i - n_rules] if n_rules <= i < len(verdicts) else None for i in first], pa.string()),
                    pa.array([verdicts[i] if i < len(verdicts) else default for i in first], pa.string()),
                ],
                names=["k", "host", "path", "rule", "matched_glob", "verdict"],
            )

    schema = f"k {key_type.simpleString()}, host string, path string, rule string, matched_glob string, verdict string"
    return source.mapInArrow(judge, schema).withColumnRenamed("k", key)
