"""Toxicity: a convolutional text classifier trained in numpy.

A text is its lower-cased words. A word's vector is the mean of hashed embeddings of the word and
of its leading letters, so that unseen words of a known stem are met. Filters of several widths run
over the whole text, each keeps its largest response (with a floor, so texts shorter than a filter
are defined), and a logistic unit joins them. Training is Adam on a bounded, hashed sample of the
labelled rows. A held-back part of the sample then calibrates: scores are shifted so that 0.5 is
the best threshold overall, and each language gets a threshold of its own, which is used only to
reject documents, never for a score.

At scoring, a filter of width w is the sum of w table look-ups, as embedding and filter are
multiplied out once per distinct word; batches are scored whole text by whole text.

Below ``LEAST_LABELLED`` labelled rows to learn from, thresholds aren't to be trusted and no
document is rejected.

Cases: null and empty texts have no words and get the score of the floor; languages not seen in
training use the overall threshold; without usable labels every score is 0; very long texts are
read whole; repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

WORD = re.compile(r"[^\W\d_]+")
#: Rows of the embedding table, its width, filter widths, filters of each.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 12
STEMS = (3, 4, 5, 6)
#: Labelled rows to learn from at most, taken in order of a hash of their id.
MAX_LABELLED = 6_000
#: Labelled rows from which documents are rejected.
LEAST_LABELLED = 100
#: Words whose filter responses a task keeps.
CACHED_WORDS = 80_000
FLOOR = -1.0


def _stem_row(n: int, stem: str) -> int:
    return zlib.crc32(f"{n}^{stem}".encode()) % BUCKETS


def features(word: str) -> list[int]:
    """Rows of the embedding table: the word's, and those of its leading letters."""
    return [zlib.crc32(word.encode()) % BUCKETS, *(_stem_row(n, word[:n]) for n in STEMS if len(word) > n)]


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: np.ndarray  # of filters, all widths
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    labelled: int = 0

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The embedding with a row of zeros at its end, and all places of all filters side by side."""
        return np.concatenate([self.embedding, np.zeros((1, DIM), np.float32)]), np.concatenate([f[k] for f in self.filters for k in range(len(f))], axis=1)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """The largest response of each filter over a text whose words' table rows these are."""
        best = np.full(len(WIDTHS) * FILTERS, FLOOR, np.float32)
        at = 0
        for w, width in enumerate(WIDTHS):
            n = len(rows) - width + 1
            if n > 0:
                total = rows[:n, at : at + FILTERS].copy()
                for k in range(1, width):
                    total += rows[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS]
                mine = slice(w * FILTERS, (w + 1) * FILTERS)
                best[mine] = np.maximum(best[mine], total.max(axis=0) + self.bias[mine])
            at += width * FILTERS
        return best

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.tanh(pooled) @ self.out + self.out_bias - self.shift, -30, 30)))


class Scorer:
    """Scores texts, with a bounded table of words met before."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.padded, self.matrix = model.tables()
        self.table = np.zeros((CACHED_WORDS, sum(WIDTHS) * FILTERS), np.float32)

    def __call__(self, text: str | None) -> float:
        words = WORD.findall((text or "").lower())
        best = np.full(len(WIDTHS) * FILTERS, FLOOR, np.float32)
        overlap = max(WIDTHS) - 1
        step = CACHED_WORDS // 2
        for a in range(0, len(words), step):  # stretches that overlap by a filter's width: the maximum is that of the whole
            best = np.maximum(best, self.model.pooled(self._look_up(words[a : a + step + overlap])))
        return float(self.model.score(best))

    def _look_up(self, words: list[str]) -> np.ndarray:
        fresh = [w for w in set(words) if w not in self.rows]
        if len(self.rows) + len(fresh) > CACHED_WORDS:
            self.rows.clear()
            self.stems.clear()
            fresh = list(set(words))
        if fresh:
            at = len(self.rows)
            self.table[at : at + len(fresh)] = self._word_table(fresh)
            self.rows.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        return self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]

    def _word_table(self, words: list[str]) -> np.ndarray:
        """For each word the responses of every place of every filter: (words, places * FILTERS)."""
        width = 1 + len(STEMS)
        index = np.full((len(words), width), BUCKETS, np.int64)
        for i, word in enumerate(words):
            index[i, 0] = zlib.crc32(word.encode()) % BUCKETS
            for k, n in enumerate(STEMS, 1):
                if len(word) <= n:
                    break
                stem = word[:n]
                row = self.stems.get(stem)
                if row is None:
                    row = self.stems[stem] = _stem_row(n, stem)
                index[i, k] = row
        vectors = self.padded[index].sum(axis=1) / (index < BUCKETS).sum(axis=1, dtype=np.float32)[:, None]
        return vectors @ self.matrix


def train(texts: list[str], labels: list[int], langs: list[str], seed: int = 7, epochs: int = 14, rate: float = 0.01) -> Model | None:
    """Fit on four fifths of the rows and calibrate on the rest; None without rows of both labels."""
    y = np.array(labels, np.float32)
    if len(y) < 20 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in WORD.findall((t or "").lower())], np.int64) for t in texts]
    feats = [features(w) for w in vocab]
    width = max(map(len, feats), default=1)
    index = np.zeros((len(feats) + 1, width), np.int64)
    share = np.zeros((len(feats) + 1, width), np.float32)
    for i, f in enumerate(feats):
        index[i, : len(f)] = f
        share[i, : len(f)] = 1 / len(f)
    model = Model(
        (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32),
        [(rng.standard_normal((w, DIM, FILTERS)) * (0.5 / w**0.5)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32),
        0.0,
    )
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    weight = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * len(fit)
    params = {"out": model.out, "bias": model.bias, **{f"f{i}": f for i, f in enumerate(model.filters)}}
    first = {k: np.zeros_like(v) for k, v in params.items()} | {"e": np.zeros_like(model.embedding)}
    second = {k: np.zeros_like(v) for k, v in params.items()} | {"e": np.zeros_like(model.embedding)}
    step = 0
    batch = 16
    for _ in range(epochs):
        rng.shuffle(fit)
        for a in range(0, len(fit), batch):
            ids = fit[a : a + batch]
            step += 1
            grads = {k: np.zeros_like(v) for k, v in params.items()}
            touched, deltas = [], []
            out_bias_grad = 0.0
            for i in ids:
                rows = docs[i]
                vectors = (model.embedding[index[rows]] * share[rows][:, :, None]).sum(axis=1) if len(rows) else np.zeros((0, DIM), np.float32)
                pooled, where = np.full(len(WIDTHS) * FILTERS, FLOOR, np.float32), np.full(len(WIDTHS) * FILTERS, -1)
                for w, (size, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
                    n = len(rows) - size + 1
                    if n <= 0:
                        continue
                    total = sum(vectors[k : k + n] @ f[k] for k in range(size)) + model.bias[w * FILTERS : (w + 1) * FILTERS]
                    place = total.argmax(axis=0)
                    value = total[place, np.arange(FILTERS)]
                    above = value > FLOOR
                    pooled[w * FILTERS : (w + 1) * FILTERS] = np.where(above, value, FLOOR)
                    where[w * FILTERS : (w + 1) * FILTERS] = np.where(above, place, -1)
                hidden = np.tanh(pooled)
                p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
                d = (p - y[i]) * weight[i] / len(ids)
                grads["out"] += d * hidden
                out_bias_grad += d
                back = d * model.out * (1 - hidden**2) * (where >= 0)
                grads["bias"] += back
                for w, size in enumerate(WIDTHS):
                    for j in range(FILTERS):
                        k0 = where[w * FILTERS + j]
                        if k0 < 0:
                            continue
                        g = back[w * FILTERS + j]
                        grads[f"f{w}"][:, :, j] += g * vectors[k0 : k0 + size]
                        touched.append(rows[k0 : k0 + size])
                        deltas.append(g * model.filters[w][:, :, j])
            lr = rate * (1 - (step * batch) / (epochs * len(fit) + batch))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= (lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
            model.out_bias -= lr * float(out_bias_grad)
            if touched:
                words, d = np.concatenate(touched), np.concatenate(deltas)
                rows = index[words].ravel()
                d = (d[:, None, :] * share[words][:, :, None]).reshape(-1, DIM)
                unique, inverse = np.unique(rows, return_inverse=True)
                g = np.zeros((len(unique), DIM), np.float32)
                np.add.at(g, inverse, d)
                second["e"][unique] += g * g
                model.embedding[unique] -= rate * 10 * (1 - (step * batch) / (epochs * len(fit) + batch)) * g / (np.sqrt(second["e"][unique]) + 1e-6)
    scorer = Scorer(model)
    raw = np.array([scorer(texts[i]) for i in held])
    model.shift = _logit(_best_threshold(raw, y[held]))
    scores = 1 / (1 + np.exp(-(np.array([_logit(s) for s in raw]) - model.shift)))
    names = np.array([langs[i] or "" for i in held])
    for name in sorted(set(names)):
        mine = names == name
        if (y[held][mine] == 1).sum() >= 5 and (y[held][mine] == 0).sum() >= 5:
            model.thresholds[name] = float(min(0.75, max(0.25, _best_threshold(scores[mine], y[held][mine]))))
    return model


def _logit(p: float) -> float:
    p = min(1 - 1e-9, max(1e-9, p))
    return float(np.log(p / (1 - p)))


def _best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the thresholds of the highest F1."""
    edges = np.unique(np.concatenate([[0.0], np.sort(scores), [1.0]]))
    best, at = (-1.0, 0.0), 0.5
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        cut = 1 / (1 + np.exp(-(_logit(a) + _logit(b)) / 2))
        said = scores >= cut
        hit = float((said & (y == 1)).sum())
        f1 = 2 * hit / max(1.0, said.sum() + (y == 1).sum())
        if (f1, _logit(b) - _logit(a)) > best:
            best, at = (f1, _logit(b) - _logit(a)), cut
    return float(at)


def held_out(key: str = "doc_id"):
    """Whether a row is kept from learning; one without an id isn't held out, and has no label either."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """Learn from at most ``max_labelled`` labelled rows that aren't held out; whole texts."""
    usable = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    order = usable.select("doc_id", "toxic", F.xxhash64("doc_id", F.lit("sample")).alias("h"))
    sample = order.orderBy("h", "doc_id").limit(max_labelled)
    found = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).join(F.broadcast(sample), "doc_id").select("h", "doc_id", "text", "lang", "toxic").collect()
    rows = sorted(found, key=lambda r: (r.h, r.doc_id, r.text or ""))
    model = train([r.text for r in rows], [r.toxic for r in rows], [r.lang or "" for r in rows])
    if model is not None:
        model.labelled = len(rows)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, training: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``held_out``, ``score``, ``predicted`` and ``rejected`` (by the language's threshold).

    Columns of these names are replaced. The labelled texts are those of ``training``, or of ``docs``.
    """
    model = fit(training if training is not None else docs, labels, max_labelled)
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model) if model is not None else lambda text: 0.0
        for batch in batches:
            yield pa.array([scorer(t.as_py()) for t in batch], pa.float64())  # one text at a time: a batch may hold many long ones

    keep = [c for c in docs.columns if c not in ("held_out", "score", "predicted", "rejected")]
    scored = docs.select(*[F.col(f"`{c}`") for c in keep], score(F.col("text").cast("string")).alias("score"))
    thresholds = model.thresholds if model else {}
    limit = F.lit(0.5 if model and model.labelled >= LEAST_LABELLED else 2.0)
    thresholds = thresholds if model and model.labelled >= LEAST_LABELLED else {}
    for name, value in thresholds.items():
        limit = F.when(F.col("lang") == name, F.lit(value)).otherwise(limit)
    return scored.select(
        *[F.col(f"`{c}`") for c in keep], held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= limit).alias("rejected")
    )
