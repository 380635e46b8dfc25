"""Hidden Markov models of state sequences: fitting, decoding, scoring, mixtures, covariates, simulation and comparison.

The expectation step runs over distinct sequences in Arrow batches: each batch gives its weighted
expected counts, which are added up, so an iteration is one narrow pass and a sum of small arrays.
Parameters live on the driver and travel with the task. Several channels are the product of their
emissions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import SequenceFrame


@dataclass(frozen=True)
class HMM:
    """start (S), moves (S, S), and per channel emissions (S, K)."""

    start: np.ndarray
    moves: np.ndarray
    emissions: tuple[np.ndarray, ...]

    @property
    def n_parameters(self) -> int:
        s = len(self.start)
        return s - 1 + s * (s - 1) + sum(s * (e.shape[1] - 1) for e in self.emissions)


def random_model(n_hidden: int, channels: Sequence[int], seed: int = 1) -> HMM:
    rng = np.random.default_rng(seed)

    def rows(n: int, k: int) -> np.ndarray:
        x = rng.random((n, k)) + 0.5
        return x / x.sum(axis=1, keepdims=True)

    moves = rows(n_hidden, n_hidden) + 2 * np.eye(n_hidden)
    return HMM(rows(1, n_hidden)[0], moves / moves.sum(axis=1, keepdims=True), tuple(rows(n_hidden, k) for k in channels))


def unique_rows(frames: Sequence[SequenceFrame]) -> DataFrame:
    """(q0, q1, ..., weight): distinct rows of the channels."""
    rows = frames[0].arrays.select("id", "weight", F.col("seq").alias("q0"))
    for n, f in enumerate(frames[1:], 1):
        rows = rows.join(f.arrays.select("id", F.col("seq").alias(f"q{n}")), "id")
    names = [f"q{n}" for n in range(len(frames))]
    return rows.groupBy(*names).agg(F.sum("weight").alias("weight"))


def _likelihoods(model: HMM, channels: Sequence[Sequence[int]]) -> np.ndarray:
    """(T, S): the probability of what is observed at each position; code 0 or beyond the alphabet is unknown."""
    out = np.ones((len(channels[0]), len(model.start)))
    for e, seq in zip(model.emissions, channels, strict=True):
        codes = np.asarray(seq)
        known = (codes > 0) & (codes <= e.shape[1])
        out[known] *= e[:, codes[known] - 1].T
    return out


def forward_backward(model: HMM, channels: Sequence[Sequence[int]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, state posteriors (T, S), and expected moves (S, S), with scaling per position."""
    b = _likelihoods(model, channels)
    n, s = b.shape
    a, scale = np.zeros((n, s)), np.zeros(n)
    for t in range(n):
        a[t] = (model.start if t == 0 else a[t - 1] @ model.moves) * b[t]
        scale[t] = max(a[t].sum(), 1e-300)
        a[t] /= scale[t]
    back = np.ones((n, s))
    for t in range(n - 2, -1, -1):
        back[t] = model.moves @ (b[t + 1] * back[t + 1]) / scale[t + 1]
    moves = np.zeros((s, s))
    for t in range(n - 1):
        moves += a[t][:, None] * model.moves * (b[t + 1] * back[t + 1])[None] / scale[t + 1]
    return float(np.log(scale).sum()), a * back, moves


def forward_backward_many(model: HMM, channels: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for n rows of one length together: (n), (n, T, S) and (n, S, S)."""
    n, length = channels[0].shape
    s = len(model.start)
    b = np.ones((n, length, s))
    for e, codes in zip(model.emissions, channels, strict=True):
        held = np.concatenate([np.ones((1, s)), e.T])  # code 0 or beyond the alphabet is unknown
        b *= held[np.where((codes > 0) & (codes <= e.shape[1]), codes, 0)]
    a, scale = np.zeros((n, length, s)), np.zeros((n, length))
    for t in range(length):
        a[:, t] = (model.start if t == 0 else a[:, t - 1] @ model.moves) * b[:, t]
        scale[:, t] = np.maximum(a[:, t].sum(axis=1), 1e-300)
        a[:, t] /= scale[:, t, None]
    back, moves = np.ones((n, length, s)), np.zeros((n, s, s))
    for t in range(length - 2, -1, -1):
        after = b[:, t + 1] * back[:, t + 1] / scale[:, t + 1, None]
        back[:, t] = after @ model.moves.T
        moves += a[:, t, :, None] * model.moves[None] * after[:, None]
    return np.log(scale).sum(axis=1), a * back, moves


def viterbi(model: HMM, channels: Sequence[Sequence[int]]) -> tuple[list[int], float]:
    """The most likely hidden states (from 1) and their log-probability."""
    b = np.log(np.maximum(_likelihoods(model, channels), 1e-300))
    moves = np.log(np.maximum(model.moves, 1e-300))
    best = np.log(np.maximum(model.start, 1e-300)) + b[0]
    back = []
    for t in range(1, len(b)):
        both = best[:, None] + moves
        back.append(both.argmax(axis=0))
        best = both.max(axis=0) + b[t]
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return [x + 1 for x in reversed(path)], float(best.max())


def _batch_rows(batch: pa.RecordBatch, n_channels: int):
    return zip(*(batch.column(f"q{n}").to_pylist() for n in range(n_channels)), strict=True)


def _expect(rows: DataFrame, models: Sequence[HMM], shares: np.ndarray) -> np.ndarray:
    """Per component: log-likelihood, weight, start, moves and emission counts, added up over all rows."""
    n_channels = len(models[0].emissions)

    def run(batches):
        total = None
        for batch in batches:
            weights = batch.column("weight").to_numpy()
            sizes = batch.column("q0").value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(sizes[sizes > 0]):  # rows of one length go through the recursions together
                at = pa.array(np.flatnonzero(sizes == length))
                codes = [batch.column(f"q{c}").take(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length) for c in range(n_channels)]
                w = weights[sizes == length]
                each = [forward_backward_many(m, codes) for m in models]
                logs = np.stack([e[0] for e in each], axis=1) + np.log(np.maximum(shares, 1e-300))
                top = logs.max(axis=1, keepdims=True)
                post = np.exp(logs - top)
                likelihood = top[:, 0] + np.log(post.sum(axis=1))
                post = w[:, None] * post / post.sum(axis=1, keepdims=True)
                flat = [[float((w * likelihood).sum())]]
                for c, (m, (_, states, moves)) in enumerate(zip(models, each, strict=True)):
                    r = post[:, c]
                    flat += [[r.sum()], r @ states[:, 0], np.tensordot(r, moves, 1).ravel()]
                    for e, held in zip(m.emissions, codes, strict=True):
                        mass = (r[:, None, None] * states).reshape(-1, states.shape[2])
                        known = np.where((held > 0) & (held <= e.shape[1]), held, 0).ravel()
                        counts = np.stack([np.bincount(known, weights=mass[:, h], minlength=e.shape[1] + 1)[1:] for h in range(mass.shape[1])])
                        flat.append(counts.ravel())
                flat = np.concatenate(flat)
                total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["x"])

    return _summed(rows, run)


def _summed(rows: DataFrame, run) -> np.ndarray:
    """The sum of the tasks' vectors on the driver, which gets a row per task with a number per parameter."""
    return np.sum([np.asarray(x) for x in rows.mapInArrow(run, "x array<double>").toArrow().column("x").to_pylist()], axis=0)


def _maximize(flat: np.ndarray, models: Sequence[HMM], smoothing: float = 1e-6) -> tuple[float, np.ndarray, list[HMM]]:
    at, out, sizes = 1, [], []

    def take(*shape: int) -> np.ndarray:
        nonlocal at
        n = int(np.prod(shape))
        x = flat[at : at + n].reshape(shape)
        at += n
        return x

    def share(x: np.ndarray) -> np.ndarray:
        x = x + smoothing
        return x / x.sum(axis=-1, keepdims=True)

    for m in models:
        s = len(m.start)
        sizes.append(float(take(1)[0]))
        start, moves = share(take(s)), share(take(s, s))
        out.append(HMM(start, moves, tuple(share(take(s, e.shape[1])) for e in m.emissions)))
    weights = np.array(sizes)
    return float(flat[0]), weights / weights.sum(), out


def fit(frames: Sequence[SequenceFrame], n_hidden: int, rounds: int = 50, tolerance: float = 1e-4, seed: int = 1, start: HMM | None = None) -> tuple[HMM, list[float]]:
    """Expectation-maximization; the model and the log-likelihood of each round."""
    models, _, history = fit_mixture(frames, [n_hidden], rounds, tolerance, seed, None if start is None else [start])
    return models[0], history


def fit_mixture(frames: Sequence[SequenceFrame], n_hidden: Sequence[int], rounds: int = 50, tolerance: float = 1e-4, seed: int = 1, start: Sequence[HMM] | None = None) -> tuple[list[HMM], np.ndarray, list[float]]:
    """A mixture of models, one per entry of ``n_hidden``: models, their shares, and the log-likelihoods."""
    channels = [f.n_states for f in frames]
    models = list(start) if start else [random_model(h, channels, seed + i) for i, h in enumerate(n_hidden)]
    shares = np.full(len(models), 1 / len(models))
    rows = unique_rows(frames).cache()
    history: list[float] = []
    try:
        for _ in range(rounds):
            value, shares, models = _maximize(_expect(rows, models, shares), models)
            history.append(value)
            if len(history) > 1 and value - history[-2] < tolerance:
                break
    finally:
        rows.unpersist()
    return models, shares, history


def fit_best(frames: Sequence[SequenceFrame], n_hidden: int, restarts: int = 5, rounds: int = 50, tolerance: float = 1e-4, seed: int = 1) -> tuple[HMM, list[float], int]:
    """The best of several fits from seeded starts: the model, its log-likelihoods, and which start it was."""
    found = [fit(frames, n_hidden, rounds, tolerance, seed + 101 * r) for r in range(restarts)]
    best = max(range(restarts), key=lambda r: (found[r][1][-1], -r))
    return (*found[best], best)


def bootstrap(frame: SequenceFrame, model: HMM, replicates: int = 20, rounds: int = 30, seed: int = 1) -> DataFrame:
    """(parameter, from_state, to, mean, sd): start, move and emission probabilities over fits to rows resampled by seeded Poisson weights.

    A replicate is a task's whole work on a sample of distinct rows; each starts from ``model``, so its states keep their order.
    """
    rows = unique_rows([frame])
    spread = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rng = np.random.default_rng([seed, key[0].as_py()])
        table = table.take(pa.array(sorted(range(table.num_rows), key=lambda i: table.column("q0")[i].as_py())))
        seqs = table.column("q0").to_pylist()
        w = rng.poisson(table.column("weight").to_numpy()).astype(float)
        sizes = np.array([len(q) for q in seqs])
        groups = [(np.array([seqs[i] for i in np.flatnonzero((sizes == n) & (w > 0))]), w[(sizes == n) & (w > 0)]) for n in np.unique(sizes[(sizes > 0) & (w > 0)])]
        now, last = model, -np.inf
        for _ in range(rounds):
            value, start, moves, counts = 0.0, np.zeros_like(model.start), np.zeros_like(model.moves), np.zeros_like(model.emissions[0])
            for codes, weight in groups:
                log, states, steps = forward_backward_many(now, [codes])
                value += float(weight @ log)
                start += weight @ states[:, 0]
                moves += np.tensordot(weight, steps, 1)
                mass = (weight[:, None, None] * states).reshape(-1, len(start))
                counts += np.stack([np.bincount(codes.ravel(), weights=mass[:, h], minlength=counts.shape[1] + 1)[1:] for h in range(len(start))])
            share = lambda x: (x + 1e-6) / (x + 1e-6).sum(axis=-1, keepdims=True)
            now = HMM(share(start), share(moves), (share(counts),))
            if value - last < 1e-4:
                break
            last = value
        out = [("start", 0, j + 1, x) for j, x in enumerate(now.start)] + [(n, i + 1, j + 1, x) for n, m in (("move", now.moves), ("emission", now.emissions[0])) for i, r in enumerate(m) for j, x in enumerate(r)]
        columns = list(zip(*out, strict=True))
        return pa.table({"parameter": pa.array(columns[0]), "from_state": pa.array(columns[1], pa.int32()), "to": pa.array(columns[2], pa.int32()), "p": pa.array([float(x) for x in columns[3]])})

    fits = spread.groupBy("replicate").applyInArrow(run, "parameter string, from_state int, to int, p double")
    return fits.groupBy("parameter", "from_state", "to").agg(F.avg("p").alias("mean"), F.stddev_samp("p").alias("sd"))


def simulate_mixture(spark, models: Sequence[HMM], shares: Sequence[float], n: int, length: int, seed: int = 1) -> DataFrame:
    """(id, component, hidden, q0, ...): sequences of a mixture; an id's component is drawn by a seeded hash."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    upto = np.cumsum(shares)
    component = F.lit(len(models))
    for c in range(len(models) - 2, -1, -1):
        component = F.when(u < float(upto[c] / upto[-1]), c + 1).otherwise(component)
    out = None
    for c, model in enumerate(models, 1):
        one = simulate(spark, model, n, length, seed + c).withColumn("component", component).where(F.col("component") == c)
        out = one if out is None else out.unionByName(one)
    return out.select("id", "component", *[x for x in out.columns if x not in ("id", "component")])


def fit_covariate_mixture(frame: SequenceFrame, covariates: DataFrame, columns: Sequence[str], n_hidden: Sequence[int], rounds: int = 30, tolerance: float = 1e-4, rate: float = 0.5, seed: int = 1) -> tuple[list[HMM], np.ndarray, list[float]]:
    """A mixture whose shares depend on covariates: models, coefficients (components, 1 + columns), and log-likelihoods.

    Each round adds up expected counts of the models, and the gradient of the multinomial logit of the components.
    """
    models = [random_model(h, [frame.n_states], seed + i) for i, h in enumerate(n_hidden)]
    m, c = len(models), len(columns) + 1
    beta = np.zeros((m, c))
    x = F.array(F.lit(1.0), *[F.col(n).cast("double") for n in columns])
    rows = frame.arrays.join(covariates, "id").select("weight", F.col("seq").alias("q0"), x.alias("x")).groupBy("q0", "x").agg(F.sum("weight").alias("weight")).cache()
    history: list[float] = []
    try:
        for _ in range(rounds):
            held, now = list(models), beta

            def run(batches, held=held, now=now):
                total = None
                for batch in batches:
                    weights, sizes = batch.column("weight").to_numpy(), batch.column("q0").value_lengths().to_numpy(zero_copy_only=False)
                    xs = np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, c)
                    for length in np.unique(sizes[sizes > 0]):
                        mine = sizes == length
                        codes = batch.column("q0").take(pa.array(np.flatnonzero(mine))).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)
                        w, z = weights[mine], xs[mine]
                        each = [forward_backward_many(one, [codes]) for one in held]
                        prior = softmax(z @ now.T)
                        logs = np.stack([e[0] for e in each], axis=1) + np.log(np.maximum(prior, 1e-300))
                        top = logs.max(axis=1, keepdims=True)
                        post = np.exp(logs - top)
                        value = float(w @ (top[:, 0] + np.log(post.sum(axis=1))))
                        post /= post.sum(axis=1, keepdims=True)
                        flat = [[value, w.sum()], ((w[:, None] * (post - prior)).T @ z).ravel()]
                        for k, (one, (_, states, moves)) in enumerate(zip(held, each, strict=True)):
                            r = w * post[:, k]
                            mass = (r[:, None, None] * states).reshape(-1, states.shape[2])
                            counts = np.stack([np.bincount(codes.ravel(), weights=mass[:, h], minlength=one.emissions[0].shape[1] + 1)[1:] for h in range(mass.shape[1])])
                            flat += [[r.sum()], r @ states[:, 0], np.tensordot(r, moves, 1).ravel(), counts.ravel()]
                        flat = np.concatenate(flat)
                        total = flat if total is None else total + flat
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["x"])

            flat = _summed(rows, run)
            history.append(float(flat[0]))
            beta = beta + rate * flat[2 : 2 + m * c].reshape(m, c) / flat[1] * m
            _, _, models = _maximize(np.concatenate([flat[:1], flat[2 + m * c :]]), models)
            if len(history) > 1 and abs(history[-1] - history[-2]) < tolerance:
                break
    finally:
        rows.unpersist()
    return models, beta - beta[:1], history


def decode(frames: Sequence[SequenceFrame], model: HMM) -> DataFrame:
    """(id, path, log_probability): the most likely hidden states."""
    return _per_row(frames, lambda c: viterbi(model, c), "path array<int>, log_probability double")


def score(frames: Sequence[SequenceFrame], model: HMM) -> DataFrame:
    """(id, log_likelihood)."""
    return _per_row(frames, lambda c: (forward_backward(model, c)[0],), "log_likelihood double")


def posteriors(frames: Sequence[SequenceFrame], model: HMM) -> DataFrame:
    """(id, pos, hidden, p): state posteriors."""
    wide = _per_row(frames, lambda c: (forward_backward(model, c)[1].tolist(),), "p array<array<double>>")
    return wide.select("id", F.posexplode("p").alias("pos", "x")).select("id", (F.col("pos") + 1).alias("pos"), F.posexplode("x").alias("hidden", "p")).withColumn("hidden", F.col("hidden") + 1)


def component_posteriors(frames: Sequence[SequenceFrame], models: Sequence[HMM], shares: np.ndarray) -> DataFrame:
    """(id, component, p)."""

    def one(channels) -> tuple:
        logs = np.array([forward_backward(m, channels)[0] for m in models]) + np.log(np.maximum(shares, 1e-300))
        p = np.exp(logs - logs.max())
        return ((p / p.sum()).tolist(),)

    return _per_row(frames, one, "p array<double>").select("id", F.posexplode("p").alias("component", "p")).withColumn("component", F.col("component") + 1)


def _per_row(frames: Sequence[SequenceFrame], one, columns: str) -> DataFrame:
    rows = frames[0].arrays.select("id", F.col("seq").alias("q0"))
    for n, f in enumerate(frames[1:], 1):
        rows = rows.join(f.arrays.select("id", F.col("seq").alias(f"q{n}")), "id")
    names = [c.strip().split(" ")[0] for c in columns.split(", ")]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {columns}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(columns))
    n_channels = len(frames)

    def run(batches):
        for batch in batches:
            found = [one(c) for c in _batch_rows(batch, n_channels)]
            out = [pa.array([f[i] for f in found], arrow.field(i).type) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *out], names=["id", *names])

    return rows.mapInArrow(run, schema)


def information_criteria(log_likelihood: float, n_parameters: int, n_observations: float) -> dict[str, float]:
    return {"aic": 2 * n_parameters - 2 * log_likelihood, "bic": n_parameters * math.log(n_observations) - 2 * log_likelihood}


def simulate(spark, model: HMM, n: int, length: int, seed: int = 1) -> DataFrame:
    """(id, hidden, q0, ...): ``n`` sequences; each id draws from a generator of its own seed."""
    n_channels = len(model.emissions)
    columns = ", ".join(f"q{i} array<int>" for i in range(n_channels))

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            hidden, seen = [], [[] for _ in range(n_channels)]
            for x in ids:
                rng = np.random.default_rng([seed, x])
                states = [int(rng.choice(len(model.start), p=model.start))]
                for _ in range(length - 1):
                    states.append(int(rng.choice(len(model.start), p=model.moves[states[-1]])))
                hidden.append([s + 1 for s in states])
                for c, e in zip(seen, model.emissions, strict=True):
                    c.append([int(rng.choice(e.shape[1], p=e[s])) + 1 for s in states])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.list_(pa.int32())) for x in (hidden, *seen))], names=["id", "hidden", *(f"q{i}" for i in range(n_channels))])

    return spark.range(n).mapInArrow(run, f"id long, hidden array<int>, {columns}")


def permuted(model: HMM, order: Sequence[int]) -> HMM:
    """The same model with its hidden states in another order (from 0)."""
    o = list(order)
    return HMM(model.start[o], model.moves[np.ix_(o, o)], tuple(e[o] for e in model.emissions))


def trimmed(model: HMM, least: float = 1e-6) -> HMM:
    """Probabilities under ``least`` set to zero, the others scaled up."""

    def cut(x: np.ndarray) -> np.ndarray:
        x = np.where(x < least, 0.0, x)
        return x / x.sum(axis=-1, keepdims=True)

    return replace(model, start=cut(model.start), moves=cut(model.moves), emissions=tuple(map(cut, model.emissions)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class CovariateHMM:
    """Start, moves and emissions as softmax of coefficients times covariates: (S, C), (S, S, C), (S, K, C)."""

    start: np.ndarray
    moves: np.ndarray
    emissions: np.ndarray

    def at(self, x: np.ndarray) -> HMM:
        """The model for one vector of covariates."""
        return HMM(softmax(self.start @ x), softmax(self.moves @ x), (softmax(self.emissions @ x),))


def fit_with_covariates(frame: SequenceFrame, covariates: DataFrame, columns: Sequence[str], n_hidden: int, rounds: int = 30, rate: float = 0.5, seed: int = 1) -> tuple[CovariateHMM, list[float]]:
    """Generalized EM: expected counts give the gradient of the softmax coefficients, added up over rows; one step a round.

    ``covariates``: (id, columns...), constant over a sequence; a constant is put before them.
    """
    rng = np.random.default_rng(seed)
    c, k, s = len(columns) + 1, frame.n_states, n_hidden
    model = CovariateHMM(rng.normal(0, 0.1, (s, c)), np.concatenate([np.eye(s)[:, :, None] * 1.5, rng.normal(0, 0.05, (s, s, c - 1))], axis=2), rng.normal(0, 0.5, (s, k, c)))
    rows = frame.arrays.join(covariates, "id").select("weight", F.col("seq").alias("q0"), F.array(F.lit(1.0), *[F.col(x).cast("double") for x in columns]).alias("x")).groupBy("q0", "x").agg(F.sum("weight").alias("weight")).cache()
    history: list[float] = []
    try:
        for _ in range(rounds):
            now = model

            def run(batches, now=now):
                total = None
                for batch in batches:
                    for seq, x, w in zip(*(batch.column(n).to_pylist() for n in ("q0", "x", "weight")), strict=True):
                        if not seq:
                            continue
                        x = np.array(x)
                        held = now.at(x)
                        value, states, moves = forward_backward(held, [seq])
                        counts = np.zeros((s, k))
                        np.add.at(counts.T, np.asarray(seq) - 1, states)
                        g0 = np.outer(states[0] - held.start, x)
                        g1 = (moves - moves.sum(axis=1, keepdims=True) * held.moves)[:, :, None] * x
                        g2 = (counts - counts.sum(axis=1, keepdims=True) * held.emissions[0])[:, :, None] * x
                        flat = w * np.concatenate([[value, 1.0, len(seq)], g0.ravel(), g1.ravel(), g2.ravel()])
                        total = flat if total is None else total + flat
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["x"])

            flat = _summed(rows, run)
            history.append(float(flat[0]))
            n_rows, n_places = flat[1], flat[2]
            g0, rest = flat[3 : 3 + s * c], flat[3 + s * c :]
            g1, g2 = rest[: s * s * c], rest[s * s * c :]
            model = CovariateHMM(model.start + rate * g0.reshape(s, c) / n_rows * s, model.moves + rate * g1.reshape(s, s, c) / n_places * s, model.emissions + rate * g2.reshape(s, k, c) / n_places * s)
    finally:
        rows.unpersist()
    return model, history
