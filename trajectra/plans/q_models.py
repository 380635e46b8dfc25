"""Queries on hidden Markov models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajectra.operators import hmm as H
from trajectra.sources import fixtures as fx
from trajectra.sources.tables import table
from trajectra.streaming import live

from .rounding import rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _fitted(spark, d):
    frame = fx.ord_status(spark, d)
    return frame, H.fit([frame], 2)[0]


@query("hmm_fit")
def _(spark, d):
    frame = fx.ord_status(spark, d)
    model, history = H.fit([frame], 2)
    n = frame.long.count()
    ic = H.information_criteria(history[-1], model.n_parameters, n)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(history)], "round int, log_likelihood double").withColumn("bic", F.lit(ic["bic"]))


@query("hmm_decode")
def _(spark, d):
    frame, model = _fitted(spark, d)
    return H.decode([frame], model)


@query("hmm_posteriors")
def _(spark, d):
    frame, model = _fitted(spark, d)
    return H.posteriors([frame], model)


@query("hmm_mixture")
def _(spark, d):
    frame = fx.ord_status(spark, d)
    models, shares, _ = H.fit_mixture([frame], [2, 2])
    return H.component_posteriors([frame], models, shares)


@query("hmm_multichannel")
def _(spark, d):
    frames = [fx.ev_all(spark, d), fx.bands_all(spark, d)]
    model, _ = H.fit(frames, 2)
    return H.score(frames, model)


@query("hmm_covariates")
def _(spark, d):
    frame = fx.ord_status(spark, d)
    x = frame.long.select("id", (F.col("id") % 2).cast("double").alias("x")).distinct()
    _, history = H.fit_with_covariates(frame, x, ["x"], 2)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(history)], "round int, log_likelihood double")


@query("hmm_restarts")
def _(spark, d):
    _, history, best = H.fit_best([fx.conv_roles(spark, d)], 2, restarts=3)
    return spark.createDataFrame([(best, len(history), float(history[-1]))], "start int, rounds int, log_likelihood double")


@query("hmm_bootstrap")
def _(spark, d):
    frame = fx.conv_roles(spark, d)
    return H.bootstrap(frame, H.fit([frame], 2)[0], 10)


@query("hmm_simulated_mixture")
def _(spark, d):
    return H.simulate_mixture(spark, [H.random_model(2, [3]), H.random_model(3, [3], 5)], [0.3, 0.7], 200, 10)


@query("hmm_covariate_mixture")
def _(spark, d):
    frame = fx.ord_status(spark, d)
    x = frame.long.select("id", (F.col("id") % 2).cast("double").alias("x")).distinct()
    _, beta, _ = H.fit_covariate_mixture(frame, x, ["x"], [2, 2], rounds=20)
    return spark.createDataFrame([(k + 1, t, float(beta[k, i])) for k in range(2) for i, t in enumerate(("constant", "x"))], "component int, term string, coefficient double")


@query("hmm_simulated")
def _(spark, d):
    return H.simulate(spark, H.random_model(2, [3]), 200, 10)


@query("stream_state_counts", "SELECT date_trunc('day', ts) AS begin, event_type AS state, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    events = table(spark, d, "events").select("ts", "event_type")
    return live.state_counts(events, "ts", "event_type", "1 day").withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@query("stream_sessions", "WITH e AS (SELECT user_id AS id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS l FROM events), g AS (SELECT *, sum(CASE WHEN l IS NULL OR ts - l >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ts) AS k FROM e) SELECT id, min(ts) AS begin, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM g GROUP BY id, k")
def _(spark, d):
    events = table(spark, d, "events").select("user_id", "ts")
    out = live.sessions(events, "user_id", "ts", "6 hours")
    return out.select("id", F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
