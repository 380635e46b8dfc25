"""Situations, their components and coordinates against plain matrices."""

import numpy as np
import pytest

from trajectra.operators import sequences, situations


def plain(rows, weights, a, b):
    """(labels, profiles, squared distances, centred) from a 0/1 table of sequences by situations; rows: id to {pos: code}."""
    labels = sorted({(p, c) for seq in rows.values() for p, c in seq.items()})
    met = np.array([[float(seq.get(p) == c) for p, c in labels] for seq in rows.values()])
    w = np.array([weights[i] for i in rows])
    profiles = np.zeros((len(labels),) * 2)
    for i, (p, _) in enumerate(labels):
        for j in range(i, len(labels)):
            profiles[i, j] = (w * met[:, i] * met[:, j]).sum() / (w * met[:, i]).sum() / (a * (labels[j][0] - p) + b)
    profiles /= profiles.sum(axis=1, keepdims=True)
    size = profiles.sum(axis=0)
    d = np.array([[((x - y) ** 2 / size).sum() for y in profiles] for x in profiles])
    return labels, met, profiles, d, -0.5 * (d - d.mean(0) - d.mean(1)[:, None] + d.mean())


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(3)
    rows = {int(i): {int(p): int(rng.integers(1, 4)) for p in range(1, int(rng.integers(3, 7)))} for i in range(80)}
    return rows, {i: float(1 + i % 3) for i in rows}


def frame_of(spark, rows, weights):
    data = [(i, p, "abc"[c - 1], weights[i]) for i, seq in rows.items() for p, c in seq.items()]
    return sequences.build(spark.createDataFrame(data, "id long, pos int, s string, w double"), "id", "pos", "s", "abc", weight="w")


def test_matrices_equal_plain_ones(spark, made):
    rows, weights = made
    labels, _, profiles, d, centred = plain(rows, weights, 2.0, 0.5)
    s = situations.situations(frame_of(spark, rows, weights))
    assert list(zip(s.pos.tolist(), s.code.tolist(), strict=True)) == labels
    assert np.allclose(s.profiles(2.0, 0.5), profiles) and np.allclose(s.distances(2.0, 0.5), d) and np.allclose(s.centred(2.0, 0.5), centred)
    scores, loadings, spread = s.components(2.0, 0.5)
    z = (centred - centred.mean(0)) / centred.std(0)
    assert np.allclose(loadings.T @ loadings, np.eye(len(labels))) and np.allclose(scores @ loadings.T, z)
    assert np.allclose(scores.std(0), spread, atol=1e-6) and (np.diff(spread) <= 1e-9).all() and (loadings[0] >= 0).all()


def test_coordinates_are_sums_of_scores(spark, made):
    rows, weights = made
    frame = frame_of(spark, rows, weights)
    labels, met, *_ = plain(rows, weights, 1.0, 1.0)
    scores = {(r.pos, "abc".index(r.state) + 1, r.component): r.score for r in situations.situation_components(frame, components=3).collect()}
    assert len(scores) == 3 * len(labels)
    found = {r.id: r.coordinates for r in situations.sequence_coordinates(frame, components=3).collect()}
    for row, i in zip(met, rows, strict=True):
        assert np.allclose(found[i], [sum(scores[p, c, k] for (p, c), m in zip(labels, row, strict=True) if m) for k in (1, 2, 3)])


def test_gaps_limits_and_empty_tables(spark, made, monkeypatch):
    rows, weights = made
    frame = frame_of(spark, rows, weights)
    gaps = frame_of(spark, {1: {2: 1, 5: 2}, 2: {2: 1, 5: 3}, 3: {5: 2}}, dict.fromkeys((1, 2, 3), 1.0))
    s = situations.situations(gaps)
    assert s.pos.tolist() == [2, 5, 5] and np.allclose(s.rates(), [[1, 0.5, 0.5], [0, 1, 0], [0, 0, 1]])
    empty = sequences.SequenceFrame(frame.long.where("false"), frame.states, frame.labels)
    assert situations.situation_correlations(empty).count() == 0
    monkeypatch.setattr(situations, "MOST_SITUATIONS", 3)
    with pytest.raises(ValueError):
        situations.situations(frame)
