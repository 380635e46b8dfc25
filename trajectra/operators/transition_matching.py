"""Optimal matching of states together with the moves around them.

Each position becomes a token: its state with the next one's, and with ``previous`` also the one's
before; at the ends a state stands for its missing neighbour. Costs are shares of the greatest
substitution cost. An indel is ``otto`` parts of its state's indel and 1 - otto parts of its moves',
a substitution ``otto`` parts of the states' cost and both tokens' moves. What a move counts:

* ``constant``: 1 for a change of state;
* ``rate``: one less the rate of transition, over all sequences; a rare move costs more;
* ``cost``: the cost of substituting the states.

Without ``previous`` staying costs nothing; with it, ``rate`` counts it like any other move.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import distances as D
from . import transitions as T
from .sequences import SequenceFrame

MOVES = ("constant", "rate", "cost")


def move_costs(frame: SequenceFrame, moves: str, shares: np.ndarray) -> np.ndarray:
    """What each move counts, by state and next state; ``shares``: substitution costs as shares of the greatest."""
    k = frame.n_states
    if moves == "rate":
        rates = np.zeros((k, k))
        for r in T.transition_rates(frame).collect():  # alphabet squared
            rates[r.s1 - 1, r.s2 - 1] = r.rate
        return 1 - rates
    if moves not in MOVES:
        raise ValueError(f"moves are one of {MOVES}")
    return shares if moves == "cost" else 1 - np.eye(k)


def token_costs(shares: np.ndarray, indels: np.ndarray, moves: np.ndarray, otto: float, previous: bool) -> tuple[np.ndarray, np.ndarray]:
    """(substitution costs, indels) of the tokens, which are numbered by previous state, state and next one; ``indels`` as shares too."""
    k = len(shares)
    weight = (1 - otto) * indels.max()
    if previous:
        before, state, after = (x.ravel() for x in np.meshgrid(*[np.arange(k)] * 3, indexing="ij"))
        part = weight / 2 * (moves[before, state] + moves[state, after])
    else:
        state, after = (x.ravel() for x in np.meshgrid(*[np.arange(k)] * 2, indexing="ij"))
        part = weight * np.where(state == after, 0.0, moves[state, after])
    cost = otto * shares[state][:, state] + part[:, None] + part[None]
    np.fill_diagonal(cost, 0.0)
    return cost, otto * indels[state] + part


def tokens(frame: SequenceFrame, previous: bool = False) -> SequenceFrame:
    """Sequences of tokens, as long as the states'."""
    k = frame.n_states
    state = lambda i, s: F.coalesce(F.get("seq", i), s) - 1
    own = F.transform("seq", lambda s, i: ((state(i - 1, s) * k if previous else F.lit(0)) + s - 1) * k + state(i + 1, s) + 1)
    names = [f"{a}>{b}" for a in frame.states for b in frame.states]
    return D.ArrayFrame(frame.arrays.select("id", own.alias("seq"), "weight"), tuple(f"{a}>{n}" for a in frame.states for n in names) if previous else tuple(names))


def transition_matching(
    frame: SequenceFrame, moves: str = "constant", previous: bool = False, otto: float = 0.5, costs: list[list[float]] | str | None = None,
    indel: float | list[float] | None = None, norm: str = "none", block: int = D.BLOCK, most: int | None = D.MOST_UNIQUE,
) -> DataFrame:
    """(i, j, d), i < j, over the distinct sequences' uids. ``costs``: of states, a matrix or the name of one (2 where none is given); ``indel``: of each state or all, half the greatest cost where none is given."""
    k = frame.n_states
    if k ** (3 if previous else 2) > T.MOST_STATES:
        raise ValueError(f"{k} states have too many moves")
    if not 0 <= otto <= 1:
        raise ValueError("otto is a share")
    if isinstance(costs, str):
        costs = T.cost_matrix({"RATE": T.rate_costs, "INDELS": T.indel_costs, "FUTURE": T.future_costs}[costs](frame), k)
    table = 2.0 * (1 - np.eye(k)) if costs is None else np.asarray(costs, float)
    greatest = table.max()
    if greatest <= 0 or not np.isfinite(table).all() or (table < 0).any():
        raise ValueError("costs must be finite and not negative, and one above 0")
    own = np.full(k, greatest / 2 if indel is None else indel) if indel is None or np.isscalar(indel) else np.asarray(indel, float)
    shares = table / greatest
    cost, token_indels = token_costs(shares, own / greatest, move_costs(frame, moves, shares), otto, previous)
    # A sequence's number is the least id that has it: that of its tokens', which tell sequences apart as the states do.
    return D.pairwise(tokens(frame, previous), "OM", block=block, most=most, costs=cost.tolist(), indel=token_indels.tolist(), norm=norm)
