"""Distributed steady state equals a brute-force numpy power of the lazy chain."""

import numpy as np

from atoflow.operators import markov, transitions
from atoflow.plans import catalog

from .conftest import SF_MID, SF_SMALL


def brute(prob_rows):
    states = sorted({r[0] for r in prob_rows})
    ix = {s: i for i, s in enumerate(states)}
    P = np.zeros((len(states), len(states)))
    for s, t, p in prob_rows:
        P[ix[s], ix[t]] = p
    for i in range(len(states)):
        if P[i].sum() == 0:
            P[i, i] = 1.0
    Q = 0.5 * (np.eye(len(states)) + P)
    x = np.full(len(states), 1.0 / len(states)) @ np.linalg.matrix_power(Q, 2 ** 40)
    return dict(zip(states, x / x.sum()))


def check(spark, trans):
    prob = transitions.transition_matrix(trans)
    exp = brute([(r["evento"], r["prox_evento"], r["p"]) for r in prob.collect()])
    got = {r["evento"]: r["prob"] for r in markov.steady_state(trans).collect()}
    assert set(got) == set(exp)
    for k in exp:
        assert abs(got[k] - exp[k]) < 2e-6, k


def test_returns_chain_small(spark):
    check(spark, catalog._ret_trans(spark, SF_SMALL))


def test_returns_chain_mid(spark):
    check(spark, catalog._ret_trans(spark, SF_MID))


def test_events_chain(spark):
    check(spark, catalog._event_trans(spark, SF_SMALL))
