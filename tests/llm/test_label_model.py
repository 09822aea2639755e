"""The label model of toxicity against loops over documents and voters."""

import math

import numpy as np
import pytest

from quillgraph.llm.toxicity import BETTER, LabelModel


def votes(n=400, seed=3):
    """Six voters: the second repeats the first, the last one speaks up on most toxic rows."""
    rng = np.random.default_rng(seed)
    toxic = rng.random(n) < 0.3
    on = [0.5, 0.5, 0.4, 0.3, 0.35, 0.9]
    off = [0.03, 0.03, 0.02, 0.05, 0.02, 0.05]
    out = np.array([[rng.random() < (a if t else b) for a, b in zip(on, off, strict=True)] for t in toxic])
    out[:, 1] = out[:, 0]
    return out.astype(float), toxic


def rates_by_loops(v, belief, parent):
    out = np.zeros((2, 2, v.shape[1]))
    for j in range(v.shape[1]):
        for c in (0, 1):
            w = belief if c else 1 - belief
            alone = sum(w[i] for i in range(len(v)) if v[i, j])
            plain = (alone + 0.02) / (w.sum() + 0.04)
            for a in (0, 1):
                rows = [i for i in range(len(v)) if parent[j] < 0 or v[i, parent[j]] == a]
                fired = sum(w[i] for i in rows if v[i, j])
                out[c, a, j] = plain if parent[j] < 0 else (fired + 2 * plain) / (sum(w[i] for i in rows) + 2)
    for j in range(v.shape[1]):
        out[1, 0, j] = max(out[1, 0, j], BETTER * out[0, 0, j])
        out[1, 1, j] = max(out[1, 1, j], out[0, 1, j])
    return np.clip(out, 1e-6, 1 - 1e-6)


def belief_by_loops(v, rates, parent, prior):
    out = []
    for row in v:
        x = math.log(prior / (1 - prior))
        for j in range(len(row)):
            a = int(parent[j] >= 0 and row[parent[j]])
            if row[j]:
                x += math.log(rates[1, a, j] / rates[0, a, j])
            elif a or j == len(row) - 1:  # others abstain
                x += math.log((1 - rates[1, a, j]) / (1 - rates[0, a, j])) if a == 1 or j == len(row) - 1 else 0.0
        out.append(1 / (1 + math.exp(-x)))
    return np.array(out)


def test_a_round_equals_loops():
    v, _ = votes()
    model = LabelModel(v, 0.3, rounds=0)
    belief = model.first_belief(v)
    model.estimate(v, belief)
    assert 0 in (model.parent[1], model.parent[0] - 1)  # the two that repeat each other hang together
    assert model.rates == pytest.approx(rates_by_loops(v, belief, model.parent), rel=1e-9)
    if model.parent[-1] < 0:
        assert model.posterior(v) == pytest.approx(belief_by_loops(v, model.rates, model.parent, 0.3), rel=1e-6)


def test_classes_are_found_from_votes_alone():
    v, toxic = votes(2000)
    found = LabelModel(v, 0.3).posterior(v) > 0.5
    assert found[toxic].mean() > 0.95 and (found == toxic).mean() > 0.85


def test_no_votes_and_one_row():
    assert (LabelModel(np.zeros((5, 3)), 0.2).posterior(np.zeros((5, 3))) < 0.5).all()
    assert LabelModel(np.ones((1, 2)), 0.5).posterior(np.ones((1, 2))).shape == (1,)
