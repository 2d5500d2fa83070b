"""The classifiers' fits against exhaustive search and plain likelihoods on small problems."""

import numpy as np

from marketloom.llm import quality, toxicity


def gain(x, y, prior, feature, threshold, inside):
    g, h = (y - prior)[inside], np.full(inside.sum(), prior * (1 - prior))
    left = x[inside, feature] <= threshold
    if h[left].sum() < 1 or h[~left].sum() < 1:
        return -1.0
    return g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)


def test_splits_of_the_first_tree_are_the_best_of_all():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (400, 4)).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 1] - 4) - 2 * (x[:, 3] > 6)))).astype(float)
    trees = toxicity.fit_trees(x, y)
    prior, feature, threshold = y.mean(), trees.feature[0], trees.threshold[0]

    def best(inside):
        return max(gain(x, y, prior, j, t, inside) for j in range(4) for t in np.unique(x[:, j])[:-1])

    whole = np.ones(400, bool)
    left = x[:, feature[0]] <= threshold[0]
    for node, inside in ((0, whole), (1, left), (2, ~left)):
        assert np.isclose(gain(x, y, prior, feature[node], threshold[node], inside), best(inside))


def pooled(y):
    """Non-decreasing least-squares fit by the largest lower and smallest upper means of all runs."""
    n = len(y)
    sums = np.concatenate([[0], np.cumsum(y)])
    return np.array([max(min((sums[b] - sums[a]) / (b - a) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)])


def test_calibration_pools_as_the_min_max_formula():
    rng = np.random.default_rng(1)
    margin = np.sort(rng.normal(size=60))
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * margin))).astype(float)
    fit = pooled(y)
    sizes = {v: (fit == v).sum() for v in np.unique(fit)}
    knots, values = toxicity.isotonic(margin, y)
    wanted = np.maximum.accumulate([(v * sizes[v] + 0.5) / (sizes[v] + 1) for v in fit])
    assert np.allclose(np.interp(margin, knots, values), wanted)


def test_ordinal_fit_cannot_be_bettered_by_small_moves():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    position = x @ [1.0, -0.5, 0.0] + rng.logistic(size=600)
    grades = (position > -0.5).astype(np.int64) + (position > 1.2)
    rows, slots = np.repeat(np.arange(600), 3), np.tile(np.arange(3), 600)
    model = quality.fit_ordinal(rows, slots, x.ravel(), grades)

    def loss(weights, cuts):
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        place = x @ weights
        p = 1 / (1 + np.exp(-(edges[grades + 1] - place))) - 1 / (1 + np.exp(-(edges[grades] - place)))
        return -np.log(p).mean() + quality.PENALTY / 2 * (weights**2).sum() / 600

    weights, cuts = model.weights[:3], model.thresholds
    assert (np.diff(cuts) > 0).all() and not model.weights[3:].any()
    here = loss(weights, cuts)
    for _ in range(300):
        assert loss(weights + rng.normal(0, 0.03, 3), cuts + rng.normal(0, 0.03, 2)) >= here - 1e-6
    assert np.allclose(weights, [1.0, -0.5, 0.0], atol=0.25) and np.allclose(cuts, [-0.5, 1.2], atol=0.25)
