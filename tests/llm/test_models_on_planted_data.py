"""Parts of models against plain versions and planted rates: the label model, Newton sums, the randomness battery."""

import base64
import math
import random

import numpy as np
import pytest

from tessera.llm import secrets, toxicity


def planted(seed, n, prior, a, b, copies=()):
    """Votes of independent voters with rates a (toxic) and b (others); ``copies`` repeat another voter's votes."""
    r = np.random.default_rng(seed)
    toxic = r.random(n) < prior
    votes = (r.random((n, len(a))) < np.where(toxic[:, None], a, b)).astype(float)
    for to, source in copies:
        votes[:, to] = votes[:, source]
    return toxic, votes


def test_label_model_finds_planted_rates():
    a, b, prior, n = np.array([0.5, 0.3, 0.4, 0.25, 0.6]), np.array([0.02, 0.01, 0.03, 0.01, 0.05]), 0.2, 60_000
    _, votes = planted(1, n, prior, a, b)
    start = a * np.array([1.25, 0.8, 1.2, 0.8, 0.85]), b * np.array([1.3, 0.7, 1.3, 0.7, 1.2])
    got_a, got_b, dependent = toxicity.fit_label_model(votes.T @ votes, n, *start, prior)
    assert not dependent.any()
    assert np.abs(got_a - a).mean() < 0.6 * np.abs(start[0] - a).mean()
    fit = prior * np.outer(got_a, got_a) + (1 - prior) * np.outer(got_b, got_b)
    true = votes.T @ votes / n
    off = ~np.eye(5, dtype=bool)
    old = prior * np.outer(start[0], start[0]) + (1 - prior) * np.outer(start[1], start[1])
    assert np.abs(fit - true)[off].mean() < 0.5 * np.abs(old - true)[off].mean()


def test_label_model_marks_copies_as_dependent():
    a, b = np.array([0.4, 0.4, 0.3, 0.4]), np.array([0.02, 0.02, 0.02, 0.02])
    _, votes = planted(2, 40_000, 0.2, a, b, copies=[(1, 0)])
    *_, dependent = toxicity.fit_label_model(votes.T @ votes, 40_000, a, b, 0.2)
    want = np.zeros((4, 4), bool)
    want[0, 1] = want[1, 0] = True
    assert (dependent == want).all()


def test_posterior_orders_planted_rows():
    a, b, prior = np.array([0.5, 0.3, 0.4]), np.array([0.02, 0.01, 0.05]), 0.3
    toxic, votes = planted(3, 20_000, prior, a, b)
    p = toxicity.posterior(votes, a, b, np.zeros((3, 3)), prior, np.full(len(votes), -1), 0.0)
    assert ((p >= 0) & (p <= 1)).all() and p[toxic].mean() > 0.6 > 0.4 > p[~toxic].mean()
    one, two = np.array([[1.0, 0, 0]]), np.array([[1.0, 1.0, 0]])
    copy = np.zeros((3, 3))
    copy[0, 1] = copy[1, 0] = 1
    score = lambda v, d: toxicity.posterior(v, a[[0, 0, 2]], b[[0, 0, 2]], d, prior, np.array([-1]), 0.0)[0]
    assert score(two, copy) == pytest.approx(score(one, copy)) and score(two, 0 * copy) > score(one, copy)
    sure = toxicity.posterior(votes[:1], a, b, np.zeros((3, 3)), prior, np.array([0]), 0.0)[0]
    assert sure < toxicity.posterior(votes[:1], a, b, np.zeros((3, 3)), prior, np.array([1]), 0.0)[0]


def test_newton_sums_are_derivatives():
    r = np.random.default_rng(4)
    votes, target, weight, w = (r.random((50, 4)) < 0.4).astype(float), r.random(50), r.uniform(0.5, 3, 50), r.normal(size=5)

    def loss(w):
        z = np.column_stack((votes, np.ones(50))) @ w
        return (weight * (np.logaddexp(0, z) - target * z)).sum()

    grad, hessian = toxicity.newton_sums(votes, target, weight, w)
    step = 1e-5 * np.eye(5)
    assert np.allclose(grad, [(loss(w + s) - loss(w - s)) / 2e-5 for s in step], atol=1e-5)
    for k, s in enumerate(step):
        assert np.allclose(hessian[k], (toxicity.newton_sums(votes, target, weight, w + s)[0] - toxicity.newton_sums(votes, target, weight, w - s)[0]) / 2e-5, atol=1e-5)


def plain_p(token):
    """(encoding, p, bits) of a token by loops over its characters."""
    for name in ("hex", "HEX", "base32", "base64", "base64url"):
        alphabet = secrets.ALPHABETS[name]
        if name == "base64url" or all(c in alphabet for c in token):
            break
    n, k = len(token), len(alphabet)
    own = token if name != "base64url" else "".join(c for c in token if c not in "+/")
    counts = [own.count(c) for c in alphabet]
    chi, df = sum(c * c for c in counts) * k / n - n, k - 1
    z_chi = ((max(chi, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    at = [alphabet.index(c) for c in own]
    turns = sum((x < k / 2) != (y < k / 2) for x, y in zip(at, at[1:]))
    serial = sum((x - (k - 1) / 2) * (y - (k - 1) / 2) for x, y in zip(at, at[1:]))
    z_runs, z_serial = (turns - (n - 1) / 2) / (math.sqrt(n - 1) / 2), serial / ((k * k - 1) / 12 * math.sqrt(n - 1))
    two = lambda z: 2 / (1 + math.exp(1.5976 * min(abs(z), 12) + 0.070566 * min(abs(z), 12) ** 3))
    upper = two(z_chi) / 2 if z_chi > 0 else 1 - two(z_chi) / 2
    p = min(upper, two(z_runs), two(z_serial))
    return name, min(1.0, 1 - (1 - p) ** 3), -sum(c / n * math.log2(c / n) for c in counts if c)


def test_battery_like_plain_loops(spark):
    r = random.Random(5)
    tokens = [r.randbytes(size).hex() for size in (10, 16, 40, 700)] + [r.randbytes(12).hex().upper(), base64.b32encode(r.randbytes(20)).decode().rstrip("=")]
    tokens += [base64.b64encode(r.randbytes(size)).decode().rstrip("=") for size in (15, 33, 1500)] + [base64.urlsafe_b64encode(r.randbytes(30)).decode().rstrip("=") for _ in range(5)]
    tokens += ["a" * 30, "configuration_of_servers-2024", "0123456789abcdef0123456789abcdef", "AKIA" + "A1" * 10, "x" * 1023 + "y" * 1026, "user/name+group_id-12"]
    frame = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {x.token: (x.encoding, x.p, x.bits) for x in secrets._tests(frame).collect()}
    for token in tokens:
        name, p, bits = plain_p(token)
        assert got[token][0] == name
        assert got[token][1] == pytest.approx(p, rel=1e-6, abs=1e-12) and got[token][2] == pytest.approx(bits, abs=1e-9)


def test_normal_tails_are_near_the_error_function(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 81).select((F.col("id") / 20.0).alias("z")).select("z", secrets.two_sided(F.col("z")).alias("p")).collect()
    assert all(abs(x.p - math.erfc(x.z / math.sqrt(2))) < 4e-4 for x in rows)
