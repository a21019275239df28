"""The methods by which models, plans and rates are found, against plain versions that go item by item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftline.llm import mixing, packing, quality, toxicity
from siftline.llm.kernels import text_slices

pa = pytest.importorskip("pyarrow")


def test_ftrl_equals_a_plain_loop():
    rng = random.Random(1)
    settings = toxicity.Settings(bits=8, l1=0.7, l2=0.1, epochs=3, support=2)
    examples = [(rng.random() < 0.4, np.array(sorted(rng.sample(range(256), rng.randint(0, 25))), np.int32)) for _ in range(120)]
    examples = [(int(y), np.union1d(x, [7]) if y else x) for y, x in examples]
    bias, index, weight = toxicity.train(examples, settings)

    seen = Counter(i for _, x in examples for i in x.tolist())
    z, n, b, bn = Counter(), Counter(), 0.0, 0.0

    def w(i):
        if abs(z[i]) <= settings.l1:
            return 0.0
        return -(z[i] - math.copysign(settings.l1, z[i])) / ((settings.beta + math.sqrt(n[i])) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for y, x in examples:
            own = [i for i in x.tolist() if seen[i] >= settings.support]
            now = {i: w(i) for i in own}
            g = 1 / (1 + math.exp(-(b + sum(now.values())))) - y
            bn += g * g
            b -= min(1.0, settings.alpha) * g / (settings.beta + math.sqrt(bn))
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / settings.alpha * now[i]
                n[i] += g * g
    plain = {i: w(i) for i in list(z) if w(i)}
    assert abs(bias - b) < 1e-9 and set(index.tolist()) == set(plain)
    assert all(abs(plain[i] - x) < 1e-9 for i, x in zip(index.tolist(), weight.tolist(), strict=True)) and 0 < len(plain) < 256


def test_hashed_features_are_words_pairs_and_skips():
    texts = ["One two, two THREE four five", "", "two three Größe x1 -- y", "one", "a b a b a b"]
    (part,) = text_slices(pa.array(texts))
    rows, places = toxicity.features(part, 60, (2, 3))
    named = {}
    for r, t in enumerate(texts):
        w = [x.lower() if x.isascii() else x for x in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", t)]
        grams = Counter([(1, x) for x in w] + [(k, w[i], w[i + k]) for k in (1, 2, 3) for i in range(len(w) - k)])
        own = Counter(places[rows == r].tolist())
        assert sorted(own.values()) == sorted(grams.values())
        for g in grams:
            named.setdefault(g, []).append(set(own))
    # what two texts share is at one coordinate in both
    assert all(set.intersection(*x) for x in named.values())
    assert len(set(places.tolist())) == len(named)


def plain_descent(positive, unlabelled, prior, settings):
    size = len(positive[0])
    w, m, v = ([0.0] * (size + 1) for _ in range(3))
    dot = lambda x: sum(a * b for a, b in zip(w, x, strict=False)) + w[size]
    for step in range(1, settings.steps + 1):
        at = [1 / (1 + math.exp(-dot(x))) for x in positive], [1 / (1 + math.exp(-dot(x))) for x in unlabelled]
        g = [0.0] * (size + 1)
        rest = sum(math.log1p(math.exp(dot(x))) for x in unlabelled) / len(unlabelled) - prior * sum(math.log1p(math.exp(dot(x))) for x in positive) / len(positive)
        for k in range(size + 1):
            of = lambda x: x[k] if k < size else 1.0  # noqa: E731, B023
            away = sum(s * of(x) for s, x in zip(at[1], unlabelled, strict=True)) / len(unlabelled) - prior * sum(s * of(x) for s, x in zip(at[0], positive, strict=True)) / len(positive)
            gain = prior * sum((s - 1) * of(x) for s, x in zip(at[0], positive, strict=True)) / len(positive)
            # where the negative risk would be below zero, only it is pushed up again
            g[k] = (gain + away if rest >= 0 else -away) + settings.ridge * (w[k] if k < size else 0.0)
        for k in range(size + 1):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            w[k] -= settings.rate * (m[k] / (1 - 0.9**step)) / (math.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


@pytest.mark.parametrize("prior", [0.1, 0.45, 0.9])
def test_non_negative_risk_equals_a_plain_loop(prior):
    rng = np.random.default_rng(3)
    positive = rng.normal(1, 1, (25, 3))
    unlabelled = np.concatenate([rng.normal(1, 1, (15, 3)), rng.normal(-1, 1, (25, 3))])
    settings = quality.Settings(steps=60)
    w, b = quality._descend(positive, unlabelled, prior, settings)
    assert np.allclose([*w, b], plain_descent(positive.tolist(), unlabelled.tolist(), prior, settings), atol=1e-9)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_the_prior_is_found(share):
    rng = np.random.default_rng(5)
    n = 8000
    unlabelled = np.where(rng.random(n) < share, rng.normal(2, 1, n), rng.normal(-2, 1, n))
    assert abs(quality.estimate_prior(rng.normal(2, 1, 4000), unlabelled) - share) < 0.08


def test_shape_features_of_plain_counts():
    texts = ["One two two, three!\nfour # five", "", "x x x x", "Größe 12 ABC."]
    (part,) = text_slices(pa.array(texts))
    x = quality.shape_features(part)
    assert np.isfinite(x).all()
    for r, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), y) for y in w]
        assert abs(x[r, 0] - math.log1p(len(w))) < 1e-12
        assert abs(x[r, 5] - sum(c in "#*$%&|<>@^~_=+{}[]\\/" for c in t) / max(1, len(w))) < 1e-12
        assert abs(x[r, 11] - (1 - len(set(low)) / max(1, len(low)))) < 1e-12


def plain_packing(counts, capacity):
    """One sequence at a time: each takes as many pieces of a length as it holds."""
    full = (capacity.tokens, capacity.documents, capacity.attention)
    open_, out = [], []
    for length in sorted(counts, reverse=True):
        need, left = (length, 1, capacity.cost(length)), counts[length]
        while left:
            able = [s for s in open_ if all(r >= d for r, d in zip(s[0], need, strict=True)) and min(s[0]) > 0]
            if able:
                parts = lambda s: zip(capacity.weights, ((r / f, d / f) for r, d, f in zip(s[0], need, full, strict=True)), strict=True)  # noqa: E731, B023
                if capacity.score == "norm":
                    best = max(able, key=lambda s: -sum(w * (r - d) ** 2 for w, (r, d) in parts(s)))
                else:
                    best = max(able, key=lambda s: sum(w * r * d for w, (r, d) in parts(s)))
            else:
                best = [list(full), []]
                open_.append(best), out.append(best)
            each = min(left, *(r // d for r, d in zip(best[0], need, strict=True)))
            best[0] = [r - each * d for r, d in zip(best[0], need, strict=True)]
            best[1] += [length] * each
            left -= each
    return Counter(tuple(s[1]) for s in out)


@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(100, 4, 60, 16, (1, 0.7, 0.3)), packing.Capacity(100, 5, 90, 13, (0.9, 0.41, 0.23), "dot")])
def test_plan_equals_plain_vector_best_fit(capacity):
    rng = random.Random(9)
    counts = Counter(min(capacity.tokens, int(rng.expovariate(3 / capacity.tokens)) + 1) for _ in range(700))
    shaped = {}
    rules = packing.plan(dict(counts), capacity, shaped).tolist()
    held = {}
    for i, (length, rank, each, first, _) in enumerate(rules):
        end = rules[i + 1][1] if i + 1 < len(rules) and rules[i + 1][0] == length else counts[length]
        for r in range(rank, end):
            held.setdefault(first + (r - rank) // each, []).append(length)
    assert Counter(tuple(sorted(x, reverse=True)) for x in held.values()) == plain_packing(counts, capacity)
    assert shaped["choice"] > 0


def test_newton_reaches_the_plain_solution(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", "c", "d", None]), rng.randint(0, 50)) for _ in range(500)] + [("empty", 0)]
    sizes = Counter()
    for s, n in rows:
        sizes[s] += n
    goal = mixing.targets(dict(sizes))
    found = mixing.balance(spark.createDataFrame(rows, "source string, size long"), goal)

    def slope(s, m):  # of the dual, document by document
        return sum(n * math.exp(m) for t, n in rows if t == s) - goal[s]

    for s in sizes:
        if not goal[s]:
            assert found[s] == -math.inf
            continue
        low, high = -20.0, 20.0
        while high - low > 1e-12:
            mid = (low + high) / 2
            low, high = (mid, high) if slope(s, mid) < 0 else (low, mid)
        assert abs(found[s] - low) < 1e-6


def test_rounding_carries_what_is_owed():
    import pandas as pd

    rng = random.Random(7)
    for rate in (0.0, 0.3, 1.0, 1.37, 2.0):
        rows = [(i, rng.randint(0, 40), rng.randrange(10**6)) for i in range(300)]
        group = pd.DataFrame(rows, columns=["doc_id", "size", "_order"]).assign(_rate=rate, _most=2.0, _bucket=0)
        out = mixing._round_copies(group)
        copies = dict(zip(out["doc_id"], out["copies"], strict=True))
        owed = 0.0
        for i, n, _ in sorted(rows, key=lambda r: (-r[1], r[2], r[0])):
            owed += (rate - math.floor(rate)) * n
            extra = copies[i] - math.floor(rate)
            assert extra in (0, 1) and extra == (rate % 1 > 0 and n > 0 and 2 * owed >= n)
            owed -= extra * n
        assert abs(owed) <= 20.5
