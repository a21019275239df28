"""The numpy kernels against plain Python and the tokenizer library."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftline.llm import bpe, components, jaccard, kernels, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")
texts = st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="ab stvldrme'\n\t é中1!  ", max_size=60)), max_size=8)


@given(texts)
@settings(max_examples=150, deadline=None)
def test_words_and_grams(rows):
    column = pa.array(rows, pa.string())
    found, grams = [], []
    for part in kernels.text_slices(column, 50):
        w = kernels.words(part)
        raw = part.data.tobytes()
        for r in range(part.rows):
            found.append([raw[a:b].decode() for a, b in zip(w.starts[w.first[r] : w.first[r + 1]], w.ends[w.first[r] : w.first[r + 1]], strict=True)])
        _, at = w.grams(3)
        grams += [part.first + r for r in w.row[at]]
    expected = [WORD.findall(t or "") for t in rows]
    assert found == expected
    assert grams == [i for i, w in enumerate(expected) for _ in range(max(0, len(w) - 2))]


def test_equal_words_hash_alike_wherever_they_stand():
    part = next(kernels.text_slices(pa.array(["one two one", "two x one", ""])))
    w = kernels.words(part)
    assert w.hashes[0] == w.hashes[2] == w.hashes[5] and w.hashes[1] == w.hashes[3]
    assert len(set(w.hashes.tolist())) == 3


@given(texts)
@settings(max_examples=100, deadline=None)
def test_token_counts_equal_the_library(rows):
    library = Tokenizer.from_file(PATH)
    model = token_counts.merges(PATH)
    ours = token_counts.count_column(pa.array(rows, pa.string()), model, bpe.Cache())
    assert ours.tolist() == [len(x.ids) for x in library.encode_batch([t or "" for t in rows], add_special_tokens=False)]


def test_special_strings_contractions_and_runs():
    rows = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "we're 'tis it's ''s 'x", "aaaa " * 50, "  x \n\n y\t", "don't\u2019s", "\U0001f600" * 9]
    library = Tokenizer.from_file(PATH)
    ours = token_counts.count_column(pa.array(rows), token_counts.merges(PATH), bpe.Cache(3))
    assert ours.tolist() == [len(x.ids) for x in library.encode_batch(rows, add_special_tokens=False)]


@given(st.integers(50, 99), st.integers(1, 3000), st.integers(0, 600), st.integers(0, 600))
@settings(max_examples=200, deadline=None)
def test_linked_sets_share_a_range(percent, n, more, less):
    a, b = n, max(1, n + more - less)
    if min(a, b) * 100 < percent * max(a, b):
        return
    low, buckets, spare = jaccard._ranges(percent)
    i, j = sorted(np.searchsorted(low, [a, b], "right") - 1)
    assert j - i <= 1
    difference = (a + b) * (100 - percent) // (100 + percent)
    if a != b or difference:
        assert buckets[i] == 0 and difference == 0 or buckets[i] - spare[i] >= difference


def random_sets(rng, groups, size):
    """Groups of sets at several similarities."""
    out = []
    for _ in range(groups):
        base = {rng.getrandbits(64) for _ in range(rng.randint(1, size))}
        out.append(base)
        for _ in range(rng.randint(0, 5)):
            changed = set(rng.sample(sorted(base), max(0, int(len(base) * rng.uniform(0.7, 1.0)))))
            out.append(changed | {rng.getrandbits(64) for _ in range(rng.randint(0, max(1, len(base) // 8)))})
    return [s for s in out if s]


def brute(sets, percent):
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                links.append((j, i))
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))], links


def packed(sets):
    grams = np.concatenate([np.sort(np.array(sorted(s), np.uint64)) for s in sets])
    return grams, np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def test_divide_skip_equals_brute_force():
    rng = random.Random(11)
    for trial in range(40):
        sets = random_sets(rng, rng.randint(1, 12), rng.choice([3, 12, 60, 300]))
        common = {rng.getrandbits(64) for _ in range(20)}  # a passage that many share
        sets = [s | common if rng.random() < 0.4 else s for s in sets]
        percent = rng.choice([60, 80, 85, 95])
        grams, bounds = packed(sets)
        assert jaccard.link_sets(grams, bounds, percent).tolist() == brute(sets, percent)[0], trial


def test_an_index_answers_foreign_queries():
    rng = random.Random(12)
    for _ in range(60):
        sets = random_sets(rng, rng.randint(1, 8), rng.choice([3, 12, 60]))
        percent = rng.choice([60, 80, 95])
        index = jaccard.Index(*packed(sets), percent, rng.choice([0.0, 0.002, 1.0]))
        for base in rng.sample(sets, min(3, len(sets))):
            query = set(rng.sample(sorted(base), max(1, int(len(base) * 0.9)))) | {rng.getrandbits(64)}
            found = index.linked(np.array(sorted(query), np.uint64))
            assert sorted(found.tolist()) == [i for i, s in enumerate(sets) if 100 * len(s & query) >= percent * len(s | query)]


def test_leaders_keep_every_posting_connected():
    rng = np.random.default_rng(4)
    leaders, rows, links = jaccard.Leaders(most=20), [], []
    keys, sets = rng.integers(0, 60, 3000), rng.integers(1000, 1400, 3000)
    for at in range(0, 3000, 100):
        posting, owner, leader = leaders.split(keys[at : at + 100], sets[at : at + 100])
        rows += [(p, o) for p, o, x in zip(posting.tolist(), owner.tolist(), leader.tolist(), strict=True) if o == x]
        links += [(o, x) for o, x in zip(owner.tolist(), leader.tolist(), strict=True) if o != x]
    assert len(leaders.keys) == 20 and len(rows) < 2000
    beside = {}
    for k, s in rows:
        beside.setdefault(("posting", k), set()).add(s)
    links += [(min(x), s) for x in beside.values() for s in x]

    def parts(pairs):
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[max(root(a), root(b))] = min(root(a), root(b))
        return {x: root(x) for x in list(up)}

    every = {}
    for k, s in zip(keys.tolist(), sets.tolist(), strict=True):
        every.setdefault(k, []).append(s)
    assert parts(links) == parts([(x[0], s) for x in every.values() for s in x])


def test_postings_lose_no_link():
    """With and without common n-grams, whichever these are: few, a passage, or nearly all."""
    rng = random.Random(5)
    for _ in range(150):
        sets = random_sets(rng, 6, rng.choice([3, 8, 30, 200, 900]))
        percent = rng.choice([70, 80, 85, 90])
        grams, bounds = packed(sets)
        keys, rows = jaccard.postings(grams, bounds, percent)
        own = [set(keys[rows == i].tolist()) for i in range(len(sets))]
        common = np.sort(np.array(rng.sample(sorted(set().union(*sets)), k=rng.randint(0, len(set().union(*sets)))), np.uint64))
        keys, rows = jaccard.all_postings(grams, bounds, percent, common)
        also = [set(keys[rows == i].tolist()) for i in range(len(sets))]
        for i, j in brute(sets, percent)[1]:
            assert sets[i] == sets[j] or (own[i] & own[j] and also[i] & also[j])


def test_least_reached_equals_union_find():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 200)
        pairs = [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(rng.randint(0, 2 * n))]
        if rng.random() < 0.3:
            pairs = [(i, i + 1) for i in range(n)]
            rng.shuffle(pairs)
        up = {}

        def root(x, up=up):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in pairs:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
        a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        assert dict(zip(*(x.tolist() for x in components.least_reached(a, b)), strict=True)) == {x: root(x) for x in list(up)}
