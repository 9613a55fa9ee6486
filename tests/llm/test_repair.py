"""Re-Pair counts exactly and goes on until no pair is frequent."""

from collections import Counter

import numpy as np
import pytest

from clipframe.llm import repair


def zipf(n, top, seed=0):
    return np.minimum(np.random.default_rng(seed).zipf(1.1, n), top).astype(np.uint32)


@pytest.mark.parametrize("ids, base", [(zipf(300_000, 50_000), 50_257), (zipf(100_000, 300), 1 << 20), (np.tile(zipf(400, 50_000), 1000), 50_257), (np.zeros(5000, np.uint32), 1)])
def test_no_frequent_pair_is_left(ids, base):
    g = repair.compress(ids, base)
    assert (g.expand(g.sequence) == ids).all()
    s = g.sequence.tolist()
    assert max(Counter(zip(s, s[1:])).values(), default=0) < repair.LEAST_COUNT


def test_equal_documents_become_few_symbols():
    assert len(repair.compress(np.tile(zipf(400, 50_000), 5000), 50_257).sequence) < 5000


@pytest.mark.parametrize("wide, half", [(np.uint32, 16), (np.uint64, 32)])
def test_most_frequent_pairs(wide, half):
    x = zipf(400_000, 60_000).astype(wide)
    pair = (x[:-1] << wide(half)) | x[1:]
    pairs, at, own, open_ = repair._frequent(pair, 2 * half, 500, 8)
    count = Counter(pair.tolist())
    want = sorted(count, key=lambda p: (-count[p], p))[:500]
    assert sorted(want) == pairs.tolist()
    assert open_[[count[p] >= 8 for p in pair.tolist()]].all()
    assert (pairs[own[own >= 0]] == pair[at[own >= 0]]).all() and (own >= 0).sum() == sum(count[p] for p in want)


def test_a_rule_is_unrolled_once(monkeypatch):
    ids = np.tile(zipf(2000, 50_000), 50)
    g = repair.compress(ids, 50_257, rules_a_round=16)
    g.sequence = np.concatenate([g.sequence] * 20)
    made, unrolled = [], repair.Grammar._unrolled
    monkeypatch.setattr(repair.Grammar, "_unrolled", lambda self, symbols: made.append(out := unrolled(self, symbols)) or out)
    assert (g.expand(g.sequence) == np.tile(ids, 20)).all()
    assert sum(map(len, made)) <= len(ids)
    assert (g.decode(777, 5000) == ids[777:5000]).all()
