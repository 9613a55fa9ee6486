"""Fingerprints against a version in plain Python, a symbol at a time."""

import hashlib
import random

import pytest

from clipframe.llm import phrases

ALL = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ALL
    return x ^ (x >> 31)


def next_level(symbols):
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    x = [mix((s + n * 0x9E3779B97F4A7C15) & ALL) if n > 1 else s for s, n in runs]
    label = x
    for _ in range(4):
        new = []
        for i, s in enumerate(label):
            before = label[i - 1] if i else ~s & ALL
            bit = next(k for k in range(64) if (s ^ before) >> k & 1)
            new.append(2 * bit + (s >> bit & 1))
        label = new
    cuts = [i for i in range(len(x)) if i == 0 or (i < len(x) - 1 and label[i - 1] < label[i] > label[i + 1])]
    names = []
    for a, b in zip(cuts, [*cuts[1:], len(x)]):
        total = sum(mix((s + k * 0xD6E8FEB86659FD93) & ALL) for k, s in enumerate(x[a:b]))
        names.append(mix((total + b - a) & ALL))
    return names


def fingerprint(text):
    slots = [None] * 64
    symbols = [mix(ord(c)) for c in text]
    for level in (1, 2, 3) if text else ():
        symbols = next_level(symbols)
        if level > 1:
            for s in symbols:
                n = mix((s + level) & ALL)
                slots[n % 64] = min(n >> 6, ALL if slots[n % 64] is None else slots[n % 64])
    while text and None in slots:
        slots = [s if s is not None else None if slots[(i + 1) % 64] is None else mix(slots[(i + 1) % 64]) >> 6 for i, s in enumerate(slots)]
    return "".join(f"{mix(ALL if s is None else s) >> 48:04x}" for s in slots)


def texts():
    r = random.Random(9)
    words = ["".join(r.choice("abcdeé世") for _ in range(r.randint(1, 7))) for _ in range(60)]
    made = [" ".join(r.choice(words) for _ in range(r.randint(1, 400))) for _ in range(30)]
    return [*made, "", "a", "aa", "a" * 5000, "ab" * 900, "\n", "\U0001f600" * 3 + " x", made[3]]


@pytest.mark.parametrize("i", range(len(texts())))
def test_fingerprint(i):
    t = texts()[i]
    assert phrases.as_text(phrases.fingerprints([t])[0]) == fingerprint(t)


def test_query(spark):
    rows = [(i * 7, t) for i, t in enumerate(texts())] + [(1000, None)]
    got = {r["doc_id"]: r for r in phrases.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    for (d, t), (_, after) in zip(order, [*order[1:], order[0]]):
        keep = len(t) - len(t) // 2
        new = t[:keep] + after[: len(t) // 2]
        own, edit, later = fingerprint(t), fingerprint(new), fingerprint(after)
        near = lambda a, b: sum(a[k : k + 4] == b[k : k + 4] for k in range(0, 256, 4)) / 64
        want = (len(t), hashlib.sha256(new.encode()).hexdigest(), own, edit, near(own, edit), near(own, later))
        assert tuple(got[d][c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) == want
