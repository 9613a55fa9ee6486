"""All five stages of the pipeline, and run(), against brute force on a small table."""

import collections
import hashlib
import math
import random
import re
import struct

import corpus_pipeline
import pytest
from test_brute import ENCODING, corpus, grams, repeat_words

from clipframe.llm import linededup, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SHARED = "a line that many documents share, with words enough"


def words(text):
    return [x for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]


def table():
    """Rows in no order of ids: near and exact copies, shared lines, junk, nulls."""
    r = random.Random(5)
    texts = corpus(150, 3)
    texts += [f"{t}\n{SHARED.upper() if i % 2 else SHARED}\nown line {i} of this document" for i, t in enumerate(texts[:40])]
    texts += [t + " # $ %" for t in texts[40:60]]
    texts += ["x " * 60, "# $ % " * 40, "line one\nline one\n" * 30, "a b", "", None, "w" * 3000, " ".join("q" * 30 + str(i) for i in range(60))]
    ids = r.sample(range(10_000), len(texts))
    rows = [(i, t, "en", ("s1", "s2", "s3", "s4", None)[min(i % 7, 4)], len(t or "")) for i, t in zip(ids, texts)]
    r.shuffle(rows)
    return rows


def good(rows):
    for row in rows:
        t, w = row[1] or "", words(row[1])
        full, chars = [x for x in t.split("\n") if words(x)], sum(map(len, w))
        bad = len(w) < 50 or 100 * repeat_words(t) > 50 * len(w)
        bad |= 10 * sum(c in quality.SYMBOLS for c in t) > 3 * len(w) or 2 * (len(full) - len(set(full))) > len(t.split("\n"))
        if not bad and 2 * len(w) <= chars <= 20 * len(w):
            yield row


def lined(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(linededup.UPPER, linededup.LOWER))
    first = {}
    for i, t, *_ in sorted(rows):
        for x in t.split("\n"):
            first.setdefault(key(x), i)
    for i, t, lang, source, _ in rows:
        t = "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i)
        yield i, t, lang, source, len(t)


def single(rows):
    sets = {row[0]: grams(row[1]) for row in rows}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    return [row for row in rows if group[row[0]] == row[0]]


def mixed(rows):
    size, total = {row[0]: len(words(row[1])) for row in rows}, collections.Counter()
    for row in rows:
        total[row[3]] += size[row[0]]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, [5.0, 2.0, 1.0] * len(names)))
    target, left = {}, 1.5 * sum(total.values())
    while set(names) - set(target):
        level = left / sum(weight[s] for s in names if s not in target)
        full = [s for s in names if s not in target and level * weight[s] >= 2 * total[s]]
        if not full:
            target |= {s: level * weight[s] for s in names if s not in target}
        for s in full:
            target[s], left = 2.0 * total[s], left - 2 * total[s]

    def key(row):
        u = (int(hashlib.md5(f"42:{row[0]}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        return -math.log(u) / (1 - min(0.9, 9 * sum(c in quality.SYMBOLS for c in row[1]) / max(len(row[1]), 1))), row[0]

    for s in names:
        epochs, upto = target[s] // total[s] if total[s] else 0, 0
        for row in sorted((row for row in rows if row[3] == s), key=key):
            upto += size[row[0]]
            copies = int(epochs) + (upto - size[row[0]] / 2 <= target[s] - epochs * total[s])
            yield from [row] * (copies if size[row[0]] else 0)


def encoded(rows):
    for i, t, *_ in rows:
        ids = ENCODING.encode_ordinary(t)
        raw = struct.pack(f"<{len(ids)}I", *ids)
        yield i, len(ids), raw, hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest()


IDS = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def same(df, columns, want):
    got = collections.Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*columns).collect())
    assert got == collections.Counter(want)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(table(), DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_every_stage_and_run(spark, sf):
    want, docs = table(), spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "mix_sources", "byte_bpe"]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (good, lined, single, mixed, encoded)):
        before, want = want, list(brute(want))
        docs = corpus_pipeline.common.stored(stage(spark, docs, sf), name)
        same(docs, IDS if name == "byte_bpe" else COLUMNS, want)
        assert want and want != before, name
    same(corpus_pipeline.run(spark, sf), IDS, want)
