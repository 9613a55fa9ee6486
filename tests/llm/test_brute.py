"""Operators against brute force on small tables made from a seed."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from clipframe.llm import bpe, components, linededup, mixing, ngramjoin, phrases, quality, repair, separators, suffixes, tokenfile

RANKS = bpe.pieces.rank_file(P.path("byte_bpe_50k.tiktoken"))
ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def corpus(n=120, seed=1):
    """Texts with exact and near copies, shared passages and repeated lines."""
    r = random.Random(seed)
    pool = ["".join(r.choice(["an", "the", "or", "é", "st", "ing"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    passage = " ".join(r.choice(pool) for _ in range(110))
    texts = []
    for i in range(n):
        ws = [r.choice(pool) for _ in range(r.randint(3, 300))]
        kind = i % 6
        if kind == 1 and texts:
            ws = r.choice(texts).split(" ")
        elif kind == 2 and texts:
            ws = r.choice(texts).split(" ")
            for _ in range(max(1, len(ws) // 60)):
                ws[r.randrange(len(ws))] = "edit"
        elif kind == 3:
            ws[len(ws) // 2 : len(ws) // 2] = passage.split(" ")
        elif kind == 4:
            ws += ["\nthe same line in many\n", *ws[:20], "\nThe Same Line in many \n"]
        texts.append(" ".join(ws))
    return texts


TEXTS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 3, t, f"s{i % 5 if i % 3 else 0}") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string").repartition(5).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def removed(texts, span):
    starts = collections.Counter(hash(b[i : i + span]) for b in texts for i in range(len(b) - span + 1))
    for b in texts:
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if starts[hash(b[i : i + span])] > 1:
                cover[i : i + span] = True
        yield cover


@pytest.mark.parametrize("span", [400, 90])
def test_suffixes(docs, span):
    got = by_id(suffixes.dedup_substrings(docs, span=span))
    raw = [t.encode() for t in TEXTS]
    for i, (b, cover) in enumerate(zip(raw, removed(raw, span))):
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        spans = int(np.sum(np.diff(np.concatenate([[0], cover.astype(int)])) == 1))
        r = got[i * 3]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (cover.sum(), spans, hashlib.sha256(kept).hexdigest())


def test_suffixes_of_periodic_text(spark):
    texts = ["ab" * 600, "xyz" * 150, "ab" * 199, "q" * 401, "q" * 400]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(suffixes.dedup_substrings(d))
    for i, cover in enumerate(removed([t.encode() for t in texts], 400)):
        assert got[i]["n_removed"] == cover.sum()


def grams(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("tile", [4096, 3])
def test_jaccard(docs, tile):
    sets = [grams(t) for t in TEXTS]
    group, links = list(range(len(sets))), [0] * len(sets)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                links[i], links[j] = links[i] + 1, links[j] + 1
                a_root, b_root = root(i), root(j)
                group[max(a_root, b_root)] = min(a_root, b_root)
    got = by_id(ngramjoin.jaccard_join(docs, tile=tile))
    for i, s in enumerate(sets):
        assert (got[i * 3]["class_id"], got[i * 3]["n_links"], got[i * 3]["n_grams"]) == (root(i) * 3, links[i], len(s))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_posterior_bounds_are_rising():
    least = ngramjoin.least_matches()
    assert list(least) == sorted(least) and 0 < least[0] < ngramjoin.STEP and least[-1] / (ngramjoin.BANDS * ngramjoin.ROWS) < 0.8


def test_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(linededup.UPPER, linededup.LOWER))
    first, count = {}, collections.Counter()
    for i, t in enumerate(TEXTS):
        for k in {key(x) for x in t.split("\n")}:
            first.setdefault(k, i)
            count[k] += 1
    got = by_id(linededup.dedup_lines(docs))
    for i, t in enumerate(TEXTS):
        kept = [x for x in t.split("\n") if not (len(key(x)) >= 10 and count[key(x)] > 1 and first[key(x)] != i)]
        assert got[i * 3]["kept_text"] == "\n".join(kept)


def test_filters_miss_no_repeat(spark):
    r = np.random.default_rng(3)
    once, twice = r.integers(-(1 << 63), 1 << 63, 3000), r.integers(-(1 << 63), 1 << 63, 500)
    rows = [([int(x)],) for x in [*once, *twice, *twice]]
    filt, bits = linededup.twice_seen(spark.createDataFrame(rows, "hashes array<long>").repartition(7))
    hit = lambda h: (np.unpackbits(filt)[linededup._mix(h, bits)]).astype(bool)
    assert hit(twice).all() and hit(once).mean() < 0.2


def test_segments_of_large_filters_agree(monkeypatch):
    import pyarrow as pa

    h = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 4000)
    h[100:200] = h[:100]
    b = pa.RecordBatch.from_pydict({"hashes": pa.array([[int(x)] for x in h], pa.list_(pa.int64()))})
    made = []
    for segment in (1 << 19, 1 << 10):
        monkeypatch.setattr(linededup, "SEGMENT", segment)
        bits = 1 << 18
        full = np.zeros(bits // 8, np.uint8)
        for out in linededup._segments(bits)([b]):
            size = min(bits, segment) // 8
            s = out.column(0)[0].as_py()
            full[s * size : (s + 1) * size] = np.frombuffer(zlib.decompress(out.column(2)[0].as_py()), np.uint8)
        made.append(full)
    assert (made[0] == made[1]).all() and made[0].any()


def test_bpe(docs):
    got = by_id(bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken")))
    for i, t in enumerate(TEXTS):
        ids = struct.pack(f"<{len(ENCODING.encode_ordinary(t))}I", *ENCODING.encode_ordinary(t))
        assert bytes(got[i * 3]["ids"]) == ids and got[i * 3]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "a" * 5000, "  \n\n x y", "'ll 'LL 're", "กำ ẞ \U0001f600‍", "x" * 63 + "é" * 40, "\x00\x1c\x85  z", " in the text"])
def test_odd_texts(spark, tmp_path, text):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ids = ENCODING.encode_ordinary(text)
    row = bpe.encode_decode(d, P.path("byte_bpe_50k.tiktoken")).first()
    assert bytes(row["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
    path = str(tmp_path / "t")
    tokenfile.write_tokens(d, path, P.path("byte_bpe_50k.json"))
    assert tokenfile.read_ids(spark, path).first()["ids"] == [*ids, 2]


def test_token_files(spark, docs, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(docs, path, P.path("byte_bpe_50k.json"), shard_ids=3000)
    got, ids_of, start = by_id(tokenfile.read_documents(spark, path)), {r["doc_id"]: r["ids"] for r in tokenfile.read_ids(spark, path).collect()}, 0
    for i, t in enumerate(TEXTS):
        ids = [*ENCODING.encode_ordinary(t), 2]
        assert ids_of[i * 3] == ids
        assert (got[i * 3]["start"], got[i * 3]["n_tokens"], got[i * 3]["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_repair_round_trip():
    r = np.random.default_rng(0)
    for ids in (r.integers(0, 50, 20_000), np.zeros(999, int), np.tile([1, 2, 3], 4000), np.zeros(0, int), np.arange(5)):
        g = repair.from_bytes(repair.to_bytes(repair.compress(ids.astype(np.uint32), 1 << 20)))
        assert (g.expand(g.sequence) == ids).all()
        for a, b in ((0, 0), (0, len(ids)), (len(ids) // 3, len(ids) // 2)):
            assert (g.decode(a, b) == ids[a:b]).all()
    assert len(repair.compress(np.tile([1, 2, 3, 4], 4000), 1 << 20).sequence) < 2000
    with pytest.raises(ValueError):
        repair.from_bytes(repair.to_bytes(g)[:-1] + b"x")


def test_separators(spark, docs, tmp_path):
    r = random.Random(2)
    flat = [r.choice([0, 0, 0, 1, 2, 3]) for _ in range(5000)] + [4, 4]
    data = struct.pack(f"<{len(flat)}I", *flat)
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(struct.pack("<3I", 3, 3, 3))
    (tmp_path / "c.bin").write_bytes(b"")
    blocks = separators.blocks_of_files(spark, str(tmp_path / "*.bin"), block_ids=64)
    got = {(r["file"].rsplit("/", 1)[1], r["doc"]): (r["start"], r["n_tokens"], r["ended"]) for r in separators.count_tokens(blocks, 3).collect()}
    want, start = {}, 0
    for i, x in enumerate([*flat, 3]):
        if x == 3 and (i < len(flat) or i > start):
            want["a.bin", len(want)] = (start, i - start, i < len(flat))
            start = i + 1
    want |= {("b.bin", k): (k, 0, True) for k in range(3)}
    assert got == want
    path = str(tmp_path / "flat")
    separators.write_flat(docs, path, P.path("byte_bpe_50k.json"), 50256, block_ids=500)
    counts = by_id(separators.count_documents(spark, path, 50256))
    assert [counts[i * 3]["n_tokens"] for i in range(len(TEXTS))] == [len(ENCODING.encode_ordinary(t)) for t in TEXTS]


def test_phrases_do_not_depend_on_offset():
    r = random.Random(4)
    inner = "".join(r.choice("abcdefgh ") for _ in range(3000))
    names = []
    for lead in ("", "zz", "some other beginning, "):
        x = phrases._mix(np.array([ord(c) for c in lead + inner], np.uint64))
        first = np.zeros(1, np.int64)
        for _ in range(3):
            x, first = phrases.parse(x, first)
        names.append(set(x.tolist()))
    assert len(names[0] & names[1] & names[2]) > 0.8 * len(names[0])


def test_fingerprints(docs):
    got = by_id(phrases.fingerprint_documents(docs))
    order = sorted(got, reverse=True)
    for a, b in zip(order, [*order[1:], order[0]]):
        x, y = TEXTS[a // 3], TEXTS[b // 3]
        new = phrases.edited(x, y)
        assert got[a]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[a]["n_chars"] == len(x)
        own, edit, after = phrases.fingerprints([x, new, y])
        assert got[a]["fingerprint"] == phrases.as_text(own) and got[a]["edited_fingerprint"] == phrases.as_text(edit)
        assert got[a]["near_next"] == phrases.likeness(own, after) and got[a]["near_edited"] == phrases.likeness(own, edit)
    texts = {t: got[i * 3]["fingerprint"] for i, t in enumerate(TEXTS)}
    assert all(texts[t] == got[i * 3]["fingerprint"] for i, t in enumerate(TEXTS))
    long = [got[i * 3]["near_edited"] for i, t in enumerate(TEXTS) if len(t) > 1000]
    assert 0.15 < sum(long) / len(long) < 0.7


def test_mixing(docs):
    rows = mixing.mix(docs, slots=8).collect()
    assert sorted(r["taken"] for r in rows) == sorted(r["taken"] for r in mixing.mix(docs.repartition(3), slots=50).collect())
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"]
    weights = dict(zip(sorted(size), (5, 2, 1, 5, 2)))
    level = {s: target[s] / w for s, w in weights.items() if target[s] < 2 * size[s] - 1e-6}
    assert max(level.values()) - min(level.values()) < 1e-6 and abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(target[s] / w <= min(level.values()) + 1e-6 for s, w in weights.items())
    assert all(abs(taken[s] - target[s]) <= max(r["size"] for r in rows) for s in size)


def repeat_words(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text) if x]
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(g)
    return len({i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)})


def test_quality(spark):
    texts = [*TEXTS, "a b c a b c", "x " * 60, "# $ % " * 40, "line one\nline one\nline one\n" * 9, "a b", "", "a b c d e f g h a b c"]
    got = by_id(quality.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        r, w = got[i], [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
        full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(full) - len(set(full)), repeat_words(t))
        assert r["base_failed"] == (len(w) < 50 or 100 * repeat_words(t) > 50 * len(w))
    kept = quality.cascade(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("failed_rule IS NULL")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_jaccard_of_an_id_with_two_texts(spark):
    a, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "ac")
    rows = [(1, a), (1, c), (2, a + " end"), (3, c + " end"), (None, c), (None, "x y"), (None, "z"), (4, None), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in ngramjoin.jaccard_join(d).collect()]
    assert sorted(x for x in got if x[0]) == [(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (4, 4, 0), (4, 4, 0)]
    assert sorted(x[2] for x in got if x[0] is None) == [0, 0, 2] and len({x[1] for x in got if x[0] is None}) == 3
    left = [(r["doc_id"], r["text"]) for r in ngramjoin.first_of_each(d.unionByName(d)).collect()]
    assert sorted(left, key=str) == sorted([(1, a), (1, c), (None, "x y"), (None, "z"), *[(4, None)] * 4], key=str)


def test_common_grams_by_blocks(monkeypatch):
    r = np.random.default_rng(8)
    cells = np.unique(r.integers(0, 6 * 900, 2500))
    cols, rows = cells // 6, cells % 6
    a, b = np.triu_indices(6, 1)
    want = [len(set(cols[rows == x]) & set(cols[rows == y])) for x, y in zip(a, b)]
    for size in (64_000_000, 96):
        monkeypatch.setattr(ngramjoin, "BITS_BYTES", size)
        assert ngramjoin._common(rows, cols, 6, a, b).tolist() == want
