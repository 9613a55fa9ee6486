"""Token ids of texts on which the numpy splitter or the table of pieces could go wrong."""

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex

from clipframe.llm import pieces, separators, tokenfile

TOKENIZER = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("text", ["x'uťa", "x'qťa", "x'kŬa", "x're x've x'll"])
def test_contractions_are_told_by_both_letters(text):
    found, counts, odd = pieces.split(pa.array([text, "we'll", text]))
    one = regex.findall(pieces.PATTERN, text)
    assert found.to_pylist() == [*one, "we", "'ll", *one] and counts.tolist() == [len(one), 2, len(one)] and not odd.any()
    ids, lens = tokenfile.encoded(pa.array([text]), TOKENIZER)
    assert ids.tolist() == tokenfile.text_encoder(TOKENIZER)(text).tolist() and lens.tolist() == [len(ids)]


SPECIAL = ["a plain text", "a <|endoftext|> b<|endoftext|>", None, "<|endoftext|>", "<|endoftext| >", "กำ <|endoftext|>", "after"]


def test_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in SPECIAL]
    assert sum(ids.count(50256) for ids in want) == 4
    d = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    path = str(tmp_path / "t")
    tokenfile.write_tokens(d, path, TOKENIZER)
    assert {r["doc_id"]: r["ids"] for r in tokenfile.read_ids(spark, path).collect()} == dict(enumerate(want))
    found = sorted(tokenfile.read_documents(spark, path).collect())
    assert [(r["start"], r["n_tokens"]) for r in found] == [(sum(map(len, want[:i])), len(w)) for i, w in enumerate(want)]
    separators.write_flat(d, str(tmp_path / "flat"), TOKENIZER, 50256)
    counts = {r["doc_id"]: r["n_tokens"] for r in separators.count_documents(spark, str(tmp_path / "flat"), 50256).collect()}
    library.encode_special_tokens = True
    assert counts == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(SPECIAL)}


def test_pieces_are_told_by_all_their_bytes():
    long = ["x" * n + end for n in (6, 7, 8, 13, 14, 15, 16, 40) for end in ("", "a", "b", "é", "\0", "\0\0")]
    own = ["", *("a" + "\0" * n for n in range(20)), *long, *(f"{i}" for i in range(50_000)), *map(chr, range(1, 0x250))]
    own = [p for p in dict.fromkeys(own) if p]
    number = {p: i for i, p in enumerate(own)}
    table = pieces.PieceTable(lambda new: (np.array([number[p] for p in new], np.uint32), np.ones(len(new), np.int64)))
    for part in (own[::3], own, own[::-1], own):
        ids, lens = table.ids(pa.array(["left out", *part])[1:], np.array([len(part)]))
        assert ids.tolist() == [number[p] for p in part] and lens.tolist() == [len(part)]
    assert table.known == len(own)


def test_library_model_spells_every_piece():
    texts = ["".join(map(chr, range(0x250))), "中文字符" * 5 + " €–", "a" * 500 + " " * 40, "é\ue000ü \U0001f600 ก"]
    ids, lens = tokenfile.encoded(pa.array(texts), TOKENIZER)
    want = [tokenfile.text_encoder(TOKENIZER)(t).tolist() for t in texts]
    assert ids.tolist() == sum(want, []) and lens.tolist() == list(map(len, want))


def test_a_million_words_are_encoded_once():
    times = []
    table = pieces.PieceTable(lambda new: times.append(len(new)) or (np.zeros(4 * len(new), np.uint32), np.full(len(new), 4)))
    for _ in range(2):
        for i in range(0, 1_000_000, 100_000):
            table.ids(pa.array([f" {n:07d}" for n in range(i, i + 100_000)]), np.array([100_000]))
    assert sum(times) == 1_000_000
