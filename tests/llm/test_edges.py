"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from clipframe.llm import bpe, linededup, mixing, ngramjoin, phrases, quality, separators, suffixes, tokenfile, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(20_000))
ROWS = [
    (1, "one line\nanother line that is long\n\none line", "en", "a", 10),
    (2, "another line that is long\nANOTHER LINE THAT IS LONG  \nx", "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, LONG, "en", None, 10),
    (5, LONG, "en", None, 10),
    (None, "a text without an id " * 40, "fr", "b", 5),
    (None, None, None, "b", None),
    (7, "tie tie tie tie tie", "en", "b", 5),
    (8, "tie tie tie tie tie", "en", "b", 5),
    (9, "naïve 世界 \U0001f600  x́ ''s 12 ½\r\n\t end", "en", "c", 5),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS)


def written(spark, tmp_path, docs):
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(docs, path, P.path("byte_bpe_50k.json"), shard_ids=5000)
    return tokenfile.read_documents(spark, path)


def flat(spark, tmp_path, docs):
    path = str(tmp_path / "flat")
    separators.write_flat(docs, path, P.path("byte_bpe_50k.json"), 50256, block_ids=1000)
    return separators.count_documents(spark, path, 50256)


OPERATORS = {
    "quality": lambda s, t, d: quality.measured(d),
    "cascade": lambda s, t, d: quality.cascade(d),
    "tokens": written,
    "lines": lambda s, t, d: linededup.dedup_lines(d),
    "counts": flat,
    "phrases": lambda s, t, d: phrases.fingerprint_documents(d),
    "mixing": lambda s, t, d: mixing.mix(d),
    "suffixes": lambda s, t, d: suffixes.dedup_substrings(d),
    "ngrams": lambda s, t, d: ngramjoin.jaccard_join(d),
    "bpe": lambda s, t, d: bpe.encode_decode(d, P.path("byte_bpe_50k.tiktoken")),
}
CLASHES = ["slot", "size", "key", "keys", "hashes", "pieces", "rest", "doc", "mark", "words", "kept_text", "target", "epochs", "failed_rule", "kept", "n_words", "part", "end", "runs", "v", "comp", "band", "weight", "level", "out"]


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay_whole(spark, tmp_path, name):
    out = OPERATORS[name](spark, tmp_path, docs(spark)).collect()
    assert len(out) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, tmp_path, name):
    out = OPERATORS[name](spark, tmp_path, docs(spark, []))
    assert out.count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, tmp_path, name):
    d = docs(spark).withColumns({c: F.lit("x") for c in CLASHES})
    out = OPERATORS[name](spark, tmp_path, d)
    out.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ROWS)


def test_defined_results(spark):
    by = {r["doc_id"]: r for r in linededup.dedup_lines(docs(spark)).collect()}
    assert (by[1]["n_lines"], by[1]["n_dropped"]) == (4, 0)
    assert by[2]["kept_text"] == "x" and by[2]["n_dropped"] == 2
    assert by[3]["kept_text"] == "" and by[3]["n_lines"] == 1
    by = {r["doc_id"]: r for r in ngramjoin.jaccard_join(docs(spark)).collect()}
    assert by[8]["class_id"] == 7 and by[8]["n_links"] == 1 and by[4]["n_links"] == 0 and by[5]["n_links"] == 1
    by = {r["doc_id"]: r for r in mixing.mix(docs(spark)).collect()}
    assert by[3]["size"] == 0 and by[3]["taken"] == 0
    by = {r["doc_id"]: r for r in suffixes.dedup_substrings(docs(spark)).collect()}
    assert by[5]["n_removed"] == by[5]["n_bytes"] and by[1]["n_removed"] == 0


PAGES = [(1, "u", "x" * 2000), (2, "u", "x" * 2000), (2, "v", "x" * 2000), (3, None, None), (None, "u", "short"), (5, "a\r\nX: b\0", "short"), (6, "u", "é" * 500)]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("content", F.lit(2))
    path = warc.write_archive(pages, str(tmp_path / "archive"))
    out = warc.read_archive(spark, path)
    rows = out.collect()
    assert len(rows) == len(PAGES)
    large = [r for r in rows if r["payload_bytes"] == 2000]
    assert sorted(r["record_type"] for r in large) == ["response", "revisit", "revisit"]
    assert {r["refers_to"] for r in large if r["record_type"] == "revisit"} == {2}
    assert all(r["record_type"] == "response" for r in rows if r["payload_bytes"] < 1000)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    raw = [bytes(r["record"]) for r in warc.warc_bytes(out).collect()]
    assert all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in raw)
    assert sum(b"Content-Length: 0\r\n\r\n\r\n\r\n" in x for x in raw) == 3
    none = warc.write_archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archive(spark, none).count() == 0


def test_damaged_payload_is_noticed(spark, tmp_path):
    path = warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), str(tmp_path / "archive"))
    spark.createDataFrame([("0" * 64, b"other")], "content string, payload binary").write.mode("append").parquet(f"{path}/payloads")
    headers = spark.read.parquet(f"{path}/headers").limit(1).withColumn("content", F.lit("0" * 64))
    headers.write.mode("append").parquet(f"{path}/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, path).collect()


def test_mixing_takes_some_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_SLOT", 16)
    rows = [(None, "a b c", "en", "s", 5)] * 50 + [(7, "a b c", "en", "s", 5)] * 4 + [(8, None, "en", "s", 0)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r["size"] for r in got) == 162
    assert {r["target"] for r in got} == {243.0} and abs(sum(r["taken"] for r in got) - 243) <= 1.5
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_cascade_names_the_same_rule_again(spark):
    d = docs(spark).repartition(3)
    orders = {tuple(r.name for r in quality.ordered(d, quality.base_rules() + quality.further_rules())) for _ in range(3)}
    assert len(orders) == 1


def test_warc_files_are_read_by_the_format(spark, tmp_path):
    """A plain reader of the format: header lines up to an empty one, Content-Length bytes, two line ends."""
    import gzip

    path = warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), str(tmp_path / "archive"))
    warc.write_files(warc.read_archive(spark, path), str(tmp_path / "files"))
    found = []
    for f in sorted((tmp_path / "files").glob("part-*.gz")):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            found.append((fields, rest[:n]))
            data = rest[n + 4 :]
    ids = {f["WARC-Record-ID"] for f, _ in found}
    assert len(found) == len(ids) == len(PAGES)
    revisits = [f for f, _ in found if f["WARC-Type"] == "revisit"]
    assert len(revisits) == 2 and {f["WARC-Refers-To"] for f in revisits} < ids
    of = {f["WARC-Record-ID"]: b for f, b in found}
    assert all(len(of[f["WARC-Refers-To"]]) == int(f["X-Payload-Length"]) for f in revisits)
    assert sorted(b for f, b in found if f["WARC-Type"] == "response") == sorted([b"x" * 2000, b"", b"short", b"short", "é".encode() * 500])
    assert {f["WARC-Target-URI"] for f, _ in found} == {"u", "v", "", "a%0D%0AX: b%00"}
