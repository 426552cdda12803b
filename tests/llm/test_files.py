"""WARC archives and token files: exact round trips."""

import random
import gzip
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from atomframe.llm import token_files, warc

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "same"), (1, "http://b/ x", "same"), (2, None, None), (5, "u", ""), (9, "u", "WARC/1.1\r\n\r\nnot a record\r\n\r\n"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS d")
    warc.write_archives(pages, f"{tmp_path}/whole")
    index = warc.normalise(spark, f"{tmp_path}/whole", f"{tmp_path}/members")
    found = {(r["record_id"], r["record_type"], r["refers_to"], bytes(r["payload"]).decode(), r["payload_length"]) for r in warc.read_records(index).collect()}
    assert found == {
        ("<urn:page:1>", "response", None, "same", 4), ("<urn:page:3>", "revisit", "<urn:page:1>", "", 4),
        ("<urn:page:2>", "response", None, "", 0), ("<urn:page:5>", "revisit", "<urn:page:2>", "", 0),
        ("<urn:page:9>", "response", None, "WARC/1.1\r\n\r\nnot a record\r\n\r\n", 28), ("<urn:page:null>", "response", None, "same", 4),
    }
    for r in index.collect():
        with open(r["archive"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            assert zlib.decompress(f.read(r["length"]), 31).startswith(b"WARC/1.1")


def test_damaged_archive(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "cut.gz").write_bytes(gzip.compress(record + record)[:-9])
    (tmp_path / "in" / "good.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    rows = warc.normalise(spark, f"{tmp_path}/in", f"{tmp_path}/out", on_error="report").collect()
    assert sum(r["error"] is not None for r in rows) == 1
    assert sum(r["error"] is None and "good" in r["archive"] for r in rows) == 2
    with pytest.raises(Exception, match="trailer"):
        warc.normalise(spark, f"{tmp_path}/in", f"{tmp_path}/out2")


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/whole")
    index = warc.normalise(spark, f"{tmp_path}/whole", f"{tmp_path}/members")
    assert warc.read_records(index).count() == 0


TRICKY = [
    (-1, "a... b. \"c\". d), e.. f ,. g.,h ., i.\nj. . k..."), (-2, "x|y | z |. q|, | |"), (-3, "Á ́x <|endoftext|> a<|endoftext|>b\x0b\x1cq İSTANBUL ΟΔΟΣ "),
    (-4, "it's don't we'll\tI'm 123 4,5"), (-5, "日本語 ÀÉ, ü."),
]


def test_token_files(spark, odd_docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.VOCABULARY)
    # One text long enough that a dictionary pays.
    rows = [*TRICKY, (99, " ".join(f"word number {i % 97}" for i in range(3000)))]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    token_files.write_token_files(docs, f"{tmp_path}/t", path, 1 << 10)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], list(r["ids"])) for r in token_files.read_tokens(spark, f"{tmp_path}/t").collect()}
    tool, start = Tokenizer.from_file(path), 0
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = [*tool.encode(r["text"] or "", add_special_tokens=False).ids, token_files.END_ID]
        assert got[r["doc_id"]] == (start, len(ids), ids)
        start += len(ids)
    part = max((tmp_path / "t").glob("part*"), key=lambda f: f.stat().st_size)
    column = lambda i: pq.ParquetFile(part).metadata.row_group(0).column(i)
    assert "DELTA_BINARY_PACKED" in column(0).encodings and "RLE_DICTIONARY" in column(3).encodings
    assert column(0).has_offset_index and column(3).has_offset_index


def test_whole_texts_where_space_counts():
    tool = token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not tool.word_wise
    ids, sizes = tool.encode(["a  b", ""], 2)
    assert ids.tolist() == [*tool.tokenizer.encode("a  b").ids, 2, 2] and sizes.sum() == len(ids)
    assert np.array(sizes).tolist()[1] == 1


def test_ids_of_random_texts():
    """Stops, spaces, marks and odd letters in any order, against whole texts in the library."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.VOCABULARY)
    tool, library, rng = token_files.WordEncoder(path), Tokenizer.from_file(path), random.Random(7)
    parts = [
        "a", "ab", "word", ".", ",", "..", ",,", ",.", ". ", ", ", " ", "  ", "\n", "\t", "!", "?", "'s", "é", "é", "ß", "İ", "क़", "ᾳ",
        "世界", "1", "23", "-", "<|endoftext|>", "<|", "|", " ", "Ab", "ÉTÉ", "ŉ", "ſ", "😀", "\x7f", "²", "…",
    ]
    texts = ["a .. b", "..", "x ,,", ". .", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(20000))]
    ids, sizes = tool.encode(texts, 2)
    wanted = [[*e.ids, 2] for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == wanted


def test_token_files_of_nothing_and_clashing_columns(spark, odd_docs, no_docs, tmp_path):
    path = public_tokenizers.path(token_files.VOCABULARY)
    token_files.write_token_files(no_docs, f"{tmp_path}/none", path)
    assert token_files.read_tokens(spark, f"{tmp_path}/none").collect() == []
    clash = odd_docs.selectExpr("*", "1 AS ids", "'x' AS n_tokens", "2 AS start_in_file", "3 AS file")
    token_files.write_token_files(clash, f"{tmp_path}/some", path)
    back = token_files.read_tokens(spark, f"{tmp_path}/some")
    assert back.count() == odd_docs.count() and back.filter("doc_id IS NULL").count() == 1
