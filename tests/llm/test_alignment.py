"""Cross-tokenizer alignment against whole-text encoding with the libraries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from atomframe.llm import alignment

tokenizers = pytest.importorskip("public_tokenizers")
PATHS = [tokenizers.path(v) for v in (alignment.VOCABULARY_A, alignment.VOCABULARY_B)]
PARTS = [
    "a", "b", "the", "ing", " ", "  ", " ", "\n", "\t", ".", ",", "'s", "é", "ß", "▁", "世", "界", " ", "😀", "é", "1", "23",
    "<|endoftext|>", "<s>", "<0x41>", "-", "\x1c", " ", "ﬁ", "Ⅳ", "\r\n", "\x00",
]


def plain(texts):
    """Rows as the operator's, from whole texts and one token after the other."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tool, letters = Tokenizer.from_file(PATHS[0]), alignment.byte_letters()
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    rows, counts = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a, b = a_tool.encode(f" {text}", add_special_tokens=False).ids, b_tool.encode(text)
        a_bytes = [bytes(letters[c] for c in a_tool.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_tool.id_to_piece(i)[3:5], 16)]) if b_tool.is_byte(i) else b_tool.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            rows.append(None)
            continue
        a_end, b_end = (np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes))
        said, links, i, j = [], [], 0, 0
        for cut in sorted(set(a_end) & set(b_end)):
            i2, j2 = a_end.index(cut, i) + 1, b_end.index(cut, j) + 1
            said.append(f"{','.join(map(str, a[i:i2]))}|{','.join(map(str, b[j:j2]))}")
            links.append((a[i2 - 1], b[j2 - 1]))
            i, j = i2, j2
        counts.update(links)
        rows.append((len(a), len(b), len(said), links, hashlib.sha256(";".join(said).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, b_id), n in counts.items():
        most[b_id] = max(most[b_id], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if r is None
        else (r[0], r[1], r[2], len(r[3]), sum(counts[x] == most[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4])
        for r in rows
    ]


@pytest.mark.parametrize("slice_bytes", [8 << 20, 2000])
def test_alignment_of_random_texts(spark, sf_dir, monkeypatch, slice_bytes):
    monkeypatch.setattr(alignment, "SLICE_BYTES", slice_bytes)
    rng = random.Random(slice_bytes)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    texts += [None, "", " ", "   ", "\n", "a ", " a", "x" * 30000, " " * 5000, f"a{' ' * 3000}b", texts[0], texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS slice", "'x' AS pair", "2 AS refs")
    got = {r[0]: tuple(r)[1:] for r in alignment.align(docs, *PATHS).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)


def test_alignment_of_nothing_and_odd_rows(spark, odd_docs, no_docs):
    assert alignment.align(no_docs, *PATHS).collect() == []
    rows = alignment.align(odd_docs, *PATHS).collect()
    assert len(rows) == odd_docs.count() and sum(r["doc_id"] is None for r in rows) == 1
    twins = {r["doc_id"]: tuple(r)[1:] for r in rows}
    assert twins[1] == twins[2] and twins[3] == twins[4] == (0, 0, 0, 0, 0, 0, "")


def test_groups_by_pointer_jumping():
    """Against a scan for shared ends, on random cuts of the same length."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        total = int(rng.integers(1, 60))
        sides = [np.append(np.sort(rng.choice(np.arange(1, total), rng.integers(0, total), replace=False)), total) for _ in range(2)] if total > 1 else [np.array([1])] * 2
        shared = np.intersect1d(*sides)
        got = alignment.groups(*[np.diff(s, prepend=0) for s in sides])
        assert all((g == np.searchsorted(shared, s)).all() for g, s in zip(got, sides))
