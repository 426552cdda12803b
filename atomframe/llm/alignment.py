"""Alignment of two tokenizers' tokens over the same bytes, and how often token ids are linked.

A text is cut by tokenizer A (byte-level BPE) and by tokenizer B (pieces with byte
fallback). Tokens of both are nodes of one graph, edges join tokens that overlap. Every
token points to the token that overlaps it and ends farthest right, or to itself where a
token of the other side ends with it; its successor's successor replaces its pointer until
nothing changes (pointer jumping: the distance doubles each time). The terminal token
labels the group, and the last tokens of a group, which end together, are linked.

Neither tokenizer ever joins what stands before a single space to what stands after it, so
a text is a row of chunks, each a space and what follows up to the next such space. A
worker aligns a distinct chunk once and keeps it while a cache has room.

Texts are read once. A slice of some megabytes of text leaves a row per document, with its
distinct linked pairs as numbers in the slice's own list of pairs, and one row with that
list and its totals. Corpus-wide counts come from the lists alone, and each slice gets back
the counts of the pairs it holds, so nothing is broadcast and no document is shuffled by
pair.

Defined results: a text that is null or empty, or that either tokenizer does not give back
byte for byte, has no tokens: zeros and an empty digest; repeated rows count each; a null
id is kept; an empty table gives no rows; further columns of the input are ignored whatever
their names. Tokens without bytes do not occur in these kinds of vocabularies.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scaling import cut_lineage
from .common import byte_slices, give_back, table

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_BYTES = 8 << 20
#: Distinct chunks a worker keeps; chunks of more characters than LONG are not kept.
CACHE_CHUNKS, LONG = 150_000, 64
#: Chunks of more characters are left to the library that the vocabulary of A comes from.
HUGE = 10_000
#: Fixed value: the pattern that byte-level BPE of this kind cuts words by.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "▁"
_CUT = re.compile(r"(?<! ) (?=\S)")
#: A space that does not stand alone between two words.
_ODD = re.compile(r"\A | (?=\s|\Z)")
ENCODED = (
    "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "refs array<int>, times array<int>, pairs array<long>, totals array<long>"
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where visible, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def groups(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B, in order, the number of its group. Both sides cover the same bytes."""
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    n = len(a_end)
    to_b = np.searchsorted(b_end, a_end)
    to_a = np.searchsorted(a_end, b_end)
    ends_too = a_end[np.minimum(to_a, max(n - 1, 0))] == b_end if n else np.zeros(0, bool)
    after = np.concatenate([n + to_b, np.where(ends_too, n + np.arange(len(b_end)), to_a)])
    while True:
        jumped = after[after]
        if (jumped == after).all():
            break
        after = jumped
    _, label = np.unique(after, return_inverse=True)
    return label[:n], label[n:]


class Aligner:
    """Both tokenizers, and the alignments of chunks seen before."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as file:
            kept = json.load(file)
        letters = byte_letters()
        special = {t["content"] for t in kept.get("added_tokens", [])}
        vocabulary = {token: i for token, i in kept["model"]["vocab"].items() if token not in special}
        spelled = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
        self.bytes_a = [b""] * (max(kept["model"]["vocab"].values()) + 1)
        for token, i in spelled.items():
            self.bytes_a[i] = token
        self.library = Tokenizer.from_file(path_a)
        self.library.encode_special_tokens = True
        # Where ids ascend with the order of merges, ranks give the same tokens and are faster to apply.
        joined = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in kept["model"]["merges"]]
        ranked = all(x < y for x, y in zip(joined, joined[1:])) and min(joined, default=0) >= 0
        self.fast = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=spelled, special_tokens={}) if ranked else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece_bytes(i) for i in range(self.pieces.get_piece_size())]
        self.cache: dict[str, tuple[int, int, int, bytes, bytes]] = {}

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(BLANK, " ").encode()

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None or any(len(t) > HUGE for t in texts):
            if len(texts) > 1 and self.fast is not None:
                return [self.encode_a([t])[0] for t in texts]
            return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return [self.fast.encode_ordinary(t) for t in texts]

    def align(self, chunks: list[str]) -> list[tuple[int, int, int, bytes, bytes]]:
        """Of each chunk (its leading space left out): tokens of A and B, groups, the groups as text, linked pairs.

        A chunk that does not come back byte for byte has -1 groups.
        """
        a, b = self.encode_a([f" {c}" for c in chunks]), self.pieces.encode(chunks, num_threads=1)
        whole = [f" {c}".encode() for c in chunks]
        good = [
            b"".join([self.bytes_a[t] for t in x]) == w and b"".join([self.bytes_b[t] for t in y]) == w
            for x, y, w in zip(a, b, whole)
        ]
        out = [(0, 0, -1, b"", b"")] * len(chunks)
        at = [i for i, g in enumerate(good) if g]
        flat_a, flat_b = [t for i in at for t in a[i]], [t for i in at for t in b[i]]
        size_a = np.fromiter((len(self.bytes_a[t]) for t in flat_a), np.int64, len(flat_a))
        size_b = np.fromiter((len(self.bytes_b[t]) for t in flat_b), np.int64, len(flat_b))
        label_a, label_b = groups(size_a, size_b)
        n = int(label_b[-1]) + 1 if len(label_b) else 0
        cut_a, cut_b = (np.searchsorted(label, np.arange(n + 1)) for label in (label_a, label_b))
        last_a, last_b = np.array(flat_a, dtype=np.int64)[cut_a[1:] - 1], np.array(flat_b, dtype=np.int64)[cut_b[1:] - 1]
        pairs = (last_a << 32 | last_b).astype("<i8")
        text_a, text_b = list(map(str, flat_a)), list(map(str, flat_b))
        lo_a, lo_b = cut_a.tolist(), cut_b.tolist()
        said = [f"{','.join(text_a[lo_a[g] : lo_a[g + 1]])}|{','.join(text_b[lo_b[g] : lo_b[g + 1]])}" for g in range(n)]
        # A chunk's last tokens end together, so groups do not cross chunks.
        first, done_b = 0, 0
        for i in at:
            done_b += len(b[i])
            end = int(label_b[done_b - 1]) + 1 if done_b else 0
            out[i] = (len(a[i]), len(b[i]), end - first, ";".join(said[first:end]).encode(), pairs[first:end].tobytes())
            first = end
        return out

    def look_up(self, chunks: list[str]) -> list[tuple[int, int, int, bytes, bytes]]:
        found = list(map(self.cache.get, chunks))
        new = [c for c, f in zip(chunks, found) if f is None]
        made: dict[str, tuple[int, int, int, bytes, bytes]] = {}
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            made.update(zip(part, self.align(part)))
        # Chunks seen first are mostly the frequent ones, so a full cache keeps them.
        if len(self.cache) < CACHE_CHUNKS:
            self.cache.update((c, f) for c, f in made.items() if len(c) <= LONG)
        return [made[c] if f is None else f for c, f in zip(chunks, found)]


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The chunks of texts: number of each one's string, chunks up to each text's end, the distinct strings."""
    odd = [t == "" or _ODD.search(t) is not None for t in texts]
    plain = pc.split_pattern(pa.array([None if o else t for t, o in zip(texts, odd)], pa.large_string()), " ")
    if any(odd):
        lists = plain.to_pylist()
        for i, o in enumerate(odd):
            if o:
                parts = _CUT.split(f" {texts[i]}") if texts[i] else []
                lists[i] = parts[1:] if parts and parts[0] == "" else [p[1:] if not k else p for k, p in enumerate(parts)]
        plain = pa.array(lists, pa.large_list(pa.large_string()))
    coded = plain.flatten().dictionary_encode()
    ends = np.cumsum(pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, coded.dictionary.to_pylist()


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts of ``values`` that stop at ``ends``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[ends], prepend=0)


def _slice(tool: Aligner, ids: pa.Array, texts: list[str | None], slice_id: int) -> pa.RecordBatch:
    """A row per document of a slice, and one with the slice's pairs."""
    number, ends, distinct = _chunks([t if t and BLANK not in t else "" for t in texts])
    facts = tool.look_up(distinct)
    n_a, n_b, n_groups = (np.fromiter((f[i] for f in facts), np.int64, len(facts)) for i in range(3))
    lost = _sums((n_groups < 0)[number].astype(np.int64), ends) > 0
    whole = ~np.repeat(lost, np.diff(ends, prepend=0))
    n_groups = np.maximum(n_groups, 0)
    counts = [np.where(lost, 0, _sums(x[number], ends)) for x in (n_a, n_b, n_groups)]
    said, order = [f[3] for f in facts], number.tolist()
    digests, lo = [], 0
    for hi, bad in zip(ends.tolist(), lost.tolist()):
        digests.append("" if bad or hi == lo else hashlib.sha256(b";".join([said[k] for k in order[lo:hi]])).hexdigest())
        lo = hi
    # Pairs of the distinct chunks as numbers in the slice's list, then those of every occurrence.
    pairs, code = np.unique(np.frombuffer(b"".join([f[4] for f in facts]), "<i8"), return_inverse=True)
    first = np.cumsum(n_groups) - n_groups
    used = number[whole]
    sizes = n_groups[used]
    upto = np.cumsum(sizes)
    at = np.repeat(first[used] - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)
    owner = np.repeat(np.arange(len(texts)), counts[2])
    keys, times = np.unique(owner * max(len(pairs), 1) + code[at], return_counts=True)
    doc, ref = np.divmod(keys, max(len(pairs), 1))
    totals = np.bincount(ref, times, minlength=len(pairs)).astype(np.int64)
    cut = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
    n = len(texts)
    null = pa.array([None], pa.int64())
    join = lambda rows, kind: pa.concat_arrays([rows.cast(kind), pa.array([None], kind)])
    longs = [join(pa.array(c), pa.int64()) for c in (*counts, counts[2])]
    ints = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (ref, times)]
    own = [pa.array([None] * n + [x], pa.list_(pa.int64())) for x in (pairs, totals)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, slice_id, dtype=np.int64)), pa.concat_arrays([ids.cast(pa.int64()), null]), *longs,
            join(pa.array(digests, pa.string()), pa.string()), *[join(x, pa.list_(pa.int32())) for x in ints], *own,
        ],
        names=["slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "refs", "times", "pairs", "totals"],
    )


def _encode(path_a: str, path_b: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, at = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1), SLICE_BYTES):
                yield _slice(tool, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).to_pylist(), at)
                at += 1
            give_back()

    return work


def _finish(docs: pa.Table, facts: pa.Table) -> pa.Table:
    """The documents of a slice with the sums over their links."""
    ref = facts.column("ref").to_numpy()
    count, best = np.zeros(len(ref), np.int64), np.zeros(len(ref), np.int64)
    count[ref], best[ref] = facts.column("count").to_numpy(), facts.column("best").to_numpy().astype(np.int64)
    refs, times = docs.column("refs").combine_chunks(), docs.column("times").combine_chunks()
    ends = np.cumsum(pc.list_value_length(refs).to_numpy(zero_copy_only=False).astype(np.int64))
    each, n = refs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sums = [_sums(x[each] * n, ends) if len(each) else np.zeros(len(ends), np.int64) for x in (best, count)]
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    kept = kept.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))
    return kept.append_column("groups_sha256", docs.column("groups_sha256"))


def link_counts(encoded: DataFrame) -> DataFrame:
    """(pair, count, best): how often an id pair is linked in the corpus, and whether no pair of its B id is linked more often.

    A pair holds A's id above the lowest 32 bits and B's id in them.
    """
    held = encoded.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "totals")).alias("x"))
    counts = cut_lineage(held.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.totals").alias("count")))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("most"))
    joined = counts.withColumn("b_id", b_id).join(most, "b_id")
    return cut_lineage(joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Token, group and link counts of every row of (doc_id, text); the paths must be readable on every executor."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    encoded = cut_lineage(rows.mapInArrow(_encode(path_a, path_b), ENCODED))
    counts = link_counts(encoded)
    held = encoded.filter("pairs IS NOT NULL").select(F.col("slice").alias("slice_of"), F.posexplode("pairs").alias("ref", "pair"))
    facts = held.join(counts, "pair").select("slice_of", "ref", "count", "best")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = encoded.filter("pairs IS NULL").drop("pairs", "totals").repartition(n, "slice").groupBy("slice")
    right = facts.repartition(n, "slice_of").groupBy("slice_of")
    return left.cogroup(right).applyInArrow(_finish, ALIGNED)


def op11_pointer_jumping(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(v) for v in (VOCABULARY_A, VOCABULARY_B)]
    return align(table(spark, sf_dir, "documents"), *paths)
