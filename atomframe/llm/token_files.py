"""Token ids in Parquet files that can be read in part.

A file holds documents in ascending order of id, one row each: the id, the number
of tokens, where its tokens start in the file, and the ids as a list column. Ids of
one vocabulary repeat, so the list is dictionary encoded; the ascending integers
are delta encoded (format version 2, dictionary off for these columns). Row groups
and pages have set sizes and the writer adds page indexes, so a reader that asks for a
few documents, or for lengths alone, skips the other pages and columns.

Where a document starts in the whole corpus is its start in the file plus the sizes
of the files before it: a manifest of one row per file, computed from the length
column alone. So the ids are written once, in the same pass that makes them.

The library encodes each distinct word once per worker while a cache has room: this
kind of vocabulary drops white space and capitals and sets stops apart, so a text's
ids are those of its words (``word_wise`` asks the tokenizer, and whole texts are
encoded otherwise).

Defined results: a null or empty text has the end id only; documents of the same id
follow each other ordered by their text; null ids come first; an empty table gives
no rows; further columns of the input are ignored whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scaling import checkpoint_dir, cut_lineage
from .alignment import byte_letters
from .common import byte_slices, give_back, table

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Bytes of text for one file, and of those for one call of the encoder.
FILE_BYTES = 32 << 20
SLICE_BYTES = 4 << 20
#: Distinct words whose ids a worker keeps; longer words than LONG are not kept.
CACHE_WORDS = 200_000
LONG = 64
#: Words encoded in one call, and what ends each of them there.
TOGETHER = 2000
WORD_END = "\x7f"
STOP = "\n"
ENDINGS = (".", ",")
#: Characters whose lower case does not depend on their neighbours and that need no composing.
_STOPS = re.compile("[.,][.,]")
_SIMPLE = re.compile(r"[\x00-\u017F]*")
FILE_SCHEMA = "doc_id long, n_tokens int, start_in_file long, ids array<int>"
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts as little-endian bytes, word by word where the tokenizer allows it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.ranked, self.last = self._ranked(path)
        self.word_wise = self._is_word_wise()

    def _ranked(self, path: str):
        """For words of letters only, the same merges as ranks of byte strings, and which ids end a word.

        A word's end is one more byte that letters never hold. Where ids do not ascend with the
        order of merges, ranks would merge in another order: None.
        """
        import tiktoken

        with open(path, encoding="utf-8") as file:
            kept = json.load(file)
        model, letters = kept["model"], byte_letters()
        suffix, special = model.get("end_of_word_suffix") or "", {t["content"] for t in kept.get("added_tokens", [])}
        vocabulary = {token: i for token, i in model["vocab"].items() if token not in special}
        joined = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        if not suffix or any(x >= y for x, y in zip([-1, *joined], joined)):
            return None, None
        last = np.zeros(max(model["vocab"].values()) + 1, bool)
        ranks = {}
        for token, i in vocabulary.items():
            last[i] = token.endswith(suffix)
            ranks[bytes(letters[c] for c in token.removesuffix(suffix)) + WORD_END.encode() * bool(last[i])] = i
        return tiktoken.Encoding("words", pat_str=f"[^{WORD_END}]+{WORD_END}", mergeable_ranks=ranks, special_tokens={}), last

    def _is_word_wise(self) -> bool:
        """Whether white space and a final stop only end a word, capitals do not count, and the ranks agree."""
        whole = self._ids(["Ab  c,\n\td."])[0]
        parts = self._ids(["ab", "c", ",", "d", "."])
        words = ["a", "stra\u00dfe", "\u00e9t\u00e9", "understanding", "xqzvw"]
        return whole == b"".join(parts) and (self.ranked is None or self._words(words) == self._ids(words))

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words made of letters only, many in one call."""
        if self.ranked is None:
            return self._ids(words)
        out: list[bytes] = []
        for lo in range(0, len(words), TOGETHER):
            flat = np.array(self.ranked.encode_ordinary(WORD_END.join([*words[lo : lo + TOGETHER], ""])), dtype="<u4")
            cuts = ((np.flatnonzero(self.last[flat]) + 1) * 4).tolist()
            ids = flat.tobytes()
            out += [ids[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from the cache as far as it has them."""
        found = list(map(self.cache.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        simple = [w.isalpha() and (w.isascii() or _SIMPLE.fullmatch(w) is not None) and w.islower() for w in new]
        plain = [w for w, s in zip(new, simple) if s]
        other = [w for w, s in zip(new, simple) if not s]
        known = dict(zip(plain, self._words(plain))) | dict(zip(other, self._ids(other)))
        # Words seen first are mostly the frequent ones, so a full cache keeps them.
        if len(self.cache) < CACHE_WORDS:
            self.cache.update((w, ids) for w, ids in known.items() if len(w) <= LONG)
        return [known[w] if ids is None else ids for w, ids in zip(words, found)]

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Words of texts, each text ended by STOP: number of the word, words up to each text's end, the distinct words."""
        words = pc.split_pattern(pa.array([f"{t} {STOP}" for t in texts], pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        return coded.indices.to_numpy(), words.offsets.to_numpy()[1:], coded.dictionary.to_pylist()

    def _gather(self, cut: tuple[np.ndarray, np.ndarray, list[str]], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cut texts, ``end_id`` for each STOP, and the number of ids of each text."""
        number, ends, words = cut
        ids = self._look_up([w for w in words if w != STOP])
        if STOP in words:
            ids.insert(words.index(STOP), np.array([end_id], dtype="<u4").tobytes())
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        first = np.cumsum(size) - size
        n = size[number]
        upto = np.cumsum(n)
        at = np.repeat(first[number] - (upto - n), n)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(ids), dtype="<u4")[at], np.diff(upto[ends - 1], prepend=0)

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, ``end_id`` after each, and the number of ids of each text."""
        if not self.word_wise:
            parts = [np.append(np.frombuffer(self._ids([t])[0], "<u4"), end_id) for t in texts]
            return np.concatenate([np.empty(0, "<u4"), *parts]).astype("<u4"), np.array([len(p) for p in parts], dtype=np.int64)
        plain = []
        for t in texts:
            for space in "\n\t\r":
                t = t.replace(space, " ")
            plain.append(t.lower() if (t.isascii() or _SIMPLE.fullmatch(t)) and "<|" not in t else t)
        # Stops become words of their own ...
        cut = self._cut([t if _STOPS.search(t) else f"{t} ".replace(". ", " . ").replace(", ", " , ") for t in plain])
        flat, sizes = self._gather(cut, end_id)
        # ... unless another sign stands next to them: those belong together, and such texts are cut at spaces only.
        number, ends, words = cut
        joined = np.array([w not in ENDINGS and w != STOP and w != "" and not _last(w).isalnum() for w in words])
        if joined.any():
            hit = np.diff(np.concatenate([[0], np.cumsum(joined[number])])[ends], prepend=0) > 0
            again, again_sizes = self._gather(self._cut([t for t, h in zip(plain, hit) if h]), end_id)
            parts, redone = np.split(flat, np.cumsum(sizes)[:-1]), iter(np.split(again, np.cumsum(again_sizes)[:-1]))
            parts = [next(redone) if h else part for part, h in zip(parts, hit)]
            flat, sizes = np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
        return flat, sizes


def _last(word: str) -> str:
    """The last character of a word as the tokenizer sees it: composed and in lower case."""
    return word[-1] if word.isascii() else unicodedata.normalize("NFC", word).lower()[-1]


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _encode_partition(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, start = encoder(path), 0
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            for lo, hi in byte_slices(texts, SLICE_BYTES):
                flat, sizes = tool.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()], END_ID)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [ids_of.slice(lo, hi - lo).cast(pa.int64()), pa.array(sizes.astype(np.int32)), pa.array(start + ends - sizes), lists],
                    names=["doc_id", "n_tokens", "start_in_file", "ids"],
                )
                start += int(ends[-1])
            give_back()

    return work


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, file_bytes: int = FILE_BYTES) -> None:
    """Encode ``docs`` and write the files under ``folder``, in ascending order of id.

    ``vocabulary``: the path of a tokenizer file that every executor can read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    rows = rows.repartitionByRange(max(1, -(-size // file_bytes)), "doc_id", F.octet_length("text"))
    rows = rows.sortWithinPartitions("doc_id", "text")
    encoded = rows.mapInArrow(_encode_partition(vocabulary), FILE_SCHEMA)
    writer = encoded.write.option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP_BYTES)
    writer = writer.option("parquet.page.size", PAGE_BYTES).option("parquet.enable.dictionary", "true")
    for column in ("doc_id", "n_tokens", "start_in_file"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.option("compression", "zstd").parquet(folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, tokens, base): one row per file; ``base`` is the number of ids in the files before it."""
    files = spark.read.schema(FILE_SCHEMA).parquet(folder).groupBy(F.col("_metadata.file_path").alias("file"))
    sums = files.agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(sums.select("file", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; select or filter for a part."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(folder).select("*", F.col("_metadata.file_path").alias("file"))
    joined = rows.join(manifest(spark, folder).select("file", "base"), "file")
    return joined.select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        ends = lists.offsets.to_numpy()
        flat = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
        sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY))
    back = read_tokens(spark, folder)
    return cut_lineage(back.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long"))
