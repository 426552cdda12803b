"""WARC: write whole-file gzip archives, normalise them to one member per record, read by offset.

Many producers gzip an archive as one stream, which can only be read from its
start. The normaliser inflates such a stream once, in pieces, rewrites every record
as a gzip member of its own and writes a sidecar index of offsets, so that any
record can then be fetched alone. It holds one piece of one record in memory.

Writing is a plain text sink: a record is a line, and the line end is the record
end of the format, so Spark's own committer and codecs do the work. Rewritten
archives get a new name per task attempt; only those named in the returned index
count, so a lost executor or a second attempt leaves no wrong rows.

Defined results: a null or empty payload is a record without payload; a null URL
becomes the record's id; a record with a null page id is always a response, as are
rows that repeat the smallest id of their payload; an empty table gives no archive
rows; further columns of the input are ignored whatever their names. A damaged
archive raises, or with on_error="report" gives a row with ``error`` set after the
records before the damage.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scaling import checkpoint_dir, cut_lineage
from .common import table

DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
PIECE = 1 << 20
LEVEL = 6
#: Payloads from this size on are stored once.
REVISIT_FROM = 0
INDEX = "archive string, offset long, length long, record_type string, record_id string, payload_digest string, error string"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text's bytes: five hex digits make four of base32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_roles(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses.

    Only payloads that occur more than once reach the join, as one row each.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    size = F.octet_length("payload")
    same = rows.filter(size >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    same = cut_lineage(same.filter("first < last").select(F.col("digest").alias("d"), "first"))
    refers = F.when((F.col("page_id") > F.col("first")) & (size >= revisit_from), F.col("first"))
    return rows.join(same, F.col("digest") == F.col("d"), "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(row_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column, date: str) -> Column:
    """A record without its end mark."""
    urn = F.concat(F.lit("urn:page:"), F.coalesce(row_id.cast("string"), F.lit("null")))
    target = F.coalesce(F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20"), urn)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END))
    revisit = refers_to.isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <"), urn,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), target,
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nWARC-Payload-Digest: sha1:"), digest,
        F.lit("\r\nX-Payload-Length: "), F.octet_length(payload).cast("string"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
            refers_to.cast("string"), F.lit(">"),
        )).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )


def write_archives(pages: DataFrame, folder: str, revisit_from: int = REVISIT_FROM, date: str = DATE) -> None:
    """One whole-file gzip archive per task under ``folder``."""
    rows = with_roles(pages, revisit_from)
    text = record(F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("refers_to"), date)
    rows.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(folder)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    plain = "/" + uri.split(":", 1)[1].lstrip("/") if uri.startswith("file:") else uri
    return fs.FileSystem.from_uri(plain)


class _Inflated:
    """The bytes of a gzip file, one or many members, read in pieces."""

    def __init__(self, source) -> None:
        self.source, self.held, self.done = source, bytearray(), False
        self.member = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.member.eof:
            raw = self.member.unused_data or self.source.read(PIECE)
            if not raw:
                return False
            self.member = zlib.decompressobj(31)
        else:
            raw = self.member.unconsumed_tail or self.source.read(PIECE)
            if not raw:
                raise ValueError("the gzip stream ends before its trailer")
        self.held += self.member.decompress(raw, PIECE)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the file."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record's header")
                return None
        out = bytes(self.held[: found + len(mark)])
        del self.held[: found + len(mark)]
        return out

    def skip(self, what: bytes) -> None:
        """Past any bytes of ``what``, to the next record or the end of the file."""
        while self.held or self._more():
            kept = self.held.lstrip(what)
            if kept:
                self.held = kept
                return
            self.held.clear()

    def pieces(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self._more():
                raise ValueError("the archive ends inside a record")
            out = bytes(self.held[:size])
            del self.held[: len(out)]
            size -= len(out)
            if out:
                yield out


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _rewrite(source, sink, archive: str) -> Iterator[tuple]:
    """Copy the records of ``source`` to ``sink``, a member each; an index row per record."""
    stream, offset = _Inflated(source), 0
    while (header := stream.until(END.encode())) is not None:
        if not header.startswith(b"WARC/"):
            raise ValueError(f"no record starts where one should: {header[:40]!r}")
        fields = _fields(header)
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        length = sink.write(packer.compress(header))
        for piece in stream.pieces(int(fields["content-length"])):
            length += sink.write(packer.compress(piece))
        length += sink.write(packer.compress(END.encode()) + packer.flush())
        stream.skip(b"\r\n")
        yield archive, offset, length, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-payload-digest"), None
        offset += length


def normalise(spark: SparkSession, folder: str, out: str, on_error: str = "raise") -> DataFrame:
    """Rewrite all archives under ``folder`` into ``out``; the index of what was written.

    Every rewritten archive has a sidecar ``.idx`` beside it: offset, length, type and
    record id, tab separated, a line per record.
    """
    if on_error not in ("raise", "report"):
        raise ValueError(f"on_error must be raise or report, got {on_error}")
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in INDEX.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                base = posixpath.basename(path).split(".")[0]
                target = f"{out}/{base}-{uuid.uuid4().hex[:12]}.warc.gz"
                read_fs, read_path = _open(path)
                write_fs, write_path = _open(target)
                write_fs.create_dir(posixpath.dirname(write_path), recursive=True)
                with (
                    read_fs.open_input_stream(read_path, compression=None) as source,
                    write_fs.open_output_stream(write_path, compression=None) as sink,
                    write_fs.open_output_stream(write_path + ".idx", compression=None) as sidecar,
                ):
                    rows = _rewrite(source, sink, target)
                    while True:
                        done, failure = [], None
                        try:
                            for row in rows:
                                done.append(row)
                                if len(done) == 10_000:
                                    break
                        except (ValueError, KeyError, zlib.error) as exc:
                            if on_error == "raise":
                                raise
                            failure = (path, None, None, None, None, None, f"{type(exc).__name__}: {exc}")
                        sidecar.write("".join(f"{r[1]}\t{r[2]}\t{r[3]}\t{r[4]}\n" for r in done).encode())
                        yield pd.DataFrame(done + [failure] * (failure is not None), columns=columns)
                        if len(done) < 10_000 or failure:
                            break

    return cut_lineage(archives.mapInPandas(work, INDEX))


RECORD = (
    "record_id string, record_type string, refers_to string, target_uri string, payload binary, "
    "payload_length long, payload_digest string"
)


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The indexed records, each inflated from its own member; digests are checked.

    A revisit has no payload of its own; its length and digest are those it refers to.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            rows, held = [], 0
            for archive, part in batch.groupby("archive", sort=False):
                files, path = _open(archive)
                with files.open_input_file(path) as source:
                    for offset, length in zip(part["offset"].astype(int), part["length"].astype(int)):
                        data = zlib.decompress(source.read_at(length, offset), 31)
                        header, _, rest = data.partition(END.encode())
                        fields = _fields(header)
                        block = rest[: int(fields["content-length"])]
                        payload = block.partition(END.encode())[2]
                        kind, named = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        size = int(fields["x-payload-length"]) if kind == "revisit" else len(payload)
                        if kind != "revisit" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != named:
                            raise ValueError(f"{archive} at {offset}: the payload does not have its digest")
                        rows.append((fields["warc-record-id"], kind, fields.get("warc-refers-to"), fields["warc-target-uri"], payload if with_payload else None, size, named))
                        held += len(payload) * with_payload
                        if held > 16 * PIECE:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return index.filter("error IS NULL").select("archive", "offset", "length").mapInPandas(work, RECORD)


def op9_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), f"{folder}/whole")
    index = normalise(spark, f"{folder}/whole", f"{folder}/members")
    found = read_records(index, with_payload=False)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return found.select(
        number(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest",
        "record_type", number(F.col("refers_to")).alias("refers_to"),
    )


_HEX5 = "('0x' || substr(h, {}, 5))::BIGINT"
SQL = f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
digests AS (SELECT page_id, payload_bytes, translate({" || ".join(f"to_base({_HEX5.format(1 + 5 * i)}, 32, 4)" for i in range(8))},
  '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM digests)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > f AND payload_bytes >= {REVISIT_FROM} THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > f AND payload_bytes >= {REVISIT_FROM} THEN f END AS refers_to
FROM firsts
"""
