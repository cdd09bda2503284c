"""WARC archives: a writer, and a sequential reader.

Each record is a gzip member of its own.  Tasks write archives of at most
``ROLL`` bytes into the shared folder and report them in a manifest, which
Spark commits once per task, so a repeated attempt leaves an unlisted file and
never a doubled record.  The reader streams an archive: members are
decompressed piece by piece, a record's content is framed by Content-Length,
and the digest is computed as the payload passes; a bad frame or digest raises.

Records with equal payloads of at least ``LEAST`` bytes are written once: the
one with the smallest page id is a response, the others are revisits that
name it and carry headers only.  Payloads are hashed where they lie and stay
there while the repeated digests fit into a broadcast; beyond that only the rows
long enough to be repeated are shuffled.

Defined results: a null payload is empty; a null url is an empty target; rows
that repeat the smallest id of a payload are all responses; a null id is
written as an empty id and, where another id has the payload, revisits it; an
empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import MOST_ROWS, Scratch, salted_join

LEAST = 100
ROLL = 64 << 20
PIECE = 1 << 16
#: Payload rows per Arrow batch are bounded by the session; records are written one by one.
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
MANIFEST = "path string, records long"


class BadRecord(ValueError):
    """A record whose frame or digest doesn't hold."""


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path; s3a and s3n are other names of s3."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member. Ids are urns, digests bare hexadecimal SHA-256."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n") + squeeze.compress(body) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


class _Member:
    """The decompressed bytes of one gzip member, in pieces of bounded size."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.raw, self.z, self.held = stream, rest, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Hold one more piece; False at the member's end."""
        while not self.z.eof:
            if not self.raw and not self.z.unconsumed_tail:
                self.raw = self.stream.read(PIECE)
                if not self.raw:
                    raise BadRecord("the archive ends inside a member")
            got = self.z.decompress(self.z.unconsumed_tail or self.raw, PIECE)
            if not self.z.unconsumed_tail:
                self.raw = b""
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > most or not self.more():
                raise BadRecord("the header doesn't end")
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise BadRecord("the content is shorter than its length")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def read_records(stream, keep_payload: bool = False) -> Iterator[dict]:
    """The records of an archive, in order, with verified frames and digests."""
    rest = b""
    while True:
        rest = rest or stream.read(PIECE)
        if not rest:
            return
        m = _Member(stream, rest)
        lines = m.until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise BadRecord("no WARC version")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        sha, size, parts = hashlib.sha256(), 0, []
        for piece in m.pieces(int(head["Content-Length"])):
            sha.update(piece)
            size += len(piece)
            if keep_payload:
                parts.append(piece)
        while m.more():
            pass
        if m.held != b"\r\n\r\n":
            raise BadRecord("the record doesn't end where its length says")
        rest = m.z.unused_data
        revisit = head["WARC-Type"] == "revisit"
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        if not revisit and (sha.hexdigest() != digest or size != int(head["WARC-Payload-Length"])):
            raise BadRecord(f"the payload of {head['WARC-Record-ID']} doesn't have its digest")
        number = lambda s: int(x) if (x := s.removeprefix("<urn:page:").removesuffix(">")) else None
        out = {
            "page_id": number(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "payload_bytes": int(head["WARC-Payload-Length"]),
            "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number(head["WARC-Refers-To"]) if revisit else None,
        }
        yield out | ({"payload": b"".join(parts)} if keep_payload else {})


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = open_store(folder)
        sink, path, size, n, done = None, "", 0, 0, []
        for b in batches:
            for page, url, html, digest, ref in zip(b["page_id"], b["url"], b["html"], b["digest"], b["ref"]):
                if sink is None:
                    path, size, n = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = store.open_output_stream(path, compression=None)
                whole = lambda x: None if pd.isna(x) else int(x)
                text = lambda x: x if isinstance(x, str) else ""
                made = record(whole(page), text(url), text(html).encode("utf-8", "surrogatepass"), digest, whole(ref))
                sink.write(made)
                size, n = size + len(made), n + 1
                if size >= roll:
                    sink.close()
                    done.append((path, n))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((path, n))
        if done:
            yield pd.DataFrame(done, columns=["path", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, id_: str = "page_id", url: str = "url", html: str = "html", roll: int = ROLL) -> DataFrame:
    """Write all rows as records under ``folder``; the committed manifest (path, records)."""
    rows = pages.select(F.col(id_).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256))
    sized = F.coalesce(F.octet_length("html") >= LEAST, F.lit(False))
    # 32 bytes of digest and an id
    first = rows.where(sized).select(F.unhex("digest").alias("_sha"), "page_id").groupBy("_sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = scratch.keep(first.where("n > 1").select("_sha", "first"))
    rows = rows.withColumn("_sha", F.when(sized, F.unhex("digest")))
    if first.n_rows <= MOST_ROWS:
        rows = rows.join(F.broadcast(first), "_sha", "left")
    else:
        short = rows.where("_sha is null").withColumn("first", F.lit(None).cast("long"))
        rows = salted_join(rows.where("_sha is not null"), first, ["_sha"], F.coalesce("page_id", F.lit(0)), "left", salts=16).unionByName(short)
    ref = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    # as text: pandas would make floats of numbers among nulls
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", ref.cast("string").alias("ref"))
    store, top = open_store(folder)
    store.create_dir(top, recursive=True)
    return scratch.keep(rows.mapInPandas(_writer(folder, roll), MANIFEST))


def _reader(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = open_store(folder)
        for b in batches:
            for path in b["path"]:
                held: list[dict] = []
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream):
                        held.append(r)
                        if len(held) == 4096:
                            yield _frame(held)
                            held = []
                if held:
                    yield _frame(held)

    return run


def _frame(rows: list[dict]) -> pd.DataFrame:
    whole = ("page_id", "refers_to")  # among nulls these must not pass through floats
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return pd.DataFrame({c: pd.array([r[c] for r in rows], dtype="Int64") if c in whole else [r[c] for r in rows] for c in names})


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the archives that the manifest lists."""
    n = max(1, manifest.count())
    spread = manifest.select("path").repartition(min(n, 4096))
    return spread.mapInPandas(_reader(folder), RECORDS)


def round_trip(pages: DataFrame, **cols) -> DataFrame:
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.path()
    manifest = write_archives(pages, folder, scratch, **cols)
    return read_archives(manifest, folder)
