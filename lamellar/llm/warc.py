"""Operator 5: WARC archives written and read by Spark alone.

Each record is a gzip member of its own, as the WARC standard advises.  The text
writer puts them into files, with an empty gzip member as the line separator, so
that the archives are plain multi-member gzip and Spark's committer handles lost
tasks.  The text reader, told that the gzip magic separates lines, gives each
task a byte range: it skips to the first magic in its range and owns whatever
starts inside.  Magic bytes also occur by chance inside compressed data, so a
candidate counts as a member only if its header decodes to a WARC record, and
it is joined with the following candidates until its deflate stream ends.

Archives of other writers are read the same way, records of all types.  A name
that ends in .gz makes Hadoop decompress the file as one stream, which cannot be
split: such a file is one task's, and its records are told apart by their lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.llm import common

#: The first bytes of a gzip member (deflate), an empty member, and a record's first bytes.
MAGIC, EMPTY, FIRST = b"\x1f\x8b\x08", b"\x1f\x8b\x08" + bytes(6) + b"\x03\x03" + bytes(9), b"WARC/1.1\r\n"
#: How records of any version begin, and what names those of this module.
BEGIN, OWN = b"WARC/", "<urn:page:"
LEAST_BYTES, LEVEL = 1000, 1

_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages with payload, payload_digest and refers_to: the largest page_id with an equal payload of least_bytes or more, null for that one and for shorter ones.

    Digests are counted before they meet the pages again, so only those that
    several pages share are joined, and a payload that very many pages share is
    split by Spark's skew join.
    """
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    shared = named.where(F.octet_length("payload") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("digest"), "latest")
    joined = named.join(shared, F.col("payload_digest") == F.col("digest"), "left")
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(F.col("latest") > F.col("page_id"), F.col("latest")).alias("refers_to"))


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    name = "null" if page_id is None else str(page_id)
    kind, block = ("response", _HTTP + payload) if refers_to is None else ("revisit", b"")
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", *([f"WARC-Target-URI: {''.join(url.split())}"] if url else []), "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return FIRST + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record for every row of pages (page_id, url, html) to a folder of archives.

    A null html is an empty payload, a null url leaves the target out.  Rows with
    one page_id give a record each.  An empty table gives an empty folder.  Other
    columns are ignored.
    """
    common.ship(pages.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.append(squeeze.compress(_record(*row)) + squeeze.flush())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = revisits(pages, least_bytes).mapInArrow(pack, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)


def _number(record_id: str | None) -> int | None:
    """The page that a record of this module is of."""
    name = record_id[len(OWN) : -1] if record_id and record_id.startswith(OWN) else ""
    return int(name) if re.fullmatch("-?[0-9]+", name) else None


def _head(data: bytes) -> tuple[dict[str, str], int] | None:
    """A record's named fields, in lower case, and where its block starts; None if the head isn't whole."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = re.sub("\r\n[ \t]+", " ", data[:end].decode("utf-8", "replace")).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, end + 4


def _parse(data: bytes) -> dict:
    names, start = _head(data) or ({}, len(data))
    block = data[start : start + int(names.get("content-length", 0))]
    record, kind, given = names.get("warc-record-id"), names.get("warc-type", ""), names.get("warc-payload-digest", "")
    http = names.get("content-type", "").startswith("application/http")
    payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2] if http else block
    digest = given.partition(":")[2] if payload is None else hashlib.sha1(payload).hexdigest()
    if payload is None and re.fullmatch("[A-Z2-7]{32}", digest):
        digest = base64.b32decode(digest).hex()
    if (record or "").startswith(OWN) and payload is not None and f"sha1:{digest}" != given:
        raise ValueError(f"record {record}: payload and digest differ")
    length = len(payload) if payload is not None else int(names["x-payload-length"]) if "x-payload-length" in names else None
    refers = names.get("warc-refers-to")
    return {"page_id": _number(record), "url": names.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest or None, "record_type": kind, "refers_to": _number(refers), "record_id": record, "refers_to_id": refers, "payload": payload}


def whole_records(pieces: Iterable[bytes]) -> Iterator[dict]:
    """Records of an archive's plain bytes, cut at each BEGIN: pieces are joined until a record has its length."""
    held = None
    for piece in pieces:
        held = BEGIN + piece if held is None else held + BEGIN + piece
        head = _head(held)
        if head and len(held) >= head[1] + int(head[0].get("content-length", 0)):
            yield _parse(held)
            held = None
    if held is not None:
        raise ValueError("an archive ends within a record")


class Members:
    """Joins candidates, given in order and without their magic, to members; tells whole records from rests."""

    def __init__(self):
        self.held: bytes | None = None

    @staticmethod
    def begins(candidate: bytes) -> bool:
        """Whether a candidate's header decodes, to the first bytes of a record or to nothing as in an empty member."""
        out = zlib.decompressobj(31)
        try:
            head = out.decompress(MAGIC + candidate, len(BEGIN))
        except zlib.error:
            return False
        return head == BEGIN[: len(head)] if head or not out.eof else True

    def add(self, candidate: bytes) -> tuple[dict | None, bool]:
        """A finished record, and whether the candidate was used: not if it begins no record and none is open."""
        if self.held is None:
            if not self.begins(candidate):
                return None, False
            data = MAGIC + candidate
        else:
            data = self.held + MAGIC + candidate
        out = zlib.decompressobj(31)
        try:
            whole = out.decompress(data)
        except zlib.error as e:
            raise ValueError("damaged gzip member") from e
        self.held = None if out.eof else data
        return (_parse(whole) if out.eof and whole else None), True


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record of the archives under path: page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id (and payload, null for revisits).

    page_id and refers_to are null in records of other writers, and so is the
    length of a revisited payload that they don't state.  The payload is the body of
    an HTTP message, else the whole block; its digest is computed, and in records of
    write_warc() held against theirs.  A broken record is an error.  Only a member whose compressed bytes hold a chance magic just where a byte range ends
    is completed in a second step, by file.
    """
    common.ship(spark)
    schema = _RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string() if x.endswith(" string") else pa.binary() if x.endswith(" binary") else pa.int64() for x in schema.split(", ")]

    def table(records: list[dict]) -> list[pa.Array]:
        return [pa.array([r[n] for r in records], k) for n, k in zip(names, kinds, strict=True)]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, at, seq = Members(), None, 0

        def batch_of(records, rests):
            n = len(rests)
            own = [pa.concat_arrays([x, pa.nulls(n, k)]) for x, k in zip(table(records), kinds, strict=True)]
            more = [pa.array([None] * len(records) + [r[i] for r in rests], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays(own + more, names=[*names, "file", "block", "seq", "rest"])

        for batch in batches:
            records, rests = [], []
            for data, file, block in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (file, block) != at:
                    if members.held is not None:
                        rests.append((*at, seq, members.held[len(MAGIC) :]))
                    members, at, seq = Members(), (file, block), 0
                if not data:
                    continue
                seq += 1
                record, used = members.add(data)
                if record:
                    records.append(record)
                elif not used:
                    rests.append((file, block, seq, data))
            yield batch_of(records, rests)
        if members.held is not None:
            yield batch_of([], [(*at, seq + 1, members.held[len(MAGIC) :])])

    def mend(rows: pa.Table) -> pa.Table:
        rows, members, records = rows.sort_by([("block", "ascending"), ("seq", "ascending")]), Members(), []
        for data in rows.column("rest").to_pylist():
            record, used = members.add(data)
            if not used:
                raise ValueError("bytes of no member")
            if record:
                records.append(record)
        return pa.table(table(records), names=names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((file, data) for batch in batches for data, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for _, own in groupby(pieces, key=lambda x: x[0]):
            for record in whole_records(data for k, (_, data) in enumerate(own) if k):  # nothing stands before the first
                yield pa.RecordBatch.from_arrays(table([record]), names=names)

    def lines(separator: bytes, which: str) -> DataFrame:
        return spark.read.option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1")).option("pathGlobFilter", which).text(path)

    members = lines(MAGIC, "{*[^z],*[^g]z,*[^.]gz}")
    found = members.select(F.col("value").cast("binary"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).mapInArrow(split, schema + ", file string, block long, seq long, rest binary")
    whole = found.where("rest is null").select(names)
    out = whole.unionByName(found.where("rest is not null").select("file", "block", "seq", "rest").groupBy("file").applyInArrow(mend, schema))
    streams = lines(BEGIN, "*.gz")
    return out.unionByName(streams.select(F.col("value").cast("binary"), F.col("_metadata.file_path")).mapInArrow(stream, schema)) if streams.inputFiles() else out
