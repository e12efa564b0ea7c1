"""WARC archives: writing, normalising monolithic gzip files, reading by offset.

``write_monolithic`` stores records as whole-file gzip streams, the form that bulk
writers leave behind and that cannot be read at an offset.  ``normalise`` inflates
each such stream once, in pieces, writes every record as a gzip member of its own
and a sidecar index of offsets beside it.  ``read_back`` reads members at the
indexed offsets.

Equal payloads of at least ``MIN_REVISIT`` bytes are stored once: the row with the
largest page_id is the response, rows with smaller or null page_ids revisit it, and
rows that share that largest page_id are all responses, as are all rows of a
payload whose page_ids are all null.  Null html is an empty payload, a null url
has no target line, control characters in urls are percent-encoded.  Extra columns
are ignored, an empty table gives no archive and no rows.

Archives lie in a folder that tasks reach through ``pyarrow.fs``.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quintavote.staging import ship_package

MIN_REVISIT = 1_000
# Records of one archive file, which is normalised by one task as a stream.
RECORDS_PER_FILE = 20_000
_CRLF = "\r\n"
_END = b"\r\n\r\n"
_CHUNK = 1 << 20

_INDEX = (
    "archive string, offset long, length long, page_id long, record_type string, "
    "refers_to long, payload_digest string"
)


def records(pages: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest, record (text up to its end)."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).select(
        "*",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    same = ["payload_digest", "payload_bytes"]
    # One row per payload that occurs more than once: map-side counts, then a small join side.
    responses = (
        base.where(F.col("payload_bytes") >= MIN_REVISIT)
        .groupBy(*same)
        .agg(F.count("*").alias("n"), F.max("page_id").alias("response"))
        .where("n > 1 AND response IS NOT NULL")
        .drop("n")
    )
    # Only ids and digests meet the counts; the payloads stay where they are until written.
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    found = base.join(responses, same, "left").select(
        "page_id", "url", "payload", *same,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response")).alias("refers_to"),
    )

    def line(name: str, value) -> object:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)), F.lit(""))

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"),
        line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit(_CRLF),
    )
    block = F.concat(
        http, F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    )
    url = F.regexp_replace("url", r"[\x00-\x1F\x7F]", "%20")
    header = F.concat(
        F.lit(f"WARC/1.0{_CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(_CRLF),
    )
    return found.withColumn("block", block).select(
        "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest",
        F.concat(header, F.col("block")).alias("record"),
    )


def write_monolithic(recs: DataFrame, folder: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Write records as gzip streams of at most ``per_file`` records each."""
    (
        recs.select(F.col("record").alias("value"))
        .write.option("compression", "gzip")
        .option("lineSep", _END.decode())
        .option("maxRecordsPerFile", per_file)
        .text(folder)
    )


class Inflated(io.RawIOBase):
    """A gzip stream of any number of members, inflated piece by piece."""

    def __init__(self, raw):
        self.raw, self.inflate, self.left = raw, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while data := self.left or self.raw.read(_CHUNK):
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            out = self.inflate.decompress(data, len(into))
            self.left = self.inflate.unconsumed_tail or self.inflate.unused_data
            if out:
                into[: len(out)] = out
                return len(out)
        if not self.inflate.eof:
            raise EOFError("gzip stream ends within a member")
        return 0


def parse_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields, block, the record's bytes) one after the other."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = [first]
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            head.append(line)
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise EOFError("record ends early")
        yield fields, block, b"".join(head) + b"\r\n" + block + _END


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def normalise_file(source: str, target: str) -> list[dict]:
    """Rewrite one stream as one member per record; returns and stores its index.

    Both files appear under their final names only when complete, so a repeated
    task replaces what a lost one left.
    """
    import uuid

    files, inside = _open(source)
    out_files, out = _open(target)
    attempt = f"{out}.{uuid.uuid4().hex}"
    index, offset = [], 0
    with files.open_input_stream(inside, compression=None) as raw, out_files.open_output_stream(
        attempt, compression=None
    ) as sink:
        for fields, _, record in parse_records(io.BufferedReader(Inflated(raw), _CHUNK)):
            member = gzip.compress(record, 6, mtime=0)
            sink.write(member)
            index.append(
                {
                    "archive": target,
                    "offset": offset,
                    "length": len(member),
                    "page_id": _page(fields.get("warc-record-id")),
                    "record_type": fields.get("warc-type"),
                    "refers_to": _page(fields.get("warc-refers-to")),
                    "payload_digest": fields.get("warc-payload-digest", "").partition(":")[2],
                }
            )
            offset += len(member)
    with out_files.open_output_stream(f"{attempt}.idx", compression=None) as sink:
        for row in index:
            sink.write(json.dumps(row).encode() + b"\n")
    out_files.move(f"{attempt}.idx", f"{out}.idx")
    out_files.move(attempt, out)
    return index


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """One row per file, dealt over tasks by its path."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path")
    )
    return files.repartitionByRange(spark.sparkContext.defaultParallelism * 4, "path")


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Normalise every archive under ``source`` into ``target``; returns the index written beside them."""
    ship_package(spark)
    _, path = _open(target)
    _open(target)[0].create_dir(path)

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                name = path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".txt")
                index = normalise_file(path, f"{target}/{name}.warc.gz")
                yield pd.DataFrame({"archive": [f"{target}/{name}.warc.gz"], "n": [len(index)]})

    done = _listed(spark, source, "part-*").mapInPandas(rewrite, "archive string, n long")
    done.write.format("noop").mode("overwrite").save()
    return spark.read.schema(_INDEX).option("pathGlobFilter", "*.idx").json(target)


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload of every record.

    Members are read at their indexed offsets.  A revisit has no payload of its
    own; its length and digest are those of the payload it refers to.  A response
    that does not have the digest its header states is an error.
    """
    ship_package(spark)
    schema = (
        "page_id long, url string, record_type string, refers_to long, "
        "payload_digest string, payload_bytes long, payload binary"
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield from _read_archive(path)

    return _listed(spark, folder, "*.idx").mapInPandas(read, schema)


def read_record(archive, offset: int, length: int) -> dict:
    """One record of an opened archive."""
    import hashlib

    archive.seek(offset)
    member = gzip.decompress(archive.read(length))
    fields, block, _ = next(parse_records(io.BufferedReader(io.BytesIO(member))))
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    digest = fields.get("warc-payload-digest", "").partition(":")[2]
    whole = fields["warc-type"] == "response"
    if whole and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields.get('warc-record-id')} does not have its digest")
    return {
        "page_id": _page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload_digest": digest,
        "payload_bytes": len(payload) if whole else int(stated[1]),
        "payload": payload if whole else None,
    }


def _read_archive(index_path: str, rows: int = 256) -> Iterator[pd.DataFrame]:
    files, path = _open(index_path)
    with files.open_input_stream(path, compression=None) as lines:
        index = [json.loads(x) for x in lines.read().splitlines()]
    with files.open_input_file(path.removesuffix(".idx")) as archive:
        for start in range(0, len(index), rows):
            got = [
                read_record(archive, x["offset"], x["length"]) for x in index[start : start + rows]
            ]
            frame = pd.DataFrame(got, dtype=object)
            for name in ("page_id", "refers_to", "payload_bytes"):
                frame[name] = frame[name].astype("Int64")
            yield frame
