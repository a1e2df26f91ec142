"""Legacy archive converter: ARC files of version 1 or 2 to WARC files with revisit records.

Pages are written as ARC archives, whose headers and declared lengths are parsed again by the rules of
their version; each record then becomes a WARC record with a synthesised identifier, time stamp, type
and payload digest, and equal payloads become revisits. Archives are written by Spark's text sink, one
record per row and the format's own record end as the line separator, so that a lost executor's files
are never left half written, and are read as whole files within tasks.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentscan.llm.common import work_dir, written

#: Payloads shorter than this are always stored.
LEAST = 100
#: The header fields of both ARC versions, in order, and the text of their first records.
FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Fixed value: the profile of a revisit that repeats a payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: How archives are compressed; the level reaches the codec as a setting of the write.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
CAPTURED = "20240101000000"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs


def record_id(page: object, digest: str) -> str:
    """The same identifier whenever the same page and payload are converted."""
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'page:{page}/{digest}')}"


def _address(url: str | None, page: object) -> str:
    """A URL without white space or control characters, which would break an ARC header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page}")


def _arc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ARC records of one partition, after its version block; partitions take the versions in turn."""
    version = None
    for batch in batches:
        out = []
        if version is None and batch.num_rows:
            version = "12"[batch["part"][0].as_py() % 2]
            name = f"part-{batch['part'][0].as_py()}.arc"
            body = f"{version} 0 agentscan\n{' '.join(FIELDS[version])}\n"
            values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": CAPTURED, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
            out.append(" ".join(values[f] for f in FIELDS[version]) + "\n" + body)
        for page, url, html in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
            block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "") + "\r\n" + (html or "")
            values = {"URL": _address(url, page), "IP-address": "0.0.0.0", "Archive-date": CAPTURED, "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "-", "Archive-length": str(len(block.encode()))}
            out.append(" ".join(values[f] for f in FIELDS[version]) + "\n" + block)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_arc(pages: DataFrame, path: str) -> None:
    """Writes page_id, url and html as gzipped ARC files, one for each partition."""
    rows = pages.select("page_id", "url", "html", F.spark_partition_id().alias("part"))
    rows.mapInArrow(_arc_rows, "value string").write.options(lineSep="\n", **GZIP).text(path)


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of the records of a gzipped ARC file, by declared length.

    The first record's body names the version, which decides how many fields the headers have. URLs
    hold no blanks, so a header is split at blanks from its end; a file cut off within a record ends
    with the record before.
    """
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)), 1 << 20)
    version = None
    while line := f.readline():
        if line in (b"\n", b"\r\n"):
            continue
        words = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        size = int(words[-1])
        content = f.read(size)
        if len(content) < size:
            return
        if version is None:
            version = content[:1].decode()
            yield dict(zip(FIELDS[version], words, strict=True)), content
        else:
            yield dict(zip(FIELDS[version], words, strict=True)), content


def _split_http(content: bytes) -> tuple[bytes, bytes]:
    head, sep, payload = content.partition(b"\r\n\r\n")
    return head + sep, payload


def _page_of(head: bytes) -> int | None:
    m = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r?$", head)
    return int(m[1]) if m else None


_ARC_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("head", pa.string()), ("payload", pa.binary()), ("digest", pa.string()), ("size", pa.int64())])


def _parse_arc(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                rows, held = [], 0
                for fields, content in arc_records(data.as_py()):
                    if fields["URL"].startswith("filedesc://"):
                        continue
                    head, payload = _split_http(content)
                    rows.append((_page_of(head), fields["URL"], fields["Archive-date"], head.decode(), zlib.compress(payload, 1) if with_payload else None, hashlib.sha256(payload).hexdigest(), len(payload)))
                    held += len(content)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(_ARC_OUT.names, r, strict=True)) for r in rows], schema=_ARC_OUT)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(_ARC_OUT.names, r, strict=True)) for r in rows], schema=_ARC_OUT)

    return run


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, url, date, head (HTTP), payload (deflated; null if not asked for), digest and size of ARC records."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse_arc(with_payload), "page_id long, url string, date string, head string, payload binary, digest string, size long")


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = True
    for batch in batches:
        out = []
        if first and batch.num_rows:
            info = "software: agentscan\r\nformat: WARC File Format 1.1\r\n"
            out.append(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {_iso(CAPTURED)}\r\nWARC-Record-ID: <{record_id('info', str(batch['part'][0].as_py()))}>\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}")
            first = False
        for r in batch.to_pylist():
            revisit = r["refers_to"] is not None
            block = r["head"] + ("" if revisit else zlib.decompress(r["payload"]).decode("utf-8", "replace"))
            head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Target-URI: {r['url']}", f"WARC-Date: {_iso(r['date'])}", f"WARC-Record-ID: <{record_id(r['page_id'], r['digest'])}>", f"WARC-Payload-Digest: sha256:{r['digest']}", "Content-Type: application/http; msgtype=response"]
            if revisit:
                head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(r['refers_to'], r['digest'])}>"]
            head.append(f"Content-Length: {len(block.encode())}")
            out.append("\r\n".join(head) + "\r\n\r\n" + block)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def _iso(stamp: str) -> str:
    """An ARC time stamp (YYYYMMDDhhmmss, shorter ones filled) as WARC writes it."""
    s = (stamp + "00010101000000"[len(stamp) :])[:14] if len(stamp) < 14 else stamp[:14]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """Converts a folder of ARC files to one of gzipped WARC files.

    Of records with equal payloads of LEAST bytes or more, those of the smallest page_id are responses
    and the others revisit them. The payloads are shuffled once, by page; the choice of each digest's
    first page moves digests alone.
    """
    light = written(read_arc(spark, arc, False).select("page_id", "digest", "size"), "digests").where(F.col("size") >= LEAST)
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    again = light.select("page_id", "digest").distinct().join(first, "digest").where("refers_to is not null and not (page_id <=> refers_to)")
    records = read_arc(spark, arc).alias("r")
    a = again.alias("a")
    decided = records.join(a, F.col("r.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("r.digest") == F.col("a.digest")), "left").select("r.*", "a.refers_to", F.spark_partition_id().alias("part"))
    decided.mapInArrow(_warc_rows, "value string").write.options(lineSep="\r\n\r\n", **GZIP).text(warc)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records of a gzipped WARC file, by declared length."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)), 1 << 20)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := f.readline().rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = f.read(size)
        if len(block) < size:
            return
        yield fields, block


_WARC_OUT = pa.schema([("page_id", pa.int64()), ("record", pa.string()), ("kind", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("sound", pa.bool_())])


def _parse_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch["content"]:
            rows = []
            for fields, block in warc_records(data.as_py()):
                if fields["warc-type"] not in ("response", "revisit"):
                    continue
                head, payload = _split_http(block)
                stated, real = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"] == "response"
                digest = hashlib.sha256(payload).hexdigest() if real else stated
                rows.append({"page_id": _page_of(head), "record": fields["warc-record-id"], "kind": fields["warc-type"], "refers": fields.get("warc-refers-to"), "digest": digest, "size": len(payload) if real else None, "sound": digest == stated})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_WARC_OUT)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit: page_id, payload_bytes, payload_digest, record_type, refers_to, sound.

    A revisit's bytes and page are those of the record it refers to; sound says whether a stored
    payload has the digest that its header states.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = written(files.mapInArrow(_parse_warc, "page_id long, record string, kind string, refers string, digest string, size long, sound boolean"), "warc-rows")
    held = rows.where("kind = 'response'").groupBy(F.col("record").alias("refers")).agg(F.first("page_id").alias("of"), F.first("size").alias("stored"))
    return rows.join(held, "refers", "left").select("page_id", F.coalesce("size", "stored").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.when(F.col("kind") == "revisit", F.col("of")).alias("refers_to"), "sound")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages to ARC, converts them to WARC and reads that back, in ``folder`` (arc, warc).

    A null html is an empty payload; a null url becomes a URN of the page. Repeated rows are records
    of their own with one identifier; records of one payload and the smallest page_id all stay
    responses. A null page_id revisits any other. No pages, no records. Other columns are not kept.
    """
    spark = pages.sparkSession
    folder = folder or work_dir(spark, "archives")
    write_arc(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    return read_warc(spark, f"{folder}/warc")
