"""WARC archives in Zstandard: a dictionary frame first, then one frame per record.

Writing: Spark deals pages to tasks, each task packs its records into archives of a
bounded size (a skippable frame with the dictionary, then one Zstandard frame per WARC
record), and Spark's own file writer commits them, one file per archive. The line
separator of that writer is an empty skippable frame, so every file is a valid stream.

Reading: ``binaryFile`` hands each archive to a task, which loads the dictionary from the
leading skippable frame (plain or itself compressed), decodes one frame per record and
checks frame, WARC version, header syntax, Content-Length, block length and payload
digest. A record that fails is returned with ``error`` set, never dropped.

Records of equal payloads: the one with the smallest page id is a ``response``, the others
are ``revisit`` records without a body; their HTTP header keeps the payload's length.
Only (page id, digest) rows are grouped to find them, so a payload that a third of the
pages share moves no html.

Records of other writers are read as well: any record type, ids that are no pages (null
``page_id``), a payload without HTTP header, and without the lengths and digests that the
standard leaves open; what is there is checked.

Null html is an empty payload; a null page id sorts last, and one that is no integer counts as null; of rows that share page id and
payload one is the response and the others revisit it. Empty tables give no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import col, fresh_path

#: Fixed values of the formats: skippable frame numbers and the frame magic number.
DICT_FRAME = 0x184D2A5D
EMPTY_FRAME = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry the capture date of the crawl; the pages table has none.
NO_DATE = "1970-01-01T00:00:00Z"

READ_SCHEMA = ("archive string, record_no long, frame_offset long, record_type string, record_id string, "
               "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
               "refers_to long, error string")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, copy_no, revisits, refers_to) of every page row.

    ``revisits`` is true for all but the first record of a payload of at least
    ``min_bytes`` bytes; ``refers_to`` is then that first record's page id.
    """
    def keyed(*more):
        html = F.coalesce(col("html").cast("string"), F.lit(""))
        page = col("page_id").try_cast("long")
        return pages.select(
            page.alias("page_id"), F.coalesce(page.cast("string"), F.lit("null")).alias("page"),
            F.concat(F.sha1(html.cast("binary")), F.lit("-"), F.octet_length(html).cast("string")).alias("digest"),
            F.octet_length(html).alias("size"), html.alias("html"), *more)

    slim = keyed().filter(F.col("size") >= min_bytes).select("page_id", "page", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    who = slim.distinct().join(first, "digest").select("page", "digest", "first_id", F.lit(True).alias("shared"))
    # one shuffle of the html, by page and digest, serves the count of repeats and the join
    rows = keyed(col("url").cast("string").alias("url")).withColumn("copy_no", F.row_number().over(
        Window.partitionBy("page", "digest").orderBy(F.coalesce("url", F.lit("")))))
    revisits = F.col("shared").isNotNull() & (
        ~F.col("page_id").eqNullSafe(F.col("first_id")) | (F.col("copy_no") > 1))
    return rows.join(who, ["page", "digest"], "left").select(
        "page_id", "url", "html", "copy_no", revisits.alias("revisits"),
        F.when(revisits, F.col("first_id")).alias("refers_to"))


def train_dictionary(pages: DataFrame, size: int = 16384, sample: int = 400, longest: int = 32768) -> bytes:
    """A Zstandard dictionary from ``sample`` pages of at most ``longest`` bytes.

    The sample (the smallest hashes of page id and length) bounds what reaches the driver:
    first the hashes alone are ordered, as a task sends its smallest ones, then the pages
    that have them are fetched, one a hash. The dictionary only affects sizes, never what
    is read back. Too little data: b"".
    """
    html = col("html").cast("string")
    keyed = pages.select(html.alias("html"), F.xxhash64(col("page_id"), F.octet_length(html), F.lit(7)).alias("h")).filter(
        F.octet_length("html").between(64, longest))
    chosen = [r["h"] for r in keyed.select("h").distinct().orderBy("h").limit(sample).collect()]
    rows = keyed.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    texts = [r["html"].encode() for r in rows]
    if len(texts) < 16 or sum(map(len, texts)) < 8 * size:
        return b""
    try:
        return zstd.train_dictionary(size, texts).as_bytes()
    except zstd.ZstdError:
        return b""


def record_bytes(page_id, url, html: bytes, copy_no: int, revisits: bool, refers_to) -> bytes:
    """One WARC/1.1 record. Ids are URNs of the page; line breaks in urls are dropped."""
    urn = lambda i, n: f"<urn:page:{'null' if i is None else i}" + (f":{n}>" if n > 1 else ">")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if revisits else http + html
    head = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", urn(page_id, copy_no)),
            ("WARC-Date", NO_DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if revisits:
        head += [("WARC-Refers-To", urn(refers_to, 1)), ("WARC-Profile", REVISIT_PROFILE)]
    head += [("WARC-Payload-Digest", "sha1:" + base32_sha1(html)),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 4 << 20, level: int = 3) -> None:
    """Write one record per row of ``plan_records`` to ``path``.

    An archive closes once it holds ``archive_bytes``; a longer record has its own.
    """
    ship_package(pages.sparkSession)
    dictionary = train_dictionary(pages)
    lead = b"" if not dictionary else struct.pack("<II", DICT_FRAME, len(dictionary)) + dictionary

    def pack(batches):
        how = {"dict_data": zstd.ZstdCompressionDict(dictionary)} if dictionary else {}
        comp = zstd.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, **how)
        parts, held = [lead], 0
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for row in zip(*cols, strict=True):
                parts.append(comp.compress(record_bytes(*row)))
                held += len(parts[-1])
                if held >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["value"])
                    parts, held = [lead], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["value"])

    rows = plan_records(pages).withColumn("html", F.col("html").cast("binary")).mapInArrow(pack, "value binary")
    (rows.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
     .option("lineSep", EMPTY_FRAME.decode()).option("compression", "none").text(path))


def split_frames(blob: bytes):
    """(offset, frame) of every frame of an archive; ValueError where none begins."""
    at = 0
    while at < len(blob):
        magic = struct.unpack_from("<I", blob, at)[0] if at + 8 <= len(blob) else 0
        if magic in SKIPPABLE:
            end = at + 8 + struct.unpack_from("<I", blob, at + 4)[0]
            if end > len(blob):
                raise ValueError(f"skippable frame cut off at {at}")
        elif blob[at:at + 4] == ZSTD_MAGIC:
            end = frame_end(blob, at)
        else:
            raise ValueError(f"no frame at {at}")
        yield at, blob[at:end]
        at = end


def frame_end(blob: bytes, at: int) -> int:
    """End of the Zstandard frame at ``at``: its block headers name the lengths."""
    info = zstd.get_frame_parameters(blob[at:at + 18])
    pos = at + zstd.frame_header_size(blob[at:at + 18])
    while True:
        if pos + 3 > len(blob):
            raise ValueError(f"frame cut off at {at}")
        head = int.from_bytes(blob[pos:pos + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        pos += 3 + (1 if kind == 1 else size)
        if last:
            pos += 4 if info.has_checksum else 0
            if pos > len(blob):
                raise ValueError(f"frame cut off at {at}")
            return pos


def load_dictionary(frame: bytes) -> zstd.ZstdCompressionDict:
    body = frame[8:]
    if body[:4] == ZSTD_MAGIC:
        body = zstd.ZstdDecompressor().decompressobj().decompress(body)
    return zstd.ZstdCompressionDict(body)


def parse_headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError("malformed header line")
        out[name.decode("utf-8").lower()] = value.strip().decode("utf-8")
    return out


def page_of(urn: str | None) -> int | None:
    """The page id in a record id of this writer; None for any other id and that of a null page."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)(:[0-9]+)?>", urn or "")
    return found and int(found[1])


def parse_record(raw: bytes) -> dict:
    """Fields of one record; ValueError if a header, a length or a digest is wrong.

    The payload is the body of an HTTP response or request, else the block; a revisit has none.
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("not a WARC record")
    warc = parse_headers(lines[1:])
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in warc:
            raise ValueError(f"header {need} is missing")
    if not warc["content-length"].isdigit() or len(rest) != int(warc["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit the record")
    kind, payload, size = warc["warc-type"], rest[:-4], None
    if warc.get("content-type", "").lower().startswith("application/http"):
        http, gap, payload = payload.partition(b"\r\n\r\n")
        status = http.split(b"\r\n")
        if not gap or not (status[0].startswith(b"HTTP/") or kind == "request"):
            raise ValueError("malformed HTTP header")
        fields = parse_headers(status[1:])
        if "transfer-encoding" not in fields:  # else the length is that of the chunks
            size = fields.get("content-length")
    if size is not None and not size.isdigit():
        raise ValueError("malformed HTTP Content-Length")
    algorithm, _, digest = warc.get("warc-payload-digest", "").partition(":")
    own = base32_sha1(payload)
    if kind == "revisit":
        if payload or "warc-refers-to" not in warc and "warc-refers-to-target-uri" not in warc:
            raise ValueError("malformed revisit record")
        payload = None
    elif size is not None and len(payload) != int(size) or algorithm.lower() == "sha1" and own != digest.upper():
        raise ValueError("payload length or digest does not fit")
    if algorithm.lower() != "sha1":
        digest = own if payload is not None else None
    length = len(payload) if payload is not None else None if size is None else int(size)
    return {"record_type": kind, "record_id": warc["warc-record-id"], "page_id": page_of(warc["warc-record-id"]),
            "url": warc.get("warc-target-uri"), "payload": payload, "payload_bytes": length,
            "payload_digest": digest and digest.upper(), "refers_to": page_of(warc.get("warc-refers-to")), "error": None}


def read_archive(name: str, blob: bytes):
    """Rows of one archive. What follows a broken frame can't be read: one error row."""
    bad = dict.fromkeys(("record_type", "record_id", "page_id", "url", "payload", "payload_bytes",
                         "payload_digest", "refers_to"))
    plain = decomp = zstd.ZstdDecompressor()
    n, at = 0, 0
    try:
        for at, frame in split_frames(blob):
            magic = struct.unpack_from("<I", frame)[0]
            if magic == DICT_FRAME and at == 0:
                decomp = zstd.ZstdDecompressor(dict_data=load_dictionary(frame))
            if magic in SKIPPABLE:
                continue
            place = {"archive": name, "record_no": n, "frame_offset": at}
            n += 1
            try:
                needs = zstd.get_frame_parameters(frame).dict_id
                yield place | parse_record((decomp if needs else plain).decompressobj().decompress(frame))
            except (ValueError, zstd.ZstdError) as e:
                yield place | bad | {"error": str(e)}
    except (ValueError, zstd.ZstdError, struct.error) as e:
        yield {"archive": name, "record_no": n, "frame_offset": at} | bad | {"error": str(e)}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives below ``path`` (READ_SCHEMA)."""
    ship_package(spark)
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in READ_SCHEMA.split(", ")])

    def decode(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows, held = [], 0
                for r in read_archive(b.column(0)[i].as_py(), b.column(1)[i].as_py()):
                    held += len(r["payload"] or b"")
                    rows.append(r if with_payload else r | {"payload": None})
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(decode, READ_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, with_payload=False)
