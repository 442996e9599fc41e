import base64
import hashlib
import struct

import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from quarry.llm import warc

PAGES = "page_id long, url string, html string"


def want_rows(rows):
    """(page_id, bytes, digest, type, refers_to) by the contract, repeated rows included."""
    first = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out, done = [], set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        p = (html or "").encode()
        lead = first.get(p)
        response = lead == i and p not in done
        if response:
            done.add(p)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
                    "response" if response else "revisit", None if response else lead))
    return out


def got_rows(df):
    return [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()]


def test_round_trip_of_awkward_pages(spark):
    rows = [(i, f"http://h/{i}?a b\r\nX: y", f"<p>{'é' * (i % 7)}\r\n\r\n{i}</p>" * (i % 30)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (99, "u", "same"), (98, "u", "same"), (98, "u", "same"),
             (None, "u", "same"), (200, "u", "long " * 400_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", payload string").repartition(5)
    got = warc.round_trip(df)
    assert sorted(got_rows(got), key=str) == sorted(want_rows(rows), key=str)
    assert got.filter("error IS NOT NULL").count() == 0
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_payloads_come_back_whole(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * i) for i in range(1, 40)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, archive_bytes=1500)
    got = warc.read_archives(spark, path).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: h for i, _, h in rows}
    assert len({r.archive for r in got}) > 2


def archive(records, dictionary=b"", compressed=False):
    lead, how = b"", {}
    if dictionary:
        how = {"dict_data": zstd.ZstdCompressionDict(dictionary)}
        body = zstd.ZstdCompressor().compress(dictionary) if compressed else dictionary
        lead = struct.pack("<II", warc.DICT_FRAME, len(body)) + body
    comp = zstd.ZstdCompressor(write_checksum=True, **how)
    return lead + b"".join(comp.compress(r) for r in records)


@pytest.mark.parametrize("compressed", [False, True])
def test_dictionary_in_the_leading_frame(compressed):
    texts = [(f"<html>{i} " + "common words of every page " * 20).encode() for i in range(200)]
    d = zstd.train_dictionary(2048, texts).as_bytes()
    recs = [warc.record_bytes(i, "u", t, 1, False, None) for i, t in enumerate(texts)]
    got = list(warc.read_archive("a", archive(recs, d, compressed)))
    assert [r["payload"] for r in got] == texts and not any(r["error"] for r in got)


def test_broken_records_are_reported():
    ok = warc.record_bytes(1, "u", b"payload", 1, False, None)
    bad = {
        "header": ok.replace(b"WARC-Date", b"WARC Date no colon").replace(b": 1970", b" 1970"),
        "length": ok.replace(b"Content-Length: 7", b"Content-Length: 9"),
        "block": ok[:-4], "digest": ok.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"),
        "version": b"X" + ok,
        "revisit": ok.replace(b"WARC-Type: response", b"WARC-Type: revisit"),
    }
    for name, raw in bad.items():
        got = list(warc.read_archive("a", archive([raw, ok])))
        assert [bool(r["error"]) for r in got] == [True, False], name
    blob = archive([ok, ok])
    cut = list(warc.read_archive("a", blob[:-5]))
    assert [bool(r["error"]) for r in cut] == [False, True]
    assert [bool(r["error"]) for r in warc.read_archive("a", b"junk")] == [True]
    assert list(warc.read_archive("a", b"")) == []
    skipped = list(warc.read_archive("a", ok[:0] + warc.EMPTY_FRAME + blob + warc.EMPTY_FRAME))
    assert len(skipped) == 2 and not any(r["error"] for r in skipped)


def test_query_against_brute_force(spark, sf_small):
    from quarry.llm.queries import op3_warc

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/pages.parquet").select("page_id", "url", "html").collect()]
    got = op3_warc(spark, sf_small)
    assert sorted(got_rows(got), key=str) == sorted(want_rows(rows), key=str)


def test_records_of_other_writers():
    def rec(kind, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0e1d>", "WARC-Date: 2020-01-01T00:00:00Z",
                f"Content-Length: {len(block)}", *more]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    http = "Content-Type: application/http; msgtype=response"
    digest = "WARC-Payload-Digest: sha1:" + warc.base32_sha1(b"body").lower()
    given = [(rec("warcinfo", b"software: x\r\n"), b"software: x\r\n"), (rec("metadata", b"", "Content-Type: text/plain"), b""),
             (rec("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", http), b""),
             (rec("response", b"HTTP/1.1 200 OK\r\n\r\nbody", http, digest), b"body"),
             (rec("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n\r\n", http),
              b"4\r\nbody\r\n0\r\n\r\n"),
             (rec("resource", b"text", "WARC-Payload-Digest: md5:xyz"), b"text")]
    got = list(warc.read_archive("a", archive([r for r, _ in given])))
    assert [(r["payload"], r["error"], r["page_id"]) for r in got] == [(p, None, None) for _, p in given]
    assert all(r["payload_digest"] == warc.base32_sha1(p) for r, (_, p) in zip(got, given, strict=True))
    assert {r["record_id"] for r in got} == {"<urn:uuid:0e1d>"}
    wrong = rec("response", b"HTTP/1.1 200 OK\r\n\r\nBODY", http, digest)
    assert [bool(r["error"]) for r in warc.read_archive("a", archive([wrong]))] == [True]


def test_many_large_pages_send_a_bounded_sample(spark):
    rows = spark.range(0, 3000, 1, 24).select((F.col("id") % 1000).cast("string").alias("page_id"), F.lit("u").alias("url"),
                                              F.concat(F.repeat(F.lit("some words "), 600), "id").alias("html"))
    assert len(warc.train_dictionary(rows, sample=50)) > 1000
    got = warc.round_trip(rows.limit(20).withColumn("page_id", F.concat(F.lit("p"), "page_id"))).collect()
    assert len(got) == 20 and all(r.page_id is None and r.error is None for r in got)
