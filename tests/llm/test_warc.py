"""Operator 1."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import queries, warc
from weftline.session import table


def test_record_round_trip():
    raw = warc.record_bytes([("WARC-Type", "response"), ("WARC-Target-URI", "http://a/\r\nb"), ("X-None", None)], b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n")
    fields, block = warc.parse_record(raw)
    assert fields["warc-target-uri"] == "http://a/%0D%0Ab" and "x-none" not in fields
    assert warc.http_payload(block) == (b"HTTP/1.1 200 OK\r\n\r\n", b"body\r\n\r\n")
    with pytest.raises(ValueError):
        warc.parse_record(raw[:-10])
    with pytest.raises(ValueError):
        warc.parse_record(b"junk\r\n\r\n")


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, file string")


def plain(rows, min_bytes):
    best = {}
    for k, _, t in rows:
        body = (t or "").encode()
        if len(body) >= min_bytes:
            best[body] = max(best.get(body, -1), -1 if k is None else k)
    out = []
    for k, _, t in rows:
        body = (t or "").encode()
        top = best.get(body)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((k, len(body), digest, "response" if top is None or top == k else "revisit", None if top is None or top == k else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_pages(spark, min_bytes, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 4)
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(["a", "same text é", None, "", "same text é", "\r\n\r\nWARC/1.1\r\n", "same text é", "b" * 100_000, "abcd", "abcd"])]
    rows.append((77, None, "same text é"))
    files = warc.deduplicated_archives(pages(spark, rows), min_bytes=min_bytes)
    back = warc.read_archives(warc.spread(files, spark), with_payload=True).collect()
    got = sorted(((r["key"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in back), key=str)
    assert got == plain(rows, min_bytes)
    texts = {k: (t or "").encode() for k, _, t in rows}
    assert all(bytes(r["payload"]) == (texts[r["key"]] if r["record_type"] == "response" else b"") for r in back)
    assert all(r["url"] == f"http://h/{r['key']}" for r in back if r["key"] != 77)


def test_repeated_rows_null_keys_and_no_rows(spark):
    rows = [(1, "u", "x")] * 3 + [(None, None, "x"), (None, None, None)]
    back = warc.read_archives(warc.deduplicated_archives(pages(spark, rows))).collect()
    assert len(back) == 5 and sum(r["record_type"] == "response" for r in back) == 2
    assert {r["refers_to"] for r in back if r["record_type"] == "revisit"} == {1}
    assert warc.read_archives(warc.deduplicated_archives(pages(spark, []))).count() == 0


def test_revisits_in_the_input(spark):
    ddl = warc.INDEX
    row = lambda key, kind, digest: ("f", key, f"<{key}>", key, "u", "d", kind, digest, 9, None)
    index = spark.createDataFrame([row(1, "response", "A"), row(2, "revisit", "A"), row(3, "revisit", "B"), row(4, "response", "A")], ddl)
    got = {r["key"]: (r["new_type"], r["original_key"]) for r in warc.resolve(index).collect()}
    assert got == {1: ("revisit", 4), 2: ("revisit", 4), 3: ("revisit", None), 4: ("response", None)}


def test_archives_are_gzip_members_and_damage_shows(spark, tmp_path):
    files = warc.deduplicated_archives(pages(spark, [(1, "u", "text"), (2, "v", "text")]).coalesce(1)).collect()
    found = [f["file"] for f in files]
    path = found[0].removeprefix("file://")
    data = gzip.open(path).read()
    assert data.count(b"WARC/1.1\r\n") == 3 and b"WARC-Profile" in data and b"WARC-Refers-To-Target-URI: v" in data
    offsets = [at for at, _ in warc.members(found[0])]
    raw = open(path, "rb").read()
    assert all(raw[at : at + 2] == b"\x1f\x8b" for at in offsets)
    cut = tmp_path / "cut.warc.gz"
    cut.write_bytes(raw[:-20])
    with pytest.raises(ValueError):
        list(warc.members(f"file://{cut}"))


def test_wrong_digest_shows(spark, tmp_path):
    a = warc.Archive(f"file://{tmp_path}")
    a.add(warc._fields("response", "<r>", 1, "u", "d", "WRONG", 4), b"HTTP/1.1 200 OK\r\n\r\nbody", 4)
    a.close()
    with pytest.raises(Exception, match="does not match"):
        warc.read_archives(spark.createDataFrame([(a.path,)], "file string")).collect()


def test_query(spark, sf, sql, same):
    got = queries.QUERIES["op1_warc_revisits"](spark, sf)
    same(got.toPandas(), sql(queries.SQL["op1_warc_revisits"]))
    assert got.count() == table(spark, sf, "pages").select(F.col("page_id")).count()
