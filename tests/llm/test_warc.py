"""ZIP-packaged WARC archives: packages of any shape, and records back by ranges."""

import base64
import gzip
import hashlib
import io
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from panelspark.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [(1, "http://a.org/x", "<p>one</p>"), (2, None, None), (3, "http://b.org/ü x\r\ny", ""), (4, "http://a.org/x", "<p>one</p>"), (5, "u", "gründe\r\n\r\nWARC/1.1 \x00"), (None, "n", "<p>one</p>"), (None, None, "none"),
        (7, "v", "twice"), (7, "v", "twice"), (8, "long", "x y " * 200_000), (-9, "w", "<p>one</p>")] + [(100 + i, f"h{i}", "hot") for i in range(200)]


def name(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize(("zip64", "records"), [(True, 7), (False, 100_000)])
def test_round_trip(spark, tmp_path, zip64, records):
    df = spark.createDataFrame(ROWS, PAGES).withColumns({"digest": F.lit(1), "row": F.lit(2), "maybe": F.lit(3), "payload": F.lit(4)}).repartition(3)
    made = warc.write(df, f"file://{tmp_path}/w", zip64=zip64, package_records=records)
    sums = made.agg(F.sum("records").alias("n"), F.count("package").alias("k"), F.max("records").alias("most")).first()
    assert sums.n == len(ROWS) and sums.most <= records and (sums.k > 20) == zip64
    got = warc.read(made).collect()
    assert len(got) == len(ROWS)
    last = {}
    for page_id, _, html in ROWS:
        own = last.get(html or "")
        last[html or ""] = page_id if own is None or (page_id is not None and page_id > own) else own
    text = {name(h): (h or "") for _, _, h in ROWS}
    for g in got:
        html = text[g.payload_digest]
        assert g.payload_bytes == len(html.encode())
        if g.record_type == "response":
            assert g.page_id == last[html] and g.refers_to is None and bytes(g.payload) == html.encode()
        else:
            assert g.record_type == "revisit" and g.refers_to == last[html] and g.payload is None
    assert sum(g.record_type == "response" for g in got) == len(text) == len({g.record_id for g in got if g.record_type == "response"}) and len({g.record_id for g in got}) == len(ROWS)
    assert {g.refers_to_record for g in got} - {None} <= {g.record_id for g in got if g.record_type == "response"}
    assert sorted((g.page_id or 0, g.url or "") for g in got) == sorted((p or 0, u or "") for p, u, _ in ROWS)
    assert {g.payload for g in warc.read(made, payload=False).collect()} == {None}


def test_short_payloads_are_all_responses(spark, tmp_path):
    got = warc.read(warc.write(spark.createDataFrame(ROWS, PAGES), f"file://{tmp_path}/w", least_bytes=6)).collect()
    assert all(g.record_type == "response" for g in got if g.payload_bytes < 6) and sum(g.record_type == "revisit" for g in got) == 3


def test_empty_table(spark):
    made = warc.write(spark.createDataFrame([], PAGES))
    assert made.count() == 0 and warc.read(made).count() == 0


def test_other_readers_read_the_packages(spark, tmp_path):
    """zipfile and gzip, which know nothing of this reader, find stored members and whole records."""
    made = warc.write(spark.createDataFrame(ROWS[:5], PAGES).coalesce(1), f"file://{tmp_path}/w").collect()
    raw = []
    for m in made:
        with zipfile.ZipFile(m.package.removeprefix("file://")) as z:
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED} and z.testzip() is None
            raw.append(gzip.decompress(z.read("archive/data.warc.gz")))
    assert all(x.startswith(b"WARC/1.1\r\n") for x in raw) and [b"".join(raw).count(b"WARC-Type: " + t) for t in (b"response", b"revisit")] == [3, 2]


def record(page_id, html):
    return gzip.compress(warc.record({"page_id": page_id, "url": "u", "payload": html, "payload_bytes": len(html), "digest": hashlib.sha1(html).digest(), "mark": "", "refers_id": None, "refers_mark": None}))


def package(path, compress=zipfile.ZIP_STORED, comment=b"", members=("archive/a.warc.gz", "archive/b.warc.gz")):
    with zipfile.ZipFile(path, "w", compress) as z:
        z.writestr("readme", "nothing")
        for k, m in enumerate(members):
            z.writestr(m, b"".join(record(10 * k + i, b"page %d" % i * (i * 900)) for i in range(4)))
        z.comment = comment


def test_archives_without_index_and_with_comment(spark, tmp_path):
    """Foreign packages: no index, two archives, and a comment that looks like an end of directory."""
    package(tmp_path / "p.wacz", comment=b"x PK\x05\x06" + b"z" * 40_000)
    got = warc.read(spark.createDataFrame([(f"file://{tmp_path}/p.wacz",)], "package string")).collect()
    assert sorted(g.page_id for g in got) == [0, 1, 2, 3, 10, 11, 12, 13] and all(g.payload_bytes == len(g.payload) for g in got)


def test_bad_packages_are_errors(spark, tmp_path):
    package(tmp_path / "deflated.wacz", zipfile.ZIP_DEFLATED)
    (tmp_path / "none.wacz").write_bytes(b"no zip")
    package(tmp_path / "cut.wacz")
    raw = (tmp_path / "cut.wacz").read_bytes()
    (tmp_path / "cut.wacz").write_bytes(raw[: len(raw) // 2])
    package(tmp_path / "changed.wacz", members=("archive/a.warc.gz",))
    raw = (tmp_path / "changed.wacz").read_bytes()
    bad = warc.record({"page_id": 1, "url": "u", "payload": b"right", "payload_bytes": 5, "digest": hashlib.sha1(b"wrong").digest(), "mark": "", "refers_id": None, "refers_mark": None})
    with pytest.raises(warc.BadPackage, match="differ"):
        warc.parse(bad)
    for name_, why in (("deflated", "not stored"), ("none", "end of central"), ("cut", "end of central")):
        with pytest.raises(Exception, match=why):
            warc.read(spark.createDataFrame([(f"file://{tmp_path}/{name_}.wacz",)], "package string")).collect()


def test_zip64_directory_beyond_32_bits():
    """A directory whose places need 64 bits, laid out by hand around a hole that is never read."""
    big, name_, size = 5 << 30, b"archive/x.warc.gz", 6 << 30
    extra = struct.pack("<HHQQQ", 1, 24, size, size, big)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name_), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name_ + extra
    start = big + size + 100
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, start + len(entry), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    tail = entry + end64 + locator + end

    class Hole(io.RawIOBase):
        def seek(self, at, whence=0):
            self.at = at

        def read(self, n=-1):
            begin = self.at - start
            assert begin >= -warc.LONGEST_COMMENT - 100
            return b"\0" * max(0, min(n, -begin)) + tail[max(0, begin) : max(0, begin + n)]

    assert warc.directory(Hole(), start + len(tail)) == [(name_.decode(), 0, size, size, big)]


def test_query_by_hand(spark, tmp_path):
    from panelspark.llm.queries_warc import op11_warc

    own = [x for x in ROWS if x[0] not in (None, 7)]
    os.makedirs(tmp_path / "sf")
    spark.createDataFrame(own, PAGES).write.parquet(f"{tmp_path}/sf/pages.parquet")
    got = {g.page_id: tuple(g) for g in op11_warc(spark, f"{tmp_path}/sf").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    last = {}
    for page_id, _, html in own:
        last[name(html)] = max(page_id, last.get(name(html), page_id))
    assert got == {p: (p, len((h or "").encode()), name(h), "response" if last[name(h)] == p else "revisit", None if last[name(h)] == p else last[name(h)]) for p, _, h in own}
