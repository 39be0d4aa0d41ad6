import io
import struct
import zipfile

import pytest

from factloom.llm import warc
from factloom.llm.common import shared_path


@pytest.fixture
def pages(spark):
    same = "<p>" + "equal " * 40
    rows = [(4, "http://a/%\r\n", same), (2, "http://b", same), (9, None, same), (1, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""),
            (None, "u", same), (10, "u", "é" * 60), (11, "v", "é" * 60), (11, "v", "é" * 60), (12, "u", "x" * 3_000_000)]
    return spark.createDataFrame([(*r, 1, "p") for r in rows], "page_id long, url string, html string, row int, payload string")


def test_round_trip(spark, pages):
    got = warc.archive_round_trip(spark, pages).collect()
    assert len(got) == 12
    by = {r.page_id: r for r in got if r.page_id != 11}
    assert by[4].url == "http://a/%\r\n" and by[9].url is None
    assert by[2].record_type == "response" and [by[k].refers_to for k in (4, 9, None)] == [2, 2, 2]
    assert all(by[k].record_type == "response" for k in (1, 6, 7, 8, 10, 12))
    assert by[7].payload_bytes == 0 and by[12].payload_bytes == 3_000_000 and bytes(by[12].payload) == b"x" * 3_000_000
    assert [(r.record_type, r.refers_to, r.payload_bytes) for r in got if r.page_id == 11] == [("revisit", 10, 120)] * 2


def test_equal_ids_have_one_response(spark):
    rows = spark.createDataFrame([(1, "u", "a" * 200)] * 3, "page_id long, url string, html string")
    assert sorted(r.record_type for r in warc.archive_round_trip(spark, rows).collect()) == ["response", "revisit", "revisit"]


def test_no_pages(spark, pages):
    assert warc.archive_round_trip(spark, pages.filter("false")).collect() == []


def test_small_packages(spark, pages):
    manifest = warc.write_archives(pages, shared_path(spark, "archives"), package_bytes=200)
    assert manifest.count() > 3
    assert warc.read_archives(manifest).count() == 12


def test_zip64_directories(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = f"{tmp_path}/x.wacz"
    package = warc._Package(path)
    for k in range(5):
        payload = b"payload %d" % k
        import hashlib

        digest = hashlib.sha256(payload).hexdigest()
        package.add(k, "u", "response", digest, warc.record(k, "u", payload, len(payload), digest, None, False))
    package.close()
    data = open(path, "rb").read()
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    got = list(warc.package_records(path))
    assert [r["payload"] for r in got] == [b"payload %d" % k for k in range(5)]


def test_large_fields_come_from_the_zip64_extra():
    """A directory whose 32-bit fields are all full."""
    name = b"archive/data.warc.gz"
    extra = struct.pack("<HHQQQ", 1, 24, 7_000_000_000, 7_000_000_001, 5_000_000_000)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 2**32 - 1, 2**32 - 1, len(name), len(extra), 0, 0, 0, 0, 2**32 - 1) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), 0)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 65535, 65535, 2**32 - 1, 2**32 - 1, 4) + b"note"
    data = entry + end64 + locator + end
    assert warc.central_directory(io.BytesIO(data), len(data)) == {name.decode(): (0, 7_000_000_001, 5_000_000_000)}


def test_damage_is_found(tmp_path):
    path = f"{tmp_path}/x.wacz"
    package = warc._Package(path)
    package.add(1, "u", "response", "0" * 64, warc.record(1, "u", b"text", 4, "0" * 64, None, False))
    package.close()
    with pytest.raises(ValueError, match="damaged payload"):
        list(warc.package_records(path))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.ARCHIVE, "x" * 100)
        z.writestr(warc.INDEX, "")
    with pytest.raises(ValueError, match="compressed"):
        list(warc.package_records(path))
