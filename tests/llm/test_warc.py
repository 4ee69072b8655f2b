"""WARC archives: round trip at any split, records inside records, broken members, edge cases."""

import base64
import gzip
import hashlib
import random
import zlib
from pathlib import Path

import pytest

from storylake.llm import warc

PAGES = "page_id long, url string, html string, kind string"


def plain(rows, least=0):
    by = {}
    for i, _, html, _ in rows:
        if i is not None:
            by[html or ""] = min(i, by.get(html or "", i))
    out = []
    for i, _, html, _ in rows:
        data, first = (html or "").encode(), by.get(html or "")
        again = len(data) >= least and first is not None and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    body = lambda: "<p>" + "".join(rnd.choices("abcdé名 \r\n", k=rnd.randint(0, 900))) + "</p>"
    made = [(i, f"http://x/{i}", body(), "k") for i in range(120)]
    made += [(200 + i, f"http://y/{i}", made[i % 3][2], None) for i in range(40)]
    made += [(300, None, None, None), (301, "", "", None), (302, "http://z/\r\nWARC-Type: request\r\n\r\nx", "\r\n\r\nWARC/1.1\r\n", None), (None, "n", "only here", None), (None, "n", made[0][2], None)]
    return made + [made[0], made[5], (303, "long", "x" * 3_000_000, None)]


@pytest.mark.parametrize("least, split", [(0, 64 << 20), (0, 700), (400, 50_000)])
def test_round_trip(spark, rows, least, split):
    found = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3), least=least, split=split).collect()
    assert all(r.intact is not False for r in found)
    assert sorted(str(tuple(r)[:5]) for r in found) == plain(rows, least)


def test_payloads_and_addresses(spark, rows, tmp_path):
    warc.write_warc(spark.createDataFrame(rows, PAGES), str(tmp_path / "a"))
    found = {r.page: r for r in warc.read_warc(spark, str(tmp_path / "a"), split=5_000).where("type = 'response'").collect()}
    assert found["302"].payload == rows[-6][2].encode() and found["302"].url == "http://z/%0D%0AWARC-Type: request%0D%0A%0D%0Ax" and found["300"].url is None
    for file in (tmp_path / "a").iterdir():  # a plain reader of gzip sees the same records
        assert gzip.decompress(file.read_bytes()).count(b"WARC/1.1\r\nWARC-Type: ") >= 1


def test_records_inside_records_and_broken_members(spark, tmp_path):
    inner = b"".join(warc.member(warc.record(str(i), "in", b"inner %d" % i, "response", None)) for i in range(40))
    whole = warc.record("outer", "http://o", inner, "response", None)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # not compressed, so that its payload's members stand in the file as they are
    outer = stored.compress(whole) + stored.flush()
    after = [warc.member(warc.record(f"a{i}", None, b"z" * i, "response", None)) for i in range(5)]
    broken = bytearray(after[0])
    broken[-6] ^= 1  # its checksum
    data = after[1] + outer + b"junk\x1f\x8b\x08" + after[2] + bytes(broken) + gzip.compress(b"no record") + after[3] + after[4][:-9]
    (tmp_path / "x.warc.gz").write_bytes(data)
    for split in (300, 1_111, 1 << 20):
        found = warc.outermost(warc.read_warc(spark, str(tmp_path), split=split), split).collect()
        assert sorted(r.page for r in found) == ["a1", "a2", "a3", "outer"]
    assert any(r.page == "20" for r in warc.read_warc(spark, str(tmp_path), split=300).collect())
    (here,) = [r for r in found if r.page == "outer"]
    assert here.payload == inner and here.end - here.offset == len(outer) and here.intact


def test_empty_tables_and_odd_names(spark, tmp_path):
    empty = spark.createDataFrame([], PAGES)
    assert warc.round_trip(empty).collect() == []
    odd = spark.createDataFrame([("a b", "u", "x", 1), ("a c", "u", "x", 1)], "`page id` string, first string, `the html` string, kind int")
    found = sorted(map(tuple, warc.round_trip(odd, "page id", "first", "the html").collect()))
    assert [(r[0], r[3], r[4]) for r in found] == [("a b", "response", None), ("a c", "revisit", "a b")]
    assert not list(Path(tmp_path).iterdir())
