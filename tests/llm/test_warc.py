"""ARC to WARC: exact round trips and the choice of responses."""

import base64
import gzip
import hashlib

import pyarrow as pa
import pytest

from barlens.llm import warc

SCHEMA = "record_type string, page_id long, url string, html string, payload string"


def brute(rows):
    """Of equal payloads one record of the largest page id is the response, a null id comes last; all others revisit it."""
    groups = {}
    for p, h in rows:
        groups.setdefault((h or "").encode(), []).append(p)
    out = []
    for b, ids in groups.items():
        ids.sort(key=lambda p: (p is None, -(p or 0)))
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out += [(p, len(b), digest, "revisit" if i else "response", ids[0] if i else None) for i, p in enumerate(ids)]
    return sorted(out, key=repr)


def test_round_trip(spark):
    texts = ["", None, "a", "a", "a\r\n\r\nb", "WARC/1.1\r\n\r\n", "é漢😀", "x\n", "\n", "\r", "filedesc://x 1 2 3 5\n", "y" * 300_000, "y" * 300_000, "", " "]
    urls = ["http://a/b", None, "", "http://a/ b\tc", "http://é.x/漢", "-"]
    rows = [("clash", i * 3 - 2, urls[i % len(urls)], t, "p") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in warc.archived(df).collect()), key=repr) == brute([(r[1], r[3]) for r in rows])
    assert warc.archived(df.limit(0)).collect() == []


def test_repeated_rows_and_null_ids(spark):
    rows = [("x", 5, "u", "same", "")] * 3 + [("x", 4, "u", "same", ""), ("x", None, "u", "same", ""), ("x", None, "u", "other", ""), ("x", None, "v", "other", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in warc.archived(df).collect()), key=repr) == brute([(r[1], r[3]) for r in rows])


def test_identifiers_are_unique_and_referred_to(spark, tmp_path):
    rows = [(p, "u", "1.2.3.4", "19990101000000", "text/html", b) for p, b in [(5, b"same")] * 40 + [(6, b"one"), (6, b"one"), (7, b"two"), (None, b"two")]]
    warc.write_arc(spark.createDataFrame(rows, warc.RECORD).repartition(5), str(tmp_path / "a"))
    out = warc.to_warc(warc.read_arc(spark, str(tmp_path / "a"))).collect()
    assert len({r.record_id for r in out}) == len(rows) == len(out)
    first = {r.record_id: r for r in out if r.record_type == "response"}
    assert len(first) == 3 and all(r.payload_digest == first[r.refers_to_id].payload_digest for r in out if r.record_type == "revisit")
    assert {bytes(r.payload) for r in first.values()} == {b"same", b"one", b"two"}
    kept = warc.to_warc(warc.read_arc(spark, str(tmp_path / "a")), smallest=4).collect()
    assert sorted(bytes(r.payload) for r in kept if r.record_type == "response") == [b"one"] * 2 + [b"same"] + [b"two"] * 2


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 100_000)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 50)
    rows = [(i, "u", "1.2.3.4", "19990101000000", "text/html", bytes([65 + i % 20]) * (1500 if i % 7 else 40_000)) for i in range(300)] + [
        (999, "u", None, "1999", None, b"z" * 250_000)]
    warc.write_arc(spark.createDataFrame(rows, warc.RECORD).coalesce(1), str(tmp_path / "a"), records_per_file=50)
    sizes = [[len(r["payload"]) for r in warc.parse_arc(open(f, "rb").read())] for f in (tmp_path / "a").rglob("part-*")]
    assert sum(map(len, sizes)) == 301 and max(map(len, sizes)) <= 50
    assert all(sum(s) <= 100_000 or len(s) == 1 for s in sizes)
    got = sorted((r.page_id, bytes(r.payload)) for r in warc.read_arc(spark, str(tmp_path / "a")).collect())
    assert got == sorted((r[0], r[5]) for r in rows)


def test_a_damaged_payload_is_found():
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc._warc_records(True)([pa.RecordBatch.from_arrays([pa.array([raw])], ["content"])]))


def test_parse_versions():
    v1 = b"filedesc://f.arc 0.0.0.0 19970101000000 text/plain 14\n1 0 x\nURL IP\n\nhttp://a b/ 1.2.3.4 19970102030405 text/html 5\nab\ncd\nhttp://c 1.2.3.4 1997 no-type 0\n\n"
    v2 = (b"filedesc://f.arc 0.0.0.0 19970101000000 text/plain 200 - - 0 f.arc 14\n2 0 x\nURL IP\n\nnot a header\n"
          b"http://d 1.2.3.4 19980102030405 text/html 200 - - 9 p7 3\r\n\n\n\n\n")
    for raw in (v1 + v2, gzip.compress(v1) + gzip.compress(v2)):
        out = list(warc.parse_arc(raw))
        assert [r["payload"] for r in out] == [b"ab\ncd", b"", b"\n\n\n"]
        assert [r["url"] for r in out] == ["http://a b/", "http://c", "http://d"] and out[2]["filename"] == "p7" and out[2]["result_code"] == "200"


def test_pieces():
    raw = gzip.compress(b"WARC/1.1\r\nContent-Length: 100000\r\n\r\n" + b"z" * 100_000 + b"\r\n\r\n") * 3
    assert [len(p) for _, p in warc.parse_warc(raw)] == [100_000] * 3


@pytest.mark.parametrize("version", [1, 2])
def test_interfaces(spark, version, tmp_path):
    rows = [(i, f"http://h/{i}", "1.2.3.4", "2001020304050%d" % (i % 10), "text/html", bytes([i, 10, 13, 255])) for i in range(20)]
    df = spark.createDataFrame(rows, warc.RECORD)
    warc.write_arc(df, str(tmp_path / "a"), records_per_file=3, version=version)
    assert sorted(tuple(r) for r in warc.read_arc(spark, str(tmp_path / "a")).collect()) == rows
    w = warc.to_warc(warc.read_arc(spark, str(tmp_path / "a")))
    warc.write_warc(w, str(tmp_path / "w"), records_per_file=4)
    back = sorted((tuple(r) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()), key=repr)
    assert back == sorted((tuple(r) for r in w.collect()), key=repr) and back[0][3].startswith("2001-02-03T04:05:0")


def test_table(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in warc.op9_warc(spark, sf).collect()), key=repr) == brute(rows)
