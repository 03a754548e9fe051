import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from cladewright.llm import warc

PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, "http://c", None), (4, "http://d", ""), (5, None, "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n"), (6, "http://e", "ü" * 50_000), (6, "http://f", "tie"), (6, "http://g", "tie"), (7, "http://h", "dup"), (7, "http://h", "dup")]


def test_round_trip(spark, monkeypatch):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("body", "content", "n", "x", "of")})
    monkeypatch.setattr(warc, "table", lambda *_: df)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op2_warc(spark, "").collect())
    want, last = [], {}
    for p, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", 0), p)
    answered = set()
    for p, u, h in sorted(PAGES, key=lambda x: (x[0], x[1] or "")):
        raw = (h or "").encode()
        again = p < last[h or ""] or h in answered
        answered |= {h} if p == last[h or ""] else set()
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_captures_nest_their_records(spark):
    df = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string")
    rows = warc.assemble(warc.read_records(spark, warc.write_archives(df, gzip=False))).collect()
    assert len(rows) == 3 and all(len(r.request) == 1 and len(r["metadata"]) == 1 and r.response for r in rows)


def test_reader_takes_members_and_orphans(spark, tmp_path):
    record = lambda kind, i, to, block: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{i}>\r\n" + (f"WARC-Concurrent-To: <{to}>\r\n" if to else "") + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    parts = [record("warcinfo", "w", None, b"i"), record("response", "r", None, b"p"), record("metadata", "m", "q", b"n"), record("request", "q", "r", b"g"), record("request", "lost", "gone", b"g")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts) + gzip.compress(b"WARC/1.0\r\ncut"))
    rows = {r.capture_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert set(rows) == {"<r>", "<gone>"}
    assert len(rows["<r>"].request) == 1 and len(rows["<r>"]["metadata"]) == 1 and rows["<gone>"].response is None


def test_empty(spark, monkeypatch):
    monkeypatch.setattr(warc, "table", lambda *_: spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.op2_warc(spark, "").count() == 0


def test_concurrent_to_of_all_records_in_both_directions(spark, tmp_path):
    def record(kind, i, *to):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{i}>\r\n" + "".join(f"WARC-Concurrent-To: <{x}>\r\n" for x in to) + "Content-Length: 1\r\n\r\nx\r\n\r\n").encode()

    parts = [
        record("request", "q1"), record("response", "r1", "q1"), record("metadata", "m1", "q1"),  # the response names its request
        record("request", "q2", "r2"), record("revisit", "r2", "q2"), record("metadata", "m12", "r1", "q2"),  # both; one of several captures
        record("metadata", "m3", "m4"), record("metadata", "m4", "q3"), record("request", "q3", "r3"), record("response", "r3"),  # a chain
        record("metadata", "m5", "q5", "r5"), record("request", "q5"), record("response", "r5"),  # a request that metadata alone names
        record("metadata", "m6", "q6"), record("request", "q6"), record("metadata", "m7", "m8"), record("metadata", "m8", "m7"),  # no response
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    rows = warc.assemble(warc.read_records(spark, str(tmp_path))).collect()
    got = {r.capture_id: (r.response is not None, sorted(x.record_id for x in r.request or []), sorted(x.record_id for x in r["metadata"] or [])) for r in rows}
    assert len(got) == len(rows)
    assert got == {
        "<r1>": (True, ["<q1>"], ["<m12>", "<m1>"]), "<r2>": (True, ["<q2>"], ["<m12>"]), "<r3>": (True, ["<q3>"], ["<m3>", "<m4>"]),
        "<r5>": (True, ["<q5>"], ["<m5>"]), "<q6>": (False, ["<q6>"], ["<m6>"]), "<m7>": (False, [], ["<m7>", "<m8>"]),
    }


def test_odd_urls_lose_no_page(spark, monkeypatch):
    urls = ["a\r\n\r\nb", "a\nWARC/1.1", "\r", "x: y", "Content-Length: 3\r\nContent-Length: 4", "", None, "\u2028", "é\x00"]
    pages = [(i, u, f"<p>{i // 2}</p>\r\n\r\n") for i, u in enumerate(urls)] + [(20, "long", "WARC/1.1\r\n" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    monkeypatch.setattr(warc, "table", lambda *_: df)
    got = {r.page_id: r for r in warc.op2_warc(spark, "").collect()}
    assert len(got) == len(pages)
    for i, _, h in pages:
        twin = i % 2 == 0 and i + 1 < len(urls)
        assert (got[i].payload_bytes, got[i].refers_to) == (len(h), i + 1 if twin else None)


def test_reader_goes_on_after_a_broken_record(spark, tmp_path):
    good = lambda i: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n".encode()
    broken = [b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno length\r\n\r\n", b"WARC/1.1\r\nContent-Length: 99999\r\n\r\ntoo long\r\n\r\n", b"noise\r\n\r\n", b"WARC/1.1\r\nContent-Length: 7"]
    (tmp_path / "a.warc").write_bytes(good(1) + broken[0] + good(2) + broken[1] + good(3) + broken[2] + good(4) + broken[3])
    found = warc.read_records(spark, str(tmp_path))
    assert found.filter("warc_type = 'broken'").count() == 4
    rows = warc.assemble(found).collect()
    assert sorted(r.capture_id for r in rows) == ["<1>", "<2>", "<3>", "<4>"]
