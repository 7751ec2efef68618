import gzip
import hashlib
import io

from narrata.llm import warc as W

PAGES = [
    (1, "http://x/1", "a" * 200),
    (3, "http://x/3", "a" * 200),
    (2, "http://x/2 b\r\nc", "a" * 200),
    (4, "http://x/4", "é" * 50),
    (5, None, "é" * 50),
    (6, "u", "short"),
    (7, "u", "short"),
    (8, "u", None),
    (9, "u", ""),
    (None, "u", "a" * 200),
    (1, "http://x/1", "a" * 200),
]


def brute(pages):
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        same = [j for j, _, g in pages if (g or "").encode() == data and j is not None]
        first = min(same) if len(data) >= 100 and same else None
        again = i is not None and first is not None and i > first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string")
    path = W.new_archive(spark)
    W.write_archive(df, path)
    assert sorted((tuple(r) for r in W.archived(spark, path).collect()), key=str) == brute(PAGES)
    full = W.read_archive(spark, path)
    assert {bytes(r.payload).decode() for r in full.where("page_id = 4").collect()} == {"é" * 50}
    assert {r.url for r in full.where("page_id = 2").collect()} == {"http://x/2%20b%0D%0Ac"}
    assert full.where("record_type = 'revisit' AND page_id > 2").count() == 2
    assert full.where("url LIKE 'http://x/%' AND declared_bytes >= 150").count() == 4
    empty = W.new_archive(spark)
    W.write_archive(df.limit(0), empty)
    assert W.archived(spark, empty).count() == 0


def test_pushed_filters_leave_blocks_unread():
    rows = [dict(page_id=i, url="u", payload=b"x" * 5000, payload_bytes=5000, payload_digest="d", refers_to=None, date="z") for i in range(20)]
    for make, parse in ((W.record, W.plain_records), (lambda r: W.gzip_member(W.record(r), 3), W.gzip_records), (lambda r: gzip.compress(W.record(r)), W.gzip_records)):
        data = b"".join(make(r) for r in rows)
        got = [(h["x-page-id"], W.payload_of(h, b()) if int(h["x-page-id"]) % 3 == 0 else None) for h, b in parse(W.Buffered(io.BytesIO(data), 512))]
        assert [g[0] for g in got] == [str(i) for i in range(20)] and all(p == b"x" * 5000 for i, p in got if int(i) % 3 == 0)
    assert gzip.decompress(b"".join(W.gzip_member(W.record(r), 3) for r in rows)) == b"".join(map(W.record, rows))
    reader = W.WarcReader({"path": "/x"})
    left = list(reader.pushFilters([W.EqualTo(("record_type",), "revisit"), W.EqualTo(("payload",), b"")]))
    assert len(left) == 1 and not reader.wanted({"warc-type": "response"}) and reader.wanted({"warc-type": "revisit"})


def test_appends_are_all_read_and_overwrite_replaces(spark, tmp_path):
    W.register(spark)
    path = str(tmp_path / "w")
    pages = lambda *ids: spark.createDataFrame([(i, f"http://x/{i}", "t" * 150 + str(i)) for i in ids], "page_id long, url string, html string")
    W.write_archive(pages(1, 2), path)
    W.write_archive(pages(3), path)
    assert sorted(r.page_id for r in W.archived(spark, path).collect()) == [1, 2, 3]
    rows = spark.read.format("warc").load(path)
    kept = rows.where("page_id = 3")
    assert kept.count() == 1


def test_damaged_messages():
    assert W.payload_of({"content-type": "application/http; msgtype=response"}, b"HTTP/1.1 200 OK\r\nA: b") == b""
    assert W.payload_of({"content-type": "application/http"}, b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\nmore") == b"body\r\n\r\nmore"


def test_overwrite_takes_the_place_of_all_before(spark, tmp_path):
    path = str(tmp_path / "w")
    W.write_archive(spark.createDataFrame([(1, "u", "t")], "page_id long, url string, html string"), path)
    W.WarcWriter({"path": path}, overwrite=True).commit([W.Written([])])
    assert W.archived(spark, path).count() == 0 and not list(tmp_path.glob("w/*.warc*"))
