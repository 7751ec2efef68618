"""The state machine, files and archives on small inputs."""

import io
import zipfile

from pyspark.sql import functions as F

from narrata.operators import jobs as J
from narrata.sources import files as S


def test_guards():
    s = None
    for op, want in (("progress", None), ("create", "pending"), ("pause", "pending"), ("start", "running"), ("create", "running"), ("pause", "paused"), ("progress", "paused"), ("resume", "pending"), ("complete", "completed"), ("cancel", "completed"), ("fail", "failed")):
        s, _, _ = J.next_state(s, 0.0, op, 0.5)
        assert s == want, op
    assert J.next_state("running", 0.2, "progress", 7.0) == ("running", 1.0, True)
    assert J.next_state("paused", 0.2, "progress", 0.5) == ("paused", 0.2, False)


def test_fold_equals_the_step_function(spark):
    import random

    rnd = random.Random(1)
    ops = ["create", "start", "progress", "pause", "resume", "cancel", "complete", "fail"]
    rows = [(f"j{rnd.randrange(40)}", 1, i // 3, i, rnd.choice(ops), rnd.random() * 1.5 - 0.2) for i in range(900)]
    df = spark.createDataFrame(rows, "job_id string, session_id long, ts long, seq long, op string, progress double")
    want = {}
    for job, _, _, _, op, p in rows:
        state, progress, good, bad = want.get(job, (None, 0.0, 0, 0))
        state, progress, ok = J.next_state(state, progress, op, p)
        want[job] = (state, progress, good + ok, bad + (not ok))
    got = {r.job_id: (r.status, r.progress, r.accepted, r.rejected) for r in J.fold_events(df).collect()}
    assert got == want


def test_templates(spark):
    jobs = spark.createDataFrame([("a", "completed", '{"title":"T \\"x\\"","output":"O"}'), ("b", "failed", None), ("c", "completed", '{"k":"v"}')], "job_id string, status string, result string")
    payloads = spark.createDataFrame([("1", '{"x":"{{a.result.title}} {{a.result}}"}'), ("2", '{"x":["{{b.result}}"]}'), ("3", '{"x":"{{c.result.none}}"}'), ("4", "{}")], "job_id string, payload string")
    got = {r.job_id: (r.payload, r.error) for r in J.resolve_templates(payloads, jobs).collect()}
    assert got == {"1": ('{"x":"T \\"x\\" O"}', None), "2": (None, "Dependency b not completed"), "3": ('{"x":""}', None), "4": ("{}", None)}


def test_session_links(spark):
    t = F.lit("2024-01-01").cast("timestamp")
    links = spark.createDataFrame([(1, 10), (2, 20)], "user_id long, session_id long").withColumn("expires_at", t)
    seen = spark.createDataFrame([(1, 10), (3, 30)], "user_id long, session_id long").withColumn("at", t)
    got = {r.user_id: str(r.expires_at)[:10] for r in J.link_sessions(links, seen).collect()}
    assert got == {1: "2024-03-31", 2: "2024-01-01", 3: "2024-03-31"}


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


EPUB = {
    "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/a.opf"/></rootfiles></container>',
    "OEBPS/a.opf": """<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Book</dc:title></metadata>
<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="chapter01" href="c1.xhtml" media-type="application/xhtml+xml"/>
<item id="chapter02" href="c2.xhtml" media-type="application/xhtml+xml"/><item id="pic" href="p.png" media-type="image/png"/></manifest>
<spine><itemref idref="chapter01"/><itemref idref="chapter02" linear="no"/><itemref idref="pic"/><itemref idref="gone"/></spine></package>""",
    "OEBPS/nav.xhtml": '<html xmlns="http://www.w3.org/1999/xhtml"><body><nav><a href="c1.xhtml#x">First</a><a href="c1.xhtml#y">Second</a></nav></body></html>',
    "OEBPS/c1.xhtml": "<html><body><p>One</p></body></html>",
    "OEBPS/c2.xhtml": "<html><body><p>Two</p></body></html>",
}
DOCX = {"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>there</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>End</w:t><w:br/></w:r></w:p></w:body></w:document>'}


def test_files(spark, tmp_path):
    (tmp_path / "a.EPUB").write_bytes(archive(EPUB))
    (tmp_path / "b.docx").write_bytes(archive(DOCX))
    (tmp_path / "c.epub").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes("naïve".encode("latin-1"))
    (tmp_path / "e.txt").write_bytes("naïve".encode("utf-16"))
    (tmp_path / "f.mp3").write_bytes(b"x")
    (tmp_path / "deep").mkdir()
    files = S.scan_corpus(spark, str(tmp_path))
    assert sorted(r.path[-6:] for r in files.select("path").collect()) == sorted(["a.EPUB", "b.docx", "c.epub", "/d.txt", "/e.txt"])
    entries = S.read_epub(files.where("format = 'epub'"))
    good = entries.where("error IS NULL")
    assert entries.where("error IS NOT NULL").count() == 1 and good.count() == 3
    read = S.chapter_titles(S.linear_spine(good)).collect()
    assert [(r.item_id, r.title_read, r.author) for r in read] == [("chapter01", "Second", "Unknown")]
    titled = S.chapter_titles(good.where("item_id = 'chapter02'")).first()
    assert titled.title_read == "Chapter 2"
    text = S.read_docx(files.where("format = 'docx'")).first()
    assert text.text == "Hello\tthere\n\nEnd\n\n"
    assert {r.t for r in files.where("format = 'txt'").select(S.decode_text(F.col("content")).alias("t")).collect()} == {"naïve"}


def test_sectioned_text(spark, tmp_path):
    (tmp_path / "s.md").write_text("# Book\n\nIntro\n\n---\n\n## One\n\n*Pages 1-3*\n\nBody of\nit.\n\n*[3 words, 11 characters]*\n\n---\n\n## Two\n\n*Pages 4-9*\n\nMore.\n\n*[1,200 words, 1 characters]*\n")
    rows = S.read_sectioned_text(spark, str(tmp_path / "s.md")).orderBy("section_seq").collect()
    assert [(r.section_seq, r.title, r.page_lo, r.page_hi, r.body, r.words_claimed) for r in rows] == [(1, "One", 1, 3, "Body of\nit.", 3), (2, "Two", 4, 9, "More.", 1200)]


def test_progress_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "failed", 1), (1, 1, "completed", 2), (1, 2, "failed", 1)], "book_id long, seq int, status string, updated_at long")
    S.write_progress(df, str(tmp_path / "p"))
    assert {(r.seq, r.status) for r in S.read_progress(spark, str(tmp_path / "p")).collect()} == {(1, "completed"), (2, "failed")}


def test_drop_folder_stream(spark, tmp_path):
    from narrata.streaming.jobs import to_parquet

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    rows = S.watch_corpus(spark, str(tmp_path / "in")).select("path", "format")
    for n in (1, 2):
        to_parquet(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (tmp_path / "in" / "b.txt").write_text("two")


def test_ranges_give_the_same_pages_either_way(spark):
    from narrata.operators import chapters as C

    pages = spark.range(6).selectExpr("1L as book_id", "cast(id as int) as page_num", "'t' as text")
    ranges = spark.createDataFrame([("a", "A", 2, 3), ("b", "B", 4, 2), ("c", "C", 5, 5), ("d", "D", None, None), ("e", "E", 6, None)], "chapter_id string, title string, start_page int, end_page int")
    both = [sorted((r.chapter_id, r.page_num) for r in C.in_ranges(pages, ranges, most).collect()) for most in (10, 0)]
    assert both[0] == both[1] == [("a", 1), ("a", 2), ("c", 4)]


def test_cleaning_requests_keep_every_chunk(spark):
    from narrata.operators import manifests as M

    chunks = spark.createDataFrame([(1, "x", "p", None), (2, "y", "none", None), (3, "z", "none", "own")], "i int, text string, preset string, custom_prompt string")
    for presets, want in (
        ([("p", "P")], [(1, "P"), (2, None), (3, "own")]),
        ([("p", "P"), ("p", "Q"), ("ocr_cleanup", "S"), ("ocr_cleanup", "T")], [(1, "P"), (2, "S"), (3, "own")]),
        ([], [(1, None), (2, None), (3, "own")]),
    ):
        got = M.clean_requests(chunks, spark.createDataFrame(presets, "preset string, prompt string"), ["i"]).collect()
        assert sorted((r.i, r.prompt) for r in got) == want
