"""Character references, pages by their elements, token measures, names of a hot source, and the voice library."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from narrata.functions import web as W
from narrata.functions.vocabulary import Vocabulary, estimated_chunks, measured
from narrata.operators import chunking as K
from narrata.operators import voices as V
from narrata.operators.page_text import page_text, page_texts
from narrata.operators.timeline import output_names

REFERENCES = ["&eacute;", "&#233;", "&#xE9;", "&#XE9", "&copy", "&copyright", "&notit;", "&notin;", "&amp;lt;", "& ", "&;", "&#;", "&#x;", "&unknown;", "&#0;", "&#128;", "&#x9f;", "&#129;", "&#55296;", "&#xD7FF;", "&#x110000;", "&#99999999999;", "&#11;", "&#13;", "&#xFFFE;", "&#x1F600;", "&NotEqualTilde;", "&AMP", "&ampx", "&Aacutex", "a&b", "&gt&lt"]


def test_references_equal_the_standards(spark):
    rnd = random.Random(4)
    texts = [*REFERENCES, *(f"x&{n}y" for n in rnd.sample(sorted(html5), 300)), "".join(rnd.choices(REFERENCES, k=50)), "none", "", *(f"&#{n};" for n in [*range(0, 170), 0xFDD0, 0xFFFF, 0x1FFFF])]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", W.unescape(F.col("t")).alias("u")).collect()
    for r in rows:
        assert r.u == html.unescape(texts[r.i]), texts[r.i]
    assert spark.createDataFrame([(None,)], "t string").select(W.unescape(F.col("t"))).first()[0] is None


def test_references_that_a_cut_left_open(spark):
    """Only whole references are decoded where that is asked for, alike by patterns and by elements."""
    texts = ["<h1>and&amp;&amp</h1><p>b", "&am", "&copy;&copy &#65;&#65 &#x42;&#x42", "&notit; &not; &unknown; & &amp;amp", "q&middot", ""]
    want = ["and&&amp b", "&am", "©&copy A&#65 B&#x42", "&notit; ¬ &unknown; & &amp", "q&middot", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id int, html string")
    assert [r.t for r in df.select("page_id", W.html_to_text(F.col("html"), unclosed=False).alias("t")).orderBy("page_id").collect()] == want
    assert [r.text for r in page_texts(df, unclosed=False).orderBy("page_id").collect()] == want
    assert page_text("a&amp</p>b") == "a& b"


def test_pages_by_elements(spark):
    page = "<html><head><title>T</title><script>if (a < b) {}</script></head><body><p>One<b>two</b>&eacute;&#x1F600;<style>p > a {}</style>\n three&nbsp;four<br>five<p>a < b &amp;lt; c</body>"
    assert page_text(page) == "One two é😀 three four five a < b &lt; c"
    assert page_text(page, "", frozenset(["script", "style"])) == "TOnetwoé😀 three fourfivea < b &lt; c"
    assert page_text("<head>gone<body>kept") == "kept" and page_text("<script>gone</scrip>more") == "" and page_text("</p></x>t<") == "t<"
    df = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (2, "", "x"), (None, "<p>q", "x")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in page_texts(df).collect()) == [(0, "q"), (1, page_text(page)), (2, ""), (2, "")]
    assert page_texts(df.limit(0)).count() == 0


def plain_tokens(text, entries):
    out = []
    while text:
        best = max((e for e in entries if e and text.startswith(e)), key=len, default=text[0])
        out.append(best)
        text = text[len(best) :]
    return out


def test_longest_entries(spark):
    rnd = random.Random(6)
    entries = ["", "a", "ab", "abc", "bca", "cab", "é𝄞", " a"]
    v = Vocabulary(entries)
    texts = ["".join(rnd.choice("abc é𝄞x") for _ in range(rnd.randrange(60))) for _ in range(200)]
    for t in texts:
        assert v.tokens(t) == plain_tokens(t, entries) and v.count(t) == len(v.tokens(t))
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").withColumn("n", measured(F.col("t"), v.count))
    assert all(r.n == v.count(r.t or "") for r in df.collect())
    assert [r[0] for r in spark.range(4).select(estimated_chunks(F.col("id"), 2)).collect()] == [1, 1, 1, 2]
    try:
        Vocabulary(["abc"], most=2)
        raise AssertionError
    except ValueError:
        pass


def test_chunks_by_a_vocabulary(spark):
    v = Vocabulary(["one", "two", " "])
    df = spark.createDataFrame([(1, "One two. One two two. Two one one one one one.")], "id int, text string")
    chunks = [r.text for r in K.chunk_tokens(df, 12, tokens=v.count).orderBy("chunk_idx").collect()]
    assert chunks == K.by_tokens("One two. One two two. Two one one one one one.", 12, v.count) and len(chunks) > 1
    assert all(v.count(c) <= 12 + c.count(".") for c in chunks) and " ".join(chunks) == "One two. One two two. Two one one one one one."


def test_names_of_a_hot_source(spark):
    rows = [(i, "x" if i % 3 else None if i % 2 else "y") for i in range(300)]
    got = {r.id: r.output_name for r in output_names(spark.createDataFrame(rows, "id int, name string"), "name", "id", ".wav").collect()}
    seen = {}
    for i, name in rows:
        seen[name] = seen.get(name, 0) + 1
        assert got[i] == (None if name is None else name + (f"_{seen[name]}" if seen[name] > 1 else "") + ".wav")


def plain_library(log):
    out = {}
    for voice, seq, op, *fields in sorted(log, key=lambda c: c[1]):
        if voice is not None:
            out[voice] = None if op == "delete" else (voice, seq, *fields)
    return sorted(v for v in out.values() if v)


def test_voices_after_changes_in_any_order(spark):
    rnd = random.Random(9)
    log = [(rnd.choice(["a", "b", "c", "d", None]), i, rnd.choice(["upsert", "upsert", "delete"]), f"n{i}", f"f{i}", None) for i in range(80)]
    schema = "voice_id string, seq long, op string, name string, audio_filename string, ref_text string"
    of = lambda rows: spark.createDataFrame(rows, schema).withColumn("created_at", F.lit(None).cast("timestamp"))
    key = lambda df: sorted(tuple(r)[:5] for r in df.drop("created_at").collect())
    want = [v[:5] for v in plain_library(log)]
    for _ in range(2):
        rnd.shuffle(log)
        assert key(V.voices(None, of(log))) == want
    early, late = log[:50], log[50:]  # a snapshot of some, then changes older than it come late
    snapshot = V.compacted(None, of(early), settled=-1)
    assert key(V.voices(snapshot, of(late))) == want
    assert V.compacted(None, of(log), settled=1000).where("op = 'delete'").count() == 0
    assert V.voices(None, of(log).limit(0)).count() == 0


def test_deletions(spark):
    now = spark.createDataFrame([("a", "a.wav"), ("b", "b.wav")], "voice_id string, audio_filename string")
    asked = spark.createDataFrame([(1, "a"), (2, "x"), (3, "../a"), (4, "a/b"), (5, None), (6, "a")], "request_id int, voice_id string")
    out = V.delete_outcomes(asked, now)
    assert {r.request_id: (r.outcome, r.audio_filename) for r in out.collect()} == {1: ("ok", "a.wav"), 2: ("not_found", None), 3: ("invalid", None), 4: ("invalid", None), 5: ("invalid", None), 6: ("ok", "a.wav")}
    assert [(r.voice_id, r.seq, r.op) for r in V.deletions(out, F.lit(9)).collect()] == [("a", 9, "delete")]
