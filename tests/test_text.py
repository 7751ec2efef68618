"""Text functions on hand-made lines, and against plain renderings."""

import re

import pytest
from pyspark.sql import functions as F

from narrata.functions import quality as Q
from narrata.functions import text as X
from narrata.functions import web as V


def values(spark, function, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


CASES = [
    (X.fix_spaced_capitals, "T H E end, I A M here, A B", "The end, Iam here, A B"),
    (X.fix_spaced_capitals, "É A B C D", "É Abcd"),
    (X.fix_spaced_capitals_title, "T H E old", "The old"),
    (X.remove_footnote_markers, "word* † next²  x", "word next x"),
    (X.remove_footnotes, "a* b [12] c†", "a b c"),
    (X.remove_footnotes_pdf, "end 12\nmore* 3\n", "end more"),
    (X.normalize_special_chars, "a—b “c” ‘d’ e…", "a - b \"c\" 'd' e..."),
    (X.normalize_special_chars_ext, "ﬁne a b “q”", "fine a b “q”"),
    (X.remove_page_numbers, "a\n 12 \n\nb", "a\nb"),
    (X.drop_small_numbers, "in 12 of 1234 x", "in  of 1234 x"),
    (X.fix_hyphenation, "re-\nceive", "receive"),
    (X.collapse_spaces, "  a  b c ", "a b c"),
    (X.escape_metadata, "a=b;c#d\\e\nf", "a\\=b\\;c\\#d\\\\e f"),
    (X.title_of_file, "/x/my_first-book.v2.epub", "My First Book.v2"),
    (V.markdown_to_text, "## Title\n[a](b)[c](d)\n* x\n| a | b | c |\n`z`", "Title\na\nc\n- x\nz"),
    (V.html_to_text, "<style>x</style><p>a &amp; b</p><script>1</script>", "a & b"),
    (V.unescape, "&#65;&quot;&copy;", 'A"©'),
]


@pytest.mark.parametrize("function,text,want", CASES)
def test_cases(spark, function, text, want):
    assert values(spark, function, [text]) == [want]


def test_sentences(spark):
    text = 'One. Two!  "Three?" four. Five 1.5 six'
    assert values(spark, X.sentences, [text])[0] == re.split(r"(?<=[.!?])\s+", text)
    assert values(spark, X.sentences_before_capital, ["A b. c d. E f."])[0] == ["A b. c d.", "E f."]
    assert values(spark, X.sentences_at_space, ["A. b.c d.  "])[0] == ["A.", " b.c d.", "  "]


def test_labels(spark):
    df = spark.createDataFrame([(0.001, 3723.4567), (0.5, 0.0), (12.0, 59.999)], "usd double, s double")
    rows = df.select(X.format_cost(F.col("usd")).alias("c"), X.clock(F.col("s")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [("$0.0010", "01:02:03,456"), ("$0.500", "00:00:00,000"), ("$12.00", "00:00:59,999")]


def test_costs_round_by_their_exact_value(spark):
    """0.00085 is a little less than it looks as a double, 0.0625 and 2.125 are ties."""
    costs = [0.00085, 50 * 0.000017, 0.0625, 2.125, 2.375, 1.005, 12345678.125, 0.0, 0.9999, 0.0099999]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(costs)] + [(99, None)], "i int, usd double")
    rows = [r.c for r in df.select("i", X.format_cost(F.col("usd")).alias("c")).orderBy("i").collect()]
    assert rows == [f"${c:.{4 if c < 0.01 else 3 if c < 1 else 2}f}" for c in costs] + [None]


def test_quality_and_headings(spark):
    assert values(spark, Q.text_quality, ["", "the and is in", "@@@@ ####"])[:2] == [0.0, 1.0]
    heads = values(spark, Q.page_heading, ["Chapter One\nx", "x\ny\nz\nPreface", "CHAPTER 4", "Part II: The sea\n", "Introduction to it", ""])
    assert heads == ["Chapter One", None, None, "Part II: The sea", None, None]


WEB = [
    ("Home About\nA real line, with a stop.\nHome Again\nBIG NEWS FROM THE HARBOUR TODAY\nRead more now\nlast", "A real line, with a stop.\nHome Again\nlast"),
    ("Home News Sport Weather Travel More  The story begins here. It goes on.", "The story begins here. It goes on."),
    ("One two  three four  five  six. On", "six. On"),
    ("One two three  four. On", "One two three four. On"),
    ("", ""),
    ("Title Case Words In A Row Here\nplain words go on and on in this line without any stop at all so it is long", "plain words go on and on in this line without any stop at all so it is long"),
    ("one\n\n\n\n\ntwo, three", "two, three"),
    ("a, b\n\n\n\n\ntwo", "a, b\n\ntwo"),
    ("Follow us\nShare this article\nx, y", "x, y"),
]


def test_web_text(spark):
    assert values(spark, V.clean_web_text, [t for t, _ in WEB]) == [want for _, want in WEB]


def test_spaced_capitals_of_ascii(spark):
    """With ascii the words end where those of the SQL do, so at a letter with an accent too."""
    texts = ["rie A B C D R\u00e9 \u00e8l", "\u00e9A B C x", "A B C_ D E F", "A\u00a0B C D E", "A\nB C D\n E FG", "A B CD \u00c9", "A B", "a A B C1 D", None]
    first = lambda m: m[0].replace(" ", "")[:1] + m[0].replace(" ", "")[1:].lower()
    for function, pattern in ((X.fix_spaced_capitals, r"\b(?:[A-Z]\s+){2,}[A-Z]+\b"), (X.fix_spaced_capitals_title, r"\b[A-Z]\s+[A-Z]\s+[A-Z](?:\s+[A-Z])*\b")):
        assert values(spark, lambda t, f=function: f(t, ascii=True), texts) == [None if t is None else re.sub(pattern, first, t, flags=re.A) for t in texts]
        assert values(spark, lambda t, f=function: f(t, ascii=True), ["A B " * 20_000 + "\u00e9x"]) == [("ab" * 20_000).capitalize() + " \u00e9x"]
    assert values(spark, lambda t: X.apply_text_cleaning(t, ascii=True), [texts[0]]) == ["rie Abcdr\u00e9 \u00e8l"]
    assert values(spark, X.fix_spaced_capitals, [texts[0]]) == ["rie Abcd R\u00e9 \u00e8l"]


def test_long_texts_end_no_worker(spark):
    """Repeats in patterns must not take a call for each word, and marks of any kind may stand in a text."""
    plain = "word " * 200_000
    assert values(spark, V.clean_web_text, [plain, "word " * 200_000 + " end. x"]) == [plain.strip(), "end. x"]


def test_web_lines_are_stripped_once_and_told_by_their_stops(spark):
    plan = spark.range(1).select(V.clean_web_text(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") <= 2  # a line, and the whole
    texts = {"READ MORE x": "", "Share thİs article. Yes": "Share thİs article. Yes", "A real line, with stops.\nHOME ABOUT US NOW GO": "A real line, with stops.", "A real line, with stops.\nA b c d e f": "A real line, with stops.\nA b c d e f", "": ""}
    assert values(spark, V.clean_web_text, list(texts)) == list(texts.values())
    assert values(spark, X.fix_spaced_capitals, ["A B " * 20_000 + "x"]) == [("ab" * 20_000).capitalize() + " x"]
    assert values(spark, X.fix_spaced_capitals_title, ["A B " * 20_000 + "Xy"]) == [("ab" * 20_000).capitalize() + " Xy"]
    assert values(spark, X.fix_spaced_capitals, ["A B C Dx \x01 E F G\x01", "A B C x", "AA BB CC", None]) == ["Abc Dx \x01 Efg\x01", "Abc x", "AA BB CC", None]
