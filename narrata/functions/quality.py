"""How well a page was read, and what its first lines are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions.text import strip, words

# Fixed values.
COMMON_WORDS = ["the", "and", "is", "in", "to", "of", "a", "that", "it", "for"]
ROMAN_OR_NUMBER = r"(?:\d+|[IVXLCDM]+|One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten{more})"
HEADINGS = [
    "CHAPTER\\s+" + ROMAN_OR_NUMBER.format(more="|Eleven|Twelve") + r"(?:\s*[:.\-].*)?",
    "PART\\s+" + ROMAN_OR_NUMBER.format(more="") + r"(?:\s*[:.\-].*)?",
    r"Introduction|Preface|Foreword|Prologue|Epilogue|Conclusion|Afterword|Appendix(?:\s+[A-Z])?|Bibliography|Notes|Index|Acknowledgements?",
]


def common_words(text: Column) -> Column:
    """Different common English words in the text."""
    return F.size(F.array_intersect(F.array_distinct(words(F.lower(text))), F.array(*map(F.lit, COMMON_WORDS))))


def text_quality(text: Column) -> Column:
    """0 to 1: the share of ordinary characters, less 0.1 a garbled run (0.5 at most), plus 0.05 a common word (0.2 at most)."""
    ordinary = F.length(F.regexp_replace(text, r"(?U)[^\p{L}\d\s.,;:!?\"'\-()\[\]{}]", ""))
    garbled = F.regexp_count(text, F.lit(r"(?U)[^\w\s.,;:!?\"'\-()\[\]{}]{3,}"))
    score = ordinary / F.length(text) - F.least(garbled * F.lit(0.1), F.lit(0.5)) + F.least(common_words(text) * F.lit(0.05), F.lit(0.2))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def needs_ocr(text: Column, n_images: Column, quality: Column) -> Column:
    """A nearly empty page with an image, or a badly read one."""
    return ((F.length(strip(text)) < 50) & (n_images > 0)) | (quality < 0.6)


def extraction(text: Column, n_images: Column, quality: Column, ocr_text: Column) -> Column:
    """struct(method, confidence): direct, ocr where a reply is there, else what was read directly, or failed."""
    bad = needs_ocr(text, n_images, quality)
    made = lambda m, c: F.struct(F.lit(m).alias("method"), F.lit(c).alias("confidence"))
    return (
        F.when(~bad, made("direct", 1.0))
        .when(ocr_text.isNotNull() & (ocr_text != ""), made("ocr", 0.9))
        .when(strip(text) != "", made("direct", 0.5))
        .otherwise(made("failed", 0.0))
    )


def is_heading(line: Column) -> Column:
    """A line of up to 60 characters that names a chapter, part or matter and doesn't look like a running header."""
    running = line.rlike(r"\d+\s*$") & (F.length(line) < 50)
    return (F.length(line) <= 60) & ~running & line.rlike("(?i)^(?:" + "|".join(HEADINGS) + ")$")


def page_heading(text: Column) -> Column:
    """The first heading among the first three lines with text in a page's first 300 characters, or null."""
    lines = F.filter(F.transform(F.split(F.substring(text, 1, 300), "\n"), strip), lambda x: x != "")
    return F.get(F.filter(F.slice(lines, 1, 3), is_heading), F.lit(0))
