"""Cleaning and measuring of narration text. Every function maps Columns to a Column and runs inside the JVM.

White space, digits, words and word boundaries follow Unicode, as `(?U)` asks for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and what they are read as.
DASHES = [("—", " - "), ("–", " - ")]
QUOTES = [("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'")]
ELLIPSIS = [("…", "...")]
LIGATURES = [("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")]
#: The characters of Unicode's white space.
BLANKS = "\t\n\u000b\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NO_BREAK_SPACE = [(" ", " ")]
FOOTNOTE_SYMBOLS = "*†‡§¶‖"
SUPERSCRIPTS = "¹²³⁴⁵⁶⁷⁸⁹⁰"


def let(value: Column, body: object) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def collapse_spaces(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def char_count(text: Column) -> Column:
    return F.length(text).cast("long")


def byte_count(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def replace_matches(text: Column, pattern: str, change: object) -> Column:
    """Each match of the pattern changed by a Column function."""
    changed = F.array_append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change), F.lit(""))
    return F.array_join(F.zip_with(F.split(text, pattern), changed, lambda between, match: F.concat(between, match)), "")


#: Where an ASCII word begins or ends at a letter, and ASCII white space.
_ASCII_START, _ASCII_END, _ASCII_SPACE = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])", r"[\t\n\f\r ]+"


def _joined(match: Column) -> Column:
    """The match without blanks, all but its first character small."""
    letters = F.replace(match, F.lit(" "), F.lit(""))
    return F.concat(F.substring(letters, 1, 1), F.lower(F.substring(letters, 2, 1 << 30)))


def fix_spaced_capitals(text: Column, ascii: bool = False) -> Column:
    """'A H OUSE' -> 'Ahouse': three or more spaced capitals lose their spaces, and all but the first become small.

    With `ascii` words and white space are those of ASCII, so 'É' is no letter and 'B C Ré' holds the spaced 'B C R'.
    The repeated part is possessive, which Java matches in a loop; a part that it may give back takes a call for each letter.
    """
    if ascii:
        return replace_matches(text, rf"{_ASCII_START}(?:[A-Z]{_ASCII_SPACE}(?=[A-Z]++{_ASCII_END})){{2,}}+[A-Z]++", _joined)
    return replace_matches(text, r"(?U)\b(?:[A-Z]\s+(?=[A-Z]++\b)){2,}+[A-Z]+\b", _joined)


def fix_spaced_capitals_title(text: Column, ascii: bool = False) -> Column:
    """'T H E' -> 'The': three or more single spaced capitals become one word with a capital; ascii as above, where capitals
    that are apart by other white space than blanks are one word too."""
    if ascii:
        return replace_matches(text, rf"{_ASCII_START}[A-Z]{_ASCII_SPACE}[A-Z]{_ASCII_SPACE}[A-Z]{_ASCII_END}(?:{_ASCII_SPACE}[A-Z]{_ASCII_END})*+", _joined)
    return replace_matches(text, r"(?U)\b[A-Z]\s+[A-Z]\s+[A-Z](?:\s+[A-Z]\b)*+\b", lambda x: F.initcap(F.replace(x, F.lit(" "), F.lit(""))))


def remove_footnote_markers(text: Column) -> Column:
    """Footnote symbols and superscript digits with the white space around them become one space."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?U)\s*[{FOOTNOTE_SYMBOLS}{SUPERSCRIPTS}]+\s*", " "), r"(?U)\s+", " ")


def remove_footnotes(text: Column) -> Column:
    """Footnote symbols and [n] references go without a trace."""
    return collapse_spaces(F.regexp_replace(F.translate(text, FOOTNOTE_SYMBOLS, ""), r"\[\d+\]", ""))


def remove_footnotes_pdf(text: Column) -> Column:
    """As remove_footnotes; digits at the ends of lines go too."""
    ends = F.regexp_replace(F.regexp_replace(text, r"\[\d+\]", ""), r"(?m)\d+\s*$", "")
    return collapse_spaces(F.translate(ends, FOOTNOTE_SYMBOLS, ""))


def normalize_special_chars(text: Column) -> Column:
    return replace_all(text, DASHES + QUOTES + ELLIPSIS)


def normalize_special_chars_ext(text: Column, curly: bool = False) -> Column:
    """Also no-break spaces and ligatures; curly quotes stay unless asked for."""
    return replace_all(text, DASHES + (QUOTES if curly else []) + ELLIPSIS + NO_BREAK_SPACE + LIGATURES)


def keep_lines(text: Column, wanted: object) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), wanted), "\n")


def remove_page_numbers(text: Column) -> Column:
    """Blank lines and lines of digits go."""
    return keep_lines(text, lambda line: ~strip(line).rlike(r"^\d*$"))


def drop_small_numbers(text: Column) -> Column:
    """White space collapsed and numbers of one to three digits gone; the space in front of them stays."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"(?U)\b\d{1,3}\b(?=\s|$)", ""))


def fix_hyphenation(text: Column) -> Column:
    """A word cut at the end of a line is joined. A match starts only where a word does, and runs are never given back, so
    each character is read once."""
    return F.regexp_replace(text, r"(?U)(?<!\w)(\w++)-\n(\w++)", "$1$2")


def drop_running_headers(text: Column, header: str, shorter_than: int = 30) -> Column:
    """Short lines that hold the header, and lines of digits, go."""
    return keep_lines(text, lambda line: ~((F.contains(line, F.lit(header)) & (F.length(strip(line)) < shorter_than)) | strip(line).rlike(r"^\d+$")))


def ocr_substitutions(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Pattern, replacement pairs in order."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def format_for_audio(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def apply_text_cleaning(text: Column, capitals: Column | bool = True, footnotes: Column | bool = True, characters: Column | bool = True, ascii: bool = False) -> Column:
    """Capitals (ascii as there), footnotes, characters, in that order, each where its toggle (a constant or a column) is true;
    then spaces."""
    for toggle, fix in ((capitals, lambda t: fix_spaced_capitals(t, ascii)), (footnotes, remove_footnote_markers), (characters, normalize_special_chars)):
        if isinstance(toggle, bool):
            text = fix(text) if toggle else text
        else:
            text = F.when(toggle, fix(text)).otherwise(text)
    return collapse_spaces(text)


def clean_page_text(text: Column, capitals: bool = False, footnotes: bool = False, characters: bool = False, page_numbers: bool = True, hyphenation: bool = True) -> Column:
    """The cleaning of scanned pages: the last two steps are on unless turned off."""
    steps = ((capitals, fix_spaced_capitals_title), (footnotes, remove_footnotes_pdf), (characters, normalize_special_chars_ext), (page_numbers, remove_page_numbers), (hyphenation, fix_hyphenation))
    return reduce(lambda c, s: s[1](c) if s[0] else c, steps, text)


def format_chapter_title(title: Column, item_id: Column) -> Column:
    """A title that only repeats the id or is under three characters is made from the id."""
    number = F.regexp_extract(item_id, r"(?i)chapter(\d+)", 1)
    made = F.when(number != "", F.concat(F.lit("Chapter "), number.cast("int").cast("string"))).otherwise(F.initcap(F.replace(title, F.lit("_"), F.lit(" "))))
    return F.when((title == item_id) | (F.length(title) < 3), made).otherwise(title)


def sentences(text: Column) -> Column:
    """Parts that end with a stop and white space; punctuation stays."""
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def sentences_before_capital(text: Column) -> Column:
    """As sentences, but only before a capital or a quote; white space collapsed, empty parts gone."""
    parts = F.split(collapse_spaces(text), r"(?U)(?<=[.!?])\s+(?=[A-Z\"'])")
    return F.filter(parts, lambda s: s != "")


def sentences_at_space(text: Column) -> Column:
    """Parts up to a stop that one space or the end follows; the space stays with the next part."""
    return F.filter(F.split(text, r"(?<=[.!?])(?= )"), lambda s: s != "")


def token_count(text: Column) -> Column:
    """Tokens by the rule of four characters each."""
    return F.ceil(F.length(text) / F.lit(4)).cast("long")


def estimate_chunks(text: Column, tokens: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(token_count(text) / F.lit(tokens))).cast("long")


def fixed_point(number: Column, digits: int) -> Column:
    """The number with so many decimals, rounded by its exact binary value and ties to even, as printf does; a format string
    would round the shortest decimal that stands for it, and that upwards."""
    return F.call_function("format_number", number, F.lit("0." + "0" * digits))


def format_cost(usd: Column) -> Column:
    amount = F.when(usd < 0.01, fixed_point(usd, 4)).when(usd < 1.0, fixed_point(usd, 3)).otherwise(fixed_point(usd, 2))
    return F.concat(F.lit("$"), amount)


def clock(seconds: Column, point: str = ",") -> Column:
    """HH:MM:SS,mmm, truncated."""
    whole = F.floor(seconds)
    return F.format_string(f"%02d:%02d:%02d{point}%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, F.floor((seconds - whole) * 1000))


def duration_label(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.floor(seconds % 60).cast("string"), F.lit("s"))


def escape_metadata(value: Column) -> Column:
    return replace_all(value, [("\\", "\\\\"), ("=", "\\="), (";", "\\;"), ("#", "\\#"), ("\n", " ")])


def cache_key(text: Column, mode: Column, speaker: Column) -> Column:
    return F.md5(F.concat_ws("_", text, mode, speaker))


def client_fingerprint(host: Column, agent: Column) -> Column:
    return F.left(F.md5(F.concat_ws(":", host, agent)), F.lit(16))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def title_of_file(path: Column) -> Column:
    """The file's name without folder and suffix, underscores and dashes as spaces, words with capitals."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.initcap(F.translate(stem, "_-", "  "))


def full_reading(title: Column, author: Column, published: Column, body: Column) -> Column:
    """Title, byline and body with blank lines between; the date is only read with an author."""
    has = lambda c: c.isNotNull() & (c != "")
    byline = F.concat(F.lit("By "), author, F.when(has(published), F.concat(F.lit(". Published "), published, F.lit("."))).otherwise(""))
    parts = F.concat(F.when(has(title), F.array(title, F.lit(""))).otherwise(F.array().cast("array<string>")), F.when(has(author), F.array(byline, F.lit(""))).otherwise(F.array().cast("array<string>")), F.array(F.coalesce(body, F.lit(""))))
    return strip(F.array_join(parts, "\n"))
