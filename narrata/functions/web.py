"""Addresses, markup and text of web pages as Columns."""

from __future__ import annotations

import html
import json
from html.entities import html5 as entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions import text as X

#: A character reference, and the longest of the names that need no semicolon.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
LONGEST_OPEN = 6
#: A reference that its semicolon ends.
CLOSED_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def normalize_url(url: Column) -> Column:
    """The address with https:// where it names no scheme; null unless it is http or https with a host."""
    trimmed = X.strip(url)
    full = F.when(trimmed.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    return F.when(full.rlike(r"(?i)^https?://[^/\s?#]+"), full)


def url_host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^https?://([^/:?#]+)", 1), F.lit(""))


def _code_point(number: Column) -> Column:
    """The character of a number as pages mean it: those of a Windows code page for 128 to 159, nothing for characters that no
    text holds, a sign for numbers that are none."""
    named = {n: html.unescape(f"&#{n};") for n in [0, 13, *range(0x80, 0xA0)]}
    special = F.from_json(F.lit(json.dumps({str(n): c for n, c in named.items()})), "map<string,string>")
    odd = number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    gone = number.between(1, 8) | number.between(14, 31) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (number == 11) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.coalesce(F.element_at(special, number.cast("string")), F.when(odd, "\ufffd").when(gone, "").otherwise(plain))


def unescape(text: Column, unclosed: bool = True) -> Column:
    """All character references of HTML decoded: decimal and hexadecimal ones, and the named ones of the standard's table, of
    which some need no semicolon and then the longest counts. A name that isn't in the table stays as it is. Without
    `unclosed` a reference counts only as a whole with its semicolon, so that of a text cut within one the rest stays."""
    table = F.from_json(F.lit(json.dumps(entities)), "map<string,string>")

    def decoded(m: Column) -> Column:
        digits = F.regexp_extract(m, r"^&#([0-9]+)", 1)
        hexes = F.regexp_extract(m, r"^&#[xX]([0-9a-fA-F]+)", 1)
        code = lambda d, base, most: F.when(F.length(F.ltrim(d, F.lit("0"))) > most, F.lit(0x110000)).otherwise(F.conv(d, base, 10).cast("long")).cast("long")
        name = F.substring(m, 2, 64)
        opens = [F.when(F.length(name) >= k, F.concat(F.element_at(table, F.left(name, F.lit(k))), F.substring(name, k + 1, 1 << 30))) for k in range(LONGEST_OPEN, 1, -1)]
        named = F.coalesce(F.element_at(table, name), *(opens if unclosed else []), m)
        return F.when(digits != "", _code_point(code(digits, 10, 7))).when(hexes != "", _code_point(code(hexes, 16, 6))).otherwise(named)

    return F.when(F.contains(text, F.lit("&")), X.replace_matches(text, REFERENCE if unclosed else CLOSED_REFERENCE, decoded)).otherwise(text)


def html_to_text(page: Column, head: bool = True, unclosed: bool = True) -> Column:
    """Markup as spaces, without styles and scripts (head=False: and the page's head), references decoded (unclosed: also those
    without a semicolon), spaces collapsed."""
    kept = page if head else F.regexp_replace(page, r"(?is)<head[^>]*>.*?</head>", " ")
    bare = F.regexp_replace(F.regexp_replace(kept, r"(?is)<(style|script)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")
    return X.collapse_spaces(unescape(bare, unclosed))


def markdown_to_text(md: Column) -> Column:
    """Link texts without addresses, no images, marks or table rows."""
    steps = [
        (r"\)\s*\[", ")\n["),
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"(?m)^#{1,6}\s*", ""),
        (r"(?m)^\s*[-*+]\s+", "- "),
        (r"`{1,3}|\*\*|__", ""),
    ]
    text = X.ocr_substitutions(md, steps)
    return X.keep_lines(text, lambda l: ~((F.regexp_count(l, F.lit(r"\|")) >= 3) | l.rlike(r"^\s*\|.*\|\s*$") | l.rlike(r"^\s*[:\-|\s]+$")))


def json_ld_scripts(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)


# How lines begin that aren't part of an article, and what makes a line real, short or a menu.
BAD_PREFIXES = ["share this article", "read more", "related articles", "follow us"]
BLOB_WORDS = 5
REAL_LENGTH, REAL_STOPS = 60, 0.01
SHORT_LENGTH, SHORT_WORDS = 45, 4
MENU_WORDS, MENU_WORD, MENU_CAPITALS, MENU_TITLE, MENU_LENGTH = 5, 16, 0.4, 0.8, 140

_NAME = r"[A-Za-z][A-Za-z0-9+\-]*+(?=\s)"
#: Plain words from the start up to the last wide gap between them. All repeats are possessive, which Java matches in a loop.
_BLOB = rf"\A(?:{_NAME}(?:\s(?!\s){_NAME})*+\s{{2,}})++"


_BAD = rf"(?i)\A(?:{'|'.join(BAD_PREFIXES)})"


def _line(raw: Column) -> Column:
    """What is told of a line. Inside lambdas nothing is shared, so the line is stripped once for all; only lines with few stops
    need their words."""

    def told(line: Column) -> Column:
        stops = (F.length(line) - F.length(F.translate(line, ".,;:!?", ""))) / F.greatest(F.length(line), F.lit(1))
        return X.let(stops, lambda share: F.struct(line.alias("line"), F.when(share < REAL_STOPS, X.words(line)).alias("words"), share.alias("stops"), line.rlike(_BAD).alias("bad")))

    return X.let(X.strip(raw), told)


def _is_real(x: Column) -> Column:
    """A line with which an article can begin."""
    return (x["line"] != "") & ~x["bad"] & ((F.length(x["line"]) >= REAL_LENGTH) | (x["stops"] >= REAL_STOPS))


def _is_short(x: Column) -> Column:
    return (F.length(x["line"]) < SHORT_LENGTH) & (x["stops"] < REAL_STOPS) & (F.size(x["words"]) <= SHORT_WORDS)


def _is_menu(x: Column) -> Column:
    n = F.size(x["words"])

    def named(some: Column) -> Column:  # of the words with a capital, without which nothing is a name
        capitals = F.size(F.filter(some, lambda w: ~w.rlike(r"(?U)\p{Ll}"))) / n
        title = F.size(F.filter(some, lambda w: w.rlike(r"(?U)^\p{Lu}"))) / n
        return (F.size(some) / n > MENU_CAPITALS) & ((capitals > MENU_CAPITALS) | ((title > MENU_TITLE) & (F.length(x["line"]) <= MENU_LENGTH)))

    few = (x["stops"] < REAL_STOPS) & (n >= MENU_WORDS) & F.forall(x["words"], lambda w: F.length(w) <= MENU_WORD)
    return few & X.let(F.filter(x["words"], lambda w: w.rlike(r"(?U)\p{Lu}")), named)


def clean_web_text(text: Column) -> Column:
    """Lines without navigation: leading blobs, known prefixes, short lines before the first real one, and lines of many
    short capitalised words go. Each line is looked at once, and nothing is shuffled."""
    t = F.replace(text, F.lit("\r"), F.lit("\n"))
    blob = F.regexp_extract(t, _BLOB, 0)
    t = F.when(F.size(X.words(blob)) >= BLOB_WORDS, F.substring(t, F.length(blob) + 1, F.length(t))).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")

    def kept(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, _is_real), F.lit(True))  # from 1, 0 if there is none
        return X.let(first, lambda start: F.filter(lines, lambda x, i: (x["line"] == "") | ~(x["bad"] | ((start == 0) | (i + 1 < start)) & _is_short(x) | _is_menu(x))))

    lines = X.let(F.transform(F.split(t, "\n"), _line), kept)
    return X.strip(F.regexp_replace(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), r"\n{3,}", "\n\n"))
