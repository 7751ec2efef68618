"""Books as files: listing, decoding, archives, sectioned texts, settings and the registry of books."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import text as X

# Fixed values.
SUFFIXES = ["epub", "pdf", "txt", "docx", "md"]
HTML_TYPES = ["application/xhtml+xml", "text/html"]
DEFAULT_PROFILE = {
    "announce_chapters": "true",
    "chapter_pause": "2.5",
    "chunk_size": "1500",
    "min_chunk_size": "200",
    "max_retries": "3",
    "retry_delay": "5",
    "fix_spaced_capitals": "true",
    "remove_footnotes": "true",
    "normalize_special_chars": "true",
    "format": "m4b",
    "bitrate": "128k",
    "embed_cover": "true",
}
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def scan_corpus(spark: SparkSession, folder: str, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """Files of a folder (not of those in it) with a known suffix of any case: path, modificationTime, length, content, format."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return files.withColumn("format", suffix_of(F.col("path"))).where(F.col("format").isin(suffixes))


def watch_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The same files as a stream, each new file once."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(folder).withColumn("format", suffix_of(F.col("path")))


def decode_text(content: Column) -> Column:
    """UTF-16 where a byte-order mark says so, UTF-8 where valid, else Latin-1."""
    start = F.hex(F.substring(content, 1, 2))
    return F.when(start.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _epub_rows(path: str, content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
        base, tree = posixpath.dirname(opf), ElementTree.fromstring(z.read(opf))
        meta = {}
        for e in tree.iter():
            if _local(e.tag) in ("title", "creator", "language") and e.text:
                meta.setdefault(_local(e.tag), e.text.strip())
        items = {e.attrib["id"]: e.attrib for e in tree.iter() if _local(e.tag) == "item"}
        titles: dict[str, str] = {}
        for item in items.values():
            full = posixpath.normpath(posixpath.join(base, item["href"]))
            if "nav" in item.get("properties", "").split() or item["media-type"] == "application/x-dtbncx+xml":
                for href, title in _nav_titles(z.read(full)):
                    titles[posixpath.normpath(posixpath.join(posixpath.dirname(full), href))] = title
        refs = [e.attrib for e in tree.iter() if _local(e.tag) == "itemref"]
        for seq, ref in enumerate(refs, 1):
            item = items.get(ref["idref"])
            if item is None:
                continue
            full = posixpath.normpath(posixpath.join(base, item["href"]))
            html = z.read(full).decode("utf-8", "replace") if item["media-type"] in HTML_TYPES and full in z.namelist() else None
            yield {"path": path, "title": meta.get("title"), "author": meta.get("creator", "Unknown"), "language": meta.get("language", "en"), "spine_seq": seq, "item_id": ref["idref"], "href": full, "media_type": item["media-type"], "linear": ref.get("linear", "yes"), "nav_title": titles.get(full), "html": html}


def _nav_titles(data: bytes) -> Iterator[tuple[str, str]]:
    tree = ElementTree.fromstring(data)
    for e in tree.iter():
        if _local(e.tag) == "a" and "href" in e.attrib:
            yield e.attrib["href"].partition("#")[0], " ".join("".join(e.itertext()).split())
        elif _local(e.tag) == "navPoint":
            label = next((x for x in e.iter() if _local(x.tag) == "text"), None)
            target = next((x for x in e.iter() if _local(x.tag) == "content"), None)
            if label is not None and target is not None:
                yield target.attrib["src"].partition("#")[0], (label.text or "").strip()


EPUB_SCHEMA = "path string, title string, author string, language string, spine_seq int, item_id string, href string, media_type string, linear string, nav_title string, html string, error string"


def read_epub(files: DataFrame) -> DataFrame:
    """A row for each entry of the spines of EPUB files (path, content); a file that can't be read is one row with its error.

    Entries that the manifest doesn't have are left out; the last title that the contents give a file counts.
    """

    names = [f.strip().split(" ")[0] for f in EPUB_SCHEMA.split(",")]
    schema = pa.schema([(n, pa.int32() if n == "spine_seq" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = list(_epub_rows(path, content))
                except Exception as e:  # noqa: BLE001  a broken file is a row, not the end of the job
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, EPUB_SCHEMA)


def linear_spine(entries: DataFrame) -> DataFrame:
    """Entries that are read in turn and are pages."""
    return entries.where((F.col("linear") == "yes") & F.col("media_type").isin(HTML_TYPES))


def chapter_titles(entries: DataFrame) -> DataFrame:
    """Adds title_read: that of the contents, else one made from the id."""
    return entries.withColumn("title_read", X.format_chapter_title(F.coalesce("nav_title", "item_id"), F.col("item_id")))


def _docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    out: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        kind = _local(e.tag)
        if kind == "t":
            out.append(e.text or "")
        elif kind == "tab":
            out.append("\t")
        elif kind == "br":
            out.append("\n")
        for child in e:
            walk(child)
        if kind == "p":
            out.append("\n")

    walk(tree)
    return "".join(out)


def read_docx(files: DataFrame) -> DataFrame:
    """(path, text, error) of DOCX files (path, content): a line for each paragraph."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((path, _docx_text(bytes(content)), None))
                except Exception as e:  # noqa: BLE001  a broken file is a row, not the end of the job
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def joined_paragraphs(text: Column) -> Column:
    """Lines with text, a blank line between."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), X.strip), lambda p: p != ""), "\n\n")


def read_sectioned_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, section_seq, title, page_lo, page_hi, body, words_claimed, chars_claimed) of texts in sections between rules."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"(?m)^---\s*$")).alias("pos", "s"))
    number = lambda p: F.try_to_number(F.regexp_extract("s", p, 1), F.lit("999,999,999")).cast("int")
    found = whole.select(
        "path",
        "pos",
        F.regexp_extract("s", r"(?m)^## (.+)$", 1).alias("title"),
        F.expr(r"try_cast(regexp_extract(s, '(?m)^\\*Pages? (\\d+)', 1) as int)").alias("page_lo"),
        F.expr(r"try_cast(regexp_extract(s, '(?m)^\\*Pages? \\d+\\s*-\\s*(\\d+)', 1) as int)").alias("page_hi"),
        F.regexp_extract("s", r"(?s)\*Pages?[^*]*\*\n\n(.*?)\n\n\*\[", 1).alias("body"),
        number(r"\*\[.*?([\d,]+) words").alias("words_claimed"),
        number(r"\*\[.*?([\d,]+) char").alias("chars_claimed"),
    )
    from pyspark.sql import Window

    kept = found.where("title <> '' AND page_lo IS NOT NULL")
    return kept.withColumn("section_seq", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).drop("pos")


def resolve_profiles(books: DataFrame, own: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """A column for each setting: the book's own value where its map has the key, even a null, else the standard value."""
    joined = books.join(own, "book_id", "left")
    value = lambda k, v: F.when(F.coalesce(F.map_contains_key("settings", k), F.lit(False)), F.element_at("settings", k)).otherwise(F.lit(v)).alias(k)
    return joined.select("book_id", *(value(k, v) for k, v in defaults.items()))


def book_registry(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Books with an array of their chapters in order, and their words."""
    listed = F.array_sort(F.collect_list(F.struct("chapter_seq", "chapter_id", F.col("title").alias("chapter_title"), "word_count")))
    grouped = chapters.groupBy("book_id").agg(listed.alias("chapters"), F.sum("word_count").alias("total_words"))
    return books.join(grouped, "book_id", "left").withColumns({"chapters": F.coalesce("chapters", F.array().cast(grouped.schema["chapters"].dataType)), "total_words": F.coalesce("total_words", F.lit(0).cast("long"))})


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of stored web pages."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Appends job rows, a folder for each day; they are read back through operators.jobs.latest."""
    jobs.withColumn("created_date", F.to_date("created_at")).write.mode("append").partitionBy("created_date").parquet(path)


def write_progress(rows: DataFrame, path: str) -> None:
    """Appends checkpoint rows (book_id, seq, status, updated_at)."""
    rows.write.mode("append").parquet(path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each (book_id, seq)."""
    from narrata.operators.jobs import latest

    return latest(spark.read.parquet(path), ["book_id", "seq"], "updated_at")
