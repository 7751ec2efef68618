"""From pages to chapters: boundaries of a table of contents, of headings, of given ranges, or of equal groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import quality as Q
from narrata.functions import text as X


def chapter_id(number: Column) -> Column:
    return F.format_string("chapter_%03d", number)


def top_entries(toc: DataFrame) -> DataFrame:
    """The entries of level 1 of each book, or all where it has none."""
    has_top = F.max((F.col("level") == 1).cast("int")).over(Window.partitionBy("book_id"))
    return toc.withColumn("has_top", has_top).where("has_top = 0 OR level = 1").drop("has_top")


def boundaries(starts: DataFrame) -> DataFrame:
    """(book_id, chapter_seq, chapter_id, title, start_page, end_page) of (book_id, title, start_page, seq).

    A chapter ends before the next start, the last never (end_page is null). Numbers count all boundaries.
    """
    order = Window.partitionBy("book_id").orderBy("start_page", "seq")
    numbered = starts.withColumn("chapter_seq", F.row_number().over(order)).withColumn("end_page", F.lead("start_page").over(order))
    return numbered.select("book_id", "chapter_seq", chapter_id(F.col("chapter_seq")).alias("chapter_id"), "title", "start_page", "end_page")


def assign_pages(pages: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each page with the last chapter that starts on or before it; earlier pages are dropped.

    Starts and pages are sorted together once and the last start is carried on, so this is no range join. Of chapters
    that start on one page the last gets it.
    """
    marks = bounds.select("book_id", F.col("start_page").alias("page_num"), F.col("chapter_seq").alias("seq"), F.struct("chapter_seq", "chapter_id", "title").alias("chapter"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"))
    rows = pages.select("book_id", "page_num", F.lit(None).cast("int").alias("seq"), F.lit(None).cast("struct<chapter_seq:int,chapter_id:string,title:string>").alias("chapter"), "text", F.lit(1).alias("kind"))
    order = Window.partitionBy("book_id").orderBy("page_num", "kind", "seq")
    carried = marks.unionByName(rows).withColumn("chapter", F.last("chapter", ignorenulls=True).over(order))
    return carried.where("kind = 1 AND chapter IS NOT NULL").select("book_id", "page_num", "text", "chapter.chapter_seq", "chapter.chapter_id", "chapter.title")


def detect_headings(pages: DataFrame, dedupe: str = "first_word", least: int = 4, pages_per_chapter: int = 10) -> DataFrame:
    """(book_id, title, start_page, seq): headings at the tops of pages.

    Only the first of a kind counts: headings are alike if their first words are (dedupe="title": if all of them are).
    A book with under `least` headings, or more than one for pages_per_chapter pages, has none.
    """
    found = pages.select("book_id", "page_num", Q.page_heading(F.col("text")).alias("title"))
    key = F.lower(F.get(F.split("title", r"\s+"), F.lit(0))) if dedupe == "first_word" else F.lower("title")
    first = Window.partitionBy("book_id", "key").orderBy("page_num")
    kept = found.where("title IS NOT NULL").withColumn("key", key).withColumn("rank", F.row_number().over(first)).where("rank = 1")
    sizes = pages.groupBy("book_id").agg(F.count("*").alias("n_pages"))
    counted = kept.withColumn("n", F.count("*").over(Window.partitionBy("book_id"))).join(sizes, "book_id")
    sound = counted.where((F.col("n") >= least) & (F.col("n") <= F.floor(F.col("n_pages") / pages_per_chapter)))
    return sound.select("book_id", "title", F.col("page_num").alias("start_page"), F.col("page_num").alias("seq"))


def group_pages(pages: DataFrame, per_chapter: int = 20) -> DataFrame:
    """(book_id, page_num, text, chapter_seq, chapter_id, title): so many pages in a row to a chapter, named by its pages."""
    order = Window.partitionBy("book_id").orderBy("page_num")
    placed = pages.withColumn("chapter_seq", (F.floor((F.row_number().over(order) - 1) / per_chapter) + 1).cast("int"))
    whole = Window.partitionBy("book_id", "chapter_seq")
    title = F.concat(F.lit("Pages "), (F.min("page_num").over(whole) + 1).cast("string"), F.lit("-"), (F.max("page_num").over(whole) + 1).cast("string"))
    return placed.select("book_id", "page_num", "text", "chapter_seq", chapter_id(F.col("chapter_seq")).alias("chapter_id"), title.alias("title"))


def in_ranges(pages: DataFrame, ranges: DataFrame, most: int = 10_000) -> DataFrame:
    """Pages in the given inclusive ranges (chapter_id, title, start_page, end_page; pages from 1) of every book.

    The ranges are a list that someone wrote; they are broadcast if there are at most `most`, else spread out by page
    and joined on it, with the same result. A range that ends before it starts holds no page.
    """
    listed = ranges.where("start_page <= end_page")
    if listed.limit(most + 1).count() <= most:
        return pages.join(F.broadcast(listed), (F.col("page_num") + 1).between(F.col("start_page"), F.col("end_page")))
    by_page = listed.withColumn("page_num", F.explode(F.sequence(F.col("start_page") - 1, F.col("end_page") - 1)))
    return pages.join(by_page, "page_num")


def assemble(pages: DataFrame, joint: str = "\n\n") -> DataFrame:
    """(book_id, chapter_seq, chapter_id, title, content, word_count, char_count), the pages' texts in order; chapters
    without text are dropped and numbers keep their gaps."""
    texts = F.array_sort(F.collect_list(F.struct("page_num", "text")))
    joined = pages.groupBy("book_id", "chapter_seq", "chapter_id", "title").agg(F.array_join(F.transform(texts, lambda p: p["text"]), joint).alias("content"))
    full = joined.where(X.strip(F.col("content")) != "")
    return full.withColumns({"word_count": X.word_count(F.col("content")), "char_count": X.char_count(F.col("content"))})


def filter_chapters(chapters: DataFrame, include: list[str] | None, exclude: list[str] | None, include_wins: bool = True, column: str = "chapter_id") -> DataFrame:
    """Chapters in include and not in exclude; empty lists are no filter. include_wins: with include, exclude is ignored."""
    if include:
        chapters = chapters.where(F.col(column).isin(include))
    if exclude and not (include and include_wins):
        chapters = chapters.where(~F.col(column).isin(exclude))
    return chapters


#: Parts of a book that aren't read aloud unless asked for; a fixed list.
BACK_MATTER = ["frontcoverImage", "title", "copyrightPage", "contents", "notes", "bibliography", "index", "maps", "timeline"]


def select_pages(pages: DataFrame, include: list[object] | None, exclude: list[object] | None) -> DataFrame:
    """Pages (from 1) by lists of numbers; a list with anything but whole numbers is no filter."""
    for wanted, numbers in ((True, include), (False, exclude)):
        if numbers and all(isinstance(n, int) for n in numbers):
            inside = (F.col("page_num") + 1).isin(numbers)
            pages = pages.where(inside if wanted else ~inside)
    return pages


def selected_ids(chapters: DataFrame, ids: DataFrame, column: str = "chapter_id") -> DataFrame:
    """Chapters whose id is in the column of ids."""
    return chapters.join(ids.select(F.col(column)), column, "left_semi")


def page_numbers_of_ids(ids: DataFrame, column: str = "chapter_id") -> DataFrame:
    """page_num from 0 of ids page_N; other ids are ignored."""
    number = F.regexp_extract(column, r"^page_(\d+)$", 1)
    return ids.where(number != "").select((number.cast("int") - 1).alias("page_num"))


def short_content_dropped(chapters: DataFrame, least: int = 50, column: str = "content") -> DataFrame:
    return chapters.where(F.length(X.strip(F.col(column))) >= least)


def inventory(chapters: DataFrame, kept: DataFrame) -> DataFrame:
    """Every chapter with whether it is kept, and the words kept so far."""
    marked = chapters.join(kept.select("book_id", "chapter_seq", F.lit(True).alias("kept")), ["book_id", "chapter_seq"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    order = Window.partitionBy("book_id").orderBy("chapter_seq").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("running_words", F.coalesce(F.sum(F.when(F.col("kept"), F.col("word_count"))).over(order), F.lit(0)).cast("long"))


def first_of_each(rows: DataFrame, k: int, order: str, by: str = "book_id") -> DataFrame:
    """The first k rows of each book, and how many more there are."""
    w = Window.partitionBy(by)
    return rows.withColumn("rank", F.row_number().over(w.orderBy(order))).withColumn("more", F.greatest(F.lit(0), F.count("*").over(w) - k).cast("long")).where(F.col("rank") <= k)
