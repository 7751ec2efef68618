"""Segments in time: markers, subtitle cues and the files that players read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import text as X
from narrata.operators.ordered import numbered


def timeline(segments: DataFrame) -> DataFrame:
    """Adds start_time and end_time to (book_id, seq, duration, ...): a segment starts when those before it have ended."""
    before = Window.partitionBy("book_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    started = segments.withColumn("start_time", F.coalesce(F.sum("duration").over(before), F.lit(0.0)))
    return started.withColumn("end_time", F.col("start_time") + F.col("duration"))


def markers(segments: DataFrame) -> DataFrame:
    """Segments with an id and a title; the others only take time."""
    return timeline(segments).where("segment_id <> '' AND title <> ''").select("book_id", "seq", "segment_id", "title", "start_time", "end_time")


def segments_of_book(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, seq, segment_id, title, text): introduction, title, chapters, closing, as far as books has texts for them.

    books: (book_id, intro_text, title_text, outro_text).
    """

    def fixed(rank: int, segment_id: str, title: str, column: str) -> DataFrame:
        some = books.where(F.col(column).isNotNull() & (F.col(column) != ""))
        return some.select("book_id", F.lit(rank).alias("rank"), F.lit(0).alias("at"), F.lit(segment_id).alias("segment_id"), F.lit(title).alias("title"), F.col(column).alias("text"))

    middle = chapters.select("book_id", F.lit(2).alias("rank"), F.col("chapter_seq").alias("at"), F.col("chapter_id").alias("segment_id"), "title", F.col("content").alias("text"))
    rows = fixed(0, "_intro", "Introduction", "intro_text").unionByName(fixed(1, "_title", "Title", "title_text")).unionByName(middle).unionByName(fixed(3, "_outro", "Closing", "outro_text"))
    order = Window.partitionBy("book_id").orderBy("rank", "at")
    return rows.select("book_id", F.row_number().over(order).alias("seq"), "segment_id", "title", "text")


def announced(chunks: DataFrame, chapters: DataFrame, pause: float = 1.0, last_pause: float = 2.5) -> DataFrame:
    """Chunks with the chapter's title as chunk 0 and the pause behind each: `pause` after a title, last_pause at the end
    of a chapter, otherwise none."""
    titles = chapters.select("book_id", "chapter_seq", F.lit(0).alias("chunk_idx"), F.concat("title", F.lit(".")).alias("text"))
    rows = chunks.select("book_id", "chapter_seq", (F.col("chunk_idx") + 1).alias("chunk_idx"), "text").unionByName(titles)
    last = F.max("chunk_idx").over(Window.partitionBy("book_id", "chapter_seq"))
    return rows.withColumn("pause", F.when(F.col("chunk_idx") == last, F.lit(last_pause)).when(F.col("chunk_idx") == 0, F.lit(pause)).otherwise(F.lit(0.0)))


def cues(rows: DataFrame, keys: list[str], text_col: str = "text", duration_col: str = "duration") -> DataFrame:
    """(keys, cue, start_sec, end_sec, text): about three seconds of words a cue, at least eight words, spread evenly.

    Without a positive duration ten words a second are assumed, and ends are held at the duration all the same.
    """
    w, d = X.words(F.col(text_col)), F.col(duration_col)
    sized = rows.select(*keys, d.alias("d"), w.alias("w")).where(F.size("w") > 0).withColumn("rate", F.when(F.col("d") > 0, F.size("w") / F.col("d")).otherwise(F.lit(10.0)))
    sized = sized.withColumn("per", F.greatest(F.lit(8), F.floor(F.col("rate") * 3)).cast("int"))
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.col("per"))
    cut = sized.select(*keys, "d", "rate", "per", "w", F.posexplode(starts).alias("at", "pos"))
    part = F.slice("w", F.col("pos") + 1, F.col("per"))
    return cut.select(
        *keys,
        (F.col("at") + 1).alias("cue"),
        (F.col("pos") / F.col("rate")).alias("start_sec"),
        F.least((F.col("pos") + F.size(part)) / F.col("rate"), F.col("d")).alias("end_sec"),
        F.array_join(part, " ").alias("text"),
    )


def word_at(n_words: Column, seconds: Column, duration: Column) -> Column:
    """Which word is read at a time."""
    return F.floor(seconds * n_words / duration)


def _block(c: DataFrame) -> Column:
    return F.concat_ws("\n", F.col("cue").cast("string"), F.concat(X.clock(F.col("start_sec")), F.lit(" --> "), X.clock(F.col("end_sec"))), F.col("text"), F.lit(""))


def _in_order(value: Column, order: str, joint: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]), joint)


def to_srt(c: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content) of a subtitle file of the cues."""
    return c.groupBy(*keys).agg(_in_order(_block(c), "cue", "\n").alias("content"))


def to_vtt(c: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """(keys, content) of a WebVTT file: every comma becomes a point, in texts too; strict: only those of the times."""
    srt = to_srt(c, keys)
    body = F.regexp_replace("content", r"(\d{2}:\d{2}:\d{2}),(\d{3})", "$1.$2") if strict else F.replace("content", F.lit(","), F.lit("."))
    return srt.withColumn("content", F.concat(F.lit("WEBVTT\n\n"), body))


def to_ffmetadata(marks: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, content): title and author lines, then a chapter block for each marker, times in whole milliseconds."""
    ms = lambda c: F.floor(F.col(c) * 1000).cast("string")
    block = F.concat(F.lit("\n[CHAPTER]\nTIMEBASE=1/1000\nSTART="), ms("start_time"), F.lit("\nEND="), ms("end_time"), F.lit("\ntitle="), X.escape_metadata(F.col("title")))
    chapters = marks.groupBy("book_id").agg(_in_order(block, "seq", "\n").alias("chapters"))
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}="), X.escape_metadata(F.col(c))))
    head = books.select("book_id", F.concat_ws("\n", F.lit(";FFMETADATA1"), line("title", "book_title"), line("artist", "author")).alias("head"))
    return head.join(chapters, "book_id", "left").select("book_id", F.concat_ws("\n", "head", "chapters").alias("content"))


def to_concat_manifest(segments: DataFrame, path_col: str = "path") -> DataFrame:
    """(book_id, content): a file line for each segment in order, quotes escaped."""
    line = F.concat(F.lit("file '"), F.replace(F.col(path_col), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return segments.groupBy("book_id").agg(_in_order(line, "seq", "\n").alias("content"))


def output_names(rows: DataFrame, base_col: str, order: str, suffix: str) -> DataFrame:
    """Adds output_name: the base name, or with _2, _3 and so on where it came before, in the order of `order`.

    Names are numbered in ranges, so one that most rows have is many tasks. A null base name gives a null; rows of one name
    and order are numbered in any order; an empty table stays empty.
    """
    place = f"{base_col}__place"
    n = F.col(place)
    named = numbered(rows, [base_col], [order], place)
    return named.withColumn("output_name", F.concat(F.col(base_col), F.when(n > 0, F.concat(F.lit("_"), (n + 1).cast("string"))).otherwise(""), F.lit(suffix))).drop(place)


def staged_progress(i: Column, n: Column | None, low: float, span: float) -> Column:
    """low + span * i / n; with n unknown low + span * (1 - 1 / (i + 2))."""
    return F.lit(low) + F.lit(span) * (i / n if n is not None else 1 - 1 / (i + 2))
