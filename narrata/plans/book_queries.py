"""Queries of pages, chapters, chunks and costs of all documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import quality as Q
from narrata.functions import text as X
from narrata.functions.gates import preview_of, preview_rejected
from narrata.operators import chapters as C
from narrata.operators import chunking as K
from narrata.operators import cost as P
from narrata.plans import text_queries as TQ
from narrata.sources.tables import PAGES_SQL, pages, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


N_WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
CHAPTERS_SQL = (
    PAGES_SQL
    + f""", grouped as (select book_id, cast(page_num // 20 + 1 as int) as chapter_seq, 'Pages ' || (min(page_num) + 1) || '-' || (max(page_num) + 1) as title,
  string_agg(text, chr(10) || chr(10) order by page_num) as content from pages_ group by 1, 2),
chapters as (select *, printf('chapter_%03d', chapter_seq) as chapter_id, cast({N_WORDS.format("content")} as bigint) as word_count, cast(length(content) as bigint) as char_count
  from grouped where {TQ.strip_sql("content")} <> '')"""
)


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' chapters: 20 lines each."""
    return C.assemble(C.group_pages(pages(spark, sf_dir)))


def chunk_sql(text: str, size: int, extra: str = "", key: str = "doc_id", source: str = "documents") -> str:
    """CTEs: packed(doc_id, chunk_idx, text) by whole sentences up to so many words."""
    return f"""recursive src as (select {key} as doc_id, {text} as t{extra} from {source}),
sents as (select doc_id, generate_subscripts(s, 1) as pos, unnest(s) as sent from (select doc_id, {TQ.SPLIT.format(t="t")} as s from src where {TQ.strip_sql("t")} <> '')),
sized as (select *, {N_WORDS.format("sent")} as n from sents),
fold as (select doc_id, pos, n as run, 0 as chunk_idx from sized where pos = 1
  union all select s.doc_id, s.pos, case when f.run + s.n > {size} then s.n else f.run + s.n end, case when f.run + s.n > {size} then f.chunk_idx + 1 else f.chunk_idx end
  from fold f join sized s on s.doc_id = f.doc_id and s.pos = f.pos + 1),
packed as (select f.doc_id, f.chunk_idx, string_agg(s.sent, ' ' order by s.pos) as text from fold f join sized s using (doc_id, pos) group by 1, 2)"""


CLEANED_SQL = TQ.collapse_sql(TQ.replace_sql(TQ._FOOT.format(t=TQ._CAPS.format(t="text")), TQ._PLAIN))


@query(
    f"""with {chunk_sql(CLEANED_SQL, 150)},
c as (select doc_id, count(*) as chunks, sum({N_WORDS.format("text")}) as words, sum(length(text)) as chars from packed group by 1)
select d.lang, cast(count(*) as bigint) as books, cast(sum(ceil(len(string_split(d.text, chr(10))) / 20.0)) as bigint) as chapters, cast(coalesce(sum(chunks), 0) as bigint) as chunks,
  cast(coalesce(sum(words), 0) as bigint) as words, cast(coalesce(sum(chars), 0) as bigint) as chars, round(coalesce(sum(chars), 0) * (0.015 / 1000), 6) as cost_usd
from documents d left join c using (doc_id) group by 1"""
)
def flagship_book_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned, cut into chunks of 150 words and priced, by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    lines = F.ceil(F.size(F.split("text", "\n")) / 20).cast("long")
    books = docs.select("lang", lines.alias("chapters")).groupBy("lang").agg(F.count("*").alias("books"), F.sum("chapters").alias("chapters"))
    cleaned = docs.select("lang", X.apply_text_cleaning(F.col("text"), ascii=True).alias("text"))
    sized = K.with_metadata(K.chunk_words_simple(cleaned, 150)).withColumn("model", F.lit("gpt-4o-mini-tts"))
    costs = P.priced(sized, "per_1k").groupBy("lang", "usd_per_char").agg(F.count("*").alias("chunks"), F.sum("words").alias("words"), F.sum("chars").alias("chars"))
    out = books.join(costs, "lang", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("lang", "books", "chapters", count("chunks"), count("words"), count("chars"), F.round(F.coalesce(F.col("chars") * F.col("usd_per_char"), F.lit(0.0)), 6).alias("cost_usd"))


@query(f"with {PAGES_SQL} select book_id, cast(page_num + 1 as int) as page_num, cast({N_WORDS.format('text')} as bigint) as words, substr(text, 1, 50) as preview from pages_")
def s06_list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its words and its first 50 characters."""
    return pages(spark, sf_dir).select("book_id", (F.col("page_num") + 1).alias("page_num"), X.word_count(F.col("text")).alias("words"), F.substring("text", 1, 50).alias("preview"))


@query(f"with {CHAPTERS_SQL} select book_id, chapter_seq, chapter_id, title, word_count, char_count, md5(content) as digest from chapters")
def w04_group_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of 20 pages."""
    return chapters(spark, sf_dir).select("book_id", "chapter_seq", "chapter_id", "title", "word_count", "char_count", F.md5("content").alias("digest"))


@query(f"with {CHAPTERS_SQL} select book_id, md5(string_agg(content, chr(10) || chr(10) order by chapter_seq)) as digest from chapters group by 1")
def a08_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books put together from their chapters."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_seq", "content"))), lambda c: c["content"]), "\n\n")
    return chapters(spark, sf_dir).groupBy("book_id").agg(F.md5(joined).alias("digest"))


@query(f"with {CHAPTERS_SQL} select book_id, count(*) as chapters, cast(sum(word_count) as bigint) as words, cast(sum(char_count) as bigint) as chars from chapters group by 1")
def a01_book_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters(spark, sf_dir).groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum("word_count").alias("words"), F.sum("char_count").alias("chars"))


#: Every 12th page begins a chapter of its book's contents, of a level that depends on the book.
TOC_SQL = "toc as (select book_id, page_num // 12 as toc_seq, case when book_id % 3 = 0 then 2 when page_num // 12 % 2 = 0 then 1 else 2 end as level, 'Part ' || page_num as title, page_num from pages_ where page_num % 12 = 3)"
BOUNDS_SQL = """tops as (select *, max(case when level = 1 then 1 else 0 end) over (partition by book_id) as has_top from toc),
bounds as (select book_id, cast(row_number() over (partition by book_id order by page_num, toc_seq) as int) as chapter_seq, title, page_num as start_page, lead(page_num) over (partition by book_id order by page_num, toc_seq) as end_page
  from tops where has_top = 0 or level = 1)"""


def _toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).where(F.col("page_num") % 12 == 3)
    level = F.when(F.col("book_id") % 3 == 0, 2).when(F.floor(F.col("page_num") / 12) % 2 == 0, 1).otherwise(2)
    return p.select("book_id", F.floor(F.col("page_num") / 12).alias("toc_seq"), level.alias("level"), F.concat(F.lit("Part "), F.col("page_num").cast("string")).alias("title"), "page_num")


def _toc_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = C.top_entries(_toc(spark, sf_dir))
    return C.boundaries(tops.select("book_id", "title", F.col("page_num").alias("start_page"), F.col("toc_seq").alias("seq")))


@query(f"with {PAGES_SQL}, {TOC_SQL}, {BOUNDS_SQL} select book_id, chapter_seq, printf('chapter_%03d', chapter_seq) as chapter_id, title, start_page, end_page from bounds")
def w02_next_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter bounds of the tables of contents (also W3: their ids)."""
    return _toc_bounds(spark, sf_dir)


@query(
    f"""with {PAGES_SQL}, {TOC_SQL}, {BOUNDS_SQL} select p.book_id, b.chapter_seq, b.title, count(*) as pages, min(p.page_num) as first_page, cast(sum(length(p.text)) as bigint) as chars
from pages_ p join bounds b on p.book_id = b.book_id and p.page_num >= b.start_page and (b.end_page is null or p.page_num < b.end_page) group by 1, 2, 3"""
)
def j03_pages_to_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the chapter of the contents that they are in."""
    placed = C.assign_pages(pages(spark, sf_dir), _toc_bounds(spark, sf_dir))
    return placed.groupBy("book_id", "chapter_seq", "title").agg(F.count("*").alias("pages"), F.min("page_num").alias("first_page"), F.sum(F.length("text")).cast("long").alias("chars"))


HEADED_SQL = """, headed as (select book_id, page_num, n_images, case when page_num % 12 = 2 then ['Chapter One', 'PART II: x', 'Preface', 'Notes', 'Chapter 7', 'Index'][(page_num // 12 + book_id) % 6 + 1] || chr(10) || text else text end as text from pages_)"""
_NOT_RUNNING = "not (regexp_matches(l, '\\d+\\s*$') and length(l) < 50)"
_IS_HEADING = f"length(l) <= 60 and {_NOT_RUNNING} and regexp_matches(l, '(?i)^(?:{'|'.join(Q.HEADINGS)})$')"
HEADINGS_SQL = f"""found as (select book_id, page_num, list_filter(list_filter(list_transform(string_split(substr(text, 1, 300), chr(10)), lambda l: {TQ.strip_sql("l")}), lambda l: l <> '')[1:3], lambda l: {_IS_HEADING})[1] as title from headed),
kinds as (select *, lower(string_split(title, ' ')[1]) as kind from found where title is not null),
firsts as (select * from (select *, row_number() over (partition by book_id, kind order by page_num) as r from kinds) where r = 1),
kept as (select f.*, count(*) over (partition by f.book_id) as n, s.n_pages from firsts f join (select book_id, count(*) as n_pages from headed group by 1) s using (book_id)),
starts as (select book_id, title, page_num from kept where n >= 4 and n <= n_pages // 10)"""


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["Chapter One", "PART II: x", "Preface", "Notes", "Chapter 7", "Index"]))
    name = F.get(names, ((F.floor(F.col("page_num") / 12) + F.col("book_id")) % 6).cast("int"))
    return pages(spark, sf_dir).withColumn("text", F.when(F.col("page_num") % 12 == 2, F.concat(name, F.lit("\n"), F.col("text"))).otherwise(F.col("text")))


@query(f"with {PAGES_SQL}{HEADED_SQL}, {HEADINGS_SQL} select book_id, page_num, title from found where title is not null")
def t27_page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings at the tops of pages, which are put in alike on both sides."""
    return _headed(spark, sf_dir).select("book_id", "page_num", Q.page_heading(F.col("text")).alias("title")).where("title IS NOT NULL")


@query(f"with {PAGES_SQL}{HEADED_SQL}, {HEADINGS_SQL} select book_id, title, page_num as start_page from starts")
def a10_heading_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heading of each kind of books with a plausible number of them (also A11)."""
    return C.detect_headings(_headed(spark, sf_dir)).select("book_id", "title", "start_page")


@query(
    f"""with {PAGES_SQL}{HEADED_SQL}, {HEADINGS_SQL}, spans as (select *, lead(page_num) over (partition by book_id order by page_num) as end_page from starts)
select s.book_id, s.title, count(*) as pages from spans s join headed p on p.book_id = s.book_id and p.page_num >= s.page_num and (s.end_page is null or p.page_num < s.end_page) group by 1, 2"""
)
def j04_pages_to_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the detected chapter that they are in."""
    p = _headed(spark, sf_dir)
    return C.assign_pages(p, C.boundaries(C.detect_headings(p))).groupBy("book_id", "title").agg(F.count("*").alias("pages"))


RANGES = [("intro", "Introduction", 1, 3), ("one", "One", 4, 9), ("two", "Two", 10, 24), ("late", "Late", 60, 400), ("none", "None", None, None)]


@query(
    f"with {PAGES_SQL} select r.chapter_id, r.title, count(*) as pages, count(distinct book_id) as books, cast(sum(length(text)) as bigint) as chars from pages_ join (values "
    + ", ".join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in RANGES if c)
    + ") r(chapter_id, title, lo, hi) on page_num + 1 between lo and hi group by 1, 2"
)
def j05_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in a written list of ranges."""
    ranges = spark.createDataFrame(RANGES, "chapter_id string, title string, start_page int, end_page int")
    return C.in_ranges(pages(spark, sf_dir), ranges).groupBy("chapter_id", "title").agg(F.count("*").alias("pages"), F.countDistinct("book_id").alias("books"), F.sum(F.length("text")).cast("long").alias("chars"))


_Q = TQ.QUALITY.format(t="text")
EXTRACTED_SQL = f"""scored as (select *, {_Q} as q from pages_), ocr as (select book_id, page_num, 'read' as ocr_text from pages_ where page_num % 5 = 0),
extracted as (select s.*, case when not ((length({TQ.strip_sql("s.text")}) < 50 and n_images > 0) or q < 0.6) then 'direct' when ocr_text is not null then 'ocr' when {TQ.strip_sql("s.text")} <> '' then 'direct' else 'failed' end as method,
  case when not ((length({TQ.strip_sql("s.text")}) < 50 and n_images > 0) or q < 0.6) then 1.0 when ocr_text is not null then 0.9 when {TQ.strip_sql("s.text")} <> '' then 0.5 else 0.0 end as confidence from scored s left join ocr using (book_id, page_num))"""


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    ocr = p.where("page_num % 5 = 0").select("book_id", "page_num", F.lit("read").alias("ocr_text"))
    scored = p.withColumn("quality", Q.text_quality(F.col("text"))).join(ocr, ["book_id", "page_num"], "left")
    return scored.withColumn("e", Q.extraction(F.col("text"), F.col("n_images"), F.col("quality"), F.col("ocr_text"))).select("*", "e.method", "e.confidence")


@query(f"with {PAGES_SQL}, {EXTRACTED_SQL} select book_id, page_num, method, cast(confidence as double) as confidence from extracted")
def t26_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each page was read and how sure that is."""
    return _extracted(spark, sf_dir).select("book_id", "page_num", "method", "confidence")


@query(f"with {PAGES_SQL}, {EXTRACTED_SQL} select book_id, count(*) filter (method = 'direct') as direct, count(*) filter (method = 'ocr') as ocr, count(*) filter (method = 'failed') as failed from extracted group by 1")
def a03_extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda m: F.count_if(F.col("method") == m).alias(m)
    return _extracted(spark, sf_dir).groupBy("book_id").agg(of("direct"), of("ocr"), of("failed"))


@query(f"with {PAGES_SQL}, {EXTRACTED_SQL} select book_id, page_num from extracted where (length({TQ.strip_sql('text')}) < 50 and n_images > 0) or q < 0.6")
def s20_ocr_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to be read again."""
    scored = pages(spark, sf_dir).withColumn("quality", Q.text_quality(F.col("text")))
    return scored.where(Q.needs_ocr(F.col("text"), F.col("n_images"), F.col("quality"))).select("book_id", "page_num")


_CH = f"with {CHAPTERS_SQL} "


@query(_CH + "select book_id, chapter_id from chapters where chapter_id in ('chapter_001', 'chapter_003')")
def f01_include_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an include list the exclude list is ignored."""
    return C.filter_chapters(chapters(spark, sf_dir), ["chapter_001", "chapter_003"], ["chapter_001"]).select("book_id", "chapter_id")


@query(_CH + "select book_id, chapter_id from chapters where chapter_id in ('chapter_001', 'chapter_003') and chapter_id not in ('chapter_001')")
def f02_include_and_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filter_chapters(chapters(spark, sf_dir), ["chapter_001", "chapter_003"], ["chapter_001"], include_wins=False).select("book_id", "chapter_id")


@query("with named as (select doc_id, case doc_id % 4 when 0 then 'index' when 1 then 'notes' else 'chapter1' end as item from documents) select doc_id, item from named where item not in (" + ", ".join(f"'{x}'" for x in C.BACK_MATTER) + ")")
def f03_back_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the standard exclusion list go."""
    k = F.col("doc_id") % 4
    named = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "index").when(k == 1, "notes").otherwise("chapter1").alias("item"))
    return C.filter_chapters(named, None, C.BACK_MATTER, column="item")


@query(f"with {PAGES_SQL} select book_id, page_num from pages_ where page_num + 1 in (1, 2, 3, 4, 9) and page_num + 1 not in (3)")
def f04_page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by lists of numbers; the list with a name in it is no filter."""
    chosen = C.select_pages(pages(spark, sf_dir), [1, 2, 3, 4, 9], [3])
    return C.select_pages(chosen, ["cover", 1], None).select("book_id", "page_num")


@query(f"with {PAGES_SQL} select book_id, page_num from pages_ where page_num in (1, 6)")
def f05_selected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages named by ids page_N; other ids are ignored."""
    ids = spark.createDataFrame([("page_2",), ("page_7",), ("page_x",), ("intro",)], "chapter_id string")
    return pages(spark, sf_dir).join(C.page_numbers_of_ids(ids), "page_num", "left_semi").select("book_id", "page_num")


@query(_CH + f"select book_id, chapter_id from chapters where length({TQ.strip_sql('content')}) >= 50")
def f07_short_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.short_content_dropped(chapters(spark, sf_dir)).select("book_id", "chapter_id")


@query("select page_id, case when regexp_matches(lower(url), '^https?://[^/]+') then 'ok' else 'rejected' end as status, regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) as host from pages")
def f09_url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with a scheme and a host."""
    from narrata.functions.web import normalize_url, url_host

    url = normalize_url(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(url.isNotNull(), "ok").otherwise("rejected").alias("status"), url_host(url).alias("host"))


@query("select doc_id, length(text) > 500 as rejected, left(text, 500) as preview from documents")
def f11_preview_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over 500 characters have no preview of their own; the first 500 are shown."""
    return table(spark, sf_dir, "documents").select("doc_id", preview_rejected(F.col("text")).alias("rejected"), preview_of(F.col("text")).alias("preview"))


@query(_CH + "select book_id, chapter_seq, chapter_id <> 'chapter_002' as kept, cast(coalesce(sum(case when chapter_id <> 'chapter_002' then word_count end) over (partition by book_id order by chapter_seq), 0) as bigint) as running_words from chapters")
def a13_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chapters with those that a run would keep."""
    ch = chapters(spark, sf_dir).select("book_id", "chapter_seq", "chapter_id", "word_count")
    return C.inventory(ch, C.filter_chapters(ch, None, ["chapter_002"])).select("book_id", "chapter_seq", "kept", "running_words")


@query(_CH + "select book_id, chapter_seq, greatest(0, n - 2) as more from (select *, count(*) over (partition by book_id) as n, row_number() over (partition by book_id order by chapter_seq) as r from chapters) where r <= 2")
def l01_first_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two chapters of each book and how many more there are."""
    return C.first_of_each(chapters(spark, sf_dir).select("book_id", "chapter_seq"), 2, "chapter_seq").select("book_id", "chapter_seq", "more")


_RATE = "case model when 'tts-1-hd' then 0.030 / 1000 else 0.015 / 1000 end"
_MODELLED = "modelled as (select *, ['tts-1', 'tts-1-hd', 'other'][book_id % 3 + 1] as model from chapters)"


def _modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.lit("tts-1"), F.lit("tts-1-hd"), F.lit("other"))
    return P.priced(chapters(spark, sf_dir).withColumn("model", F.get(names, (F.col("book_id") % 3).cast("int"))), "per_1k")


@query(f"with {CHAPTERS_SQL}, {_MODELLED} select book_id, chapter_seq, model, round(char_count * ({_RATE}), 9) as usd from modelled")
def j14_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters with their price by model; an unknown model has the standard rate (also T24)."""
    return _modelled(spark, sf_dir).select("book_id", "chapter_seq", "model", F.round(F.col("char_count") * F.col("usd_per_char"), 9).alias("usd"))


@query(
    f"""with {CHAPTERS_SQL}, {_MODELLED} select book_id, cast(sum(char_count) as bigint) as total_chars, cast(sum(word_count) as bigint) as total_words, round(sum(char_count) * max({_RATE}), 9) as usd,
  cast(sum(length(title) + 10) + 25 as bigint) as extra_chars, round((sum(length(title) + 10) + 25) * max({_RATE}), 9) as extra_usd from modelled group by 1"""
)
def a02_book_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's cost with its announcements."""
    c = P.book_costs(_modelled(spark, sf_dir), extra_chars=25)
    return c.withColumns({"usd": F.round("usd", 9), "extra_usd": F.round("extra_usd", 9)})


@query(
    f"""with {CHAPTERS_SQL}, {_MODELLED}, s as (select m.*, d.source from modelled m join documents d on d.doc_id = m.book_id)
select source, model, cast(grouping_id(source, model) as bigint) as level, cast(sum(char_count) as bigint) as chars, round(sum(char_count * ({_RATE})), 6) as usd from s group by rollup(source, model)"""
)
def a02_cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by source and model, by source, and in all."""
    named = _modelled(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), "source"), "book_id")
    return P.cost_rollup(named, "source", "model").withColumn("usd", F.round("usd", 6))


@query(_CH + f"select book_id, chapter_seq, word_count / 150.0 * 60.0 as seconds, round_even(char_count / 1000.0, 1) as minutes from chapters")
def t25_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listening time by words and by characters."""
    return chapters(spark, sf_dir).select("book_id", "chapter_seq", P.listening_seconds(F.col("word_count")).alias("seconds"), P.reading_minutes(F.col("char_count")).alias("minutes"))


@query(f"with {chunk_sql('text', 150)} select doc_id, chunk_idx, cast({N_WORDS.format('text')} as bigint) as words, md5({TQ.collapse_sql('text')}) as digest from packed")
def c01_chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole sentences up to 150 words."""
    c = K.chunk_words(table(spark, sf_dir, "documents").select("doc_id", "text"), 150)
    return c.select("doc_id", "chunk_idx", X.word_count(F.col("text")).alias("words"), F.md5(X.collapse_spaces(F.col("text"))).alias("digest"))


@query(f"with {chunk_sql(TQ.collapse_sql('text'), 150)} select doc_id, chunk_idx, cast({N_WORDS.format('text')} as bigint) as words, cast(length(text) as bigint) as chars, cast(ceil(length(text) / 4.0) as bigint) as tokens, md5(text) as digest from packed")
def c03_chunk_words_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of collapsed text with their sizes (also C7)."""
    c = K.with_metadata(K.chunk_words_simple(table(spark, sf_dir, "documents").select("doc_id", "text"), 150))
    return c.select("doc_id", "chunk_idx", "words", "chars", "tokens", F.md5("text").alias("digest"))


@query(ORACLE_SQL["c03_chunk_words_simple"].replace("cast(length(text) as bigint) as chars, cast(ceil(length(text) / 4.0) as bigint) as tokens, ", ""))
def c03_chunk_words_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks by a fold inside the JVM."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(K.chunk_words_sql(F.col("text"), 150)).alias("chunk_idx", "text"))
    return c.select("doc_id", "chunk_idx", X.word_count(F.col("text")).alias("words"), F.md5("text").alias("digest"))


@query(f"with {chunk_sql(TQ.collapse_sql('text'), 150)} select doc_id, count(*) as chunks, avg({N_WORDS.format('text')}) as mean_words from packed group by 1")
def a04_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = K.with_metadata(K.chunk_words_simple(table(spark, sf_dir, "documents").select("doc_id", "text"), 150))
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.avg("words").alias("mean_words"))


@query(
    f"""with recursive sents as (select doc_id, generate_subscripts(s, 1) as place, unnest(s) as sent from (select doc_id, {TQ.SPLIT.format(t="text")} as s from documents where {TQ.strip_sql("text")} <> '')),
long as (select *, {N_WORDS.format("sent")} > 12 as is_long from sents),
cut as (select doc_id, place, is_long, generate_subscripts(p, 1) as k, unnest(p) as part from (select *, case when is_long then regexp_split_to_array(sent, '[,;:]') else [sent] end as p from long)),
sized as (select doc_id, part, is_long and k = 1 as begins, {N_WORDS.format("part")} as n, row_number() over (partition by doc_id order by place, k) as pos from cut),
fold as (select doc_id, pos, n as run, 0 as grp from sized where pos = 1
  union all select s.doc_id, s.pos, case when s.begins or f.run + s.n > 12 then s.n else f.run + s.n end, case when s.begins or f.run + s.n > 12 then f.grp + 1 else f.grp end
  from fold f join sized s on s.doc_id = f.doc_id and s.pos = f.pos + 1),
packed as (select f.doc_id, f.grp, string_agg(s.part, ' ' order by s.pos) as joined from fold f join sized s using (doc_id, pos) group by 1, 2),
kept as (select doc_id, grp, {TQ.strip_sql("joined")} as text from packed)
select doc_id, cast(row_number() over (partition by doc_id order by grp) - 1 as int) as chunk_idx, text from kept where text <> ''"""
)
def c02_chunk_words_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks up to 12 words with long sentences cut at clauses."""
    return K.chunk_words_clauses(table(spark, sf_dir, "documents").select("doc_id", "text"), 12)


def nested_sql(limit: int, joint: int) -> str:
    """CTEs: packed(doc_id, chunk_idx, text) of units(doc_id, a, b, c, level, u, n), in the order of a, b, c, whose sizes n
    and joints fill chunks to the limit. Wholes are of level 0, pieces of a whole a of level 1, words of its piece b of
    level 2; chunks never mix levels, wholes or pieces."""
    return f"""placed as (select *, row_number() over w as pos, coalesce(level <> lag(level) over w or level > 0 and a <> lag(a) over w or level = 2 and b <> lag(b) over w, true) as begins
  from units window w as (partition by doc_id order by a, b, c)),
fold as (select doc_id, pos, n as run, 0 as chunk_idx from placed where pos = 1
  union all select doc_id, pos, case when fresh then n else run + n + {joint} end, chunk_idx + cast(fresh as int)
  from (select s.doc_id, s.pos, s.n, f.run, f.chunk_idx, s.begins or f.run + s.n + {joint} > {limit} as fresh from fold f join placed s on s.doc_id = f.doc_id and s.pos = f.pos + 1)),
packed as (select f.doc_id, f.chunk_idx, case when max(s.level) = 0 then string_agg(s.u, chr(10) order by s.pos) else string_agg(s.u, ' ' order by s.pos) end as lined, string_agg(s.u, ' ' order by s.pos) as text
  from fold f join placed s using (doc_id, pos) group by 1, 2)"""


_N_TOKENS = "cast(ceil(length({}) / 4.0) as int)"
_MARKED = "string_split(regexp_replace(sent, '({})\\s*', '\\1' || chr(1), 'g'), chr(1))"


@query(
    f"""with recursive flat as (select doc_id, string_split(regexp_replace({TQ.collapse_sql("text")}, '([.!?]) ([A-Z"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as s from documents),
sents as (select doc_id, generate_subscripts(s, 1) as a, unnest(s) as sent from flat),
parted as (select doc_id, a, case when {_N_TOKENS.format("sent")} <= 60 then [sent] when len({_MARKED.format("[;:—–]")}) > 1 then {_MARKED.format("[;:—–]")} else {_MARKED.format(",")} end as p, {_N_TOKENS.format("sent")} > 60 as is_long from sents where sent <> ''),
parts as (select doc_id, a, is_long, generate_subscripts(p, 1) as b, unnest(p) as part from parted),
worded as (select *, is_long and {_N_TOKENS.format("part")} > 60 as in_words from parts),
pieces as (select doc_id, a, b, case when in_words then 2 when is_long then 1 else 0 end as level, case when in_words then list_filter(string_split(part, ' '), lambda w: w <> '') else [part] end as w from worded),
spread as (select doc_id, a, b, level, generate_subscripts(w, 1) as c, unnest(w) as u from pieces),
units as (select *, case when level = 2 then {_N_TOKENS.format("u || ' '")} else {_N_TOKENS.format("u")} end as n from spread),
{nested_sql(60, 0)} select doc_id, chunk_idx, text from packed"""
)
def c04_chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks up to 60 tokens."""
    return K.chunk_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), 60)


@query(
    f"""with recursive src as (select doc_id, {TQ.strip_sql("text")} as t from documents),
lines as (select doc_id, generate_subscripts(l, 1) as a, unnest(l) as line from (select doc_id, string_split(t, chr(10)) as l from src where strlen(t) > 4096)),
paras as (select doc_id, a, {TQ.strip_sql("line")} as para from lines),
parted as (select doc_id, a, strlen(para) > 4096 as is_long, case when strlen(para) > 4096 then string_split(regexp_replace(para, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) else [para] end as p from paras where para <> ''),
parts as (select doc_id, a, is_long, generate_subscripts(p, 1) as b, unnest(p) as part from parted),
stripped as (select * replace ({TQ.strip_sql("part")} as part) from parts),
pieces as (select doc_id, a, b, case when strlen(part) > 4096 then 2 when is_long then 1 else 0 end as level, case when strlen(part) > 4096 then list_filter(regexp_split_to_array(part, '\\s+'), lambda w: w <> '') else [part] end as w from stripped where part <> ''),
spread as (select doc_id, a, b, level, generate_subscripts(w, 1) as c, unnest(w) as u from pieces),
units as (select *, strlen(u) as n from spread),
{nested_sql(4096, 1)} select doc_id, chunk_idx, lined as text from packed union all select doc_id, 0, t from src where strlen(t) <= 4096"""
)
def c05_chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks up to 4,096 bytes."""
    return K.chunk_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 4096)


_BREAKS = TQ._sql_string(".\n\n\n")


@query(
    f"""with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', {_BREAKS}), '\\n\\n+'), lambda p: {TQ.strip_sql("p")}), lambda p: p <> '') as parts from documents)
select doc_id, cast(generate_subscripts(parts, 1) - 1 as int) as chunk_idx, unnest(parts) as text from p"""
)
def c06_chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs; blank lines are put in behind stops."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n\n")).alias("text"))
    return K.chunk_paragraphs(docs)


@query(
    f"""with {chunk_sql(TQ.collapse_sql('text'), 400)},
failed as (select doc_id, chunk_idx as parent_idx, cast(doc_id % 3 + 1 as int) as attempt, {TQ.SPLIT.format(t="text")} as s from packed where (doc_id + chunk_idx) % 3 = 0),
again as (select doc_id, parent_idx, attempt, generate_subscripts(s, 1) as pos, unnest(s) as sent from failed),
counted as (select *, {N_WORDS.format("sent")} as n, [200, 100, 50][attempt] as most from again),
refold as (select doc_id, parent_idx, pos, n as run, 0 as chunk_idx from counted where pos = 1
  union all select s.doc_id, s.parent_idx, s.pos, case when f.run + s.n > s.most then s.n else f.run + s.n end, case when f.run + s.n > s.most then f.chunk_idx + 1 else f.chunk_idx end
  from refold f join counted s on s.doc_id = f.doc_id and s.parent_idx = f.parent_idx and s.pos = f.pos + 1)
select f.doc_id, s.attempt, f.parent_idx, f.chunk_idx, string_agg(s.sent, ' ' order by s.pos) as text from refold f join counted s using (doc_id, parent_idx, pos) group by 1, 2, 3, 4"""
)
def c08_rechunk_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third chunk of 400 words cut again at half the size for each attempt."""
    c = K.chunk_words_simple(table(spark, sf_dir, "documents").select("doc_id", "text"), 400)
    failed = c.where((F.col("doc_id") + F.col("chunk_idx")) % 3 == 0).withColumn("attempt", (F.col("doc_id") % 3 + 1).cast("int"))
    return K.rechunk_failed(failed, 400, 50)


@query(
    f"""with recursive sents as (select doc_id, generate_subscripts(s, 1) as place, unnest(s) as sent from (select doc_id, {TQ.SPLIT.format(t="text")} as s from documents where {TQ.strip_sql("text")} <> '')),
cut as (select doc_id, place, length(sent) > 200 as is_long, generate_subscripts(p, 1) as k, unnest(p) as part from (select *, case when length(sent) > 200 then list_filter(regexp_split_to_array(sent, '\\s+'), lambda w: w <> '') else [sent] end as p from sents)),
sized as (select *, row_number() over (partition by doc_id order by place, k) as pos, case when is_long then 0 else {N_WORDS.format("part")} end as n, length(part) + 1 as size from cut),
flagged as (select *, is_long and k = 1 or coalesce(is_long <> lag(is_long) over (partition by doc_id order by pos), true) as begins from sized),
fold as (select doc_id, pos, n as run, size as chars, 0 as grp from flagged where pos = 1
  union all select s.doc_id, s.pos, case when fresh then s.n else s.run + s.n end, case when fresh then s.size else s.chars + s.size end, s.grp + cast(fresh as int)
  from (select s.*, f.run, f.chars, f.grp, s.begins or f.run + s.n > 50 or f.chars + s.size > case when s.is_long then 201 else 200 end as fresh from fold f join flagged s on s.doc_id = f.doc_id and s.pos = f.pos + 1) s),
packed as (select f.doc_id, f.grp, string_agg(s.part, ' ' order by s.pos) as joined from fold f join flagged s using (doc_id, pos) group by 1, 2),
kept as (select doc_id, grp, {TQ.strip_sql("joined")} as text from packed)
select doc_id, cast(row_number() over (partition by doc_id order by grp) - 1 as int) as chunk_idx, text from kept where text <> ''"""
)
def c09_highlight_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks up to 50 words and 200 characters."""
    return K.chunk_words(table(spark, sf_dir, "documents").select("doc_id", "text"), 50, 200)
