"""Queries about running work: observed progress, plugged-in cleaners, expiry, patches, nested settings, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions.cleaners import Cleaners
from narrata.functions.vocabulary import Vocabulary, estimated_chunks, measured
from narrata.operators import patches as P
from narrata.operators import voices as V
from narrata.operators.progress import Progress, StreamProgress
from narrata.plans.stream_queries import event_stream, finished
from narrata.sources.profiles import resolve_settings
from narrata.sources.shared import new_folder
from narrata.sources.tables import EVENT_OPS, PAGES_SQL, table
from narrata.streaming import expiry as E
from narrata.streaming.jobs import stream_table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {PAGES_SQL}, kept as (select * from pages_ where trim(text) <> '')
select 'documents' as stage, count(*) as n, cast(sum(length(text)) as bigint) as chars, 0.25::double as fraction from documents
union all select 'pages', count(*), cast(sum(length(text)) as bigint), 0.5 from pages_
union all select 'kept pages', count(*), cast(sum(length(text)) as bigint), 0.75 from kept
union all select 'books', count(distinct book_id), cast(sum(length(text)) as bigint), 1.0 from kept""")
def x04_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passed each stage of a conversion that writes books' kept pages, observed while it ran once."""
    told: list[tuple[float, str]] = []
    progress = Progress(lambda fraction, message: told.append((fraction, message)))
    size = lambda c: F.sum(F.length(c))
    docs = progress.passing(table(spark, sf_dir, "documents"), "documents", chars=size("text"))
    lines = docs.select(F.col("doc_id").alias("book_id"), F.posexplode(F.split("text", "\n")).alias("page_num", "text"))
    read = progress.passing(lines, "pages", chars=size("text"))
    kept = progress.passing(read.where(F.trim("text") != ""), "kept pages", chars=size("text"))
    books = kept.groupBy("book_id").agg(F.count("*").alias("pages"), size("text").alias("chars"))
    progress.passing(books, "books", chars=F.sum("chars")).write.parquet(new_folder(spark, "books"))
    found = progress.told()
    rows = [(name, m["rows"], m["chars"], fraction) for (name, m), (fraction, _) in zip(found.items(), told, strict=True)]
    return spark.createDataFrame(rows, "stage string, n long, chars long, fraction double")


_OPS = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_OPS.items()) + " end"


@query(f"select count(*) as n, count(*) filter (op = 'create') as created, count(*) filter (op in ('complete', 'fail')) as ended, 1.0::double as fraction from (select {_OPS} as op from events)")
def x04_progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener heard of a stream's batches until its end."""
    told: list[float] = []
    heard = StreamProgress("events", table(spark, sf_dir, "events").count(), lambda fraction, _: told.append(fraction))
    spark.streams.addListener(heard)
    try:
        op = F.col("op")
        counted = heard.observed(event_stream(spark, sf_dir), created=F.count_if(op == "create"), ended=F.count_if(op.isin("complete", "fail")))
        folder = new_folder(spark, "heard")
        writing = counted.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        sums = heard.finished(writing.trigger(availableNow=True).start())
    finally:
        spark.streams.removeListener(heard)
    return spark.createDataFrame([(sums["rows"], sums["created"], sums["ended"], told[-1])], "n long, created long, ended long, fraction double")


@query("""with c as (select doc_id, case doc_id % 5 when 0 then replace(text, '-', ' ') when 1 then split_part(text, chr(10), 1)
  when 2 then translate(replace(text, '-', ' '), 'aeiou', '') when 3 then replace(translate(split_part(text, chr(10), 1), 'aeiou', ''), 'th', '_') else text end as t from documents)
select doc_id, length(t) as n_chars, md5(t) as digest from c""")
def x02_cleaners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned by chains of their own, of two cleaners in the JVM and two vectorised ones."""
    cleaners = Cleaners()
    cleaners.column("no_dashes", lambda t: F.replace(t, F.lit("-"), F.lit(" "))).column("no_th", lambda t: F.replace(t, F.lit("th"), F.lit("_")))
    cleaners.vectorised("first_line", lambda s: s.str.split("\n", n=1).str[0]).vectorised("no_vowels", lambda s: s.str.replace("[aeiou]", "", regex=True))
    chains = [["no_dashes"], ["first_line"], ["no_dashes", "no_vowels"], ["first_line", "no_vowels", "no_th"], []]
    named = F.array(*(F.array(*map(F.lit, c)).cast("array<string>") for c in chains))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.get(named, (F.col("doc_id") % 5).cast("int")).alias("chain"))
    cleaned = docs.select("doc_id", cleaners.apply(F.col("text"), F.col("chain")).alias("t"))
    return cleaned.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


_KINDS = ["job", "session", "file", "cache"]
_LIVES = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in E.LIFETIMES_MS.items()) + " end"
_EXPIRY_SQL = f"""with t as (select (['job', 'session', 'file', 'cache'])[event_id % 4 + 1] as kind, cast(user_id as varchar) as id, epoch_us(ts) // 1000 as at_ms from events),
g as (select *, {_LIVES} as span, case when at_ms < lag(at_ms) over w + {_LIVES} then 0 else 1 end as starts from t window w as (partition by kind, id order by at_ms)),
l as (select *, sum(starts) over (partition by kind, id order by at_ms range unbounded preceding) as life from g)
select kind, id, max(at_ms) as touched_ms, max(at_ms) + any_value(span) as expired_ms, count(*) as touches from l group by kind, id, life
having max(at_ms) + any_value(span) <= (select max(at_ms) from t)"""


def _touches(events: DataFrame, number: str, who: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, _KINDS)), F.pmod(number, F.lit(4)).cast("int"))
    return events.select(kind.alias("kind"), F.col(who).alias("id"), F.col("ts").alias("at"))


@query(_EXPIRY_SQL)
def r07_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' jobs, sessions, files and cache entries that expired by the last event."""
    return E.expired_lives(_touches(table(spark, sf_dir, "events"), "event_id", "user_id"))


@query(_EXPIRY_SQL)
def r07_expiry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the timers of a stream."""
    return finished(spark, E.expiries(_touches(event_stream(spark, sf_dir), "seq", "session_id")), "append").drop("batch")


_PATCH_SQL = """with e as (select user_id || '-' || event_id % 5 as job_id, event_id as seq, value, props,
  case event_type when 'signup' then 'created' when 'view' then 'update' when 'click' then 'update' when 'purchase' then 'completed' when 'error' then 'failed' end as kind, event_type from events),
w as (select job_id, max(seq) filter (kind = 'created') as created,
  arg_max(case when kind = 'created' then 'pending' when kind = 'update' then 'running' when kind = 'completed' then 'completed' else 'failed' end, seq) filter (kind <> 'update' or event_type = 'click') as status,
  arg_max(case when kind = 'created' then 0 when kind = 'completed' then 1 else cast(round(value) as bigint) end, seq) filter (kind in ('created', 'completed') or event_type = 'view') as progress,
  arg_max(struct_pack(v := case when kind = 'completed' then 'result ' || seq end), seq) filter (kind in ('created', 'completed')) as result,
  arg_max(struct_pack(v := case when kind = 'failed' then 'error ' || seq end), seq) filter (kind in ('created', 'failed')) as error_message from e where kind is not null group by 1)
select job_id, created, status, cast(progress as bigint) as progress, result.v as result, error_message.v as error_message from w where created is not null"""


def _patches(events: DataFrame) -> DataFrame:
    """Events as patches: views tell the progress and clicks the status."""
    kind = F.col("event_type")
    named = F.when(kind == "signup", "created").when(kind.isin("view", "click"), "update").when(kind == "purchase", "completed").when(kind == "error", "failed")
    number = F.col("event_id").cast("string")
    values = {"status": F.when(kind == "click", F.lit("running")), "progress": F.when(kind == "view", F.round("value").cast("long").cast("string")), "result": F.when(kind == "purchase", F.concat(F.lit("result "), number)), "error_message": F.when(kind == "error", F.concat(F.lit("error "), number))}
    fields = P.job_patch(named, values)
    return events.where(named.isNotNull()).select(F.concat_ws("-", "user_id", F.pmod("event_id", F.lit(5))).alias("job_id"), F.col("event_id").alias("seq"), (named == "created").alias("created"), fields.alias("fields"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("progress", F.col("progress").cast("double").cast("long"))


@query(_PATCH_SQL)
def r04_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as their patches leave them, field by field."""
    return _shown(P.patched(_patches(table(spark, sf_dir, "events")), P.JOB_FIELDS))


@query(_PATCH_SQL)
def r04_patches_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream that upserts each batch's last writes."""
    stored = table(spark, sf_dir, "events")
    folder = new_folder(spark, "patches")
    P.upsert_stream(_patches(stream_table(spark, f"{sf_dir}/events.parquet*", stored.schema)), P.JOB_FIELDS, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return _shown(P.current_rows(spark, f"{folder}/out", P.JOB_FIELDS))


_OWN = [
    '{"chapters": {"include": ["one", "two"]}, "conversion": {"chunk_size": 300}}',
    '{"chapters": {"exclude": null}, "output": {"format": "mp3", "embed_cover": false}}',
    '{"memory": null, "conversion": {"chapter_pause": 0.5}, "narrator": "x"}',
    '{"chapters": {"exclude": []}, "text_cleaning": {"remove_footnotes": false}}',
    "not a setting",
]


@query("""select doc_id as book_id, case when i in (0, 5) then 'Read by ' || source end as intro_text, case i when 0 then 'one,two' end as include,
  case i when 1 then null when 3 then '' else 'frontcoverImage,title,copyrightPage,contents,notes,bibliography,index,maps,timeline' end as exclude,
  case when i in (0, 5) then 300 else 1500 end as chunk_size, case i when 2 then 0.5 else 2.5 end::double as chapter_pause, i <> 3 as remove_footnotes,
  case i when 1 then 'mp3' else 'm4b' end as format, i <> 1 as embed_cover, case when i <> 2 then 4.0::double end as low_memory_threshold, i <> 2 as has_memory
from (select doc_id, source, doc_id % 7 as i from (select doc_id, source from documents)) t""".replace("case when i in (0, 5) then 300", "case when i = 0 then 300").replace("case when i in (0, 5) then 'Read", "case when i = 5 then 'Read"))
def s09_nested_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books' nested settings: own sections over the standard ones; some books have none."""
    books = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), "source")
    i = F.pmod("book_id", F.lit(7)).cast("int")
    text = F.when(i < 5, F.get(F.array(*map(F.lit, _OWN)), i)).when(i == 5, F.to_json(F.struct(F.concat(F.lit("Read by "), "source").alias("intro_text"))))
    settings = resolve_settings(books, books.where(i < 6).select("book_id", text.alias("json")))

    def joined(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.array_join(c, ",")).alias(c.rpartition(".")[2])

    s = "settings."
    plain = [f"{s}conversion.chunk_size", f"{s}conversion.chapter_pause", f"{s}text_cleaning.remove_footnotes", f"{s}output.format", f"{s}output.embed_cover", f"{s}memory.low_memory_threshold"]
    return settings.select("book_id", f"{s}intro_text", joined(f"{s}chapters.include"), joined(f"{s}chapters.exclude"), *plain, F.col(f"{s}memory").isNotNull().alias("has_memory"))


_VOICES = """with c as (select cast(user_id % 40 as varchar) as voice_id, event_id as seq, event_type = 'error' as gone, event_type || '.wav' as audio_filename from events),
now as (select voice_id, max(seq) as seq, arg_max(gone, seq) as gone, arg_max(audio_filename, seq) as audio_filename from c group by 1)"""


def _voice_log(events: DataFrame) -> DataFrame:
    """Events as changes of forty voices: errors delete."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    name = F.concat(F.lit("voice "), F.col("event_id").cast("string"))
    return events.select((F.col("user_id") % 40).cast("string").alias("voice_id"), F.col("event_id").alias("seq"), op.alias("op"), name.alias("name"), F.concat("event_type", F.lit(".wav")).alias("audio_filename"), F.lit(None).cast("string").alias("ref_text"), F.col("ts").cast("timestamp").alias("created_at"))


@query(_VOICES + " select voice_id, seq, 'voice ' || seq as name, audio_filename from now where not gone")
def s16_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voice library after a snapshot of half the changes and the log of the others."""
    log = _voice_log(table(spark, sf_dir, "events"))
    early = F.col("seq") % 3 == 0
    snapshot = V.compacted(None, log.where(early), settled=-1)
    return V.voices(snapshot, log.where(~early)).select("voice_id", "seq", "name", "audio_filename")


@query(_VOICES + """, r as (select c_custkey as request_id, case c_custkey % 5 when 0 then '../x' when 1 then 'v' || c_custkey else cast(c_custkey % 40 as varchar) end as voice_id from customer)
select request_id, case when r.voice_id = '../x' then 'invalid' when n.voice_id is null then 'not_found' else 'ok' end as outcome, n.audio_filename from r left join (select * from now where not gone) n using (voice_id)""")
def s16_voice_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests to delete voices come to."""
    key = F.col("c_custkey")
    voice = F.when(key % 5 == 0, "../x").when(key % 5 == 1, F.concat(F.lit("v"), key.cast("string"))).otherwise((key % 40).cast("string"))
    requests = table(spark, sf_dir, "customer").select(key.alias("request_id"), voice.alias("voice_id"))
    return V.delete_outcomes(requests, V.voices(None, _voice_log(table(spark, sf_dir, "events")))).select("request_id", "outcome", "audio_filename")


@query()
def t22_vocabulary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and chunks of every document by the longest entries of a vocabulary, which holds the word beginnings of the
    benchmark."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w"))
    entries = [r.w for r in words.select(F.left("w", F.lit(4)).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(1000).collect()]
    n = measured(F.col("text"), Vocabulary([*entries, *(f" {e}" for e in entries)]).count)
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_tokens")).withColumn("n_chunks", estimated_chunks(F.col("n_tokens"), 1500))
