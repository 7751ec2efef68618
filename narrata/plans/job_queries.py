"""Queries of jobs, sharing, resuming and casting, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import text as X
from narrata.functions.gates import session_path
from narrata.operators import casting as G
from narrata.operators import chunking as K
from narrata.operators import jobs as J
from narrata.operators import resume as R
from narrata.plans import text_queries as TQ
from narrata.plans.book_queries import CHAPTERS_SQL, chapters, chunk_sql
from narrata.sources.tables import EVENT_OPS, JOBS_SQL, job_events, jobs, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_J = f"with {JOBS_SQL} "


@query(_J + "select job_id, session_id, priority from jobs where status = 'running' and session_id < 200 order by created_at desc, job_id limit 50 offset 10")
def f12_list_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of running jobs of some sessions, newest first (also L4)."""
    return J.list_jobs(jobs(spark, sf_dir).where("session_id < 200"), "running", 10, 50).select("job_id", "session_id", "priority")


@query(_J + "select case when status in ('pending', 'running') then 'active' when status = 'completed' then 'completed' end as tab, count(*) as jobs from jobs group by 1")
def f13_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by the view that shows them."""
    return jobs(spark, sf_dir).groupBy(J.tab(F.col("status")).alias("tab")).agg(F.count("*").alias("jobs"))


@query(_J + "select job_id, status = 'completed' as terminal, status = 'pending' as can_run, status <> 'completed' as can_cancel from jobs")
def f14_state_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    return jobs(spark, sf_dir).select("job_id", J.is_terminal(s).alias("terminal"), J.can_run(s).alias("can_run"), J.can_cancel(s).alias("can_cancel"))


@query(_J + "select job_id from jobs where created_at < timestamp '1996-01-01' - interval 30 days")
def f15_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of over thirty days at a given time."""
    return J.expired(jobs(spark, sf_dir), F.lit("1996-01-01").cast("timestamp"), 30).select("job_id")


@query("select distinct user_id, case when regexp_full_match(s, '[a-zA-Z0-9\\-]{12,36}') then 'sessions/' || s end as path from (select user_id, 'user-' || user_id || case when user_id % 2 = 0 then '-session' else '!' end as s from events)")
def f16_session_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of well-formed session ids."""
    s = F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, "-session").otherwise("!"))
    return table(spark, sf_dir, "events").select("user_id", session_path(s, "sessions").alias("path")).distinct()


_STATS = ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in J.STATUSES) + ", count(*) filter (status in ('pending', 'running', 'paused')) as total_active"


@query(_J + ", s as (select session_id, " + _STATS + " from jobs group by 1) select c_custkey as session_id, " + ", ".join(f"coalesce({s}, 0) as {s}" for s in [*J.STATUSES, "total_active"]) + " from customer left join s on session_id = c_custkey")
def a05_job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status of every session, zeros for those without jobs."""
    everyone = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    return J.job_stats(jobs(spark, sf_dir), "session_id", everyone)


@query(_J + ", p as (select *, row_number() over (partition by session_id order by priority, created_at, job_id) as rank from jobs where status = 'pending') select session_id, job_id, cast(rank as int) as rank from p where rank <= 2")
def w07_next_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.next_pending(jobs(spark, sf_dir), 2).select("session_id", "job_id", "rank")


@query(_J + "select j.job_id from jobs j left join jobs d on d.job_id = j.dependency where j.status = 'pending' and (j.dependency is null or (d.status = 'completed' and j.job_id % 10 <> 0))")
def j08_ready_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending jobs whose dependencies are completed; every tenth also waits for a job that nobody knows."""
    one = F.when(F.col("dependency").isNull(), F.array().cast("array<long>")).when(F.col("job_id") % 10 == 0, F.array("dependency", F.lit(-1).cast("long"))).otherwise(F.array("dependency"))
    return J.ready_jobs(jobs(spark, sf_dir).withColumn("dependencies", one))


@query("select l_orderkey as chain, l_linenumber as step, lag(k) over w as dependency, case when first(k) over w <> k then first(k) over w end as parent from (select *, l_orderkey * 10 + l_linenumber as k from lineitem) window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity)")
def w09_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the steps of a chain."""
    steps = table(spark, sf_dir, "lineitem").withColumn("job_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return J.link_chain(steps, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("step"), "dependency", "parent")


@query("with l as (select o_custkey, list(o_orderkey order by o_orderkey desc) as ids from orders group by 1) select unnest(ids) as job_id, cast(least(10, generate_subscripts(ids, 1)) as int) as priority from l")
def w08_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities by place in each session's list."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.reverse(F.array_sort(F.collect_list("o_orderkey"))).alias("ids"))
    return J.reorder(lists)


@query(_J + ", l as (select job_id, row_number() over (order by job_id desc) as pos from jobs where job_id % 3 = 0) select session_id, j.job_id, cast(row_number() over (partition by session_id order by pos is null, pos, j.job_id) - 1 as int) as place from jobs j left join l using (job_id)")
def u03_merged_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed jobs first, in the list's order, then the rest."""
    all_jobs = jobs(spark, sf_dir).withColumn("seq", F.col("job_id"))
    return J.merged_order(all_jobs, all_jobs.where("job_id % 3 = 0").select("job_id", (-F.col("job_id")).alias("pos")))


@query(
    _J
    + """select j.job_id, case when j.dependency is null then '{"a":"x"}' when d.status = 'completed' then '{"a":"' || case when j.job_id % 2 = 0 then 'v' || d.job_id else '' end || '","b":["out ' || d.job_id || '"]}' end as payload,
  case when j.dependency is not null and d.status <> 'completed' then 'Dependency ' || j.dependency || ' not completed' end as error from jobs j left join jobs d on d.job_id = j.dependency"""
)
def j09_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that name fields of the results of the job before."""
    all_jobs = jobs(spark, sf_dir)
    result = F.to_json(F.struct(F.concat(F.lit("v"), F.col("job_id").cast("string")).alias("title"), F.concat(F.lit("out "), F.col("job_id").cast("string")).alias("output")))
    d = F.col("dependency").cast("string")
    field = F.when(F.col("job_id") % 2 == 0, "title").otherwise("none")
    payload = F.when(d.isNull(), '{"a":"x"}').otherwise(F.concat(F.lit('{"a":"{{'), d, F.lit(".result."), field, F.lit('}}","b":["{{'), d, F.lit('.result}}"]}')))
    return J.resolve_templates(all_jobs.select("job_id", payload.alias("payload")), all_jobs.select("job_id", "status", result.alias("result")))


@query(_J + "select o.job_id as request_id, case when o.job_id % 7 = 0 then 'not_found' when o.job_id % 5 = 0 then 'denied' when o.status = 'completed' then 'terminal' else 'ok' end as outcome from jobs o")
def j16_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for jobs that don't exist, are others' or have ended."""
    all_jobs = jobs(spark, sf_dir)
    asked = all_jobs.select(F.col("job_id").alias("request_id"), F.when(F.col("job_id") % 7 == 0, -F.col("job_id") - 1).otherwise(F.col("job_id")).alias("job_id"), F.when(F.col("job_id") % 5 == 0, F.lit(-1).cast("long")).otherwise(F.col("session_id")).alias("session_id"))
    return J.access(asked, all_jobs)


@query(_J + "select c_nationkey as user_id, count(*) as jobs, count(distinct session_id) as sessions from jobs join customer on c_custkey = session_id where c_custkey % 3 <> 0 group by 1")
def j10_user_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by nation over the customers' unexpired sessions."""
    as_of = F.lit("2000-01-01").cast("timestamp")
    links = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("session_id"), F.when(F.col("c_custkey") % 3 == 0, as_of).otherwise(as_of + F.expr("interval 1 day")).alias("expires_at"))
    return J.user_jobs(links, jobs(spark, sf_dir), as_of).groupBy("user_id").agg(F.count("*").alias("jobs"), F.countDistinct("session_id").alias("sessions"))


@query("select c_custkey as user_id, c_nationkey as share_id, c_custkey % 4 = 1 as can_modify from customer where c_nationkey % 2 = 0 and c_nationkey % 3 <> 0")
def j11_visible_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as members of their nation's share, of which some are closed or expired."""
    as_of = F.lit("2000-01-01").cast("timestamp")
    shares = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("share_id"), (F.col("n_nationkey") % 2 == 0).alias("is_active"), F.when(F.col("n_nationkey") % 3 == 0, as_of).alias("expires_at"))
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("share_id"), F.when(F.col("c_custkey") % 4 == 1, True).alias("can_modify"))
    return J.visible_shares(members, shares, as_of)


@query("select c_nationkey as share_id, c_custkey as user_id, c_custkey % 2 = 0 as can_modify from customer where c_custkey % 3 <> 1 or c_custkey % 2 = 0")
def j18_merge_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins to shares; members stay as they are."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("share_id"), F.col("c_custkey").alias("user_id"))
    members = c.where("user_id % 2 = 0").withColumn("can_modify", F.lit(True))
    joining = c.where("user_id % 3 <> 1")
    return J.merge_members(members, joining.union(joining))


@query(_J + "select session_id, max(job_id) as job_id from (select * from jobs qualify created_at = max(created_at) over (partition by session_id)) group by 1")
def s08_latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last job of each session (also R4, S10 and S16: upserts are read so)."""
    last = jobs(spark, sf_dir).withColumn("version", F.struct("created_at", "job_id"))
    return J.latest(last.select("session_id", "job_id", "version"), ["session_id"], "version").select("session_id", "job_id")


@query("select v.c_custkey as voice_id from customer v where c_custkey % 5 <> 0")
def u05_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without those that were deleted."""
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("voice_id"))
    return J.deleted(v, v.where("voice_id % 5 = 0"), "voice_id")


_OPS = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_OPS.items()) + " end"
EVENTS_SQL = f"""recursive log as (select user_id || '-' || event_id % 5 as job_id, user_id as session_id, {_OPS} as op, least(value / 100, 1.0) as p, row_number() over (partition by user_id || '-' || event_id % 5, user_id order by ts, event_id) as n from events),
fold as (select job_id, session_id, cast(null as varchar) as status, cast(0 as double) as progress, 0 as accepted, 0 as rejected, 0 as n from log where n = 1
  union all select f.job_id, f.session_id,
    case when op = 'create' and status is null then 'pending' when op = 'start' and status = 'pending' then 'running' when op = 'complete' and status is not null then 'completed' when op = 'fail' and status is not null then 'failed' else status end,
    case when op = 'create' and status is null then 0 when op = 'progress' and status = 'running' then greatest(0, least(1, p)) when op = 'complete' and status is not null then 1 else progress end,
    accepted + g, rejected + 1 - g, l.n
  from fold f join (select l.*, 0 as zero from log l) l on l.job_id = f.job_id and l.session_id = f.session_id and l.n = f.n + 1,
  lateral (select case when (op = 'create' and status is null) or (op = 'start' and status = 'pending') or (op = 'progress' and status = 'running') or (op in ('complete', 'fail') and status is not null) then 1 else 0 end as g) t)"""


@query(f"with {EVENTS_SQL} select job_id, session_id, status, progress, accepted, rejected from fold qualify n = max(n) over (partition by job_id, session_id)")
def r01_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every job after its events; the stream's twin."""
    return J.fold_events(job_events(spark, sf_dir))


@query(f"with {EVENTS_SQL} select session_id, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed, count(*) filter (status in ('pending', 'running', 'paused')) as total_active from (select * from fold qualify n = max(n) over (partition by job_id, session_id)) group by 1")
def r02_session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each session's jobs after all events."""
    return J.job_stats(J.fold_events(job_events(spark, sf_dir)), "session_id").select("session_id", "completed", "failed", "total_active")


@query(f"select op, count(*) as n from (select {_OPS} as op, least(value / 100, 1.0) as p from events) where op <> 'progress' or cast(floor(p * 100) as bigint) % 5 = 0 group by 1")
def r03_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are sent on: progress only at multiples of five percent."""
    return J.throttled(job_events(spark, sf_dir)).groupBy("op").agg(F.count("*").alias("n"))


@query("select job_id, case when kind = 'up' then upper(payload) end as result, case when kind <> 'up' then 'No handler for job type: ' || kind end as error from (select doc_id as job_id, case when doc_id % 3 = 0 then 'sing' else 'up' end as kind, lang as payload from documents)")
def x01_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs handed to the task of their type; one type has none."""
    J.register_task("up", lambda d: d.select("job_id", F.upper("payload").alias("result"), F.lit(None).cast("string").alias("error")))
    docs = table(spark, sf_dir, "documents")
    return J.run_jobs(docs.select(F.col("doc_id").alias("job_id"), F.when(F.col("doc_id") % 3 == 0, "sing").otherwise("up").alias("job_type"), F.col("lang").alias("payload")))


_CH = f"with {CHAPTERS_SQL} "


@query(_CH + "select book_id, chapter_seq from chapters where (book_id + chapter_seq) % 3 <> 0")
def j06_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that a checkpoint doesn't have as completed."""
    ch = chapters(spark, sf_dir).select("book_id", "chapter_seq")
    progress = ch.withColumn("status", F.when((F.col("book_id") + F.col("chapter_seq")) % 3 == 0, "completed").otherwise("failed"))
    return R.remaining(ch, progress.union(progress), ["book_id", "chapter_seq"])


_KEYED = f"with {chunk_sql(TQ.collapse_sql('text'), 150)}, keyed as (select doc_id, chunk_idx, source, md5(text || '_custom_' || source) as cache_key from packed join documents d using (doc_id))".replace("md5(text ||", "md5(packed.text ||")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = K.chunk_words_simple(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), 150)
    return c.select("doc_id", "chunk_idx", "source", X.cache_key(F.col("text"), F.lit("custom"), F.col("source")).alias("cache_key"))


@query(_KEYED + ", cache as (select cache_key, min('/cache/' || doc_id || '-' || chunk_idx) as path from keyed where doc_id % 4 = 0 group by 1) select doc_id, chunk_idx, path, path is not null as hit from keyed left join cache using (cache_key)")
def j07_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that were made before for other documents."""
    keyed = _keyed(spark, sf_dir)
    cache = keyed.where("doc_id % 4 = 0").select("cache_key", F.concat(F.lit("/cache/"), F.col("doc_id").cast("string"), F.lit("-"), F.col("chunk_idx").cast("string")).alias("path"))
    return R.cache_lookup(keyed, cache).select("doc_id", "chunk_idx", "path", "hit")


@query(_KEYED + " select source, count(*) as chunks, count(distinct cache_key) as unique_keys, count(*) - count(distinct cache_key) as repeats from keyed group by 1")
def a12_duplicate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicate_accounting(_keyed(spark, sf_dir), "source")


@query(_KEYED + ", r as (select doc_id as book_id, chunk_idx, (doc_id + chunk_idx) % 4 <> 0 as ok from keyed) select book_id, count(*) as total, count(*) filter (ok) as ok, count(*) filter (not ok) as failed, coalesce(string_agg(case when not ok then chunk_idx end, ',' order by chunk_idx), '') as missing, count(*) filter (ok) > 0 as usable from r group by 1")
def a06_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _keyed(spark, sf_dir).select(F.col("doc_id").alias("book_id"), "chunk_idx", ((F.col("doc_id") + F.col("chunk_idx")) % 4 != 0).alias("ok"))
    return R.batch_summary(results).withColumn("missing", F.array_join("missing", ","))


@query(_CH + ", t as (select doc_id as book_id, count(chapter_seq) as total, count(chapter_seq) filter (chapter_seq % 2 = 1) as completed from documents left join chapters on book_id = doc_id group by 1) select book_id, total, completed, case when total = 0 then 0.0::double else completed * 100.0::double / total end as percent, total - completed as remaining, (total - completed) * 4 as minutes_left from t")
def a07_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books' progress with every other chapter done, some reported twice (also R9, W11)."""
    ch = chapters(spark, sf_dir).select("book_id", F.col("chapter_seq").alias("seq"))
    done = ch.where("seq % 2 = 1")
    totals = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id")).join(ch.groupBy("book_id").agg(F.count("*").alias("total")), "book_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return R.progress_report(totals, done.union(done))


@query("with r as (select *, row_number() over (partition by conv_id, role order by turn, text) as n from conversations), s as (select conv_id, role, count(*) as line_count, md5(string_agg(case when n <= 3 then text end, '|' order by n)) as samples from r group by 1, 2) select conv_id, role as character_name, line_count, samples from s")
def a09_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of conversations with their first three lines."""
    c = G.characters(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "text", ["turn", "text"])
    return c.select("conv_id", "character_name", "line_count", F.md5(F.array_join("sample_lines", "|")).alias("samples"))


@query("with a as (select conv_id, arg_min(role, turn) as role from (select conv_id, min(turn) as turn from conversations where conv_id % 3 <> 0 group by 1) join (select conv_id, turn, min(role) as role from conversations group by 1, 2) using (conv_id, turn) group by 1) select c.conv_id as book_id, coalesce('voice-' || a.role, 'default') as voice from (select distinct conv_id from conversations) c left join a using (conv_id)")
def j13_narrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's voice: that of who speaks first, where voices are assigned."""
    c = table(spark, sf_dir, "conversations")
    assigned = c.where("conv_id % 3 <> 0").groupBy("conv_id", "turn").agg(F.min("role").alias("role")).select(F.col("conv_id").alias("book_id"), F.col("turn").alias("seq"), F.concat(F.lit("voice-"), "role").alias("voice"))
    books = c.select(F.col("conv_id").alias("book_id"), F.lit("default").alias("default_voice")).distinct()
    return G.narrator_voice(books, assigned)


@query("select doc_id, case when doc_id % 4 = 3 then 0 else 1 end as n, case when doc_id % 4 = 3 then null when doc_id % 4 = 2 then 'Unknown' else source end as name, case when doc_id % 4 = 3 then null when doc_id % 4 = 2 then 0 else doc_id % 9 end as line_count from documents")
def t36_casting_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as objects, arrays, with missing fields, and broken."""
    one = F.concat(F.lit('{"name":"'), "source", F.lit('","line_count":'), (F.col("doc_id") % 9).cast("string"), F.lit("}"))
    i = F.col("doc_id") % 4
    reply = F.when(i == 0, F.concat(F.lit('{"characters":['), one, F.lit("]}"))).when(i == 1, F.concat(F.lit(" ["), one, F.lit("]"))).when(i == 2, F.lit('[{"description":"x"}]')).otherwise(F.lit("{broken"))
    c = G.parse_casting(reply)
    first = F.get(c, F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(c).alias("n"), first["name"].alias("name"), first["line_count"].cast("long").alias("line_count"))


@query("select doc_id, doc_id % 3 <> 2 as valid, case doc_id % 3 when 0 then 'lifetime' when 1 then 'annual' end as kind, case doc_id % 3 when 1 then timestamp '2031-05-01 00:00:00' end as expires_at from documents")
def t37_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a licence server."""
    i = F.col("doc_id") % 3
    reply = F.when(i == 0, '{"success":true,"license":"valid","expires":"lifetime"}').when(i == 1, '{"success":true,"license":"valid","expires":"2031-05-01 00:00:00"}').otherwise('{"success":false}')
    return table(spark, sf_dir, "documents").select("doc_id", G.license_state(reply).alias("s")).select("doc_id", "s.valid", "s.kind", "s.expires_at")


@query("select doc_id, case when doc_id % 2 = 0 then '/voices/' || source || '.wav' else source end as voice_path from documents")
def j12_voice_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice addresses as files, or as they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/api/voices/"), "source")).otherwise(F.col("source")).alias("voice_url"))
    voices = docs.where("doc_id % 2 = 0").select(F.col("voice_url").alias("url"), F.concat(F.lit("/voices/"), F.regexp_extract("voice_url", "([^/]+)$", 1), F.lit(".wav")).alias("path")).distinct()
    return G.resolve_paths(docs, voices).select("doc_id", "voice_path")


@query("select '/a/' || doc_id || '.wav' as audio, case doc_id % 4 when 0 then '/a/' || doc_id || '.txt' when 1 then '/a/' || doc_id || '_transcript.txt' when 2 then '/a/' || doc_id || '.transcript.txt' end as transcript from documents")
def j17_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with the transcript beside them."""
    i = F.col("doc_id") % 4
    stem = F.concat(F.lit("/a/"), F.col("doc_id").cast("string"))
    found = lambda *s: F.array(F.concat(stem, F.lit(".wav")), *(F.concat(stem, F.lit(x)) for x in s))
    paths = F.when(i == 0, found("_transcript.txt", ".txt")).when(i == 1, found("_transcript.txt", ".transcript.txt")).when(i == 2, found(".transcript.txt")).otherwise(found())
    return G.paired_transcripts(table(spark, sf_dir, "documents").select(F.explode(paths).alias("path")))


@query(_CH + "select c.book_id, cast(sum(word_count) as bigint) as words from chapters c where chapter_seq % 2 = 1 group by 1")
def j15_selected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the selected chapters."""
    ch = chapters(spark, sf_dir).select("book_id", "chapter_seq", "word_count")
    chosen = ch.where("chapter_seq % 2 = 1").select("book_id", "chapter_seq")
    return ch.join(chosen, ["book_id", "chapter_seq"], "left_semi").groupBy("book_id").agg(F.sum("word_count").alias("words"))


@query("select case when suffix in ('epub', 'pdf', 'txt', 'docx', 'md') then 'ok' else 'rejected' end as status, count(*) as files from (select ['epub', 'pdf', 'mobi', 'txt'][doc_id % 4 + 1] as suffix from documents) group by 1")
def f08_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by whether their format can be read."""
    from narrata.sources.files import SUFFIXES, suffix_of

    names = F.concat(F.lit("b."), F.get(F.array(*map(F.lit, ["epub", "PDF", "mobi", "txt"])), (F.col("doc_id") % 4).cast("int")))
    return table(spark, sf_dir, "documents").select(F.when(suffix_of(names).isin(SUFFIXES), "ok").otherwise("rejected").alias("status")).groupBy("status").agg(F.count("*").alias("files"))


@query(_CH + "select doc_id as book_id, source as title, coalesce(string_agg(chapter_id || ':' || word_count, ',' order by chapter_seq), '') as listing, cast(coalesce(sum(word_count), 0) as bigint) as total_words from documents left join chapters on book_id = doc_id group by 1, 2")
def s17_book_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with their chapters."""
    from narrata.sources.files import book_registry

    books = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.col("source").alias("title"))
    r = book_registry(books, chapters(spark, sf_dir))
    return r.select("book_id", "title", F.array_join(F.transform("chapters", lambda c: F.concat_ws(":", c["chapter_id"], c["word_count"].cast("string"))), ",").alias("listing"), "total_words")


@query("select doc_id as book_id, case when doc_id % 3 = 0 then 300 else 1500 end as chunk_size, case when doc_id % 4 = 0 then null else 'm4b' end as format, true as fix_spaced_capitals from documents")
def s09_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books' settings: own values over the standard ones; a null of one's own counts."""
    from narrata.sources.files import DEFAULT_PROFILE, resolve_profiles

    books = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"))
    small = F.when(F.col("book_id") % 3 == 0, F.create_map(F.lit("chunk_size"), F.lit("300"))).otherwise(F.create_map().cast("map<string,string>"))
    fmt = F.when(F.col("book_id") % 4 == 0, F.create_map(F.lit("format"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    own = books.select("book_id", F.map_concat(small, fmt).alias("settings"))
    p = resolve_profiles(books, own, DEFAULT_PROFILE)
    return p.select("book_id", F.col("chunk_size").cast("int").alias("chunk_size"), "format", F.col("fix_spaced_capitals").cast("boolean").alias("fix_spaced_capitals"))
