"""Job tables: listing, readiness, chains, templates, sharing, and the state machine over an event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators.ordered import numbered

# Fixed values.
STATUSES = ["pending", "running", "paused", "completed", "failed", "cancelled"]
ACTIVE = ["pending", "running", "paused"]
TERMINAL = ["completed", "failed", "cancelled"]
TEMPLATE = r"\{\{(\w+)\.result(?:\.(\w+))?\}\}"


def is_terminal(status: Column) -> Column:
    return status.isin(TERMINAL)


def can_run(status: Column) -> Column:
    return status == "pending"


def can_cancel(status: Column) -> Column:
    return status.isin(ACTIVE)


def tab(status: Column) -> Column:
    """The view that shows a job."""
    return F.when(status.isin("running", "pending"), "active").when(status == "paused", "paused").when(status == "completed", "completed").otherwise("failed")


def list_jobs(jobs: DataFrame, status: str | None = None, offset: int = 0, limit: int | None = None, **equal: object) -> DataFrame:
    """Jobs with the given column values, newest first, ties to the smaller id; a page of them."""
    for column, value in (equal | ({"status": status} if status else {})).items():
        jobs = jobs.where(F.col(column) == value)
    ordered = jobs.orderBy(F.desc("created_at"), "job_id").offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def job_stats(jobs: DataFrame, by: str, everyone: DataFrame | None = None) -> DataFrame:
    """Counts of each status and of active jobs for each value of `by`; those of everyone that have no jobs have zeros."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    stats = jobs.groupBy(by).agg(*counts, F.count_if(F.col("status").isin(ACTIVE)).alias("total_active"))
    if everyone is None:
        return stats
    names = [*STATUSES, "total_active"]
    return everyone.select(by).distinct().join(stats, by, "left").select(by, *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def next_pending(jobs: DataFrame, n: int, by: str = "session_id") -> DataFrame:
    """The next n pending jobs of each session by priority, then age."""
    order = Window.partitionBy(by).orderBy("priority", "created_at", "job_id")
    return jobs.where(F.col("status") == "pending").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def ready_jobs(jobs: DataFrame) -> DataFrame:
    """Pending jobs of which every dependency is completed; one that isn't known is not. jobs has dependencies, an array."""
    waiting = jobs.where(F.col("status") == "pending").select("job_id", F.explode_outer("dependencies").alias("dep"))
    done = jobs.where(F.col("status") == "completed").select(F.col("job_id").alias("dep"), F.lit(True).alias("done"))
    met = F.bool_and(F.col("dep").isNull() | F.coalesce("done", F.lit(False)))
    return waiting.join(done, "dep", "left").groupBy("job_id").agg(met.alias("ready")).where("ready").select("job_id")


def link_chain(steps: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds dependency (the step before) and parent (the first step) to the steps of each chain."""
    w = Window.partitionBy(by).orderBy(*order)
    first = F.first("job_id").over(w)
    return steps.withColumn("dependency", F.lag("job_id").over(w)).withColumn("parent", F.when(first != F.col("job_id"), first))


def reorder(ids: DataFrame, column: str = "ids") -> DataFrame:
    """(job_id, priority): the place in the list, 10 at most."""
    return ids.select(F.posexplode(column).alias("pos", "job_id")).select("job_id", F.least(F.col("pos") + 1, F.lit(10)).alias("priority"))


def merged_order(jobs: DataFrame, listed: DataFrame, by: str = "session_id") -> DataFrame:
    """(by, job_id, place): the ids of the list (job_id, pos) that are known, in its order, then the others by seq."""
    order = Window.partitionBy(by).orderBy(F.col("pos").isNull(), "pos", "seq")
    return jobs.join(listed, "job_id", "left").select(by, "job_id", (F.row_number().over(order) - 1).alias("place"))


def resolve_templates(payloads: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, payload, error): {{id.result.field}} in JSON payloads replaced by the field of that job's JSON result.

    Without a field the result's output is meant, or the whole result where it has none; a field that isn't there is
    empty; values are escaped as JSON strings need it. A dependency that isn't completed is an error.
    """
    names = F.array_distinct(F.regexp_extract_all("payload", F.lit(TEMPLATE), 0))
    found = payloads.select("job_id", "payload", F.explode_outer(names).alias("mark"))
    dep, field = F.regexp_extract("mark", TEMPLATE, 1), F.regexp_extract("mark", TEMPLATE, 2)
    asked = found.withColumn("dep", F.when(F.col("mark").isNotNull(), dep)).withColumn("field", field)
    done = jobs.where(F.col("status") == "completed").select(F.col("job_id").cast("string").alias("dep"), F.coalesce("result", F.lit("{}")).alias("result"))
    fields = F.from_json("result", "map<string,string>")
    value = F.when(F.col("field") != "", F.coalesce(F.element_at(fields, F.col("field")), F.lit(""))).otherwise(F.coalesce(F.element_at(fields, F.lit("output")), F.col("result")))
    escaped = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    joined = asked.join(done, "dep", "left").withColumn("value", F.when(F.col("result").isNotNull(), escaped))
    missing = F.min(F.when(F.col("dep").isNotNull() & F.col("result").isNull(), F.col("dep")))
    pairs = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("mark", "value"))))
    grouped = joined.groupBy("job_id", "payload").agg(missing.alias("missing"), pairs.alias("pairs"))
    filled = F.aggregate("pairs", F.col("payload"), lambda acc, p: F.replace(acc, p["mark"], p["value"]))
    error = F.when(F.col("missing").isNotNull(), F.concat(F.lit("Dependency "), F.col("missing"), F.lit(" not completed")))
    return grouped.select("job_id", F.when(F.col("missing").isNull(), filled).alias("payload"), error.alias("error"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, of ties the greatest row; upserts are unions read through this."""
    last = F.max(F.struct(F.col(order).alias("__order"), F.struct(*rows.columns).alias("r")))["r"]
    return rows.groupBy(*keys).agg(last.alias("r")).select("r.*")


def deleted(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def expired(rows: DataFrame, as_of: Column, days: int, column: str = "created_at") -> DataFrame:
    return rows.where(F.col(column) < as_of - F.make_interval(days=F.lit(days)))


def access(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """(request_id, outcome) of requests (request_id, job_id, session_id): ok, not_found, denied or terminal."""
    owned = jobs.select("job_id", F.col("session_id").alias("owner"), "status")
    outcome = F.when(F.col("owner").isNull(), "not_found").when(F.col("owner") != F.col("session_id"), "denied").when(is_terminal(F.col("status")), "terminal").otherwise("ok")
    return requests.join(owned, "job_id", "left").select("request_id", outcome.alias("outcome"))


def user_jobs(links: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs of each user over all unexpired sessions (user_id, session_id, expires_at)."""
    return links.where(F.col("expires_at") > as_of).select("user_id", "session_id").join(jobs, "session_id")


def visible_shares(members: DataFrame, shares: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, share_id, can_modify) of members' shares that are active and unexpired."""
    valid = shares.where(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))).select("share_id")
    return members.join(valid, "share_id", "left_semi").select("user_id", "share_id", F.coalesce("can_modify", F.lit(False)).alias("can_modify"))


def merge_members(members: DataFrame, joins: DataFrame) -> DataFrame:
    """Members with new joins (share_id, user_id); who is a member already stays as they are."""
    new = joins.select("share_id", "user_id").distinct().join(members, ["share_id", "user_id"], "left_anti").withColumn("can_modify", F.lit(False))
    return members.select("share_id", "user_id", "can_modify").unionByName(new)


def link_sessions(links: DataFrame, seen: DataFrame, days: int = 90) -> DataFrame:
    """Session links (user_id, session_id, expires_at) with those seen (…, at) added or extended to `days` after."""
    until = seen.groupBy("user_id", "session_id").agg(F.max("at").alias("at")).select("user_id", "session_id", (F.col("at") + F.make_interval(days=F.lit(days))).alias("new"))
    return links.join(until, ["user_id", "session_id"], "full").select("user_id", "session_id", F.coalesce("new", "expires_at").alias("expires_at"))


_TASKS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_task(job_type: str, task: Callable[[DataFrame], DataFrame]) -> None:
    """task takes jobs (job_id, payload) and returns (job_id, result, error)."""
    _TASKS[job_type] = task


def run_jobs(jobs: DataFrame) -> DataFrame:
    """(job_id, result, error) of jobs (job_id, job_type, payload); a type without a task fails."""
    kind = F.col("job_type")
    unknown = jobs.where(kind.isNull() | ~kind.isin(list(_TASKS))) if _TASKS else jobs
    out = unknown.select("job_id", F.lit(None).cast("string").alias("result"), F.concat(F.lit("No handler for job type: "), F.coalesce(kind, F.lit("none"))).alias("error"))
    for name, task in sorted(_TASKS.items()):
        out = out.unionByName(task(jobs.where(kind == name).select("job_id", "payload")).select("job_id", "result", "error"))
    return out


# The state machine. Guards: start only from pending; progress only while running; pause only running; resume only paused;
# cancel only what has not ended; complete and fail always; events of unknown jobs are ignored.
GUARDS = {"start": ["pending"], "progress": ["running"], "pause": ["running"], "resume": ["paused"], "cancel": ACTIVE, "complete": STATUSES, "fail": STATUSES}
RESULTS = {"start": "running", "pause": "paused", "resume": "pending", "cancel": "cancelled", "complete": "completed", "fail": "failed"}


def next_state(status: str | None, progress: float, op: str, value: float | None) -> tuple[str | None, float, bool]:
    """(status, progress, accepted) after an event."""
    if op == "create":
        return ("pending", 0.0, True) if status is None else (status, progress, False)
    if status is None or status not in GUARDS.get(op, ()):
        return status, progress, False
    if op == "progress":
        return status, max(0.0, min(1.0, value or 0.0)), True
    return RESULTS[op], 1.0 if op == "complete" else progress, True


#: Events of a block of a job's log, and blocks of a block of the next level.
LOG_BLOCK = 64
#: A job before it was created has no status.
STARTS: list[str | None] = [None, *STATUSES]


def _moved(a: Column, e: Column) -> Column:
    """The state after event e, progress null where no event has set it since the start of the block."""
    status, op = a["status"], e["op"]
    allowed = F.when(op == "create", status.isNull())
    for name, states in GUARDS.items():
        allowed = allowed.when(op == name, F.coalesce(status.isin(states), F.lit(False)))
    allowed = F.coalesce(allowed, F.lit(False))
    becomes = F.when(op == "create", F.lit("pending"))
    for name, state in RESULTS.items():
        becomes = becomes.when(op == name, F.lit(state))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(e["progress"], F.lit(0.0))))
    moved = F.when(op == "progress", clamped).when(op == "complete", F.lit(1.0)).when(op == "create", F.lit(0.0)).otherwise(a["progress"])
    return F.struct(
        F.when(allowed, F.coalesce(becomes, status)).otherwise(status).alias("status"),
        F.when(allowed, moved).otherwise(a["progress"]).alias("progress"),
        (a["accepted"] + allowed.cast("long")).alias("accepted"),
        (a["rejected"] + (~allowed).cast("long")).alias("rejected"),
    )


def _start(status: str | None) -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(F.lit(status).cast("string").alias("status"), F.lit(None).cast("double").alias("progress"), zero.alias("accepted"), zero.alias("rejected"))


def _then(a: Column, table: Column) -> Column:
    """The state a followed by the block whose transitions the table has: associative, so blocks combine in any grouping."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, STATUSES)), a["status"]), F.lit(0)) + 1
    b = F.element_at(table, place.cast("int"))
    return F.struct(
        b["status"].alias("status"),
        F.coalesce(b["progress"], a["progress"]).alias("progress"),
        (a["accepted"] + b["accepted"]).alias("accepted"),
        (a["rejected"] + b["rejected"]).alias("rejected"),
    )


def transition_tables(events: DataFrame, block: int = LOG_BLOCK) -> DataFrame:
    """(job_id, session_id, transitions): for each status a job may start with, what its events make of it.

    transitions has a struct (status, progress, accepted, rejected) for each of STARTS; progress is null where no event sets
    it. Logs are cut into blocks of `block` events in the order (ts, seq), each of which becomes a table; tables are combined
    `block` at a time until a job has one, so a job with a third of all events is no larger group than others.
    """
    slim = events.select("job_id", "session_id", "ts", "seq", "op", "progress")
    placed = numbered(slim, ["job_id", "session_id"], ["ts", "seq", "op", "progress"])
    whole = F.array(*map(_start, STARTS))
    keys = ["job_id", "session_id"]

    def grouped(rows: DataFrame, at: str, item: Column) -> DataFrame:
        return rows.groupBy(*keys, F.floor(F.col(at) / block).alias("k")).agg(F.array_sort(F.collect_list(item)).alias("items"))

    found = grouped(placed, "place", F.struct("place", "op", "progress"))
    tables = found.select(*keys, "k", F.aggregate("items", whole, lambda acc, e: F.transform(acc, lambda a: _moved(a, e))).alias("transitions"))
    longest = placed.agg(F.max("place")).first()[0] or 0
    while longest >= block:
        longest //= block
        found = grouped(tables, "k", F.struct("k", "transitions"))
        tables = found.select(*keys, "k", F.aggregate("items", whole, lambda acc, t: F.transform(acc, lambda a: _then(a, t["transitions"]))).alias("transitions"))
    return tables.drop("k")


def after_transitions(tables: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(job_id, session_id, status, progress, accepted, rejected) of jobs after transition_tables(); before has such rows of
    jobs as they were, others start without status."""
    keys = ["job_id", "session_id"]
    if before is None:
        s = F.element_at("transitions", 1)
        state = tables.select(*keys, s.alias("s"))
    else:
        old = before.select(*keys, F.struct("status", "progress", F.col("accepted").cast("long").alias("accepted"), F.col("rejected").cast("long").alias("rejected")).alias("old"))
        joined = tables.join(old, keys, "full")
        start = F.coalesce("old", _start(None))
        state = joined.select(*keys, F.when(F.col("transitions").isNull(), F.col("old")).otherwise(_then(start, F.col("transitions"))).alias("s"))
    return state.select(*keys, "s.status", F.coalesce("s.progress", F.lit(0.0)).alias("progress"), F.col("s.accepted").cast("int").alias("accepted"), F.col("s.rejected").cast("int").alias("rejected"))


def fold_events(events: DataFrame, block: int = LOG_BLOCK) -> DataFrame:
    """(job_id, session_id, status, progress, accepted, rejected) after all events (job_id, session_id, ts, seq, op, progress).

    Events count in the order (ts, seq), nulls first; those of a job that was never created are rejected, and its status stays
    null, as does the effect of unknown or null operations; a null job_id or session_id is a key of its own; an empty log
    gives no rows.
    """
    return after_transitions(transition_tables(events, block))


def throttled(events: DataFrame) -> DataFrame:
    """Progress events that are sent on: whole multiples of five percent; others all."""
    return events.where((F.col("op") != "progress") | (F.floor(F.col("progress") * 100) % 5 == 0))
