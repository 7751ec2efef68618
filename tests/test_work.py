"""Progress, plugged-in cleaners, transition tables, expiry, patches and nested settings on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from narrata.functions.cleaners import Cleaners
from narrata.functions.text import fix_hyphenation
from narrata.operators import jobs as J
from narrata.operators import patches as P
from narrata.operators.progress import Progress, StreamProgress
from narrata.sources.profiles import DEFAULTS, extra_settings, resolve_settings
from narrata.streaming import expiry as E
from narrata.streaming.jobs import stream_table


def test_observed_stages_equal_counts_and_the_plan_runs_once(spark, tmp_path):
    told = []
    p = Progress(lambda f, m: told.append((f, m)))
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    df = p.passing(spark.range(1000).mapInPandas(seen, "id long"), "all", total=F.sum("id"))
    p.passing(df.where("id % 3 = 0"), "thirds").write.parquet(str(tmp_path / "out"))
    assert p.told() == {"all": {"rows": 1000, "total": 499500}, "thirds": {"rows": 334}} and runs.value == 1000
    assert told == [(0.5, "all: 1000 rows"), (1.0, "thirds: 334 rows")]


def test_stream_progress_sums_batches(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    heard = StreamProgress("rows", 30, lambda f, m: told.append(f))
    spark.streams.addListener(heard)
    try:
        df = heard.observed(stream_table(spark, str(tmp_path / "in"), "id long"), even=F.count_if(F.col("id") % 2 == 0))
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert heard.finished(q) == {"rows": 30, "even": 15}
    finally:
        spark.streams.removeListener(heard)
    assert told == [0.3333, 0.6667, 1.0]


def test_stream_progress_without_total_or_metrics():
    told = []
    heard = StreamProgress("x", None, lambda f, m: told.append(f))
    heard.add(None)
    assert told == [] and heard.sums == {}


def small_cleaners():
    c = Cleaners()
    c.column("up", F.upper).column("bang", lambda t: F.concat(t, F.lit("!")))
    return c.vectorised("rev", lambda s: s.str[::-1]).vectorised("dup", lambda s: s + s)


def test_chains_of_both_kinds(spark):
    step = {"up": str.upper, "bang": lambda t: t + "!", "rev": lambda t: t[::-1], "dup": lambda t: t + t}
    chains = [None, [], ["up"], ["rev"], ["bang", "rev", "dup", "up"], ["dup", "bang"], ["up", "bang", "bang"], ["bang", "rev"]]
    rows = [(i, t, chains[i % len(chains)]) for i, t in enumerate(["abc", "", None, "ü𝄞x"] * 10)]
    df = spark.createDataFrame(rows, "id int, t string, chain array<string>")
    got = {r.id: r.out for r in df.select("id", small_cleaners().apply(F.col("t"), F.col("chain")).alias("out")).collect()}
    for i, t, chain in rows:
        for name in chain or []:
            t = None if t is None else step[name](t)
        assert got[i] == t, (i, chain)


def test_one_python_pass(spark):
    df = spark.createDataFrame([(1, "a", ["rev", "dup"])], "id int, t string, chain array<string>").select(small_cleaners().apply(F.col("t"), F.col("chain")).alias("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("chain", [["nothing"], ["rev", "up", "dup"], ["rev", None]])
def test_chains_that_are_errors(spark, chain):
    df = spark.createDataFrame([(1, "a", chain)], "id int, t string, chain array<string>")
    with pytest.raises(Exception, match="cleaner"):
        df.select(small_cleaners().apply(F.col("t"), F.col("chain"))).collect()


def test_names_are_taken_once_and_library_cleaners_are_there():
    with pytest.raises(ValueError, match="already"):
        Cleaners().column("fix_hyphenation", F.upper)


def plain_states(log):
    out = {}
    for e in sorted(log, key=lambda e: (e[2], e[3])):
        job, session, _, _, op, value = e
        status, progress, yes, no = out.get((job, session), (None, 0.0, 0, 0))
        status, progress, good = J.next_state(status, progress, op, value)
        out[job, session] = (status, progress, yes + good, no + (not good))
    return out


@pytest.mark.parametrize("block", [2, 5, 64])
def test_transition_tables_equal_the_plain_fold(spark, block):
    rnd = random.Random(block)
    ops = [*J.GUARDS, "create", "start", "progress", "resume", "unknown", None]
    log = [(rnd.choice(["hot", "hot", "a", "b"]), 1, rnd.randrange(300), i, rnd.choice(ops), rnd.choice([None, -1.0, 0.3, 2.0])) for i in range(600)]
    df = spark.createDataFrame(log, "job_id string, session_id long, ts long, seq long, op string, progress double")
    key = lambda rows: {(r.job_id, r.session_id): (r.status, r.progress, r.accepted, r.rejected) for r in rows}
    assert key(J.fold_events(df, block).collect()) == plain_states(log)
    early, late = df.where("ts < 150"), df.where("ts >= 150")
    then = J.after_transitions(J.transition_tables(late, block), J.fold_events(early, block))
    assert key(then.collect()) == plain_states(log)
    assert J.fold_events(df.limit(0)).count() == 0


def plain_lives(touches, span, as_of):
    out, times = [], {}
    for kind, i, at in touches:
        if kind in span and i is not None and at is not None:
            times.setdefault((kind, i), []).append(at)
    for (kind, i), ats in times.items():
        life = []
        for at in [*sorted(ats), None]:
            if life and (at is None or at >= life[-1] + span[kind]):
                if life[-1] + span[kind] <= as_of:
                    out.append((kind, i, life[-1], life[-1] + span[kind], len(life)))
                life = []
            life.append(at)
    return sorted(out)


def test_expiry_of_tables_and_streams(spark, tmp_path):
    rnd = random.Random(2)
    span = {"job": 500, "file": 40}
    touches = [(rnd.choice(["job", "file", "other"]), rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(1000, 4000, 7)])) for _ in range(400)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    of = lambda rows: spark.createDataFrame(rows, "kind string, id string, ms long").select("kind", "id", F.timestamp_millis("ms").alias("at"))
    as_of = max(t[2] for t in touches if t[0] in span and t[1] and t[2])
    want = plain_lives(touches, span, as_of)
    key = lambda rows: sorted((r.kind, r.id, r.touched_ms, r.expired_ms, r.touches) for r in rows)
    assert key(E.expired_lives(of(touches), lifetimes=span).collect()) == want and len(want) > 20
    assert E.expired_lives(of(touches).limit(0), lifetimes=span).count() == 0
    ordered = sorted(touches, key=lambda t: t[2] or 0)
    for i in range(0, 400, 100):  # batches in order of time, each with its rows in any order
        part = ordered[i : i + 100]
        rnd.shuffle(part)
        of(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = E.expiries(stream_table(spark, str(tmp_path / "in"), of(touches).schema), span)

    def save(batch, n):
        batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"b={n}"))

    stream.writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert key(spark.read.parquet(str(tmp_path / "out")).collect()) == want


PATCHES = [("a", 5, True, {"status": "pending", "progress": "0.0", "result": None, "error_message": None}), ("a", 7, False, {"progress": "0.5"}), ("a", 9, False, {"status": "completed", "progress": "1.0", "result": None}), ("a", 8, False, {"result": "early"}), ("a", 3, False, {"error_message": "before"}), ("b", 1, False, {"status": "running"}), ("c", 4, True, {"status": "pending", "progress": "0.0", "result": None, "error_message": None}), ("c", 6, True, {"status": "pending", "progress": "0.0", "result": None, "error_message": None}), ("c", 5, False, {"status": "failed", "error_message": "x"}), (None, 1, True, {"status": "odd"})]
WANT = {("a", 5, "completed", "1.0", None, None), ("c", 6, "pending", "0.0", None, None), (None, 1, "odd", None, None, None)}


def test_patches_in_any_order_and_in_streams(spark, tmp_path):
    schema = "job_id string, seq long, created boolean, fields map<string,string>"
    for seed in range(3):
        rows = random.Random(seed).sample(PATCHES, len(PATCHES))
        df = spark.createDataFrame(rows, schema)
        assert {tuple(r) for r in P.patched(df, P.JOB_FIELDS).collect()} == WANT
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    P.upsert_stream(stream_table(spark, str(tmp_path / "in"), df.schema), P.JOB_FIELDS, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in P.current_rows(spark, str(tmp_path / "out"), P.JOB_FIELDS).collect()} == WANT
    P.compacted(spark, str(tmp_path / "out"), str(tmp_path / "small"), P.JOB_FIELDS)
    assert {tuple(r) for r in P.current_rows(spark, str(tmp_path / "small"), P.JOB_FIELDS).collect()} == WANT
    assert P.patched(df.limit(0), P.JOB_FIELDS).count() == 0


def plain_merge(base, own):
    out = dict(base)
    for k, v in own.items():
        out[k] = plain_merge(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


SETTINGS = {
    1: {"intro_text": "Read by a machine.", "chapters": {"include": ["foreword", "chapter01"], "exclude": ["fm01", "title"]}},
    2: {"chapters": {"include": None, "exclude": None}, "output": {"bitrate": "64k"}},
    3: {"memory": None},
    4: {"conversion": {"chunk_size": 200, "announce_chapters": False, "chapter_pause": 0.25}, "text_cleaning": {}},
    5: {"chapters": {"exclude": []}, "outro_text": None, "voice": {"name": "x", "seed": 3}},
    6: {},
}


def test_nested_settings_equal_a_plain_merge(spark):
    books = spark.createDataFrame([(i, "x") for i in range(1, 10)], "book_id int, settings_of string")
    odd = [(7, None), (8, "[1, 2]"), (9, "{broken")]
    own = spark.createDataFrame([*((k, json.dumps(v)) for k, v in SETTINGS.items()), *odd], "book_id int, json string")
    got = {r.book_id: r.settings.asDict(True) if r.settings else None for r in resolve_settings(books, own).collect()}
    for k in range(1, 10):
        want = plain_merge(DEFAULTS, SETTINGS.get(k, {}))
        want.pop("voice", None)
        assert got[k] == want, k
    extra = {r.book_id: r.e for r in own.select("book_id", extra_settings(F.try_parse_json("json")).alias("e")).collect()}
    assert extra[5] == {"voice": '{"name":"x","seed":3}'} and extra[1] == {}


def test_settings_of_other_types(spark):
    own = spark.createDataFrame([(1, '{"conversion": {"chunk_size": "many", "max_retries": "7"}, "output": "mp3"}')], "book_id int, json string")
    s = resolve_settings(own.select("book_id"), own).first().settings
    assert s.conversion.chunk_size is None and s.conversion.max_retries == 7 and s.output is None


def test_hyphenation_of_long_runs(spark):
    text = "a" * 200_000 + " end-\nless b-\nc-\nd" + "b" * 200_000
    assert spark.createDataFrame([(text,)], "t string").select(fix_hyphenation(F.col("t"))).first()[0] == "a" * 200_000 + " endless bc-\nd" + "b" * 200_000


