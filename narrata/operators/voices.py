"""The voice library: a snapshot and a log of changes, read together, with deletions that late changes can't undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["name", "audio_filename", "ref_text", "created_at"]


def _changes(snapshot: DataFrame | None, log: DataFrame) -> DataFrame:
    columns = ["voice_id", "seq", "op", *FIELDS]
    return log.select(*columns) if snapshot is None else snapshot.select(*columns).unionByName(log.select(*columns))


def last_changes(snapshot: DataFrame | None, log: DataFrame) -> DataFrame:
    """(voice_id, seq, op, fields): the last change of each voice, by seq, deletions included.

    log and snapshot have voice_id, seq, op (upsert or delete) and the voice's fields. Of changes with one seq a deletion wins,
    then the greatest fields. Changes are combined before the shuffle; a voice with very many is a group like others.
    """
    last = F.max(F.struct("seq", (F.col("op") == "delete").alias("gone"), F.struct("op", *FIELDS).alias("v")))
    found = _changes(snapshot, log).where("voice_id IS NOT NULL").groupBy("voice_id").agg(last.alias("c"))
    return found.select("voice_id", "c.seq", "c.v.*")


def voices(snapshot: DataFrame | None, log: DataFrame) -> DataFrame:
    """(voice_id, seq, fields) of the voices that are there, whatever the order of the log's rows; rows without an id are none."""
    return last_changes(snapshot, log).where("op <> 'delete'").drop("op")


def compacted(snapshot: DataFrame | None, log: DataFrame, settled: int) -> DataFrame:
    """A snapshot that stands for both: deletions newer than the seq `settled` stay as tombstones, so that late changes before
    them stay without effect; older ones go, as no change under `settled` can come any more."""
    return last_changes(snapshot, log).where((F.col("op") != "delete") | (F.col("seq") > settled)).select("voice_id", "seq", "op", *FIELDS)


def valid_id(voice_id: Column) -> Column:
    """Whether an id names no path: it has no slash, backslash or two dots."""
    return F.coalesce(~voice_id.rlike(r"[/\\]|\.\."), F.lit(False))


def delete_outcomes(requests: DataFrame, now: DataFrame) -> DataFrame:
    """(request_id, voice_id, outcome, audio_filename) of requests (request_id, voice_id): ok with the file that goes, invalid or
    not_found."""
    there = now.select("voice_id", "audio_filename", F.lit(True).alias("there"))
    valid = valid_id(F.col("voice_id"))
    outcome = F.when(~valid, "invalid").when(F.col("there").isNull(), "not_found").otherwise("ok")
    joined = requests.select("request_id", "voice_id").join(there, "voice_id", "left")
    return joined.select("request_id", "voice_id", outcome.alias("outcome"), F.when(outcome == "ok", F.col("audio_filename")).alias("audio_filename"))


def deletions(outcomes: DataFrame, seq: Column) -> DataFrame:
    """The log rows of the requests that are ok, a row for a voice and seq."""
    none = [F.lit(None).cast("string").alias(f) for f in FIELDS[:3]]
    rows = outcomes.where("outcome = 'ok'").select("voice_id", seq.cast("long").alias("seq"), F.lit("delete").alias("op"), *none, F.lit(None).cast("timestamp").alias("created_at"))
    return rows.dropDuplicates(["voice_id", "seq"])
