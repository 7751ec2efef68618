"""Characters, their voices, and replies of models and servers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARACTER = "struct<name:string,description:string,line_count:int,sample_lines:array<string>>"


def characters(lines: DataFrame, by: list[str], name_col: str, text_col: str, order: list[str], samples: int = 3) -> DataFrame:
    """(by, character_name, line_count, sample_lines): each character's lines and the first few of them.

    The first lines are ranked before they are gathered, so a character with very many lines is no large group.
    """
    from pyspark.sql import Window

    named = lines.withColumnRenamed(name_col, "character_name")
    keys = [*by, "character_name"]
    counts = named.groupBy(*keys).agg(F.count("*").alias("line_count"))
    first = named.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= samples)
    some = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", text_col))), lambda x: x[text_col]).alias("sample_lines"))
    return counts.join(some, keys)


def narrator_voice(books: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each book's voice: that of its first assignment (book_id, seq, voice), else its own default_voice."""
    first = assignments.groupBy("book_id").agg(F.min_by("voice", "seq").alias("assigned"))
    return books.join(first, "book_id", "left").select("book_id", F.coalesce("assigned", "default_voice").alias("voice"))


def parse_casting(reply: Column) -> Column:
    """The characters of a reply, which is an array or an object that holds one; empty where it can't be read."""
    as_array = F.from_json(reply, f"array<{CHARACTER}>")
    as_object = F.from_json(reply, f"struct<characters:array<{CHARACTER}>>")["characters"]
    some = F.when(F.ltrim(reply).startswith("["), as_array).otherwise(as_object)
    filled = F.transform(F.filter(some, lambda c: c.isNotNull()), lambda c: F.struct(F.coalesce(c["name"], F.lit("Unknown")).alias("name"), F.coalesce(c["description"], F.lit("")).alias("description"), F.coalesce(c["line_count"], F.lit(0)).alias("line_count"), F.coalesce(c["sample_lines"], F.array().cast("array<string>")).alias("sample_lines")))
    return F.coalesce(filled, F.array().cast(f"array<{CHARACTER}>"))


def license_state(reply: Column) -> Column:
    """struct(valid, kind, expires_at) of a licence server's reply."""
    r = F.from_json(reply, "struct<success:boolean,license:string,expires:string>")
    valid = F.coalesce(r["success"] & (r["license"] == "valid"), F.lit(False))
    kind = F.when(r["expires"] == "lifetime", "lifetime").when(r["expires"].isNotNull(), "annual")
    return F.struct(valid.alias("valid"), kind.alias("kind"), F.when(kind == "annual", F.try_to_timestamp(r["expires"])).alias("expires_at"))


def resolve_paths(rows: DataFrame, voices: DataFrame) -> DataFrame:
    """Rows with voice addresses replaced by the file that voices (url, path) has for them, or as they are."""
    return rows.join(voices.withColumnRenamed("url", "voice_url"), "voice_url", "left").withColumn("voice_path", F.coalesce("path", "voice_url")).drop("path")


def paired_transcripts(files: DataFrame) -> DataFrame:
    """(audio, transcript) of a listing (path): the first that is there of <stem>.txt, <stem>_transcript.txt, <stem>.transcript.txt."""
    audio = files.where(F.lower("path").rlike(r"\.(wav|mp3|flac|m4a)$")).select(F.col("path").alias("audio"), F.regexp_replace("path", r"\.[^.]+$", "").alias("stem"))
    wanted = audio.select("audio", F.posexplode(F.array(*(F.concat("stem", F.lit(s)) for s in (".txt", "_transcript.txt", ".transcript.txt")))).alias("place", "path"))
    found = wanted.join(files, "path", "left_semi").groupBy("audio").agg(F.min_by("path", "place").alias("transcript"))
    return audio.select("audio").join(found, "audio", "left")
