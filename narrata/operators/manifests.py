"""Requests for models that run elsewhere, and the hook that runs a function of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.operators.batches import in_slices

# Fixed values.
INSTRUCTED_MODELS = ["gpt-4o-mini-tts"]
VOICES = ["alloy", "ash", "ballad", "coral", "echo", "fable", "nova", "onyx", "sage", "shimmer", "verse"]
DEFAULT_PRESET = "ocr_cleanup"
CASTING_CHARS = 10_000


def tts_requests(chunks: DataFrame, keys: list[str], model: Column, voice: Column, instructions: Column, fmt: str = "mp3") -> DataFrame:
    """(keys, request): JSON of a speech request; instructions are only sent to models that follow them, nulls are left out."""
    told = F.when(model.isin(INSTRUCTED_MODELS) & (instructions != ""), instructions)
    body = F.struct(model.alias("model"), voice.alias("voice"), F.col("text").alias("input"), F.lit(fmt).alias("response_format"), told.alias("instructions"))
    return chunks.select(*keys, F.to_json(body).alias("request"))


def voice_error(mode: Column, voice: Column, reference: Column, reference_text: Column, description: Column) -> Column:
    """Why a voice request can't be made, or null."""
    blank = lambda c: c.isNull() | (c == "")
    return (
        F.when(mode == "preset", F.when(voice.isNull() | ~voice.isin(VOICES), F.concat(F.lit("unknown voice: "), F.coalesce(voice, F.lit("")))))
        .when(mode == "clone", F.when(blank(reference), F.lit("clone needs reference audio")).when(blank(reference_text), F.lit("clone needs the text of its reference")))
        .when(mode == "design", F.when(blank(description), F.lit("design needs a description")))
        .otherwise(F.concat(F.lit("unknown mode: "), F.coalesce(mode, F.lit(""))))
    )


def clean_requests(chunks: DataFrame, presets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, preset, prompt, text): the prompt of the chunk's preset, its own where it brings one, and the standard preset's
    where the name is unknown; null where there is no standard preset. presets is a list (preset, prompt); of prompts of one
    name the least counts. Every chunk gives one row, where it lies: a preset that most chunks name sends no text to one task."""
    known = presets.groupBy("preset").agg(F.min("prompt").alias("prompt"))
    standard = known.where(F.col("preset") == DEFAULT_PRESET).select(F.col("preset").alias("__standard"), F.col("prompt").alias("standard"))  # one row at most
    named = chunks.join(F.broadcast(known), "preset", "left").withColumn("__standard", F.lit(DEFAULT_PRESET)).join(F.broadcast(standard), "__standard", "left")
    return named.select(*keys, F.when(F.col("prompt").isNotNull() | F.col("custom_prompt").isNotNull(), F.col("preset")).otherwise(F.lit(DEFAULT_PRESET)).alias("preset"), F.coalesce("custom_prompt", "prompt", "standard").alias("prompt"), "text")


def casting_requests(books: DataFrame, prompt: str) -> DataFrame:
    """(book_id, prompt): the prompt and the book's first characters."""
    return books.select("book_id", F.concat(F.lit(prompt), F.lit("\n\n"), F.substring("text", 1, CASTING_CHARS)).alias("prompt"))


def apply_hook(rows: DataFrame, hook: Callable[[str], str | None], keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, output, ok, error): the hook's reply to each text, in Arrow batches; no reply leaves the text, an exception is
    that row's error."""

    def one(text: str | None) -> tuple[str | None, bool, str | None]:
        try:
            reply = hook(text or "")
        except Exception as e:  # noqa: BLE001  every row's failure is its own
            return text, False, f"{type(e).__name__}: {e}"
        return (text if reply is None else reply), True, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(t) for t in batch.column(len(keys)).to_pylist()]
            out = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *out], names=[*keys, "output", "ok", "error"])

    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, F.col(text_col).cast("string").alias(text_col)).mapInArrow(in_slices(run, len(keys)), f"{fields}, output string, ok boolean, error string")
