"""Books' settings: nested standard values with each book's own merged into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The standard settings, sections in sections.
DEFAULTS: dict = {
    "intro_text": None,
    "title_announcement": None,
    "outro_text": None,
    "chapters": {"include": None, "exclude": ["frontcoverImage", "title", "copyrightPage", "contents", "notes", "bibliography", "index", "maps", "timeline"]},
    "conversion": {"announce_chapters": True, "chapter_pause": 2.5, "chunk_size": 1500, "min_chunk_size": 200, "max_retries": 3, "retry_delay": 5},
    "text_cleaning": {"fix_spaced_capitals": True, "remove_footnotes": True, "normalize_special_chars": True},
    "output": {"format": "m4b", "bitrate": "128k", "embed_cover": True},
    "memory": {"clear_cache_per_chapter": True, "low_memory_threshold": 4.0, "emergency_split_threshold": 2.0},
}
#: Types of settings whose standard value is null.
TYPES = {"intro_text": "string", "title_announcement": "string", "outro_text": "string", "chapters.include": "array<string>"}


def _type(value: object, path: str, types: dict[str, str]) -> str:
    if path in types:
        return types[path]
    if isinstance(value, list):
        return "array<string>"
    return {bool: "boolean", int: "int", float: "double"}.get(type(value), "string")


def _literal(value: object, kind: str) -> Column:
    if isinstance(value, list):
        return F.array(*map(F.lit, value)).cast(kind)
    return F.lit(value).cast(kind)


def merged_settings(own: Column, defaults: dict | None = None, types: dict[str, str] | None = None) -> Column:
    """A struct like `defaults` in which own, a VARIANT, wins: sections merge key by key, all else is replaced whole.

    Arrays are replaced, not joined; a null that own gives is a null, for a section too; a key that own doesn't have keeps the
    standard value, as all do where own is null or isn't an object. A value of another type than the standard one is cast,
    or null where it can't be; a section that own replaces by a plain value is null; keys that defaults lacks are left
    out of the struct (extra_settings() has them).
    """
    defaults, types = DEFAULTS if defaults is None else defaults, TYPES if types is None else types

    def get(path: str) -> Column:
        return F.try_variant_get(own, f"$.{path}", "variant")

    def node(value: object, path: str) -> Column:
        if isinstance(value, dict):
            inner = F.struct(*(node(v, f"{path}.{k}").alias(k) for k, v in value.items()))
            given = get(path)
            replaced = given.isNotNull() & ~F.coalesce(F.schema_of_variant(given).startswith("OBJECT"), F.lit(False))
            return F.when(~F.coalesce(replaced, F.lit(False)), inner)
        kind = _type(value, path, types)
        return F.when(get(path).isNotNull(), F.try_variant_get(own, f"$.{path}", kind)).otherwise(_literal(value, kind))

    return F.struct(*(node(v, k).alias(k) for k, v in defaults.items()))


def extra_settings(own: Column, defaults: dict | None = None) -> Column:
    """The top-level keys of own (VARIANT) that defaults lacks, with their values as JSON text; null where own isn't an object."""
    known = list(DEFAULTS if defaults is None else defaults)
    given = F.from_json(F.to_json(own), "map<string,string>")
    return F.map_filter(given, lambda k, _: ~k.isin(known))


def resolve_settings(books: DataFrame, own: DataFrame, defaults: dict | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """books with `settings`: the standard values with those of own (book_id, json) merged into them.

    own has a row for a book at most (each row of several gives one of its own); text that isn't JSON counts as none; a book
    without a row has the standard values.
    """
    given = own.select("book_id", F.try_parse_json("json").alias("own"))
    return books.join(given, "book_id", "left").withColumn("settings", merged_settings(F.col("own"), defaults, types)).drop("own")
