"""What may go on: articles by size and words, texts for a preview, and folders of sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ARTICLE_BYTES = 12 * 1024 * 1024
FEWEST_WORDS = 40
ENOUGH_WORDS = 120
PREVIEW_CHARS = 500
SESSION_ID = r"\A[a-zA-Z0-9\-]{12,36}\z"


def article_status(html: Column, n_words: Column, most_bytes: int = ARTICLE_BYTES) -> Column:
    """too_large beyond most_bytes of UTF-8, rejected under 40 words, fallback (another source is needed) under 120, else ok.

    A size or a number of words that is exactly at a bound is on the better side of it; a null page or number of words is
    rejected.
    """
    n = F.coalesce(n_words, F.lit(0))
    sized = F.when(F.octet_length(html) > most_bytes, "too_large")
    return sized.when(html.isNull() | (n < FEWEST_WORDS), "rejected").when(n < ENOUGH_WORDS, "fallback").otherwise("ok")


def preview_rejected(text: Column, most: int = PREVIEW_CHARS) -> Column:
    """Whether a text has more characters than a preview takes; a null text has none."""
    return F.coalesce(F.length(text) > most, F.lit(False))


def preview_of(text: Column, most: int = PREVIEW_CHARS) -> Column:
    """What a preview shows of a text; null for null."""
    return F.left(text, F.lit(most))


def session_path(session_id: Column, root: str) -> Column:
    """The session's folder below root; null where the id is null or isn't 12 to 36 letters, digits and hyphens, so no id
    leads out of root."""
    return F.when(session_id.rlike(SESSION_ID), F.concat_ws("/", F.lit(root), session_id))
