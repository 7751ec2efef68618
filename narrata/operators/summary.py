"""Extracts of articles for listening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions import text as X

# Fixed values.
KEYWORDS = ["important", "key", "significant", "impact", "means", "therefore", "however", "reveals", "shows", "future"]
NO_CONTENT = "No content extracted."
NO_INSIGHT = "The article highlights several notable points."
TAKEAWAY = "Review the key insights and apply the most relevant ideas to your goals or workflow."


def long_sentences(text: Column) -> Column:
    """Sentences of 30 characters or more."""
    return F.filter(F.transform(X.sentences(text), X.strip), lambda s: F.length(s) >= 30)


def _summary(s: Column, text: Column) -> Column:
    start = X.strip(F.substring(text, 1, 500))
    return F.when(F.size(s) > 0, F.array_join(F.slice(s, 1, 6), " ")).when(start != "", start).when(X.strip(text) != "", start).otherwise(F.lit(NO_CONTENT))


def _insights(s: Column) -> Column:
    telling = F.slice(F.filter(s, lambda x: F.exists(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(F.lower(x), k))), 1, 4)

    def filled(t: Column) -> Column:
        fill = F.filter(F.slice(s, 7, 10), lambda x: ~F.array_contains(t, x))
        full = F.when(F.size(t) < 3, F.concat(t, F.slice(fill, F.lit(1), F.greatest(F.lit(0), 3 - F.size(t))))).otherwise(t)
        return F.when(F.size(full) > 0, full).otherwise(F.array(F.lit(NO_INSIGHT)))

    return X.let(telling, filled)


def summary(text: Column) -> Column:
    """The first six long sentences, else the first 500 characters."""
    return X.let(long_sentences(text), lambda s: _summary(s, text))


def insights(text: Column) -> Column:
    """The first four long sentences with a keyword; of under three, later sentences (the 7th to the 16th) fill up to three."""
    return X.let(long_sentences(text), _insights)


def summary_block(title: Column, text: Column) -> Column:
    """The summary, numbered insights and the takeaway as one text to read."""
    name = F.when(title.isNotNull() & (title != ""), title).otherwise("Article")

    def block(s: Column) -> Column:
        numbered = F.transform(_insights(s), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
        head = F.array(F.concat(F.lit("Summary and insights for: "), name), F.lit(""), F.lit("Summary:"), _summary(s, text), F.lit(""), F.lit("Key insights:"))
        return X.strip(F.array_join(F.concat(head, numbered, F.array(F.lit(""), F.lit("Takeaway:"), F.lit(TAKEAWAY))), "\n"))

    return X.let(long_sentences(text), block)


def speech_text(edited: Column, summarise: Column, title: Column, author: Column, published: Column, body: Column, ascii: bool = False) -> Column:
    """What is read of an article: an edited text, else its summary or the whole, cleaned (ascii: spaced capitals by the words of
    ASCII); null where nothing is left."""
    whole = F.when(summarise, summary_block(title, body)).otherwise(X.full_reading(title, author, published, body))
    chosen = F.when(X.strip(edited) != "", edited).otherwise(whole)
    return F.nullif(X.format_for_audio(X.apply_text_cleaning(chosen, ascii=ascii)), F.lit(""))
