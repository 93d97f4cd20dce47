"""Gloss text: separators, stopwords, tokens and gloss lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters between the terms of a gloss entry, and the words that carry no meaning in a lookup.
SEPARATORS = " \t\r\n()[],.-;:{}?!/\\&%+="
STOPWORDS = (
    "i a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()

SEPARATOR_RUN = r"[ \t\r\n()\[\],.\-;:{}?!/\\&%+=]+"


def tokens(text: Column | str) -> Column:
    """The pieces between separators, empty ones dropped; null for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(text, SEPARATOR_RUN), lambda t: t != "")


def is_stopword(word: Column | str) -> Column:
    word = F.col(word) if isinstance(word, str) else word
    return F.lower(word).isin(STOPWORDS)


def keep_gloss_token(token: Column, gloss: Column) -> Column:
    """A token is indexed if it is the whole gloss or no stopword."""
    return (F.octet_length(token) == F.octet_length(gloss)) | ~is_stopword(token)


def entries_of(glosses: Column | str, lang: str) -> Column:
    """Entries of the first gloss in lang; null if there is none."""
    glosses = F.col(glosses) if isinstance(glosses, str) else glosses
    return F.try_element_at(F.filter(glosses, lambda g: g["lang"] == lang), F.lit(1))["entries"]


def add_gloss(glosses: Column | str, lang: str, entry: Column | str) -> Column:
    """glosses with one more entry at the end of the first gloss in lang, or with a new gloss of it alone."""
    glosses = F.coalesce(F.col(glosses) if isinstance(glosses, str) else glosses, F.array().cast("array<struct<lang:string,entries:array<string>>>"))
    entry = F.array(F.col(entry) if isinstance(entry, str) else entry)
    at = F.array_position(F.transform(glosses, lambda g: g["lang"]), lang) - 1
    gloss = lambda g, entries: F.struct(g["lang"].alias("lang"), entries.alias("entries"))
    longer = F.transform(glosses, lambda g, i: gloss(g, F.when(i == at, F.concat(F.coalesce(g["entries"], F.array().cast("array<string>")), entry)).otherwise(g["entries"])))
    return F.when(at >= 0, longer).otherwise(F.concat(glosses, F.array(F.struct(F.lit(lang).alias("lang"), entry.alias("entries")))))


def gloss_string(entries: Column | str) -> Column:
    """Entries joined by ', ' with a final '.' unless the text ends in . ; ) , ? or the last entry is empty."""
    entries = F.col(entries) if isinstance(entries, str) else entries
    joined = F.array_join(entries, ", ")
    last = F.try_element_at(entries, F.lit(-1))
    closed = F.right(last, F.lit(1)).isin(".", ";", ")", ",", "?") | (last == "") | (F.size(entries) <= 0)
    return F.when(closed, joined).otherwise(F.concat(joined, F.lit(".")))


def gloss_text(glosses: Column | str) -> Column:
    """The text form lang:entry:entry#lang:entry."""
    glosses = F.col(glosses) if isinstance(glosses, str) else glosses
    return F.array_join(F.transform(glosses, lambda g: F.concat_ws(":", g["lang"], F.array_join(g["entries"], ":"))), "#")


def has_tag(tags: Column | str, tag: Column | str) -> Column:
    """Membership without regard to ASCII case."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.coalesce(F.exists(tags, lambda t: F.lower(t) == F.lower(tag)), F.lit(False))
