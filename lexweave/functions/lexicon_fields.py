"""Casts of the fields of lexicon lines; a value that can't be cast is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the parts of speech, in order from 0, by their English label without spaces.
PARTS_OF_SPEECH = (
    "unknown particle verb noun adjective adverb conjunction propernoun preposition conditional article interjection "
    "pronoun personalpronoun possessivepronoun relativepronoun demonstrativepronoun reciprocalpronoun reflexivepronoun "
    "transliteration hebrewtransliteration aramaictransliteration letter numeral superlativeadjective superlativeadverb "
    "superlativenoun comparativeadjective comparativeadverb comparativenoun"
).split()
# The articles of each gender code.
ARTICLES = {"": 0, "ὁ": 1, "ἡ": 2, "ὁ ἡ": 3, "ὁ,ἡ": 3, "τό": 4, "τὸ": 4, "ὁ τό": 5, "ὁ,τό": 5, "ὁ ἡ τό": 7, "ὁ,ἡ,τό": 7}
GENDERS = {0: "", 1: "masculine", 2: "feminine", 3: "masculine_feminine", 4: "neuter", 5: "masculine_neuter", 7: "masculine_feminine_neuter"}
# Language codes as read, and the code that each stands for.
LANGS = {"he": "he", "el": "el", "aaa": "aaa", "en": "en", "zh": "zh", "zh_tw": "zh", "zh_hanst": "zh", "es": "es", "ru": "ru", "uk": "ru", "ko": "ko"}

INTERROGATIVE, INDEFINITE, INDECLINABLE = 1 << 25, 1 << 28, 1 << 29
MAX_TAGS = 10


def mapped(column: Column, table: dict) -> Column:
    """Lookup in a small literal map; null where the key is missing."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[column]


def is_u16(text: Column, least: int = 0) -> Column:
    """Written in the digits 0-9 only, and from least to 65535; leading zeros are allowed."""
    digits = F.regexp_replace(text, "^0+(?=[0-9])", "")
    short = F.regexp_like(text, F.lit(r"^[0-9]+\z")) & (F.length(digits) <= 5)
    return F.coalesce(short & F.when(short, digits).try_cast("int").between(least, 65535), F.lit(False))


def u16(text: Column) -> Column:
    return F.when(is_u16(text), text.try_cast("int"))


def u24(text: Column) -> Column:
    value = text.try_cast("int")
    return F.when(F.regexp_like(text, F.lit(r"^[0-9]+\z")) & value.between(0, 0xFFFFFF), value)


def boolean(text: Column) -> Column:
    return F.when(F.lower(text).isin("true", "yes"), True).when(F.lower(text).isin("false", "no"), False)


def lang_code(text: Column) -> Column:
    return mapped(F.lower(text), LANGS)


def pos_code(text: Column) -> Column:
    """Packed code of a label in any case, its words joined by nothing, space, '_' or '-'; unknown is 0."""
    key = F.regexp_replace(F.lower(text), "(?<=[a-z])[ _-](?=[a-z])", "")
    table = {name: code for code, name in enumerate(PARTS_OF_SPEECH)}
    table |= {"definitearticle": 10, "interrogativepronoun": 12 | INTERROGATIVE, "indefinitepronoun": 12 | INDEFINITE, "interrogativeparticle": 1 | INTERROGATIVE, "indeclinablepropernoun": 7 | INDECLINABLE}
    known = (F.octet_length(text) <= 40) & (F.lower(text) != "comparativeadjective")
    return F.coalesce(F.when(known, mapped(key, table)), F.lit(0))


def article_code(text: Column) -> Column:
    return mapped(text, ARTICLES)


def strongs_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[, ]+"), u16), lambda n: n.isNotNull())


def tag_list(text: Column) -> Column:
    """Split at quotes, spaces, commas and line ends; the first MAX_TAGS are kept; null where none is."""
    tags = F.slice(F.filter(F.split(text, '[" ,\\n\\r\\t]+'), lambda t: t != ""), 1, MAX_TAGS)
    return F.when(F.size(tags) > 0, tags)


def gloss_list(text: Column) -> Column:
    """lang:entry:entry#lang:entry to an array of glosses; fields before the first known language are dropped, so are
    empty entries; an empty text gives null."""
    parsed = F.transform(F.split(text, "#"), lambda g: F.split(g, ":"))
    first = lambda parts: F.filter(F.transform(parts, lambda p, i: F.when(lang_code(p).isNotNull(), i)), lambda i: i.isNotNull())[0]
    started = F.transform(F.filter(parsed, lambda p: F.exists(p, lambda x: lang_code(x).isNotNull())), lambda p: F.struct(p.alias("parts"), first(p).alias("at")))
    glosses = F.transform(
        started,
        lambda s: F.struct(
            lang_code(F.get(s["parts"], s["at"])).alias("lang"),
            F.filter(s["parts"], lambda e, i: (i > s["at"]) & (e != "")).alias("entries"),
        ),
    )
    return F.when(text != "", glosses)


_REFERENCE = r"^(?:([^#]*)#)?([0-9]*[^0-9#,.|\t\n]*?) ?([0-9]+):([0-9]+)(?: ([0-9]+))?.*\z"


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def reference(text: Column) -> Column:
    """'module#Book c:v w' to a struct, null if it isn't one; module may be missing, text after it is ignored."""
    parts = F.when(F.regexp_like(text, F.lit(_REFERENCE)), F.split(F.regexp_replace(text, _REFERENCE, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001"))
    given = lambda c: F.when(c != "", c)
    made = lambda p: F.when(
        p.isNotNull(),
        F.struct(given(p[0]).alias("module"), p[1].alias("book"), u16(p[2]).alias("chapter"), u16(p[3]).alias("verse"), F.coalesce(u16(given(p[4])), F.lit(0)).alias("word")),
    )
    return let(parts, made)


def reference_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda r: reference(F.trim(r))), lambda r: r.isNotNull())
