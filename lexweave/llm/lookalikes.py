"""One consistent form for text that looks the same, by the skeleton of look-alike characters.

A value is decomposed, each character replaced by its prototype, and decomposed again: that is its skeleton. Values of
one language with the same skeleton are the same text; the composed skeleton (NFC) is their consistent form. Prototypes
lead into the script of the value's language (Greek, Hebrew or Latin), so that the consistent form is ordinary text:

- wide, presentation, mathematical, symbol and other compatibility variants go to their ordinary letters and digits,
- invisible characters go away, spaces become the plain space, the non-breaking hyphen the plain one,
- letters of other scripts that look like one of this script become it: those of the short list below, and all that the
  Unicode confusables table of ICU (in Spark's jars) gives the same skeleton as a letter of this script. Where the driver
  lacks ICU, that is an error.

Case, final sigma and plain punctuation stay as they are. A letter of another script without a look-alike stays too and
makes the value a case all the same. Null stays null, an empty text empty; text in an unknown language keeps the letters
of all scripts. Values are judged one by one, so ties and repeated rows need no rule.

Only values with other than plain characters of their language go to Python; the others are let through in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from py4j.java_gateway import JavaPackage
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import key_counts, split_join
from ..session import ship
from . import encoding

SCRIPT_OF = {"el": "GREEK", "he": "HEBREW", "aaa": "LATIN"}
# Letters that look like the letter below them.
_TO_GREEK = {
    "LATIN": ("aoipvuktyxnwsABEZHIKMNOPTYX", "αοιρνυκτγχηωσΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"),
    "CYRILLIC": ("аорткхпсіувгфАВЕНІКМОПРТХГФ", "αορτκχπσιγβγφΑΒΕΗΙΚΜΟΠΡΤΧΓΦ"),
}
_TO_LATIN = {
    "GREEK": ("αοιρνυκτγχηωςεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aoipvuktyxnwseABEZHIKMNOPTYX"),
    "CYRILLIC": ("аеорсухѕіјктмһԁԛԝАВЕНІЈКМОРСТХУЅ", "aeopcyxsijktmhdqwABEHIJKMOPCTXYS"),
}
#: Language to look-alike (code point) to the letter that it becomes.
Table = dict[str, dict[int, str]]
LISTED: Table = {
    "el": {ord(a): b for pair in _TO_GREEK.values() for a, b in zip(*pair)},
    "aaa": {ord(a): b for pair in _TO_LATIN.values() for a, b in zip(*pair)},
    "he": {},
}
# Invisible characters outside the category of format characters.
_INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_LETTERS = ("Lu", "Ll", "Lt", "Lo")
_WIDE_TAGS = ("<wide>", "<narrow>", "<small>", "<vertical>")
_PLAIN_SIGNS = "".join(chr(c) for c in range(32, 127) if not chr(c).isalpha()) + "\t·’‘“”«»–—…"


def script(char: str) -> str:
    """Script of a letter, '' for anything else and for modifier letters, which belong to every script."""
    if unicodedata.category(char) not in _LETTERS:
        return ""
    return unicodedata.name(char, "").split(" ")[0]


_BASIC = {"el": (0x391, 0x400), "he": (0x5D0, 0x5EB), "aaa": (0x41, 0x7B)}
# Letters of an own script that are plain as they are, whatever they look like.
_OWN = {"el": ((0x370, 0x400), (0x1F00, 0x2000)), "aaa": ((0x41, 0x180), (0x1E00, 0x1F00)), "he": ((0x5D0, 0x5EB),)}
# Scripts of very many signs, none of which looks like a letter, and compatibility letters.
_SKIPPED = ((0x3400, 0xA4D0), (0xAC00, 0xD7A4), (0x17000, 0x1BC00), (0x1D400, 0x1D800))


def _skeletons(spark: SparkSession) -> dict[str, str]:
    """ICU's confusables skeleton of each letter of the scripts of few signs. Without ICU that fails: the short list alone
    would leave look-alikes apart as if there were none."""
    chars = [chr(c) for c in range(0x41, 0x1F000) if unicodedata.category(chr(c)) in _LETTERS and not any(low <= c < high for low, high in _SKIPPED)]
    builder = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")
    if isinstance(builder, JavaPackage):  # what py4j takes an unknown class for
        raise RuntimeError("look-alikes need com.ibm.icu.text.SpoofChecker (icu4j, among the jars of Spark 4) on the driver's class path")
    return dict(zip(chars, builder().build().getSkeleton("\n".join(chars)).split("\n"), strict=True))


@lru_cache(4)
def _table(spark: SparkSession) -> Table:
    shape = _skeletons(spark)
    out: Table = {}
    for lang, (low, high) in _BASIC.items():
        targets: dict[str, list[str]] = {}
        for code in range(low, high):
            if script(chr(code)) == SCRIPT_OF[lang] and chr(code) in shape and not unicodedata.normalize("NFD", chr(code))[1:]:
                targets.setdefault(shape[chr(code)], []).append(chr(code))
        made = {}
        for char, look in shape.items():
            own = script(char) == SCRIPT_OF[lang]
            if look not in targets or own and (lang != "aaa" or any(a <= ord(char) < b for a, b in _OWN[lang])):
                continue
            # Of letters that look the same, one in the same case, else the first.
            best = min(targets[look], key=lambda t: (t.isupper() != char.isupper(), t))
            made[ord(char)] = best if best == "ϲ" else unicodedata.normalize("NFKC", best)
        out[lang] = made | LISTED[lang]
    return out


def lookalikes(spark: SparkSession) -> Table:
    """The whole table: some thousand letters of the world's alphabets for each language, whatever the data."""
    return _table(spark)


@lru_cache(200_000)
def _prototype(char: str, lookalike: str | None) -> str:
    code, kind = ord(char), unicodedata.category(char)
    if char == "\t":
        return char
    if kind in ("Cf", "Cc") or code in _INVISIBLE:
        return ""
    if kind in ("Zs", "Zl", "Zp"):
        return " "
    if code == 0x2011:
        return "-"
    if lookalike is not None:
        return lookalike
    tag = unicodedata.decomposition(char).split(" ")[0]
    if tag.startswith("<"):
        plain = unicodedata.normalize("NFKD", char)
        if tag in _WIDE_TAGS or all(unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd" for c in plain):
            return plain
    return char


def prototype(char: str, lang: str, table: Table = LISTED) -> str:
    """What stands for a character (of decomposed text) in the skeleton."""
    own = table.get(lang, {})
    plain = _prototype(char, own.get(ord(char)))
    return plain if plain == char else "".join(own.get(ord(c), c) for c in plain)


def skeleton(text: str, lang: str | None, table: Table = LISTED) -> str:
    """Decomposed, prototypes put in, decomposed again."""
    decomposed = unicodedata.normalize("NFD", text)
    out = []
    for i, char in enumerate(decomposed):
        p = prototype(char, lang or "", table)
        if char == "ϲ" or p == "ϲ":
            p = "ς" if i and (i + 1 == len(decomposed) or not decomposed[i + 1].isalpha()) else "σ"
        out.append(p)
    return unicodedata.normalize("NFD", "".join(out))


def consistent(text: str | None, lang: str | None, table: Table = LISTED) -> str | None:
    return None if text is None else unicodedata.normalize("NFC", skeleton(text, lang, table))


def is_case(text: str | None, lang: str | None, table: Table = LISTED) -> bool:
    """Whether text has a character that is no plain one in its language."""
    if text is None:
        return False
    own = SCRIPT_OF.get(lang or "")
    return consistent(text, lang, table) != text or own is not None and any(script(c) not in ("", own) for c in text)


@lru_cache(1)
def plain_letters() -> dict[str, str]:
    """Letters of each language that are plain wherever they stand: composed, of its script and without a variant."""
    out = {}
    for lang, ranges in _OWN.items():
        chars = [chr(c) for low, high in ranges for c in range(low, high)]
        out[lang] = "".join(c for c in chars if script(c) == SCRIPT_OF[lang] and unicodedata.normalize("NFKC", c) == c and consistent(c, lang) == c)
    return out


def plain_in(text: Column, lang: str) -> Column:
    """Surely plain text of a language; of other text Python decides."""
    if lang == "he":
        signs = re.escape(_PLAIN_SIGNS)
        return F.regexp_like(text, F.lit(rf"^(?:[\x{{5D0}}-\x{{5EA}}][\x{{5B0}}-\x{{5C7}}]?|[{signs}])*+\z"))
    return F.translate(text, plain_letters()[lang] + _PLAIN_SIGNS, "") == ""


def plain_text(text: Column, lang: Column) -> Column:
    out = F.when(text.isNull(), True)
    for code in SCRIPT_OF:
        out = out.when(lang == code, plain_in(text, code))
    return F.coalesce(out, F.lit(False))


def _forms_and_cases(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows = list(zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()))
            made = [consistent(t, k, table) for t, k in rows]
            cases = [is_case(t, k, table) for t, k in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string()), pa.array(cases, pa.bool_())], [*batch.schema.names, "form", "is_case"])

    return run


def _judged(values: DataFrame) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values.schema.fields) + ", form string, is_case boolean"
    spark = values.sparkSession
    return values.mapInArrow(_forms_and_cases(ship(spark, lookalikes(spark))), schema)


def with_consistent_form(values: DataFrame) -> DataFrame:
    """values (keys..., lang, text) with form, the consistent form of text, and is_case."""
    plain = plain_text(F.col("text"), F.col("lang"))
    return values.filter(plain).select("*", F.col("text").alias("form"), F.lit(False).alias("is_case")).unionByName(_judged(values.filter(~plain)))


def head_values(lexemes: DataFrame) -> DataFrame:
    """(field, lexeme_no, form_no, lang, text) of lexemes.word and lexemes.root."""
    fields = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("text")) for n, c in (("lexeme_word", "word"), ("lexeme_root", "root"))]))
    return lexemes.select("lexeme_no", F.lit(0).alias("form_no"), "lang", fields.alias("v")).select("v.field", "lexeme_no", "form_no", "lang", "v.text")


def _langs(lexemes: DataFrame) -> DataFrame:
    """One language for each number; of rows with the same one the first language in order."""
    return lexemes.groupBy("lexeme_no").agg(F.min("lang").alias("lang"))


def dictionary_values(lexemes: DataFrame, forms: DataFrame) -> DataFrame:
    """(field, lexeme_no, form_no, lang, text) of forms.word, lexemes.word and lexemes.root; lang is the lexeme's."""
    words = forms.select(F.lit("form_word").alias("field"), "lexeme_no", "form_no", F.col("word").alias("text"))
    words = split_join(words, _langs(lexemes), "lexeme_no", ["form_no", "text"], "left")
    return words.select("field", "lexeme_no", "form_no", "lang", "text").unionByName(head_values(lexemes))


def consistent_values(lexemes: DataFrame, forms: DataFrame) -> DataFrame:
    """All values with their consistent forms. Words in the wrong encoding keep theirs; that is for encoding to restore."""
    return with_consistent_form(dictionary_values(lexemes, forms))


def lookalike_groups(lexemes: DataFrame, forms: DataFrame) -> DataFrame:
    """(lang, form, originals, n): the spellings that have the same skeleton, for groups of more than one."""
    spelled = consistent_values(lexemes, forms).filter("text is not null").groupBy("lang", "form", "text").agg(F.count("*").alias("n"))
    return spelled.groupBy("lang", "form").agg(F.count("*").alias("originals"), F.sum("n").alias("n")).filter("originals > 1")


def lookalike_records(lexemes: DataFrame, forms: DataFrame) -> DataFrame:
    """(field, lexeme_no, form_no): values with a character that is no plain one, garbled words aside.

    Of the forms, those with letters carry their word into the join with their lexeme's language. A word in plain letters
    of another language is a case, but may still be a garbled one.
    """
    word = F.col("word")
    kind = F.when(word.isNull(), "none")
    for code in SCRIPT_OF:
        kind = kind.when(plain_in(word, code), code)
    signs = F.translate(word, _PLAIN_SIGNS, "") == ""  # plain in every language
    narrow = forms.select("lexeme_no", "form_no", F.when(signs, "none").otherwise(kind).alias("kind"), word.alias("text"))
    narrow = narrow.filter("kind is null or kind != 'none'")
    joined = split_join(narrow, _langs(lexemes), "lexeme_no", ["form_no", "text"], "left", key_counts(forms.select("lexeme_no"), "lexeme_no")).filter(F.col("kind").isNull() | (F.col("lang").isin(*SCRIPT_OF) & (F.col("kind") != F.col("lang"))))
    keyed = joined.select(F.lit("form_word").alias("field"), "lexeme_no", "form_no", "lang", "text", "kind")
    foreign = keyed.filter("kind is not null and kind != 'aaa'")
    odd = keyed.filter("kind is null or kind = 'aaa'").drop("kind")
    cases = _judged(odd).filter("is_case")
    script_lang = F.when(F.regexp_like("text", F.lit(r"\p{IsGreek}")), "el").when(F.regexp_like("text", F.lit(r"\p{IsHebrew}")), "he")
    words = forms.select(F.col("word").alias("text")).filter("text is not null").withColumn("lang", script_lang).unionByName(lexemes.select(F.col("word").alias("text"), "lang"))
    languages = encoding.learn_languages(words.filter("text is not null"))
    every = cases.select("field", "lexeme_no", "form_no", F.lit("*").alias("lang"), "text").unionByName(foreign.select("field", "lexeme_no", "form_no", "lang", "text"))
    judged = encoding.judged_with(every, languages, all_suspects=True)
    clean = judged.filter("not garbled").select("field", "lexeme_no", "form_no")

    heads = head_values(lexemes)
    own = with_consistent_form(heads).filter("is_case").select("field", "lexeme_no", "form_no")
    return clean.unionByName(own).distinct()
