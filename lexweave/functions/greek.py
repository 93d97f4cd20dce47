"""Folding, keywords, collation, transliteration of Greek (and Hebrew) words, as column expressions.

All tables are made by a rule (strip marks, lower case, final sigma to sigma) less the letters that a fold leaves alone.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .glosses import is_stopword

MAX_WORD_BYTES = 499
MAX_PREFIX = 49

# Letters that the unaccented fold only lowers, and those that it leaves alone.
_UNACCENT_LOWERS = "ΪΫἊἋἎἏἚἛἜἪἫἬἭἺἻἼἽὊὋὌὍὛὝὨὩὫὬὭ".translate(str.maketrans({"Ἆ": "", "Ἇ": ""}))
_UNACCENT_KEEPS = "ΐΰϊϴἆἇἎἏἮἯἾἿὟὪὮὯᾀᾁᾂᾃᾄᾅᾆᾇᾈᾉᾊᾋᾌᾍᾎᾏᾟᾠᾡᾢᾣᾤᾥᾦᾧᾨᾩᾪᾫᾬᾭᾮᾯᾰᾱᾲᾳᾴᾸᾹᾼῐῑῒῗῘῙῠῡῢῧῨῩῲῳῴῼ"
# Capitals without a lower case in the lowering table.
_LOWER_LACKS = "ϴἎἏἮἯἾἿὟὪὮὯᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾸᾹᾼῌῘῙῨῩῼ"
# Letters that the collation fold leaves alone.
_COLLATE_KEEPS = "ΙΪΫΰϴἊἋἏἚἛἪἫἭἮἯἺἻἽἾἿὊὋὌὍὛὝὟὪὫὬὭὮὯᾁᾂᾃᾅᾇᾈᾉᾊᾋᾌᾎᾏᾟᾡᾢᾣᾥᾨᾩᾪᾫᾬᾭᾮᾯᾱᾸᾹᾼῑῒῗῘῙῡῢῧῨῩῼ"
# Letters that the character fold leaves alone, but for the first two of its capitals, which it lowers.
_NORMALISE_KEEPS = "ΐΪΫΰϊϴἆἇἎἏἮἯἾἿὟὨὩὪὮὯᾀᾁᾂᾃᾄᾅᾆᾇᾈᾉᾊᾋᾌᾍᾎᾏᾟᾠᾡᾢᾣᾤᾥᾨᾩᾪᾫᾬᾭᾮᾯᾰᾱᾲᾳᾴᾸᾹᾼῐῑῒῗῘῙῠῡῢῧῨῩῲῴῼ"
_ASCII = {chr(c): chr(c + 32) for c in range(65, 91)}


def _greek_letters() -> list[str]:
    out = []
    for code in (*range(0x370, 0x400), *range(0x1F00, 0x2000)):
        c = chr(code)
        if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFC", c) == c and "α" <= unicodedata.normalize("NFD", c)[0].lower() <= "ω":
            out.append(c)
    return out


GREEK = _greek_letters()


def _base(c: str) -> str:
    """The bare small letter; ς counts as σ."""
    b = unicodedata.normalize("NFD", c)[0].lower()
    return "σ" if b == "ς" else b


def _fold(keeps: str, lowers: str = "") -> dict[str, str]:
    table = {c: _base(c) for c in GREEK if _base(c) != c and c not in keeps}
    return table | {c: c.lower() for c in lowers} | _ASCII


LOWER = {c: c.lower() for c in GREEK if c.lower() != c and c not in _LOWER_LACKS} | _ASCII
UNACCENT = _fold(_UNACCENT_KEEPS + _UNACCENT_LOWERS, _UNACCENT_LOWERS)
COLLATE = _fold(_COLLATE_KEEPS)
NORMALISE = _fold(_NORMALISE_KEEPS, "ΪΫ")

_ACUTE, _GRAVE, _BEND, _IOTA, _DOTS = "́", "̀", "͂", "ͅ", "̈"


def _remove_accent() -> dict[str, str]:
    """Accents go, breathings stay, capitals become small. Of letters with iota subscript only a few omegas take part,
    and lose it."""
    table = {}
    for c in GREEK:
        marks = unicodedata.normalize("NFD", c)[1:]
        if _IOTA in marks and c not in "ῷῳᾧᾯᾦᾮ":
            continue
        if _DOTS in marks or not (set(marks) & {_ACUTE, _GRAVE, _BEND} or c == "ῳ"):
            continue
        kept = "".join(m for m in marks if m in "̓̔")
        table[c] = unicodedata.normalize("NFC", unicodedata.normalize("NFD", c)[0].lower() + kept)
    return table


REMOVE_ACCENT = _remove_accent()
# Letters with a grave that stay as they are.
FIX_GRAVE = {
    c: unicodedata.normalize("NFC", unicodedata.normalize("NFD", c).replace(_GRAVE, _ACUTE))
    for c in GREEK
    if _GRAVE in unicodedata.normalize("NFD", c) and not {_IOTA, _DOTS} & set(unicodedata.normalize("NFD", c)) and c not in "ὢὪ"
}


def swap(text: Column | str, table: dict[str, str]) -> Column:
    """translate() with a table of single characters."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(text, "".join(table), "".join(table.values()))


def unaccented(word: Column | str) -> Column:
    return swap(word, UNACCENT)


def lowercased(word: Column | str) -> Column:
    return swap(word, LOWER)


def sort_key(word: Column | str) -> Column:
    """Orders like the collation when the word itself breaks ties: strings compare by code point."""
    return swap(word, COLLATE)


def normalised_chars(word: Column | str) -> Column:
    return swap(word, NORMALISE)


#: Letters that take up a word's one accent: accented and without a lower case.
_FIRST = "".join(c for c in REMOVE_ACCENT if c not in LOWER)
_BEFORE = f"^[^{_FIRST}]*"
_AFTER = LOWER | REMOVE_ACCENT


def _accented_word(word: Column) -> Column:
    before = F.regexp_extract(word, _BEFORE, 0)
    n = F.length(before)
    return F.concat(swap(before, LOWER), swap(F.substr(word, n + 1, F.lit(1)), FIX_GRAVE), swap(F.substr(word, n + 2), _AFTER))


def accented(word: Column | str) -> Column:
    """The accented key: in lower case with one accent a word, acute for grave, and final sigma at the end of the text.

    A word falls into what precedes its first accented small letter (lowered), that letter (grave to acute) and the rest
    (accents removed), so that no loop over characters is needed.
    """
    word = F.col(word) if isinstance(word, str) else word
    parts = F.transform(F.split(word, r"(?<=[ \t])"), _accented_word)
    out = F.when(F.regexp_like(word, F.lit("[ \\t]")), F.array_join(parts, "")).otherwise(_accented_word(word))
    ends = F.regexp_like(word, F.lit("[σΣς]\\z"))
    return F.when(ends, F.concat(F.substr(out, F.lit(1), F.length(out) - 1), F.lit("ς"))).otherwise(out)


def keyword_rows(df: DataFrame, word: str, exact_only: tuple[str, ...] = ()) -> DataFrame:
    """df with a row for each (tier, keyword) of its column word, which is dropped: tier 1 the accented key, 2 the
    unaccented key if it differs, 3 the prefixes of both from 2 characters to one less than the word, at most
    MAX_PREFIX, without stopwords. Rows with an empty or overlong word drop out. Columns of exact_only are null in tier 3.

    A row first becomes one row for each prefix length (length 1 stands for the whole keys), then one for each key: both
    steps stay in generated code.
    """
    kept = [c for c in df.columns if c != word]
    usable = df.filter(F.octet_length(word).between(1, MAX_WORD_BYTES))
    folded = usable.select(*kept, accented(word).alias("_a"), unaccented(word).alias("_u"))
    lengths = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("_a") - 1, F.lit(MAX_PREFIX))))
    long = folded.select(*kept, "_a", "_u", F.explode(lengths).alias("_k"))
    whole = F.col("_k") == 1
    cut = long.select(*kept, whole.alias("_whole"), F.when(whole, F.col("_a")).otherwise(F.substr("_a", F.lit(1), F.col("_k"))).alias("_a"), F.when(whole, F.col("_u")).otherwise(F.substr("_u", F.lit(1), F.col("_k"))).alias("_u"))
    entry = lambda tier, key: F.struct(F.when(F.col("_whole"), tier).otherwise(3).alias("tier"), F.col(key).alias("keyword"))
    keys = F.explode(F.array(entry(1, "_a"), F.when(F.col("_a") != F.col("_u"), entry(2, "_u"))))
    rows = cut.select(*kept, keys.alias("_e")).filter(F.col("_e").isNotNull() & ((F.col("_e.tier") < 3) | ~is_stopword(F.col("_e.keyword"))))
    return rows.select("_e.keyword", "_e.tier", *[F.when(F.col("_e.tier") < 3, F.col(c)).alias(c) if c in exact_only else F.col(c) for c in kept])


# Letters and what they are in Latin script.
_LATIN = dict(zip("αβγδεζηικλμνξοπρστυω", "abgdezeiklmnxoprstuo")) | {"θ": "th", "φ": "ph", "χ": "ch", "ψ": "ps"}
_HEBREW = dict(zip("אבגדהוזחטיכךלמםנןסעפףצץקרשת־", "'bgdhwzhtykklmmnnsʿppssqrst-"))
_KEPT_LATIN = "bdfghklmnprstxzBDFGHKLMNPRSTXZ"
# Greek letters that have no transliteration.
_NO_LATIN = (
    "ΐΪΫΰϊϴἊἋἚἛἜἪἫἬἭἺἻἼἽὊὋὌὍὛὝὢὣὨὩὪὫὬὭᾀᾁᾂᾃᾄᾅᾆᾇᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾠᾡᾢᾣᾤᾥᾨᾩᾪᾫᾬᾭᾮᾯᾰᾱᾲᾳᾴᾸᾹᾼῌῐῑῒῗῘῙῠῡῢῧῨῩῲῳῴῼ"
)


def transliteration_table(allow_unicode: bool) -> dict[str, str]:
    table = {c: c for c in _KEPT_LATIN} | _HEBREW | {"ϝ": "w", "᾽": "'"}
    for c in GREEK:
        if c in _NO_LATIN:
            continue
        latin = _LATIN[_base(c)]
        if allow_unicode and _base(c) in "ηω":
            latin = {"η": "ē", "ω": "ō"}[_base(c)]
        table[c] = latin if c == c.lower() else latin[0].upper() + latin[1:]
    return table


def transliterated(word: Column | str, allow_unicode: bool = False) -> Column:
    """Latin letters for Greek and Hebrew ones; characters without any are dropped."""
    word = F.col(word) if isinstance(word, str) else word
    table = transliteration_table(allow_unicode)
    several: dict[str, str] = {}
    for latin in table.values():
        if len(latin) > 1 and latin not in several:
            several[latin] = chr(0xE000 + len(several))  # stands for the letters until the end
    known = F.regexp_replace(word, "[^" + "".join(sorted(set(table) - {"-"})) + "]", "")
    out = swap(known, {c: several.get(x, x) for c, x in table.items()})
    for latin, mark in several.items():
        out = F.replace(out, F.lit(mark), F.lit(latin))
    return out
