"""Morphology: the packed parsing record, four notations that are read into it, and the one it is written in.

Tags are read by one regular expression for each part of speech. A column holds few different tags, so the readers are
Arrow UDFs with a cache: each different tag is read once a worker, whatever the number of rows.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon_fields import PARTS_OF_SPEECH

# Place of each field in the packed record, (lowest bit, bits).
FIELDS = {
    "pos": (0, 5), "tense": (5, 4), "mood": (9, 3), "gender": (12, 3), "voice": (15, 3), "case": (18, 3), "person": (21, 2), "number": (23, 2),
    "interrogative": (25, 1), "negative": (26, 1), "correlative": (27, 1), "indefinite": (28, 1), "indeclinable": (29, 1), "crasis": (30, 1),
}
# Codes of the letters of the tag notation.
TENSES = {"P": 1, "F": 2, "A": 3, "I": 4, "R": 5, "L": 6, "2F": 7, "2A": 8, "2R": 9, "2L": 10}
VOICES = {"A": 1, "M": 2, "P": 3, "E": 4, "D": 5, "O": 6, "N": 7}
MOODS = {"I": 1, "S": 2, "O": 3, "M": 4, "N": 5, "P": 6}
CASES = {"N": 1, "A": 2, "G": 3, "D": 4, "V": 5}
NUMBERS = {"S": 1, "1": 1, "D": 2, "P": 3, "2": 3}
GENDERS = {"M": 1, "F": 2, "N": 4}
REFERENTS = {"S": 11, "1": 11, "P": 12, "2": 12}
POS = {name: code for code, name in enumerate(PARTS_OF_SPEECH)}
# One-letter parts of speech and the flags that come with them.
_LETTERS = {
    "N": {"pos": 3}, "A": {"pos": 4}, "R": {"pos": 15}, "C": {"pos": 17}, "D": {"pos": 16}, "T": {"pos": 10}, "O": {"pos": 12},
    "K": {"pos": 12, "correlative": 1}, "I": {"pos": 12, "interrogative": 1}, "X": {"pos": 12, "indefinite": 1},
    "Q": {"pos": 12, "interrogative": 1, "correlative": 1}, "F": {"pos": 18}, "S": {"pos": 14}, "P": {"pos": 13}, "V": {"pos": 2},
}
_WORDS = {"ADV": 5, "PRT": 1, "INJ": 11, "HEB": 20, "COND": 9, "CONJ": 6, "ARAM": 21, "PREP": 8}
_SPECIAL = {"LI": 22, "OI": 3, "PRI": 7, "NUI": 23}
_COMPARED = {"C": {5: 28, 4: 27, 3: 29}, "S": {5: 25, 4: 24, 3: 26}}


class TagError(ValueError):
    """Incomplete, InvalidParsing, UnknownPartOfSpeech and so on."""


def pack(**values: int) -> int:
    return sum(int(v) << FIELDS[k][0] for k, v in values.items())


def unpack(packed: int) -> dict[str, int]:
    return {k: packed >> low & ((1 << bits) - 1) for k, (low, bits) in FIELDS.items()}


_BREAK = " {}[]().\"'\x00"
_FLAG = r"(?:-(?P<flag>A(?:TT|(?-i:B)B)|[IKNPCS]))?"
_ENDING = rf"(?:(?P<special>LI|OI|PRI|NUI){_FLAG}|(?P<case>[NAGDV])(?P<number>[SP12])(?:(?P<gender>[MFN]){_FLAG}%s))"


def _grammar() -> list[tuple[regex.Pattern, dict, bool]]:
    """(pattern, values, whether it ends in case, number and gender)."""
    i = regex.IGNORECASE
    full, short = _ENDING % "", _ENDING % "|"
    out = []
    for letter, values in _LETTERS.items():
        if letter == "V":
            tense, voice = "(?P<tense>2[FARL]|[PIFARL])", "(?P<voice>[AMPEDON])"
            out.append((regex.compile(rf"V-{tense}{voice}(?:(?P<mood>[IMOS])-(?P<person>[123])(?P<number>[SPD]){_FLAG}|(?P<mood>N){_FLAG})", i), values, False))
            out.append((regex.compile(rf"V-{tense}{voice}(?P<mood>P)-{full}", i), values, True))
        elif letter == "F":
            out.append((regex.compile(rf"F-(?P<person>[123]){full}", i), values, True))
        elif letter == "S":
            out.append((regex.compile(rf"S-(?P<person>[12])(?P<referent>[SP12]){full}", i), values, True))
        elif letter == "P":
            out.append((regex.compile(rf"P-(?P<person>[12])(?P<case>[NAGDV])(?P<referent>[SP12]){_FLAG}", i), values, False))
            out.append((regex.compile(rf"P-{full}", i), values, True))
        else:
            out.append((regex.compile(rf"{letter}-{short if values['pos'] in (3, 12) else full}", i), values, True))
    out.append((regex.compile(rf"(?-i:PN)-{full}", i), {"pos": 7}, True))
    out += [(regex.compile(rf"{word}{_FLAG}", i), {"pos": code}, False) for word, code in _WORDS.items()]
    return out


_GRAMMAR = _grammar()


def parse_byzantine(tag: str) -> int:
    """'V-PAI-1S' to the packed record. Brackets, quotes and spaces may surround the tag."""
    start = len(tag) - len(tag.lstrip(_BREAK))
    body = tag[start:]
    end = next((k for k, c in enumerate(body) if c in _BREAK), len(body))
    core, rest = body[:end], body[end + 1 :]
    if not core:
        raise TagError("Incomplete")
    partial = False
    for pattern, values, ends in _GRAMMAR:
        m = pattern.fullmatch(core, partial=True)
        if m is None:
            continue
        if m.partial or (ends and m["special"] is None and m["gender"] is None and end < len(body)):
            partial = True
            continue
        if ends and rest and rest[0] not in _BREAK:
            raise TagError("InvalidParsing")
        return _packed({k: v.upper() for k, v in m.groupdict().items() if v}, dict(values))
    if partial:
        raise TagError("Incomplete")
    one = core[1:2] in ("", "-")
    raise TagError("UnknownPartOfSpeech" if one and core[0].upper() not in _LETTERS else "InvalidParsing")


def _packed(found: dict[str, str], values: dict[str, int]) -> int:
    for name, table in (("tense", TENSES), ("voice", VOICES), ("mood", MOODS), ("case", CASES), ("number", NUMBERS), ("gender", GENDERS)):
        if name in found:
            values[name] = table[found[name]]
    if "person" in found:
        values["person"] = int(found["person"])
    if "referent" in found:
        values["tense"] = REFERENTS[found["referent"]]
    if special := found.get("special"):
        values |= {"pos": _SPECIAL[special], "indeclinable": 1}
    flag = found.get("flag")
    if flag == "I":
        values["interrogative"] = 1
    elif flag == "N":
        values["negative"] = 1
    elif flag == "K":
        values["correlative" if values["pos"] == 5 else "crasis"] = 1
    elif flag in _COMPARED:
        if values["pos"] not in _COMPARED[flag]:
            raise TagError("InvalidParsing")
        values["pos"] = _COMPARED[flag][values["pos"]]
    return pack(**values)


def _name(table: dict[str, int], code: int) -> str | None:
    return next((k for k, v in table.items() if v == code), None)


def _written(p: dict[str, int], slots: str) -> str:
    """Letters of the slots (p person, c case, n number, g gender, r referent) up to the first unknown one."""
    out = ""
    for slot in slots:
        letter = {
            "p": str(p["person"]) if p["person"] else None,
            "c": _name(CASES, p["case"]),
            "n": {1: "S", 3: "P"}.get(p["number"]),
            "r": {11: "S", 12: "P"}.get(p["tense"]),
            "g": {0: "", 1: "M", 2: "F", 4: "N"}.get(p["gender"], "C"),
            "G": {0: "U", 1: "M", 2: "F", 4: "N"}.get(p["gender"], "C"),
        }[slot]
        if letter is None:
            return out
        out += letter
    return out


def format_byzantine(packed: int) -> str:
    """The tag of a packed record; what is unknown ends it. A reflexive without person raises Incomplete."""
    p = unpack(packed)
    pos = p["pos"]
    flags = "-K" * p["correlative"] + "-K" * p["crasis"] + "-N" * p["negative"] + "-I" * p["interrogative"]
    dash = lambda text: "-" + text if text else ""
    ending = dash(_written(p, "cng"))
    words = {code: word for word, code in _WORDS.items()}
    if pos in (25, 28):
        return "ADV-S" if pos == 25 else "ADV-C"
    if pos in words:
        return words[pos] + ("" if pos in (20, 21) else flags)
    if p["indeclinable"] and pos in (3, 7, 22, 23):
        return {3: "N-OI", 7: "N-PRI", 22: "N-LI", 23: "A-NUI"}[pos]
    if pos == 2:
        tense, voice, mood = (_name(t, p[k]) for t, k in ((TENSES, "tense"), (VOICES, "voice"), (MOODS, "mood")))
        head = "V" + dash("".join(x for x in (tense, tense and voice, tense and voice and mood) if x))
        if not (tense and voice and mood) or mood == "N":
            return head
        return head + (ending if mood == "P" else dash(_written(p, "pn")))
    if pos in (3, 4, 10, 16):
        return {3: "N", 4: "A", 10: "T", 16: "D"}[pos] + ending + flags
    if pos in (15, 17, 7):
        return {15: "R", 17: "C", 7: "PN"}[pos] + ending
    if pos == 18:
        if not p["person"]:
            raise TagError("Incomplete")
        return "F" + dash(_written(p, "pcnG"))
    if pos == 14:
        return "S" + dash(_written(p, "prcnG"))
    if pos == 13:
        return "P" + (dash(_written(p, "pcr")) if p["person"] in (1, 2) else ending) + flags
    if pos == 12:
        letter = "Q" if p["correlative"] and p["interrogative"] else "K" if p["correlative"] else "I" if p["interrogative"] else "X" if p["indefinite"] else "O"
        return letter + ending
    if pos in (24, 26, 27, 29):
        return {24: "A", 26: "N", 27: "A", 29: "N"}[pos] + ending + ("-S" if pos in (24, 26) else "-C")
    return ""


# Part-of-speech codes of the two positional notations that name inflection classes, and genders they imply.
_CLASSES = {"RA": 10, "RD": 16, "RI": 12, "RP": 14, "RR": 15, "RX": 15, "C": 6, "X": 1, "I": 11, "M": 23, "P": 8, "D": 5, "N": 3, "A": 4}
_CCAT_NOUNS = {"N1": 2, "N1A": 2, "N1S": 2, "N1M": 1, "N1T": 1, "N2": 1, "N2N": 4} | {"N3" + x: 0 for x in ("", *"DEGHIKMNPRSTUVWX")}
_CCAT_ADJECTIVES = {"A1", "A1A", "A1B", "A1C", "A1S", "A1P", "A3", "A3P", "A3E", "A3H", "A3N", "A3U", "A3C"}
_VERBS = {"V" + x for x in ("", *"123456789ABZCDVSQXMPTKFEHO")}
_GNT_NOUNS = {"N1": 2, "N2": 1, "N3": 0}
_GNT_TENSES = {"P": 1, "F": 2, "A": 3, "I": 4, "E": 5, "X": 5, "L": 6, "Y": 6}
_NONE = " -."


def _slot(letter: str, table: dict[str, int], error: str, none: str = _NONE) -> int:
    if letter in none:
        return 0
    if letter not in table:
        raise TagError(error)
    return table[letter]


def _class(tag: str, nouns: dict[str, int], adjectives: set[str]) -> tuple[dict[str, int], str, str]:
    """(values, class, what follows) of a tag that starts with an inflection class."""
    body = tag.lstrip(" -")
    if not body:
        raise TagError("Incomplete")
    name = regex.match(r"[^ \-+]*", body).group()
    rest = body[len(name) :]
    if name in nouns:
        return {"pos": 3, "gender": nouns[name]}, name, rest
    if name in adjectives:
        return {"pos": 4}, name, rest
    if name in _VERBS:
        return {"pos": 2}, name, rest
    if name in _CLASSES:
        return {"pos": _CLASSES[name]} | ({"indefinite": 1} if name == "RX" else {}), name, rest
    raise TagError("UnknownPartOfSpeech")


def _ccat_ending(text: str, values: dict[str, int]) -> None:
    """Case, number, gender; the case may be missing, a blank number is the plural."""
    if text and text[0] not in "SP12":
        values["case"] = _slot(text[0], CASES, "UnknownCase", " -")
        text = text[1:]
    if text:
        values["number"] = _slot(text[0], {"S": 1, "1": 1, "P": 3, "2": 3, " ": 3, "-": 3}, "UnknownNumber", "")
    if text[1:]:
        values["gender"] = _slot(text[1], GENDERS, "UnknownGender", " -")


def parse_ccat(tag: str) -> int:
    """'VF  FMI3S' to the packed record."""
    body = tag.lstrip(" -")
    name = regex.match(r"[^ \-+]*", body).group()
    if name[:1] == "V" and len(name) > 2:
        body = name[:2] + body[len(name) :]
    values, name, rest = _class(body, _CCAT_NOUNS, _CCAT_ADJECTIVES)
    if rest.startswith("+"):
        return pack(**values)
    rest = rest.lstrip(" -")
    if values["pos"] in (3, 4, 10, 12, 14, 15, 16):
        _ccat_ending(rest, values)
    elif values["pos"] == 2 and rest:
        values["tense"] = _slot(rest[0], _GNT_TENSES, "UnknownTenseForm", "")
        if rest[1:]:
            values["voice"] = _slot(rest[1], VOICES, "UnknownVoice", "")
        if rest[2:]:
            values["mood"] = _slot(rest[2], MOODS | {"D": 4}, "UnknownMood", "")
        if values.get("mood") == 6 and len(rest) > 5:
            _ccat_ending(rest[3:], values)
        if rest[3:]:
            values["person"] = {"1": 1, "2": 2, "3": 3}.get(rest[3], 0)
        if rest[4:]:
            values["number"] = {"S": 1, "1": 1, "P": 3, "2": 3}.get(rest[4], 0)
        if values["tense"] == 3 and name in ("VB", "VZ"):
            values["tense"] = 8
    return pack(**values)


def _mood_or_degree(letter: str, values: dict[str, int]) -> None:
    pos = values["pos"]
    if letter == "I":
        values["mood" if pos == 2 else "indeclinable"] = 1
    elif letter == "S" and pos == 2:
        values["mood"] = 2
    elif letter in "SC":
        values["pos"] = _COMPARED[letter].get(pos, pos)
    elif letter in "OMNP":
        values["mood"] = MOODS[letter]
    elif letter not in _NONE + "D":
        raise TagError("UnrecognisedValue")


def parse_cntr(tag: str) -> int:
    """'V       IAA3..S' to the packed record; a short tag gives its part of speech."""
    # Parts of speech by letter.
    table = {"N": 3, "R": 12, "A": 4, "V": 2, "D": 5, "P": 8, "C": 6, "I": 11, "X": 1, "E": 10, "S": 4, "T": 1}
    if not tag:
        raise TagError("Incomplete")
    values = {"pos": _slot(tag[0], table, "UnknownPartOfSpeech", "")}
    rest = tag[1:].lstrip(" \t")
    if len(rest) >= 7:
        _mood_or_degree(rest[0], values)
        values["tense"] = _slot(rest[1], {"P": 1, "F": 2, "A": 3, "I": 4, "E": 5, "L": 6, "U": 0}, "UnknownTenseForm")
        values["voice"] = _slot(rest[2], {"A": 1, "M": 2, "P": 3}, "UnknownVoice")
        values["person"] = _slot(rest[3], {"1": 1, "2": 2, "3": 3}, "UnknownPerson")
        values["case"] = _slot(rest[4], CASES, "UnknownCase")
        values["gender"] = _slot(rest[5], GENDERS, "UnknownGender")
        values["number"] = _slot(rest[6], {"S": 1, "P": 3, "A": 0}, "UnknownNumber")
    return pack(**values)


def parse_morphgnt(tag: str) -> int:
    """'V- 1AAI-S--' to the packed record; a short tag gives its part of speech."""
    values, _, rest = _class(tag, _GNT_NOUNS, {"A1", "A3"})
    rest = (rest[1:] if rest.startswith("-") else rest).lstrip(" ")
    if len(rest) >= 8:
        values["person"] = _slot(rest[0], {"1": 1, "2": 2, "3": 3}, "UnknownPerson")
        values["tense"] = _slot(rest[1], _GNT_TENSES | {"U": 0}, "UnknownTenseForm")
        values["voice"] = _slot(rest[2], {"A": 1, "M": 2, "P": 3}, "UnknownVoice")
        _mood_or_degree(rest[3], values)
        values["case"] = _slot(rest[4], CASES, "UnknownCase")
        values["number"] = _slot(rest[5], {"S": 1, "P": 3, "A": 0}, "UnknownNumber")
        values["gender"] = _slot(rest[6], GENDERS, "UnknownGender")
    return pack(**values)


READERS = {"byzantine": parse_byzantine, "ccat": parse_ccat, "cntr": parse_cntr, "morphgnt": parse_morphgnt}


@lru_cache(100_000)
def read_tag(notation: str, tag: str) -> tuple[int | None, str | None]:
    """(packed, error)."""
    try:
        return READERS[notation](tag), None
    except TagError as e:
        return None, str(e)


def parse_tag(tag: Column | str, notation: str = "byzantine") -> Column:
    """Struct (packed, error) of each tag; null for null."""

    @F.pandas_udf("packed int, error string")
    def run(tags: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else read_tag(notation, t) for t in tags]
        return pd.DataFrame({"packed": pd.array([r[0] for r in rows], dtype="Int32"), "error": [r[1] for r in rows]})

    return run(F.col(tag) if isinstance(tag, str) else tag)


@lru_cache(100_000)
def write_tag(packed: int) -> str:
    try:
        return format_byzantine(packed)
    except TagError:
        return "[incomplete]"


def format_tag(packed: Column | str) -> Column:
    """The tag of each packed record; '[incomplete]' where it can't be written."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else write_tag(int(v)))

    return run(F.col(packed) if isinstance(packed, str) else packed)


def field(packed: Column | str, name: str) -> Column:
    """One field of a packed record, without leaving the JVM."""
    packed = F.col(packed) if isinstance(packed, str) else packed
    low, bits = FIELDS[name]
    return F.shiftright(packed, low).bitwiseAND((1 << bits) - 1)


def unpacked(packed: Column | str) -> Column:
    return F.struct(*[field(packed, name).alias(name) for name in FIELDS])


def packed(**fields: Column) -> Column:
    out = F.lit(0)
    for name, value in fields.items():
        out = out.bitwiseOR(F.shiftleft(value.cast("int"), FIELDS[name][0]))
    return out


def english_label(pos: int, spaced: bool = True) -> str:
    """'Proper Noun' or 'ProperNoun'; unspaced labels keep the irregular ones of the notation."""
    name = PARTS_OF_SPEECH[pos] if 0 <= pos < len(PARTS_OF_SPEECH) else ""
    heads = ("proper", "personal", "possessive", "relative", "demonstrative", "reciprocal", "reflexive", "hebrew", "aramaic", "superlative", "comparative")
    head = next((h for h in heads if name.startswith(h) and name != h), "")
    words = [w.capitalize() for w in (head, name[len(head) :]) if w]
    if not spaced:
        # Labels that don't follow the rule.
        irregular = {14: "PosessivePronoun", 19: "HebrewTransliteration", 25: "", 28: ""}
        return irregular.get(pos, "".join(words))
    return " ".join(words)
