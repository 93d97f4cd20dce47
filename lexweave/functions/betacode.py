"""Betacode (ASCII) to Greek.

Words of plain letters, by far the most, are translated in the JVM; only words with accents, signs or errors go through
an Arrow UDF that composes each letter with its accents.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of both variants, and what each variant adds.
LETTERS = dict(zip("abdefghiklmnopqrstuwxyz", "αβδεφγηικλμνοπθρστυωχψζ"))
LETTERS |= {a.upper(): b.upper() for a, b in LETTERS.items()}
EXTRA = {"default": dict(zip("vVjJcC", "σΣςΣχχ")), "tlg": dict(zip("vVcC", "ϝϜξΞ"))}
MARKS = {"/": "́", "\\": "̀", "(": "̔", ")": "̓", "|": "ͅ", "+": "̈", "=": "͂", "^": "͂"}
SIGMAS = {"1": "σ", "2": "ς", "3": "ϲ"}
# Combinations of marks that are read at all (each may also stand with iota where listed), and letters
# that come out otherwise than composed.
_MARK_SETS = [
    frozenset(MARKS[c] for c in s)
    for s in (") ( / \\ = | + )/ (/ )\\ (\\ )= (= /| \\| =| )| (| )/| (/| )\\| (\\| )=| (=| +/ +\\ +=").split()
]
_IRREGULAR = {
    ("Υ", ")"): "ὐ", ("ε", ")\\"): "ἔ", ("Ω", ")\\"): "Ὤ", ("Ε", "(\\"): "Ἒ", ("Ι", "+\\"): "ῒ", ("Υ", "+\\"): "ῢ", ("ι", "+/"): "ΐ", ("Ι", "+/"): "ΐ",
    ("Υ", "+/"): "ΰ", ("Υ", ")="): "ὖ", ("η", "(\\|"): "ᾕ", ("ω", "(\\|"): "ᾥ", ("Η", "(\\|"): "ᾝ", ("Ω", "(\\|"): "ᾭ",
}
_IRREGULAR = {(a, frozenset(MARKS[c] for c in s)): b for (a, s), b in _IRREGULAR.items()}
_ORDER = "̓̔̈̀́͂ͅ"
_SPACE = " \t\r\n\v\f"


class BetacodeError(ValueError):
    """UnexpectedCharacter, UnexpectedAccent or Overflow."""


def _letter(letter: str, marks: set[str]) -> str:
    signs = {m for m in marks if m in SIGMAS}
    if signs:
        if len(marks) > 1 or letter not in "σΣς":
            raise BetacodeError("UnexpectedAccent")
        return "Σ" if letter == "Σ" and signs != {"3"} else {"Σ3": "Ϲ"}.get(letter + min(signs), SIGMAS[min(signs)])
    wanted = frozenset(marks)
    if (letter, wanted) in _IRREGULAR:
        return _IRREGULAR[letter, wanted]
    composed = unicodedata.normalize("NFC", letter + "".join(sorted(marks, key=_ORDER.index)))
    if wanted not in _MARK_SETS or len(composed) > 1 or composed == "ῤ":
        raise BetacodeError("UnexpectedAccent")
    return composed


def betacode_to_greek(text: str, variant: str = "default") -> str:
    letters = LETTERS | EXTRA[variant]
    word = text.lstrip(_SPACE)
    out: list[str] = []
    held, marks, capital, at = "", set(), False, 0
    while at < len(word):
        c = word[at]
        at += 1
        if c == "\0" or c in _SPACE:
            break
        if ord(c) > 127 or c == "*" and variant != "tlg":
            raise BetacodeError("UnexpectedCharacter")
        if c == "*":
            capital = True
            continue
        if variant == "tlg" and c.isalpha():
            c, capital = (c.upper(), False) if capital else (c.lower(), capital)
        if c in letters:
            if held:
                out.append(_letter(held, marks) if marks else held)
                marks = set()
            held = letters[c]
        elif c in MARKS:
            marks.add(MARKS[c])
        elif c in SIGMAS:
            marks.add(c)
        else:
            at -= 1
            break
    if held:
        out.append(_letter(held, marks) if marks else "ς" if held == "σ" else held)
    rest = word[at:]
    if rest.startswith("'"):
        out.append("᾽")
        rest = rest[1:]
    if rest.strip(_SPACE):
        raise BetacodeError("UnexpectedCharacter")
    greek = "".join(out)
    if len(greek.encode()) > 500:
        raise BetacodeError("Overflow")
    return greek


@lru_cache(100_000)
def _read(text: str, variant: str) -> tuple[str | None, str | None]:
    try:
        return betacode_to_greek(text, variant), None
    except BetacodeError as e:
        return None, str(e)


def plain_to_greek(text: Column, variant: str = "default") -> Column:
    """Words of letters only: translate, and final sigma."""
    letters = LETTERS | EXTRA[variant]
    source = F.lower(text) if variant == "tlg" else text
    return F.regexp_replace(F.translate(source, "".join(letters), "".join(letters.values())), "σ\\z", "ς")


def to_greek(text: Column | str, variant: str = "default") -> Column:
    """Struct (greek, error); null for null."""
    text = F.col(text) if isinstance(text, str) else text

    @F.pandas_udf("greek string, error string")
    def run(words: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if w is None else _read(w, variant) for w in words]
        return pd.DataFrame(rows, columns=["greek", "error"])

    pattern = "^[" + re.escape("".join(sorted(LETTERS | EXTRA[variant]))) + "]{0,200}\\z"
    plain = F.regexp_like(text, F.lit(pattern))
    hard = run(F.when(~plain, text))
    return F.when(plain, F.struct(plain_to_greek(text, variant).alias("greek"), F.lit(None).cast("string").alias("error"))).otherwise(hard)
