"""Text decoded with the wrong encoding: found and restored by deciphering it as a substitution cipher.

A swap of code pages replaces each letter by a fixed unit: one character where the right page has one byte a letter, or
several where it has more (UTF-8, double-byte pages). So every swap is a cipher of its own, and every (language, swap)
a source of its own:

1. Letter bigrams of each language are counted over all its plain texts.
2. Texts with characters outside their language's alphabet are suspects; of a wide script, which may hold garbled text
   too, also texts that hide UTF-8 (a check of the row alone; what hides it isn't counted in 1). Under each listed swap a
   suspect falls into units, and the starting key of the swap, from the public code pages, tells whether it may be at work.
3. Unit bigrams of each source are counted over all its suspects. The starting key of a listed swap keeps the units that it
   has a letter for; expectation-maximisation, which fits P(unit | letter) against the language's letter bigrams, gives
   letters to the others, and is only run where there are any (on the test tables there are none). The suspects of a
   language that no listed swap explains are an unknown source: there EM gives all letters, from frequency ranks, and the
   keys of all other pages of a byte a letter are held against its result. That is repeated while texts are left that yield
   a key (at most PEELS times), so that several unknown swaps of a language come out one by one.
4. Each suspect is translated with the learned keys only, twice if need be (text garbled twice), wholly or only where it
   is garbled, and is taken as garbled if the translation is so much likelier as text of its language. A unit that didn't
   occur while a key was learned has the letter of the starting key, as EM leaves it without evidence.

Text with U+FFFD has lost characters; it counts as garbled and is restored as far as its other characters allow.

Everything is counted over all rows. The driver gets letter bigrams of at most LETTERS letters for the ten known
languages (of Chinese and Korean at most WIDE_LETTERS single letters), and of each source (languages times swaps) at most
PAIRS bigrams of units, the most frequent ones; Spark cuts them before they are sent. Counts are shuffled,
and the words of forms once, to join their lexeme's language.

Null texts and empty ones are never garbled; equal rows are each judged alike; text in an unknown language is only
held against U+FFFD.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import key_counts, split_join
from ..session import durable, ship, spread
from .cipher import PLAIN, PUNCTUATION, Language, decipher, decipher_unknown

#: Letters of an alphabet that take part in the bigrams, the most frequent ones.
LETTERS = 256
WIDE_LETTERS = 30_000
#: Unit bigrams of a source from which its key is learned, the most frequent ones; unknown sources of a language.
PAIRS, PEELS = 10_000, 3
#: Of a language's letters, the share that makes a letter ordinary.
ORDINARY = 1e-4
#: By how much (natural log) the translation has to be likelier.
MARGIN = 1.4

# The languages' scripts as regular expression classes.
SCRIPTS = {"el": r"\p{IsGreek}", "he": r"\p{IsHebrew}", "ru": r"\p{IsCyrillic}", "uk": r"\p{IsCyrillic}", "zh": r"\p{IsHan}", "ko": r"\p{IsHangul}"}
LATIN = ("en", "es", "aaa", "de", "fr")
_LATIN_LETTERS = r"a-z\x{DF}-\x{F6}\x{F8}-\x{17F}\x{1E00}-\x{1EFF}"
_WIDE = ("zh", "ko")
#: Languages of words of lexemes and forms.
WORDS = ("el", "he", "aaa")

# Code pages by what they are used for. The right page of a text is one of its language's, the wrong one
# any of WRONG.
WRONG = ("cp1252", "latin-1", "cp1251", "cp1253", "cp437", "cp850", "mac_roman", "cp866", "koi8-r", "cp1255", "cp862", "iso8859-7", "iso8859-5", "cp1250")
RIGHT = {
    "el": ("cp1253", "cp737", "mac_greek", "cp869"),
    "he": ("cp1255", "cp862"),
    "ru": ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"),
    "uk": ("cp1251", "koi8-u", "cp1125", "iso8859-5"),
    "zh": ("gbk", "big5"),
    "ko": ("cp949",),
    "es": ("latin-1", "cp437", "mac_roman"),
    "en": ("cp1252", "cp437", "mac_roman"),
    "aaa": ("cp1257",),
    "de": ("latin-1", "cp437", "mac_roman"),
    "fr": ("latin-1", "cp437", "mac_roman"),
}
_DOUBLE = ("gbk", "big5", "cp949")
#: Wrong pages of text garbled twice, the second time.
TWICE = ("latin-1", "cp1252")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
_HAN_HANGUL = re.compile(r"[\u3400-\u9fff\uac00-\ud7a3]")


@lru_cache(None)
def page(name: str) -> tuple[dict[str, int], list[str]]:
    """Bytes from 128 of a single-byte page by character, and characters by byte; an undefined byte stands for the
    character of its number."""
    chars: list[str] = [chr(i) for i in range(128)]
    for b in range(128, 256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {c: b for b, c in enumerate(chars) if b > 127}, chars


@lru_cache(None)
def utf8_units(wrong: str) -> re.Pattern:
    """UTF-8 sequences of two to four bytes as characters of the wrong page; a C1 control may stand for its byte."""
    _, chars = page(wrong)

    def group(low: int, high: int) -> str:
        found = {c for b in range(low, high + 1) for c in (chars[b], chr(b) if b < 160 else chars[b])}
        return "[" + "".join(map(re.escape, sorted(found))) + "]"

    tail = group(0x80, 0xBF)
    return re.compile(f"{group(0xC3, 0xDF)}{tail}|{group(0xC2, 0xC2)}{tail}|{group(0xE0, 0xEF)}{tail}{{2}}|{group(0xF0, 0xF4)}{tail}{{3}}")


def _bytes(text: str, wrong: str) -> bytes | None:
    table, _ = page(wrong)
    out = bytearray()
    for c in text:
        b = ord(c) if c < "\x80" else table.get(c, ord(c) if c < "\xa0" else None)
        if b is None:
            return None
        out.append(b)
    return bytes(out)


def utf8_in_gbk(run: str) -> str | None:
    """What a run of characters was, if it is UTF-8 read as GBK (with characters lost where it has U+FFFD)."""
    try:
        return run.replace("�", "").encode("gbk").decode("utf-8", "ignore" if "�" in run else "strict")
    except UnicodeError:
        return None


def hidden_utf8(text: str) -> list[str]:
    """What the runs of text that are UTF-8 read as GBK were."""
    return [d for d in map(utf8_in_gbk, _NOT_ASCII.findall(text)) if d]


def surely_hidden(text: str) -> bool:
    """Whether such a run holds characters of three bytes, at once or read as UTF-8 again; ordinary characters may well be
    ones of two bytes by chance."""
    return any(max(d) >= "\u0800" or any(len(m) > 2 for w in TWICE for m in utf8_units(w).findall(d)) for d in hidden_utf8(text))


@dataclass(frozen=True)
class Swap:
    """Text of the page right that was decoded as the page wrong."""

    right: str
    wrong: str

    def units(self, text: str) -> list[tuple[str, bool]] | None:
        """text as (unit, whether it is a cipher's), or None where the swap can't have made it."""
        if self.right == "utf-8":
            if self.wrong == "gbk":
                return self._whole(text)
            out, at = [], 0
            for m in utf8_units(self.wrong).finditer(text):
                out += [(c, False) for c in text[at : m.start()]]
                out.append((m.group(), True))
                at = m.end()
            return out + [(c, False) for c in text[at:]] if at else None
        raw = _bytes(text, self.wrong)
        if raw is None or raw.isascii():
            return None
        if self.right in _DOUBLE:
            out, i = [], 0
            while i < len(text):
                n = 2 if raw[i] > 0x80 and i + 1 < len(raw) else 1
                out.append((text[i : i + n], raw[i] > 0x7F))
                i += n
            return out
        return [(c, b > 0x7F) for c, b in zip(text, raw)]

    def _whole(self, text: str) -> list[tuple[str, bool]] | None:
        """UTF-8 read as a double-byte page: its characters share bytes, so that a whole run is one stretch. Runs that
        can't be such stay; beside one that becomes wide, also those that don't."""
        runs = re.findall(r"[^\x00-\x7f]+|[\x00-\x7f]+", text)
        decoded = [None if run < "\x80" else utf8_in_gbk(run) for run in runs]
        wide = any(d and _HAN_HANGUL.search(d) for d in decoded)
        out: list[tuple[str, bool]] = []
        for run, d in zip(runs, decoded):
            if d is None or wide and not _HAN_HANGUL.search(d):
                out += [(c, False) for c in run]
            else:
                out += [("\ue000" + c, True) for c in d]
        return out if any(k for _, k in out) else None

    def start(self, unit: str) -> str | None:
        """The letter of the starting key."""
        if unit[0] == "\ue000":
            return unit[1]
        raw = _bytes(unit, self.wrong)
        try:
            return raw.decode(self.right) if raw else None
        except UnicodeError:
            return chr(raw[0]) if len(raw) == 1 and raw[0] < 160 else None


@lru_cache(None)
def swaps(lang: str) -> tuple[Swap, ...]:
    utf8 = [Swap("utf-8", w) for w in (*WRONG, "gbk")]
    return tuple(utf8 + [Swap(r, w) for r in RIGHT.get(lang, ()) for w in WRONG if r != w and page_differs(r, w)])


def page_differs(a: str, b: str) -> bool:
    return codecs.lookup(a).name != codecs.lookup(b).name


def _training(lang: Column, text: Column) -> Column:
    """Whether a text is plain: only letters of its language's script (capitals first in a word for Latin), ASCII and
    common punctuation."""
    plain = r"\x20-\x7e" + PUNCTUATION
    latin = rf"^(?:(?<!\p{{L}})[A-Z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{DE}}]|[{plain}{_LATIN_LETTERS}])*+\z"
    out = F.when(lang.isin(*LATIN), F.regexp_like(text, F.lit(latin)))
    for code, script in SCRIPTS.items():
        out = out.when(lang == code, F.regexp_like(text, F.lit(rf"^[{plain}{script}]*+\z")) & F.regexp_like(text, F.lit(script)))
    return F.coalesce(out, F.lit(False))


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of code points (0 at the edges of words) of each language."""
    for batch in batches:
        column = pc.dictionary_encode(batch.column("lang"))
        texts = {lang: batch.column("text").filter(pc.equal(column.indices, i)).to_pylist() for i, lang in enumerate(column.dictionary.to_pylist())}
        # In a wide script, garbled text may have letters of the script only.
        texts = {lang: [t for t in own if not surely_hidden(t)] if lang in _WIDE else own for lang, own in texts.items()}
        langs, pairs, counts = [], [], []
        for lang, own in texts.items():
            points = np.frombuffer((" " + " ".join(own) + " ").lower().encode("utf-32-le"), np.uint32).astype(np.int64)
            letter = np.ones(0x110000, bool)
            letter[:128] = False
            letter[ord("a") : ord("z") + 1] = lang in LATIN
            letter[[ord(c) for c in PUNCTUATION]] = False
            points = np.where(letter[points], points, 0)
            pair = points[:-1] << 21 | points[1:]
            if lang in _WIDE:
                pair = points[points > 0]
            values, n = np.unique(pair[pair > 0], return_counts=True)
            langs += [lang] * len(values)
            pairs.append(values)
            counts.append(n)
        if langs:
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(np.concatenate(pairs)), pa.array(np.concatenate(counts))], ["lang", "pair", "n"])


def learn_languages(texts: DataFrame) -> dict[str, Language]:
    """texts (lang, text) to the languages' bigrams."""
    known = [*SCRIPTS, *LATIN]
    plain = texts.filter(F.col("lang").isin(known) & _training(F.col("lang"), F.col("text"))).select("lang", "text")
    counts = plain.mapInArrow(_count_letters, "lang string, pair long, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n"))
    # The most frequent pairs (of wide scripts, letters): more than alphabets have.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "pair"))
    rows = counts.withColumn("_r", rank).filter(F.col("_r") <= F.when(F.col("lang").isin(*_WIDE), WIDE_LETTERS).otherwise(LETTERS * LETTERS)).collect()
    singles: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    by_lang: dict[str, list] = defaultdict(list)
    for r in rows:
        if r.lang in _WIDE:
            singles[r.lang][chr(r.pair)] += r.n
            continue
        a, b = r.pair >> 21, r.pair & 0x1FFFFF
        by_lang[r.lang].append((chr(a) if a else "", chr(b) if b else "", r.n))
        if b:
            singles[r.lang][chr(b)] += r.n
    out = {}
    for lang, single in sorted(singles.items()):
        total = sum(single.values())
        least = total * ORDINARY / (20 if lang in _WIDE else 4)
        letters = sorted((c for c in single if single[c] >= least), key=lambda c: (-single[c], c))
        letters = letters if lang in _WIDE else letters[:LETTERS]
        index = {c: i + 1 for i, c in enumerate(letters)}
        k = len(letters) + 1
        if lang in _WIDE:  # single letters only; the same for every predecessor
            p = np.array([total / 3, *[single[c] for c in letters]]) / (total * 4 / 3)
            out[lang] = Language(letters, np.log(p)[None, :])
            continue
        table = np.zeros((k, k))
        for a, b, n in by_lang[lang]:
            i, j = (index.get(c) if c else 0 for c in (a, b))
            if i is not None and j is not None:
                table[i, j] += n
        share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * k)
        rows_sum = table.sum(1, keepdims=True)
        p = (table + 2.0 * share) / (rows_sum + 2.0)
        out[lang] = Language(letters, np.log(p), p * share[:, None])
    return out


def suspects(texts: DataFrame, languages: dict[str, Language], own: tuple[dict[str, Language], DataFrame] | None = None) -> DataFrame:
    """Texts with a character that isn't ordinary in their language, U+FFFD, or a capital inside a word; sure is false for
    texts in a wide script only, which are suspect only if they hide UTF-8. There, any letter of the script is ordinary,
    so that the verdict doesn't depend on how many texts there are."""
    rest = None
    for lang, model in languages.items():
        left = F.regexp_like("text", F.lit(rf"[^\x20-\x7e{PUNCTUATION}{SCRIPTS[lang]}]")) if lang in _WIDE else _outside(model)
        rest = F.when(F.col("lang") == lang, left) if rest is None else rest.when(F.col("lang") == lang, left)
    odd = F.coalesce(rest, F.lit(False)) if rest is not None else F.lit(False)
    sure = odd | F.contains("text", F.lit("�")) | F.regexp_like("text", F.lit(r"\p{L}\p{Lu}"))
    found = texts.filter(F.col("text").isNotNull() & F.regexp_like("text", F.lit(r"[^\x00-\x7f]"))).withColumn("sure", sure)
    if own is not None:  # also with letters foreign to the lexeme's language
        words, heads = own
        foreign = F.array(*[F.when(_outside(model), lang) for lang, model in words.items()])
        langs = heads.filter(F.col("lang").isin(*words)).groupBy("lexeme_no").agg(F.min("lang").alias("_lang"))
        joined = split_join(found.withColumn("_foreign", foreign), langs, "lexeme_no", ["form_no", "text"], "left", key_counts(texts.select("lexeme_no"), "lexeme_no"))
        other = F.coalesce(F.array_contains("_foreign", F.col("_lang")), F.lit(False))
        joined = joined.filter(F.col("sure") | other).withColumn("lang", F.when(F.col("sure"), F.col("lang")).otherwise(F.col("_lang"))).withColumn("home", F.col("_lang"))
        return joined.withColumn("sure", F.lit(True)).select(*found.columns, "home")
    return found.withColumn("home", F.when(F.col("lang") != "*", F.col("lang"))).filter(F.col("sure") | (F.coalesce("lang", F.lit("")).isin(*_WIDE) & F.regexp_like("text", F.lit(r"\p{IsHan}"))))


def _outside(model: Language) -> Column:
    """Whether text has a character that is none of the language's letters, their capitals and plain signs."""
    own = "".join(model.letters)
    own += "".join(c.upper() for c in own if len(c.upper()) == 1 and c.upper() != c)
    return F.translate(F.col("text"), "".join(chr(i) for i in range(32, 127)) + PUNCTUATION + own, "") != ""


#: Keys by language, right and wrong page; the pages of an unknown source are UNKNOWN and its number.
Keys = dict[tuple[str, str, str], dict[str, str]]
UNKNOWN = "unknown"


class Cipher:
    """A swap with its key: the letters learned, else those of the starting key."""

    def __init__(self, swap: Swap, key: dict[str, str]):
        self.swap, self.key = swap, key
        self.known: dict[str, str | None] = {}
        self.table: dict[int, str] | None = None
        self.chars: frozenset[str] = frozenset()
        if swap.right == UNKNOWN:
            self.table = {ord(c): x for c, x in key.items()}
            self.chars = frozenset(key) | frozenset(map(chr, range(128))) | frozenset(PUNCTUATION)
        elif swap.right not in _DOUBLE and swap.right != "utf-8":
            high = {c for c in page(swap.wrong)[0]} | {chr(b) for b in range(128, 160)}
            letters = {c: self.letter(c) for c in high}
            self.table = {ord(c): x for c, x in letters.items() if x is not None}
            self.chars = frozenset(chr(i) for i in self.table) | frozenset(map(chr, range(128)))
        elif swap.wrong != "gbk":
            self.chars = frozenset(page(swap.wrong)[0]) | frozenset(map(chr, range(160)))

    def letter(self, unit: str) -> str | None:
        if unit not in self.known:
            self.known[unit] = self.key.get(unit) or self.swap.start(unit)
        return self.known[unit]

    def translate(self, text: str, chars: frozenset[str]) -> tuple[str, str] | None:
        """text with the swap's units replaced, and what has to be letters of the language in it: all of a text that
        was of one or two bytes a letter, else what was garbled. None where the swap can't have made text."""
        if self.table is not None:
            plain = text.translate(self.table) if chars <= self.chars else text
            return (plain, plain) if plain != text else None
        if self.swap.right == "utf-8" and self.swap.wrong != "gbk":
            made: list[str] = []

            def one(m: re.Match) -> str:
                letter = self.letter(m.group())
                made.append(letter or "\x00")
                return letter or m.group()

            plain = utf8_units(self.swap.wrong).sub(one, text)
            return (plain, "".join(made)) if made else None
        if self.swap.right in _DOUBLE and not chars <= self.chars:
            return None
        units = self.swap.units(text)
        if units is None:
            return None
        letters = [self.letter(u) if cipher else u for u, cipher in units]
        if None in letters:
            return None
        plain = "".join(letters)
        return (plain, plain.replace("�", "")) if plain != text else None


class Reader:
    """Judges texts by the languages and the keys of all sources; without keys, by the starting keys of all swaps."""

    def __init__(self, languages: dict[str, Language], keys: Keys | None = None):
        self.languages = languages
        if keys is None:
            keys = {(lang, s.right, s.wrong): {} for lang in languages for s in swaps(lang)}
        self.ciphers: dict[str, list[Cipher]] = {lang: [] for lang in languages}
        for (lang, right, wrong), key in keys.items():
            self.ciphers[lang].append(Cipher(Swap(right, wrong), key))
        self.again = {lang: [c for c in own if c.swap.right == "utf-8" and c.swap.wrong in TWICE] for lang, own in self.ciphers.items()}

    def translations(self, text: str, lang: str) -> Iterator[tuple[tuple[Swap, ...], str, str]]:
        """What the swaps, and UTF-8 swaps one after another, make of text."""
        chars = frozenset(text)
        for cipher in self.ciphers[lang]:
            first = cipher.translate(text, chars)
            if first is None:
                continue
            yield (cipher.swap,), *first
            if cipher.swap.right == "utf-8" and not first[0].isascii():
                inner = frozenset(first[0])
                for second in self.again[lang]:
                    twice = second.translate(first[0], inner)
                    if twice is not None:
                        yield (cipher.swap, second.swap), *twice

    def judge(self, text: str, langs: tuple[str, ...]) -> tuple[float, str, str, tuple[Swap, ...]] | None:
        """(gain, lang, plain text, swaps) of the likeliest translation, None if there is none."""
        models = [(k, self.languages[k]) for k in langs if k in self.languages]
        if not models:
            return None
        stored = max(m.score(text) for _, m in models)
        best = None
        for lang, model in models:
            seen = set()
            for path, plain, made in self.translations(text, lang):
                if (plain, len(path)) in seen or not model.knows(made) or path[0].right != "utf-8" and not model.gains_letters(text, plain):
                    continue
                seen.add((plain, len(path)))
                gain = model.score(plain) - stored - 1.5 * len(path) - (0.5 if path[0].right != "utf-8" else 0)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, lang, plain, path)
        return best


def _langs(lang: str | None) -> tuple[str, ...]:
    return WORDS if lang == "*" else (lang,) if lang else ()


def likely_enciphered(text: str, lang: str, model: Language) -> bool:
    """Whether a text may be a cipher of its language as a whole: it has letters or signs beyond ASCII, but, unless the
    language is Latin, none of the language's own letters, and it isn't ordinary text in compatibility characters. In a
    Latin language only what is beyond ASCII is of the cipher."""
    if model.wide or lang == "aaa" or text.isascii() or "�" in text or model.knows(unicodedata.normalize("NFKC", text)):
        return False
    return model.latin or not any(c in model.index for c in text.lower())


def _first_look(shared):
    """Adds the source, that is language and swaps (right and wrong page each) of the likeliest translation by the starting
    keys, else the language alone if the text may be an unknown cipher of it; without the texts that hide no UTF-8 and
    aren't suspect otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        # UTF-8 read in any other page of a byte a letter, for texts that the listed swaps don't explain, or not wholly.
        others = Reader(shared.value, {(lang, "utf-8", w): {} for lang in shared.value for w in all_pages() if not any(tuple(page(w)[1]) == tuple(page(x)[1]) for x in WRONG)})

        def source(text: str, lang: str | None, home: str | None) -> list[str] | None:
            found = reader.judge(text, _langs(lang))
            if found is None or found[0] < MARGIN or not reader.languages[found[1]].knows(found[2]):
                found = max((x for x in (found, others.judge(text, _langs(lang))) if x is not None), key=lambda x: x[0], default=None)
            if found is not None and found[0] >= MARGIN:
                return [found[1], *(p for swap in found[3] for p in (swap.right, swap.wrong))]
            model = reader.languages.get(home or "")
            return [home] if model is not None and likely_enciphered(text, home, model) else None

        for batch in batches:
            kept = [sure or bool(hidden_utf8(text)) for sure, text in zip(batch.column("sure").to_pylist(), batch.column("text").to_pylist())]
            batch = batch.filter(pa.array(kept, pa.bool_()))
            sources = [source(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "home")))]
            batch = batch.drop_columns(["sure", "home"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sources, pa.list_(pa.string()))], [*batch.schema.names, "source"])

    return run


_UNITS = "lang string, right string, wrong string, a string, b string, n long"


def _batch_of(counts: dict[tuple, int]) -> pa.RecordBatch:
    cols = list(zip(*counts))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(list(counts.values()), pa.int64())], ["lang", "right", "wrong", "a", "b", "n"])


def _add_units(counts: dict[tuple, int], source: tuple[str, str, str], units: list[tuple[str, bool]]) -> None:
    last = ""
    for unit, cipher in [*units, ("", True)]:
        # Letters that the swap leaves alone are the context of the others.
        unit = unit if cipher else PLAIN + unit.lower() if unit.isalpha() else ""
        if last or unit:
            counts[*source, last, unit] += 1
        last = unit


#: Bigrams that a task holds before it passes them on.
_HELD = 200_000


def _unknown_units(text: str, model: Language) -> list[tuple[str, bool]]:
    """Characters as units of an unknown cipher: all beyond ASCII but punctuation; ASCII letters only are context in Latin
    languages, else signs."""
    return [(c, True) if c > "\x7f" and c not in PUNCTUATION else (c if model.latin else " ", False) for c in text]


def _count_units(shared):
    """Unit bigrams of the sources (of wide scripts, which have no bigrams to learn from, only that a source is at work), and
    those of the texts that may be ciphers of their language but aren't read by the unknown keys learned so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, unknown = shared.value
        reader = Reader(languages, unknown)
        starts: dict[tuple[str, str, str], Cipher] = {}
        counts: dict[tuple, int] = defaultdict(int)
        for batch in batches:
            for (lang, *path), text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist()):
                if not path:
                    read = reader.judge(text, (lang,)) if unknown else None
                    if read is None or read[0] < MARGIN:
                        _add_units(counts, (lang, UNKNOWN, ""), _unknown_units(text, languages[lang]))
                for right, wrong in zip(path[::2], path[1::2]):
                    key = (lang, right, wrong)
                    if lang in _WIDE:
                        counts[*key, "", ""] += 1
                    else:
                        _add_units(counts, key, Swap(right, wrong).units(text) or [])
                    if len(path) > 2:  # garbled twice: the second swap's units are in the first one's translation
                        if key not in starts:
                            starts[key] = Cipher(Swap(right, wrong), {})
                        text = (starts[key].translate(text, frozenset(text)) or (text,))[0]
            if len(counts) > _HELD:
                yield _batch_of(counts)
                counts.clear()
        if counts:
            yield _batch_of(counts)

    return run


def _collect_units(counted: DataFrame) -> dict[tuple[str, str, str], list[tuple[str, str, int]]]:
    """The most frequent bigrams of each source."""
    at = ["lang", "right", "wrong"]
    summed = counted.groupBy(*at, "a", "b").agg(F.sum("n").alias("n"))
    ranked = summed.withColumn("_r", F.row_number().over(Window.partitionBy(*at).orderBy(F.desc("n"), "a", "b")))
    sources: dict[tuple[str, str, str], list] = defaultdict(list)
    for r in ranked.filter(F.col("_r") <= PAIRS).collect():
        sources[r.lang, r.right, r.wrong].append((r.a, r.b, r.n))
    return dict(sorted(sources.items()))


def learn_keys(suspect: DataFrame, languages: dict[str, Language]) -> Keys:
    """The keys of all sources among the suspects (text, source), with those of unknown ones."""
    left = suspect.filter("source is not null").select("source", "text")
    keys: Keys = {}
    unknown: Keys = {}
    for peel in range(PEELS):
        counted = _collect_units(left.mapInArrow(_count_units(ship(suspect.sparkSession, (languages, unknown))), _UNITS))
        found: Keys = {}
        for (lang, right, wrong), pairs in counted.items():
            if right != UNKNOWN:
                keys[lang, right, wrong] = {} if lang in _WIDE else decipher(sorted(pairs), Swap(right, wrong), languages[lang])
            elif key := decipher_unknown(sorted(pairs), languages[lang], page_keys(lang)):
                found[lang, UNKNOWN, str(peel)] = key
        if not found:
            break
        unknown |= found
        left = left.filter(F.size("source") == 1)
    return keys | unknown


@lru_cache(1)
def all_pages() -> tuple[str, ...]:
    """The single-byte code pages that Python knows and that hold ASCII, as candidates for the pages of an unknown source."""
    import encodings
    import importlib
    import pkgutil

    out = {tuple(page("latin-1")[1]): "latin-1"}
    for name in sorted(m.name for m in pkgutil.iter_modules(encodings.__path__) if m.name not in ("mbcs", "oem")):
        table = getattr(importlib.import_module(f"encodings.{name}"), "decoding_table", None)
        if isinstance(table, str) and table[32:127] == bytes(range(32, 127)).decode():
            out.setdefault(tuple(page(name)[1]), name)
    return tuple(sorted(out.values()))


@lru_cache(16)
def page_keys(lang: str) -> list[dict[str, str]]:
    """Keys of all pairs of single-byte pages of which the right one has the language's letters."""
    script = {"el": "α", "he": "א", "ru": "б", "uk": "є"}.get(lang, "ñ" if lang == "es" else "é")
    right = [p for p in all_pages() if script in page(p)[0]]
    return [{chars: plain for chars, plain in zip(page(w)[1][128:], page(r)[1][128:]) if chars > "\x7f"} for r in right for w in all_pages() if r != w]


def _judge_all(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in batches:
            restored, swap, gain = [], [], []
            for lang, text, source in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "source"))):
                best = None if source is None else reader.judge(text, _langs(lang))
                good = best is not None and best[0] >= MARGIN
                restored.append(best[2] if good else None)
                swap.append(" ".join(f"{s.right}>{s.wrong}" for s in best[3]) if good else None)
                gain.append(best[0] if best is not None else -math.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(restored, pa.string()), pa.array(swap, pa.string()), pa.array(gain, pa.float64())], [*batch.schema.names, "restored", "swap", "gain"])

    return run


def judged(texts: DataFrame) -> DataFrame:
    """texts (keys..., lang, text) to those under suspicion, with restored, swap and gain; garbled tells the verdict.

    lang is a code of the project, or '*' for a word in Greek, Hebrew or Aramaic.
    """
    return judged_with(texts, learn_languages(_by_script(texts)))


def _by_script(texts: DataFrame) -> DataFrame:
    return texts.withColumn("lang", F.when(F.col("lang") == "*", F.when(F.regexp_like("text", F.lit(r"\p{IsGreek}")), "el").when(F.regexp_like("text", F.lit(r"\p{IsHebrew}")), "he")).otherwise(F.col("lang")))


def judged_with(texts: DataFrame, languages: dict[str, Language], all_suspects: bool = False, heads: DataFrame | None = None) -> DataFrame:
    """As judged, by languages learned elsewhere; with all_suspects, every text is judged and returned.

    With heads (lexeme_no, lang), words of '*' are also suspect if their lexeme's language hasn't their letters, and
    then judged as words of that language.
    """
    starred = texts.filter("lang = '*'")
    named = texts.filter("lang is null or lang != '*'")
    words = {k: languages[k] for k in WORDS if k in languages}
    found = suspects(named, languages)
    if all_suspects:
        found = texts.withColumn("sure", F.lit(True)).withColumn("home", F.lit(None).cast("string"))
    elif words:
        every = sorted({c for m in words.values() for c in m.letters})
        found = found.unionByName(suspects(starred, {"*": Language(every, np.zeros((1, 1)))}, None if heads is None else (words, heads)))
    looked = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.drop("sure", "home").schema.fields) + ", source array<string>"
    suspect = durable(found.mapInArrow(_first_look(ship(texts.sparkSession, languages)), looked))
    keys = learn_keys(suspect, languages)
    shared = ship(texts.sparkSession, (languages, keys))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suspect.schema.fields)
    out = suspect.mapInArrow(_judge_all(shared), schema + ", restored string, swap string, gain double")
    return out.drop("source").withColumn("garbled", F.col("restored").isNotNull() | F.contains("text", F.lit("�")))


def dictionary_texts(lexemes: DataFrame, forms: DataFrame) -> DataFrame:
    """(field, lexeme_no, form_no, lang, text): words of lexemes and forms, and their gloss entries."""

    def entries(df: DataFrame, name: str, no: Column) -> DataFrame:
        gloss = df.select(F.lit(name).alias("field"), "lexeme_no", no.alias("form_no"), F.explode("glosses").alias("g"))
        return gloss.select("field", "lexeme_no", "form_no", F.col("g.lang").alias("lang"), F.explode("g.entries").alias("text"))

    zero = F.lit(0)
    words = forms.select(F.lit("form_word").alias("field"), "lexeme_no", "form_no", F.lit("*").alias("lang"), F.col("word").alias("text"))
    heads = lexemes.select(F.lit("lexeme_word").alias("field"), "lexeme_no", zero.alias("form_no"), "lang", F.col("word").alias("text"))
    both = words.unionByName(heads).unionByName(entries(forms, "form_gloss", F.col("form_no"))).unionByName(entries(lexemes, "lexeme_gloss", zero))
    return both.filter("text is not null and text != ''")


def garbled_texts(lexemes: DataFrame, forms: DataFrame) -> DataFrame:
    """(field, lexeme_no, form_no, lang, text, restored, swap) of the garbled words of forms and gloss entries."""
    texts = dictionary_texts(spread(lexemes.select("lexeme_no", "lang", "word", "glosses")), spread(forms.select("lexeme_no", "form_no", "word", "glosses")))
    found = judged_with(texts, learn_languages(_by_script(texts)), heads=lexemes)
    return found.filter("garbled and field != 'lexeme_word'").drop("garbled", "gain")


def garbled_records(lexemes: DataFrame, forms: DataFrame) -> DataFrame:
    """(field, lexeme_no, form_no): one row for each record and field with garbled text."""
    return garbled_texts(lexemes, forms).select("field", "lexeme_no", "form_no").distinct()
