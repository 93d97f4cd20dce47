"""Scripture references: modules, books, and references as text.

The dimension tables are small and fixed; they are literal maps in expressions and small DataFrames for joins.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon_fields as fields

# Modules in the order of their codes (code: name: aliases).
_MODULES = """
unknown: Unknown: unknown unk un
byz: Byzantine GNT: byz byzantine
nestle: Nestle 1904: nestle nest nestle_1904 nestle1904
sbl: SBL GNT: sbl sbl_gnt sblgnt
sr: Statistical Restoration GNT: sr sr_gnt srgnt
kjtr: King James Textus Receptus: kjtr kjvtr
ccat: CCAT: ccat
berean: Berean GNT: berean ber ber_gnt bergnt berean_gnt bereangnt
brenton: Brenton LXX: bren brent brenton brentons brenton_lxx brentons_lxx
"""
# Books in the order of their codes (name; short name; names under which they are read).
_BOOKS = """
Unknown; Unkn; unknown, unk, un
Genesis; Gen; genesis, gen, gn
Exodus; Ex; exodus, exo, ex
Leviticus; Lev; leviticus, lev, le, lv
Numbers; Num; numbers, num, nu, nm, nb
Deuteronomy; Deut; deuteronomy, deut, dt, de
Joshua; Josh; joshua, josh, jos, jsh, jo
Judges; Judg; judges, judg, jdg, jg
Ruth; Ruth; ruth, rth, ru
1 Samuel; 1Sam; 1 samuel, 1samuel, 1sam, 1sm, 1sa
2 Samuel; 1Sam; 2 samuel, 2samuel, 2sam, 2sm, 2sa
1 Kings; 1Ki; 1 kings, 1kings, 1king, 1ki, 1kin, 1kgs
2 Kings; 2Ki; 2 kings, 2kings, 2king, 2ki, 2kin, 2kgs
1 Chronicles; 1Chr; 1 chronicles, 1chronicles, 1ch, 1chr, 1chron
2 Chronicles; 2Chr; 2 chronicles, 2chronicles, 2ch, 2chr, 2chron
Ezra; Ezra; ezra, ezr, ez
Nehemiah; Neh; nehemiah, neh, ne
Esther; Est; esther, esth, est, es
Job; Job; job, jb
Psalms; Ps; psalms, psalm, ps, pslm, psm, pss
Proverbs; Prov; proverbs, prov, pv, prv
Ecclesiastes; Ecc; ecclesiastes, eccl, ecc, eccle
SongOfSolomon; song; song of solomon, songofsolomon, songs, song, sos, cant
Isaiah; Isa; isaiah, isa, is
Jeremiah; Jer; jeremiah, jer, je
Lamentations; Lam; lamentations, lam, la
Ezekiel; Ezek; ezekiel, ezek, eze, ezk
Daniel; Dan; daniel, dan, dn
Hosea; Hos; hosea, hos, ho
Joel; Joel; joel, jl
Amos; Amos; amos, am
Obadiah; Obad; obadiah, obad, ob
Jonah; Jonah; jonah, jon, jnh
Micah; Mic; micah, mic, mi
Nahum; Nah; nahum, nah, na
Habakkuk; Hab; habakkuk, hab, ha
Zephaniah; Zeph; zephaniah, zeph, ze, zp
Haggai; Hag; haggai, hag, hg
Zechariah; Zech; zechariah, zech, zec, zc
Malachi; Mal; malachi, mal, ml
Matthew; Matt; matthew, matt, mt, mat
Mark; Mark; mark, mrk, mk, mr, mar
Luke; Luke; luke, luk, lk
John; John; john, jhn, joh, jh
Acts; Acts; acts, act, ac
Romans; Rom; romans, rom, ro, rm
1 Corinthians; 1Cor; 1 corinthians, 1corinthians, firstcorinthians, 1cor, 1co, first corinthians, first_corinthians
2 Corinthians; 2Cor; 2 corinthians, 2corinthians, secondcorinthians, 2cor, 2co, second corinthians, second_corinthians
Galatians; Gal; galatians, gal, ga
Ephesians; Eph; ephesians, eph, ep
Philippians; Phil; philippians, phil, php, pp
Colossians; Col; colossians, col, cl
1 Thessalonians; 1Th; 1 thessalonians, 1thessalonians, firstthessalonians, 1thess, 1th, first thessalonians, first_thessalonians
2 Thessalonians; 2Th; 2 thessalonians, 2thessalonians, secondthessalonians, 2thess, 2th, second thessalonians, second_thessalonians
1 Timothy; 1Tim; 1 timothy, 1timothy, firsttimothy, 1tim, 1ti, first timothy, first_timothy
2 Timothy; 2Tim; 2 timothy, 2timothy, secondtimothy, 2tim, 2ti, second timothy, second_timothy
Titus; Tit; titus, tit, ti
Philemon; Phm; philemon, phm, philem, phlm
Hebrews; Heb; hebrews, heb, he
James; Jas; james, jam, jas, jm
1 Peter; 1Pet; 1 peter, 1peter, firstpeter, 1pet, 1pe, 1pt, first peter, first_peter
2 Peter; 2Pet; 2 peter, 2peter, secondpeter, 2pet, 2pe, second peter, second_peter
1 John; 1Jn; 1 john, 1john, firstjohn, 1jn, 1 jn, 1jh, 1 jh, 1jo, 1jhn, 1joh, first_john
2 John; 2Jn; 2 john, 2john, secondjohn, 2jn, 2 jn, 2jh, 2 jh, 2jo, 2jhn, 2joh, second_john
3 John; 3Jn; 3 john, 3john, thirdjohn, 3jn, 3 jn, 3jh, 3 jh, 3jo, 3joh, 3jhn, third_john
Jude; Jude; jude, jud, ju, jde
Revelation; Rev; revelation, rev, re, rv
1Sam-K; 1SamK; 1 samuel-k, 1samuel-k, firstsamuel-k, 1 sam-k, 1sam-k, 1sa-k, 1samk
2Sam-K; 2SamK; 2 samuel-k, 2samuel-k, secondsamuel-k, 2 sam-k, 2sam-k, 2sa-k, 2samk
Tobit; Tob; tobit, tobbit, tob
TobitS; TobS; tobits, tobs, tobit s, tobit_s
TobitBA; TobBA; tobitba, tobba, tobit ba, tobit_ba
Bel; Bel; bel, bell
BelTh; BelTh; belth, bellth, bel th, bel_th
DanielTh; DanTh; daniel th, danielth, daniel_th
Sirach; Sira; sirach, sir
Wisdom; Wis; wisdom, wis
PsalmsOfSolomon; Pos; psalmsofsolomon, psalms of solomon, pos, pss, psalms_of_solomon
Odes; Odes; odes, ode, od
EpistleOfJeremiah; Eoj; epistleofjeremiah, eoj, epistle of jeremiah, epistle_of_jeremiah
1 Esdras; 1Es; firstesdras, 1 esdras, 1esdras, 1es, first esdras, first_esdras
2 Esdras; 2Es; secondesdras, 2 esdras, 2esdras, 2es, second esdras, second_esdras
3 Maccabees; 3Mac; thirdmaccabees, 3 maccabees, 3maccabees, third maccabees, third_maccabees
4 Maccabees; 4Mac; fourthmaccabees, 4 maccabees, 4maccabees, fourth maccabees, fourth_maccabees
Baruch; Bar; baruch, bar
Qohelet; Qoh; qohelet, qoh, kohelet
JoshuaA; JoshA; joshuaa, josha, joshua a, joshua_a
JoshuaB; JoshB; joshuab, joshb, joshua_b, joshua b
JudgesA; JudgA; judgesa, judga, judges a, judges_a
JudgesB; JudgB; judgesb, judgb, judges b, judges_b
3 Kings; 3King; 3 kings, 3kings, 3king, three kings, three_kings
4 Kings; 4King; 4 kings, 4kings, 4king, four kings, four_kings
Judith; Jdth; judith
1 Maccabees; 1Mac; firstmaccabees, 1 maccabees, 1maccabees, first macabees, first_maccabees
2 Maccabees; 2Mac; secondmaccabees, 2 maccabees, 2maccabees, second maccabees, second_maccabees
Susannah; Sus; susannah, sus
SusannahTh; SusTh; susannahth, susannah th, susth, sus th, susannah_th, sus_th
"""
_BOOK_ROWS = [[p.strip() for p in line.split(";")] for line in _BOOKS.strip().splitlines()]
BOOKS = [name for name, _, _ in _BOOK_ROWS]
SHORT_NAMES = [short for _, short, _ in _BOOK_ROWS]


@lru_cache(1)
def book_aliases() -> dict[str, int]:
    """Alias to book code; of books with the same alias the first."""
    out: dict[str, int] = {}
    for code, (_, _, aliases) in enumerate(_BOOK_ROWS):
        for alias in aliases.split(", "):
            out.setdefault(alias, code)
    return out


@lru_cache(1)
def modules() -> list[tuple[int, str, str, list[str]]]:
    rows = [line.split(": ") for line in _MODULES.strip().splitlines()]
    return [(i, code, name, [a.replace("_", " ") for a in aliases.split()]) for i, (code, name, aliases) in enumerate(rows)]


@lru_cache(1)
def module_aliases() -> dict[str, int]:
    return {a: i for i, _, _, aliases in modules() for a in aliases}


def book_code(name: Column) -> Column:
    """Code of a book in any spelling and case; 0 if unknown."""
    return F.coalesce(fields.mapped(F.lower(name), book_aliases()), F.lit(0))


def book_name(code: Column) -> Column:
    return fields.mapped(code, dict(enumerate(BOOKS)))


def module_code(name: Column) -> Column:
    return F.coalesce(fields.mapped(F.lower(name), module_aliases()), F.lit(0))


def module_name(code: Column) -> Column:
    return fields.mapped(code, {i: c for i, c, _, _ in modules()})


def parse_reference(text: Column | str) -> Column:
    """'1 John 2:4' (or 'byz#1 John 2:4 7') to codes (module, book, chapter, verse, word); null if it is no reference."""
    text = F.col(text) if isinstance(text, str) else text

    def coded(read: Column) -> Column:
        number = lambda c: F.coalesce(read[c], F.lit(0)).alias(c)
        module = F.when(read["module"].isNotNull(), module_code(read["module"])).otherwise(0)
        return F.struct(module.alias("module"), book_code(read["book"]).alias("book"), number("chapter"), number("verse"), number("word"), (read["chapter"].isNotNull() & read["verse"].isNotNull()).alias("_ok"))

    fields_ = ("module", "book", "chapter", "verse", "word")
    return fields.let(fields.let(fields.reference(text), coded), lambda c: F.when(c["_ok"] & (c["book"] > 0), F.struct(*[c[f].alias(f) for f in fields_])))


def reference_text(ref: Column) -> Column:
    """'module#Book c:v w'; the word number is left out where it is 0."""
    verse = F.concat(ref["module"], F.lit("#"), ref["book"], F.lit(" "), ref["chapter"].cast("string"), F.lit(":"), ref["verse"].cast("string"))
    return F.when(ref["word"] > 0, F.concat(verse, F.lit(" "), ref["word"].cast("string"))).otherwise(verse)


def book_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(range(len(BOOKS)), BOOKS, SHORT_NAMES)), "code int, english string, english_short string")


def module_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([m[:3] for m in modules()], "code int, module string, name string")
