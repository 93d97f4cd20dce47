"""Term frequencies and formatting copies against brute force, and their edge cases."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexweave.llm import dedupe, terms

LEX = "lexeme_no long, lang string, word string, root string, glosses array<struct<lang:string,entries:array<string>>>, extra string"
FORM = "lexeme_no long, form_no int, word string, glosses array<struct<lang:string,entries:array<string>>>, field string, term string"


def lexemes(spark, rows):
    return spark.createDataFrame(rows, LEX)


def test_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(terms, "RANGE", 7)
    rng = random.Random(1)
    words = ["a", "b", "c-d", "  ", "e.e", "ζ", "long " * 300]
    gloss = lambda: rng.choice([None, [], [("en", None)], [("en", [rng.choice(words) for _ in range(rng.randrange(4))]), ("es", [None, "x"])]])
    lex = [(i, "el", "w", None, gloss(), "x") for i in range(60)]
    forms = [(i, 1, rng.choice([None, "", "w", "v", "u%d" % i]), gloss(), "clash", "clash") for i in range(60)]
    got = {(r.field, r.term): (r.occurrences, r.records, r.mark) for r in terms.term_frequencies(lexemes(spark, lex), spark.createDataFrame(forms, FORM), common_one_in=10).collect()}

    want, records, totals = Counter(), Counter(), Counter()
    for glosses in [r[4] for r in lex] + [r[3] for r in forms]:
        if not glosses:
            continue
        totals["gloss_entries"] += 1
        found = [t for g in glosses for e in g[1] or () if e is not None for t in __import__("re").split(r"[ \t\r\n()\[\],.\-;:{}?!/\\&%+=]+", e) if t]
        want.update(("gloss_entries", t) for t in found)
        records.update(("gloss_entries", t) for t in set(found))
    for r in forms:
        if r[2] is not None:
            totals["form_word"] += 1
            want["form_word", r[2]] += 1
            records["form_word", r[2]] += 1
    mark = lambda k: "rare" if records[k] == 1 else "common" if records[k] * 10 > totals[k[0]] else None
    assert got == {k: (n, records[k], mark(k)) for k, n in want.items()}


def test_identifiers_are_unique(spark):
    rows = spark.createDataFrame([("f", "t%d" % (i % 500), True) for i in range(3000)], "field string, term string, first boolean")
    counted = terms.count_terms(rows).collect()
    assert len({r.term_id for r in counted}) == 500 and sum(r.occurrences for r in counted) == 3000


def test_no_rows(spark):
    assert terms.term_frequencies(lexemes(spark, []), spark.createDataFrame([], FORM)).count() == 0
    assert dedupe.formatting_copies(lexemes(spark, [])).count() == 0


COPIES = [
    (1, "el", "Λόγος", None, [("en", ["word", "speech"])], "a"),
    (2, "el", " λόγοσ.", "", [("en", ["Speech!"]), ("en", ["WORD"])], "b"),
    (3, "el", "λόγος", None, [("es", ["word", "speech"])], "c"),
    (4, "el", "λόγος", None, [("en", ["word", "speech", "word"])], "d"),
    (5, "he", "λόγος", None, [("en", ["word", "speech"])], "e"),
    (6, "el", "λογος", None, [("en", ["word", "speech"])], "f"),
    (7, None, None, None, None, None),
    (8, None, "", "--", [], None),
    (9, None, None, None, [("en", ["?", None, ""])], None),
    (None, None, None, None, None, None),
    (10, "el", "İx", None, None, "g"),
    (11, "el", "i̇x", None, None, "h"),
    (12, "el", "x" * 100_000, None, None, "i"),
    (13, "el", "X " * 100_000, None, None, "j"),
]


@pytest.mark.parametrize("bits", [64, 2])
def test_copies(spark, bits):
    got = sorted(tuple(r) for r in dedupe.formatting_copies(lexemes(spark, COPIES), bits).select("first_no", "copy_no").collect())
    assert got == [(1, 2), (7, 8), (7, 9), (10, 11), (12, 13)]


def test_collapse_counts_copies(spark):
    rows = COPIES + [(100 + i, "el", "λόγος" + "," * (i % 3), "", [("en", ["speech", "word"])], "z") for i in range(300)]
    got = {r.lexeme_no: r.n_copies for r in dedupe.collapse_copies(lexemes(spark, rows)).collect() if r.lexeme_no is not None}
    assert got[1] == 302 and got[7] == 3 and got[3] == 1 and sum(got.values()) == len(rows) - 1


def test_large_groups_fall_into_parts(spark, monkeypatch):
    """A group of more rows than a part holds, some of which only collide with the others."""
    monkeypatch.setattr(dedupe, "PART", 10)
    rows = [(i, "el", ("ab", "ab.", "AB")[i % 3] if i % 4 else "zz", None, [("en", ["p", "q"] if i % 2 else ["Q", "p"])], None) for i in range(200)]
    want = {(1, i) for i in range(2, 200) if i % 4} | {(0, i) for i in range(4, 200, 4)}
    for bits in (64, 0):
        assert {tuple(r) for r in dedupe.formatting_copies(lexemes(spark, rows), bits).select("first_no", "copy_no").collect()} == want


def test_copies_against_brute_force(spark):
    rng = random.Random(3)
    vary = lambda s: "".join(rng.choice([c, c.upper(), c + " ", c + "."]) for c in s)
    rows = []
    for i in range(400):
        word = rng.choice(["ab", "ac", "bc"])
        entries = [rng.choice(["p q", "r"]) for _ in range(rng.randrange(3))]
        rows.append((i, rng.choice(["el", "he"]), vary(word), rng.choice([None, "", "r"]), [("en", [vary(e)]) for e in entries], None))
    clean = lambda s: "".join(c for c in (s or "").lower() if c.isalnum()).replace("ς", "σ")
    groups = defaultdict(list)
    for r in rows:
        groups[r[1], clean(r[2]), clean(r[3]), tuple(sorted(clean(e) for _, es in r[4] for e in es))].append(r[0])
    want = {(min(g), n) for g in groups.values() for n in g if n != min(g)}
    assert {tuple(r) for r in dedupe.formatting_copies(lexemes(spark, rows)).select("first_no", "copy_no").collect()} == want


def test_two_pointers():
    assert dedupe.same_folded("A-b", " a B!") and not dedupe.same_folded("ab", "abc") and dedupe.same_folded(None, "..")
