"""Scalar functions against pairs of input and expected output."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import betacode, greek, hashing
from lexweave.functions import glosses as G
from lexweave.functions import lexicon_fields as fields
from lexweave.functions import references as R


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_table_sizes():
    assert [len(t) for t in (greek.LOWER, greek.REMOVE_ACCENT, greek.FIX_GRAVE)] == [105, 112, 39]
    assert len(greek.COLLATE) == 174 + 26 and len(greek.NORMALISE) == 175 + 26


KEYS = [
    ("ἄρτόσ", "ἄρτος", "αρτοσ"),
    ("τὸ", "τό", "το"),
    ("οἶκός", "οἶκος", "οικοσ"),
    ("ΜΩϋσῆς", "μωϋσῆς", "μωυσησ"),
    ("ὁ Πέτρος λέγει·", "ὁ πέτρος λέγει·", "ο πετροσ λεγει·"),
    ("", "", ""),
    ("É", "É", "É"),
    ("ἆ", "ἆ", "ἆ"),
]


def test_keys(spark):
    words = [k[0] for k in KEYS]
    assert column(spark, words, greek.accented) == [k[1] for k in KEYS]
    assert column(spark, words, greek.unaccented) == [k[2] for k in KEYS]
    assert column(spark, [None], greek.accented) == [None]


@pytest.mark.parametrize("word, n", [("περιπατεῖτε", 13), ("αβ", 1), ("α", 1), ("θεός", 3 + 2)])
def test_keyword_counts(spark, word, n):
    rows = greek.keyword_rows(spark.createDataFrame([(1, word)], "id int, word string"), "word").collect()
    assert len(rows) == n if word != "θεός" else len(rows) in (4, 5, 6)


def test_keyword_limits(spark):
    df = spark.createDataFrame([(1, "a" * 499), (2, "a" * 500), (3, ""), (4, None)], "id int, word string")
    rows = greek.keyword_rows(df, "word").collect()
    assert {r.id for r in rows} == {1}
    assert max(len(r.keyword) for r in rows if r.tier == 3) == greek.MAX_PREFIX


def test_prefixes_skip_stopwords_but_exact_keys_stay(spark):
    rows = greek.keyword_rows(spark.createDataFrame([("these",), ("the",)], "word string"), "word").collect()
    partial = [r.keyword for r in rows if r.tier == 3]
    assert "the" not in partial and "thes" in partial
    assert "the" in [r.keyword for r in rows if r.tier == 1]


def test_collation_orders_by_fold_then_bytes(spark):
    words = ["Βα", "ἀβ", "αβ", "ἄ", "γ", "αβγ"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.w for r in df.orderBy(greek.sort_key("w"), "w").collect()] == ["ἄ", "αβ", "ἀβ", "αβγ", "Βα", "γ"]


def test_transliteration(spark):
    words = ["Θεός", "ψυχή", "ἁγίῳ", "שָׁלוֹם", "Jesus", "ὢ"]
    assert column(spark, words, greek.transliterated) == ["Theos", "psuche", "agi", "slwm", "ss", ""]
    assert column(spark, ["ψυχή"], lambda c: greek.transliterated(c, True)) == ["psuchē"]


BETACODE = [
    ("default", "Qeo/v", "Θεός"), ("default", "es1", "εσ"), ("default", "es3", "εϲ"), ("default", "a)p'", "ἀπ᾽"), ("default", " d' ", "δ᾽"), ("default", "klhto\\s", "κλητὸς"),
    ("default", "w=|t", "ῷτ"), ("default", ")Ihsou^", "Ἰησοῦ"), ("tlg", "*(/A|DOU", "ᾍδου"), ("tlg", "A)RXH=|", "ἀρχῇ"), ("tlg", "*(HRW/|DOU", "Ἡρῴδου"), ("tlg", "*QEO/S", "Θεός"), ("default", "sos", "σος"),
]


def test_betacode(spark):
    for variant in ("default", "tlg"):
        own = [b for b in BETACODE if b[0] == variant]
        out = column(spark, [b[1] for b in own], lambda c, v=variant: betacode.to_greek(c, v))
        assert [r.greek for r in out] == [b[2] for b in own]


def test_betacode_errors(spark):
    out = column(spark, ["a\\b'a", "dε", "*a", "n/", None, ""], betacode.to_greek)
    assert [r and r.error for r in out[:4]] == ["UnexpectedCharacter", "UnexpectedCharacter", "UnexpectedCharacter", "UnexpectedAccent"]
    assert out[5].greek == ""


def test_gloss_tokens_and_strings(spark):
    assert column(spark, ["the bread-seed?;", "", None, " a/b "], G.tokens) == [["the", "bread", "seed"], [], None, ["a", "b"]]
    entries = [["a", "b"], ["a."], [], None, ["a", ""]]
    assert column(spark, entries, G.gloss_string, "array<string>") == ["a, b.", "a.", "", None, "a, "]


def test_gloss_list(spark):
    out = column(spark, ["en:dragon:large serpent#es:dragón", "", "xx:en:a::b", "xx:yy", "en"], fields.gloss_list)
    assert [[(g.lang, g.entries) for g in x] if x is not None else None for x in out] == [
        [("en", ["dragon", "large serpent"]), ("es", ["dragón"])], None, [("en", ["a", "b"])], [], [("en", [])]
    ]


def test_field_casts(spark):
    assert column(spark, ["5", "-1", "16777216", "x", "", None], fields.u24) == [5, None, None, None, None, None]
    assert column(spark, ["TRUE", "no", "1"], fields.boolean) == [True, False, None]
    assert column(spark, ["uk", "zh_TW", "xx"], fields.lang_code) == ["ru", "zh", None]
    assert column(spark, ["Proper Noun", "proper_noun", "Nothing", "comparativeadjective", "comparative adjective"], fields.pos_code) == [7, 7, 0, 0, 27]
    assert column(spark, ["00065535", "65536", "0", "-5"], fields.u16) == [65535, None, 0, None]
    assert column(spark, ["food, object", "", "a b c d e f g h i j k l"], fields.tag_list) == [["food", "object"], None, list("abcdefghij")]


def test_references(spark):
    out = column(spark, ["1 John 2:4", "byz#Revelation 20:2 3", "Mk 3.4", "Nobook 1:2", "kjtr#2 sam 1:99999", None], R.parse_reference)
    assert [tuple(r) if r else None for r in out] == [(0, 62, 2, 4, 0), (1, 66, 20, 2, 3), None, None, None, None]


def test_every_book_is_read_by_its_name():
    aliases = R.book_aliases()
    assert [aliases[b.lower()] for b in R.BOOKS] == list(range(97))
    assert {a: R.BOOKS[aliases[a]] for a in ("gn", "pss", "jud", "1jn", "2sm", "mt")} == {"gn": "Genesis", "pss": "Psalms", "jud": "Jude", "1jn": "1 John", "2sm": "2 Samuel", "mt": "Matthew"}


def test_farmhash():
    out = hashing.fingerprints(["", "a", "abc", None]).view("uint64")
    assert [int(x) for x in out[:3]] == [11160318154034397263, 12917804110809363939, 2640714258260161385]
    assert len({int(x) for x in hashing.fingerprints(["x" * n for n in range(300)])}) == 300
