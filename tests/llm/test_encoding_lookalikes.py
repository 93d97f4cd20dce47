"""Garbled text against text that we garble ourselves, and look-alikes against text that we disguise."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import encoding as E
from lexweave.llm import lookalikes as K
from lexweave.llm import queries

SF = "/root/testdata/sf0.01"


def garble(text, right, wrong):
    raw = text.encode(right, "ignore")
    return "".join(E.page(wrong)[1][b] for b in raw)


@pytest.fixture(scope="module")
def plain(spark):
    """Plain glosses and words of the small tables."""
    lexemes, forms = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lexemes", "forms"))
    texts = E.dictionary_texts(lexemes, forms).filter("field != 'form_word'").select("lang", "text").distinct()
    return [tuple(r) for r in texts.filter(E._training(F.col("lang"), F.col("text"))).collect()]


@pytest.fixture(scope="module")
def mixed(spark, plain):
    rng = random.Random(7)
    swaps = {"el": [("utf-8", "cp1252"), ("cp1253", "latin-1"), ("utf-8", "cp437")], "ru": [("cp1251", "latin-1"), ("utf-8", "cp1251"), ("koi8-r", "latin-1")], "es": [("utf-8", "cp1252"), ("latin-1", "cp1251")]}
    rows, no = [], 0
    for lang, text in plain:
        no += 1
        if lang in swaps and not text.isascii() and rng.random() < 0.15:
            right, wrong = rng.choice(swaps[lang])
            try:
                text.encode(right)
            except UnicodeEncodeError:
                right = "utf-8"
            bad = garble(text, right, wrong)
            if bad != text:
                rows.append((no, lang, bad, text))
                continue
        rows.append((no, lang, text, None))
    return rows


def test_garbled_is_found_and_restored(spark, mixed):
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in mixed], "no long, lang string, text string")
    got = {r.no: r for r in E.judged(df).filter("garbled").collect()}
    truth = {r[0]: r for r in mixed if r[3] is not None}
    assert len(truth) > 100
    found = len(set(got) & set(truth))
    assert found / len(truth) > 0.98 and found / len(got) > 0.97
    restored = sum(got[n].restored == truth[n][3] for n in set(got) & set(truth))
    assert restored / found > 0.95


def test_em_learns_a_key_that_starts_wrong(plain):
    """Half of the starting key is wrong; the bigrams put most of it right."""
    words = [w for lang, t in plain if lang == "ru" for w in t.split()]
    letters = sorted({c for w in words for c in w})
    counts = np.zeros((len(letters) + 1,) * 2)
    at = {c: i + 1 for i, c in enumerate(letters)}
    pairs = {}
    cipher = {c: garble(c, "cp1251", "latin-1") for c in letters if len(garble(c, "cp1251", "latin-1")) == 1 and ord(c) > 127}
    for w in words:
        last = ""
        for c in [*w, ""]:
            counts[at.get(last, 0), at.get(c, 0)] += 1
            pairs[cipher.get(last, ""), cipher.get(c, "")] = pairs.get((cipher.get(last, ""), cipher.get(c, "")), 0) + 1
            last = c
    p = (counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * len(counts))
    model = E.Language(letters, np.log(p), p * (counts.sum(1, keepdims=True) / counts.sum()))

    class Wrong(E.Swap):
        def start(self, unit):
            right = super().start(unit)
            return None if right and ord(right) % 2 else right

    key = E.decipher([(a, b, n) for (a, b), n in pairs.items() if a or b], Wrong("cp1251", "latin-1"), model, rounds=40)
    wrong = [c for c in cipher if ord(c) % 2 and sum(c in w for w in words) > 20]
    assert sum(key.get(cipher[c]) == c for c in wrong) >= 0.6 * len(wrong)


def test_text_twice_or_partly_garbled_and_lost(spark, plain):
    twice = garble(garble("оружие и вода", "utf-8", "cp1252"), "utf-8", "cp1252")
    rows = [(0, "ru", twice), (1, "ru", "дом и " + garble("вода", "utf-8", "latin-1")), (2, "ru", "д���"), (3, "ru", "дом"), (4, "en", "crow·n"), (5, None, "Ã©"), (6, "ru", None), (7, "ru", ""), (8, "ru", "дом " * 3000)]
    base = [(100 + i, lang, t) for i, (lang, t) in enumerate(plain)]
    got = {r.no: r for r in E.judged(spark.createDataFrame(rows + base, "no long, lang string, text string")).filter("garbled and no < 100").collect()}
    assert set(got) == {0, 1, 2}
    assert got[0].restored == "оружие и вода" and got[1].restored == "дом и вода"


def test_garbled_text_of_letters_of_a_wide_script(spark, plain):
    """UTF-8 read as GBK that stays Han, however often it occurs, and beside plain text."""
    bad = "明喜".encode().decode("gbk")
    rows = [(i, "zh", bad) for i in range(5)] + [(5, "zh", "山; " + bad), (6, "zh", "山女"), (7, "zh", "去思食"), (8, "ko", bad)]
    base = [(100 + i, lang, t) for i, (lang, t) in enumerate(plain)]
    got = {r.no: r.restored for r in E.judged(spark.createDataFrame(rows + base, "no long, lang string, text string")).filter("garbled").collect()}
    assert {k: v for k, v in got.items() if k < 8} == {i: "明喜" for i in range(5)} | {5: "山; 明喜"}
    assert all(E.surely_hidden(t) == t.endswith(bad) for _, _, t in rows)
    assert all(E.surely_hidden(plain[k - 100][1]) for k in got if k >= 100 and plain[k - 100][0] == "zh")


def test_words_in_letters_of_another_language(spark):
    """An unpointed Hebrew word that became plain Greek letters is garbled, an accented Greek word isn't."""
    lexemes, forms = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lexemes", "forms"))
    (no,) = lexemes.filter("lang = 'he'").select("lexeme_no").first()
    words = spark.createDataFrame([(no, 9000, garble("דבר", "cp1255", "cp1253")), (no, 9001, "λόγος")], "lexeme_no long, form_no long, word string")
    more = words.select(*[(F.col(f.name) if f.name in words.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in forms.schema.fields])
    forms = forms.unionByName(more)
    got = {r.form_no: r.restored for r in E.garbled_texts(lexemes, forms).filter("field = 'form_word' and form_no >= 9000").collect()}
    assert got == {9000: "דבר"}
    assert [r.form_no for r in K.lookalike_records(lexemes, forms).filter("form_no >= 9000").collect()] == [9001]


def test_no_key_worsens_a_correct_start(spark, plain):
    """English rarely has é, which is no evidence against the page's é."""
    truth = dict(enumerate(["café", "résumé", "élite", "naïve café"] * 30))
    rows = [(i, "en", garble(t, "utf-8", "cp1252")) for i, t in truth.items()] + [(1000, "en", garble(garble("café", "utf-8", "cp1252"), "utf-8", "cp1252"))]
    base = [(2000 + i, lang, t) for i, (lang, t) in enumerate(plain)]
    got = {r.no: r.restored for r in E.judged(spark.createDataFrame(rows + base, "no long, lang string, text string")).filter("garbled and no < 2000").collect()}
    assert got == truth | {1000: "café"}


@pytest.mark.parametrize("lang, kind", [("ru", "cp1251>cp1257"), ("ru", "cp855>latin-1"), ("ru", "random"), ("es", "random")])
def test_unknown_swap_is_deciphered(spark, plain, lang, kind, monkeypatch):
    """A swap of no listed pages, and a substitution of letters at random, among plain texts and other garbled ones."""
    rng = random.Random(5)
    own = [t for k, t in plain if k == lang and not t.isascii()]
    letters = sorted({c for t in own for c in t if not c.isascii()})
    table = dict(zip(map(ord, letters), rng.sample([chr(c) for c in range(0x10A0, 0x10F0)], len(letters))))
    bad = [(t.translate(table) if kind == "random" else garble(t, *kind.split(">")), t) for t in own]
    truth = dict(enumerate(t for t in bad for _ in range(2)))
    rows = [(i, lang, b) for i, (b, _) in truth.items()]
    rows += [(10_000 + i, "ru", garble(t, "cp1251", "latin-1")) for i, (k, t) in enumerate(plain) if k == "ru"]
    base = [(20_000 + i, k, t) for i, (k, t) in enumerate(plain)]
    df = spark.createDataFrame(rows + base, "no long, lang string, text string")
    got = {r.no: r.restored for r in E.judged(df).filter("garbled").collect()}
    assert sum(got.get(i) == t for i, (_, t) in truth.items()) >= 0.9 * len(truth)
    alone = {r.no for r in E.judged(spark.createDataFrame(base, "no long, lang string, text string")).filter("garbled").collect()}
    assert {i for i in got if i >= 20_000} <= alone
    # Without learned keys nothing is read.
    monkeypatch.setattr(E, "learn_keys", lambda *a: {})
    assert E.judged(df).filter("restored is not null").count() == 0


def test_utf8_in_pages_off_the_list(spark, plain):
    own = [t for k, t in plain if k == "ru" and not t.isascii()][:60]
    rows = [(i, "ru", garble(t, "utf-8", ("cp737", "mac_cyrillic", "cp855")[i % 3])) for i, t in enumerate(own)]
    base = [(20_000 + i, k, t) for i, (k, t) in enumerate(plain)]
    got = {r.no: r.restored for r in E.judged(spark.createDataFrame(rows + base, "no long, lang string, text string")).filter("garbled and no < 20000").collect()}
    assert sum(got.get(i) == t for i, t in enumerate(own)) >= 0.9 * len(own)


def test_noise_yields_no_key(plain):
    rng = random.Random(1)
    signs = [chr(c) for c in range(0x10A0, 0x10F0)]
    counts = {}
    for _ in range(800):
        units = [(rng.choice(signs), True) for _ in range(rng.randint(3, 9))]
        for a, b in zip(["", *(u for u, _ in units)], [*(u for u, _ in units), ""]):
            counts[a, b] = counts.get((a, b), 0) + 1
    words = [t for lang, t in plain if lang == "ru"]
    letters = sorted({c for w in words for c in w if not c.isascii()})
    p = np.full((len(letters) + 1,) * 2, 0.05)
    for w in words:
        for a, b in zip(" " + w, w + " "):
            p[letters.index(a) + 1 if a in letters else 0, letters.index(b) + 1 if b in letters else 0] += 1
    share = p.sum(0) / p.sum()
    p /= p.sum(1, keepdims=True)
    model = E.Language(letters, np.log(p), p * share[:, None])
    assert E.decipher_unknown([(a, b, n) for (a, b), n in counts.items()], model, E.page_keys("ru")) is None
    few = [("", "\u10a0", 5), ("\u10a0", "", 5)]
    assert E.decipher_unknown(few, model, []) is None and E.decipher_unknown([], model, []) is None


def test_nothing_to_learn_from(spark):
    assert E.judged(spark.createDataFrame([], "no long, lang string, text string")).count() == 0
    assert [r.garbled for r in E.judged(spark.createDataFrame([(1, "ru", "�")], "no long, lang string, text string")).collect()] == [True]


CASES = [
    ("el", "λόγος", "λόγος", False),
    ("el", "λόγος", "λόγος", True),
    ("el", "λόγος", "λόγος", True),
    ("el", "λόyoς", "λόγος", True),
    ("el", "λоγος", "λογος", True),
    ("el", "ϰαι", "και", True),
    ("el", "λο​γος", "λογος", True),
    ("el", "λογος ", "λογος ", True),
    ("el", "ΛΟΓΟΣ. «»", "ΛΟΓΟΣ. «»", False),
    ("el", "λοςγ\t α-β", "λοςγ\t α-β", False),
    ("el", "日", "日", True),
    ("he", "שָׁל", "שָׁל", True),
    ("he", "שָׁל", "שָׁל", False),
    ("he", "שׁ", "שׁ", True),
    ("he", "ℵב", "אב", True),
    ("aaa", "ｍēh", "mēh", True),
    ("aaa", "mēh", "mēh", True),
    ("aaa", "šaα", "šaa", True),
    ("aaa", "šaʿa-b", "šaʿa-b", False),
    ("aaa", "a‑b", "a-b", True),
    ("xx", "aα", "aα", False),
    ("el", "", "", False),
    ("el", None, None, False),
    ("el", "α" * 50_000, "α" * 50_000, False),
]


def test_consistent_forms(spark):
    for lang, text, form, case in CASES:
        assert K.consistent(text, lang) == form, text
        assert K.is_case(text, lang) == case, (lang, text)
    df = spark.createDataFrame([(i, c[0], c[1], "x") for i, c in enumerate(CASES)], "i long, lang string, text string, other string")
    got = {r.i: (r.form, r.is_case) for r in K.with_consistent_form(df).collect()}
    assert got == {i: (c[2], K.is_case(c[1], c[0])) for i, c in enumerate(CASES)}


ALIKE = [
    ("el", "cλ", "ϲλ", "σλ"), ("el", "λօγος", "λογος", "λογος"), ("el", "ɑβ", "αβ", "αβ"), ("el", "ΛӨΓΟΣ", "ΛΘΓΟΣ", "ΛΘΓΟΣ"),
    ("el", "λⲟγος", "λογος", "λογος"), ("el", "Ꭺβ", "Αβ", "Αβ"), ("he", "oש", "סש", "סש"), ("he", "օש", "סש", "סש"),
    ("aaa", "ոa", "na", "na"), ("aaa", "զa", "qa", "qa"), ("aaa", "ⲟa", "oa", "oa"), ("aaa", "Ꮪa", "Sa", "Sa"), ("aaa", "ɡa", "ga", "ga"),
]


def test_letters_of_any_script_that_look_the_same(spark):
    rows = [(2 * i + j, lang, text) for i, (lang, one, two, _) in enumerate(ALIKE) for j, text in enumerate((one, two))]
    got = {r.i: (r.form, r.is_case) for r in K.with_consistent_form(spark.createDataFrame(rows, "i long, lang string, text string")).collect()}
    for i, (lang, one, two, form) in enumerate(ALIKE):
        assert got[2 * i] == (form, True), (lang, one)
        assert got[2 * i + 1] == (form, form != two), (lang, two)
    table = K.lookalikes(spark)
    assert 500 < sum(map(len, table.values())) < 5000
    # No plain letter of a language becomes another one.
    assert all(K.consistent(c, lang, table) == c for lang, own in K.plain_letters().items() for c in own)


class NoIcu:
    """A JVM in which ICU's classes are unknown, as py4j shows it."""

    def __init__(self, jvm):
        self._real, self.com = jvm, jvm.no_such_package

    def __getattr__(self, name):
        return getattr(self._real, name)


@pytest.mark.parametrize("name", ["p5_found", "p5_forms", "p5_groups"])
def test_without_icu_there_is_no_result(spark, name, monkeypatch):
    K._table.cache_clear()
    with monkeypatch.context() as m:
        m.setattr(spark, "_jvm", NoIcu(spark._jvm))
        with pytest.raises(RuntimeError, match="icu4j"):
            queries.QUERIES[name](spark, SF)
    assert len(K.lookalikes(spark)["he"]) > 50  # nothing of the failure is kept


def test_every_letter_has_its_skeleton(spark, monkeypatch):
    """Skeletons that don't match the letters one to one are an error, not a shorter table."""
    icu = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")
    cut = SimpleNamespace(build=lambda: SimpleNamespace(getSkeleton=lambda text: icu().build().getSkeleton(text)[:100]))
    jvm = SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=SimpleNamespace(**{"SpoofChecker$Builder": lambda: cut})))))
    with monkeypatch.context() as m:
        m.setattr(spark, "_jvm", jvm)
        with pytest.raises(ValueError):
            K._skeletons(spark)
    assert K._skeletons(spark)["ɡ"] == K._skeletons(spark)["g"]


def test_form_is_stable_and_groups(spark):
    for lang, text, form, _ in CASES:
        assert form is None or K.consistent(form, lang) == form
    lex = spark.createDataFrame([(1, "el", "λογος", None), (2, "el", "λ\u006fγ\u006fς", ""), (3, "el", "λογος", "λογ")], "lexeme_no long, lang string, word string, root string")
    forms = spark.createDataFrame([(1, 1, "λ\u043eγος"), (1, 2, None), (9, 1, "λ\u006fγ")], "lexeme_no long, form_no int, word string")
    groups = {(r.lang, r.form): (r.originals, r.n) for r in K.lookalike_groups(lex, forms).collect()}
    assert groups == {("el", "λογος"): (3, 4)}
    found = {tuple(r) for r in K.lookalike_records(lex, forms).collect()}
    assert ("form_word", 1, 1) in found and ("lexeme_word", 2, 0) in found and ("lexeme_word", 1, 0) not in found
    assert K.lookalike_records(lex.limit(0), forms.limit(0)).count() == 0
