"""Index, corpora, paradigms, sources and streaming on a small lexicon of our own."""

import pytest
from pyspark.sql import functions as F

from lexweave.operators import index, paradigm
from lexweave.operators import lexicon as L
from lexweave.sources import binary, tables, text

LINES = """
λέων|el|800000|Noun|ὁ|-οντος|30,55|λέ|en:lion:big cat#es:león||food, object|a note
  λέων|N-NSM|false|700001||byz#Mark 1:2 3,byz#Mark 1:4
  λέοντα|N-ASM|true|700002|en:The sneaky|
  λέοντα|N-ASM|false|700003|en:King|byz#Luke 2:2

λέων|el|800009|Noun|ὁ|||||||
  dropped|N-NSM|false|700009||
ὁράω|el|5|Verb|||||en:to see:the|||
  ὁρῶ|V-PAI-1S|false|7||
"""


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lex") / "a.txt"
    path.write_text(LINES)
    return text.read_lexicon(spark, str(path))


@pytest.fixture(scope="module")
def lexicon(loaded):
    return L.Lexicon(*loaded).written()


def test_first_lexeme_wins_and_its_forms_only(lexicon):
    assert sorted(r.uid for r in lexicon.lexemes.collect()) == [5, 800000]
    assert sorted(r.uid for r in lexicon.forms.collect()) == [7, 700001, 700002, 700003]


def test_lookup_prefers_accented_then_unaccented(spark, lexicon):
    asked = spark.createDataFrame([("λέων",), ("ΛΕΩΝ",), ("λεο",), ("ὁρ",), ("nothing",), ("",)], "q string")
    rows = index.lookup(asked, "q", lexicon.by_form).select("q", "keyword", "tier", "uid").collect()
    got = {(r.q, r.tier, r.uid) for r in rows}
    assert ("λέων", 1, 700001) in got
    assert {r.uid for r in rows if r.q == "λεο"} == {700002, 700003}
    assert not [r for r in rows if r.q in ("nothing", "")]


def test_ranks(lexicon):
    ranked = index.ranked(lexicon.by_form, index.FORM_SPEC, 60)
    rows = ranked.filter("keyword = 'λέ'").orderBy("rank").collect()
    assert [r.uid for r in rows] == [700001, 700003, 700002]


def test_gloss_tokens(lexicon):
    rows = {(r.form_no, r.token) for r in L.gloss_tokens(lexicon.forms.filter("uid >= 700000")).collect()}
    assert rows == {(1, "lion"), (1, "big"), (1, "cat"), (2, "sneaky"), (3, "King")}
    whole = {r.token for r in L.gloss_tokens(lexicon.forms.filter("uid = 7")).collect()}
    assert whole == {"see", "the"}  # 'the' is a whole entry


def test_uids_are_unique_and_deterministic(spark, lexicon):
    forms = lexicon.forms
    one, two = (sorted((r.uid, r.uid_new) for r in L.assign_uids(forms.select("lexeme_no", "form_no", "uid"), ["lexeme_no", "form_no"], forms.select("uid")).collect()) for _ in "ab")
    assert one == two and len({x[1] for x in one}) == 4
    assert [x for x in one if x[0] < L.MIN_UID] == [(7, 700004)]


def test_primary_form_and_panels(lexicon):
    chosen = {r.lexeme_no: r.form_no for r in paradigm.primary_form(lexicon.lexemes, lexicon.forms).collect()}
    assert set(chosen.values()) == {1}
    tables_ = [(r.title, r.top, r.bottom) for r in paradigm.panels(lexicon.lexemes, lexicon.forms).orderBy("kind").collect()]
    assert tables_ == [("Masculine", ["λέων", None, None, "λέοντα"], [None] * 4), ("Present", ["ὁρῶ", None, None, None], [None] * 4)]


def brute_form_by_parsing(forms, parsing):
    found = None
    for f in sorted(forms, key=lambda f: f[0]):
        if f[1] != parsing:
            if found is not None:
                return found
            continue
        if found is None or f[2] or (f[3] > 0 and found[3] == 0) or ((f[3] > 0) == (found[3] > 0) and found[4] > f[4]):
            found = f
    return found


def test_form_by_parsing_against_a_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(lex, no, rng.choice([1, 1, 1, 2]), rng.random() < 0.2, rng.choice([0, 0, 1]), rng.randrange(4)) for lex in range(60) for no in range(rng.randrange(1, 12))]
    forms = spark.createDataFrame(rows, "lexeme_no long, form_no int, parsing int, preferred boolean, n_glosses int, n_refs int")
    wanted = spark.createDataFrame([(lex, p) for lex in range(60) for p in (1, 2)], "lexeme_no long, parsing int")
    got = {(r.lexeme_no, r.parsing): r.form_no for r in paradigm.form_by_parsing(forms, wanted).collect()}
    for lex in range(60):
        for p in (1, 2):
            best = brute_form_by_parsing([r[1:] for r in rows if r[0] == lex], p)
            assert got.get((lex, p)) == (best and best[0])


def test_text_roundtrip(spark, loaded, tmp_path):
    lexemes, forms = loaded
    text.write_lexicon(lexemes, forms, str(tmp_path / "out"), one_file=True)
    again = text.read_lexicon(spark, str(tmp_path / "out"))
    cols = ["word", "uid", "glosses", "strongs", "tags", "note"]
    key = lambda df, c: sorted(map(repr, df.select(*c).collect()))
    assert key(again[0], cols) == key(lexemes, cols)
    assert key(again[1], ["word", "parsing", "preferred", "uid", "glosses", "refs"]) == key(forms, ["word", "parsing", "preferred", "uid", "glosses", "refs"])


def test_bad_rows(spark, tmp_path):
    (tmp_path / "b.txt").write_text("λέων|el|x|Noun|ὁ|||||||\n  λέων|N-NZ|false|1||\n")
    lexemes, forms = text.read_lexicon(spark, str(tmp_path / "b.txt"), "PERMISSIVE")
    assert [r.error for r in lexemes.collect()] == ["InvalidU24"] and [r.error for r in forms.collect()] == ["InvalidParsing"]
    with pytest.raises(Exception, match="InvalidU24"):
        text.read_lexicon(spark, str(tmp_path / "b.txt"))[0].collect()
    with pytest.raises(Exception):
        text.read_lexicon(spark, str(tmp_path / "missing.txt"))[0].collect()


def test_binary_roundtrip(spark, lexicon, tmp_path):
    path = str(tmp_path / "lex.bin")
    binary.write_binary(lexicon, path)
    assert binary.is_binary(path)
    first = open(path, "rb").read()
    lexemes = binary.read_binary(spark, path, "lexemes").drop("genitive_suffix", "root", "adjective", "note")
    assert sorted((r.uid, r.word, r.strongs, r.tags) for r in lexemes.collect()) == [(5, "ὁράω", [], None), (800000, "λέων", [30, 55], ["food", "object"])]
    forms = binary.read_binary(spark, path, "forms").collect()
    assert {(r.uid, r.word, len(r.refs)) for r in forms} == {(7, "ὁρῶ", 0), (700001, "λέων", 2), (700002, "λέοντα", 0), (700003, "λέοντα", 1)}
    postings = binary.read_binary(spark, path, "postings").filter("index = 'by_form' and keyword = 'λέ'").orderBy("rank").collect()
    assert [r.uid for r in postings] == [700001, 700003, 700002]
    binary.write_binary(lexicon, path)
    assert open(path, "rb").read() == first
    with pytest.raises(binary.InvalidFile):
        list(binary.read_records(first[:40]))


def test_tables(spark, lexicon, tmp_path):
    tables.write_tables(lexicon, str(tmp_path))
    stored = tables.read_table(spark, str(tmp_path), "by_form")
    forms = tables.read_table(spark, str(tmp_path), "forms")
    assert tables.entries(stored, forms).count() == stored.count()
    assert tables.lost(stored, forms.filter("uid != 7")).first().lost == stored.filter("lexeme_no = %d" % forms.filter("uid = 7").first().lexeme_no).count()


def test_streaming_postings(spark, lexicon, tmp_path):
    from lexweave.streaming import postings as S

    forms = lexicon.forms.select("lexeme_no", "form_no", *index.FORM_CARRY, "word")
    forms.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(forms.schema).parquet(str(tmp_path / "in"))
    S.append_postings(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == lexicon.by_form.count()


def test_empty_tables(spark, lexicon):
    none = L.Lexicon(lexicon.lexemes_all.limit(0), lexicon.forms_all.limit(0))
    assert none.by_form.count() == 0 and none.by_gloss.count() == 0
    assert paradigm.panels(none.lexemes, none.forms).count() == 0
