"""Lines that fail and lines that load."""

import pytest
from pyspark.sql import functions as F

from lexweave.sources import lines as L

LEX = "λέων|el|800000|Noun|ὁ|||||||"
CASES = [
    (LEX, []),
    ("  λέων|N-NSM|yes|1||", []),
    ("\tλέων|n-nsm|yes|1||", []),
    ('  "λέων"|"N-NSM"|yes|1||"a|b"', []),
    ('λέων|el|1|Noun|ὁ||||||"a ""b"" | c"|', []),
    ("", None),
    (" \t ", None),
    (None, None),
    ("  λέων|N-NSM|yes|1|", ["columns"]),
    ("λέων", ["columns"]),
    ('  λέ"ων|N-NSM|yes|1||', ["quoting"]),
    ('  "λέων"x|N-NSM|yes|1||', ["quoting"]),
    ('  "λέων|N-NSM|yes|1||', ["quoting"]),
    ("  |N-XYZ|yes|1||", ["word", "parsing"]),
    ("  λέων1||yes|1||", ["word"]),
    ("  λέ�ων|N-NSM|yes|1||", ["word"]),
    ("λέων|el|1|Noun|ὁ||5,0||||||"[:-1], ["strongs"]),
    ("λέων|el|1|Noun|ὁ||65536||||||"[:-1], ["strongs"]),
    ("λέων|el|1|Noun|ὁ||00012, 7||||||"[:-1], []),
    ("λ" * 250 + "|el|1|Noun|ὁ|||||||", ["word"]),
    ("  " + "x" * 200_000 + "|N-NSM|yes|1||", ["word"]),
    ('  λέων|N-NSM|yes|1|"' + '""' * 50_000 + '"|', []),
]


@pytest.fixture(scope="module")
def classified(spark):
    lines = spark.createDataFrame([(i, "f", i, c[0], "x") for i, c in enumerate(CASES)], "line_id long, file_name string, line_no int, line string, tag string")
    tags = spark.createDataFrame([("N-NSM", 42), (None, 1), ("N-NSM", 42)], "tag string, packed int")
    return L.classify_lines(lines, tags)


def test_reasons(classified):
    got = {r.line_id: r.reasons for r in classified.select("line_id", "reasons").collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: c[1] for i, c in enumerate(CASES)}


def test_lines_of_very_many_fields(spark):
    rows = [(1, LEX), (2, "|" * 25_000), (3, "  λέων" + "|x" * 25_000), (4, "λέων" + "|x" * 12), (5, "  λέων" + "|" * 6), (6, 'a|"b"' + "|" * 25_000)]
    lines = spark.createDataFrame([(i, "f", i, t) for i, t in rows], "line_id long, file_name string, line_no int, line string")
    got = {(r.line_id, r.reason) for r in L.rejected_lines(lines, spark.createDataFrame([("N-NSM", 42)], "tag string, packed int")).collect()}
    assert got == {(i, "columns") for i in range(2, 7)}


def test_no_character_shortens_a_line(spark):
    """Any character of the basic plane, in the first and in the last field, loads as it stands."""
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and chr(c) not in '|"']
    rows = [(i, "f", i, f"w{c}w|N-NSM|yes|1||r{c}s" if k else f"w{c}w|el|1|Noun|ὁ||||||t|{c}") for i, (c, k) in enumerate((c, k) for c in chars for k in (0, 1))]
    lines = spark.createDataFrame([(i, f, n, "  " + t if i % 2 else t) for i, f, n, t in rows], "line_id long, file_name string, line_no int, line string")
    got = {r.line_id: r.fields for r in L.classify_lines(lines, spark.createDataFrame([("N-NSM", 42)], "tag string, packed int")).collect()}
    assert [t for i, _, _, t in rows if got[i] != t.split("|")] == []


def test_many_tags_are_joined(spark, monkeypatch):
    lines = spark.createDataFrame([(1, "f", 1, "  a|N-NSM|||  |"), (2, "f", 2, "  a|N-XXX||||"), (3, "f", 3, "  a|||||"), (4, "f", 4, "a" + "|" * 11)], "line_id long, file_name string, line_no int, line string")
    tags = spark.createDataFrame([("N-NSM", 42), ("N-NSF", 43)], "tag string, packed int")
    def seen():
        return {(r.line_id, r.packed, tuple(r.reasons)) for r in L.classify_lines(lines, tags).collect()}

    small = seen()
    monkeypatch.setattr(L, "BROADCAST_TAGS", 1)
    assert seen() == small == {(1, 42, ()), (2, 0, ("parsing",)), (3, 0, ()), (4, None, ())}


def test_quoted_fields(classified):
    rows = {r.line_id: r.fields for r in classified.select("line_id", "fields").collect()}
    assert rows[3] == ["λέων", "N-NSM", "yes", "1", "", "a|b"]
    assert rows[4][10] == 'a "b" | c'


def test_loading(classified):
    assert [r.word for r in L.load_lexemes(classified).filter("line_id in (0, 4)").collect()] == ["λέων", "λέων"]
    forms = {r.line_id: (r.lexeme_line, r.lexeme_valid, r.parsing) for r in L.load_forms(classified).collect()}
    assert forms[1] == (0, True, 42) and forms[2] == (0, True, 42)
    assert forms[21] == (19, False, 42)


def test_lexeme_lines_carry_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_LINES", 7)
    rows = [(i, "f" if i % 2 else None, i, LEX if i % 23 in (0, 1) else "  λέων|N-NSM|yes|1||") for i in range(200)]
    lines = spark.createDataFrame(rows, "line_id long, file_name string, line_no int, line string")
    tags = spark.createDataFrame([("N-NSM", 42)], "tag string, packed int")
    got = {r.line_id: r.lexeme_line for r in L.load_forms(L.classify_lines(lines, tags)).collect()}
    for i, f, n, line in rows:
        if line != LEX:
            before = [r[2] for r in rows if r[1] == f and r[2] <= n and r[3] == LEX]
            assert got[i] == (max(before) if before else None)


def test_empty(spark, classified):
    empty = spark.createDataFrame([], "line_id long, file_name string, line_no int, line string")
    tags = spark.createDataFrame([], "tag string, packed int")
    assert L.rejected_lines(empty, tags).count() == 0
    assert L.load_forms(L.classify_lines(empty, tags)).count() == 0
