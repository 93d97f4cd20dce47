"""Loading by kind of file, random columns, event-time counts, and custom indexes."""

import random

from pyspark.sql import functions as F

from lexweave import sources
from lexweave.functions import randoms
from lexweave.operators import index
from lexweave.sources import binary, tables
from test_lexicon import LINES


def test_load_tells_files_apart(spark, tmp_path):
    (tmp_path / "a.txt").write_text(LINES)
    lexicon = sources.load_lexicon(spark, str(tmp_path / "a.txt")).written()
    binary.write_binary(lexicon, str(tmp_path / "a.bin"))
    tables.write_tables(lexicon, str(tmp_path / "t"))
    words = sorted(r.word for r in lexicon.forms.collect())
    for path in ("a.bin", "t"):
        again = sources.load_lexicon(spark, str(tmp_path / path))
        assert sorted(r.word for r in again.forms.collect()) == words


def test_stored_posting_lists_are_whole(spark, tmp_path):
    """More than sixty forms of one prefix."""
    words = ["λα" + a + b for a in "αβγδεζηθικ" for b in "αβγδεζηθικ"]
    (tmp_path / "a.txt").write_text("\n".join(["λέων|el|800000|Noun|ὁ|||||||", *(f"  {w}|N-NSM|no|{300000 + i}||" for i, w in enumerate(words))]))
    lexicon = sources.load_lexicon(spark, str(tmp_path / "a.txt")).written()
    for path, limit in (("t", {}), ("top", {"limit": index.MAX_RESULTS})):
        tables.write_tables(lexicon, str(tmp_path / path), **limit)
        ranks = [r["rank"] for r in tables.read_table(spark, str(tmp_path / path), "by_form").filter("keyword = 'λα'").collect()]
        assert sorted(ranks) == list(range(1, (limit or {"limit": len(words)})["limit"] + 1))


def test_long_files_keep_their_order(spark, tmp_path):
    """A file that is read in many splits: each form finds the lexeme before it."""
    rng = random.Random(4)
    lines, want, current = [], [], None
    for i in range(6000):
        if i == 0 or rng.random() < 0.1:
            current = f"w{'abcdefghij'[i % 10]}x" + "y" * (i % 37) + "z" * (i // 370)
            lines.append(f"{current}|el|{200000 + i}|Noun|ὁ|||||||")
        else:
            lines.append(f"  f|N-NSM|no|{300000 + i}||")
            want.append((300000 + i, current))
    (tmp_path / "big.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        from lexweave.sources.text import read_lexicon

        lexemes, forms = read_lexicon(spark, str(tmp_path / "big.txt"))
        got = {r.uid: r.lw for r in forms.join(lexemes.select("lexeme_no", F.col("word").alias("lw")), "lexeme_no").select("uid", "lw").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(want)


def test_randoms_repeat(spark):
    df = spark.range(1000).select(randoms.u24(F.col("id"), 1).alias("a"), randoms.string(F.col("id"), 8, 2).alias("b"))
    rows = df.collect()
    assert rows == df.collect()
    assert all(0 <= r.a < 1 << 24 and r.b.isalnum() and len(r.b) == 8 for r in rows) and len({r.b for r in rows}) == 1000


def test_event_time_counts(spark, tmp_path):
    from lexweave.streaming.postings import windowed_keyword_counts

    rows = [(1, 1, "λέων", "2024-01-01 10:00:00"), (1, 2, "λέων", "2024-01-01 11:00:00"), (1, 3, "ὁρῶ", "2024-01-02 10:00:00")]
    df = spark.createDataFrame(rows, "lexeme_no long, form_no int, word string, t string").withColumn("loaded_at", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = windowed_keyword_counts(stream)
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert {(r.keyword, r.n) for r in spark.table("counts").collect()} == {("λέων", 2), ("ὁρῶ", 1)}


def test_custom_items_and_hot_prefix(spark):
    """An index of other items; a prefix that all share is cut to its best before it is shuffled."""
    items = spark.createDataFrame([(i, f"ab{i}") for i in range(3000)], "thing long, name string")
    spec = index.IndexSpec(("thing",), "name", lambda: (F.col("thing").desc(),))
    top = index.ranked(index.postings(items, spec), spec, 3)
    assert [r.thing for r in top.filter("keyword = 'ab'").orderBy("rank").collect()] == [2999, 2998, 2997]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_stored_indexes_are_used(spark, tmp_path):
    """Posting lists come from the file, by uid or by form, and equal those made anew."""
    (tmp_path / "a.txt").write_text(LINES)
    lexicon = sources.load_lexicon(spark, str(tmp_path / "a.txt")).written()
    binary.write_binary(lexicon, str(tmp_path / "a.bin"))
    tables.write_tables(lexicon, str(tmp_path / "t"))
    cols = ["keyword", "tier", "rank", "uid"]
    for path in ("a.bin", "t"):
        again = sources.load_lexicon(spark, str(tmp_path / path))
        assert "by_form" in again.__dict__ and "by_form" not in sources.load_lexicon(spark, str(tmp_path / path), stored_indexes=False).__dict__
        for name, spec in (("by_form", index.FORM_SPEC), ("by_gloss", index.GLOSS_SPEC)):
            got, want = (sorted(map(tuple, index.ranked(getattr(x, name), spec).select(*cols).collect())) for x in (again, lexicon))
            assert got == want and len(got) > 5
    stored = binary.read_binary(spark, str(tmp_path / "a.bin"), "postings")
    some = lexicon.forms.filter("uid != 7")
    assert tables.lost_uids(stored, some).first().lost == stored.filter("uid = 7").count() > 0
    assert tables.by_uid(stored, some).count() == stored.filter("uid != 7").count()
    other = binary._parse("forms", binary.FORM.fieldNames())  # as on another file system
    content = spark.read.format("binaryFile").load(str(tmp_path / "a.bin")).select("content")
    assert sorted(r.word for r in content.mapInArrow(other, binary.FORM).collect()) == sorted(r.word for r in lexicon.forms.collect())


def test_of_forms_with_one_uid_the_last_counts(spark):
    forms = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (2, 3, None), (1, 2, 0)], "lexeme_no long, form_no int, uid int")
    assert {tuple(r) for r in tables.by_form_uid(forms).collect()} == {(5, 2, 1), (0, 2, 3)}


def test_too_many_forms_of_a_lexeme_for_the_binary_file(spark, tmp_path):
    import pytest

    from lexweave.operators.lexicon import Lexicon
    from lexweave.schemas import FORM, LEXEME

    lexemes = spark.createDataFrame([(1, 1, "a", "el") + (None,) * 9], LEXEME)
    forms = spark.range(1 << 16).select(*[{"lexeme_no": F.lit(1), "form_no": F.col("id"), "word": F.lit("a")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FORM.fields])
    with pytest.raises(ValueError, match="65536 forms"):
        binary.write_binary(Lexicon(lexemes, forms), str(tmp_path / "a.bin"))


def test_books_are_read_under_their_names_only(spark):
    from lexweave.functions import references as R

    names = {"song": "SongOfSolomon", "1 samuel-k": "1Sam-K", "2samk": "2Sam-K", "1 jn": "1 John", "pss": "Psalms", "1 jo": None, "1 es": None, "1 th": None}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", R.book_name(R.book_code(F.upper("n"))).alias("b")).collect()
    assert {r.n: None if r.b == "Unknown" else r.b for r in got} == names


def test_add_gloss(spark):
    from lexweave.functions import glosses as G

    df = spark.createDataFrame([(1, [("en", ["a"]), ("es", None), ("en", ["b"])]), (2, None), (3, [("es", None)])], "i int, g array<struct<lang:string,entries:array<string>>>")
    got = {r.i: [(g.lang, g.entries) for g in r.x] for r in df.select("i", G.add_gloss("g", "en", F.lit("x")).alias("x")).collect()}
    assert got == {1: [("en", ["a", "x"]), ("es", None), ("en", ["b"])], 2: [("en", ["x"])], 3: [("es", None), ("en", ["x"])]}
    assert {r.i: r.x[0].entries for r in df.select("i", G.add_gloss("g", "es", F.lit("y")).alias("x")).collect()}[3] == ["y"]
