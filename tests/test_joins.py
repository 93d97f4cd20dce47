"""Joins and numbering where one key holds half of all rows."""

import pytest
from pyspark.sql import functions as F

from lexweave.operators import lexicon as L
from lexweave.operators import paradigm
from lexweave.operators.joins import key_counts, split_join
from lexweave.session import gathered
from lexweave.sources import text


@pytest.fixture
def shuffled(spark):
    """No broadcasts and no merging of small partitions, so that tasks show how rows are dealt."""
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(spark, n=8000):
    return spark.range(n).select(F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 97).cast("long").alias("k"), F.col("id").alias("v"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_is_a_join(spark, shuffled, how):
    rows, heads = rows_of(spark), spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("h"))
    want = sorted(map(tuple, rows.join(heads, "k", how).collect()), key=repr)
    assert sorted(map(tuple, split_join(rows, heads, "k", ["v"], how, rows_a_task=100).collect()), key=repr) == want
    assert sorted(map(tuple, split_join(rows, heads, "k", ["v"], how, key_counts(rows, "k"), 100).select("k", "v", "h").collect()), key=repr) == want
    assert split_join(rows.limit(0), heads, "k", ["v"], how).count() == 0


def test_no_task_gets_a_large_key(spark, shuffled):
    """Of 8,000 rows, half with one key and a tenth without any, no task gets much more than an even share."""
    joined = split_join(rows_of(spark), spark.range(97).select(F.col("id").alias("k")), "k", ["v"], "left", rows_a_task=100)
    sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 8000 and max(sizes) < 1800


def test_a_large_lexeme_is_dealt(spark, shuffled, monkeypatch):
    lexemes = spark.createDataFrame([(i, f"w{i}", None) for i in range(60)], "lexeme_no long, word string, glosses array<struct<lang:string,entries:array<string>>>")
    forms = spark.range(6000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 60).cast("long").alias("lexeme_no"), F.col("id").cast("int").alias("form_no"), F.lit("a").alias("word"))
    want = {tuple(r) for r in L.forms_with(forms, lexemes).select("lexeme_no", "form_no", "_first", "lexeme_word").collect()}
    assert len(want) == 6000
    monkeypatch.setattr(split_join, "__defaults__", ("inner", None, 100))
    dealt = L.forms_with(forms, lexemes)
    assert {tuple(r) for r in dealt.select("lexeme_no", "form_no", "_first", "lexeme_word").collect()} == want
    assert max(r[1] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) < 1500


def test_paradigms_of_a_large_lexeme(spark, shuffled, monkeypatch):
    import random

    rng = random.Random(2)
    rows = [(1 if i % 2 else i % 7, i, rng.randrange(3), rng.random() < 0.1, rng.randrange(2), rng.randrange(3)) for i in range(600)]
    forms = spark.createDataFrame(rows, "lexeme_no long, form_no int, parsing int, preferred boolean, n_glosses int, n_refs int")
    wanted = spark.createDataFrame([(i, p) for i in range(7) for p in range(3)], "lexeme_no long, parsing int")
    want = sorted(map(tuple, paradigm.form_by_parsing(forms, wanted).collect()))
    from lexweave.operators import joins

    monkeypatch.setattr(joins.with_parts, "__defaults__", (20,))
    assert sorted(map(tuple, paradigm.form_by_parsing(forms, wanted).collect())) == want and len(want) == 21


def test_forms_are_numbered_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "BLOCK_LINES", 50)
    lines = ["  orphan|N-NSM|no|1||", "λέων|el|800000|Noun|ὁ|||||||", *(f"  f|N-NSM|no|{300000 + i}||" for i in range(200)), "ὁράω|el|5|Verb||||||||", "  ὁρῶ|V-PAI-1S|no|7||"]
    (tmp_path / "a.txt").write_text("x|el|9|Noun|ὁ|||||||\n" + "\n".join(lines))
    _, forms = text.read_lexicon(spark, str(tmp_path / "a.txt"))
    got = {r.uid: r.form_no for r in forms.collect()}
    assert got == {1: 1, 7: 1} | {300000 + i: i + 1 for i in range(200)}


def test_gathered_rows_stay_together(spark):
    """Also where a join has just brought them together by the same keys and becomes another one at run time."""
    heads = spark.range(20).select(F.col("id").alias("k"))
    rows = spark.range(4000).select((F.col("id") % 20).alias("k"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        tasks = gathered(rows.join(heads, "k"), "k").select("k", F.spark_partition_id().alias("p")).distinct()
        assert tasks.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
