"""The lossless form of a lexicon: Parquet tables of lexemes, forms and posting lists; and stored posting lists, by form or
by uid, put together with their forms again."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from ..operators.joins import split_join
from ..operators.lexicon import Lexicon

NAMES = ("lexemes", "forms", "by_form", "by_lexeme", "by_gloss", "by_transliteration")
#: Indexes of forms, each of which may be stored with a lexicon.
OF_FORMS = ("by_form", "by_gloss", "by_transliteration")


def write_tables(lexicon: Lexicon, path: str, limit: int | None = None, indexes: Sequence[str] = NAMES[2:]) -> None:
    """Tables under path, with the given indexes. Posting lists are ranked, whole unless there is a limit, and laid out by keyword, so that a lookup
    reads few row groups. Without a limit, one task sorts (and spills) the list of a keyword."""
    lexicon = lexicon.written()
    lexicon.lexemes.write.mode("overwrite").parquet(f"{path}/lexemes")
    lexicon.forms.select(*lexicon.forms_all.columns).write.mode("overwrite").parquet(f"{path}/forms")
    specs = {"by_form": index.FORM_SPEC, "by_lexeme": index.LEXEME_SPEC, "by_gloss": index.GLOSS_SPEC, "by_transliteration": index.GLOSS_SPEC}
    for name, spec in ((n, specs[n]) for n in indexes):
        rows = index.ranked(getattr(lexicon, name), spec, limit).select("keyword", "tier", "rank", *spec.ids)
        rows.repartitionByRange("keyword").sortWithinPartitions("keyword", "tier", "rank").write.mode("overwrite").parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    if name not in NAMES:
        raise ValueError(name)
    return spark.read.parquet(f"{path}/{name}")


def read_postings(spark: SparkSession, path: str, names: Sequence[str] = OF_FORMS) -> DataFrame:
    """(index, keyword, tier, rank, lexeme_no, form_no) of the stored indexes of forms."""
    return reduce(DataFrame.unionByName, [read_table(spark, path, n).withColumn("index", F.lit(n)) for n in names])


def by_form_uid(forms: DataFrame) -> DataFrame:
    """(uid, lexeme_no, form_no): the form of each uid, of forms with the same one the last. A missing uid counts as 0."""
    return forms.groupBy(F.coalesce("uid", F.lit(0)).alias("uid")).agg(F.max(F.struct("lexeme_no", "form_no")).alias("_f")).select("uid", "_f.lexeme_no", "_f.form_no")


def by_uid(stored: DataFrame, forms: DataFrame) -> DataFrame:
    """Posting lists that name forms by uid, with lexeme_no and form_no instead; postings of missing forms drop out."""
    named = stored.withColumn("uid", F.coalesce("uid", F.lit(0)))
    return split_join(named, by_form_uid(forms), "uid", ["keyword", "tier", "rank"]).drop("uid")


def lost_uids(stored: DataFrame, forms: DataFrame) -> DataFrame:
    """One row with the number of postings whose uid no form has."""
    known = forms.select(F.coalesce("uid", F.lit(0)).alias("uid")).distinct()
    return stored.withColumn("uid", F.coalesce("uid", F.lit(0))).join(known, "uid", "left_anti").agg(F.count("*").alias("lost"))


def entries(stored: DataFrame, forms: DataFrame) -> DataFrame:
    """Stored posting lists with their forms; postings of missing forms drop out. A form may stand in any part of them."""
    return split_join(stored, forms, ["lexeme_no", "form_no"], ["keyword", "tier"])


def lost(stored: DataFrame, forms: DataFrame) -> DataFrame:
    """One row with the number of postings whose form is missing."""
    return stored.join(forms, ["lexeme_no", "form_no"], "left_anti").agg(F.count("*").alias("lost"))


def with_indexes(lexicon: Lexicon, stored: DataFrame, key: str, names: Sequence[str] = OF_FORMS) -> Lexicon:
    """lexicon with its indexes of forms from stored posting lists (index, keyword, tier, rank, and uid or lexeme_no and
    form_no by key) instead of made anew; others are made when asked for."""
    placed = by_uid(stored, lexicon.forms) if key == "uid" else stored
    carried = lexicon.forms.select("lexeme_no", "form_no", *index.FORM_CARRY)
    for name in names:
        own = placed.filter(F.col("index") == name).select("keyword", "tier", "lexeme_no", "form_no")
        lexicon.__dict__[name] = entries(own, carried)
    return lexicon
