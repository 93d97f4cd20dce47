"""Queries of the operators for training data, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import durable
from . import dedupe, encoding, lookalikes, mixing, packing, spam, terms


def _tables(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf}/{n}.parquet") for n in names]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    lexemes, forms = _tables(spark, sf, "lexemes", "forms")
    return encoding.garbled_records(lexemes, forms)


def p1_restored(spark: SparkSession, sf: str) -> DataFrame:
    lexemes, forms = _tables(spark, sf, "lexemes", "forms")
    return encoding.garbled_texts(lexemes, forms).select("field", "lexeme_no", "form_no", "text", "restored", "swap")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    (lexemes,) = _tables(spark, sf, "lexemes")
    return dedupe.formatting_copies(lexemes)


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    (lexemes,) = _tables(spark, sf, "lexemes")
    return dedupe.collapse_copies(lexemes).select("lexeme_no", "word", "n_copies")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    lexemes, forms = _tables(spark, sf, "lexemes", "forms")
    return terms.term_frequencies(lexemes, forms).filter("mark is not null").select("field", "term", "mark")


def p3_terms(spark: SparkSession, sf: str) -> DataFrame:
    lexemes, forms = _tables(spark, sf, "lexemes", "forms")
    return terms.term_frequencies(lexemes, forms).select("field", "term", "occurrences", "records", "mark")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    lexemes, forms = _tables(spark, sf, "lexemes", "forms")
    return lookalikes.lookalike_records(lexemes, forms)


def p5_forms(spark: SparkSession, sf: str) -> DataFrame:
    lexemes, forms = _tables(spark, sf, "lexemes", "forms")
    return lookalikes.consistent_values(lexemes, forms).select("field", "lexeme_no", "form_no", "form")


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    lexemes, forms = _tables(spark, sf, "lexemes", "forms")
    return lookalikes.lookalike_groups(lexemes, forms)


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    (documents,) = _tables(spark, sf, "documents")
    return packing.pack_documents(documents)


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    documents, targets = _tables(spark, sf, "documents", "mix_targets")
    return mixing.mix_documents(documents, targets)


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    documents, targets = _tables(spark, sf, "documents", "mix_targets")
    return mixing.mix_shares(durable(mixing.mix_documents(documents, targets)), targets)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    (documents,) = _tables(spark, sf, "documents")
    return spam.spam_posts(documents)


QUERIES = {"p8_found": p8_found, "p6_containers": p6_containers, "p7_mix": p7_mix, "p7_shares": p7_shares, "p5_found": p5_found, "p5_forms": p5_forms, "p5_groups": p5_groups, "p1_found": p1_found, "p1_restored": p1_restored, "p2_found": p2_found, "p2_records": p2_records, "p3_found": p3_found, "p3_terms": p3_terms}

_CLEAN = r"replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{M}}\p{{Nd}}]', '', 'g'), 'ς', 'σ')"
_COPIES = f"""
with entry as (
  select lexeme_no, coalesce(g.lang, '') as k, {_CLEAN.format("e")} as e
  from (select lexeme_no, g, unnest(g.entries) as e from (select lexeme_no, unnest(glosses) as g from lexemes))),
bag as (select lexeme_no, list([k, e] order by k, e) as es from entry where e <> '' group by lexeme_no),
whole as (
  select l.lexeme_no, l.word, min(l.lexeme_no) over w as first_no, count(*) over w as n_copies
  from lexemes l left join bag b on l.lexeme_no = b.lexeme_no
  window w as (partition by coalesce(l.lang, ''), {_CLEAN.format("l.word")}, {_CLEAN.format("l.root")}, b.es))
"""
_TERMS = r"""
with term as (
  select 'gloss_entries' as field, src, r, unnest(regexp_split_to_array(e, '[ \t\r\n()\[\],.\-;:{}?!/\\&%+=]+')) as term
  from (select src, r, unnest(g.entries) as e from (
    select 'l' as src, row_number() over () as r, unnest(glosses) as g from lexemes
    union all select 'f', row_number() over (), unnest(glosses) from (select glosses from forms)))
  union all select 'form_word', 'f', row_number() over (), word from forms where word is not null),
one as (
  select field, src, r, term, count(*) as n from term where term is not null and (term <> '' or field = 'form_word') group by all),
total as (
  select 'gloss_entries' as field, (select count(*) from lexemes where len(glosses) > 0) + (select count(*) from forms where len(glosses) > 0) as total
  union all select 'form_word', (select count(*) from forms where word is not null)),
marked as (
  select o.field, o.term, sum(n)::bigint as occurrences, count(*) as records,
    case when count(*) = 1 then 'rare' when count(*) * 200 > any_value(total) then 'common' end as mark
  from one o join total t on o.field = t.field group by o.field, o.term)
"""
SQL = {
    "p2_found": _COPIES + "select first_no, lexeme_no as copy_no from whole where first_no <> lexeme_no",
    "p2_records": _COPIES + "select lexeme_no, word, n_copies from whole where first_no = lexeme_no",
    "p3_found": _TERMS + "select field, term, mark from marked where mark is not null",
    "p3_terms": _TERMS + "select * from marked",
}
