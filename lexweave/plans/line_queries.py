"""Queries of the line loader (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import glosses as G
from ..sources import lines as L


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return L.classify_lines(spark.read.parquet(f"{sf}/raw_lines.parquet"), spark.read.parquet(f"{sf}/parsing_tags.parquet"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    lines, tags = spark.read.parquet(f"{sf}/raw_lines.parquet"), spark.read.parquet(f"{sf}/parsing_tags.parquet")
    return L.rejected_lines(lines, tags).select("line_id", "reason")


def _references(refs) -> Column:
    """References as text, field by field."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.array_join(F.transform(refs, lambda r: F.concat_ws("/", text(r["module"]), text(r["book"]), text(r["chapter"]), text(r["verse"]), text(r["word"]))), ",")


def p4_lexemes(spark: SparkSession, sf: str) -> DataFrame:
    """The lexemes of the valid lines, gloss and list columns as text."""
    d = L.load_lexemes(_classified(spark, sf))
    lists = [F.concat_ws(",", "strongs").alias("strongs"), G.gloss_text("glosses").alias("glosses"), F.concat_ws(",", "tags").alias("tags")]
    return d.select("line_id", "word", "lang", "uid", "pos", "article", "genitive_suffix", "root", "adjective", "note", *lists)


def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    d = L.load_forms(_classified(spark, sf))
    return d.select("line_id", "lexeme_line", "lexeme_valid", "word", "parsing", "preferred", "uid", G.gloss_text("glosses").alias("glosses"), _references("refs").alias("refs"))


QUERIES = {"p4_found": p4_found, "p4_lexemes": p4_lexemes, "p4_forms": p4_forms}

_FIELD = '(?:"[^"]*(?:""[^"]*)*"|[^"|]*)'
_FIELDS = rf"""
with kept as (
  select *, regexp_matches(line, '^[ \t]') as is_form, regexp_replace(line, '^[ \t]+', '') as body
  from raw_lines where regexp_matches(coalesce(line, ''), '[^ \t]')),
quoted as (
  select *, not regexp_full_match(body, '{_FIELD}(\|{_FIELD})*') as bad_quote from kept),
cut as (
  select *, list_transform(regexp_extract_all('|' || body, '\|({_FIELD})', 1),
    lambda x: case when x[1] = '"' then replace(x[2:length(x) - 1], '""', '"') else x end) as f
  from quoted where not bad_quote),
counted as (select *, len(f) <> (case when is_form then 6 else 12 end) as bad_count from cut),
checked as (
  select c.*, t.tag, t.packed,
    regexp_matches(f[1], '^\s*$') or strlen(f[1]) > 499 or regexp_matches(f[1], '[0-9\x00-\x1f\x7f-\x9f\x{{FFFD}}]') as bad_word,
    is_form and f[2] <> '' and t.tag is null as bad_tag,
    not is_form and len(list_filter(regexp_split_to_array(f[7], '[, ]'), lambda p: p <> '' and not (
      regexp_full_match(p, '[0-9]+') and coalesce(try_cast(p as hugeint) between 1 and 65535, false)))) > 0 as bad_strongs
  from counted c left join parsing_tags t on c.is_form and upper(c.f[2]) = t.tag where not bad_count)
"""

# The codes are spelled out here, so that the SQL tells errors in the library's tables.
_LANG = """case lower({0}) when 'he' then 'he' when 'el' then 'el' when 'aaa' then 'aaa' when 'en' then 'en' when 'zh' then 'zh'
  when 'zh_tw' then 'zh' when 'zh_hanst' then 'zh' when 'es' then 'es' when 'ru' then 'ru' when 'uk' then 'ru' when 'ko' then 'ko' end"""
_GLOSSES = f"""case when {{0}} <> '' then array_to_string(list_transform(list_filter(list_transform(string_split({{0}}, '#'), lambda g: string_split(g, ':')),
    lambda p: len(list_filter(p, lambda x: {_LANG.format("x")} is not null)) > 0), lambda p: {_LANG.format("p[at(p)]")} || ':' || array_to_string(list_filter(p[at(p) + 1:], lambda e: e <> ''), ':')), '#') end"""
# at(p) is the place of the first language in p.
_GLOSSES = _GLOSSES.replace("at(p)", f"list_min(list_filter(range(1, len(p) + 1), lambda i: {_LANG.format('p[i]')} is not null))")
_U24 = "case when regexp_full_match({0}, '[0-9]+') and try_cast({0} as int) between 0 and 16777215 then try_cast({0} as int) end"
_POS = r"""coalesce(case when strlen(f[4]) <= 40 and lower(f[4]) <> 'comparativeadjective' then
  case regexp_replace(lower(f[4]), '([a-z])[ _-]([a-z])', '\1\2', 'g')
    when 'unknown' then 0 when 'particle' then 1 when 'verb' then 2 when 'noun' then 3 when 'adjective' then 4 when 'adverb' then 5
    when 'conjunction' then 6 when 'propernoun' then 7 when 'preposition' then 8 when 'conditional' then 9 when 'article' then 10
    when 'definitearticle' then 10 when 'interjection' then 11 when 'pronoun' then 12 when 'personalpronoun' then 13
    when 'possessivepronoun' then 14 when 'relativepronoun' then 15 when 'demonstrativepronoun' then 16 when 'reciprocalpronoun' then 17
    when 'reflexivepronoun' then 18 when 'transliteration' then 19 when 'hebrewtransliteration' then 20 when 'aramaictransliteration' then 21
    when 'letter' then 22 when 'numeral' then 23 when 'superlativeadjective' then 24 when 'superlativeadverb' then 25
    when 'superlativenoun' then 26 when 'comparativeadjective' then 27 when 'comparativeadverb' then 28 when 'comparativenoun' then 29
    when 'interrogativepronoun' then 12 + (1 << 25) when 'indefinitepronoun' then 12 + (1 << 28)
    when 'interrogativeparticle' then 1 + (1 << 25) when 'indeclinablepropernoun' then 7 + (1 << 29) end end, 0)::int"""
_ARTICLE = """case f[5] when '' then 0 when 'ὁ' then 1 when 'ἡ' then 2 when 'ὁ ἡ' then 3 when 'ὁ,ἡ' then 3 when 'τό' then 4 when 'τὸ' then 4
  when 'ὁ τό' then 5 when 'ὁ,τό' then 5 when 'ὁ ἡ τό' then 7 when 'ὁ,ἡ,τό' then 7 end::int"""
_U16 = "case when regexp_full_match({0}, '[0-9]+') and length(ltrim({0}, '0')) <= 5 and try_cast({0} as int) <= 65535 then ({0}::int)::varchar else '' end"
_REF = r"'^(?:([^#]*)#)?([0-9]*[^0-9#,.|\t\n]*?) ?([0-9]+):([0-9]+)(?: ([0-9]+))?.*$'"
_REFS = f"""coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(f[6], ','), lambda r: trim(r)), lambda r: regexp_matches(r, {_REF})),
    lambda r: regexp_extract(r, {_REF}, 1) || '/' || regexp_extract(r, {_REF}, 2) || '/' || {_U16.format(f"regexp_extract(r, {_REF}, 3)")} || '/' ||
      {_U16.format(f"regexp_extract(r, {_REF}, 4)")} || '/' || coalesce(nullif({_U16.format(f"regexp_extract(r, {_REF}, 5)")}, ''), '0')), ','), '')"""

SQL = {
    "p4_lexemes": _FIELDS
    + rf"""
select line_id, f[1] as word, {_LANG.format("f[2]")} as lang, {_U24.format("f[3]")} as uid, {_POS} as pos, {_ARTICLE} as article,
  nullif(f[6], '') as genitive_suffix, array_to_string(list_transform(list_filter(regexp_split_to_array(f[7], '[, ]+'), lambda p: p <> ''), lambda p: p::int), ',') as strongs,
  nullif(f[8], '') as root, {_GLOSSES.format("f[9]")} as glosses, nullif(f[10], '') as adjective,
  array_to_string(list_filter(regexp_split_to_array(f[11], '[" ,\n\r\t]+'), lambda t: t <> '')[1:10], ',') as tags, nullif(f[12], '') as note
from checked where not is_form and not (bad_word or bad_tag or bad_strongs)""",
    "p4_found": _FIELDS
    + """
select line_id, 'quoting' as reason from quoted where bad_quote
union all select line_id, 'columns' from counted where bad_count
union all select line_id, 'word' from checked where bad_word
union all select line_id, 'parsing' from checked where bad_tag
union all select line_id, 'strongs' from checked where bad_strongs""",
    "p4_forms": _FIELDS
    + rf"""
, valid as (select line_id from checked where not (bad_word or bad_tag or bad_strongs)),
placed as (
  select k.line_id, k.is_form, max(case when not k.is_form then k.line_no end) over (partition by k.file_name order by k.line_no) as lexeme_line, k.file_name from kept k),
lex as (select k.file_name, k.line_no from kept k join valid v on k.line_id = v.line_id where not k.is_form)
select c.line_id, p.lexeme_line, l.line_no is not null as lexeme_valid, c.f[1] as word, coalesce(c.packed, 0)::int as parsing,
  case when lower(c.f[3]) in ('true', 'yes') then true when lower(c.f[3]) in ('false', 'no') then false end as preferred,
  {_U24.format("c.f[4]")} as uid, {_GLOSSES.format("c.f[5]")} as glosses, {_REFS} as refs
from checked c join valid v on c.line_id = v.line_id join placed p on p.line_id = c.line_id
left join lex l on l.file_name = p.file_name and l.line_no = p.lexeme_line
where c.is_form""",
}
