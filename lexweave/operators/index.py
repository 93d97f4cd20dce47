"""Search index: ranked posting lists for keywords, and lookups against them.

An index is made of items by IndexSpec: which columns identify an item, which holds its text, and how items of one
posting list are ordered. Postings stay long, one row for each keyword, tier and item. Ranks are only taken where asked
for, and with a limit Spark prunes each task's rows before the shuffle, so that short prefixes, which a large part of
all items share, don't gather in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import greek
from ..session import durable

MAX_RESULTS = 60
EXACT, UNACCENTED, PARTIAL = 1, 2, 3


@dataclass(frozen=True)
class IndexSpec:
    """ids: columns that identify an item; text: the column that is indexed; order: gives the sort columns of a posting
    list, which may use the columns keyword and tier; carry: columns of the item that order or the caller needs; exact_only: those of
    them that only exact tiers need, null in the far more numerous partial postings."""

    ids: tuple[str, ...]
    text: str
    order: Callable[[], tuple[Column, ...]] = tuple
    carry: tuple[str, ...] = field(default=())
    exact_only: tuple[str, ...] = field(default=())


def postings(items: DataFrame, spec: IndexSpec) -> DataFrame:
    """(keyword, tier, ids..., carry...): a row for each keyword of each item; equal items count each."""
    kept = list(dict.fromkeys((*spec.ids, *spec.carry)))
    return greek.keyword_rows(items.select(*kept, F.col(spec.text).alias("_text")), "_text", spec.exact_only)


def ranked(posting_rows: DataFrame, spec: IndexSpec, limit: int | None = None) -> DataFrame:
    """Adds rank within keyword and tier; with a limit, only the first of each list."""
    order = [*spec.order(), *(F.col(c).asc() for c in spec.ids)]
    out = posting_rows.withColumn("rank", F.row_number().over(Window.partitionBy("keyword", "tier").orderBy(*order)))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def lookup(queries: DataFrame, query: str, posting_rows: DataFrame) -> DataFrame:
    """queries joined with the whole entry (all tiers) of their accented key, or else of their unaccented key.

    Queries without an entry, and empty or overlong ones, give no rows. Only keywords that are asked for are looked at.
    """
    asked = queries.filter(F.octet_length(query).between(1, greek.MAX_WORD_BYTES)).select("*", greek.accented(F.col(query)).alias("_a"), greek.unaccented(F.col(query)).alias("_u"))
    keys = asked.select(F.explode(F.array("_a", "_u")).alias("keyword")).distinct()
    # Only the postings that are asked for, written once: they are probed, then joined.
    asked_for = durable(posting_rows.join(keys, "keyword", "left_semi"))
    found = asked_for.select("keyword").distinct()
    a, u = found.select(F.col("keyword").alias("_ka")), found.select(F.col("keyword").alias("_ku"))
    probed = asked.join(a, F.col("_a") == F.col("_ka"), "left").join(u, F.col("_u") == F.col("_ku"), "left")
    hit = probed.select(*queries.columns, F.coalesce("_ka", "_ku").alias("keyword")).filter("keyword is not null")
    return hit.join(asked_for, "keyword")


def form_rank_columns(forms: DataFrame) -> DataFrame:
    """Adds the columns that order forms. Of forms with references most are null, which keeps postings narrow."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    sized = forms.withColumns({"word_bytes": F.octet_length("word"), "n_refs": size("refs"), "n_glosses": size("glosses"), "preferred": F.coalesce("preferred", F.lit(False))})
    bare = F.col("n_refs") == 0
    barest = bare & (F.col("n_glosses") == 0)
    return sized.withColumns({"bare_glosses": F.when(bare, F.col("n_glosses")), "barest_preferred": F.when(barest, F.col("preferred")), "barest_key": F.when(barest, greek.sort_key("word")), "barest_word": F.when(barest, F.col("word"))})


def form_order() -> tuple[Column, ...]:
    """Order of forms: shorter words first, in exact tiers those whose lexeme is the keyword, then more references;
    glosses, preference and collation only decide where both have none of what comes before."""
    match = F.when(F.col("tier") != PARTIAL, F.coalesce(F.col("lexeme_word") == F.col("keyword"), F.lit(False)))
    return F.col("word_bytes").asc(), match.desc(), F.col("n_refs").desc(), F.col("bare_glosses").desc(), F.col("barest_preferred").desc(), F.col("barest_key").asc(), F.col("barest_word").asc(), F.col("uid").asc_nulls_last()


def lexeme_order() -> tuple[Column, ...]:
    """Collation order, then fewer glosses first."""
    return F.col("sort_key").asc(), F.col("word").asc(), F.col("n_glosses").asc()


FORM_CARRY = ("uid", "word_bytes", "n_refs", "bare_glosses", "barest_preferred", "barest_key", "barest_word", "lexeme_word")
FORM_SPEC = IndexSpec(("lexeme_no", "form_no"), "word", form_order, FORM_CARRY, ("lexeme_word",))
LEXEME_SPEC = IndexSpec(("lexeme_no",), "word", lexeme_order, ("word", "sort_key", "n_glosses"))
GLOSS_SPEC = IndexSpec(("lexeme_no", "form_no"), "token", form_order, FORM_CARRY, ("lexeme_word",))
