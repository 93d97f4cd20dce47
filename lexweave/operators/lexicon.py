"""A dictionary as a bundle of DataFrames: first-wins lexemes, their forms, gloss fallback, uids, corpora and indexes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import glosses as G
from ..functions import greek
from ..session import durable, spread
from . import index
from .joins import key_counts, split_join

MIN_UID = 100_000


def first_wins(lexemes: DataFrame) -> DataFrame:
    """Of lexemes with the same word, the first in file order. One row a word is kept on the map side, so a word may stand
    on any part of all rows. Lexemes without a word are left out."""
    kept = lexemes.filter("word is not null and word != ''").groupBy("word").agg(F.min("lexeme_no").alias("lexeme_no")).select("lexeme_no")
    return lexemes.join(kept, "lexeme_no", "left_semi")


def _own(lexemes: DataFrame) -> DataFrame:
    return lexemes.select("lexeme_no", F.col("word").alias("lexeme_word"), F.col("glosses").alias("lexeme_glosses"))


def forms_with(forms: DataFrame, lexemes: DataFrame) -> DataFrame:
    """Forms whose lexeme is kept, with what ranking and fallback need of it, and _first, the number of its first form;
    forms without a word are left out. A lexeme may have any part of all forms."""
    kept = forms.filter("word is not null and word != ''")
    counts = key_counts(kept, "lexeme_no", F.min("form_no").alias("_first"))
    heads = _own(lexemes).join(counts.select("lexeme_no", "_first"), "lexeme_no")
    return split_join(kept, heads, "lexeme_no", ["form_no"], counts=counts)


def with_lexeme(forms: DataFrame, lexemes: DataFrame) -> DataFrame:
    """Forms with what ranking and fallback need of their lexeme, which may be missing."""
    return split_join(forms, _own(lexemes), "lexeme_no", ["form_no"], "left")


def effective_entries(lang: str) -> Column:
    """Entries of the form's first gloss in lang, else of its lexeme's."""
    return F.coalesce(G.entries_of("glosses", lang), G.entries_of("lexeme_glosses", lang))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gloss_tokens(forms: DataFrame, lang: str = "en", carry: tuple[str, ...] = (), marked: bool = False) -> DataFrame:
    """(lexeme_no, form_no, token, carry...): the tokens under which forms are found by gloss.

    A lexeme's first form (with its lexeme's glosses if it has none) gives all its tokens in ASCII lower case, repeats
    included. The other forms give each token of their own glosses once a lexeme, as written, if the first form has
    none that is equal. Stopwords only count where they are a whole entry. Forms that are marked have the number of the
    first form in _first; else it is found among the forms given.

    One aggregation by lexeme and token, combined before the shuffle, finds both: a token of the first form counts its
    repeats, another one keeps its first place.
    """
    if not marked:
        counts = key_counts(forms, "lexeme_no", F.min("form_no").alias("_first"))
        forms = split_join(forms.drop("_first"), counts.drop("n"), "lexeme_no", ["form_no"], counts=counts)
    primary = F.col("form_no") == F.col("_first")
    own = F.flatten(F.transform(F.filter("glosses", lambda g: g["lang"] == lang), lambda g: g["entries"]))
    kept = ("lexeme_no", "form_no", *carry)
    entry = forms.select(*kept, primary.alias("_primary"), F.posexplode(F.when(primary, effective_entries(lang)).otherwise(own)).alias("_i", "_entry"))
    token = entry.select(*kept, "_primary", "_i", "_entry", F.posexplode(G.tokens("_entry")).alias("_j", "_token"))
    spelled = token.withColumn("_token", F.when(F.col("_primary"), _ascii_lower(F.col("_token"))).otherwise(F.col("_token")))
    usable = spelled.filter(G.keep_gloss_token(F.col("_token"), F.col("_entry")))
    place = F.struct((~F.col("_primary")).alias("_other"), "form_no", "_i", "_j", *carry)
    once = usable.groupBy("lexeme_no", F.col("_token").alias("token")).agg(F.min(place).alias("_at"), F.sum(F.col("_primary").cast("long")).alias("_repeats"))
    rows = once.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), "_repeats"))))
    return rows.select("lexeme_no", F.col("_at.form_no").alias("form_no"), "token", *[F.col(f"_at.{c}").alias(c) for c in carry])


def transliterations(forms: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(lexeme_no, form_no, token, carry...): forms under their Latin spelling; those without any are left out."""
    return forms.select("lexeme_no", "form_no", greek.transliterated("word").alias("token"), *carry).filter("token != ''")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with _no from 1 in the given order, dealt by partitions of the range-sorted rows, not by one task."""
    # Written once: the partition of a row must be the same wherever it is used.
    dealt = durable(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = F.broadcast(sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.join(starts, "_p").withColumn("_no", F.col("_start") + inside).drop("_p", "_start")


def assign_uids(rows: DataFrame, order: list[str], used: DataFrame, least: int = MIN_UID) -> DataFrame:
    """rows with uid_new: their uid, or for a missing one or one below least a number above all used ones, by order."""
    good = F.coalesce(F.col("uid") >= least, F.lit(False))
    top = used.agg(F.greatest(F.max("uid"), F.lit(least - 1)).cast("long").alias("_top"))
    fresh = numbered(rows.filter(~good), order).join(F.broadcast(top)).withColumn("uid_new", F.col("_top") + F.col("_no"))
    return rows.filter(good).withColumn("uid_new", F.col("uid").cast("long")).unionByName(fresh.drop("_top", "_no"))


def glossed(lexemes: DataFrame) -> DataFrame:
    """Lexemes with at least one gloss: what an export of glossed words keeps."""
    return lexemes.filter(F.size("glosses") > 0)


@dataclass
class Lexicon:
    """Lexemes and forms as loaded; everything else is made when asked for."""

    lexemes_all: DataFrame
    forms_all: DataFrame

    @cached_property
    def lexemes(self) -> DataFrame:
        return first_wins(spread(self.lexemes_all))

    @cached_property
    def forms(self) -> DataFrame:
        return index.form_rank_columns(forms_with(spread(self.forms_all), self.lexemes))

    def written(self) -> Lexicon:
        """The same lexicon with its lexemes and forms written once, for work that uses them several times."""
        out = Lexicon(self.lexemes_all, self.forms_all)
        out.__dict__["lexemes"] = durable(self.lexemes)
        out.__dict__["forms"] = durable(index.form_rank_columns(forms_with(spread(self.forms_all), out.lexemes)))
        return out

    @cached_property
    def by_form(self) -> DataFrame:
        return index.postings(self.forms, index.FORM_SPEC)

    @cached_property
    def by_lexeme(self) -> DataFrame:
        items = self.lexemes.withColumns({"sort_key": greek.sort_key("word"), "n_glosses": F.greatest(F.coalesce(F.size("glosses"), F.lit(0)), F.lit(0))})
        return index.postings(items, index.LEXEME_SPEC)

    @cached_property
    def by_transliteration(self) -> DataFrame:
        return index.postings(transliterations(self.forms, index.FORM_CARRY), index.GLOSS_SPEC)

    @cached_property
    def by_gloss(self) -> DataFrame:
        """Gloss tokens and, as they are looked up together, transliterations."""
        tokens = gloss_tokens(self.forms, carry=index.FORM_CARRY, marked=True)
        return index.postings(tokens.unionByName(transliterations(self.forms, index.FORM_CARRY)), index.GLOSS_SPEC)
