"""Queries of the dictionary, its index, morphology and text functions, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import betacode, greek, hashing
from ..functions import glosses as G
from ..functions import lexicon_fields as fields
from ..functions import morphology as M
from ..functions import references as R
from ..operators import index, paradigm
from ..operators import lexicon as L
from ..session import durable, table_folder
from ..sources import load_lexicon, tables, text


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lexicon(spark: SparkSession, sf: str) -> L.Lexicon:
    return L.Lexicon(_read(spark, sf, "lexemes"), _read(spark, sf, "forms"))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Different words of the forms: far fewer than forms, so functions of words run on them."""
    return _read(spark, sf, "forms").select("word").filter("word is not null and word != ''").distinct()


def word_keys(spark, sf):
    w = F.col("word")
    return _words(spark, sf).select("word", greek.accented(w).alias("accented"), greek.unaccented(w).alias("unaccented"), greek.lowercased(w).alias("lowercased"), greek.sort_key(w).alias("sort_key"), greek.normalised_chars(w).alias("normalised"))


def transliterate(spark, sf):
    return _words(spark, sf).select("word", greek.transliterated("word").alias("plain"), greek.transliterated("word", True).alias("marked"))


def prefix_keywords(spark, sf):
    return greek.keyword_rows(_words(spark, sf), "word").groupBy("tier", "keyword").agg(F.count("*").alias("n"))


def collation_rank(spark, sf):
    keyed = _words(spark, sf).withColumn("sort_key", greek.sort_key("word"))
    return L.numbered(keyed, ["sort_key", "word"]).select("word", F.col("_no").alias("rank"))


def form_collation_rank(spark, sf):
    """All forms in the order of the dictionary: collation, preferred first, more glosses first."""
    forms = _read(spark, sf, "forms").filter("word is not null and word != ''")
    keyed = forms.select("lexeme_no", "form_no", "word", greek.sort_key("word").alias("sort_key"), F.when(F.coalesce("preferred", F.lit(False)), 0).otherwise(1).alias("rest"), (-F.greatest(F.coalesce(F.size("glosses"), F.lit(0)), F.lit(0))).alias("fewer"))
    return L.numbered(keyed, ["sort_key", "word", "rest", "fewer", "lexeme_no", "form_no"]).select("lexeme_no", "form_no", F.col("_no").alias("rank"))


def part_name_index(spark, sf):
    """An index of other items in another order: parts by name, dearest first."""
    spec = index.IndexSpec(("p_partkey",), "p_name", lambda: (F.col("p_retailprice").desc(),), ("p_retailprice",))
    return index.ranked(index.postings(_read(spark, sf, "part"), spec), spec, 5).select("keyword", "tier", "rank", "p_partkey")


def autocomplete(spark, sf):
    """The ten best forms that begin like the words of lexemes with a number divisible by 100."""
    lex = _lexicon(spark, sf)
    asked = lex.lexemes.filter("lexeme_no % 100 = 0").select(F.substr("word", F.lit(1), F.lit(3)).alias("query")).distinct()
    hits = index.lookup(asked, "query", lex.by_form).filter(F.col("tier") == index.PARTIAL).drop("query").distinct()
    return index.ranked(hits, index.FORM_SPEC, 10).select("keyword", "rank", "lexeme_no", "form_no")


def text_export(spark, sf):
    """The dictionary as lines of the text format."""
    lex = _lexicon(spark, sf).written()
    return text.text_lines(lex.lexemes, lex.forms)


def gloss_token_counts(spark, sf):
    rows = _read(spark, sf, "lexemes").select(F.explode("glosses").alias("g")).select("g.lang", F.explode("g.entries").alias("entry"))
    tokens = rows.select("lang", "entry", F.explode(G.tokens("entry")).alias("token")).filter(G.keep_gloss_token(F.col("token"), F.col("entry")))
    return tokens.groupBy("lang", "token").agg(F.count("*").alias("n"))


def stopword_ratio(spark, sf):
    tokens = _read(spark, sf, "documents").select("lang", F.explode(G.tokens("text")).alias("token"))
    return tokens.groupBy("lang").agg(F.count("*").alias("tokens"), F.sum(G.is_stopword("token").cast("long")).alias("stopwords"))


def betacode_words(spark, sf):
    """All that stands between white space in the posts, read as betacode, or why it can't be."""
    tokens = _read(spark, sf, "documents").select(F.explode(F.split("text", r"[ \t\r\n\x0B\f]+")).alias("token")).filter("token != ''").distinct()
    return tokens.select("token", betacode.to_greek("token").alias("r")).select("token", "r.greek", "r.error")


def postings_top60(spark, sf):
    return index.ranked(_lexicon(spark, sf).by_form, index.FORM_SPEC, index.MAX_RESULTS).select("keyword", "tier", "rank", "lexeme_no", "form_no")


def postings_lexeme_top60(spark, sf):
    return index.ranked(_lexicon(spark, sf).by_lexeme, index.LEXEME_SPEC, index.MAX_RESULTS).select("keyword", "tier", "rank", "lexeme_no")


def postings_gloss_top60(spark, sf):
    return index.ranked(_lexicon(spark, sf).written().by_gloss, index.GLOSS_SPEC, index.MAX_RESULTS).select("keyword", "tier", "rank", "lexeme_no", "form_no")


def postings_stored(spark, sf):
    """The posting lists as written to tables with the dictionary, loaded with it again."""
    path = table_folder(spark)
    tables.write_tables(_lexicon(spark, sf), path, indexes=("by_form",))
    return index.ranked(load_lexicon(spark, path).by_form, index.FORM_SPEC, index.MAX_RESULTS).select("keyword", "tier", "rank", "lexeme_no", "form_no")


def postings_by_uid(spark, sf):
    """Posting lists that keep uids only, as in the binary form, with their forms looked up."""
    lex = _lexicon(spark, sf).written()
    kept = durable(index.ranked(lex.by_form, index.FORM_SPEC, index.MAX_RESULTS).select("keyword", "tier", "rank", "uid"))
    return tables.by_uid(kept, lex.forms).select("keyword", "tier", "rank", "lexeme_no", "form_no")


def posting_fanout(spark, sf):
    return _lexicon(spark, sf).by_form.groupBy("tier").agg(F.count("*").alias("postings"), F.countDistinct("keyword").alias("keywords"))


def gloss_index_tokens(spark, sf):
    return L.gloss_tokens(_lexicon(spark, sf).written().forms).groupBy("lexeme_no", "form_no", "token").agg(F.count("*").alias("n"))


def lookup_with_fallback(spark, sf):
    """The entries of the words (in capitals) of lexemes with a number divisible by 100, against the index of all forms."""
    lex = _lexicon(spark, sf)
    asked = lex.lexemes.filter("lexeme_no % 100 = 0").select(F.col("lexeme_no").alias("query_no"), F.upper("word").alias("query"))
    hits = index.lookup(asked, "query", lex.by_form)
    return hits.groupBy("query_no", "keyword", "tier").agg(F.count("*").alias("n"), F.min(F.struct("lexeme_no", "form_no")).alias("f")).select("query_no", "keyword", "tier", "n", "f.lexeme_no", "f.form_no")


def first_wins_dedupe(spark, sf):
    return _lexicon(spark, sf).lexemes.select("lexeme_no", "word", "uid")


def assign_uids(spark, sf):
    forms = _read(spark, sf, "forms")
    return L.assign_uids(forms.select("lexeme_no", "form_no", "uid"), ["lexeme_no", "form_no"], forms.select("uid")).select("lexeme_no", "form_no", "uid_new")


def gloss_fallback(spark, sf):
    forms = L.with_lexeme(_read(spark, sf, "forms"), _read(spark, sf, "lexemes"))
    return forms.select("lexeme_no", "form_no", F.array_join(L.effective_entries("en"), "; ").alias("entries"))


def gloss_string(spark, sf):
    rows = _read(spark, sf, "lexemes").select("lexeme_no", F.posexplode("glosses").alias("i", "g"))
    return rows.select("lexeme_no", "i", "g.lang", G.gloss_string("g.entries").alias("text"))


def gloss_text(spark, sf):
    return _read(spark, sf, "lexemes").select("lexeme_no", G.gloss_text("glosses").alias("text"))


def has_tag(spark, sf):
    return _read(spark, sf, "lexemes").select("lexeme_no", G.has_tag("tags", "FOOD").alias("food"))


def glossed_lexemes(spark, sf):
    return L.glossed(_read(spark, sf, "lexemes")).select("lexeme_no")


def parse_byzantine(spark, sf):
    read = _read(spark, sf, "parsing_tags").select("tag", M.parse_tag("tag").alias("p"))
    return read.select("tag", "p.packed", "p.error")


def format_byzantine(spark, sf):
    packed = _read(spark, sf, "forms").filter("parsing is not null").groupBy("parsing").agg(F.count("*").alias("n"))
    return packed.select("parsing", M.format_tag("parsing").alias("tag"), "n")


def unpack_parsing(spark, sf):
    return _read(spark, sf, "parsing_tags").select("tag", M.unpacked("packed").alias("u")).select("tag", "u.*")


def pack_parsing(spark, sf):
    fields_ = _read(spark, sf, "parsing_tags").select("tag", "packed", M.unpacked("packed").alias("u"))
    return fields_.select("tag", M.packed(**{n: F.col(f"u.{n}") for n in M.FIELDS}).alias("packed"), (M.packed(**{n: F.col(f"u.{n}") for n in M.FIELDS}) == F.col("packed")).alias("same"))


# How the three positional notations write the parts of speech (by code) and the order of the fields after them.
_NOTATIONS = {
    "cntr": ({2: "V", 3: "N", 4: "A", 10: "E", 5: "D", 6: "C", 8: "P", 11: "I", 1: "X"}, "       ", "mood tense voice person case gender number", ""),
    "morphgnt": ({2: "V-", 3: "N-", 4: "A-", 10: "RA", 15: "RR", 16: "RD", 5: "D-", 6: "C-", 8: "P-", 11: "I-", 1: "X-"}, " ", "person tense voice mood case number gender", "-"),
    "ccat": ({2: "VX", 3: "N ", 4: "A ", 10: "RA", 15: "RR", 16: "RD", 5: "D", 6: "C", 8: "P", 11: "I", 1: "X"}, "  ", "", ""),
}


def _positional(spark, sf, notation: str) -> DataFrame:
    """The valid tags that a positional notation has too, written in it, and the same with an unknown part of speech or
    case; then read."""
    names, gap, order, end = _NOTATIONS[notation]
    p = lambda n: M.field("packed", n)
    pick = lambda letters, n: F.substr(F.lit(letters), p(n) + 1, F.lit(1))
    plain = (p("number") != 2) & (p("crasis") == 0) & (p("interrogative") == 0) & (p("negative") == 0) & (p("correlative") == 0) & (p("indefinite") == 0) & (p("indeclinable") == 0)
    known = plain & p("pos").isin([*names]) & (p("tense") <= 6) & (p("voice") <= 3) & ((p("pos") == 2) | p("gender").isin(0, 1, 2, 4))
    tags = _read(spark, sf, "parsing_tags").filter(known)
    parts = {"mood": pick(".ISOMNP", "mood"), "tense": pick(".PFAIEL", "tense"), "voice": pick(".AMP", "voice"), "person": pick(".123", "person"), "case": pick(".NAGDV", "case"), "gender": pick(".MF.N", "gender"), "number": pick(".S.P", "number")}
    written = F.concat(*[parts[n] for n in order.split()]) if order else F.lit("")
    if notation == "ccat":
        nominal = F.concat(parts["case"], parts["number"], parts["gender"])
        verbal = F.concat(parts["tense"], parts["voice"], parts["mood"], F.when(p("mood") == 6, nominal).when(p("mood") == 5, F.lit("")).otherwise(F.concat(pick(" 123", "person"), pick(" S P", "number"))))
        written = F.when(p("pos") == 2, verbal).when(p("case") > 0, nominal).otherwise(F.lit(""))
    text = F.concat(fields.mapped(p("pos"), names), F.lit(gap), written, F.lit(end))
    bad = F.when((p("case") > 0) & (p("pos") != 2), F.concat(fields.mapped(p("pos"), names), F.lit(gap), F.translate(written, "NAGDV", "ZZZZZ"), F.lit(end)))
    texts = tags.select(F.explode(F.array_compact(F.array(text, F.concat(F.lit("Q"), text), bad))).alias("text")).distinct()
    return texts.select("text", M.parse_tag("text", notation).alias("r")).select("text", F.col("r.packed").alias("read"), "r.error")


def parse_cntr(spark, sf):
    return _positional(spark, sf, "cntr")


def parse_morphgnt(spark, sf):
    return _positional(spark, sf, "morphgnt")


def parse_ccat(spark, sf):
    return _positional(spark, sf, "ccat")


def _refs(spark, sf) -> DataFrame:
    return _read(spark, sf, "forms").select("lexeme_no", "form_no", F.posexplode("refs").alias("i", "ref"))


def parse_reference(spark, sf):
    texts = _refs(spark, sf).select(R.reference_text(F.col("ref")).alias("text")).distinct()
    return texts.select("text", R.parse_reference("text").alias("r")).select("text", R.module_name(F.col("r.module")).alias("module"), R.book_name(F.col("r.book")).alias("book"), "r.chapter", "r.verse", "r.word")


def concordance(spark, sf):
    rows = _refs(spark, sf)
    named = rows.select(R.module_name(R.module_code(F.col("ref.module"))).alias("module"), R.book_name(R.book_code(F.col("ref.book"))).alias("book"), "ref.chapter")
    return named.groupBy("module", "book", "chapter").agg(F.count("*").alias("n"))


def modules(spark, sf):
    return R.module_dim(spark)


def books(spark, sf):
    return R.book_dim(spark)


def articles(spark, sf):
    return _read(spark, sf, "lexemes").groupBy(fields.mapped(F.col("article"), fields.GENDERS).alias("gender")).agg(F.count("*").alias("n"))


def parts_of_speech(spark, sf):
    labels = {i: M.english_label(i) for i in range(len(fields.PARTS_OF_SPEECH))}
    return _read(spark, sf, "lexemes").groupBy(fields.mapped(M.field("pos", "pos"), labels).alias("label")).agg(F.count("*").alias("n"))


def farmhash64(spark, sf):
    return _words(spark, sf).select("word", hashing.farmhash64("word").alias("hash"))


def farmhash_vectors(spark, sf):
    """Texts whose fingerprints are published."""
    texts = ["test", "3true", "1footrue", "2applefalse", "test" * 8, "test" * 64]
    return spark.createDataFrame([(t,) for t in texts], "text string").select("text", hashing.farmhash64("text").alias("hash"))


def add_gloss(spark, sf):
    """Each lexeme's word as one more English gloss."""
    return _read(spark, sf, "lexemes").select("lexeme_no", G.gloss_text(G.add_gloss("glosses", "en", F.coalesce("word", F.lit("")))).alias("text"))


def primary_form(spark, sf):
    lex = _lexicon(spark, sf).written()
    return paradigm.primary_form(lex.lexemes, lex.forms)


def panel_cells(spark, sf):
    lex = _lexicon(spark, sf).written()
    return paradigm.panel_cells(lex.lexemes, lex.forms).select("lexeme_no", "kind", "panel_no", "side", "slot", "form_no", "word")


def panel_tables(spark, sf):
    lex = _lexicon(spark, sf).written()
    tables = paradigm.panels(lex.lexemes, lex.forms)
    flat = lambda c: F.array_join(c, ",", "-").alias(c)
    return tables.select("lexeme_no", "kind", "panel_no", "title", "subtitle", flat("top"), flat("bottom"))


QUERIES = {
    f.__name__: f
    for f in (
        word_keys, transliterate, prefix_keywords, collation_rank, form_collation_rank, part_name_index, autocomplete, text_export, gloss_token_counts, stopword_ratio, betacode_words, postings_top60, postings_lexeme_top60, postings_gloss_top60,
        postings_stored, postings_by_uid, posting_fanout, gloss_index_tokens, lookup_with_fallback, first_wins_dedupe, assign_uids, gloss_fallback, gloss_string, gloss_text, has_tag, glossed_lexemes, parse_byzantine,
        format_byzantine, unpack_parsing, pack_parsing, parse_cntr, parse_morphgnt, parse_ccat, parse_reference, concordance, modules, books, articles, parts_of_speech, farmhash64, farmhash_vectors, add_gloss,
        primary_form, panel_cells, panel_tables,
    )
}
