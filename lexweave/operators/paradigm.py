"""Paradigms: the form of a lexeme with a given parsing, its primary form, and its tables of grammatical forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morphology as M
from .joins import dealt, key_counts, repeated, split_join, with_parts

# The parsings, in order, of which the first that occurs is a lexeme's primary form.
PRIMARY = {2: "V-PAI-1S V-PEI-1S V-PMI-1S V-PPI-1S V-FAI-1S V-AAI-1S V-IAI-1S".split(), 3: "N-NSM N-NSF N-NSN".split(), 4: "A-NSM A-NSF A-NSN".split()}


def form_by_parsing(forms: DataFrame, wanted: DataFrame) -> DataFrame:
    """forms (lexeme_no, form_no, parsing, preferred, n_glosses, n_refs) and wanted (lexeme_no, parsing, ...) to the
    wanted rows with form_no, the chosen form.

    Of a lexeme's forms with the parsing only the first run in order counts. In it a preferred form wins, else one with
    glosses over one without, else the one with fewer references; a later one must be strictly better. So the choice
    starts at the last preferred form (or the first), and of that and the later ones, those with glosses if there are
    any, the first with the fewest references stands at the end. That takes minima and maxima only, which combine before
    the shuffle; where forms meet what was found of their lexeme, a large lexeme is dealt to several tasks: it may have any
    number of forms.
    """
    at = ["lexeme_no", "parsing"]
    counts = key_counts(forms, "lexeme_no")
    marked = dealt(with_parts(forms, counts), ["form_no"])
    parts = F.max("_parts").alias("_parts")
    keys = repeated(with_parts(wanted.select(*at).distinct(), counts))
    hits = marked.select(*at, "form_no", F.coalesce("preferred", F.lit(False)).alias("preferred"), (F.col("n_glosses") > 0).alias("glossed"), "n_refs", "_parts", "_salt").join(keys, [*at, "_salt"])
    start = repeated(hits.groupBy(*at).agg(F.min("form_no").alias("_start"), parts))
    other = marked.select("lexeme_no", "_salt", "_parts", F.col("parsing").alias("_other"), F.col("form_no").alias("_no"))
    later = other.join(start, ["lexeme_no", "_salt"]).filter((F.col("_no") > F.col("_start")) & ~F.col("_other").eqNullSafe(F.col("parsing")))
    end = repeated(later.groupBy(*at).agg(F.min("_no").alias("_end"), parts))
    run = hits.join(end, [*at, "_salt"], "left").filter(F.col("_end").isNull() | (F.col("form_no") < F.col("_end")))
    base = repeated(run.groupBy(*at).agg(F.coalesce(F.max(F.when(F.col("preferred"), F.col("form_no"))), F.min("form_no")).alias("_base"), parts))
    best = F.min(F.struct("n_refs", "form_no"))
    chosen = run.join(base, [*at, "_salt"]).filter("form_no >= _base").groupBy(*at, "glossed").agg(best.alias("best")).groupBy(*at).agg(F.max_by("best.form_no", "glossed").alias("form_no"))
    return wanted.join(chosen, at)


def primary_parsings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(pos, i, M.parse_byzantine(tag)) for pos, tags in PRIMARY.items() for i, tag in enumerate(tags)], "pos int, priority int, parsing int")


def primary_form(lexemes: DataFrame, forms: DataFrame) -> DataFrame:
    """(lexeme_no, form_no): the form that stands at the head of a lexeme's tables; none for lexemes without forms."""
    pos = lexemes.select("lexeme_no", M.field("pos", "pos").alias("pos"))
    wanted = pos.join(F.broadcast(primary_parsings(lexemes.sparkSession)), "pos")  # a fixed list of 13
    found = form_by_parsing(forms, wanted).groupBy("lexeme_no").agg(F.min_by("form_no", "priority").alias("_primary"))
    first = forms.groupBy("lexeme_no").agg(F.min("form_no").alias("_first"))
    return lexemes.select("lexeme_no").join(first, "lexeme_no").join(found, "lexeme_no", "left").select("lexeme_no", F.coalesce("_primary", "_first").alias("form_no"))


def _verb_panels() -> list[tuple[str, str, int, int, int]]:
    """(title, subtitle, tense, voice, mood) of the finite panels in order, by the codes of the packed record."""
    active, middle, passive, indicative, subjunctive, imperative = 1, 2, 3, 1, 2, 4
    tense = {"Present": 1, "Future": 2, "Aorist": 3, "Imperfect": 4, "Perfect": 5, "Pluperfect": 6}
    out = [(t, "Active", tense[t], active, indicative) for t in ("Present", "Future", "Imperfect", "Aorist", "Perfect", "Pluperfect")]
    for voice, name in ((active, "Active"), (middle, "Mid"), (passive, "Psv")):
        out += [("Subjunctive", f"{t} {name}", tense[t], voice, subjunctive) for t in ("Present", "Aorist")]
    out.append(("Infinitive", "", 0, 0, 5))
    out += [("Present", "Passive", 1, passive, indicative), ("Future", "Middle", 2, middle, indicative), ("Future", "Passive", 2, passive, indicative)]
    out += [("Imperfect", "Passive", 4, passive, indicative), ("Aorist", "Passive", 3, passive, indicative)]
    for voice, name in ((active, "Active"), (passive, "Psv")):
        out += [("Imperative", f"{t} {name}", tense[t], voice, imperative) for t in ("Present", "Aorist")]
    return out


def panel_slots() -> list[tuple]:
    """The slots of all panels: (kind, panel_no, title, subtitle, gender, side, slot, pos, tense, voice, mood, person,
    number, case, slot_gender); kinds are verb, noun, pronoun and adjective, and 0 stands for unknown."""
    rows: list[tuple] = []
    for no, (title, subtitle, tense, voice, mood) in enumerate(_verb_panels(), 1):
        if title == "Infinitive":
            cells = [("top", 0, 1, 1), ("top", 1, 3, 1), ("bottom", 0, 1, 3), ("bottom", 1, 3, 3)]
            rows += [("verb", no, title, subtitle, 0, side, i, 2, t, v, mood, 0, 0, 0, 0) for side, i, t, v in cells]
            continue
        persons = (2, 3) if mood == 4 else (1, 2, 3)
        rows += [("verb", no, title, subtitle, 0, side, i, 2, tense, voice, mood, p, n, 0, 0) for side, n in (("top", 1), ("bottom", 3)) for i, p in enumerate(persons)]
    for kind, pos in (("noun", 3), ("adjective", 4)):
        for no, (title, gender) in enumerate((("Masculine", 1), ("Feminine", 2), ("Neuter", 4)), 1):
            # The order nominative, genitive, dative, accusative.
            rows += [(kind, no, title, "", gender, side, i, pos, 0, 0, 0, 0, n, c, gender) for side, n in (("top", 1), ("bottom", 3)) for i, c in enumerate((1, 3, 4, 2))]
    for person in (1, 2):
        for k, (title, referent) in enumerate((("Singular", 11), ("Plural", 12))):
            # The order nominative, accusative, genitive, dative.
            rows += [("pronoun", 2 * person - 1 + k, title, "", 0, "top", i, 13, referent, 0, 0, person, 0, c, 0) for i, c in enumerate((1, 2, 3, 4))]
    return rows


SLOTS = "kind string, panel_no int, title string, subtitle string, gender int, side string, slot int, pos int, tense int, voice int, mood int, person int, number int, case int, slot_gender int"


def _voices(voice: Column) -> Column:
    """Voices that a form counts as: deponents as their voice, middle-or-passive as both."""
    return F.when(voice == 1, F.array(F.lit(1))).when(voice.isin(2, 5), F.array(F.lit(2))).when(voice.isin(3, 6), F.array(F.lit(3))).when(voice.isin(4, 7), F.array(F.lit(2), F.lit(3))).otherwise(F.array().cast("array<int>"))


def panel_cells(lexemes: DataFrame, forms: DataFrame) -> DataFrame:
    """(lexeme_no, kind, panel_no, title, subtitle, gender, side, slot, form_no, word): the filled cells of all lexemes'
    tables; the first form in order fills a cell. Tables without cells don't come out.

    Forms are classified by what they are, then joined with the fixed list of slots, which is broadcast.
    """
    slots = lexemes.sparkSession.createDataFrame(panel_slots(), SLOTS)
    pos = M.field("pos", "pos")
    indeclinable = M.field("pos", "indeclinable") == 1
    kind = F.when(pos == 2, "verb").when((pos == 3) | ((pos == 7) & ~indeclinable), "noun").when(pos == 13, "pronoun").when(pos == 4, "adjective")
    kinds = lexemes.select("lexeme_no", kind.alias("kind")).filter("kind is not null")
    f = lambda n: M.field("parsing", n)
    cells = split_join(forms, kinds, "lexeme_no", ["form_no"]).select(
        "lexeme_no", "kind", "form_no", "word", f("pos").alias("pos"), f("tense").alias("tense"), f("mood").alias("mood"), f("person").alias("person"),
        f("number").alias("number"), f("case").alias("case"), f("gender").alias("slot_gender"), f("voice").alias("_v"),
    )
    verbs = cells.filter("kind = 'verb'").withColumn("voice", F.explode(_voices(F.col("_v")))).withColumn("person", F.when(F.col("mood") == 5, 0).otherwise(F.col("person"))).withColumn("number", F.when(F.col("mood") == 5, 0).otherwise(F.col("number")))
    verb_hits = verbs.drop("case", "slot_gender").join(F.broadcast(slots.drop("case", "slot_gender")), ["kind", "pos", "tense", "voice", "mood", "person", "number"])
    nominal = slots.filter("kind in ('noun', 'adjective')").drop("tense", "voice", "mood", "person")
    nominal_hits = cells.drop("tense", "mood", "person").join(F.broadcast(nominal), ["kind", "pos", "case", "number", "slot_gender"])
    pronoun = slots.filter("kind = 'pronoun'").drop("voice", "mood", "number", "slot_gender")
    pronoun_hits = cells.drop("mood", "number", "slot_gender").join(F.broadcast(pronoun), ["kind", "pos", "tense", "person", "case"])
    keep = ["lexeme_no", "kind", "panel_no", "title", "subtitle", "gender", "side", "slot"]
    hits = verb_hits.select(*keep, "form_no", "word").unionByName(nominal_hits.select(*keep, "form_no", "word")).unionByName(pronoun_hits.select(*keep, "form_no", "word"))
    best = hits.groupBy(*keep).agg(F.min(F.struct("form_no", "word")).alias("f"))
    return best.select(*keep, "f.form_no", "f.word")


def panels(lexemes: DataFrame, forms: DataFrame) -> DataFrame:
    """(lexeme_no, kind, panel_no, title, subtitle, gender, top, bottom): tables with arrays of words by slot, null where
    a cell is empty."""
    cells = panel_cells(lexemes, forms)
    grouped = cells.groupBy("lexeme_no", "kind", "panel_no", "title", "subtitle", "gender").agg(
        *[F.map_from_entries(F.collect_list(F.when(F.col("side") == side, F.struct("slot", "word")))).alias(f"_{side}") for side in ("top", "bottom")]
    )
    row = lambda side: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.try_element_at(F.col(f"_{side}"), i))
    return grouped.select("lexeme_no", "kind", "panel_no", "title", "subtitle", "gender", row("top").alias("top"), row("bottom").alias("bottom"))
