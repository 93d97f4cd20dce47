"""The two-level text format: lexeme lines, each followed by its indented form lines, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import glosses as G
from ..functions import greek
from ..functions import lexicon_fields as fields
from ..functions import morphology as M
from ..functions import references as R
from ..operators.joins import key_counts, split_join
from ..session import durable
from .lines import BLOCK_LINES, FORM_FIELDS, LEXEME_FIELDS, _with_lexeme_line


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, line_no, line) of text files of any size; line_no grows along a file but has gaps.

    Files are split for reading; a line's number is its split's first byte plus its place in the split, so that numbers
    grow from split to split. Only one row a split is gathered.
    """
    place = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("_start"), place.alias("_place"))
    first = lines.groupBy("file_name", "_start").agg(F.min("_place").alias("_first"))
    return lines.join(first, ["file_name", "_start"]).select("file_name", (F.col("_start") + F.col("_place") - F.col("_first")).alias("line_no"), F.col("value").alias("line"))


def _field(i: int) -> Column:
    return F.coalesce(F.get("fields", F.lit(i)), F.lit(""))


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines (file_name, line_no, line) to (lexemes, forms), both with error, null for good rows. lexeme_no is the
    lexeme's place over all files (file, then line), form_no the form's place in its lexeme."""
    kept = lines.filter(F.regexp_like("line", F.lit(r"[^ \t\r]")))
    # White space before the first line of a file doesn't indent it.
    counts = key_counts(kept, "file_name", F.min("line_no").alias("_start"))
    indented = F.regexp_like("line", F.lit("^[ \\t]"))
    split = split_join(kept, counts.drop("n"), "file_name", ["line_no"], counts=counts).select("file_name", "line_no", (indented & (F.col("line_no") != F.col("_start"))).alias("is_form"), F.split(F.regexp_replace("line", r"^[ \t]+|\r\z", ""), r"\|", -1).alias("fields"))
    placed = _with_lexeme_line(split)
    f = _field
    first_error = lambda *pairs: F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in pairs])
    given = lambda c: c != ""
    lexemes = placed.filter(~F.col("is_form")).select(
        "file_name", "line_no", f(0).alias("word"), fields.lang_code(f(1)).alias("lang"), F.coalesce(fields.u24(f(2)), F.lit(0)).alias("uid"), fields.pos_code(f(3)).alias("pos"),
        fields.article_code(f(4)).alias("article"), f(5).alias("genitive_suffix"), fields.strongs_list(f(6)).alias("strongs"), f(7).alias("root"), fields.gloss_list(f(8)).alias("glosses"),
        f(9).alias("adjective"), fields.tag_list(f(10)).alias("tags"), f(11).alias("note"),
        first_error(
            (f(0) == "", "EmptyWord"),
            (F.size("fields") < len(LEXEME_FIELDS), "MissingField"),
            (given(f(2)) & fields.u24(f(2)).isNull(), "InvalidU24"),
            (fields.article_code(f(4)).isNull(), "InvalidGender"),
            (F.exists(F.filter(F.split(f(6), "[, ]+"), lambda s: s != ""), lambda s: ~fields.is_u16(s)), "InvalidU16"),
        ).alias("error"),
    )
    numbered = lexemes.orderBy("file_name", "line_no").withColumn("lexeme_no", F.monotonically_increasing_id())
    parsed = M.parse_tag(F.when(given(f(1)), f(1)))
    refs = F.filter(F.split(f(5), ","), lambda r: F.trim(r) != "")
    forms = placed.filter("is_form").select(
        "file_name", "line_no", "lexeme_line", f(0).alias("word"), F.coalesce(parsed["packed"], F.lit(0)).alias("parsing"), F.coalesce(fields.boolean(f(2)), F.lit(False)).alias("preferred"),
        F.lit(False).alias("incorrect"), F.coalesce(fields.u24(f(3)), F.lit(0)).alias("uid"), fields.gloss_list(f(4)).alias("glosses"), fields.reference_list(f(5)).alias("refs"),
        first_error(
            (f(0) == "", "EmptyWord"),
            (F.size("fields") < len(FORM_FIELDS), "MissingField"),
            (parsed["error"].isNotNull(), "InvalidParsing"),
            (given(f(2)) & fields.boolean(f(2)).isNull(), "InvalidBoolean"),
            (given(f(3)) & fields.u24(f(3)).isNull(), "InvalidU24"),
            (F.exists(refs, lambda r: R.parse_reference(F.trim(r)).isNull()), "InvalidReference"),
        ).alias("error"),
    )
    return numbered, forms


def read_lexicon(spark: SparkSession, path: str, mode: str = "FAILFAST") -> tuple[DataFrame, DataFrame]:
    """(lexemes, forms) of text files. FAILFAST raises on the first bad row that is read; PERMISSIVE keeps bad rows with
    their error. A missing path is an error."""
    lexemes, forms = parse_lines(read_lines(spark, path))
    if mode.upper() == "FAILFAST":
        checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("error"), F.lit(" in line: "), F.col("word")))).otherwise(F.col("error"))
        lexemes, forms = lexemes.withColumn("error", checked), forms.withColumn("error", checked)
    # Numbers follow the sorted rows; written once, so that they are the same for lexemes and forms.
    lexemes = durable(lexemes)
    keys = lexemes.select("file_name", F.col("line_no").alias("lexeme_line"), "lexeme_no")
    numbered = _number_forms(forms)
    forms = split_join(numbered, keys, ["file_name", "lexeme_line"], ["line_no"], "left")
    return lexemes.drop("file_name", "line_no"), forms.drop("file_name", "line_no", "lexeme_line")


def _number_forms(forms: DataFrame) -> DataFrame:
    """Adds form_no, the place of a form among those of its lexeme line. A lexeme's forms are numbered in blocks of lines,
    and each block starts after those before (one row a block), so that a lexeme may have any number of forms."""
    own = ["file_name", F.coalesce("lexeme_line", F.lit(-1)).alias("_own"), F.floor(F.col("line_no") / BLOCK_LINES).alias("_block")]
    blocks = forms.groupBy(*own).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file_name", "_own").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file_name", "_own", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("file_name", "_own", "_block").orderBy("line_no"))
    placed = forms.select("*", *own[1:]).withColumn("_inside", inside).join(starts, ["file_name", "_own", "_block"])
    return placed.withColumn("form_no", (F.col("_before") + F.col("_inside")).cast("int")).drop("_own", "_block", "_before", "_inside")


def lexeme_line(pos_label: Column | None = None) -> Column:
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    labels = {code: M.english_label(code, spaced=False) for code in range(30)}
    article = {0: "", 1: "ὁ", 2: "ἡ", 3: "ὁ ἡ", 4: "τό", 5: "ὁ τό", 7: "ὁ ἡ τό"}
    label = F.coalesce(fields.mapped(M.field("pos", "pos"), labels), F.lit("")) if pos_label is None else pos_label
    return F.concat_ws(
        "|", c("word"), c("lang"), c("uid"), label, F.coalesce(fields.mapped(F.col("article"), article), F.lit("")), c("genitive_suffix"),
        F.array_join(F.coalesce("strongs", F.array().cast("array<int>")).cast("array<string>"), ","), c("root"), F.coalesce(G.gloss_text("glosses"), F.lit("")), c("adjective"),
        F.coalesce(F.array_join("tags", ", "), F.lit("")), c("note"),
    )


def form_line() -> Column:
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    refs = F.array_join(F.transform("refs", R.reference_text), ",")
    return F.concat(F.lit("  "), F.concat_ws("|", c("word"), F.coalesce(M.format_tag("parsing"), F.lit("")), F.when(F.coalesce("preferred", F.lit(False)), "true").otherwise("false"), c("uid"), F.coalesce(G.gloss_text("glosses"), F.lit("")), F.coalesce(refs, F.lit(""))))


def text_lines(lexemes: DataFrame, forms: DataFrame, only_glossed: bool = False) -> DataFrame:
    """(line) rows in order: lexemes in collation order, each followed by its forms. Lines are sorted as rows, so no
    lexeme's forms have to fit in memory."""
    kept = lexemes.filter(F.size("glosses") > 0) if only_glossed else lexemes
    keyed = kept.withColumns({"_key": greek.sort_key("word"), "_g": F.greatest(F.coalesce(F.size("glosses"), F.lit(0)), F.lit(0))})
    heads = keyed.select("_key", F.col("word").alias("_word"), "_g", "lexeme_no", F.lit(0).alias("_form"), lexeme_line().alias("line"))
    places = keyed.select("lexeme_no", "_key", F.col("word").alias("_word"), "_g")
    tails = split_join(forms, places, "lexeme_no", ["form_no"]).select("_key", "_word", "_g", "lexeme_no", F.col("form_no").alias("_form"), form_line().alias("line"))
    return heads.unionByName(tails).orderBy("_key", "_word", "_g", "lexeme_no", "_form").select("line")


def write_lexicon(lexemes: DataFrame, forms: DataFrame, path: str, only_glossed: bool = False, one_file: bool = False) -> None:
    """Text files whose names sort in the order of their lines; Spark's committer replaces the target as a whole."""
    lines = text_lines(lexemes, forms, only_glossed)
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)
