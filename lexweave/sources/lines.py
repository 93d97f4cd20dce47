"""Lines of lexicon text files: valid lines become lexemes and forms, the others are kept apart with their reasons.

A line is read permissively by from_csv under an explicit schema that retains the raw text of a corrupt line. Lines
that it calls corrupt, and those that hold a quote or a line break inside (on which the reader is lenient) or more
fields than any record, are read again field by field: first the quoting is checked, then the number of fields. The
casts and values of word, parsing tag and Strong's list are checked on every line.

A line of only spaces and tabs, or null, is no record. A null file_name is a file of its own; lines without a line_no
come first in it. All checks are row by row; the only shuffles are those that give a form line its lexeme line, for
which a file is cut into blocks of lines, so that one file may hold any part of all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon_fields as fields
from ..operators.joins import split_join

LEXEME_FIELDS = ("word", "lang", "uid", "pos", "article", "genitive_suffix", "strongs", "root", "glosses", "adjective", "tags", "note")
FORM_FIELDS = ("word", "parsing", "preferred", "uid", "glosses", "refs")
#: Lines of one file that a task orders at once.
BLOCK_LINES = 50_000
MAX_WORD_BYTES = 499
#: Valid tags up to this number are broadcast; more are joined by their text.
BROADCAST_TAGS = 100_000

# A field is quoted or holds no quote; possessive, so that long lines need no stack.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^"|]*+)'
_WELL_QUOTED = rf"^{_FIELD}(?:\|{_FIELD})*+\z"
_EACH = rf"\|({_FIELD})"
# Characters that the reader reads otherwise than as they stand (its end mark and null value among them); also more fields
# than any record has: the reader gives up on lines of very many, and their count is wrong anyway.
_ODD = rf'["\n\r\u0000\u0001\x{{FFFF}}]|^(?:[^|]*+\|){{{len(LEXEME_FIELDS)}}}'
_OPTIONS = {"sep": "|", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "raw", "maxCharsPerColumn": "-1", "nullValue": "\u0001", "emptyValue": ""}


def _permissive(body: Column, names: tuple[str, ...]) -> Column:
    schema = ", ".join(f"{n} string" for n in names) + ", raw string"
    return F.from_csv(body, schema, _OPTIONS)


def _split(body: Column) -> Column:
    """The fields of a well-quoted line, without their quotes."""
    found = F.regexp_extract_all(F.concat(F.lit("|"), body), F.lit(_EACH), F.lit(1))
    plain = lambda x: F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda x: F.when(F.startswith(x, F.lit('"')), plain(x)).otherwise(x))


def classify_lines(lines: DataFrame, tags: DataFrame) -> DataFrame:
    """lines with is_form, fields (array of the line's fields, null if its quoting is broken), packed and reasons (empty
    if the line is valid). tags (tag, packed) is the list of valid tags; where it is small, as it is, it is broadcast."""
    kept = lines.filter(F.regexp_like(F.coalesce("line", F.lit("")), F.lit(r"[^ \t]")))
    is_form = F.regexp_like("line", F.lit(r"^[ \t]"))
    body = F.when(is_form, F.regexp_replace("line", r"^[ \t]+", "")).otherwise(F.col("line"))
    # In steps of their own, so that each parse is evaluated once.
    parsed = kept.select("*", is_form.alias("is_form"), body.alias("_body")).select(
        "*",
        F.regexp_like("_body", F.lit(_ODD)).alias("_odd"),
        F.when(~F.regexp_like("_body", F.lit(_ODD)) & F.col("is_form"), _permissive(F.col("_body"), FORM_FIELDS)).alias("_form"),
        F.when(~F.regexp_like("_body", F.lit(_ODD)) & ~F.col("is_form"), _permissive(F.col("_body"), LEXEME_FIELDS)).alias("_lexeme"),
    )
    array = lambda c, names: F.array(*[F.coalesce(F.col(f"{c}.{n}"), F.lit("")) for n in names])
    read = parsed.select(
        "*",
        F.when(F.col("_form").isNotNull() & F.col("_form.raw").isNull(), array("_form", FORM_FIELDS))
        .when(F.col("_lexeme").isNotNull() & F.col("_lexeme.raw").isNull(), array("_lexeme", LEXEME_FIELDS))
        .when(~F.col("_odd") | F.regexp_like("_body", F.lit(_WELL_QUOTED)), _split(F.col("_body")))
        .alias("fields"),
    ).drop("_form", "_lexeme", "_odd", "_body")

    wanted = F.when(F.col("is_form"), len(FORM_FIELDS)).otherwise(len(LEXEME_FIELDS))
    quoting = F.col("fields").isNull()
    columns = ~quoting & (F.size("fields") != wanted)
    usable = ~quoting & ~columns
    word = F.get("fields", F.lit(0))
    bad_word = F.regexp_like(word, F.lit(r"^\s*\z")) | (F.octet_length(word) > MAX_WORD_BYTES) | F.regexp_like(word, F.lit(r"[0-9\x00-\x1f\x7f-\x9f\x{FFFD}]"))
    bad_strongs = F.exists(
        F.filter(F.split(F.get("fields", F.lit(6)), "[, ]"), lambda p: p != ""),
        lambda p: ~fields.is_u16(p, 1),
    )
    tag = F.when(F.col("is_form") & usable, F.upper(F.get("fields", F.lit(1))))
    known = tags.filter("tag is not null").groupBy(F.col("tag").alias("_key")).agg(F.min("packed").alias("_packed"), F.lit(True).alias("_known"))
    keyed = read.withColumn("_key", tag)
    small = tags.limit(BROADCAST_TAGS + 1).count() <= BROADCAST_TAGS
    joined = keyed.join(F.broadcast(known), "_key", "left") if small else split_join(keyed, known, "_key", ["line_id"], "left")
    bad_tag = F.col("is_form") & (F.col("_key") != "") & F.col("_known").isNull()
    reasons = F.filter(
        F.array(
            F.when(quoting, "quoting"),
            F.when(columns, "columns"),
            F.when(usable & bad_word, "word"),
            F.when(usable & bad_tag, "parsing"),
            F.when(usable & ~F.col("is_form") & bad_strongs, "strongs"),
        ),
        lambda r: r.isNotNull(),
    )
    packed = F.when(F.col("is_form") & usable, F.coalesce("_packed", F.lit(0)))
    return joined.select(*[c for c in read.columns], packed.alias("packed"), reasons.alias("reasons"))


def rejected_lines(lines: DataFrame, tags: DataFrame) -> DataFrame:
    """(line_id, file_name, line_no, line, reason): one row for each reason of a line that fails."""
    return classify_lines(lines, tags).select("line_id", "file_name", "line_no", "line", F.explode("reasons").alias("reason"))


def _with_lexeme_line(rows: DataFrame) -> DataFrame:
    """rows with lexeme_line, the line_no of the last lexeme line at or before it in the file.

    The last lexeme line of each block of lines is carried over the blocks (one row a block), then inside the blocks.
    """
    rows = rows.withColumn("_file", F.coalesce("file_name", F.lit(""))).withColumn("_line", F.coalesce("line_no", F.lit(-1))).withColumn("_block", F.floor(F.col("_line") / BLOCK_LINES))
    own = F.when(~F.col("is_form"), F.col("_line"))
    ends = rows.groupBy("_file", "_block").agg(F.max(own).alias("_end"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_file", "_block", F.max("_end").over(before).alias("_carried"))
    inside = Window.partitionBy("_file", "_block").orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_inside", F.max(own).over(inside)).join(carried, ["_file", "_block"]).withColumn("lexeme_line", F.coalesce("_inside", "_carried")).drop("_file", "_line", "_block", "_inside", "_carried")


def load_lexemes(classified: DataFrame) -> DataFrame:
    """Typed lexemes of the valid lexeme lines, with file_name and line_no, which name the lexeme for its forms."""
    f = lambda i: F.get("fields", F.lit(i))
    empty_null = lambda c: F.when(c != "", c)
    return classified.filter(~F.col("is_form") & (F.size("reasons") == 0)).select(
        "line_id",
        "file_name",
        "line_no",
        f(0).alias("word"),
        fields.lang_code(f(1)).alias("lang"),
        fields.u24(f(2)).alias("uid"),
        fields.pos_code(f(3)).alias("pos"),
        fields.article_code(f(4)).alias("article"),
        empty_null(f(5)).alias("genitive_suffix"),
        fields.strongs_list(f(6)).alias("strongs"),
        empty_null(f(7)).alias("root"),
        fields.gloss_list(f(8)).alias("glosses"),
        empty_null(f(9)).alias("adjective"),
        fields.tag_list(f(10)).alias("tags"),
        empty_null(f(11)).alias("note"),
    )


def load_forms(classified: DataFrame) -> DataFrame:
    """Typed forms of the valid form lines; lexeme_line is null for a form before any lexeme line, and lexeme_valid tells
    whether that line itself is valid."""
    f = lambda i: F.get("fields", F.lit(i))
    narrow = classified.select("line_id", "file_name", "line_no", "is_form", "fields", "packed", F.size("reasons").alias("_bad"))
    placed = _with_lexeme_line(narrow)
    valid = placed.filter(~F.col("is_form") & (F.col("_bad") == 0)).select(F.col("file_name").alias("_f"), F.col("line_no").alias("_l"), F.lit(True).alias("lexeme_valid"))
    forms = placed.filter(F.col("is_form") & (F.col("_bad") == 0))
    joined = forms.join(valid, F.col("file_name").eqNullSafe(F.col("_f")) & (F.col("lexeme_line") == F.col("_l")), "left")
    return joined.select(
        "line_id",
        "file_name",
        "line_no",
        "lexeme_line",
        F.coalesce("lexeme_valid", F.lit(False)).alias("lexeme_valid"),
        f(0).alias("word"),
        F.col("packed").alias("parsing"),
        fields.boolean(f(2)).alias("preferred"),
        fields.u24(f(3)).alias("uid"),
        fields.gloss_list(f(4)).alias("glosses"),
        fields.reference_list(f(5)).alias("refs"),
    )
