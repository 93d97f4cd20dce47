"""The fixed schemas of the dictionary's tables."""

from pyspark.sql import types as T

GLOSS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("entries", T.ArrayType(T.StringType()))])
REFERENCE = T.StructType(
    [
        T.StructField("module", T.StringType()),
        T.StructField("book", T.StringType()),
        T.StructField("chapter", T.IntegerType()),
        T.StructField("verse", T.IntegerType()),
        T.StructField("word", T.IntegerType()),
    ]
)
LEXEME = T.StructType(
    [
        T.StructField("lexeme_no", T.LongType()),
        T.StructField("uid", T.IntegerType()),
        T.StructField("word", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("article", T.IntegerType()),
        T.StructField("genitive_suffix", T.StringType()),
        T.StructField("strongs", T.ArrayType(T.IntegerType())),
        T.StructField("root", T.StringType()),
        T.StructField("glosses", T.ArrayType(GLOSS)),
        T.StructField("adjective", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("note", T.StringType()),
    ]
)
FORM = T.StructType(
    [
        T.StructField("lexeme_no", T.LongType()),
        T.StructField("form_no", T.IntegerType()),
        T.StructField("uid", T.IntegerType()),
        T.StructField("word", T.StringType()),
        T.StructField("parsing", T.IntegerType()),
        T.StructField("preferred", T.BooleanType()),
        T.StructField("incorrect", T.BooleanType()),
        T.StructField("glosses", T.ArrayType(GLOSS)),
        T.StructField("refs", T.ArrayType(REFERENCE)),
    ]
)
