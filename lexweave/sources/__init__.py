"""Sources and sinks of lexicons."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.lexicon import Lexicon


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _kind(spark: SparkSession, path: str) -> str:
    """'binary', 'tables' or 'text', by what Spark's file system finds at path."""
    from . import binary

    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return "text"  # a pattern of names, or an error of the reader
    if files.getFileStatus(target).isDirectory():
        return "tables" if files.exists(spark._jvm.org.apache.hadoop.fs.Path(target, "lexemes")) else "text"
    stream = files.open(target)
    try:
        start = bytes(max(0, stream.read()) for _ in binary.MAGIC)
    finally:
        stream.close()
    return "binary" if start == binary.MAGIC and files.getFileStatus(target).getLen() > 10 else "text"


def load_lexicon(spark: SparkSession, path: str, mode: str = "FAILFAST", stored_indexes: bool = True) -> Lexicon:
    """A lexicon of a binary file, of Parquet tables, or else of text files, on any file system that Spark reads.

    Posting lists that are stored with it are used as they are (those of a binary file hold the first results only) and
    their forms are looked up; without stored_indexes they are made anew.
    """
    from . import binary, tables, text

    kind = _kind(spark, path)
    if kind == "text":
        return Lexicon(*text.read_lexicon(spark, path, mode))
    if kind == "binary":
        out = Lexicon(binary.read_binary(spark, path, "lexemes"), binary.read_binary(spark, path, "forms"))
        return tables.with_indexes(out, binary.read_binary(spark, path, "postings"), "uid") if stored_indexes else out
    out = Lexicon(spark.read.parquet(f"{path}/lexemes"), spark.read.parquet(f"{path}/forms"))
    names = [n for n in tables.OF_FORMS if stored_indexes and exists(spark, f"{path}/{n}")]
    return tables.with_indexes(out, tables.read_postings(spark, path, names), "form", names) if names else out
