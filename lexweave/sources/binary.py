"""The condensed binary format: one file of lexemes with their forms and three indexes.

Its record numbers have 24 bits, so a file holds less than 2**24 records; within that bound it is read and written as a
stream, record by record. It has no roots, suffixes, adjective forms and notes; Parquet tables keep everything.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import references as R
from ..operators import index
from ..operators.lexicon import Lexicon
from ..schemas import FORM, LEXEME

MAGIC = bytes((99, 1))
FS, RS, US = 28, 30, 31
LANGS = ("unknown", "he", "el", "aaa", "en", "zh", "es", "ko", "ru", "uk")
LIST_LIMIT = index.MAX_RESULTS


class InvalidFile(ValueError):
    pass


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise InvalidFile("unexpected end")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def text(self) -> str:
        end = self.data.find(US, self.at)
        if end < 0:
            raise InvalidFile("text without end")
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out

    def peek(self) -> int:
        return self.data[self.at] if self.at < len(self.data) else 0


def _glosses(cursor: Cursor) -> list[dict]:
    out = []
    for _ in range(cursor.number(2)):
        lang = LANGS[cursor.number(1)]
        entries = []
        while cursor.peek() not in (RS, 0):
            entries.append(cursor.text())
        if cursor.number(1) != RS:
            raise InvalidFile("gloss without end")
        out.append({"lang": lang, "entries": entries})
    return out


def read_records(data: bytes) -> Iterator[tuple[str, dict]]:
    """('lexeme', row), ('form', row) and ('posting', row) of a file, in its order."""
    cursor = Cursor(data)
    if cursor.take(2) != MAGIC:
        raise InvalidFile("not a lexicon")
    modules = [m[1] for m in R.modules()]
    for no in range(1, cursor.number(4) + 1):
        row = {"lexeme_no": no, "uid": cursor.number(3), "word": cursor.text(), "lang": LANGS[cursor.number(1)], "pos": cursor.number(4), "article": cursor.number(1), "glosses": _glosses(cursor)}
        row["tags"] = [cursor.text() for _ in range(cursor.number(1))] or None
        row["strongs"] = [cursor.number(2) for _ in range(cursor.number(1))]
        yield "lexeme", row
        for form_no in range(1, cursor.number(2) + 1):
            form = {"lexeme_no": no, "form_no": form_no, "uid": cursor.number(3), "parsing": cursor.number(4)}
            flags = cursor.number(1)
            form |= {"preferred": bool(flags & 1), "incorrect": bool(flags & 16), "word": cursor.text(), "glosses": _glosses(cursor), "refs": []}
            for _ in range(cursor.number(4)):
                module, book, chapter, verse, word = struct.unpack("<5H", cursor.take(10))
                form["refs"].append({"module": modules[module], "book": R.BOOKS[book], "chapter": chapter, "verse": verse, "word": word})
            yield "form", form
    if cursor.number(1) != FS:
        raise InvalidFile("lexemes without end")
    for name in ("by_form", "by_gloss", "by_transliteration"):
        for _ in range(cursor.number(4)):
            keyword = cursor.text()
            for tier in (1, 2, 3):
                for rank in range(1, cursor.number(1) + 1):
                    yield "posting", {"index": name, "keyword": keyword, "tier": tier, "rank": rank, "uid": cursor.number(3)}
        if cursor.number(1) != FS:
            raise InvalidFile("index without end")


def _text(value: str | None) -> bytes:
    return (value or "").encode() + bytes((US,))


def _number(value: int | None, size: int) -> bytes:
    return int(value or 0).to_bytes(size, "little")


def _gloss_bytes(glosses) -> bytes:
    out = [_number(len(glosses or ()), 2)]
    for g in glosses or ():
        out += [_number(LANGS.index(g["lang"]) if g["lang"] in LANGS else 0, 1), *(_text(e) for e in g["entries"] or () if e), bytes((RS,))]
    return b"".join(out)


def lexeme_bytes(row: dict) -> bytes:
    tags, strongs = row["tags"] or (), row["strongs"] or ()
    head = _number(row["uid"], 3) + _text(row["word"]) + _number(LANGS.index(row["lang"]) if row["lang"] in LANGS else 0, 1) + _number(row["pos"], 4) + _number(row["article"], 1)
    return head + _gloss_bytes(row["glosses"]) + _number(len(tags), 1) + b"".join(map(_text, tags)) + _number(len(strongs), 1) + b"".join(_number(n, 2) for n in strongs)


def form_bytes(row: dict) -> bytes:
    refs = row["refs"] or ()
    modules, books = R.module_aliases(), R.book_aliases()
    packed = [struct.pack("<5H", modules.get((r["module"] or "").lower(), 0), books.get((r["book"] or "").lower(), 0), r["chapter"] or 0, r["verse"] or 0, r["word"] or 0) for r in refs]
    flags = (1 if row["preferred"] else 0) | (16 if row["incorrect"] else 0)
    return _number(row["uid"], 3) + _number(row["parsing"], 4) + bytes((flags,)) + _text(row["word"]) + _gloss_bytes(row["glosses"]) + _number(len(refs), 4) + b"".join(packed)


def index_bytes(keyword: str, lists: Iterable[list[int]]) -> bytes:
    return _text(keyword) + b"".join(_number(len(uids[:LIST_LIMIT]), 1) + b"".join(_number(u, 3) for u in uids[:LIST_LIMIT]) for uids in lists)


def write_binary(lexicon: Lexicon, path: str, only_glossed: bool = False) -> None:
    """One file, written beside its target and then put in its place. Rows stream through the driver in order."""
    lexemes = lexicon.lexemes.filter(F.size("glosses") > 0) if only_glossed else lexicon.lexemes
    total, forms = lexemes.count(), lexicon.forms
    if max(total, forms.count()) >= 1 << 24:
        raise ValueError("too many records for this format; write Parquet tables")
    widest = forms.groupBy("lexeme_no").count().agg(F.max("count")).first()[0] or 0
    if widest >= 1 << 16:
        raise ValueError(f"a lexeme has {widest} forms, too many for this format; write Parquet tables")
    own = forms.select("lexeme_no", F.struct("form_no", "uid", "word", "parsing", "preferred", "incorrect", "glosses", "refs").alias("form"))
    rows = lexemes.select("lexeme_no", F.struct("uid", "word", "lang", "pos", "article", "glosses", "tags", "strongs").alias("lexeme"), F.lit(None).cast(own.schema["form"].dataType).alias("form"))
    rows = rows.unionByName(own.join(lexemes.select("lexeme_no"), "lexeme_no", "left_semi"), allowMissingColumns=True).orderBy("lexeme_no", F.col("form.form_no").asc_nulls_first())
    specs = ((lexicon.by_form, index.FORM_SPEC), (lexicon.by_gloss, index.GLOSS_SPEC), (lexicon.by_transliteration, index.GLOSS_SPEC))
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(MAGIC + _number(total, 4))
            head, tail = b"", []
            for row in rows.toLocalIterator():
                if row.form is None:
                    if head:
                        f.write(head + _number(len(tail), 2) + b"".join(tail))
                    head, tail = lexeme_bytes(row.lexeme.asDict(True)), []
                else:
                    tail.append(form_bytes(row.form.asDict(True)))
            if head:
                f.write(head + _number(len(tail), 2) + b"".join(tail))
            f.write(bytes((FS,)))
            for postings, spec in specs:
                _write_index(f, index.ranked(postings, spec, LIST_LIMIT))
                f.write(bytes((FS,)))
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def _write_index(f, ranked: DataFrame) -> None:
    """Keywords in collation order; a keyword's three lists are short, as they are cut to LIST_LIMIT."""
    from ..functions import greek

    lists = ranked.groupBy("keyword").agg(*[F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.struct("rank", "uid")))).alias(f"t{t}") for t in (1, 2, 3)])
    f.write(_number(lists.count(), 4))
    for row in lists.orderBy(greek.sort_key("keyword"), "keyword").toLocalIterator():
        f.write(index_bytes(row.keyword, [[x.uid or 0 for x in row[f"t{t}"]] for t in (1, 2, 3)]))


POSTING = T.StructType([T.StructField(n, T.StringType() if n in ("index", "keyword") else T.IntegerType()) for n in ("index", "keyword", "tier", "rank", "uid")])
TABLES = {"lexemes": LEXEME, "forms": FORM, "postings": POSTING}
KINDS = {"lexemes": "lexeme", "forms": "form", "postings": "posting"}


class BinaryLexicon(DataSource):
    """format("lexweave-binary"), option("table", "lexemes" | "forms" | "postings"), load(path)."""

    @classmethod
    def name(cls) -> str:
        return "lexweave-binary"

    def schema(self):
        return TABLES[self.options.get("table", "lexemes")]

    def reader(self, schema):
        return _Reader(self.options, schema)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """A task for each file; the records of a file only follow from each other."""

    def __init__(self, options, schema):
        self.kind = KINDS[options.get("table", "lexemes")]
        self.path, self.names = options["path"], [f.name for f in schema.fields]

    def partitions(self):
        if os.path.isdir(self.path):
            return [_File(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if not n.startswith((".", "_"))]
        return [_File(self.path)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            data = f.read()
        for kind, row in read_records(data):
            if kind == self.kind:
                yield tuple(_tuples(row.get(n)) for n in self.names)


def _tuples(value):
    if isinstance(value, dict):
        return tuple(_tuples(v) for v in value.values())
    return [_tuples(v) for v in value] if isinstance(value, list) else value


def _parse(table: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(TABLES[table])
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = (row for kind, row in read_records(content) if kind == KINDS[table])
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in part], schema)

    return run


def read_binary(spark: SparkSession, path: str, table: str = "lexemes") -> DataFrame:
    """Records of a binary file: a local one by the data source, any other through Spark's file system."""
    if "://" in path and not path.startswith("file://"):
        files = spark.read.format("binaryFile").load(path).select("content")
        return files.mapInArrow(_parse(table, TABLES[table].fieldNames()), TABLES[table])
    path = path.removeprefix("file://")
    spark.dataSource.register(BinaryLexicon)
    return spark.read.format("lexweave-binary").option("table", table).load(path)


def is_binary(path: str) -> bool:
    """Whether a file starts like the binary format; a missing file is an error."""
    with open(path, "rb") as f:
        return f.read(2) == MAGIC and os.path.getsize(path) > 10
