"""Records that differ only in formatting, by rolling polynomial hashes over a skip-and-fold lookup table.

Code points stream through one table that holds 0 for a character to skip and else its folded code; the polynomial of
the codes that remain is the field's hash, so no canonical string is made. A row's key is made of two such hashes of 64
bits. Rows with equal keys are then compared with two pointers that skip; entries in another order are first paired by
their hashes. Rows that collide without being equal (none in practice) are grouped again by their whole folded content.

Copies: the same lang, and the same word, root and multiset of (gloss lang, entry) once everything but letters, marks
and decimal digits is dropped and letters are lower-cased, final sigma counting as sigma. Null and empty are the same,
and an entry in which nothing remains is none. Rows without a lexeme_no can't be named and are left out; a lexeme_no
that stands on several rows makes no pair with itself.

Scale: keys (two longs) alone are shuffled to find the groups, combined before. Then the rows of groups, and only they
where the groups are few enough to be broadcast, are brought together by key, once, each group in as many parts as its
size asks for and its first record in every part, and are compared as a stream; so a group may hold any part of all rows,
and no group is held in memory.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import split_join
from ..session import durable, gathered, spread

#: Rows of a part of a group.
PART = 50_000
_END = 0xE01F0
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@lru_cache(1)
def fold_table() -> np.ndarray:
    """Code of each code point, 0 for those to skip."""
    table = np.zeros(_END + 1, np.uint32)
    for low, high in ((0, 0x32400), (0xE0100, _END)):
        for code in range(low, high):
            char = chr(code)
            kind = unicodedata.category(char)
            if kind[0] in "LM" or kind == "Nd":
                table[code] = ord(char.lower()[0])
    table[0x3C2] = 0x3C3
    return table


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _plain(array: pa.Array) -> pa.Array:
    """Strings without null; İ, the one letter whose lower case is two characters, as these two."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if pc.any(pc.match_substring(array, "İ")).as_py():
        array = pc.replace_substring(array, "İ", "i̇")
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def rolling_hashes(array: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Two polynomial hashes of each string; 0 where nothing remains of it."""
    array = _plain(array)
    n = len(array)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    ends = starts[offsets - offsets[0]]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    codes = fold_table()[np.minimum(points, _END)] if fold else points + np.uint32(1)
    kept = np.concatenate([[0], np.cumsum(codes != 0)])
    ends = kept[ends]
    codes = codes[codes != 0].astype(np.uint64)
    lengths = np.diff(ends)
    at = np.arange(len(codes)) - np.repeat(ends[:-1], lengths)
    out = []
    for base in _BASES:
        powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(lengths.max()), base, np.uint64))])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes * base) * powers[at], dtype=np.uint64)])
        out.append(np.where(lengths > 0, _mix(sums[ends[1:]] - sums[ends[:-1]] + lengths.astype(np.uint64)), np.uint64(0)))
    return out[0], out[1]


def _record_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    glosses = batch.column("glosses")
    of_row = pc.list_parent_indices(glosses)
    structs = pc.list_flatten(glosses)
    langs, entries = pc.struct_field(structs, "lang"), pc.struct_field(structs, "entries")
    of_gloss = pc.list_parent_indices(entries)
    rows = of_row.take(of_gloss).to_numpy(zero_copy_only=False)
    texts, kinds = rolling_hashes(pc.list_flatten(entries)), rolling_hashes(langs.take(of_gloss), fold=False)
    word, root, lang = rolling_hashes(batch.column("word")), rolling_hashes(batch.column("root")), rolling_hashes(batch.column("lang"), fold=False)
    keys = []
    for k in (0, 1):
        bag = np.zeros(batch.num_rows, np.uint64)
        some = texts[k] != 0
        np.add.at(bag, rows[some], _mix(texts[k][some] + np.uint64(3) * _mix(kinds[k][some] + np.uint64(7))))
        keys.append(_mix(_mix(_mix(word[k] + np.uint64(1)) + np.uint64(5) * root[k] + np.uint64(2)) + np.uint64(9) * bag) + _mix(lang[k] + np.uint64(4)))
    return keys[0], keys[1]


def hash_records(bits: int = 64, whole: bool = False):
    """A mapInArrow function to (lexeme_no, h1, h2), with whole rows to all columns, h1 and h2; fewer bits make collisions,
    for tests."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (k & mask for k in _record_keys(batch))
                kept = batch.schema.names if whole else ["lexeme_no"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], [*kept, "h1", "h2"])

    return run


def _stream(text: str | None):
    table = fold_table()
    for char in text or "":
        for c in "i̇" if char == "İ" else char:
            if (code := int(table[min(ord(c), _END)])) != 0:
                yield code


def same_folded(a: str | None, b: str | None) -> bool:
    """Two pointers run over both texts and skip what doesn't count."""
    if (a or "") == (b or ""):
        return True
    return all(x == y for x, y in zip_longest(_stream(a), _stream(b)))


def _bag(glosses) -> list[tuple[str, str]]:
    return [(g["lang"] or "", e) for g in glosses or () if g for e in g["entries"] or () if e is not None and next(_stream(e), None)]


def same_record(a: dict, b: dict) -> bool:
    if (a["lang"] or "") != (b["lang"] or "") or not same_folded(a["word"], b["word"]) or not same_folded(a["root"], b["root"]):
        return False
    if a["glosses"] == b["glosses"]:
        return True
    one, two = _bag(a["glosses"]), _bag(b["glosses"])
    if len(one) != len(two):
        return False
    if all(x[0] == y[0] and same_folded(x[1], y[1]) for x, y in zip(one, two)):
        return True
    # In another order: entries of one language and hash are held against each other; equality makes any choice right.
    left = defaultdict(list)
    for k, e in one:
        left[k, _rolling(e)].append(e)
    for k, e in two:
        own = left[k, _rolling(e)]
        at = next((i for i, x in enumerate(own) if same_folded(x, e)), None)
        if at is None:
            return False
        own.pop(at)
    return True


def _rolling(text: str) -> int:
    h = 0
    for code in _stream(text):
        h = (h * 1_000_003 + code) % ((1 << 61) - 1)
    return h


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by group and part, the group's first record at the head of each part; the others are held against it."""
    at, head = None, None
    for batch in batches:
        firsts, copies, same = [], [], []
        for row in batch.to_pylist():
            part = (row["h1"], row["h2"], row["salt"])
            if part != at:
                at, head = part, row
            elif row["lexeme_no"] != row["first_no"]:
                firsts.append(row["first_no"])
                copies.append(row["lexeme_no"])
                same.append(same_record(head, row))
        yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(copies, pa.int64()), pa.array(same, pa.bool_())], ["first_no", "copy_no", "same"])


def _content(row_lang, word, root, glosses) -> str:
    """Whole folded content, made only for rows whose hashes collide without being equal."""
    bag = sorted((k, list(_stream(e))) for k, e in _bag(glosses))
    return repr((row_lang or "", list(_stream(word)), list(_stream(root)), bag))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("lexeme_no"), pa.array([_content(r["lang"], r["word"], r["root"], r["glosses"]) for r in rows], pa.string())], ["lexeme_no", "content"])


def formatting_copies(lexemes: DataFrame, bits: int = 64) -> DataFrame:
    """(first_no, copy_no): for each record that isn't the first of its copies, the smallest lexeme_no among them."""
    base = spread(lexemes.select(F.col("lexeme_no").cast("long").alias("lexeme_no"), "lang", "word", "root", "glosses").filter("lexeme_no is not null"))
    keys = base.mapInArrow(hash_records(bits), "lexeme_no long, h1 long, h2 long")
    found = keys.groupBy("h1", "h2").agg(F.min("lexeme_no").alias("first_no"), F.max("lexeme_no").alias("last_no"), F.count("*").alias("n")).filter("first_no < last_no")
    groups = durable(found.drop("last_no"))
    hashed = base.mapInArrow(hash_records(bits, True), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields) + ", h1 long, h2 long")
    grouped = split_join(hashed, groups, ["h1", "h2"], ["lexeme_no"], counts=groups)
    # The first record goes to every part of its group.
    parts, is_first = F.floor(F.col("n") / PART) + 1, F.col("lexeme_no") == F.col("first_no")
    salts = F.when(is_first, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("lexeme_no"), parts)))
    dealt = gathered(grouped.withColumn("salt", F.explode(salts)).drop("n"), "h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", (~is_first).cast("int"), "lexeme_no")
    checked = dealt.mapInArrow(_compare, "first_no long, copy_no long, same boolean")
    checked = durable(checked.groupBy("copy_no").agg(F.min("first_no").alias("first_no"), F.bool_and("same").alias("same")))

    failed = base.join(checked.filter("not same").select(F.col("copy_no").alias("lexeme_no")), "lexeme_no", "left_semi")
    contents = failed.mapInArrow(_contents, "lexeme_no long, content string")
    again_first = contents.groupBy("content").agg(F.min("lexeme_no").alias("first_no"))
    again = contents.join(again_first, "content").filter("lexeme_no != first_no").select("first_no", F.col("lexeme_no").alias("copy_no"))
    return checked.filter("same").select("first_no", "copy_no").unionAll(again)


def collapse_copies(lexemes: DataFrame) -> DataFrame:
    """The first record of each group of copies, with n_copies, the number of records it stands for."""
    pairs = durable(formatting_copies(lexemes))
    counts = pairs.groupBy(F.col("first_no").alias("lexeme_no")).agg((F.count("*") + 1).alias("n_copies"))
    kept = lexemes.join(pairs.select(F.col("copy_no").alias("lexeme_no")), "lexeme_no", "left_anti")
    return kept.join(counts, "lexeme_no", "left").withColumn("n_copies", F.coalesce("n_copies", F.lit(1).cast("long")))
