"""Frequency of every distinct term, by a global integer dictionary and blockwise count arrays.

Three steps, two of them without any shuffle:

1. Each task dictionary-encodes its own terms and adds up two arrays over its local identifiers, occurrences and
   records; a term leaves the task once per block, however often it occurs, so no hot term can skew the shuffle.
2. The blocks' terms are hash-partitioned and sorted. A partition owns one range of the global identifiers
   (partition * 2**40 + rank in the partition), which encodes its terms in sorted order.
3. The arrays that fall on the same identifier are summed range by range, in blocks of RANGE identifiers.

Nulls: a null term is none; a null record has no terms. Empty tables give no rows. Ties in the marks can't occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.glosses import tokens
from ..session import gathered

#: Distinct terms that a task holds before it passes its arrays on.
BLOCK = 1 << 17
#: Identifiers of one range whose arrays are added up together.
RANGE = 1 << 16

_COUNTS = "field string, term string, occurrences long, records long"


def record_terms(terms):
    """(term, whether it is the first of its kind in the record) for the array of a record's terms."""
    ordered = F.array_sort(F.filter(terms, lambda t: t.isNotNull()))
    return F.transform(ordered, lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get(ordered, i - 1) != t)).alias("first")))


def gloss_terms(glosses):
    """All terms of a record's gloss entries, of every language."""
    entries = F.filter(F.flatten(F.filter(F.transform(glosses, lambda g: g["entries"]), lambda e: e.isNotNull())), lambda e: e.isNotNull())
    return F.flatten(F.transform(entries, tokens))


def _local_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: dict[tuple[str, str], int] = {}
    occurrences = np.zeros(1024, np.int64)
    records = np.zeros(1024, np.int64)

    def flush():
        n = len(ids)
        keys = list(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(occurrences[:n]), pa.array(records[:n])],
            ["field", "term", "occurrences", "records"],
        )

    for batch in batches:
        for field in pc.unique(batch.column("field")).to_pylist():
            part = batch.filter(pc.equal(batch.column("field"), field))
            encoded = pc.dictionary_encode(part.column("term"))
            codes = encoded.indices.to_numpy(zero_copy_only=False)
            first = part.column("first").to_numpy(zero_copy_only=False).astype(np.float64)
            local = np.fromiter((ids.setdefault((field, t), len(ids)) for t in encoded.dictionary.to_pylist()), np.int64, len(encoded.dictionary))
            while len(ids) > len(occurrences):
                occurrences = np.concatenate([occurrences, np.zeros_like(occurrences)])
                records = np.concatenate([records, np.zeros_like(records)])
            occurrences[local] += np.bincount(codes, minlength=len(local))
            records[local] += np.bincount(codes, weights=first, minlength=len(local)).astype(np.int64)
        if len(ids) >= BLOCK:
            yield flush()
            ids.clear()
            occurrences[:] = 0
            records[:] = 0
    if ids:
        yield flush()


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks of one partition to one row per identifier; a range's arrays are added up by np.add.at."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    names: list[tuple[str, str]] = []
    sums = np.zeros((2, RANGE), np.int64)
    start = 0

    def flush(keep: int):
        n = len(names) - keep
        fields, terms = zip(*names[:n])
        return pa.RecordBatch.from_arrays(
            [pa.array(fields, pa.string()), pa.array(terms, pa.string()), pa.array(base + start + np.arange(n)), pa.array(sums[0, :n].copy()), pa.array(sums[1, :n].copy())],
            ["field", "term", "term_id", "occurrences", "records"],
        )

    for batch in batches:
        fields, terms = batch.column("field").to_pylist(), batch.column("term").to_pylist()
        counts = np.stack([batch.column("occurrences").to_numpy(), batch.column("records").to_numpy()])
        at = 0
        while at < len(terms):
            ids = []
            for i in range(at, len(terms)):
                key = (fields[i], terms[i])
                if not names or names[-1] != key:
                    if len(names) == RANGE:
                        break
                    names.append(key)
                ids.append(len(names) - 1)
            np.add.at(sums[0], ids, counts[0, at : at + len(ids)])
            np.add.at(sums[1], ids, counts[1, at : at + len(ids)])
            at += len(ids)
            if at < len(terms):  # the range is full and its last identifier complete
                yield flush(0)
                start += RANGE
                names.clear()
                sums[:] = 0
    if names:
        yield flush(0)


def count_terms(rows: DataFrame) -> DataFrame:
    """rows (field string, term string, first boolean), one for each occurrence, to (field, term, term_id, occurrences, records)."""
    blocks = rows.filter("term is not null and field is not null").mapInArrow(_local_blocks, _COUNTS)
    dealt = gathered(blocks, "field", "term").sortWithinPartitions("field", "term")
    return dealt.mapInArrow(_sum_ranges, "field string, term string, term_id long, occurrences long, records long")


def gloss_and_word_terms(lexemes: DataFrame, forms: DataFrame) -> DataFrame:
    """Occurrences for the fields gloss_entries (lexemes and forms) and form_word (forms), in one scan of each table."""

    def tagged(field: str, pairs):
        return F.transform(pairs, lambda p: F.struct(F.lit(field).alias("field"), p["term"].alias("term"), p["first"].alias("first")))

    glosses = tagged("gloss_entries", record_terms(gloss_terms(F.col("glosses"))))
    none = F.array().cast("array<struct<field:string,term:string,first:boolean>>")
    word = F.array(F.struct(F.lit("form_word").alias("field"), F.col("word").alias("term"), F.lit(True).alias("first")))
    of_forms = forms.select(F.explode(F.concat(F.coalesce(glosses, none), word)).alias("t"))
    of_lexemes = lexemes.select(F.explode(glosses).alias("t"))
    return of_forms.unionAll(of_lexemes).select("t.*")


def record_totals(lexemes: DataFrame, forms: DataFrame) -> DataFrame:
    """(field, total): two rows."""
    has_gloss = F.when(F.size("glosses") > 0, F.lit(1)).otherwise(0)
    glossed = forms.select(has_gloss.alias("g"), F.when(F.col("word").isNotNull(), 1).otherwise(0).alias("w")).unionAll(lexemes.select(has_gloss.alias("g"), F.lit(0).alias("w")))
    sums = glossed.agg(F.sum("g").alias("g"), F.sum("w").alias("w"))
    return sums.select(F.inline(F.array(F.struct(F.lit("gloss_entries").alias("field"), F.coalesce("g", F.lit(0)).alias("total")), F.struct(F.lit("form_word").alias("field"), F.coalesce("w", F.lit(0)).alias("total")))))


def term_frequencies(lexemes: DataFrame, forms: DataFrame, common_one_in: int = 200) -> DataFrame:
    """(field, term, term_id, occurrences, records, mark): mark is 'rare' for a term of one record, 'common' for a term
    of more than one record in every common_one_in, else null. Rows and characters count as stored."""
    totals = F.broadcast(record_totals(lexemes, forms))  # two rows
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") * common_one_in > F.col("total"), "common")
    return count_terms(gloss_and_word_terms(lexemes, forms)).join(totals, "field").select("field", "term", "term_id", "occurrences", "records", mark.alias("mark"))
