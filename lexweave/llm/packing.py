"""Filling containers of fixed capacity with posts, by harmonic packing.

A post of n tokens is of class k = capacity // n, so that k posts of the class always fit in one container. A worker (one
partition of the scan) packs its posts class by class: posts first top up containers that are open with room enough,
fullest first; the others fill new containers of the class with k posts each. Workers never exchange posts, so there is
no shuffle, and a hot source needs no care; each worker leaves at most a few containers half empty.

A post larger than the capacity is cut into whole containers and a rest, which is packed as a post. No other is split.
A null or empty text takes no room: it comes out with 0 tokens, in the worker's first container. Equal lengths are taken
in the order of the scan; a container's number is the worker's times 2**32 plus its place. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread
from .tokens import TOKENIZER, token_counts

CAPACITY = 2048
_SCHEMA = "doc_id long, piece int, first_token long, n_tokens long, container long"


def harmonic_bins(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item of at most capacity; items of length 0 go into bin 0."""
    bins = np.zeros(len(lengths), np.int64)
    classes = np.where(lengths > 0, capacity // np.maximum(lengths, 1), 0)
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    order = order[lengths[order] > 0]
    room: dict[int, list[int]] = defaultdict(list)  # open bins by their room
    sizes: list[int] = []  # the keys of room that have bins, sorted
    n_bins = 0

    def put(space: int, which: int) -> None:
        if space:
            if not room[space]:
                insort(sizes, space)
            room[space].append(which)

    bounds = np.flatnonzero(np.diff(classes[order], prepend=-1))
    for start, end in zip(bounds, [*bounds[1:], len(order)]):
        items = order[start:end]
        k = int(classes[items[0]])
        fresh: list[int] = []
        for item in items.tolist():
            n = int(lengths[item])
            at = bisect_left(sizes, n)
            if at == len(sizes):
                fresh.append(item)
                continue
            space = sizes[at]
            which = room[space].pop()
            if not room[space]:
                del sizes[at]
            bins[item] = which
            put(space - n, which)
        for i in range(0, len(fresh), k):
            group = fresh[i : i + k]
            bins[group] = n_bins
            put(capacity - int(lengths[group].sum()), n_bins)
            n_bins += 1
    return bins


def pieces(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(post, first token, tokens) of each piece; a post of at most capacity is one piece."""
    n = np.maximum(1, -(-counts // capacity))
    post = np.repeat(np.arange(len(counts)), n)
    number = np.arange(len(post)) - np.repeat(np.cumsum(n) - n, n)
    first = number * capacity
    return post, first, np.minimum(counts[post] - first, capacity)


def _pack(capacity: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, counts = [], []
        for batch in batches:
            ids.append(batch.column("doc_id").cast(pa.int64()))
            counts.append(np.array(token_counts(batch.column("text"), path), np.int64))
        if not ids:
            return
        doc = pa.chunked_array(ids, pa.int64()).combine_chunks()
        post, first, tokens = pieces(np.concatenate(counts), capacity)
        if not len(post):
            return
        container = (TaskContext.get().partitionId() << 32) + harmonic_bins(tokens, capacity)
        table = pa.table([doc.take(pa.array(post)), pa.array((first // capacity).astype(np.int32)), pa.array(first), pa.array(tokens), pa.array(container)], names=["doc_id", "piece", "first_token", "n_tokens", "container"])
        yield from table.to_batches(max_chunksize=50_000)

    return run


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, container) of each post or piece of documents (doc_id, text)."""
    return spread(documents.select("doc_id", "text")).mapInArrow(_pack(capacity, tokenizer), _SCHEMA)
