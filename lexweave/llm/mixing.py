"""Mixing sources to target weights, by Sainte-Laguë apportionment of blocks of equal tokens.

1. Tokens are summed by source and shard (a seeded hash of the post; hot sources fall into as many shards as others).
2. The mix is as large as the shares and repeats allow: no source may need more than max_repeats times its tokens. Its
   size in blocks is dealt to the sources by highest quotients, and each source's blocks to its shards likewise, so every
   shard gets an integer quota.
3. In a shard, posts are taken in seeded order, after as many whole passes as the quota holds, each that still fits, so
   that in the end none is left that would.

Shares are reached up to a block, and in each shard up to a gap that no post of it fits. Sources of posts without a target, or with share 0, are
left out; a target without posts can't be met: the shares of the others are scaled up. A null max_repeats is 1. Of targets of
one source the largest share counts, then the most repeats. A post without tokens (null or empty text) or without source is
in no mix. Equal hashes are ordered by doc_id; repeated rows are posts of their own. An empty table gives an empty mix.

The driver gets the target table and one sum for each of its sources. Shards are planned in tasks, a source in each (at most
SHARDS rows); posts of a shard are sorted by Spark and read as a stream, so that a shard may hold any number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, gathered, spread
from .tokens import TOKENIZER, token_counts

BLOCK_TOKENS = 2048
#: Shards of a source at most; fewer are used while a shard would hold less than SHARD_BLOCKS blocks on average.
SHARDS = 4096
SHARD_BLOCKS = 512


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """seats dealt one by one to the highest weight / (2 * own + 1), none beyond its cap; ties go to the first.

    The bulk is dealt at once by rounding down exact quotas; highest quotients deal the rest and correct the start.
    """
    n = len(weights)
    caps = list(caps) if caps is not None else [seats] * n
    seats = min(seats, sum(c for c, w in zip(caps, weights) if w > 0))
    own, open_, left = [0] * n, [i for i in range(n) if weights[i] > 0], seats
    while open_ and left:  # sources at their caps leave the sharing
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] / total * left >= caps[i]]
        if not full:
            for i in open_:
                own[i] = min(caps[i], max(0, int(weights[i] / total * left) - 1))
            break
        for i in full:
            own[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(full)]
    gain = [(-weights[i] / (2 * own[i] + 1), i) for i in range(n) if weights[i] > 0 and own[i] < caps[i]]
    heapq.heapify(gain)
    for _ in range(seats - sum(own)):
        _, i = heapq.heappop(gain)
        own[i] += 1
        if own[i] < caps[i]:
            heapq.heappush(gain, (-weights[i] / (2 * own[i] + 1), i))
    while gain:  # a seat moves while another's next quotient is higher than the last one that got a seat
        last = min(((weights[i] / (2 * own[i] - 1), -i) for i in range(n) if own[i]), default=None)
        nxt = -gain[0][0]
        if last is None or nxt <= last[0]:
            break
        _, i = heapq.heappop(gain)
        j = -last[1]
        own[i] += 1
        own[j] -= 1
        gain = [(-weights[x] / (2 * own[x] + 1), x) for x in range(n) if weights[x] > 0 and own[x] < caps[x]]
        heapq.heapify(gain)
    return own


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array(token_counts(batch.column("text"), path), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), counts], ["doc_id", "source", "n_tokens"])

    return run


Target = tuple[str, float, int]


def plan_sources(tokens: dict[str, int], targets: list[Target], block: int = BLOCK_TOKENS, total: int | None = None) -> tuple[int, list[tuple[str, int, int]]]:
    """Tokens by source and targets (source, share, repeats) to (shards, [(source, blocks, repeats)])."""
    live = [(s, share, max(1, int(r or 1))) for s, share, r in targets if share and share > 0 and tokens.get(s)]
    if not live:
        return 1, []
    scale = sum(share for _, share, _ in live)
    most = min(int(r * tokens[s] / (share / scale)) for s, share, r in live)
    size = most if total is None else min(most, total)
    shards = max(1, min(SHARDS, sum(tokens[s] for s, _, _ in live) // (SHARD_BLOCKS * block * len(live))))
    # As many blocks as a source can fill; its last one may be short.
    caps = [-(-r * tokens[s] // block) for s, _, r in live]
    dealt = sainte_lague([share for _, share, _ in live], max(1, size // block), caps)
    return shards, [(source, quota, repeats) for (source, _, repeats), quota in zip(live, dealt)]


def plan_shards(sums: list[tuple[int, int]], quota: int, repeats: int, block: int = BLOCK_TOKENS) -> list[tuple[int, int, int]]:
    """A source's sums (shard, tokens) to (shard, whole passes, tokens of the last pass)."""
    own = sorted((h, n) for h, n in sums if n)
    dealt = sainte_lague([n for _, n in own], quota, [-(-repeats * n // block) for _, n in own])
    wants = [min(q * block, repeats * n) for (_, n), q in zip(own, dealt)]
    return [(shard, want // n, want % n) for (shard, n), want in zip(own, wants)]


def _plan_group(block: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        made = plan_shards(list(zip(group["shard"], group["n"])), int(group["quota"].iloc[0]), int(group["repeats"].iloc[0]), block)
        return pd.DataFrame([(group["source"].iloc[0], *row) for row in made], columns=["source", "shard", "passes", "rest"])

    return run


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies of each post, where the posts come shard by shard in order: a post that fits what is left of its shard's last
    pass is taken once more."""
    at, gap = None, 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("source", "shard", "n_tokens", "passes", "rest")]
        copies = []
        for source, shard, n, passes, rest in zip(*columns):
            if (source, shard) != at:
                at, gap = (source, shard), rest
            if n <= gap:
                gap -= n
                passes += 1
            copies.append(passes)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "shard", "n_tokens")), pa.array(copies, pa.int64())], ["doc_id", "source", "shard", "n_tokens", "copies"])


def _wanted(targets: DataFrame) -> DataFrame:
    """One target for each source."""
    best = F.max(F.struct("target_share", "max_repeats")).alias("t")
    return targets.filter("source is not null").groupBy("source").agg(best).select("source", "t.target_share", "t.max_repeats")


def mix_documents(documents: DataFrame, targets: DataFrame, seed: int = 1, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, shard, n_tokens, copies): the posts of the mix and how many times each is used."""
    spark = documents.sparkSession
    wanted = [tuple(r) for r in _wanted(targets).orderBy("source").collect()]
    used = documents.select("doc_id", "source", "text").filter(F.col("source").isin([w[0] for w in wanted] or [""]) & (F.col("text") != ""))
    counted = spread(used).mapInArrow(_count(tokenizer), "doc_id long, source string, n_tokens long")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    # Narrow rows, written once: tokens are counted a single time.
    posts = durable(counted.select("*", key.alias("key"), F.pmod(F.xxhash64(key), F.lit(SHARDS)).alias("fine")))
    tokens = {r.source: r.n for r in posts.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    shards, quotas = plan_sources(tokens, wanted, total=total_tokens)
    quota = F.broadcast(spark.createDataFrame(quotas, "source string, quota long, repeats int"))  # the target table's sources
    placed = posts.withColumn("shard", F.col("fine") % F.lit(shards)).drop("fine")
    sums = placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).join(quota, "source")
    plans = sums.groupBy("source").applyInPandas(_plan_group(BLOCK_TOKENS), "source string, shard long, passes long, rest long")
    ordered = gathered(placed.join(plans.filter("passes > 0 or rest > 0"), ["source", "shard"]), "source", "shard").sortWithinPartitions("source", "shard", "key", "doc_id", "n_tokens")
    return ordered.mapInArrow(_take, "doc_id long, source string, shard long, n_tokens long, copies long").filter("copies > 0")


def mix_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, posts, most_copies) of each target source."""
    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("posts"), F.max("copies").alias("most_copies"))
    whole = F.broadcast(used.agg(F.sum("tokens").alias("all_tokens")))  # one row
    joined = _wanted(targets).select("source", "target_share").join(F.broadcast(used), "source", "left").join(whole)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return joined.select("source", "target_share", (zero("tokens") / F.col("all_tokens")).alias("actual_share"), zero("tokens").alias("tokens"), zero("posts").alias("posts"), zero("most_copies").alias("most_copies"))
