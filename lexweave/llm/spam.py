"""Posts of repeated keywords, link lists or product tags, by rank-frequency curves against prose.

1. A post's own text is what remains without quotations and signature. Its terms are words in lower case, links, hashtags
   and numbers; on the curve links, hashtags and numbers count as one term each. Terms are cut once and written.
2. A language's prose model holds the share of its texts in which a word occurs, for the MODEL_TERMS most common words of
   at least COMMON of them. Each text counts a word once, and posts of the same words are one text, so that neither
   repetition nor copies make a keyword common. A post's own text is left out of the shares that it is held against, so
   that a language of few posts judges as one of many.
3. Per post, SQL windows rank its terms by frequency, and log frequency is fitted on log rank: slope, residual, and level
   (mean log frequency, which a curve flat through repetition of everything still shows).
4. Divergence: mean log share of each window of NEAR terms under the model of the best fitting language; what counts is
   the window in the middle, by characters, so that it tells about the larger part of a post.
5. Prose of the same language, and for curves of the same length (power of two), gives the quartiles of each; distances
   are in interquartile ranges beyond them (Tukey's fences). A post is spam if its divergence alone is beyond
   FAR_ALONE, or beyond OUTER with a curve outside the middle half of prose, or beyond INNER with an extreme curve.

Posts of less than LEAST_TERMS terms and less than LEAST_LINKS links have no curve to speak of and are no spam, whatever
they hold. A null text has no terms; a null or untrue language is replaced by the one whose model fits best. A language
of less than LEAST_TEXTS different texts has no model; posts in it are judged by the curve alone, of which
EXTREME_ALONE is asked then. Without any model, one over all posts counts. Rows with a null doc_id can't be named and are
left out; repeated rows are judged one by one, and a post is spam if any of its rows is.

Scale: models (at most MODEL_TERMS words for LANGUAGES languages, the ones of most texts) and quartiles (of languages by
powers of two) are broadcast. Texts are shuffled once, as their different words, and copies are combined before; else
frequencies and narrow rows are shuffled by post, so no key is hot.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, durable_table, ship, spread

COMMON = 0.005
MODEL_TERMS = 5000
LANGUAGES = 200
LEAST_TEXTS = 20
LEAST_TERMS = 5
LEAST_LINKS = 3
NEAR = 9
#: Fences, in interquartile ranges beyond the quartiles.
INNER, OUTER, FAR_ALONE = 1.5, 3.0, 4.5
EXTREME, EXTREME_ALONE = 9.0, 12.0
#: Least interquartile ranges: short posts of prose may all have the same curve.
LEAST_RANGE = {"slope": 0.1, "residual": 0.05, "level": 0.05, "nearness": 0.2}
#: Bins of the histogram of windows, from the share of a word off the model to 1.
BINS = 300
FLOOR = math.log(COMMON / 2)
#: Posts that are scored at once.
SLICE = 2000
LINK, TAG, NUMBER = "\u0001", "\u0002", "\u0003"

_URL = r"(?:https?://|www\.)[^\s<>\[\]()\"']+"
# Innermost quotations; possessive, so that long ones need no stack.
_QUOTES = (
    re.compile(r"(?is)\[quote\b[^\]]*+\](?:[^\[]++|\[(?!/?quote\b))*+\[/quote\]"),
    re.compile(r"(?is)<blockquote\b[^>]*+>(?:[^<]++|<(?!/?blockquote\b))*+</blockquote>"),
)
_LEFT_OVER = re.compile(r"(?i)\[/?quote\b[^\]]*+\]|</?blockquote\b[^>]*+>")
_QUOTED_LINE = re.compile(r"(?m)^[ \t]*+(?:>|&gt;)[^\n]*+$")
_VERBS = ("wrote", "writes", "said", "schrieb", "escribió", "a écrit")
_INTRODUCES = re.compile(rf"(?m)^[^\n]{{1,80}}\b(?:{'|'.join(_VERBS)})[ \t]*+:?[ \t]*+$")
#: What follows a divider or stands in small letters is a signature if it has at most so many characters and, after a
#: divider, lines; more is the post's own text.
SIGNATURE_CHARS, SIGNATURE_LINES = 400, 8
_DIVIDER = re.compile(r"\n(?:-- ?|_{5,}|={5,}|\*{3})[ \t]*(?=\n)")
# Each with what the text in lower case must hold for it to occur.
_SIGNATURES = (
    ("~", re.compile(r"(?m)^[ \t]*~[^~\n]{1,60}~[ \t]*$")),
    ("sent from my ", re.compile(r"(?im)^sent from my [^\n]*$")),
    ("[size=", re.compile(rf"(?is)\[size=[^\]]*+\](?:[^\[]|\[(?!/size\])){{0,{SIGNATURE_CHARS}}}+(?:\[/size\]|\Z)")),
    ("<i>", re.compile(rf"(?is)<br\s*+/?>\s*+<i>[^<]{{0,{SIGNATURE_CHARS}}}+(?:</i>|\Z)")),
)
_LINK_CODE = re.compile(r"(?i)\[url=[\"']?([^\]\"']*+)[\"']?\]")
_LINK_TAG = re.compile(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'>\s]*+)[^>]*+>")
_MARKUP = re.compile(r"<[^>]{1,300}>|\[/?[A-Za-z]+(?:=[^\]]*)?\]|&#?\w{1,8};")


@lru_cache(1)
def _term() -> re.Pattern:
    import regex

    return regex.compile(rf"{_URL}|#[\p{{L}}\p{{N}}_]++|\p{{N}}[\p{{N}}.,]*+|\p{{L}}[\p{{L}}\p{{M}}]*+(?:['’][\p{{L}}\p{{M}}]++)*+")


def strip_others(text: str) -> str:
    """Text without quotations, lines that introduce them, and signatures."""
    out = "\n" + text.replace("\r\n", "\n").replace("\r", "\n")
    low = out.lower()
    if "quote" in low:
        last = None
        while out != last:  # innermost ones go until none is left
            last = out
            for pattern in _QUOTES:
                out = pattern.sub("\n", out)
        out = _LEFT_OVER.sub("\n", out)
    if ">" in out or "&gt;" in out:
        out = _QUOTED_LINE.sub("", out)
    if any(verb in out for verb in _VERBS):
        out = _INTRODUCES.sub("", out)
    followed = [m for m in _DIVIDER.finditer(out) if not out[m.end() :].isspace()]
    if followed:
        tail = out[followed[-1].end() + 1 :]
        if len(tail) <= SIGNATURE_CHARS and tail.rstrip().count("\n") < SIGNATURE_LINES:
            out = out[: followed[-1].start()]
    for sign, pattern in _SIGNATURES:
        if sign in low:
            out = pattern.sub("\n", out)
    return out


def cut_terms(text: str) -> list[str]:
    """Links, hashtags, numbers and words of the own text, in order."""
    out = strip_others(text)
    if "[" in out:
        out = _LINK_CODE.sub(r" \1 ", out)
    if "<" in out:
        out = _LINK_TAG.sub(r" \1 ", out)
    if "[" in out or "<" in out or "&" in out:
        out = _MARKUP.sub(" ", out)
    return _term().findall(out.lower())


def own_text(text: Column) -> Column:
    """strip_others as a column function."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else strip_others(t)), "string")(text)


def is_link(term: str) -> bool:
    return term.startswith(("http://", "https://", "www."))


def _kind(term: str) -> str:
    return LINK if is_link(term) else TAG if term[0] == "#" else NUMBER if term[0].isnumeric() else term


_TERMS = "row long, doc_id long, lang string, terms string, words string, links int, freqs array<int>, terms_of array<int>"


def _lists(of: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """values by the post of each, of n posts."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), values)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per post: its terms and its different words, each as one text, links, and how many terms occur with each frequency."""
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        cut = [cut_terms(t) for t in batch.column("text").to_pylist()]
        sizes = np.array([len(c) for c in cut], np.int64)
        kept = pa.array(np.flatnonzero(sizes))
        n, sizes = len(kept), sizes[sizes > 0]
        flat = pa.array([t for c in cut for t in c], pa.string())
        coded = pc.dictionary_encode(flat)
        # Kinds are told of different terms only; their numbers follow the order of their texts.
        kinds = [_kind(t) for t in coded.dictionary.to_pylist()]
        known = sorted(set(kinds))
        rank = {k: i for i, k in enumerate(known)}
        kind_of = np.array([rank[k] for k in kinds], np.int64)[coded.indices.to_numpy()] if n else np.zeros(0, np.int64)
        v = len(known) + 1
        pairs, f = np.unique(np.repeat(np.arange(n), sizes) * v + kind_of, return_counts=True)
        post, code = pairs // v, pairs % v
        words = pc.binary_join(_lists(post, pa.array(known, pa.string()).take(pa.array(code)), n), " ")
        links = np.zeros(n, np.int32)
        if LINK in rank:
            links[post[code == rank[LINK]]] = f[code == rank[LINK]]
        most = int(f.max(initial=0)) + 1
        spectrum, k = np.unique(post * most + (most - 1 - f), return_counts=True)  # highest frequency first
        of = spectrum // most
        made = [
            pa.array([" ".join(c) for c in cut if c], pa.string()), words, pa.array(links),
            _lists(of, pa.array((most - 1 - spectrum % most).astype(np.int32)), n), _lists(of, pa.array(k.astype(np.int32)), n),
        ]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(kept) for c in ("row", "doc_id", "lang")), *made], [c.split(" ")[0] for c in _TERMS.split(", ")])


def cut_posts(documents: DataFrame) -> DataFrame:
    """The terms of all posts that have any, written once; rows get numbers."""
    usable = spread(documents).filter("doc_id is not null and text is not null").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    return durable_table(usable.mapInArrow(_cut, _TERMS))


def prose_models(posts: DataFrame) -> DataFrame:
    """posts (lang, words) to (lang, term, n, texts): in how many of a language's different texts a word occurs."""
    texts = posts.filter("lang is not null").groupBy("lang", "words").agg(F.lit(1).alias("one"))
    # Markers of links, hashtags and numbers are no words. An empty term counts the texts themselves.
    words = F.filter(F.split("words", " "), lambda w: w > F.lit(NUMBER))
    counted = durable(texts.select("lang", F.explode_outer(F.array_append(words, F.lit(""))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n")))
    sizes = counted.filter("term = ''").select("lang", F.col("n").alias("texts")).filter(F.col("texts") >= LEAST_TEXTS)
    sizes = F.broadcast(sizes.orderBy(F.desc("texts"), "lang").limit(LANGUAGES))
    common = counted.filter("term != ''").join(sizes, "lang").filter(F.col("n") >= F.col("texts") * COMMON)
    ranked = common.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term")))
    return ranked.filter(F.col("_r") <= MODEL_TERMS).drop("_r")


Models = dict[str, tuple[list[str], list[int], int]]


def learn_models(posts: DataFrame) -> Models:
    """Language to (words, texts with each, all texts); bounded by MODEL_TERMS and LANGUAGES."""
    out: Models = {}
    for r in prose_models(posts).collect():
        words, counts, _ = out.setdefault(r.lang, ([], [], r.texts))
        words.append(r.term)
        counts.append(r.n)
    return dict(sorted(out.items()))


_SCORED = "row long, doc_id long, lang string, best_lang string, n long, links int, nearness double, words string, freqs array<int>, terms_of array<int>, bins array<int>, bin_n array<int>"


def _score(shared):
    """Per post: the best fitting language, its middle window's nearness to prose, and the histogram of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: Models = shared.value
        names = np.array([*models], object)
        logs = []
        for _, counts, texts in models.values():  # without the text itself
            others = (np.array(counts, float) - 1) / max(1, texts - 1)
            logs.append(np.append(np.log(np.maximum(others, COMMON / 2)), FLOOR))
        words = [pa.array(w, pa.string()) for w, _, _ in models.values()]
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            lists = pc.split_pattern(batch.column("terms"), " ")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.dictionary_encode(pc.list_flatten(lists))
            codes = flat.indices.to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            best, total, value = np.zeros(len(sizes), int), np.full(len(sizes), -np.inf), np.zeros(len(codes))
            for k, (own, log) in enumerate(zip(words, logs)):
                at = pc.fill_null(pc.index_in(flat.dictionary, value_set=own), len(own)).to_numpy(zero_copy_only=False)
                shares = log[at][codes]
                sums = np.add.reduceat(shares, starts)
                better = sums > total + 1e-9
                best[better], total[better] = k, sums[better]
                value = np.where(np.repeat(better, sizes), shares, value)
            post = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(codes))
            low, high = np.maximum(starts[post], place - NEAR // 2), np.minimum(ends[post], place + NEAR // 2 + 1)
            sums = np.concatenate([[0.0], np.cumsum(value)])
            near = np.round((sums[high] - sums[low]) / (high - low), 9)
            # The middle window by characters.
            weight = pc.utf8_length(flat.dictionary).to_numpy(zero_copy_only=False)[codes].astype(np.int64)
            order = np.lexsort((near, post))
            upto = np.cumsum(weight[order])
            before = np.concatenate([[0], upto])[starts]
            middle = near[order][np.searchsorted(upto, before + (upto[ends - 1] - before) / 2)]
            kept, n = np.unique(post * BINS + np.clip(((near - FLOOR) / -FLOOR * BINS).astype(np.int64), 0, BINS - 1), return_counts=True)
            bins, bin_n = (_lists(kept // BINS, pa.array(x.astype(np.int32)), len(sizes)) for x in (kept % BINS, n))
            made = {"best_lang": pa.array(names[best], pa.string()), "n": pa.array(sizes), "nearness": pa.array(middle), "bins": bins, "bin_n": bin_n}
            order_of = [f.split(" ")[0] for f in _SCORED.split(", ")]
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in order_of], order_of)

    return run


def rank_frequency(posts: DataFrame, carried: Column) -> DataFrame:
    """posts (row, freqs, terms_of), where terms_of[i] terms occur freqs[i] times each, to (row, carried, slope, residual,
    level) of log frequency fitted on log rank; terms of one frequency stand at their middle rank.

    carried goes with the first point, so that nothing has to be joined back.
    """
    points = posts.select("row", F.posexplode(F.arrays_zip("freqs", "terms_of")).alias("i", "p"), carried.alias("_c"))
    narrow = points.select("row", F.col("p.freqs").alias("f"), F.col("p.terms_of").alias("k"), F.when(F.col("i") == 0, F.col("_c")).alias("_c"))
    upto = F.sum("k").over(Window.partitionBy("row").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = narrow.withColumn("_upto", upto)
    logs = ranked.select("row", "_c", F.col("k").cast("double").alias("w"), F.log(F.col("_upto") - (F.col("k") - 1) / 2).alias("x"), F.log("f").alias("y"))
    sums = {"w": F.col("w"), "x": F.col("w") * F.col("x"), "y": F.col("w") * F.col("y"), "xx": F.col("w") * F.col("x") * F.col("x"), "xy": F.col("w") * F.col("x") * F.col("y"), "yy": F.col("w") * F.col("y") * F.col("y")}
    fit = logs.groupBy("row").agg(F.max("_c").alias("_c"), *[F.sum(c).alias(name) for name, c in sums.items()])
    centred = fit.select("row", "_c", "w", (F.col("y") / F.col("w")).alias("level"), *[(F.col(a + b) - F.col(a) * F.col(b) / F.col("w")).alias(f"s{a}{b}") for a, b in ("xx", "xy", "yy")])
    slope = F.when(F.col("sxx") > 1e-9, F.col("sxy") / F.col("sxx")).otherwise(0.0)
    lined = centred.withColumn("slope", slope)
    residual = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("w"))
    return lined.select("row", "_c", "slope", residual.alias("residual"), "level")


_CURVE = ("slope", "residual", "level")


def _quartiles(texts: DataFrame, *keys: str) -> DataFrame:
    """Quartiles of the curves, and the number of texts, by keys; accurate to a thousandth of the texts."""
    middle = lambda c: F.percentile_approx(c, [0.25, 0.75], 1000).alias(f"q_{c}")
    return texts.groupBy(*keys).agg(F.count("*").alias("texts"), *[middle(c) for c in _CURVE])


def _window_quartiles(texts: DataFrame) -> DataFrame:
    """(best_lang, near_low, near_high): quartiles of the nearness of all windows of a language's prose, from bins."""
    bins = texts.select("best_lang", F.explode(F.arrays_zip("bins", "bin_n")).alias("b")).groupBy("best_lang", F.col("b.bins").alias("bin")).agg(F.sum("b.bin_n").alias("n"))
    own = Window.partitionBy("best_lang")  # at most BINS rows
    share = F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("n").over(own)
    placed = bins.withColumn("_share", share).withColumn("_value", FLOOR - (F.col("bin") + 0.5) / BINS * FLOOR)
    return placed.groupBy("best_lang").agg(F.min(F.when(F.col("_share") >= 0.25, F.col("_value"))).alias("near_low"), F.min(F.when(F.col("_share") >= 0.75, F.col("_value"))).alias("near_high"))


def _range(low: Column, high: Column, name: str) -> Column:
    return F.greatest(high - low, F.lit(LEAST_RANGE[name]))


def page_scores(documents: DataFrame) -> DataFrame:
    """(doc_id, n, links, best_lang, nearness, slope, residual, level, divergence, curve_far, spam) of each row with
    terms: divergence and curve_far are distances from prose in interquartile ranges; divergence is null in a language
    without a model."""
    spark = documents.sparkSession
    posts = cut_posts(documents)
    models = learn_models(posts)
    if not models:  # no language is known well enough: one model over all posts
        models = learn_models(posts.withColumn("lang", F.lit("")))
        posts = posts.withColumn("lang", F.when(F.lit(bool(models)), "").otherwise(F.col("lang")))
    models = models or {"": ([], [], 0)}
    scored = posts.select("row", "doc_id", "lang", "terms", "links", "words", "freqs", "terms_of").mapInArrow(_score(ship(spark, models)), _SCORED)
    # Posts that only differ in the order of their words are one text here.
    carried = F.struct("doc_id", "lang", "best_lang", "n", "links", "nearness", F.xxhash64("words").alias("same"), "bins", "bin_n")
    judged = rank_frequency(scored, carried).select("_c.*", *_CURVE, F.floor(F.log2("_c.n")).cast("int").alias("size"))
    # What a language without a model is written in isn't known.
    judged = durable(judged.withColumn("known", F.col("lang").isNull() | F.col("lang").isin([*models])))
    # Prose: different texts in the language that they are said to be in, of which spam is the smaller part.
    agreed = judged.filter(F.col("lang") == F.col("best_lang"))
    texts = durable(agreed.select("best_lang", "size", "same", "bins", "bin_n", *_CURVE).distinct())
    by_lang = F.broadcast(_window_quartiles(texts))
    by_size = F.broadcast(_quartiles(judged.select("size", "same", *_CURVE).distinct(), "size").drop("texts"))
    by_both = F.broadcast(_quartiles(texts, "best_lang", "size").filter(F.col("texts") >= LEAST_TEXTS).drop("texts"))
    own = by_both.select("best_lang", "size", *[F.col(f"q_{c}").alias(f"own_{c}") for c in _CURVE])
    held = judged.join(by_lang, "best_lang", "left").join(by_size, "size", "left").join(own, ["best_lang", "size"], "left")

    def far(c: str) -> Column:
        q = F.coalesce(F.when(F.col("known"), F.col(f"own_{c}")), F.col(f"q_{c}"))
        low, high = F.get(q, F.lit(0)), F.get(q, F.lit(1))
        return F.greatest(low - F.col(c), F.col(c) - high) / _range(low, high, c)

    divergence = F.when(F.col("known"), (F.col("near_low") - F.col("nearness")) / _range(F.col("near_low"), F.col("near_high"), "nearness"))
    out = held.select("doc_id", "n", "links", "best_lang", "nearness", *_CURVE, divergence.alias("divergence"), F.greatest(*[far(c) for c in _CURVE]).alias("curve_far"))
    d, c = F.col("divergence"), F.col("curve_far")
    extreme = (d > FAR_ALONE) | ((d > OUTER) & (c > 0)) | ((d > INNER) & (c > EXTREME)) | (d.isNull() & (c > EXTREME_ALONE))
    enough = (F.col("n") >= LEAST_TERMS) | (F.col("links") >= LEAST_LINKS)
    return out.withColumn("spam", F.coalesce(enough & extreme, F.lit(False)))


def spam_posts(documents: DataFrame) -> DataFrame:
    """(doc_id) of the posts that are spam."""
    return page_scores(documents).filter("spam").select("doc_id").distinct()
