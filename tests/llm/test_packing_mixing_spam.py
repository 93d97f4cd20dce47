"""Packing, mixing and spam: invariants, brute force and edge cases."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import mixing, packing, spam
from lexweave.llm.tokens import TOKENIZER, encoding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_what_fits(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 101, rng.integers(0, 400))
    bins = packing.harmonic_bins(lengths, 100)
    sums = np.bincount(bins, weights=lengths) if len(bins) else np.zeros(0)
    assert (sums <= 100).all()
    # No two bins but the fullest ones could be one: at most one bin is at most half full.
    assert (sums[sums > 0] * 2 <= 100).sum() <= 1
    assert len(sums) <= max(1, 1.25 * lengths.sum() / 100 + 1)


def test_pieces():
    post, first, tokens = packing.pieces(np.array([0, 5, 10, 11, 25]), 10)
    assert list(zip(post, first, tokens)) == [(0, 0, 0), (1, 0, 5), (2, 0, 10), (3, 0, 10), (3, 10, 1), (4, 0, 10), (4, 10, 10), (4, 20, 5)]


def test_packed_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("container"))
    extra = spark.createDataFrame([(-1, None, 1), (-2, "", 1), (None, "word", 1), (-3, "word " * 5000, 1), (-4, "same", 1), (-4, "same", 1)], "doc_id long, text string, container int")
    rows = packing.pack_documents(docs.unionByName(extra)).collect()
    encode = encoding(TOKENIZER).encode_ordinary
    sizes = {}
    for r in rows:
        sizes[r.container] = sizes.get(r.container, 0) + r.n_tokens
    assert max(sizes.values()) <= packing.CAPACITY
    whole = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n_tokens
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(whole[d] == len(encode(t or "")) for d, t in texts.items())
    assert whole[-1] == whole[-2] == 0 and whole[-3] == len(encode("word " * 5000)) and whole[-4] == 2 * len(encode("same"))
    assert [r.piece for r in rows if r.doc_id == -3] == list(range(len([r for r in rows if r.doc_id == -3])))
    assert packing.pack_documents(docs.limit(0)).count() == 0


def brute_sainte_lague(weights, seats, caps):
    own = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if own[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        own[max(open_, key=lambda i: (Fraction(weights[i]) / (2 * own[i] + 1), -i))] += 1
    return own


def test_apportionment_against_one_by_one():
    rng = random.Random(2)
    for _ in range(300):
        weights = [rng.choice([0, 1, 2, 3, 10, 50, 200]) for _ in range(rng.randrange(1, 7))]
        seats = rng.randrange(0, 120)
        caps = [rng.choice([0, 3, 40, 1000]) for _ in weights]
        assert mixing.sainte_lague(weights, seats, caps) == brute_sainte_lague(weights, seats, caps)


def test_mix(spark):
    docs, targets = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "mix_targets"))
    mix = mixing.mix_documents(docs, targets).cache()
    repeats = {r.source: r.max_repeats for r in targets.collect()}
    assert all(r.copies <= repeats[r.source] for r in mix.collect())
    assert mix.count() == mix.select("doc_id").distinct().count()
    shares = mixing.mix_shares(mix, targets).collect()
    total = sum(r.tokens for r in shares)
    for r in shares:
        assert abs(r.actual_share - r.target_share) < 0.01 + 2 * 2048 / total
    assert {tuple(r) for r in mixing.mix_documents(docs, targets).collect()} == {tuple(r) for r in mix.collect()}


def test_no_post_is_left_that_fits(spark):
    """In each shard the last pass takes every post in seeded order that fits, as a loop does."""
    docs, targets = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "mix_targets"))
    mix = {r.doc_id: r for r in mixing.mix_documents(docs, targets, total_tokens=60_000).collect()}
    tokens = {}
    for r in docs.filter("source is not null and text != ''").collect():
        tokens.setdefault(r.source, {})[r.doc_id] = mixing.token_counts(mixing.pa.array([r.text]), mixing.TOKENIZER)[0]
    wanted = [(r.source, r.target_share, r.max_repeats) for r in targets.orderBy("source").collect()]
    shards, quotas = mixing.plan_sources({s: sum(t.values()) for s, t in tokens.items()}, wanted, total=60_000)
    assert shards == 1
    for source, quota, repeats in quotas:
        ((_, passes, rest),) = mixing.plan_shards([(0, sum(tokens[source].values()))], quota, repeats)
        gap = rest - sum(n for d, n in tokens[source].items() if d in mix and mix[d].copies > passes)
        left = [n for d, n in tokens[source].items() if (mix[d].copies if d in mix else 0) == passes]
        assert gap >= 0 and (not left or min(left) > gap)


def test_mix_where_joins_change_at_run_time(spark):
    """A sort-merge join that becomes a broadcast join at run time gives up its partitioning; shards stay whole."""
    docs, targets = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "mix_targets"))
    want = {tuple(r) for r in mixing.mix_documents(docs, targets).collect()}
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert {tuple(r) for r in mixing.mix_documents(docs, targets).collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        for k, v in before.items():
            spark.conf.set(k, v)


def test_two_targets_of_a_source(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "x y z " * 2000) for i in range(20)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), ("a", 0.1, 9)], "source string, target_share double, max_repeats int")
    shares = {r.source: r.target_share for r in mixing.mix_shares(mixing.mix_documents(docs, targets), targets).collect()}
    assert shares == {"a": 0.5, "b": 0.5}


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, "a", "x y z"), (2, "a", None), (3, "b", ""), (4, None, "q"), (5, "c", "w " * 9000), (6, "a", "x y z")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, None), ("b", 0.3, 1), ("c", 0.2, 2), (None, 0.1, 1), ("d", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_documents(docs, targets)
    assert {r.source for r in mix.collect()} <= {"a", "c"}
    assert mixing.mix_documents(docs.limit(0), targets).count() == 0
    assert mixing.mix_documents(docs, targets.limit(0)).count() == 0


SPAM = [
    "cheap socks buy online cheap socks buy cheap socks deal cheap socks cheap online",
    "Hello!\nhttp://a.example/x\nhttp://b.example/y\nhttp://c.example/z\nhttp://d.example/q",
    "#sale #top #2024 #discount #sale #best #price #sale #shipping #sale",
    "[url=http://a.example]cheap socks[/url] [url=http://b.example]cheap socks[/url] [url=http://c.example]cheap socks[/url] [url=http://d.example]cheap socks[/url]",
]
HAM = ["Bump.", None, "", "[quote]" + SPAM[0] + "[/quote]\nPlease report this and do not click any of it, thanks.", "> " + SPAM[0] + "\n+1", "[deleted]"]


def test_spam(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    extra = spark.createDataFrame([(-1 - i, "en", t) for i, t in enumerate(SPAM)] + [(-100 - i, "en", t) for i, t in enumerate(HAM)] + [(None, "en", SPAM[0])], "doc_id long, lang string, text string")
    found = {r.doc_id for r in spam.spam_posts(docs.unionByName(extra)).collect()}
    assert {-1 - i for i in range(len(SPAM))} <= found
    assert not {-100 - i for i in range(len(HAM))} & found
    share = len([d for d in found if d > 0]) / docs.count()
    assert 0.02 < share < 0.12


def test_copies_of_spam_stay_spam(spark):
    """One keyword text as a third of all rows doesn't become prose."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    before = {r.doc_id for r in spam.spam_posts(docs).collect()}
    n = docs.count() // 2
    copies = spark.range(n).select((-1 - F.col("id")).alias("doc_id"), F.lit("en").alias("lang"), F.lit("vellum discount; vellum discount top; vellum store discount; discount vellum online; vellum top").alias("text"))
    found = {r.doc_id for r in spam.spam_posts(docs.unionByName(copies)).collect()}
    assert len([d for d in found if d < 0]) == n
    assert len(before - found) <= 0.01 * len(before)


def test_spam_without_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.lit(None).cast("string").alias("lang"), "text")
    extra = spark.createDataFrame([(-1 - i, None, t) for i, t in enumerate(SPAM)] + [(-100 - i, None, t) for i, t in enumerate(HAM)], "doc_id long, lang string, text string")
    found = {r.doc_id for r in spam.spam_posts(docs.unionByName(extra)).collect()}
    assert {-1 - i for i in range(len(SPAM))} <= found
    assert not {-100 - i for i in range(len(HAM))} & found


def test_spam_without_posts(spark):
    assert spam.spam_posts(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0


def test_own_text(spark):
    texts = ["> a\nmine", "[quote=x][quote]a[/quote]b[/quote]mine", "<blockquote>a</blockquote>mine", "joe wrote:\n> a\nmine", "mine\n-- \nme", "mine\n~ me ~", "[quote]" + "a" * 100_000 + "[/quote]mine"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1].strip() for r in df.select("i", spam.own_text(F.col("t"))).orderBy("i").collect()] == ["mine"] * len(texts)


def test_long_text_after_a_divider_is_own_text(spark):
    long = "cheap socks online " * 40
    cases = [
        ("a\n***\n" + long + "\n-- \nme", "a *** " + long),
        ("a\n=====\n" + long, "a ===== " + long),
        ("a\n_____\n" + "b\n" * 50, "a _____ " + "b " * 50),
        ("a\n***\nb\n-- \nme\n=====\n", "a *** b"),
        ("[size=1]" + long, "[size=1]" + long),
        ("a [size=1]me", "a"),
        ("[quote]" * 40 + "b" + "[/quote]" * 40 + "a", "a"),
        ("[quote]a[quote]" + "<blockquote>" * 9 + "b" + "</blockquote>" * 9 + "[/quote]c[/quote]d", "d"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = [" ".join(r[1].split()) for r in df.select("i", spam.own_text(F.col("t"))).orderBy("i").collect()]
    assert got == [" ".join(c[1].split()) for c in cases]


def test_rare_language_is_judged_alike(spark):
    """Posts of a language get the same verdicts where it has only 40 posts; an unknown language is judged by curves alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "text")
    few = [r.doc_id for r in docs.filter("lang = 'fr' and doc_id % 7 = 1").orderBy("doc_id").limit(40).collect()]
    whole = {r.doc_id for r in spam.spam_posts(docs).collect()} & set(few)
    part = docs.filter((F.col("lang") != "fr") | F.col("doc_id").isin(few))
    assert {r.doc_id for r in spam.spam_posts(part).collect()} & set(few) == whole
    finnish = "Tämä kirja on hyvin vanha ja sen sivut ovat kellastuneet, mutta sana näkyy vielä selvästi rivin lopussa."
    more = spark.createDataFrame([(-1, "fi", finnish), (-2, "fi", "halpa kello " * 60)], "doc_id long, lang string, text string")
    assert {r.doc_id for r in spam.spam_posts(docs.unionByName(more)).collect() if r.doc_id < 0} == {-2}


def test_curve_and_divergence_both_decide(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "text")
    rows = [r for r in spam.page_scores(docs).collect() if r.n >= spam.LEAST_TERMS or r.links >= spam.LEAST_LINKS]
    found = {r.doc_id for r in rows if r.spam}
    assert found != {r.doc_id for r in rows if r.divergence is not None and r.divergence > spam.FAR_ALONE}
    assert found != {r.doc_id for r in rows if r.divergence is not None and r.divergence > spam.OUTER}
    assert found < {r.doc_id for r in rows if r.curve_far > 0}  | {r.doc_id for r in rows if r.divergence is not None and r.divergence > spam.FAR_ALONE}


def test_fit_against_least_squares(spark):
    import numpy as np

    df = spark.createDataFrame([(1, [9, 4, 1], [1, 2, 5]), (2, [3], [4]), (3, [7], [1])], "row long, freqs array<int>, terms_of array<int>")
    got = {r.row: r for r in spam.rank_frequency(df, F.col("row")).collect()}
    x = np.log([1, 2.5, 2.5, 6, 6, 6, 6, 6])
    y = np.log([9, 4, 4, 1, 1, 1, 1, 1])
    slope, start = np.polyfit(x, y, 1)
    assert np.isclose(got[1].slope, slope) and np.isclose(got[1].level, y.mean())
    assert np.isclose(got[1].residual, np.sqrt(((y - slope * x - start) ** 2).mean()))
    assert (got[2].slope, got[2].residual) == (0, 0) and np.isclose(got[2].level, np.log(3)) and got[3].slope == 0
