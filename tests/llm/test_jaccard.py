"""Near copies by exact Jaccard similarity: brute force over all pairs, and the pipeline's stage."""

import random

import numpy as np

import corpus_pipeline as pipeline
from pagelens.llm import jaccard, neardup
from pagelens.session import materialize
from tests.llm import brute
from tests.llm.test_pipeline import check_stage


def family(seed, n, edits, size=120):
    """Texts that differ from one text in up to ``edits`` words each."""
    r = random.Random(seed)
    base = [f"w{seed}x{r.randrange(10**6)}" for _ in range(size)]
    for _ in range(n):
        words = list(base)
        for i in r.sample(range(size), r.randrange(edits + 1)):
            words[i] = f"e{r.randrange(10**6)}"
        yield " ".join(words)


def test_groups_equal_brute_force(spark):
    # up to 4 edits of 5 shingles each straddle the similarity of 0.8, within a family and between its members
    texts = [t for seed in range(12) for t in family(seed, 12, 4)] + list(family(99, 150, 3)) + [None, "", "one", "ONE", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = neardup.one_of_each(docs, 0.8, 5).collect()
    assert sorted(r.doc_id for r in rows) == brute.kept_ids(list(enumerate(texts)))
    assert neardup.one_of_each(docs.filter("false"), 0.8, 5).collect() == []


def test_groups_that_share_an_identifier_keep_a_row_each(spark):
    one, two, none = (list(family(seed, 1, 0))[0] for seed in (1, 2, 3))
    rows = [(6, one), (6, two), (7, one), (None, none), (None, none + " more"), (None, two), (6, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in neardup.one_of_each(docs, 0.8, 5).collect()), key=repr)
    assert [r[0] for r in kept if r[0] is not None] == brute.kept_ids(rows) == [6, 6]
    assert {r for r in kept if r[0] is not None} == {(6, one), (6, two)} and len(kept) == 3


def test_borderline_members_are_compared_in_later_rounds(monkeypatch, spark):
    monkeypatch.setattr(jaccard, "PARTNERS", 1)
    texts = list(family(5, 60, 6))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.one_of_each(docs, 0.8, 5).collect()) == brute.kept_ids(list(enumerate(texts)))


def test_bands_meet_nearly_all_pairs_at_the_bound():
    r, met = np.random.default_rng(3), 0
    for _ in range(1000):
        both, a, b = r.integers(0, 2**64, 160, dtype=np.uint64), *r.integers(0, 2**64, (2, 20), dtype=np.uint64)
        least = np.stack([jaccard.minima(np.r_[both, x]) for x in (a, b)])
        one, other = jaccard.band_keys(least)
        x, y = jaccard.sketches(least)
        met += bool((one == other).any() and np.bitwise_count(x ^ y).sum() <= jaccard.most_differing(0.8))
    assert met >= 998


def test_a_large_group_takes_few_comparisons():
    label, r = np.arange(6000), np.random.default_rng(1)
    a, b, full = jaccard.candidates(label, np.zeros((6000, 4), dtype=np.uint64), 50, 4)
    assert full and len(a) <= 4 * 6000 and np.bincount(b).max() <= 8
    assert jaccard.candidates(np.zeros(6000, dtype=np.int64), r.integers(0, 9, (6000, 4)).astype(np.uint64), 50, 4)[2] is False


def test_every_stage_with_near_copies_by_similarity(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), "stage")
        after = docs.collect()
        if name == "near_copies":
            assert sorted(r.doc_id for r in after) == brute.kept_ids([(r.doc_id, r.text) for r in before])
            assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
        else:
            check_stage(name, before, after, docs)
        before = after


def test_bin_counts_never_tell_a_link_apart():
    r = np.random.default_rng(4)
    for size, apart in ((40, 4), (200, 20), (3000, 320), (30_000, 3300)):
        both, a, b = (r.integers(0, 2**64, n, dtype=np.uint64) for n in (size, apart, apart))
        x, y = np.unique(np.r_[both, a]), np.unique(np.r_[both, b])
        one, other = (np.frombuffer(jaccard.bin_counts(s), dtype=np.uint8) for s in (x, y))
        assert jaccard.alike(x, y) >= 0.8 and jaccard.may_be_alike(one, other[None], jaccard.alike(x, y)).all()
    far = np.frombuffer(jaccard.bin_counts(np.unique(np.r_[both[:200], a[:40]])), dtype=np.uint8)
    near = np.frombuffer(jaccard.bin_counts(np.unique(np.r_[both[:200], b[:40]])), dtype=np.uint8)
    assert not jaccard.may_be_alike(far, near[None], 0.8).any()  # similarity 0.71
    assert jaccard.bin_counts(r.integers(0, 2**64, 300_000, dtype=np.uint64)) == b""
    assert jaccard.may_be_alike(np.zeros(jaccard.BINS, dtype=np.uint8), near[None], 0.8).all()


def test_pairs_compared_follow_the_members_of_a_group(monkeypatch, spark):
    compared = []
    plain = jaccard.similarities
    monkeypatch.setattr(jaccard, "similarities", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    counts = {}
    for n in (100, 400):  # up to 6 edits of 5 shingles: half of the pairs are links, nearly all others look like links to the sketches
        texts = list(family(8, n, 6))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        compared.clear()
        rows = neardup.one_of_each(docs, 0.8, 5).collect()
        assert sorted(r.doc_id for r in rows) == brute.kept_ids(list(enumerate(texts)))
        counts[n] = sum(compared)
    assert counts[400] <= 4 * 400 and counts[400] <= 6 * counts[100]


def test_pairs_that_share_no_band_are_found(spark):
    r = random.Random(2420)
    words = [f"w{r.randrange(10**6)}" for _ in range(104)]
    one, other = " ".join(words[:84]), " ".join(words)  # 80 of 100 shingles
    least = np.stack([jaccard.minima(jaccard.shingles(t, 5)) for t in (one, other)])
    assert not (jaccard.band_keys(least)[0] == jaccard.band_keys(least)[1]).any()
    rows = [(3, other), (1, one), (2, one), (4, " ".join(words[:83])), (5, " ".join(words + ["x"]))]
    for given in (rows[:2], rows):
        docs = spark.createDataFrame(given, "doc_id long, text string")
        assert sorted(x.doc_id for x in neardup.one_of_each(docs, 0.8, 5).collect()) == brute.kept_ids(given) == [1]


def test_links_do_not_hang_on_bands_or_bits(monkeypatch, spark):
    monkeypatch.setattr(jaccard, "band_keys", lambda least: least.sum(axis=1)[:, None] * np.arange(1, 25, dtype=np.uint64))  # none is shared
    for sifted in (jaccard.SIFTED, 1):
        monkeypatch.setattr(jaccard, "SIFTED", sifted)
        texts = [t for seed in range(6) for t in family(seed, 12, 4)] + list(family(98, 40, 3)) + [None, "", "one", "ONE", "one two", "one two three four five six"]
        rows = list(enumerate(texts))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(r.doc_id for r in neardup.one_of_each(docs, 0.8, 5).collect()) == brute.kept_ids(rows)


def test_alike_sets_share_one_of_their_rarest():
    r = np.random.default_rng(6)
    level = r.integers(0, 255, jaccard.SLOTS).astype(np.uint8)
    for size, apart in ((4, 1), (40, 10), (8, 1), (400, 50), (80, 20), (900, 220)):
        for _ in range(200):
            both, a, b = (r.integers(0, 2**64, n, dtype=np.uint64) for n in (size, r.integers(apart + 1), apart))
            x, y = np.unique(np.r_[both, a]), np.unique(np.r_[both, b])
            if jaccard.alike(x, y) < 0.8:
                continue
            p, q = (jaccard.rarest(s, level, 0.8) for s in (x, y))
            i, j = next((i, int(np.nonzero(q == k)[0][0])) for i, k in enumerate(p) if k in q)
            size_of, left = np.array([[len(x), len(y)]]), np.array([[len(x) - i, len(y) - j]])
            assert jaccard.has_partner(np.array([[1, 2]]), size_of, left, 0.8).all()
    far = jaccard.has_partner(np.array([[1, 2, 2]]), np.array([[80, 101, 101]]), np.array([[80, 101, 101]]), 0.8)
    assert not far.any()
