"""Operators on documents: edge rows against plain versions, and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from pagelens.llm import langid, mixing, neardup, packing, pii, quality, rules
from tests.llm import brute
from tests.llm.conftest import CLASHES, edge_rows

ROWS = edge_rows()
IDS = Counter(r[0] for r in ROWS)


@pytest.fixture(scope="module")
def labels(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
    return spark.createDataFrame([(0, 1, 0), (0, 1, 0), (7, 0, 0), (6, 1, None), (8, 0, 1), (None, 1, 0), (9, None, 0), (99, 0, 0), (20, 1, 0), (21, 1, 0), (22, 1, 0)], schema)


def test_identifiers_equal_those_of_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for _, text, *_ in ROWS:
        if text is not None and len(text) < 10_000:
            assert packing.token_ids(text).tolist() == [*other.encode(text, add_special_tokens=False).ids, 0]
    odd = "<|endoftext|> a  b\n\n\tc d'll 12345 é中\U0001f600"
    assert packing.token_ids(odd).tolist() == [*other.encode(odd, add_special_tokens=False).ids, 0]


def check_packing(rows, texts):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    left = defaultdict(list)
    for r in rows:
        left[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for doc_id, text in texts:  # each text takes one run of pieces that covers it
        ids, at = packing.token_ids(text), 0
        while at < len(ids):
            piece = next(p for p in left[doc_id] if p[0] == at and p[3] == len(ids) and p[2] == zlib.crc32(ids[at:at + p[1]].tobytes()))
            left[doc_id].remove(piece)
            at += piece[1]
        assert at == len(ids)
    assert not any(left.values())
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing(edge, nothing):
    check_packing(packing.packed(edge).collect(), [r[:2] for r in ROWS])
    assert packing.packed(nothing).collect() == []


def test_an_awkward_length_is_cut(spark):
    text = " ".join(f"w{i}" for i in range(300))
    n = len(packing.token_ids(text))
    assert 512 < n < 1000
    docs = spark.createDataFrame([(i, text) for i in range(64)], "doc_id long, text string")
    rows = packing.packed(docs).collect()
    check_packing(rows, [(i, text) for i in range(64)])
    assert len({r.sequence_id for r in rows}) < 64 and {r.length for r in rows} == {512, n - 512}


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_and_pads_little(seed):
    rng = np.random.default_rng(seed)
    h = np.zeros(1025, dtype=np.int64)
    lengths = rng.integers(1, 1025, 3000) if seed % 2 else np.minimum(1024, rng.geometric(0.005, 3000))
    np.add.at(h, lengths, 1)
    used, total = np.zeros_like(h), 0
    for parts, times in packing.plan(h):
        assert sum(parts) <= 1024 and times > 0
        total += times
        for n in parts:
            used[n] += times
    assert (used == h).all()
    assert total <= 1.02 * lengths.sum() / 1024 + 1


def test_nnls_lowers_the_misfit():
    h = np.zeros(1025, dtype=np.int64)
    h[[300, 724, 512]] = [40, 40, 10]
    combos = packing.combinations(1024, np.nonzero(h)[0])
    x = packing.nnls(combos, h)
    assert np.allclose(sorted(x), [5, 40], atol=0.1)


def test_near_copies(edge, nothing):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in neardup.groups(edge).collect()), key=repr)
    assert got == sorted(brute.linked([r[:2] for r in ROWS]), key=repr)
    assert neardup.groups(nothing).collect() == []


def test_one_of_each_group_stays_with_its_columns(edge, nothing):
    out = neardup.one_of_each(edge)
    assert out.columns == edge.columns
    rows = out.collect()
    groups = brute.linked([r[:2] for r in ROWS])
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted({c for _, _, c in groups if c is not None})
    bare = {f for _, f, c in groups if c is None}
    assert len([r for r in rows if r.doc_id is None]) == len(bare)
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    assert neardup.one_of_each(nothing).collect() == []


def test_every_pair_within_three_bits_shares_a_key():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    offered, plain = defaultdict(set), defaultdict(set)
    for key, fp, side in zip(*neardup.key_rows(a)):
        if side & 1:
            offered[fp].add(key)
    for key, fp, side in zip(*neardup.key_rows(b)):
        if side & 2:
            plain[fp].add(key)
    assert all(offered[x] & plain[y] for x, y in zip(a, b))


def test_golay_decoding_is_perfect():
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000).astype(np.uint32)
    fixed = words ^ neardup.ERRORS[neardup._syndromes(words)]
    assert (neardup._syndromes(fixed) == 0).all() and (np.bitwise_count(words ^ fixed) <= 3).all()


def test_dense_family_of_fingerprints(spark):
    """Thousands of fingerprints around one centre: the same components as comparing all pairs."""
    rng = np.random.default_rng(2)
    fps = {0x0123456789ABCDEF}
    while len(fps) < 1500:
        f = 0x0123456789ABCDEF
        for bit in rng.choice(14, rng.integers(1, 9), replace=False):
            f ^= 1 << int(bit) * 4
        fps.add(f)
    fps |= {int(x) for x in rng.integers(0, 2**63, 300)}
    u = np.array(sorted(fps), dtype=np.uint64)
    hit = np.bitwise_count(u[:, None] ^ u) <= 3
    label = np.arange(len(u))
    while True:
        new = np.array([label[h].min() for h in hit])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long")
    links = neardup.links(df)
    assert links.count() < 40 * len(u)
    got = {r.node: r.label for r in neardup.components(links).collect()}
    names = u.view(np.int64).tolist()
    parts = lambda of: sorted(sorted(x) for x in of.values())
    mine, want = defaultdict(list), defaultdict(list)
    for i, n in enumerate(names):
        mine[got.get(n, n)].append(n)
        want[int(label[i])].append(n)
    assert parts(mine) == parts(want)


def test_personal_data(edge, nothing):
    want = Counter()
    for doc_id, text, *_ in ROWS:
        spans = brute.personal(text)
        want[(doc_id, *(len(spans[k]) for k in pii.KINDS), hashlib.sha256(brute.listed(spans).encode()).hexdigest(), brute.listed(spans))] += 1
    assert Counter(tuple(r) for r in pii.personal_data(edge).collect()) == want
    assert pii.personal_data(nothing).collect() == []


def test_terms_that_give_an_entity_away(spark):
    near = ["codename Zorbax sent", "ask Zorbax about", "to Zorbax from", "Zorbax again wrote", "meets Zorbax by the"]
    rows = [(i, f"the report of {a} ann@x.org today number {i}") for i, a in enumerate(near)]
    rows += [(100 + i, f"the plain text number {i} of today and the report") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    for i, (_, text) in enumerate(rows[:5]):
        a = text.index("Zorbax")
        assert f"term:{a}:{a + 6}" in spans[i] and spans[i].count("term") == 1
    assert all(spans[100 + i] == "" for i in range(200))
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[0] == "the report of codename [TERM] sent [EMAIL] today number 0" and clean[150] == rows[55][1]
    copies = spark.createDataFrame([(i, rows[0][1]) for i in range(50)] + rows[5:], "doc_id long, text string")
    assert all("term" not in r.spans for r in pii.personal_data(copies).collect())


def test_a_disclosing_term_goes_wherever_it_stands(spark):
    far = " and then nothing much was said for quite a while until (Zorbax) came"
    rows = [(i, f"the report {i} of {w} Zorbax {w} ann@x.org {w} number{far}") for i, w in enumerate(("one", "two", "three", "four", "five"))]
    rows += [(5, "nobody wrote but Zorbax, was there"), (5, "nobody wrote but Zorbax, was there"), (6, "Zorbaxes are no Zorba"), (7, None)]
    rows += [(100 + i, f"the plain text number {i} of today and the report and then nothing much was said for quite a while until it came") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows)
    spans = {r.doc_id: r.spans.split(",") for r in got}
    for doc_id, text in rows[:5]:
        at = [m.start() for m in re.finditer("Zorbax", text)]
        assert spans[doc_id][1:] == [f"term:{a}:{a + 6}" for a in at] and len(at) == 2
    assert spans[5] == ["term:17:23"] and spans[6] == spans[7] == spans[100] == [""]
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[5] == "nobody wrote but [TERM], was there" and "Zorbax" not in clean[0] and clean[6] == rows[7][1] and clean[7] is None


def test_redaction_keeps_rows_and_columns(edge):
    out = pii.sanitised(edge)
    assert out.columns == edge.columns
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == IDS and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    assert {r.doc_id: r.text for r in rows}[10] == "[EMAIL] [IP] or [CARD] [PHONE]"
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def check_mix(rows, texts):
    sizes = defaultdict(int)
    for _, text, source in texts:
        sizes[source] += len(brute.words(text))
    want = brute.targets(sizes)
    seen = Counter((r.doc_id, r.size, r.source_size) for r in rows)
    assert seen == Counter((d, len(brute.words(t)), sizes[s]) for d, t, s in texts)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))
    assert {round(r.target, 6) for r in rows} == {round(t, 6) for t in want.values()}


def test_mixing(edge, nothing):
    texts = [(d, t, s) for d, t, _, s, _ in ROWS]
    rows = mixing.mix_documents(edge).collect()
    check_mix(rows, texts)
    assert sorted(rows, key=repr) == sorted(mixing.mix_documents(edge.repartition(7)).collect(), key=repr)
    assert mixing.mix_documents(nothing).collect() == []
    blank = [("", None)] * 3
    empty = edge.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(blank)], "doc_id long, text string, source string")
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix_documents(empty).collect())


def test_mixed_texts_take_the_words_they_are_told(edge):
    out = mixing.mixed_texts(edge)
    assert out.columns == edge.columns
    rows = out.collect()
    taken = Counter()
    for r in mixing.mix_documents(edge).collect():
        taken[r.doc_id] += r.taken
    got = Counter()
    texts = {(d, t) for d, t, *_ in ROWS}
    for r in rows:
        got[r.doc_id] += len(brute.words(r.text))
        assert any(d == r.doc_id and t is not None and t.startswith(r.text) for d, t in texts)
        assert r.n_chars == len(r.text) and all(r[c] == f"own {c}" for c in CLASHES)
    assert +got == +taken


def test_only_texts_at_a_cut_are_shuffled(spark):
    rows = [(i % 900, f"w{i % 900} " * (1 + i % 900 % 13), "abc"[i % 900 % 3]) for i in range(1200)] + [(None, "x y", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_texts(docs)
    want = Counter()
    for r in mixing.mix_documents(docs).collect():
        want[r.doc_id] += r.taken
    got, texts = Counter(), {d: t for d, t, _ in rows}
    for r in out.collect():
        got[r.doc_id] += len(brute.words(r.text))
        assert texts[r.doc_id].startswith(r.text)
    assert got == +want and sum(want.values()) > sum(len(brute.words(t)) for _, t, _ in rows)
    lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
    top = next(i for i, line in enumerate(lines) if "Union" in line)
    depth = lines[top].index("Union")
    second = next(i for i in range(top + 2, len(lines)) if lines[i][depth:depth + 3] == "+- ")
    first = lines[top + 1:second]
    assert any("Scan" in line for line in first) and not any("Exchange" in line and "Broadcast" not in line for line in first)


def test_rules(edge, nothing):
    rows = rules.rule_report(edge).collect()
    want = Counter((r[0], *brute.measures(r[1])) for r in ROWS)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in rows if r.kept} >= set(range(20, 32))
    assert rules.rule_report(nothing).collect() == []


def test_thresholds_follow_the_group(spark):
    values = [("en", "code", 0.2 + i / 1000) for i in range(300)] + [("en", "news", i / 10000) for i in range(300)] + [("fr", "tiny", 0.0)] * 3
    df = spark.createDataFrame([(a, b, *([v] * len(rules.MEASURES))) for a, b, v in values], "lang string, source string, " + ", ".join(f"{m} double" for m, _, _ in rules.MEASURES))
    got = {(r._lang, r._source): r["_symbol_share"] for r in rules.thresholds(df).collect()}
    assert got["en", "code"] == pytest.approx(0.35 + 3 * 0.12, rel=0.05)
    assert got["en", "news"] == pytest.approx(0.015 + 3 * 0.015, rel=0.05)
    assert got["fr", "tiny"] == pytest.approx(got["fr", "tiny"]) and got["fr", "tiny"] > got["en", "news"]


@pytest.mark.parametrize("junk", [40, 200, 350])
def test_junk_in_a_large_part_of_a_source_falls(spark, junk):
    from tests.llm.conftest import prose

    rows = [(i, prose(i), "en", "hot") for i in range(400)] + [(1000 + i, "# " + " ".join(f"{w} *" for w in prose(7).split()), "en", "hot") for i in range(junk)]
    got = rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("doc_id", "kept").collect()
    assert len(got) == len(rows) and all(r.kept == (r.doc_id < 1000) for r in got)


def test_quality(edge, nothing, labels):
    rows = quality.scored(edge, labels).collect()
    assert Counter(r.doc_id for r in rows) == IDS
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    same = {r.score for r in rows if r.doc_id in (0, 5)}
    assert len(same) == 1
    assert quality.scored(nothing, labels).collect() == []
    assert len({r.score for r in quality.scored(edge, labels.filter("false")).collect()}) == 1


def test_ranking_learns_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    good = x[:, 0] + 0.1 * rng.normal(size=400) > -0.8
    model = quality.fit(x, good)
    raw = x @ np.array(model.weights)
    assert ((raw > model.threshold) == good).mean() > 0.95
    assert np.argmax(np.array(model.weights) * x.std(axis=0)) == 0


def test_language(edge, nothing):
    out = langid.language_report(edge)
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == IDS
    texts = {r[0]: r[1] for r in ROWS}
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id in (1, 2, 3, 12):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert r.lang_pred in ("en", "fr")
    assert langid.language_report(nothing).collect() == []
    kept = langid.known_language(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} <= set(IDS)


def test_switching_text_is_labelled_word_by_word():
    rng = np.random.default_rng(3)
    pools = {"a": ["kalo", "kemu", "kira", "kosa", "kuno"], "b": ["zheft", "zhurt", "zholm", "zhart", "zhisk"]}
    spans = [(lang, list(rng.choice(pools[lang], 12))) for lang in ("a", "b") for _ in range(60)]
    model = langid.fit(spans)
    text = list(rng.choice(pools["a"], 10)) + ["unseen"] + list(rng.choice(pools["b"], 5))
    scores = model.emissions(text)[None]
    p, _ = langid.forward_backward(scores, np.ones((1, len(text)), bool), model.moves)
    assert (p[0].argmax(axis=1)[:10] == 0).all() and (p[0].argmax(axis=1)[11:] == 1).all()
    assert np.allclose(langid.posterior(scores, np.ones((1, len(text)), bool), model.moves), p, atol=1e-4)
    (lang, score), (none, zero) = langid.Labeller(model).label([" ".join(text), "12 !"])
    assert lang == "a" and 0.4 < score < 0.9 and (none, zero) == ("und", 0.0)


def test_forward_backward_sums_over_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    total, want = 0.0, np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(sum(scores[0, i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += w
        for i, y in enumerate(path):
            want[i, y] += w
    p, _ = langid.forward_backward(scores, np.ones((1, 4), bool), moves)
    assert np.allclose(p[0], want / total)
