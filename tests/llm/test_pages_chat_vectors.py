"""Extraction, tool calls and search: edge rows and plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagelens.llm import ann, chat, html
from tests.llm import brute


# extraction

PAGE = ('<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><b";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>'
        '<!-- hidden <p> --><div class="ad">Buy now</div><article><h1>Head &amp; more</h1><p><b>One  two\n three<br><p>Fish &eacute; chips</p><aside>side</aside>'
        '<form>mail <input></form><div class="comments"><p>first!</p></div></article><footer>&copy; host</footer>')


def test_article_text():
    assert html.main_text(PAGE, frozenset()) == "Head & more\nOne two three\nFish é chips"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<", "<"), ("a<b>c</b>d", "acd"), ("<p>a<p>b", "a\nb"), ("<ul><li>a<li>b</ul>", "a\nb"), ("x <!-- y", "x"),
    ("<script>if (a < b) {}", ""), ('<p title="a > b">q</p>', "q"), ("<main><p>m</main><p>outside", "m"), ("&lt;p&gt;", "<p>"), ("<table><tr><td>a<td>b</table>", "a\nb"),
])
def test_fragments(page, text):
    assert html.main_text(page, frozenset()) == text


def test_broken_and_deep_pages_take_linear_time():
    for page in ('<a b="x' * 50_000, "<div>" * 20_000 + "x", "</p>" * 50_000, "<!--" * 50_000, "<p" * 50_000):
        html.main_text(page, frozenset())


def test_template_runs_are_left_out_where_no_element_tells(spark):
    rows = [(i, f"http://Host.example/{i}", f"<body><div><p>Welcome to the site</p><p>unique words {i}</p><p>All rights reserved</p></div></body>") for i in range(6)]
    rows += [(10, "http://other.example/", rows[0][2]), (11, None, None), (12, "no url", ""), (13, "http://Host.example/13", PAGE), (13, "http://Host.example/13", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("own")).withColumn("template", F.lit("own"))
    got = html.extracted(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == f"unique words {i}" for i in range(6))
    assert text[10] == "Welcome to the site\nunique words 0\nAll rights reserved"  # a single page deduces nothing
    assert text[11] == text[12] == "" and text[13].startswith("Head & more")
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extracted(df.filter("false")).collect() == []


def test_whole_table_equals_a_plain_reading(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html.extracted(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        lines = [" ".join(unescape(re.sub("<[^>]*>", "", part)).split()) for part in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in lines if x)


# tool calls

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"


def run_calls(spark, calls, results):
    rows = chat.tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)).collect()
    return {(r.conv_id, r.call_id): r for r in rows}, rows


def test_calls_link_order_validate_and_serialise(spark):
    good = json.dumps({"words": 1, "turn": 2, "question": "q é"})
    calls = [
        (1, "a", 5, "reply", good, ["b", "c"]), (1, "b", 6, "reply", good, ["c"]), (1, "c", 7, "reply", good, ["missing"]), (1, "d", 1, "reply", good, None),
        (2, "a", 1, "reply", '{"question": 3}', []), (2, "a", 1, "reply", '{"question": 3}', []), (2, "b", 2, "other", "{}", ["a"]), (2, "c", 3, "reply", "no json", None),
        (3, "x", 1, "reply", good, ["y"]), (3, "y", 2, "reply", good, ["x"]), (3, "z", 3, "reply", good, ["y"]), (3, "w", 4, "reply", good, []),
        (None, "n", 1, "advise", '{"question":"a","turn":1,"words":1,"more":0}', None), (4, None, 1, "reply", None, None), (4, None, 2, "reply", None, None),
    ]
    results = [(1, "a", 8, "ok"), (1, "c", 6, "early"), (2, "gone", 1, "orphan"), (2, "a", 2, "second"), (2, "a", 3, "third"), (None, "n", 2, None), (4, None, 3, "nobody's")]
    by, rows = run_calls(spark, calls, results)
    assert len(rows) == 16
    order = lambda c: [r.call_id for r in sorted((r for r in rows if r.conv_id == c), key=lambda r: r.position)]
    assert order(1) == ["d", "c", "b", "a"] and order(3) == ["w", "x", "y", "z"]
    assert [by[3, k].layer for k in "wxyz"] == [0, -1, -1, -1]
    assert (by[1, "a"].status, by[1, "b"].status, by[1, "c"].status, by[2, "gone"].status) == ("linked", "unanswered", "early", "orphan")
    assert by[1, "a"].json == '{"arguments":{"question":"q é","turn":2,"words":1},"id":"a","name":"reply","result":"ok"}'
    assert by[1, "a"].valid and by[2, "a"].n_calls == 2 and by[2, "a"].n_results == 2 and '"result":"second"' in by[2, "a"].json
    assert by[2, "a"].problems == "turn: no bigint; words: no bigint" and by[2, "b"].problems == "unknown tool" and by[2, "c"].problems == "no object"
    assert by[None, "n"].problems == "more: unknown" and not by[None, "n"].valid


def test_long_conversation_of_repeated_turns(spark):
    rows = [(1, t % 50, ("user", "assistant")[t % 2], f"text {t % 50}") for t in range(3000)] + [(2, 0, "user", None), (3, 1, None, "x"), (None, 0, "user", "q")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("layer", F.lit("own"))
    got = chat.conversation_calls(conv).collect()
    first = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert len(first) == 25 and [json.loads(r.json)["arguments"]["turn"] for r in first] == list(range(0, 50, 2)) and all(r.n_calls == 60 for r in first)
    assert all(json.loads(r.json)["result"] == f"text {2 * i + 1}" for i, r in enumerate(first))
    assert chat.conversation_calls(conv.filter("false")).collect() == []


# search

def plain_search(rows, queries, k):
    out = {}
    for q, v in queries:
        near = sorted(((-round(brute.cosine(v, w), 12), i) for i, w in rows if i != q))[:k]
        out[q] = [i for _, i in near]
    return out


def test_search_with_ties_repeats_and_useless_vectors(spark):
    rng = random.Random(4)
    base = [(i, [float(x) for x in (rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1))]) for i in range(1, 80)]
    same = [(100 + i, [1.0, 0.5, 0.25, 0.0]) for i in range(30)]
    scaled = [(200 + i, [(i + 1) * x for x in (1.0, 0.5, 0.25, 0.0)]) for i in range(30)]
    useless = [(300, None), (350, [0.0] * 4), (400, [float("nan"), 1.0, 1.0, 1.0]), (450, [float("inf"), 1.0, 1.0, 1.0]), (500, [None, 1.0, 1.0, 1.0]), (550, []), (None, [1.0] * 4)]
    other = [(600, [1.0, 2.0]), (601, [1.0, 2.5]), (650, [3.0, -1.0, 2.0])]
    df = spark.createDataFrame(base + same + scaled + useless + other, "vec_id long, embedding array<double>").withColumn("unit", F.lit("own")).withColumn("rank", F.lit("own"))
    got = {}
    for r in ann.nearest_vectors(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    good = base + same + scaled
    want = plain_search(good, [(i, v) for i, v in good if i % 50 == 0], 5)
    assert {q: got[q] for q in want} == want
    assert got[600] == [601] and 650 not in got and not {300, 350, 400, 450, 500, 550} & set(got)
    assert ann.nearest_vectors(df.filter("false")).collect() == []


def test_full_buckets_are_dealt_out(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, ann.nearest_vectors(df).collect()))
    real = ann.met
    monkeypatch.setattr(ann, "met", lambda i, p, most: real(i, p, most, part_vectors=20, part_queries=2))
    assert sorted(map(tuple, ann.nearest_vectors(df).collect())) == whole


def test_recall_on_a_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    import numpy as np

    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    found = {}
    for r in ann.nearest_vectors(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in np.nonzero(ids % 50 == 0)[0]:
        s = x @ x[q]
        s[q] = -2
        hit += len(set(ids[np.argsort(-s)[:5]].tolist()) & found[ids[q]])
    assert hit >= 0.93 * 5 * len(found)
