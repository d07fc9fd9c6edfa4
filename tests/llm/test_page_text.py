"""Text of pages that is easily lost."""

import pytest

from pagelens.llm import html


@pytest.mark.parametrize("page, text", [
    ('<p>a<svg class="i"/>b</p><article>c</article>', "c"), ("<p>a<svg />b</p>", "ab"), ("<p>a<svg><text>x</text></svg>b</p>", "ab"),
    ("<svg/><p>first</p><svg><title>x</title></svg><p>last</p>", "first\nlast"),
])
def test_a_closed_icon_ends_at_its_tag(page, text):
    assert html.main_text(page, frozenset()) == text


def test_copies_of_a_page_are_no_template(spark):
    page = "<body><div><h1>Title</h1><p>The only text</p><p>and its end</p></div></body>"
    other = "<body><div><p>something else</p></div></body>"
    rows = [(i, f"http://copies.example/{i}", page) for i in range(5)] + [(5, "http://copies.example/5", other)]
    rows += [(6, "http://twice.example/", page)] * 2 + [(i, "http://null.example/", None) for i in (7, 8)]
    rows += [(10 + i, f"http://real.example/{i}", f"<body><div><p>Welcome</p><p>words {i // 2}</p><p>Goodbye</p></div></body>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.extracted(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == "Title\nThe only text\nand its end" for i in (0, 1, 2, 3, 4, 6)) and text[7] == text[8] == ""
    assert all(text[10 + i] == f"words {i // 2}" for i in range(8))


@pytest.mark.parametrize("page, text", [
    ('<article class="post status-publish category-ads"><p>Body text</p></article>', "Body text"),
    ('<article><p>One</p><p class="skip-intro">Two</p><p class="alert">Three</p></article>', "One\nTwo\nThree"),
    ('<div class="entry-meta">12 May</div><div><p>The whole article is here.</p></div>', "12 May\nThe whole article is here."),
    ('<div class="entry-content"><p>a</p></div><div>b</div>', "a"), ('<div id="main-nav">a</div><div class="post body">b</div>', "b"),
    ('<main><article class="post">a</article><article class="comment">b</article></main>', "a"), ('<article class="comment">a</article>', "a"),
    ('<article><div class="share-buttons">a</div><p class="ad">b</p><p>c</p><div class="cookie notice">d</div></article>', "c"),
])
def test_marks_are_asked_as_wholes(page, text):
    assert html.main_text(page, frozenset()) == text


def test_a_notice_that_a_host_repeats_in_its_articles_is_template(spark):
    page = "<body><article><div>Subscribe to our <b>letter</b></div><h2>Method</h2><p>One {0}</p><p>Shared by some</p></article><p>foot</p></body>"
    rows = [(i, f"http://letters.example/{i}", page.format(i)) for i in range(12)]
    rows += [(20 + i, f"http://few.example/{i}", page.format(i)) for i in range(4)]  # too few pages to tell
    rows += [(30 + i, f"http://half.example/{i}", page.format(i) if i % 3 else f"<body><article><p>Other {i}</p></article></body>") for i in range(12)]
    rows += [(50 + i, f"http://same.example/{i}", f"<body><nav>{i}</nav><article><p>All there is</p></article></body>") for i in range(8)]
    text = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(text) == len(rows)
    assert all(text[i] == f"Method\nOne {i}" for i in range(12))
    assert all(text[20 + i] == f"Subscribe to our letter\nMethod\nOne {i}\nShared by some" for i in range(4))
    assert all(text[30 + i] == f"Subscribe to our letter\nMethod\nOne {i}\nShared by some" for i in range(12) if i % 3)
    assert all(text[50 + i] == "All there is" for i in range(8))
