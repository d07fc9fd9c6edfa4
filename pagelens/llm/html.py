"""Main text of web pages by equivalence classes of their tokens.

A page's tokens are its elements, named by their path, and its runs of text. For every host each token has an
occurrence vector, the count on every page of the host; vectors are compared by mergeable sums of hashes, so
no page is ever gathered with its neighbours. Tokens with one vector form a class. A class on more than half
of a host's pages whose tokens nest in tokens of other such classes belongs to the host's template. What the
template leaves open are its slots; those of navigation, adverts and the like are told by the elements they
hang in, and the article is the rest. Within the article blocks that nearly all pages of a host repeat are
template too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import map_rows
from pagelens.session import materialize

START = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*+))")
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("html head body caption legend optgroup option summary td th tr tbody thead tfoot dd dt li".split())
#: An element that starts ends an open one of these, up to an open one of those.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# What an element's name or class says about what it holds
ASIDE_TAGS = frozenset("nav footer aside form button select dialog menu head object video audio canvas label".split())
ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments
respond reply replies disqus related recommended share sharing social newsletter subscribe signup login search widget pagination pager toolbar
skip form""".split())
HEADS = frozenset(("header",))
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article main content story post entry".split())
#: A mark of main words may have these beside them.
BODY_WORDS = frozenset("body text".split())
#: Marks with one of these say what an element is filed under or has, not what it is.
FILED_WORDS = frozenset("category cat tag tagged status type format with without has no".split())
#: Whole marks that put an article inside of another one, and a paragraph, aside.
COMMENT_MARKS = frozenset("comment comments reply replies ad ads advert adverts advertisement".split())
NOTICE_MARKS = COMMENT_MARKS | frozenset("sponsored promo promotion banner cookie cookies consent notice newsletter subscribe related share".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = HEADINGS | frozenset("p blockquote pre li td th dt dd figcaption".split())
#: In an article a repeated block is template on a host with so many different pages, on this share of them.
FIXED_PAGES, FIXED_SHARE = 5, 0.9
RAW_ENDS = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
SPLIT = re.compile(r"[^a-z0-9]+")
#: A host with more than 1 / HOT of the pages is dealt over SALTS partitions.
HOT, SALTS = 1000, 64
#: Slots that hashes of contents fall into.
SLOTS = 1 << 19


def number(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


ROOT = number("")


class Element:
    """An open element: the number of its path and of its parent's, and whether it is left out, main, or in a heading.

    Marks (classes, id, role) are asked as wholes or by their parts, as in ``site-footer``. What the mark of an article or
    main element says counts only where it is inside of another one, and only whole marks put a paragraph of an article aside.
    """

    __slots__ = ("tag", "path", "parent", "out", "main", "heading")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        self.tag = tag
        marks: set[str] = set()
        mark = ""
        if attributes and not attributes.isspace():
            for name, *values in ATTRIBUTE.findall(attributes):
                value = "".join(values).lower()
                marks.update(value.split())
                mark += f".{value}" if name.lower() == "class" else ""
        self.parent = parent.path if parent else ROOT
        self.path = number(f"{self.parent}/{tag}{mark}")
        inside = bool(parent and parent.main)
        parts = [set(SPLIT.split(m)) for m in marks]
        if tag in MAIN_TAGS:
            told = inside and bool(marks & COMMENT_MARKS)
        elif inside and tag in TEXT_TAGS:
            told = bool(marks & NOTICE_MARKS)
        else:
            words = ASIDE_WORDS - HEADS if inside else ASIDE_WORDS  # an article's own header belongs to it
            told = tag not in ("html", "body") and any(p & words and not p & FILED_WORDS for p in parts)
        main = any(p & MAIN_WORDS and p <= MAIN_WORDS | BODY_WORDS for p in parts)
        self.main = inside or tag in MAIN_TAGS or (main and tag in BLOCKS and not told)
        self.heading = tag in HEADINGS or bool(parent and parent.heading)
        own = tag in ASIDE_TAGS or (tag == "header" and not inside) or told
        self.out = bool(parent and parent.out) or own


def walk(page: str) -> Iterator[tuple[str, Element | None, str]]:
    """``kind, element, text``: "open" for every element, "text" for every run of text, "break" where a block starts or ends.

    Time is linear in the page: once a tag's quotes swallow the rest of the page, quotes no longer count.
    """
    stack, opened = [], Counter()
    at, end, quoted = 0, len(page), True

    def cut(i: int) -> None:
        opened.subtract(e.tag for e in stack[i:])
        del stack[i:]

    def finish(ended: set[str], walls: set[str]) -> None:
        if any(opened[t] for t in ended):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ended:
                    return cut(i)
                if stack[i].tag in walls:
                    return None

    while at < end:
        m = START.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            yield "text", stack[-1] if stack else None, page[at:stop]
        if not m:
            return
        tag, rest = (m[2] or "").lower(), ""
        if not tag:
            close = page.find("-->" if m[0] == "<!--" else ">", m.end())
            at = end if close < 0 else close + (3 if m[0] == "<!--" else 1)
            continue
        t = REST.match(page, m.end()) if quoted else None
        quoted = t is not None
        close = t.end() - 1 if t else page.find(">", m.end())
        if close < 0:
            yield "text", stack[-1] if stack else None, page[stop:]
            return
        rest, at = page[m.end():close], close + 1
        if m[1]:
            if opened[tag]:
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            if tag in BLOCKS:
                yield "break", None, ""
            continue
        if tag in CLOSES_P:
            finish({"p"}, {"table", "button", "object"})
        if tag in ENDS:
            finish(*ENDS[tag])
        if tag in BLOCKS:
            yield "break", None, ""
        if tag == "br":
            yield "text", stack[-1] if stack else None, " "
        if tag in VOID:
            continue
        element = Element(tag, rest, stack[-1] if stack else None)
        yield "open", element, ""
        if tag == "svg" and rest.endswith("/"):
            continue
        if tag in RAW:
            ended = RAW_ENDS[tag].search(page, at)
            at = end if not ended else page.find(">", ended.end()) + 1 or end
        else:
            stack.append(element)
            opened[tag] += 1


def squeeze(text: str) -> str:
    return " ".join(unescape(text).split())


def run_token(element: Element | None, run: str) -> int:
    """Runs of text have odd numbers, elements even ones."""
    return number(str(element.path if element else ROOT), run) | 1


def page_tokens(page: str | None) -> dict[tuple[int, int], int]:
    """Counts of ``token, parent token``; elements hang in their parent element, runs of text in their own."""
    counts: dict[tuple[int, int], int] = {}
    for kind, element, text in walk(page or ""):
        if kind == "open":
            key = element.path & ~1, element.parent & ~1
        elif kind == "text" and (run := squeeze(text)):
            key = run_token(element, run), (element.path if element else ROOT) & ~1
        else:
            continue
        counts[key] = counts.get(key, 0) + 1
    return counts


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def contents(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``host, page, html``, every different content of a host once, and ``host, rows``.

    Contents are spread over SLOTS slots by their hash. The slots of contents that repeat, at most SLOTS numbers, are broadcast;
    only pages in such slots are shuffled to find copies, and copies read by one task are merged before.
    """
    read = pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html").withColumn("slot", F.pmod("page", F.lit(SLOTS)))
    counts = materialize(read.groupBy("host", "page", "slot").agg(F.count(F.lit(1)).alias("n")), "contents")
    again = F.broadcast(counts.filter("n > 1").select("slot").distinct())
    alone = read.join(again, "slot", "left_anti").select("host", "page", "html")
    copies = read.join(again, "slot", "left_semi").groupBy("host", "page").agg(F.first("html").alias("html"))
    return alone.unionByName(copies), counts.groupBy("host").agg(F.sum("n").alias("rows"))


def templates(pages: DataFrame) -> DataFrame:
    """``host, pages, template, fixed``: the page rows of each host that has a template, its tokens, and the runs of text
    among them that are on a share FIXED_SHARE of FIXED_PAGES different pages or more.

    Copies prove no template: pages of a host with one content count as one. A vector is known by the pages
    that hold the token, its occurrences and two sums of hashes of (page, count). A class is valid when it is on more than half of the host's pages and holds two tokens or more, or is
    a repeated element, and is nested when its tokens' parents are valid too or are the root. A page has finitely many tokens, so more
    than half of the pages bound a template by two pages' tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int, int], list[int]] = {}
            for name, page, html in zip(*(c.to_pylist() for c in batch.columns)):
                counts = page_tokens(html)
                counts[(0, 0)] = 1
                for (token, parent), n in counts.items():
                    h = xxhash.xxh64_intdigest(f"{page}:{n}")
                    s = sums.setdefault((name, token, parent), [0, 0, 0, 0])
                    s[0] += 1
                    s[1] += n
                    s[2] += h & 0x3FFFFFFF
                    s[3] += h >> 34
            if sums:
                names, tokens, parents = zip(*sums)
                made = [pa.array(x, type=pa.int64()) for x in zip(*sums.values())]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(tokens, type=pa.int64()), pa.array(parents, type=pa.int64()), *made],
                                                 ["host", "token", "parent", "pages", "times", "low", "high"])

    read, rows = contents(pages)
    schema = "host string, token long, parent long, pages long, times long, low long, high long"
    sums = read.mapInArrow(run, schema).groupBy("host", "token", "parent").agg(*[F.sum(c).alias(c) for c in ("pages", "times", "low", "high")])
    # what a single page has is in no template; the token 0 is on every page and counts them
    sums = materialize(sums.filter("pages > 1 OR token = 0"), "tokens")
    of_host = sums.filter("token = 0").select(F.col("host").alias("_host"), F.col("pages").alias("all_pages"))
    common = sums.join(of_host, F.col("host") == F.col("_host")).filter("token <> 0 AND pages > 1 AND 2 * pages > all_pages")
    vector = F.struct("pages", "times", "low", "high")
    kept = common.groupBy("host").agg(F.collect_list(F.struct("token", "parent", vector.alias("vector"))).alias("t"), F.max("all_pages").alias("all_pages"))

    def nested(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, fixed = [], []
        for tokens, total in zip(batch.column("t").to_pylist(), batch.column("all_pages").to_pylist()):
            out.append(valid_tokens([(t["token"], t["parent"], tuple(t["vector"].values())) for t in tokens]))
            often = {t["token"] for t in tokens if t["token"] & 1 and t["vector"]["pages"] >= FIXED_SHARE * total}
            fixed.append([t for t in out[-1] if t in often] if total >= FIXED_PAGES else [])
        lists = [pa.array(x, type=pa.list_(pa.int64())) for x in (out, fixed)]
        return pa.RecordBatch.from_arrays([batch.column("host"), batch.column("rows"), *lists], ["host", "pages", "template", "fixed"])

    valid = map_rows(kept.join(rows, "host"), nested, "host string, pages long, template array<long>, fixed array<long>")
    return materialize(valid, "templates")



def valid_tokens(tokens: list[tuple[int, int, tuple[int, ...]]]) -> list[int]:
    """Tokens of classes of two or more whose parents, up to the root, are valid too; an element that pages repeat
    as they like is a class of its own, and valid by its parent."""
    sizes: dict[tuple[int, ...], int] = {}
    for _, _, vector in tokens:
        sizes[vector] = sizes.get(vector, 0) + 1
    left = {token: parent for token, parent, vector in tokens if sizes[vector] > 1 or not token & 1}
    kept = {ROOT & ~1}
    while True:
        more = {t for t, p in left.items() if p in kept and t not in kept}
        if not more:
            return sorted(kept - {ROOT & ~1})
        kept |= more


def main_text(page: str | None, template: frozenset[int], fixed: frozenset[int] = frozenset()) -> str:
    """The article's blocks.

    Inside a main element of the page a block is template where all its runs are ``fixed`` and none is a heading; runs that
    fewer pages repeat are content, and an article of nothing but fixed blocks keeps them. Without a main element, content is
    what fills slots of the template outside of the elements that are left out, and runs that are part of the template
    themselves are not.
    """
    blocks: list[tuple[bool, list[str]]] = [(False, [])]
    open_slots: set[int] = set()  # blocks of the article with a run of their own
    any_main = False
    for kind, element, text in walk(page or ""):
        if kind == "break":
            if blocks[-1][1]:
                blocks.append((False, []))
        elif kind == "text" and not (element and element.out):
            inside = bool(element and element.main)
            if not inside and not any_main and (run := squeeze(text)) and run_token(element, run) in template:
                continue
            if inside != blocks[-1][0]:
                if any(x.strip() for x in blocks[-1][1]):
                    blocks.append((inside, []))
                else:
                    blocks[-1] = (inside, [])
            any_main |= inside
            blocks[-1][1].append(text)
            if inside and fixed and (run := squeeze(text)) and (element.heading or run_token(element, run) not in fixed):
                open_slots.add(len(blocks) - 1)
    lines = (squeeze("".join(parts)) for i, (inside, parts) in enumerate(blocks) if (inside and (i in open_slots or not open_slots)) or not any_main)
    return "\n".join(line for line in lines if line)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null or empty page, and one without content, has an empty text; a page with a null or malformed url
    shares the template of the host with an empty name; repeated rows each get their row; other columns are
    not read; an empty table gives an empty result.
    """
    of_host = templates(pages)
    # Spark broadcasts the templates where they are small enough. Where they are not, a host with more than 1 / HOT of
    # all pages (there are fewer than HOT of these) is dealt over SALTS partitions.
    total = of_host.agg(F.sum("pages").alias("total"))
    hot = F.broadcast(of_host.join(F.broadcast(total)).filter(F.col("pages") * HOT > F.col("total")).select(F.col("host").alias("_hot")))
    salts = F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = of_host.join(hot, F.col("host") == F.col("_hot"), "left").select(F.col("host").alias("_host"), "template", "fixed", F.explode(salts).alias("_salt"))
    mine = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    read = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(hot, F.col("host") == F.col("_hot"), "left").withColumn("salt", mine)
    j = read.join(dealt, (F.col("host") == F.col("_host")) & (F.col("salt") == F.col("_salt")), "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[str, tuple[frozenset[int], frozenset[int]]] = {}
        texts = []
        hosts, template, fixed = batch.column("host").to_pylist(), batch.column("template"), batch.column("fixed")
        for i, html in enumerate(batch.column("html").to_pylist()):
            if hosts[i] not in seen:
                seen[hosts[i]] = frozenset(template[i].as_py() or ()), frozenset(fixed[i].as_py() or ())
            texts.append(main_text(html, *seen[hosts[i]]))
        n = pa.array(np.array([len(t) for t in texts], dtype=np.int64))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, type=pa.string()), n], ["page_id", "url", "text", "n_chars"])

    return map_rows(j.select("page_id", "url", "html", "host", "template", "fixed"), run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
