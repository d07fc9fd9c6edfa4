"""Personal data: fixed patterns, and the terms that give an entity away.

Base spans come from four patterns. Every base span is an occurrence of a protected entity. The words near
it are candidates: the corpus tells how much a term reveals an entity by their pointwise mutual information,
counted over whole documents, against what there is to know, the entity's information content. A term that
met the entity in several different contexts and reveals at least a given share of it is generalised wherever
it stands, far from the entity and in documents without it too.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import map_rows, set_aside
from pagelens.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of a base span that are its context.
CONTEXT = 5
#: Different contexts in which a term must meet an entity.
CONTEXTS = 3
#: Share of an entity's information that a term may reveal.
DISCLOSURE = 0.9
#: ASCII punctuation around a word is no part of a term.
PUNCTUATION = r"!-/:-@\[-`{-~"

# Each pattern is read so that no text makes it slow: digits are taken whole, and a mail address is looked for from its @.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
LONG_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){12}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = re.compile(f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$")
DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """A match starts where the run of local characters before its @ starts, or where the match before it ended."""
    out, free = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str | None) -> list[list[Span]]:
    """Spans of each kind in code points; a match that fails its check is dropped and not tried again."""
    text = text or ""
    found: list[list[Span]] = [emails(text) if "@" in text else [], [], [], []]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found[1].append(m.span())
    if LONG_NUMBER.search(text):
        for m in CARD.finditer(text):
            digits = "".join(DIGITS.findall(m.group())) if m.end() - m.start() <= 37 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                found[2].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m.group())) <= 15:
                found[3].append(m.span())
    return found


def listing(found: list[list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, spans in zip(KINDS, found) for a, b in spans)


def covered(found: list[list[Span]]) -> Callable[[int, int], bool]:
    """Whether a stretch of text meets a base span."""
    taken = sorted(s for spans in found for s in spans)
    upto: list[int] = []  # the furthest end among the spans so far
    for _, b in taken:
        upto.append(max(b, upto[-1] if upto else 0))

    def meets(x: int, y: int) -> bool:
        i = bisect_left(taken, (y, 0))
        return bool(i) and upto[i - 1] > x

    return meets


def places(text: str, terms: set[str]) -> list[Span]:
    """Where words that are one of ``terms`` stand outside of base spans."""
    meets, out = covered(base_spans(text)), []
    for m in WORDS.finditer(text):
        term = STRIP.sub("", m.group())
        if term in terms and not meets(*m.span()):
            at = m.start() + m.group().index(term)
            out.append((at, at + len(term)))
    return out


def context(text: str, found: list[list[Span]]) -> list[dict]:
    """The terms near each base span: entity, term, and a hash of the whole context."""
    if not any(found):
        return []
    words = [m.span() for m in WORDS.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    meets, out = covered(found), []
    for kind, spans in zip(KINDS, found):
        for a, b in spans:
            value = text[a:b].lower() if kind == "email" else "".join(DIGITS.findall(text[a:b])) if kind != "ip" else text[a:b]
            entity = xxhash.xxh64_intdigest(f"{kind}:{value}".encode("utf-8", "surrogatepass")) - (1 << 63)
            lo, hi = bisect_right(ends, a), bisect_left(starts, b)
            near = words[max(0, lo - CONTEXT):lo] + words[hi:hi + CONTEXT]
            seen = xxhash.xxh64_intdigest(" ".join(text[x:y] for x, y in near).encode("utf-8", "surrogatepass")) - (1 << 63)
            for x, y in near:
                term = STRIP.sub("", text[x:y])
                if len(term) >= 3 and not term.isdigit() and not meets(x, y):
                    out.append({"entity": entity, "term": term, "context": seen})
    return out


NEAR = "near array<struct<entity: long, term: string, context: long>>"
PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
NEAR_TYPE = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string()), ("context", pa.int64())]))


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash`` of every row with its base counts and spans, and the terms near them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, base, near = [], [], []
        for text in batch.column(2).to_pylist():
            found = base_spans(text)
            counts.append([len(s) for s in found])
            base.append(listing(found))
            near.append(context(text or "", found))
        n = [pa.array([c[k] for c in counts], type=pa.int64()) for k in range(4)]
        sha = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base])
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *n, sha, pa.array(base), pa.array(near, type=NEAR_TYPE)],
                                          ["doc_id", "text_hash", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "near"])

    schema = "doc_id long, text_hash long, " + "".join(f"n_{k} long, " for k in KINDS) + f"base_sha256 string, base string, {NEAR}"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), run, schema)


def row_of(doc_id: str = "doc_id", text_hash: str = "text_hash") -> Column:
    return F.xxhash64(doc_id, text_hash)


def disclosing(near: DataFrame, docs: DataFrame, contexts: int = CONTEXTS, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """``entity, term`` pairs where the term reveals at least ``disclosure`` of the entity, and ``row, term``: which documents hold candidate terms.

    With document counts n: log(n(e,t) N / (n(e) n(t))) / log(N / n(e)); a document counts in n(e,t) when it holds both,
    however far apart. The share is 1 when the term occurs only in documents of the entity. A pair needs ``contexts`` different
    contexts, so that copies of one passage prove nothing. n(e,t) is at most the smaller of n(e) and n(t), which bounds the share
    from above: only pairs that can still reach it are counted, and a term of such a pair is little more frequent than its entity.
    """
    occ = near.select("entity", "term", "context", row_of().alias("row"))
    met = occ.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts")).filter(F.col("contexts") >= contexts)
    of_entity = occ.select("entity", "row").distinct()
    entities = of_entity.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    # a term is in all documents where it stands near any entity, so this many bound n(t) from below
    at_least = occ.select("term", "row").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("least"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    share = lambda n_et, n_t: F.log(n_et * F.col("n") / (F.col("n_e") * F.col(n_t))) / F.log(F.col("n") / F.col("n_e"))
    can = lambda n_t: share(F.least("n_e", n_t), n_t) >= disclosure
    met = met.join(entities, "entity").join(at_least, "term").join(F.broadcast(total))  # one row
    met = materialize(met.filter((F.col("n") > F.col("n_e")) & can("least")), "met")
    bare = F.regexp_replace(F.col("word"), f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "").alias("term")
    word = F.explode(F.array_distinct(F.split("text", r"[\x20\x09-\x0D]+"))).alias("word")
    mine = docs.select(row_of(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("row"), word).select("row", bare)
    held = materialize(mine.join(met.select("term").distinct(), "term", "left_semi").distinct(), "held")
    pairs = met.join(held.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "term").filter(can("n_t"))
    both = held.join(pairs.select("entity", "term"), "term").join(of_entity, ["entity", "row"], "left_semi")
    pairs = pairs.join(both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")), ["entity", "term"])
    return pairs.filter(share(F.col("n_et"), "n_t") >= disclosure).select("entity", "term"), held


def term_spans(scan: DataFrame, docs: DataFrame) -> DataFrame:
    """``_d, _h, terms``: the places of disclosing terms, in order, one row for each different document that has any."""
    near = scan.select("doc_id", "text_hash", F.explode("near").alias("x")).select("doc_id", "text_hash", "x.*")
    pairs, held = disclosing(near, docs)
    terms = held.join(pairs.select("term").distinct(), "term", "left_semi").groupBy("row").agg(F.collect_set("term").alias("wanted"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_h"), "text")
    texts = texts.join(materialize(terms, "wanted"), row_of("_d", "_h") == F.col("row"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"start": a, "end": b} for a, b in places(text or "", set(wanted))] for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_h"), pa.array(found, type=PLACES)], ["_d", "_h", "terms"])

    out = map_rows(texts.select("_d", "_h", "text", "wanted"), run, "_d long, _h long, terms array<struct<start: long, end: long>>")
    return out.filter(F.size("terms") > 0).dropDuplicates(["_d", "_h"])


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts, digest and all spans of every document.

    A null text is empty; its digest is that of an empty string. Repeated rows each get their row, a null
    doc_id stays null, columns beside ``doc_id`` and ``text`` are not read, an empty table gives none.
    """
    scan = materialize(scanned(docs), "scan")
    terms = term_spans(scan, docs)
    j = scan.join(terms, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("text_hash").eqNullSafe(F.col("_h")), "left")
    more = F.concat_ws(",", F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"])))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("terms").isNotNull(), more))
    return j.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"))


def redact(text: str, found: list[list[Span]], terms: list[Span]) -> str:
    """Spans give way to the name of their kind in brackets; of spans that overlap, the first names the whole stretch."""
    marks = sorted((a, -b, kind) for kind, spans in zip((*KINDS, "term"), (*found, terms)) for a, b in spans)
    out, at = [], 0
    for a, b, kind in marks:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data generalised in ``text``; ``n_chars``, where there is one, follows. No row goes."""
    scan = materialize(scanned(docs).filter(F.size("near") > 0), "scan")
    terms = materialize(term_spans(scan, docs), "terms")
    slim, back = set_aside(docs, ("doc_id", "text", "n_chars"))
    wide = slim.join(terms, F.col("doc_id").eqNullSafe(F.col("_d")) & F.xxhash64("text").eqNullSafe(F.col("_h")), "left").drop("_d", "_h")
    names = slim.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = dict(zip(names, batch.columns))
        before, texts = made["text"].to_pylist(), []
        for text, terms in zip(before, batch.column("terms").to_pylist()):
            found = base_spans(text)
            texts.append(redact(text, found, [(t["start"], t["end"]) for t in terms or []]) if any(found) or terms else text)
        made["text"] = pa.array(texts, type=pa.string())
        if "n_chars" in made:
            n = [old if a == b else len(b) for old, a, b in zip(made["n_chars"].to_pylist(), before, texts)]
            made["n_chars"] = pa.array(n, type=made["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(made.values()), names)

    return back(map_rows(wide, run, slim.schema))
