"""Merkle manifest of a dataset as a content-addressed graph, and proofs by descent.

Every row is a leaf, the hash of its columns. Leaves of a group stand in order and every ``arity`` consecutive nodes
become their hash, level by level, until the group's subroot remains; subroots become the root in the same way. The
store holds one record for each digest: its children. Records are kept by pages, subtrees of ``arity ** height``
positions under one digest, so that a billion leaves are three pages deep and a page is always small.

A proof starts at the root with nothing but the request's rank. Its digits, highest first, choose a child on every
level; the children not chosen are collected, and the next record is looked up by the chosen one's digest. Requests
that share a page share the way to it, so every page is joined once, however many leaves are asked for. The path
comes out root first and is reversed. Folding a leaf along its path gives the root again, unless something differs.

Ordering is one range shuffle of all leaves, in which a group of any size takes as many ranges as it fills; no group,
page list or path of all rows meets in one task or on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagelens.llm.common import map_rows, remainder, shuffle_width
from pagelens.session import materialize

ARITY = 2
#: Positions of a page at most.
PAGE = 1024
#: Rows of a batch that a task hands back.
ROWS = 4000
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves whose hashed identifier this divides are tampered with.
TAMPERED = 7


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of the fields: ``-`` for null, else the length in bytes, ``:`` and the value."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def page_height(arity: int, most: int = PAGE) -> int:
    height = 1
    while arity ** (height + 1) <= most:
        height += 1
    return height


def levels(n: int, arity: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    up = 0
    while n > 1:
        n, up = -(-n // arity), up + 1
    return up


@dataclass
class Manifest:
    """A manifest's tables and its root.

    ``leaves``: the given columns with ``pos`` in their tree and ``n``, its leaves. ``store``: ``top, digest, children``, the
    records by the page they are in. ``subroots``: ``tree, pos, n, name, leaves, digest``, the leaves of the root's tree.
    """

    leaves: DataFrame
    store: DataFrame
    subroots: DataFrame
    root: str | None
    arity: int
    most: int
    tall: int
    root_tall: int


# order

def placed(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """``nodes`` with ``pos``, its place from 0 within its ``tree``, and ``n``, the tree's nodes.

    Rows equal in ``order`` are told apart by where they were read, so that repeats spread over ranges.
    """
    kept = nodes.withColumn("_read", F.monotonically_increasing_id())
    ranged = kept.repartitionByRange(shuffle_width(nodes), "tree", *order, "_read").withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    of_tree = Window.partitionBy("tree")
    past = of_tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = ranged.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_m"))  # one row for each tree of a range
    heads = heads.select("tree", "_range", F.coalesce(F.sum("_m").over(past), F.lit(0)).alias("_before"), F.sum("_m").over(of_tree).alias("n"))
    inner = Window.partitionBy("tree", "_range").orderBy(*order, "_read")
    out = ranged.join(heads, ["tree", "_range"]).withColumn("pos", F.row_number().over(inner) - 1 + F.col("_before"))
    return out.select(*nodes.columns, "pos", "n")


# building

def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def as_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def by_page(rows: DataFrame, then: str, fn, schema: str) -> DataFrame:
    """``fn`` over the rows of every ``tree, page``, in order of ``then``; pages stream past one after the other."""
    dealt = rows.repartition(shuffle_width(rows), "tree", "page").sortWithinPartitions("tree", "page", then)
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = groupby(streamed(batches), key=lambda r: r[:2])
        yield from as_batches((row for (tree, page), members in pages for row in fn(tree, page, members)), made)

    return dealt.mapInArrow(run, schema)


def hashed(nodes: DataFrame, arity: int, height: int, floor: int) -> DataFrame:
    """Records and pages above ``tree, pos, n, digest`` on level ``floor``; a page's own row has no children."""
    page = F.floor(F.col("pos") / arity ** height).cast("long")

    def run(tree: str, page: int, members: Iterator[tuple]) -> Iterator[tuple]:
        *_, sizes, row = zip(*members)
        row, made = list(row), {}
        for _ in range(min(height, levels(sizes[0], arity) - floor)):
            above = [row[i:i + arity] for i in range(0, len(row), arity)]
            row = [digest(*children) for children in above]
            made |= zip(row, above)
        for name, children in made.items():
            yield tree, page, sizes[0], row[0], name, children
        yield tree, page, sizes[0], row[0], row[0], None

    rows = nodes.select("tree", page.alias("page"), "pos", "n", "digest")
    return by_page(rows, "pos", run, "tree string, page long, n long, top string, digest string, children array<string>")


def built(nodes: DataFrame, arity: int, most: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Records in parts, ``tree, n, digest`` of the tops, and how many pages deep the deepest tree is."""
    height = page_height(arity, most)
    store, tops, floor = [], [], 0
    while True:
        made = materialize(hashed(nodes, arity, height, floor), "pages")
        floor += height
        done = F.col("n") <= arity ** floor
        store.append(made.filter("children IS NOT NULL").select("top", "digest", "children"))
        pages = made.filter("children IS NULL")
        tops.append(pages.filter(done).select("tree", "n", "digest"))
        nodes = pages.filter(~done).select("tree", F.col("page").alias("pos"), "n", "digest")
        if nodes.isEmpty():
            return store, materialize(reduce(DataFrame.unionByName, tops), "tops"), len(tops)


def manifest(leaves: DataFrame, order: list[str], arity: int = ARITY, most: int = PAGE) -> Manifest:
    """Manifest of ``tree, digest`` and the columns in ``order``, which order a tree's leaves; trees are in order of their names.

    Ties go to the smaller digest. Equal leaves are leaves each for itself, identical subtrees share one record. An empty
    table has no root.
    """
    given = materialize(placed(leaves, [*map(F.col, order), F.col("digest")]), "leaves")
    store, tops, tall = built(given, arity, most)
    of_root = tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("leaves"), "digest")
    subroots = materialize(placed(of_root, [F.col("name")]), "subroots")
    more, top, root_tall = built(subroots, arity, most)
    records = reduce(DataFrame.unionByName, [*store, *more]).groupBy("top", "digest").agg(F.first("children").alias("children"))
    root = top.select("digest").take(1)
    return Manifest(given, materialize(records, "store"), subroots, root[0][0] if root else None, arity, most, tall, root_tall)


# proofs

FRONT = "tree string, page long, n long, digest string, subroot string, digits array<int>, others array<array<string>>"
FRONT_COLUMNS = ("tree", "page", "n", "digest", "subroot", "digits", "others")


def descend(front: DataFrame, wanted: DataFrame, m: Manifest, floor: int) -> DataFrame:
    """From every page of ``front`` on to the positions wanted of it: ``front``'s columns and ``asked``.

    ``page`` is then the position itself, ``digest`` what stands there; ``digits`` and ``others`` (children not chosen)
    have grown by the levels of the page.
    """
    height, arity = page_height(m.arity, m.most), m.arity
    blank = {f.name: f.dataType.simpleString() for f in front.schema if f.name not in ("tree", "page")}
    blank |= {"children": "array<string>", "pos": "long", "asked": wanted.schema["asked"].dataType.simpleString()}

    def shaped(rows: DataFrame, kind: int) -> DataFrame:
        return rows.select("tree", "page", F.lit(kind).alias("kind"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in blank.items()])

    records = front.select("tree", "page", F.col("digest").alias("top")).join(m.store, "top")
    rows = shaped(front, 0).unionByName(shaped(records, 1)).unionByName(shaped(wanted.withColumn("page", F.floor(F.col("pos") / arity ** height)), 2))

    def run(tree: str, page: int, members: Iterator[tuple]) -> Iterator[tuple]:
        record, head = {}, None
        for _, _, kind, n, at, subroot, digits, others, children, pos, asked in members:
            if kind == 0:
                head = n, at, subroot, digits, others
                deep = range(min(height, levels(n, arity) - floor) - 1, -1, -1)
            elif kind == 1:
                record[at] = children
            elif head:
                n, at, subroot, digits, others = head
                way = [pos // arity ** d % arity for d in deep]
                left = []
                for digit in way:
                    children = record[at]
                    left.append(children[:digit] + children[digit + 1:])
                    at = children[digit]
                yield tree, pos, n, at, subroot, digits + way, others + left, asked

    return by_page(rows, "kind", run, f"{FRONT}, asked {blank['asked']}")


def above(requests: DataFrame, size: int, s: int) -> DataFrame:
    """The pages that hold the requests, ``s`` pages up, each once."""
    up = requests.filter(F.col("n") > size ** s).select("tree", F.floor(F.col("pos") / size ** s).cast("long").alias("pos"))
    return up.distinct().withColumn("asked", F.lit(None).cast("int"))


def walked(top: DataFrame, requests: DataFrame, m: Manifest, tall: int) -> DataFrame:
    """From the tops of trees down to ``requests`` (``tree, pos, n, asked``), a page at a time; trees less deep join further down."""
    height = page_height(m.arity, m.most)
    size, front = m.arity ** height, None
    for s in range(tall - 1, -1, -1):
        begins = (F.col("n") <= size ** (s + 1)) & ((F.col("n") > size ** s) | F.lit(s == 0))
        here = top.filter(begins).select(*FRONT_COLUMNS)
        front = here if front is None else front.select(*FRONT_COLUMNS).unionByName(here)
        if s:
            front = materialize(descend(front, above(requests, size, s), m, s * height), "descent")
    return descend(front, requests.select("tree", "pos", "asked"), m, 0)


def proofs(m: Manifest, requests: DataFrame) -> DataFrame:
    """``tree, pos, digest, subroot, digits, siblings, asked`` for ``tree, pos, n, asked``, positions among the manifest's leaves.

    ``siblings`` are the other children on every level, leaf first; ``digits`` says where among them the own node stands.
    """
    root = m.subroots.filter("pos = 0").select(
        "tree", F.lit(0).cast("long").alias("page"), "n", F.lit(m.root).cast("string").alias("digest"), F.lit(None).cast("string").alias("subroot"),
        F.array().cast("array<int>").alias("digits"), F.array().cast("array<array<string>>").alias("others"))
    trees = requests.select(F.col("tree").alias("name")).distinct()
    asked = m.subroots.join(trees, "name").select("tree", "pos", "n", F.struct("name", "leaves").alias("asked"))
    found = walked(root, asked, m, m.root_tall)
    top = materialize(found.select(
        F.col("asked.name").alias("tree"), F.lit(0).cast("long").alias("page"), F.col("asked.leaves").alias("n"), "digest",
        F.col("digest").alias("subroot"), "digits", "others"), "tops")
    out = walked(top, requests, m, m.tall)
    return out.select("tree", F.col("page").alias("pos"), "digest", "subroot", F.reverse("digits").alias("digits"), F.reverse("others").alias("siblings"), "asked")


def folded(leaf: str, digits: list[int], siblings: list[list[str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for digit, others in zip(digits, siblings):
        leaf = digest(*others[:digit], leaf, *others[digit:])
    return leaf


def manifest_report(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A null counts as ``-`` in its leaf, a null ``lang`` is a tree of its own and the first one. Rows that share a doc_id (a null
    one comes first) stand in the order of their hashes, repeated rows are leaves each for itself. A row without
    identifier or without n_chars is not tampered with. Texts are hashed whole; other columns are not read. An
    empty table gives an empty result.
    """
    fields = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars").cast("decimal(20,0)"), "text": F.col("text")}
    changed = F.coalesce(remainder(fields["doc_id"], TAMPERED) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    leaf = leaf_hash(list(fields.values()))
    other = leaf_hash(list((fields | {"n_chars": fields["n_chars"] + 1}).values()))
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree")
    leaves = materialize(docs.select(fields["doc_id"].alias("doc_id"), tree, leaf.alias("digest"), F.when(changed, other).alias("changed")), "digests")
    m = manifest(leaves, ["doc_id"])
    root = m.root
    found = proofs(m, m.leaves.select("tree", "pos", "n", F.struct("doc_id", "changed").alias("asked")))
    found = found.select("asked.doc_id", F.col("digest").alias("leaf"), "subroot", "digits", "siblings", "asked.changed")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc_id, leaf, subroot, digits, siblings, changed = (c.to_pylist() for c in batch.columns)
        proof = [digest(*chain.from_iterable(s)) for s in siblings]
        ends = [folded(c or a, d, s) for a, d, s, c in zip(leaf, digits, siblings, changed)]
        made = [batch.column(0), batch.column(1), batch.column(2), pa.array([root] * len(ends), pa.string()), pa.array(proof, pa.string()), pa.array(ends, pa.string()), pa.array([e == root for e in ends])]
        return pa.RecordBatch.from_arrays(made, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return map_rows(found, run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _field(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _climbed(name: str, nodes: str) -> str:
    """All levels of the trees in ``nodes`` (tree, pos, h, n), two children to a node."""
    return f"""{name} AS (SELECT tree, 0 AS lvl, pos, h, n FROM {nodes} UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, lvl, pos // 2)"""


def _siblings(nodes: str, levels: str, base: str) -> str:
    """One row for each node and level: L or R and the sibling, by the side it stands on, or N where there is none."""
    return f"""SELECT a.rid, {base} + l.lvl AS step, coalesce(CASE WHEN (a.pos >> l.lvl) % 2 = 1 THEN 'L' ELSE 'R' END || u.h, 'N') AS mark
  FROM {nodes} a JOIN (SELECT DISTINCT tree, lvl FROM {levels} WHERE n > 1) l USING (tree)
  LEFT JOIN {levels} u ON u.tree = a.tree AND u.lvl = l.lvl AND u.pos = xor(a.pos >> l.lvl, 1)"""


_LEAF = "sha256(" + " || ".join(_field(f) for f in FIELDS) + ")"
_CHANGED = "sha256(" + " || ".join(_field("n_chars + 1" if f == "n_chars" else f) for f in FIELDS) + ")"
_CRC = """xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
  lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295)"""

#: The same rows in DuckDB.
ORACLE = f"""WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS tree, {_LEAF} AS h,
    CASE WHEN {_CRC} % {TAMPERED} = 0 AND n_chars IS NOT NULL THEN {_CHANGED} END AS changed FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, rid) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM given),
{_climbed("up", "leaf")},
subroot AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n, tree AS rid FROM up WHERE n = 1),
{_climbed("top", "subroot")},
deep AS (SELECT tree, max(lvl) AS steps FROM up GROUP BY tree),
way AS ({_siblings("leaf", "up", "0")} UNION ALL
  SELECT a.rid, deep.steps + s.step, s.mark FROM leaf a JOIN deep USING (tree) JOIN ({_siblings("subroot", "top", "0")}) s ON s.rid = a.tree),
path AS (SELECT rid, list(mark ORDER BY step) AS marks FROM way GROUP BY rid),
ends AS (SELECT leaf.*, coalesce(path.marks, []) AS marks, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root
  FROM leaf JOIN subroot s ON s.name = leaf.tree LEFT JOIN path ON path.rid = leaf.rid),
done AS (SELECT *, list_reduce(marks, lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END), coalesce(changed, h)) AS folded_root FROM ends)
SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string(list_transform(marks, lambda x: x[2:]), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM done"""
