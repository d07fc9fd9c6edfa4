"""The manifest against a plain tree, proofs of single leaves, and tampering."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelens.llm import merkle
from tests.llm.conftest import edge_rows


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(row, arity=2):
    """Subroot, and for every node its siblings by level, leaf first."""
    paths, at = [[] for _ in row], [[i] for i in range(len(row))]
    while len(row) > 1:
        above, members = [], []
        for a in range(0, len(row), arity):
            run = row[a:a + arity]
            for i in range(len(run)):
                for m in at[a + i]:
                    paths[m].append((i, run[:i] + run[i + 1:]))
            above.append(sha(*run))
            members.append([m for group in at[a:a + arity] for m in group])
        row, at = above, members
    return row[0], paths


def plain(rows):
    """rows: doc_id, text, lang, source, n_chars"""
    trees = {}
    for d, t, lang, s, n in rows:
        trees.setdefault(lang, []).append((d is not None, d or 0, leaf(d, s, lang, n, t), d, (s, lang, n, t)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for name in names:
        trees[name].sort(key=lambda r: r[:3])
        subs[name] = climb([r[2] for r in trees[name]])
    root, tops = climb([subs[x][0] for x in names])
    out = []
    for name, top in zip(names, tops):
        for (_, _, h, d, (s, lang, n, t)), path in zip(trees[name], subs[name][1]):
            now = h
            if d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0:
                now = leaf(d, s, lang, n + 1, t)
            for i, others in path + top:
                now = sha(*others[:i], now, *others[i:])
            proof = sha(*[x for _, others in path + top for x in others])
            out.append((d, h, subs[name][0], root, proof, now, now == root))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_report_equals_a_plain_tree(edge, nothing):
    report = merkle.manifest_report(edge)
    assert report.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = got(report)
    assert rows == plain(edge_rows())
    assert {r[-1] for r in rows} == {True, False}
    assert got(merkle.manifest_report(nothing)) == []


def test_one_row_and_one_repeated_row(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([(1, "a", "en", "s", 1)], [(None, None, None, None, None)] * 33, [(3, "a", "en", "s", None)] * 5 + [(2, "b", "", "s", 1)]):
        assert got(merkle.manifest_report(spark.createDataFrame(rows, schema))) == plain(rows)


@pytest.mark.parametrize(("arity", "most"), [(2, 4), (3, 9), (5, 5)])
def test_pages_and_arity_leave_proofs_alike(spark, arity, most):
    """Small pages, so that trees are several pages deep; trees of all sizes, one with most of the leaves."""
    sizes = {"": 1, "=a": 2, "=b": 17, "=c": 300, "=d": 8, "=e": 9}
    rows = [(t, i, sha(t, str(i))) for t, n in sizes.items() for i in range(n)]
    m = merkle.manifest(spark.createDataFrame(rows, "tree string, nth long, digest string"), ["nth"], arity, most)
    plain_trees = {t: climb([sha(t, str(i)) for i in range(n)], arity) for t, n in sizes.items()}
    root, tops = climb([plain_trees[t][0] for t in sorted(sizes)], arity)
    assert m.root == root
    wanted = m.leaves.filter("pos % 3 = 0").select("tree", "pos", "n", F.col("nth").alias("asked"))
    rows = merkle.proofs(m, wanted).collect()
    assert Counter((r.tree, r.pos) for r in rows) == Counter((t, i) for t, n in sizes.items() for i in range(0, n, 3))
    for r in rows:
        path = plain_trees[r.tree][1][r.pos] + tops[sorted(sizes).index(r.tree)]
        assert list(zip(r.digits, map(list, r.siblings))) == path
        assert (r.digest, r.subroot, r.asked) == (sha(r.tree, str(r.pos)), plain_trees[r.tree][0], r.pos)
        assert merkle.folded(r.digest, r.digits, r.siblings) == root
    assert m.store.count() == m.store.select("digest").distinct().count()


def test_identical_subtrees_share_records(spark):
    rows = [("=a", 0, sha("x"))] * 4096
    m = merkle.manifest(spark.createDataFrame(rows, "tree string, nth long, digest string"), ["nth"], 2, 16)
    assert m.store.count() == 12 and m.root == climb([sha("x")] * 4096)[0]


def test_no_request_gives_no_proof(spark):
    m = merkle.manifest(spark.createDataFrame([("=a", 0, sha("x")), ("=a", 1, sha("y"))], "tree string, nth long, digest string"), ["nth"])
    assert merkle.proofs(m, m.leaves.filter("pos > 5").select("tree", "pos", "n", F.col("nth").alias("asked"))).collect() == []
