"""Near copies by SimHash, found through Golay-code keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. The binary Golay code (23, 12) is
perfect: every word of 23 bits lies within three bits of exactly one codeword, whose 12 message bits
are its index. A segment's keys are the indices that it and its one-bit neighbours decode to: one key
when the segment lies within two bits of its codeword, six when it lies at three. Two segments that
differ in at most one bit therefore share the plain index of either one.

Three differing bits over three segments leave either one segment equal and another with at most one
difference, or exactly one difference in each. The first case is met by keys of an exact segment and
one index (six ordered pairs), the second by three indices. On one side of a meeting an index is any
of the keys, on the other it is the plain one; both sides come from the same rows. Every pair within
three bits thus meets under some key, and each meeting is verified on the whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm import jaccard
from pagelens.llm.common import columns, map_rows, set_aside, shuffle_width
from pagelens.operators.graph import min_labels
from pagelens.session import materialize

SHINGLE = 3
MOST_BITS = 3
WIDTHS = (22, 21, 21)
#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Members of one bucket that are compared in one step; larger buckets go block against block.
BLOCK = 2048


# fingerprints

def fingerprint(text: str | None) -> int:
    """SimHash of a text's word shingles; zero without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII is lowered, only ASCII space splits
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return hashed(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1:] - 1).tolist()
    h = np.array([hashed(joined[a:b], 42) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


# Golay code

def _syndromes(words: np.ndarray) -> np.ndarray:
    r = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def _errors() -> np.ndarray:
    """The error of at most three bits for each of the 2048 syndromes."""
    bit = 1 << np.arange(23, dtype=np.uint32)
    one = np.r_[np.uint32(0), bit]
    sums = np.unique(one[:, None, None] ^ one[None, :, None] ^ one[None, None, :])
    table = np.zeros(2048, dtype=np.uint32)
    table[_syndromes(sums)] = sums
    return table


ERRORS = _errors()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 message bits) of the one codeword within three bits of each 23-bit word."""
    return (words ^ ERRORS[_syndromes(words)]) >> 11


def keys(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Plain index of each word, and the sorted indices of it and its one-bit neighbours, repeats as -1."""
    flips = np.r_[np.uint32(0), 1 << np.arange(width, dtype=np.uint32)]
    near = decode(words.astype(np.uint32)[:, None] ^ flips).astype(np.int64)
    plain = near[:, 0].copy()
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near.sort(axis=1)
    most = int((near >= 0).sum(axis=1).max(initial=1))
    return plain, near[:, -most:]


def key_rows(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``key, fp, side`` rows: side 1 offers any of an index's keys, 2 the plain one, 3 both."""
    at, seg = 0, []
    for width in WIDTHS:
        seg.append((fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    coded = [keys(s, w) for s, w in zip(seg, WIDTHS)]
    out = []
    for kind, (i, j) in enumerate([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]):
        plain, near = coded[j]
        rows, _ = np.nonzero(near >= 0)
        index = near[near >= 0]
        out.append(((seg[i][rows] << 12 | index) << 3 | kind, fp[rows], np.where(index == plain[rows], 3, 1)))
    (p0, n0), (p1, n1), (p2, n2) = coded
    left = np.where((n0[:, :, None] >= 0) & (n2[:, None, :] >= 0), (n0[:, :, None] << 12 | p1[:, None, None]) << 12 | n2[:, None, :], -1).reshape(len(fp), -1)
    right = np.where(n1 >= 0, (p0[:, None] << 12 | n1) << 12 | p2[:, None], -1)
    both = (p0 << 12 | p1) << 12 | p2
    for grid, side in ((left, 1), (right, 2)):
        rows, _ = np.nonzero(grid >= 0)
        key = grid[grid >= 0]
        own = key == both[rows]
        keep = ~own if side == 2 else np.ones(len(key), dtype=bool)
        out.append((key[keep] << 3 | 6, fp[rows][keep], np.where(own, 3, side)[keep]))
    key, fps, side = (np.concatenate(x) for x in zip(*out))
    return key, fps, side.astype(np.int8)


# links

def links(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``hi, lo``: enough verified links between distinct fingerprints to join all that lie within ``most_bits``.

    A bucket's members are linked to one member of their part of the bucket, so a bucket of ``n`` gives
    fewer than ``n`` links however alike its members are. Parts joined in some bucket are exactly those
    that chains of verified pairs join, so no connection is lost.
    """

    def expand(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        parts = [key_rows(fp[at:at + 4096]) for at in range(0, len(fp), 4096)]
        if not parts:
            return None
        key, f, side = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(f.view(np.int64)), pa.array(side)], ["key", "fp", "side"])

    rows = map_rows(fps.select("fp"), expand, "key long, fp long, side byte")
    met = rows.repartition(shuffle_width(fps), "key").sortWithinPartitions("key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, side in whole_groups(batches):
            a, b = bucket_links(key, fp, side, most_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["hi", "lo"])

    return met.mapInArrow(meet, "hi long, lo long").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays that hold whole keys of a stream sorted by key.

    A key's members are distinct fingerprints that agree on 34 bits of information or more, 17 bytes
    each; copies were merged before, so a group of copies of any number of rows is one member.
    """
    rest: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(batch.column(i).to_numpy() for i in range(3))
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut or (rest and rest[-1][0][-1] != now[0][-1]):
            rest.append(tuple(x[:cut] for x in now))
            yield tuple(np.concatenate(x) for x in zip(*rest))
            rest = []
        rest.append(tuple(x[cut:] for x in now))
    if rest:
        yield tuple(np.concatenate(x) for x in zip(*rest))


def bucket_links(key: np.ndarray, fp: np.ndarray, side: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of each key's members, thinned to one link a member."""
    first = np.r_[0, np.nonzero(np.diff(key))[0] + 1]
    size = np.diff(np.r_[first, len(key)])
    u = fp.view(np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    small = size <= 64
    for s in np.unique(size[small & (size > 1)]):  # all buckets of one size together
        at = first[size == s]
        for lo in range(0, len(at), max(1, 2_000_000 // (s * s))):
            member = at[lo:lo + max(1, 2_000_000 // (s * s)), None] + np.arange(s)
            x, d = u[member], side[member]
            hit = np.bitwise_count(x[:, :, None] ^ x[:, None, :]) <= most_bits
            hit &= ((d[:, :, None] & 1) > 0) & ((d[:, None, :] & 2) > 0)
            g, i, j = np.nonzero(hit)
            keep = member[g, i] != member[g, j]
            found.append((member[g, i][keep], member[g, j][keep]))
    for f, s in zip(first[~small], size[~small]):
        found.extend(_large(u[f:f + s], side[f:f + s], f, most_bits))
    if not found:
        return fp[:0], fp[:0]
    a, b = (np.concatenate(x) for x in zip(*found))
    node, at = np.unique(np.r_[a, b], return_inverse=True)
    root = node[min_labels(len(node), at[: len(a)], at[len(a):])]
    apart = fp[node] != fp[root]
    return fp[node][apart], fp[root][apart]


def _large(u: np.ndarray, side: np.ndarray, base: int, most_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One bucket, block against block; links are thinned after each block row, so memory follows the members."""
    left, right = np.nonzero(side & 1)[0], np.nonzero(side & 2)[0]
    for lo in range(0, len(left), BLOCK):
        mine, pairs = left[lo:lo + BLOCK], []
        for to in range(0, len(right), BLOCK):
            other = right[to:to + BLOCK]
            i, j = np.nonzero(np.bitwise_count(u[mine][:, None] ^ u[other]) <= most_bits)
            i, j = mine[i], other[j]
            node, at = np.unique(np.r_[i, j], return_inverse=True)
            root = node[min_labels(len(node), at[: len(i)], at[len(i):])] if len(node) else node
            pairs.append((node[node != root] + base, root[node != root] + base))
        if pairs:
            yield tuple(np.concatenate(x) for x in zip(*pairs))


# groups

def components(edges: DataFrame) -> DataFrame:
    """``hi, lo`` links to ``node, label``: the smallest node reachable, for every node with a link.

    Alternating large-star and small-star rounds; each is aggregated before it is shuffled and written
    to the shared folder, so no task holds a component and a lost executor costs one round.
    """
    e, mark = edges, None
    while True:
        both = e.select("hi", "lo").union(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        j = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                                                             F.struct("hi", F.col("m").alias("lo")))).alias("p"))
        e = materialize(j.select("p.hi", "p.lo").filter("hi <> lo").distinct(), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
        mark = now


def groups(docs: DataFrame, similarity: float | None = None, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Fingerprints within three bits are linked, equal ones included. With a ``similarity``, texts are linked whose
    sets of ``shingle`` words have at least that Jaccard similarity, and the fingerprint is a hash of the set; without
    one, ``shingle`` must be the width of the SimHash. ``component_id`` is the smallest
    doc_id that links reach. Null and empty texts have fingerprint zero and are linked like any other;
    rows with equal doc_id each keep their own row; a null doc_id counts only where a component has no
    other, whose ``component_id`` is then null. An empty table gives an empty result.
    """
    return labelled(docs, similarity, shingle).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def labelled(docs: DataFrame, similarity: float | None, shingle: int) -> DataFrame:
    """``doc_id, fp, component_id, label`` of every row, and with a ``similarity`` also ``row``, a hash of identifier and text; a group is known by its ``label``."""
    counted = [F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")]
    if similarity is None:
        if shingle != SHINGLE:
            raise ValueError(f"fingerprints are of {SHINGLE} words")
        table = materialize(fingerprints(docs), "fingerprints")
        distinct = materialize(table.groupBy("fp").agg(*counted), "distinct-fp")
        met = links(distinct)
    else:
        printed = materialize(jaccard.prints(docs, shingle), "fingerprints")
        table = printed.filter("counts IS NULL").drop("counts")
        one = F.min(F.struct("row", "keys", "sketch")).alias("one")
        distinct = materialize(table.groupBy("fp").agg(*counted, one).select("fp", "least", "n", "one.*"), "distinct-fp")
        met = jaccard.links(distinct, docs, jaccard.levels(printed), shingle, similarity, components)
        table, distinct = table.select("doc_id", "fp", "row"), distinct.select("fp", "least", "n")
    label = components(materialize(met, "links"))
    named = distinct.join(label, F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("label", "fp"))
    shared = named.filter("node IS NOT NULL OR n > 1")
    partners = shared.select("label").union(label.select("label")).distinct()
    of_label = distinct.join(label, F.col("fp") == F.col("node"), "left").select(F.coalesce("label", "fp").alias("label"), "least")
    of_label = of_label.join(partners, "label", "left_semi").groupBy("label").agg(F.min("least").alias("component_id"))
    reach = named.join(of_label, "label").select(F.col("fp").alias("_fp"), "component_id", "label")
    j = table.join(reach, F.col("fp") == F.col("_fp"), "left")
    alone = F.col("_fp").isNull()
    return j.select(*table.columns, F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("label", "fp").alias("label"))


def one_of_each(docs: DataFrame, similarity: float | None = None, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest doc_id stays, with all its columns.

    Without a ``similarity`` rows that share that doc_id are repeats; the one that comes first by the hash of its text
    stays. With one, every group keeps a row of its own, groups that share their smallest doc_id too. A
    group without any doc_id keeps one row in the same way. The parameters are those of :func:`groups`.
    """
    if similarity is not None:
        return one_of_each_label(docs, labelled(docs, similarity, shingle))
    kept = materialize(groups(docs, similarity, shingle).select(F.col("doc_id").alias("_d"), F.col("component_id").alias("_c"), "fingerprint"), "kept")
    slim, back = set_aside(docs, ("doc_id", "text"))
    named = kept.filter("_d = _c").select("_d").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.hash(*columns(slim)))
    mine = slim.join(named, F.col("doc_id") == F.col("_d"), "left_semi").withColumn("_nth", F.row_number().over(order))
    out = mine.filter("_nth = 1").select(*columns(slim))
    bare = kept.filter("_c IS NULL").select("fingerprint").distinct()
    if not bare.isEmpty():
        orphans = slim.filter("doc_id IS NULL").dropDuplicates(["text"])
        marked = orphans.join(fingerprint_of(orphans), F.col("text").eqNullSafe(F.col("_text"))).join(bare, F.col("_fp") == F.col("fingerprint"))
        out = out.unionByName(marked.dropDuplicates(["_fp"]).select(*columns(slim)))
    return back(out)


def one_of_each_label(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each label; of several such the first by the hash of identifier and text."""
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("label").agg(F.min("row").alias("_row"))
    first = materialize(first.select("_row").distinct(), "kept")
    slim, back = set_aside(docs, ("doc_id", "text"))
    mine = slim.withColumn("_hash", F.xxhash64("doc_id", "text")).join(first, F.col("_hash") == F.col("_row"), "left_semi")
    order = Window.partitionBy("_hash").orderBy(F.hash(*columns(slim)))
    return back(mine.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select(*columns(slim)))


def fingerprint_of(docs: DataFrame) -> DataFrame:
    """Each text with its fingerprint as 16 hexadecimal digits."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0)
        return pa.RecordBatch.from_arrays([texts, pa.array([f"{fingerprint(t):016x}" for t in texts.to_pylist()])], ["_text", "_fp"])

    return map_rows(docs.select("text"), run, "_text string, _fp string")
