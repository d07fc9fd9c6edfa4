"""Links between texts whose sets of word shingles are alike, by MinHash bands, rare shingles and an exact comparison.

A text is known by its set of shingle hashes; texts with one set are one content. Every content has minima under
many hash functions. Those of a band make a key, and contents that share a key meet. Which of those that meet are
compared is told by one bit of each minimum, with room for five standard errors, and by counts of their hashes in bins,
which bound from above what two sets share; whether they are linked is told by their whole sets. A pair beyond the bound
is no link, so pairs that are nearly alike leave no task. Contents that links join already are not compared again, and
one content is compared with few others in a round, whatever the keys it has: a group of any number of near copies
costs about as many comparisons as it has members. The others are compared in rounds, each with more partners for
every member, under the keys that have pairs left, until no pair is left.

Bands and bits join most contents at little cost but are chances: a pair may share no band, or differ in more bits. So
contents that they leave apart meet again under their rarest shingles. In one order of all shingles two sets that are
alike share one of their first, as many as either can have without the other and one more. Only contents that can be
alike by this are looked at, under the bands too, and of those that are left apart exact bounds alone tell which are
compared, so no link is left out. The order goes by how often shingles occur, counted over all texts in slots: it
decides how many meet, not which are linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import lean, map_rows, shuffle_width
from pagelens.session import materialize

BANDS, ROWS = 24, 5
#: Minima, of which each gives a bit to the sketch.
MINIMA = 256
#: Partners of a member in the first round, and their growth from round to round.
PARTNERS, MORE = 2, 4
#: Partners of a member in the first round over what the bands have left apart, where few have any.
REST = 128
BLOCK = 1024
#: Bins of a content's hashes, and the most that one may count.
BINS, BYTE_COUNTS = 512, 255
#: Slots in which shingles are counted, and the parts that their counts are added in.
SLOTS, PARTS = 1 << 18, 16
#: Members of a shingle up to which those without a possible partner are left out before they are looked at by labels.
SIFTED = 256
_RNG = np.random.default_rng(7)
_XOR, _ODD = _RNG.integers(0, 2**64, (MINIMA, 1), dtype=np.uint64), _RNG.integers(0, 2**64, (MINIMA, 1), dtype=np.uint64) | np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted different hashes of a text's word shingles; a text of fewer words is one shingle, one without a word has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(joined, 42)] if words else [], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    stops = (ends[width - 1:] - 1).tolist()
    return np.unique(np.array([hashed(joined[a:b], 42) for a, b in zip(starts, stops)], dtype=np.uint64))


def content(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) if len(found) else 0


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def minima(found: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(found), 2048):
        out = np.minimum(out, ((found[at:at + 2048] ^ _XOR) * _ODD).min(axis=1))
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band, of ``(contents, MINIMA)``."""
    m = least[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _PRIME, m.shape[:2])
    for i in range(ROWS):
        key = (key ^ m[:, :, i]) * _PRIME
        key = key ^ (key >> np.uint64(29))
    return key


def sketches(least: np.ndarray) -> np.ndarray:
    """One bit of each minimum, ``(contents, MINIMA / 64)``."""
    mixed = (least ^ (least >> np.uint64(31))) * _PRIME
    bits = (mixed >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def bin_counts(found: np.ndarray) -> bytes:
    """How many hashes fall in each bin. A content with a bin beyond a byte has none and is never told apart by them."""
    counts = np.bincount((found >> np.uint64(32)).astype(np.int64) % BINS, minlength=BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() <= BYTE_COUNTS else b""


def may_be_alike(x: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with these bin counts can have the similarity: two sets share at most the smaller count of each bin. Counts of nothing can."""
    both = np.minimum(x, others).sum(axis=1, dtype=np.int64)
    a, b = int(x.sum(dtype=np.int64)), others.sum(axis=1, dtype=np.int64)
    return (both >= similarity * (a + b - both) - 1e-6) | (a == 0) | (b == 0)


def most_differing(similarity: float) -> int:
    """Differing bits of two sketches up to which a pair is compared: five standard errors over those expected."""
    p = (1 - similarity) / 2
    return math.ceil(MINIMA * p + 5 * math.sqrt(MINIMA * p * (1 - p)))


def prints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, fp, row, keys, sketch`` of every row: its content, a hash of identifier and text, band keys and sketch.

    Each task adds :data:`PARTS` rows with ``counts``, its shingles by slots, which :func:`levels` reads; in others they are null.
    """
    names, size = ["doc_id", "fp", "row", "keys", "sketch", "counts"], SLOTS // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
            if not sets:
                continue
            for s in sets:
                np.add.at(total, slots(s), 1)
            least = np.stack([minima(s) for s in sets])
            fp = np.array([content(s) for s in sets], dtype=np.uint64)
            lists = [pa.array(list(x.view(np.int64)), type=pa.list_(pa.int64())) for x in (band_keys(least), sketches(least))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), batch.column("row"), *lists, pa.nulls(len(sets), pa.binary())], names)
        counts = np.minimum(total, 2**16 - 1).astype("<u2")
        none = [pa.nulls(PARTS, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
        rows = [counts[at:at + size].tobytes() for at in range(0, SLOTS, size)]
        yield pa.RecordBatch.from_arrays([none[0], pa.array(range(PARTS), type=pa.int64()), *none[1:], pa.array(rows, type=pa.binary())], names)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    return read.mapInArrow(lean(run), "doc_id long, fp long, row long, keys array<long>, sketch array<long>, counts binary")


def slots(found: np.ndarray) -> np.ndarray:
    return (found % np.uint64(SLOTS)).astype(np.int64)


def levels(printed: DataFrame) -> np.ndarray:
    """How often the shingles of each slot occur in all texts, in eighths of a doubling, from the counts of :func:`prints`; they are added part by part."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[part] = total.get(part, 0) + np.frombuffer(counts, dtype="<u2").astype(np.int64)
        steps = [np.minimum(8 * np.log2(1 + n), 255).astype(np.uint8).tobytes() for n in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int64()), pa.array(steps, type=pa.binary())], ["part", "steps"])

    rows = printed.filter("counts IS NOT NULL").select("fp", "counts").repartition(PARTS, "fp")
    found = {r.part: bytes(r.steps) for r in rows.mapInArrow(lean(add), "part long, steps binary").collect()}
    return np.frombuffer(b"".join(found.get(p, bytes(SLOTS // PARTS)) for p in range(PARTS)), dtype=np.uint8)


def candidates(label: np.ndarray, sketch: np.ndarray, most: int, partners: int, bins: np.ndarray | None = None,
               similarity: float = 0.0) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of members to compare: for each up to ``partners`` that it may be linked to and is not yet; and whether any has more.

    Members of the most frequent label are joined already, so only the others look for partners. With ``bins`` a partner's
    bin counts allow the similarity.
    """
    n = len(label)
    _, at, count = np.unique(label, return_inverse=True, return_counts=True)
    seeking = np.nonzero(at != count.argmax())[0]
    pairs, full = [], False
    for lo in range(0, len(seeking), BLOCK):
        mine = seeking[lo:lo + BLOCK]
        wanted = np.full(len(mine), partners)
        for back in range(0, n, BLOCK):  # partners by their distance before the block, so that no member is everyone's
            some = np.nonzero(wanted > 0)[0]
            if not len(some):
                break
            other = (mine[-1] - back - np.arange(min(BLOCK, n - back))) % n
            x = mine[some]
            bits = sum(np.bitwise_count(sketch[x, i][:, None] ^ sketch[other, i]).astype(np.int16) for i in range(sketch.shape[1]))
            hit = (bits <= most) & (label[x][:, None] != label[other])
            behind = (x[:, None] - other) % n
            for r in np.nonzero(hit.any(axis=1))[0]:
                to = np.nonzero(hit[r])[0]
                to = to[np.argsort(behind[r, to], kind="stable")]
                if bins is not None:
                    to = _first_allowed(bins[x[r]], bins, other[to], to, similarity, int(wanted[some[r]]))
                to = to[: wanted[some[r]]]
                pairs.append((np.full(len(to), x[r]), other[to]))
                wanted[some[r]] -= len(to)
        full |= bool((wanted == 0).any())
    if not pairs:
        return seeking[:0], seeking[:0], False
    a, b = (np.concatenate(x) for x in zip(*pairs))
    return a, b, full


def _first_allowed(x: np.ndarray, bins: np.ndarray, place: np.ndarray, to: np.ndarray, similarity: float, wanted: int) -> np.ndarray:
    """The first ``wanted`` of ``to`` that bin counts allow, looked for in growing steps: most members find theirs at once."""
    kept, at, step = [], 0, 4 * wanted
    while at < len(to) and wanted > 0:
        got = to[at:at + step][may_be_alike(x, bins[place[at:at + step]], similarity)][:wanted]
        kept.append(got)
        wanted, at, step = wanted - len(got), at + step, step * 4
    return np.concatenate(kept) if kept else to[:0]


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole keys of a stream sorted by key."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (rest and rest[-1].column(0)[-1].as_py() != key[-1]):
            rest.append(batch.slice(0, cut))
            yield pa.Table.from_batches(rest)
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def rarest(found: np.ndarray, level: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's shingles by level and hash, of which any set with the similarity holds one among its own first."""
    n = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
    return found[np.argsort(level[slots(found)], kind="stable")[:n]] if len(found) else found


def has_partner(label: np.ndarray, size: np.ndarray, left: np.ndarray, similarity: float) -> np.ndarray:
    """Whether a member of its row can have the similarity to one of another label: two sets share at most what either has ``left`` from their first common shingle on."""
    least = similarity / (1 + similarity) * (size[:, :, None] + size[:, None, :]) - 1e-6
    can = (np.minimum(left[:, :, None], left[:, None, :]) >= least) & (label[:, :, None] != label[:, None, :])
    return can.any(axis=2)


def sharing(docs: DataFrame, level: np.ndarray, width: int, similarity: float) -> DataFrame:
    """``key, fp, size, left``: contents under each of their rarest shingles that another one which can be alike has too,
    with the size of their set and what is left of it from the shingle on."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in a task are one content; those of other tasks merge below
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                out = []
                for t in batch.column(0).slice(at, BLOCK).to_pylist():
                    s = shingles(t, width)
                    fp, n = content(s), len(s)
                    if n and fp not in seen:
                        seen.add(fp)
                        key = rarest(s, level, similarity).view(np.int64)
                        out.append((key, np.full(len(key), fp, dtype=np.uint64).view(np.int64), np.full(len(key), n, dtype=np.int32), np.arange(n, n - len(key), -1, dtype=np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["key", "fp", "size", "left"])

    rows = docs.select("text").mapInArrow(lean(expand), "key long, fp long, size int, left int")
    return sifted(rows, None, similarity, shuffle_width(docs))


def sifted(rows: DataFrame, label: DataFrame | None, similarity: float, width: int) -> DataFrame:
    """The ``key, fp, size, left`` that have under their key another one, not joined to them by ``label``, to which they can be alike."""
    rows = rows.withColumn("label", F.col("fp")) if label is None else (
        rows.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches):
            key, fp, size, left, label = (t.column(i).to_numpy() for i in range(5))
            one = np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]
            key, fp, size, left, label = key[one], fp[one], size[one], left[one], label[one]
            first = np.r_[0, np.nonzero(np.diff(key))[0] + 1]
            count = np.diff(np.r_[first, len(key)])
            large = (count > SIFTED) & (np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first))
            keep = np.repeat(large, count)
            for n in np.unique(count[(count > 1) & (count <= SIFTED)]):
                at, step = first[count == n], max(1, 2_000_000 // (n * n))
                for lo in range(0, len(at), step):
                    member = at[lo:lo + step, None] + np.arange(n)
                    keep[member] = has_partner(label[member], size[member], left[member], similarity)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, fp, size, left)], ["key", "fp", "size", "left"])

    rows = rows.select("key", "fp", "size", "left", "label").repartition(width, "key").sortWithinPartitions("key", "fp")
    return rows.mapInArrow(lean(sift), "key long, fp long, size int, left int")


def links(distinct: DataFrame, docs: DataFrame, level: np.ndarray, width: int, similarity: float, components) -> DataFrame:
    """``hi, lo``: enough exactly compared links to join all contents that are at least so similar.

    ``distinct`` has ``fp, row, keys, sketch`` of each content, ``row`` one of its rows in ``docs``; ``level`` is that of :func:`levels`.
    """
    tasks = shuffle_width(distinct)
    rare = materialize(sharing(docs, level, width, similarity), "rare")
    able = materialize(distinct.join(rare.select("fp").distinct(), "fp", "left_semi").select("fp", "row", "keys", "sketch"), "able")
    keyed = able.select("fp", F.explode("keys").alias("key"))
    again = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    sets = materialize(shingle_sets(docs, able.select("fp", "row", "sketch"), width), "sets")
    linked, compared, label = settled(keyed.join(again, "key", "left_semi"), sets, most_differing(similarity), similarity, components, tasks)
    left = sifted(rare, label, similarity, tasks)
    return settled(left.select("key", "fp"), sets, MINIMA, similarity, components, tasks, REST, linked, compared, label)[0]


def settled(met: DataFrame, sets: DataFrame, most: int, similarity: float, components, width: int, partners: int | None = None,
            linked: DataFrame | None = None, compared: DataFrame | None = None, label: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``linked``, ``compared`` and ``label`` after rounds over the ``key, fp`` of ``met``, until contents that meet, differ in at
    most ``most`` bits and can have the similarity are joined or compared."""
    parts = [f"s{i}" for i in range(MINIMA // 64)]
    known = sets.select("fp", "bins", *[F.col("sketch")[i].alias(p) for i, p in enumerate(parts)])
    met = materialize(met.join(known, "fp"), "met")
    partners = partners or PARTNERS
    while True:
        now = met.withColumn("label", F.col("fp"))
        if label is not None:
            now = met.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        rows = now.select("key", "fp", "label", *parts, "bins")
        rows = rows.repartition(width, "key").sortWithinPartitions("key", "fp")

        def meet(batches: Iterator[pa.RecordBatch], partners: int = partners) -> Iterator[pa.RecordBatch]:
            for t in whole_keys(batches):
                key, fp, label, *bits = (t.column(i).to_numpy() for i in range(3 + len(parts)))
                sketch = np.stack(bits, axis=1).view(np.uint64)
                first = np.r_[0, np.nonzero(np.diff(key))[0] + 1, len(key)]
                out = []
                for lo, hi in zip(first[:-1], first[1:]):
                    if (label[lo:hi] != label[lo]).any():
                        bins = np.stack([np.frombuffer(x or bytes(BINS), dtype=np.uint8) for x in t.column("bins")[lo:hi].to_pylist()])
                        a, b, full = candidates(label[lo:hi], sketch[lo:hi], most, partners, bins, similarity)
                        out.append((fp[lo:hi][a], fp[lo:hi][b], key[lo:hi][a], np.full(len(a), full)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["one", "other", "key", "more"])

        found = materialize(rows.mapInArrow(lean(meet), "one long, other long, key long, more boolean"), "found")
        # of what a content's keys propose it takes a few, by hashes; a key of which anything is left stays open
        nth = F.row_number().over(Window.partitionBy("one").orderBy(F.xxhash64("one", "other"), "other"))
        once = found.select("one", "other").distinct().withColumn("taken", nth <= partners)
        left = found.filter("more").select("key").union(found.join(once.filter("not taken"), ["one", "other"], "left_semi").select("key"))
        open_keys = materialize(left.distinct(), "open")
        more = not open_keys.isEmpty()
        new = once.filter("taken").select(F.greatest("one", "other").alias("hi"), F.least("one", "other").alias("lo")).distinct()
        if compared is not None:
            new = new.join(compared, ["hi", "lo"], "left_anti")
        done = materialize(similarities(new, sets), "compared")
        tried = not done.isEmpty()
        if not tried and not more:
            none = done.select("hi", "lo")
            return linked if linked is not None else none, compared if compared is not None else none, label
        if tried:
            compared = done.select("hi", "lo") if compared is None else compared.union(done.select("hi", "lo"))
            passed = done.filter(F.col("similarity") >= similarity).select("hi", "lo")
            linked = passed if linked is None else linked.union(passed)
            label = components(linked)
        if not more:
            return linked, compared, label
        met = materialize(met.join(open_keys, "key", "left_semi"), "met")
        partners *= MORE


def shingle_sets(docs: DataFrame, need: DataFrame, width: int) -> DataFrame:
    """``fp, sketch, set, bins`` of the contents ``fp, row, sketch``, from the whole text of one row each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
        made = [pa.array([s.view(np.int64) for s in sets], type=pa.list_(pa.int64())), pa.array([bin_counts(s) for s in sets], type=pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("sketch"), *made], ["fp", "sketch", "set", "bins"])

    need = need.withColumnRenamed("row", "_row")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").join(need, F.col("row") == F.col("_row"))
    return map_rows(texts.dropDuplicates(["row"]).select("fp", "sketch", "text"), run, "fp long, sketch array<long>, set array<long>, bins binary")


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``hi, lo, similarity`` of pairs of contents, from their whole ``fp, set``."""

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = batch.column("a"), batch.column("b")
        found = [alike(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(a, b)]
        return pa.RecordBatch.from_arrays([batch.column("hi"), batch.column("lo"), pa.array(found, type=pa.float64())], ["hi", "lo", "similarity"])

    j = pairs.join(sets.select(F.col("fp").alias("hi"), F.col("set").alias("a")), "hi").join(sets.select(F.col("fp").alias("lo"), F.col("set").alias("b")), "lo")
    return map_rows(j.select("hi", "lo", "a", "b"), compare, "hi long, lo long, similarity double")
