"""Packing tokenised documents into windows.

A document's identifiers are cut into full windows and one rest. The rests are packed by lengths alone: a
histogram of at most ``window`` counts is all that the driver sees. Combinations of up to three lengths that
fill a window are the columns of a non-negative least-squares problem whose right side is the histogram;
its solution says how often to repeat each combination. Repeats are rounded, largest first, within what
the histogram still holds, and the pieces left over are packed greedily. Where that leaves large gaps, as
when most documents have one awkward length, the pieces concerned are cut once more and all are planned
anew. The plan then gives every piece its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagelens.llm.common import lean, map_rows
from pagelens.session import materialize

SEQUENCE = 1024
#: Ends every document.
END = 0
#: The vocabulary of byte_bpe_50k.json in the form of the faster of the two libraries; tests compare their identifiers.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Has the tokens that were added to the vocabulary; a text that names one holds that token.
TOKENIZER = "byte_bpe_50k.json"
ROUNDS = 150
#: Share of a window that may stay empty before the pieces in it are cut.
GAP = 0.01


@cache
def encoding(name: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, name: str = VOCABULARY) -> np.ndarray:
    """Identifiers of a whole text and the closing one; names of special tokens are ordinary text."""
    return np.array([*encoding(name).encode_ordinary(text or ""), END], dtype="<u4")


@cache
def added_tokens(name: str = TOKENIZER) -> tuple[Tokenizer, tuple[str, ...]]:
    """The other library's tokenizer, and the names of its added tokens."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return tokenizer, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def document_ids(text: str | None, name: str = VOCABULARY) -> np.ndarray:
    """Identifiers of a whole text, added tokens that it names as such, and the closing one."""
    if text and name == VOCABULARY:
        tokenizer, names = added_tokens()
        if any(n in text for n in names):
            return np.array([*tokenizer.encode(text, add_special_tokens=False).ids, END], dtype="<u4")
    return token_ids(text, name)


# plan

def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Rows of up to three lengths, zero for none, that fill ``window``; only lengths that occur."""
    have = np.zeros(window + 1, dtype=bool)
    have[present] = True
    a = np.arange(1, window // 2 + 1)
    two = np.stack([a, window - a, np.zeros_like(a)], axis=1)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(1, window // 3 + 1), np.arange(1, window // 2 + 1), indexing="ij"))
    k = window - i - j
    fits = (i <= j) & (j <= k)
    three = np.stack([i[fits], j[fits], k[fits]], axis=1)
    c = np.concatenate([two, three])
    return c[(have[c] | (c == 0)).all(axis=1)]


def nnls(combos: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeats ``x >= 0`` that minimise ``|A x - h|``, ``A`` the lengths of each combination.

    Multiplicative updates keep every repeat non-negative and never raise the loss; ``A`` has three
    entries a column, so a round is three gathers and three sums.
    """
    used = combos > 0
    gather = lambda v: sum(np.where(used[:, s], v[combos[:, s]], 0.0) for s in range(3))
    scatter = lambda x: sum(np.bincount(combos[:, s], np.where(used[:, s], x, 0.0), len(histogram)) for s in range(3))
    goal = gather(histogram.astype(float))
    x = np.full(len(combos), histogram.sum() / max(len(combos), 1))
    for _ in range(rounds):
        x *= goal / np.maximum(gather(scatter(x)), 1e-12)
    return x


def plan(histogram: np.ndarray, window: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Lengths laid end to end in one sequence, and how many sequences do so; uses up the histogram exactly."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: list[int], times: int) -> None:
        if times > 0:
            out.append((tuple(lengths), times))
            for n in lengths:
                left[n] -= times

    take([window], int(left[window]))
    combos = combinations(window, np.nonzero(left)[0])
    if len(combos):
        x = nnls(combos, left)
        for at in np.argsort(-x, kind="stable"):
            lengths = [int(n) for n in combos[at] if n]
            need = {n: lengths.count(n) for n in lengths}
            take(lengths, min(int(np.rint(x[at])), min(int(left[n]) // m for n, m in need.items())))
    while left.any():
        lengths = _fill(left, window)
        need = {n: lengths.count(n) for n in set(lengths)}
        take(lengths, min(int(left[n]) // m for n, m in need.items()))
    return out


def _fill(left: np.ndarray, window: int) -> list[int]:
    """The longest piece left, then whichever one or two pieces fill the gap best, until nothing fits."""
    spare = left.copy()
    lengths, gap = [], window
    while gap > 0:
        have = np.nonzero(spare[: gap + 1])[0]
        if not len(have):
            break
        best = [int(have[-1])]
        if lengths and best[0] < gap and len(have) > 1:
            other = have[np.searchsorted(have, gap - have, side="right") - 1]
            fits = (have + other <= gap) & (other > 0) & ((have != other) | (spare[have] > 1))
            if fits.any():
                at = int(np.argmax(np.where(fits, have + other, 0)))
                if have[at] + other[at] > best[0]:
                    best = [int(have[at]), int(other[at])]
        for n in best:
            spare[n] -= 1
            lengths.append(n)
            gap -= n
    return sorted(lengths, reverse=True)


def padding(planned: list[tuple[tuple[int, ...], int]], window: int = SEQUENCE) -> int:
    """Places that stay empty; a sequence that is a power of two long is not padded."""
    return sum(times * (window - sum(n)) for n, times in planned if sum(n) & (sum(n) - 1))


def cut_at(length: int, window: int = SEQUENCE) -> int:
    """Where a piece is cut if the plan asks for it: after half or a quarter of a window, 0 for nowhere."""
    return next((h for h in (window // 2, window // 4) if h < length < window), 0)


def plan_with_cuts(histogram: np.ndarray, window: int = SEQUENCE) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """A plan, and how many pieces of each length it wants cut: those of sequences with gaps, if that lessens the padding."""
    best, cuts = plan(histogram, window), np.zeros_like(histogram)
    wanted = np.zeros_like(histogram)
    for lengths, times in best:
        if window - sum(lengths) > GAP * window and padding([(lengths, 1)], window):
            for n in lengths:
                wanted[n] += times if cut_at(n, window) else 0
    if wanted.any():
        after = histogram - wanted
        for n in np.nonzero(wanted)[0]:
            head = cut_at(int(n), window)
            after[head] += wanted[n]
            after[n - head] += wanted[n]
        other = plan(after, window)
        if padding(other, window) < padding(best, window):
            best, cuts = other, wanted
    return best, cuts


def fragment_ranks(histogram: np.ndarray, cuts: np.ndarray, window: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length: the pieces that stay whole, and the first ranks of heads and of tails among pieces of their own lengths."""
    whole = histogram - cuts
    seen, head, tail = whole.copy(), np.zeros_like(histogram), np.zeros_like(histogram)
    for n in np.nonzero(cuts)[0]:
        at = cut_at(int(n), window)
        head[n] = seen[at]
        seen[at] += cuts[n]
        tail[n] = seen[n - at]
        seen[n - at] += cuts[n]
    return whole, head, tail


def slots(planned: list[tuple[tuple[int, ...], int]], window: int = SEQUENCE) -> dict[int, np.ndarray]:
    """For each length, rows of first rank, first sequence, uses in one sequence, offset of the first use."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    seen = np.zeros(window + 1, dtype=np.int64)
    sequence = 0
    for lengths, times in planned:
        offset = 0
        for n in dict.fromkeys(lengths):
            uses = lengths.count(n)
            table.setdefault(n, []).append((int(seen[n]), sequence, uses, offset))
            seen[n] += uses * times
            offset += uses * n
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in table.items()}


# rows

def pieces(docs: DataFrame, window: int = SEQUENCE, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``, the checksums of a piece's halves should it be cut, and its rank among the pieces of that length in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = document_ids(text, vocabulary)
                for start in range(0, len(ids), window):
                    piece = ids[start:start + window]
                    at = cut_at(len(piece), window)
                    crc = [zlib.crc32(x.tobytes()) for x in (piece, piece[:at], piece[at:])]
                    rows.append((doc_id, start, len(piece), *crc, len(ids), int(seen[len(piece)])))
                    seen[len(piece)] += 1
            if rows:
                made = [pa.array(x, type=pa.int64()) for x in zip(*rows)]
                names = ["doc_id", "start", "length", "ids_crc32", "head_crc32", "tail_crc32", "doc_tokens", "nth", "part"]
                yield pa.RecordBatch.from_arrays([*made, pa.array(np.full(len(rows), part, dtype=np.int64))], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, head_crc32 long, tail_crc32 long, doc_tokens long, nth long, part long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema)


def packed(docs: DataFrame, window: int = SEQUENCE, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the closing identifier alone. Repeated rows are packed each for itself, a null
    doc_id stays null, other columns are not read, an empty table gives an empty result. A sequence that
    is neither full nor a power of two long is padded to ``window``.
    """
    made = materialize(pieces(docs, window, vocabulary), "pieces")
    counts = materialize(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        histogram[row["length"]] = row["n"]
    planned, cuts = plan_with_cuts(histogram, window)
    table = slots(planned, window)
    whole, head_rank, tail_rank = fragment_ranks(histogram, cuts, window)
    past = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"))
    ranked = made.join(before, ["part", "length"]).select(
        "doc_id", "doc_tokens", "start", "length", "ids_crc32", "head_crc32", "tail_crc32", (F.col("nth") + F.col("before")).alias("rank"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc_id, tokens = batch.column("doc_id"), batch.column("doc_tokens")
        start, length, crc, head, tail, rank = (batch.column(c).to_numpy() for c in ("start", "length", "ids_crc32", "head_crc32", "tail_crc32", "rank"))
        uncut, cut = np.nonzero(rank < whole[length])[0], np.nonzero(rank >= whole[length])[0]
        at = np.array([cut_at(int(n), window) for n in length[cut]], dtype=np.int64)
        over = rank[cut] - whole[length[cut]]
        row = np.concatenate([uncut, cut, cut])
        start = np.concatenate([start[uncut], start[cut], start[cut] + at])
        rank = np.concatenate([rank[uncut], head_rank[length[cut]] + over, tail_rank[length[cut]] + over])
        crc = np.concatenate([crc[uncut], head[cut], tail[cut]])
        length = np.concatenate([length[uncut], at, length[cut] - at])
        sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        for n in np.unique(length):
            mine = np.nonzero(length == n)[0]
            rows = table[int(n)][np.searchsorted(table[int(n)][:, 0], rank[mine], side="right") - 1]
            within = rank[mine] - rows[:, 0]
            sequence[mine] = rows[:, 1] + within // rows[:, 2]
            offset[mine] = rows[:, 3] + within % rows[:, 2] * n
        made = [doc_id.take(pa.array(row)), *map(pa.array, (start, length, crc)), tokens.take(pa.array(row)), pa.array(sequence), pa.array(offset)]
        return pa.RecordBatch.from_arrays(made, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return map_rows(ranked, place, ", ".join(f"{n} long" for n in names))
