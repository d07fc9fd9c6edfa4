"""Best-fit packing by minimum bin slack.

Documents stay whole unless they are longer than a window. All that decides the packing is the histogram of piece
lengths, at most ``window`` counts, so the driver plans on it alone. A bin takes the longest length left, and a
subset-sum program over the lengths still available finds what fills the rest of it best: bit ``t`` of one large
integer says whether a total of ``t`` can be reached, and adding a length is a shift and an OR. The combination found
is removed and the next bin begins. As removing lengths never makes a fuller combination possible, one found is
repeated as often as the histogram holds it; a plan has no more kinds of bins than it exhausts lengths and remainders.
A piece gets its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from pagelens.llm.common import WORD, map_rows
from pagelens.llm.packing import slots
from pagelens.session import materialize

WINDOW = 2048
#: Ends every document.
END = 0
VOCABULARY = "word_bpe_49k.json"
#: Words remembered with their identifiers.
REMEMBERED = 600_000
#: Characters whose lower case, composition and class (letter, digit or other) all Unicode versions agree on.
PLAIN = re.compile("[\\t-\\r -~À-ÿ¡¿«»‘’“”–—…€]*")
LOWER = "a-zß-öø-ÿ"
#: The vocabulary's own pattern, for lower-cased texts of such characters.
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LOWER}]+|[0-9]|[^\x20\x09-\x0D{LOWER}0-9]+")

Planned = list[tuple[tuple[int, ...], int]]


def letters() -> dict[int, int]:
    """Bytes as the letters that byte-level vocabularies write for them: printable ones are themselves, the others follow in order from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Identifiers:
    """Identifiers of texts as little-endian unsigned 32-bit numbers.

    The vocabulary's normaliser and patterns never look across ASCII white space, and its added tokens hold none, so a
    text has the identifiers of its words, one after the other. Words of plain characters are cut into pieces here
    and remembered; other words, and those that hold an added token, go through the whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = letters() | {32: 32}
        tokens = self.tokenizer.get_vocab()
        self.last = np.zeros(max(tokens.values()) + 1, dtype=bool)
        self.last[[i for t, i in tokens.items() if t.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.words = re.compile(WORD).findall
        self.known: dict[str, bytes] = {}

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(n in text for n in self.names)

    def learn(self, words: list[str]) -> None:
        """Identifiers of plain words, all merged in one call; only a piece's last token has the word's end."""
        pieces = [PIECE.findall(w) for w in words]
        joined = " ".join(chain.from_iterable(pieces)).encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        ends, of_word = np.nonzero(self.last[ids])[0], np.cumsum([len(p) for p in pieces])
        if len(ends) != of_word[-1]:
            raise ValueError("a vocabulary that marks the ends of words is needed")
        stops, raw = (4 * (ends[of_word - 1] + 1)).tolist(), ids.tobytes()
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        self.known.update(zip(words, (raw[a:b] for a, b in zip([0, *stops], stops))))

    def odd(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def spelt(self, lowered: str) -> bytes:
        words = lowered.split()  # plain characters have no white space but ASCII's
        out = []
        for at in range(0, len(words), REMEMBERED // 4):
            some = words[at:at + REMEMBERED // 4]
            unknown = set(some).difference(self.known)
            if unknown:
                self.learn(list(unknown if len(self.known) + len(unknown) <= REMEMBERED else set(some)))
            out.append(b"".join(map(self.known.__getitem__, some)))
        return b"".join(out)

    def of(self, text: str | None) -> bytes:
        """A whole text's identifiers and the closing one."""
        text = text or ""
        if self.plain(text):
            ids = self.spelt(text.lower())
        else:
            ids = b"".join(self.spelt(w.lower()) if self.plain(w) else self.odd(w) for w in self.words(text))
        return ids + END.to_bytes(4, "little")


@cache
def identifiers(vocabulary: str = VOCABULARY) -> Identifiers:
    return Identifiers(vocabulary)


# plan

def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths, no more of each than ``counts``, whose total within ``room`` is largest; long ones before short ones."""
    reach, within = 1, (1 << room + 1) - 1
    steps: list[tuple[int, int, int]] = []
    for n in np.nonzero(counts[: room + 1])[0][::-1].tolist():
        left, pack = min(int(counts[n]), room // n), 1
        while left and not reach >> room & 1:  # copies by powers of two reach every number of them
            use = min(pack, left)
            more = (reach | reach << n * use) & within
            if more != reach:
                steps.append((n, use, reach))
                reach = more
            left, pack = left - use, pack * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for n, use, before in reversed(steps):
        if not before >> total & 1:
            out += [n] * use
            total -= n * use
    return out


def plan(histogram: np.ndarray, window: int = WINDOW) -> Planned:
    """Lengths laid end to end in one sequence, and how many sequences do so; uses up the histogram exactly."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: Planned = []
    while left.any():
        longest = int(np.nonzero(left)[0][-1])
        left[longest] -= 1
        lengths = [longest, *fullest(left, window - longest)]
        left[longest] += 1
        need = {n: lengths.count(n) for n in lengths}
        times = min(int(left[n]) // m for n, m in need.items())
        for n, m in need.items():
            left[n] -= m * times
        out.append((tuple(sorted(lengths, reverse=True)), times))
    return out


# rows

def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, and a piece's rank among those of its length in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, dtype=np.int64)
        known = identifiers(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = known.of(text.as_py())
                for piece, at in enumerate(range(0, len(ids), 4 * window)):
                    cut = ids[at:at + 4 * window]
                    n = len(cut) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(cut), int(seen[n]), part))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*rows)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def best_fit(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the closing identifier alone. A document longer than ``window`` is cut into full windows
    and one rest; no other is cut. Repeated rows are packed each for itself, a null doc_id stays null, other columns are
    not read, pieces of equal length are alike to the plan, an empty table gives an empty result. Sequences count from 0.
    """
    made = materialize(pieces(docs, window, vocabulary), "pieces")
    counts = materialize(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        histogram[row["length"]] = row["n"]
    table = slots(plan(histogram, window), window)
    past = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"))
    rows = made.join(before, ["part", "length"])
    ranked = rows.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
        for n in np.unique(length):
            mine = np.nonzero(length == n)[0]
            first = table[int(n)][np.searchsorted(table[int(n)][:, 0], rank[mine], side="right") - 1]
            within = rank[mine] - first[:, 0]
            sequence[mine] = first[:, 1] + within // first[:, 2]
            offset[mine] = first[:, 3] + within % first[:, 2] * n
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return map_rows(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
