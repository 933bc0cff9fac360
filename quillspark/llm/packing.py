"""Packing token sequences by minimum bin slack.

Texts become token ids (one end token after each text). A text's ids are cut into whole windows and one remaining piece
shorter than a window. Only the counts of pieces by length matter for what shares a window, a table of at most
`capacity` rows. On it the driver plans windows one after another: the longest length left is placed, then a subset-sum
dynamic program over the counts of the other lengths, kept as the bits of one integer, finds the reachable fill closest
to the capacity; going back through the stored bits gives how many pieces of each length to take. The same window is
then repeated as often as the counts allow, so that every pattern uses up at least one length and there are about as
many patterns as lengths. Where what is left cannot fill a window, the last windows stay partly filled.

Pieces get a number within their length without bringing a length's pieces together: lengths are dealt into slices by
a hash, numbered within each slice, and shifted by the counts of the slices before. Number and length give pattern,
window and place. Whole windows, most of all pieces, have as many slices as keep a slice near FULL_SLICE pieces. The
broadcast tables have at most capacity rows (patterns), and capacity * SLICES rows and one for each FULL_SLICE whole
windows (counts).

Defined results: null text counts as empty and is the end token alone; rows that repeat are packed as often as they
occur; an empty table gives an empty result; other columns take no part. doc_id may be null or repeat. A text is tokenized whole
in one worker: about 60 bytes of memory a byte of the longest text.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import durable
from quillspark.llm.textnp import give_back, mix, tidy

#: Slices into which the pieces of one length are dealt to be numbered.
SLICES = 256
#: Whole windows in a slice, about.
FULL_SLICE = 200_000


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others for
    the code points from 256 on, in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE vocabulary file, the same as the library's, computed once for each distinct piece.

    The vocabulary's own pattern splits a text into pieces that are encoded independently. Pieces are found for many
    texts at once with numpy (character classes of the code points), told apart by a 64-bit hash, and only pieces not
    met before are encoded. Texts for which the class rules don't suffice (apostrophes, special tokens) go to the
    reference encoders whole. The memory of pieces is bounded: beyond `keep` distinct ones it is begun anew."""

    #: The fixed split pattern of this family of vocabularies.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, keep: int = 600_000):
        import tiktoken

        self.path = path
        ranks, self.special, largest = self._vocabulary(path)
        self.plain = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.uint16 if largest < 1 << 16 else np.uint32
        self.classes = self._classes()
        self.keep = keep
        self._forget()

    @staticmethod
    def _vocabulary(path: str) -> tuple[dict[bytes, int], list[str], int]:
        """Ids by bytes, the special tokens, and the largest id. What else the file holds is let go again."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _byte_symbols()
        special = {x["content"] for x in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        return {bytes(symbols[c] for c in token): i for token, i in vocab.items() if token not in special}, sorted(special), max(vocab.values())

    @cached_property
    def full(self):
        """The library's tokenizer, made when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _classes() -> np.ndarray:
        """0 letter, 1 number, 2 other, 3 white space, by code point."""
        import sys

        import regex

        # surrogates can't occur in a text
        out = np.full(sys.maxunicode + 1, 2, np.uint8)
        for begin, end in ((0, 0xD800), (0xE000, sys.maxunicode + 1)):
            for at in range(begin, end, 1 << 14):
                some = np.arange(at, min(at + (1 << 14), end), dtype="<u4").tobytes().decode("utf-32-le")
                for value, pattern in ((0, r"\p{L}"), (1, r"\p{N}"), (3, r"\s")):
                    found = "".join(regex.findall(pattern, some))
                    out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
        return out

    def _forget(self) -> None:
        self.index: dict[int, int] = {}
        self.count, self.used = 0, 0
        self.begins = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, self.dtype)

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        encode = self.plain._core_bpe.encode_single_piece
        found = [encode(p.encode()) for p in pieces]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        total = int(lengths.sum())
        while self.count + len(found) > len(self.begins):
            self.begins, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.lengths))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.begins[self.count : self.count + len(found)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.count : self.count + len(found)] = lengths
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(found), self.dtype, total)
        self.index.update(zip(hashes, range(self.count, self.count + len(found)), strict=True))
        self.count += len(found)
        self.used += total

    def _pieces(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of text, and starts and ends of its pieces by the pattern (without the apostrophe cases)."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        n = len(kind)
        if not n:
            return points, np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.ones(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        blank = kind == 3
        # a run of white space before something else gives up its last character: to the piece that follows if
        # that character is U+0020, else as a piece of its own
        lasts = np.flatnonzero(blank[:-1] & ~blank[1:])
        start[lasts] = True
        start[lasts[points[lasts] == 0x20] + 1] = False
        begin = np.flatnonzero(start)
        return points, begin, np.append(begin[1:], n)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        group, size = [], 0
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = np.array(self.full.encode(text, add_special_tokens=False).ids, self.dtype)
            elif "'" in text:
                out[i] = np.array(self.plain.encode_ordinary(text), self.dtype)
            else:
                group.append(i)
                size += len(text)
                if size > 1 << 17:
                    self._together(texts, group, out)
                    group, size = [], 0
        self._together(texts, group, out)
        return out

    def _together(self, texts: list[str], group: list[int], out: list) -> None:
        import pandas as pd

        from quillspark.llm.textnp import hash_spans

        if not group:
            return
        parts = [self._pieces(texts[i]) for i in group]
        sizes = np.cumsum([0, *[len(p[0]) for p in parts]])
        points = np.concatenate([p[0] for p in parts])
        begin = np.concatenate([p[1] + s for p, s in zip(parts, sizes, strict=False)])
        end = np.concatenate([p[2] + s for p, s in zip(parts, sizes, strict=False)])
        if not len(begin):
            for i in group:
                out[i] = np.zeros(0, self.dtype)
            return
        hashes = hash_spans(mix(points.astype(np.uint64) + np.uint64(1)), begin, end)
        codes, distinct = pd.factorize(hashes)
        if self.count + len(distinct) > self.keep:
            self._forget()
        asked = distinct.tolist()
        known = list(map(self.index.get, asked))
        new = [j for j, k in enumerate(known) if k is None]
        if new:
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            joined = "".join([texts[i] for i in group])
            at = first[new]
            self._learn([asked[j] for j in new], [joined[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
            known = list(map(self.index.get, asked))
        known = np.array(known, np.int64)
        which = known[codes]
        lengths = self.lengths[which]
        stop = np.cumsum(lengths)
        where = np.arange(stop[-1]) + np.repeat(self.begins[which] - (stop - lengths), lengths)
        ids = self.flat[where]
        edge = np.append(0, stop)[np.cumsum([0, *[len(p[1]) for p in parts]])]
        for i, a, b in zip(group, edge[:-1], edge[1:], strict=True):
            out[i] = ids[a:b]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    own = Encoder(path)
    give_back()
    return own


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary files have this one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _piece_rows(path: str, capacity: int, end_id: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            at, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(own.encode_batch(texts)):
                data = np.append(ids.astype("<u4"), np.uint32(end_id)).astype("<u4")
                for a in range(0, len(data), capacity):
                    piece = data[a : a + capacity]
                    at.append(i)
                    start.append(a)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(data))
            out = [batch.column("doc_id").take(pa.array(at, pa.int32())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return tidy(rows)


def fill_window(counts: list[int], capacity: int) -> dict[int, int]:
    """How many pieces of each length to put into the next window: the longest, and of the others the multiset whose
    sum comes closest to what is left. counts[n]: pieces of length n, some not 0."""
    longest = max(n for n, c in enumerate(counts) if c)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in range(min(room, len(counts) - 1), 0, -1):
        left = min(counts[n] - (n == longest), room // n)
        k = 1
        while left > 0:  # binary shares of the count: 1, 2, 4, ... and the rest
            share = min(k, left)
            before = reach
            reach |= (reach << (n * share)) & mask
            steps.append((n, share, before))
            left -= share
            k *= 2
        if reach >> room & 1:
            break
    fill = reach.bit_length() - 1
    taken = {longest: 1}
    for n, share, before in reversed(steps):
        if not before >> fill & 1:
            taken[n] = taken.get(n, 0) + share
            fill -= n * share
    return taken


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns in order: (windows, {length: pieces in each window}). Uses up the histogram."""
    counts = [0] * (capacity + 1)
    for n, c in histogram.items():
        counts[n] = c
    plan = []
    while any(counts):
        taken = fill_window(counts, capacity)
        times = min(counts[n] // k for n, k in taken.items())
        for n, k in taken.items():
            counts[n] -= k * times
        plan.append((times, taken))
    return plan


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    pieces = source.mapInArrow(
        _piece_rows(tokenizer_path, capacity, end_id), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )
    pieces = durable(pieces)
    full = F.col("length") == capacity
    slices = F.when(full, max(SLICES, pieces.filter(full).count() // FULL_SLICE)).otherwise(SLICES)
    # salted by content, so that equal pieces spread too
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), slices).cast("int"))
    counts = pieces.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    counts = durable(counts.withColumn("before", F.coalesce(before, F.lit(0))))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    intervals, window = [], 0
    done = dict.fromkeys(histogram, 0)
    for times, taken in plan_windows(histogram, capacity):
        at = 0
        for n in sorted(taken, reverse=True):
            intervals.append((n, done[n], done[n] + taken[n] * times, taken[n], window, at))
            done[n] += taken[n] * times
            at += n * taken[n]
        window += times
    planned = _by_length(intervals)
    number = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "start", "ids_crc32")) - 1
    numbered = pieces.withColumn("number", number).join(F.broadcast(counts.select("length", "slice", "before")), ["length", "slice"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("before"))
    schema = "length long, spans array<struct<lo: long, hi: long, each: long, window: long, at: long>>"
    table = spark.createDataFrame(planned, schema)
    span = F.element_at(F.filter("spans", lambda s: (s.lo <= F.col("number")) & (F.col("number") < s.hi)), 1)
    placed = numbered.join(F.broadcast(table), "length").withColumn("span", span)
    within = F.col("number") - F.col("span.lo")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("span.window") + F.floor(within / F.col("span.each"))).cast("long").alias("sequence_id"),
        (F.col("span.at") + F.col("length") * F.pmod(within, F.col("span.each"))).cast("long").alias("offset"),
    )


def _by_length(intervals: list[tuple]) -> list[tuple]:
    found: dict[int, list] = {}
    for n, *rest in intervals:
        found.setdefault(n, []).append(tuple(rest))
    return list(found.items())
