"""Deduplication of long passages by sparse suffix arrays.

Of all suffixes (by words) only those are kept that begin at content-selected positions: minimisers of word k-gram
hashes over windows of such a length that every passage of `min_words` words holds at least one, and equal passages
the same ones. First the k-grams at these positions are counted, and a bit map of bounded size tells which repeat.
Then the kept suffixes, with the words around them, are brought together by their first k words and sorted: once by
what follows and then what precedes, once the other way. In this order each is compared with its nearest neighbours
from other documents on both sides; the match is extended right and left, and if it reaches min_words words both
places are noted. Noted stretches of a document are united; longer passages are covered from one kept position to
the next.

The neighbours show the furthest that a place's surroundings are shared on each side. Where both together could still
be a passage that no compared pair showed, all windows of min_words words around the places of that anchor are brought
together by two 64-bit hashes, and those that several documents hold are noted too.

Sorting spills and comparing streams, so a passage in very many documents needs no memory in proportion; documents'
texts don't move, but for the words around the kept positions that repeat. Anchors with very many places are sorted over
many tasks, each of which also has the rows next to its range.

Words are compared by 32 of their 64 hash bits within a context (a passage by 50 of them and the anchor's 64 bits), and by
two 64-bit hashes of the whole window where windows meet; a text is read whole in one worker, about 60 bytes of memory a
byte of the longest text.

Defined results: null and short texts have no passage; repeats within one document alone are not noted; rows with equal
doc_id (or none) are one document in this; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quillspark.llm.common import stored
from quillspark.llm.textnp import mix, tidy, words

_STEP, _OTHER = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of h[i : i + width] for each i that has so many."""
    low, have = h, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def _rolled(h: np.ndarray, width: int, step: np.uint64) -> np.ndarray:
    """The polynomial in step of h[i : i + width] for each i that has so many, by doubling."""
    out, have = h, 1
    for bit in f"{width:b}"[1:]:
        out = out[:-have] * np.uint64(pow(int(step), have, 1 << 64)) + out[have:]
        have *= 2
        if bit == "1":
            out = out[:-1] * step + h[have:]
            have += 1
    return out


def kept_positions(hashed: np.ndarray, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the minimisers of one text's word hashes, and the hashes of the k words there."""
    n = len(hashed) - k + 1
    width = min_words - k + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolled = mix(_rolled(hashed, k, _STEP))
    low = _window_min(rolled, width)
    # position i is kept if it is least in a window: the greatest of the window minima over the windows that hold it
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    top = ~_window_min(~padded, width)
    at = np.flatnonzero(top == rolled)
    return at, rolled[at]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
    i = 0
    with np.errstate(over="ignore"):
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < 1 << 18):
                size += len(texts[j])
                j += 1
            hashed, first, _, _ = words(texts[i:j], lower=False)
            for r in range(i, j):
                yield r, hashed[first[r - i] : first[r - i + 1]]
            i = j


def _anchor_rows(k: int, min_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(kept_positions(h, k, min_words)[1], return_counts=True) for _, h in _texts(batch)]
            found = [x for x in found if len(x[0])]
            if found:
                anchor, at, n = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True, return_counts=True)
                places = np.bincount(at, np.concatenate([x for _, x in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n, pa.int64()), pa.array(places)], names=["anchor", "n", "places"])

    return tidy(rows)


def _context_rows(k: int, min_words: int, bits, log2: int, hot, wanted: bool):
    """Places with the words around them: those of hot anchors (sorted) if wanted, else all others."""
    left_words, right_words = min_words - k, min_words + 14

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.frombuffer(bits.value, np.uint8)
            anchors, row, places, left, right = [], [], [], [], []
            for r, h in _texts(batch):
                at, anchor = kept_positions(h, k, min_words)
                if not len(at):
                    continue
                key = (anchor & np.uint64((1 << log2) - 1)).astype(np.int64)
                hit = table[key >> 3] >> (key & 7).astype(np.uint8) & 1 == 1
                if len(hot.value):
                    near = np.minimum(np.searchsorted(hot.value, anchor), len(hot.value) - 1)
                    hit &= (hot.value[near] == anchor) == wanted
                if not hit.any():
                    continue
                forth = (h >> np.uint64(32)).astype(">u4")
                back = forth[::-1].tobytes()
                forth = forth.tobytes()
                for p, a in zip(at[hit].tolist(), anchor[hit].tolist(), strict=True):
                    anchors.append(a)
                    row.append(r)
                    places.append(p)
                    right.append(forth[4 * p : 4 * (p + right_words)])
                    left.append(back[4 * (len(h) - p) : 4 * (len(h) - p + left_words)])
            for i in range(0, len(anchors), 5000):
                some = slice(i, i + 5000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(anchors[some], np.uint64).view(np.int64)), batch.column("doc_id").take(pa.array(row[some], pa.int32())), pa.array(places[some], pa.int64()), pa.array(left[some], pa.binary()), pa.array(right[some], pa.binary())],
                    names=["anchor", "doc_id", "place", "left", "right"],
                )

    return tidy(rows)


def common_words(a: bytes, b: bytes) -> int:
    """How many leading words of four bytes are equal."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    low, high = 0, n
    while high - low > 1:  # a[:low] is equal, a[:high] isn't
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low // 4


def _match_rows(min_words: int):
    """Sorted rows in, noted stretches out, and per place (anchor not null) the most words shared left (sorted by left)
    and right (sorted by right) with any other document, and those noted. Rows of one document that follow each other
    are a run: all of them are compared with the last row before the run and the first after it."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple] = []
        before: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            reach: dict[tuple, tuple] = {}

            def note(x: tuple, y: tuple, out=out, reach=reach) -> None:
                left, right = common_words(x[3], y[3]), common_words(x[4], y[4])
                seen = (left if x[5] else 0, 0 if x[5] else right, *((left, right) if left + right >= min_words else (0, 0)))
                for z in (x, y):
                    at = (z[1], z[2], z[0])
                    reach[at] = tuple(map(max, reach[at], seen)) if at in reach else seen
                if left + right >= min_words:
                    first = (x[1] is None, x[1], x[2]) < (y[1] is None, y[1], y[2]) if x[1] is not None and y[1] is not None else x[1] is not None
                    out.append((x[1], x[2] - left, x[2] + right, first))
                    out.append((y[1], y[2] - left, y[2] + right, not first))

            for r in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
                if run and (r[0], r[5], r[6]) != (run[0][0], run[0][5], run[0][6]):
                    run, before = [], None
                if run and r[1] != run[0][1]:
                    before, run_before = run[-1], run
                    for x in run_before[:-1]:
                        note(x, r)
                    run = []
                if before is not None:
                    note(before, r)
                run.append(r)
            kind = batch.schema.field("doc_id").type
            rows = [(d, a, b, f, None, 0, 0, 0, 0) for d, a, b, f in dict.fromkeys(out)] + [(d, p, None, None, a, *seen) for (d, p, a), seen in reach.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [kind, pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "start", "end", "first", "anchor", "left", "right", "noted_left", "noted_right"])

    return tidy(rows_of)


def _window_rows(k: int, min_words: int, bits, log2: int):
    """All windows of min_words words that hold one of the anchors: two hashes, document and start."""

    def packed(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        a, b, row, start = (np.concatenate(x) for x in zip(*found, strict=True))
        columns = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column("doc_id").take(pa.array(row)), pa.array(start, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "doc_id", "start"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, found, size = np.frombuffer(bits.value, np.uint8), [], 0
            for r, h in _texts(batch):
                at, anchor = kept_positions(h, k, min_words)
                key = (anchor & np.uint64((1 << log2) - 1)).astype(np.int64)
                at = at[table[key >> 3] >> (key & 7).astype(np.uint8) & 1 == 1]
                if not len(at):
                    continue
                n = len(h) - min_words + 1
                holds = np.zeros(n + 1, np.int64)  # how many anchors' windows begin less end
                np.add.at(holds, np.maximum(at - (min_words - k), 0), 1)
                np.add.at(holds, np.minimum(at + 1, n), -1)
                start = np.flatnonzero(np.cumsum(holds[:-1]))
                found.append((_rolled(h, min_words, _STEP)[start], _rolled(mix(h), min_words, _OTHER)[start], np.full(len(start), r, np.int32), start))
                size += len(start)
                if size >= 20_000:
                    yield packed(batch, found)
                    found, size = [], 0
            if found:
                yield packed(batch, found)

    return tidy(rows)


def _equal_rows(min_words: int):
    """Rows sorted by a, b, document (nulls last) and start in; those windows out that several documents hold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead, several, waiting = None, None, False, []
        for batch in batches:
            out: list[tuple] = []
            for a, b, doc, start in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if (a, b) != key:
                    key, lead, several, waiting = (a, b), doc, False, []
                if doc == lead:
                    waiting.append((doc, start, start + min_words, True))
                else:
                    if not several:
                        out += waiting
                        several, waiting = True, []
                    out.append((doc, start, start + min_words, False))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "start", "end", "first"])

    return tidy(rows)


def _bit_map(anchors: DataFrame) -> tuple[bytes, int]:
    """A bit for each anchor: 16 bits an anchor, 2**26 (8 MB) at most."""
    log2 = min(26, max(12, int(16 * anchors.count()).bit_length()))
    at = anchors.select(F.col("anchor").bitwiseAND(F.lit((1 << log2) - 1)).alias("at"))
    word = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (log2 - 5), np.uint32)
    bits[word.column("word").to_numpy()] = word.column("bits").to_numpy().astype(np.uint32)
    return bits.astype("<u4").tobytes(), log2


#: Places from which on an anchor is hot (more, in a table where more than MOST_HOT anchors had so many).
HOT, MOST_HOT = 20_000, 200_000


def _hot_anchors(kept: DataFrame, least: int) -> np.ndarray:
    """The anchors with more than `least` places and more than their MOST_HOTth part of all places: MOST_HOT at most."""
    total = kept.agg(F.sum("places")).first()[0] or 0
    found = kept.filter(F.col("places") > max(least, total // MOST_HOT)).select("anchor").toArrow()
    return np.sort(found.column("anchor").to_numpy().view(np.uint64))


def _order(ways: DataFrame) -> list[Column]:
    """What sorts the rows of an anchor and way: one side's words, the other's, the place."""
    key = lambda way, other: F.when(F.col("way") == 0, F.col(way)).otherwise(F.col(other))
    return [F.col("anchor"), F.col("way"), key("right", "left"), key("left", "right"), F.col("doc_id"), F.col("place")]


def _edge_rows(ends: list[Row]) -> list[tuple]:
    """Of ranges in order, with their first and last rows and the outermost rows of other documents than these: for each
    range the last row before it of another document than its first, and the first after it of another than its last."""
    out = []
    for i, e in enumerate(ends):
        for side, here, near, far in ((reversed(ends[:i]), e.head, "tail", "inner_tail"), (ends[i + 1 :], e.tail, "head", "inner_head")):
            for other in side:
                row = other[near] if other[near].doc_id != here.doc_id else other[far]
                if row is not None:
                    out.append((row.anchor, row.doc_id, row.place, row.left, row.right, row.way, e.part))
                    break
    return out


def _in_ranges(ways: DataFrame) -> DataFrame:
    """Rows of hot anchors, stored, dealt out by ranges of their order, so that one anchor takes many tasks; each range
    (part) also has the rows next to it, of other documents than its outermost ones. To the driver come four rows a range."""
    spark, columns = ways.sparkSession, ways.columns
    parted = stored(ways.repartitionByRange(*_order(ways)).withColumn("part", F.spark_partition_id()))
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_order(parted))], F.struct(*columns).alias("row"))
    ends = parted.groupBy("part").agg(F.min(at)["row"].alias("head"), F.max(at)["row"].alias("tail"))
    beside = parted.join(F.broadcast(ends.select(F.col("part").alias("of"), F.col("head.doc_id").alias("head_doc"), F.col("tail.doc_id").alias("tail_doc"))), F.col("part") == F.col("of"))
    inner = [F.min(F.when(~F.col("doc_id").eqNullSafe(F.col("head_doc")), at))["row"].alias("inner_head"), F.max(F.when(~F.col("doc_id").eqNullSafe(F.col("tail_doc")), at))["row"].alias("inner_tail")]
    ends = ends.join(beside.groupBy("part").agg(*inner), "part").orderBy("part").collect()
    edges = spark.createDataFrame(_edge_rows(ends), parted.schema)
    return parted.unionByName(edges).repartition("part").sortWithinPartitions("part", *_order(parted))


def repeated_passages(docs: DataFrame, min_words: int = 50, k: int = 20, id_col: str = "doc_id", text_col: str = "text", hot_places: int = HOT) -> DataFrame:
    """Per document and maximal stretch that other documents hold too: doc_id, start_word, n_words, first (whether no
    other place before it was found to hold any of it). hot_places decides speed alone."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    counted = source.select("text").mapInArrow(_anchor_rows(k, min_words), "anchor long, n long, places long").groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))
    kept = stored(counted.filter("n > 1").select("anchor", "places"))
    bits, log2 = _bit_map(kept)
    spark = docs.sparkSession
    sent, hot = spark.sparkContext.broadcast(bits), spark.sparkContext.broadcast(_hot_anchors(kept, hot_places))
    context = f"anchor long, doc_id {kind}, place long, left binary, right binary"
    both = lambda d: d.withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
    ways = both(source.mapInArrow(_context_rows(k, min_words, sent, log2, hot, False), context)).withColumn("part", F.lit(0))
    sorted_rows = [ways.repartition("anchor", "way").sortWithinPartitions(*_order(ways))]
    if len(hot.value):
        sorted_rows.append(_in_ranges(both(stored(source.mapInArrow(_context_rows(k, min_words, sent, log2, hot, True), context)))))
    stretch = f"doc_id {kind}, start long, end long, first boolean"
    seen = f"{stretch}, anchor long, left long, right long, noted_left long, noted_right long"
    matched = reduce(DataFrame.union, [d.mapInArrow(_match_rows(min_words), seen) for d in sorted_rows])
    most = [F.max(c).alias(c) for c in ("left", "right", "noted_left", "noted_right")]
    matched = stored(matched.groupBy("doc_id", "start", "end", "anchor").agg(F.min("first").alias("first"), *most))
    noted = matched.filter("anchor is null").select("doc_id", "start", "end", "first")
    doubtful = F.col("anchor").isNotNull() & (F.col("left") + F.col("right") >= min_words) & ((F.col("noted_left") < F.col("left")) | (F.col("noted_right") < F.col("right")))
    open_anchors = stored(matched.filter(doubtful).select("anchor").distinct())
    if not open_anchors.isEmpty():
        again = spark.sparkContext.broadcast((held := _bit_map(open_anchors))[0])
        windows = source.mapInArrow(_window_rows(k, min_words, again, held[1]), f"a long, b long, doc_id {kind}, start long")
        windows = windows.repartition("a", "b").sortWithinPartitions("a", "b", F.asc_nulls_last("doc_id"), "start")
        noted = noted.unionByName(windows.mapInArrow(_equal_rows(min_words), stretch)).groupBy("doc_id", "start", "end").agg(F.min("first").alias("first"))
    along = Window.partitionBy("doc_id").orderBy("start", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start") > reached, F.lit(True)).cast("int")
    united = noted.withColumn("apart", apart).withColumn("stretch", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    out = united.groupBy("doc_id", "stretch").agg(F.min("start").alias("start_word"), F.max("end").alias("end"), F.min("first").alias("first"))
    return out.select("doc_id", "start_word", (F.col("end") - F.col("start_word")).alias("n_words"), "first")
