"""Near duplicates by a grouped prefix join on n-gram sets, exact for a Jaccard threshold.

A document's set is that of the 64-bit hashes of its word shingles. In one global order of shingles, two sets of n and m
members with similarity t or more share a member among their first n - ceil(t n) + 1 and m - ceil(t m) + 1: their
prefixes. The order used here is by hash, with frequent shingles last, by powers of two of their frequency; any fixed
order is right, so the list of frequent ones, broadcast to the workers, is held to a number of entries by choosing its
threshold, and where it ends decides speed alone. Frequencies are counted over the prefixes (half as long again) of all documents.

1. Equal sets are one member, and sets with equal prefix and size are one group; only groups have index rows.
2. Index rows meet by shingle. Of each list the group in which the shingle stands first is the leader, and a first
   round pairs each other group with the leader that it meets most often. Pairs that verify give provisional components.
3. A second round pairs the groups of a list that are in different components. Pairs inside a component need no look:
   they can't change the result. Length and position filters leave out pairs that can't reach the threshold: a pair's
   first common shingle must leave room for the overlap it needs. Group pairs are expanded to their members.
4. Pairs are verified on whole sets by exact intersection (sets are computed again for documents that are in a pair;
   a bit map of bounded size tells which). Links of both rounds give the components.

So a group of m near copies costs about m pairs and not m * m / 2, and no link between components is lost.

Defined results: documents without words or text have n_shingles 0 and are linked with nothing; rows that repeat are
linked; component_id is the smallest doc_id that isn't null; an empty table gives an empty result; other columns take
no part. A text is read whole in one worker: about 60 bytes of memory a byte of the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import stored
from quillspark.llm.components import components
from quillspark.llm.textnp import shingle_sets, tidy

#: A shingle counts as frequent from this many documents on (more if the list would grow too long).
FREQUENT = 4


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers and sets, computed for some hundred kilobytes of text at a time."""
    texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
    i = 0
    with np.errstate(over="ignore"):
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < 1 << 18):
                size += len(texts[j])
                j += 1
            yield from zip(range(i, j), shingle_sets(texts[i:j], width), strict=True)
            i = j


def _digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class Frequent(NamedTuple):
    """Sorted hashes of frequent shingles, and the power of two of each one's frequency."""

    tokens: np.ndarray
    powers: np.ndarray

    def power(self, some: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(some), np.int8)
        at = np.minimum(np.searchsorted(self.tokens, some), len(self.tokens) - 1)
        return np.where(self.tokens[at] == some, self.powers[at], 0)


def prefix(members: np.ndarray, frequent: Frequent, percent: int) -> np.ndarray:
    """The first members in the global order: by power of two of the frequency (0 if not listed), then by hash."""
    p = prefix_length(len(members), percent)
    some = members[: min(2 * p, len(members))]
    rare = some[frequent.power(some) == 0]
    if len(rare) >= p:
        return rare[:p]
    return members[np.argsort(frequent.power(members), kind="stable")][:p]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _frequency_rows(width: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, some = set(), []
            for _, members in _sets(batch, width):
                if len(members) and (key := _digest(members)) not in seen:
                    seen.add(key)
                    some.append(members[: prefix_length(len(members), percent) * 3 // 2])
            if some:
                token, n = np.unique(np.concatenate(some), return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(token), pa.array(n, pa.int64())], names=["token", "n"])

    return tidy(rows)


def frequent_shingles(texts: DataFrame, width: int, percent: int, least: int = FREQUENT, most: int = 2_000_000) -> Frequent:
    """At most `most` shingles (18 MB) in at least `least` prefixes."""
    counted = texts.mapInArrow(_frequency_rows(width, percent), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = stored(counted.filter(F.col("n") >= least).withColumn("power", F.floor(F.log2("n")).cast("tinyint")))
    # a histogram by powers of two: at most 64 rows
    powers = sorted((r[0], r[1]) for r in counted.groupBy("power").count().collect())
    while powers and sum(n for _, n in powers) > most:
        powers.pop(0)
    found = counted.filter(F.col("power") >= (powers[0][0] if powers else 64)).select("token", "power").toArrow()
    tokens = found.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return Frequent(tokens[order], found.column("power").to_numpy()[order])


def _group_key(n: int, first: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(first.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)


#: Bits of the parity sketch of a set.
SKETCH_BITS = 1024


def parity_sketch(members: np.ndarray) -> np.ndarray:
    """Whether an odd number of members falls into each of SKETCH_BITS buckets. Two sketches differ in no more bits
    than the sets have members that only one of them holds."""
    odd = np.bincount((members & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _document_rows(width: int, percent: int, frequent):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, group, sketch = [], [], [], []
            for _, members in _sets(batch, width):
                n.append(len(members))
                digest.append(_digest(members) if len(members) else None)
                group.append(_group_key(len(members), prefix(members, frequent.value, percent)) if len(members) else None)
                sketch.append(parity_sketch(members))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(group, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc_id", "n", "digest", "gkey", "sketch"],
            )

    return tidy(rows)


def _index_rows(width: int, percent: int, frequent):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, tokens, keys, sizes = set(), [], [], []
            for _, members in _sets(batch, width):
                if not len(members):
                    continue
                first = prefix(members, frequent.value, percent)
                key = _group_key(len(members), first)
                if key not in seen:
                    seen.add(key)
                    tokens.append(first)
                    keys.append(key)
                    sizes.append(len(members))
            if tokens:
                each = np.array([len(x) for x in tokens])
                place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(tokens)), pa.array(np.repeat(np.array(keys, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each)), pa.array(place.astype(np.int32))],
                    names=["token", "gkey", "n", "place"],
                )

    return tidy(rows)


def _set_rows(width: int, bits, log2: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, np.ndarray] = {}
            size = 0
            for _, members in _sets(batch, width):
                if len(members):
                    key = _digest(members)
                    at = int.from_bytes(key[:4], "big") & ((1 << log2) - 1)
                    if bits.value[at >> 3] >> (at & 7) & 1 and key not in found:
                        found[key] = members
                        size += len(members)
                if size > 1 << 20:
                    yield _packed(found)
                    found, size = {}, 0
            if found:
                yield _packed(found)

    return tidy(rows)


def _packed(found: dict[bytes, np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, found.values())]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate(list(found.values()))))
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), lists], names=["digest", "members"])


def _bit_map(keys: DataFrame) -> tuple[bytes, int]:
    """One bit for each digest of keys: 16 bits a key, 2**26 (8 MB) at most. Made on the executors, word by word."""
    log2 = min(26, max(12, int(16 * keys.count()).bit_length()))
    low = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")  # the first four bytes, big-endian
    at = keys.select(low.bitwiseAND(F.lit((1 << log2) - 1)).alias("at"))
    word = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits"))
    found = word.toArrow()
    bits = np.zeros(1 << (log2 - 5), np.uint32)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return bits.astype("<u4").tobytes(), log2


def verified(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs (a, b) of digests, stored: those whose sets reach the threshold; stored."""
    spark = texts.sparkSession
    keys = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
    bits, log2 = _bit_map(keys)
    sent = spark.sparkContext.broadcast(bits)
    sets = texts.mapInArrow(_set_rows(width, sent, log2), "digest binary, members array<long>")
    sets = stored(sets.dropDuplicates(["digest"]))
    left = sets.select(F.col("digest").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("digest").alias("b"), F.col("members").alias("y"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return stored(met.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"))


def _can_reach(n: str, i: str, m: str, j: str, percent: int):
    """Whether sets of n and m can reach the threshold if their first common member stands at i and j."""
    n, i, m, j = (F.col(x) for x in (n, i, m, j))
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & ((100 + percent) * F.least(n - i, m - j) >= percent * (n + m))


def _few_apart(n: str, s: str, m: str, t: str, percent: int):
    """Whether the sketches leave it possible that sets of n and m reach the threshold: they may have at most
    (n + m) (1 - t) / (1 + t) members apart."""
    apart = sum((F.bit_count(F.get(s, F.lit(i)).bitwiseXOR(F.get(t, F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col(n) + F.col(m))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, digest (of its set; null without words)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = source.select("text")
    kind = source.schema["doc_id"].dataType.simpleString()
    frequent = spark.sparkContext.broadcast(frequent_shingles(texts, width, percent))
    known = stored(source.mapInArrow(_document_rows(width, percent, frequent), f"doc_id {kind}, n long, digest binary, gkey long, sketch array<long>"))
    sets = stored(known.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("gkey").alias("gkey"), F.min("n").alias("n"), F.first("sketch").alias("sketch")))
    rows = texts.mapInArrow(_index_rows(width, percent, frequent), "token long, gkey long, n int, place int")
    # groups in several tasks have the same rows in each; the sort of the window puts them side by side
    order = Window.partitionBy("token").orderBy("place", "n", "gkey")
    lead = lambda c: F.first(c).over(order.rowsBetween(Window.unboundedPreceding, 0))
    lists = rows.withColumns({"before": F.lag("gkey").over(order), "after": F.lead("gkey").over(order), "lead": lead("gkey"), "lead_n": lead("n"), "lead_place": lead("place")})
    again = F.coalesce(F.col("before") == F.col("gkey"), F.lit(False))
    alone = (F.col("lead") == F.col("gkey")) & F.coalesce(F.col("after") == F.col("gkey"), F.col("after").isNull())
    # a leader whose copies alone follow may stay: later steps find nothing to pair it with
    lists = stored(lists.filter(~again & ~(alone & F.col("after").isNull())).drop("before", "after"))

    # first round: with the leader
    reps = sets.groupBy("gkey").agg(F.min("digest").alias("rep"))
    starred = lists.filter((F.col("gkey") != F.col("lead")) & _can_reach("n", "place", "lead_n", "lead_place", percent))
    # of its leaders each group takes the one that it meets most often: a pair a group
    starred = starred.groupBy("gkey", "lead").agg(F.count("*").alias("meetings"))
    starred = starred.groupBy("gkey").agg(F.max_by("lead", F.struct("meetings", "lead")).alias("lead"))
    a = starred.join(reps.select("gkey", F.col("rep").alias("a")), "gkey").join(reps.select(F.col("gkey").alias("lead"), F.col("rep").alias("b")), "lead")
    within = sets.join(reps, "gkey").filter("digest <> rep").select(F.col("digest").alias("a"), F.col("rep").alias("b"))
    pair = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first_pairs = stored(pair(a.select("a", "b").union(within)))
    links = verified(texts, first_pairs, width, percent)

    # second round: between components
    found = components(links).select(F.col("node").alias("digest"), "root")
    placed = stored(sets.join(found, "digest", "left").select("digest", "gkey", F.coalesce("root", "digest").alias("comp"), F.col("n").alias("size"), "sketch"))
    comps = placed.select("gkey", "comp").distinct()
    by_comp = lists.select("token", "gkey", "n", "place").join(comps, "gkey")
    lead_comp = F.first("comp").over(Window.partitionBy("token").orderBy("place", "n", "gkey", "comp").rowsBetween(Window.unboundedPreceding, 0))
    by_comp = stored(by_comp.withColumn("lead_comp", lead_comp))
    # only lists with several components go on; their groups are expanded to members, with the members' sketches
    mixed = by_comp.filter("comp <> lead_comp").select("token").distinct()
    by_comp = stored(by_comp.join(mixed, "token", "left_semi").join(placed.select("gkey", "comp", "digest", "sketch"), ["gkey", "comp"]))
    minor = by_comp.filter("comp <> lead_comp").select("token", F.col("digest").alias("a"), "n", "place", "comp", "sketch")
    other = by_comp.select("token", F.col("digest").alias("b"), F.col("n").alias("m"), F.col("place").alias("place2"), F.col("comp").alias("comp2"), (F.col("comp") == F.col("lead_comp")).alias("major"), F.col("sketch").alias("sketch2"))
    apart = (F.col("comp") != F.col("comp2")) & (F.col("major") | (F.col("a") < F.col("b")))
    fits = _can_reach("n", "place", "m", "place2", percent) & _few_apart("n", "sketch", "m", "sketch2", percent)
    met = minor.join(other, (minor["token"] == other["token"]) & apart & fits).select("a", "b").distinct()
    two = placed.select(F.col("gkey").alias("gkey2"), F.col("digest").alias("b"), F.col("comp").alias("comp2"), F.col("size").alias("m"), F.col("sketch").alias("sketch2"))
    alike = (F.col("gkey") == F.col("gkey2")) & (F.col("comp") < F.col("comp2")) & _few_apart("size", "sketch", "m", "sketch2", percent)
    inside = placed.join(two, alike).select(F.col("digest").alias("a"), "b")
    expanded = met.union(inside)
    second_pairs = stored(pair(expanded.union(inside)).join(first_pairs, ["a", "b"], "left_anti"))
    if second_pairs.limit(1).count():
        links = stored(links.union(verified(texts, second_pairs, width, percent)))
        found = components(links).select(F.col("node").alias("digest"), "root")
    rooted = sets.join(found, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    rooted = stored(rooted.select("digest", "root", "first_id"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    classes = stored(rooted.join(smallest, "root").select(F.col("digest").alias("key"), "component"))
    out = known.join(classes, F.col("digest") == F.col("key"), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "digest")
