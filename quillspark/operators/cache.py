"""A response cache looked up by SimHash."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import hamming_similarity, simhash


def entries(rows: DataFrame, ttl_seconds: int = 86400) -> DataFrame:
    """rows (id, prompt, model, response, created_at in seconds): cache entries."""
    return rows.select("id", simhash(F.col("prompt")).alias("simhash"), "model", F.md5("prompt").alias("prompt_hash"), "response", "created_at", F.lit(ttl_seconds).alias("ttl_seconds"))


class _Latest:
    """The newest entries of a model as they stream by, and the newest of them that answers a request."""

    def __init__(self, newest: int):
        self.marks = np.zeros(newest, np.uint64)
        self.rows: list[tuple | None] = [None] * newest
        self.count = 0

    def add(self, mark: int, row: tuple) -> None:
        at = self.count % len(self.rows)
        self.marks[at], self.rows[at] = mark & (1 << 64) - 1, row
        self.count += 1

    def answer(self, mark: int, now: float, threshold: float) -> tuple[tuple, float] | None:
        """The entry and its similarity. An entry's row begins with created_at and ttl_seconds."""
        n = len(self.rows)
        held = min(self.count, n)
        alike = 1 - np.bitwise_count(self.marks[:held] ^ np.uint64(mark & (1 << 64) - 1)) / 64.0
        for k in range(1, held + 1):
            at = (self.count - k) % n
            row = self.rows[at]
            if alike[at] >= threshold and now - row[0] <= row[1]:
                return row, float(alike[at])
        return None


_HIT = "request_id {kind}, id {id}, model string, created_at double, prompt_hash string, similarity double"


#: Events of a model in one stretch of time, on average. A task reads whole stretches.
STRETCH = 100_000


def _carried(events: DataFrame, newest: int) -> DataFrame:
    """events with a part of their model's time: for each part the `newest` last entries before it, as rows of it. At
    most newest + 1 rows a part stream by in order of time."""
    last = Window.partitionBy("model", "part").orderBy(F.desc("at"), F.desc("id"))
    ends = events.filter("asks = 0").withColumn("back", F.row_number().over(last)).filter(F.col("back") <= newest).drop("back")
    marked = ends.withColumn("begins", F.lit(0)).unionByName(events.select("model", "part").distinct().withColumn("begins", F.lit(1)), allowMissingColumns=True)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = (), deque(maxlen=newest)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["model"],) != model:
                    model, held = (row["model"],), deque(maxlen=newest)
                if row["begins"]:
                    out += [{**x, "part": row["part"]} for x in held]
                else:
                    held.append(row)
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    dealt = marked.repartition("model").sortWithinPartitions("model", "part", F.desc("begins"), "at", "id")
    return dealt.mapInArrow(carry, dealt.schema).drop("begins")


def lookup(cache: DataFrame, requests: DataFrame, threshold: float = 0.95, newest: int = 200, stretch: int = STRETCH) -> DataFrame:
    """requests (request_id, prompt, model, now): request_id, hit_id, response, similarity. Among a model's `newest`
    latest entries before the request, the latest that hasn't expired and is similar enough.

    Entries and requests of a model stream by in order of time, and the last `newest` entries are held, so no request is
    paired with older ones. A model with more events than `stretch` is dealt out by equal parts of its time, each of which
    also has the last entries before it. Prompts and responses don't travel; responses are fetched for the hits. Requests
    without model or time find nothing, and entries without them answer none."""
    asked = requests.select("request_id", "model", F.col("now").cast("double").alias("at"), simhash(F.col("prompt")).alias("mark"))
    known = ["id", "model", "created_at", "prompt_hash"]
    events = cache.select("model", F.col("created_at").cast("double").alias("at"), F.lit(0).alias("asks"), F.col("simhash").alias("mark"), "id", "prompt_hash", F.col("ttl_seconds").cast("double").alias("ttl"))
    events = events.unionByName(asked.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    kinds = {c: (cache if c == "id" else requests).schema[c].dataType.simpleString() for c in ("id", "request_id")}

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = (), _Latest(newest)
        for batch in batches:
            out = []
            for m, part, at, asks, mark, id_, hash_, ttl, request in zip(*(batch.column(c).to_pylist() for c in ("model", "part", "at", "asks", "mark", "id", "prompt_hash", "ttl", "request_id")), strict=True):
                if (m, part) != model:
                    model, held = (m, part), _Latest(newest)
                if not asks:
                    held.add(mark, (at, ttl, id_, hash_))
                elif (found := held.answer(mark, at, threshold)):
                    out.append((request, found[0][2], m, found[0][0], found[0][3], found[1]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [batch.schema.field("request_id").type, batch.schema.field("id").type, pa.string(), pa.float64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["request_id", *known, "similarity"])

    events = events.filter("at is not null and model is not null")
    span = events.groupBy("model").agg(F.floor(F.count("*") / stretch).alias("parts"), F.min("at").alias("begin"), F.max("at").alias("end"))
    part = F.floor((F.col("at") - F.col("begin")) / (F.col("end") - F.col("begin")) * F.col("parts"))
    events = events.join(span, "model").withColumn("part", F.when((F.col("parts") > 0) & (F.col("end") > F.col("begin")), part).otherwise(0))
    columns = ["model", "part", "at", "asks", "mark", "id", "prompt_hash", "ttl", "request_id"]
    dealt = events.select(columns).unionByName(_carried(events.filter("parts > 0").select(columns), newest))
    dealt = dealt.repartition("model", "part").sortWithinPartitions("model", "part", "at", "asks", "id")
    best = dealt.mapInArrow(answers, _HIT.format(kind=kinds["request_id"], id=kinds["id"]))
    fetched = best.alias("b").join(cache.select(*known, "response").alias("c"), [F.col(f"b.{c}").eqNullSafe(F.col(f"c.{c}")) for c in known])
    hits = fetched.groupBy("request_id").agg(F.min("b.id").alias("hit_id"), F.min("response").alias("response"), F.min("similarity").alias("similarity"))
    return asked.select("request_id").join(hits, "request_id", "left")


def replay(requests: DataFrame, ttl_seconds: float = 3600, threshold: float = 0.95, newest: int = 200) -> DataFrame:
    """Reading through the cache: requests (request_id, prompt, model, now, response) in order of time, where response is
    what the model would say. Each is answered from what earlier ones left there (hit_id), or by its own response, which
    is then kept: request_id, hit_id, response. A model's requests stream through one task, as each depends on those
    before it; the last `newest` are held."""
    marked = requests.select("request_id", "model", F.col("now").cast("double").alias("now"), simhash(F.col("prompt")).alias("mark"), "response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = (), _Latest(newest)
        for batch in batches:
            hits, responses = [], []
            for request, m, now, mark, response in zip(*(batch.column(c).to_pylist() for c in ("request_id", "model", "now", "mark", "response")), strict=True):
                if (m,) != model:
                    model, held = (m,), _Latest(newest)
                found = held.answer(mark, now, threshold)
                if found is None:
                    held.add(mark, (now, ttl_seconds, request, response))
                hits.append(found and found[0][2])
                responses.append(found[0][3] if found else response)
            yield pa.RecordBatch.from_arrays([batch.column("request_id"), pa.array(hits, batch.schema.field("request_id").type), pa.array(responses, pa.string())], names=["request_id", "hit_id", "response"])

    kind = requests.schema["request_id"].dataType.simpleString()
    dealt = marked.filter("now is not null").repartition("model").sortWithinPartitions("model", "now", "request_id")
    return dealt.mapInArrow(run, f"request_id {kind}, hit_id {kind}, response string")


def append(cache: DataFrame, new: DataFrame) -> DataFrame:
    return cache.unionByName(new)


def live(cache: DataFrame, now: float) -> DataFrame:
    """The entries that haven't expired."""
    return cache.filter(F.lit(now) - F.col("created_at") <= F.col("ttl_seconds"))


def purge(cache: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """The entries that haven't expired, and one row with the number of those that have (removed)."""
    expired = F.lit(now) - F.col("created_at") > F.col("ttl_seconds")
    return live(cache, now), cache.agg(F.count(F.when(expired, 1)).alias("removed"))


def stats(found: DataFrame) -> DataFrame:
    hits, n = F.count("hit_id"), F.count("*")
    return found.agg(hits.alias("hits"), (n - hits).alias("misses"), F.when(n > 0, F.round(hits / n, 4)).otherwise(0.0).alias("hit_rate"))
