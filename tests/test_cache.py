"""The response cache against brute force, and the requests of its registered queries."""

import random

from pyspark.sql import functions as F

from quillspark import queries
from quillspark.functions.text import simhash
from quillspark.operators import cache


def test_lookup_against_brute_force(spark):
    draw = random.Random(6)
    texts = [" ".join(f"w{draw.randrange(300)}" for _ in range(300)) for _ in range(3)]

    def changed(text, n):
        words = text.split()
        for i in draw.sample(range(len(words)), n):
            words[i] = "other"
        return " ".join(words)

    held = [(i, changed(draw.choice(texts), draw.randrange(3)), f"m{i % 2}", f"r{i}", float(draw.randrange(1000))) for i in range(90)]
    asked = [(i, changed(draw.choice(texts), draw.randrange(4)), f"m{i % 3}", float(draw.randrange(200, 1100))) for i in range(60)]
    entries = cache.entries(spark.createDataFrame(held, "id long, prompt string, model string, response string, created_at double"), 300)
    requests = spark.createDataFrame(asked, "request_id long, prompt string, model string, now double")
    prompts = sorted({r[1] for r in held + asked})
    marks = {r.p: r.h for r in spark.createDataFrame([(p,) for p in prompts], "p string").select("p", simhash(F.col("p")).alias("h")).collect()}
    alike = lambda a, b: 1 - ((marks[a] ^ marks[b]) & (1 << 64) - 1).bit_count() / 64
    for newest, stretch in ((200, cache.STRETCH), (200, 7), (5, 2)):
        expected, near = {}, 0
        for i, prompt, model, now in asked:
            met = sorted((e for e in held if e[2] == model and e[4] <= now), key=lambda e: (-e[4], -e[0]))[:newest]
            hits = [(e[0], e[3], alike(prompt, e[1])) for e in met if now - e[4] <= 300 and alike(prompt, e[1]) >= 0.95]
            expected[i] = hits[0] if hits else (None, None, None)
            near += bool(hits) and hits[0][2] < 1
        found = cache.lookup(entries, requests, newest=newest, stretch=stretch)
        assert {r.request_id: (r.hit_id, r.response, r.similarity) for r in found.collect()} == expected
        n = sum(e[0] is not None for e in expected.values())
        assert 0 < n < 60 and near > 0
        assert tuple(cache.stats(found).first()) == (n, 60 - n, round(n / 60, 4))


def test_every_benchmark_row_asks(spark, tmp_path):
    spark.createDataFrame([(i, f"text of {i} in some words") for i in range(60)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"question {i}") for i in range(70)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.QUERIES["h1_cache_lookup"](spark, str(tmp_path)).collect()
    assert sorted(r.request_id for r in found) == list(range(70))
    assert tuple(queries.QUERIES["m12_cache_stats"](spark, str(tmp_path)).first())[:2] == (60, 10)
