"""License scans by diagonal voting.

Every run of k words of every text (k = 3) is hashed and joined with the hashes of the templates' runs; a hit whose
words are equal too is a vote for the diagonal text position minus template position. Votes are counted per document,
template and diagonal. A template that must stand exactly is found where all its runs vote for one diagonal. For the
others neighbouring diagonals (words put in or left out) are merged, and the span is verified: the share of the
template's runs seen in it must reach the template's `least`, and it must not be stretched beyond `stretch` template lengths.

Only DataFrame expressions run. The table of templates is a parameter of fixed size (one row for each run of its few
phrases) and is broadcast; the text's runs are generated, looked up and checked in one stage, and only hits are
shuffled, by the row's number. One document is the most that meets in one task.

Defined results: null text counts as empty; documents without a hit have n_base 0, null places, empty labels and
score 0; rows that repeat are scanned each for itself; labels that tie are sorted by name; texts of any length are
scanned whole, one text in one task; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What stands between words, once A-Z are lower case.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    words: str
    exact: bool = False
    least: float = 0.8


#: Phrases whose every place counts (fixed values).
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
#: Opening sentences of public licenses, found with small changes too (fixed values).
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("gpl-3", "licensed under the gnu general public license version 3", least=1.0),
    Template("gpl-2", "licensed under the gnu general public license version 2", least=1.0),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", least=0.95),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", least=0.95),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", least=1.0),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", least=1.0),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", least=1.0),
)


def word_list(text: Column) -> Column:
    """Words in lower case (A-Z only: of the code points that lower() maps into ASCII or splits, the two that could
    turn into ASCII letters are put aside first)."""
    shy = F.translate(F.coalesce(text, F.lit("")), "Kİ", "Åì")
    return F.array_remove(F.split(F.lower(shy), BREAK), "")


def template_runs(spark: SparkSession, templates: tuple[Template, ...], k: int) -> DataFrame:
    """hash, hits: array of {template, at, run}."""
    rows = []
    for i, t in enumerate(templates):
        words = t.words.split()
        if len(words) < k or set(t.words) - set(string.ascii_lowercase + string.digits + " "):
            raise ValueError(f"a template has {k} or more words of a-z and 0-9: {t.words}")
        for at in range(len(words) - k + 1):
            run = F.array(*[F.lit(w) for w in words[at : at + k]])
            rows.append(F.struct(F.lit(i).alias("template"), F.lit(at).alias("at"), run.alias("run")))
    one = spark.range(1).select(F.explode(F.array(*rows)).alias("hit"))
    hashed = F.xxhash64(*[F.col("hit.run")[j] for j in range(k)])
    return one.groupBy(hashed.alias("hash")).agg(F.collect_list("hit").alias("hits"))


def scan(
    docs: DataFrame,
    templates: tuple[Template, ...] = BASE + NOTICES,
    k: int = 3,
    gap: int = 3,
    stretch: float = 1.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label,
    start and end in words, share)."""
    runs_of = [len(t.words.split()) - k + 1 for t in templates]
    lit = lambda values, kind: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    of = lambda values, kind: F.element_at(lit(values, kind), F.col("template") + 1)

    texts = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), word_list(F.col(text_col)).alias("words"))
    places = F.sequence(F.lit(0), F.size("words") - k)
    run = F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(*[F.get("words", i + j) for j in range(k)]).alias("hash")))
    none = F.array(F.struct(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("hash")))  # keeps documents without hits
    every = F.when(F.size("words") >= k, F.concat(none, run)).otherwise(none)
    looked_up = texts.withColumn("run", F.explode(every)).select("*", "run.place", "run.hash").drop("run")
    looked_up = looked_up.join(F.broadcast(template_runs(docs.sparkSession, templates, k)), "hash", "left")
    looked_up = looked_up.filter((F.col("place") < 0) | F.col("hits").isNotNull())
    hits = looked_up.withColumn("hit", F.explode_outer(F.when(F.col("place") >= 0, F.col("hits"))))
    hits = hits.filter((F.col("place") < 0) | (F.slice("words", F.col("place") + 1, k) == F.col("hit.run")))
    hits = hits.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "hit.template", "hit.at", (F.col("place") - F.col("hit.at")).alias("diagonal"))
    # from here on everything of a row stands in one partition
    votes = hits.repartition("row").groupBy("row", "template", "diagonal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_set("at").alias("seen")
    )
    exact = F.coalesce(of([t.exact for t in templates], "boolean"), F.lit(False))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = exact | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > gap, F.lit(True))
    clusters = votes.withColumn("cluster", F.sum(apart.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("diagonal") + F.array_min("seen")
    end = F.col("diagonal") + F.array_max("seen") + k
    spans = clusters.groupBy("row", "template", "cluster").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.min("diagonal").alias("diagonal"),
        F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min(start).alias("start"), F.max(end).alias("end"),
    )
    share = F.coalesce(F.size("seen") / of(runs_of, "int"), F.lit(0.0))
    fits = (F.col("end") - F.col("start")) <= stretch * (of(runs_of, "int") + k - 1)
    spans = spans.withColumns({"share": F.when(F.col("template").isNotNull(), share).otherwise(0.0), "exact": exact, "label": of([t.label for t in templates], "string")})
    spans = spans.withColumn("base", F.col("exact") & (F.col("share") == 1.0))
    spans = spans.withColumn("found", F.coalesce(F.col("base") | (~F.col("exact") & (F.col("share") >= of([t.least for t in templates], "double")) & fits), F.lit(False)))
    place = F.when(F.col("base"), F.col("diagonal").cast("long"))
    joined = lambda when: F.array_join(F.sort_array(F.collect_set(F.when(when, F.col("label")))), ",")
    span = F.struct("start", "end", "label", "share")
    out = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count(place).alias("n_base"),
        F.min(place).alias("first_word"), F.max(place).alias("last_word"), joined(F.col("base")).alias("base_labels"),
        joined(F.col("found")).alias("labels"), F.coalesce(F.max(F.when(F.col("found") | ~F.col("exact"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("found"), span))).alias("spans"),
    )
    return out.drop("row")
