"""BM25 ranking and selection of chunks under a token budget, for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import RANKING_STOPWORDS, terms, text_of, token_count


def bm25_scores(chunks: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, stopwords: list[str] = RANKING_STOPWORDS) -> DataFrame:
    """chunks (set_id, pos, text), queries (query_id, set_id, query): query_id, set_id, pos, score. A set of chunks is
    the collection for its document frequencies. Scores are rounded to 1e-9, so that equal ones tie."""
    tokens = chunks.select("set_id", "pos", terms(F.col("text"), stopwords).alias("terms"))
    stats = tokens.groupBy("set_id").agg(F.count("*").alias("n"), F.greatest(F.avg(F.size("terms")), F.lit(1.0)).alias("avg_len"))
    asked = queries.select("query_id", "set_id", F.explode(F.array_distinct(terms(F.col("query"), stopwords))).alias("term"))
    asked_terms = asked.select("set_id", "term").distinct()
    tf = tokens.select("set_id", "pos", F.size("terms").alias("len"), F.explode("terms").alias("term")).join(asked_terms, ["set_id", "term"], "left_semi")
    tf = tf.groupBy("set_id", "pos", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("set_id", "term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    hits = asked.join(tf, ["set_id", "term"]).join(df, ["set_id", "term"]).join(stats, "set_id")
    scored = hits.groupBy("query_id", "set_id", "pos").agg(F.round(F.sum(part), 9).alias("score"))
    every = queries.select("query_id", "set_id").join(chunks.select("set_id", "pos"), "set_id")
    return every.join(scored, ["query_id", "set_id", "pos"], "left").fillna(0.0, ["score"])


def select_context(chunks: DataFrame, queries: DataFrame, max_tokens: int = 2000, min_score: float = 0.0, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Chunks in order of score that still fit the budget, given in their own order: query_id, set_id, pos, text, score.
    A blank query selects everything, whatever the budget.

    A query's chunks stream by in order of score with their token counts alone; what was taken is one number. Chunks
    that can't fit or score too little go before they are sorted, and texts are looked up for the chosen ones."""
    blank = queries.select("query_id", "set_id", (F.size(terms(F.col("query"))) == 0).alias("blank"))
    sized = chunks.select("set_id", "pos", token_count(F.col("text")).alias("tokens"))
    scored = bm25_scores(chunks, queries, k1, b).join(sized, ["set_id", "pos"]).join(blank, ["query_id", "set_id"])
    scored = scored.filter(F.col("blank") | ((F.col("score") >= min_score) & (F.col("tokens") <= max_tokens)))
    names = ["query_id", "set_id", "pos", "score"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, used = (), 0
        for batch in batches:
            chosen = []
            for i, (q, s, tokens, everything) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("query_id", "set_id", "tokens", "blank")), strict=True)):
                if (q, s) != query:
                    query, used = (q, s), 0
                if everything or (used < max_tokens and used + tokens <= max_tokens):
                    used += 0 if everything else tokens
                    chosen.append(i)
            yield batch.take(pa.array(chosen, pa.int32())).select(names)

    order = scored.repartition("query_id", "set_id").sortWithinPartitions("query_id", "set_id", F.desc("score"), "pos")
    picked = order.mapInArrow(take, scored.select(*names).schema)
    return picked.join(chunks.select("set_id", "pos", "text"), ["set_id", "pos"]).select("query_id", "set_id", "pos", "text", "score")


def split_chunks(raw: DataFrame, separator: str = "---") -> DataFrame:
    """raw (set_id, text): set_id, pos, text; parts are stripped, empty ones go."""
    parts = F.transform(F.split(text_of(F.col("text")), rf"\Q{separator}\E"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return raw.select("set_id", F.posexplode(F.filter(parts, lambda p: p != "")).alias("pos", "text"))
