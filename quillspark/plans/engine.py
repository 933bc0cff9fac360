"""One object with the options of all operators, for callers that want a single entry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quillspark.operators import conversation, ranking
from quillspark.plans import pipeline
from quillspark.plans.pipeline import Config


@dataclass(frozen=True)
class Engine:
    config: Config = Config()

    def compress_prompts(self, docs: DataFrame, text_col: str = "text", skip_lossy: bool = False) -> DataFrame:
        from dataclasses import replace

        return replace(pipeline.build(self.config), skip_lossy=skip_lossy).run(docs, text_col)

    def compress_conversations(self, turns: DataFrame, keep_recent: int | None = None, summarize: bool = False, summarize_ratio: int = 3) -> DataFrame:
        recent = self.config.keep_recent if keep_recent is None else keep_recent
        compress = conversation.compress_block_history if "blocks" in turns.columns and "text" not in turns.columns else conversation.compress_history
        return compress(turns, recent, self.config.similarity_threshold, summarize, summarize_ratio)

    def select_context(self, chunks: DataFrame, queries: DataFrame, max_tokens: int | None = None) -> DataFrame:
        c = self.config
        return ranking.select_context(chunks, queries, c.rag_max_tokens if max_tokens is None else max_tokens, c.rag_min_score, c.bm25_k1, c.bm25_b)

    def estimate_cost(self, docs: DataFrame, model_col: str = "model", text_col: str = "text") -> DataFrame:
        """docs with the tokens and costs of their texts before and after compression."""
        return pipeline.estimate_cost(self.compress_prompts(docs, text_col), model_col)
