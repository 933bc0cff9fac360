"""Streaming compression: chunks of many streams; complete paragraphs are compressed as they come, near duplicates of
earlier ones go."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.functions import arrow, plain

TECHNIQUES = ("whitespace", "deduplication", "format", "semantic_dedup")


def compress_paragraph(text: str, kept: arrow.Kept, techniques: Iterable[str] = TECHNIQUES, indent: int = 2, language: str = "auto") -> str:
    """The stages of the batch pipeline, in its order, on one paragraph. Blank text stays as it is."""
    if not text.strip():
        return text
    if "whitespace" in techniques:
        text = plain.normalize_whitespace(text, indent)
    if "deduplication" in techniques:
        text = plain.deduplicate_blocks(text)
    if "format" in techniques:
        text = plain.optimize_format(text)
    if "semantic_dedup" in techniques:
        text = arrow.leader_fold(text, kept, kept.threshold, "sentence", language)
    return text


class StreamState:
    """What is carried between micro-batches of one stream: the open paragraph, and the last `remember` kept sentences."""

    def __init__(self, buffer: str = "", kept: Iterable[str] = (), threshold: float = 0.85, remember: int | None = None, **options):
        self.buffer, self.kept, self.options = buffer, arrow.Kept(threshold, kept, remember), options

    def feed(self, chunk: str) -> str:
        *whole, self.buffer = (self.buffer + chunk).split("\n\n")
        out = [c for p in whole if (c := compress_paragraph(p, self.kept, **self.options))]
        return "\n\n".join(out) + "\n\n" if out else ""

    def flush(self) -> str:
        out = compress_paragraph(self.buffer, self.kept, **self.options)
        self.buffer, self.kept = "", arrow.Kept(self.kept.threshold, (), self.kept.remember)
        return out


def compress_stream(
    chunks: DataFrame,
    threshold: float = 0.85,
    techniques: tuple[str, ...] = TECHNIQUES,
    indent: int = 2,
    language: str = "auto",
    remember: int = 5000,
    idle_ms: int | None = 600_000,
) -> DataFrame:
    """chunks (stream_id, seq, chunk, is_end), a streaming DataFrame: stream_id, seq, text for each chunk that completes
    a paragraph. The end marker, or idle_ms without a chunk, gives out the rest (seq -1 when idle) and clears the state.
    With idle_ms none, streams wait for their end marker; a query that runs until its input is used up needs that, as
    one that waits for idle streams has no last batch.

    A stream's state is its open paragraph and the texts of the last `remember` sentences kept, so it is bounded; a
    sentence is compared with those. Streams are spread by stream_id."""
    options = {"threshold": threshold, "remember": remember, "techniques": techniques, "indent": indent, "language": language}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = StreamState(*(state.get if state.exists else ("", [])), **options)
        rows: list[tuple] = []
        if state.hasTimedOut:
            rows.append((key[0], -1, held.flush()))
            state.remove()
        else:
            got = pd.concat(list(batches)).sort_values("seq")
            ended = False
            for seq, chunk, is_end in zip(got["seq"], got["chunk"], got["is_end"], strict=True):
                text = held.feed(chunk or "")
                ended = bool(is_end)
                rows.append((key[0], int(seq), text + held.flush() if ended else text))
            if ended:
                state.remove()
            else:
                state.update((held.buffer, list(held.kept.units)))
                if idle_ms is not None:
                    state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([r for r in rows if r[2]], columns=["stream_id", "seq", "text"])

    kind = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.groupBy("stream_id").applyInPandasWithState(
        step, f"stream_id {kind}, seq long, text string", "buffer string, kept array<string>", "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
