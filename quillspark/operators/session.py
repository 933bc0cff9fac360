"""Operators over ordered events of a session: budgets, reads that repeat, profiles and command rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import arrow
from quillspark.functions.text import strip, text_of, token_count


def session_key(session_id: Column) -> Column:
    return F.substring(F.md5(session_id), 1, 8)


def track_budget(turns: DataFrame, window_tokens: int = 180_000, alert_at: float = 0.70) -> DataFrame:
    """turns (session_id, seq, text, input_tokens, output_tokens): running turns, input, output, fill, alert (the first
    time that fill reaches alert_at) and status."""
    so_far = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(F.col("output_tokens"), token_count(F.col("text")))
    out = turns.select(
        "session_id", "seq", F.count(F.lit(1)).over(so_far).alias("turns"), F.sum(own).over(so_far).alias("output_tokens"),
        F.coalesce(F.last("input_tokens", ignorenulls=True).over(so_far), F.lit(0)).alias("input_tokens"),
    )
    used = F.when(F.col("input_tokens") > 0, F.col("input_tokens")).otherwise(F.col("output_tokens"))
    out = out.withColumn("fill", used / F.lit(float(window_tokens)))
    high = (F.col("fill") >= alert_at).cast("int")
    out = out.withColumn("alert", (high == 1) & (F.sum(high).over(so_far) == 1))
    label = F.when(F.col("input_tokens") > 0, "context").otherwise("output tokens")
    return out.withColumn("status", F.when(F.col("alert"), alert_line(F.col("fill"))).otherwise(status_line(F.col("turns"), used, F.col("fill"), label, window_tokens)))


def _short(n: Column) -> Column:
    return F.when(n >= 1000, F.format_string("%.1fk", n / F.lit(1000.0))).otherwise(n.cast("string"))


#: Hints by least fill, and the alert.
HINTS = ((0.8, " — ⚠ run /compact now"), (0.6, " — consider /compact"), (0.4, " — approaching mid-session"))
ALERT = "IMPORTANT: Context is at %d%%. You must call /compact before taking any other action to prevent hitting the context limit."


def alert_line(fill: Column) -> Column:
    return F.format_string(ALERT, F.least(F.lit(100), F.floor(fill * 100).cast("int")))


def status_line(turns: Column, used: Column, fill: Column, label: Column, window_tokens: int, show_at: float = 0.15) -> Column:
    """Null below show_at; above, turns, what is used and what remains, with a hint."""
    hint = F.when(F.lit(False), "")
    for least, text in HINTS:
        hint = hint.when(fill >= least, text)
    left = F.greatest(F.lit(window_tokens) - used, F.lit(0))
    line = F.concat(F.lit("Turn "), turns.cast("string"), F.lit(" | ~"), _short(used), F.lit(" "), label, F.lit(" this session | ~"), _short(left), F.lit(" remaining"), hint.otherwise(""))
    return F.when(fill >= show_at, line)


def once_per_session(events: DataFrame) -> DataFrame:
    """The first event (session_id, seq) of each session."""
    first = Window.partitionBy("session_id").orderBy("seq")
    return events.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def read_deltas(reads: DataFrame, largest: int = 200_000, share: float = 0.30) -> DataFrame:
    """reads (session_id, path, seq, content): kind (new, unchanged, diff, full) and what to show. A read is compared
    with the previous one of the same path in the session; a diff is shown if it is short beside the content."""
    before = Window.partitionBy("session_id", "path").orderBy("seq")
    old = F.when(F.octet_length("content") <= largest, F.col("content"))
    seen = reads.withColumns({"old_key": F.lag(F.md5("content")).over(before), "old": F.lag(old).over(before), "old_seq": F.lag("seq").over(before)})
    name = F.element_at(F.split("path", "/"), -1)
    same = F.col("old_key") == F.md5("content")
    seen = seen.withColumns({"name": name, "same": F.coalesce(same, F.lit(False))})
    diff = arrow.unified_diff(F.when(~F.col("same"), F.col("old")), F.col("content"), F.col("name"))
    seen = seen.withColumn("diff", diff)
    brief = F.coalesce((F.length("diff") > 0) & (F.length("diff") < share * F.length("content")), F.lit(False))
    kind = F.when(F.col("old_key").isNull(), "new").when(F.col("same"), "unchanged").when(brief, "diff").otherwise("full")
    note = F.concat(F.lit("["), F.col("name"), F.format_string(": unchanged since read %d]", F.col("old_seq")))
    shown = F.when(kind == "unchanged", note).when(kind == "diff", F.col("diff")).otherwise(F.col("content"))
    return seen.select("session_id", "path", "seq", kind.alias("kind"), shown.alias("shown"))


#: By tool, the techniques, the least tokens and the longest code block; and for any other tool.
PROFILES = {
    "Bash": (["whitespace", "deduplication", "semantic_dedup"], 150, 60),
    "Read": (["whitespace", "deduplication"], 300, 80),
    "WebFetch": (["whitespace", "deduplication", "format", "semantic_dedup"], 100, 40),
    "WebSearch": (["whitespace", "deduplication", "format", "semantic_dedup"], 100, 40),
    "Grep": (["whitespace", "deduplication"], 200, 60),
}
OTHER_TOOL = (["whitespace", "deduplication"], 200, 60)
EVERYTHING = ["whitespace", "deduplication", "format", "semantic_dedup"]


def tool_profile(tool: Column, fill: Column, profiles: dict = PROFILES) -> Column:
    """{techniques, min_tokens, max_code_block_lines} for a tool at a fill."""
    strings = lambda v: F.array(*[F.lit(x) for x in v])
    def of(i, make):  # noqa: E306
        out = F.when(F.lit(False), make(OTHER_TOOL[i]))
        for name, values in profiles.items():
            out = out.when(tool == name, make(values[i]))
        return out.otherwise(make(OTHER_TOOL[i]))

    techniques, least, longest = of(0, strings), of(1, F.lit), of(2, F.lit)
    middle = F.when(F.array_contains(techniques, "semantic_dedup"), techniques).otherwise(F.array_append(techniques, F.lit("semantic_dedup")))
    return F.struct(
        F.when(fill < 0.4, techniques).when(fill < 0.7, middle).otherwise(strings(EVERYTHING)).alias("techniques"),
        F.when(fill < 0.4, least).when(fill < 0.7, F.greatest(F.lit(50), F.floor(least / 2).cast("int"))).otherwise(50).alias("min_tokens"),
        F.when(fill < 0.7, longest).otherwise(F.least(F.lit(40), longest)).alias("max_code_block_lines"),
    )


#: By least fill, the techniques for a user's prompt and the least tokens.
PROMPT_PROFILES = (
    (0.7, ["whitespace", "deduplication", "format", "semantic_dedup"], 50),
    (0.4, ["whitespace", "deduplication", "semantic_dedup"], 75),
    (0.0, ["whitespace", "semantic_dedup"], 100),
)


def prompt_profile(fill: Column) -> Column:
    """{techniques, min_tokens} for a user's prompt at a fill."""
    strings = lambda v: F.array(*[F.lit(x) for x in v])
    techniques = least = F
    for at, some, tokens in PROMPT_PROFILES:
        techniques, least = techniques.when(fill >= at, strings(some)), least.when(fill >= at, tokens)
    return F.struct(techniques.alias("techniques"), least.alias("min_tokens"))


#: Pattern, replacement and least fill; the first that changes the command counts.
REWRITES = (
    (r"^cat\s+(\S+)\s*$", r"head -100 $1", 0.0),
    (r"^pip\s+list\s*$", "pip list | head -30", 0.0),
    (r"^pip3\s+list\s*$", "pip3 list | head -30", 0.0),
    (r"^(find\s+\S+\s+-name\s+\"[^\"]+\")\s*$", r"$1 | head -50", 0.4),
    (r"^(find\s+\S+\s+-name\s+'[^']+')\s*$", r"$1 | head -50", 0.4),
    (r"^ls\s+-la?\s*$", "ls -la | head -40", 0.4),
    (r"^ls\s+-al?\s*$", "ls -al | head -40", 0.4),
    (r"^(npm\s+test)\s*$", r"$1 -- --reporter=min", 0.7),
    (r"^(npm\s+test\s+--)(?!\s+--reporter)(.*)$", r"$1 --reporter=min$2", 0.7),
    (r"^(cargo\s+test)\s*$", r"$1 2>&1 | tail -50", 0.7),
)


def rewrite_command(command: Column, fill: Column) -> Column:
    c = strip(text_of(command))
    out = F.when(F.lit(False), c)
    for pattern, by, least in REWRITES:
        out = out.when((fill >= least) & c.rlike(pattern) & (F.regexp_replace(c, pattern, by) != c), F.regexp_replace(c, pattern, by))
    return out.otherwise(command)
