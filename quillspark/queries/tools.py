"""Queries over tool output, reads, commands and budgets. Logs are made of events in the same way on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import arrow
from quillspark.operators import conversation, logs, session
from quillspark.plans import pipeline
from quillspark.queries.base import query
from quillspark.queries.reduction import LOG, _log
from quillspark.sources.readers import table


def _lines(*lines: str):
    """The line of an event by its remainder, as a Column (when asked, as Columns need a session) and as SQL; {id}
    stands for the event's id."""

    def said(line):
        first, *rest = line.split("{id}")
        return F.concat(F.lit(first), *[x for part in rest for x in (F.col("event_id").cast("string"), F.lit(part))])

    def column():
        out = F
        for i, line in enumerate(lines):
            out = out.when(F.col("event_id") % len(lines) == i, said(line))
        return out

    def sql(line):
        return " || CAST(event_id AS VARCHAR) || ".join("'" + part.replace("'", "''") + "'" for part in line.split("{id}"))

    return column, f"CASE event_id % {len(lines)} " + " ".join(f"WHEN {i} THEN {sql(line)}" for i, line in enumerate(lines)) + " END"


NL = "chr(10)"
_ROWS = "SELECT user_id, event_id, {} AS line FROM events"


def _agg(what: str = "line", where: str = "") -> str:
    return f"string_agg({what}, {NL} ORDER BY event_id)" + (f" FILTER (WHERE {where})" if where else "")


@query("x2_grep_blocks", f"""
WITH b AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
g AS (SELECT user_id, string_agg('f' || event_id || '.py:' || event_id || ':' || event_type, {NL} || '--' || {NL} ORDER BY event_id) FILTER (WHERE n = 1) AS text, count(*) - count(*) FILTER (WHERE n = 1) AS gone FROM b GROUP BY 1)
SELECT user_id, CASE WHEN gone = 0 THEN text ELSE text || {NL} || '[' || gone || ' duplicate context block(s) omitted]' END AS text FROM g""")
def x2_grep_blocks(spark, sf):
    e = F.col("event_id").cast("string")
    block = F.concat(F.lit("f"), e, F.lit(".py:"), e, F.lit(":"), "event_type")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", block.alias("block")))), lambda x: x.block)
    made = table(spark, sf, "events").groupBy("user_id").agg(F.array_join(ordered, "\n--\n").alias("output"))
    return made.select("user_id", logs.grep_output(F.col("output")).alias("text"))


_RUFF = _lines("a.py:{id}:1: W291 trailing", "b.py:{id}:1: E501 long", "c.py:{id}:2: W605 escape", "Found some.", "d.py:{id}:9: W291 again")


@query("x3_ruff", f"""
WITH l AS ({_ROWS.format(_RUFF[1])}),
r AS (SELECT *, regexp_extract(line, ':\\s+([A-Z]\\d+)\\s+', 1) AS rule FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, rule ORDER BY event_id) AS n FROM r)
SELECT user_id, {_agg(where="rule NOT LIKE 'W%' OR n = 1")} AS text FROM n GROUP BY 1""")
def x3_ruff(spark, sf):
    return _log(spark, sf, _RUFF[0]()).select("user_id", logs.ruff_output(F.col("output")).alias("text"))


_LINT = _lines("x:1 warning 'no-var' here", "y:2 error boom", "z:3 warning said (C901)", "fine", "x:{id} Warning 'no-var' there", "w: warn something unused-name ", "WARN a line without any rule but this: {id}!")


@query("x4_lint", f"""
WITH l AS ({_ROWS.format(_LINT[1])}),
r AS (SELECT *, CASE event_id % 7 WHEN 0 THEN 'no-var' WHEN 4 THEN 'no-var' WHEN 2 THEN 'C901' WHEN 5 THEN 'unused-name' WHEN 6 THEN left(line, 50) END AS rule FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, rule ORDER BY event_id) AS n FROM r)
SELECT user_id, {_agg(where="rule IS NULL OR n = 1")} AS text FROM n GROUP BY 1""")
def x4_lint(spark, sf):
    return _log(spark, sf, _LINT[0]()).select("user_id", logs.lint_output(F.col("output")).alias("text"))


def _reports(spark, sf):
    """ESLint reports as JSON: a file an event, with an error, and a warning of one of three rules."""
    e = F.col("event_id")
    message = lambda level, rule, text: F.struct(rule.alias("ruleId"), F.lit(level).alias("severity"), F.lit(text).alias("message"), e.alias("line"), F.lit(2).alias("column"))
    report = F.struct(F.concat(F.lit("/src/f"), e.cast("string"), F.lit(".js")).alias("filePath"), F.when(e % 5 < 4, F.array(message(1, F.concat(F.lit("rule-"), (e % 3).cast("string")), "soft"), message(2, F.lit("hard-rule"), "hard"))).otherwise(F.array()).alias("messages"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.to_json(report).alias("report")))), lambda x: x.report)
    return table(spark, sf, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("output"))


@query("x5_eslint", f"""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS n FROM events WHERE event_id % 5 < 4),
f AS (SELECT user_id, event_id, n, 'f' || event_id || '.js:' || {NL} || CASE WHEN n = 1 THEN '  ' || event_id || ':2 warn   soft (rule-' || (event_id % 3) || ')' || {NL} ELSE '' END || '  ' || event_id || ':2 error  hard (hard-rule)' AS line FROM r)
SELECT user_id, {_agg()} || {NL} || '[ESLint: ' || count(*) || ' errors, ' || count(*) || ' warnings (' || count(*) FILTER (WHERE n = 1) || ' unique warning rules shown)]' AS text FROM f GROUP BY 1""")
def x5_eslint(spark, sf):
    return _reports(spark, sf).select("user_id", arrow.eslint_report("output").alias("text"))


@query("f4_traceback", f"""
WITH t AS (SELECT item_id, item_id % 12 AS n FROM benchmark),
f AS (SELECT item_id, n, list_transform(range(n), lambda i: '  File "f' || i || '.py"' || {NL} || '    call ' || i) AS frames FROM t)
SELECT item_id, 'before' || {NL} || 'Traceback (most recent call last):' || {NL}
  || CASE WHEN n > 6 THEN array_to_string(frames[1:3], {NL}) || {NL} || '  ... (' || (n - 6) || ' frames omitted) ...' || {NL} || array_to_string(frames[n-2:n], {NL}) || {NL} || 'ValueError: x' || {NL} || 'after'
     WHEN n > 0 THEN array_to_string(frames, {NL}) || {NL} || 'ValueError: x' || {NL} || 'after' ELSE '' END AS text
FROM f WHERE n > 0""")
def f4_traceback(spark, sf):
    frames = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit('  File "f'), i.cast("string"), F.lit('.py"\n    call '), i.cast("string")))
    made = F.concat(F.lit("before\nTraceback (most recent call last):\n"), F.array_join(frames, "\n"), F.lit("\nValueError: x\nafter"))
    items = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 12).alias("n")).filter("n > 0")
    return items.select("item_id", logs.filter_output(F.lit("python run.py"), made).alias("text"))


_LS = _lines("total {id}", "drwxr-xr-x  2 me staff {id} Jan  1 12:00 folder {id}", "-rw-r--r--  1 me staff 00{id} Feb 28 2024 a_file_with_a_name_of_more_than_forty_characters_{id}.txt", "-rwxr-xr-x  1 me staff 0 Mar  3 09:30 f{id}")


@query("f5_directory", f"""
WITH l AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'total ' || event_id
  WHEN 1 THEN 'd ' || rpad('folder ' || event_id, 40, ' ') || ' ' || lpad(CAST(event_id AS VARCHAR), 10, ' ')
  WHEN 2 THEN '- a_file_with_a_name_of_more_than_forty_characters_' || event_id || '.txt ' || lpad(CAST(event_id AS VARCHAR), 10, ' ')
  ELSE '- ' || rpad('f' || event_id, 40, ' ') || ' ' || lpad('0', 10, ' ') END AS line FROM events)
SELECT user_id, {_agg()} AS text FROM l GROUP BY 1""")
def f5_directory(spark, sf):
    return _log(spark, sf, _LS[0]()).select("user_id", logs.filter_output(F.lit("ls -la"), F.col("output")).alias("text"))


_TSC = _lines("src/b.ts({id},7): error TS2304: no name {id}", "src/a.tsx(1,{id}): error TS1005: expected", "src/a.tsx(3,3): warning TS6133: unused", "error in the config {id}", "compiled {id}")


@query("f6_tsc", f"""
WITH l AS ({_ROWS.format(_TSC[1])}),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id, event_id % 5) AS most FROM l),
f AS (SELECT user_id, event_id % 5 AS k, CASE event_id % 5 WHEN 0 THEN 'src/b.ts' ELSE 'src/a.tsx' END AS file, any_value(most) AS most,
   string_agg(CASE event_id % 5 WHEN 0 THEN '  (' || event_id || ',7) TS2304: no name ' || event_id ELSE '  (1,' || event_id || ') TS1005: expected' END, {NL} ORDER BY event_id) FILTER (WHERE n <= 3) AS shown
   FROM n WHERE event_id % 5 < 2 GROUP BY ALL),
files AS (SELECT user_id, count(*) AS files, sum(most) AS errors, string_agg(file || ': ' || most || ' error(s)' || {NL} || shown || CASE WHEN most > 3 THEN {NL} || '  ... ' || (most - 3) || ' more' ELSE '' END, {NL} ORDER BY file) AS body FROM f GROUP BY 1),
other AS (SELECT user_id, count(*) AS errors, string_agg(line, {NL} ORDER BY event_id) FILTER (WHERE n <= 5) AS body FROM n WHERE event_id % 5 = 3 GROUP BY 1),
whole AS (SELECT user_id, {_agg()} AS everything FROM l GROUP BY 1)
SELECT user_id, CASE WHEN f.errors IS NULL AND o.errors IS NULL THEN everything
  ELSE '[tsc: ' || CAST(coalesce(f.errors, 0) + coalesce(o.errors, 0) AS BIGINT) || ' error(s) in ' || coalesce(files, 0) || ' file(s)]' || coalesce({NL} || f.body, '') || coalesce({NL} || o.body, '') END AS text
FROM whole LEFT JOIN files f USING (user_id) LEFT JOIN other o USING (user_id)""")
def f6_tsc(spark, sf):
    return _log(spark, sf, _TSC[0]()).select("user_id", logs.filter_output(F.lit("npx tsc --noEmit"), F.col("output")).alias("text"))


_BUILD = _lines("step {id}", "an error at {id}", "warning: unused-import in {id}", "WARN deprecated/thing", "a warning", "done {id}")


@query("f7_build", f"""
WITH l AS ({_ROWS.format(_BUILD[1])}),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 6 = 1 ORDER BY event_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back,
  CASE event_id % 6 WHEN 2 THEN 'unused-import' WHEN 3 THEN 'deprecated/thing' WHEN 4 THEN 'general' END AS kind FROM l),
e AS (SELECT user_id, count(*) AS errors, string_agg(line, {NL} ORDER BY event_id) FILTER (WHERE n <= 20) AS shown FROM n WHERE event_id % 6 = 1 GROUP BY 1),
w AS (SELECT user_id, string_agg(kind || ':' || c, ', ' ORDER BY kind) AS kinds FROM (SELECT user_id, kind, count(*) AS c FROM n WHERE kind IS NOT NULL GROUP BY ALL) GROUP BY 1),
t AS (SELECT user_id, {_agg(where="back <= 5")} AS tail FROM n GROUP BY 1)
SELECT user_id, CASE WHEN errors IS NULL AND kinds IS NULL THEN tail ELSE
  coalesce('[Errors: ' || errors || ']' || {NL} || shown || CASE WHEN errors > 20 THEN {NL} || '  ... ' || (errors - 20) || ' more error(s)' ELSE '' END || {NL}, '')
  || coalesce('[Warnings] ' || kinds || {NL}, '') || '[Last lines]' || {NL} || tail END AS text
FROM t LEFT JOIN e USING (user_id) LEFT JOIN w USING (user_id)""")
def f7_build(spark, sf):
    return _log(spark, sf, _BUILD[0]()).select("user_id", logs.filter_output(F.lit("make all"), F.col("output")).alias("text"))


@query("f8_linters", f"""
WITH l AS ({LOG.format("'x.py:1: W1 said, warning (W100)'")}),
one AS (SELECT user_id, 'x.py:1: W1 said, warning (W100)' AS line, output FROM l)
SELECT user_id, CASE user_id % 4 WHEN 0 THEN line WHEN 1 THEN line WHEN 2 THEN '[{{"filePath":"a.js","messages":[]}}]' ELSE output END AS text FROM one""")
def f8_linters(spark, sf):
    made = _log(spark, sf, F.lit("x.py:1: W1 said, warning (W100)"))
    u = F.col("user_id") % 4
    command = F.when(u == 0, "ruff check .").when(u == 1, "flake8 src").when(u == 2, "npx eslint -f json .").otherwise("cat it")
    output = F.when(u == 2, F.lit('[{"filePath":"a.js","messages":[]}]')).otherwise(F.col("output"))
    return made.select("user_id", logs.filter_output(command, output).alias("text"))


_JEST = _lines("PASS a{id}.test.js", "FAIL b{id}.test.js", "  expected {id}", "Tests: {id} in all", "  a note {id}")


@query("f9_jest", f"""
WITH l AS ({_ROWS.format(_JEST[1])}),
s AS (SELECT *, coalesce(max(CASE WHEN event_id % 5 = 1 THEN event_id END) OVER w, -1) > coalesce(max(CASE WHEN event_id % 5 = 3 THEN event_id END) OVER w, -1) AS failing FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT user_id, count(*) FILTER (WHERE event_id % 5 = 0) AS passed, {_agg(where="event_id % 5 <> 0 AND (event_id % 5 = 3 OR failing)")} AS kept, {_agg()} AS everything FROM s GROUP BY 1)
SELECT user_id, CASE WHEN passed = 0 AND kept IS NULL THEN everything ELSE concat_ws({NL}, CASE WHEN passed > 0 THEN '[' || passed || ' suite(s) passed -- omitted]' END, kept) END AS text FROM k""")
def f9_jest(spark, sf):
    return _log(spark, sf, _JEST[0]()).select("user_id", logs.filter_output(F.lit("npx jest"), F.col("output")).alias("text"))


_FAILURES = _lines("a.py .", "a warning", "=== FAILURES ===", "assert {id}", "=== 1 failed, 2 passed in 1s ===", "b.py F")


@query("f1_pytest_failures", f"""
WITH l AS ({_ROWS.format(_FAILURES[1])}),
b AS (SELECT *, min(CASE WHEN event_id % 6 = 2 THEN event_id END) OVER (PARTITION BY user_id) AS begins FROM l)
SELECT user_id, coalesce({_agg(where="event_id % 6 = 4 OR event_id >= begins OR event_id % 6 = 1")}, {_agg()}) AS text FROM b GROUP BY 1""")
def f1_pytest_failures(spark, sf):
    return _log(spark, sf, _FAILURES[0]()).select("user_id", logs.filter_output(F.lit("python -m pytest -q"), F.col("output")).alias("text"))


_MIXED = _lines("added 3 packages", "Author: x", "plain line {id}", "")


@query("f0_filtered_output", f"""
WITH l AS ({_ROWS.format(_MIXED[1])}),
k AS (SELECT user_id, {_agg()} AS everything, {_agg(where="event_id % 4 = 0")} AS installed, count(*) FILTER (WHERE event_id % 4 = 0) AS n FROM l GROUP BY 1)
SELECT user_id, CASE user_id % 3 WHEN 0 THEN CASE WHEN n >= 3 THEN installed ELSE everything END ELSE everything END AS text FROM k WHERE user_id % 3 <> 2
UNION ALL
SELECT user_id, CASE user_id % 2 WHEN 0 THEN '[1 suite(s) passed -- omitted]' ELSE 'no command known' END AS text FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 = 2""")
def f0_filtered_output(spark, sf):
    u = F.col("user_id")
    command = F.when(u % 3 == 0, "  npm install left").when(u % 3 == 1, "cat log").when(u % 2 == 0, "vitest run").otherwise(F.lit(None))
    output = F.when(u % 3 != 2, F.col("output")).when(u % 2 == 0, "PASS a").otherwise("no command known")
    return _log(spark, sf, _MIXED[0]()).select("user_id", logs.filter_output(command, output).alias("text"))


def _versions(spark, sf):
    """Reads of two files that change in their last line, every third time not at all."""
    e = F.col("event_id")
    body = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("line number "), i.cast("string"))), "\n"), F.lit("\nversion "), F.floor(e / 3).cast("string"))
    return table(spark, sf, "events").select((e % 7).alias("session_id"), F.lit("src/a.py").alias("path"), e.alias("seq"), body.alias("content"))


@query("f11_read_diffs", f"""
WITH r AS (SELECT event_id % 7 AS session_id, event_id AS seq, event_id // 3 AS v, lag(event_id // 3) OVER w AS old, lag(event_id) OVER w AS before FROM events WINDOW w AS (PARTITION BY event_id % 7 ORDER BY event_id)),
body AS (SELECT array_to_string(list_transform(range(1, 61), lambda i: 'line number ' || i), {NL}) AS b)
SELECT session_id, seq, CASE WHEN old IS NULL THEN 'new' WHEN old = v THEN 'unchanged' ELSE 'diff' END AS kind,
  CASE WHEN old IS NULL THEN b || {NL} || 'version ' || v WHEN old = v THEN '[a.py: unchanged since read ' || before || ']'
  ELSE '--- a/a.py' || {NL} || '+++ b/a.py' || {NL} || '@@ -58,4 +58,4 @@' || {NL} || ' line number 58' || {NL} || ' line number 59' || {NL} || ' line number 60' || {NL} || '-version ' || old || {NL} || '+version ' || v END AS shown
FROM r, body""")
def f11_read_diffs(spark, sf):
    return session.read_deltas(_versions(spark, sf)).select("session_id", "seq", "kind", "shown")


@query("f12_tool_events", f"""
WITH e AS (SELECT event_id, event_id % 5 AS k FROM events),
n AS (SELECT *, 'added ' || event_id || ' packages' AS added FROM e)
SELECT event_id, CASE k
  WHEN 0 THEN added || {NL} || 'WARN one' || {NL} || 'WARN two'
  WHEN 1 THEN 'a.py:1:same text' || {NL} || '[2 duplicate context block(s) omitted]'
  WHEN 2 THEN array_to_string(list_transform(range(1, 201), lambda i: 'web word ' || i || '.'), {NL})
  END AS shown FROM n""")
def f12_tool_events(spark, sf):
    e = F.col("event_id")
    k = e % 5
    install = F.concat(F.lit("npm http fetch\nresolving it all\nadded "), e.cast("string"), F.lit(" packages\nWARN one\nWARN two"))
    grep = F.lit("a.py:1:same text\n--\nb.py:2:same text\n--\nc.py:33:same text")
    rows = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("web word "), i.cast("string"), F.lit(".")))
    web = F.concat(F.array_join(rows, "  \n"), F.lit("\n<content> </content> </document>"))
    output = F.when(k == 0, install).when(k == 1, grep).when(k == 2, web).when(k == 3, "short read").otherwise("not a tool of ours")
    tool = F.when(k == 0, "Bash").when(k == 1, "Grep").when(k == 2, "WebFetch").when(k == 3, "Read").otherwise("Write")
    made = table(spark, sf, "events").select("event_id", tool.alias("tool_name"), F.when(k == 0, "npm install").alias("command"), output.alias("output"), F.lit(0.1).alias("fill"))
    return pipeline.compress_tool_events(made).select("event_id", "shown")


@query("k4_hook_response", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"hookSpecificOutput\":{\"updatedToolOutput\":\"say ' || event_id || '\"}}' END AS response FROM events")
def k4_hook_response(spark, sf):
    shown = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("say "), F.col("event_id").cast("string")))
    return table(spark, sf, "events").select("event_id", pipeline.hook_response(shown).alias("response"))


_FILL = "(event_id % 101) / 100.0::DOUBLE"


@query("f13_tool_profiles", f"""
WITH t AS (SELECT event_id, {_FILL} AS f, ['Bash', 'Read', 'WebFetch', 'WebSearch', 'Grep', 'Other'][event_id % 6 + 1] AS tool FROM events),
p AS (SELECT *, CASE tool WHEN 'Bash' THEN ['whitespace', 'deduplication', 'semantic_dedup'] WHEN 'WebFetch' THEN ['whitespace', 'deduplication', 'format', 'semantic_dedup'] WHEN 'WebSearch' THEN ['whitespace', 'deduplication', 'format', 'semantic_dedup'] ELSE ['whitespace', 'deduplication'] END AS own,
  CASE tool WHEN 'Bash' THEN 150 WHEN 'Read' THEN 300 WHEN 'WebFetch' THEN 100 WHEN 'WebSearch' THEN 100 ELSE 200 END AS least,
  CASE tool WHEN 'Read' THEN 80 WHEN 'WebFetch' THEN 40 WHEN 'WebSearch' THEN 40 ELSE 60 END AS longest FROM t)
SELECT event_id, array_to_string(CASE WHEN f < 0.4 THEN own WHEN f < 0.7 THEN CASE WHEN list_contains(own, 'semantic_dedup') THEN own ELSE list_append(own, 'semantic_dedup') END ELSE ['whitespace', 'deduplication', 'format', 'semantic_dedup'] END, ',') AS techniques,
  CASE WHEN f < 0.4 THEN least WHEN f < 0.7 THEN CAST(greatest(50, least // 2) AS INTEGER) ELSE 50 END AS min_tokens, CASE WHEN f < 0.7 THEN longest ELSE least(40, longest) END AS longest FROM p""")
def f13_tool_profiles(spark, sf):
    tool = F.element_at(F.array(*[F.lit(t) for t in (*session.PROFILES, "Other")]), (F.col("event_id") % 6 + 1).cast("int"))
    p = session.tool_profile(tool, F.col("event_id") % 101 / F.lit(100.0))
    return table(spark, sf, "events").select("event_id", F.array_join(p.techniques, ",").alias("techniques"), p.min_tokens.alias("min_tokens"), p.max_code_block_lines.alias("longest"))


@query("f14_prompt_profile", f"""
SELECT event_id, CASE WHEN {_FILL} >= 0.7 THEN 'whitespace,deduplication,format,semantic_dedup' WHEN {_FILL} >= 0.4 THEN 'whitespace,deduplication,semantic_dedup' ELSE 'whitespace,semantic_dedup' END AS techniques,
  CASE WHEN {_FILL} >= 0.7 THEN 50 WHEN {_FILL} >= 0.4 THEN 75 ELSE 100 END AS min_tokens FROM events""")
def f14_prompt_profile(spark, sf):
    p = session.prompt_profile(F.col("event_id") % 101 / F.lit(100.0))
    return table(spark, sf, "events").select("event_id", F.array_join(p.techniques, ",").alias("techniques"), p.min_tokens.alias("min_tokens"))


_COMMANDS = ("cat  a.txt ", "pip list", "pip3 list", 'find . -name "*.py"', "find src -name '*.c'", "ls -la", "ls -al", "npm test", "npm test -- unit", "cargo test", "cat a b", "npm test -- --reporter=dot")
_REWRITTEN = (
    ("head -100 a.txt", 0.0), ("pip list | head -30", 0.0), ("pip3 list | head -30", 0.0), ('find . -name "*.py" | head -50', 0.4), ("find src -name '*.c' | head -50", 0.4), ("ls -la | head -40", 0.4),
    ("ls -al | head -40", 0.4), ("npm test -- --reporter=min", 0.7), ("npm test -- --reporter=min unit", 0.7), ("cargo test 2>&1 | tail -50", 0.7), ("cat a b", 0.0), ("npm test -- --reporter=dot", 0.0),
)


def _quoted(s):
    return "'" + s.replace("'", "''") + "'"


@query("f15_all_rewrites", "SELECT event_id, CASE event_id % 12 " + " ".join(
    f"WHEN {i} THEN CASE WHEN {_FILL} >= {least} THEN {_quoted(new)} ELSE {_quoted(old)} END" for i, (old, (new, least)) in enumerate(zip(_COMMANDS, _REWRITTEN, strict=True))
) + " END AS command FROM events")
def f15_all_rewrites(spark, sf):
    made = F.element_at(F.array(*[F.lit(c) for c in _COMMANDS]), (F.col("event_id") % 12 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", session.rewrite_command(made, F.col("event_id") % 101 / F.lit(100.0)).alias("command"))


_SHORT = "CASE WHEN {0} >= 1000 THEN printf('%.1fk', {0} / 1000.0::DOUBLE) ELSE CAST({0} AS VARCHAR) END"


@query("b3_status", f"""
WITH u AS (SELECT user_id AS session_id, event_id AS seq, row_number() OVER w AS turns, CAST(event_id % 3 = 0 AS INTEGER) AS api, CAST(row_number() OVER w * 4000 AS BIGINT) AS context, CAST(sum(1000) OVER w AS BIGINT) AS said FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT *, coalesce(last_value(CASE WHEN api = 1 THEN context END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq), 0) AS input FROM u),
f AS (SELECT *, CASE WHEN input > 0 THEN input ELSE said END AS used, CASE WHEN input > 0 THEN 'context' ELSE 'output tokens' END AS label FROM c),
h AS (SELECT *, used / 180000.0::DOUBLE AS fill, sum(CASE WHEN used / 180000.0::DOUBLE >= 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS high FROM f)
SELECT session_id, seq, CASE
  WHEN fill >= 0.7 AND high = 1 THEN 'IMPORTANT: Context is at ' || least(100, CAST(floor(fill * 100) AS BIGINT)) || '%. You must call /compact before taking any other action to prevent hitting the context limit.'
  WHEN fill >= 0.15 THEN 'Turn ' || turns || ' | ~' || {_SHORT.format("used")} || ' ' || label || ' this session | ~' || {_SHORT.format("greatest(180000 - used, 0)")} || ' remaining'
    || CASE WHEN fill >= 0.8 THEN ' — ⚠ run /compact now' WHEN fill >= 0.6 THEN ' — consider /compact' WHEN fill >= 0.4 THEN ' — approaching mid-session' ELSE '' END END AS status FROM h""")
def b3_status(spark, sf):
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    made = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.lit("").alias("text"), F.when(F.col("event_id") % 3 == 0, turn * 4000).cast("long").alias("input_tokens"), F.lit(1000).cast("long").alias("output_tokens"))
    return session.track_budget(made).select("session_id", "seq", "status")


@query("b4_block_text", "SELECT event_id, event_type || ' ' || CASE WHEN event_id % 2 = 0 THEN '' ELSE props END AS text FROM events")
def b4_block_text(spark, sf):
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.array(block("text", F.col("event_type")), block("image", F.lit("no text")), block("text", F.when(F.col("event_id") % 2 == 1, F.col("props"))))
    return table(spark, sf, "events").select("event_id", conversation.block_text(blocks).alias("text"))


@query("m11_rule_free_lines", f"""
WITH l AS ({_ROWS.format("event_type || ' W' || (event_id % 4)")})
SELECT user_id, {_agg()} AS text FROM l GROUP BY 1""")
def m11_rule_free_lines(spark, sf):
    line = F.concat("event_type", F.lit(" W"), (F.col("event_id") % 4).cast("string"))
    return _log(spark, sf, line).select("user_id", logs.ruff_output(F.col("output")).alias("text"))
