"""Structural filters for tool output, as Column expressions over its lines; Python only for JSON and tracebacks."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import arrow
from quillspark.functions.text import first_of, join_lines, let, lines, strip, text_of


#: What an install log keeps and skips, an entry of a directory, a compiler's error, a build's errors,
#: warnings and their kinds, and the rule that a linter's line names.
INSTALL_KEEPS = r"(?i)error|warn|successfully installed|added \d+|updated \d+|removed \d+|packages? (installed|updated)|requirement already|collecting |^\+ |done\."
INSTALL_SKIPS = r"(?i)^\s*[█▓░▒]+|^\s*\d+%|^npm http|node_modules"
DIRECTORY_ENTRY = r"^([d\-lbcsp][rwx\-]{9})\s+\d+\s+\S+\s+\S+\s+(\d+)\s+\S+\s+\S+\s+\S+\s+(.+)$"
COMPILER_ERROR = r"^(.+\.tsx?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.+)$"
BUILD_ERROR, BUILD_WARNING = r"\berror\b|\bERROR\b|Error:", r"(?i)\bwarning\b|\bWARN\b"
WARNING_KIND = r"(?i)(?:warning|warn)[:\s]+([A-Za-z][\w\-/]+)"
LINT_RULE = r"['\"]([a-z][\w\-]{2,})['\"]|\(([A-Z]\d+)\)|[ \t]([a-z][\w\-]{3,})[ \t]*$"


def _by_lines(fn):
    """A filter of a text, given the text and its lines, both computed once."""

    @functools.wraps(fn)
    def of(output: Column) -> Column:
        both = F.struct(output.alias("text"), lines(output).alias("rows"))
        return let(both, lambda o: fn(o.text, o.rows))

    return of


def _kept(output: Column, found: Column, least: int = 1) -> Column:
    return F.when(F.size(found) >= least, join_lines(found)).otherwise(output)


@_by_lines
def pytest_output(output: Column, rows: Column) -> Column:
    """Summary lines, and everything from the first failure section on; before it only warnings."""
    summary = lambda x: x.rlike(r"(?i)^=+ .*(passed|failed|error).* =+$")
    section = F.transform(rows, lambda x: ~summary(x) & x.rlike("(?i)^=+ (FAILURES|ERRORS|short test summary)"))
    kept = lambda begin: F.filter(rows, lambda x, i: summary(x) | ((begin > 0) & (i + 1 >= begin)) | x.rlike(r"(?i)\bwarning\b"))
    return _kept(output, let(F.array_position(section, F.lit(True)), kept))


def install_output(output: Column) -> Column:
    return _kept(output, F.filter(lines(output), lambda x: x.rlike(INSTALL_KEEPS) & ~x.rlike(INSTALL_SKIPS)), 3)


@_by_lines
def git_log_output(output: Column, rows: Column) -> Column:
    rows = F.filter(rows, lambda x: ~x.rlike(r"^(Author|Date):\s+"))
    blank = F.transform(rows, lambda x: strip(x) == "")
    run = lambda b: F.filter(rows, lambda x, i: ~(F.get(b, i) & F.coalesce(F.get(b, i - 1), F.lit(False))))
    return join_lines(let(blank, run))


def directory_output(output: Column) -> Column:
    entry = DIRECTORY_ENTRY

    def short(x: Column) -> Column:
        name, size = F.regexp_extract(x, entry, 3), F.regexp_extract(x, entry, 2)
        size = F.when(F.ltrim(size, F.lit("0")) == "", "0").otherwise(F.ltrim(size, F.lit("0")))
        padded = F.concat(name, F.repeat(F.lit(" "), F.greatest(40 - F.length(name), F.lit(0))), F.lit(" "), F.repeat(F.lit(" "), F.greatest(10 - F.length(size), F.lit(0))), size)
        return F.when(x.rlike(entry), F.concat(F.when(x.startswith("d"), "d ").otherwise("- "), padded)).otherwise(x)

    return join_lines(F.transform(lines(output), short))


@_by_lines
def tsc_output(output: Column, rows: Column) -> Column:
    """Compiler errors by file, three of each; five others."""
    entry = COMPILER_ERROR
    errors = F.filter(rows, lambda x: x.rlike(entry) & (F.regexp_extract(x, entry, 4) == "error"))
    other = F.filter(rows, lambda x: ~x.rlike(entry) & x.rlike(r"(?i)\berror\b"))
    files = F.array_sort(F.array_distinct(F.transform(errors, lambda x: F.regexp_extract(x, entry, 1))))

    def of(file: Column) -> Column:
        own = F.filter(errors, lambda x: F.regexp_extract(x, entry, 1) == file)
        shown = F.transform(F.slice(own, 1, 3), lambda x: F.regexp_replace(x, entry, r"  ($2,$3) $5: $6"))
        more = F.when(F.size(own) > 3, F.array(F.format_string("  ... %d more", F.size(own) - 3))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.concat(file, F.format_string(": %d error(s)", F.size(own)))), shown, more)

    head = F.array(F.format_string("[tsc: %d error(s) in %d file(s)]", F.size(errors) + F.size(other), F.size(files)))
    report = F.concat(head, F.flatten(F.transform(files, of)), F.slice(other, 1, 5))
    return F.when((F.size(errors) == 0) & (F.size(other) == 0), output).otherwise(join_lines(report))


@_by_lines
def build_output(output: Column, rows: Column) -> Column:
    """Twenty errors, warnings counted by kind, the last five lines."""
    is_error = lambda x: x.rlike(BUILD_ERROR)
    errors = F.filter(rows, is_error)
    warned = F.filter(rows, lambda x: ~is_error(x) & x.rlike(BUILD_WARNING))
    kind = WARNING_KIND
    kinds = F.transform(warned, lambda x: F.when(x.rlike(kind), F.regexp_extract(x, kind, 1)).otherwise("general"))
    counted = let(kinds, lambda ks: F.transform(F.array_sort(F.array_distinct(ks)), lambda k: F.concat(k, F.lit(":"), F.size(F.filter(ks, lambda y: y == k)).cast("string"))))
    tail = F.slice(rows, F.greatest(F.size(rows) - 4, F.lit(1)), 5)
    none = F.array().cast("array<string>")
    more = F.when(F.size(errors) > 20, F.array(F.format_string("  ... %d more error(s)", F.size(errors) - 20))).otherwise(none)
    of_errors = F.when(F.size(errors) > 0, F.concat(F.array(F.format_string("[Errors: %d]", F.size(errors))), F.slice(errors, 1, 20), more)).otherwise(none)
    of_warnings = F.when(F.size(warned) > 0, F.array(F.concat(F.lit("[Warnings] "), F.array_join(counted, ", ")))).otherwise(none)
    report = join_lines(F.concat(of_errors, of_warnings, F.array(F.lit("[Last lines]")), tail))
    quiet = F.when(F.size(rows) > 5, join_lines(tail)).otherwise(output)
    return F.when((F.size(errors) == 0) & (F.size(warned) == 0), quiet).otherwise(report)


def _first_warnings(rows: Column, rules: Column) -> Column:
    """Lines whose rule is null, and the first line of each rule."""
    return join_lines(let(rules, lambda r: F.filter(rows, lambda x, i: F.get(r, i).isNull() | first_of(r)(x, i))))


@_by_lines
def ruff_output(output: Column, rows: Column) -> Column:
    rules = F.transform(rows, lambda x: F.when(F.regexp_extract(x, r":\s+([A-Z]\d+)\s+", 1).startswith("W"), F.regexp_extract(x, r":\s+([A-Z]\d+)\s+", 1)))
    return _first_warnings(rows, rules)


@_by_lines
def lint_output(output: Column, rows: Column) -> Column:
    rule = LINT_RULE

    def of(x: Column) -> Column:
        named = F.concat(*[F.regexp_extract(x, rule, k) for k in (1, 2, 3)])
        warns = ~F.lower(x).contains("error") & F.lower(x).contains("warn")
        return F.when(warns, F.when(named != "", named).otherwise(F.substring(x, 1, 50)))

    return _first_warnings(rows, F.transform(rows, of))


@_by_lines
def jest_output(output: Column, rows: Column) -> Column:
    """Passing suites are counted; from a failing one on all lines stay, up to the next summary line."""
    passes, fails, sums = r"^\s*(PASS|✓)\s+", r"^\s*(FAIL|✕|×)\s+", r"^(Tests?|Test Suites?|Suites?):"
    n = F.size(F.filter(rows, lambda x: x.rlike(passes)))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("failing"))

    def step(state: Column, x: Column) -> Column:
        failing = F.when(x.rlike(fails), True).when(x.rlike(sums), False).otherwise(state.failing)
        stays = ~x.rlike(passes) & (failing | x.rlike(sums))
        return F.struct(F.when(stays, F.array_append(state.kept, x)).otherwise(state.kept).alias("kept"), F.when(x.rlike(passes), state.failing).otherwise(failing).alias("failing"))

    kept = F.aggregate(rows, start, step).kept
    head = F.when(n > 0, F.array(F.format_string("[%d suite(s) passed -- omitted]", n))).otherwise(F.array().cast("array<string>"))
    return _kept(output, F.concat(head, kept))


def grep_output(output: Column) -> Column:
    """Context blocks that are equal but for file and line go."""
    blocks = F.split(output, r"\n--\n")
    keys = F.transform(blocks, lambda b: F.md5(strip(F.regexp_replace(b, r"(?m)^[^\n:]+[:\-]\d+[:\-]", ""))))
    unique = let(keys, lambda k: F.filter(blocks, first_of(k)))
    gone = F.size(blocks) - F.size(unique)
    note = F.format_string("\n[%d duplicate context block(s) omitted]", gone)
    return F.when(gone == 0, output).otherwise(F.concat(F.array_join(unique, "\n--\n"), note))


#: Which command has which kind of output; the first that matches counts.
KINDS = (
    ("pytest", r"\bpytest\b|\bpython\s+-m\s+(pytest|unittest)\b"),
    ("jest", r"\b(jest|vitest)\b"),
    ("install", r"\b(npm\s+(install|i)|pip3?\s+install|yarn\s+add)\b"),
    ("git_log", r"\bgit\s+log\b"),
    ("directory", r"\bls\s+-\S*[la]\S*|\bfind\s+"),
    ("build", r"\b(tsc\b|webpack\b|cargo\s+build|make\b|gradle\b|next\s+build)"),
    ("lint", r"\b(eslint|ruff\s+check|flake8|pylint)\b"),
)


def kind_of(command: Column, output: Column) -> Column:
    c = strip(text_of(command))
    out = F.when(F.lit(False), "")
    for name, pattern in KINDS:
        out = out.when(c.rlike(pattern), name)
    return out.when(output.contains("Traceback (most recent call last)"), "traceback").otherwise("other")


def needs_python(command: Column, output: Column) -> Column:
    """eslint or traceback, if the command calls for a filter beyond Column expressions; else null."""
    is_eslint = text_of(command).rlike(r"\beslint\b")
    return let(kind_of(command, output), lambda k: F.when((k == "lint") & is_eslint, "eslint").when(k == "traceback", "traceback"))


def structural_output(command: Column, output: Column) -> Column:
    """The filter that the command calls for, as far as it is a Column expression."""

    def of(x: Column) -> Column:
        c, t = x.command, x.text
        build = F.when(c.rlike(r"\btsc\b"), tsc_output(t)).otherwise(build_output(t))
        lint = F.when(c.rlike(r"\bruff\b") & ~c.rlike(r"\beslint\b"), ruff_output(t)).otherwise(lint_output(t))
        branches = {"pytest": pytest_output(t), "jest": jest_output(t), "install": install_output(t), "git_log": git_log_output(t), "directory": directory_output(t), "build": build, "lint": lint}
        out = F
        for name, filtered in branches.items():
            out = out.when(x.kind == name, filtered)
        return out.otherwise(t)

    command, output = text_of(command), text_of(output)
    return let(F.struct(command.alias("command"), output.alias("text"), kind_of(command, output).alias("kind")), of)


def filter_output(command: Column, output: Column) -> Column:
    """The filter that the command calls for. A report of ESLint is read as JSON if it is."""
    filtered, kind = structural_output(command, output), needs_python(command, output)
    report = F.coalesce(arrow.eslint_report(text_of(output)), filtered)
    return F.when(kind == "eslint", report).when(kind == "traceback", arrow.short_tracebacks(text_of(output))).otherwise(filtered)
