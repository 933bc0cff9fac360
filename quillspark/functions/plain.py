"""The text stages on one Python string, from the rule tables of functions.text: used by streams and inside Arrow steps.

Each gives what its Column form gives; tests hold them against each other.
"""

from __future__ import annotations

import json
import re

from quillspark.functions import text as T

_FENCE = re.compile(r"(```[\s\S]*?```)")
_BLOCK_BREAK = re.compile(rf"({T.BLOCK_BREAK})")


def _rules(table) -> list[tuple[re.Pattern, str, int]]:
    """Rules as Python's patterns: only line feeds end lines there anyway, and groups are named by backslashes."""
    return [(re.compile(re.sub(r"^\(\?(\w*)d\)", r"(?\1)", pattern)), re.sub(r"\$(\d)", r"\\\1", by), least) for pattern, by, least in table]


_MARKUP, _DELIMITERS = _rules(T.MARKUP), _rules(T.DELIMITERS)


def _replaced(text: str, rules: list[tuple[re.Pattern, str, int]]) -> str:
    for pattern, by, least in rules:
        if least == 1 or len(pattern.findall(text)) >= least:
            text = pattern.sub(by, text)
    return text


def _outside_fences(text: str, fn) -> str:
    return "".join(p if i % 2 else fn(p) for i, p in enumerate(_FENCE.split(text)))


def normalize_whitespace(text: str, indent_spaces: int = 2) -> str:
    def prose(t: str) -> str:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
        t = re.sub(r"[ \t]+$", "", t, flags=re.M)
        t = re.sub(r"(?<=\S) {2,}", " ", re.sub(r"\n{3,}", "\n\n", t))
        return re.sub(r"^\t+", lambda m: " " * indent_spaces * len(m[0]), t, flags=re.M).strip("\n")

    return _outside_fences(text, prose)


def deduplicate_blocks(text: str, min_block_tokens: int = 5) -> str:
    seen: set[str] = set()
    out = []
    for i, block in enumerate(_BLOCK_BREAK.split(text)):
        key = block.strip()
        if i % 2 == 0 and len(key.split()) >= min_block_tokens:
            if key in seen:
                continue
            seen.add(key)
        out.append(block)
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def compact_json(text: str) -> str | None:
    """JSON without spaces; null if it isn't."""
    if not text.startswith(("{", "[")):
        return None
    try:
        return json.dumps(json.loads(text), separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def compact_paragraphs(text: str) -> str:
    if "{" not in text and "[" not in text:
        return text
    parts = re.split(r"(\n{2,})", text)
    return "".join(p if i % 2 else compact_json(p.strip()) or p for i, p in enumerate(parts))


def numeric_entities(text: str) -> str:
    return re.sub(r"&#(\d+);", lambda m: chr(int(m[1])), text) if "&#" in text else text


def strip_markup(text: str) -> str:
    text = _replaced(text, _MARKUP)
    if "&" in text:
        for name, by in T.ENTITIES:
            text = text.replace(name, by)
        text = numeric_entities(text)
    return _replaced(text, _DELIMITERS)


def optimize_format(text: str, minify: bool = True) -> str:
    """JSON without spaces; else markup, entities and JSON paragraphs, outside fences. A text with a numeric entity beyond
    the code points stays as it is."""
    whole = compact_json(text.strip()) if minify else None
    if whole is not None:
        return whole
    try:
        return _outside_fences(text, lambda t: compact_paragraphs(strip_markup(t)) if minify else strip_markup(t))
    except (ValueError, OverflowError):
        return text


def truncate_code_blocks(text: str, max_lines: int, ends: int = 20) -> str:
    """Fenced blocks of more than max_lines lines keep their first and last `ends` lines."""

    def cut(m: re.Match) -> str:
        rows = m[2].splitlines()
        if len(rows) <= max_lines:
            return m[0]
        return m[1] + "\n".join([*rows[:ends], f"... ({len(rows) - 2 * ends} lines omitted) ...", *rows[-ends:]]) + "\n```"

    return re.sub(r"(```[^\n]*\n)([\s\S]*?)```", cut, text) if "```" in text else text
