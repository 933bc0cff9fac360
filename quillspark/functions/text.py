"""Text functions as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, as a line break, and as a fenced block.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
FENCE = r"(?s)```.*?```"
BLOCK_BREAK = r"\n{2,}|(?<=\n)---+\n"
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_BREAK = rf"(?<=[.!?]){SPACE}+(?=[A-Z])"


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def words(c: Column) -> Column:
    """Split at white space."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Lines without their breaks; a break at the end opens no further line."""
    return let(F.split(c, LINE_BREAK), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def join_lines(c: Column) -> Column:
    return F.array_join(c, "\n")


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of value, with value computed once, however often fn names it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def first_of(values: Column) -> Callable[[Column, Column], Column]:
    """A predicate for filter(): whether the item at an index is the first of its value."""
    return lambda _, i: F.array_position(values, F.get(values, i)) == i + 1


def with_separators(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """fn applied to what stands between the matches of pattern; the matches stay."""
    between = F.transform(F.split(text, pattern), fn)
    matches = F.array_append(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(""))
    return F.array_join(F.zip_with(between, matches, lambda a, b: F.concat(a, b)), "")


def outside_fences(text: Column, fn: Callable[[Column], Column]) -> Column:
    """fn applied to prose; fenced blocks stay, an unclosed fence is prose."""
    return with_separators(text, FENCE, fn)


def normalize_whitespace(text: Column, indent_spaces: int = 2) -> Column:
    """Line ends, trailing blanks, runs of blank lines and of spaces, leading tabs; outside fences."""

    def prose(t: Column) -> Column:
        t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
        t = F.regexp_replace(t, r"(?md)[ \t]+$", "")
        t = F.regexp_replace(t, r"\n{3,}", "\n\n")
        t = F.regexp_replace(t, r"(?<=\S) {2,}", " ")
        t = F.regexp_replace(t, r"(?md)(?:^|\G)\t", " " * indent_spaces)
        return F.btrim(t, F.lit("\n"))

    return outside_fences(text_of(text), prose)


def deduplicate_blocks(text: Column, min_block_tokens: int = 5) -> Column:
    """Blocks (paragraphs, or what `---` lines part) that repeat an earlier one go, if they have enough words."""
    text = text_of(text)
    blocks = F.split(text, BLOCK_BREAK)
    breaks = F.array_append(F.regexp_extract_all(text, F.lit(BLOCK_BREAK), F.lit(0)), F.lit(""))
    own = lambda b, i: F.when(F.size(words(b)) >= min_block_tokens, F.sha2(strip(b), 256)).otherwise(F.concat(F.lit("#"), i.cast("string")))
    first = let(F.transform(blocks, own), lambda keys: F.transform(keys, lambda k, i: F.array_position(keys, k) == i + 1))
    kept = F.zip_with(F.zip_with(blocks, first, lambda b, f: F.when(f, b).otherwise("")), breaks, lambda a, b: F.concat(a, b))
    return strip(F.regexp_replace(F.array_join(kept, ""), r"\n{3,}", "\n\n"))


#: Patterns of markup around retrieved text, what replaces them, and how many must be found.
MARKUP = (
    (r"(?i)<document(?:\s[^>]*)?>", "---\n", 1),
    (r"(?i)</document>", "", 1),
    (r"(?i)<source>([^<]*)</source>\s*", "[$1] ", 1),
    (r"(?i)<content>\s*", "", 1),
    (r"(?i)\s*</content>", "", 1),
    (r"(?imd)^<(?:chunk|passage|context|result|item|entry)(?:\s[^>]*)?>[ \t]*\n", "", 2),
    (r"(?imd)^</(?:chunk|passage|context|result|item|entry)>[ \t]*\n?", "", 2),
    (r"(?md)^={3,}\s*$", "", 2),
    (r"(?md)^-{3,}\s*$", "---", 2),
)
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
DELIMITERS = ((r"(?md)^[=\-]{4,}\s*$", "---", 3), (r"\n{3,}", "\n\n", 1))


def _if_found(pattern: str, by: str, least: int) -> Callable[[Column], Column]:
    return lambda x: F.when(F.regexp_count(x, F.lit(pattern)) >= least, F.regexp_replace(x, pattern, by)).otherwise(x)


def _replaced(t: Column, rules) -> Column:
    for pattern, by, least in rules:
        if least == 1:
            t = F.regexp_replace(t, pattern, by)
        else:
            t = let(t, _if_found(pattern, by, least))
    return t


def strip_markup(text: Column) -> Column:
    """Wrapper tags, underlines and named character entities; functions.arrow.optimize_format does numeric ones too."""
    t = _replaced(text_of(text), MARKUP)
    for name, by in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(by))
    return _replaced(t, DELIMITERS)


def truncate_code_blocks(text: Column, max_lines: Column | int, ends: int = 20) -> Column:
    """Fenced blocks of more than max_lines lines keep their first and last `ends` lines."""
    text = text_of(text)
    limit = max_lines if isinstance(max_lines, Column) else F.lit(max_lines)
    block = r"(?s)```[^\n]*\n.*?```"

    def cut(b: Column) -> Column:
        head = F.regexp_extract(b, r"(?s)^(```[^\n]*\n)", 1)
        body = lines(F.regexp_extract(b, r"(?s)^```[^\n]*\n(.*)```$", 1))
        n = F.size(body)
        note = F.array(F.format_string("... (%d lines omitted) ...", n - 2 * ends))
        tail = F.slice(body, F.greatest(n - ends + 1, F.lit(1)), ends)
        return F.when(n > limit, F.concat(head, join_lines(F.concat(F.slice(body, 1, ends), note, tail)), F.lit("\n```"))).otherwise(b)

    between = F.split(text, block)
    matches = F.array_append(F.transform(F.regexp_extract_all(text, F.lit(block), F.lit(0)), cut), F.lit(""))
    return F.array_join(F.zip_with(between, matches, lambda a, b: F.concat(a, b)), "")


def token_count(text: Column, backend: str = "approx") -> Column:
    """approx: words times 1.3, rounded up; chars: characters over 4, rounded up; bpe:<path>: tokens of that vocabulary
    file."""
    if backend.startswith("bpe:"):
        from quillspark.functions import arrow

        return arrow.bpe_count(text, backend[4:])
    if backend == "approx":
        return F.ceil(F.size(words(text_of(text))) * F.lit(1.3)).cast("long")
    if backend == "chars":
        return F.ceil(F.length(text_of(text)) / F.lit(4.0)).cast("long")
    raise ValueError(f"no such backend: {backend}")


def ratio(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.lit(0.0)).otherwise((before - after) / before)


def quality_score(before: Column, after: Column) -> Column:
    """Similarity of the word sets (runs of letters, digits and underscores); 1 if nothing is left."""
    found = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(text_of(t)), F.lit(WORD), F.lit(0)))

    def score(both: Column) -> Column:
        common = F.size(F.array_intersect(both.a, both.b))
        return F.when(F.size(both.b) == 0, F.lit(1.0)).otherwise(common / (F.size(both.a) + F.size(both.b) - common))

    return let(F.struct(found(before).alias("a"), found(after).alias("b")), score)


def char_shingles(text: Column, k: int = 5) -> Column:
    t = F.regexp_replace(strip(F.lower(text_of(text))), f"{SPACE}+", " ")
    some = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - k + 1), lambda i: F.substring(x, i, k)))
    return let(t, lambda x: F.when(F.length(x) >= k, some(x)).otherwise(F.array().cast("array<string>")))


def word_shingles(text: Column, k: int = 3) -> Column:
    some = lambda t: F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - k, F.lit(0))), lambda i: F.array_join(F.slice(t, i + 1, k), " "))
    return let(words(F.lower(text_of(text))), some)


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def minhash(shingles: Column, functions: int = 128) -> Column:
    """A signature of seeded 64-bit hashes, the same on every executor."""
    least = lambda held, s: F.array_min(F.transform(held, lambda x: F.xxhash64(s, x)))
    seeds = F.sequence(F.lit(1), F.lit(functions))
    return let(shingles, lambda h: F.transform(seeds, lambda s: F.coalesce(least(h, s), F.lit(0).cast("long"))))


def minhash_similarity(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)) / F.size(a)


def simhash(text: Column, k: int = 3) -> Column:
    """64 votes of the low halves of the shingles' MD5s."""
    hashes = F.transform(word_shingles(text, k), lambda s: F.conv(F.substring(F.md5(s), 17, 16), 16, -10).cast("long"))

    def bit(held: Column, i: Column) -> Column:
        votes = F.aggregate(held, F.lit(0), lambda n, h: n + F.call_function("getbit", h, i) * 2 - 1)
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

    bits = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: bit(h, i)))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def hamming_similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


#: Words that don't count in ranking.
RANKING_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can i you "
    "he she it we they this that these those of in on at to for with by from as into about and or but not so yet nor "
    "both either neither just also"
).split()


def terms(text: Column, stopwords: list[str] = RANKING_STOPWORDS) -> Column:
    found = F.regexp_extract_all(F.lower(text_of(text)), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stopwords))


def sentences(text: Column) -> Column:
    return F.split(text_of(text), SENTENCE_BREAK)
