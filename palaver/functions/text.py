"""Strings: trimming, names, snippets, highlights, scores, entropy, masking, trigrams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNTITLED = "(untitled)"
CHAT_URL_PREFIX = "https://claude.ai/chat/"


def quoted(literal: str) -> str:
    """``literal`` as a Java regex that matches only itself."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def ws_trim(c: Column) -> Column:
    """Strip all Unicode white space, not only spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def query_words(query: str) -> list[str]:
    return query.lower().split()


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping, case-insensitive occurrences (of the original text, Unicode case rules)."""
    return F.regexp_count(text, F.lit("(?iu)" + quoted(literal))).cast("long")


def has_literal(text: Column, literal: str) -> Column:
    return F.contains(F.lower(text), F.lit(literal.lower()))


def has_word(text: Column, word: str) -> Column:
    """Whole word with Unicode word borders; ``word`` is lower case."""
    return F.lower(text).rlike(r"(?U)\b" + quoted(word) + r"\b")


def matches_query(text: Column, query: str, exact: bool = False) -> Column:
    """One text must hold the phrase (``exact``) or every word, as substrings without case."""
    phrase = query.lower().strip()
    if exact:
        return has_literal(text, phrase)
    out = F.lit(True)
    for w in dict.fromkeys(query_words(phrase)):
        out = out & has_literal(text, w)
    return out


def score_match(text: Column, query: str) -> Column:
    """Phrase +10; each word +2 as a whole word, else +1 as a part; all of several words +5."""
    phrase = query.lower().strip()
    words = query_words(phrase)
    out = F.when(has_literal(text, phrase), 10.0).otherwise(0.0)
    for w in words:
        out = out + F.when(has_word(text, w), 2.0).when(has_literal(text, w), 1.0).otherwise(0.0)
    if len(words) > 1:
        out = out + F.when(matches_query(text, phrase), 5.0).otherwise(0.0)
    return out


def snippet_count(text: Column, query: str, exact: bool = False) -> Column:
    """Occurrences that give a snippet: of the phrase, or of each query word (repeats count again)."""
    parts = [query.strip()] if exact else query.split()
    out = F.lit(0).cast("long")
    for p in parts:
        out = out + occurrences(text, p)
    return out


def name_bonus(name_raw: Column, query: str, exact: bool = False) -> Column:
    """+5 if the raw name holds the phrase, or all words unless ``exact``."""
    found = has_literal(name_raw, query.lower().strip())
    if not exact:
        found = found | matches_query(name_raw, query)
    return F.when((F.coalesce(name_raw, F.lit("")) != "") & found, 5.0).otherwise(0.0)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often, and in whatever loop, ``body`` has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def snippets(text: Column, literal: str, around: int = 100) -> Column:
    """One string for each occurrence: the text around it, line ends as spaces, dots where cut.

    One pass: the text between occurrences, the occurrences and what follows each are extracted once. What stands
    before one is put together of the ends of the few pieces before it, as many as hold ``around`` characters for sure,
    so that the work grows with the number of occurrences and not with its square."""
    hit = "(?iu)" + quoted(literal)
    between = F.split(text, hit, -1)
    found = F.regexp_extract_all(text, F.lit(hit), F.lit(0))
    after = F.regexp_extract_all(text, F.lit(f"{hit}(?s)(?=(.{{0,{around + 1}}}))"), F.lit(1))
    steps = F.filter(F.arrays_zip(between.alias("between"), found.alias("hit"), after.alias("after")), lambda s: s["hit"].isNotNull())
    pieces, end = around + 2, F.lit(around + 1)

    def one(s: Column, before: Column) -> Column:
        body = ws_trim(F.translate(F.concat(F.right(before, F.lit(around)), s["hit"], F.left(s["after"], F.lit(around))), "\n", " "))
        return F.concat(F.when(F.length(before) > around, "...").otherwise(""), body, F.when(F.length(s["after"]) > around, "...").otherwise(""))

    def each(b: Column) -> Column:
        def before(s: Column, k: Column) -> Column:
            last = F.slice(b["ends"], F.greatest(k - pieces, F.lit(0)) + 1, F.least(k, F.lit(pieces)))
            return F.right(F.concat(F.array_join(last, ""), s["between"]), end)

        return F.transform(b["steps"], lambda s, k: bound(before(s, k), lambda x: one(s, x)))

    def with_ends(steps: Column) -> Column:
        ends = F.transform(steps, lambda s: F.right(F.concat(s["between"], s["hit"]), end))
        return F.struct(steps.alias("steps"), ends.alias("ends"))

    return bound(bound(steps, with_ends), each)


def highlight(text: Column, terms: list[str], left: str = "<<", right: str = ">>") -> Column:
    """Mark every term in one pass from left to right, longer terms first."""
    distinct = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not distinct:
        return text
    return F.regexp_replace(text, "(?iu)(" + "|".join(map(quoted, distinct)) + ")", f"{left}$1{right}")


def highlight_query(text: Column, query: str, exact: bool = False, left: str = "<<", right: str = ">>") -> Column:
    """Mark a query's words, or all of it if ``exact``, in one pass: where several could begin, the one that
    comes first in the query is marked."""
    terms = [query] if exact else query.split()
    if not terms:
        return text
    return F.regexp_replace(text, "(?iu)(" + "|".join(map(quoted, terms)) + ")", f"{left}$1{right}")


def prettify_model(model: Column) -> Column:
    """A readable model name; unknown shapes pass unchanged, null becomes empty."""
    # The model name patterns.
    pattern = r"^claude-(opus|sonnet|haiku|fable)-(\d+)(?:-(\d+))?"
    minor = F.regexp_extract(model, pattern, 3)
    named = F.concat(F.initcap(F.regexp_extract(model, pattern, 1)), F.lit(" "), F.regexp_extract(model, pattern, 2), F.when(minor != "", F.concat(F.lit("."), minor)).otherwise(""))
    return F.when(F.coalesce(model, F.lit("")) == "", "").when(model.rlike(pattern), named).when(F.startswith(model, F.lit("gpt-")), F.concat(F.lit("GPT-"), F.substring(model, 5, 1 << 30))).otherwise(model)


def truncate_name(name: Column, most: int = 80) -> Column:
    """First line, white space collapsed, at most ``most`` characters with an ellipsis."""
    line = ws_trim(F.regexp_replace(F.get(F.split(ws_trim(name), "\n", 2), F.lit(0)), r"(?U)\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def sanitize_name(name: Column) -> Column:
    """A file name: spaces as hyphens, only ASCII letters, digits and hyphens, never empty."""
    kept = F.regexp_replace(F.translate(F.coalesce(name, F.lit("")), " ", "-"), "[^a-zA-Z0-9-]", "")
    return F.coalesce(blank_to_null(F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", "")), F.lit("untitled"))


def preview(texts: Column, most: int = 200) -> Column:
    """Of the first non-empty text: one line, stripped, first ``most`` characters and dots if cut."""
    first = F.get(F.filter(texts, lambda t: t != ""), F.lit(0))
    flat = ws_trim(F.translate(first, "\n", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def normalize_uuid(c: Column, prefix: str = CHAT_URL_PREFIX) -> Column:
    return F.lower(ws_trim(F.regexp_replace(ws_trim(c), "^" + quoted(prefix), "")))


def normalize_hostname(c: Column) -> Column:
    return F.regexp_replace(F.lower(ws_trim(c)), r"\.local$", "")


def abbreviate_home(path: Column, home: str) -> Column:
    return F.when(path == home, "~").when(F.startswith(path, F.lit(home + "/")), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))).otherwise(path)


def body_after_rule(document: Column) -> Column:
    """What follows the first ``---`` line; null without one."""
    return F.get(F.split(document, "\n---\n", 2), F.lit(1))


def entropy(token: Column) -> Column:
    """Shannon entropy of a token's characters, in bits."""
    chars = F.split(token, "")
    size = F.length(token).cast("double")
    share = lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / size
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, ch: acc - share(ch) * F.log2(share(ch)))
    return F.when(F.coalesce(token, F.lit("")) == "", 0.0).otherwise(total)


def substitute(c: Column, pairs: dict[str, str]) -> Column:
    """Literal replacement without case, longest key first."""
    for key in sorted((k for k in pairs if k), key=lambda k: (-len(k), k)):
        c = F.regexp_replace(c, "(?iu)" + quoted(key), pairs[key].replace("\\", "\\\\").replace("$", "\\$"))
    return c


def mask_id(value: Column, salt: str = "") -> Column:
    """The same id always gets the same mask of the same shape: hexadecimal digits come from a hash,
    separators stay. Masks of different ids differ as SHA-256 does."""
    digits = F.sha2(F.concat(F.lit(salt), value), 256)
    digits = F.concat(digits, F.sha2(digits, 256))
    chars = F.split(value, "")
    return F.array_join(F.transform(chars, lambda ch, k: F.when(ch.rlike("[0-9a-fA-F]"), F.substring(digits, k + 1, F.lit(1))).otherwise(ch)), "")


def mask_token(value: Column, salt: str = "") -> Column:
    """``mask_id`` for ids of logs: what follows ``call_`` is replaced letter by letter, too."""
    digits = F.sha2(F.concat(F.lit(salt), value), 256)
    digits = F.concat(digits, F.sha2(digits, 256))
    chars = F.split(F.substring(value, 6, 1 << 30), "")
    call = F.transform(chars, lambda ch, k: F.when(ch.rlike("[0-9A-Za-z]"), F.substring(digits, k + 6, F.lit(1))).otherwise(ch))
    return F.when(F.startswith(value, F.lit("call_")), F.concat(F.lit("call_"), F.array_join(call, ""))).otherwise(mask_id(value, salt))


def archive_path(path: Column, anchor: str) -> Column:
    """The part of a path below ``/anchor/``; null without it or with a ``..`` step."""
    tail = blank_to_null(F.regexp_extract(path, f"/{quoted(anchor)}/(.*)$", 1))
    return F.when(~tail.rlike(r"(^|/)\.\.(/|$)"), tail)


def trigrams(text: Column) -> Column:
    """Distinct groups of three characters of the lower-cased text; linear in its length."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def json_strings(document: Column) -> Column:
    """The string values (not keys) of a JSON document, in order, without parsing a schema."""
    tokens = F.regexp_extract_all(document, F.lit(r'"((?:[^"\\]|\\.)*+)"\s*+(:?)'), F.lit(0))
    values = F.filter(tokens, lambda t: ~F.endswith(t, F.lit(":")))
    raw = F.transform(values, lambda t: F.regexp_extract(t, r'(?s)^"(.*)"\s*$', 1))
    return F.transform(raw, lambda t: F.from_json(F.concat(F.lit('["'), t, F.lit('"]')), "array<string>")[0])
