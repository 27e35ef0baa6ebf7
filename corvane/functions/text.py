"""Text expressions: folding, terms, shingles, token estimates and normal forms. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> dict[str, str]:
    """Lower-case Latin letters with marks, and the letters they fold to: the base of the canonical decomposition."""
    table = {"đ": "d", "ħ": "h", "ı": "i", "ł": "l", "ŀ": "l", "ø": "o", "ŧ": "t", "ŉ": "n"}
    for code in (*range(0xC0, 0x180), 0x1A1, 0x1B0, *range(0x1EA0, 0x1EFA)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if chr(code).islower() and base.isascii() and base != chr(code):
            table[chr(code)] = base
    return table


FOLD = _fold_table()
FOLD_FROM, FOLD_TO = "".join(FOLD), "".join(FOLD.values())

# Words that are no terms, folded.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "is", "it", "this", "that", "be", "at", "as",
    "la", "va", "cua", "cho", "voi", "trong", "mot", "cai", "nay", "thi", "o",
)
#: Terms of a query at most, words of a shingle, and letters of one word that a shingle must have.
QUERY_TERMS, SHINGLE, LONG_WORD = 24, 5, 6


def fold(s: Column) -> Column:
    """Lower case, with ß as ss and Latin letters without their marks."""
    return F.translate(F.replace(F.lower(s), F.lit("ß"), F.lit("ss")), FOLD_FROM, FOLD_TO)


def terms(s: Column, cap: int = 0, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct folded runs of letters and digits in order, of two bytes or more, without stop words; `cap` at most if over 0."""
    found = F.regexp_extract_all(fold(s), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    found = F.array_distinct(F.filter(found, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*stop_words)))
    return F.slice(found, 1, cap) if cap else found


def all_words(s: Column) -> Column:
    """Terms with repeats and stop words: what term frequencies count."""
    return F.regexp_extract_all(fold(s), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def token_estimate(s: Column) -> Column:
    """bytes / 4 + 1; characters / 1.8 + 1 where over a fifth of the characters take more than a byte; 0 if empty."""
    size, chars = F.octet_length(s), F.char_length(s)
    return F.when(size == 0, 0).when((size - chars) * 5 > chars, F.expr("0") + F.floor(chars * 10 / 18) + 1).otherwise(F.floor(size / 4) + 1).cast("int")


def slug(s: Column, cap: int = 64, default: str = "card") -> Column:
    cut = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.trim(F.substring(cut, 1, cap), F.lit("-")) if cap else cut
    return F.when(cut == "", default).otherwise(cut)


def first_line(s: Column, cap: int = 0) -> Column:
    line = F.trim(F.substring_index(s, "\n", 1))
    return F.substring(line, 1, cap) if cap else line


def short_hash(s: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(s, 256), 1, digits)


def cut_bytes(s: Column, most: Column | int) -> Column:
    """The first `most` bytes of a text, less what would split a character."""
    data, most = F.encode(s, "UTF-8"), F.lit(most)
    inside = lambda k: F.hex(F.substr(data, most + (1 - k), F.lit(1))).rlike("^[89AB]")  # noqa: E731  the byte behind begins no character
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    return F.when(F.octet_length(s) <= most, s).otherwise(F.decode(F.substr(data, F.lit(1), most - back), "UTF-8"))


def truncated(s: Column, most: int) -> Column:
    """One line of at most `most` bytes, with an ellipsis if it was longer."""
    line = F.replace(s, F.lit("\n"), F.lit(" ¶ "))
    return F.when(F.octet_length(line) <= most, line).otherwise(F.concat(cut_bytes(line, most), F.lit("…")))


def loose_json(s: Column) -> Column:
    """The JSON object from the first `{` to the last `}` of a text, as a variant; null if that is none.

    Prose and code fences around it don't matter.
    """
    found = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    # the parser takes no notice of what follows a value: within two kinds of brackets, nothing can follow
    listed, held = F.try_parse_json(F.concat(F.lit("["), found, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"x":'), found, F.lit("}")))
    alone = held.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when((found != "") & alone, F.try_variant_get(listed, "$[0]", "variant"))


def folded(words: list[str] | tuple[str, ...]) -> list[str]:
    """Words of a configuration as `fold` gives them, trimmed and without empty ones."""
    table = str.maketrans(FOLD)
    return [w for w in (x.strip().lower().replace("ß", "ss").translate(table) for x in words) if w]


def plain_phrases(s: Column) -> Column:
    """Folded words with single spaces, without apostrophes and ASCII punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(s), "['’]", ""), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def prose(s: Column) -> Column:
    """Markdown without fenced blocks, code spans, URLs, paths and file names. An open fence hides what follows.

    Only \\n ends a line, any white space may stand before a fence, and words and their bounds are ASCII.
    """
    fence, bound = r"^[\t\x0B\f\r \x85\p{Z}]*+```[^\n]*+", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
    out = F.regexp_replace(s, rf"(?dms){fence}\n?(?:.*?{fence}$\n?|.*\z)", "")
    for pattern in (r"`[^`]*`", r"https?://[^\t\n\f\r ]+", r"~?/[\w./@-]+", rf"{bound}[\w-]+\.[a-z]{{2,4}}{bound}"):
        out = F.regexp_replace(out, pattern, " ")
    return out


def shingles(s: Column) -> Column:
    """Distinct runs of five folded ASCII words, one of which is long."""

    def runs(words: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.slice(words, i, SHINGLE))
        kept = F.filter(every, lambda r: F.exists(r, lambda w: F.length(w) >= LONG_WORD))
        joined = F.array_distinct(F.transform(kept, lambda r: F.array_join(r, " ")))
        return F.when(F.size(words) >= SHINGLE, joined).otherwise(F.array().cast("array<string>"))

    # the words are one value of a lambda, or each run would find them anew
    return F.transform(F.array(F.regexp_extract_all(fold(s), F.lit("[a-z0-9]+"), F.lit(0))), runs)[0]


def lines_of(s: Column) -> Column:
    """Lines without trailing blanks, without blank ones."""
    lines = F.split(F.replace(s, F.lit("\r\n"), F.lit("\n")), "\n")
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"[ \t]+$", "")), lambda x: x != "")


def repo_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def session_parts(session: Column, default: str = "claude") -> tuple[Column, Column]:
    """Harness and plain id of a session id with an optional `harness:` prefix."""
    has = session.contains(":")
    return F.when(has, F.substring_index(session, ":", 1)).otherwise(default), F.when(has, F.regexp_replace(session, "^[^:]*:", "")).otherwise(session)


def commas(n: Column) -> Column:
    return F.format_number(n, 0)


def human_tokens(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))
