"""Text functions as Column expressions: normalising, titles, tokens, windows, slugs."""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` names it: as a lambda's variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space, ideographic and no-break spaces included, become one space."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s 　]+", " "))


def clean_text(text: Column) -> Column:
    for old, new in (("+", " "), ("（ ", "（"), (" ）", "）"), ("《 ", "《"), (" 》", "》")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return normalize_whitespace(text)


def normalize_title(title: Column) -> Column:
    """Without a version suffix of eight digits and without an outer pair of title marks."""
    title = clean_text(F.replace(F.regexp_replace(title, r"_\d{8}$", ""), F.lit("_"), F.lit(" ")))
    return F.when(title.startswith("《") & title.endswith("》"), F.trim(F.substring(title, F.lit(2), F.length(title) - 2))).otherwise(title)


def title_aliases(title: Column, prefix: str = "中华人民共和国") -> Column:
    """The normalised title, and its short form without the state's name."""
    full = normalize_title(title)
    return F.filter(F.array_distinct(F.array(full, F.trim(F.regexp_replace(full, "^" + prefix, "")))), lambda x: x != "")


def cross_references(text: Column) -> Column:
    """Distinct normalised titles between title marks, in order."""
    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"《([^》\n]{2,120})》"), F.lit(1)), normalize_title)), lambda x: x != "")


#: Headings of articles and of what holds them, at the start of a line.
ARTICLE, SECTION = (rf"^第([一二三四五六七八九十百千万零〇两\d]+){x}" for x in ("条", "(编|章|节)"))


def article_heading(text: Column) -> Column:
    return F.nullif(F.regexp_extract(clean_text(text), ARTICLE, 0), F.lit(""))


def section_heading(text: Column) -> Column:
    return F.nullif(F.regexp_extract(clean_text(text), SECTION, 0), F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and _, then CJK characters, then pairs of CJK characters."""
    pairs = lambda han: F.when(F.size(han) > 1, F.transform(F.sequence(F.lit(0), F.size(han) - 2), lambda i: F.concat(F.get(han, i), F.get(han, i + 1))))
    both = lambda han: F.concat(han, F.coalesce(pairs(han), F.array().cast("array<string>")))
    return bind(clean_text(text), lambda t: F.concat(word_tokens(t), bind(F.regexp_extract_all(t, F.lit("([一-鿿])"), F.lit(1)), both)))


def word_tokens(text: Column) -> Column:
    """The ASCII part of ``tokens``."""
    return F.regexp_extract_all(F.lower(text), F.lit("([0-9a-z_]+)"), F.lit(1))


def truncate_text(text: Column, size: int = 320) -> Column:
    text = clean_text(text)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, size - 1), "[ ，,；;：:]+$", ""), F.lit("…")))


def safe_slug(text: Column, default: str = "document") -> Column:
    slug = F.regexp_replace(F.regexp_replace(text, "[^0-9A-Za-z一-鿿]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", F.lit(default)).otherwise(slug)


def char_windows(text: Column, size: int = 900, overlap: int = 120) -> Column:
    """Overlapping windows of the characters of the cleaned text, trimmed; one window if the text fits, none without text.

    The text is cut once into pieces as long as the greatest common divisor of window and step, so time is linear in its length.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window")
    step = size - overlap
    width = gcd(size, step)
    whole, each = size // width, step // width

    def windows(pieces: Column) -> Column:
        n = F.when(F.size(pieces) <= whole, 1).otherwise(F.ceil((F.size(pieces) - whole) / each).cast("int") + 1)
        return F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.trim(F.array_join(F.slice(pieces, k * each + 1, whole), ""))), lambda w: w != "")

    pieces = F.regexp_extract_all(clean_text(text), F.lit(f"(?s)(.{{1,{width}}})"), F.lit(1))
    return bind(pieces, windows)


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2).cast("int"))


def join_non_empty(parts: Column) -> Column:
    """The trimmed parts that are not empty, a line each."""
    return F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), "\n")


def dedupe_strings(values: Column) -> Column:
    """Trimmed, without empty ones, each once in order of first sight."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))


def contains_any(text: Column, hints: tuple[str, ...]) -> Column:
    """Whether the text holds one of the hints, as plain strings."""
    return F.coalesce(text.rlike("|".join("\\Q" + h + "\\E" for h in hints)), F.lit(False))


def bag_overlap(a: Column, b: Column) -> Column:
    """The size of the intersection of two bags of tokens."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    shared = lambda a, b: F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return bind(a, lambda a: bind(b, lambda b: shared(a, b)))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two bags of tokens; 0 where one is empty or nothing is shared."""
    f1 = lambda a, b, shared: F.when((F.size(a) == 0) | (F.size(b) == 0) | (shared == 0), 0.0).otherwise(2 * (shared / F.size(a)) * (shared / F.size(b)) / (shared / F.size(a) + shared / F.size(b)))
    return bind(a, lambda a: bind(b, lambda b: bind(bag_overlap(a, b).cast("double"), lambda shared: f1(a, b, shared))))


#: Fixed value: what is left out when answers are compared.
ANSWER_MARKS = r"[\s，。、“”‘’：:；;,！!？?（）()【】\[\]《》<>]+"


def normalize_answer(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), ANSWER_MARKS, ""))


def exact_match(a: Column, b: Column) -> Column:
    return bind(normalize_answer(a), lambda a: F.when((a != "") & (a == normalize_answer(b)), 1.0).otherwise(0.0))
