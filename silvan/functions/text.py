"""Text functions as Column expressions. White space is Unicode white space, as (?U) makes it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from silvan.functions.arrays import let, sums_before

SPACES = r"(?U)\s+"
#: What ends a sentence, at the end of a word: a fixed value.
SENTENCE_END = r"[.!?;:]['\")\]]*$"
#: Values of Roman digits: fixed values.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
#: Ordinal words up to nineteen and the tens: fixed values.
UNITS = "One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen Fourteen Fifteen Sixteen Seventeen Eighteen Nineteen".split()
TENS = "Twenty Thirty Forty Fifty Sixty Seventy Eighty Ninety".split()


def collapse_spaces(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(collapse_spaces(text), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text, none for null or blank."""
    clean = F.coalesce(collapse_spaces(text), F.lit(""))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_spans(text: Column) -> Column:
    """array<struct<start, end>>: offsets of each word in the collapsed text."""
    span = lambda starts: lambda n, i: F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + n).alias("end"))
    of = lambda sizes: let(sums_before(F.transform(sizes, lambda n: n + 1)), lambda starts: F.transform(sizes, span(starts)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return let(F.transform(words(text), F.length), lambda sizes: F.when(F.size(sizes) > 0, let(sizes, of)).otherwise(none))


def ends_sentence(word: Column) -> Column:
    return word.rlike(SENTENCE_END)


def token_estimate(n_words: Column, least: int = 1) -> Column:
    """1.3 tokens to a word, rounded down."""
    return F.greatest(F.floor(n_words * 13 / 10), F.lit(least)).cast("long")


def slug(text: Column) -> Column:
    """Letters and digits in lower case, all else as single hyphens inside."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def first_integer(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).cast("int")


def roman_to_int(text: Column) -> Column:
    """A smaller digit before a larger one counts against it. Null if the text is no Roman numeral."""
    value = F.create_map(*(F.lit(x) for kv in ROMAN.items() for x in kv))
    digits = F.transform(F.filter(F.split(F.upper(F.trim(text)), ""), lambda c: c != ""), lambda c: F.element_at(value, c))
    step = lambda a, v: F.struct((a["sum"] + F.when(v < a["last"], -v).otherwise(v)).alias("sum"), F.greatest(a["last"], v).alias("last"))
    total = F.aggregate(F.reverse(digits), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), step, lambda a: a["sum"])
    return F.when(F.upper(F.trim(text)).rlike("^[IVXLCDM]+$"), total)


def ordinal_word_to_int(text: Column) -> Column:
    """One to Ninety Nine, with a space or hyphen between tens and units."""
    named = {w: i + 1 for i, w in enumerate(UNITS)} | {t: 20 + 10 * i for i, t in enumerate(TENS)}
    value = F.create_map(*(F.lit(x) for w, n in named.items() for x in (w.lower(), n)))
    parts = F.split(F.lower(F.trim(text)), r"[\s-]+")
    return F.aggregate(parts, F.lit(0), lambda a, w: a + F.element_at(value, w))


def strip_tags(html: Column) -> Column:
    return collapse_spaces(F.regexp_replace(html, r"<[^>]+>", " "))


def table_cell(html: Column, nth: int) -> Column:
    """Text of the nth table cell, null if there is none."""
    cell = F.try_element_at(F.regexp_extract_all(html, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), F.lit(nth))
    return strip_tags(cell)


def strip_envelope(text: Column, start: str = r"\*\*\* ?START[^\n]*", end: str = r"\*\*\* ?END") -> Column:
    """What stands between the line of the start mark and the end mark; without marks, all of it. Both marks are looked for in
    the whole text, so the tail can't survive. Blank lines go at both ends; the first line keeps its indentation."""
    head = F.regexp_replace(text, rf"(?s)^.*?{start}\n?", "")
    return F.regexp_replace(F.regexp_replace(head, rf"(?s){end}.*$", ""), r"^(?:[^\S\n]*\n)+|\s+$", "")


def section_parts(title: Column, default: str = "Main") -> tuple[Column, Column]:
    """Section and subsection on either side of the first ' - '."""
    parts = F.split(title, " - ", 2)
    return F.trim(parts[0]), F.coalesce(F.nullif(F.trim(F.try_element_at(parts, F.lit(2))), F.lit("")), F.lit(default))


def span_label(first: Column, last: Column) -> Column:
    return F.when(first.isNotNull() & last.isNotNull() & (first != last), F.concat(first, F.lit(" - "), last)).otherwise(F.coalesce(first, last))


def child_path(parent: Column, label: Column, key: Column) -> Column:
    return F.concat(F.coalesce(parent, F.lit("")), F.lit("/"), F.coalesce(F.nullif(label, F.lit("")), key))


def span_path(paths: Column) -> Column:
    """The path of a span is that of its first unit. paths: of its units in order."""
    return F.get(paths, F.lit(0))


def run_id(time: Column) -> Column:
    """A run's name from its time: 2026-04-13_213715."""
    return F.date_format(time, "yyyy-MM-dd_HHmmss")


def iso_time(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def name_hash(name: Column) -> Column:
    """h = (31 * h + code) mod 65536 over the characters of the basic plane."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda h, c: (h * 31 + c).bitwiseAND(0xFFFF))


def natural_key(text: Column, width: int = 12) -> Column:
    """Sorts as text with its digits as numbers: runs of digits are padded with zeros."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, width, "0")).otherwise(p)), "")


def score_band(score: Column, high: float = 0.75, middle: float = 0.5) -> Column:
    return F.when(score >= high, "high").when(score >= middle, "medium").otherwise("low")


def with_prefix(text: Column, task: str) -> Column:
    """The task's prefix that the encoder expects: search_query or search_document."""
    return F.concat(F.lit(f"{task}: "), text)
