"""Volume numbers, ranges and sort keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import SERIES_SIZES

_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def strict_int(c: Column) -> Column:
    """Text that is an integer and nothing else, or null."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c)).try_cast("bigint")


def leading_int(c: Column) -> Column:
    """What a lenient cast makes of text: its leading number, else 0."""
    digits = F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1), F.lit(""))
    most = F.when(digits.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return F.coalesce(F.when(digits.isNotNull(), F.coalesce(digits.try_cast("bigint"), most)), F.lit(0))


def roman_to_int(c: Column) -> Column:
    values = F.create_map(*[x for k, v in _ROMAN.items() for x in (F.lit(k), F.lit(v))])
    letters = F.reverse(F.filter(F.split(F.upper(c), ""), lambda x: x != ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))

    def step(a, x):
        v = values[x]
        return F.struct((a["total"] + F.when(v < a["last"], -v).otherwise(v)).alias("total"), v.alias("last"))

    return F.when(F.upper(c).rlike("^[IVXLCDM]+$"), F.aggregate(letters, start, step, lambda a: a["total"]))


def number_prefix(stem: Column) -> Column:
    return F.nullif(F.regexp_extract(stem, r"^(\d{1,3})[_-]", 1), F.lit("")).cast("int")


def _number(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).cast("int")


def inline_volume(c: Column) -> Column:
    """A volume keyword's number: plain, a sum such as 12+1, or roman."""
    word = r"(?iuU)\b(?:том|книга|часть|выпуск|volume|vol|book|part)\.?\s+"
    a, b = _number(c, word + r"(\d{1,3})"), _number(c, word + r"\d{1,3}\s*\+\s*(\d{1,3})")
    return F.coalesce(a + F.coalesce(b, F.lit(0)), roman_to_int(F.nullif(F.regexp_extract(c, word + r"([IVXLCDMivxlcdm]+)\b", 1), F.lit(""))))


def volume_range(c: Column) -> Column:
    """(lo, hi) of ``3-7``, ``7`` or null."""
    lo, hi = _number(c, r"(\d{1,3})\s*[-–—]\s*\d{1,3}"), _number(c, r"\d{1,3}\s*[-–—]\s*(\d{1,3})")
    one = _number(c, r"^\D*(\d{1,3})\D*$")
    return F.when(lo.isNotNull() & (lo < hi), F.struct(lo.alias("lo"), hi.alias("hi"))).when(one.isNotNull(), F.struct(one.alias("lo"), one.alias("hi")))


def sort_key(series_number: Column, stem: Column, title: Column) -> Column:
    """(level, primary, secondary, source): the first source that knows."""

    def at(level, source, primary, secondary=None):
        second = F.lit(0) if secondary is None else F.coalesce(secondary, F.lit(0))
        return F.when(primary.isNotNull(), F.struct(F.lit(level).alias("level"), primary.alias("primary"), second.alias("secondary"), F.lit(source).alias("source")))

    spans = volume_range(series_number)
    return F.coalesce(
        at(0, "series_number", spans["lo"]),
        at(1, "filename", number_prefix(stem)),
        at(1, "dot_part", _number(stem, r"(?<!\d)(\d{1,3})\.\d{1,2}(?!\d)"), _number(stem, r"(?<!\d)\d{1,3}\.(\d{1,2})(?!\d)")),
        at(2, "inline_title", inline_volume(title)),
        at(3, "title_date", _number(title, r"(?<!\d)((?:19|20)\d{2})(?!\d)")),
        F.struct(F.lit(9).alias("level"), F.lit(0).alias("primary"), F.lit(0).alias("secondary"), F.lit("unknown").alias("source")),
    )


def series_suffix(lo: Column, hi: Column, n: Column, complete: Column) -> Column:
    """What a compilation of volumes lo to hi is called."""
    names = F.array(*[F.lit(x) for x in SERIES_SIZES])
    whole = complete & (lo == 1) & n.between(2, len(SERIES_SIZES))
    in_books = F.concat(F.lit("в "), n.cast("string"), F.lit(" книгах"))
    return F.when(whole, F.element_at(names, F.least(F.greatest(n, F.lit(1)), F.lit(len(SERIES_SIZES))).cast("int"))).when(complete & (lo == 1), in_books).otherwise(F.concat(F.lit("т. "), lo.cast("string"), F.lit("-"), hi.cast("string")))


def runs_text(numbers: Column) -> Column:
    """``lo-hi`` of a gapless set of numbers, one number alone, else ''."""
    lo, hi = F.array_min(numbers), F.array_max(numbers)
    text = F.when(lo == hi, lo.cast("string")).otherwise(F.concat(lo.cast("string"), F.lit("-"), hi.cast("string")))
    return F.coalesce(F.when(F.size(F.array_distinct(numbers)) == hi - lo + 1, text), F.lit(""))
