"""Normalising text, names and paths, as column expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..vocabulary import NAME_PARTICLES, SERIES_CLEANUP_PATTERNS, SERVICE_WORDS, SURNAME_CONVERSIONS, UNKNOWN_AUTHOR


def _chain(c: Column, rules) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, *r), rules, c)


def _any_of(words: list[str]) -> str:
    return "|".join("".join("\\" + ch if ch in r".^$*+?{}[]\|()-" else ch for ch in w) for w in words)


def compose(c: Column) -> Column:
    """The two Cyrillic letters that come decomposed, composed."""
    for base, mark, one in (("е", "̈", "ё"), ("Е", "̈", "Ё"), ("и", "̆", "й"), ("И", "̆", "Й")):
        c = F.replace(c, F.lit(base + mark), F.lit(one))
    return c


def fold(c: Column) -> Column:
    """Composed, lower case, ё as е."""
    return F.translate(F.lower(compose(c)), "ё", "е")


def yo_to_ye(c: Column) -> Column:
    return F.translate(compose(c), "ёЁ", "еЕ")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title_key(c: Column) -> Column:
    """Titles compare without quotes, brackets, case and double spaces."""
    return squeeze(F.regexp_replace(fold(c), "[\"'«»“”„()\\[\\]{}]", ""))


def author_words(c: Column) -> Column:
    """The words of three letters or more, sorted, once each."""
    words = F.split(squeeze(F.regexp_replace(fold(c), r"[.,;]", " ")), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.char_length(w) >= 3)))


def punctuation_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(fold(F.trim(c)), "[:.;,!?«»\"'—–-]+", " "))


def group_key(c: Column) -> Column:
    r"""Punctuation as spaces; ``Root 3\Sub`` as ``root|sub``, but ``Root\Sub``
    stays as it is."""
    root, sub = F.trim(F.substring_index(c, "\\", 1)), F.trim(F.regexp_replace(c, r"^[^\\]*\\", ""))
    bare = F.trim(F.regexp_replace(root, r"\s+\d{1,4}\s*$", ""))
    joined = F.concat_ws("|", punctuation_key(bare), F.nullif(punctuation_key(sub), F.lit("")))
    return F.when(c.contains("\\") & (bare != root), joined).otherwise(punctuation_key(c))


def compare_key(c: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(c, r"[;,()\[\].]", " ")))


_LOOKALIKES = ("ABCEHKMOPTXaceopxy", "АВСЕНКМОРТХасеорху")


def cyrillic_lookalikes(c: Column) -> Column:
    return F.translate(c, *_LOOKALIKES)


def logical_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"(?i)\.fb2(\.zip)?$", "")


def like_ascii(c: Column, pattern: str) -> Column:
    """LIKE that folds the case of ASCII letters only; '%' and '_' are wildcards
    and nothing escapes them."""
    low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in pattern).replace("\\", "\\\\")
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").like(low)


def without_author_suffix(c: Column) -> Column:
    return F.trim(_chain(c, [(r"\s*\([^)]*\)\s*$", ""), (r"\s*\[[^\]]*\]\s*$", "")]))


def title_of_file(stem: Column) -> Column:
    """A file's title: without a number in front, and what follows ' - '."""
    bare = F.regexp_replace(stem, r"^\d+[\s._-]+", "")
    return F.trim(F.when(bare.contains(" - "), F.regexp_replace(bare, r"^.*? - ", "")).otherwise(bare))


def ordered_union(*lists: Column) -> Column:
    """Lists merged, sorted, each entry once."""
    return F.array_sort(F.array_distinct(F.concat(*lists)))


def path_depth(path: Column) -> Column:
    return F.size(F.split(F.translate(path, "\\", "/"), "/")) - 1


def split_authors(c: Column) -> Column:
    """By '; ' if there is one, else by ', '; none for the unknown."""
    none = F.array().cast("array<string>")
    parts = F.when(c.contains("; "), F.split(c, "; ")).otherwise(F.split(c, ", "))
    return F.when(c.isNull() | c.isin("", UNKNOWN_AUTHOR), none).otherwise(parts)


def person_order(c: Column) -> Column:
    """A name of two words, given name first, as surname first."""
    words = F.split(squeeze(c), " ")
    return F.when(F.size(words) == 2, F.concat_ws(" ", words[1], words[0])).otherwise(squeeze(c))


def format_authors(c: Column) -> Column:
    """At most two words each, initials dotted, once each, joined by ', '."""

    def one(name):
        words = F.slice(F.split(squeeze(name), " "), 1, 2)
        return F.array_join(F.transform(words, lambda w: F.when(F.char_length(w) == 1, F.concat(w, F.lit("."))).otherwise(w)), " ")

    return F.array_join(F.array_distinct(F.transform(split_authors(c), one)), ", ")


def capitalise(c: Column) -> Column:
    """Each word's first letter, but for particles; the rest stays."""

    def one(w):
        return F.when(F.lower(w).isin(NAME_PARTICLES), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))

    return F.array_join(F.transform(F.split(c, " "), one), " ")


def convert_surnames(c: Column) -> Column:
    for old, new in SURNAME_CONVERSIONS.items():
        c = F.regexp_replace(c, rf"(?U)(?<!\w){_any_of([old])}(?!\w)", new)
    return c


def surname_stem(c: Column) -> Column:
    """Without Russian endings, taken off twice."""
    return _chain(F.lower(c), [("(ого|ему|ому|ыми|ими|ова|ева|ина|ой|ый|ий|ая|ых|их|ым|им|а|у|е|ы|и|я)$", "")] * 2)


def singular_surname(c: Column) -> Column:
    return F.regexp_replace(c, "[ыи]$", "")


def balance_quotes(c: Column) -> Column:
    count = lambda q: F.char_length(c) - F.char_length(F.replace(c, F.lit(q), F.lit("")))
    return F.concat(c, F.repeat(F.lit("»"), F.greatest(F.lit(0), count("«") - count("»"))))


def comma_before_that(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)([^\s,-])\s+что\b", "$1, что")


def file_name_safe(c: Column) -> Column:
    return _chain(c, [(r'[<>:"/\\|?*]', "_"), (r"[\s.]+$", "")])


def escape_xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def slug(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 12)


_LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya".replace("_", "").split(" ")))


def transliterate(c: Column) -> Column:
    c = F.lower(c)
    for cyr, lat in _LATIN.items():
        c = F.replace(c, F.lit(cyr), F.lit(lat))
    return c


# --- series names -----------------------------------------------------------------------


def series_base(c: Column) -> Column:
    """Without volume numbers at the end; a decimal such as 2.0 stays."""
    return F.trim(_chain(c, [(r"[\s.,-]+\d+\s*-\s*\d+$", ""), (r"(?<!\.)[\s-]+\d+$", ""), (r"\s*[,.]+$", "")]))


def clean_series(c: Column) -> Column:
    """The first level of a series name, without number and service words."""
    service = _any_of([w for w in SERVICE_WORDS if w.isalpha()])
    c = _chain(c, [(r"\s+\d+(-\d+)?\.\s+.*$", ""), (rf"(?iuU)[\s.,(]*\b({service})\b\s*\d*\)?\s*$", "")])
    return series_base(c)


def without_publisher(c: Column) -> Column:
    return squeeze(_chain(c, [(p if p.startswith("(?") else "(?iu)" + p, " ") for p in SERIES_CLEANUP_PATTERNS]))


def series_levels(c: Column) -> Column:
    r"""``A 1. B 2. C 3`` as ``A\B\C``."""
    parts = F.filter(F.split(c, r"(?<=\d)\.\s+"), lambda x: x != "")
    return F.array_join(F.transform(parts, series_base), "\\")


def folder_series(c: Column) -> Column:
    """A folder's series: no leading number, no author in brackets."""
    return F.trim(_chain(c, [(r"^\d{1,3}[.)]\s+", ""), (r"(?U)\s*\([\p{Lu}][^()]*\)\s*$", "")]))


def display_series(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit(". "))


# --- bodies of books --------------------------------------------------------------------

_PREFACE = r"(?iuU)предисловие|вступлени[ея]|от\s+автор|от\s+переводчик|foreword|preface|introduction|аннотаци[яи]|copyright|копирайт|все\s+права"
_BOILERPLATE = r"(?iuU)https?://\S+|©[^©\n]{1,120}|выпуск\s+произведения[^©\n]*|isbn[\s:]*[\d\-–—Xx]{5,}"


def opening_text(xml: Column, most: int = 2000) -> Column:
    """The first characters of a book's body as plain text, from the first
    section that isn't a preface, without links and notices."""
    body = F.regexp_replace(xml, r"(?is)^.*?<(?:fb:)?body(?!\s[^>]*\bname\s*=)[^>]*>", "")
    sections = F.split(body, r"(?i)(?=<(?:fb:)?section[^>]*>)")
    title = lambda s: F.regexp_replace(F.regexp_extract(F.substring(F.regexp_replace(s, r"(?i)^<(?:fb:)?section[^>]*>", ""), 1, 400), r"(?is)<(?:fb:)?title[^>]*>(.*?)</(?:fb:)?title>", 1), "<[^>]+>", "")
    said = F.transform(sections, lambda s, i: F.when(s.rlike(r"(?i)^<(?:fb:)?section") & ~title(s).rlike(_PREFACE), i))
    first = F.coalesce(F.array_min(said), F.lit(0))
    text = F.array_join(F.slice(sections, first + 1, F.size(sections)), "")
    return F.substring(squeeze(_chain(text, [("<[^>]+>", " "), (_BOILERPLATE, " ")])), 1, most)


def book_bodies(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"(?is)<(?:fb:)?body\b[^>]*>(.*?)</(?:fb:)?body>"), F.lit(1))


def book_images(xml: Column) -> Column:
    """The binaries of a book, whole, each once."""
    return F.array_distinct(F.regexp_extract_all(xml, F.lit(r"(?is)<(?:fb:)?binary\b[^>]*>.*?</(?:fb:)?binary>"), F.lit(0)))


def title_without_series(title: Column, series: Column) -> Column:
    """For finding doubles: a title without its series in front."""
    t, s = fold(F.trim(nfkc(title))), fold(F.trim(nfkc(series)))
    after = lambda sep: t.startswith(F.concat(s, F.lit(sep)))
    return F.when(after(". "), F.substr(t, F.char_length(s) + 3)).when(after(" "), F.substr(t, F.char_length(s) + 2)).otherwise(t)


# --- what has no native form ------------------------------------------------------------


@F.pandas_udf(StringType())
def nfkc(c: pd.Series) -> pd.Series:
    return c.str.normalize("NFKC")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
