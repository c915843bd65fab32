"""Tests of names of files, folders, authors and series, as boolean columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import COLLECTION_KEYWORDS, EXTENSION_FOLDERS, FILENAME_BLACKLIST, NO_SERIES_FOLDERS, SERVICE_WORDS, VARIANT_KEYWORDS
from .text import _any_of, fold, split_authors, squeeze

_LOWER = "[а-яёa-z]"


def _lower(words: list[str]) -> list[str]:
    return [w.lower() for w in words]


def contains_word(c: Column, words: list[str] = FILENAME_BLACKLIST) -> Column:
    """Holds one of the words, with no word character beside it."""
    return F.lower(c).rlike(rf"(?U)(?:^|\W)(?:{_any_of(_lower(words))})(?:\W|$)")


def contains_any(c: Column, words: list[str]) -> Column:
    return F.lower(c).rlike(_any_of(_lower(words)))


def is_branding(c: Column, words: list[str] = FILENAME_BLACKLIST) -> Column:
    """Texts of several words must equal an entry; else entries under four
    characters count as whole words, longer ones anywhere."""
    words, low = _lower(words), F.lower(c)
    short, long = [w for w in words if len(w) < 4], [w for w in words if len(w) >= 4]
    one = low.rlike(rf"(?<!{_LOWER})(?:{_any_of(short)})(?!{_LOWER})") | low.rlike(_any_of(long))
    return F.when(F.size(F.split(F.trim(c), r"\s+")) >= 2, F.trim(low).isin(words)).otherwise(one)


def is_mostly_listed(c: Column, share: float = 0.6, words: list[str] = FILENAME_BLACKLIST) -> Column:
    """An entry makes up at least the share of the text."""
    low = F.lower(c)
    return reduce(or_, [low.contains(w) & (F.lit(len(w)) >= share * F.char_length(c)) for w in dict.fromkeys(_lower(words))])


def is_collection(stem: Column) -> Column:
    return contains_any(stem, COLLECTION_KEYWORDS)


def is_anthology(name: Column, authors: Column) -> Column:
    """A collection's name and more than two authors."""
    return is_collection(name) & (F.size(split_authors(authors)) > 2)


def is_valid_author(c: Column) -> Column:
    """Not a number, path or listed name, and with a word of two letters."""
    bare = squeeze(F.regexp_replace(c, r"[,;:!?\-–—()\[\]{}«»\"'`]", " "))
    ok = (F.char_length(c) >= 2) & ~is_mostly_listed(c) & ~bare.rlike(r"(?U)^\d+$") & ~c.rlike(r"[/\\]|\.{2,}")
    return F.coalesce(ok & F.exists(F.split(bare, " "), lambda w: F.char_length(w) > 1), F.lit(False))


def is_incomplete_name(c: Column) -> Column:
    """One word, or with an initial and under two words of three letters."""
    words = F.filter(F.split(squeeze(c), " "), lambda w: w != "")
    initial = F.exists(words, lambda w: w.rlike(r"^\p{L}\.?$"))
    full = F.size(F.filter(words, lambda w: F.char_length(w) > 2))
    return F.coalesce((F.size(words) <= 1) | (initial & (full < 2)), F.lit(True))


def is_person(c: Column, names: list[str]) -> Column:
    """An initial and a surname, or a word of the name lists."""
    initial = c.rlike(r"^\p{Lu}\.\s*\p{Lu}[\p{L}-]+$") | c.rlike(r"^\p{Lu}[\p{L}-]+\s+\p{Lu}\.$")
    listed = F.array(*[F.lit(n.lower().replace("ё", "е")) for n in names]).cast("array<string>")
    return initial | F.arrays_overlap(F.split(fold(squeeze(c)), r"[\s,;]+"), listed)


def is_variant_folder(c: Column) -> Column:
    """Keywords of up to three characters need no letter beside them."""
    words = _lower(VARIANT_KEYWORDS)
    short, long = [w for w in words if len(w) <= 3], [w for w in words if len(w) > 3]
    low = F.lower(c)
    return low.rlike(rf"(?<!{_LOWER})(?:{_any_of(short)})(?!{_LOWER})") | low.rlike(_any_of(long))


def is_no_series_folder(c: Column) -> Column:
    return fold(F.trim(c)).isin(NO_SERIES_FOLDERS)


def has_service_word(c: Column) -> Column:
    return contains_any(c, SERVICE_WORDS)


def without_extension_folders(parts: Column) -> Column:
    return F.filter(parts, lambda p: ~F.lower(p).isin(EXTENSION_FOLDERS))


def is_surname_of(candidate: Column, authors: Column) -> Column:
    """The candidate is an author, a word of one, or an initial with one."""
    low, every = F.lower(F.trim(candidate)), F.transform(split_authors(authors), lambda a: F.lower(F.trim(a)))
    words = F.flatten(F.transform(every, lambda a: F.split(a, r"\s+")))
    return F.array_contains(every, low) | F.array_contains(words, low) | F.array_contains(words, F.regexp_extract(low, r"^\p{L}\.\s*(\p{L}[\p{L}-]+)$", 1))


def title_is_author(title: Column, author: Column) -> Column:
    """Seven tenths of the title's words of three letters or more are the author's."""
    words = lambda c: F.filter(F.array_distinct(F.split(fold(squeeze(c)), r"[\s,.;]+")), lambda w: F.char_length(w) >= 3)
    t = words(title)
    return (F.size(t) > 0) & (F.size(F.array_intersect(t, words(author))) >= 0.7 * F.size(t))
