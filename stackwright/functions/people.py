"""Person names: their parts, their order, and lists of them, as column expressions.

Lists of given names (lower case, ё as е) are a parameter; none is shipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import (
    ANTHOLOGY, COLLECTION_KEYWORDS, COLLECTIVE_NAMES, FOLDER_CATEGORY_STARTS, INNER_SURNAME_ENDINGS, NAME_PARTICLES, NAME_SUFFIXES, NON_AUTHOR_WORDS,
    SHARED_SURNAME_ENDINGS, SURNAME_ENDINGS, SWAPPED_SURNAME_ENDINGS, UNKNOWN_AUTHOR,
)
from ..staging import cut
from .predicates import is_valid_author
from .text import _any_of, convert_surnames, split_authors, squeeze

_PARTS = "struct<last string, first string, patronymic string>"
_PATRONYMIC = "(?:ович|евич|овна|евна)$"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def listed(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _span(words: Column, start, end) -> Column:
    """The words from one place up to another, as one string."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.nullif(F.array_join(F.slice(words, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int")), " "), F.lit(""))


def _first_place(words: Column, test) -> Column:
    """The place of the first word that a test holds for."""
    return F.array_min(F.transform(words, lambda w, i: F.when(test(w), i)))


def _name(last, first, patronymic=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(last.alias("last"), (none if first is None else first).alias("first"), (none if patronymic is None else patronymic).alias("patronymic"))


def _vowels(w: Column) -> Column:
    return F.char_length(F.regexp_replace(F.lower(w), "[^aeiouаеёиоуыэюя]", "")) / F.char_length(w)


def name_parts(c: Column, given: list[str] = ()) -> Column:
    """struct(last, first, patronymic) of one person's name, nulls where the
    name has none; null for what is no name.

    Kept whole: a surname with dotted initials, and a pseudonym of one word with
    a name in brackets.  Otherwise brackets go, single letters go, a patronymic
    and suffixes are taken off the end.  From a particle on (de, van) all is
    surname.  Of two words the one that isn't a listed given name is the surname;
    if that doesn't tell, the one with a surname's ending, then the one with
    fewer vowels, then the second.  Of more words a patronymic or an initial
    inside parts given names from the surname; then a word inside with a
    surname's ending is it; without any listed name at either end the first word
    is the surname and the rest are given names; else the last word is it."""
    raw = F.translate(F.trim(c), "ё", "е")
    known = listed(list(given))
    is_given = lambda w: F.array_contains(known, F.lower(w))
    ends = lambda w, xs: F.lower(F.right(w, F.lit(2))).isin(xs)
    patronymic = lambda w: F.lower(w).rlike(_PATRONYMIC)

    def of_two(w: Column, p: Column) -> Column:
        a, b = F.get(w, 0), F.get(w, 1)
        a_first, b_first = _name(a, b, p), _name(b, a, p)
        return (
            F.when(is_given(a) & ~is_given(b), b_first).when(is_given(b) & ~is_given(a), a_first)
            .when(ends(a, SURNAME_ENDINGS) & ~ends(b, SURNAME_ENDINGS), a_first).when(ends(b, SURNAME_ENDINGS) & ~ends(a, SURNAME_ENDINGS), b_first)
            .when(_vowels(a) < _vowels(b), a_first).otherwise(b_first)
        )

    def of_more(w: Column, p: Column) -> Column:
        n = F.size(w)
        first, second, last = F.get(w, 0), F.get(w, 1), F.get(w, n - 1)
        inner = F.filter(F.slice(w, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda x: ends(x, INNER_SURNAME_ENDINGS))
        at = _first_place(w, patronymic)
        return (
            F.when(at >= 1, _name(last, _span(w, 0, at), F.get(w, at)))
            .when((n == 3) & (F.char_length(first) <= 2) & first.endswith("."), _name(last, _span(w, 0, 2), p))
            .when((F.char_length(second) <= 3) & second.endswith("."), _name(last, _span(w, 0, 2), p))
            .when(F.size(inner) > 0, _name(F.get(inner, 0), first, p))
            .when(~is_given(first) & ~is_given(last), _name(first, _span(w, 1, n), p))
            .otherwise(_name(last, first, p))
        )

    def of_words(w: Column, p: Column) -> Column:
        n, particle = F.size(w), _first_place(w, lambda x: F.lower(x).isin(NAME_PARTICLES))
        return (
            F.when(n == 0, _name(F.lit(None).cast("string"), None, p)).when(n == 1, _name(F.get(w, 0), None, p))
            .when(particle.isNotNull(), _name(_span(w, particle, n), _span(w, 0, particle), p))
            .when(n == 2, of_two(w, p)).otherwise(of_more(w, p))
        )

    def of_text(w: Column) -> Column:
        named = (F.size(w) > 1) & patronymic(F.get(w, F.size(w) - 1))
        body = F.when(named, F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w)
        # Suffixes at the end: what follows the last word that is none.
        keep = F.coalesce(F.array_max(F.transform(body, lambda x, i: F.when(~F.lower(x).isin(NAME_SUFFIXES), i))) + 1, F.lit(0))
        p = F.when(named, F.get(w, F.size(w) - 1))
        return F.when(F.size(w) == 1, _name(F.get(w, 0), None)).otherwise(let(F.slice(body, F.lit(1), keep), lambda b: of_words(b, p)))

    inner, main = F.nullif(F.trim(F.regexp_extract(raw, r"\(([^)]+)\)", 1)), F.lit("")), F.trim(F.regexp_replace(raw, r"\([^)]*\)", ""))
    whole = raw.rlike(r"^[А-Яа-яЁё]+\s+[А-Яа-яЁё]\.\s*([А-Яа-яЁё]\.)?$") | (inner.isNotNull() & (F.size(words_of(main)) == 1))
    text = F.when(main == "", F.coalesce(inner, F.lit(""))).otherwise(main)
    parts = let(F.filter(words_of(text), lambda w: F.char_length(w) > 1), lambda w: F.when(F.size(w) > 0, of_text(w)))
    return F.when(is_valid_author(raw), F.when(whole, _name(raw, None)).otherwise(parts)).cast(_PARTS)


def name_completeness(c: Column, given: list[str] = ()) -> Column:
    """How many of surname, given name and patronymic a name has."""
    return let(name_parts(c, given), lambda p: sum((F.when(p[f].isNotNull(), 1).otherwise(0) for f in ("last", "first", "patronymic")), F.lit(0)))


def normal_name(c: Column, given: list[str] = ()) -> Column:
    """``Surname Given Patronymic``; '' for what is no name, an anthology for
    collective authors."""
    joined = let(name_parts(c, given), lambda p: F.concat_ws(" ", p["last"], p["first"], p["patronymic"]))
    return F.when(F.lower(F.trim(c)).isin(COLLECTIVE_NAMES), ANTHOLOGY).otherwise(F.coalesce(joined, F.lit("")))


def author_count(c: Column) -> Column:
    return F.size(F.filter(split_authors(c), lambda a: F.trim(a) != ""))


def metadata_list(c: Column) -> Column:
    """Authors of metadata, between semicolons or commas."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda a: (a != "") & (a != UNKNOWN_AUTHOR))


def normal_names(names: DataFrame, given: list[str] = ()) -> DataFrame:
    """name, normal of the distinct names of ``names`` (name); what is no name
    stays as it is.  Parsing is done once a name, so callers join."""
    name = F.col("name")
    person = is_valid_author(F.translate(name, "ё", "е")) | F.lower(name).isin(COLLECTIVE_NAMES)
    return names.select("name").filter("name is not null").distinct().select("name", F.when(person, normal_name(name, given)).otherwise(name).alias("normal"))


def with_initials(raw: Column, normal: Column) -> Column:
    """The normal form, unless it has lost initials."""
    has_initial = normal.rlike(r"(?U)\b[А-ЯЁA-Z]\.?(?:\s|$)")
    return F.when((F.size(words_of(normal)) < F.size(words_of(raw))) & ~has_initial, raw).otherwise(normal)


def _by_surname(names: Column) -> Column:
    return F.transform(F.array_sort(F.transform(names, lambda a: F.struct(F.lower(squeeze(a)).alias("k"), a.alias("a")))), lambda x: x["a"])


def joined_names(authors: Column, known: Column, metadata: Column) -> Column:
    """One or more authors as ``Surname Given``, several sorted and joined by
    ', '.  ``known`` has the authors, ``metadata`` the metadata's, each a struct
    (name, normal); the metadata completes a lone word, and restores the others
    where it lists several authors and one of them is meant."""
    lone = lambda x: F.size(words_of(x)) == 1

    def one_of_several(a: Column) -> Column:
        full = F.get(F.filter(metadata, lambda m: lone(a["name"]) & F.array_contains(words_of(m["name"]), a["name"])), 0)

        def normal(x: Column) -> Column:
            turned = (x["normal"] == x["name"]) & (F.size(words_of(x["name"])) == 2) & F.lower(x["name"]).rlike(f"(?:{_any_of(SWAPPED_SURNAME_ENDINGS)})$")
            return F.when(turned, F.concat_ws(" ", F.get(words_of(x["name"]), 1), F.get(words_of(x["name"]), 0))).otherwise(x["normal"])

        return let(F.coalesce(full, a), normal)

    def alone(a: Column) -> Column:
        bare = lambda w: F.regexp_replace(F.translate(F.lower(w), "ё", "е"), r"\.+$", "")
        m, low, name = F.get(metadata, 0), F.translate(F.lower(a["name"]), "ё", "е"), a["name"]
        words = words_of(m["name"])
        same = (F.size(metadata) == 1) & lone(name) & (F.size(words) > 1) & ((bare(F.get(words, 0)) == low) | (bare(F.element_at(words, -1)) == low))
        shared = (F.size(metadata) > 1) & F.exists(metadata, lambda x: F.arrays_overlap(words_of(F.lower(x["name"])), words_of(F.lower(name))))
        everyone = F.array_join(F.array_sort(F.transform(metadata, lambda x: x["normal"])), ", ")
        fuller = F.when(F.size(words_of(m["normal"])) < F.size(words), m["name"]).otherwise(m["normal"])
        return F.when(shared, everyone).when(same, fuller).otherwise(with_initials(name, a["normal"]))

    others = authors.rlike(r"(?iuU)\s(?:и\s+другие|и\s+др\.?|et\s+al\.?)\s*$")
    several = F.array_join(_by_surname(F.transform(known, one_of_several)), ", ")
    return F.when(authors.isin("", ANTHOLOGY) | others | (F.size(known) == 0), authors).when(authors.contains("; ") | authors.contains(", "), several).otherwise(alone(F.get(known, 0)))


def normal_authors(df: DataFrame, key: str, authors: Column, metadata: Column, given: list[str] = ()) -> DataFrame:
    """key, normal: the authors of each row in their normal form."""
    both = lambda a, m: F.array(F.struct(F.lit("a").alias("kind"), a.alias("names")), F.struct(F.lit("m").alias("kind"), m.alias("names")))
    own = F.filter(F.transform(split_authors(authors), lambda x: F.trim(x)), lambda a: a != "")
    rows = df.select(F.col(key).alias("__key"), F.explode(both(own, metadata_list(metadata))).alias("x")).select("__key", "x.kind", F.posexplode("x.names").alias("pos", "name"))
    rows = cut(rows)
    rows = rows.join(cut(normal_names(rows, given)), "name")
    # Of each row, its authors and its metadata's, in their order.
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "name", "normal")))), lambda x: F.struct(x["name"].alias("name"), x["normal"].alias("normal")))
    known = rows.groupBy("__key").agg(of("a").alias("known"), of("m").alias("said"))
    return df.select(F.col(key).alias("__key"), authors.alias("__authors")).join(known, "__key").select(F.col("__key").alias(key), joined_names(F.col("__authors"), F.col("known"), F.col("said")).alias("normal"))


def distinct_names(names: Column) -> Column:
    """Each name once, at its first place; case and ё don't tell names apart."""
    key = lambda x: F.translate(F.lower(F.trim(x)), "ё", "е")
    return let(F.transform(names, key), lambda k: F.filter(F.transform(names, lambda x: F.trim(x)), lambda x, i: F.array_position(k, key(x)) == i + 1))


def looks_like_author(c: Column, given: list[str] = ()) -> Column:
    """Begins with a letter, ends with neither dot nor comma, and has no word of
    kinds of books.  Several words are at most three capital ones that aren't
    words of collections, or hold a listed name or a particle (any, if no names
    are listed)."""
    words, low = words_of(c), words_of(F.lower(c))
    proper = F.forall(words, lambda w: w.rlike(r"^\p{Lu}")) & (F.size(words) <= 3) & ~F.arrays_overlap(low, listed([k.lower() for k in COLLECTION_KEYWORDS]))
    names = F.arrays_overlap(low, listed([*given, *NAME_PARTICLES])) if given else F.lit(True)
    ok = (F.char_length(c) >= 2) & ~c.rlike(r"[.,]$") & c.rlike(r"^\p{L}") & ~F.arrays_overlap(low, listed(NON_AUTHOR_WORDS))
    return F.coalesce(ok & ((F.size(words) <= 1) | proper | names), F.lit(False))


def shared_surname_root(c: Column) -> Column:
    """A surname without the endings that tell one bearer from several."""
    last = F.lower(F.element_at(words_of(c), -1))
    return F.regexp_replace(last, f"(?:{_any_of(SHARED_SURNAME_ENDINGS)})$", "")


def family_name_first(full: Column, surname: Column) -> Column:
    """The name with its word ``surname`` in front."""
    at = F.array_position(words_of(F.lower(full)), F.lower(surname))
    return F.concat_ws(" ", F.get(words_of(full), (at - 1).cast("int")), F.array_join(F.filter(words_of(full), lambda w, i: i != at - 1), " "))


def from_metadata(author: Column, metadata: Column) -> Column:
    """The metadata's authors that bear the first word of a short name, that
    word in front, joined by ', '; the name itself if there are none."""
    first = F.get(words_of(author), 0)
    found = F.filter(metadata_list(metadata), lambda m: F.array_contains(words_of(F.lower(m)), F.lower(first)))
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda m: F.rtrim(family_name_first(m, first))), ", ")).otherwise(author)


def spelt_initials(author: Column, metadata: Column) -> Column:
    """``X.Surname`` tokens as the metadata's author of that surname with a
    name in X; others as they are."""

    def one(part: Column) -> Column:
        initial, surname = F.lower(F.substring(part, 1, 1)), F.lower(F.substr(part, F.lit(3)))
        fits = lambda m: F.array_contains(words_of(F.lower(m)), surname) & F.exists(words_of(F.lower(m)), lambda w: w.startswith(initial) & (w != surname))
        return F.when(part.rlike(r"^\p{Lu}\.\p{Lu}"), F.coalesce(F.get(F.filter(metadata_list(metadata), fits), 0), part)).otherwise(part)

    return F.array_join(F.transform(F.filter(F.transform(F.split(author, ","), lambda x: F.trim(x)), lambda p: p != ""), one), ", ")


def folder_author(c: Column, given: list[str] = ()) -> Column:
    r"""The author that a folder's name tells, authors joined by '; ', or ''.

    ====================================  =======================================
    begins like a category                 none
    ``Surnames A и B``                     ``Surname A; Surname B``
    a comma, no brackets                   all of it
    two words, no brackets                 both
    brackets with a comma at the end       what the first brackets hold
    a person, then brackets at the end     the person (brackets hold a pseudonym)
    brackets at the end                    what the last brackets hold
    brackets, then text                    the text
    ``A - text`` without quotes            A without brackets
    ====================================  ======================================="""
    name = F.trim(c)
    plain = squeeze(F.regexp_replace(name, r"\s*\[[^\]]*\]\s*", " "))
    inside = F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda x: squeeze(F.regexp_replace(x, r"\s*\[[^\]]*\]\s*", " ")))
    n = F.size(inside)
    before, after = F.trim(F.regexp_extract(name, r"^([^(]*)", 1)), F.trim(F.regexp_extract(name, r"\)([^)]*)$", 1))
    starts, closed = name.startswith("("), (n > 0) & (after == "")
    at_end = closed & ~starts
    comma_inside = F.exists(F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda x: x.contains(","))
    pair = F.split(plain, " и ")
    family = (F.size(pair) == 2) & (F.size(words_of(F.get(pair, 0))) >= 2) & (F.size(words_of(F.get(pair, 1))) == 1)
    surname = F.regexp_replace(F.get(words_of(F.get(pair, 0)), 0), "[ыи]$", "")
    both = F.concat(surname, F.lit(" "), _span(words_of(F.get(pair, 0)), 1, F.size(words_of(F.get(pair, 0)))), F.lit("; "), surname, F.lit(" "), F.trim(F.get(pair, 1)))
    person = (F.size(words_of(before)) == 2) & F.arrays_overlap(F.transform(words_of(F.lower(before)), lambda w: F.regexp_replace(w, "^[.,;]+|[.,;]+$", "")), listed(list(given)))
    tail = F.trim(F.regexp_extract(name, r"^.*? - (.*)$", 1))
    category = F.lower(name).rlike("^(?:" + _any_of([w.lower() for w in [*COLLECTION_KEYWORDS, *FOLDER_CATEGORY_STARTS]]) + ")")
    semicolons = lambda x: F.replace(x, F.lit(", "), F.lit("; "))
    found = (
        F.when(category, "").when((n == 0) & family, both).when((n == 0) & plain.contains(","), semicolons(plain)).when((n == 0) & (F.size(words_of(name)) == 2), plain)
        .when(at_end & comma_inside, semicolons(F.get(inside, 0))).when(at_end & (n == 1) & person, before).when(at_end, F.get(inside, n - 1))
        .when((n == 1) & starts & (after != ""), after)
        .when(name.contains(" - ") & ~tail.rlike("[«»]"), F.trim(F.regexp_replace(F.substring_index(plain, " - ", 1), r"\s*\([^)]*\)", "")))
        .when((n > 0) & (before != ""), before).otherwise("")
    )
    return F.coalesce(F.trim(found), F.lit(""))


def has_known_name(c: Column, given: list[str]) -> Column:
    """An initial and a surname, or a listed word."""
    initials = c.rlike(r"^\p{Lu}\.\s*(?:\p{Lu}\.\s*)?\p{Lu}[\p{L}-]+$") | c.rlike(r"^\p{Lu}[\p{L}-]+\s+\p{Lu}\.(?:\s*\p{Lu}\.)?$")
    return initials | F.arrays_overlap(F.split(F.translate(F.lower(c), "ё", "е"), r"[\s,;]+"), listed(list(given)))


def converted(c: Column) -> Column:
    """Every author of the list under the name that conversions give."""
    return F.when(c.isin("", ANTHOLOGY), c).otherwise(joined_as(c, F.transform(split_authors(c), convert_surnames)))


def joined_as(c: Column, names: Column) -> Column:
    """Names joined as those of ``c`` are: by '; ' if it has one, else by ', '."""
    return F.when(c.contains("; "), F.array_join(names, "; ")).otherwise(F.array_join(names, ", "))
