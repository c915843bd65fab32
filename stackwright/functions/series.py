r"""Series names: which texts are one, how they are cleaned, and where a file's
name holds one, as column expressions.  ``A\B`` is series B within series A."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import AWARD_WORDS, COLLECTION_KEYWORDS, FILENAME_BLACKLIST, LEVEL_ENDS, SERIES_CLEANUP_PATTERNS, SERVICE_WORDS
from .people import let, words_of
from .predicates import contains_any
from .text import _any_of, _chain, fold, squeeze, yo_to_ye

_CAPITAL = "А-ЯЁA-Z"
_CYRILLIC_NAME = rf"[{_CAPITAL}][А-Яа-яёЁA-Za-z]+"


def levels(c: Column) -> Column:
    r"""``A 1. B 2. Трилогия`` as ``A\B``: parts between full stops up to the first
    that says what kind of set it is, without numbers; '' if one is a single
    letter, for that is an abbreviation."""
    parts = F.when(c.contains("\\"), F.transform(F.split(c, r"\\"), lambda p: F.substring_index(p, ". ", 1))).otherwise(F.split(c, r"\. "))
    parts = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    end = F.array_min(F.transform(parts, lambda p, i: F.when(p.rlike(rf"(?iuU)\b(?:{_any_of(LEVEL_ENDS)})\b"), i)))
    named = F.transform(F.filter(parts, lambda p, i: F.isnull(end) | (i < end)), lambda p: F.trim(_chain(p, [(r"\s*[\d\-,–]+\s*$", ""), (r"\s*№\s*\d*\s*$", "")])))
    return F.when(F.exists(named, lambda p: F.char_length(p) <= 1), "").otherwise(F.array_join(named, "\\"))


def clean(c: Column) -> Column:
    """The series itself: no quotes around it, no dash in front, no volume
    number, title, remark in brackets or service word behind it."""
    service = rf"(?iuU)\s*[-–—]?\s*\b(?:{_any_of(SERVICE_WORDS)})(?!\w)\s*$"
    quotes = [(r"^«\s*", ""), (r"\s*»$", "")]
    bare = _chain(F.trim(c), [
        *quotes, (r"^[-–—]\s*", ""), (r"\s*\([^)]*\)\s*$", ""), (r"^(.+?)\s+\d+(?!\.\d)[.:]\s+.+$", "$1"), (r"(?<!\.)\s+\d{1,2}\s*$", ""), (r"\s*№\s*\d*\s*$", ""), (r"^(.+?)\s+\d+\s+.+$", "$1"),
        (r"\s*\([^)]+\)\s*$", ""), (service, ""), (service, ""), *quotes, (r"(?<![.…])\.$", ""),
    ])
    return F.coalesce(F.nullif(F.trim(bare), F.lit("")), F.trim(c))


def normal(c: Column) -> Column:
    """The form in which series are compared and kept: one space, ё as е, no
    author's name in brackets or before a colon, no padded number, no ``Цикл``
    around a quoted name, no open bracket or number in brackets at the end, no
    publisher's remark; a service word at the end goes if two words stay."""
    after = F.trim(F.regexp_replace(c, r"^.*?[：:]", ""))
    before = words_of(F.regexp_replace(c, r"[：:].*$", ""))
    person = F.size(before).between(1, 2) & F.forall(before, lambda w: w.rlike(r"^\p{Lu}")) & (after != "")
    text = F.when(~c.rlike("[：:]"), c).when(person, after).otherwise(F.regexp_replace(c, "[：:]", ""))
    text = yo_to_ye(squeeze(text))
    text = F.trim(_chain(text, [(r"\s*\[[^\]]*\]\s*$", ""), (rf"\s*\({_CYRILLIC_NAME}(?:\s*[-–,]\s*{_CYRILLIC_NAME})*\)\s*$", ""), (r"\s+(?:0\d+\+?|\d+\+)\s*$", ""), (r"^[Цц]икл\s*[«\"'](.+?)[»\"']\s*$", "$1")]))
    text = _chain(text, [(r"\s*\([^)]*$", ""), (r"\s*\([^)]*\d[^)]*\)\s*$", "")])
    text = squeeze(_chain(text, [(p if p.startswith("(?") else "(?iu)" + p, " ") for p in SERIES_CLEANUP_PATTERNS]))
    shorter = F.trim(F.regexp_replace(text, rf"(?iuU)\s+(?:{_any_of([w for w in SERVICE_WORDS if w.isalpha()])})(?:\s*\d+)?\s*$", ""))
    text = F.when(F.size(words_of(shorter)) >= 2, shorter).otherwise(text)
    return F.trim(F.regexp_replace(text, r"[/:*?<>=|]", ""))


def without_folder_prefix(c: Column, path: Column) -> Column:
    """``A. B`` as ``B`` where a folder above has three fifths of A's words."""
    words = lambda x: F.array_distinct(words_of(F.regexp_replace(F.lower(x), r"(?U)[^\w]", " ")))
    prefix, suffix = words(F.substring_index(c, ". ", 1)), F.trim(F.regexp_replace(c, r"^.*?\. ", ""))
    folders = F.split(F.regexp_replace(F.translate(path, "\\", "/"), r"/?[^/]*$", ""), "/")
    held = F.exists(folders, lambda f: F.size(F.array_intersect(prefix, words(f))) >= 0.6 * F.size(prefix))
    return F.when(c.contains(". ") & ~c.contains("\\") & (suffix != "") & (F.size(prefix) > 0) & held, suffix).otherwise(c)


def is_series(c: Column) -> Column:
    """Whether a text can be a series' name.  None are awards and what ends in a
    year after a dash; levels of one letter; bare numbers and calibres; lists of
    genres; listed words (but for the last of three words or more, the first of
    three, or one that capital names follow); collections; service words alone
    or with a number."""
    low = F.lower(c)
    words = words_of(low)
    year = c.rlike(r"\s[–—-]\s*\d{4}\s*[»\"']*\s*$|[–—]\s*\d{4}\s*[»\"']*\s*$")
    letters = c.contains("\\") & F.exists(F.split(c, r"\\"), lambda p: F.char_length(F.trim(p)) <= 1)
    numeric = low.rlike(r"^[.,]\d+$|^\d+[a-z]{1,2}$|^\d{1,2}$")
    listed = [w.lower() for w in FILENAME_BLACKLIST]
    parts = F.filter(F.transform(F.split(low, ","), lambda p: F.trim(p)), lambda p: p != "")
    genres = low.contains(",") & F.forall(parts, lambda p: F.size(words_of(p)) <= 2) & F.exists(parts, lambda p: p.isin(listed))
    single = [w for w in dict.fromkeys(listed) if " " not in w]
    several = [w for w in dict.fromkeys(listed) if " " in w]
    n, own = F.size(words), words_of(c)

    def brands(w: Column, i: Column) -> Column:
        hit = F.regexp_replace(w, r"^[(-]|\)$", "").isin(single)
        later = F.filter(own, lambda x, j: (j > i) & x.rlike(r"^\p{L}"))
        names = (F.size(later) > 0) & F.forall(later, lambda x: x.rlike(r"^\p{Lu}"))
        fine = ((i >= 2) & (i == n - 1)) | ((i == 0) & (n >= 3)) | names
        return hit & ~fine

    branded = F.exists(F.transform(words, brands), lambda b: b) | low.rlike(rf"(?:^|[\s(-])(?:{_any_of(several)})(?:[\s)]|$)")
    served = low.rlike(rf"^(?:{_any_of(SERVICE_WORDS)})(?:\s+(?:\d+|[ivx]+|и|-)(?:\s|$)|\s*$)")
    ok = (F.char_length(c) >= 2) & ~contains_any(c, AWARD_WORDS) & ~year & ~letters & ~numeric & ~genres & ~branded & ~contains_any(c, COLLECTION_KEYWORDS) & ~served
    return F.coalesce(ok, F.lit(False))


def parsed_name(stem: Column) -> Column:
    """A file's stem without remarks about origin and edition, and without a
    year at its end, which is no volume."""
    return F.trim(_chain(stem, [(r"\s*\([СЛ]И\)\s*$", ""), (r"(?iu)\s*\([^)]*(?:издание|изд\.)[^)]*\)\s*$", ""), (r"(?:\s*[-–—])?\s*(?:19|20)\d{2}\s*$", "")]))


def two_levels(name: Column, metadata: Column) -> Column:
    r"""``A 1\B`` of ``A 1. B 2. Title`` and the like, where the metadata's series
    is A or B (for ranges and sets, or shares two long words with B); else null."""
    rest = F.when(name.contains(" - "), F.regexp_replace(name, r"^.*? - ", "")).otherwise(name)
    root, sub = r"^(.+?)\s+(\d{1,4})\.\s+", rf"([{_CAPITAL}][^.]{{2,}}?)"
    kinds = r"(?:Тетралогия|Трилогия|Дилогия|Пенталогия|Сага|Цикл|[Сс]борник|[Аа]нтология)"
    shapes = [
        (root + sub + r"\s+\d{1,4}\.\s+.+$", False), ("(?iu)" + root + sub + r"\.\s+(?:Том|Книга|Часть|кн\.|Book|Vol\.?)\s+\d.*$", False),
        (root + sub + r"\s+\d{1,4}\s*[-–—]\s*\d{1,4}\.\s+.+$", True), (root + rf"([{_CAPITAL}][^(]{{2,}}?)\s*\({kinds}\)\s*$", True),
    ]
    meta = fold(F.trim(metadata))
    long = lambda x: F.filter(words_of(x), lambda w: F.char_length(w) >= 4)

    def of(shape: str, loose: bool) -> Column:
        a, n, b = (F.trim(F.regexp_extract(rest, shape, i)) for i in (1, 2, 3))
        sure = (meta == fold(a)) | (meta == fold(b))
        if loose:
            sure |= (meta == fold(F.concat(a, F.lit(" "), n))) | (F.size(F.array_intersect(long(meta), long(fold(b)))) >= 2)
        return F.when((F.trim(metadata) != "") & rest.rlike(shape) & sure, F.concat(a, F.lit(" "), n, F.lit("\\"), b))

    return F.coalesce(*[of(*s) for s in shapes])


def told_by_name(name: Column) -> Column:
    """The first of these that is a series; '' if none is: square brackets in
    front, the first round ones with several words, the first of two sentences,
    ``A. Series n``, ``A - Series n``, ``A - Series n. Title``, ``A - Series. Title``."""
    numbered = name.rlike(r"\s+\d+(?:[-–—]\d+)?\s*$|\s+\d+\.\s+\S")
    group = lambda pattern, i=1: F.when(name.rlike(pattern), F.trim(F.regexp_extract(name, pattern, i)))
    inner = group(r"\(([^)]+)\)(?:\s*\(|\s*$)")
    remark = F.forall(words_of(F.lower(inner)), lambda w: w.rlike(rf"^(?:\d+|{_any_of(SERVICE_WORDS)}|весь|вся|все|полн\w*|цел\w*)$"))
    bracket = F.when((inner.contains(" ") | inner.contains(".")) & ~remark, let(levels(inner), lambda s: F.when(~s.rlike("[,.]"), s)))
    head = F.substring_index(name, ". ", 1)
    person = (F.size(words_of(head)) <= 1) | head.rlike(r"\s\p{Lu}$") | head.rlike(r"[А-ЯA-Z]\.[А-Яа-яA-Za-z]")
    sentence = F.when(name.contains(". ") & ~head.contains(" - ") & ~person & ~numbered, F.trim(head))
    second = F.when(~head.rlike(r"^\d") & (F.char_length(head) < 60), group(r"^.+?\.\s+(.+?)\s+(?:\d+[-–—]\d+|\d+|[IVX]+)\s*$"))
    dashed = group(r"^.+?\s*-\s*(.+?)\s+(?:\d+[-–—]\d+|\d{1,2})\s*$")
    titled = group(r"^.+?\s*-\s*(.+?)\s+\d{1,2}\.\s+.+$")
    last = F.when(name.contains(" - ") & name.contains(". "), group(r"^.+?\s*-\s*([^.]+)\.\s+.+$"))
    last = F.when(F.char_length(last) > 3, last)
    options = F.array(group(r"^\[([^\[\]]+)\]"), bracket, sentence, second, F.when(name.contains(" - "), dashed), F.when(name.contains(" - "), titled), last)
    return F.coalesce(F.get(F.filter(options, lambda s: s.isNotNull() & is_series(s)), 0), F.lit(""))
