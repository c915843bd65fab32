"""File names against patterns of blocks, such as ``Author - Title (Series)``.

A name is cut into blocks by column expressions, and the patterns are a constant
array in the plan, so a match is one native projection without join or shuffle.
Scores are counted in tenths, as whole numbers, and divided at the end."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _any_of
from ..vocabulary import BLOCK_QUALIFIERS, FILE_PATTERNS, SERVICE_WORDS, TITLE_WORDS

_SHAPE = "array<struct<idx int, pattern string, blocks array<struct<kind string, inside boolean, quoted boolean, before string>>>>"
#: A delimiter, and a piece of text up to one; quoted text and an ellipsis are never cut.
_DELIMITER = r"\s+-\s+|\.\s+(?!-)"
_PIECE = rf"((?:«[^»]*»|\.{{2,}}|(?!{_DELIMITER}).)*)({_DELIMITER}|$)"


def _pieces(text: Column, before: Column) -> Column:
    """The blocks of text outside brackets, which ``before`` comes before."""
    ends = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(2))
    return F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1)), lambda t, i: F.struct(t.alias("text"), F.lit(False).alias("inside"), F.when(i == 0, before).otherwise(F.get(ends, i - 1)).alias("before")))


def blocks(name: Column) -> Column:
    """The blocks of a name: array of (text, inside brackets, delimiter before),
    null for null.  What follows the last bracket is one block."""
    name = F.regexp_replace(name, r"\.fb2$", "")
    tokens = F.regexp_extract_all(name, F.lit(r"[()]|[^()]+"), F.lit(0))
    last = F.array_max(F.transform(tokens, lambda t, i: F.when(t == ")", i)))

    def cut(token: Column, i: Column) -> Column:
        ahead = F.slice(tokens, F.lit(1), i)
        depth = F.size(F.filter(ahead, lambda t: t == "(")) - F.size(F.filter(ahead, lambda t: t == ")"))
        before = F.when(i > 0, F.get(tokens, i - 1))
        whole = lambda inside: F.array(F.struct(token.alias("text"), F.lit(inside).alias("inside"), before.alias("before")))
        none = F.slice(whole(False), 1, 0)
        return F.when(token.isin("(", ")"), none).when(depth > 0, whole(True)).when(i > last, whole(False)).otherwise(_pieces(token, before))

    found = F.transform(F.flatten(F.transform(tokens, cut)), lambda b: F.struct(F.trim(F.regexp_replace(b["text"], r"\.{2,}", "...")).alias("text"), b["inside"].alias("inside"), b["before"].alias("before")))
    return F.filter(found, lambda b: b["text"] != "")


def block_kind(text: Column) -> Column:
    """What a block looks like by itself: the first of these tests that holds.

    ======================================================  =============
    only service words, their qualifiers and numbers         service_words
    a service word, a range, a number at the end, ``vol. n``  Series
    a word that titles have                                   Title
    two Cyrillic words, capital or of two letters             Author
    one Cyrillic word                                         Author
    anything else                                             Title
    ======================================================  ============="""
    low = F.lower(text)
    words, listed = F.split(low, r"\s+"), lambda xs: F.array(*[F.lit(x) for x in sorted(xs)])
    counted = F.forall(words, lambda w: w.rlike(r"^\d+$") | F.array_contains(listed(set(SERVICE_WORDS) | set(BLOCK_QUALIFIERS)), w))
    served = low.rlike(_any_of(SERVICE_WORDS))
    numbered = text.rlike(r"\d+[-–—]\d+|(?<!\w)\d+$|\bvol\.\s+\d+")
    pair = text.rlike(r"^(?:\p{Lu}\S*[Ѐ-ӿ]\S*|[\u0410-\u042F\u0401]\S*|\S?[Ѐ-ӿ]\S?)\s+(?:\p{Lu}\S*[Ѐ-ӿ]\S*|[\u0410-\u042F\u0401]\S*|\S?[Ѐ-ӿ]\S?)(?:\s|$)")
    alone = text.rlike(r"^\S*[Ѐ-ӿ]\S*$") & (F.char_length(text) >= 3)
    return (
        F.when(served & counted, "service_words").when(served | numbered, "Series")
        .when(F.arrays_overlap(words, listed(TITLE_WORDS)), "Title").when(pair | alone, "Author").otherwise("Title")
    )


def pattern_kind(block: str) -> str:
    lower = block.lower().strip(",. ")
    if "author" in lower:
        return "Author"
    if lower.startswith("subseries"):
        return "SubSeries"
    for word, kind in (("series", "Series"), ("title", "Title"), ("service_words", "service_words")):
        if word in lower:
            return kind
    return "Title"


def pattern_table(patterns: list[str]) -> list[dict]:
    """The patterns' blocks; inside brackets they aren't cut."""
    rows = []
    for i, pattern in enumerate(patterns):
        found, before, inside = [], None, False
        for part in re.split(r"(\s+-\s+|\.\s+|[()])", pattern):
            if inside and part not in "()":
                found[-1]["text"] += part
            elif re.fullmatch(r"\s+-\s+|\.\s+|[()]", part):
                before, inside = part, part == "("
                if inside:
                    found.append({"text": "", "inside": True, "before": before})
            elif part.strip():
                found.append({"text": part.strip(), "inside": False, "before": before})
        rows.append({"idx": i, "pattern": pattern, "blocks": [{"kind": pattern_kind(b["text"]), "inside": b["inside"], "quoted": "«" in b["text"], "before": b["before"]} for b in found]})
    return rows


def blocks_of(name: str) -> Column:
    """The name's blocks with their place and kind."""
    return F.transform(blocks(F.col(name)), lambda b, i: F.struct(i.alias("pos"), b["text"].alias("text"), b["inside"].alias("inside"), b["before"].alias("before"), block_kind(b["text"]).alias("kind")))


def match_patterns(df: DataFrame, name: str, patterns: list[str] = FILE_PATTERNS, known_names: list[str] = (), least: float = 0.0) -> DataFrame:
    """``df`` with best_score, best_pattern, author, series: the pattern whose
    blocks fit best; more blocks of the right kind, then the earlier pattern win
    ties.  Number, brackets, quotes and the first dash must agree.  Without a
    fit, or for a null or empty name, the four are null; columns of these names are
    replaced."""
    shapes = F.from_json(F.lit(json.dumps(pattern_table(list(patterns)), ensure_ascii=False)), _SHAPE)
    listed = F.array(*[F.lit(w.lower()) for w in known_names]).cast("array<string>")
    known = F.arrays_overlap(F.split(F.lower(F.try_element_at(F.col("__b"), F.lit(1))["text"]), r"\s+"), listed)
    dash = lambda blocks: F.coalesce(F.trim(F.try_element_at(blocks, F.lit(2))["before"]) == "-", F.lit(False))

    def fit(b: Column, p: Column) -> Column:
        first, want, kind = b["pos"] == 0, p["kind"], b["kind"]
        right = (kind == want) | (first & (want == "Author") & F.col("__known"))
        right |= (kind == "Title") & want.isin("Series", "SubSeries")
        right |= ~first & (kind == "Author") & (want == "Series")
        right |= (kind == "Series") & (want == "SubSeries")
        same = (b["inside"] == p["inside"]) & (b["text"].contains("«") == p["quoted"])
        tenths = F.lit(5) + F.when(right, 5).otherwise(0) + F.when(right & b["before"].eqNullSafe(p["before"]), 1).otherwise(0)
        tenths -= F.when(first & F.col("__known") & (want == "Title"), 5).otherwise(0)
        return F.struct(same.alias("same"), right.alias("right"), tenths.alias("tenths"), F.when(right, want).alias("kind"), b["text"].alias("text"))

    def scored(p: Column) -> Column:
        z = F.zip_with(F.col("__b"), p["blocks"], fit)
        texts = lambda kind: F.transform(F.filter(z, lambda x: x["kind"] == kind), lambda x: x["text"])
        total = F.aggregate(z, F.lit(0), lambda s, x: s + x["tenths"])
        series = F.concat_ws("\\", F.nullif(F.array_join(texts("Series"), ". "), F.lit("")), F.nullif(F.array_join(texts("SubSeries"), "\\"), F.lit("")))
        fits = F.forall(z, lambda x: x["same"]) & (total > 0)
        return F.when(fits, F.struct(
            total.alias("tenths"), F.size(F.filter(z, lambda x: x["right"])).alias("n_right"), (-p["idx"]).alias("order"), p["pattern"].alias("pattern"),
            F.try_element_at(texts("Author"), F.lit(-1)).alias("author"), F.nullif(series, F.lit("")).alias("series"),
        ))

    rows = df.withColumn("__b", blocks_of(name)).withColumn("__known", F.coalesce(known, F.lit(False)))
    alike = F.filter(shapes, lambda p: (F.size(p["blocks"]) == F.size("__b")) & (dash(p["blocks"]) == dash(F.col("__b"))))
    rows = rows.withColumn("__best", F.array_max(F.transform(alike, scored)))
    score = F.col("__best.tenths") / (F.size("__b") * F.lit(11.0))
    good = score >= least
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in ("best_score", "best_pattern", "author", "series")], F.when(good, score).alias("best_score"), F.when(good, F.col("__best.pattern")).alias("best_pattern"),
        F.when(good, F.col("__best.author")).alias("author"), F.when(good, F.col("__best.series")).alias("series"),
    )


def compile_pattern(pattern: str) -> tuple[str, list[str]]:
    """A Java regular expression and its groups' names, in order; a name that
    comes again is numbered.  ``(X)``, ``[X]`` and quotes stand for themselves."""
    names: list[str] = []

    def part(token: str) -> str:
        if re.fullmatch(r"[A-Za-z_]+", token):
            n = sum(x.split("_#")[0] == token.lower() for x in names)
            names.append(token.lower() + (f"_#{n + 1}" if n else ""))
            return "(.+?)"
        return r"\s*" if token.isspace() else "\\" + token if token in r".^$*+?{}[]\|()-" else token

    body = "".join(part(t) for t in re.findall(r"[A-Za-z_]+|\s+|.", pattern))
    return f"^{body}$", [x.replace("_#", "_") for x in names]


def extract_groups(c: Column, pattern: str) -> Column:
    """A struct of the pattern's groups in a text, null where it doesn't fit."""
    regex, names = compile_pattern(pattern)
    return F.when(c.rlike(regex), F.struct(*[F.trim(F.regexp_extract(c, regex, i + 1)).alias(n) for i, n in enumerate(names)]))
