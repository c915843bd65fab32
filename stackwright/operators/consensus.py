"""The consensus pass: what records of a folder, author or series settle for
each other, rule by rule in a fixed order.

Every rule is a function from records to records (the columns of
``authors.RECORD``).  Votes and donors are summed by key before they are joined
back; where the first counts, it is the first by ``file_path``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.people import words_of
from ..functions.predicates import has_service_word, is_branding
from ..functions.text import _any_of, _chain, fold, yo_to_ye
from ..staging import cut
from ..vocabulary import ANTHOLOGY, COAUTHORS, FILENAME_BLACKLIST, SERVICE_WORDS, SPECIAL_SERIES, UNKNOWN_AUTHOR
from .authors import RECORD, file_name, file_stem, folder_of, records

STRONG = ("filename+meta_confirmed", "filename", "folder_dataset", "metadata")
WEAK = ("consensus", "author-consensus", "author-consensus (metadata-confirmed)")


def base(c: Column) -> Column:
    """A series without the volume number at its end; 2.0 stays."""
    bare = _chain(F.trim(c), [(r"\s+\d+(?!\.\d)[\s.]*$", ""), (r"\s+\d+(?!\.\d)\s*$", ""), (r"[-–—]\d+(?!\.\d)\s*$", "")])
    return F.coalesce(F.nullif(F.trim(bare), F.lit("")), c)


def without_author(c: Column) -> Column:
    """A series without an author in brackets behind it."""
    return F.trim(_chain(c, [(r"\s*\([^)]*\)\s*$", ""), (r"\s*\[[^\]]*\]\s*$", "")]))


def _set(df: DataFrame, hit: Column, series=None, source=None) -> DataFrame:
    """Sets series and source where ``hit``."""
    hit = F.coalesce(hit, F.lit(False))
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    new = {c: F.when(hit, lit(v)).otherwise(F.col(c)) for c, v in (("proposed_series", series), ("series_source", source)) if v is not None}
    return df.withColumns(new).select(*RECORD)


def _by(df: DataFrame) -> DataFrame:
    author = F.when(F.col("proposed_author") == "", UNKNOWN_AUTHOR).otherwise(F.col("proposed_author"))
    return df.withColumns({"_author": author, "_folder": folder_of(F.col("file_path")), "_stem": fold(file_stem(F.col("file_path")))})


def has_series_evidence(path: Column) -> Column:
    """The file's name counts volumes, or has brackets that speak of a series:
    a service word, a range, ``из цикла``, or three levels."""
    stem, name = file_stem(path), file_name(path)
    brackets = F.regexp_extract_all(name, F.lit(r"\([^)]*\)"), F.lit(0))
    words = _any_of([w.lower() for w in SERVICE_WORDS])
    told = F.exists(brackets, lambda b: F.lower(b).rlike(words) | b.rlike(r"\d+[-,]\d+") | F.lower(b).rlike(r"из\s+(?:цикла|серии)") | b.rlike(r"\. .*\. "))
    return stem.rlike(r"\s+\d+(?:[-–—]\d+)?\s*$|\s+\d+\.\s+\S") | told


def clear_lone_titles(df: DataFrame) -> DataFrame:
    """A series from a file's name that its author has once, and that nothing
    confirms, is a title."""
    n = F.count(F.lit(1)).over(Window.partitionBy("_author", "proposed_series"))
    rows = _by(df).withColumn("_n", n)
    s, top = F.col("proposed_series"), F.substring_index(F.translate(F.col("file_path"), "\\", "/"), "/", 1)
    confirmed = F.lower(F.trim("metadata_series")) == F.lower(s)
    return _set(rows, (s != "") & (F.col("_n") == 1) & (F.col("series_source") == "filename") & ~has_service_word(s) & ~confirmed & ~has_series_evidence(F.col("file_path")) & ~top.contains("Серия"), "", "")


def special_series(df: DataFrame) -> DataFrame:
    return _set(df, F.trim("metadata_series").isin(SPECIAL_SERIES), F.trim("metadata_series"), "metadata")


def folder_author_consensus(df: DataFrame) -> DataFrame:
    """The most frequent author of a folder, among records with a strong source
    if there are any, goes to records with a weak one.  Without a strong source
    only blanks and anthologies change."""
    strong = F.col("author_source").isin("folder_dataset", "folder_hierarchy", "filename", "filename_meta_confirmed")
    rows = _by(df)
    some = rows.groupBy("_folder").agg(F.bool_or(strong).alias("_strong"))
    votes = rows.filter((F.col("author_source") != "") & ~F.col("proposed_author").isin("", ANTHOLOGY)).join(some, "_folder").filter(strong | ~F.col("_strong"))
    counts = votes.groupBy("_folder", "proposed_author", "_strong").agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("seen"))
    best = counts.groupBy("_folder", "_strong").agg(F.min_by("proposed_author", F.struct(-F.col("n"), F.col("seen"))).alias("_best"))
    rows = rows.join(best, "_folder", "left")
    hit = F.coalesce(F.col("_best").isNotNull() & ~strong & (F.col("proposed_author") != F.col("_best")) & (F.col("_strong") | F.col("proposed_author").isin("", ANTHOLOGY)), F.lit(False))
    return rows.withColumns({"proposed_author": F.when(hit, F.col("_best")).otherwise(F.col("proposed_author")), "author_source": F.when(hit, "consensus").otherwise(F.col("author_source"))}).select(*RECORD)


def author_series_consensus(df: DataFrame) -> DataFrame:
    """A series that one of an author's files names goes to the author's files
    without one whose name has it at the start, or after a dash or full stop."""
    rows = _by(df)
    bases = rows.filter("extracted_series_candidate <> ''").select("_author", base(F.col("extracted_series_candidate")).alias("_base"), "file_path")
    bases = bases.groupBy("_author", "_base").agg(F.min("file_path").alias("_seen")).filter(F.char_length("_base") >= 2)
    open_ = rows.filter("extracted_series_candidate = '' AND (proposed_series = '' OR series_source IN ('metadata', 'metadata_folder_confirmed')) AND series_source <> 'no_series_folder'")
    at = lambda what: F.instr("_stem", what)  # noqa: E731  from 1
    place = F.position("_key", F.col("_stem"))
    pairs = open_.select("file_path", "_author", "_stem").join(bases.withColumn("_key", fold(F.col("_base"))), "_author").withColumn("_at", place).filter("_at > 0")
    legal = (F.col("_at") == 1) | ((at(" - ") > 0) & (F.col("_at") > at(" - "))) | ((at(". ") > 0) & (F.col("_at") > at(". ")))
    first = pairs.filter(legal).groupBy("file_path").agg(F.min_by("_base", F.struct("_seen", "_base")).alias("_base"))
    sure = (F.col("metadata_series") != "") & (base(F.col("metadata_series")) == F.col("_base"))
    return _set(df.join(first, "file_path", "left"), F.col("_base").isNotNull(), F.col("_base"), F.when(sure, "author-consensus (metadata-confirmed)").otherwise("author-consensus"))


def folder_series_consensus(df: DataFrame) -> DataFrame:
    """The only series that a folder's metadata confirm goes to records whose
    metadata say it; then the only one that two records have goes to those
    whose file names it."""
    blank = (F.col("proposed_series") == "") & (F.col("series_source") != "no_series_folder")
    rows = _by(df)
    only = rows.filter("metadata_series <> '' AND proposed_series = metadata_series").groupBy("_folder").agg(F.collect_set("metadata_series").alias("_s")).filter("size(_s) = 1").select("_folder", F.col("_s")[0].alias("_only"))
    rows = rows.join(only, "_folder", "left")
    rows = _by(_set(rows, blank & (F.col("metadata_series") == F.col("_only")), F.col("_only"), "consensus"))
    twice = rows.filter("proposed_series <> ''").groupBy("_folder", "proposed_series").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    only = twice.groupBy("_folder").agg(F.collect_list("proposed_series").alias("_s")).filter("size(_s) = 1").select("_folder", F.col("_s")[0].alias("_only"))
    rows = rows.join(only, "_folder", "left")
    return _set(rows, blank & (F.col("extracted_series_candidate") == "") & F.col("_stem").contains(fold(F.col("_only"))), F.col("_only"), "consensus")


def series_author_consensus(df: DataFrame) -> DataFrame:
    """The most frequent author of a series goes to its records whose author is
    a part of it, unless their folder names the author."""
    rows = df.filter("proposed_series <> ''")
    counts = rows.filter(~F.col("proposed_author").isin("", ANTHOLOGY)).groupBy("proposed_series", "proposed_author").agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("seen"))
    best = counts.groupBy("proposed_series").agg(F.min_by("proposed_author", F.struct(-F.col("n"), F.col("seen"))).alias("_best"))
    many = rows.groupBy("proposed_series").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    out = df.join(best.join(many, "proposed_series"), "proposed_series", "left")
    words = lambda c: F.array_distinct(words_of(F.replace(F.lower(c), F.lit(","), F.lit(""))))
    mine, theirs = words(F.col("proposed_author")), words(F.col("_best"))
    part = (F.size(mine) > 0) & (F.size(F.array_except(mine, theirs)) == 0) & (F.size(mine) < F.size(theirs))
    hit = F.coalesce(part & F.col("author_source").isin("filename", "filename_meta_confirmed", "metadata", "consensus", ""), F.lit(False))
    source = F.concat_ws("+", F.nullif(F.col("author_source"), F.lit("")), F.lit("series-consensus"))
    return out.withColumns({"author_source": F.when(hit, source).otherwise(F.col("author_source")), "proposed_author": F.when(hit, F.col("_best")).otherwise(F.col("proposed_author"))}).select(*RECORD)


def unify_hierarchies(df: DataFrame, fragments: bool) -> DataFrame:
    r"""``A. B`` becomes ``A\B`` where the author also has ``A``, and ``A`` if B is
    a number; with ``fragments`` also if B is no more than one."""
    rows = _by(df)
    plain = ~F.col("proposed_series").contains("\\")
    roots = rows.filter(plain & (F.col("proposed_series") != "") & ~F.col("proposed_series").contains(". ")).select("_author", F.col("proposed_series").alias("_root")).distinct()
    rows = rows.withColumn("_root", F.when(plain & F.col("proposed_series").contains(". "), F.substring_index("proposed_series", ". ", 1)))
    rows = rows.join(roots.withColumn("_has", F.lit(True)), ["_author", "_root"], "left")
    sub = F.trim(F.regexp_replace("proposed_series", r"^.*?\. ", ""))
    whole = (F.char_length(sub) >= 4) & ((F.size(words_of(sub)) >= 3) | (F.char_length(F.element_at(words_of(sub), -1)) >= 4))
    drop = sub.rlike(r"^\d+$") | (~whole if fragments else F.lit(False))
    return _set(rows, F.col("_has"), F.when(drop, F.col("_root")).otherwise(F.concat("_root", F.lit("\\"), sub)))


def clear_embedded_authors(df: DataFrame) -> DataFrame:
    """A series from the folders that is a brand, or holds its author's name (by
    the first four letters, short words whole), gives way to the metadata's
    series, if that is none of these and no library class, else goes."""
    s, a, meta = F.col("proposed_series"), F.col("proposed_author"), F.col("metadata_series")
    starts = lambda c: F.transform(F.filter(words_of(F.lower(c)), lambda w: F.char_length(w) >= 4), lambda w: F.substring(w, 1, 4))
    short = F.filter(words_of(F.lower(a)), lambda w: F.char_length(w).between(2, 3))
    bare = F.transform(words_of(F.lower(s)), lambda w: F.regexp_replace(w, "[аяоеуиёью]+$", ""))
    embedded = F.arrays_overlap(starts(a), starts(s)) | F.arrays_overlap(short, bare)
    hit = (F.col("series_source") == "folder_hierarchy") & (s != "") & (is_branding(s) | embedded)
    good = (meta != "") & ~meta.rlike(r"(?U)^\w[\w\s]+,\s+\w") & ~_holds_brand(meta)
    return _set(df, hit, F.when(good, meta).otherwise(""), F.when(good, "metadata").otherwise(""))


def _holds_brand(c: Column) -> Column:
    words, low = [w.lower() for w in FILENAME_BLACKLIST], F.lower(c)
    short, long = [w for w in words if len(w) < 4], [w for w in words if len(w) >= 4]
    return low.rlike(rf"(?<![а-яёa-z])(?:{_any_of(short)})(?![а-яёa-z])") | low.rlike(_any_of(long))


def authors_by_prefix(df: DataFrame) -> DataFrame:
    """Files without an author whose name begins with that of a folder-mate."""
    key = lambda c: F.translate(fold(c), "z", "з")
    rows = _by(df)
    known = rows.filter(~F.col("proposed_author").isin("", UNKNOWN_AUTHOR, ANTHOLOGY, COAUTHORS)).groupBy("_folder", "proposed_author").agg(F.min("file_path").alias("_seen"))
    known = known.select("_folder", "_seen", F.col("proposed_author").alias("_known"), key(F.col("proposed_author")).alias("_key"))
    blank = F.col("proposed_author").isin("", UNKNOWN_AUTHOR)
    pairs = rows.filter(blank).select("file_path", "_folder", key(F.col("_stem")).alias("_at")).join(known, "_folder").filter(F.col("_at").startswith(F.col("_key")) & ~F.substr("_at", F.char_length("_key") + 1, F.lit(1)).rlike(r"\p{L}"))
    first = pairs.groupBy("file_path").agg(F.min_by("_known", F.struct("_seen", "_known")).alias("_known"))
    out, hit = df.join(first, "file_path", "left"), F.col("_known").isNotNull()
    return out.withColumns({"author_source": F.when(hit, "filename").otherwise(F.col("author_source")), "proposed_author": F.coalesce("_known", "proposed_author")}).select(*RECORD)


def clear_shared_folders(df: DataFrame) -> DataFrame:
    """In a folder of several authors, a series that the folder's name (of four
    letters or more) has is the publisher's, and goes."""
    rows = _by(df)
    real = F.count_distinct(F.when(~F.col("proposed_author").isin("", UNKNOWN_AUTHOR, ANTHOLOGY, COAUTHORS), F.col("proposed_author")))
    kinds = rows.groupBy("_folder").agg(real.alias("_real"), F.bool_or(F.col("proposed_author").isin(ANTHOLOGY, COAUTHORS)).alias("_joint"))
    name = fold(F.element_at(F.split("_folder", "/"), -1))
    mixed = (F.col("_real") > 1) | (F.col("_joint") & (F.col("_real") >= 1))
    return _set(rows.join(kinds, "_folder"), mixed & (F.char_length(name) >= 4) & (F.col("proposed_series") != "") & name.contains(fold(F.col("proposed_series"))), "", "")


def confirm_twice(df: DataFrame) -> DataFrame:
    """A weak series gives way to the one that the record's metadata name, its
    file's name holds, and another file of the author confirms."""
    rows = _by(df)
    known = rows.filter(F.col("series_source").isin(*STRONG) & (F.col("extracted_series_candidate") != ""))
    shown = F.coalesce(F.nullif(F.col("proposed_series"), F.lit("")), F.col("extracted_series_candidate"))
    known = known.groupBy("_author", base(F.col("extracted_series_candidate")).alias("_base")).agg(F.min_by(shown, "file_path").alias("_right"))
    rows = rows.withColumn("_base", F.when(F.col("metadata_series") != "", base(F.col("metadata_series")))).join(known, ["_author", "_base"], "left")
    hit = F.col("series_source").isin(*WEAK) & F.col("_right").isNotNull() & F.col("_stem").contains(fold(F.col("_base"))) & (F.col("proposed_series") != F.col("_right"))
    return _set(rows, hit, F.col("_right"), "filename+meta_confirmed")


def restore_cut_series(df: DataFrame) -> DataFrame:
    """A series from a file's name that ends a longer confirmed one of its
    author becomes that one.  Ends are exploded, so they meet by equality."""
    rows = _by(df)
    full = rows.filter((F.col("proposed_series") != "") & F.col("series_source").isin(*STRONG)).select("_author", F.col("proposed_series").alias("_full")).distinct()
    low = fold(F.col("_full"))
    ends = full.select("_author", "_full", F.explode(F.transform(F.sequence(F.lit(1), F.char_length(low)), lambda i: F.substr(low, i))).alias("_end"))
    longest = ends.groupBy("_author", "_end").agg(F.max_by("_full", F.struct(F.char_length("_full"), "_full")).alias("_full"))
    rows = rows.withColumn("_end", F.when((F.col("series_source") == "filename") & (F.col("proposed_series") != ""), fold(F.col("proposed_series")))).join(longest, ["_author", "_end"], "left")
    return _set(rows, fold(F.col("_full")) != F.col("_end"), F.col("_full"), "author-consensus")


def folder_metadata_majority(df: DataFrame) -> DataFrame:
    """The series that half of a folder's metadata or more name goes to records
    that their metadata, their present series or their file's name speaks for,
    but not over file names, brands or folders that name a series themselves."""
    rows = _by(df)
    said = without_author(F.trim("metadata_series"))
    rows = rows.withColumns({"_said": said, "_vote": F.when(F.trim("metadata_series") != "", F.nullif(fold(base(said)), F.lit("")))})
    of = rows.groupBy("_folder").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("series_source").isin("folder_hierarchy", "folder_dataset")).alias("_named")).filter("not _named")
    votes = rows.filter("_vote is not null").groupBy("_folder", "_vote").agg(F.count(F.lit(1)).alias("n"), F.min_by("_said", "file_path").alias("_best"), F.min("file_path").alias("seen"))
    best = votes.groupBy("_folder").agg(F.min_by(F.struct("_vote", "_best", "n"), F.struct(-F.col("n"), F.col("seen"))).alias("b"))
    best = best.join(of, "_folder").filter("b.n >= greatest(1, 0.5 * _n)").select("_folder", F.col("b._vote").alias("_key"), F.col("b._best").alias("_best"))
    rows = rows.join(best, "_folder", "left")
    s, low = F.col("proposed_series"), fold(F.col("_best"))
    speaks = F.when(F.trim("metadata_series") != "", F.col("_vote").eqNullSafe(F.col("_key"))).when(s != "", low.contains(s)).otherwise(F.col("_stem").contains(low))
    hit = F.col("_best").isNotNull() & (fold(base(s)) != F.col("_key")) & speaks & ~_holds_brand(F.col("_best")) & ~F.col("series_source").isin("filename", "filename+meta_confirmed")
    return _set(rows, hit, F.col("_best"), "folder_meta_consensus")


def folder_series_donors(df: DataFrame) -> DataFrame:
    """Records without a series take that of the first one of their folder that
    has it from a folder."""
    rows = _by(df)
    donors = rows.filter((F.col("proposed_series") != "") & F.col("series_source").isin("folder_hierarchy", "folder_dataset", "folder_meta_consensus"))
    donors = donors.groupBy("_folder").agg(F.min_by(F.struct("proposed_series", "series_source"), "file_path").alias("_d"))
    return _set(rows.join(donors, "_folder", "left"), (F.col("proposed_series") == "") & F.col("_d").isNotNull(), F.col("_d.proposed_series"), F.col("_d.series_source"))


def confirm_phrases(df: DataFrame) -> DataFrame:
    """Two words or more that begin the titles of two of an author's files, and
    that metadata confirm as a series, become the series of those files whose
    own is missing or weak; the longest such phrase of each."""
    rows = _by(df).filter("proposed_author <> ''")
    clean = without_author(F.trim("metadata_series"))
    said = rows.filter(F.trim("metadata_series") != "").groupBy("_author", fold(base(clean)).alias("_phrase")).agg(F.min_by(clean, "file_path").alias("_series"))
    author = fold(F.col("proposed_author"))
    turned = F.when(F.size(words_of(author)) == 2, F.concat_ws(" ", F.get(words_of(author), 1), F.get(words_of(author), 0))).otherwise(author)
    starts = [F.concat(who, F.lit(sep)) for who in (author, turned) for sep in (". ", " - ")]
    title = reduce(lambda out, p: out.when(F.col("_stem").startswith(p), F.substr("_stem", F.char_length(p) + 1)), starts, F.when(F.lit(False), F.lit(""))).otherwise(F.col("_stem"))
    words = words_of(F.trim(F.regexp_replace(title, r"\s+\d+(\s*\.\s*.*)?$", "")))
    runs = F.when(F.size(words) >= 2, F.transform(F.sequence(F.lit(2), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")))
    phrases = rows.select("file_path", "_author", runs.alias("_runs")).select("file_path", "_author", F.explode("_runs").alias("_phrase")).filter(F.char_length("_phrase") >= 3)
    often = phrases.groupBy("_author", "_phrase").agg(F.count_distinct("file_path").alias("n")).filter("n >= 2").join(said, ["_author", "_phrase"])
    best = phrases.join(often, ["_author", "_phrase"]).groupBy("file_path").agg(F.max_by("_series", F.struct(F.char_length("_phrase"), F.col("_phrase"))).alias("_series"))
    s = F.col("proposed_series")
    hit = F.col("_series").isNotNull() & ((s == "") | F.col("series_source").isin(*WEAK, "")) & (s != F.col("_series"))
    return _set(df.join(best, "file_path", "left"), hit, F.col("_series"), "filename_phrase_confirmed")


#: The rules in their order.
RULES = [
    clear_lone_titles, special_series, folder_author_consensus, author_series_consensus, folder_series_consensus, series_author_consensus, lambda df: unify_hierarchies(df, True),
    clear_embedded_authors, authors_by_prefix, clear_shared_folders, confirm_twice, restore_cut_series, folder_metadata_majority, folder_series_donors, confirm_phrases,
    lambda df: unify_hierarchies(df, False),
]


def consensus(df: DataFrame, every: int = 3) -> DataFrame:
    """All rules, one after the other.  The lineage is cut after so many rules:
    each reads its input more than once."""
    df = records(df)
    for i, rule in enumerate(RULES, 1):
        df = rule(df)
        if i % every == 0:
            df = cut(df)
    return df.withColumn("proposed_series", yo_to_ye(F.col("proposed_series"))).select(*RECORD)
