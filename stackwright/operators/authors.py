"""The passes that settle each book's author, from frame to frame.

A record has the columns of ``RECORD``; ``file_path`` is its key and the order in
which ties go.  What other records know of a name is a table of aliases, built
from all records before any is changed, so results don't depend on the order in
which records are met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import people as N
from ..functions.people import let, words_of
from ..functions.predicates import contains_any, is_collection, is_incomplete_name, is_valid_author
from ..functions.text import _chain, capitalise, fold, split_authors, squeeze, yo_to_ye
from ..vocabulary import ANTHOLOGY, COAUTHORS, COLLECTION_KEYWORDS, FILE_PATTERNS, NAME_PARTICLES, UNKNOWN_AUTHOR
from ..staging import cut
from .patterns import match_patterns

RECORD = [
    "file_path", "file_title", "metadata_authors", "proposed_author", "author_source", "metadata_series", "proposed_series", "series_source",
    "metadata_genre", "series_number", "extracted_series_candidate", "needs_filename_fallback",
]
FINAL = (ANTHOLOGY, COAUTHORS, UNKNOWN_AUTHOR)
_ILLEGAL_AUTHOR, _ILLEGAL_SERIES = r'[\\/:*?"<>=|]', r'[/*?"<>=|]'


def records(df: DataFrame) -> DataFrame:
    """``df`` with all columns of a record: '' and false where it has none."""
    have = set(df.columns)
    blank = lambda c: F.lit(False) if c == "needs_filename_fallback" else F.lit("")
    return df.select(*[F.coalesce(F.col(c), blank(c)).alias(c) if c in have else blank(c).alias(c) for c in RECORD])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"(?:^|/)[^/]*$", "")


def without_marks(stem: Column) -> Column:
    """A stem without remarks in brackets at its end: samizdat, collection,
    edition, translation."""
    kinds = [r"СИ", r"сборник[^)]*", r"антология[^)]*", r"omnibus[^)]*", r"[^)]*(?:издание|изд\.)[^)]*", r"пер\.\s*[^)]*", r"перевод[^)]*", r"пер"]
    return F.trim(_chain(stem, [(rf"(?iuU)\s*\({k}\)\s*$", "") for k in kinds]))


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


# --- aliases ----------------------------------------------------------------------------


def aliases(names: DataFrame) -> DataFrame:
    """key, full of ``names`` (author, seen): each name under itself and under
    each of its words of three letters or more, that word in front; the longest
    form, then the first seen, has the key.  Names with a comma are left out."""
    names = names.filter(~F.col("author").contains(",") & (F.trim("author") != "")).select(F.trim("author").alias("author"), "seen")
    whole = names.select(F.lower("author").alias("key"), F.col("author").alias("full"), "seen")
    word = names.select(F.explode(F.filter(words_of(F.col("author")), lambda w: F.char_length(w) > 2)).alias("w"), "author", "seen")
    word = word.select(F.lower("w").alias("key"), F.rtrim(N.family_name_first(F.col("author"), F.col("w"))).alias("full"), "seen")
    order = F.struct(-F.size(words_of(F.col("full"))), F.col("seen"), F.col("full"))
    return whole.unionByName(word).groupBy("key").agg(F.min_by("full", order).alias("full"))


def metadata_names(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.split("metadata_authors", ";")).alias("author"), F.col("file_path").alias("seen")).filter(F.trim("author") != UNKNOWN_AUTHOR)


# --- authors from file names ------------------------------------------------------------


def extracted_authors(df: DataFrame, given: list[str] = (), least: float = 0.6) -> DataFrame:
    """file_path, found: the author that the best pattern finds in each file's
    name.  Where that is the book's title, patterns that begin with a title
    don't count.  '' for what doesn't look like an author."""
    rows = df.select("file_path", "file_title", without_marks(file_stem(F.col("file_path"))).alias("name"))
    first = match_patterns(rows, "name", known_names=list(given), least=least).withColumnRenamed("author", "a1").drop("best_score", "best_pattern", "series")
    both = match_patterns(first, "name", [p for p in FILE_PATTERNS if not p.startswith("Title")], list(given), least).withColumnRenamed("author", "a2")
    title = F.regexp_replace(F.trim("file_title"), r"\s*\[.*?\]\s*$", "")
    short = F.trim(F.regexp_replace(title, r"\s*\([^)]*\)\s*$", ""))
    is_title = lambda a: (a != "") & (fold(F.trim(a)).isin("") | (fold(title) == fold(F.trim(a))) | (fold(short) == fold(F.trim(a))))
    found = F.when(is_title(F.col("a1")), F.when(~is_title(F.col("a2")), F.col("a2"))).otherwise(F.col("a1"))
    parts = F.filter(F.transform(F.split(F.coalesce(F.trim(found), F.lit("")), ", "), lambda x: F.trim(x)), lambda a: a != "")
    fits = lambda a: N.looks_like_author(a, given) & is_valid_author(a)
    return both.select("file_path", parts.alias("parts")).select("file_path", F.when(F.size("parts") > 1, F.col("parts")).otherwise(F.filter("parts", fits)).alias("parts"))


def _meant(a: Column, metadata: Column, alias: Column) -> Column:
    """The fuller form of a name from a file's name: an alias of several words;
    else the metadata's author that is the same, bears the lone word (unless
    several do), begins with the same word and has as many, or ends with the
    same particle and surname; else an alias; else the name."""
    meta = F.filter(F.transform(F.split(metadata, ";"), lambda x: F.trim(x)), lambda m: (m != "") & (m != UNKNOWN_AUTHOR))
    low, words = F.lower(F.trim(a)), words_of(F.lower(a))
    lone = F.size(words) == 1
    bearers = F.filter(meta, lambda m: lone & F.array_contains(words_of(F.lower(m)), low))
    same = F.get(F.filter(meta, lambda m: F.lower(m) == low), 0)
    alike = F.get(F.filter(meta, lambda m: ~lone & (F.size(words_of(m)) == F.size(words)) & (F.get(words_of(F.lower(m)), 0) == F.get(words, 0))), 0)
    glue = lambda x: F.translate(F.lower(x), " '’ʼ", "")
    at = F.array_min(F.transform(words, lambda w, i: F.when(w.isin(NAME_PARTICLES), i)))
    tail = glue(F.array_join(F.slice(words, (F.coalesce(at, F.lit(0)) + 1).cast("int"), F.size(words)), " "))
    ended = F.get(F.filter(meta, lambda m: at.isNotNull() & (tail != "") & glue(m).contains(tail)), 0)
    from_meta = F.coalesce(same, F.when(F.size(bearers) > 0, F.rtrim(N.family_name_first(F.get(bearers, 0), low))), alike, ended)
    return F.when(~lone & alias.isNotNull(), alias).when((F.size(bearers) > 1) & (F.size(meta) > 1), a).otherwise(F.coalesce(from_meta, alias, a))


def authors_from_file_names(df: DataFrame, given: list[str] = ()) -> DataFrame:
    """Authors by file name, over metadata but never over a folder.

    Three or more authors in the metadata make an anthology (if the file's name
    says so) or a joint work.  Initials and lone words are completed from the
    metadata, names from what other files know.  Glued initials, two names joined
    by ``и`` and parts of the title give way to the metadata."""
    df = records(df)
    known = aliases(metadata_names(df))
    # Cut before the names are exploded: a filter on them would repeat how they were found.
    parts = cut(extracted_authors(df, given)).select("file_path", F.posexplode("parts").alias("pos", "name"))
    parts = parts.join(known.withColumnRenamed("full", "alias"), F.lower("name") == F.col("key"), "left").join(df.select("file_path", "metadata_authors"), "file_path")
    meant = parts.select("file_path", "pos", F.when(N.looks_like_author(F.col("name"), given) & is_valid_author(F.col("name")), _meant(F.col("name"), F.col("metadata_authors"), F.col("alias"))).otherwise(F.col("name")).alias("name"))
    found = meant.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), ", ").alias("found"))

    meta, n = F.col("metadata_authors"), N.author_count(F.col("metadata_authors"))
    out = df.join(cut(found), "file_path", "left").withColumn("found", F.coalesce("found", F.lit("")))
    out = out.withColumn("spelt", F.when(meta != "", N.spelt_initials(F.col("found"), meta)).otherwise(F.col("found")))
    short = is_incomplete_name(F.col("found")) | F.col("found").rlike(r"\s[А-ЯЁA-Z]\.\s")
    full = F.when(F.col("spelt") != F.col("found"), F.col("spelt")).when(short & (meta != ""), N.from_metadata(F.col("found"), meta)).otherwise(F.col("found"))
    out = cut(out.withColumn("full", F.when(F.col("found") == "", "").otherwise(full)).drop("spelt"))
    name, title = F.col("full"), F.col("file_title")
    glued, joined = name.rlike(r"^[А-ЯЁ]{2,}[А-ЯЁ][а-яё]"), name.rlike(r"\s+[иИ]\s+")
    in_title = (title != "") & F.lower(title).contains(F.lower(name))
    pair = F.array_join(N.metadata_list(meta), ", ")
    outcome = lambda author, source: F.struct(author.alias("author"), F.lit(source).alias("source") if isinstance(source, str) else source.alias("source"))
    own = outcome(F.col("proposed_author"), F.col("author_source"))
    chosen = (
        F.when(F.col("author_source") == "folder_dataset", own)
        .when(n >= 3, outcome(F.when(is_collection(file_stem(F.col("file_path"))), ANTHOLOGY).otherwise(COAUTHORS), "collection"))
        .when(name == "", F.when((meta != "") & (F.col("proposed_author") == ""), outcome(meta, "metadata")).otherwise(own))
        .when((meta != "") & (n == 2) & joined, outcome(pair, "metadata")).when((meta != "") & (n == 1) & (glued | in_title), outcome(meta, "metadata"))
        .otherwise(outcome(name, F.when(name != F.col("found"), "filename_meta_confirmed").otherwise("filename")))
    )
    out = out.withColumn("chosen", chosen).select(*[c for c in RECORD if c not in ("proposed_author", "author_source")], F.col("chosen.author").alias("proposed_author"), F.col("chosen.source").alias("author_source"))
    return cut(longest_forms(cut(out)).select(*RECORD))


def longest_forms(df: DataFrame) -> DataFrame:
    """Names from file names in the longest form that any record has under the
    same name, or under the same first word."""
    named = df.filter(F.col("author_source").isin("filename", "filename_meta_confirmed")).select(F.explode(F.split("proposed_author", ", ")).alias("author"), F.col("file_path").alias("seen"))
    known = aliases(metadata_names(df).unionByName(named))
    author = F.col("proposed_author")
    weak = ~F.col("author_source").isin("folder_dataset", "collection", "metadata") & (author != "")
    rows = df.withColumns({"__k": F.when(weak, F.lower(F.trim(author))), "__f": F.when(weak & (F.size(words_of(author)) > 1), F.lower(F.get(words_of(author), 0)))})
    rows = rows.join(known.select(F.col("key").alias("__k"), F.col("full").alias("__same")), "__k", "left").join(known.select(F.col("key").alias("__f"), F.col("full").alias("__first")), "__f", "left")
    size = lambda c: F.size(words_of(c))
    better = F.when(size(F.col("__same")) > size(author), F.col("__same")).when((size(F.col("__first")) > size(author)) & (F.lower(F.get(words_of(F.col("__first")), 0)) == F.col("__f")), F.col("__first"))
    return rows.withColumn("proposed_author", F.coalesce(better, author)).select(*df.columns)


def fall_back_to_metadata(df: DataFrame) -> DataFrame:
    """Records without an author take the metadata's: an anthology if three or
    more authors and the file's name say so."""
    none, meta = F.col("proposed_author") == "", F.col("metadata_authors")
    has = (meta != "") & (meta != UNKNOWN_AUTHOR)
    many = (N.author_count(meta) >= 3) & is_collection(file_name(F.col("file_path")))
    author = F.when(~none, F.col("proposed_author")).when(many, ANTHOLOGY).when(has, meta).otherwise("")
    source = F.when(~none, F.col("author_source")).when(many, "collection").when(has, "metadata").otherwise("")
    return _with(df, author_source=source, proposed_author=author)


def dataset_authors(df: DataFrame) -> DataFrame:
    """The first author that a folder's records have from the folder itself
    goes to all its records."""
    donors = df.filter((F.col("author_source") == "folder_dataset") & (F.col("proposed_author") != "")).groupBy(folder_of(F.col("file_path")).alias("__folder")).agg(F.min_by("proposed_author", "file_path").alias("__donor"))
    rows = df.withColumn("__folder", folder_of(F.col("file_path"))).join(donors, "__folder", "left")
    hit = F.col("__donor").isNotNull()
    return _with(rows, author_source=F.when(hit, "folder_dataset").otherwise(F.col("author_source")), proposed_author=F.coalesce("__donor", "proposed_author")).select(*df.columns)


# --- one form for each author -----------------------------------------------------------


def shared_surnames(df: DataFrame) -> DataFrame:
    """A lone surname from a file's name that several of the metadata's authors
    bear, up to its ending, becomes all of them."""
    name, meta = F.trim("proposed_author"), F.transform(split_authors(F.col("metadata_authors")), lambda x: F.trim(x))
    root = N.shared_surname_root(name)
    bearers = F.filter(meta, lambda m: F.array_contains(words_of(m), name) | (N.shared_surname_root(m) == root))
    lone = (F.col("author_source") == "filename") & (F.size(words_of(name)) == 1)
    everyone = F.array_join(bearers, "; ")
    return _with(df, proposed_author=F.when(lone & (F.size(bearers) > 1), everyone).otherwise(F.col("proposed_author")))


def normalise_authors(df: DataFrame, given: list[str] = ()) -> DataFrame:
    """Every author as ``Surname Given``, joined by ', '."""
    a, source, meta = F.col("proposed_author"), F.col("author_source"), F.col("metadata_authors")
    settled = (a == "") | (a == ANTHOLOGY)
    parts = F.transform(F.split(a, "[;,]"), lambda x: F.trim(x))
    once = let(N.distinct_names(F.filter(parts, lambda x: x != "")), lambda d: F.when(F.size(d) < F.size(parts), N.joined_as(a, d)).otherwise(a))
    collective = F.exists(parts, lambda p: fold(p) == "коллектив авторов")
    df = _with(df, proposed_author=F.when(settled, a).when(collective, ANTHOLOGY).otherwise(once))
    df = cut(shared_surnames(df))

    several = a.contains(", ") | a.contains("; ")
    by_name = source.isin("filename", "filename_meta_confirmed")
    use = F.when((source == "folder_dataset") & ~several, "").when(by_name & ~several & (F.size(words_of(a)) > 1), "").otherwise(meta)
    head = lambda c: F.translate(F.lower(F.get(words_of(c), 0)), "ё", "е")

    def ordered(n: Column) -> Column:
        # A name of several words from a file's name keeps its first word, unless the metadata has the other order.
        turned = by_name & ~several & (F.size(words_of(a)) > 1) & (n != "") & (head(a) != head(n)) & ~F.coalesce(head(meta) == head(n), F.lit(False))
        return F.when(turned, F.translate(N.converted(a), "ё", "е")).when(n == "", a).otherwise(n)

    normal = N.normal_authors(df, "file_path", a, use, given)
    df = df.join(normal, "file_path", "left").withColumn("proposed_author", F.when(a.isin("", ANTHOLOGY) | (source == "folder_multiauthor") | F.isnull("normal"), a).otherwise(ordered(F.col("normal")))).select(*df.columns)
    df = cut(df)
    done = a.isin("", *FINAL)
    after_colon = F.trim(F.when(a.contains("："), F.regexp_replace(a, r"^.*?：", "")).when(a.contains(":"), F.regexp_replace(a, r"^.*?:", "")).otherwise(a))
    df = _with(df, proposed_author=F.when(done, a).otherwise(capitalise(a)))
    df = _with(df, proposed_author=F.trim(F.regexp_replace(after_colon, _ILLEGAL_AUTHOR, "")))
    return cut(_with(cut(df), proposed_author=F.when(done, a).otherwise(two_word_authors(a)), proposed_series=yo_to_ye(F.col("proposed_series"))))


def two_word_authors(c: Column) -> Column:
    """At most two words an author, single letters dotted, each author once."""
    dotted = lambda w: F.when(w.rlike(r"^[А-ЯЁA-Z]\.?$"), F.concat(F.substring(w, 1, 1), F.lit("."))).otherwise(w)
    names = F.filter(F.transform(F.split(F.replace(c, F.lit("; "), F.lit(", ")), ", "), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(N.distinct_names(F.transform(names, lambda x: F.array_join(F.transform(F.slice(words_of(x), 1, 2), dotted), " "))), ", ")


def convert_authors(df: DataFrame) -> DataFrame:
    return _with(df, proposed_author=N.converted(F.col("proposed_author")))


def full_names(df: DataFrame, given: list[str] = ()) -> DataFrame:
    """surname, full, words, at of every full name that records or their metadata have."""
    proposed = df.filter(F.col("proposed_author") != ANTHOLOGY).select(F.explode(F.split("proposed_author", ", ")).alias("name"), F.col("file_path").alias("at"), F.lit(0).alias("kind"))
    meta = df.filter(F.col("metadata_authors") != ANTHOLOGY).select(F.explode(split_authors(F.col("metadata_authors"))).alias("name"), F.col("file_path").alias("at"))
    meta = meta.groupBy(F.trim("name").alias("name")).agg(F.min("at").alias("at")).join(cut(N.normal_names(meta.select(F.trim("name").alias("name")), given)), "name")
    meta = meta.select(N.with_initials(F.col("name"), F.col("normal")).alias("name"), "at", F.lit(1).alias("kind"))
    every = proposed.filter(~F.col("name").contains(".")).unionByName(meta).filter(F.trim("name") != "")
    first = every.groupBy(F.trim("name").alias("full")).agg(F.min(F.struct("at", "kind")).alias("at"))
    return first.select(F.lower(F.get(words_of(F.col("full")), 0)).alias("surname"), "full", F.size(words_of(F.col("full"))).alias("words"), "at")


def expand_authors(df: DataFrame, given: list[str] = ()) -> DataFrame:
    """``Surname X.`` and ``X. Surname`` become the first full name of that
    surname with that initial, a lone surname the longest one; then each author
    counts once, and a series that is the author goes."""
    known = full_names(df, given)
    parts = df.filter((F.col("proposed_author") != "") & (F.col("proposed_author") != ANTHOLOGY)).select("file_path", F.posexplode(split_authors(F.col("proposed_author"))).alias("pos", "name"))
    name = F.trim("name")
    before, behind = r"([А-Я])\.\s*([А-ЯЁа-яё]+)", r"([А-ЯЁа-яё]+)\s*([А-Я])\."
    surname = F.when(name.rlike(before), F.regexp_extract(name, before, 2)).when(name.rlike(behind), F.regexp_extract(name, behind, 1))
    initial = F.when(name.rlike(before), F.regexp_extract(name, before, 1)).when(name.rlike(behind), F.regexp_extract(name, behind, 2))
    dotted, lone = name.contains("."), F.size(words_of(name)) == 1
    parts = parts.withColumns({"s": F.lower(F.when(dotted, surname).when(lone, name)), "i": F.when(dotted, initial).otherwise("")})
    # One full name for each surname and initial, and one for each surname.
    by_initial = known.filter("words >= 2").withColumn("i", F.upper(F.substring(F.get(words_of(F.col("full")), 1), 1, 1))).groupBy("surname", "i").agg(F.min_by("full", F.struct("at", "full")).alias("as"))
    longest = known.groupBy("surname").agg(F.min_by("full", F.struct(-F.col("words"), F.col("at"), F.col("full"))).alias("as")).filter(F.size(words_of(F.col("as"))) > 1)
    by = by_initial.unionByName(longest.select("surname", F.lit("").alias("i"), "as")).select(F.col("surname").alias("s"), "i", "as")
    names = parts.join(by, ["s", "i"], "left").select("file_path", "pos", F.coalesce("as", F.trim("name")).alias("name"))
    joined = names.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("__names"))
    once = F.when(F.col("__names").isNotNull(), N.joined_as(F.col("proposed_author"), N.distinct_names(F.col("__names"))))
    out = cut(df.join(joined, "file_path", "left").withColumn("proposed_author", F.coalesce(once, "proposed_author")).select(*df.columns))
    same = (F.col("proposed_series") != "") & (fold(F.trim("proposed_series")) == fold(F.trim("proposed_author")))
    return _with(out, series_source=F.when(same, "").otherwise(F.col("series_source")), proposed_series=F.when(same, "").otherwise(F.col("proposed_series")))


def clear_collections(df: DataFrame) -> DataFrame:
    """Records whose author is a kind of collection have no series."""
    hit = (F.col("proposed_author") != "") & contains_any(F.col("proposed_author"), COLLECTION_KEYWORDS)
    return _with(df, series_source=F.when(hit, "").otherwise(F.col("series_source")), proposed_series=F.when(hit, "").otherwise(F.col("proposed_series")))


def clean_names(df: DataFrame) -> DataFrame:
    """Authors and series as names of folders: no illegal characters, nothing
    but a letter, bracket or '!' at the end, a colon as a full stop."""
    end = r"[.,…;: \t]+$"
    s = F.col("proposed_series")
    # ": x" as ". X": the letters after colons are put back in upper case.
    pieces = F.split(s, r":\s*")
    s = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))), ". ")
    s = F.regexp_replace(F.trim(F.regexp_replace(s, _ILLEGAL_SERIES, "")), end, "")
    s = F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))
    a = F.regexp_replace(F.trim(F.regexp_replace("proposed_author", _ILLEGAL_AUTHOR, "")), end, "")
    return _with(df, proposed_series=s, proposed_author=a)


# --- folders ----------------------------------------------------------------------------


def folder_authors(files: DataFrame, given: list[str], most_depth: int = 5) -> DataFrame:
    """folder, author, confidence of the folders above ``files`` (file_path)
    whose name tells a person: high where files lie in it, low where only
    folders do.  Folders named like an extension don't count in the depth."""
    path = F.translate(F.col("file_path"), "\\", "/")
    from ..functions.predicates import without_extension_folders
    from .paths import ancestors

    each = files.select(F.explode(ancestors(path)).alias("folder"), folder_of(F.col("file_path")).alias("own"))
    folders = each.groupBy("folder").agg(F.bool_or(F.col("folder") == F.col("own")).alias("holds"))
    parts = without_extension_folders(F.split("folder", "/"))
    name = F.element_at(F.split("folder", "/"), -1)
    named = folders.filter((F.size(parts) <= most_depth) & ~name.startswith(".") & F.array_contains(parts, name))
    told = named.withColumn("author", N.folder_author(N.converted(name), given)).filter("author <> ''")
    return told.filter(N.has_known_name(F.col("author"), given)).select("folder", "author", F.when(F.col("holds"), "high").otherwise("low").alias("confidence"))


def author_pass(df: DataFrame, given: list[str] = ()) -> DataFrame:
    """File names, metadata, one form, conversions, expansions, in this order."""
    out = authors_from_file_names(dataset_authors(records(df)), given)
    out = normalise_authors(fall_back_to_metadata(out), given)
    return clean_names(clear_collections(expand_authors(convert_authors(out), given)))


def best_of_sources(by_folder: Column, by_name: Column, by_metadata: Column, metadata: Column) -> Column:
    """struct(author, source, confirmed) by priority: folder, file name,
    metadata; confirmed if the metadata has a word of it."""
    words = lambda c: words_of(F.regexp_replace(fold(c), r"[.,;]", " "))
    one = lambda c, source: F.when(c != "", F.struct(c.alias("author"), F.lit(source).alias("source"), F.arrays_overlap(words(c), words(metadata)).alias("confirmed")))
    return F.coalesce(one(by_folder, "folder_dataset"), one(by_name, "filename"), one(by_metadata, "metadata"), F.struct(F.lit("").alias("author"), F.lit("").alias("source"), F.lit(False).alias("confirmed")))


def metadata_majority(df: DataFrame, share: float = 0.6) -> DataFrame:
    """Names of one word take the form that the metadata of their folder has
    for them in at least ``share`` of its records."""
    rows = df.withColumn("__folder", folder_of(F.col("file_path")))
    sets = rows.filter((F.col("metadata_authors") != "") & (F.col("metadata_authors") != UNKNOWN_AUTHOR)).groupBy("__folder", "metadata_authors").agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("seen"))
    everyone = Window.partitionBy("__folder")
    best = F.row_number().over(everyone.orderBy(F.desc("n"), "seen"))
    sets = sets.withColumns({"rn": best, "all": F.sum("n").over(everyone)}).filter((F.col("rn") == 1) & (F.col("n") >= share * F.col("all"))).select("__folder", F.col("metadata_authors").alias("__meta"))
    rows = rows.join(sets, "__folder", "left")
    name = F.col("proposed_author")
    short = (F.size(words_of(name)) == 1) & ~F.col("author_source").isin("folder_dataset", "collection")
    full = F.when(short & F.col("__meta").isNotNull(), N.from_metadata(name, F.col("__meta"))).otherwise(name)
    return rows.withColumns({"proposed_author": squeeze(full)}).select(*df.columns)
