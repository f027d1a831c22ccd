"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions only.

Candidates are found row by row with regular expressions. The values' hashes are then counted over the whole corpus by
distinct owner, repository and document: a value that many of either share is a widely copied example, a value of few
looks live. Long mixed tokens without any keyword are reported only when that count finds them specific to an owner.

Scale: one pass over the texts writes the spans of each row (the text itself is never shuffled). Counts of
distinct owners and repositories are pre-aggregated before the shuffle; documents are dealt by value and document, so a value in
a third of all rows is counted by all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.common import row_key, staged, whole_text

# The base kinds in their order, their patterns and the least length of what counts.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # maximal runs, so a shorter run can be left out by the pattern itself
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
# Candidates without a keyword: runs of 20 or more token characters; those with both a letter and a digit count.
OWNED = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
MIXED = "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"

#: A value of more owners, places (owner and repository) or documents is a widely copied example.
MAX_OWNERS, MAX_REPOSITORIES, MAX_DOCUMENTS = 2, 4, 20

_SPAN = "struct<start:long,rank:int,end:long,kind:string,hash:binary>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _spans(text: str, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """All matches of ``pattern`` in code points, start first; what stands between the matches gives their places."""
    t = F.col(text)
    whole, value = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.expr(_NONE).alias("out"))

    def step(seen: Column, part: Column) -> Column:
        begin = seen["pos"] + F.char_length(part["gap"])
        end = begin + F.char_length(part["whole"])
        span = F.struct(
            begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
            F.unhex(F.md5(part["value"])).alias("hash"),
        )
        # the last part has a gap only, and its span is null
        longer = F.when(F.char_length(part["value"]) >= least, F.concat(seen["out"], F.array(span))).otherwise(seen["out"])
        return F.struct(F.coalesce(end, begin).cast("long").alias("pos"), longer.cast(f"array<{_SPAN}>").alias("out"))

    found = F.aggregate(parts, start, step, lambda seen: seen["out"])
    return F.when(t.rlike(pattern), found).otherwise(F.expr(_NONE))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """Per row: key, id, owner, repository, base spans, and token-like runs that touch no base span."""
    rows = docs.select(
        F.col(id_col).alias("id"), owner.cast("string").alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), whole_text(text_col).alias("text"),
    )
    found = rows.select(
        "id", "owner", "repository", row_key("id", F.col("text")).alias("key"),
        *[_spans("text", k, i, p, g, n).alias(k) for i, (k, p, g, n) in enumerate(KINDS)],
        F.when(F.col("text").rlike(OWNED), F.col("text")).alias("text"),
    )
    merged = found.select(
        "id", "owner", "repository", "key", F.array_sort(F.concat("assign", "access", "hex")).alias("base"),
        _spans("text", "owned", len(KINDS), OWNED, 0, 20).alias("runs"),
        F.regexp_extract_all("text", F.lit(OWNED), F.lit(0)).alias("values"),
    )
    mixed = F.filter(
        F.coalesce(F.arrays_zip(F.col("runs").alias("run"), F.col("values").alias("value")), F.array()),
        lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
        & ~F.exists("base", lambda b: (b["start"] < x["run"]["end"]) & (x["run"]["start"] < b["end"])),
    )
    return merged.select("id", "owner", "repository", "key", "base", F.transform(mixed, lambda x: x["run"]).alias("owned"))


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash: distinct known owners, distinct places (owner and repository), distinct documents, occurrences."""
    each = found.select("key", "owner", F.struct("owner", "repository").alias("place"), F.explode(F.concat("base", "owned")).alias("s"))
    return each.groupBy(F.col("s.hash").alias("hash")).agg(
        F.count_distinct("owner").alias("owners"), F.count_distinct("place").alias("repositories"),
        F.count_distinct("key").alias("documents"), F.count(F.lit(1)).alias("occurrences"),
    )


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None,
    repository: Column | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES,
    max_documents: int = MAX_DOCUMENTS,
) -> DataFrame:
    """Per row of ``docs``: ``id``, ``key`` (of id and text), ``base`` spans, and ``all`` spans with each value's ``live`` mark.

    ``owner`` names who a row belongs to, ``repository`` the place below it (default: the columns ``source`` and, within it,
    ``lang``). A value of at most ``max_owners`` owners, ``max_repositories`` places and ``max_documents`` documents looks live; of
    more of any, it is a widely copied example. A null owner is unknown: it counts as no owner, its places and documents count. ``all`` holds the base spans and the live-looking runs without keyword, by start, then kind.
    Null text is empty; rows that repeat id and text get the same spans; an empty table gives no rows.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.col("lang") if repository is None else repository
    found = staged(candidates(docs, id_col, text_col, owner, repository))
    few = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories) & (F.col("documents") <= max_documents)
    live = ownership(found).select("hash", few.alias("live"))
    each = found.select("key", F.explode(F.concat("base", "owned")).alias("s"))
    judged = (
        each.join(live, F.col("s.hash") == F.col("hash"))
        .where((F.col("s.kind") != "owned") | F.col("live"))
        .groupBy("key")
        .agg(F.collect_set(F.struct("s.start", "s.rank", "s.end", "s.kind", "live")).alias("all"))
    )
    none = F.expr("cast(array() as array<struct<start:long,rank:int,end:long,kind:string,live:boolean>>)")
    return found.select("id", "key", "base").join(judged, "key", "left").select(
        F.col("id").alias(id_col), "key", "base", F.coalesce(F.array_sort("all"), none).alias("all")
    )


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """``text`` with every span replaced; spans come sorted by start and may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))

    def step(seen: Column, s: Column) -> Column:
        gap = F.substr(text, seen["pos"] + 1, s["start"] - seen["pos"])
        apart = F.concat(seen["out"], gap, F.lit(by))
        return F.struct(
            F.greatest(s["end"], seen["pos"]).alias("pos"),
            F.when(s["start"] >= seen["pos"], apart).otherwise(seen["out"]).alias("out"),
        )

    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substr(text, a["pos"] + 1)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_owners: int = MAX_OWNERS) -> DataFrame:
    """``docs`` with live-looking secrets replaced by ``[SECRET]``; widely copied examples and all other text stay.

    ``n_chars``, where there is one, follows the new text. Only texts that hold a candidate are shuffled to meet the verdicts.
    """
    scanned = scan_secrets(docs, id_col, text_col, max_owners=max_owners)
    live = scanned.select(
        F.col("key").alias("_key"), F.filter("all", lambda s: s["live"]).alias("_spans")
    ).where(F.size("_spans") > 0).dropDuplicates(["_key"])
    some = F.lit(False)
    for pattern in (ASSIGN, ACCESS, HEX, MIXED):
        some = some | whole_text(text_col).rlike(pattern)
    rows = docs.where(some).select(F.struct(*docs.columns).alias("_row"), row_key(id_col, whole_text(text_col)).alias("_own"))
    hit, text = F.col("_spans").isNotNull(), F.col("_row")[text_col]
    out = rows.join(live, F.col("_own") == F.col("_key"), "left").withColumn("_new", F.when(hit, mask(text, F.col("_spans"))).otherwise(text))
    changed = {text_col: F.col("_new")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(hit, F.char_length("_new").cast(kind)).otherwise(F.col("_row")["n_chars"])
    return docs.where(~some).unionByName(out.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns]))
