"""Linking investigation acts to incidents by a weighted fuzzy score.

The score of a pair is 0.35 date + 0.30 name + 0.20 company + 0.10 region + 0.05 severity, a link needs 0.80.
Scoring every pair of a date window is quadratic in the busiest date, so the search is blocked exactly:

1. copies collapse: rows equal in everything the score looks at are one profile (partial aggregate, then shuffle);
2. profiles meet in blocks: the acts of some neighbouring dates with the incidents of these and the dates around, in as many
   blocks as the rows of a band of dates need, so that a task holds a bounded number of either side whatever one date holds;
3. in a block (``operators/namesearch``) contexts are scored once, an act meets equal names first, then the contexts that offer most,
   and goes on only where that could beat what it has; bounds from sizes and letters drop pairs before names are compared;
4. the best of the blocks of an act is its match.

No step drops a pair that could reach the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyarrow import Table
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewarden.functions.frames import computed_once
from sitewarden.functions.similarity import SIMILARITIES
from sitewarden.functions.text import norm_text
from sitewarden.operators.namesearch import ACT_KEY, PARTS, Rule, best_in_block
from sitewarden.operators.upsert import apply_links
from sitewarden.schemas import INJURY_FATAL, LINK_AUTO, LINK_UNLINKED
from sitewarden.session import staged

# Fixed values of the score.
MATCH_THRESHOLD = 0.80
SUBSTRING_SCORE = 0.9
SEVERITY_MISMATCH = 0.3
WINDOW_DAYS = 3
SEVERITY_KEYWORDS = {
    "смертельн": "смертельн",
    "летальн": "смертельн",
    "тяжел": "тяжел",
    "тяжёл": "тяжел",
    "лёгк": "лёгк",
    "легк": "лёгк",
    "групповой": "групповой",
    "групповых": "групповой",
}


@dataclass(frozen=True)
class Weights:
    date: float = 0.35
    name: float = 0.30
    company: float = 0.20
    region: float = 0.10
    injury: float = 0.05


DEFAULT_WEIGHTS = Weights()
_SLACK = 1e-9
#: Acts in a block; eight times as many incidents.
_ROWS_PER_SALT = 32768


def score_date(a: Column, b: Column) -> Column:
    """Linear decay over three days; null and anything further apart score 0."""
    gap = F.abs(F.datediff(a, b))
    return F.when(gap <= WINDOW_DAYS, F.lit(1.0) - gap / F.lit(4.0)).otherwise(F.lit(0.0))


def _ratio(a: Column, b: Column, similarity: str) -> Column:
    return SIMILARITIES[similarity][0](a, b)


def score_name(act: Column, incident: Column, similarity: str = "ratcliff") -> Column:
    a, b = norm_text(act), norm_text(incident)
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(_ratio(a, b, similarity))


def _contained_or_ratio(a: Column, b: Column, similarity: str) -> Column:
    """Normalised texts: 0.9 if one contains the other (equality included), else the ratio; empty scores 0."""
    contained = a.contains(b) | b.contains(a)
    # The arguments are nulled where the ratio is not needed, so that no work is done for them.
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(contained, F.lit(SUBSTRING_SCORE))
        .otherwise(_ratio(F.when(~contained, a), F.when(~contained, b), similarity))
    )


def score_company(act: Column, company: Column, dzo: Column, similarity: str = "ratcliff") -> Column:
    a = norm_text(act)
    return F.greatest(
        _contained_or_ratio(a, norm_text(company), similarity), _contained_or_ratio(a, norm_text(dzo), similarity)
    )


def score_region(act: Column, incident: Column, similarity: str = "ratcliff") -> Column:
    return _contained_or_ratio(norm_text(act), norm_text(incident), similarity)


def severity_class(text: Column) -> Column:
    """Class of the last keyword (in table order) the text contains, null if none."""
    a = norm_text(text)
    return F.coalesce(*[F.when(a.contains(k), F.lit(v)) for k, v in reversed(SEVERITY_KEYWORDS.items())])


def _score_classes(a: Column, b: Column) -> Column:
    return (
        F.when(a.isNull() | b.isNull(), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.lit(SEVERITY_MISMATCH))
    )


def score_injury(act: Column, incident: Column) -> Column:
    return _score_classes(severity_class(act), severity_class(incident))


def match_score(date: Column, name: Column, company: Column, region: Column, injury: Column, w: Weights = DEFAULT_WEIGHTS) -> Column:
    return (
        F.lit(w.date) * date
        + F.lit(w.name) * name
        + F.lit(w.company) * company
        + F.lit(w.region) * region
        + F.lit(w.injury) * injury
    )


def pair_scores(pairs: DataFrame, similarity: str = "ratcliff", w: Weights = DEFAULT_WEIGHTS) -> DataFrame:
    """All component scores and the total for given act/incident pairs (columns of both tables side by side)."""
    c = F.col
    return pairs.withColumns(
        {
            "score_date": score_date(c("incident_date_from_act"), c("incident_date")),
            "score_name": score_name(c("victim_name_from_act"), c("victim_name"), similarity),
            "score_company": score_company(c("company_name_from_act"), c("company"), c("dzo"), similarity),
            "score_region": score_region(c("region_from_act"), c("region"), similarity),
            "score_injury": score_injury(c("injury_severity"), c("injury_type")),
        }
    ).withColumn(
        "score",
        match_score(c("score_date"), c("score_name"), c("score_company"), c("score_region"), c("score_injury"), w),
    )


def _on_dates(acts: DataFrame, days: int) -> DataFrame:
    """One row per act and date of its window; lossless equi-join form of ``|date difference| <= days``."""
    day = F.col("incident_date_from_act")
    return acts.where(day.isNotNull()).withColumn(
        "day", F.explode(F.sequence(F.date_sub(day, days), F.date_add(day, days)))
    )


def date_candidates(acts: DataFrame, incidents: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Per act with a date: how many incidents lie within ``days``, with the least and greatest id.

    Incidents are counted per date first, so the join never multiplies the rows of a busy date.
    """
    per_day = (
        incidents.where(F.col("incident_date").isNotNull())
        .groupBy(F.col("incident_date").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    )
    return (
        _on_dates(acts.select("id", "incident_date_from_act"), days)
        .join(per_day, "day")
        .groupBy(F.col("id").alias("act_id"))
        .agg(F.sum("n").alias("n_candidates"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
    )


def reachable_days(threshold: float = MATCH_THRESHOLD, w: Weights = DEFAULT_WEIGHTS, days: int = WINDOW_DAYS) -> int:
    """The widest date gap that can still reach the threshold when everything else is perfect (-1: none)."""
    rest = w.name + w.company + w.region + w.injury
    reached = [d for d in range(days + 1) if w.date * (1 - d / 4) + rest >= threshold - _SLACK]
    return max(reached, default=-1)


def best_match(
    acts: DataFrame,
    incidents: DataFrame,
    threshold: float = MATCH_THRESHOLD,
    similarity: str = "ratcliff",
    w: Weights = DEFAULT_WEIGHTS,
) -> DataFrame:
    """Best incident per act: ``act_id, incident_id, score``; equal scores go to the lower incident id."""
    rest_without_name = w.date + w.company + w.region + w.injury
    if rest_without_name >= threshold:
        raise ValueError("the name must be needed to reach the threshold; blocking relies on it")
    days = reachable_days(threshold, w)
    text = lambda c: norm_text(F.col(c))
    tasks = 4 * int(acts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # 1. profiles ---------------------------------------------------------------------------------------------
    act_rows = staged(
        acts.where(F.col("incident_date_from_act").isNotNull())
        .select(
            F.col("id").alias("act_id"),
            F.col("incident_date_from_act").alias("a_date"),
            text("victim_name_from_act").alias("a_name"),
            text("company_name_from_act").alias("a_company"),
            text("region_from_act").alias("a_region"),
            F.coalesce(severity_class(F.col("injury_severity")), F.lit("")).alias("a_class"),
        )
        .where(F.col("a_name") != "")
    )
    act_profiles = staged(act_rows.groupBy(*ACT_KEY).agg(F.min("act_id").alias("profile")).where(F.col("profile").isNotNull()).drop("profile"))
    inc_key = ("day", "i_company", "i_dzo", "i_region", "i_class", "i_name")
    inc_profiles = staged(
        incidents.where(F.col("incident_date").isNotNull())
        .select(
            "id",
            F.col("incident_date").alias("day"),
            text("victim_name").alias("i_name"),
            text("company").alias("i_company"),
            text("dzo").alias("i_dzo"),
            text("region").alias("i_region"),
            F.coalesce(severity_class(F.col("injury_type")), F.lit("")).alias("i_class"),
        )
        .where(F.col("i_name") != "")
        .groupBy(*inc_key)
        .agg(F.min("id").alias("incident_id"))
    )

    # 2. blocks: some neighbouring dates of acts with all incidents around, split where that is too many ---------------------
    n_acts, dates = act_profiles.agg(F.count(F.lit(1)), F.countDistinct("a_date")).first()
    n_incidents, days_with = inc_profiles.agg(F.count(F.lit(1)), F.countDistinct("day")).first()
    most_incidents = 8 * _ROWS_PER_SALT
    wide = max(1, min(
        _ROWS_PER_SALT * dates // max(1, n_acts), most_incidents * days_with // max(1, n_incidents) - 2 * days, dates // tasks))
    band = lambda day, shift=0: F.floor((F.unix_date(day) + shift) / wide)
    act_bands = act_profiles.withColumn("band", band("a_date"))
    inc_bands = inc_profiles.withColumn("band", F.explode(F.sequence(band("day", -days), band("day", days))))
    in_parts = lambda most: F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int")
    sizes = staged(
        act_bands.groupBy("band").agg(in_parts(_ROWS_PER_SALT).alias("a_blocks"))
        .join(inc_bands.groupBy("band").agg(in_parts(most_incidents).alias("i_blocks")), "band")
    )
    block = ("band", "a_block", "i_block")

    def dealt(rows: DataFrame, key: tuple[str, ...], own: str, other: str) -> GroupedData:
        """Every row into one block of its own side, with each of the other side."""
        return (
            rows.join(sizes, "band")
            .withColumn(f"{own}_block", F.pmod(F.xxhash64(*key), F.col(f"{own}_blocks")).cast("int"))
            .withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
            .drop("a_blocks", "i_blocks")
            .repartition(tasks, *block)
            .groupBy(*block)
        )

    # 3. the best incident of an act in each block, then of all; its score is computed from the names once more -----------------
    rule = Rule(threshold, days, similarity, (w.date, w.name, w.company, w.region, w.injury), SUBSTRING_SCORE, SEVERITY_MISMATCH)

    def search(block_acts: Table, block_incidents: Table) -> Table:
        return best_in_block(block_acts, block_incidents, rule)

    fields = [act_profiles.schema[c] for c in ACT_KEY] + [inc_profiles.schema[c] for c in ("incident_id", "i_name")]
    fields += [T.StructField(c, T.DoubleType()) for c in (*PARTS, "s_name")]
    found = dealt(act_bands, ACT_KEY, "a", "i").cogroup(dealt(inc_bands, inc_key, "i", "a")).applyInArrow(search, T.StructType(fields))
    names = F.col("a_name"), F.col("i_name"), F.col("s_name") - F.lit(_SLACK)
    scored = computed_once(found, {"s_name": SIMILARITIES[similarity][0](*names)})
    score = match_score(F.col("s_date"), F.col("s_name"), F.col("s_company"), F.col("s_region"), F.col("s_injury"), w)
    best = (
        scored.withColumn("score", score)
        .where(F.col("score") >= threshold)
        .groupBy(*ACT_KEY)
        .agg(F.min(F.struct((-F.col("score")).alias("minus"), "incident_id")).alias("hit"))
    )
    return act_rows.join(best, list(ACT_KEY)).select(
        "act_id", F.col("hit.incident_id").alias("incident_id"), (-F.col("hit.minus")).alias("score")
    )


def adopt(
    acts: DataFrame, new_incidents: DataFrame, relink_explicit: bool = False, similarity: str = "ratcliff"
) -> tuple[DataFrame, DataFrame]:
    """Unlinked acts against newly created incidents: ``(acts after linking, links)``.

    An act uploaded with an explicit incident keeps the "unlinked" state; ``relink_explicit=True`` lets adoption
    move such an act to another incident, the default leaves it alone.
    """
    open_acts = acts.where(F.col("link_status") == LINK_UNLINKED)
    if not relink_explicit:
        open_acts = open_acts.where(F.col("incident_id").isNull())
    links = best_match(open_acts, new_incidents, similarity=similarity).withColumn("link_status", F.lit(LINK_AUTO))
    return apply_links(acts, links), links


def link_on_upload(acts: DataFrame, incidents: DataFrame, similarity: str = "ratcliff") -> DataFrame:
    """New acts with their links: those without an explicit incident are matched, the rest are left unlinked."""
    links = best_match(acts.where(F.col("incident_id").isNull()), incidents, similarity=similarity)
    return apply_links(acts, links.withColumn("link_status", F.lit(LINK_AUTO)))


def backfill_links(acts: DataFrame) -> DataFrame:
    """Acts that have an incident become auto-linked."""
    return acts.withColumn(
        "link_status", F.when(F.col("incident_id").isNotNull(), F.lit(LINK_AUTO)).otherwise(F.col("link_status"))
    )


def backfill_fatality(incidents: DataFrame) -> DataFrame:
    """``fatality_count`` becomes 1 where the injury is fatal."""
    kind = incidents.schema["fatality_count"].dataType
    return incidents.withColumn(
        "fatality_count",
        F.when(F.col("injury_type") == INJURY_FATAL, F.lit(1)).otherwise(F.col("fatality_count")).cast(kind),
    )
