"""Pages, counts and key lookups."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewarden.schemas import LINK_UNLINKED

MAX_PAGE = 1000
#: Rows that are simply taken from the head, and ranges of one count.
SHALLOW, PAGE_RANGES = 10_000, 64

# The columns of the lists, in their order.
INCIDENT_BRIEF = (
    "id",
    "incident_date",
    "incident_time",
    "company",
    "dzo",
    "classification",
    "region",
    "location",
    "victim_name",
    "victim_birth_date",
    "victim_position",
    "victim_work_experience",
    "injury_type",
    "diagnosis",
    "description",
    "investigation_status",
    "work_type",
    "equipment",
    "safety_responsible_person",
    "weather_conditions",
    "victim_count",
    "fatality_count",
    "safety_training_completed",
    "is_recurrent",
    "regulatory_compliant",
    "created_at",
    "updated_at",
)
ACT_BRIEF = (
    "id",
    "incident_id",
    "link_status",
    "act_type",
    "act_date",
    "language",
    "original_filename",
    "victim_name",
    "company_name",
    "cause_categories",
    "violation_types",
    "industry_tags",
    "uploaded_at",
)


def brief(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The list projection, limited to the columns the table has."""
    return df.select(*[c for c in columns if c in df.columns])


def page(df: DataFrame, order: str = "incident_date", limit: int = 50, offset: int = 0, key: str = "id", shallow: int = SHALLOW) -> DataFrame:
    """Newest first with the key as tie-break, so that pages join up to the full order.

    Up to ``shallow`` rows the head of the table is taken; a deeper page is found by counting (``_narrowed``), so only rows near it are sorted.
    """
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("limit must be 1..1000 and offset not negative")
    if offset + limit > shallow:
        df, offset = _narrowed(df, order, key, limit, offset, shallow)
    return df.orderBy(F.col(order).desc_nulls_last(), F.col(key)).offset(offset).limit(limit)


def page_after(df: DataFrame, last_order, last_key, order: str = "incident_date", limit: int = 50, key: str = "id") -> DataFrame:
    """The page after the row with these values: a filter instead of an offset. A null ``last_order`` is the tail without a value."""
    same_key = F.col(key) > F.lit(last_key)
    if last_order is None:
        rest = df.where(F.col(order).isNull() & same_key)
    else:
        last = F.lit(last_order)
        rest = df.where((F.col(order) < last) | F.col(order).isNull() | ((F.col(order) == last) & same_key))
    return rest.orderBy(F.col(order).desc_nulls_last(), F.col(key)).limit(limit)


def _narrowed(df: DataFrame, order: str, key: str, limit: int, offset: int, enough: int) -> tuple[DataFrame, int]:
    """The rows around a deep page, and its offset among them.

    Rows are counted per range of the order column (bounds from a sketch of fixed size); ranges before the page are skipped by their
    counts, those behind it dropped. This repeats within the ranges that are left, then by key where one value fills them. Only columns a sketch takes
    (numbers, dates, timestamps) are narrowed.
    """
    rows, column, descending = df, order, True
    sketched = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    while isinstance(df.schema[column].dataType, sketched):
        value = F.col(column)
        found = rows.agg(F.percentile_approx(column, [i / PAGE_RANGES for i in range(PAGE_RANGES + 1)]).alias("bounds"), F.min(column).alias("low"),
                         F.max(column).alias("high"), F.count(F.lit(1)).alias("n"), F.count(column).alias("known")).first()
        bounds, known = sorted(set(found.bounds or [])), found.known
        if descending and offset >= known < found.n:  # among the rows without a value, which come last
            rows, offset, column, descending = rows.where(value.isNull()), offset - known, key, False
            continue
        if found.n <= enough or offset + limit > known or (not descending and known < found.n):
            return rows, offset
        rows = rows.where(value.isNotNull())
        if found.low == found.high:  # one value fills the rows: the key decides
            if not descending:
                return rows, offset
            column, descending = key, False
            continue
        place = reduce(lambda a, b: a + b, [(value > F.lit(b)).cast("int") for b in bounds])
        counts = sorted((r.p, r["count"]) for r in rows.groupBy(place.alias("p")).count().collect())  # a row per range
        before, inside = 0, []
        for p, n in reversed(counts) if descending else counts:
            if before < offset + limit and before + n > offset:
                inside.append((p, before, n))
            before += n
        low, high = min(p for p, _, _ in inside), max(p for p, _, _ in inside)
        # Range p holds the values above bound p - 1, up to bound p.
        if low > 0:
            rows = rows.where(value > F.lit(bounds[low - 1]))
        if high < len(bounds):
            rows = rows.where(value <= F.lit(bounds[high]))
        offset -= inside[0][1]
        if len(inside) > 1 or inside[0][2] == known:  # the page lies across a bound, or the sketch cannot divide the rest
            return rows, offset
    return rows, offset


def count_filtered(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def lookup(df: DataFrame, keys: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose ``column`` is among ``keys`` (same column name): records by id, or children by parent."""
    return df.join(keys.select(column), column, "left_semi")


def unlinked(acts: DataFrame) -> DataFrame:
    """The work queue: acts without a link, newest upload first."""
    return acts.where(F.col("link_status") == LINK_UNLINKED).orderBy(F.col("uploaded_at").desc(), F.col("id"))


def candidates(incidents: DataFrame, day: datetime.date, days: int = 3) -> DataFrame:
    """Incidents within ``days`` of one date; both bounds reach the scan."""
    span = datetime.timedelta(days=days)
    return incidents.where(F.col("incident_date").between(F.lit(day - span), F.lit(day + span)))
