"""Optional predicates over incidents and acts; unset fields add nothing, set fields are ANDed."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce
from uuid import UUID

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden import schemas as S
from sitewarden.functions.text import any_of, icontains

_AT_LEAST, _AT_MOST = "__ge__", "__le__"


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _require_domain(name: str, values, domain) -> None:
    for value in values or ():
        _require(value in domain, f"{name}: {value!r} is outside the domain")


@dataclass(frozen=True)
class IncidentFilters:
    date_from: datetime.date | None = None
    date_to: datetime.date | None = None
    region: str | None = None
    company: str | None = None
    companies: list[str] | None = None
    regions: list[str] | None = None
    classification: str | None = None
    injury_type: str | None = None
    investigation_status: str | None = None
    investigation_results: str | None = None
    work_experience: str | None = None
    location: str | None = None
    description: str | None = None
    victim_name: str | None = None
    victim_position: str | None = None
    dzo: str | None = None
    time_from: datetime.time | None = None
    time_to: datetime.time | None = None
    cause_search: str | None = None
    work_type: str | None = None
    equipment: str | None = None
    safety_responsible_person: str | None = None
    weather_conditions: str | None = None
    victim_count_min: int | None = None
    victim_count_max: int | None = None
    fatality_count_min: int | None = None
    fatality_count_max: int | None = None
    safety_training_completed: bool | None = None
    is_recurrent: bool | None = None
    regulatory_compliant: bool | None = None
    recommendation_status: str | None = None

    # field -> column it tests
    EQUALS = {
        "region": "region",
        "company": "company",
        "classification": "classification",
        "injury_type": "injury_type",
        "investigation_status": "investigation_status",
        "investigation_results": "investigation_results",
        "work_experience": "victim_work_experience",
    }
    MEMBER = {"companies": "company", "regions": "region"}
    CONTAINS = (
        "victim_name",
        "victim_position",
        "dzo",
        "location",
        "description",
        "work_type",
        "equipment",
        "safety_responsible_person",
        "weather_conditions",
    )
    CAUSE_COLUMNS = ("preliminary_causes", "main_causes_from_report")
    COUNTS = ("victim_count", "fatality_count")
    FLAGS = ("safety_training_completed", "is_recurrent", "regulatory_compliant")

    def validate(self) -> "IncidentFilters":
        """Reject contradictory or out-of-domain settings before any job starts."""
        for low, high in (
            ("victim_count_min", "victim_count_max"),
            ("fatality_count_min", "fatality_count_max"),
            ("date_from", "date_to"),
            ("time_from", "time_to"),
        ):
            a, b = getattr(self, low), getattr(self, high)
            _require(a is None or b is None or a <= b, f"{low} must not exceed {high}")
        _require(not (self.company and self.companies), "company and companies exclude each other")
        _require(not (self.region and self.regions), "region and regions exclude each other")
        _require_domain("companies", self.companies, S.COMPANIES)
        _require_domain("regions", self.regions, S.REGIONS)
        _require_domain("company", [self.company] if self.company else (), S.COMPANIES)
        _require_domain("region", [self.region] if self.region else (), S.REGIONS)
        for name, domain in (
            ("classification", S.CLASSIFICATIONS),
            ("injury_type", S.INJURY_TYPES),
            ("investigation_status", S.INVESTIGATION_STATUSES),
            ("investigation_results", S.INVESTIGATION_RESULTS),
            ("work_experience", S.WORK_EXPERIENCE),
            ("recommendation_status", (*S.RECOMMENDATION_STATUSES, S.NO_RECOMMENDATIONS)),
        ):
            value = getattr(self, name)
            _require(value is None or value in domain, f"{name}: {value!r} is outside the domain")
        return self

    def condition(self) -> Column:
        """Row predicate of everything but the recommendation test (which is a join)."""
        parts: list[Column] = []

        def bound(column: str, operator: str, value) -> None:
            parts.append(getattr(F.col(column), operator)(F.lit(value)))

        if self.date_from:
            bound("incident_date", _AT_LEAST, self.date_from)
        if self.date_to:
            bound("incident_date", _AT_MOST, self.date_to)
        if self.time_from is not None:
            bound("incident_time", _AT_LEAST, self.time_from.strftime("%H:%M:%S"))
        if self.time_to is not None:
            bound("incident_time", _AT_MOST, self.time_to.strftime("%H:%M:%S"))
        parts += [F.col(c) == getattr(self, f) for f, c in self.EQUALS.items() if getattr(self, f)]
        parts += [F.col(c).isin(list(getattr(self, f))) for f, c in self.MEMBER.items() if getattr(self, f)]
        parts += [icontains(F.col(f), getattr(self, f)) for f in self.CONTAINS if getattr(self, f)]
        if self.cause_search:
            parts.append(any_of([icontains(F.col(c), self.cause_search) for c in self.CAUSE_COLUMNS]))
        for name in self.COUNTS:
            low, high = getattr(self, f"{name}_min"), getattr(self, f"{name}_max")
            if low is not None:
                bound(name, _AT_LEAST, low)
            if high is not None:
                bound(name, _AT_MOST, high)
        parts += [F.col(f) == F.lit(getattr(self, f)) for f in self.FLAGS if getattr(self, f) is not None]
        return _all(parts)


def filter_incidents(
    incidents: DataFrame, filters: IncidentFilters, recommendations: DataFrame | None = None
) -> DataFrame:
    """Rows passing every set filter; the recommendation status is a semi or anti join on the incident id."""
    kept = incidents.where(filters.condition())
    if not filters.recommendation_status:
        return kept
    if recommendations is None:
        raise ValueError("recommendation_status needs the recommendations table")
    if filters.recommendation_status == S.NO_RECOMMENDATIONS:
        owners, how = recommendations, "left_anti"
    else:
        owners = recommendations.where(F.col("status") == filters.recommendation_status)
        how = "left_semi"
    return kept.join(owners.select(F.col("incident_id").alias("id")), "id", how)


@dataclass(frozen=True)
class ActFilters:
    act_type: str | None = None
    link_status: str | None = None
    date_from: datetime.date | None = None
    date_to: datetime.date | None = None
    victim_name: str | None = None
    company_name: str | None = None
    companies: list[str] | None = None
    region: str | None = None
    regions: list[str] | None = None
    language: str | None = None
    incident_id: str | None = None
    cause_category: str | None = None
    violation_type: str | None = None
    industry_tag: str | None = None

    EQUALS = ("act_type", "link_status", "language", "incident_id")
    CONTAINS = {"victim_name": "victim_name", "company_name": "company_name", "region": "region_from_act"}
    CONTAINS_ANY = {"companies": "company_name", "regions": "region_from_act"}
    TAGS = {
        "cause_category": "cause_categories",
        "violation_type": "violation_types",
        "industry_tag": "industry_tags",
    }

    def validate(self) -> "ActFilters":
        _require(not (self.company_name and self.companies), "company_name and companies exclude each other")
        _require(not (self.region and self.regions), "region and regions exclude each other")
        _require_domain("companies", self.companies, S.COMPANIES)
        _require_domain("regions", self.regions, S.REGIONS)
        _require_domain("act_type", [self.act_type] if self.act_type is not None else (), S.ACT_TYPES)
        _require_domain("link_status", [self.link_status] if self.link_status is not None else (), S.LINK_STATES)
        if self.incident_id is not None:
            UUID(self.incident_id)
        return self

    def condition(self) -> Column:
        parts: list[Column] = []
        if self.date_from:
            parts.append(F.col("act_date") >= F.lit(self.date_from))
        if self.date_to:
            parts.append(F.col("act_date") <= F.lit(self.date_to))
        parts += [F.col(f) == F.lit(getattr(self, f)) for f in self.EQUALS if getattr(self, f)]
        parts += [icontains(F.col(c), getattr(self, f)) for f, c in self.CONTAINS.items() if getattr(self, f)]
        for field, column in self.CONTAINS_ANY.items():
            if getattr(self, field):
                parts.append(any_of([icontains(F.col(column), v) for v in getattr(self, field)]))
        parts += [F.array_contains(F.col(c), getattr(self, f)) for f, c in self.TAGS.items() if getattr(self, f)]
        return _all(parts)


def filter_acts(acts: DataFrame, filters: ActFilters) -> DataFrame:
    return acts.where(filters.condition())
