"""Value domains, table schemas and the role helper."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: the closed domains of the incident and act tables -------------------------------------------

COMPANIES = (
    "АО «Казахтелеком»",
    "АО «НК «КазМунайГаз»",
    "АО «Казпочта»",
    "АО «Самрук-Энерго»",
    "АО «НАК «Казатомпром»",
    "АО «НК «Казахстан темир жолы»",
    "АО «KEGOC»",
    "АО «НК «QazaqGaz»",
    "АО «НГРК «Тау-Кен Самрук»",
    "ТОО 'Samruk-Kazyna Ondeu'",
)
CLASSIFICATIONS = (
    "Несчастный случай (согласно Трудовому кодексу РК)",
    "ДТП без пострадавших по вине работника организации",
    "Несчастный случай по причине внезапного ухудшения здоровья с летальным исходом (в рабочее время и на рабочем месте)",
    "Пожар без пострадавших",
    "Авария без пострадавших (согласно Закону РК «О Гражданской защите)",
    "Инцидент на опасном производственном объекте (согласно Закону РК «О Гражданской защите)",
    "Несчастный случай по причине внезапного ухудшения здоровья",
    "Несчастный случай по причине внезапного ухудшения здоровья с летальным исходом (в не рабочее время и не на рабочем месте)",
    "Чрезвычайная ситуация без пострадавших",
)
REGIONS = (
    "Восточно-Казахстанская область",
    "Атырауская область",
    "Костанайская область",
    "Павлодарская область",
    "Туркестанская область",
    "Мангистауская область",
    "Кызылординская область",
    "Актюбинская область",
    "Алматинская область",
    "Абайская область",
    "Ближнее зарубежье",
    "Алматы",
    "Северо-Казахстанская область",
    "Акмолинская область",
    "Астана",
    "Карагандинская область",
    "Жамбылская область",
    "Западно-Казахстанская область",
    "Улытауская область",
    "Шымкент",
    "Жетысуйская область",
)
WORK_EXPERIENCE = ("С 6 до 10 лет", "С 1 до 5 лет", "До 1 года", "С 11 до 20 лет", "Более 20 лет")
INJURY_SEVERE = "Травма относится к тяжелым"
INJURY_NON_SEVERE = "Травма не относится к тяжелым"
INJURY_FATAL = "Смертельный исход"
INJURY_TYPES = (INJURY_SEVERE, INJURY_NON_SEVERE, INJURY_FATAL)
INVESTIGATION_RESULTS = ("Связан с трудовой деятельностью", "Не связан с трудовой деятельностью")
STATUS_OPEN = "Не завершено"
INVESTIGATION_STATUSES = ("Завершено", STATUS_OPEN)
DELETION_STATUSES = ("УДАЛИТЬ",)
RECOMMENDATION_PRIORITIES = ("Высокий", "Средний", "Низкий")
RECOMMENDATION_STATUSES = ("Ожидает выполнения", "В работе", "Выполнено", "Отклонено")
NO_RECOMMENDATIONS = "Нет рекомендаций"
ACT_TYPES = ("Внутреннее расследование", "Специальное расследование")
LINK_UNLINKED = "Не привязан"
LINK_AUTO = "Автоматически привязан"
LINK_MANUAL = "Привязан вручную"
LINK_STATES = (LINK_UNLINKED, LINK_AUTO, LINK_MANUAL)
TAG_FIELDS = ("cause_categories", "violation_types", "industry_tags")

# --- Table schemas ---------------------------------------------------------------------------------------------

_STR, _DATE, _TS = T.StringType(), T.DateType(), T.TimestampNTZType()
_STRINGS = T.ArrayType(_STR)
PERSON = T.StructType([T.StructField(n, _STR) for n in ("name", "position", "violation")])
MEASURE = T.StructType([T.StructField(n, _STR) for n in ("measure", "deadline", "responsible")])


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Fixed values from here on: names and types of the stored fields, in their order.
INCIDENT = _table(
    id=_STR,
    incident_date=_DATE,
    incident_time=_STR,
    company=_STR,
    dzo=_STR,
    classification=_STR,
    region=_STR,
    location=_STR,
    victim_name=_STR,
    victim_birth_date=_DATE,
    victim_position=_STR,
    victim_work_experience=_STR,
    injury_type=_STR,
    diagnosis=_STR,
    description=_STR,
    initial_actions=_STR,
    consequences_elimination_date=_DATE,
    consequences_elimination_time=_STR,
    impact_on_production=_STR,
    notified_authorities=_STR,
    preliminary_causes=_STR,
    consequences_description=_STR,
    damage_amount_kzt=T.DoubleType(),
    investigation_results=_STR,
    main_causes_from_report=_STR,
    corrective_actions=_STR,
    corrective_actions_execution_report=_STR,
    root_causes=_STR,
    notes=_STR,
    investigation_status=_STR,
    deletion_status=_STR,
    work_type=_STR,
    equipment=_STR,
    safety_responsible_person=_STR,
    weather_conditions=_STR,
    victim_count=T.ShortType(),
    fatality_count=T.ShortType(),
    safety_training_completed=T.BooleanType(),
    is_recurrent=T.BooleanType(),
    regulatory_compliant=T.BooleanType(),
    created_at=_TS,
    updated_at=_TS,
)

# What a column becomes when a journal says nothing about it (null where not listed).
INCIDENT_DEFAULTS = {
    "company": COMPANIES[0],
    "classification": CLASSIFICATIONS[0],
    "region": "Алматы",
    "location": "",
    "description": "",
    "investigation_status": STATUS_OPEN,
    "victim_count": 1,
    "fatality_count": 0,
}

# The fields an act record may carry, as read from a JSON document.
ACT_FIELDS = _table(
    act_type=_STR,
    act_date=_DATE,
    act_number=_STR,
    language=_STR,
    commission_chairman=_STR,
    commission_members=_STRINGS,
    investigation_period=_STR,
    incident_date_from_act=_DATE,
    victim_name_from_act=_STR,
    company_name_from_act=_STR,
    region_from_act=_STR,
    victim_name=_STR,
    victim_birth_date=_DATE,
    victim_position=_STR,
    victim_experience=_STR,
    victim_training_dates=_STR,
    injury_severity=_STR,
    victim_dependents=_STR,
    company_name=_STR,
    company_bin=_STR,
    workplace_description=_STR,
    circumstances=_STR,
    root_causes=_STR,
    immediate_causes=_STR,
    state_classifier_codes=_STRINGS,
    investigation_method=_STR,
    legal_violations=_STRINGS,
    responsible_persons=T.ArrayType(PERSON),
    corrective_measures=T.ArrayType(MEASURE),
    work_related=T.BooleanType(),
    employer_fault_pct=T.IntegerType(),
    worker_fault_pct=T.IntegerType(),
    conclusions=_STR,
    ai_summary=_STR,
    ai_risk_factors=_STRINGS,
    cause_categories=_STRINGS,
    violation_types=_STRINGS,
    industry_tags=_STRINGS,
)

ACT = T.StructType(
    [
        T.StructField("id", _STR),
        T.StructField("incident_id", _STR),
        T.StructField("link_status", _STR),
        T.StructField("file_path", _STR),
        T.StructField("file_id", _STR),
        T.StructField("original_filename", _STR),
        T.StructField("extracted_text", _STR),
        T.StructField("analysis_result", _STR),
        *ACT_FIELDS.fields,
        T.StructField("related_incident_ids", _STRINGS),
        T.StructField("uploaded_at", _TS),
        T.StructField("created_at", _TS),
        T.StructField("updated_at", _TS),
    ]
)

ACT_CHUNK = _table(
    id=_STR,
    act_id=_STR,
    chunk_index=T.IntegerType(),
    section_type=_STR,
    content=_STR,
    embedding=T.ArrayType(T.FloatType()),
    created_at=_TS,
    updated_at=_TS,
)

RECOMMENDATION = _table(
    id=_STR,
    incident_id=_STR,
    recommendation_text=_STR,
    priority=_STR,
    status=_STR,
    legal_references=_STRINGS,
    created_at=_TS,
    updated_at=_TS,
)


def as_roles(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Rename columns so that a foreign table plays the canonical roles: ``{"incident_date": "o_orderdate"}``."""
    return df.withColumnsRenamed({actual: role for role, actual in roles.items()})


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Exactly the columns of ``schema``, cast; absent or null columns take their default."""
    defaults = defaults or {}
    present = set(df.columns)

    def column(field: T.StructField):
        value = F.col(field.name) if field.name in present else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        return value.cast(field.dataType).alias(field.name)

    return df.select(*[column(field) for field in schema.fields])
