"""Registered queries: filters and lookups."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from sitewarden.operators import filters as flt
from sitewarden.operators import lookups
from sitewarden.plans import roles
from sitewarden.plans.registry import query
from sitewarden.schemas import LINK_UNLINKED, NO_RECOMMENDATIONS

_SHOWN = ["id", "company", "region"]


def _incident_query(name: str, where: str, **settings) -> None:
    @query(name, roles.sql(f"SELECT id, company, region FROM incidents WHERE {where}", "incidents"))
    def plan(t):
        return flt.filter_incidents(roles.incidents(t), flt.IncidentFilters(**settings)).select(*_SHOWN)


_incident_query(
    "f_date",
    "incident_date >= DATE '1996-02-01' AND incident_date <= DATE '1997-01-31'",
    date_from=datetime.date(1996, 2, 1),
    date_to=datetime.date(1997, 1, 31),
)
_incident_query(
    "f_eq",
    "region = 'NATION_3' AND company = 'MACHINERY' AND investigation_status = 'Завершено'",
    region="NATION_3",
    company="MACHINERY",
    investigation_status="Завершено",
)
_incident_query(
    "f_eq_rest",
    "classification = '1-URGENT' AND injury_type = 'Смертельный исход' AND investigation_results = 'Связан с трудовой деятельностью' AND victim_work_experience = 'До 1 года'",
    classification="1-URGENT",
    injury_type="Смертельный исход",
    investigation_results="Связан с трудовой деятельностью",
    work_experience="До 1 года",
)
_incident_query(
    "f_in",
    "company IN ('MACHINERY', 'BUILDING') AND region IN ('NATION_3', 'NATION_7', 'NATION_11')",
    companies=["MACHINERY", "BUILDING"],
    regions=["NATION_3", "NATION_7", "NATION_11"],
)
_incident_query(
    "f_ilike",
    """contains(lower(location), 'site_4%') AND contains(lower(description), '100% OF') = false
       AND contains(lower(description), '100% of') AND contains(lower(victim_position), 'worker')
       AND contains(lower(safety_responsible_person), 'resp_') AND contains(lower(victim_name), 'customer')""",
    location="SITE_4%",
    description="100% OF",
    victim_position="wORKER",
    safety_responsible_person="RESP_",
    victim_name="CUSTOMER",
)
_incident_query(
    "f_ilike_rest",
    "contains(lower(dzo), 'nation_') AND contains(lower(work_type), 'high') AND contains(lower(equipment), 'high') AND contains(lower(weather_conditions), 'ветер')",
    dzo="Nation_",
    work_type="HIGH",
    equipment="high",
    weather_conditions="ВЕТЕР",
)
_incident_query(
    "f_cause",
    "contains(lower(preliminary_causes), 'furniture') OR contains(lower(main_causes_from_report), 'furniture')",
    cause_search="Furniture",
)
_incident_query(
    "f_time",
    "incident_time >= '08:00:00' AND incident_time <= '17:30:00'",
    time_from=datetime.time(8),
    time_to=datetime.time(17, 30),
)
_incident_query(
    "f_range",
    "victim_count >= 0 AND victim_count <= 2 AND fatality_count >= 1 AND fatality_count <= 1",
    victim_count_min=0,
    victim_count_max=2,
    fatality_count_min=1,
    fatality_count_max=1,
)
_incident_query(
    "f_bool",
    "safety_training_completed = false AND is_recurrent = true AND regulatory_compliant = false",
    safety_training_completed=False,
    is_recurrent=True,
    regulatory_compliant=False,
)


@query("f_rec_semi", roles.sql("SELECT id, company, region FROM incidents i WHERE EXISTS (SELECT 1 FROM recommendations r WHERE r.incident_id = i.id AND r.status = 'Выполнено')", "incidents", "recommendations"))
def f_rec_semi(t):
    wanted = flt.IncidentFilters(recommendation_status="Выполнено").validate()
    return flt.filter_incidents(roles.incidents(t), wanted, roles.recommendations(t)).select(*_SHOWN)


@query("f_rec_anti", roles.sql("SELECT id, company, region FROM incidents i WHERE NOT EXISTS (SELECT 1 FROM recommendations r WHERE r.incident_id = i.id)", "incidents", "recommendations"))
def f_rec_anti(t):
    wanted = flt.IncidentFilters(recommendation_status=NO_RECOMMENDATIONS).validate()
    return flt.filter_incidents(roles.incidents(t), wanted, roles.recommendations(t)).select(*_SHOWN)


@query(
    "f_act",
    roles.sql(
        f"""SELECT id, link_status, region_from_act FROM acts
WHERE act_type = 'Внутреннее расследование' AND link_status = '{LINK_UNLINKED}' AND language = 'ru'
  AND act_date >= DATE '1996-01-01' AND act_date <= DATE '2000-12-31' AND contains(lower(victim_name), 'customer')
  AND (contains(lower(company_name), 'machinery') OR contains(lower(company_name), 'building'))
  AND (contains(lower(region_from_act), 'nation_1') OR contains(lower(region_from_act), 'nation_2'))""",
        "acts",
    ),
)
def f_act(t):
    wanted = flt.ActFilters(
        act_type="Внутреннее расследование",
        link_status=LINK_UNLINKED,
        language="ru",
        date_from=datetime.date(1996, 1, 1),
        date_to=datetime.date(2000, 12, 31),
        victim_name="CUSTOMER",
        companies=["machinery", "BUILDING"],
        regions=["Nation_1", "Nation_2"],
    )
    return flt.filter_acts(roles.acts(t), wanted).select("id", "link_status", "region_from_act")


@query(
    "f_act_rest",
    roles.sql(
        "SELECT id, company_name, region_from_act FROM acts WHERE contains(lower(company_name), 'ао «auto') AND contains(lower(region_from_act), 'nation_1')",
        "acts",
    ),
)
def f_act_rest(t):
    wanted = flt.ActFilters(company_name="АО «Auto", region="nation_1")
    return flt.filter_acts(roles.acts(t), wanted).select("id", "company_name", "region_from_act")


@query(
    "f_tag",
    roles.sql(
        """SELECT act_id AS id FROM act_lines GROUP BY act_id
HAVING bool_or(p_type = 'PROMO') AND bool_or(p_brand = 'Brand#3') AND bool_or(l_returnflag = 'R')""",
        "act_lines",
    ),
)
def f_tag(t):
    wanted = flt.ActFilters(cause_category="PROMO", violation_type="Brand#3", industry_tag="R")
    return flt.filter_acts(roles.tagged_acts(t), wanted).select("id")


@query(
    "page",
    roles.sql(
        "SELECT id, CAST(incident_date AS VARCHAR) AS incident_date, company, location FROM incidents WHERE company = 'MACHINERY' ORDER BY incidents.incident_date DESC, id LIMIT 50 OFFSET 100",
        "incidents",
    ),
)
def page(t):
    rows = flt.filter_incidents(roles.incidents(t), flt.IncidentFilters(company="MACHINERY"))
    shown = lookups.brief(lookups.page(rows, "incident_date", 50, 100), lookups.INCIDENT_BRIEF)
    return shown.select("id", F.col("incident_date").cast("string").alias("incident_date"), "company", "location")


@query(
    "page_deep",
    roles.sql("SELECT id, CAST(incident_date AS VARCHAR) AS incident_date FROM incidents ORDER BY incidents.incident_date DESC, id LIMIT 100 OFFSET 9000", "incidents"),
)
def page_deep(t):
    """A page far into the table, found by counting ranges."""
    rows = roles.incidents(t).select("id", "incident_date")
    return lookups.page(rows, "incident_date", 100, 9000, shallow=500).select("id", F.col("incident_date").cast("string").alias("incident_date"))


@query(
    "page_acts",
    roles.sql("SELECT id, link_status, company_name FROM acts WHERE language = 'kz' ORDER BY uploaded_at DESC, id LIMIT 20", "acts"),
)
def page_acts(t):
    rows = flt.filter_acts(roles.acts(t), flt.ActFilters(language="kz"))
    shown = lookups.brief(lookups.page(rows, "uploaded_at", 20), lookups.ACT_BRIEF)
    return shown.select("id", "link_status", "company_name")


@query("count_filtered", roles.sql("SELECT count(*) AS n FROM incidents WHERE company = 'MACHINERY' AND is_recurrent", "incidents"))
def count_filtered(t):
    wanted = flt.IncidentFilters(company="MACHINERY", is_recurrent=True)
    return lookups.count_filtered(flt.filter_incidents(roles.incidents(t), wanted))


@query(
    "lookup_children",
    roles.sql(
        "SELECT id, incident_id, status FROM recommendations WHERE incident_id IN (SELECT id FROM incidents WHERE injury_type = 'Смертельный исход' AND is_recurrent)",
        "incidents",
        "recommendations",
    ),
)
def lookup_children(t):
    parents = flt.filter_incidents(
        roles.incidents(t), flt.IncidentFilters(injury_type="Смертельный исход", is_recurrent=True)
    )
    keys = parents.select(F.col("id").alias("incident_id"))
    return lookups.lookup(roles.recommendations(t), keys, "incident_id").select("id", "incident_id", "status")


@query(
    "lookup_ids",
    roles.sql("SELECT id, company, region FROM incidents WHERE id IN (SELECT o_custkey FROM orders)", "incidents"),
)
def lookup_ids(t):
    keys = t.orders.select(F.col("o_custkey").alias("id"))
    return lookups.lookup(roles.incidents(t), keys).select(*_SHOWN)


@query("unlinked", roles.sql(f"SELECT id, link_status FROM acts WHERE link_status = '{LINK_UNLINKED}'", "acts"))
def unlinked(t):
    return lookups.unlinked(roles.acts(t)).select("id", "link_status")


@query(
    "candidates",
    roles.sql("SELECT id, company FROM incidents WHERE incident_date BETWEEN DATE '1998-06-12' AND DATE '1998-06-18'", "incidents"),
)
def candidates(t):
    return lookups.candidates(roles.incidents(t), datetime.date(1998, 6, 15)).select("id", "company")
