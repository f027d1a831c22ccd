"""Registered queries: dashboard aggregates, tags and report statistics."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from sitewarden.operators import lookups, stats, summary, tags
from sitewarden.operators.filters import IncidentFilters, filter_incidents
from sitewarden.plans import roles
from sitewarden.plans.registry import query
from sitewarden.session import scratch_folder

_HEAD = """SELECT 'total_incidents' AS dimension, '' AS key, count(*) AS n FROM {src}
UNION ALL SELECT 'total_victims', '', count(DISTINCT victim_name) FROM {src}
UNION ALL SELECT 'total_fatalities', '', count(*) FILTER (WHERE injury_type = 'Смертельный исход') FROM {src}"""


def _breakdown(dimension: str, expression: str | None = None, source: str = "incidents") -> str:
    e = expression or dimension
    return f"SELECT '{dimension}' AS dimension, {e} AS key, count(*) AS n FROM {source} WHERE {e} IS NOT NULL AND {e} <> '' GROUP BY {e}"


SUMMARY_SQL = "\nUNION ALL ".join(
    [
        _HEAD.format(src="incidents"),
        *[_breakdown(d) for d in ("classification", "injury_type", "region", "company")],
        _breakdown("month", "strftime(incident_date, '%Y-%m')"),
    ]
)


@query("summary", roles.sql(SUMMARY_SQL, "incidents"))
def full_summary(t):
    return summary.summary(roles.incidents(t))


@query("summary_incremental", roles.sql(SUMMARY_SQL, "incidents"))
def summary_incremental(t):
    """Stored counts of the years before an import, then refreshed for the years it touched."""
    rows, states = roles.incidents(t), scratch_folder(t.spark, "summary")
    old = rows.where("incident_date < DATE '1997-06-15'")
    summary.refresh_states(old, states)
    touched = [r.y for r in rows.where("incident_date >= DATE '1997-06-15'").select(F.year("incident_date").alias("y")).distinct().collect()]
    summary.refresh_states(rows, states, touched)
    return summary.summary_of_states(t.spark, states)


@query(
    "summary_filtered",
    roles.sql(
        SUMMARY_SQL.replace("FROM incidents", "FROM kept"),
        "incidents",
        kept="SELECT * FROM incidents WHERE incident_date >= DATE '1997-01-01' AND is_recurrent",
    ),
)
def summary_filtered(t):
    wanted = IncidentFilters(date_from=datetime.date(1997, 1, 1), is_recurrent=True).validate()
    return summary.summary(filter_incidents(roles.incidents(t), wanted))


@query(
    "totals",
    roles.sql(
        "SELECT count(*) AS total_incidents, count(DISTINCT victim_name) AS total_victims, count(*) FILTER (WHERE injury_type = 'Смертельный исход') AS total_fatalities FROM incidents",
        "incidents",
    ),
)
def totals(t):
    return summary.totals(roles.incidents(t))


@query("by_dim", roles.sql("SELECT region AS key, count(*) AS n FROM incidents WHERE region IS NOT NULL AND region <> '' GROUP BY region", "incidents"))
def by_dim(t):
    return summary.count_by(roles.incidents(t), "region")


@query("by_month", roles.sql("SELECT strftime(incident_date, '%Y-%m') AS month, count(*) AS n FROM incidents GROUP BY 1", "incidents"))
def by_month(t):
    return summary.by_month(roles.incidents(t))


@query(
    "statistics",
    roles.sql(
        _HEAD.format(src="kept")
        + "\nUNION ALL SELECT 'classification', coalesce(classification, 'None'), count(*) FROM kept GROUP BY classification\nUNION ALL "
        + _breakdown("injury_type", source="kept"),
        "incidents",
        kept="SELECT * FROM incidents WHERE company = 'BUILDING' AND incident_date >= DATE '1996-01-01' AND incident_date <= DATE '1999-12-31'",
    ),
)
def statistics(t):
    return summary.statistics(
        roles.incidents(t), "BUILDING", datetime.date(1996, 1, 1), datetime.date(1999, 12, 31)
    )


@query("heatmap", roles.sql("SELECT coalesce(region, 'None') AS region, count(*) AS n FROM incidents GROUP BY 1", "incidents"))
def heatmap(t):
    return summary.heatmap(roles.incidents(t))


_TAGS = "SELECT {c} AS tag, count(*) AS n FROM act_lines GROUP BY 1 ORDER BY n DESC, tag LIMIT {k}"


@query("tag_patterns", roles.sql(_TAGS.format(c="p_brand", k=10), "act_lines"))
def tag_patterns(t):
    return tags.tag_patterns(roles.tagged_acts(t), "violation_types", 10)


@query(
    "tag_patterns_linked",
    roles.sql(
        "SELECT p_brand AS tag, count(*) AS n FROM act_lines WHERE act_id % 2 = 0 AND act_id IN (SELECT id FROM incidents WHERE is_recurrent) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10",
        "incidents",
        "act_lines",
    ),
)
def tag_patterns_linked(t):
    recurrent = filter_incidents(roles.incidents(t), IncidentFilters(is_recurrent=True))
    return tags.tag_patterns(roles.tagged_acts(t), "violation_types", 10, recurrent)


@query(
    "tag_panel",
    roles.sql(
        """SELECT field, tag, n, rank FROM (SELECT field, tag, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, tag) AS rank FROM (
SELECT 'cause_categories' AS field, p_type AS tag, count(*) AS n FROM act_lines GROUP BY 2
UNION ALL SELECT 'violation_types', p_brand, count(*) FROM act_lines GROUP BY 2
UNION ALL SELECT 'industry_tags', l_returnflag, count(*) FROM act_lines GROUP BY 2) c) r WHERE rank <= 5""",
        "act_lines",
    ),
)
def tag_panel(t):
    return tags.tag_panel(roles.tagged_acts(t), 5).select("field", "tag", "n", F.col("rank").cast("long").alias("rank"))


@query("recurrence", roles.sql("SELECT company, count(*) AS n FROM incidents WHERE is_recurrent GROUP BY 1", "incidents"))
def recurrence(t):
    return stats.recurrence(roles.incidents(t))


@query(
    "training",
    roles.sql(
        "SELECT count(*) AS total, round(count(*) FILTER (WHERE safety_training_completed = false) * 100.0 / count(*), 1)::DOUBLE AS without_training_pct FROM incidents",
        "incidents",
    ),
)
def training(t):
    return stats.training_stats(roles.incidents(t))


@query(
    "top_equipment",
    roles.sql("SELECT equipment, count(*) AS n FROM incidents WHERE equipment <> '' GROUP BY 1 ORDER BY n DESC, equipment LIMIT 3", "incidents"),
)
def top_equipment(t):
    return stats.top_equipment(roles.incidents(t), 3)


@query(
    "by_position",
    roles.sql(
        """SELECT CASE WHEN position IS NULL OR position = '' THEN 'не указано' ELSE position END AS position,
CAST(count(*) AS BIGINT) AS n, count(DISTINCT violation) AS n_violations FROM act_lines GROUP BY 1""",
        "act_lines",
    ),
)
def by_position(t):
    return stats.by_position(roles.tagged_acts(t))


@query(
    "position_violations",
    roles.sql(
        """SELECT CASE WHEN position IS NULL OR position = '' THEN 'не указано' ELSE position END AS position,
violation, count(*) AS n FROM act_lines GROUP BY 1, 2""",
        "act_lines",
    ),
)
def position_violations(t):
    return stats.position_violations(roles.tagged_acts(t))


@query("legal_violations", roles.sql("SELECT DISTINCT trim(reference) AS violation FROM act_lines", "act_lines"))
def legal_violations(t):
    return stats.legal_violations(roles.tagged_acts(t))


@query(
    "act_digest",
    roles.sql(
        """SELECT a.id, a.ai_summary, a.employer_fault_pct, a.immediate_causes, coalesce(l.n, 0) AS n_tags FROM acts a
LEFT JOIN (SELECT act_id, count(*) AS n FROM act_lines GROUP BY 1) l ON l.act_id = a.id
WHERE a.ai_summary <> '' AND a.incident_id IN (SELECT id FROM (SELECT id FROM incidents ORDER BY incident_date DESC, id LIMIT 50) r)
ORDER BY a.id LIMIT 30""",
        "incidents",
        "acts",
        "act_lines",
    ),
)
def act_digest(t):
    recent = lookups.page(roles.incidents(t), "incident_date", 50)
    digest = stats.act_digest(roles.tagged_acts(t), recent, 30)
    return digest.select(
        "id", "ai_summary", "employer_fault_pct", "immediate_causes", F.size("cause_categories").cast("long").alias("n_tags")
    )
