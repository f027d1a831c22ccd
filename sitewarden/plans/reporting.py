"""Registered queries: report facts, cases, contexts and section records."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from sitewarden.operators import report as rp
from sitewarden.operators import retrieval, summary
from sitewarden.operators.filters import IncidentFilters, filter_incidents
from sitewarden.plans import roles
from sitewarden.plans.aggregates import SUMMARY_SQL
from sitewarden.plans.registry import query
from sitewarden.plans.searching import _THRESHOLD

_TODAY = datetime.date(2001, 8, 1)


def _summary(t):
    return summary.summary(roles.incidents(t))


_RANKED = "SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS rank FROM summary"


@query(
    "narrative_facts",
    roles.sql(
        """SELECT dimension AS fact, 1 AS rank, key, n FROM summary WHERE dimension LIKE 'total_%'
UNION ALL SELECT concat('top_', dimension), rank, key, n FROM ranked WHERE dimension IN ('region', 'company') AND rank <= 3
UNION ALL SELECT trend, e.rank, e.key, e.n FROM (SELECT CASE WHEN last_n > first_n * 1.2 THEN 'growth' WHEN last_n < first_n * 0.8 THEN 'decline' END AS trend,
 unnest([{'rank': 1, 'key': first_m, 'n': first_n}, {'rank': 2, 'key': last_m, 'n': last_n}]) AS e FROM (
 SELECT arg_min(n, key) AS first_n, min(key) AS first_m, arg_max(n, key) AS last_n, max(key) AS last_m, count(*) AS months FROM summary WHERE dimension = 'month') m WHERE months >= 2) x WHERE trend IS NOT NULL""",
        "incidents",
        summary=SUMMARY_SQL,
        ranked=_RANKED,
    ),
)
def narrative_facts(t):
    return rp.narrative_facts(_summary(t)).withColumn("rank", F.col("rank").cast("long"))


@query(
    "key_findings",
    roles.sql(
        """SELECT 1 AS place, substr(dimension, 7) AS finding, '' AS key, n, -1.0::DOUBLE AS pct FROM summary WHERE dimension LIKE 'total_%'
UNION ALL SELECT rank + 1, 'injury_share', key, n, round(n * 100.0 / (SELECT n FROM summary WHERE dimension = 'total_incidents'), 1)::DOUBLE FROM ranked WHERE dimension = 'injury_type' AND rank <= 4
UNION ALL SELECT 6, 'top_region', key, n, -1.0::DOUBLE FROM ranked WHERE dimension = 'region' AND rank = 1""",
        "incidents",
        summary=SUMMARY_SQL,
        ranked=_RANKED,
    ),
)
def key_findings(t):
    return rp.key_findings(_summary(t)).withColumns({"place": F.col("place").cast("long"), "pct": F.coalesce("pct", F.lit(-1.0))})


@query(
    "illustrative",
    roles.sql(
        """SELECT id, CAST(CASE WHEN injury_type = 'Смертельный исход' THEN 10 WHEN injury_type LIKE '%тяжел%' THEN 5 ELSE 0 END
 + CASE WHEN is_recurrent THEN 3 ELSE 0 END + CASE WHEN equipment <> '' THEN 2 ELSE 0 END + CASE WHEN incident_date >= DATE '2001-05-03' THEN 1 ELSE 0 END AS BIGINT) AS case_score,
 CAST(incident_date AS VARCHAR) AS incident_date, company, description, coalesce(preliminary_causes, '') AS preliminary_causes
FROM incidents ORDER BY case_score DESC, incidents.incident_date DESC, id LIMIT 5""",
        "incidents",
    ),
)
def illustrative(t):
    cases = rp.illustrative_cases(roles.incidents(t), _TODAY)
    return cases.select("id", F.col("case_score").cast("long").alias("case_score"), "incident_date", "company", "description", "preliminary_causes")


def _contexts(t):
    hits = retrieval.vector_search(roles.chunks(t), roles.queries(t), 5, _THRESHOLD, roles.allowed(t))
    none = hits.where(F.lit(False)).withColumnRenamed("query_id", "query_no")
    merged = retrieval.merge_hits(none, hits.withColumnRenamed("query_id", "query_no"))
    norms = merged.select("place", F.col("row_id").alias("chunk"), F.round("score", 3).alias("similarity"))
    return rp.report_context(_summary(t), roles.incidents(t), roles.tagged_acts(t), norms, _TODAY, listed=20, acts_listed=30)


def _joined(path: str, *names: str):
    """Members of the list items as text, comma between members and bar between items."""
    return F.array_join(F.transform(path, lambda e: F.concat_ws(",", *[e[n].cast("string") for n in names])), "|")


_SHAPES = {
    "causes": """struct<recurrence_data: array<struct<company: string, count: bigint>>, top_equipment: array<struct<equipment: string, count: bigint>>,
    training_stats: struct<total: bigint, without_training_pct: double>, illustrative_cases: array<struct<id: bigint>>, act_summaries: array<struct<id: bigint, ai_summary: string>>,
    cause_patterns: struct<violation_types: array<struct<tag: string, count: bigint>>, cause_categories: array<struct<tag: string, count: bigint>>>>""",
    "risks": """struct<summary: array<struct<dimension: string, key: string, n: bigint>>, legal_violations: array<string>,
    relevant_legal_norms: array<struct<place: bigint, chunk: bigint>>, recurrence_data: array<struct<company: string, count: bigint>>>""",
    "recommendations": """struct<summary_brief: map<string, bigint>, legal_violations: array<string>,
    responsible_persons_summary: array<struct<position: string, count: bigint, n_violations: bigint>>>""",
}
_PARTS = dict(
    linked_lines="SELECT * FROM act_lines WHERE act_id % 2 = 0 AND act_id IN (SELECT id FROM incidents)",
    recurrence="SELECT string_agg(concat_ws(',', company, n), '|' ORDER BY n DESC, company) AS v FROM (SELECT company, count(*) AS n FROM incidents WHERE is_recurrent GROUP BY 1 ORDER BY n DESC, company LIMIT 20) r",
    equipment="SELECT string_agg(concat_ws(',', equipment, n), '|' ORDER BY n DESC, equipment) AS v FROM (SELECT equipment, count(*) AS n FROM incidents WHERE equipment <> '' GROUP BY 1 ORDER BY n DESC, equipment LIMIT 20) e",
    violation_tags="SELECT string_agg(concat_ws(',', tag, n), '|' ORDER BY n DESC, tag) AS v FROM (SELECT p_brand AS tag, count(*) AS n FROM linked_lines GROUP BY 1 ORDER BY n DESC, tag LIMIT 20) x",
    cause_tags="SELECT string_agg(concat_ws(',', tag, n), '|' ORDER BY n DESC, tag) AS v FROM (SELECT p_type AS tag, count(*) AS n FROM linked_lines GROUP BY 1 ORDER BY n DESC, tag LIMIT 20) x",
    training="SELECT count(*) AS total, round(count(*) FILTER (WHERE safety_training_completed = false) * 100.0 / count(*), 1)::DOUBLE AS pct FROM incidents",
    cases="""SELECT string_agg(id, '|' ORDER BY score DESC, incident_date DESC, id) AS v FROM (SELECT id, incident_date, CASE WHEN injury_type = 'Смертельный исход' THEN 10 WHEN injury_type LIKE '%тяжел%' THEN 5 ELSE 0 END
 + CASE WHEN is_recurrent THEN 3 ELSE 0 END + CASE WHEN equipment <> '' THEN 2 ELSE 0 END + CASE WHEN incident_date >= DATE '2001-05-03' THEN 1 ELSE 0 END AS score FROM incidents ORDER BY score DESC, incident_date DESC, id LIMIT 5) c""",
    digest="SELECT string_agg(concat_ws(',', id, ai_summary), '|' ORDER BY id) AS v FROM (SELECT id, ai_summary FROM acts WHERE ai_summary <> '' AND incident_id IN (SELECT id FROM incidents) ORDER BY id LIMIT 30) d",
    laws="SELECT string_agg(v, '|' ORDER BY v) AS v FROM (SELECT DISTINCT trim(reference) AS v FROM linked_lines ORDER BY 1 LIMIT 20) l",
    positions="""SELECT string_agg(concat_ws(',', position, n, k), '|' ORDER BY n DESC, position) AS v FROM (SELECT CASE WHEN position = '' THEN 'не указано' ELSE position END AS position, count(*) AS n, count(DISTINCT CASE WHEN violation <> '' THEN violation END) AS k
 FROM linked_lines GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20) p""",
    summary=SUMMARY_SQL,
    listed="SELECT string_agg(concat_ws(',', dimension, key, n), '|' ORDER BY dimension, key) AS v FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS k FROM summary) s WHERE k <= 20",
    brief="SELECT string_agg(concat_ws(',', dimension, n), '|' ORDER BY dimension) AS v FROM summary WHERE dimension LIKE 'total_%'",
    norm_pairs="""SELECT q.query_id, c.row_id, round(list_dot_product(c.embedding, q.embedding) / (sqrt(list_dot_product(c.embedding, c.embedding)) * sqrt(list_dot_product(q.embedding, q.embedding))), 12) AS score
FROM (SELECT * FROM chunks WHERE doc_id IN (SELECT doc_id FROM allowed)) c, queries q""",
    norm_hits=f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM norm_pairs WHERE score >= {_THRESHOLD}::DOUBLE) h WHERE rank <= 5",
    norm_list="""SELECT string_agg(row_id, '|' ORDER BY place) AS v FROM (SELECT row_id, row_number() OVER (ORDER BY query_id, rank, row_id) AS place FROM (
SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY query_id, rank) AS k FROM norm_hits) d WHERE k = 1) n WHERE place <= 20""",
)


@query(
    "report_context",
    roles.sql(
        """SELECT 'causes' AS section, concat_ws('#', (SELECT v FROM recurrence), (SELECT v FROM equipment), (SELECT v FROM violation_tags), (SELECT v FROM cause_tags), (SELECT v FROM cases), (SELECT v FROM digest)) AS content
UNION ALL SELECT 'risks', concat_ws('#', (SELECT v FROM listed), (SELECT v FROM laws), (SELECT v FROM recurrence), (SELECT v FROM norm_list))
UNION ALL SELECT 'recommendations', concat_ws('#', (SELECT v FROM brief), (SELECT v FROM laws), (SELECT v FROM positions))""",
        "incidents", "acts", "act_lines", "chunks", "queries", "allowed", **_PARTS,
    ),
)
def report_context(t):
    """All three contexts read back from their JSON, member by member."""
    c = lambda section: F.from_json(F.when(F.col("section") == section, F.col("context")), _SHAPES[section]).alias(section)
    read = _contexts(t).select("section", *[c(s) for s in _SHAPES])
    causes = F.concat_ws(
        "#", _joined("causes.recurrence_data", "company", "count"), _joined("causes.top_equipment", "equipment", "count"),
        _joined("causes.cause_patterns.violation_types", "tag", "count"), _joined("causes.cause_patterns.cause_categories", "tag", "count"),
        _joined("causes.illustrative_cases", "id"), _joined("causes.act_summaries", "id", "ai_summary"),
    )
    risks = F.concat_ws("#", _joined("risks.summary", "dimension", "key", "n"), F.array_join("risks.legal_violations", "|"),
                        _joined("risks.recurrence_data", "company", "count"), _joined("risks.relevant_legal_norms", "chunk"))
    brief = F.array_join(F.transform(F.map_entries("recommendations.summary_brief"), lambda e: F.concat_ws(",", e["key"], e["value"].cast("string"))), "|")
    advice = F.concat_ws("#", brief, F.array_join("recommendations.legal_violations", "|"),
                         _joined("recommendations.responsible_persons_summary", "position", "count", "n_violations"))
    content = F.when(F.col("section") == "causes", causes).when(F.col("section") == "risks", risks).otherwise(advice)
    return read.select("section", content.alias("content"))


@query(
    "report_context_facts",
    roles.sql(
        "SELECT (SELECT v FROM recurrence) AS recurrence, (SELECT total FROM training) AS total, (SELECT pct FROM training) AS without_training_pct, (SELECT v FROM violation_tags) AS violations, (SELECT v FROM equipment) AS equipment",
        "incidents", "act_lines", **{k: _PARTS[k] for k in ("linked_lines", "recurrence", "equipment", "violation_tags", "training")},
    ),
)
def report_context_facts(t):
    """The causes context read back: counts over all incidents and their acts."""
    causes = _contexts(t).where("section = 'causes'").select(F.from_json("context", _SHAPES["causes"]).alias("c"))
    return causes.select(
        _joined("c.recurrence_data", "company", "count").alias("recurrence"),
        F.col("c.training_stats.total").alias("total"),
        F.col("c.training_stats.without_training_pct").alias("without_training_pct"),
        _joined("c.cause_patterns.violation_types", "tag", "count").alias("violations"),
        _joined("c.top_equipment", "equipment", "count").alias("equipment"),
    )


@query(
    "report_stub",
    roles.sql(
        """SELECT count(*) AS total_incidents, count(DISTINCT victim_name) AS total_victims, count(*) FILTER (WHERE injury_type = 'Смертельный исход') AS total_fatalities,
 'не определён' AS overall_risk_level, CASE WHEN count(*) = 0 THEN 'Нет инцидентов, соответствующих заданным фильтрам.' ELSE 'AI-анализ не был выполнен. Отображена только сводная статистика.' END AS confidence_note
FROM incidents WHERE company = 'NOBODY'""",
        "incidents",
    ),
)
def report_stub(t):
    none = filter_incidents(roles.incidents(t), IncidentFilters(company="NOBODY"))
    return rp.stub_report(summary.summary(none))


_DOC = """CASE WHEN event_id % 20 = 3 THEN 'oops' ELSE concat('{"cause_analysis": ', CASE WHEN event_id % 9 = 0 THEN 'null' ELSE concat('"', event_type, '"') END,
', "extra": ', props, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(', "top_cause_categories": [{"category": "', event_type, '", "count": ', CASE WHEN event_id % 7 = 0 THEN '1.5' WHEN event_id % 7 = 1 THEN '"12"' ELSE CAST(user_id AS {text}) END,
CASE WHEN event_id % 2 = 0 THEN '' ELSE ', "analysis": "why"' END, '}]') END, '}') END"""


@query(
    "report_json",
    """SELECT event_id, valid, CASE WHEN valid THEN event_type END AS cause_analysis, CASE WHEN NOT valid OR event_id % 4 = 0 THEN NULL WHEN event_id % 7 = 1 THEN concat(event_type, ':12:', CASE WHEN event_id % 2 = 0 THEN '' ELSE 'why' END)
ELSE concat(event_type, ':', CAST(user_id AS VARCHAR), ':', CASE WHEN event_id % 2 = 0 THEN '' ELSE 'why' END) END AS category
FROM (SELECT *, event_id % 20 <> 3 AND event_id % 9 <> 0 AND (event_id % 4 = 0 OR event_id % 7 <> 0) AS valid FROM events) e""",
)
def report_json(t):
    docs = t.events.selectExpr("event_id", f"{_DOC.replace('{text}', 'STRING')} AS doc")
    first = F.get(F.col("record.top_cause_categories"), F.lit(0))
    return rp.parse_section(docs, "doc", "causes").select(
        "event_id", "valid", F.col("record.cause_analysis").alias("cause_analysis"),
        F.concat(first["category"], F.lit(":"), first["count"].cast("string"), F.lit(":"), first["analysis"]).alias("category"),
    )


_RISKS = """concat('{{"risk_assessment": [{{"risk_type": "', event_type, '", "severity": ', CASE WHEN event_id % 6 = 0 THEN 'null' ELSE '"high"' END, ', "description": "d", "affected_entities": ["', CAST(user_id AS {text}), '"]}}]',
CASE WHEN event_id % 5 = 0 THEN ', "overall_risk_level": "высокий"' ELSE '' END, '}}')"""
_ADVICE = """concat('{{"recommendations": [{{"priority": "p", "recommendation": "', event_type, '", "rationale": "r"', CASE WHEN event_id % 3 = 0 THEN ', "target_entities": ["x", "y"]' ELSE '' END, '}}], "immediate_actions": ',
CASE WHEN event_id % 4 = 0 THEN '"none"' ELSE '["a", "b"]' END, '}}')"""


@query(
    "report_json_risks",
    """SELECT event_id, valid, CASE WHEN NOT valid THEN NULL WHEN event_id % 5 = 0 THEN 'высокий' ELSE 'не определён' END AS level,
CASE WHEN valid THEN concat(event_type, ':', CAST(user_id AS VARCHAR)) END AS risk FROM (SELECT *, event_id % 6 <> 0 AS valid FROM events) e""",
)
def report_json_risks(t):
    docs = t.events.selectExpr("event_id", f"{_RISKS.format(text='STRING')} AS doc")
    first = F.get(F.col("record.risk_assessment"), F.lit(0))
    return rp.parse_section(docs, "doc", "risks").select(
        "event_id", "valid", F.col("record.overall_risk_level").alias("level"),
        F.concat(first["risk_type"], F.lit(":"), F.get(first["affected_entities"], F.lit(0))).alias("risk"),
    )


@query(
    "report_json_recommendations",
    """SELECT event_id, valid, CASE WHEN valid THEN 'a|b' END AS actions, CASE WHEN valid THEN concat(event_type, ':', CASE WHEN event_id % 3 = 0 THEN 'x|y' ELSE '' END) END AS advice
FROM (SELECT *, event_id % 4 <> 0 AS valid FROM events) e""",
)
def report_json_recommendations(t):
    docs = t.events.selectExpr("event_id", f"{_ADVICE.format(text='STRING')} AS doc")
    first = F.get(F.col("record.recommendations"), F.lit(0))
    return rp.parse_section(docs, "doc", "recommendations").select(
        "event_id", "valid", F.array_join("record.immediate_actions", "|").alias("actions"),
        F.concat(first["recommendation"], F.lit(":"), F.array_join(first["target_entities"], "|")).alias("advice"),
    )
