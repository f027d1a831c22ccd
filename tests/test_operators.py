"""Filters, summaries, statistics, norms and report parts on hand-made rows."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from sitewarden import schemas as S
from sitewarden.functions.text import round_half_even
from sitewarden.operators import lookups, report, stats, summary, tags, temporal
from sitewarden.operators.filters import ActFilters, IncidentFilters, filter_acts, filter_incidents

D = datetime.date


def incidents(spark, *rows):
    base = {f.name: None for f in S.INCIDENT.fields}
    return spark.createDataFrame([tuple((base | {"id": str(i)} | row).values()) for i, row in enumerate(rows)], S.INCIDENT)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_special_characters_are_literal(spark):
    df = incidents(spark, {"location": "100% Цех_1"}, {"location": "100 Цех 1"}, {"location": "a\\b"}, {})
    for needle, found in (("0% цех_", ["0"]), ("\\", ["2"]), ("ЦЕХ", ["0", "1"])):
        assert ids(filter_incidents(df, IncidentFilters(location=needle))) == found


def test_false_and_zero_are_set_filters_and_nulls_never_match(spark):
    df = incidents(spark, {"is_recurrent": False, "victim_count": 0, "incident_time": "00:00:00"}, {"is_recurrent": True, "victim_count": 2}, {})
    assert ids(filter_incidents(df, IncidentFilters(is_recurrent=False))) == ["0"]
    assert ids(filter_incidents(df, IncidentFilters(victim_count_max=0))) == ["0"]
    assert ids(filter_incidents(df, IncidentFilters(time_to=datetime.time(0)))) == ["0"]
    assert ids(filter_incidents(df, IncidentFilters(companies=[], location=""))) == ["0", "1", "2"]


@pytest.mark.parametrize(
    "filters",
    [
        IncidentFilters(date_from=D(2024, 2, 1), date_to=D(2024, 1, 1)), IncidentFilters(victim_count_min=2, victim_count_max=1),
        IncidentFilters(company=S.COMPANIES[0], companies=[S.COMPANIES[1]]), IncidentFilters(regions=["Марс"]),
        IncidentFilters(recommendation_status="?"), ActFilters(act_type="?"), ActFilters(incident_id="?"),
        ActFilters(region="Алматы", regions=["Алматы"]), ActFilters(link_status="?"),
    ],
)
def test_contradictions_are_rejected_before_any_job(filters):
    with pytest.raises(ValueError):
        filters.validate()


def test_valid_filters_pass():
    assert IncidentFilters(date_from=D(2024, 1, 1), regions=["Алматы"], recommendation_status=S.NO_RECOMMENDATIONS).validate()
    assert ActFilters(incident_id="12345678-1234-5678-1234-567812345678", act_type=S.ACT_TYPES[0]).validate()


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "i")
    incidents(spark, {"incident_date": D(2024, 1, 1), "company": "c"}).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    wanted = IncidentFilters(date_from=D(2024, 1, 1), company="c")
    plan = filter_incidents(spark.read.parquet(path), wanted).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(incident_date" in plan and "EqualTo(company,c)" in plan and "ReadSchema: struct<id:string,incident_date:date,company:string>" in plan


def test_pages_join_up_to_the_full_order(spark):
    rng = random.Random(1)
    df = incidents(spark, *[{"incident_date": D(2024, 1, 1 + rng.randrange(4))} for _ in range(25)])
    pages = [r["id"] for o in range(0, 25, 10) for r in lookups.page(df, "incident_date", 10, o).collect()]
    assert pages == [r["id"] for r in df.orderBy(F.col("incident_date").desc(), "id").collect()]
    with pytest.raises(ValueError):
        lookups.page(df, limit=1001)


def long(df):
    return {(r["dimension"], r["key"]): r["n"] for r in df.collect()}


def test_summary_equals_separate_groupings_and_null_rules(spark):
    fatal = {"injury_type": S.INJURY_FATAL, "fatality_count": 5, "victim_count": 9}
    df = incidents(
        spark, {"victim_name": "A", "region": "r", "incident_date": D(2024, 1, 5), **fatal}, {"victim_name": "A", "region": ""},
        {"classification": "c", "company": "x", "incident_date": D(2024, 2, 5)}, {"victim_name": "B", "incident_date": D(2024, 1, 9)},
    )
    got = long(summary.summary(df))
    assert got == {
        ("total_incidents", ""): 4, ("total_victims", ""): 2, ("total_fatalities", ""): 1, ("injury_type", S.INJURY_FATAL): 1,
        ("region", "r"): 1, ("classification", "c"): 1, ("company", "x"): 1, ("month", "2024-01"): 2, ("month", "2024-02"): 1,
    }
    for dimension in ("classification", "injury_type", "region", "company"):
        assert {k[1]: n for k, n in got.items() if k[0] == dimension} == {r["key"]: r["n"] for r in summary.count_by(df, dimension).collect()}
    assert long(summary.statistics(df))[("classification", "None")] == 3
    assert {r["region"]: r["n"] for r in summary.heatmap(df).collect()} == {"r": 1, "": 1, "None": 2}
    assert long(summary.summary(df.where("false"))) == {(f"total_{c}", ""): 0 for c in ("incidents", "victims", "fatalities")}


ACTS = "id int, incident_id int, cause_categories array<string>, violation_types array<string>, industry_tags array<string>, legal_violations array<string>, responsible_persons array<struct<name:string,position:string,violation:string>>"


def test_tags_count_occurrences_and_an_empty_list_means_all(spark):
    acts = spark.createDataFrame(
        [(1, 10, ["a", "a", "b"], None, [], [" x ", "", "y"], [("n", "", "v"), ("n", "p", None)]), (2, 11, ["b"], ["v"], None, ["x"], [("n", None, "v")]), (3, None, ["c"], None, None, None, None)],
        ACTS,
    )
    top = lambda **k: [(r["tag"], r["n"]) for r in tags.tag_patterns(acts, "cause_categories", 2, **k).collect()]
    assert top() == top(incidents=[]) == [("a", 2), ("b", 2)]
    assert top(incidents=[11]) == [("b", 1)]
    assert top(incidents=spark.createDataFrame([(10,)], "id int")) == [("a", 2), ("b", 1)]
    with pytest.raises(ValueError):
        tags.tag_patterns(acts, "id")
    assert sorted((r["field"], r["tag"], r["rank"]) for r in tags.tag_panel(acts, 1).collect()) == [("cause_categories", "a", 1), ("violation_types", "v", 1)]
    assert [tuple(r) for r in stats.by_position(acts).collect()] == [(stats.POSITION_UNKNOWN, 2, 1), ("p", 1, 0)]
    assert [tuple(r) for r in stats.by_position_lists(acts).collect()] == [(stats.POSITION_UNKNOWN, 2, ["v"]), ("p", 1, [])]
    assert sorted(r[0] for r in stats.legal_violations(acts).collect()) == ["x", "y"]
    assert filter_acts(acts, ActFilters(cause_category="b")).count() == 2


def test_rounding_follows_the_binary_value(spark):
    values = [0.15, 0.25, 0.35, 12.25, 2.675, 33.33333, 66.65, 0.0, 99.95, 1.005, 0.5, 100.0 / 3]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 3):
        assert [r[0] for r in df.select(round_half_even(F.col("x"), digits)).collect()] == [float(round(v, digits)) for v in values]


def test_training_share_of_an_empty_table(spark):
    df = incidents(spark, {"safety_training_completed": False}, {"safety_training_completed": True}, {})
    assert tuple(stats.training_stats(df).first()) == (3, 33.3)
    assert tuple(stats.training_stats(df.where("false")).first()) == (0, 0.0)


def test_versions_are_half_open(spark):
    rows = [(1, 7, "ru", D(2020, 1, 1), D(2021, 1, 1), "active"), (2, 7, "ru", D(2021, 1, 1), None, "active"), (3, 8, "ru", D(2020, 1, 1), None, "repealed")]
    v = spark.createDataFrame(rows, "version_id int, norm_id int, language string, effective_from date, effective_to date, status string")
    at = lambda d: [r["version_id"] for r in temporal.effective_at(v, d).collect()]
    assert (at(D(2020, 12, 31)), at(D(2021, 1, 1)), at(D(2019, 1, 1))) == ([1], [2], [])
    assert [r["version_id"] for r in temporal.current_version(v).collect()] == [2]
    assert [r["version_id"] for r in temporal.version_history(v).where("norm_id = 7").orderBy("place").collect()] == [2, 1]


def test_trend_findings_and_stub(spark):
    rows = [("month", "2024-01", 10), ("month", "2024-02", 50), ("month", "2024-03", 7), ("total_incidents", "", 67), ("total_victims", "", 3), ("total_fatalities", "", 0), ("injury_type", "i", 22), ("region", "b", 4), ("region", "a", 4)]
    s = spark.createDataFrame(rows, "dimension string, key string, n long")
    facts = [tuple(r) for r in report.narrative_facts(s).collect()]
    assert ("decline", 1, "2024-01", 10) in facts and ("decline", 2, "2024-03", 7) in facts and ("top_region", 1, "a", 4) in facts
    assert not any(f[0] == "decline" for f in report.narrative_facts(s.where("key <> '2024-01' and key <> '2024-02'")).collect())
    findings = {(r["place"], r["finding"]): (r["key"], r["n"], r["pct"]) for r in report.key_findings(s).collect()}
    assert findings[(2, "injury_share")] == ("i", 22, 32.8) and findings[(6, "top_region")] == ("a", 4, None)
    assert report.stub_report(s).first()["confidence_note"] == report.NO_ANALYSIS_NOTE
    assert report.stub_report(s.where("false")).first()["confidence_note"] == report.NO_INCIDENTS_NOTE


def test_context_is_whole_json(spark):
    df = incidents(spark, *[{"id": str(i), "incident_date": D(2024, 1, 1), "description": "д" * 900, "company": "c", "is_recurrent": True} for i in range(80)])
    acts = spark.createDataFrame([], S.ACT)
    build = lambda f, **n: {r["section"]: json.loads(r["context"]) for r in report.report_context(summary.summary(f), f, acts, None, D(2024, 2, 1), **n).collect()}
    context = build(df, listed=20, acts_listed=30)
    assert set(context) == {"causes", "risks", "recommendations"}
    assert len(context["causes"]["illustrative_cases"]) == 5 and {len(c["description"]) for c in context["causes"]["illustrative_cases"]} == {900}
    assert context["causes"]["recurrence_data"] == [{"company": "c", "count": 80}] and context["causes"]["training_stats"]["total"] == 80
    assert len(build(df, listed=20, acts_listed=30, cases_listed=70)["causes"]["illustrative_cases"]) == 70
    assert build(df.where("false"), listed=20, acts_listed=30) == {}


@pytest.mark.parametrize(
    "section, doc, valid",
    [
        ("risks", {}, True), ("risks", {"overall_risk_level": None}, False), ("risks", {"risk_assessment": [{"risk_type": "a", "severity": "b", "description": "c"}], "x": 1}, True),
        ("risks", {"risk_assessment": [{"risk_type": "a"}]}, False), ("causes", {}, False), ("causes", {"cause_analysis": "x", "top_cause_categories": [{"category": "c", "count": "3"}]}, True),
        ("causes", {"cause_analysis": "x", "top_cause_categories": None}, False), ("recommendations", {"immediate_actions": ["a"]}, True), ("recommendations", {"immediate_actions": "a"}, False),
    ],
)
def test_section_records(spark, section, doc, valid):
    row = report.parse_section(spark.createDataFrame([(json.dumps(doc),)], "d string"), "d", section).first()
    assert row["valid"] is valid and (row["record"] is not None) is valid
    if section == "risks" and doc == {}:
        assert row["record"]["overall_risk_level"] == report.UNKNOWN_LEVEL and row["record"]["risk_assessment"] == []
