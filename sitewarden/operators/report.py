"""Report preparation: facts, findings, illustrative cases, section contexts, validation of section records."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewarden.functions.text import present, round_half_even
from sitewarden.operators import stats, tags
from sitewarden.session import staged
from sitewarden.sources.acts import _as_int, _as_strings, _kind, _text

# --- Fixed values ------------------------------------------------------------------------------------------------------

GROWTH, DECLINE = 1.2, 0.8
RECENT_DAYS = 90
CASE_POINTS = {"fatal": 10, "severe": 5, "recurrent": 3, "equipment": 2, "recent": 1}
CASE_WORDS = {"fatal": ("смертельн", "fatal"), "severe": ("тяжел", "severe")}
UNKNOWN_LEVEL = "не определён"
NO_INCIDENTS_NOTE = "Нет инцидентов, соответствующих заданным фильтрам."
NO_ANALYSIS_NOTE = "AI-анализ не был выполнен. Отображена только сводная статистика."


# --- facts -------------------------------------------------------------------------------------------------------------


def _ranked(summary: DataFrame, dimension: str, n: int) -> DataFrame:
    """Top rows of one dimension of a summary (a few hundred rows), ties by key."""
    order = Window.partitionBy("dimension").orderBy(F.col("n").desc(), F.col("key"))
    rows = summary.where(F.col("dimension") == dimension)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def narrative_facts(summary: DataFrame) -> DataFrame:
    """Totals, the three leading regions and companies, and the trend from first to last month: ``fact, rank, key, n``.

    The trend is a growth above 1.2 times the first month, a decline below 0.8 times, and needs two months.
    """
    summary = staged(summary)
    totals = summary.where(F.col("dimension").startswith("total_")).select(
        F.col("dimension").alias("fact"), F.lit(1).alias("rank"), "key", "n"
    )
    tops = [
        _ranked(summary, d, 3).select(F.lit(f"top_{d}").alias("fact"), "rank", "key", "n") for d in ("region", "company")
    ]
    months = summary.where(F.col("dimension") == "month").agg(
        F.min(F.struct("key", "n")).alias("a"), F.max(F.struct("key", "n")).alias("b"), F.count(F.lit(1)).alias("months")
    )
    label = F.when(F.col("b.n") > F.col("a.n") * GROWTH, F.lit("growth")).when(
        F.col("b.n") < F.col("a.n") * DECLINE, F.lit("decline")
    )
    ends = F.array(
        F.struct(F.lit(1).alias("rank"), F.col("a.key").alias("key"), F.col("a.n").alias("n")),
        F.struct(F.lit(2).alias("rank"), F.col("b.key").alias("key"), F.col("b.n").alias("n")),
    )
    trend = (
        months.where(F.col("months") >= 2)
        .select(label.alias("fact"), F.explode(ends).alias("e"))
        .where(F.col("fact").isNotNull())
        .select("fact", "e.rank", "e.key", "e.n")
    )
    return reduce(DataFrame.unionByName, [totals, *tops, trend])


def key_findings(summary: DataFrame) -> DataFrame:
    """Totals line, up to four injury shares in percent (one decimal), the leading region: ``place, finding, key, n, pct``."""
    summary = staged(summary)
    of = lambda name: F.max(F.when(F.col("dimension") == name, F.col("n")))
    head = summary.agg(of("total_incidents").alias("total"), of("total_victims").alias("victims"), of("total_fatalities").alias("dead"))
    none = F.lit(None).cast("double").alias("pct")
    lines = [
        F.struct(F.lit(place).alias("place"), F.lit(name).alias("finding"), F.lit("").alias("key"), F.col(c).alias("n"), none)
        for place, name, c in ((1, "incidents", "total"), (1, "victims", "victims"), (1, "fatalities", "dead"))
    ]
    first = head.select(F.explode(F.array(*lines)).alias("l")).select("l.*")
    total = head.select(F.col("total").cast("double")).scalar()
    share = F.try_divide(F.col("n").cast("double"), total) * F.lit(100.0)
    injuries = (
        _ranked(summary, "injury_type", 4)
        .select((F.col("rank") + 1).alias("place"), F.lit("injury_share").alias("finding"), "key", "n",
                F.coalesce(round_half_even(share, 1), F.lit(0.0)).alias("pct"))
    )
    region = _ranked(summary, "region", 1).select(F.lit(6).alias("place"), F.lit("top_region").alias("finding"), "key", "n", none)
    return first.unionByName(injuries).unionByName(region)


def illustrative_cases(incidents: DataFrame, today: datetime.date, n: int = 5) -> DataFrame:
    """The ``n`` most telling incidents: fatal 10 or severe 5, recurrent 3, equipment 2, within 90 days 1."""
    injury = F.lower(F.coalesce("injury_type", F.lit("")))
    fatal, severe = (reduce(lambda a, b: a | b, [injury.contains(w) for w in CASE_WORDS[k]]) for k in ("fatal", "severe"))
    yes = lambda c, kind: F.when(c, F.lit(CASE_POINTS[kind])).otherwise(F.lit(0))
    score = (
        F.when(fatal, F.lit(CASE_POINTS["fatal"])).when(severe, F.lit(CASE_POINTS["severe"])).otherwise(F.lit(0))
        + yes(F.col("is_recurrent"), "recurrent")
        + yes(present(F.col("equipment")), "equipment")
        + yes(F.col("incident_date") >= F.lit(today - datetime.timedelta(days=RECENT_DAYS)), "recent")
    )
    whole = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return (
        incidents.withColumn("case_score", score)
        .orderBy(F.col("case_score").desc(), F.col("incident_date").desc(), F.col("id"))
        .limit(n)
        .select(
            "id",
            "case_score",
            F.col("incident_date").cast("string").alias("incident_date"),
            "company",
            "region",
            "classification",
            "injury_type",
            whole("description"),
            whole("preliminary_causes"),
            whole("root_causes"),
            "victim_position",
            "equipment",
            "is_recurrent",
            "victim_count",
            "fatality_count",
        )
    )


# --- contexts ------------------------------------------------------------------------------------------------------------


def _packed(df: DataFrame, name: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows as one list in one row; the limit applies in every task before rows meet."""
    key = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)])
    top = df.orderBy(*order).limit(n).select(F.struct(*df.columns).alias("_item"), key.alias("_key"))
    return top.agg(F.array_sort(F.collect_list(F.struct("_key", "_item"))).alias("l")).select(F.transform("l", lambda e: e["_item"]).alias(name))


def report_context(
    summary: DataFrame,
    incidents: DataFrame,
    acts: DataFrame,
    norms: DataFrame | None,
    today: datetime.date,
    *,
    listed: int,
    acts_listed: int,
    cases_listed: int = 5,
) -> DataFrame:
    """Section contexts as JSON: ``section, context``; no rows when the summary counts no incident.

    Every figure covers all ``incidents`` and all acts of them. Lists show the ``listed`` most frequent entries (of a
    breakdown, of each dimension), ``acts_listed`` acts and ``cases_listed`` cases, whole texts included; trimming to
    what a consumer can take is left to it. ``norms`` has ``place`` and display columns.
    """
    # The summary and the acts of the incidents are read by several parts; they are worked out once.
    summary = staged(summary)
    linked = staged(acts.join(incidents.select(F.col("id").alias("incident_id")), "incident_id", "left_semi"))
    panel = tags.tag_panel(linked, listed).withColumnRenamed("n", "count")
    cases = illustrative_cases(incidents, today, cases_listed)
    age = F.datediff(F.lit(today), F.to_date("incident_date"))
    down = lambda c: -F.col(c)

    def counted(df: DataFrame, name: str, key: str) -> DataFrame:
        return _packed(df.withColumnRenamed("n", "count").select(key, "count"), name, [down("count"), F.col(key)], listed)

    def of_field(name: str) -> DataFrame:
        return _packed(panel.where(F.col("field") == name).select("tag", "count"), name, [down("count"), F.col("tag")], listed)

    per_dimension = Window.partitionBy("dimension").orderBy(F.col("n").desc(), F.col("key"))
    shown = summary.withColumn("_rank", F.row_number().over(per_dimension)).where(F.col("_rank") <= listed).select("dimension", "key", "n")
    parts = [
        _packed(stats.act_digest(linked, incidents, acts_listed), "act_summaries", [F.col("id")], acts_listed),
        of_field("cause_categories"),
        of_field("violation_types"),
        _packed(cases, "illustrative_cases", [down("case_score"), age, F.col("id")], cases_listed),
        counted(stats.recurrence(incidents), "recurrence_data", "company"),
        stats.training_stats(incidents).select(F.struct("total", "without_training_pct").alias("training_stats")),
        counted(stats.top_equipment(incidents, listed), "top_equipment", "equipment"),
        _packed(stats.legal_violations(linked), "legal_violations", [F.col("violation")], listed),
        _packed(stats.by_position(linked).withColumnRenamed("n", "count"), "responsible_persons_summary", [down("count"), F.col("position")], listed),
        summary.where(F.col("dimension").startswith("total_")).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "n")))).alias("summary_brief")
        ),
        # At most ``listed`` rows of a fixed number of dimensions.
        shown.agg(F.array_sort(F.collect_list(F.struct("dimension", "key", "n"))).alias("summary")),
    ]
    if norms is not None:
        parts.append(_packed(norms, "relevant_legal_norms", [F.col("place")], listed))
    # Every part is one value, so the context is one row of scalar subqueries.
    one = summary.sparkSession.range(1).select(*[p.scalar().alias(p.columns[0]) for p in parts])
    if norms is None:
        one = one.withColumn("relevant_legal_norms", F.array().cast("array<string>"))
    one = one.where(F.coalesce(F.col("summary_brief")["total_incidents"], F.lit(0)) > 0)
    one = one.withColumn("legal_violations", F.transform("legal_violations", lambda v: v["violation"]))
    patterns = F.struct("cause_categories", "violation_types").alias("cause_patterns")
    members = {
        "causes": [patterns, "act_summaries", "illustrative_cases", "recurrence_data", "training_stats", "top_equipment"],
        "risks": ["summary", patterns, "legal_violations", "relevant_legal_norms", "recurrence_data"],
        "recommendations": ["summary_brief", "relevant_legal_norms", "legal_violations", "responsible_persons_summary"],
    }
    contexts = [
        F.struct(F.lit(name).alias("section"), F.to_json(F.struct(*m), {"ignoreNullFields": "false"}).alias("context"))
        for name, m in members.items()
    ]
    return one.select(F.explode(F.array(*contexts)).alias("c")).select("c.*")


def stub_report(summary: DataFrame) -> DataFrame:
    """Totals with the note a report carries when nothing was analysed; also for an empty table."""
    of = lambda name: F.coalesce(F.max(F.when(F.col("dimension") == name, F.col("n"))), F.lit(0))
    head = summary.agg(*[of(c).alias(c) for c in ("total_incidents", "total_victims", "total_fatalities")])
    note = F.when(F.col("total_incidents") == 0, F.lit(NO_INCIDENTS_NOTE)).otherwise(F.lit(NO_ANALYSIS_NOTE))
    return head.withColumns({"overall_risk_level": F.lit(UNKNOWN_LEVEL), "confidence_note": note})


# --- section records -------------------------------------------------------------------------------------------------------

_TEXTS = T.ArrayType(T.StringType())


def _list_of(required: tuple[str, ...], optional: dict[str, str] = {}, numbers: tuple[str, ...] = (), lists: tuple[str, ...] = ()):
    return {"required": required, "optional": optional, "numbers": numbers, "lists": lists}


# Members of the list items of every section; texts are required unless they have a default.
SECTIONS = {
    "causes": {
        "required": ("cause_analysis",),
        "lists": {
            "top_cause_categories": _list_of(("category",), {"analysis": ""}, ("count",)),
            "recurrence_patterns": _list_of(("pattern_description",), {}, ("frequency",), ("affected_companies", "affected_regions")),
        },
    },
    "risks": {
        "required": (),
        "lists": {"risk_assessment": _list_of(("risk_type", "severity", "description"), {}, (), ("affected_entities",))},
        "defaults": {"overall_risk_level": UNKNOWN_LEVEL},
    },
    "recommendations": {
        "required": (),
        "lists": {"recommendations": _list_of(("priority", "recommendation", "rationale"), {}, (), ("target_entities",))},
        "texts": ("immediate_actions",),
    },
}


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _absent(v: Column) -> Column:
    return F.schema_of_variant(v).isNull()


def _items(v: Column, shape: dict) -> tuple[Column, Column]:
    """``(valid, items)`` of a list member; an absent list is valid and empty, a null or malformed one is not."""
    raw = F.try_variant_get(v, "$", "array<variant>")

    def value(e: Column, name: str) -> Column:
        m = _member(e, name)
        kind = _kind(m)
        if name in shape["numbers"]:
            return _as_int(m, kind)
        if name in shape["lists"]:
            return F.when(_absent(m), F.array().cast(_TEXTS)).otherwise(_as_strings(m, kind))
        text = _text(m, kind)
        return F.when(_absent(m), F.lit(shape["optional"][name])).otherwise(text) if name in shape["optional"] else text

    names = (*shape["required"], *shape["numbers"], *shape["optional"], *shape["lists"])

    def valid(e: Column) -> Column:
        return reduce(lambda a, b: a & b, [value(e, n).isNotNull() for n in names])

    def build(e: Column) -> Column:
        return F.struct(*[value(e, n).alias(n) for n in names])

    ok = _absent(v) | F.coalesce(F.schema_of_variant(v).startswith("ARRAY") & F.forall(raw, valid), F.lit(False))
    empty = F.transform(F.try_variant_get(F.parse_json(F.lit("[]")), "$", "array<variant>"), build)
    return ok, F.when(_absent(v), empty).otherwise(F.transform(raw, build))


def parse_section(df: DataFrame, column: str, section: str) -> DataFrame:
    """Adds ``valid`` and ``record``: the section's members with defaults; unknown members are ignored.

    A missing required member, or one of a wrong type, makes the record invalid (null).
    """
    rules = SECTIONS[section]
    doc = F.try_parse_json(F.col(column))
    base = df.withColumn("_doc", doc)
    d = F.col("_doc")
    checks, members = [F.schema_of_variant(d).startswith("OBJECT")], []
    for name in rules["required"]:
        value = _text(_member(d, name), _kind(_member(d, name)))
        checks.append(value.isNotNull())
        members.append(value.alias(name))
    for name, shape in rules["lists"].items():
        ok, items = _items(_member(d, name), shape)
        checks.append(ok)
        members.append(items.alias(name))
    for name, default in rules.get("defaults", {}).items():
        m = _member(d, name)
        value = F.when(_absent(m), F.lit(default)).otherwise(_text(m, _kind(m)))
        checks.append(value.isNotNull())
        members.append(value.alias(name))
    for name in rules.get("texts", ()):
        m = _member(d, name)
        value = F.when(_absent(m), F.array().cast(_TEXTS)).otherwise(_as_strings(m, _kind(m)))
        checks.append(value.isNotNull())
        members.append(value.alias(name))
    valid = F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))
    return base.select(*df.columns, valid.alias("valid"), F.when(valid, F.struct(*members)).alias("record"))
