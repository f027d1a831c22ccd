"""The sample tables in the roles of the safety tables.

Each role is given twice: as a DataFrame for the library and, in ``VIEWS``, as SQL for the engine the results are
compared with. Roles are plain projections of whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewarden import schemas as S

FATAL, SEVERE = S.INJURY_FATAL, S.INJURY_SEVERE


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _located_orders(t: Tables) -> DataFrame:
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("k", F.col("o_orderkey"))
        .withColumn("d", F.col("o_orderdate").cast("date"))
    )


_INJURY = f"CASE o_orderstatus WHEN 'F' THEN '{FATAL}' WHEN 'P' THEN '{SEVERE}' ELSE NULL END"

# Column expressions both engines read the same way.
_INCIDENT_COLUMNS = {
    "id": "k",
    "incident_date": "d",
    "incident_time": "concat(lpad(CAST(k % 24 AS STRING), 2, '0'), ':00:00')",
    "company": "c_mktsegment",
    "dzo": "CASE WHEN k % 4 = 0 THEN NULL ELSE concat(c_mktsegment, ' ', n_name) END",
    "classification": "CASE WHEN k % 17 = 0 THEN NULL ELSE o_orderpriority END",
    "region": "CASE WHEN k % 19 = 0 THEN NULL ELSE n_name END",
    "location": "concat('Site_', CAST(o_custkey % 50 AS STRING), '% ', n_name)",
    "victim_name": "CASE WHEN k % 13 = 0 THEN NULL ELSE c_name END",
    "victim_position": "concat('Worker ', o_orderpriority)",
    "victim_work_experience": "CASE k % 3 WHEN 0 THEN 'До 1 года' WHEN 1 THEN 'С 1 до 5 лет' ELSE NULL END",
    "injury_type": _INJURY,
    "description": "concat('Fall at ', n_name, ', 100% of ', c_mktsegment, ' _ ', o_orderpriority)",
    "preliminary_causes": "CASE WHEN k % 7 = 0 THEN NULL ELSE concat('No guard, ', c_mktsegment) END",
    "main_causes_from_report": "CASE WHEN k % 5 = 0 THEN NULL ELSE concat('Training ', n_name) END",
    "root_causes": "CASE WHEN k % 9 = 0 THEN NULL ELSE concat('Root ', o_orderpriority) END",
    "investigation_status": "CASE o_orderstatus WHEN 'O' THEN 'Не завершено' ELSE 'Завершено' END",
    "investigation_results": "CASE k % 4 WHEN 0 THEN 'Связан с трудовой деятельностью' WHEN 1 THEN 'Не связан с трудовой деятельностью' ELSE NULL END",
    "work_type": "lower(o_orderpriority)",
    "equipment": "CASE WHEN k % 6 = 0 THEN NULL WHEN k % 35 = 0 THEN '' ELSE o_orderpriority END",
    "safety_responsible_person": "concat('Resp_', n_name)",
    "weather_conditions": "CASE k % 3 WHEN 0 THEN 'Снег' WHEN 1 THEN 'Дождь и ветер' ELSE NULL END",
    "victim_count": "CAST(k % 4 AS INT)",
    "fatality_count": "CASE WHEN k % 8 = 0 THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "safety_training_completed": "CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END",
    "is_recurrent": "CASE WHEN k % 11 = 0 THEN NULL ELSE (k % 5 = 0) END",
    "regulatory_compliant": "CASE k % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END",
    "damage_amount_kzt": "o_totalprice",
}
_ACT_COLUMNS = {
    "id": "k",
    "incident_id": "CASE WHEN k % 2 = 0 THEN k ELSE NULL END",
    "link_status": f"CASE k % 5 WHEN 0 THEN '{S.LINK_AUTO}' WHEN 1 THEN '{S.LINK_MANUAL}' ELSE '{S.LINK_UNLINKED}' END",
    "act_type": f"CASE k % 3 WHEN 0 THEN '{S.ACT_TYPES[0]}' WHEN 1 THEN '{S.ACT_TYPES[1]}' ELSE NULL END",
    "act_date": "date_add(d, CAST(k % 11 AS INT))",
    "language": "CASE WHEN k % 6 = 0 THEN 'kz' ELSE 'ru' END",
    "incident_date_from_act": "CASE WHEN k % 23 = 0 THEN NULL ELSE date_add(d, CAST(k % 7 AS INT) - 3) END",
    "victim_name_from_act": "CASE WHEN k % 29 = 0 THEN NULL WHEN k % 4 = 0 THEN upper(c_name) WHEN k % 5 = 0 THEN concat(c_name, 'x') ELSE concat('  ', c_name, ' ') END",
    "company_name_from_act": "concat('\"', c_mktsegment, '\" LLP')",
    "region_from_act": "CASE WHEN k % 31 = 0 THEN NULL ELSE n_name END",
    "injury_severity": _INJURY,
    "victim_name": "c_name",
    "company_name": "concat('АО «', c_mktsegment, '»')",
    "uploaded_at": "o_orderdate",
    "ai_summary": "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 14 = 0 THEN '' ELSE concat('Summary of ', c_name) END",
    "root_causes": "concat('Root ', o_orderpriority)",
    "immediate_causes": "CASE WHEN k % 3 = 0 THEN NULL ELSE concat('Immediate ', n_name) END",
    "employer_fault_pct": "CAST(k % 101 AS INT)",
    "conclusions": "concat('Concluded in ', n_name)",
    "circumstances": "concat('On site ', n_name)",
    "workplace_description": "CASE WHEN k % 10 = 0 THEN NULL ELSE 'Workshop' END",
}


def _spark(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


def incidents(t: Tables) -> DataFrame:
    return _located_orders(t).selectExpr(*_spark(_INCIDENT_COLUMNS))


def act_tags(t: Tables) -> DataFrame:
    """Tag lists, violation references and responsible persons of every order with lines."""
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    person = F.struct(
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("name"),
        F.when(F.col("l_linenumber") % 5 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("position"),
        F.when(F.col("l_linenumber") % 4 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("violation"),
    )
    listed = lambda c: F.array_sort(F.collect_list(c))
    return lines.groupBy(F.col("l_orderkey").alias("act_id")).agg(
        listed(F.col("p_type")).alias("cause_categories"),
        listed(F.col("p_brand")).alias("violation_types"),
        listed(F.col("l_returnflag")).alias("industry_tags"),
        listed(F.concat(F.lit(" ст. "), F.col("p_size").cast("string"), F.lit(" "))).alias("legal_violations"),
        listed(person).alias("responsible_persons"),
    )


def acts(t: Tables) -> DataFrame:
    return _located_orders(t).selectExpr(*_spark(_ACT_COLUMNS))


def tagged_acts(t: Tables) -> DataFrame:
    """Acts with their lists; an act without lines has null lists."""
    measures = F.lit(None).cast(f"array<{S.MEASURE.simpleString()}>").alias("corrective_measures")
    return acts(t).join(act_tags(t).withColumnRenamed("act_id", "id"), "id", "left").select("*", measures)


def recommendations(t: Tables) -> DataFrame:
    return t.lineitem.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("incident_id"),
        F.when(F.col("l_returnflag") == "A", F.lit("Выполнено"))
        .when(F.col("l_returnflag") == "R", F.lit("Отклонено"))
        .otherwise(F.lit("В работе"))
        .alias("status"),
        F.col("l_linestatus").alias("priority"),
    )


def chunks(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("doc_id"), "embedding"
    )


def queries(t: Tables) -> DataFrame:
    """One query per label: the vector with the least id."""
    return t.embeddings.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))


def allowed(t: Tables) -> DataFrame:
    """Labels with at least the average number of vectors."""
    per = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    mean = per.agg((F.sum("n") / F.count(F.lit(1))).alias("m"))
    return per.where(F.col("n") >= mean.scalar()).select(F.col("label").cast("string").alias("doc_id"))


def text_chunks(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("doc_id"), "lang", F.col("text").alias("chunk")
    )


def norm_chunks(t: Tables) -> DataFrame:
    """Chunks with text and vector under one id: documents with the embedding of the same number, if there is one."""
    vectors = t.embeddings.select(F.col("vec_id").alias("row_id"), "embedding")
    return text_chunks(t).join(vectors, "row_id", "left")


def norm_allowed(t: Tables) -> DataFrame:
    """Sources with at least the average number of such chunks."""
    per = norm_chunks(t).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    mean = per.agg((F.sum("n") / F.count(F.lit(1))).alias("m"))
    return per.where(F.col("n") >= mean.scalar()).select("doc_id")


def text_queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def norm_versions(t: Tables) -> DataFrame:
    """Customer orders as versions: each ends where the next of the same norm and language starts."""
    order = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(
        F.col("o_orderkey").alias("version_id"),
        F.col("o_custkey").alias("norm_id"),
        F.col("o_orderpriority").alias("language"),
        F.col("o_orderdate").cast("date").alias("effective_from"),
        F.lead("o_orderdate").over(order).cast("date").alias("effective_to"),
        F.when(F.col("o_orderstatus") == "P", F.lit("repealed")).otherwise(F.lit("active")).alias("status"),
    )


def norms(t: Tables) -> DataFrame:
    """Regions, nations and customers as a three-level tree with dotted paths."""
    top = t.region.selectExpr("concat('R', CAST(r_regionkey AS STRING)) AS id", "concat('R', CAST(r_regionkey AS STRING)) AS path", "0 AS depth")
    path = "concat('R', CAST(n_regionkey AS STRING), '.N', CAST(n_nationkey AS STRING))"
    middle = t.nation.selectExpr("concat('N', CAST(n_nationkey AS STRING)) AS id", f"{path} AS path", "1 AS depth")
    leaf = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "concat('C', CAST(c_custkey AS STRING)) AS id", f"concat({path}, '.C', CAST(c_custkey AS STRING)) AS path", "2 AS depth"
    )
    return top.unionByName(middle).unionByName(leaf)


# --- the same roles in SQL -----------------------------------------------------------------------------------------------


def _duck(expression: str) -> str:
    out = expression.replace("AS STRING", "AS VARCHAR")
    out = out.replace("date_add(d, CAST(k % 11 AS INT))", "(d + CAST(k % 11 AS INT))")
    return out.replace("date_add(d, CAST(k % 7 AS INT) - 3)", "(d + (CAST(k % 7 AS INT) - 3))")


def _select(columns: dict[str, str]) -> str:
    return ",\n       ".join(f"{_duck(e)} AS {n}" for n, e in columns.items())


_LOCATED = "SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"

VIEWS = {
    "located": _LOCATED,
    "incidents": f"SELECT {_select(_INCIDENT_COLUMNS)} FROM located",
    "acts": f"SELECT {_select(_ACT_COLUMNS)} FROM located",
    "act_lines": """SELECT l_orderkey AS act_id, p_type, p_brand, l_returnflag, concat(' ст. ', CAST(p_size AS VARCHAR), ' ') AS reference,
       concat('P', CAST(l_suppkey AS VARCHAR)) AS name,
       CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE p_brand END AS position,
       CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE p_type END AS violation
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "recommendations": """SELECT l_orderkey * 100 + l_linenumber AS id, l_orderkey AS incident_id,
       CASE l_returnflag WHEN 'A' THEN 'Выполнено' WHEN 'R' THEN 'Отклонено' ELSE 'В работе' END AS status, l_linestatus AS priority FROM lineitem""",
    "chunks": "SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS doc_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "queries": "SELECT label AS query_id, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS embedding FROM embeddings GROUP BY label",
    "allowed": """SELECT CAST(label AS VARCHAR) AS doc_id FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) p
WHERE n >= (SELECT sum(n) / count(*) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label) q)""",
    "text_chunks": "SELECT doc_id AS row_id, source AS doc_id, lang, text AS chunk FROM documents",
    "text_queries": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "norm_versions": """SELECT o_orderkey AS version_id, o_custkey AS norm_id, o_orderpriority AS language, CAST(o_orderdate AS DATE) AS effective_from,
       CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS DATE) AS effective_to,
       CASE WHEN o_orderstatus = 'P' THEN 'repealed' ELSE 'active' END AS status FROM orders""",
    "norms": """SELECT concat('R', CAST(r_regionkey AS VARCHAR)) AS id, concat('R', CAST(r_regionkey AS VARCHAR)) AS path, 0 AS depth FROM region
UNION ALL SELECT concat('N', CAST(n_nationkey AS VARCHAR)), concat('R', CAST(n_regionkey AS VARCHAR), '.N', CAST(n_nationkey AS VARCHAR)), 1 FROM nation
UNION ALL SELECT concat('C', CAST(c_custkey AS VARCHAR)), concat('R', CAST(n_regionkey AS VARCHAR), '.N', CAST(n_nationkey AS VARCHAR), '.C', CAST(c_custkey AS VARCHAR)), 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}
NORM_CHUNKS_SQL = "SELECT d.doc_id AS row_id, d.source AS doc_id, d.lang, d.text AS chunk, CAST(e.embedding AS DOUBLE[]) AS embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"
NORM_ALLOWED_SQL = """SELECT doc_id FROM (SELECT doc_id, count(*) AS n FROM norm_chunks GROUP BY 1) p
WHERE n >= (SELECT sum(n) / count(*) FROM (SELECT count(*) AS n FROM norm_chunks GROUP BY doc_id) q)"""
_NEEDS = {"incidents": ("located",), "acts": ("located",)}


def sql(select: str, *views: str, **extra: str) -> str:
    """``WITH`` the named role views (and extra ones, in order) in front of a select."""
    names: list[str] = []
    for v in views:
        names += [n for n in (*_NEEDS.get(v, ()), v) if n not in names]
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra.items()]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + select
