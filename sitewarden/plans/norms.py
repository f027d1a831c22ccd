"""Registered queries: versioned norms."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from sitewarden import schemas as S
from sitewarden.operators import temporal as n
from sitewarden.plans import roles
from sitewarden.plans.registry import query

_HOLDS = "effective_from <= {d} AND (effective_to IS NULL OR effective_to > {d}) AND status = 'active'"


@query("effective_at", roles.sql(f"SELECT version_id, norm_id FROM norm_versions WHERE {_HOLDS.format(d='DATE ' + repr('1998-01-01'))}", "norm_versions"))
def effective_at(t):
    return n.effective_at(roles.norm_versions(t), datetime.date(1998, 1, 1)).select("version_id", "norm_id")


@query(
    "effective_on_days",
    roles.sql(
        f"SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM norm_versions JOIN (SELECT unnest([DATE '1996-01-01', DATE '1998-07-01', DATE '2001-01-01']) AS day) d ON {_HOLDS.format(d='day')} GROUP BY 1",
        "norm_versions",
    ),
)
def effective_on_days(t):
    days = [datetime.date(1998, 7, 1), datetime.date(1996, 1, 1), datetime.date(2001, 1, 1)]
    valid = n.effective_on_days(roles.norm_versions(t), days)
    return valid.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("current_version", roles.sql("SELECT version_id, norm_id, language FROM norm_versions WHERE effective_to IS NULL AND status = 'active'", "norm_versions"))
def current_version(t):
    return n.current_version(roles.norm_versions(t)).select("version_id", "norm_id", "language")


@query(
    "version_at",
    roles.sql(
        f"""SELECT v.version_id, p.o_orderkey AS point, CAST(p.day AS VARCHAR) AS day FROM norm_versions v
JOIN (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) + 45 AS day FROM orders) p
ON p.o_custkey = v.norm_id AND p.o_orderpriority = v.language AND {_HOLDS.format(d='p.day')}""",
        "norm_versions",
    ),
)
def version_at(t):
    points = t.orders.select(
        F.col("o_orderkey").alias("point"), F.col("o_custkey").alias("norm_id"), F.col("o_orderpriority").alias("language"),
        F.date_add(F.col("o_orderdate").cast("date"), 45).alias("day"),
    )
    found = n.version_at(roles.norm_versions(t), points)
    return found.select("version_id", "point", F.col("day").cast("string").alias("day"))


@query(
    "version_history",
    roles.sql("SELECT version_id, norm_id, row_number() OVER (PARTITION BY norm_id ORDER BY effective_from DESC, version_id) AS place FROM norm_versions", "norm_versions"),
)
def version_history(t):
    return n.version_history(roles.norm_versions(t)).select("version_id", "norm_id", F.col("place").cast("long").alias("place"))


@query(
    "close_version",
    roles.sql(
        """SELECT version_id, CAST(CASE WHEN c.k IS NOT NULL THEN c.day ELSE effective_to END AS VARCHAR) AS effective_to FROM norm_versions v
LEFT JOIN (SELECT l_orderkey AS k, CAST(max(l_shipdate) AS DATE) AS day FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) c ON c.k = v.version_id""",
        "norm_versions",
    ),
)
def close_version(t):
    closures = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("version_id")).agg(
        F.max("l_shipdate").cast("date").alias("effective_to")
    )
    closed = n.close_version(roles.norm_versions(t), closures)
    return closed.select("version_id", F.col("effective_to").cast("string").alias("effective_to"))


@query(
    "ancestors",
    roles.sql(
        """SELECT s.id, s.ancestor_id, a.depth AS ancestor_depth FROM (
SELECT id, unnest(string_split(path, '.')[1:len(string_split(path, '.')) - 1]) AS ancestor_id FROM norms) s JOIN norms a ON a.id = s.ancestor_id""",
        "norms",
    ),
)
def ancestors(t):
    return n.ancestors(roles.norms(t))


@query(
    "ancestors_by_parent",
    roles.sql(
        """SELECT s.id, s.ancestor_id, CAST(depth - a_depth AS BIGINT) AS distance FROM (SELECT s.*, a.depth AS a_depth FROM (
SELECT id, depth, unnest(string_split(path, '.')[1:len(string_split(path, '.')) - 1]) AS ancestor_id FROM norms) s JOIN norms a ON a.id = s.ancestor_id) s""",
        "norms",
    ),
)
def ancestors_by_parent(t):
    """The same tree known by its parents only."""
    parts = F.split("path", r"\.")
    known = roles.norms(t).select("id", F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("parent_id"))
    return n.ancestors_by_parent(known)


@query(
    "children",
    roles.sql("SELECT concat('C', CAST(c_custkey AS VARCHAR)) AS id, concat('N', CAST(c_nationkey AS VARCHAR)) AS parent_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2"),
)
def children(t):
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    tree = t.customer.select(
        key("C", "c_custkey").alias("id"), key("N", "c_nationkey").alias("parent_id"), F.col("c_custkey").alias("order_index")
    )
    parents = t.nation.where("n_regionkey = 2").select(key("N", "n_nationkey").alias("id"))
    return n.children(tree, parents).select("id", "parent_id")


_ROLES = dict(
    types="SELECT p_type AS type_id, CASE p_type WHEN 'PROMO' THEN 'article' WHEN 'SMALL' THEN 'paragraph' WHEN 'LARGE' THEN 'subparagraph' ELSE 'chapter' END AS code, p_type <> 'STANDARD' AS is_retrievable FROM part GROUP BY 1, 2, 3",
    rules="SELECT p_partkey AS id, p_type AS type_id, CAST(p_size AS VARCHAR) AS number, CAST(p_partkey % 7 AS BIGINT) AS npa_id FROM part",
    acts_of_law="SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS title_ru FROM region",
    norm_chunks="SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS embedding, vec_id * 3 AS version_id, CAST(vec_id % 5 AS INT) AS chunk_index, concat('chunk ', CAST(vec_id AS VARCHAR)) AS chunk_text FROM embeddings",
    owned=f"""SELECT c.*, v.norm_id, v.effective_from, v.effective_to, r.number, r.npa_id, y.code FROM norm_chunks c JOIN norm_versions v ON v.version_id = c.version_id
JOIN rules r ON r.id = v.norm_id JOIN types y ON y.type_id = r.type_id AND y.is_retrievable
WHERE v.language = '2-HIGH' AND {_HOLDS.format(d="DATE '1998-01-01'")}""",
    pairs="""SELECT q.query_id, c.row_id, round(list_dot_product(c.embedding, q.embedding)
/ (sqrt(list_dot_product(c.embedding, c.embedding)) * sqrt(list_dot_product(q.embedding, q.embedding))), 12) AS score FROM owned c, queries q""",
    top="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM pairs) t WHERE rank <= 10",
)


def _law(t):
    code = F.expr("CASE p_type WHEN 'PROMO' THEN 'article' WHEN 'SMALL' THEN 'paragraph' WHEN 'LARGE' THEN 'subparagraph' ELSE 'chapter' END")
    types = t.part.select(F.col("p_type").alias("type_id"), code.alias("code"), (F.col("p_type") != "STANDARD").alias("is_retrievable")).distinct()
    rules = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("type_id"), F.col("p_size").cast("string").alias("number"),
        (F.col("p_partkey") % 7).alias("npa_id"),
    )
    acts = t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("title_ru"))
    chunks = t.embeddings.select(
        F.col("vec_id").alias("row_id"), "embedding", (F.col("vec_id") * 3).alias("version_id"),
        (F.col("vec_id") % 5).cast("int").alias("chunk_index"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("chunk_text"),
    )
    return types, rules, acts, chunks


@query(
    "norm_search",
    roles.sql(
        """SELECT t.query_id, t.rank, t.row_id, l.title_ru AS document_title, CASE WHEN o.code = 'article' THEN o.number END AS article,
CASE WHEN o.code IN ('paragraph', 'subparagraph') THEN o.number END AS paragraph, CAST(o.effective_from AS VARCHAR) AS effective_from,
CAST(o.effective_to AS VARCHAR) AS effective_to, o.chunk_index, o.chunk_text, round(t.score, 4) AS similarity
FROM top t JOIN owned o ON o.row_id = t.row_id JOIN acts_of_law l ON l.id = o.npa_id""",
        "norm_versions",
        "queries",
        **_ROLES,
    ),
)
def norm_search(t):
    types, rules, acts, chunks = _law(t)
    versions = roles.norm_versions(t).withColumn("content_plain", F.lit("text"))
    hits = n.norm_search(chunks, versions, rules, types, roles.queries(t), "2-HIGH", 10, datetime.date(1998, 1, 1))
    shaped = n.shape_norm_hits(hits, chunks, versions, rules, types, acts)
    return shaped.drop("text", "language").withColumn("rank", F.col("rank").cast("long"))


@query("retrievable", roles.sql("SELECT type_id, code FROM types WHERE is_retrievable", types=_ROLES["types"]))
def retrievable(t):
    return n.retrievable(_law(t)[0]).select("type_id", "code")


_LINKS = "SELECT l_orderkey AS source_id, l_partkey AS target_id, l_linenumber AS no FROM lineitem"


@query(
    "references",
    roles.sql(
        f"""SELECT 'outgoing' AS side, source_id, target_id, no FROM ({_LINKS}) x WHERE source_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'incoming', source_id, target_id, no FROM ({_LINKS}) y WHERE target_id IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')"""
    ),
)
def references(t):
    links = t.lineitem.select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_linenumber").alias("no"))
    sources = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    targets = t.part.where("p_type = 'PROMO'").select(F.col("p_partkey").alias("id"))
    out = n.edges(links, sources, "source_id").select(F.lit("outgoing").alias("side"), "source_id", "target_id", "no")
    into = n.edges(links, targets, "target_id").select(F.lit("incoming").alias("side"), "source_id", "target_id", "no")
    return out.unionByName(into)


@query("drop_children", roles.sql("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"))
def drop_children(t):
    deleted = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return n.drop_children(t.lineitem.select("l_orderkey", "l_linenumber"), deleted, "l_orderkey")


@query("version_chunks", roles.sql("SELECT row_id, version_id, chunk_index FROM norm_chunks WHERE version_id IN (SELECT version_id FROM norm_versions WHERE status = 'active' AND effective_to IS NULL)", "norm_versions", norm_chunks=_ROLES["norm_chunks"]))
def version_chunks(t):
    return n.version_chunks(_law(t)[3], n.current_version(roles.norm_versions(t))).select("row_id", "version_id", "chunk_index")


@query("norms_of_act", roles.sql("SELECT id, npa_id FROM rules WHERE npa_id IN (SELECT id FROM acts_of_law)", rules=_ROLES["rules"], acts_of_law=_ROLES["acts_of_law"]))
def norms_of_act(t):
    _, rules, acts, _ = _law(t)
    return n.norms_of_act(rules.withColumn("path", F.col("number")), acts).select("id", "npa_id")


@query("types_by_level", roles.sql("SELECT type_id, length(type_id) AS hierarchy_level FROM types", types=_ROLES["types"]))
def types_by_level(t):
    types = _law(t)[0].withColumns({"hierarchy_level": F.length("type_id").cast("long"), "id": F.col("type_id")})
    return n.by_level(types).select("type_id", "hierarchy_level")


@query("type_by_code", roles.sql("SELECT type_id, code FROM types WHERE code = 'paragraph'", types=_ROLES["types"]))
def type_by_code(t):
    return n.type_by_code(_law(t)[0], "paragraph").select("type_id", "code")


@query("acts_by_type", roles.sql(f"SELECT id, act_type FROM acts WHERE act_type = '{S.ACT_TYPES[0]}'", "acts"))
def acts_by_type(t):
    return n.acts_of_type(roles.acts(t), S.ACT_TYPES[0]).select("id", "act_type")
