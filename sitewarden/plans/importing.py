"""Registered queries: journal import, act records, files, upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewarden import schemas as S
from sitewarden.operators import upsert as u
from sitewarden.plans import roles
from sitewarden.plans.registry import query
from sitewarden.session import scratch_folder
from sitewarden.sources import acts as a
from sitewarden.sources import journal as j
from sitewarden.sources import manifest as mf
from sitewarden.sources.snapshots import SnapshotTable

# --- journal: every nation sends one file, its orders are the rows -----------------------------------------------------

_LIST = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"

# Raw cells from an order, the same text on both engines; ``pick`` is a domain value by number.
_CELLS = {
    "incident_date": "CASE WHEN k % 37 = 0 THEN '-' WHEN k % 41 = 0 THEN NULL WHEN k % 43 = 0 THEN 'soon' WHEN k % 2 = 0 THEN CAST(d AS {text}) ELSE concat(CAST(d AS {text}), ' 00:00:00') END",
    "incident_time": "CASE WHEN k % 9 = 0 THEN '-' WHEN k % 10 = 0 THEN 'noon' ELSE concat(CAST(k % 24 AS {text}), ':05') END",
    "company": "CASE WHEN k % 47 = 0 THEN NULL WHEN k % 53 = 0 THEN 'ТОО Неизвестная' WHEN k % 3 = 0 THEN concat('  ', upper({company}), ' ') ELSE {company} END",
    "classification": "CASE WHEN k % 59 = 0 THEN '-' ELSE {classification} END",
    "region": "CASE WHEN k % 61 = 0 THEN 'Марс' WHEN k % 5 = 0 THEN lower({region}) ELSE {region} END",
    "location": "CASE WHEN k % 67 = 0 THEN ' ' ELSE concat(' Site ', n_name, '  ') END",
    "victim_name": "CASE WHEN k % 7 = 0 THEN '-' ELSE c_name END",
    "injury_type": "CASE o_orderstatus WHEN 'F' THEN 'СМЕРТЕЛЬНЫЙ  исход' WHEN 'P' THEN 'Травма относится к тяжелым' ELSE '-' END",
    "description": "CASE WHEN k % 4 = 0 THEN '' ELSE concat('Order of ', c_name) END",
    "damage_amount_kzt": "CASE WHEN k % 6 = 0 THEN 'много' ELSE concat(' ', CAST(k AS {text}), '.5 ') END",
    "investigation_status": "CASE WHEN o_orderstatus = 'O' THEN 'не  завершено' ELSE 'Завершено' END",
}
_DOMAINS = {"company": S.COMPANIES, "classification": S.CLASSIFICATIONS, "region": S.REGIONS}
_NUMBER = {"company": "o_custkey", "classification": "k", "region": "c_nationkey"}


def _cells(engine: str) -> dict[str, str]:
    if engine == "spark":
        pick = {n: f"element_at({n}_list, CAST(1 + {_NUMBER[n]} % {len(v)} AS INT))" for n, v in _DOMAINS.items()}
        return {n: e.format(text="STRING", **pick) for n, e in _CELLS.items()}
    pick = {n: f"({_LIST(v)})[1 + {_NUMBER[n]} % {len(v)}]" for n, v in _DOMAINS.items()}
    return {n: e.format(text="VARCHAR", **pick) for n, e in _CELLS.items()}


def _numbered(t):
    for_lists = {f"{n}_list": F.array(*[F.lit(v) for v in values]) for n, values in _DOMAINS.items()}
    return roles._located_orders(t).withColumns(for_lists)


def _raw_rows(t):
    """Raw journal columns, one row per order; ``file`` is the nation."""
    missing = [f"CAST(NULL AS STRING) AS {f}" for f in j.FIELDS if f not in _CELLS]
    cells = [f"{e} AS {n}" for n, e in _cells("spark").items()]
    return _numbered(t).selectExpr("n_name AS file", "k AS row_no", *cells, *missing)


def _journal_cells(t):
    """The same rows as sheets: a title, a header in the form's order with a line break in one name, then the data."""
    header = [j.HEADERS.get(n) or f"{j.PREFIX_HEADERS[n]}, тенге" for n in _CELLS]
    header[0] = header[0].upper().replace(" ", " \n", 1)
    title = F.array(F.lit("Журнал происшествий"), *[F.lit(None).cast("string")] * (len(header) - 1))
    files = t.nation.select(F.col("n_name").alias("file"))
    head = files.select("file", F.lit(2).alias("row_no"), F.array(*[F.lit(h) for h in header]).alias("cells"))
    top = files.select("file", F.lit(0).alias("row_no"), title.alias("cells"))
    data = _raw_rows(t).select("file", (F.col("row_no") + 3).cast("int").alias("row_no"), F.array(*_CELLS).alias("cells"))
    return top.unionByName(head).unionByName(data)


def _sql_rows() -> str:
    return f"SELECT n_name AS file, k AS row_no, {', '.join(f'{e} AS {n}' for n, e in _cells('duck').items())} FROM located"


_SPACED = r"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"


def _enum_sql(column: str, domain) -> str:
    norm = _SPACED.format(c=column)
    return "CASE " + " ".join(f"WHEN {norm} = '{' '.join(v.split()).lower().replace(chr(39), chr(39) * 2)}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for v in domain) + " END"


def _value(c: str) -> str:
    return f"nullif(nullif({c}, ''), '-')"


_ENUMS = ("company", "classification", "region", "injury_type", "investigation_status")
_MAPPED = f"""SELECT file, row_no,
  CASE WHEN incident_date SIMILAR TO '\\d{{4}}-.*' THEN CAST(substr(incident_date, 1, 10) AS DATE) END AS incident_date,
  CASE WHEN incident_time LIKE '%:%' THEN concat(lpad(split_part(incident_time, ':', 1), 2, '0'), ':05:00') END AS incident_time,
  {', '.join(f"{_enum_sql(_value(c), j.ENUMS[c])} AS {c}, CASE WHEN {_value(c)} IS NOT NULL AND {_enum_sql(_value(c), j.ENUMS[c])} IS NULL THEN concat('Некорректное значение для {c}: ''', trim({c}), '''') END AS e_{c}" for c in _ENUMS)},
  trim({_value('location')}) AS location, trim({_value('victim_name')}) AS victim_name,
  CASE WHEN {_value('description')} IS NULL THEN 'Нет описания' ELSE trim(description) END AS description,
  TRY_CAST(trim(damage_amount_kzt) AS DOUBLE) AS damage_amount_kzt
FROM raw WHERE incident_date IS NOT NULL AND company IS NOT NULL"""
_JUDGED = """SELECT *, coalesce(e_company, e_classification, e_region, e_injury_type, e_investigation_status,
  CASE WHEN incident_date IS NULL OR company IS NULL OR classification IS NULL OR region IS NULL OR location IS NULL OR location = '' OR investigation_status IS NULL
  THEN 'missing required fields after parsing' END) AS failure FROM mapped"""
_JOURNAL = dict(raw=_sql_rows(), mapped=_MAPPED, judged=_JUDGED)
_SHOW = ("row_no", "incident_time", "company", "classification", "region", "location", "victim_name", "injury_type", "description", "damage_amount_kzt", "investigation_status")


_BROKEN_TEXT = "CASE WHEN k % 4 = 0 THEN '' ELSE concat('Order \"of\", ', chr(10), '\"', c_name, '\"') END"


@query(
    "journal_csv",
    roles.sql(
        f"SELECT file, {', '.join(_SHOW)}, CAST(incident_date AS VARCHAR) AS incident_date FROM judged WHERE failure IS NULL",
        "located",
        plain=_sql_rows(),
        raw=f"SELECT * REPLACE (r.description2 AS description, 2 + row_number() OVER (PARTITION BY file ORDER BY row_no) AS row_no) FROM "
        f"(SELECT p.*, {_BROKEN_TEXT} AS description2 FROM plain p JOIN located l ON l.k = p.row_no) r",
        mapped=_MAPPED,
        judged=_JUDGED,
    ),
)
def journal_csv(t):
    """The journals as CSV files with line breaks, quotes and delimiters in quoted cells, written and read back."""
    folder = scratch_folder(t.spark, "journals")
    cells = [*_CELLS]
    broken = _numbered(t).selectExpr("c_nationkey AS nation", "k AS row_no", *[
        f"{_BROKEN_TEXT if n == 'description' else e} AS {n}" for n, e in _cells("spark").items()])
    data = broken.select("nation", "row_no", F.array(*cells).alias("cells"))
    header = [j.HEADERS.get(n) or f"{j.PREFIX_HEADERS[n]}, тенге" for n in _CELLS]
    header[0] = header[0].upper().replace(" ", " \n", 1)
    head = t.nation.select(F.col("n_nationkey").alias("nation"), F.lit(-1).cast("long").alias("row_no"), F.array(*[F.lit(h) for h in header]).alias("cells"))
    title = t.nation.select(F.col("n_nationkey").alias("nation"), F.lit(-2).cast("long").alias("row_no"), F.array(F.lit("Журнал происшествий")).alias("cells"))
    quoted = F.transform("cells", lambda c: F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))))
    sheets = data.unionByName(head).unionByName(title).select("nation", "row_no", F.array_join(quoted, ",").alias("line"))
    sheets.repartition("nation").sortWithinPartitions("nation", "row_no").select("nation", "line").write.partitionBy("nation").text(folder)
    rows = j.read_journal(t.spark, f"{folder}/*", "csv")
    good, _, _ = j.parse_journal(rows)
    nation = F.regexp_extract("file", r"nation=(\d+)", 1).cast("long")
    named = good.withColumn("nation", nation).drop("file").join(t.nation.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("file")), "nation")
    return named.select("file", *_SHOW, F.col("incident_date").cast("string").alias("incident_date")).withColumn("row_no", F.col("row_no").cast("long"))


@query(
    "journal_map",
    roles.sql(
        f"SELECT file, {', '.join(_SHOW)}, CAST(incident_date AS VARCHAR) AS incident_date, CASE WHEN injury_type = 'Смертельный исход' THEN 1 ELSE 0 END AS fatality_count FROM mapped",
        "located",
        **_JOURNAL,
    ),
)
def journal_map(t):
    mapped = j.map_journal_rows(_raw_rows(t))
    return mapped.select("file", *_SHOW, F.col("incident_date").cast("string").alias("incident_date"), F.col("fatality_count").cast("int").alias("fatality_count"))


@query("enum_conform", roles.sql(f"SELECT row_no, {_enum_sql(_value('company'), S.COMPANIES)} AS company, {_enum_sql(_value('region'), S.REGIONS)} AS region FROM raw", "located", raw=_sql_rows()))
def enum_conform(t):
    one = lambda c: j.conform_enum(j.cell_value(F.col(c)), j.ENUMS[c]).alias(c)
    return _raw_rows(t).select("row_no", one("company"), one("region"))


@query("journal_blank", roles.sql("SELECT row_no FROM raw WHERE incident_date IS NOT NULL AND company IS NOT NULL", "located", raw=_sql_rows()))
def journal_blank(t):
    return j.skip_blank(_raw_rows(t)).select("row_no")


@query(
    "journal_errors",
    roles.sql("SELECT file, row_no, concat('Row ', CAST(row_no AS VARCHAR), ': ', failure) AS message FROM judged WHERE failure IS NOT NULL", "located", **_JOURNAL),
)
def journal_errors(t):
    return j.split_valid(j.map_journal_rows(_raw_rows(t)))[1]


@query("journal_header", "SELECT n_name AS file, CAST(2 AS BIGINT) AS header_row, CAST(6 AS BIGINT) AS hits, true AS accepted FROM nation")
def journal_header(t):
    found = j.detect_header(_journal_cells(t))
    return found.select("file", F.col("header_row").cast("long").alias("header_row"), F.col("hits").cast("long").alias("hits"), "accepted")


@query(
    "journal_parse",
    roles.sql(
        f"SELECT file, {', '.join(c for c in _SHOW if c != 'row_no')}, row_no + 4 AS row_no, CAST(incident_date AS VARCHAR) AS incident_date FROM judged WHERE failure IS NULL",
        "located",
        **_JOURNAL,
    ),
)
def journal_parse(t):
    """From untyped cells to valid rows: header search, column positions, mapping, quarantine."""
    good, _, _ = j.parse_journal(_journal_cells(t))
    return good.select("file", *[c for c in _SHOW if c != "row_no"], F.col("row_no").cast("long").alias("row_no"), F.col("incident_date").cast("string").alias("incident_date"))


# --- files and act records ---------------------------------------------------------------------------------------------

_FILE_SQL = """SELECT page_id, reason IS NULL AS accepted, reason, name AS original_filename FROM (SELECT page_id, name,
CASE WHEN content_type = 'text/html' THEN 'content_type' WHEN NOT (ext IN ('.pdf', '.docx', '.xls', '.xlsx')) THEN 'extension' WHEN size_bytes > 52428800 THEN 'size' END AS reason
FROM (SELECT *, concat('file', CAST(page_id AS VARCHAR), suffix) AS name, lower(suffix) AS ext FROM files) f) g"""
_FILES = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.exe' WHEN 3 THEN '' ELSE '.docx' END AS suffix,
CASE WHEN page_id % 7 = 0 THEN 'text/html' WHEN page_id % 7 = 1 THEN '' ELSE 'application/pdf' END AS content_type, length(html) * 20000 AS size_bytes FROM pages"""


@query("manifest", roles.sql(_FILE_SQL, files=_FILES))
def manifest(t):
    files = t.pages.selectExpr(
        "page_id",
        "concat(url, '/file', CAST(page_id AS STRING), CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.exe' WHEN 3 THEN '' ELSE '.docx' END) AS path",
        "CASE WHEN page_id % 7 = 0 THEN 'text/html' WHEN page_id % 7 = 1 THEN '' ELSE 'application/pdf' END AS content_type",
        "length(html) * 20000L AS size_bytes",
        "TIMESTAMP_NTZ '2026-02-17 10:00:00' AS uploaded_at",
    )
    return mf.classify_manifest(files).select("page_id", "accepted", "reason", "original_filename")


@query(
    "text_prep",
    "SELECT doc_id, false AS truncated, md5(text) AS digest FROM documents WHERE trim(text, E' \\n\\t\\r') <> ''",
)
def text_prep(t):
    ready = a.prepare_text(t.documents, "text")
    return ready.select("doc_id", "truncated", F.md5("prepared").alias("digest"))


_ACT_JSON = """concat('{"act_type": "', CASE k % 4 WHEN 0 THEN ' Служебное расследование' WHEN 1 THEN 'СПЕЦИАЛЬНОЕ РАССЛЕДОВАНИЕ' WHEN 2 THEN 'Иное' ELSE 'Внутреннее расследование' END,
 '", "act_date": ', CASE k % 5 WHEN 0 THEN '"не-дата"' WHEN 1 THEN 'null' ELSE concat('"', CAST(d AS {text}), '"') END,
 ', "act_number": ', CASE k % 3 WHEN 0 THEN CAST(k AS {text}) ELSE concat('"N', CAST(k AS {text}), '"') END,
 ', "victim_birth_date": "', CASE k % 2 WHEN 0 THEN '1994' ELSE '1985-05-20' END,
 '", "victim_training_dates": ', CASE k % 2 WHEN 0 THEN '["2020-01-01", "2021-01-01"]' ELSE '"2022"' END,
 ', "employer_fault_pct": ', CASE k % 6 WHEN 0 THEN '"80"' WHEN 1 THEN '80.5' WHEN 2 THEN '40.0' WHEN 3 THEN '"many"' ELSE CAST(k % 101 AS {text}) END,
 ', "work_related": ', CASE k % 4 WHEN 0 THEN '"yes"' WHEN 1 THEN 'false' WHEN 2 THEN '2' ELSE 'true' END,
 ', "company_name_from_act": "', CASE WHEN k % 8 = 0 THEN '' ELSE c_mktsegment END, '", "company_name": "', CASE WHEN k % 16 = 0 THEN ' ' ELSE c_name END,
 '", "region_from_act": "', CASE k % 3 WHEN 0 THEN 'город Алматы' ELSE n_name END,
 '", "cause_categories": ', CASE k % 7 WHEN 0 THEN '["a", 1]' WHEN 1 THEN '"a"' ELSE concat('["', o_orderpriority, '", "x"]') END, ', "unknown": 1}')"""


def _parsed_acts(t):
    docs = roles._located_orders(t).selectExpr(
        "k AS file_id",
        "CASE WHEN k % 10 = 0 THEN k + 500 WHEN k % 10 = 1 THEN k ELSE NULL END AS incident_id",
        f"CASE WHEN k % 50 = 7 THEN 'no json' ELSE {_ACT_JSON.replace('{text}', 'STRING')} END AS doc",
    )
    return a.parse_act_json(docs, "doc")


_ACT_FIELDS = """SELECT k AS file_id, CASE WHEN k % 10 = 0 THEN k + 500 WHEN k % 10 = 1 THEN k ELSE NULL END AS incident_id, k % 50 = 7 AS broken,
CASE WHEN k % 50 = 7 THEN NULL WHEN k % 4 IN (0, 3) THEN 'Внутреннее расследование' WHEN k % 4 = 1 THEN 'Специальное расследование' ELSE 'Иное' END AS act_type,
CASE WHEN k % 50 = 7 OR k % 5 IN (0, 1) THEN NULL ELSE CAST(d AS VARCHAR) END AS act_date,
CASE WHEN k % 50 = 7 OR k % 3 = 0 THEN NULL ELSE concat('N', CAST(k AS VARCHAR)) END AS act_number,
CASE WHEN k % 50 = 7 THEN NULL WHEN k % 2 = 0 THEN '1994-01-01' ELSE '1985-05-20' END AS victim_birth_date,
CASE WHEN k % 50 = 7 THEN NULL WHEN k % 2 = 0 THEN '2020-01-01, 2021-01-01' ELSE '2022' END AS victim_training_dates,
CASE WHEN k % 50 = 7 OR k % 6 IN (1, 3) THEN -1 WHEN k % 6 = 0 THEN 80 WHEN k % 6 = 2 THEN 40 ELSE k % 101 END AS employer_fault_pct,
CASE WHEN k % 50 = 7 OR k % 4 = 2 THEN NULL ELSE k % 4 <> 1 END AS work_related,
CASE WHEN k % 50 = 7 OR k % 8 = 0 THEN '' ELSE c_mktsegment END AS for_matching, CASE WHEN k % 50 = 7 OR k % 16 = 0 THEN '' ELSE c_name END AS company_name,
CASE WHEN k % 3 = 0 THEN 'Алматы' ELSE n_name END AS region,
CASE WHEN k % 50 = 7 OR k % 7 IN (0, 1) THEN NULL ELSE concat(o_orderpriority, '|x') END AS cause_categories,
concat_ws('|', CASE WHEN k % 50 <> 7 AND k % 5 = 0 THEN 'act_date' END, CASE WHEN k % 50 <> 7 AND k % 3 = 0 THEN 'act_number' END,
CASE WHEN k % 50 <> 7 AND k % 4 = 2 THEN 'work_related' END, CASE WHEN k % 50 <> 7 AND k % 6 IN (1, 3) THEN 'employer_fault_pct' END,
CASE WHEN k % 50 <> 7 AND k % 7 IN (0, 1) THEN 'cause_categories' END) AS bad_fields FROM located"""


@query(
    "act_json",
    roles.sql(
        "SELECT file_id, act_type, act_date, act_number, victim_birth_date, victim_training_dates, CAST(employer_fault_pct AS BIGINT) AS employer_fault_pct, work_related, cause_categories, bad_fields FROM fields",
        "located",
        fields=_ACT_FIELDS,
    ),
)
def act_json(t):
    f = lambda c: F.col(f"act.{c}")
    return _parsed_acts(t).select(
        "file_id", f("act_type"), f("act_date").cast("string").alias("act_date"), f("act_number"),
        f("victim_birth_date").cast("string").alias("victim_birth_date"), f("victim_training_dates"),
        F.coalesce(f("employer_fault_pct").cast("long"), F.lit(-1)).alias("employer_fault_pct"), f("work_related"),
        F.array_join(f("cause_categories"), "|").alias("cause_categories"), F.array_join("bad_fields", "|").alias("bad_fields"),
    )


_ACCEPT = "NOT broken AND (for_matching <> '' OR company_name <> '') AND (incident_id IS NULL OR incident_id IN (SELECT o_orderkey FROM orders))"


@query(
    "act_accept",
    roles.sql(
        f"SELECT file_id, act_type = 'Иное' AS text_only, CASE WHEN act_type <> 'Иное' THEN region END AS region_from_act, CASE WHEN act_type <> 'Иное' THEN coalesce(cause_categories, '') ELSE '' END AS cause_categories, 'ru' AS language, 'Не привязан' AS link_status FROM fields WHERE {_ACCEPT}",
        "located",
        fields=_ACT_FIELDS,
    ),
)
def act_accept(t):
    accepted, _ = a.accept_acts(_parsed_acts(t), t.orders.select(F.col("o_orderkey").alias("id")))
    tags = F.array_join("cause_categories", "|").alias("cause_categories")
    return accepted.select("file_id", "text_only", "region_from_act", tags, "language", "link_status")


@query(
    "act_batch",
    roles.sql(f"SELECT count(*) AS total, count(*) FILTER (WHERE {_ACCEPT}) AS successful, count(*) FILTER (WHERE NOT ({_ACCEPT})) AS failed FROM fields", "located", fields=_ACT_FIELDS),
)
def act_batch(t):
    return a.act_batch_report(*a.accept_acts(_parsed_acts(t), t.orders.select(F.col("o_orderkey").alias("id"))))


@query(
    "region_norm",
    roles.sql(
        """SELECT k AS id, CASE WHEN k % 6 = 0 THEN 'Мангистауская область' WHEN k % 6 = 1 THEN 'Алматы' WHEN k % 6 = 2 THEN 'Мангистауская область' WHEN k % 6 = 3 THEN 'Туркестанская область'
WHEN k % 6 = 4 THEN NULL ELSE n_name END AS region FROM located""",
        "located",
    ),
)
def region_norm(t):
    rows = roles._located_orders(t).selectExpr(
        "k AS id",
        "CASE k % 6 WHEN 0 THEN 'Маңғыстау облысы' WHEN 1 THEN 'город Алматы' WHEN 4 THEN NULL ELSE n_name END AS region",
        "CASE k % 6 WHEN 1 THEN 'ТОО Уранэнерго' WHEN 2 THEN 'Oil Services Company 7' WHEN 3 THEN 'ТОО Уранэнерго' ELSE c_name END AS company",
    )
    return rows.select("id", a.normalise_region(F.col("region"), F.col("company")).alias("region"))


# --- upsert ------------------------------------------------------------------------------------------------------------

_STAMP = "TIMESTAMP_NTZ '2026-01-01 00:00:00'"


def _stored(t):
    """All orders of customers with a positive balance are stored; ids are texts."""
    rich = t.customer.where("c_acctbal > 3000").select(F.col("c_name").alias("victim_name"))
    stored = roles.incidents(t).join(rich, "victim_name", "left_semi")
    return stored.withColumns(
        {"id": F.col("id").cast("string"), "created_at": F.expr(_STAMP), "updated_at": F.expr(_STAMP)}
    )


def _incoming(t):
    """All orders arrive again, respaced, in two files; every third with another location."""
    rows = roles.incidents(t)
    return rows.withColumns(
        {
            "victim_name": F.concat(F.lit(" "), F.upper("victim_name")),
            "location": F.when(F.col("id") % 3 == 0, F.lit("Elsewhere")).otherwise(F.concat("location", F.lit("  "))),
            "file_seq": (F.col("id") % 2).cast("int"),
            "file": F.concat(F.lit("file"), (F.col("id") % 2).cast("string")),
            "row_no": F.col("id"),
            "id": F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 9, "0")),
            "description": F.lit("imported"),
        }
    )


_UPSERT = dict(
    stored="SELECT CAST(id AS VARCHAR) AS id, incident_date, company, classification, region, victim_name, location, description, dzo FROM incidents WHERE victim_name IN (SELECT c_name FROM customer WHERE c_acctbal > 3000)",
    incoming="""SELECT concat('n', lpad(CAST(id AS VARCHAR), 9, '0')) AS id, incident_date, company, classification, region,
 CASE WHEN victim_name IS NOT NULL THEN concat(' ', upper(victim_name)) END AS victim_name, CASE WHEN id % 3 = 0 THEN 'Elsewhere' ELSE concat(location, '  ') END AS location,
 CAST(id % 2 AS INT) AS file_seq, id AS row_no, dzo FROM incidents""",
    keyed_in="SELECT *, concat_ws('|', CAST(incident_date AS VARCHAR), company, coalesce(classification, '?'), coalesce(region, '?'), lower(trim(coalesce(victim_name, ''))), lower(trim(location))) AS key FROM incoming",
    keyed_stored="SELECT *, concat_ws('|', CAST(incident_date AS VARCHAR), company, coalesce(classification, '?'), coalesce(region, '?'), lower(trim(coalesce(victim_name, ''))), lower(trim(location))) AS key FROM stored",
    known="SELECT key, max(id) AS stored_id FROM keyed_stored GROUP BY 1",
    firsts="SELECT key, min(file_seq) AS first_file FROM keyed_in GROUP BY 1",
    openers="SELECT i.key, max(i.id) AS first_id FROM keyed_in i JOIN firsts f ON f.key = i.key AND f.first_file = i.file_seq GROUP BY 1",
    classified="""SELECT i.*, i.id AS own_id, CASE WHEN s.stored_id IS NOT NULL OR i.file_seq <> f.first_file THEN 'update' ELSE 'create' END AS action,
 CASE WHEN s.stored_id IS NOT NULL THEN s.stored_id WHEN i.file_seq = f.first_file THEN i.id ELSE o.first_id END AS final_id
FROM keyed_in i JOIN firsts f ON f.key = i.key JOIN openers o ON o.key = i.key LEFT JOIN known s ON s.key = i.key""",
)


@query(
    "dedup_key",
    roles.sql("SELECT row_no, lower(trim(coalesce(victim_name, ''))) AS victim_key, lower(trim(location)) AS location_key FROM incoming", "incidents", incoming=_UPSERT["incoming"]),
)
def dedup_key(t):
    return u.with_dedup_key(_incoming(t)).select("row_no", "victim_key", "location_key")


@query("append_replay", roles.sql("SELECT id, CAST(incident_date AS VARCHAR) AS incident_date, company FROM incidents WHERE company <> 'MACHINERY'", "incidents"))
def append_replay(t):
    """Two batches appended to a stored table, the first of them twice; a write that ended before its manifest is left lying."""
    stored = SnapshotTable(t.spark, scratch_folder(t.spark, "store"), S.INCIDENT)
    rows = roles.incidents(t).withColumn("id", F.col("id").cast("string"))
    batches = {"first": rows.where("company < 'MACHINERY'"), "second": rows.where("company > 'MACHINERY'")}
    for name in ("first", "first", "second", "first"):
        stored.append(batches[name], name, F.current_timestamp(), S.INCIDENT_DEFAULTS)
    stored._write(S.conform(rows.limit(10), S.INCIDENT, S.INCIDENT_DEFAULTS))
    return stored.read().select(F.col("id").cast("long").alias("id"), F.col("incident_date").cast("string").alias("incident_date"), "company")


@query(
    "year_prune",
    roles.sql("SELECT id FROM stored WHERE year(incident_date) BETWEEN 1997 AND 1998", "incidents", stored=_UPSERT["stored"]),
)
def year_prune(t):
    late = roles.incidents(t).where("incident_date >= DATE '1997-03-01' AND incident_date < DATE '1998-06-01'")
    return u.prune_existing(_stored(t), late).select("id")


@query("upsert_classify", roles.sql("SELECT row_no, action, final_id AS id FROM classified", "incidents", **_UPSERT))
def upsert_classify(t):
    return u.classify_upsert(_incoming(t), _stored(t)).select("row_no", "action", "id")


@query(
    "upsert_last",
    roles.sql(
        "SELECT row_no, action, final_id AS id FROM classified",
        "incidents",
        **(_UPSERT | {"keyed_in": f"SELECT * FROM ({_UPSERT['keyed_in']}) z QUALIFY row_no = max(row_no) OVER (PARTITION BY key, file_seq)"}),
    ),
)
def upsert_last(t):
    """Of rows with one key in one file only the last counts."""
    return u.classify_upsert(_incoming(t), _stored(t), "last").select("row_no", "action", "id")


@query(
    "upsert_apply",
    roles.sql(
        """SELECT b.id, CASE WHEN w.id IS NULL THEN b.location ELSE w.location END AS location, CASE WHEN w.id IS NULL THEN b.description ELSE 'imported' END AS description,
 CASE WHEN w.id IS NULL THEN b.dzo ELSE w.dzo END AS dzo, w.id IS NULL AND b.old AS untouched
FROM (SELECT id, location, description, dzo, true AS old FROM stored UNION ALL SELECT final_id, location, 'imported', dzo, false FROM classified WHERE action = 'create') b
LEFT JOIN (SELECT final_id AS id, location, dzo FROM (SELECT *, row_number() OVER (PARTITION BY final_id ORDER BY file_seq DESC, row_no DESC) AS k FROM classified WHERE action = 'update') r WHERE k = 1) w ON w.id = b.id""",
        "incidents",
        **_UPSERT,
    ),
)
def upsert_apply(t):
    now = F.expr("TIMESTAMP_NTZ '2026-02-01 00:00:00'")
    stored = _stored(t)
    result = u.upsert(stored, u.classify_upsert(_incoming(t), stored), now)
    return result.select("id", "location", "description", "dzo", (F.col("updated_at") < now).alias("untouched"))


@query(
    "import_report",
    roles.sql(
        """SELECT coalesce(file, 'all files') AS file, processed, created, updated, n_errors FROM (
SELECT c.file, processed, created, updated, n_errors FROM (
SELECT concat('file', CAST(file_seq AS VARCHAR)) AS file, count(*) AS processed, count(*) FILTER (WHERE action = 'create') AS created, count(*) FILTER (WHERE action = 'update') AS updated FROM classified GROUP BY 1) c
JOIN (SELECT file, count(*) AS n_errors FROM numbered GROUP BY 1) e ON e.file = c.file
UNION ALL SELECT NULL, (SELECT count(*) FROM classified), (SELECT count(*) FROM classified WHERE action = 'create'), (SELECT count(*) FROM classified WHERE action = 'update'), (SELECT count(*) FROM numbered)) r""",
        "incidents",
        **_UPSERT,
        numbered="SELECT *, row_number() OVER (PARTITION BY file ORDER BY row_no) AS k FROM (SELECT concat('file', CAST(l_linestatus = 'F' AS INT)::VARCHAR) AS file, l_orderkey * 10 + l_linenumber AS row_no, max(concat('Row ', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR))) AS message FROM lineitem GROUP BY 1, 2) x",
    ),
)
def import_report(t):
    errors = t.lineitem.select(
        F.when(F.col("l_linestatus") == "F", F.lit("file1")).otherwise(F.lit("file0")).alias("file"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"),
    ).distinct()
    errors = errors.withColumn("message", F.concat(F.lit("Row "), F.col("row_no").cast("string")))
    report = u.import_report(u.classify_upsert(_incoming(t), _stored(t)), errors)
    return report.select(F.coalesce("file", F.lit("all files")).alias("file"), "processed", "created", "updated", "n_errors")


@query(
    "import_full",
    roles.sql(
        """SELECT * FROM per_file UNION ALL SELECT 'all files', sum(processed)::BIGINT, sum(created)::BIGINT, sum(updated)::BIGINT, sum(adopted_acts)::BIGINT, sum(n_errors)::BIGINT, NULL, count(*), count(error) FROM per_file""",
        "incidents",
        **_UPSERT,
        per_file="""SELECT c.file, processed, created, updated, coalesce(adopted_acts, 0) AS adopted_acts, coalesce(n_errors, 0) AS n_errors, NULL AS error, CAST(1 AS BIGINT) AS files, CAST(0 AS BIGINT) AS failed_files FROM (
SELECT concat('file', CAST(file_seq AS VARCHAR)) AS file, count(*) AS processed, count(*) FILTER (WHERE action = 'create') AS created, count(*) FILTER (WHERE action = 'update') AS updated FROM classified GROUP BY 1) c
LEFT JOIN (SELECT concat('file', CAST(p_partkey % 2 AS VARCHAR)) AS file, count(*) AS adopted_acts FROM part GROUP BY 1) d ON d.file = c.file
LEFT JOIN (SELECT 'file0' AS file, count(*) AS n_errors FROM supplier) e ON e.file = c.file
UNION ALL SELECT concat('bad', CAST(r_regionkey AS VARCHAR)), 0, 0, 0, 0, 0, r_name, 1, 1 FROM region""",
    ),
)
def import_full(t):
    """The report of a whole import: adopted acts and files that could not be read beside the counts."""
    errors = t.supplier.select(F.lit("file0").alias("file"), F.col("s_suppkey").alias("row_no"), F.lit("wrong").alias("message"))
    adopted = t.part.select(F.concat(F.lit("file"), (F.col("p_partkey") % 2).cast("string")).alias("file"))
    rejected = t.region.select(F.concat(F.lit("bad"), F.col("r_regionkey").cast("string")).alias("file"), F.col("r_name").alias("reason"))
    report = u.import_report(u.classify_upsert(_incoming(t), _stored(t)), errors, adopted, rejected)
    return report.withColumn("file", F.coalesce("file", F.lit("all files")))


@query(
    "update_by_id",
    roles.sql(
        "SELECT id, CASE WHEN c.k IS NULL THEN location ELSE 'moved' END AS location, CASE WHEN c.k IS NULL THEN victim_count ELSE c.n END AS victim_count, region FROM incidents LEFT JOIN (SELECT l_orderkey AS k, CAST(count(*) AS INT) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) c ON c.k = id",
        "incidents",
    ),
)
def update_by_id(t):
    changes = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).cast("int").alias("victim_count"), F.lit("moved").alias("location")
    )
    return u.update_by_id(roles.incidents(t), changes).select("id", "location", "victim_count", "region")


@query("unknown_ids", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def unknown_ids(t):
    known = t.customer.select(F.col("c_custkey").alias("id"))
    return u.unknown_ids(known, t.part.select(F.col("p_partkey").alias("id")))
