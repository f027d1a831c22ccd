"""Incident journals: scan, header detection, column positions, typed mapping, quarantine."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewarden import schemas as S
from sitewarden.functions.frames import computed_once
from sitewarden.functions.text import any_of, collapse, lookup, present, strip
from sitewarden.operators.upsert import stable_id
from sitewarden.session import staged
from sitewarden.sources.csvscan import csv_records

RAW = T.StructType(
    [T.StructField("row_no", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))]
)

# --- Fixed values of the journal form ----------------------------------------------------------------------------

HEADERS = {
    "incident_date": "Дата возникновения происшествия",
    "incident_time": "Время возникновения происшествия",
    "company": "Портфельная компания",
    "dzo": "ДЗО",
    "classification": "Вид/классификация происшествия",
    "region": "Регион происшествия",
    "location": "Место происшествия",
    "victim_name": "ФИО пострадавшего",
    "victim_birth_date": "Дата рождения прострадавшего",
    "victim_position": "Должность прострадавшего",
    "victim_work_experience": "Стаж работы прострадавшего",
    "injury_type": "Тип травмы",
    "diagnosis": "Диагноз",
    "description": "Краткое описание происшествия",
    "initial_actions": "Принятые первоочередные меры по защите персонала, локализации",
    "consequences_elimination_date": "Дата ликвидации последствий происшествия",
    "consequences_elimination_time": "Время ликвидации последствий происшествия",
    "notified_authorities": "Какие государтвенные органы и другие организации оповещены",
    "preliminary_causes": "Предварительные причины",
    "consequences_description": "Описание проследствий",
    "investigation_results": "Результаты расследования",
    "main_causes_from_report": "Информация об основных причинах согласно акту расследования",
    "corrective_actions": "Мероприятия по устранению причин несчастного случая, согласно Акту специального расследования",
    "corrective_actions_execution_report": "Отчет об исполнении мероприятий по устранению причин несчастного случая",
    "root_causes": "Информация о коренных причинах",
    "notes": "Примечание",
    "investigation_status": "Завершено \\ не завершено расследование",
    "deletion_status": "Статаус удаления заявки",
}
PREFIX_HEADERS = {
    "impact_on_production": "Влияние на производственный процесс",
    "damage_amount_kzt": "Сумма ущерба",
}
REQUIRED = ("incident_date", "company", "classification", "region", "location", "investigation_status")
HEADER_MIN_HITS = 4
NO_DESCRIPTION = "Нет описания"
NO_HEADER, NO_COLUMNS = "Не удалось определить строку заголовка", "Отсутствуют обязательные колонки: "
WRONG_VALUE, MISSING_VALUE = "Некорректное значение для {field}: '", "missing required fields after parsing"
# Cell texts a spreadsheet reader takes for a missing value.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

ENUMS = {
    "company": S.COMPANIES,
    "classification": S.CLASSIFICATIONS,
    "region": S.REGIONS,
    "victim_work_experience": S.WORK_EXPERIENCE,
    "injury_type": S.INJURY_TYPES,
    "investigation_results": S.INVESTIGATION_RESULTS,
    "investigation_status": S.INVESTIGATION_STATUSES,
    "deletion_status": S.DELETION_STATUSES,
}
DATES = ("incident_date", "victim_birth_date", "consequences_elimination_date")
TIMES = ("incident_time", "consequences_elimination_time")
FIELDS = (*HEADERS, *PREFIX_HEADERS)
_TYPED_AT_ONCE = 6
NOT_IN_JOURNAL = (
    "work_type",
    "equipment",
    "safety_responsible_person",
    "weather_conditions",
    "safety_training_completed",
    "is_recurrent",
    "regulatory_compliant",
)


# --- scan ------------------------------------------------------------------------------------------------------------


def read_journal(spark: SparkSession, path: str, fmt: str = "parquet", delimiter: str = ",") -> DataFrame:
    """Untyped rows of every journal under ``path``: ``file, row_no, cells``.

    JSON lines and Parquet hold ``row_no`` and ``cells``. CSV files may be of any size and width, and quoted cells may hold line breaks
    (see ``sources.csvscan``); a record is a row.
    """
    if fmt in ("json", "parquet"):
        rows = spark.read.schema(RAW).format(fmt).load(path)
        return rows.select(F.col("_metadata.file_path").alias("file"), "row_no", "cells")
    if fmt != "csv":
        raise ValueError(f"unsupported journal format {fmt!r}")
    records = csv_records(spark, path, delimiter)
    return staged(records.select("file", F.col("row_no").cast("int").alias("row_no"), _csv_cells(F.col("text"), delimiter).alias("cells")))


def _csv_cells(record: Column, delimiter: str) -> Column:
    """As many cells as the record has; quotes may hold delimiters and line breaks, doubled quotes are one, an empty cell is null.

    What follows a closing quote up to the delimiter belongs to the cell.
    """
    d = re.escape(delimiter)
    quoted = '"[^"]*+(?:""[^"]*+)*+"'
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(f"{d}({quoted}[^{d}]*|[^{d}]*)"), F.lit(1))
    inner = lambda c: F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    mixed = lambda c: F.concat(inner(F.regexp_extract(c, f"^({quoted})", 1)), F.regexp_replace(c, f"^{quoted}", ""))
    whole = lambda c: c.startswith('"') & c.rlike(f"^{quoted}\\z")
    return F.transform(found, lambda c: F.when(whole(c), inner(c)).when(c.rlike(f"^{quoted}"), mixed(c)).when(c != "", c))


# --- header ------------------------------------------------------------------------------------------------------------


def _norm_name(c: Column) -> Column:
    return F.lower(collapse(c))


def detect_header(
    rows: DataFrame, required: tuple[str, ...] = REQUIRED, scan: int | None = None, min_hits: int = HEADER_MIN_HITS
) -> DataFrame:
    """Per file the row (among the first ``scan``, if given) that holds most required names, the first such, and its hits.

    ``accepted`` is false below ``min_hits``. Every file gets a row.
    """
    names = F.transform(F.col("cells"), lambda c: _norm_name(F.coalesce(c, F.lit(""))))
    wanted = F.array(*[_norm_name(F.lit(HEADERS[f])) for f in required])
    # Names are normalised only in rows that hold the longest word of one.
    text = F.lower(F.array_join("cells", " "))
    likely = any_of([text.contains(w) for w in sorted({max(HEADERS[f].lower().split(), key=len) for f in required})])
    hits = F.when(F.col("cells").isNull() | likely, F.size(F.array_intersect(names, wanted))).otherwise(F.lit(0))
    looked_at = rows if scan is None else rows.where(F.col("row_no") < scan)
    scored = looked_at.select("file", "row_no", "cells", hits.alias("hits"))
    best = scored.groupBy("file").agg(
        F.max_by(F.struct("row_no", "cells", "hits"), F.struct(F.col("hits"), -F.col("row_no"))).alias("h")
    )
    return best.select(
        "file",
        F.col("h.row_no").alias("header_row"),
        F.col("h.cells").alias("header"),
        F.col("h.hits").alias("hits"),
        (F.col("h.hits") >= min_hits).alias("accepted"),
    )


def locate_columns(headers: DataFrame) -> DataFrame:
    """Adds ``at``: the position (from 1, 0 = absent) of every journal field, and the required fields that miss.

    Required names match in any case and spacing, the others by exact name once trimmed, two by prefix. Unnamed
    columns match nothing.
    """
    plain = F.transform("header", lambda c: F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "\n", " "))
    normal = F.transform(plain, lambda c: _norm_name(c))

    def position(field: str) -> Column:
        if field in PREFIX_HEADERS:
            at = F.array_position(F.transform(plain, lambda c: c.startswith(PREFIX_HEADERS[field])), True)
        elif field in REQUIRED:
            at = F.array_position(normal, _norm_name(F.lit(HEADERS[field])))
        else:
            at = F.array_position(plain, HEADERS[field])
        return F.coalesce(at, F.lit(0)).cast("int").alias(field)

    located = headers.withColumn("at", F.struct(*[position(f) for f in FIELDS]))
    missing = F.array_compact(F.array(*[F.when(F.col(f"at.{f}") == 0, F.lit(HEADERS[f])) for f in REQUIRED]))
    return located.withColumn("missing", missing)


def rejected_files(located: DataFrame) -> DataFrame:
    """Files without a header or without a required column: ``file, reason``."""
    reason = F.when(~F.col("accepted"), F.lit(NO_HEADER)).when(
        F.size("missing") > 0,
        F.concat(F.lit(NO_COLUMNS), F.array_join("missing", ", ")),
    )
    return located.select("file", reason.alias("reason")).where(F.col("reason").isNotNull())


def canonicalise_columns(rows: DataFrame, located: DataFrame) -> DataFrame:
    """Data rows of accepted files with one raw text column per journal field; ``row_no`` is the sheet row from 1.

    The header table has one row per file, so adaptive execution broadcasts it unless the files outnumber that.
    """
    usable = located.where(F.col("accepted") & (F.size("missing") == 0)).select("file", "header_row", "at")
    data = rows.join(usable, "file").where(F.col("row_no") > F.col("header_row"))

    def cell(field: str) -> Column:
        at = F.col(f"at.{field}")
        raw = F.when(at > 0, F.get("cells", at - 1))
        return F.when(~raw.isin(*MISSING_CELLS), raw).alias(field)

    return data.select("file", (F.col("row_no") + 1).alias("row_no"), *[cell(f) for f in FIELDS])


# --- typed rows ----------------------------------------------------------------------------------------------------------


def skip_blank(rows: DataFrame) -> DataFrame:
    """Rows without a date or a company cell are neither good nor wrong."""
    return rows.where(F.col("incident_date").isNotNull() & F.col("company").isNotNull())


def cell_value(c: Column) -> Column:
    return F.when((c != "") & (c != "-"), c)


def parse_date(c: Column) -> Column:
    """Lenient: ISO first, then month before day, then day before month; anything else is null."""
    day = F.translate(F.regexp_extract(c, r"^\s*(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})([T ].*)?$", 1), "/-", "..")
    formats = ("y.M.d", "M.d.y", "d.M.y")
    return F.coalesce(*[F.try_to_timestamp(day, F.lit(f)) for f in formats]).cast("date")


def parse_time(c: Column) -> Column:
    """``HH:mm:ss`` text; a date without a time is midnight, anything else null."""
    pattern = r"^(?:.*[T ])?([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?(?:\.\d+)?$"
    text = strip(c)
    hour, minute, second = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    clock = F.concat_ws(":", F.lpad(hour, 2, "0"), minute, F.when(second == "", F.lit("00")).otherwise(second))
    return F.when(text.rlike(pattern), clock).when(parse_date(text).isNotNull(), F.lit("00:00:00"))


def parse_number(c: Column) -> Column:
    text = strip(c)
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def conform_enum(c: Column, domain: tuple[str, ...]) -> Column:
    """The domain value equal to the text ignoring case and spacing (an exact value is equal to itself), else null."""
    return lookup(_norm_name(c), {" ".join(v.split()).lower(): v for v in domain})


def _enum_error(raw: Column, conformed: Column, field: str) -> Column:
    """Message for a non-null text outside the domain, null otherwise."""
    message = F.concat(F.lit(WRONG_VALUE.format(field=field)), strip(raw), F.lit("'"))
    return F.when(raw.isNotNull() & conformed.isNull(), message)


def map_journal_rows(rows: DataFrame) -> DataFrame:
    """Typed incident columns from the raw journal columns, plus ``error`` (first wrong domain value or null).

    The steps build on columns rather than on nested expressions, so that each text is normalised once.
    """
    rows = skip_blank(rows)
    values = rows.select(
        *[c for c in rows.columns if c not in FIELDS], *[cell_value(F.col(f)).alias(f"raw_{f}") for f in FIELDS]
    )

    def typed(field: str) -> Column:
        raw = F.col(f"raw_{field}")
        if field in ENUMS:
            return conform_enum(raw, ENUMS[field])
        if field in DATES:
            return parse_date(raw)
        if field in TIMES:
            return parse_time(raw)
        if field == "damage_amount_kzt":
            return parse_number(raw)
        return strip(raw)

    # Some at a time: one method of generated code for all would be too large to be compiled to machine code.
    mapped = values
    for i in range(0, len(FIELDS), _TYPED_AT_ONCE):
        mapped = computed_once(mapped, {f: typed(f) for f in FIELDS[i : i + _TYPED_AT_ONCE]})
    error = F.coalesce(*[_enum_error(F.col(f"raw_{f}"), F.col(f), f) for f in ENUMS])
    described = F.when(present(F.col("description")), F.col("description")).otherwise(F.lit(NO_DESCRIPTION))
    fatal = F.coalesce(F.col("injury_type") == S.INJURY_FATAL, F.lit(False))
    return mapped.withColumns(
        {
            "error": error,
            "description": described,
            "victim_count": F.lit(1).cast("short"),
            "fatality_count": fatal.cast("short"),
        }
    ).drop(*[f"raw_{f}" for f in FIELDS])


def split_valid(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good rows, errors)``; an error row has ``file, row_no, message``."""
    missing = ~present(F.col("location")) | F.greatest(*[F.col(f).isNull().cast("int") for f in REQUIRED]).cast("boolean")
    text = F.coalesce(F.col("error"), F.when(missing, F.lit(MISSING_VALUE)))
    judged = mapped.withColumn("failure", text)
    good = judged.where(F.col("failure").isNull()).drop("failure", "error")
    message = F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(": "), F.col("failure"))
    errors = judged.where(F.col("failure").isNotNull()).select("file", "row_no", message.alias("message"))
    return good, errors


def with_file_order(good: DataFrame, order: DataFrame | None = None, batch: str = "") -> DataFrame:
    """Adds ``file_seq`` (from ``order``: ``file, file_seq``; 0 for a single file) and a stable new ``id``."""
    rows = good.join(order, "file") if order is not None else good.withColumn("file_seq", F.lit(0))
    return rows.withColumn("id", stable_id(F.lit(batch), F.col("file"), F.col("row_no")))


def parse_journal(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(good rows, row errors, rejected files)`` of a journal scan."""
    located = locate_columns(detect_header(rows))
    good, errors = split_valid(map_journal_rows(canonicalise_columns(rows, located)))
    return good, errors, rejected_files(located)
