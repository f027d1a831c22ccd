"""Act records: text preparation, field-by-field validation of JSON documents, acceptance, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewarden import schemas as S
from sitewarden.functions.text import lookup, present, strip
from sitewarden.session import staged

# --- Fixed values ----------------------------------------------------------------------------------------------------

ACT_TYPE_ALIASES = {
    "внутреннее расследование": "Внутреннее расследование",
    "служебное расследование": "Внутреннее расследование",
    "специальное расследование": "Специальное расследование",
}
REGION_ALIASES = {
    "Маңғыстау облысы": "Мангистауская область",
    "Өзен кенорны": "Мангистауская область",
    "Ақтас кенорны": "Мангистауская область",
    "город Алматы": "Алматы",
}
COMPANY_REGIONS = {
    "Oil Services Company": "Мангистауская область",
    "Уранэнерго": "Туркестанская область",
}
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")
MILLISECONDS_FROM = 20_000_000_000


# --- text --------------------------------------------------------------------------------------------------------------


def prepare_text(df: DataFrame, column: str = "text", limit: int | None = None) -> DataFrame:
    """Blank texts are skipped; the others stay whole unless a ``limit`` is given, and a flag says which were longer."""
    text = F.col(column)
    longer, kept = (F.lit(False), text) if limit is None else (F.length(text) > limit, F.substring(text, 1, limit))
    return df.where(present(strip(text))).withColumns({"truncated": longer, "prepared": kept})


# --- JSON fields ---------------------------------------------------------------------------------------------------------


def _kind(v: Column) -> Column:
    """JSON kind of a variant: STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, ARRAY<..>, OBJECT<..>; null for JSON null."""
    kind = F.schema_of_variant(v)
    return F.when(kind != "VOID", kind)


def _text(v: Column, kind: Column) -> Column:
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))


def _is_number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DECIMAL|DOUBLE)")


def _as_date(v: Column, kind: Column, year_only: bool = False) -> Column:
    """ISO date, ISO date-time at midnight, or a Unix time at midnight; optionally a bare year as 1 January."""
    text = _text(v, kind)
    day = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]00:00(:00(\.0+)?)?Z?)?$"), F.try_to_date(F.substring(text, 1, 10))
    )
    if year_only:
        day = F.coalesce(F.when(text.rlike(r"^\d{4}$"), F.try_to_date(F.concat(text, F.lit("-01-01")))), day)
    number = F.coalesce(
        F.when(_is_number(kind), F.try_variant_get(v, "$", "double")),
        F.when(text.rlike(r"^-?\d+$"), text.try_cast("double")),
    )
    seconds = F.when(F.abs(number) > MILLISECONDS_FROM, number / 1000).otherwise(number)
    unix = F.when(seconds % 86400 == 0, F.date_add(F.lit("1970-01-01").cast("date"), (seconds / 86400).cast("int")))
    return F.coalesce(day, unix)


def _as_int(v: Column, kind: Column) -> Column:
    """Integers, integral numbers, integer texts and booleans; 80.5 is no integer."""
    text = F.regexp_extract(strip(_text(v, kind)), r"^([+-]?\d+)(\.0+)?$", 1)
    number = F.coalesce(
        F.when(_is_number(kind), F.try_variant_get(v, "$", "double")),
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")),
        text.try_cast("double"),
    )
    return F.when(number == F.floor(number), number.try_cast("int"))


def _as_bool(v: Column, kind: Column) -> Column:
    word = F.lower(_text(v, kind))
    number = F.when(_is_number(kind), F.try_variant_get(v, "$", "double"))
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(word.isin(*TRUE_WORDS) | (number == 1), F.lit(True))
        .when(word.isin(*FALSE_WORDS) | (number == 0), F.lit(False))
    )


def _elements(v: Column, kind: Column) -> Column:
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _as_strings(v: Column, kind: Column) -> Column:
    """A list of texts; one element of another kind spoils the field."""
    items = _elements(v, kind)
    return F.when(
        F.forall(items, lambda e: F.schema_of_variant(e) == "STRING"),
        F.transform(items, lambda e: F.try_variant_get(e, "$", "string")),
    )


def _as_objects(v: Column, kind: Column, shape: T.StructType) -> Column:
    """A list of objects with optional text members; unknown members are ignored, a wrong one spoils the field."""
    items = _elements(v, kind)

    def member_ok(e: Column, name: str) -> Column:
        found = F.schema_of_variant(F.try_variant_get(e, f"$.{name}", "variant"))
        return found.isNull() | found.isin("STRING", "VOID")

    def ok(e: Column) -> Column:
        result = F.schema_of_variant(e).startswith("OBJECT")
        for f in shape.fields:
            result = result & member_ok(e, f.name)
        return result

    def build(e: Column) -> Column:
        return F.struct(*[F.try_variant_get(e, f"$.{f.name}", "string").alias(f.name) for f in shape.fields])

    return F.when(F.forall(items, ok), F.transform(items, build))


def _joined_dates(v: Column, kind: Column) -> Column:
    """A text, or a list of anything joined by ", "."""
    items = F.transform(_elements(v, kind), lambda e: F.try_variant_get(e, "$", "string"))
    return F.coalesce(_text(v, kind), F.array_join(items, ", ", "None"))


def _act_type(v: Column, kind: Column) -> Column:
    text = strip(_text(v, kind))
    return F.coalesce(lookup(F.lower(text), ACT_TYPE_ALIASES), text)


def _field(v: Column, kind: Column, field: T.StructField) -> Column:
    if field.name == "act_type":
        return _act_type(v, kind)
    if field.name == "victim_training_dates":
        return _joined_dates(v, kind)
    match field.dataType:
        case T.DateType():
            return _as_date(v, kind, year_only=field.name == "victim_birth_date")
        case T.IntegerType():
            return _as_int(v, kind)
        case T.BooleanType():
            return _as_bool(v, kind)
        case T.ArrayType(elementType=T.StructType()):
            return _as_objects(v, kind, field.dataType.elementType)
        case T.ArrayType():
            return _as_strings(v, kind)
        case _:
            return _text(v, kind)


def parse_act_json(df: DataFrame, column: str, fields: T.StructType = S.ACT_FIELDS) -> DataFrame:
    """Adds ``act`` (struct of validated fields) and ``bad_fields`` (present, but of a wrong type, hence dropped).

    A document that is no JSON object gives an empty record.
    """
    members = fields.fieldNames()
    raw = T.StructType([T.StructField(n, T.VariantType()) for n in members])
    is_object = F.col(column).rlike(r"^\s*\{")
    parsed = df.withColumn("_doc", F.from_json(F.when(is_object, F.col(column)), raw))
    split = parsed.withColumns({f"_v_{n}": F.col(f"_doc.{n}") for n in members})
    kinds = split.withColumns({f"_k_{n}": _kind(F.col(f"_v_{n}")) for n in members})
    values = {f.name: _field(F.col(f"_v_{f.name}"), F.col(f"_k_{f.name}"), f).cast(f.dataType) for f in fields.fields}
    act = kinds.withColumn("act", F.struct(*[v.alias(n) for n, v in values.items()]))
    bad = F.array_compact(
        F.array(*[F.when(F.col(f"_k_{n}").isNotNull() & F.col(f"act.{n}").isNull(), F.lit(n)) for n in members])
    )
    return act.select(*df.columns, "act", bad.alias("bad_fields"))


# --- regions and acceptance ------------------------------------------------------------------------------------------------


def normalise_region(region: Column, company: Column) -> Column:
    """Alias of the region, else the region of the first company pattern found, else unchanged."""
    by_company = [F.when(company.contains(k), F.lit(v)) for k, v in COMPANY_REGIONS.items()]
    return F.coalesce(lookup(region, REGION_ALIASES), *by_company, region)


def accept_acts(parsed: DataFrame, incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` of parsed acts with ``file_id, incident_id, act``.

    The first non-empty of company-for-matching and company is needed; an explicit incident must exist. Fields
    outside the act domain (an act type that is none of the two) leave an act with its text only. Accepted acts
    start unlinked, also those with an explicit incident.
    """
    company = strip(F.coalesce(F.nullif("act.company_name_from_act", F.lit("")), F.col("act.company_name"), F.lit("")))
    known = incidents.select(F.col("id").alias("incident_id"), F.lit(True).alias("known"))
    # Most acts name no incident; a key of their own keeps them from meeting in one task.
    key = F.coalesce(F.concat(F.lit("="), F.col("incident_id").cast("string")), F.concat(F.lit("-"), F.col("file_id").cast("string")))
    marked = known.select(F.concat(F.lit("="), F.col("incident_id").cast("string")).alias("_key"), "known")
    # Written once: the accepted and the rejected acts both read it.
    judged = staged(
        parsed.withColumn("_own", key).join(marked, F.col("_own") == F.col("_key"), "left").drop("_own", "_key")
        .withColumn("company_found", company)
        .withColumn(
            "reason",
            F.when(F.col("incident_id").isNotNull() & F.col("known").isNull(), F.lit("incident_not_found")).when(
                ~present(F.col("company_found")), F.lit("company_missing")
            ),
        )
    )
    rejected = judged.where(F.col("reason").isNotNull()).select("file_id", "reason")
    good = judged.where(F.col("reason").isNull())
    fits = F.col("act.act_type").isNull() | F.col("act.act_type").isin(*S.ACT_TYPES)
    region = normalise_region(F.col("act.region_from_act"), F.col("company_found"))

    def field(f: T.StructField) -> Column:
        value = region if f.name == "region_from_act" else F.col(f"act.{f.name}")
        value = F.when(fits, value)
        if f.name == "language":
            value = F.coalesce(value, F.lit("ru"))
        elif isinstance(f.dataType, T.ArrayType):
            value = F.coalesce(value, F.array().cast(f.dataType))
        return value.alias(f.name)

    kept = [c for c in parsed.columns if c not in ("act", "bad_fields")]
    accepted = good.select(
        *kept, F.lit(S.LINK_UNLINKED).alias("link_status"), (~fits).alias("text_only"), *[field(f) for f in S.ACT_FIELDS.fields]
    )
    return accepted, rejected


def act_batch_report(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """``total, successful, failed`` of an act batch."""
    both = accepted.select(F.lit(1).alias("ok")).unionByName(rejected.select(F.lit(0).alias("ok")))
    return both.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("ok") == 1).alias("successful"),
        F.count_if(F.col("ok") == 0).alias("failed"),
    )
