"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the groups, keep one id of each.

The grouping key is the hash together with the normalised bytes, so texts that share a hash without being equal stay
apart. Copies collapse before the shuffle (a group that holds a third of all rows sends one row per task), and the text
is shuffled once. Rows find their group by hash and SHA-256, so the second shuffle carries no text; the join's large
side may be split by adaptive execution however many rows share a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.common import ascii_lower, whole_text


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower,
    content_hash: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep`` is ``smallest`` or ``largest`` id of a group. Null text counts as empty, and empty texts form a group like any
    other. A row without id counts in ``group_size`` and is kept only where its whole group has no id (``keep_id`` null).
    Rows that repeat id and text are one document given twice: each counts, and each carries the same decision.
    An empty table gives no rows; other columns of ``docs`` play no part, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    norm = normalise(whole_text(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm")).select(
        "_id", "_norm", content_hash(F.col("_norm")).alias("_hash")
    )
    best = F.max("_id") if keep == "largest" else F.min("_id")
    # One row per distinct text: the bytes are compared here, as part of the grouping key.
    texts = (
        rows.groupBy("_hash", "_norm").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.col("_hash").alias("_h"), F.unhex(F.sha2("_norm", 256)).alias("_s"), "keep_id", "group_size")
    )
    ids = rows.select("_id", "_hash", F.unhex(F.sha2("_norm", 256)).alias("_sha"))
    joined = ids.join(texts, (F.col("_hash") == F.col("_h")) & (F.col("_sha") == F.col("_s")))
    return joined.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that repeat a kept id and text all stay: nothing in the two columns tells them apart.
    """
    groups = exact_groups(docs, id_col, text_col, keep).where("kept").select(
        F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_own"), F.sha2(ascii_lower(whole_text(text_col)), 256).alias("_text")
    )
    return rows.join(groups, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_sha")), "left_semi").select("_row.*")
