"""One query per operator, each over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarden.llm import (
    byte_bpe,
    collocations,
    cross_polytope,
    decontamination,
    exact_dedup,
    language_id,
    lexical_search,
    packing,
    secret_scan,
    simhash_dedup,
    suffix_dedup,
    toxicity,
    warc,
)
from sitewarden.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register


@query("op7_exact_dedup", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"), keep="largest")


@query("op3_secret_scan")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Base spans, those the ownership count adds, and how many of the base spans look live or are copied widely."""
    scanned = secret_scan.scan_secrets(table(spark, folder, "documents"))
    of_kind = {k: F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long") for k, *_ in secret_scan.KINDS}
    base = F.filter("all", lambda s: s["kind"] != "owned")
    return scanned.select(
        "doc_id",
        *[n.alias(f"n_{k}") for k, n in of_kind.items()],
        F.sha2(secret_scan.span_list(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_list(F.col("all")).alias("spans"),
        F.size(F.filter(base, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(base, lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


@query("op1_pack")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_simhash")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash_dedup.fingerprint_hex().alias("fingerprint"), "component_id")


@query("op8_byte_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_warc")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archive_round_trip(table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """The chain first predicts poor quality, then toxicity from the words and that."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    categories = ["low_quality", "toxic"]
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    scored = toxicity.predict(docs, toxicity.fit(docs, marks, categories), categories)
    return scored.withColumn("toxic", F.col("p_toxic") >= 0.5)


@query("op4_cross_polytope")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return cross_polytope.search(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20).withColumnRenamed("id", "vec_id")


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = language_id.held_out()
    model = language_id.fit(docs.where(~out & F.col("doc_id").isNotNull()))
    return language_id.predict(docs, model).withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score")


@query("op10_suffix_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op13_decontaminate", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
     i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
     sized AS (SELECT item_id, w, least(len(w), 10) AS m FROM i WHERE len(w) > 0),
     starts AS (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM sized),
     windows AS (SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS g FROM starts),
     lengths AS (SELECT DISTINCT m FROM windows),
     places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, lengths WHERE len(w) >= m),
     grams AS (SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS g FROM places),
     hits AS (SELECT doc_id, p, m, item_id FROM grams JOIN windows USING (m, g)),
     words AS (SELECT DISTINCT doc_id, unnest(range(p, p + m)) AS at FROM hits),
     n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
     of_doc AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                       string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN of_doc USING (doc_id)
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@query("op11_collocations", rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     split AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[ \t]+') IF x <> ''] AS w FROM pieces),
     totals AS (SELECT lang, sum(len(w))::bigint AS n FROM split GROUP BY lang),
     starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
     grams AS (SELECT lang, w[i : i + k - 1] AS g FROM starts, range(1, 6) AS ks(k) WHERE i + k - 1 <= len(w)),
     f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100),
     parts AS (SELECT lang, f, g[2 :] AS inner_g FROM f WHERE len(g) > 2 UNION ALL SELECT lang, f, g[: len(g) - 1] FROM f WHERE len(g) > 2),
     longer AS (SELECT lang, inner_g, max(f) AS f FROM parts GROUP BY ALL),
     kept AS (SELECT f.lang, f.g, f.f AS a FROM f LEFT JOIN longer ON f.lang = longer.lang AND f.g = inner_g
              WHERE len(f.g) > 1 AND (longer.f IS NULL OR longer.f < f.f)),
     cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM kept),
     scored AS (SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, n, (1000::hugeint * c.a * n) // (x.f::hugeint * y.f) AS score
                FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[: k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 :]
                JOIN totals t ON t.lang = c.lang),
     best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
     named AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score::bigint AS score FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named QUALIFY rank <= 2000
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    phrases, _ = collocations.mine(table(spark, folder, "documents"))
    best = collocations.ranked(phrases)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query("op12_lexical", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
     sized AS (SELECT doc_id, w, len(w)::bigint AS n FROM d WHERE len(w) > 0),
     total AS (SELECT count(*) AS nn, sum(n)::bigint AS ll FROM sized),
     item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS t FROM benchmark),
     words AS (SELECT doc_id, n, unnest(w) AS t FROM sized),
     tf AS (SELECT doc_id, n, t, count(*) AS tf FROM words WHERE t IN (SELECT t FROM item) GROUP BY ALL),
     weight AS (SELECT t, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM tf, total GROUP BY t, nn),
     part AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll)))) AS c FROM tf JOIN weight USING (t), total),
     scored AS (SELECT item_id, doc_id, sum(c)::bigint AS score FROM item JOIN part USING (t) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::integer AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
