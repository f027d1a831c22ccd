"""Registered queries: vector and keyword search, merging, metadata."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitewarden.functions import stemming
from sitewarden.operators import postings, tags, vector_index
from sitewarden.operators import retrieval as r
from sitewarden.plans import roles
from sitewarden.plans.registry import query
from sitewarden.session import scratch_folder
from sitewarden.sources import tables

_COSINE = """SELECT q.query_id, c.row_id, round(list_dot_product(c.embedding, q.embedding)
/ (sqrt(list_dot_product(c.embedding, c.embedding)) * sqrt(list_dot_product(q.embedding, q.embedding))), 12) AS score
FROM {chunks} c, queries q"""
_TOP = """SELECT query_id, row_id, round(score, 6) AS score, rank FROM (
SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM pairs {where}) t WHERE rank <= {k}"""
_THRESHOLD = 0.15


def _shown(hits):
    return hits.select("query_id", "row_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "vector_search",
    roles.sql(
        _TOP.format(where=f"WHERE score >= {_THRESHOLD}::DOUBLE", k=5),
        "chunks",
        "queries",
        "allowed",
        pairs=_COSINE.format(chunks="(SELECT * FROM chunks WHERE doc_id IN (SELECT doc_id FROM allowed))"),
    ),
)
def vector_search(t):
    return _shown(r.vector_search(roles.chunks(t), roles.queries(t), 5, _THRESHOLD, roles.allowed(t)))


@query("vector_search_all", roles.sql(_TOP.format(where="", k=10), "chunks", "queries", pairs=_COSINE.format(chunks="chunks")))
def vector_search_all(t):
    return _shown(r.vector_search(roles.chunks(t), roles.queries(t), 10, None))


@query(
    "vector_section",
    roles.sql(
        _TOP.format(where="", k=10),
        "chunks",
        "queries",
        pairs=_COSINE.format(chunks="(SELECT * FROM chunks WHERE doc_id = '3')"),
    ),
)
def vector_section(t):
    sections = roles.chunks(t).withColumnRenamed("doc_id", "section_type")
    return _shown(r.vector_search_section(sections, roles.queries(t), "3"))


@query(
    "vector_section_indexed",
    roles.sql(
        _TOP.format(where="", k=10),
        "chunks",
        "queries",
        pairs=_COSINE.format(chunks="(SELECT * FROM chunks WHERE doc_id = '3')"),
    ),
)
def vector_section_indexed(t):
    """The same from a stored inverted-file index, which is exact without a limit on probes."""
    sections = roles.chunks(t).withColumnRenamed("doc_id", "section_type")
    index = vector_index.build_index(sections, scratch_folder(t.spark, "vectors"))
    return _shown(vector_index.search_index(index, roles.queries(t), 10, "3")[0])


# Every vector of the table is a query.
@query(
    "vector_search_grid",
    roles.sql(
        _TOP.format(where="", k=3),
        "chunks",
        queries="SELECT row_id AS query_id, embedding FROM chunks",
        pairs=_COSINE.format(chunks="chunks"),
    ),
)
def vector_search_grid(t):
    own = roles.chunks(t).select(F.col("row_id").alias("query_id"), "embedding")
    return _shown(r.vector_search(roles.chunks(t), own, 3, None))


_TOKENS = r"""SELECT row_id, unnest(words) AS term, generate_subscripts(words, 1) AS pos
FROM (SELECT row_id, regexp_extract_all(lower(chunk), '[\p{L}\p{N}]+') AS words FROM text_chunks) w"""
_OR_TERMS = r"""SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(array_to_string(CASE WHEN len(long) > 0 THEN long ELSE raw END, ' ')), '[\p{L}\p{N}]+')) AS term
FROM (SELECT query_id, raw, list_filter(raw, lambda w: length(w) > 2) AS long FROM (
SELECT query_id, list_filter(string_split_regex(query, '\s+'), lambda w: w <> '') AS raw FROM text_queries) s) l"""
_AND_TERMS = r"SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS term FROM text_queries"


@query(
    "keyword_or",
    roles.sql(
        _TOP.format(where="", k=3),
        "text_chunks",
        "text_queries",
        tokens=_TOKENS,
        terms=_OR_TERMS,
        counts="SELECT row_id, term, count(*) AS tf FROM tokens GROUP BY 1, 2",
        pairs="SELECT query_id, row_id, round(sum(tf)::DOUBLE * 0.1::DOUBLE, 6) AS score FROM counts JOIN terms USING (term) GROUP BY 1, 2",
    ),
)
def keyword_or(t):
    return _shown(r.keyword_or(roles.text_chunks(t), roles.text_queries(t), 3))


_KEYWORD_AND = dict(
    tokens=_TOKENS,
    terms=_AND_TERMS,
    needed="SELECT query_id, count(*) AS n FROM terms GROUP BY 1",
    full_rows="""SELECT query_id, row_id FROM (SELECT DISTINCT row_id, term FROM tokens) d JOIN terms USING (term)
GROUP BY 1, 2 HAVING count(*) = (SELECT n FROM needed x WHERE x.query_id = terms.query_id)""",
    hits="""SELECT f.query_id, f.row_id, k.term, k.pos, row_number() OVER (PARTITION BY f.query_id, f.row_id ORDER BY k.pos) AS seq
FROM full_rows f JOIN tokens k USING (row_id) JOIN terms q ON q.query_id = f.query_id AND q.term = k.term""",
    last_seen="""SELECT e.query_id, e.row_id, e.seq, e.pos, p.term, max(p.seq) AS p_seq, max(p.pos) AS p_pos
FROM hits e JOIN hits p ON p.query_id = e.query_id AND p.row_id = e.row_id AND p.seq <= e.seq GROUP BY 1, 2, 3, 4, 5""",
    windows="""SELECT query_id, row_id, seq, pos, min(p_seq) AS b_seq, min(p_pos) AS b_pos FROM last_seen GROUP BY 1, 2, 3, 4
HAVING count(*) = (SELECT n FROM needed x WHERE x.query_id = last_seen.query_id)""",
    minimal="SELECT query_id, row_id, b_seq, b_pos, min(seq) AS seq, min(pos) AS pos FROM windows GROUP BY 1, 2, 3, 4",
    pairs="SELECT query_id, row_id, round(sum(0.1::DOUBLE / (1 + (pos - b_pos) - (seq - b_seq))), 6) AS score FROM minimal GROUP BY 1, 2",
)


@query("keyword_and", roles.sql(_TOP.format(where="", k=10), "text_chunks", "text_queries", **_KEYWORD_AND))
def keyword_and(t):
    return _shown(r.keyword_and(roles.text_chunks(t), roles.text_queries(t), 10))


def _index(t, config=stemming.SIMPLE, stop=None):
    """A stored index of the texts, as a store would keep it beside them."""
    return postings.build_index(roles.text_chunks(t), scratch_folder(t.spark, "index"), config, stop)


@query(
    "keyword_or_indexed",
    roles.sql(
        _TOP.format(where="", k=3),
        "text_chunks",
        "text_queries",
        tokens=_TOKENS,
        terms=_OR_TERMS,
        counts="SELECT row_id, term, count(*) AS tf FROM tokens GROUP BY 1, 2",
        pairs="SELECT query_id, row_id, round(sum(tf)::DOUBLE * 0.1::DOUBLE, 6) AS score FROM counts JOIN terms USING (term) GROUP BY 1, 2",
    ),
)
def keyword_or_indexed(t):
    return _shown(postings.search_any(_index(t), roles.text_queries(t), 3)[0])


@query("keyword_and_indexed", roles.sql(_TOP.format(where="", k=10), "text_chunks", "text_queries", **_KEYWORD_AND))
def keyword_and_indexed(t):
    return _shown(postings.search_all(_index(t), roles.text_queries(t), 10)[0])


_STOP = ("the", "of", "and")


def _english_stems(words: str) -> dict[str, str]:
    """The English stemmer as a chain of views over the distinct words of a view; the last is ``stems`` (word, term)."""
    vowel, consonant = "[aeiouy]", "[^aeiouy]"
    short = f"({consonant}{vowel}[^aeiouywxY]|^{vowel}{consonant})$"
    listed = lambda text: ", ".join(f"'{w}'" for w in text.split())
    pairs = lambda rules: [r.split(":") for r in rules.split()]
    after = lambda start: f"length(regexp_extract(substr(w, {start} + 1), '^.*?{vowel}{consonant}'))"
    keep = "word, p1, p2"
    rest = "left(w, length(w) - length(e))"

    def ending(source: str, endings) -> str:
        return f"(SELECT *, {rest} AS rest FROM (SELECT *, regexp_extract(w, '({'|'.join(endings)})$', 1) AS e FROM {source}) x)"

    def replaced(source: str, rules, condition: str) -> str:
        value = "CASE e " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules) + " END"
        return f"SELECT {keep}, CASE WHEN e <> '' AND {condition} THEN rest || {value} ELSE w END AS w FROM {ending(source, [a for a, _ in rules])} y"

    prefix = f"length(regexp_extract(w, '^({'|'.join(stemming.EN_R1_PREFIX.split())})'))"
    whole = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs(stemming.EN_WHOLE))
    held = listed(stemming.EN_AFTER_1A)
    return {
        "st_y": f"SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '({vowel})y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT term AS word FROM {words}) d",
        "st_p1": f"SELECT *, CASE WHEN {prefix} > 0 THEN {prefix} WHEN {after(0)} = 0 THEN length(w) ELSE {after(0)} END AS p1 FROM st_y",
        "st_p2": f"SELECT {keep[:-4]}, CASE WHEN {after('p1')} = 0 THEN length(w) ELSE p1 + {after('p1')} END AS p2, w FROM st_p1",
        "st_1a": f"""SELECT {keep}, CASE WHEN e = 'sses' THEN rest || 'ss' WHEN e IN ('ied', 'ies') THEN rest || CASE WHEN length(w) > 4 THEN 'i' ELSE 'ie' END
WHEN e = 's' AND regexp_matches(w, '{vowel}.+s$') THEN rest ELSE w END AS w FROM {ending('st_p2', ['sses', 'ied', 'ies', 'us', 'ss', 's'])} y""",
        "st_cut": f"""SELECT {keep}, w, rest, e IN ('eed', 'eedly') AND length(rest) >= p1 AS doubled,
e IN ('ed', 'edly', 'ing', 'ingly') AND regexp_matches(rest, '{vowel}') AS cut FROM {ending('st_1a', ['eedly', 'eed', 'ingly', 'edly', 'ing', 'ed'])} y""",
        "st_1b": f"""SELECT {keep}, CASE WHEN w IN ({held}) THEN w WHEN doubled THEN rest || 'ee' WHEN NOT cut THEN w WHEN regexp_matches(rest, '(at|bl|iz)$') THEN rest || 'e'
WHEN regexp_matches(rest, '({'|'.join(stemming.EN_DOUBLES.split())})$') THEN left(rest, length(rest) - 1)
WHEN regexp_matches(rest, '{short}') AND length(rest) <= p1 THEN rest || 'e' ELSE rest END AS w FROM st_cut""",
        "st_1c": f"SELECT {keep}, CASE WHEN regexp_matches(w, '^.+{consonant}[yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM st_1b",
        "st_2": replaced("st_1c", pairs(stemming.EN_STEP_2),
                         "length(rest) >= p1 AND (e <> 'li' OR regexp_matches(rest, '[cdeghkmnrt]$')) AND (e <> 'ogi' OR rest LIKE '%l')"),
        "st_3": replaced("st_2", pairs(stemming.EN_STEP_3), "length(rest) >= CASE WHEN e = 'ative' THEN p2 ELSE p1 END"),
        "st_4": replaced("st_3", [(e, "") for e in stemming.EN_STEP_4.split()], "length(rest) >= p2 AND (e <> 'ion' OR regexp_matches(rest, '[st]$'))"),
        "st_5": f"""SELECT {keep}, CASE WHEN w LIKE '%e' AND (length(w) > p2 OR (length(w) > p1 AND NOT regexp_matches(left(w, length(w) - 1), '{short}')))
THEN left(w, length(w) - 1) WHEN w LIKE '%ll' AND length(w) > p2 THEN left(w, length(w) - 1) ELSE w END AS w FROM st_4""",
        "stems": f"""SELECT word, CASE WHEN NOT regexp_matches(word, '^[a-z]+$') OR length(word) <= 2 THEN word ELSE CASE word {whole}
ELSE CASE WHEN word IN ({held}) THEN word ELSE replace(w, 'Y', 'y') END END END AS term FROM st_5 WHERE word NOT IN ({listed(' '.join(_STOP))})""",
    }


@query(
    "keyword_and_stemmed",
    roles.sql(
        _TOP.format(where="", k=10),
        "text_chunks",
        "text_queries",
        raw_tokens=_TOKENS,
        raw_terms=_AND_TERMS,
        all_words="SELECT term FROM raw_tokens UNION SELECT term FROM raw_terms",
        **_english_stems("all_words"),
        **{
            **_KEYWORD_AND,
            "tokens": "SELECT row_id, s.term, pos FROM raw_tokens t JOIN stems s ON t.term = s.word",
            "terms": "SELECT DISTINCT query_id, s.term FROM raw_terms t JOIN stems s ON t.term = s.word",
        },
    ),
)
def keyword_and_stemmed(t):
    """The search configuration with stems; the sample has no Russian words, so its words of plain letters get English ones."""
    return _shown(postings.search_all(_index(t, stemming.RUSSIAN, _STOP), roles.text_queries(t), 10)[0])


@query(
    "whitelist",
    roles.sql("SELECT doc_id FROM allowed", "allowed"),
)
def whitelist(t):
    return r.whitelist(roles.allowed(t))


@query(
    "search_tags",
    roles.sql(
        """SELECT trim(tag) AS tag, min(pos) AS pos FROM (SELECT 1000000 + n_nationkey AS pos, concat(' ', n_name, ' ') AS tag FROM nation
UNION ALL SELECT l_orderkey * 10 + l_linenumber, concat(' ', p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 2000000 + p_partkey, CASE WHEN p_size % 3 = 0 THEN '  ' ELSE concat(p_type, ' ') END FROM part) x WHERE trim(tag) <> '' GROUP BY 1"""
    ),
)
def search_tags(t):
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    named = t.nation.select((F.lit(1000000) + F.col("n_nationkey")).cast("long").alias("pos"), spaced("n_name").alias("tag"))
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), spaced("p_brand").alias("tag")
    )
    blank = F.when(F.col("p_size") % 3 == 0, F.lit("  ")).otherwise(spaced("p_type"))
    parts = t.part.select((F.lit(2000000) + F.col("p_partkey")).alias("pos"), blank.alias("tag"))
    return r.search_tags(named.unionByName(lines).unionByName(parts))


_MERGE = """SELECT row_number() OVER (ORDER BY source, query_no, rank, row_id) AS place, row_id, source, score FROM (
SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY source, query_no, rank) AS k FROM both_lists) d WHERE k = 1
ORDER BY source, query_no, rank, row_id LIMIT 20"""
_EVENT_LISTS = dict(
    ranked="SELECT user_id AS row_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events",
)


def _ranked_events(t):
    order = Window.partitionBy("event_type").orderBy(F.col("value").desc(), "event_id")
    return t.events.select(
        F.col("user_id").alias("row_id"), "event_type", "value", F.row_number().over(order).cast("long").alias("rank")
    )


@query(
    "merge_hits",
    roles.sql(
        _MERGE,
        **_EVENT_LISTS,
        both_lists="""SELECT CASE WHEN event_type IN ('click', 'error') THEN 0 ELSE 1 END AS source, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'view' THEN 1 ELSE 2 END AS query_no,
row_id, rank, value AS score FROM ranked""",
    ),
)
def merge_hits(t):
    lists = _ranked_events(t).select(
        F.when(F.col("event_type").isin("click", "view"), F.lit(1)).otherwise(F.lit(2)).alias("query_no"),
        "event_type", "rank", "row_id", F.col("value").alias("score"),
    )
    keyword = F.col("event_type").isin("click", "error")
    merged = r.merge_hits(lists.where(keyword), lists.where(~keyword))
    return merged.withColumn("place", F.col("place").cast("long"))


@query(
    "rrf",
    roles.sql(
        """SELECT row_id AS key, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, arg_min(event_type, (event_type, rank)) AS payload
FROM ranked GROUP BY 1 ORDER BY round(sum((1.0::DOUBLE / (60 + rank))::DECIMAL(28, 18))::DOUBLE, 15) DESC, min((event_type, rank)) LIMIT 10""",
        **_EVENT_LISTS,
    ),
)
def rrf(t):
    lists = _ranked_events(t).select(
        F.col("event_type").alias("list_no"), (F.col("rank") - 1).alias("rank"), F.col("row_id").alias("key"),
        F.col("event_type").alias("payload"),
    )
    return r.rrf(lists).withColumn("score", F.round("score", 6))


_META = "SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END AS title, concat('/doc/', n_name) AS link, n_name AS act_types FROM nation WHERE n_regionkey <> 1"


@query(
    "with_metadata",
    roles.sql(
        "SELECT row_id, CASE WHEN title <> '' THEN title ELSE 'Без названия' END AS document, link, act_types FROM (SELECT row_id, doc_id FROM chunks) c LEFT JOIN meta m ON m.id = c.doc_id",
        "chunks",
        meta=_META,
    ),
)
def with_metadata(t):
    meta = t.nation.where("n_regionkey <> 1").selectExpr(
        "CAST(n_nationkey AS STRING) AS id", "CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END AS title",
        "concat('/doc/', n_name) AS link", "n_name AS act_types",
    )
    hits = roles.chunks(t).select("row_id", "doc_id", F.lit(0.5).alias("score"))
    return r.format_hits(r.with_metadata(hits, meta)).select("row_id", "document", "link", "act_types")


_NORM_META = "SELECT source AS id, concat('Source ', source) AS title, source AS link, min(lang) AS act_types FROM documents GROUP BY source"


@query(
    "report_norms",
    roles.sql(
        """SELECT m.place, m.row_id, t.title AS document, t.link, t.act_types, round_even(m.score, 3) AS similarity
FROM merged m JOIN norm_chunks c USING (row_id) LEFT JOIN meta t ON t.id = c.doc_id""",
        "act_lines",
        "queries",
        norm_chunks=roles.NORM_CHUNKS_SQL,
        norm_allowed=roles.NORM_ALLOWED_SQL,
        open_chunks="SELECT * FROM norm_chunks WHERE doc_id IN (SELECT doc_id FROM norm_allowed)",
        vector_pairs=_COSINE.format(chunks="open_chunks"),
        vector_hits=f"""SELECT * FROM (SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank
FROM vector_pairs WHERE score >= {_THRESHOLD}::DOUBLE) v WHERE rank <= 5""",
        panel="SELECT tag, row_number() OVER (ORDER BY n DESC, tag) AS query_id FROM (SELECT p_brand AS tag, count(*) AS n FROM act_lines GROUP BY 1) b QUALIFY query_id <= 15",
        asked=r"""SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(array_to_string(CASE WHEN len(long) > 0 THEN long ELSE raw END, ' ')), '[\p{L}\p{N}]+')) AS term
FROM (SELECT query_id, raw, list_filter(raw, lambda w: length(w) > 2) AS long FROM (SELECT query_id, list_filter(string_split_regex(tag, '\s+'), lambda w: w <> '') AS raw FROM panel) s) l""",
        tokens=r"SELECT row_id, unnest(regexp_extract_all(lower(chunk), '[\p{L}\p{N}]+')) AS term FROM open_chunks",
        word_pairs="SELECT query_id, row_id, round(count(*)::DOUBLE * 0.1::DOUBLE, 6) AS score FROM tokens JOIN asked USING (term) GROUP BY 1, 2",
        word_hits="SELECT * FROM (SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM word_pairs) w WHERE rank <= 3",
        both_lists="SELECT 0 AS source, query_id AS query_no, rank, row_id, score FROM word_hits UNION ALL SELECT 1, query_id, rank, row_id, score FROM vector_hits",
        merged=f"SELECT * FROM ({_MERGE}) g",
        meta=_NORM_META,
    ),
)
def report_norms(t):
    """Report retrieval end to end over one table of chunks: both searches within the whitelist, merge, metadata, display."""
    chunks, allow = roles.norm_chunks(t), roles.norm_allowed(t)
    vector = r.vector_search(chunks, roles.queries(t), 5, _THRESHOLD, allow)
    panel = tags.tag_panel(roles.tagged_acts(t), 15).where(F.col("field") == "violation_types")
    keyword = r.keyword_or(chunks, panel.select(F.col("rank").alias("query_id"), F.col("tag").alias("query")), 3, allow)
    merged = r.merge_hits(keyword.withColumnRenamed("query_id", "query_no"), vector.withColumnRenamed("query_id", "query_no"))
    meta = t.documents.groupBy("source").agg(F.min("lang").alias("act_types")).select(
        F.col("source").alias("id"), F.concat(F.lit("Source "), F.col("source")).alias("title"), F.col("source").alias("link"), "act_types",
    )
    shown = r.format_hits(r.with_metadata(merged.join(chunks.select("row_id", "doc_id"), "row_id"), meta))
    return shown.select(F.col("place").cast("long").alias("place"), "row_id", "document", "link", "act_types", "similarity")


@query(
    "keyword_or_allowed",
    roles.sql(
        _TOP.format(where="", k=3),
        "text_queries",
        norm_chunks=roles.NORM_CHUNKS_SQL,
        norm_allowed=roles.NORM_ALLOWED_SQL,
        text_chunks="SELECT * FROM norm_chunks WHERE doc_id IN (SELECT doc_id FROM norm_allowed)",
        tokens=_TOKENS,
        terms=_OR_TERMS,
        pairs="SELECT query_id, row_id, round(count(*)::DOUBLE * 0.1::DOUBLE, 6) AS score FROM tokens JOIN terms USING (term) WHERE term NOT IN ('the', 'of', 'and') GROUP BY 1, 2",
    ),
)
def keyword_or_allowed(t):
    """Within the whitelist and without stop words."""
    return _shown(r.keyword_or(roles.norm_chunks(t), roles.text_queries(t), 3, roles.norm_allowed(t), ["the", "of", "and"]))


@query("laws_by_language", "SELECT doc_id AS row_id, lang FROM documents WHERE lang = 'fr'")
def laws_by_language(t):
    """The language rule of the search: one table serves each language; French stands for Kazakh here."""
    by_rule = roles.text_chunks(t).withColumn("lang", F.when(F.col("lang") == "fr", F.lit("kz")).otherwise(F.lit("ru")))
    return tables.laws(by_rule, tables.KAZAKH).select("row_id", F.lit("fr").alias("lang"))
