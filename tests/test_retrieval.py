"""Vector and keyword search, merging."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewarden.functions import stemming, vector
from sitewarden.operators import postings, vector_index
from sitewarden.operators import retrieval as r


def _vectors(spark, n, seed, name):
    rng = np.random.default_rng(seed)
    rows = [(i, str(i % 3), [float(x) for x in rng.normal(size=8)]) for i in range(n)]
    rows += [(n, "0", None), (n + 1, "0", [0.0] * 8), (n + 2, "1", rows[0][2]), (n + 3, "1", rows[0][2])]
    return spark.createDataFrame(rows, f"{name} long, doc_id string, embedding array<float>")


def _rows(df):
    return sorted((x["query_id"], x["rank"], x["row_id"], round(x["score"], 6)) for x in df.collect())


@pytest.mark.parametrize("chunk_block, query_block, most", [(20_000, 512, 1000), (50, 4, 0), (50, 4, 1000)])
def test_search_equals_brute_force(spark, monkeypatch, chunk_block, query_block, most):
    monkeypatch.setattr(r, "_CHUNKS_PER_BLOCK", chunk_block)
    monkeypatch.setattr(r, "_QUERIES_PER_BLOCK", query_block)
    chunks, queries = _vectors(spark, 200, 1, "row_id").repartition(5), _vectors(spark, 10, 1, "query_id").drop("doc_id")
    by = lambda df, c: {x[c]: np.array(x["embedding"], dtype=np.float64) for x in df.collect() if x["embedding"] and any(x["embedding"])}
    expected = []
    for q, v in by(queries, "query_id").items():
        scored = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), i) for i, w in by(chunks, "row_id").items()]
        expected += [(q, k + 1, i, round(-s, 6)) for k, (s, i) in enumerate(sorted(x for x in scored if -x[0] >= 0.2)[:4])]
    assert _rows(r.vector_search(chunks, queries, 4, 0.2, most_numbers=most)) == sorted(expected)


def test_score_matrices_are_bounded(monkeypatch):
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(7, 5)), rng.normal(size=(301, 5))
    x[50:60] = x[3]
    whole = vector.top_k(np.arange(7), q, np.arange(301), x, 6, None)
    sizes, real = [], np.round
    monkeypatch.setattr(vector.np, "round", lambda m, n: sizes.append(m.size) or real(m, n))
    parts = vector.top_k(np.arange(7), q, np.arange(301), x, 6, None, values=100)
    assert max(sizes) <= 100 and len(sizes) > 10
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert vector.block_rows(512) * 512 <= vector.BLOCK_VALUES


def test_whitelist_blank_ids_and_empty_inputs(spark):
    chunks, queries = _vectors(spark, 20, 2, "row_id"), _vectors(spark, 3, 3, "query_id").drop("doc_id")
    allow = spark.createDataFrame([("1",), ("",), (None,)], "doc_id string")
    hits = r.vector_search(chunks, queries, 50, None, allow)
    assert {x["row_id"] % 3 for x in hits.where("row_id < 20").collect()} == {1}
    assert r.vector_search(chunks, queries.where("false")).count() == 0
    assert r.vector_search(chunks, queries, allow=allow.where("false")).count() == 0


def test_vectors_of_different_length_are_an_error(spark):
    chunks = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "row_id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        r.vector_search(chunks, chunks.select(F.col("row_id").alias("query_id"), "embedding").limit(1)).collect()


def _texts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id int, chunk string")


def _asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


@pytest.mark.parametrize("most", [100, 0])
def test_or_search_counts_occurrences_of_longer_words(spark, most):
    texts = _texts(spark, "Статья 12. Кодекс, кодекс!", "о статья", "ничего", "аб вг де жз")
    hits = r.keyword_or(texts, _asked(spark, "статья о кодекс", "аб вг де жз", "  "), k=5, most_terms=most)
    assert _rows(hits) == [(0, 1, 0, 0.3), (0, 2, 1, 0.1), (1, 1, 3, 0.4)]
    assert _rows(r.keyword_or(texts, _asked(spark, "статья кодекс"), 5, None, ["статья"])) == [(0, 1, 0, 0.2)]


def _cover_density(tokens, terms):
    """All windows by definition: minimal ones hold every term and no smaller window inside does."""
    at = [i for i, t in enumerate(tokens) if t in terms]
    full = [(p, q) for p in at for q in at if p <= q and set(terms) <= set(tokens[p : q + 1])]
    minimal = [(p, q) for p, q in full if not any((a, b) != (p, q) and p <= a and b <= q for a, b in full)]
    return sum(0.1 / (1 + (q - p) - (sum(p <= i <= q for i in at) - 1)) for p, q in minimal)


@pytest.mark.parametrize("most", [100, 0])
def test_and_search_ranks_by_cover_density(spark, most):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdxyz"), size=30)) for _ in range(40)] + ["a b", "a", ""]
    hits = r.keyword_and(_texts(spark, *texts), _asked(spark, "a b c", "B a", "", "d"), k=100, most_terms=most)
    expected = []
    for q, terms in ((0, "abc"), (1, "ab"), (3, "d")):
        found = [(-round(_cover_density(t.split(), set(terms)), 6), i) for i, t in enumerate(texts) if set(terms) <= set(t.split())]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(found))]
    assert _rows(hits) == sorted(expected)


def test_rrf(spark):
    rows = [(0, 0, "a", "A0"), (0, 1, "b", "B0"), (1, 0, "b", "B1"), (1, 1, "c", "C1"), (1, 2, "a", "A1")]
    lists = spark.createDataFrame(rows, "list_no int, rank int, key string, payload string")
    got = [(x["key"], x["payload"], round(x["score"], 9)) for x in r.rrf(lists, n=2).collect()]
    assert got == [("b", "B0", round(1 / 62 + 1 / 61, 9)), ("a", "A0", round(1 / 61 + 1 / 63, 9))]
    assert [x["key"] for x in r.rrf(lists.orderBy(F.col("rank").desc())).collect()] == ["b", "a", "c"]


def test_merge_keeps_first_occurrence_keywords_first(spark):
    shape = "query_no int, rank int, row_id int, score double"
    keyword = spark.createDataFrame([(2, 1, 5, 0.1), (1, 2, 6, 0.2)], shape)
    vector = spark.createDataFrame([(1, 1, 5, 0.9), (1, 2, 7, 0.8)], shape)
    got = [(x["place"], x["row_id"], x["source"], x["score"]) for x in r.merge_hits(keyword, vector).collect()]
    assert got == [(1, 6, 0, 0.2), (2, 5, 0, 0.1), (3, 7, 1, 0.8)]
    assert r.merge_hits(keyword, vector, 1).count() == 1


def test_tags_and_display(spark):
    tags = spark.createDataFrame([(0, " b"), (1, ""), (2, "a"), (3, "b "), (4, None)], "pos int, tag string")
    assert sorted((x["pos"], x["tag"]) for x in r.search_tags(tags).collect()) == [(0, "b"), (2, "a")]
    hits = spark.createDataFrame([(1, "d", None, 0.12355), (2, "d", "T", 0.5)], "row_id int, doc_id string, title string, score double")
    assert [(x["document"], x["similarity"]) for x in r.format_hits(hits).orderBy("row_id").collect()] == [(r.UNTITLED, round(0.12355, 3)), ("T", 0.5)]


WORDS = {
    "russian": "вагонов:вагон важнейшими:важн важничал:важнича важность:важност валандался:валанда павлиньим:павлин падаль:падал падая:пад ёлка:елк данные:дан в:в",
    "english": "consistency:consist consolatory:consolatori knackeries:knackeri generously:generous skies:sky ties:tie gas:gas running:run hoping:hope "
    "happy:happi enjoy:enjoy communism:communism agreed:agre feed:feed ability:abil national:nation adoption:adopt rate:rate controlling:control early:earli",
}


@pytest.mark.parametrize("language", WORDS)
def test_published_stems(spark, language):
    pairs = [tuple(x.split(":")) for x in WORDS[language].split()]
    stem = {"russian": stemming.stem_russian, "english": stemming.stem_english}[language]
    got = spark.createDataFrame(pairs, "word string, stem string").select("word", stem(F.col("word")).alias("stem")).collect()
    assert [tuple(x) for x in got] == pairs


def test_search_terms(spark):
    words = spark.createDataFrame([("the",), ("и",), ("законов",), ("laws",), ("a1s",), ("données",), ("кодекс",)], "w string")
    got = [x["t"] for x in words.select(stemming.search_term(F.col("w")).alias("t")).collect()]
    assert got == [None, None, "закон", "law", "a1s", "données", "кодекс"]
    got = [x["t"] for x in words.select(stemming.search_term(F.col("w"), "simple", ["laws"]).alias("t")).collect()]
    assert got == ["the", "и", "законов", None, "a1s", "données", "кодекс"]


def test_index_gives_what_the_scan_gives(spark, tmp_path):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["aaa", "bbb", "ccc", "ddd", "rare", "и", "zz"], p=[0.3, 0.2, 0.2, 0.1, 0.01, 0.1, 0.09], size=int(rng.integers(0, 40)))) for _ in range(300)]
    rows = [(i * 3, str(i % 4), t) for i, t in enumerate(texts)] + [(2000, "1", None), (2001, None, "aaa aaa bbb")]
    chunks = spark.createDataFrame(rows, "row_id long, doc_id string, chunk string").repartition(3)
    queries = _asked(spark, "aaa bbb", "rare", "ccc ddd rare", "zz", "", "nowhere aaa")
    allow = spark.createDataFrame([("1",), ("2",)], "doc_id string")
    index = postings.build_index(chunks, f"{tmp_path}/index", span=32)
    for which in (None, allow):
        assert _rows(postings.search_any(index, queries, 4, which)[0]) == _rows(r.keyword_or(chunks, queries, 4, which))
        assert _rows(postings.search_all(index, queries, 4, which)[0]) == _rows(r.keyword_and(chunks, queries, 4, which))


def test_index_skips_windows_that_cannot_reach_the_best(spark, tmp_path):
    rows = [(i, "d", "word " * (50 if i == 700 or i == 701 else 1 + i % 3)) for i in range(1000)]
    chunks = spark.createDataFrame(rows, "row_id long, doc_id string, chunk string")
    index = postings.build_index(chunks, f"{tmp_path}/index", span=10)
    hits, windows = postings.search_any(index, _asked(spark, "word"), 2)
    assert [x["row_id"] for x in hits.orderBy("rank").collect()] == [700, 701]
    assert windows.count() == 100 and windows.where("read").count() == 2


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_index_moves_blocks_and_no_single_occurrences(spark, tmp_path):
    rows = [(i, "d", "common " * (1 + i % 3) + ("rare other" if i % 50 == 0 else "other")) for i in range(400)]
    chunks = spark.createDataFrame(rows, "row_id long, doc_id string, chunk string")
    index = postings.build_index(chunks, f"{tmp_path}/index", span=2)
    queries = _asked(spark, "common rare", "other", "other common")
    for search, scan in ((postings.search_any, r.keyword_or), (postings.search_all, r.keyword_and)):
        hits, _ = search(index, queries, 3)
        assert "FlatMapCoGroupsInArrow" in _plan(hits) and "arrays_zip" not in _plan(hits)
        assert _rows(hits) == _rows(scan(chunks, queries, 3))


def test_index_of_very_long_texts_and_equal_ids(spark, tmp_path):
    rows = [(i, "d", "aa bb " * 1_100_000 + f"end{i}") for i in range(3)] + [(7, "d", "aa cc"), (7, "d", "cc aa aa")]
    chunks = spark.createDataFrame(rows, "row_id long, doc_id string, chunk string")
    index = postings.build_index(chunks, f"{tmp_path}/index")
    blocks = {x["term"]: x for x in index.blocks(spark).select("term", "window", "most", "at", "tf", F.size("positions").alias("n")).collect()}
    assert blocks["aa"][1:] == (0, 1_100_000, [0, 1, 2, 7], [1_100_000] * 3 + [3], 3_300_003)
    assert blocks["bb"]["at"] == [0, 1, 2] and blocks["cc"]["tf"] == [2] and index.blocks(spark).count() == 6
    hits, _ = postings.search_any(index, _asked(spark, "cc", "aa"), 2)
    assert [tuple(x)[1:3] for x in hits.orderBy("query_id", "rank").collect()] == [(7, 0.2), (0, 110000.0), (1, 110000.0)]


def test_inflected_words_match(spark, tmp_path):
    texts = _texts(spark, "Нарушения трудового законодательства", "трудовое нарушение", "закон", "Laws and the running")
    texts = texts.select(F.col("row_id").cast("long").alias("row_id"), F.lit("d").alias("doc_id"), "chunk")
    index = postings.build_index(texts, f"{tmp_path}/index", stemming.RUSSIAN)
    hits, _ = postings.search_all(index, _asked(spark, "нарушением трудовым", "и законы", "the law runs", "и"), 5)
    assert [(x[0], x[2]) for x in _rows(hits)] == [(0, 0), (0, 1), (1, 2), (2, 3)]


def test_words_are_stemmed_after_they_are_made_distinct(spark):
    found = spark.range(50).select(F.concat(F.lit("law"), F.when(F.col("id") % 2 == 0, "s").otherwise("")).alias("word"))
    terms = postings._terms_of(found, stemming.RUSSIAN, ["the"])
    plan = terms._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan[plan.index("Aggregate") :]
    assert sorted(tuple(x) for x in terms.collect()) == [("law", "law"), ("laws", "law")]


def test_empty_index(spark, tmp_path):
    nothing = spark.createDataFrame([], "row_id long, doc_id string, chunk string")
    index = postings.build_index(nothing, f"{tmp_path}/index")
    assert postings.search_any(index, _asked(spark, "word"), 5)[0].count() == 0


def _clustered(spark, n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 12))
    points = centres[rng.integers(0, 30, n)] + 0.15 * rng.normal(size=(n, 12))
    rows = [(i, str(i % 3), [float(x) for x in p]) for i, p in enumerate(points)] + [(n, "0", None), (n + 1, "1", [0.0] * 12), (n + 2, "1", [float(x) for x in points[0]])]
    queries = [(i, [float(x) for x in centres[i] + 0.2 * rng.normal(size=12)]) for i in range(15)] + [(15, None), (16, [0.0] * 12)]
    return (spark.createDataFrame(rows, "row_id long, section_type string, embedding array<float>").repartition(4),
            spark.createDataFrame(queries, "query_id int, embedding array<float>"))


def test_inverted_file_is_exact_and_reads_little(spark, tmp_path):
    chunks, queries = _clustered(spark, 3000, 1)
    index = vector_index.build_index(chunks, f"{tmp_path}/index", lists=60)
    hits, share = vector_index.search_index(index, queries, 7)
    assert _rows(hits) == _rows(r.vector_search(chunks, queries, 7, None))
    assert share < 0.2
    again = vector_index.VectorIndex.load(spark, f"{tmp_path}/index")
    hits, _ = vector_index.search_index(again, queries, 5, "1", most_numbers=40)
    assert _rows(hits) == _rows(r.vector_search_section(chunks, queries, "1", 5))


def test_probes_trade_recall_for_reading(spark, tmp_path):
    chunks, queries = _clustered(spark, 3000, 2)
    index = vector_index.build_index(chunks, f"{tmp_path}/index", lists=60)
    exact = {x[:1] + x[2:3] for x in _rows(r.vector_search(chunks, queries, 10, None))}
    recall, shares = [], []
    for probes in (1, 3, 60):
        hits, share = vector_index.search_index(index, queries, 10, probes=probes)
        recall.append(len(exact & {x[:1] + x[2:3] for x in _rows(hits)}) / len(exact))
        shares.append(share)
    assert recall[0] <= recall[1] <= recall[2] == 1.0 and recall[1] > 0.9 and shares[1] < 0.2


def test_empty_vector_index(spark, tmp_path):
    chunks, queries = _clustered(spark, 10, 3)
    index = vector_index.build_index(chunks.where("false"), f"{tmp_path}/index")
    assert vector_index.search_index(index, queries)[0].count() == 0
    full = vector_index.build_index(chunks, f"{tmp_path}/full")
    assert vector_index.search_index(full, queries.where("false"))[0].count() == 0
    assert vector_index.search_index(full, queries, 50)[0].count() == 15 * 11


def test_a_chunk_meets_many_queries_at_once(spark):
    """1 200 queries are three blocks to score, but a chunk is shuffled once for all of them."""
    rows = spark.range(1200).select(F.col("id").alias("row_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    left, right = r._blocks(rows, rows.withColumnRenamed("row_id", "query_id"))
    assert (left.count(), right.count()) == (1200, 1200)
    kept = r.vector_search(rows.limit(40), rows.withColumnRenamed("row_id", "query_id"), 2, None, most_numbers=1)
    alone = r.vector_search(rows.limit(40), rows.withColumnRenamed("row_id", "query_id"), 2, None)
    pairs = lambda df: sorted((x.query_id, x.row_id, x.score) for x in df.collect())
    assert pairs(kept) == pairs(alone)
