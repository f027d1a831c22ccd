"""Snapshot tables, deep pages, versions at points, hierarchies by parent, stored summary states, pruning by years."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sitewarden import schemas as S
from sitewarden.operators import lookups, summary, temporal
from sitewarden.operators import upsert as u
from sitewarden.sources.snapshots import SnapshotTable

DAY = datetime.date(2024, 1, 1)


@pytest.fixture
def now(spark):
    return F.lit("2024-05-05 00:00:00").cast("timestamp_ntz")


def _incidents(spark, rows):
    return spark.createDataFrame(rows, "id string, incident_date date, company string, classification string, region string, location string, victim_name string")


def _row(i, year=2024, name="A", where="x"):
    return (str(i), datetime.date(year, 1, 1 + i % 28), "АО А", "К", "Алматы", where, name)


def test_append_may_be_repeated_and_a_half_batch_is_invisible(spark, tmp_path, now):
    table = SnapshotTable(spark, str(tmp_path / "t"), S.INCIDENT)
    assert table.read().count() == 0
    assert table.append(_incidents(spark, [_row(1), _row(2, 2020)]), "b1", now)
    assert not table.append(_incidents(spark, [_row(1), _row(2, 2020)]), "b1", now)

    def ends_early(*_):
        raise RuntimeError("the job ends here")

    broken = SnapshotTable(spark, str(tmp_path / "t"), S.INCIDENT)
    broken._commit = ends_early
    with pytest.raises(RuntimeError):
        broken.append(_incidents(spark, [_row(3)]), "b2", now)
    assert sorted(r.id for r in table.read().collect()) == ["1", "2"]
    assert table.append(_incidents(spark, [_row(3)]), "b2", now)
    assert sorted(r.id for r in table.read().collect()) == ["1", "2", "3"]
    assert [r.id for r in table.read([2020]).collect()] == ["2"] and len(table.read([2020]).inputFiles()) == 1


def test_two_writers_cannot_take_one_number(spark, tmp_path, now):
    table = SnapshotTable(spark, str(tmp_path / "t"), S.INCIDENT)
    stale = table.manifest()
    table.append(_incidents(spark, [_row(1)]), "b1", now)
    with pytest.raises(RuntimeError, match="another batch"):
        table._commit(stale, "b2", {})


def test_merge_replaces_touched_years_at_once(spark, tmp_path, now):
    table = SnapshotTable(spark, str(tmp_path / "t"), S.INCIDENT)
    table.append(_incidents(spark, [_row(1), _row(2, 2020), _row(3, 2010)]), "b0", now)
    incoming = _incidents(spark, [("n1", *_row(1)[1:]), ("n2", *_row(5)[1:]), ("n3", *_row(2, 2020, "B")[1:])]).withColumns({"file_seq": F.lit(0), "row_no": F.col("id").substr(2, 1).cast("int")})
    classified = u.classify_upsert(incoming, table.read())
    before = table.manifest()
    assert table.merge(classified, "b1", now) and not table.merge(classified, "b1", now)
    assert sorted(r.id for r in table.read().collect()) == ["1", "2", "3", "n2", "n3"]
    after = table.manifest()
    assert after.folders["2010"] == before.folders["2010"] and after.folders["2024"] != before.folders["2024"]


@pytest.mark.parametrize("offset", [0, 40, 399, 450, 1480, 1990, 2140, 2240, 2300])
def test_deep_pages_join_up(spark, offset):
    rng = random.Random(1)
    days = [DAY + datetime.timedelta(rng.randrange(300)) for _ in range(1000)] + [DAY + datetime.timedelta(100)] * 1000 + [None] * 250
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id long, incident_date date").repartition(4)
    full = [r.id for r in df.orderBy(F.col("incident_date").desc_nulls_last(), "id").collect()]
    assert [r.id for r in lookups.page(df, limit=60, offset=offset, shallow=50).collect()] == full[offset : offset + 60]
    if 0 < offset < len(full):
        last = df.where(F.col("id") == full[offset - 1]).first()
        assert [r.id for r in lookups.page_after(df, last.incident_date, last.id, limit=60).collect()] == full[offset : offset + 60]


def test_deep_page_sorts_only_what_is_near(spark):
    df = spark.range(20_000).select("id", F.date_add(F.lit(DAY), (F.col("id") % 1000).cast("int")).alias("incident_date"))
    rows, offset = lookups._narrowed(df, "incident_date", "id", 50, 15_000, 1000)
    assert rows.count() <= 1500 and offset < 1000


@pytest.mark.parametrize("per_range", [1, 8, 512])
def test_versions_at_points(spark, per_range):
    rng = random.Random(2)
    day = lambda n: DAY + datetime.timedelta(n)
    versions = []
    for i in range(300):
        start = rng.randrange(200)
        versions.append((i, rng.choice(["hot", "hot", "cold"]), rng.choice(["ru", "kz"]), day(start), None if rng.random() < 0.1 else day(start + rng.randrange(30)), rng.choice(["active"] * 5 + ["repealed"])))
    points = [(i, rng.choice(["hot", "cold", "none"]), rng.choice(["ru", "kz"]), day(rng.randrange(-10, 260)) if rng.random() < 0.95 else None) for i in range(400)]
    v = spark.createDataFrame(versions, "version_id int, norm_id string, language string, effective_from date, effective_to date, status string")
    p = spark.createDataFrame(points, "point int, norm_id string, language string, day date")
    got = temporal.version_at(v, p, per_range).select("point", "version_id").collect()
    want = [(a, x[0]) for a, n, la, d in points for x in versions if d and (x[1], x[2]) == (n, la) and x[5] == "active" and x[3] <= d and (x[4] is None or x[4] > d)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_hot_norm_is_spread(spark):
    n = 20_000
    v = spark.range(n).select(F.col("id").alias("version_id"), F.lit("hot").alias("norm_id"), F.lit("ru").alias("language"), F.lit("active").alias("status"),
                              F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("effective_from"), F.date_add(F.lit(DAY), (F.col("id") + 1).cast("int")).alias("effective_to"))
    p = spark.range(n).select(F.col("id").alias("point"), F.lit("hot").alias("norm_id"), F.lit("ru").alias("language"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("day"))
    found = temporal.version_at(v, p)
    assert found.count() == n and found.where("version_id <> point").count() == 0


def test_ancestors_from_parents_with_rings_and_orphans(spark):
    rng = random.Random(3)
    parent = {i: rng.randrange(i) if i and rng.random() < 0.95 else None for i in range(120)}
    parent |= {200 + i: 200 + i - 1 if i else None for i in range(70)}  # a long chain
    parent |= {300: 302, 301: 300, 302: 301, 303: 301, 304: 303, 305: 305, 306: 305}  # rings with norms below them
    parent |= {400: 999, 401: 400}  # an orphan
    df = spark.createDataFrame(list(parent.items()), "id int, parent_id int")
    assert sorted(r.id for r in temporal.rings(df).collect()) == [300, 301, 302, 305]
    want = []
    for i in parent:
        at, steps = i, 0
        while at not in (300, 301, 302, 305) and parent[at] in parent:
            at, steps = parent[at], steps + 1
            want.append((i, at, steps))
    assert sorted(tuple(r) for r in temporal.ancestors_by_parent(df).select("id", "ancestor_id", "distance").collect()) == sorted(want)


def test_stored_states_follow_an_import(spark, tmp_path):
    shape = "incident_date date, victim_name string, injury_type string, classification string, region string, company string"
    rng = random.Random(4)
    row = lambda year: (year and datetime.date(year, rng.randint(1, 12), 3), rng.choice(["A", "B", None]), rng.choice([S.INJURY_FATAL, "x", None]), "c", rng.choice(["r", ""]), "o")
    old = [row(rng.choice([2020, 2021, 2022, None])) for _ in range(60)]
    new = old + [row(rng.choice([2022, None])) for _ in range(20)]
    frame = lambda rows: spark.createDataFrame(rows, shape)
    shown = lambda df: sorted((r.dimension, r.key, r.n) for r in df.collect())
    path = str(tmp_path / "states")
    summary.refresh_states(frame(old), path)
    assert shown(summary.summary_of_states(spark, path)) == shown(summary.summary(frame(old)))
    kept = [p for p in (tmp_path / "states" / "_year=2020").iterdir()]
    summary.refresh_states(frame(new), path, [2022, 0])
    assert shown(summary.summary_of_states(spark, path)) == shown(summary.summary(frame(new)))
    assert [p for p in (tmp_path / "states" / "_year=2020").iterdir()] == kept


def test_two_far_years_read_two_folders(spark, tmp_path, now):
    rows = _incidents(spark, [_row(i, 2000 + i) for i in range(20)]).withColumn("created_at", now)
    rows.withColumn("year", F.year("incident_date")).write.partitionBy("year").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    kept = u.prune_existing(stored, _incidents(spark, [_row(1, 2001), _row(2, 2017), ("x", None, *_row(1)[2:])]))
    assert sorted(r.id for r in kept.collect()) == ["1", "17"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan.split("PartitionFilters")[1].split("]")[0]
    assert u.prune_existing(stored, _incidents(spark, [])).count() == 0
