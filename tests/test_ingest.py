"""Journal scan to quarantine, files, act records, store merges and arrivals."""

import csv
import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from sitewarden import schemas as S
from sitewarden.operators import upsert as u
from sitewarden.sources import acts as a
from sitewarden.sources import journal as j
from sitewarden.sources import manifest as mf
from sitewarden.sources import tables

NAMES = ["incident_date", "company", "classification", "region", "location", "investigation_status", "victim_name", "injury_type", "damage_amount_kzt"]
HEADER = [j.HEADERS.get(n) or "Сумма ущерба, тенге" for n in NAMES]
GOOD = ["2024-01-15", S.COMPANIES[0], S.CLASSIFICATIONS[0], "Алматы", "Цех", "Завершено", "Иванов", S.INJURY_FATAL, "10.5"]


def changed(**cells):
    return [cells.get(n, v) for n, v in zip(NAMES, GOOD)]


def frame(spark, files):
    rows = [(f, i, cells) for f, sheet in files.items() for i, cells in enumerate(sheet)]
    return spark.createDataFrame(rows, "file string, row_no int, cells array<string>")


def test_header_on_row_four_with_line_break_and_errors(spark):
    odd = [HEADER[0].upper().replace(" ", "\n", 1), *HEADER[1:]]
    sheet = [
        ["Журнал"], [None], HEADER[:3], odd,
        GOOD,
        changed(company="  ао   «казахтелеком» ", incident_date="15.01.2024"),
        changed(incident_date=None),
        changed(company=""),
        changed(company="Нет такой"),
        changed(location=" "),
        changed(incident_date="-"),
        changed(region="-"),
        changed(damage_amount_kzt="много", injury_type="-", victim_name="N/A"),
    ]
    good, errors, rejected = j.parse_journal(frame(spark, {"f": sheet}))
    rows = {r["row_no"]: r for r in good.collect()}
    assert sorted(rows) == [5, 6, 13]
    assert rows[5]["incident_date"] == datetime.date(2024, 1, 15) and rows[5]["damage_amount_kzt"] == 10.5
    assert (rows[5]["victim_count"], rows[5]["fatality_count"]) == (1, 1)
    assert rows[5]["description"] == j.NO_DESCRIPTION
    assert rows[6]["company"] == S.COMPANIES[0] and rows[6]["incident_date"] == datetime.date(2024, 1, 15)
    assert rows[13]["damage_amount_kzt"] is None and rows[13]["victim_name"] is None and rows[13]["fatality_count"] == 0
    messages = {r["row_no"]: r["message"] for r in errors.collect()}
    assert sorted(messages) == [9, 10, 11, 12]
    assert messages[9] == "Row 9: Некорректное значение для company: 'Нет такой'"
    assert messages[10] == "Row 10: missing required fields after parsing"
    assert rejected.count() == 0


def test_files_without_header_or_column_are_rejected(spark):
    files = {"none": [["x", "y"], GOOD], "short": [HEADER[:4] + HEADER[5:], GOOD], "ok": [HEADER, GOOD]}
    good, _, rejected = j.parse_journal(frame(spark, files))
    assert {r["file"] for r in good.collect()} == {"ok"}
    reasons = {r["file"]: r["reason"] for r in rejected.collect()}
    assert set(reasons) == {"none", "short"} and HEADER[4] in reasons["short"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-05", "2024-01-05"), ("2024-1-5 10:00:00", "2024-01-05"), ("05.03.2024", "2024-05-03"),
        ("15.03.2024", "2024-03-15"), ("03/15/2024", "2024-03-15"), ("soon", None), ("2024-13-01", None),
    ],
)
def test_parse_date(spark, text, expected):
    assert spark.range(1).select(j.parse_date(F.lit(text)).cast("string")).first()[0] == expected


@pytest.mark.parametrize("text, expected", [("14:30", "14:30:00"), ("7:05:09", "07:05:09"), ("2024-01-05 08:10:00", "08:10:00"), ("25:00", None), ("2024-01-05", "00:00:00")])
def test_parse_time(spark, text, expected):
    assert spark.range(1).select(j.parse_time(F.lit(text))).first()[0] == expected


def test_formats_read_alike(spark, tmp_path):
    for kind in ("json", "csv"):
        (tmp_path / kind).mkdir()
    lines = [{"row_no": i, "cells": c} for i, c in enumerate([HEADER, GOOD])]
    (tmp_path / "json" / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    (tmp_path / "csv" / "a.csv").write_text("\r\n".join(";".join(c) for c in [HEADER, GOOD]))
    for kind in ("json", "csv"):
        good, _, rejected = j.parse_journal(j.read_journal(spark, str(tmp_path / kind), kind, ";"))
        rows = [(r["row_no"], r["incident_date"], r["company"], r["damage_amount_kzt"]) for r in good.collect()]
        assert rows == [(2, datetime.date(2024, 1, 15), S.COMPANIES[0], 10.5)], kind
        assert rejected.count() == 0
    with pytest.raises(ValueError):
        j.read_journal(spark, "x", "pdf")


def test_csv_lines_keep_width_quotes_and_numbers(spark, tmp_path):
    wide = [str(i) for i in range(100)]
    lines = [",".join(wide), "", 'a,"b, ""c""",,d', ",x", '"",""'] + [f"r{i},y" for i in range(5, 300)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    (tmp_path / "b.csv").write_text("one\ntwo")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = {(r["file"][-5:], r["row_no"]): r["cells"] for r in j.read_journal(spark, str(tmp_path), "csv").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows["a.csv", 0] == wide and ("a.csv", 1) not in rows
    assert rows["a.csv", 2] == ["a", 'b, "c"', None, "d"] and rows["a.csv", 3] == [None, "x"] and rows["a.csv", 4] == ["", ""]
    assert all(rows["a.csv", i] == [f"r{i}", "y"] for i in range(5, 300)) and len(rows) == 301
    assert rows["b.csv", 1] == ["two"]


def _cells_of(spark, folder, block=None, delimiter=","):
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        found = {}
        for r in j.read_journal(spark, str(folder), "csv", delimiter).collect():
            assert (r["file"][-5:], r["row_no"]) not in found
            found[r["file"][-5:], r["row_no"]] = r["cells"]
        return found
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("block", [None, 64, 700])
def test_csv_line_breaks_in_quoted_cells(spark, tmp_path, block):
    rng = random.Random(block or 1)
    cells = ["plain", "two\nlines", 'say "hi"', "a,b", "\n\n", '"', "x\r\ny", 'end "\n', "long " * 40 + "\n" + "tail " * 30, "ü,\n\"ß\""]
    for name in ("a.csv", "b.csv"):
        rows = [[rng.choice(cells) for _ in range(rng.randint(1, 4))] for _ in range(120)]
        with open(tmp_path / name, "w", newline="") as f:
            csv.writer(f, lineterminator="\r\n" if name == "b.csv" else "\n").writerows(rows)
        (tmp_path / name).with_suffix(".json").write_text(json.dumps(rows))
    got = _cells_of(spark, tmp_path / "*.csv", block)
    for name in ("a.csv", "b.csv"):
        rows = json.loads((tmp_path / name).with_suffix(".json").read_text())
        assert [got[name, i] for i in range(len(rows))] == rows
    assert len(got) == 240


@pytest.mark.parametrize("block", [None, 12])
def test_csv_quotes_inside_cells_and_unclosed_cells(spark, tmp_path, block):
    (tmp_path / "a.csv").write_text('5" pipe,"ok",2\nx,7"\n"q"z,"two\nlines"\nlast,1')
    (tmp_path / "b.csv").write_text('one,"two\nthree"\n\nfour,"open\nfive,six\n"seven",8')
    got = _cells_of(spark, tmp_path, block)
    assert {k[1]: v for k, v in got.items() if k[0] == "a.csv"} == {0: ['5" pipe', "ok", "2"], 1: ["x", '7"'], 2: ["qz", "two\nlines"], 3: ["last", "1"]}
    # The quote before seven closes the cell that the line with four opens; what follows belongs to the cell.
    assert {k[1]: v for k, v in got.items() if k[0] == "b.csv"} == {0: ["one", "two\nthree"], 2: ["four", 'open\nfive,six\nseven"', "8"]}
    (tmp_path / "c.csv").write_text('one,1\ntwo,"open\nthree,3\nfour,4')
    got = _cells_of(spark, tmp_path / "c.csv", block)
    assert [got["c.csv", i][0] for i in range(4)] == ["one", "two", "three", "four"]


@pytest.mark.parametrize(
    "path, name",
    [
        ("report.pdf", "report.pdf"), ("/etc/passwd", "passwd"), ("C:/Users/test/file.xlsx", "file.xlsx"),
        ("../../secret.txt", "secret.txt"), ("test\x01\x02.pdf", "test.pdf"), ("a" * 500 + ".pdf", "a" * 255), ("", "unknown"),
    ],
)
def test_safe_name(spark, path, name):
    assert spark.range(1).select(mf.safe_name(F.lit(path))).first()[0] == name


def test_manifest_of_a_folder(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    rows = {r["original_filename"]: (r["accepted"], r["reason"], r["size_bytes"]) for r in mf.file_manifest(spark, str(tmp_path)).collect()}
    assert rows == {"a.PDF": (True, None, 1), "b.txt": (False, "extension", 1)}


def parse(spark, *docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "n int, doc string")
    return [(r["act"], r["bad_fields"]) for r in a.parse_act_json(df, "doc").orderBy("n").collect()]


def test_act_json_fields(spark):
    full = {
        "act_type": "Служебное расследование ", "act_date": "2024-01-15", "victim_birth_date": "1994", "victim_training_dates": ["2020", 7],
        "responsible_persons": [{"name": "А", "position": "мастер", "x": 1}, {"violation": None}],
        "corrective_measures": [{"measure": "м", "deadline": "д", "responsible": "о"}],
        "employer_fault_pct": "80", "worker_fault_pct": 20.0, "work_related": "yes", "cause_categories": ["a", "b"], "extra": {},
    }
    bad = {
        "act_date": "не-дата", "employer_fault_pct": 80.5, "cause_categories": ["a", 1], "act_number": 15, "language": "ru",
        "responsible_persons": [{"name": 1}], "work_related": 2, "victim_name": None,
    }
    rows = parse(spark, json.dumps(full), json.dumps(bad), "{}", "no json", "[1]", None)
    act, wrong = rows[0]
    assert act["act_type"] == S.ACT_TYPES[0] and str(act["act_date"]) == "2024-01-15" and str(act["victim_birth_date"]) == "1994-01-01"
    assert act["victim_training_dates"] == "2020, 7" and act["employer_fault_pct"] == 80 and act["worker_fault_pct"] == 20
    assert act["work_related"] is True and act["cause_categories"] == ["a", "b"] and wrong == []
    assert [tuple(p) for p in act["responsible_persons"]] == [("А", "мастер", None), (None, None, None)]
    act, wrong = rows[1]
    assert set(wrong) == {"act_date", "employer_fault_pct", "cause_categories", "act_number", "responsible_persons", "work_related"}
    assert act["language"] == "ru"
    for act, wrong in rows[2:]:
        assert all(v is None for v in act) and wrong == []


def test_acceptance(spark):
    docs = [
        (1, None, '{"company_name": " X ", "act_type": "Внутреннее расследование", "region_from_act": "город Алматы"}'),
        (2, None, '{"company_name_from_act": " ", "company_name": "X"}'),
        (3, "no", '{"company_name": "X"}'),
        (4, "yes", '{"company_name": "Уранэнерго", "act_type": "Иное", "victim_name": "В"}'),
    ]
    parsed = a.parse_act_json(spark.createDataFrame(docs, "file_id int, incident_id string, doc string"), "doc")
    accepted, rejected = a.accept_acts(parsed, spark.createDataFrame([("yes",)], "id string"))
    rows = {r["file_id"]: r for r in accepted.collect()}
    assert set(rows) == {1, 4} and rows[1]["region_from_act"] == "Алматы"
    assert rows[4]["text_only"] and rows[4]["victim_name"] is None and rows[4]["cause_categories"] == []
    assert rows[4]["incident_id"] == "yes" and rows[4]["link_status"] == S.LINK_UNLINKED
    # A blank company-for-matching is taken before the company and leaves the act without one.
    assert {r["file_id"]: r["reason"] for r in rejected.collect()} == {2: "company_missing", 3: "incident_not_found"}
    assert a.act_batch_report(accepted, rejected).first().asDict() == {"total": 4, "successful": 2, "failed": 2}


def test_import_order_duplicates_and_replay(spark, tmp_path):
    files = {
        "a": [HEADER, GOOD, GOOD, changed(victim_name="Петров")],
        "b": [HEADER, changed(victim_name=" иванов ", damage_amount_kzt="99"), changed(victim_name="Ким")],
    }
    good, errors, rejected = j.parse_journal(frame(spark, files))
    order = spark.createDataFrame([("a", 1), ("b", 2)], "file string, file_seq int")
    incoming = j.with_file_order(good, order, "batch").withColumn("work_type", F.lit(None).cast("string"))
    store = str(tmp_path / "store")
    classified = u.classify_upsert(incoming, tables.read_store(spark, store))
    assert sorted((r["file"], r["action"]) for r in classified.collect()) == [("a", "create")] * 3 + [("b", "create"), ("b", "update")]
    report = {r["file"]: r for r in u.import_report(classified, errors, None, rejected).collect()}
    assert (report[None]["processed"], report[None]["created"], report[None]["updated"], report[None]["files"]) == (5, 4, 1, 2)

    tables.merge_import(spark, store, classified, F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'"))
    first = tables.read_store(spark, store).collect()
    assert len(first) == 4 and sorted(r["damage_amount_kzt"] for r in first) == [10.5, 10.5, 10.5, 99.0]

    again = u.classify_upsert(incoming, tables.read_store(spark, store))
    assert {r["action"] for r in again.collect()} == {"update"}
    tables.merge_import(spark, store, again, F.expr("TIMESTAMP_NTZ '2026-02-01 00:00:00'"))
    second = tables.read_store(spark, store).collect()
    assert {r["id"] for r in second} == {r["id"] for r in first}
    assert {r["created_at"] for r in second} == {datetime.datetime(2026, 1, 1)}


def test_update_resets_absent_columns_unless_preserved(spark):
    old = {f.name: None for f in S.INCIDENT.fields} | {
        "id": "x", "incident_date": datetime.date(2024, 1, 15), "company": "c", "location": "Цех", "equipment": "кран", "notes": "old",
        "created_at": datetime.datetime(2025, 1, 1), "updated_at": datetime.datetime(2025, 1, 1),
    }
    existing = spark.createDataFrame([tuple(old.values())], S.INCIDENT)
    rows = existing.withColumns(
        {"equipment": F.lit(None).cast("string"), "notes": F.lit("new"), "file_seq": F.lit(0), "row_no": F.lit(2), "id": F.lit("n")}
    )
    classified = u.classify_upsert(rows, existing)
    now = F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'")
    reset = u.upsert(existing, classified, now).first()
    assert (reset["id"], reset["equipment"], reset["notes"], reset["created_at"].year, reset["updated_at"].year) == ("x", None, "new", 2025, 2026)
    kept = u.upsert(existing, classified, now, True, j.NOT_IN_JOURNAL).first()
    assert (kept["equipment"], kept["notes"]) == ("кран", "new")


def test_last_row_of_a_file_wins_on_request(spark):
    good, _, _ = j.parse_journal(frame(spark, {"a": [HEADER, GOOD, GOOD, changed(victim_name=None)]}))
    empty = spark.createDataFrame([], S.INCIDENT)
    incoming = j.with_file_order(good)
    assert u.classify_upsert(incoming, empty).count() == 3
    assert sorted(r["row_no"] for r in u.classify_upsert(incoming, empty, "last").collect()) == [3, 4]


def test_append_fills_defaults(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("1", datetime.date(2024, 5, 1))], "id string, incident_date date")
    tables.append(df, path, S.INCIDENT, F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'"), S.INCIDENT_DEFAULTS)
    row = tables.read_store(spark, path).first()
    assert (row["year"], row["company"], row["victim_count"], row["investigation_status"]) == (2024, S.COMPANIES[0], 1, S.STATUS_OPEN)


def test_arrivals_are_imported_once(spark, tmp_path):
    from sitewarden.streaming.arrivals import stream_journals

    arrivals, store, state, reports = (str(tmp_path / n) for n in ("in", "store", "state", "reports"))
    sheet = lambda *rows: spark.createDataFrame(list(enumerate([HEADER, *rows])), "row_no int, cells array<string>").coalesce(1)
    act = ("1", None, S.LINK_UNLINKED, datetime.date(2024, 1, 15), "Ким", S.COMPANIES[0], "Алматы", S.INJURY_FATAL)
    acts = spark.createDataFrame([act], "id string, incident_id string, link_status string, incident_date_from_act date, victim_name_from_act string, company_name_from_act string, region_from_act string, injury_severity string")
    sheet(GOOD, changed(victim_name="Ким"), changed(company="Нет такой")).write.mode("append").parquet(arrivals)
    spark.createDataFrame([(0, ["x", "y"])], "row_no int, cells array<string>").write.mode("append").parquet(arrivals)
    stream_journals(spark, arrivals, store, state, reports, acts=acts).awaitTermination()
    assert tables.read_store(spark, store).count() == 2
    sheet(changed(damage_amount_kzt="7"), changed(victim_name="Ли")).write.mode("append").parquet(arrivals)
    stream_journals(spark, arrivals, store, state, reports, acts=acts).awaitTermination()
    rows = tables.read_store(spark, store).collect()
    assert len(rows) == 3 and {r["victim_name"]: r["damage_amount_kzt"] for r in rows}["Иванов"] == 7.0
    read = lambda n: spark.read.parquet(f"{reports}/{n}").collect()
    assert [r["message"] for r in read("errors")] == ["Row 4: Некорректное значение для company: 'Нет такой'"]
    assert len(read("rejected")) == 1
    by_name = {r["victim_name"]: r["id"] for r in rows}
    assert [(r["act_id"], r["incident_id"], r["batch"]) for r in read("links")] == [("1", by_name["Ким"], 0)]
    totals = {r["batch"]: r for r in read("report") if r["file"] is None}
    assert (totals[0]["created"], totals[0]["n_errors"], totals[0]["failed_files"], totals[0]["adopted_acts"]) == (2, 1, 1, 1)
    assert (totals[1]["created"], totals[1]["updated"]) == (1, 1)


def test_long_quoted_csv_cell(spark, tmp_path):
    from sitewarden.sources import journal as j

    line = 'a;"' + 'x;' * 100_000 + '""y";"";b'
    cells = spark.createDataFrame([(line,)], "line string").select(j._csv_cells(F.col("line"), ";").alias("c")).first().c
    assert cells == ["a", "x;" * 100_000 + '"y', "", "b"]


def test_csv_is_scanned_once_however_often_rows_are_used(spark, tmp_path):
    cell = lambda i: '"' + "line\n" * (i % 4) + f'of ""{i}"""'
    (tmp_path / "a.csv").write_text("\n".join(f"{i},{cell(i)},x" for i in range(3000)) + "\n", encoding="utf-8")
    rows = j.read_journal(spark, str(tmp_path), "csv")
    assert "MapInArrow" not in rows._jdf.queryExecution().toString()
    got = {x["row_no"]: x["cells"] for x in rows.collect()}
    assert got == {i: [str(i), "line\n" * (i % 4) + f'of "{i}"', "x"] for i in range(3000)}


def test_names_of_a_header_are_found_in_any_case_and_spacing(spark):
    header = [f"  {j.HEADERS[f].upper().replace(' ', '  ')}\n" for f in j.REQUIRED]
    rows = spark.createDataFrame([("f", 0, ["title", None]), ("f", 4, header), ("g", 2, ["a"]), ("g", 1, [None]), ("h", 0, None)], "file string, row_no int, cells array<string>")
    found = {x["file"]: (x["header_row"], x["hits"]) for x in j.detect_header(rows).collect()}
    assert found["f"] == (4, len(j.REQUIRED)) and found["g"] == (1, 0) and set(found) == {"f", "g", "h"}
