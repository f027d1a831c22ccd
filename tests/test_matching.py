"""Scores, blocking and adoption."""

import datetime
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewarden import schemas as S
from sitewarden import session
from sitewarden.functions import similarity as sim
from sitewarden.operators import matching as m
from sitewarden.operators import namesearch

DAY = datetime.date(2026, 1, 15)
ACT = "id long, incident_id long, link_status string, incident_date_from_act date, victim_name_from_act string, company_name_from_act string, region_from_act string, injury_severity string"
INCIDENT = "id long, incident_date date, victim_name string, company string, dzo string, region string, injury_type string"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def lit(value):
    return F.lit(value).cast("date") if isinstance(value, datetime.date) else F.lit(value).cast("string")


@pytest.mark.parametrize(
    "text, expected",
    [(None, ""), ("", ""), ("  ФИО  Пострадавшего  ", "фио пострадавшего"), ("АО «Тест»", "ао тест"), ('АО "Тест"', "ао тест"), ("a \tb", "a b")],
)
def test_norm_text(spark, text, expected):
    assert one(spark, m.norm_text(lit(text))) == expected


@pytest.mark.parametrize("days, expected", [(0, 1.0), (1, 0.75), (-3, 0.25), (4, 0.0)])
def test_score_date(spark, days, expected):
    assert one(spark, m.score_date(lit(DAY), lit(DAY + datetime.timedelta(days=days)))) == expected


def test_score_date_null(spark):
    assert one(spark, m.score_date(F.lit(None).cast("date"), lit(DAY))) == 0.0


def test_score_name(spark):
    score = lambda a, b: one(spark, m.score_name(lit(a), lit(b)))
    assert score("Иванов Иван Иванович", "Иванов Иван Иванович") == 1.0
    assert 0.4 < score("Иванов И.И.", "Иванов Иван Иванович") < 0.9
    assert score("Петров Пётр", "Сидоров Алексей") < 0.5
    assert score(None, "Иванов") == score("Иванов", None) == score("", "Иванов") == 0.0


def test_score_company(spark):
    score = lambda a, b, c: one(spark, m.score_company(lit(a), lit(b), lit(c)))
    assert score("АО Казахтелеком", "АО «Казахтелеком»", None) == 0.9
    assert score("Нурсат+", None, "Нурсат+") == 0.9
    assert score("Казахтелеком", "Unrelated Corp", "АО Казахтелеком — головной офис") == 0.9
    assert score(None, "Тест", None) == 0.0
    assert score("ТОО Восток Электроника", "АО Западный Транспорт", "ООО Северный Металл") < 0.5


def test_score_region(spark):
    score = lambda a, b: one(spark, m.score_region(lit(a), lit(b)))
    assert score("Алматы", "г. Алматы") == 0.9
    assert score(None, "Алматы") == score("Алматы", None) == 0.0
    assert score("Астана", "Актобе") < 0.7


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ("Смертельный исход", "Смертельный исход", 1.0),
        ("летальный", "смертельный", 1.0),
        ("тяжёлая травма", "Тяжёлая", 1.0),
        ("лёгкая", "легкая", 1.0),
        ("лёгкая", "тяжёлая", 0.3),
        ("групповой", "групповой случай", 1.0),
        (None, "тяжёлая", 0.0),
        ("перелом", "ушиб", 0.0),
        ("Травма не относится к тяжелым", "Травма относится к тяжелым", 1.0),
        ("смертельный, групповой", "групповой", 1.0),
    ],
)
def test_score_injury(spark, a, b, expected):
    assert one(spark, m.score_injury(lit(a), lit(b))) == expected


def test_reachable_window_is_two_days():
    assert m.reachable_days() == 2


def test_perfect_pair_scores_097(spark):
    acts = spark.createDataFrame([(1, None, S.LINK_UNLINKED, DAY, "Иванов Иван", "АО Казахтелеком", "Алматы", "смертельный")], ACT)
    incidents = spark.createDataFrame([(7, DAY, "Иванов  Иван", "АО «Казахтелеком»", None, "Алматы", "Смертельный исход")], INCIDENT)
    row = m.best_match(acts, incidents).first()
    assert (row["act_id"], row["incident_id"], round(row["score"], 6)) == (1, 7, 0.97)


def test_ties_go_to_the_lower_id_and_two_acts_may_share_one(spark):
    act = (None, S.LINK_UNLINKED, DAY, "Иванов Иван", "АО А", "Алматы", None)
    acts = spark.createDataFrame([(1, *act), (2, *act), (3, None, S.LINK_UNLINKED, None, "Иванов Иван", "АО А", "Алматы", None)], ACT)
    incidents = spark.createDataFrame([(i, DAY, "Иванов Иван", "АО А", None, "Алматы", None) for i in (9, 8)], INCIDENT)
    assert sorted((r["act_id"], r["incident_id"]) for r in m.best_match(acts, incidents).collect()) == [(1, 8), (2, 8)]


def test_bag_bounds_hold(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("абвг ", k=rng.randint(0, 12))), "".join(rng.choices("абвг ", k=rng.randint(0, 12)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    common = F.size(F.array_intersect(sim.bag(F.col("a")), sim.bag(F.col("b"))))
    cols = [bound(common, F.col("a"), F.col("b")) - ratio(F.col("a"), F.col("b")) for ratio, _, bound in sim.SIMILARITIES.values() if bound]
    rows = df.where("a <> '' and b <> ''").select(common, *cols, "a", "b").collect()
    for n, slack, a, b in rows:
        assert n == sum(min(a.count(c), b.count(c)) for c in set(a)) and slack > -1e-12


def _brute(acts, incidents):
    def norm(s):
        return " ".join("".join(ch for ch in (s or "").lower() if ch not in "«»\"'").split())

    def ratio(a, b):
        return SequenceMatcher(None, a, b).ratio()

    def near(a, b):
        if not a or not b:
            return 0.0
        return 0.9 if a in b or b in a else ratio(a, b)

    def kind(s):
        found = None
        for k, v in m.SEVERITY_KEYWORDS.items():
            if k in norm(s):
                found = v
        return found

    best = {}
    for a in acts:
        for i in incidents:
            gap = abs((a[3] - i[1]).days) if a[3] else 9
            if gap > 3:
                continue
            an, iname = norm(a[4]), norm(i[2])
            ka, ki = kind(a[7]), kind(i[6])
            score = (
                0.35 * (1 - gap / 4)
                + 0.30 * (ratio(an, iname) if an and iname else 0.0)
                + 0.20 * max(near(norm(a[5]), norm(i[3])), near(norm(a[5]), norm(i[4])))
                + 0.10 * near(norm(a[6]), norm(i[5]))
                + 0.05 * ((1.0 if ka == ki else 0.3) if ka and ki else 0.0)
            )
            if score >= 0.80:
                key = (-score, i[0])
                best[a[0]] = min(best.get(a[0], key), key)
    return {k: (v[1], round(-v[0], 9)) for k, v in best.items()}


@pytest.mark.parametrize("hot", [False, True])
def test_blocking_equals_brute_force(spark, hot, monkeypatch):
    """Exact on random rows, and on one date holding most rows with the salt forced to split contexts."""
    monkeypatch.setattr(m, "_ROWS_PER_SALT", 3)
    rng = random.Random(7)
    names = ["Иванов Иван", "Иванов Иван Иванович", "Петров Пётр", "Ивановa Ивана", "Ким А", "ким  а", None, ""]
    companies = ["АО «Казахтелеком»", "Казахтелеком", "АО Казпочта", "ТОО Восток", None, "АО Казахтелекон"]
    regions = ["Алматы", "г. Алматы", "Астана", "Алмата", None]
    injuries = ["Смертельный исход", "Травма относится к тяжелым", "лёгкая", None]
    day = lambda: DAY + datetime.timedelta(days=0 if hot and rng.random() < 0.6 else rng.randrange(6))
    pick = rng.choice
    acts = [
        (i, None, S.LINK_UNLINKED, day() if rng.random() < 0.95 else None, pick(names), pick(companies), pick(regions), pick(injuries))
        for i in range(60)
    ]
    incidents = [(i, day(), pick(names), pick(companies), pick(companies), pick(regions), pick(injuries)) for i in range(120)]
    found = m.best_match(spark.createDataFrame(acts, ACT), spark.createDataFrame(incidents, INCIDENT)).collect()
    assert {r["act_id"]: (r["incident_id"], round(r["score"], 9)) for r in found} == _brute(acts, incidents)


def test_adoption_and_explicit_links(spark):
    fields = (DAY, "Иванов Иван", "АО А", "Алматы", "смертельный")
    acts = spark.createDataFrame(
        [(1, None, S.LINK_UNLINKED, *fields), (2, 5, S.LINK_UNLINKED, *fields), (3, None, S.LINK_MANUAL, *fields)], ACT
    )
    incidents = spark.createDataFrame([(9, DAY, "Иванов Иван", "АО А", None, "Алматы", "Смертельный исход")], INCIDENT)
    rows = lambda df: {r["id"]: (r["incident_id"], r["link_status"]) for r in df.collect()}
    kept, _ = m.adopt(acts, incidents)
    assert rows(kept) == {1: (9, S.LINK_AUTO), 2: (5, S.LINK_UNLINKED), 3: (None, S.LINK_MANUAL)}
    moved, links = m.adopt(acts, incidents, relink_explicit=True)
    assert rows(moved)[2] == (9, S.LINK_AUTO) and links.count() == 2
    assert rows(m.link_on_upload(acts, incidents))[2] == (5, S.LINK_UNLINKED)


def test_ratio_kernel_equals_its_definition():
    rng = random.Random(11)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    many = "".join(chr(c) for c in range(1000, 1150))
    pairs = [(text("абв г", rng.randrange(20)), text("абв г", rng.randrange(20))) for _ in range(2000)]
    pairs += [(text(letters, rng.choice([30, 220, 400])), text(letters, rng.choice([150, 199, 200, 330]))) for letters in ("ab", "abcdefghij", many) for _ in range(30)]
    pairs += [(a, (a + b)[:250]) for a, b in pairs[-90:]] + [("", ""), ("a", ""), ("", "a"), ("😀é", "é😀")]
    left, right = map(list, zip(*pairs))
    wanted = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert sim.ratcliff_ratios(left, right).tolist() == pytest.approx(wanted, abs=1e-12)
    needed = np.array([rng.random() for _ in pairs])
    early = sim.ratcliff_ratios(left, right, needed)
    for got, want, least in zip(early, wanted, needed):
        assert got == pytest.approx(want, abs=1e-12) if want >= least else got < least


def test_ratio_of_columns(spark):
    rows = [("иванов", "иванова", 0.5), ("иванов", "иванова", 0.99), ("иванов", None, 0.1), (None, "x", 0.1), ("", "", 0.2)]
    df = spark.createDataFrame(rows, "a string, b string, n double")
    got = [tuple(r) for r in df.select(sim.ratcliff(F.col("a"), F.col("b")), sim.ratcliff(F.col("a"), F.col("b"), F.col("n"))).collect()]
    assert got[0] == pytest.approx((12 / 13, 12 / 13)) and got[1][0] == got[0][0] and got[1][1] < 0.99 and got[4] == (1.0, 1.0)
    assert all(x is None or x != x for r in got[2:4] for x in r)


def test_names_of_contexts_that_offer_less_are_not_compared(spark, monkeypatch):
    """What an act finds in the context that offers most spares it the names of all others."""
    ratio, bound, _ = sim.SIMILARITIES["levenshtein"]
    compared = spark.sparkContext.accumulator(0)

    def seen(a):
        compared.add(1)
        return a

    noted = F.udf(seen, "string").asNondeterministic()
    monkeypatch.setitem(sim.SIMILARITIES, "levenshtein", (lambda a, b, n=None: ratio(a, b) if n is None else ratio(noted(a), b, n), bound, None))
    acts = spark.createDataFrame([(1, None, S.LINK_UNLINKED, DAY, "Иванов Иван", "АО А", "Алматы", "смертельный")], ACT)
    rows = [(0, DAY, "Иванова Иван", "АО А", None, "Алматы", "смертельный")]
    rows += [(i, DAY, f"Петров Пе{i:03}", "АО А", None, f"Костанай {i % 7}", "смертельный") for i in range(1, 101)]
    found = m.best_match(acts, spark.createDataFrame(rows, INCIDENT), similarity="levenshtein").collect()
    assert [(r["act_id"], r["incident_id"], round(r["score"], 6)) for r in found] == [(1, 0, 0.945)]
    assert 0 < compared.value < 20  # the plan reads the ratio several times per pair


def test_bags_are_numbers(spark):
    """Bags of numbers take half the memory of bags of texts."""
    assert dict(spark.createDataFrame([("абба",)], "a string").select(sim.bag(F.col("a")).alias("b")).dtypes)["b"] == "array<bigint>"


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_numbered_texts_compare_as_their_definitions():
    rng = random.Random(5)
    many = "".join(chr(c) for c in range(1000, 1400))
    texts = ["", "a", "😀é", "ab" * 32, "ab" * 32 + "c", "x" * 63, "x" * 64]
    texts += ["".join(rng.choices(letters, k=rng.choice([1, 5, 18, 40, 63, 64, 65, 90, 128, 129, 256, 257, 300]))) for letters in ("ab", "абвгде 0123", many) for _ in range(25)]
    words = sim.Words(texts := list(dict.fromkeys(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in rng.sample(range(len(texts)), 25)]
    left, right = (np.array(x) for x in zip(*pairs))
    wanted = [_distance(texts[i], texts[j]) for i, j in pairs]
    assert words.distances(left, right).tolist() == wanted
    for name, exact in (("levenshtein", [1 - d / max(len(texts[i]), len(texts[j]), 1) for d, (i, j) in zip(wanted, pairs)]), ("ratcliff", [SequenceMatcher(None, texts[i], texts[j]).ratio() for i, j in pairs])):
        kernel, told = sim.KERNELS[name], (left != right) & (words.sizes[left] > 0) & (words.sizes[right] > 0)
        assert kernel.ratios(words, left, right)[told] == pytest.approx(np.array(exact)[told], abs=1e-12)
        assert (kernel.bound(words, left, right) - exact > -1e-12)[told].all()
        assert (kernel.unequal(np.maximum(words.sizes[left], words.sizes[right])) - exact > -1e-12)[told].all()
        for needed in (0.0, 0.4):
            found = np.full(len(left), -1.0)
            for at, ratio in kernel.search(words, left, right, left, lambda p: np.full(len(p), needed)):
                found[at] = ratio
            assert all(got == pytest.approx(want, abs=1e-12) if want >= needed else got < needed for got, want in zip(found[told], np.array(exact)[told]))


def test_search_stages_no_bands(spark):
    """Rows, profiles, incidents and the sizes of the blocks are written, whatever the contexts; before, three tables per band were besides."""
    rows = [(i, DAY, f"Иванов Иван{i}", "АО А", None, "Алматы", "смертельный") for i in range(40)]
    acts = spark.createDataFrame([(i, None, S.LINK_UNLINKED, DAY, f"Иванов Ива{i}", "АО А", "Алматы", "смертельный") for i in range(40)], ACT)
    before = session.staged_so_far()
    links = m.best_match(acts, spark.createDataFrame(rows, INCIDENT), similarity="levenshtein")
    assert links.count() == 40 and session.staged_so_far() - before == 4


@pytest.mark.parametrize("similarity", ["levenshtein", "ratcliff"])
def test_what_an_act_has_spares_it_other_names(monkeypatch, similarity):
    """Of 100 acts and 2 000 incidents of one date few names are compared, and the result is that of all pairs."""
    rng = random.Random(2)
    kernel, compared = sim.KERNELS[similarity], []

    def search(words, left, right, *more):
        compared.append(len(left))
        return kernel.search(words, left, right, *more)

    monkeypatch.setitem(namesearch.KERNELS, similarity, sim.Kernel(kernel.ratios, kernel.unequal, kernel.bound, search))
    name = lambda: "".join(rng.choices("абвгдежзиклмн", k=9))
    regions = ["алматы", "г. алматы", "астана", "актобе", "караганда"]
    offered = [(DAY + datetime.timedelta(days=rng.choice([0, 0, 1, 3])), "а", "", rng.choice(regions), "тяжел", name(), i) for i in range(2000)]
    asked = [(DAY, "ао а", rng.choice(regions), "тяжел", offered[rng.randrange(2000)][5][: rng.choice([7, 8, 9])]) for _ in range(100)]
    asked = list(dict.fromkeys(asked))
    table = lambda names, rows: namesearch.pa.table(dict(zip(names, map(list, zip(*rows)))))
    rule = namesearch.Rule(0.8, 2, similarity, (0.35, 0.3, 0.2, 0.1, 0.05), 0.9, 0.3)
    found = namesearch.best_in_block(
        table(namesearch.ACT_KEY, asked), table(("day", "i_company", "i_dzo", "i_region", "i_class", "i_name", "incident_id"), offered), rule
    ).to_pylist()
    ratio = (lambda a, b: SequenceMatcher(None, a, b).ratio()) if similarity == "ratcliff" else (lambda a, b: 1 - _distance(a, b) / max(len(a), len(b)))
    near = lambda a, b: 0.9 if a in b or b in a else ratio(a, b)
    wanted = {}
    for a in asked:
        for i in offered:
            if (gap := abs((a[0] - i[0]).days)) <= 2:
                score = 0.35 * (1 - gap / 4) + 0.18 + 0.1 * near(a[2], i[3]) + 0.05
                if score + 0.3 >= 0.8 and (score := score + 0.3 * ratio(a[4], i[5])) >= 0.8:
                    wanted[a] = min(wanted.get(a, (0, 0)), (-round(score, 9), i[6]))
    assert {tuple(r[c] for c in namesearch.ACT_KEY): r["incident_id"] for r in found} == {a: i for a, (_, i) in wanted.items()}
    assert len(wanted) > 50 and 0 < sum(compared) < len(asked) * len(offered) / 10


def test_long_and_odd_names_and_dates(spark):
    """Names of more letters than a machine word, dates far apart, an act that comes twice, ids that are null."""
    far = datetime.date(1, 1, 2)
    long = "Иванов " * 12
    fields = lambda day, name: (None, S.LINK_UNLINKED, day, name, "АО А", "Алматы", None)
    acts = [(1, *fields(DAY, long)), (1, *fields(DAY, long)), (2, *fields(far, "Ким А")), (3, *fields(DAY, "")), (None, *fields(DAY, "Ким"))]
    incidents = [(5, DAY, long + "х", "АО А", None, "Алматы", None), (6, far, "Ким Б", "АО А", None, "Алматы", None), (7, DAY, "Ким", None, "АО А", "Алматы", None)]
    for similarity in ("levenshtein", "ratcliff"):
        found = m.best_match(spark.createDataFrame(acts, ACT), spark.createDataFrame(incidents, INCIDENT), similarity=similarity).collect()
        assert sorted((r["act_id"], r["incident_id"]) for r in found) == [(1, 5), (1, 5), (2, 6)]
