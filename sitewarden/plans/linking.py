"""Registered queries: scores, matching, adoption, link updates, backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewarden.operators import matching as m
from sitewarden.operators import upsert as u
from sitewarden.plans import roles
from sitewarden.plans.registry import query
from sitewarden.schemas import LINK_AUTO, LINK_MANUAL, LINK_UNLINKED

_LEV = "levenshtein"


def _norm(c: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[«»"'']', '', 'g'), '\s+', ' ', 'g'))"""


def _ratio(a: str, b: str) -> str:
    return f"(1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))::DOUBLE)"


def _contained(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.9::DOUBLE ELSE {_ratio(a, b)} END"


def _severity(c: str) -> str:
    branches = " ".join(f"WHEN contains({c}, '{k}') THEN '{v}'" for k, v in reversed(m.SEVERITY_KEYWORDS.items()))
    return f"CASE {branches} END"


_A_SIDE = f"""SELECT id AS act_id, incident_date_from_act AS a_date, {_norm('victim_name_from_act')} AS a_name, {_norm('company_name_from_act')} AS a_company,
       {_norm('region_from_act')} AS a_region, {_severity(_norm('injury_severity'))} AS a_class FROM {{acts}}"""
_I_SIDE = f"""SELECT id AS incident_id, incident_date AS i_date, {_norm('victim_name')} AS i_name, {_norm('company')} AS i_company, {_norm('dzo')} AS i_dzo,
       {_norm('region')} AS i_region, {_severity(_norm('injury_type'))} AS i_class FROM incidents"""
_SCORES = f"""SELECT act_id, incident_id,
       CASE WHEN abs(date_diff('day', i_date, a_date)) <= 3 THEN 1.0::DOUBLE - abs(date_diff('day', i_date, a_date)) / 4.0::DOUBLE ELSE 0.0::DOUBLE END AS s_date,
       CASE WHEN a_name = '' OR i_name = '' THEN 0.0::DOUBLE ELSE {_ratio('a_name', 'i_name')} END AS s_name,
       greatest({_contained('a_company', 'i_company')}, {_contained('a_company', 'i_dzo')}) AS s_company,
       {_contained('a_region', 'i_region')} AS s_region,
       CASE WHEN a_class IS NULL OR i_class IS NULL THEN 0.0::DOUBLE WHEN a_class = i_class THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS s_injury
FROM pairs"""
_TOTAL = "0.35::DOUBLE * s_date + 0.30::DOUBLE * s_name + 0.20::DOUBLE * s_company + 0.10::DOUBLE * s_region + 0.05::DOUBLE * s_injury"


def _match_views(acts: str = "acts") -> dict[str, str]:
    return {
        "a_side": _A_SIDE.format(acts=acts),
        "i_side": _I_SIDE,
        "pairs": "SELECT * FROM a_side JOIN i_side ON i_date BETWEEN a_date - 3 AND a_date + 3",
        "scores": _SCORES,
        "scored": f"SELECT act_id, incident_id, {_TOTAL} AS score FROM scores",
        "links": """SELECT act_id, incident_id, score FROM (SELECT *, row_number() OVER (PARTITION BY act_id ORDER BY score DESC, incident_id) AS k
FROM scored WHERE score >= 0.80::DOUBLE) r WHERE k = 1""",
    }


def _own_pairs(t):
    """Every act next to the incident of the same number."""
    return roles.acts(t).select(
        F.col("id").alias("act_id"),
        "incident_date_from_act",
        "victim_name_from_act",
        "company_name_from_act",
        "region_from_act",
        "injury_severity",
    ).join(
        roles.incidents(t).select(
            F.col("id").alias("act_id"), "incident_date", "victim_name", "company", "dzo", "region", "injury_type"
        ),
        "act_id",
    )


_OWN = {
    "a_side": _A_SIDE.format(acts="acts"),
    "i_side": _I_SIDE,
    "pairs": "SELECT * FROM a_side JOIN i_side ON act_id = incident_id",
    "scores": _SCORES,
}


def _score_query(name: str, column: str) -> None:
    short = column.replace("score_", "s_")

    @query(name, roles.sql(f"SELECT act_id, round({short}, 6) AS score FROM scores", "incidents", "acts", **_OWN))
    def plan(t):
        return m.pair_scores(_own_pairs(t), _LEV).select("act_id", F.round(column, 6).alias("score"))


for _name in ("score_date", "score_name", "score_company", "score_region", "score_injury"):
    _score_query(_name, _name)


@query("match_score", roles.sql(f"SELECT act_id, round({_TOTAL}, 6) AS score FROM scores", "incidents", "acts", **_OWN))
def match_score(t):
    return m.pair_scores(_own_pairs(t), _LEV).select("act_id", F.round("score", 6).alias("score"))


# Ratcliff/Obershelp in SQL: the longest common block (n * 1000 - begin is largest), then what lies left and right of it, summed over all rounds.
_BLOCK = """list_max(flatten([[CASE WHEN contains(b, substr(a, i, n)) THEN n * 1000 - i ELSE 0 END FOR n IN range(1, length(a) - i + 2)]
FOR i IN range(1, length(a) + 1)]))"""
_RATCLIFF = f"""WITH RECURSIVE part AS (
SELECT a AS a0, b AS b0, a, b, {_BLOCK} AS x FROM (SELECT DISTINCT a, b FROM texts WHERE a <> '' AND b <> '') d
UNION ALL SELECT a0, b0, a, b, {_BLOCK} AS x FROM (
SELECT a0, b0, CASE WHEN l THEN left(a, i - 1) ELSE substr(a, i + n) END AS a, CASE WHEN l THEN left(b, j - 1) ELSE substr(b, j + n) END AS b FROM (
SELECT *, strpos(b, substr(a, i, n)) AS j FROM (SELECT *, n * 1000 - x AS i FROM (SELECT *, (x + 999) // 1000 AS n FROM part WHERE x > 0) p) q) r,
(VALUES (true), (false)) AS side(l)) s WHERE a <> '' AND b <> '')
SELECT a0 AS a, b0 AS b, 2.0::DOUBLE * sum((x + 999) // 1000) / (length(a0) + length(b0)) AS ratio FROM part GROUP BY a0, b0"""


def _contained_in_pair(a: str, b: str, ratio: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.9::DOUBLE ELSE {ratio} END"


_RATCLIFF_SCORES = f"""SELECT act_id, s_date, coalesce(n.ratio, 0.0::DOUBLE) AS s_name,
greatest({_contained_in_pair('a_company', 'i_company', 'c.ratio')}, {_contained_in_pair('a_company', 'i_dzo', 'z.ratio')}) AS s_company,
{_contained_in_pair('a_region', 'i_region', 'g.ratio')} AS s_region, s_injury
FROM pairs JOIN (SELECT act_id, s_date, s_injury FROM scores) own USING (act_id)
LEFT JOIN ratios n ON n.a = a_name AND n.b = i_name LEFT JOIN ratios c ON c.a = a_company AND c.b = i_company
LEFT JOIN ratios z ON z.a = a_company AND z.b = i_dzo LEFT JOIN ratios g ON g.a = a_region AND g.b = i_region"""


@query(
    "match_score_ratcliff",
    roles.sql(
        f"SELECT act_id, round({_TOTAL}, 6) AS score FROM ratcliff_scores",
        "incidents",
        "acts",
        **_OWN,
        texts="""SELECT a_name AS a, i_name AS b FROM pairs UNION SELECT a_company, i_company FROM pairs
UNION SELECT a_company, i_dzo FROM pairs UNION SELECT a_region, i_region FROM pairs""",
        ratios=_RATCLIFF,
        ratcliff_scores=_RATCLIFF_SCORES,
    ),
)
def match_score_ratcliff(t):
    """The default similarity."""
    return m.pair_scores(_own_pairs(t)).select("act_id", F.round("score", 6).alias("score"))


@query("norm_text", roles.sql(f"SELECT id, {_norm('victim_name_from_act')} AS name, {_norm('company_name_from_act')} AS company FROM acts", "acts"))
def norm_text(t):
    text = lambda c: m.norm_text(F.col(c))
    return roles.acts(t).select("id", text("victim_name_from_act").alias("name"), text("company_name_from_act").alias("company"))


@query(
    "date_candidates",
    roles.sql(
        "SELECT a.id AS act_id, count(*) AS n_candidates, min(i.id) AS first_id, max(i.id) AS last_id FROM acts a JOIN incidents i ON i.incident_date BETWEEN a.incident_date_from_act - 3 AND a.incident_date_from_act + 3 GROUP BY 1",
        "incidents",
        "acts",
    ),
)
def date_candidates(t):
    return m.date_candidates(roles.acts(t), roles.incidents(t))


@query("best_match", roles.sql("SELECT act_id, incident_id, round(score, 6) AS score FROM links", "incidents", "acts", **_match_views()))
def best_match(t):
    links = m.best_match(roles.acts(t), roles.incidents(t), similarity=_LEV)
    return links.select("act_id", "incident_id", F.round("score", 6).alias("score"))


@query("best_match_ratcliff")
def best_match_ratcliff(t):
    links = m.best_match(roles.acts(t), roles.incidents(t))
    return links.select("act_id", "incident_id", F.round("score", 6).alias("score"))


@query(
    "adopt",
    roles.sql(
        f"""SELECT a.id, coalesce(l.incident_id, a.incident_id) AS incident_id,
CASE WHEN l.act_id IS NULL THEN a.link_status ELSE '{LINK_AUTO}' END AS link_status FROM acts a LEFT JOIN links l ON l.act_id = a.id""",
        "incidents",
        "acts",
        open_acts=f"SELECT * FROM acts WHERE link_status = '{LINK_UNLINKED}' AND incident_id IS NULL",
        **_match_views("open_acts"),
    ),
)
def adopt(t):
    linked, _ = m.adopt(roles.acts(t), roles.incidents(t), similarity=_LEV)
    return linked.select("id", "incident_id", "link_status")


def _relinked(open_acts: str) -> str:
    return roles.sql(
        f"""SELECT a.id, coalesce(l.incident_id, a.incident_id) AS incident_id,
CASE WHEN l.act_id IS NULL THEN a.link_status ELSE '{LINK_AUTO}' END AS link_status FROM acts a LEFT JOIN links l ON l.act_id = a.id""",
        "incidents",
        "acts",
        open_acts=open_acts,
        **_match_views("open_acts"),
    )


@query("adopt_explicit", _relinked(f"SELECT * FROM acts WHERE link_status = '{LINK_UNLINKED}'"))
def adopt_explicit(t):
    """Adoption that also moves acts uploaded with an explicit incident."""
    linked, _ = m.adopt(roles.acts(t), roles.incidents(t), relink_explicit=True, similarity=_LEV)
    return linked.select("id", "incident_id", "link_status")


@query("link_on_upload", _relinked("SELECT * FROM acts WHERE incident_id IS NULL"))
def link_on_upload(t):
    return m.link_on_upload(roles.acts(t), roles.incidents(t), similarity=_LEV).select("id", "incident_id", "link_status")


@query(
    "apply_links",
    roles.sql(
        f"""SELECT id, CASE WHEN incident_id IS NULL AND id IN (SELECT l_orderkey FROM lineitem) THEN id ELSE incident_id END AS incident_id,
CASE WHEN incident_id IS NULL AND id IN (SELECT l_orderkey FROM lineitem) THEN '{LINK_MANUAL}' ELSE link_status END AS link_status FROM acts""",
        "acts",
    ),
)
def apply_links(t):
    acts = roles.acts(t)
    shipped = t.lineitem.select(F.col("l_orderkey").alias("id")).distinct()
    links = acts.where(F.col("incident_id").isNull()).join(shipped, "id", "left_semi").select(
        F.col("id").alias("act_id"), F.col("id").alias("incident_id"), F.lit(LINK_MANUAL).alias("link_status")
    )
    return u.apply_links(acts, links).select("id", "incident_id", "link_status")


@query(
    "backfill_links",
    roles.sql(f"SELECT id, CASE WHEN incident_id IS NOT NULL THEN '{LINK_AUTO}' ELSE link_status END AS link_status FROM acts", "acts"),
)
def backfill_links(t):
    return m.backfill_links(roles.acts(t)).select("id", "link_status")


@query(
    "backfill_fatality",
    roles.sql("SELECT id, CASE WHEN injury_type = 'Смертельный исход' THEN 1 ELSE fatality_count END AS fatality_count FROM incidents", "incidents"),
)
def backfill_fatality(t):
    return m.backfill_fatality(roles.incidents(t)).select("id", "fatality_count")
