"""DuckDB SQL for the linkage queries, written apart from the Spark expressions."""

from __future__ import annotations

from foliate.plans.datasets import duck

_NUM = r"([0-9]+½|[0-9]+/[0-9]+|[0-9]+\.[0-9]+|[0-9]+[a-zA-Z]?|½)"
_YEAR = r"[(\[]((?:19|20)[0-9]{2})[)\]]"
_VOL = r"(?i)\b(?:v|vol|volume)\.?\s*([0-9]+)\b"
_STEPS = [
    (r"(?i)\bannual\s*#?\s*([0-9]+)\b", None), (r"(?i)\bannual\b", "Annual"), (r"(?i)\b(?:fcbd|free comic book day)\b", "FCBD"),
    (r"(?i)\b(?:one-shot|oneshot)\b", "One-Shot"), (r"(?i)\bpreview\b", "Preview"), (r"(?i)\bspecial\s*#?\s*([0-9]+)\b", None),
    (r"(?i)\bspecial\b", "Special"), (r"#\s*" + _NUM, None), (r"(?i)\bissue\s*#?\s*" + _NUM, None),
    (r"(?:^|[\s_\-#])([0-9]{1,4}[a-zA-Z]?)\b[^0-9]*$", None),
]
_WORDS = "tpb|trade paperback|hc|hardcover|gn|graphic novel|omnibus|compendium|masterworks|collection|deluxe|deluxe edition|collected edition|complete edition|vol 0|vol\\.0|volume 0|vol 1 tpb|vol\\.1 tpb|vol 1 hc|volume 1 tpb"


def rep(x: str, p: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{p}', '{by}', 'g')"


def squeeze(x: str) -> str:
    return f"trim({rep(x, chr(92) + 's+', ' ')})"


def title(x: str) -> str:
    t = f"trim(lower(coalesce({x}, '')))"
    for a in ("the ", "a ", "an "):
        t = f"regexp_replace({t}, '^{a}', '')"
    return squeeze(rep(t, r"[^\w\s]", " "))


def key(x: str) -> str:
    return squeeze(rep(f"regexp_replace(trim(lower(coalesce({x}, ''))), '^(the|a|an)\\s+', '')", r"[\W_]+", " "))


def nform(x: str) -> str:
    return f"""CASE WHEN {x} IN ('½', '1/2', '0.5') THEN '0.5' WHEN suffix({x}, '½') OR suffix({x}, '1/2') THEN trim({rep(x, '[½|1/2]')}) || '.5'
      WHEN regexp_full_match({x}, '[0-9]+') THEN CASE WHEN ltrim({x}, '0') = '' THEN '0' ELSE ltrim({x}, '0') END ELSE {x} END"""


def _number() -> str:
    arms = []
    for p, fixed in _STEPS:
        value = f"'{fixed}'" if fixed else nform(f"trim(regexp_extract(name, '{p}', 1))")
        arms.append(f"WHEN regexp_matches(name, '{p}') THEN {value}")
    return "CASE " + " ".join(arms) + " ELSE '' END"


def _cut() -> str:
    arms = [
        f"WHEN regexp_matches(name, '{p}') THEN " + ("name" if fixed else f"CASE WHEN string_split_regex(name, '{p}')[1] = '' THEN name ELSE string_split_regex(name, '{p}')[1] END")
        for p, fixed in _STEPS
    ]
    return "CASE " + " ".join(arms) + " ELSE name END"


_TRAIL = r"[_\-.()\[\]]+"
_CLEAN = f"trim({rep(rep(rep(rep(rep('cut', _YEAR), _VOL), '#' + chr(92) + 's*' + _NUM), '(?i)' + chr(92) + 'bissue' + chr(92) + 's*#?' + chr(92) + 's*' + _NUM), _TRAIL, ' ')})"
NAMES = rf"""nm AS (SELECT file_id, path, regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') AS name, string_split(path, '/')[-2] AS parent FROM lib_files)"""
PARSED = rf"""{duck("lib_files")}, {NAMES},
p1 AS (SELECT *, lower(name) AS low, {_number()} AS issue_number, {_cut()} AS cut,
  coalesce(TRY_CAST(CASE WHEN regexp_extract(name, '{_YEAR}', 1) <> '' THEN regexp_extract(name, '{_YEAR}', 1) ELSE regexp_extract(parent, '{_YEAR}', 1) END AS INT), 0) AS year,
  CASE WHEN regexp_extract(name, '{_VOL}', 1) = '' THEN '' WHEN ltrim(regexp_extract(name, '{_VOL}', 1), '0') = '' THEN '1' ELSE ltrim(regexp_extract(name, '{_VOL}', 1), '0') END AS volume,
  regexp_matches(lower(name), '\b(?:{_WORDS})\b') AS is_tpb, contains(lower(name), 'annual') AS is_annual,
  regexp_matches(lower(name), 'special|giant|fcbd|free comic book day|preview|one-shot|oneshot') AS is_special FROM nm),
p2 AS (SELECT *, {_CLEAN} AS c1, trim({rep(rep('parent', _YEAR), _TRAIL, ' ')}) AS folder FROM p1),
p3 AS (SELECT *, CASE WHEN is_annual AND NOT suffix(lower(c1), 'annual') THEN trim(c1 || ' Annual')
    WHEN contains(low, 'special') AND NOT suffix(lower(c1), 'special') THEN trim(c1 || ' Special') ELSE c1 END AS c2 FROM p2),
p4 AS (SELECT *, CASE WHEN parent <> '' AND lower(parent) NOT IN ('comics', 'downloads', 'tmp', 'temp') AND folder <> '' AND (c2 = '' OR lower(c2) = lower(folder)) THEN folder ELSE c2 END AS c3 FROM p3),
parsed AS (SELECT file_id, path, CASE WHEN c3 <> '' THEN c3 WHEN parent <> '' THEN parent ELSE name END AS series_name, volume, issue_number, year, '' AS publisher, is_tpb, is_annual, is_special FROM p4)"""


def _pool(where: str = "TRUE") -> str:
    """Evaluated candidates `ev` of the pools, and decisions `dec`."""
    return rf"""
cd AS (SELECT c.*, f.series_name AS f_series, f.issue_number AS f_number, f.year AS f_year, f.volume AS f_volume, f.is_tpb AS f_tpb,
  x.series AS xs, x.title AS xt, x.number AS xn, coalesce(x.year, 0) AS xy, x.provider_id AS xid,
  {title("c.series_name")} AS t, {title("f.series_name")} AS ft, ltrim(c.issue_number, '0') AS n, ltrim(f.issue_number, '0') AS fn,
  {title("CASE WHEN coalesce(x.series, '') <> '' THEN x.series ELSE x.title END")} AS xtitle,
  c.provider IN ('Kapowarr', 'ComicVine', 'GCD', 'GCP') AND c.series_name <> '' AND c.issue_number <> '' AS ext
  FROM candidates c JOIN parsed f USING (file_id) LEFT JOIN existing x USING (file_id) WHERE {where}),
ag AS (SELECT file_id, t, n, trim(lower(volume)) AS v, publication_year AS y, count(DISTINCT provider) AS k, min(pool_pos) AS first FROM cd WHERE ext GROUP BY ALL),
fb AS (SELECT file_id, t, n, arg_min(k, first) AS k FROM ag WHERE k >= 2 GROUP BY ALL),
pf AS (SELECT * FROM cd WHERE provider IN ('Kapowarr', 'ComicVine', 'GCD', 'GCP', 'ExistingXML') AND (series_name <> '' OR issue_number <> '')
  QUALIFY row_number() OVER (PARTITION BY file_id, provider ORDER BY pool_pos) = 1),
dis AS (SELECT a.file_id, sum(CASE WHEN a.issue_number <> '' AND b.issue_number <> '' AND a.n <> b.n THEN 1 ELSE 0 END
    + CASE WHEN a.t <> '' AND b.t <> '' AND a.t <> b.t THEN 1 ELSE 0 END
    + CASE WHEN a.publication_year > 0 AND b.publication_year > 0 AND abs(a.publication_year - b.publication_year) >= 2 THEN 1 ELSE 0 END) AS k
  FROM pf a JOIN pf b ON a.file_id = b.file_id AND a.pool_pos < b.pool_pos GROUP BY 1),
s1 AS (SELECT cd.*, CASE WHEN NOT ext THEN 0 WHEN ag.k >= 2 THEN ag.k ELSE coalesce(fb.k, 0) END AS n_agree, coalesce(dis.k, 0) AS n_dis,
  CASE WHEN provider = 'ExistingXML' THEN 100 WHEN provider = 'Kapowarr' AND (issue_id <> '' OR series_id <> '') THEN 90 WHEN issue_id <> '' THEN 20 WHEN series_id <> '' THEN 15 ELSE 0 END AS e1,
  CASE WHEN issue_number = '' OR f_number = '' THEN 0 WHEN cd.n = fn THEN 30 ELSE -60 END AS e2,
  CASE WHEN f_tpb AND NOT regexp_matches(lower(series_name), 'tpb|trade paperback|omnibus|compendium|masterworks|collection|deluxe edition|graphic novel') AND issue_number <> '' THEN -50
       WHEN NOT f_tpb AND regexp_matches(lower(series_name), 'tpb|trade paperback|omnibus|compendium|masterworks|collection|deluxe edition|graphic novel') THEN -50 ELSE 0 END AS e3,
  CASE WHEN cd.t = '' OR ft = '' THEN 0 WHEN cd.t = ft THEN 25 WHEN starts_with(cd.t, ft) OR starts_with(ft, cd.t) THEN 15 ELSE -50 END AS e4,
  CASE WHEN publication_year <= 0 OR f_year <= 0 THEN 0 WHEN publication_year = f_year THEN 15 WHEN abs(publication_year - f_year) = 1 THEN 5 ELSE -50 END AS e5,
  CASE WHEN cd.t = '' OR ft = '' OR cd.t = ft THEN NULL WHEN starts_with(cd.t, ft) OR starts_with(ft, cd.t) THEN 'ERROR' ELSE 'FATAL' END AS c1,
  CASE WHEN publication_year <= 0 OR f_year <= 0 OR abs(publication_year - f_year) <= 1 THEN NULL WHEN abs(publication_year - f_year) >= 5 THEN 'FATAL' ELSE 'ERROR' END AS c2,
  CASE WHEN issue_number = '' OR f_number = '' OR cd.n = fn THEN NULL WHEN regexp_replace(cd.n, '[A-Z]+$', '') = regexp_replace(fn, '[A-Z]+$', '') THEN 'WARNING' ELSE 'FATAL' END AS c3,
  CASE WHEN volume = '' OR f_volume = '' OR lower(volume) = lower(f_volume) THEN NULL ELSE 'ERROR' END AS c4,
  CASE WHEN coalesce(xn, '') <> '' AND f_number <> '' AND ltrim(xn, '0') <> fn THEN 1 ELSE 0 END + CASE WHEN xtitle <> '' AND ft <> '' AND xtitle <> ft THEN 1 ELSE 0 END
    + CASE WHEN xy > 0 AND f_year > 0 AND abs(xy - f_year) >= 2 THEN 1 ELSE 0 END AS n_xf,
  CASE WHEN provider = 'ExistingXML' THEN 0 ELSE CASE WHEN coalesce(xid, '') <> '' AND issue_id <> '' AND xid <> issue_id AND contains(xid, '4000-') AND contains(issue_id, '4000-') THEN 1 ELSE 0 END
    + CASE WHEN coalesce(xn, '') <> '' AND issue_number <> '' AND ltrim(xn, '0') <> cd.n THEN 1 ELSE 0 END + CASE WHEN xtitle <> '' AND cd.t <> '' AND xtitle <> cd.t THEN 1 ELSE 0 END
    + CASE WHEN xy > 0 AND publication_year > 0 AND abs(xy - publication_year) >= 2 THEN 1 ELSE 0 END END AS n_xp
  FROM cd LEFT JOIN ag ON ag.file_id = cd.file_id AND ag.t = cd.t AND ag.n = cd.n AND ag.v = trim(lower(cd.volume)) AND ag.y = cd.publication_year
  LEFT JOIN fb ON fb.file_id = cd.file_id AND fb.t = cd.t AND fb.n = cd.n LEFT JOIN dis ON dis.file_id = cd.file_id),
s2 AS (SELECT *, CAST(greatest(0, least(100, e1 + e2 + e3 + e4 + e5 + CASE WHEN n_agree >= 2 THEN 15 ELSE 0 END)) AS DOUBLE) AS score,
  greatest(e1, 0) + greatest(e2, 0) + greatest(e4, 0) + greatest(e5, 0) + CASE WHEN n_agree >= 2 THEN 15 ELSE 0 END AS pos,
  c1 IS NOT NULL OR c2 IS NOT NULL OR coalesce(c3, '') = 'FATAL' OR c4 IS NOT NULL AS own, n_dis + n_xf + n_xp AS outside FROM s1),
s3 AS (SELECT *, CASE WHEN score >= 75 AND NOT own THEN CASE WHEN outside > 0 THEN 'MANUAL_REVIEW' WHEN score >= 90 THEN 'AUTO_ACCEPT' ELSE 'ACCEPT_WITH_WARNING' END
  WHEN coalesce(c1, '') <> 'FATAL' AND (score >= 50 OR (own AND pos >= 50)) THEN 'MANUAL_REVIEW' ELSE 'UNRESOLVED' END AS level, own OR outside > 0 AS critical FROM s2),
ev AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY critical, score DESC, pool_pos) AS rk FROM s3),
best AS (SELECT * FROM ev WHERE rk = 1),
sec AS (SELECT ev.file_id, arg_min(ev.score, ev.rk) AS second_best FROM ev JOIN best b USING (file_id) WHERE ev.rk > 1 AND (ev.t <> b.t OR ev.n <> b.n
  OR (ev.publication_year <> 0 AND b.publication_year <> 0 AND abs(ev.publication_year - b.publication_year) > 1)) GROUP BY 1),
cnt AS (SELECT file_id, count(*) AS n_candidates FROM ev GROUP BY 1),
dec0 AS (SELECT best.*, second_best, n_candidates, coalesce(score - second_best <= 10, FALSE) AND level IN ('AUTO_ACCEPT', 'ACCEPT_WITH_WARNING') AS ambiguous
  FROM best LEFT JOIN sec USING (file_id) JOIN cnt USING (file_id)),
dec AS (SELECT * REPLACE (CASE WHEN ambiguous THEN 'MANUAL_REVIEW' ELSE level END AS level) FROM dec0)"""


_ACTION = "CASE WHEN level IN ('AUTO_ACCEPT', 'ACCEPT_WITH_WARNING') THEN 'UPDATE' WHEN level = 'MANUAL_REVIEW' THEN 'REVIEW' ELSE 'SKIP' END"
_BASE = f"{PARSED}, {duck('candidates')}, {duck('existing')}"
DECIDED = f"WITH {_BASE}, {_pool()}"

ORACLES = {
    "F1_F9_parse_filename": f"WITH {PARSED} SELECT * FROM parsed",
    "A1_evidence_score": f"{DECIDED} SELECT file_id, pool_pos, score, CAST(n_agree AS INT) AS n_agree FROM ev",
    "A3_conflicts": f"""{DECIDED} SELECT file_id, pool_pos, array_to_string(list_filter(['series_conflict:' || c1, 'year_conflict:' || c2,
       CASE WHEN c3 = 'WARNING' THEN 'variant_conflict:WARNING' WHEN c3 = 'FATAL' THEN 'issue_number_conflict:FATAL' END, 'volume_conflict:' || c4], lambda x: x IS NOT NULL), ',') AS conflicts FROM ev""",
    "A2_tier": f"{DECIDED} SELECT file_id, pool_pos, level, {_ACTION} AS action, critical FROM ev",
    "A4_pool_decision": f"""{DECIDED} SELECT file_id, provider, issue_id, series_name, issue_number, publication_year, score, second_best, score - second_best AS margin, ambiguous, level, {_ACTION} AS action, critical, n_candidates FROM dec""",
}


def _of(dataset: str, *columns: str) -> str:
    return f"WITH {duck(dataset)} SELECT {', '.join(columns)} FROM {dataset}"


_ARC = lambda x: squeeze(rep(f"lower(coalesce({x}, ''))", "[\"''():]", " "))
_SHOWN = lambda x: f"""regexp_replace(regexp_replace(trim(coalesce({x}, '')), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')"""
_BASE_NAME = "string_split(path, '/')[-1]"
_NUMBER_RE = "^([0-9]+(?:[.][0-9]+)?)([a-zA-Z]*)$"
_SPECIALS = "special|giant|one-shot|oneshot|preview|fcbd"
_NAMED = "CASE WHEN starts_with(l, 'annual') THEN 10000 WHEN starts_with(l, 'special') THEN 10001 WHEN starts_with(l, 'tpb') THEN 10002 WHEN starts_with(l, 'hc') THEN 10003 WHEN starts_with(l, 'omnibus') THEN 10004 END"


def order_of(raw: str, source: str, keep: str) -> str:
    """A select with numeric, suffix and is_named of a raw number."""
    return f"""SELECT {keep}, CAST(CASE WHEN raw0 = '' THEN 99999 WHEN nm IS NOT NULL THEN nm WHEN regexp_extract(t, '^([0-9]+(?:[.][0-9]+)?)', 1) <> '' THEN CAST(regexp_extract(t, '^([0-9]+(?:[.][0-9]+)?)', 1) AS DOUBLE) ELSE 99998 END AS DOUBLE) AS numeric,
  CASE WHEN nm IS NULL THEN upper(regexp_extract(t, '{_NUMBER_RE}', 2)) ELSE '' END AS suffix, nm IS NOT NULL AS is_named
  FROM (SELECT *, {_NAMED} AS nm FROM (SELECT *, {raw} AS raw0, trim({raw}) AS t, lower(trim({raw})) AS l FROM {source}))"""


def issue_of(raw: str, source: str) -> str:
    return f"""SELECT *, CASE WHEN is_annual THEN 'Annual #' || CAST(first AS BIGINT) WHEN is_special THEN 'Special' WHEN half THEN '0.5' WHEN dg <> '' THEN CASE WHEN ltrim(dg, '0') = '' THEN '0' ELSE ltrim(dg, '0') END || lt ELSE t END AS clean,
  CAST(CASE WHEN is_annual THEN first WHEN is_special THEN 0 WHEN half THEN 0.5 WHEN dg <> '' THEN CAST(dg AS DOUBLE) ELSE 0 END AS DOUBLE) AS number,
  CASE WHEN NOT is_annual AND NOT is_special AND dg <> '' THEN lt ELSE '' END AS suffix
  FROM (SELECT *, contains(lower(t), 'annual') AS is_annual, NOT contains(lower(t), 'annual') AND regexp_matches(lower(t), '{_SPECIALS}') AS is_special, t IN ('½', '1/2') AS half,
    coalesce(TRY_CAST(regexp_extract(t, '([0-9]+)', 1) AS DOUBLE), 1) AS first, regexp_extract(t, '{_NUMBER_RE}', 1) AS dg, regexp_extract(t, '{_NUMBER_RE}', 2) AS lt
    FROM (SELECT *, trim({raw}) AS t FROM {source}))"""


_MONTHS = "['january','february','march','april','may','june','july','august','september','october','november','december']"


def _month(x: str) -> str:
    return f"coalesce(list_position({_MONTHS}, lower({x})), list_position([m[1:3] FOR m IN {_MONTHS}], lower({x})), 0)"


_D1, _D2, _D3 = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", r"^([A-Za-z]+)\s+([0-9]{1,2}),?\s+([0-9]{4})", r"^([A-Za-z]+),?\s+([0-9]{4})"
_X = lambda p, i: f"regexp_extract(day_text, '{p}', {i})"
_INT = lambda x: f"CAST({x} AS INT)"
_BATCH_NUM = "0*([0-9]+[a-zA-Z]?)"
_READ = f"{rep(rep(_BASE_NAME, chr(92) + '(.*?' + chr(92) + ')'), '(?i)vol(?:ume)?' + chr(92) + 's*[0-9]+')}"
_BARE = lambda x: f"CASE WHEN ltrim({x}, '0') = '' THEN '0' ELSE ltrim({x}, '0') END"


def reading_number(t: str) -> str:
    i, e, s = rf"regexp_extract({t}, '(?i)(?:issue|#)\s*([0-9]+[a-zA-Z]?)', 1)", rf"regexp_extract({t}, '(?i)[-_\s]([0-9]+)\.(?:cbz|cbr)$', 1)", f"regexp_extract({t}, '([0-9]+)', 1)"
    return rf"""CASE WHEN regexp_matches({t}, '½|1/2|0\.5') THEN '0.5' WHEN regexp_matches({t}, '(?i)(?:#|\b)(?:000|00|0)(?:\b|\.cbz|\.cbr)') THEN '0'
  WHEN regexp_matches({t}, '(?i)\b(?:tpb|os|one[\s-]*shot|gn|graphic novel|special)\b') THEN '1' WHEN {i} <> '' THEN {_BARE(i)} WHEN {e} <> '' THEN {_BARE(e)} WHEN {s} <> '' THEN {_BARE(s)} ELSE '' END"""


_KEYED = lambda src, number, year, keep: f"""SELECT {keep}, {key('series_name')} AS series_norm, numeric AS issue_numeric, suffix AS issue_suffix, is_named, trim(lower(volume)) AS volume_norm, {year} AS key_year, {key('publisher')} AS publisher_norm
  FROM ({order_of(number, src, '*')})"""  # noqa: E731

_RANGE = r"(?i)(.+?)\s*(?: issues?|,)?\s*#?([0-9]+)\s*[-–—]\s*([0-9]+)"
_SINGLE = r"(?i)(.+?)\s*(?: issue|,)?\s*#?([0-9]+[a-zA-Z]?|[0-9]+\.[0-9]+|½|1/2|0\.5)"
EXPANDED = f"""{duck("reading")},
ex0 AS (SELECT line_id, trim(line) AS t FROM reading WHERE trim(line) <> ''),
ex1 AS (SELECT *, regexp_matches(t, '{_RANGE}') AND CAST('0' || regexp_extract(t, '{_RANGE}', 2) AS INT) <= CAST('0' || regexp_extract(t, '{_RANGE}', 3) AS INT) AS is_range, regexp_matches(t, '{_SINGLE}') AS one FROM ex0),
ex2 AS (SELECT line_id, trim(CASE WHEN is_range THEN regexp_extract(t, '{_RANGE}', 1) WHEN one THEN regexp_extract(t, '{_SINGLE}', 1) ELSE t END) AS series, NOT is_range AND NOT one AS plain,
  CASE WHEN is_range THEN [CAST(n AS VARCHAR) FOR n IN range(CAST('0' || regexp_extract(t, '{_RANGE}', 2) AS INT), CAST('0' || regexp_extract(t, '{_RANGE}', 3) AS INT) + 1)]
       WHEN one THEN [regexp_extract(t, '{_SINGLE}', 2)] ELSE ['1'] END AS ns FROM ex1),
expanded AS (SELECT line_id, CAST(k - 1 AS INT) AS "at", series, ns[k] AS number, CASE WHEN plain THEN series ELSE series || ' #' || ns[k] END AS title FROM (SELECT *, unnest(range(1, len(ns) + 1)) AS k FROM ex2))"""

_PATH = lambda x: squeeze(rep(rep(f"lower({x})", "[-:/.]", " "), chr(92) + "b(?:vs|versus)" + chr(92) + "b", " "))
_STOP = "('', 'the', 'a', 'an', 'of', 'and')"
FILES_OF = rf"""{EXPANDED}, {duck("lib_files")},
en AS (SELECT series, number, {_PATH("series")} AS ef FROM (SELECT DISTINCT series, number FROM expanded)),
en2 AS (SELECT *, regexp_extract(ef, '([0-9]+)$', 1) AS dg, trim(regexp_replace(ef, '[0-9]+$', '')) AS base, CASE WHEN regexp_extract(number, '([0-9]+)', 1) = '' THEN '' ELSE {_BARE("regexp_extract(number, '([0-9]+)', 1)")} END AS tn FROM en),
fi AS (SELECT DISTINCT path, {_BASE_NAME} AS nm, {_PATH("path")} AS pf, {reading_number(_READ)} AS rn FROM lib_files),
sm AS (SELECT * FROM (SELECT DISTINCT ef, dg, base FROM en2) JOIN (SELECT DISTINCT pf FROM fi) ON len([w FOR w IN string_split(ef, ' ') IF w NOT IN {_STOP}]) > 0 AND CASE WHEN dg <> '' THEN
   len([w FOR w IN string_split(base, ' ') IF w NOT IN {_STOP} AND NOT contains(pf, w)]) = 0 AND (contains(pf, ' ' || dg || ' ') OR contains(pf, ' 0' || dg || ' ') OR contains(pf, 'volume 0' || dg) OR contains(pf, 'volume ' || dg)
     OR contains(pf, 'v0' || dg) OR contains(pf, 'v' || dg) OR contains(pf, base || ' ' || dg) OR contains(pf, base || ' 0' || dg))
   ELSE len([w FOR w IN string_split(ef, ' ') IF w NOT IN {_STOP} AND NOT contains(pf, w)]) = 0 END),
hits AS (SELECT series, number, min(path) AS path FROM en2 JOIN sm USING (ef) JOIN fi USING (pf) WHERE (rn <> '' AND number <> '' AND ltrim(rn, '0') = ltrim(number, '0')) OR (tn <> '' AND (
   regexp_matches(nm, '(?i)issue\s*0*' || tn || '\b') OR regexp_matches(nm, '#\s*0*' || tn || '\b') OR regexp_matches(nm, '(?i)\b0*' || tn || '\.(?:cbz|cbr)$')
   OR regexp_matches(nm, '(?i)vol(?:ume)?\s*[0-9]+\s+issue\s+0*' || tn || '\b') OR regexp_matches(nm, '(?i)v[0-9]+\s+0*' || tn || '\b'))) GROUP BY 1, 2)"""

_LIST = lambda x: f"[trim(p) FOR p IN string_split(coalesce({x}, ''), ',') IF trim(p) <> '']"


def tags(blank: str) -> str:
    """Rows (id, pos, i, arc, num) of the arcs table's cleaned lists."""
    return f"""{duck("arcs")},
tz AS (SELECT id, pos, i, a[i] AS arc, coalesce(n[i], '') AS num FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT id, pos, {_LIST("arcs")} AS a, {_LIST("nums")} AS n FROM arcs))),
tg AS (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY i) AS i, {_SHOWN("arc")} AS arc, CASE WHEN num = '' THEN {blank} ELSE num END AS num
  FROM (SELECT *, {_ARC("arc")} AS f FROM tz) WHERE f <> '' QUALIFY row_number() OVER (PARTITION BY id, f ORDER BY i) = 1)"""


def arc_match(expected: str, actual: str) -> str:
    e, a = _ARC(expected), _ARC(actual)
    return f"({actual} <> '' AND {e} <> '' AND {a} <> '' AND (contains({a}, {e}) OR contains({e}, {a}) OR len([w FOR w IN string_split({e}, ' ') IF length(w) > 3 AND contains({a}, w)]) > 0))"


_TOLD = "SELECT arcs.id, coalesce(string_agg(arc || '=' || num, '|' ORDER BY i), '') AS tags FROM arcs LEFT JOIN {} USING (id) GROUP BY 1"
_MEM = duck("members")
_LISTS = ["writers", "pencillers", "inkers", "colorists", "letterers", "cover_artists", "characters", "teams", "story_arcs", "story_arc_numbers"]


def united(name: str, form: str) -> str:
    """`name`(collection_id, l_<list>...): ordered unions of the members' lists, items equal by `form`."""
    rows = " UNION ALL ".join(f"SELECT collection_id, pos, '{k}' AS kind, string_split({k}, ';') AS w FROM members" for k in _LISTS)
    picked = ", ".join(f"string_agg(item, ';' ORDER BY pos, i) FILTER (kind = '{k}') AS l_{k}" for k in _LISTS)
    return f"""{name}_i AS (SELECT collection_id, pos, kind, i, w[i] AS item FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM ({rows}))),
{name} AS (SELECT collection_id, {picked} FROM (SELECT *, {form} AS f FROM {name}_i WHERE {form} <> '' QUALIFY row_number() OVER (PARTITION BY collection_id, kind, f ORDER BY pos, i) = 1) GROUP BY 1)"""


def merged_simple(members: str) -> str:
    return rf"""WITH {members}, {united("lists", "item")},
g AS (SELECT collection_id, arg_min(series_name, pos) AS series, arg_min(publisher, pos) AS publisher, CAST(count(*) AS INT) AS count, list(issue_number ORDER BY pos) FILTER (issue_number <> '') AS ns,
  list(title ORDER BY pos) FILTER (title <> '') AS ts, min([year, greatest(month, 1), greatest(day, 1), pos, month, day]) FILTER (year > 0) AS d, coalesce(string_agg(web, ', ' ORDER BY pos) FILTER (web <> ''), '') AS web,
  coalesce(string_agg('--- ' || CASE WHEN issue_number <> '' THEN 'Issue #' || issue_number ELSE title END || ' ---' || chr(10) || summary, chr(10) || chr(10) ORDER BY pos) FILTER (summary <> ''), '') AS summary,
  arg_min({{'n': issue_number, 't': title, 'y': year, 'm': month, 'd': day, 's': summary, 'g': genre, 'l': language, {", ".join(f"'{k}': {k}" for k in _LISTS)}}}, pos) AS one FROM members GROUP BY 1),
h AS (SELECT *, CASE WHEN ns IS NULL THEN '' WHEN len([n FOR n IN ns IF NOT regexp_full_match(n, '[0-9]+')]) > 0 THEN array_to_string(ns, ', ') WHEN len(ns) > 1 THEN list_min([CAST(n AS BIGINT) FOR n IN ns IF regexp_full_match(n, '[0-9]+')]) || '-' || list_max([CAST(n AS BIGINT) FOR n IN ns IF regexp_full_match(n, '[0-9]+')]) ELSE CAST(CAST(ns[1] AS BIGINT) AS VARCHAR) END AS many FROM g)
SELECT collection_id, series, publisher, count, CASE WHEN count = 1 THEN one.n ELSE many END AS number, CASE WHEN count = 1 THEN one.t WHEN ts IS NULL THEN '' WHEN series <> '' THEN series || ' #' || many ELSE array_to_string(ts, ' / ') END AS title,
  CASE WHEN count = 1 THEN one.y ELSE coalesce(d[1], 0) END AS year, CASE WHEN count = 1 THEN one.m ELSE coalesce(d[5], 0) END AS month, CASE WHEN count = 1 THEN one.d ELSE coalesce(d[6], 0) END AS day, web, CASE WHEN count = 1 THEN one.s ELSE summary END AS summary,
  one.g AS genre, one.l AS language, CASE WHEN count = 1 THEN '' ELSE 'Trade Paperback' END AS format, {", ".join(f"CASE WHEN count = 1 THEN one.{k} ELSE coalesce(l_{k}, '') END AS {k}" for k in _LISTS)} FROM h LEFT JOIN lists USING (collection_id)"""


_ORD = f"mo AS ({order_of('issue_number', 'members', '*')})"
_CR = duck("cache_rows")
_LATEST_CACHE = "lc AS (SELECT * FROM cache_rows QUALIFY row_number() OVER (PARTITION BY provider, kind, cache_key ORDER BY updated_at DESC) = 1)"
_OUT = "count(*) FILTER ({0} IN ('SUCCESS', 'COMPLETED')) AS resolved, count(*) FILTER ({0} = 'SKIPPED') AS skipped, count(*) FILTER ({0} = 'UNRESOLVED') AS unresolved, count(*) FILTER ({0} = 'FAILED') AS failed, count(*) FILTER ({0} = 'REVIEW') AS review"

ORACLES |= {
    "F10_title_form": _of("candidates", "file_id", "pool_pos", f"{title('series_name')} AS form"),
    "F11_key_form": _of("candidates", "file_id", "pool_pos", f"{key('series_name')} AS form"),
    "F12_collection_form": _of("members", "collection_id", "pos", f"trim({rep('lower(series_name)', '[^a-z0-9 ]')}) AS series", "trim(lower(publisher)) AS publisher_norm"),
    "F13_issue_number": f"WITH {duck('numbers')} SELECT id, clean, number, suffix, is_annual, is_special FROM ({issue_of('raw', 'numbers')})",
    "F14_same_issue": f"""WITH {duck('numbers')}, k AS ({issue_of('raw', 'numbers')})
SELECT a.id, CASE WHEN a.t = '' OR b.t = '' THEN FALSE WHEN a.is_annual AND b.is_annual THEN a.number = b.number WHEN a.is_special AND b.is_special THEN TRUE
  ELSE lower(a.clean) = lower(b.clean) OR (a.number = b.number AND lower(a.suffix) = lower(b.suffix)) END AS same FROM k a JOIN k b ON b.id = a.id + 1""",
    "F15_issue_order": f"WITH {duck('numbers')} {order_of('raw', 'numbers', 'id')}",
    "F16_canonical_key": f"WITH {duck('candidates')} {_KEYED('candidates', 'issue_number', 'publication_year', 'file_id, pool_pos')}",
    "F17_batch_number": rf"""WITH {duck('lib_files')}, a AS (SELECT file_id, regexp_replace({_BASE_NAME}, '(?i)\.(cbz|cbr|zip|rar)$', '') AS t FROM lib_files),
b AS (SELECT *, {rep(rep('t', chr(40) + '?i)' + chr(92) + 'bv[0-9]+' + chr(92) + 'b'), chr(92) + 'b(?:19|20)[0-9]{2}' + chr(92) + 'b')} AS rest, regexp_extract(t, '(?i)\bissue\s*#?\s*{_BATCH_NUM}', 1) AS i, regexp_extract(t, '#\s*{_BATCH_NUM}', 1) AS h FROM a)
SELECT file_id, CASE WHEN regexp_matches(t, '(?i)(?:issue\s*#?|#|\b)0*(?:½|1/2|0\.5)\b') OR regexp_matches(t, '½|1/2') THEN '0.5' WHEN regexp_matches(t, '(?i)\bissue\s*#?\s*0+(?:[^0-9]|$)') OR regexp_matches(t, '#\s*0+(?:[^0-9]|$)') THEN '0'
  WHEN i <> '' THEN i WHEN h <> '' THEN h WHEN regexp_matches(rest, '\b0+(?:[^0-9]|$)') THEN '0' ELSE regexp_extract(rest, '0*([0-9]+)\b', 1) END AS number FROM b""",
    "F18_reading_number": _of("lib_files", "file_id", f"{reading_number(_READ)} AS number"),
    "F19_date_parts": f"""WITH {duck('urls')} SELECT id,
  CASE WHEN regexp_matches(day_text, '{_D1}') THEN {_INT(_X(_D1, 1))} WHEN regexp_matches(day_text, '{_D2}') THEN {_INT(_X(_D2, 3))} WHEN regexp_matches(day_text, '{_D3}') THEN {_INT(_X(_D3, 2))} ELSE coalesce(TRY_CAST(regexp_extract(day_text, '((?:19|20)[0-9]{{2}})', 1) AS INT), 0) END AS year,
  CAST(CASE WHEN regexp_matches(day_text, '{_D1}') THEN {_INT(_X(_D1, 2))} WHEN regexp_matches(day_text, '{_D2}') THEN {_month(_X(_D2, 1))} WHEN regexp_matches(day_text, '{_D3}') THEN {_month(_X(_D3, 1))} ELSE 0 END AS INT) AS month,
  CASE WHEN regexp_matches(day_text, '{_D1}') THEN {_INT(_X(_D1, 3))} WHEN regexp_matches(day_text, '{_D2}') THEN {_INT(_X(_D2, 2))} ELSE 0 END AS day FROM urls""",
    "F20_route": _of("urls", "id", "CASE WHEN starts_with(url, 'http://kap.local') THEN 'Kapowarr' WHEN contains(lower(url), 'comics.org') OR regexp_matches(url, 'Grand Comics Database|Indexer notes|Pencils:|Script:') THEN 'GCP' ELSE 'ComicVine' END AS source"),
    "F21_provider_id": _of("urls", "id", "CASE WHEN regexp_extract(url, '(40(?:00|50|45)-[0-9]+)', 1) <> '' THEN regexp_extract(url, '(40(?:00|50|45)-[0-9]+)', 1) ELSE regexp_extract(url, '/(?:issue|series)/([0-9]+)', 1) END AS provider_id"),
    "F22_creator_form": _of("urls", "id", rf"trim({rep(rep(rep('creator', chr(92) + '([^)]*' + chr(92) + ')'), chr(92) + '(.*$'), chr(92) + '?')}) AS form"),
    "F23_volume_slug": _of("urls", "id", "CASE WHEN regexp_extract(url, '/([^/]+)/4050-[0-9]+', 1) = 'volume' THEN '' ELSE regexp_extract(url, '/([^/]+)/4050-[0-9]+', 1) END AS slug"),
    "F24_arc_form": _of("arcs", "id", f"{_ARC('arcs')} AS form", f"{_SHOWN('arcs')} AS shown"),
    "F25_provider_alias": _of("calls", "call_id", "CASE lower(provider) WHEN 'kap' THEN 'kapowarr' WHEN 'comic_vine' THEN 'comicvine' ELSE lower(provider) END AS name"),
    "F26_mask_secret": _of("urls", "id", *[f"CASE WHEN {x} = '' THEN '<not set>' WHEN length({x}) <= 8 THEN '********' ELSE left({x}, 4) || '...' || right({x}, 4) END AS {n}" for x, n in (("day_text", "masked"), ("creator", "creator_masked"))]),
    "F27_redact": _of("urls", "id", rf"regexp_replace(url, '(?i)\b(api_key|apikey|key|token|password|secret|auth)=[^&\s]+', '\1=REDACTED', 'g') AS shown"),
    "F29_url_list": _of("urls", "id", "array_to_string([x FOR x IN string_split_regex(trim(concat_ws(' ', url, day_text, url)), '[\\s,]+') IF starts_with(x, 'http')], '|') AS urls"),
    "F30_http_state": _of("calls", "call_id", "CASE WHEN http_status = 429 THEN 'RATE_LIMITED' WHEN http_status IN (500, 502, 503, 504) THEN 'SERVER_ERROR' WHEN http_status = 404 THEN 'NOT_FOUND' WHEN http_status IN (401, 403) THEN 'AUTH_ERROR' WHEN http_status IN (400, 422) THEN 'BAD_REQUEST' WHEN http_status BETWEEN 200 AND 299 THEN 'OK' ELSE 'UNKNOWN_ERROR' END AS state", "http_status IN (429, 500, 502, 503, 504) AS retryable"),
    "F33_target_path": _of("lib_files", "file_id", r"regexp_replace(path, '(?i)\.cbr$', '.cbz') AS target", "suffix(lower(path), '.cbr') AS is_cbr"),
    "F34_identity_type": f"WITH {PARSED} SELECT file_id, CASE WHEN is_tpb THEN 'TPB' WHEN is_annual THEN 'Annual' ELSE 'Issue' END AS identity_type FROM parsed",
    "L5_split_list": _of("arcs", "id", "array_to_string([trim(x) FOR x IN string_split_regex(arcs, '[,;]') IF trim(x) <> ''], '|') AS items"),
    "P1_archive_extension": _of("lib_files", "file_id", "lower(path) LIKE '%.cbz' OR lower(path) LIKE '%.cbr' AS is_archive"),
    "P4_range_listing": _of("reading", "line_id", r"regexp_matches(line, '#[0-9]+\s*[-–][0-9]+|\([0-9]+-[0-9]+\)') AS is_range"),
    "P5_live_cache": f"WITH {_CR} SELECT provider, kind, cache_key, updated_at FROM cache_rows WHERE schema_version = '2' AND expires_at > 1250",
    "P7_arc_match": f"WITH {duck('arcs')} SELECT id, {arc_match(chr(39) + 'The ' + chr(34) + 'Dark' + chr(34) + ' Age' + chr(39), 'arcs')} AS matches FROM arcs",
    "P10_input_quarantine": f"WITH {duck('urls')} SELECT id, reason, reason = '' AS good FROM (SELECT id, CASE WHEN length(trim(url)) = 0 THEN 'empty' WHEN length(trim(url)) > 250 THEN 'too long' WHEN NOT regexp_matches(trim(url), '^https?://[^/]+') THEN 'scheme' ELSE '' END AS reason FROM urls)",
    "P11_active_jobs": f"WITH {duck('leases')} SELECT job_id, status FROM leases WHERE status IN ('PENDING', 'RUNNING', 'RETRYING')",
    "J1_title_pairs": f"WITH {PARSED}, {duck('candidates')}, a AS (SELECT DISTINCT {title('series_name')} AS l FROM parsed), b AS (SELECT DISTINCT {title('series_name')} AS r FROM candidates) SELECT l, r FROM a, b WHERE l <> '' AND r <> '' AND (starts_with(l, r) OR starts_with(r, l))",
    "J2_canonical_match": f"""WITH {PARSED}, {duck('candidates')}, a AS ({_KEYED('parsed', 'issue_number', 'year', 'file_id')}), b AS ({_KEYED('candidates', 'issue_number', 'publication_year', 'file_id * 10 + pool_pos AS file_id')})
SELECT a.file_id AS left_id, b.file_id AS right_id FROM a JOIN b ON a.issue_numeric = b.issue_numeric AND a.issue_suffix = b.issue_suffix AND a.is_named = b.is_named AND (a.series_norm = '' OR b.series_norm = '' OR a.series_norm = b.series_norm)
  AND (a.volume_norm = '' OR b.volume_norm = '' OR a.volume_norm = b.volume_norm) AND (a.key_year <= 0 OR b.key_year <= 0 OR abs(a.key_year - b.key_year) <= 1)""",
    "J3_agreement": f"{DECIDED} SELECT file_id, pool_pos, CAST(n_agree AS INT) AS n_agree FROM s1",
    "J4_disagreement": f"{DECIDED} SELECT file_id, CAST(k AS BIGINT) AS n FROM dis WHERE k > 0",
    "J5_existing_vs_file": f"{DECIDED} SELECT file_id, n_xf AS n FROM s1 WHERE pool_pos = 3",
    "J6_existing_vs_candidate": f"{DECIDED} SELECT file_id, pool_pos, n_xp AS n FROM s1",
    "J7_issue_files": f"""WITH {PARSED}, {duck('candidates')}, f AS (SELECT {title('series_name')} AS s, ltrim(issue_number, '0') AS n, min(path) AS path FROM parsed GROUP BY 1, 2)
SELECT series_name, issue_number, coalesce(path, '') AS path FROM (SELECT DISTINCT {title('series_name')} AS s, ltrim(issue_number, '0') AS n, series_name, issue_number FROM candidates) LEFT JOIN f USING (s, n)""",
    "J10_changed_files": f"WITH {duck('seen_files')}, {duck('known_files')}, k AS (SELECT * FROM known_files QUALIFY row_number() OVER (PARTITION BY path ORDER BY updated_at DESC) = 1) SELECT seen_id, path FROM seen_files s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.path = s.path AND k.size = s.size AND k.mtime = s.mtime AND k.sha256 = s.sha256)",
    "J11_job_dedup": f"WITH {duck('seen_files')}, {duck('leases')}, act AS (SELECT path, sha256 FROM leases WHERE status IN ('PENDING', 'RUNNING', 'RETRYING')) SELECT seen_id, path, sha256 FROM seen_files s WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.path = s.path AND (s.sha256 = '' OR act.sha256 = s.sha256)) QUALIFY row_number() OVER (PARTITION BY path, sha256 ORDER BY seen_id) = 1",
    "J12_manifest_diff": f"""WITH {duck('manifest')}, {duck('manifest_new')}, a AS (SELECT archive, lower(entry) AS entry, crc, size, sha256 FROM manifest WHERE lower(entry) <> 'comicinfo.xml'), b AS (SELECT archive, lower(entry) AS entry, crc, size, sha256 FROM manifest_new WHERE lower(entry) <> 'comicinfo.xml')
SELECT coalesce(a.archive, b.archive) AS archive, coalesce(a.entry, b.entry) AS entry, CASE WHEN b.crc IS NULL THEN 'missing' WHEN a.crc IS NULL THEN 'extra' WHEN a.crc <> b.crc OR a.size <> b.size THEN 'changed_size' WHEN a.sha256 <> b.sha256 THEN 'changed_hash' ELSE 'same' END AS status
FROM a FULL JOIN b ON a.archive = b.archive AND a.entry = b.entry""",
    "J13_uncovered_folders": f"WITH {duck('lib_files')}, {duck('existing')} SELECT DISTINCT string_split(path, '/')[-2] AS folder FROM lib_files EXCEPT SELECT series || ' (' || year || ')' FROM existing",
    "J15_cache_lookup": f"""WITH {_CR}, {_LATEST_CACHE}, best AS (SELECT kind, cache_key, provider AS hit_provider, data_json FROM lc WHERE schema_version = '2' AND expires_at > 1250 AND data_json LIKE '%"series_name":"_%' QUALIFY row_number() OVER (PARTITION BY kind, cache_key ORDER BY provider = 'Kapowarr' DESC) = 1)
SELECT kind, ' ' || upper(cache_key) AS cache_key, hit_provider, data_json FROM (SELECT DISTINCT kind, cache_key FROM cache_rows) LEFT JOIN best USING (kind, cache_key)""",
    "J9_reading_files": f"WITH {FILES_OF} SELECT * FROM hits",
    "A10_reading_coverage": f"WITH {FILES_OF} SELECT count(*) AS total, count(path) AS found, count(*) FILTER (lower(path) LIKE '%.cbz') AS tagged, count(*) FILTER (path IN (SELECT path FROM lib_files WHERE file_id % 4 = 0)) AS arc_tagged, count(*) FILTER (path IS NULL) AS missing FROM expanded LEFT JOIN hits USING (series, number)",
    "A5_list_union": f"""WITH {_MEM}, i AS (SELECT collection_id, pos, k, w[k] AS item FROM (SELECT collection_id, pos, w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT collection_id, pos, string_split(writers, ';') AS w FROM members))),
f AS (SELECT * FROM i WHERE trim(item) <> '' QUALIFY row_number() OVER (PARTITION BY collection_id, trim(lower(item)) ORDER BY pos, k) = 1) SELECT collection_id, string_agg(item, '|' ORDER BY pos, k) AS items FROM f GROUP BY 1""",
    "A6_merge_simple": merged_simple(_MEM),
    "A7_merge_policy": rf"""WITH {_MEM}, {_ORD},
ov AS (SELECT o_orderkey AS collection_id, CASE WHEN o_orderkey % 12 = 0 THEN o_orderpriority ELSE '' END AS ot, CASE WHEN o_orderkey % 18 = 0 THEN 1999 ELSE 0 END AS oy, CASE WHEN o_orderkey % 30 = 0 THEN 'oid' ELSE '' END AS oi, o_orderkey % 12 = 0 AS k, o_orderkey % 6 = 0 AS o FROM orders),
{united("lists", "trim(lower(item))")},
g AS (SELECT collection_id, arg_min(series_name, pos) AS series, arg_min(publisher, pos) AS fp, CAST(count(*) AS INT) AS count, list(issue_number ORDER BY numeric, suffix, pos) FILTER (issue_number <> '') AS ns,
  min([year, greatest(month, 1), greatest(day, 1), pos, month, day]) FILTER (year > 0) AS d, coalesce(string_agg(web, ', ' ORDER BY pos) FILTER (web <> ''), '') AS web,
  coalesce(string_agg('--- Issue #' || issue_number || ' ---' || chr(10) || summary, chr(10) || chr(10) ORDER BY pos) FILTER (summary <> ''), '') AS summary,
  string_agg(notes, chr(10) ORDER BY pos) FILTER (notes <> '') AS notes, arg_min(provider_id, pos) FILTER (provider_id <> '') AS pid, arg_min(genre, pos) AS genre, arg_min(language, pos) AS language FROM mo GROUP BY 1),
h AS (SELECT g.*, coalesce(ot, '') AS ot, coalesce(oy, 0) AS oy, coalesce(oi, '') AS oi, coalesce(k, FALSE) AS k, coalesce(o, FALSE) AS o, CASE WHEN len(ns) > 1 THEN ns[1] || '-' || ns[-1] ELSE ns[1] END AS span FROM g LEFT JOIN ov USING (collection_id))
SELECT collection_id, series, count, CASE WHEN ot <> '' THEN ot ELSE series || ' #' || span END AS title, CASE WHEN ot <> '' THEN '' ELSE span END AS number, CASE WHEN k THEN 'Kap' ELSE fp END AS publisher,
  CASE WHEN oy > 0 THEN 1999 ELSE coalesce(d[1], 0) END AS year, CASE WHEN oy > 0 THEN 5 ELSE coalesce(d[5], 0) END AS month, CASE WHEN oy > 0 THEN 0 ELSE coalesce(d[6], 0) END AS day, summary,
  coalesce(concat_ws(chr(10), CASE WHEN o THEN 'own' END, notes), '') AS notes, web, CASE WHEN oi <> '' THEN oi ELSE coalesce(pid, '') END AS provider_id,
  concat_ws(',', 'series=first_issue', CASE WHEN ot <> '' THEN 'title=collection_override' ELSE 'title=generated_range' END, CASE WHEN k THEN 'publisher=Kapowarr' WHEN fp <> '' THEN 'publisher=first_issue_provider' END,
    CASE WHEN oy > 0 THEN 'year=collection_override' WHEN d IS NOT NULL THEN 'year=earliest_issue' END, 'summary=issue_union', 'web=issue_urls_joined', {", ".join(f"'{k}=issue_union_dedup'" for k in _LISTS if k not in ("teams", "story_arc_numbers"))}, CASE WHEN oi <> '' THEN 'provider_id=collection_override' WHEN pid IS NOT NULL THEN 'provider_id=first_issue' END) AS provenance,
  genre, CASE WHEN language = '' THEN 'en' ELSE language END AS language, 'Trade Paperback' AS format, {", ".join(f"coalesce(l_{k}, '') AS {k}" for k in _LISTS if k != "story_arc_numbers")} FROM h LEFT JOIN lists USING (collection_id)""",
    "A8_collection_validation": f"""WITH {_MEM}, {_ORD},
b AS (SELECT collection_id, count(*) FILTER (n > 1 AND s = 1) AS repeated, count(*) FILTER (s > 1) AS variants FROM (SELECT collection_id, numeric, count(*) AS n, count(DISTINCT issue_number) AS s FROM mo GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT collection_id, count(DISTINCT trim({rep('lower(series_name)', '[^a-z0-9 ]')})) AS series, count(DISTINCT trim(lower(publisher))) FILTER (publisher <> '') AS pubs, count(DISTINCT volume_id) FILTER (volume_id <> '') AS vols, string_agg(issue_number, ',' ORDER BY numeric, suffix, pos) AS sorted_numbers FROM mo GROUP BY 1),
r AS (SELECT *, CAST((series > 1)::INT + (vols > 1)::INT + repeated AS INT) AS n_problems, CAST((pubs > 1)::INT + variants AS INT) AS n_warnings FROM w JOIN b USING (collection_id))
SELECT collection_id, CASE WHEN n_problems > 0 THEN 'REJECT' WHEN n_warnings > 0 THEN 'WARN' ELSE 'ACCEPT' END AS result, n_problems, n_warnings, sorted_numbers FROM r""",
    "A9_library_status": f"""WITH {duck('lib_files')}, {duck('existing')}, p AS (SELECT string_split(path, '/')[-2] AS folder, count(*) AS t, count(*) FILTER (lower(path) LIKE '%.cbz' AND file_id % 3 <> 0) AS g FROM lib_files GROUP BY 1),
v AS (SELECT series || ' (' || year || ')' AS folder, count(*) AS n FROM existing GROUP BY 1), j AS (SELECT folder, coalesce(t, 0) AS total, coalesce(g, 0) AS tagged, CASE WHEN t IS NULL THEN coalesce(n, 0) ELSE t - coalesce(g, 0) END AS missing, n IS NOT NULL AS in_catalog FROM p FULL JOIN v USING (folder))
SELECT folder, total, tagged, missing, missing > 0 AS has_missing, total > 0 AND missing = 0 AS is_complete, in_catalog, tagged || '/' || total || ' Tagged (' || missing || ' Missing)' AS label FROM j""",
    "A11_job_metrics": f"WITH {duck('jobs')} SELECT job_id, count(*) AS total, {_OUT.format('status')}, round(coalesce(avg(value), 0), 1) AS avg_duration FROM jobs GROUP BY 1",
    "A12_provider_metrics": f"WITH {duck('calls')} SELECT provider, count(*) AS calls, count(*) FILTER (http_status >= 400) AS failures, round(avg(ms), 1) AS avg_ms, round(CASE WHEN count(*) FILTER (cache_lookup) > 0 THEN 100.0 * count(*) FILTER (cache_lookup AND cache_hit) / count(*) FILTER (cache_lookup) ELSE 0.0 END, 1) AS hit_rate FROM calls GROUP BY 1",
    "A13_cache_stats": f"WITH {_CR} SELECT kind, count(*) AS rows, count(*) FILTER (expires_at > 0 AND expires_at < 1250) AS expired FROM cache_rows GROUP BY 1",
    "A14_resolution_rates": f"{DECIDED} SELECT count(*) AS items, round(100.0 * count(*) FILTER (level = 'AUTO_ACCEPT') / count(*), 2) AS auto_accept, round(100.0 * count(*) FILTER (level = 'MANUAL_REVIEW') / count(*), 2) AS review, round(100.0 * count(*) FILTER (level = 'UNRESOLVED') / count(*), 2) AS unresolved, round(100.0 * count(*) FILTER (level IN ('AUTO_ACCEPT', 'ACCEPT_WITH_WARNING') AND issue_number = '99') / count(*), 2) AS false_positive, round(count(*) / 60.0, 1) AS items_per_second FROM dec",
    "W1_ranked_pool": f"{DECIDED} SELECT file_id, pool_pos, CAST(rk AS INT) AS rank FROM ev",
    "W4_first_per_provider": f"WITH {duck('calls')} SELECT provider, min(call_id) AS call_id FROM calls GROUP BY 1",
    "W5_reading_position": f"WITH {FILES_OF} SELECT * FROM (SELECT series, line_id, \"at\", number, CAST(row_number() OVER (PARTITION BY series ORDER BY line_id, \"at\") AS INT) AS arc_number FROM expanded) SEMI JOIN hits USING (series, number)",
    "W6_latest_row": f"WITH {duck('known_files')} SELECT path, max(updated_at) AS updated_at, arg_max(status, updated_at) AS status FROM known_files GROUP BY 1",
    "W7_oldest_job": f"WITH {duck('leases')} SELECT path, job_id FROM leases WHERE status IN ('PENDING', 'RETRYING') QUALIFY row_number() OVER (PARTITION BY path ORDER BY created_at, job_id) = 1",
    "O1_natural_order": f"WITH {_MEM}, {_ORD} SELECT collection_id, string_agg(issue_number, ',' ORDER BY numeric, suffix, pos) AS numbers FROM mo GROUP BY 1",
    "O2_digits_order": _of("numbers", "id", f"coalesce(TRY_CAST({rep('raw', '[^0-9]')} AS BIGINT), 0) AS place"),
    "O3_newest_jobs": f"WITH {duck('leases')} SELECT job_id, created_at FROM leases WHERE status = 'FAILED' ORDER BY created_at DESC, job_id LIMIT 100",
    "U1_candidate_pool": f"WITH {PARSED}, {duck('candidates')} SELECT file_id, 0 AS pool_pos, 'Filename' AS provider, series_name, issue_number FROM parsed UNION ALL SELECT file_id, pool_pos, provider, series_name, issue_number FROM candidates",
    "U3_entry_difference": f"WITH {duck('manifest')}, {duck('manifest_new')} SELECT archive, lower(entry) AS entry FROM manifest EXCEPT ALL SELECT archive, lower(entry) FROM manifest_new",
    "L1_range_expansion": f"WITH {EXPANDED} SELECT line_id, \"at\", series, number, title FROM expanded",
    "L2_tag_list": f"WITH {tags(chr(39) + '1' + chr(39))} {_TOLD.format('tg')}",
    "L3_arc_upsert": f"""WITH {tags('CAST(pos AS VARCHAR)')}, m AS (SELECT id, min(i) AS mi FROM tg WHERE {arc_match("'Night One'", 'arc')} GROUP BY 1),
z AS (SELECT id, i, CASE WHEN i = mi THEN 'Night One' ELSE arc END AS arc, CASE WHEN i = mi THEN CAST(pos AS VARCHAR) ELSE num END AS num FROM tg LEFT JOIN m USING (id) UNION ALL SELECT id, 999, 'Night One', CAST(pos AS VARCHAR) FROM arcs WHERE id NOT IN (SELECT id FROM m)) {_TOLD.format('z')}""",
    "L4_arc_rename": f"""WITH {tags(chr(39) + '1' + chr(39))}, m AS (SELECT id, min(i) AS mi FROM tg WHERE {arc_match("'night one'", 'arc')} GROUP BY 1), z AS (SELECT id, i, CASE WHEN i = mi THEN 'Dawn' ELSE arc END AS arc, num FROM tg LEFT JOIN m USING (id)) {_TOLD.format('z')}""",
    "M1_cache_upsert": f"""WITH {_CR}, n AS (SELECT DISTINCT provider, kind, cache_key FROM cache_rows WHERE updated_at % 5 = 0), {_LATEST_CACHE}
SELECT provider, kind, cache_key, 'new' AS data_json, CAST(1250 AS BIGINT) AS updated_at, CAST(1250 + CASE kind WHEN 'issue' THEN 604800 WHEN 'series' THEN 604800 WHEN 'search' THEN 86400 ELSE 43200 END AS BIGINT) AS expires_at, '3' AS schema_version FROM n
UNION ALL SELECT provider, kind, cache_key, data_json, updated_at, CAST(expires_at AS BIGINT), schema_version FROM lc ANTI JOIN n USING (provider, kind, cache_key)""",
    "M2_cache_invalidate": f"WITH {_CR}, k AS (SELECT DISTINCT provider, kind, cache_key FROM cache_rows WHERE updated_at % 7 = 0) SELECT provider, kind, cache_key, updated_at, CAST(CASE WHEN (provider, kind, cache_key) IN (SELECT (provider, kind, cache_key) FROM k) THEN 0 ELSE expires_at END AS BIGINT) AS expires_at FROM cache_rows",
    "M3_cache_purge": f"WITH {_CR} SELECT provider, kind, cache_key, updated_at FROM cache_rows WHERE NOT (expires_at > 0 AND expires_at < 1250)",
    "M4_stale_versions": f"WITH {_CR} SELECT provider, kind, cache_key, updated_at FROM cache_rows WHERE schema_version = '2'",
    "M7_expired_leases": f"WITH {duck('leases')} SELECT job_id, CASE WHEN status = 'RUNNING' AND lease_until < 500 THEN CASE WHEN attempts >= max_attempts THEN 'FAILED' ELSE 'RETRYING' END ELSE status END AS status, CASE WHEN status = 'RUNNING' AND lease_until < 500 AND attempts >= max_attempts THEN 'MAX_ATTEMPTS_EXCEEDED' ELSE '' END AS error_code FROM leases",
}


def _existing_ev() -> str:
    """Embedded records scored against their files: xs1."""
    return rf"""
xe AS (SELECT f.file_id, CASE WHEN x.series <> '' THEN x.series ELSE x.title END AS s, x.number AS n, x.year AS y, regexp_extract(x.web, 'comicvine\.gamespot\.com/.*?/4000-([0-9]+)', 1) AS web_id,
  f.series_name AS fs, f.issue_number AS fn, suffix(lower(f.path), '.cbz') AS zipped, f.year AS fy, f.is_tpb AS ft, {title("CASE WHEN x.series <> '' THEN x.series ELSE x.title END")} AS t, {title("f.series_name")} AS tt FROM existing x JOIN parsed f USING (file_id)),
xs0 AS (SELECT *, greatest(0, least(100, 100 + CASE WHEN n = '' OR fn = '' THEN 0 WHEN ltrim(n, '0') = ltrim(fn, '0') THEN 30 ELSE -60 END
   + CASE WHEN ft AND NOT regexp_matches(lower(s), 'tpb|trade paperback|omnibus|compendium|masterworks|collection|deluxe edition|graphic novel') AND n <> '' THEN -50 WHEN NOT ft AND regexp_matches(lower(s), 'tpb|trade paperback|omnibus|compendium|masterworks|collection|deluxe edition|graphic novel') THEN -50 ELSE 0 END
   + CASE WHEN t = '' OR tt = '' THEN 0 WHEN t = tt THEN 25 WHEN starts_with(t, tt) OR starts_with(tt, t) THEN 15 ELSE -50 END
   + CASE WHEN y <= 0 OR fy <= 0 THEN 0 WHEN y = fy THEN 15 WHEN abs(y - fy) = 1 THEN 5 ELSE -50 END)) AS score,
  (t <> '' AND tt <> '' AND t <> tt) OR (y > 0 AND fy > 0 AND abs(y - fy) >= 2) OR (n <> '' AND fn <> '' AND ltrim(n, '0') <> ltrim(fn, '0')) AS critical FROM xe),
xs1 AS (SELECT *, CASE WHEN critical THEN 'CONFLICTING' WHEN s = '' OR n = '' THEN 'PARTIAL' ELSE 'VALID' END AS state FROM xs0)"""


def _stage(name: str, where: str) -> str:
    """The decision of one pool, as `name`(file_id, ...)."""
    renamed = _pool(where)
    for t in ("cd", "ag", "fb", "pf", "dis", "s1", "s2", "s3", "ev", "best", "sec", "cnt", "dec0", "dec"):
        renamed = renamed.replace(f"\n{t} AS (", f"\n{t}_{name} AS (")
    import re as _re  # noqa: PLC0415

    for t in ("cd", "ag", "fb", "pf", "dis", "s1", "s2", "s3", "ev", "best", "sec", "cnt", "dec0", "dec"):
        renamed = _re.sub(rf"(?<=FROM ){t}\b(?!_)|(?<=JOIN ){t}\b(?!_)", f"{t}_{name} AS {t}", renamed)
    return renamed.replace("AS pf a JOIN", "AS a JOIN").replace("AS pf b ON", "AS b ON").replace("AS best b USING", "AS b USING")


_INHERIT = """inh AS (SELECT c.* REPLACE (CASE WHEN c.provider <> 'Filename' AND c.issue_number = '' THEN f.issue_number ELSE c.issue_number END AS issue_number) FROM candidates c JOIN parsed f USING (file_id))"""
_RESOLVE_BASE = f"{PARSED}, {duck('candidates').replace('candidates AS', 'candidates0 AS', 1)}, {_INHERIT.replace('FROM candidates c', 'FROM candidates0 c').replace('inh AS', 'candidates AS')}, {duck('existing')}, {_existing_ev()}, {duck('overrides')}, {duck('cached')}"
_ROW = "file_id, provider, series_name, issue_number, issue_id, score, level"
RESOLVED = f"""WITH {_RESOLVE_BASE},
ovr AS (SELECT file_id, 'Override' AS provider, series_name, issue_number, issue_id, 100.0::DOUBLE AS score, 'AUTO_ACCEPT' AS level FROM overrides),
ux AS (SELECT file_id, 'ExistingXML' AS provider, s AS series_name, n AS issue_number, '4000-' || web_id AS issue_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 90 THEN 'AUTO_ACCEPT' ELSE 'ACCEPT_WITH_WARNING' END AS level FROM xs1 WHERE state = 'VALID' AND web_id <> '' AND score >= 80 AND zipped AND file_id NOT IN (SELECT file_id FROM ovr)),
{_stage("h", "file_id NOT IN (SELECT file_id FROM ovr UNION ALL SELECT file_id FROM ux)").lstrip().replace("FROM candidates c JOIN", "FROM cached c JOIN")},
uh AS (SELECT {_ROW} FROM dec_h WHERE score >= 80 AND NOT critical),
u AS (SELECT * FROM ovr UNION ALL SELECT * FROM ux UNION ALL SELECT * FROM uh),
{_stage("k", "c.provider IN ('Filename', 'Kapowarr') AND file_id NOT IN (SELECT file_id FROM u)").lstrip()},
wk AS (SELECT {_ROW} FROM dec_k WHERE score >= 70 AND NOT critical),
{_stage("c", "c.provider IN ('Filename', 'Kapowarr', 'ComicVine') AND file_id NOT IN (SELECT file_id FROM u UNION ALL SELECT file_id FROM wk)").lstrip()},
wc AS (SELECT {_ROW} FROM dec_c WHERE score >= 70 AND NOT critical),
{_stage("g", "file_id NOT IN (SELECT file_id FROM u UNION ALL SELECT file_id FROM wk UNION ALL SELECT file_id FROM wc)").lstrip()},
al AS (SELECT *, 'url_override' AS source FROM ovr UNION ALL SELECT *, 'existing_comicinfo' FROM ux UNION ALL SELECT *, 'persistent_cache' FROM uh UNION ALL SELECT *, 'kapowarr' FROM wk UNION ALL SELECT *, 'comicvine_fallback' FROM wc UNION ALL SELECT {_ROW}, 'gcd_fallback' FROM dec_g),
re AS (SELECT p.file_id, al.provider, al.series_name, al.issue_number, al.issue_id, al.score, CASE WHEN k THEN level ELSE 'UNRESOLVED' END AS level, CASE WHEN k THEN source ELSE '' END AS source, k AND coalesce(suffix(source, '_fallback'), FALSE) AS fallback_used
  FROM parsed p LEFT JOIN al USING (file_id) LEFT JOIN (SELECT DISTINCT file_id AS asked FROM (SELECT file_id FROM candidates WHERE provider <> 'Filename' UNION ALL SELECT file_id FROM existing)) q ON q.asked = p.file_id,
  LATERAL (SELECT (al.provider IS NOT NULL AND q.asked IS NOT NULL) OR coalesce(al.source = 'url_override', FALSE) AS k))"""
_RECORDS = """rec AS (SELECT provider, issue_id, arg_min({'s': CASE WHEN file_id % 14 = 0 THEN '' ELSE series_name END, 't': CASE WHEN file_id % 14 = 0 THEN '' ELSE series_name || ' #' || issue_number END, 'n': issue_number, 'p': publisher, 'y': publication_year, 'f': file_id}, file_id) AS r FROM candidates0 WHERE issue_id <> '' AND file_id % 9 <> 0 GROUP BY 1, 2),
fl AS (SELECT DISTINCT issue_id FROM candidates0 WHERE provider = 'Kapowarr' AND issue_id <> '' AND file_id % 31 = 0),
ret AS (SELECT re.*, r, CASE WHEN {failed} THEN 'PROVIDER_ERROR' WHEN r IS NULL THEN 'NOT_FOUND' WHEN r.s <> '' OR r.t <> '' THEN 'FOUND' ELSE 'INVALID' END AS state FROM re LEFT JOIN rec ON rec.provider = re.provider AND rec.issue_id = re.issue_id)"""

_FAILED = "coalesce(re.provider = 'Kapowarr' AND re.issue_id IN (SELECT issue_id FROM fl), FALSE)"

ORACLES |= {
    "Q2_existing_state": f"WITH {PARSED}, {duck('existing')}, {_existing_ev()} SELECT p.file_id, CASE WHEN NOT suffix(lower(path), '.cbz') OR state IS NULL THEN 'MISSING' WHEN p.file_id % 35 = 0 THEN 'MALFORMED' ELSE state END AS state, CASE WHEN p.file_id % 35 = 0 THEN 0 ELSE CAST(coalesce(score, 0) AS DOUBLE) END AS score FROM parsed p LEFT JOIN xs1 USING (file_id)",
    "Q3_resolve": f"{RESOLVED} SELECT file_id, provider, series_name, issue_number, score, level, {_ACTION} AS action, source, fallback_used, CASE WHEN NOT fallback_used THEN '' WHEN (file_id, CASE source WHEN 'comicvine_fallback' THEN 'Kapowarr' ELSE 'ComicVine' END) IN (SELECT (file_id, provider) FROM candidates) THEN 'insufficient' ELSE 'no results' END AS fallback_reason FROM re",
    "J14_retrieval": f"{RESOLVED}, {_RECORDS.replace('{failed}', _FAILED)} SELECT file_id, state, coalesce(r.t, '') AS title FROM ret",
    "Q5_plan": rf"""{RESOLVED}, {_RECORDS.replace('{failed}', 'FALSE')}, pl AS (SELECT ret.*, {_ACTION} AS act, state = 'FOUND' AS ok, file_id IN (SELECT file_id FROM existing) AS has FROM ret)
SELECT file_id, CASE WHEN act = 'SKIP' THEN 'SKIP' WHEN act = 'REVIEW' THEN 'REVIEW' WHEN NOT ok THEN 'SKIP' WHEN has THEN 'UPDATE' ELSE 'EMBED' END AS action,
  CASE WHEN act <> 'SKIP' AND ok THEN concat_ws(',', CASE WHEN r.t <> '' THEN 'Title' END, CASE WHEN r.s <> '' THEN 'Series' END, CASE WHEN r.n NOT IN ('', '0') THEN 'Number' END, CASE WHEN r.p <> '' THEN 'Publisher' END, CASE WHEN r.y <> 0 THEN 'Year' END, CASE WHEN r.f % 2 = 0 THEN 'Writer' END, CASE WHEN r.f % 3 = 0 THEN 'Characters' END, CASE WHEN r.f % 4 = 1 THEN 'Summary' END) ELSE '' END AS fields,
  coalesce(provider, '') AS provider, coalesce(score, 0) AS confidence, state AS metadata_state, CASE WHEN act = 'SKIP' THEN 'below threshold' WHEN NOT ok THEN 'metadata ' || lower(state) WHEN act = 'REVIEW' THEN 'needs review' WHEN has THEN 'existing record' ELSE 'resolved' END AS reason,
  regexp_replace(path, '(?i)\.cbr$', '.cbz') AS target_path FROM pl JOIN lib_files USING (file_id)""",
}

ORACLES["Q12_incremental_ingest"] = f"""WITH pl AS ({ORACLES['Q5_plan']}), f AS (SELECT p_partkey AS file_id, '/lib/f' || p_partkey AS path, CAST(p_partkey % 97 AS BIGINT) AS size, CAST(p_partkey % 89 AS BIGINT) AS mtime, 'h' || p_partkey % 83 AS sha256 FROM part),
n AS (SELECT path, size, mtime, sha256, action AS status, CAST(1250 AS BIGINT) AS updated_at FROM f JOIN pl USING (file_id) WHERE (file_id % 3 = 0 OR file_id % 5 = 0) AND file_id % 13 <> 0 AND action IN ('UPDATE', 'EMBED'))
SELECT * FROM n UNION ALL SELECT path, size, CASE WHEN file_id % 5 = 0 THEN mtime + 1 ELSE mtime END, sha256, 'SUCCESS', CAST(1 AS BIGINT) FROM f WHERE file_id % 3 <> 0 AND path NOT IN (SELECT path FROM n)"""

_EV = """ev AS (SELECT event_id, ts, '/lib/' || user_id || '.cbz' AS path, '/new/' || user_id || '.cbz' AS dest, CASE WHEN event_id % 11 = 0 THEN 'moved' WHEN event_id % 7 = 0 THEN 'deleted' WHEN event_id % 2 = 0 THEN 'created' ELSE 'modified' END AS event_type, CAST(floor(value) AS BIGINT) AS size FROM events)"""

ORACLES |= {
    "T1_debounce": f"""WITH {_EV}, t AS (SELECT path, date_trunc('second', ts) AS ts FROM ev), b AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY path ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY path ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM t),
s AS (SELECT path, k, count(*) AS n, min(ts) AS a FROM (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM b) GROUP BY 1, 2) SELECT path, count(*) AS bursts, max(n) AS largest, strftime(min(a), '%Y-%m-%d %H:%M:%S') AS first FROM s GROUP BY 1""",
    "T2_moves": f"WITH {_EV} SELECT event_id, path, CASE WHEN event_type = 'moved' THEN 'deleted' ELSE event_type END AS event_type FROM ev UNION ALL SELECT event_id, dest, 'created' FROM ev WHERE event_type = 'moved'",
    "T5_archive_events": f"WITH {_EV} SELECT event_id, path FROM ev",
    "T6_new_jobs": f"WITH {_EV} SELECT DISTINCT path, CAST(size % 5 AS VARCHAR) AS sha256 FROM ev",
    "T7_job_lifecycle": f"WITH {duck('jobs')}, g AS (SELECT job_id, arg_max(status, {{'t': ts, 'e': event_id}}) AS status, count(*) AS n_events, count(*) FILTER (status = 'FAILED') AS failures FROM jobs GROUP BY 1) SELECT *, failures >= 3 OR status IN ('SUCCESS', 'COMPLETED') AS terminal FROM g",
    "T8_windowed_metrics": f"WITH {duck('jobs')} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS total, {_OUT.format('status')}, round(avg(value), 1) AS avg_duration FROM jobs GROUP BY 1",
    "S18_record_json": f"WITH {duck('existing')} SELECT file_id, series, title, number, year, volume, publisher, web, '' AS language, CAST(1 AS INT) AS count, title || '|Ann|Bob' AS writers FROM existing",
    "S20_job_event_lines": f"""WITH {duck('jobs')} SELECT event_id, concat_ws(' ', 'job_id=' || job_id, 'status=' || status, CASE WHEN status = 'FAILED' THEN 'error=1' END) AS line,
  chr(123) || '"job_id":' || job_id || ',"status":"' || status || '"' || CASE WHEN status = 'FAILED' THEN ',"error":"1"' ELSE '' END || chr(125) AS json FROM jobs""",
}

_VOL_ROWS = f"""{duck('catalog_json')}, vi AS (SELECT row_id, CAST(data->>'$.id' AS BIGINT) AS volume_id, CASE WHEN data->>'$.title' <> '' THEN data->>'$.title' ELSE data->>'$.name' END AS series, coalesce(TRY_CAST(data->>'$.year' AS INT), 0) AS year,
  CAST(i->>'$.id' AS BIGINT) AS issue_id, replace(coalesce(i->>'$.issue_number', i->>'$.number'), '#', '') AS number, coalesce(i->>'$.title', '') AS title, coalesce(i->>'$.date', '') AS date FROM (SELECT row_id, data, unnest(CAST(data->'$.issues' AS JSON[])) AS i FROM catalog_json)),
ix AS (SELECT * FROM vi QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY row_id DESC) = 1)"""

ORACLES |= {
    "S7_catalog_volumes": f"WITH {_VOL_ROWS} SELECT row_id, volume_id, series, year, issue_id, number FROM vi",
    "S8_issue_index": f"WITH {_VOL_ROWS} SELECT issue_id, row_id, number FROM ix",
    "S9_issue_record": f"WITH {_VOL_ROWS} SELECT issue_id, series, number, CASE WHEN title <> '' THEN title ELSE series || ' #' || number END AS title, coalesce(TRY_CAST(regexp_extract(date, '((?:19|20)[0-9]{{2}})', 1) AS INT), year) AS year, 'ComicVine ID: ' || issue_id AS notes FROM ix",
    "S19_review_reports": DECIDED + rf""" SELECT file_id, 'review_' || regexp_replace({_BASE_NAME}, '\.[^.]*$', '') || '.md' AS name, '# Review of ' || {_BASE_NAME} || chr(10) || '- Best: ' || dec.series_name || ' #' || dec.issue_number || chr(10) || printf('- Score: %.1f (%s)', score, level) AS report
FROM dec JOIN lib_files USING (file_id) WHERE level = 'MANUAL_REVIEW'""",
}

_BATCH_OF = ORACLES["F17_batch_number"]
ORACLES |= {
    "Q10_collection_build": f"SELECT * FROM ({ORACLES['A7_merge_policy']}) WHERE collection_id IN (SELECT collection_id FROM ({ORACLES['A8_collection_validation']}) WHERE result <> 'REJECT')",
    "Q7_review": f"""SELECT r.file_id, r.score, b.provider AS recommended, b.series_name, b.score AS best_score FROM ({ORACLES['Q3_resolve']}) r
JOIN (SELECT * FROM ({DECIDED} SELECT file_id, provider, series_name, score, pool_pos FROM ev) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY score DESC, pool_pos) = 1) b ON b.file_id = r.file_id WHERE r.action = 'REVIEW'""",
    "J8_batch_match": f"""WITH f AS (SELECT b.file_id, p_name AS folder, b.number, count(*) OVER (PARTITION BY p_name) AS n FROM ({_BATCH_OF}) b JOIN part ON p_partkey = b.file_id),
i AS (SELECT DISTINCT p_name AS folder, CAST(p_size AS VARCHAR) AS number, 'u/' || p_name || '/' || p_size AS url FROM part),
k AS (SELECT folder, url, 0 AS rule, number AS key FROM i UNION ALL SELECT folder, url, 1, CASE WHEN ltrim(number, '0') = '' THEN '0' ELSE ltrim(number, '0') END FROM i UNION ALL SELECT folder, url, 2, '0.5' FROM i WHERE number IN ('0.5', '½', '1/2')),
a AS (SELECT file_id, folder, 0 AS plus, number AS key FROM f UNION ALL SELECT file_id, folder, 5, '1' FROM f WHERE n = 1),
m AS (SELECT file_id, min(ROW(plus + rule, url)) AS m FROM a JOIN k USING (folder, key) GROUP BY 1)
SELECT f.file_id, f.folder, f.number, coalesce(m[2], '') AS url, CASE WHEN m IS NULL THEN 'unmatched' ELSE 'ready' END AS status FROM f LEFT JOIN m USING (file_id)""",
}

_LISTED = """l AS (SELECT p_partkey % 40 AS volume_id, floor(p_partkey / 40) + 1 AS page_no, 0 AS pos, p_size || CASE WHEN p_partkey % 6 = 0 THEN 'A' ELSE '' END AS number, '/' || CASE WHEN p_partkey % 5 = 1 THEN 'the-red-sky-7' ELSE 'red-sky-annual' END || '/4000-' || p_partkey || '/' AS url, p_name AS label FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey % 40, floor(p_partkey / 40) + 1, 2, CAST(p_size + 100 AS VARCHAR), '/red-sky/4000-' || (p_partkey + 20000000) || '/', 'Issue ' || (p_size + 100) FROM part)"""
ORACLES |= {
    "S10_related_records": """WITH s AS (SELECT p_partkey AS sid, p_name AS series, s_name AS publisher FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 150)
SELECT p_partkey AS issue_id, coalesce(series, '') AS series, CAST(p_size AS VARCHAR) AS number, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE coalesce(series, '') || ' #' || p_size END AS title, coalesce(publisher, '') AS publisher, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1940 + p_partkey % 80 END AS year, '' AS summary,
p_brand || '; ' || p_type || '; Ann' AS writers, '' AS pencillers, p_brand AS inkers, '' AS colorists, p_name AS characters FROM part LEFT JOIN s ON sid = CASE WHEN p_partkey % 10 = 0 THEN -1 ELSE p_partkey - p_partkey % 7 END""",
    "S15_volume_issues": f"WITH {_LISTED} SELECT volume_id, number, url, label FROM l WHERE page_no <= 50 QUALIFY row_number() OVER (PARTITION BY volume_id, number ORDER BY page_no, pos) = 1",
    "S16_reading_entries": """SELECT p_partkey AS page_id, 1 AS place, p_name AS series, p_size || CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE '' END AS number, p_name || ' #' || p_size || CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE '' END AS title, '/x/4000-' || p_partkey || '/' AS url FROM part
UNION ALL SELECT p_partkey, 2, p_type, '', p_type, '/x/4000-' || (p_partkey + 1) || '/' FROM part""",
}
