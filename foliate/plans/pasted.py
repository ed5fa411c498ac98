"""Queries over pasted pages, the second catalog's pages and requests of several urls, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.functions.text import MONTHS
from foliate.operators import curate as K
from foliate.plans import resolve as V
from foliate.plans.datasets import derive, duck
from foliate.plans.oracles import merged_simple
from foliate.plans.queries import QUERIES, query
from foliate.plans.searches import ORACLES, catalog_issues
from foliate.sources import series_pages as S
from foliate.sources.pasted import LABELLED, SEASONS, pasted_records

c = F.col


@query("S17_labelled_text")
def _(spark, sf):
    """Records out of all documents, read as if they had been pasted."""
    return pasted_records(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id")


@query("S17_pasted_pages")
def _(spark, sf):
    """Records out of copied pages and page sources."""
    return pasted_records(derive(spark, sf, "pasted_pages"), "page_id")


_WS = r"E' \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f' || chr(133) || chr(160)"
_STRIP = "trim({}, w)"
_NUMBERED = r"^(.+?)\s+#?([0-9]+[a-zA-Z]?|[0-9]+\.[0-9]+|[0-9]+|\[[^\]]+\])"
_DATED = rf"(?i)\b({'|'.join([*MONTHS, *SEASONS])})\s+([0-9]{{4}})\b"
_PUBLISHED = r"([A-Za-z0-9\s]+),\s+([0-9]{4})\s+Series"


def _people(labels: list[str], cut: str, least: int) -> str:
    lines = f"[substr(x, strpos(x, ':') + 1) FOR x IN ls IF {' OR '.join(f'''starts_with(x, '{v}:')''' for v in labels)}]"
    bare = r"regexp_replace(regexp_replace(y, '\s*\([^)]*\)', '', 'g'), '\s*\([^)]*$', '', 'g')"
    items = f"[trim(trim(trim({bare}, w), '?'), w) FOR y IN flatten([string_split_regex(z, '{cut}') FOR z IN {lines}])]"
    kept = f"[v FOR v IN {items} IF length(v) >= {least} AND lower(v) <> 'none']"
    return f"array_to_string(list_filter({kept}, lambda v, i: list_position({kept}, v) = i), '; ')"


def _records(table: str, key: str) -> str:
    """From the rules of copied text; `html` rows are told apart by the caller."""
    people = ", ".join(f"{_people(v, '[,;]+', 1)} AS {k}" for k, v in LABELLED.items())
    names = ", ".join(f"'{m}'" for m in MONTHS)
    return rf"""ws AS (SELECT {_WS} AS w),
ln AS (SELECT {key}, w, [x FOR x IN [trim(y, w) FOR y IN string_split(coalesce(text, ''), chr(10))] IF x <> ''] AS al FROM {table}, ws),
cl AS (SELECT *, [x FOR x IN al IF NOT (starts_with(x, 'http://') OR starts_with(x, 'https://'))] AS ls, [x FOR x IN al IF starts_with(x, 'http://') OR starts_with(x, 'https://')] AS us FROM ln),
pg AS (SELECT *, coalesce(ls[1], '') AS title, array_to_string(ls, chr(10)) AS page FROM cl),
rx AS (SELECT *, trim(regexp_extract(title, '{_NUMBERED}', 1), w) AS s, lower(regexp_extract(page, '{_DATED}', 1)) AS mon, TRY_CAST(regexp_extract(page, '{_PUBLISHED}', 2) AS INT) AS py, TRY_CAST(regexp_extract(page, '{_DATED}', 2) AS INT) AS dy FROM pg),
tx AS (SELECT {key}, title, CASE WHEN s <> '' THEN s ELSE title END AS series, trim(regexp_extract(title, '{_NUMBERED}', 2), w) AS number,
  trim(string_split(trim(regexp_extract(page, '{_PUBLISHED}', 1), w), chr(10))[-1], w) AS publisher, coalesce(nullif(py, 0), dy, 0) AS year, CAST(coalesce(list_position([{names}], mon), 0) AS INT) AS month, coalesce(us[1], '') AS web,
  coalesce(trim(substr([x FOR x IN ls IF starts_with(x, 'Genre:')][-1], 7), w), '') AS genre, {people}, {_people(['Characters'], '[;' + chr(92) + 'n]+', 2)} AS characters FROM rx)"""


ORACLES["S17_labelled_text"] = f"WITH {_records('documents', 'doc_id')} SELECT * FROM tx"
_NO_ONE = ", ".join(f"'' AS {k}" for k in (*LABELLED, "characters"))
ORACLES["S17_pasted_pages"] = f"""WITH {duck("pasted_pages")}, copied AS (SELECT * FROM pasted_pages WHERE NOT contains(text, '<html')), {_records("copied", "page_id")}
SELECT * FROM tx UNION ALL
SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' #' || p_size ELSE '' END, p_name, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END, 'Press', CAST(1910 + p_partkey % 90 AS INT), 0, '', '', {_NO_ONE} FROM part WHERE p_partkey % 9 = 0"""


# Requests of several urls


def gcd_issues(spark, sf):
    """Records of the relational catalog, as merges take them."""
    r = QUERIES["S10_related_records"](spark, sf)
    people = {k: F.replace(k, F.lit("; "), F.lit(";")) for k in ("writers", "pencillers", "inkers", "colorists", "characters")}
    blank = {k: F.lit("") for k in ("volume_id", "notes", "provider_id", "genre", "language", *[x for x in K.LISTS if x not in people])}
    web = F.concat(F.lit("http://www.comics.org/issue/"), "issue_id", F.lit("/"))
    return r.withColumnsRenamed({"series": "series_name", "number": "issue_number"}).withColumns({**people, **blank, "month": F.lit(0), "day": F.lit(0), "web": web})


def requested(spark, sf):
    return V.routed_records(derive(spark, sf, "url_requests"), {"ComicVine": catalog_issues(spark, sf), "GCP": gcd_issues(spark, sf)})


@query("Q11_multi_source")
def _(spark, sf):
    """Requests that name several urls: each url's record from its own catalog, merged into one record."""
    return K.merge_issues(requested(spark, sf).where("state = 'FOUND'").withColumnRenamed("request_id", "collection_id"))


@query("Q11_url_states")
def _(spark, sf):
    """Where each url of a request leads, and whether its catalog knows it."""
    return requested(spark, sf).select("request_id", c("pos").cast("int").alias("pos"), "url", "route", "issue_id", "state")


_CV = ", ".join(f"'' AS {k}" for k in ("publisher", "volume_id", "summary", "notes", "provider_id", "genre", "language", *K.LISTS[1:]))
_GCD = ", ".join([f"replace({k}, '; ', ';') AS {k}" if k in ("writers", "pencillers", "inkers", "colorists", "characters") else f"'' AS {k}" for k in K.LISTS] + [f"'' AS {k}" for k in ("volume_id", "notes", "provider_id", "genre", "language")])
_REQUESTED = f"""{duck("candidates")}, ci AS (SELECT issue_id, series_name, issue_number, series_name || ' #' || issue_number AS title, publication_year AS year, 1 AS month, 0 AS day, 'http://u/' || issue_id AS web, 'W' || file_id % 3 AS writers, {_CV}
  FROM candidates WHERE provider = 'ComicVine' QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY file_id) = 1),
gi AS (SELECT CAST(issue_id AS VARCHAR) AS issue_id, series AS series_name, number AS issue_number, title, year, 0 AS month, 0 AS day, 'http://www.comics.org/issue/' || issue_id || '/' AS web, publisher, summary, {_GCD} FROM ({ORACLES["S10_related_records"]})),
uq AS (SELECT o_orderkey AS request_id, k AS pos, CASE k WHEN 0 THEN 'https://comicvine.gamespot.com/x/4000-' || o_custkey * 2 || '/' WHEN 1 THEN 'https://comicvine.gamespot.com/y/4000-' || (o_custkey * 2 + 4) || '/' ELSE 'http://www.comics.org/issue/5/' END AS url,
  CASE WHEN k < 2 THEN '4000-' || (o_custkey * 2 + 4 * k) ELSE '5' END AS issue_id, k = 2 AS gcd
  FROM (SELECT *, unnest(CASE WHEN o_orderkey % 4 = 1 THEN [0, 1, 2] ELSE [0, 1] END) AS k FROM orders))"""
ORACLES["Q11_multi_source"] = merged_simple(f"""{_REQUESTED}, members AS (SELECT request_id AS collection_id, pos, ci.* EXCLUDE (issue_id) FROM uq JOIN ci ON NOT gcd AND ci.issue_id = uq.issue_id
  UNION ALL BY NAME SELECT request_id AS collection_id, pos, gi.* EXCLUDE (issue_id) FROM uq JOIN gi ON gcd AND gi.issue_id = uq.issue_id)""")
ORACLES["Q11_url_states"] = f"""WITH {_REQUESTED} SELECT request_id, pos, url, CASE WHEN gcd THEN 'GCP' ELSE 'ComicVine' END AS route, issue_id, CASE WHEN issue_id IN (SELECT issue_id FROM ci) AND NOT gcd OR issue_id IN (SELECT issue_id FROM gi) AND gcd THEN 'FOUND' ELSE 'NOT_FOUND' END AS state FROM uq"""


# The second catalog's pages


@query("S14_series_search")
def _(spark, sf):
    rows = S.page_rows(derive(spark, sf, "series_pages"))
    return S.series_search(rows, "series", "issue").drop("pos")


@query("S15_series_pages")
def _(spark, sf):
    return S.series_issues(S.page_links(derive(spark, sf, "series_pages")))


@query("S15_series_index")
def _(spark, sf):
    return S.series_index(derive(spark, sf, "series_json"), derive(spark, sf, "related_issues"))


@query("S16_arc_search")
def _(spark, sf):
    return S.arc_search(S.page_links(derive(spark, sf, "series_pages")))


ORACLES["S14_series_search"] = """WITH a AS (SELECT *, p_name || ' ' || p_type || ' ' || (1950 + p_size) || ' ' || p_size || ' Issues ' || repeat(p_brand || ' ', 20) || 'late' AS d FROM part)
SELECT p_partkey AS page_id, p_name || ' ' || p_type AS title, 'https://www.comics.org/series/' || p_partkey || '/' AS url, 'gcp_volume' AS type, 'GCP Series' AS type_label, CAST(1950 + p_size AS VARCHAR) AS year, p_size || ' issues' AS count, left(d, 160) AS description FROM a
UNION ALL SELECT p_partkey, '#00' || p_size || ' b', 'https://www.comics.org/issue/' || p_partkey || '/', 'gcp_issue', 'GCP Issue', '2001', '1 issue', 'in 2001 #00' || p_size || ' b' FROM part
UNION ALL SELECT p_partkey, '#' || p_size || 'b', 'https://www.comics.org/issue/' || (p_partkey + 10000000) || '/', 'gcp_issue', 'GCP Issue', '', '1 issue', '#' || p_size || 'b No. 000' FROM part"""
ORACLES["S15_series_pages"] = """SELECT p_partkey AS series_id, CASE WHEN p_partkey % 4 = 0 THEN 'GCP Series #' || p_partkey ELSE p_name || ' ' || (1950 + p_size) END AS series, n.number, 'Issue #' || n.number AS label, 'https://www.comics.org/issue/' || n.issue || '/' AS url
FROM (SELECT *, unnest([{'number': p_size || 'b', 'issue': p_partkey}, {'number': '0', 'issue': 8}]) AS n FROM part)"""
ORACLES["S15_series_index"] = """WITH l AS (SELECT p_partkey AS series_id, p_name AS series, unnest([0, 2, 3]) AS pos, unnest([p_partkey, p_partkey + 7, p_partkey + 90000000]) AS issue FROM part),
n AS (SELECT l.*, coalesce(nullif(ltrim(CAST(p.p_size AS VARCHAR), '0'), ''), '0') AS number FROM l LEFT JOIN part p ON p.p_partkey = issue)
SELECT series_id, series, number, 'Issue #' || number AS label, 'https://www.comics.org/issue/' || issue || '/' AS url, CAST(issue AS VARCHAR) AS issue_id, CAST(number AS BIGINT) AS sort_number
FROM n QUALIFY row_number() OVER (PARTITION BY series_id, number ORDER BY pos) = 1"""
ORACLES["S16_arc_search"] = """SELECT p_partkey AS page_id, CAST(p_partkey AS VARCHAR) AS arc_id, CASE WHEN p_partkey % 3 = 0 THEN 'Dark' ELSE 'Dark Age' END AS name, 'ComicVine Story Arc #' || p_partkey AS deck, 'https://comicvine.gamespot.com/x/4045-' || p_partkey || '/' AS url FROM part"""
