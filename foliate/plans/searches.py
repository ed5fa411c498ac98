"""Queries over catalogs, searches, local candidates and embedded records, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.functions import text as T
from foliate.operators import arcs as R
from foliate.operators import curate as K
from foliate.operators import decide as D
from foliate.operators import metrics as X
from foliate.operators import score as S
from foliate.plans import resolve as V
from foliate.plans.datasets import derive, duck
from foliate.plans.oracles import _ACTION, _VOL_ROWS, DECIDED, ORACLES, PARSED, RESOLVED, arc_match, merged_simple, tags, title
from foliate.plans.queries import NOW, QUERIES, evaluated, parsed, query, records
from foliate.sources import archives as A
from foliate.sources import catalogs as B
from foliate.sources.tables import written

__all__ = ["ORACLES", "QUERIES"]

c = F.col
_CR = duck("cache_rows")


def base_name():
    return F.element_at(F.split("path", "/"), -1)


# Archives and their records


@query("S1_library_scan")
def _(spark, sf):
    """Archives below overlapping roots, each once (the rules of scan_library over a listing)."""
    listing = derive(spark, sf, "lib_files").select(F.when(c("file_id") % 10 == 0, F.concat("path", F.lit(".part"))).otherwise(c("path")).alias("path"))
    return listing.union(listing.where("path LIKE '/lib/misc/%'")).where(F.lower("path").rlike(r"\.cb[zr]$")).distinct()


ORACLES["S1_library_scan"] = f"WITH {duck('lib_files')} SELECT DISTINCT path FROM lib_files WHERE file_id % 10 <> 0"
QUERIES["U5_distinct_paths"] = QUERIES["S1_library_scan"]
ORACLES["U5_distinct_paths"] = ORACLES["S1_library_scan"]


@query("S2_fingerprint")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    content = F.coalesce("text", F.lit("")).cast("binary")
    files = docs.select(F.concat(F.lit("/lib/"), "doc_id", F.lit(".CBZ")).alias("path"), content.alias("content"), F.octet_length(content).cast("bigint").alias("size"), F.timestamp_seconds(c("doc_id")).alias("modified"))
    return A.fingerprint(files)


ORACLES["S2_fingerprint"] = "SELECT '/lib/' || doc_id || '.CBZ' AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, doc_id AS mtime, sha256(coalesce(text, '')) AS sha256, 'cbz' AS archive_type FROM documents"


@query("S3_archive_entries")
def _(spark, sf):
    """Archives packed from pages and records, and their manifests read back; every seventh archive cannot be read."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.concat(F.lit("/lib/"), "page_id", F.lit(".cbz")).alias("path"), F.lit("Page1.HTML").alias("entry"), F.coalesce("html", F.lit("")).cast("binary").alias("data"), "page_id")
    own = pages.select("path", F.lit("ComicInfo.xml").alias("entry"), F.concat(F.lit("<ComicInfo><Number>"), "page_id", F.lit("</Number></ComicInfo>")).cast("binary").alias("data"))
    packed = A.pack_archives(pages.drop("page_id").union(own))
    broken = F.when(F.pmod(F.regexp_extract("path", "([0-9]+)", 1).cast("bigint"), F.lit(7)) == 0, F.substring("content", 1, 20)).otherwise(c("content"))
    return A.read_entries(packed.withColumn("content", broken)).select("path", "entry", "size", "sha256", "record", c("error").isNotNull().alias("failed"))


ORACLES["S3_archive_entries"] = """WITH p AS (SELECT page_id, '/lib/' || page_id || '.cbz' AS path, coalesce(html, '') AS h, '<ComicInfo><Number>' || page_id || '</Number></ComicInfo>' AS x FROM pages)
SELECT path, 'page1.html' AS entry, CAST(octet_length(encode(h)) AS BIGINT) AS size, sha256(h) AS sha256, NULL AS record, FALSE AS failed FROM p WHERE page_id % 7 <> 0
UNION ALL SELECT path, 'comicinfo.xml', CAST(octet_length(encode(x)) AS BIGINT), sha256(x), x, FALSE FROM p WHERE page_id % 7 <> 0 UNION ALL SELECT path, NULL, NULL, NULL, NULL, TRUE FROM p WHERE page_id % 7 = 0"""

_RECORD = ["file_id", "title", "series", "number", "summary", "year", "month", "day", "count"]


def joined(*names):
    return [F.array_join(n, "|").alias(n) for n in names]


@query("S4_record")
def _(spark, sf):
    return A.parse_record(derive(spark, sf, "xml_records")).select(*_RECORD, *joined("writers", "characters"), "malformed")


@query("S5_record_round_trip")
def _(spark, sf):
    """Records written as XML and read again."""
    once = A.parse_record(derive(spark, sf, "xml_records")).where("NOT malformed").drop("record", "malformed")
    return A.parse_record(A.write_record(once)).select(*_RECORD, *joined("writers", "characters", "story_arcs"), "malformed")


@query("S6_arc_tags")
def _(spark, sf):
    return A.parse_record(derive(spark, sf, "xml_records")).select("file_id", *joined("story_arcs", "story_arc_numbers"))


@query("L6_extra_fields")
def _(spark, sf):
    """Fields that no column stands for, kept through a round trip."""
    once = A.parse_record(derive(spark, sf, "xml_records")).drop("record", "malformed")
    again = A.parse_record(A.write_record(once))
    return again.select("file_id", F.array_join(F.transform(F.sort_array(F.map_entries("extras")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("extras"))


_GOOD = "p_partkey % 11 <> 0"
_DAY = "CASE WHEN p_partkey % 6 = 0 OR p_partkey % 9 = 0 THEN 0 ELSE 3 END"
_TOLD = f"""SELECT p_partkey AS file_id, p_type AS title, p_name AS series, CAST(p_size AS VARCHAR) AS number, '' AS summary, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE CAST(1940 + p_partkey % 80 AS INT) END AS year, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE CAST(p_partkey % 12 + 1 AS INT) END AS month, {_DAY} AS day,
  CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 12 END AS count, 'Ann|Bob ' || p_size AS writers"""
ORACLES["S4_record"] = f"""{_TOLD}, 'A, B|C' AS characters, FALSE AS malformed FROM part WHERE {_GOOD}
UNION ALL SELECT p_partkey, '', '', '', '', 0, 0, 0, NULL, '', '', TRUE FROM part WHERE NOT {_GOOD}"""
ORACLES["S5_record_round_trip"] = f"{_TOLD}, 'A, B, C' AS characters, 'Dark Age|' || p_name || '|Night' AS story_arcs, FALSE AS malformed FROM part WHERE {_GOOD}"
ORACLES["S6_arc_tags"] = f"SELECT p_partkey AS file_id, CASE WHEN {_GOOD} THEN 'Dark Age|' || p_name || '|Night' ELSE '' END AS story_arcs, CASE WHEN {_GOOD} THEN '1|2' ELSE '' END AS story_arc_numbers FROM part"
ORACLES["L6_extra_fields"] = f"SELECT p_partkey AS file_id, CASE WHEN {_GOOD} AND p_partkey % 4 = 0 THEN 'BlackAndWhite=Yes|Score=' || p_size || ' < 60' ELSE '' END AS extras FROM part"


# Catalogs and searches


@query("S21_pluggable_catalog")
def _(spark, sf):
    return B.as_catalog(derive(spark, sf, "vendor_rows"), "Vendor", {"series_name": "label", "issue_number": "issue_no", "publication_year": "yr", "issue_id": "code"})


ORACLES["S21_pluggable_catalog"] = f"""WITH {duck('vendor_rows')} SELECT 'Vendor' AS provider, code AS issue_id, '' AS series_id, label AS series_name, issue_no AS issue_number, coalesce(TRY_CAST(yr AS INT), 0) AS publication_year, '' AS publisher, '' AS volume, CASE WHEN code = '' THEN 'no id' ELSE '' END AS reason FROM vendor_rows"""


def found_by(spark, sf, q):
    """What each catalog finds for a query: title and url."""
    volumes = B.volumes(derive(spark, sf, "catalog_json"))
    pool = derive(spark, sf, "candidates")
    shelf = volumes.select(c("series").alias("series_name"), F.concat(F.lit("v/"), "volume_id").alias("url")).distinct()
    cv, gcd = pool.where("provider = 'ComicVine'"), pool.where("provider = 'GCD'")

    def listed(rows, url):
        return B.search(rows, q).select(c("series_name").alias("title"), url.alias("url")).distinct()

    return {
        "kapowarr_volume": B.search(shelf, q).select(c("series_name").alias("title"), "url"),
        "kapowarr_issue": B.search_issues(volumes.where("issue_id is not null"), q).select(c("shown").alias("title"), F.concat(F.lit("i/"), "issue_id").alias("url")),
        "cv_volume": listed(cv, F.concat(F.lit("n/"), "series_name")),
        "cv_issue": listed(cv, F.concat(F.lit("c/"), "issue_id")),
        "gcp": listed(gcd, F.concat(F.lit("g/"), "series_id")),
    }


@query("P2_issue_search")
def _(spark, sf):
    return found_by(spark, sf, " #7 ")["kapowarr_issue"]


@query("U2_federated_search")
def _(spark, sf):
    return B.federated_search(found_by(spark, sf, " Cold ")).select("title", "url", "provider", "type", "type_label")


@query("A17_search_counts")
def _(spark, sf):
    """Results of a search by catalog, and whether the first catalog took part."""
    per = B.federated_search(found_by(spark, sf, "cold"), "all").groupBy("provider", "type").agg(F.count("*").alias("results"))
    return per.withColumn("is_local", c("provider") == "Kapowarr")


def _found(q: str) -> str:
    low = q.strip().lower()
    return f"""{_VOL_ROWS}, {duck('candidates')}, fs AS (
  SELECT series AS title, 'v/' || volume_id AS url, 'Kapowarr' AS provider, 'kapowarr_volume' AS type, 'Kapowarr Volume' AS type_label FROM (SELECT DISTINCT series, volume_id FROM vi) WHERE contains(lower(series), '{low}')
  UNION ALL SELECT CASE WHEN title <> '' THEN title ELSE 'Issue #' || number END, 'i/' || issue_id, 'Kapowarr', 'kapowarr_issue', 'Kapowarr Issue' FROM vi WHERE contains(lower(title), '{low}') OR contains('issue ' || lower(number), '{low}') OR contains('#' || lower(number), '{low}')
  UNION ALL SELECT DISTINCT series_name, 'n/' || series_name, 'CV', 'cv_volume', 'CV Series' FROM candidates WHERE provider = 'ComicVine' AND contains(lower(series_name), '{low}')
  UNION ALL SELECT DISTINCT series_name, 'c/' || issue_id, 'CV', 'cv_issue', 'CV Issue' FROM candidates WHERE provider = 'ComicVine' AND contains(lower(series_name), '{low}')
  UNION ALL SELECT DISTINCT series_name, 'g/' || series_id, 'GCP', 'gcp_issue', 'GCP Issue' FROM candidates WHERE provider = 'GCD' AND contains(lower(series_name), '{low}'))"""


ORACLES["P2_issue_search"] = f"WITH {_found('#7')} SELECT title, url FROM fs WHERE type = 'kapowarr_issue'"
ORACLES["U2_federated_search"] = f"WITH {_found('cold')} SELECT * FROM fs"
ORACLES["A17_search_counts"] = f"WITH {_found('cold')} SELECT provider, type, count(*) AS results, provider = 'Kapowarr' AS is_local FROM fs GROUP BY ALL"


@query("O4_provider_order")
def _(spark, sf):
    return K.provider_order(derive(spark, sf, "calls").select("provider", c("call_id").alias("registered")), ["GCP", "cv", "gcd", "other"]).select("provider", c("place").cast("int").alias("place"))


ORACLES["O4_provider_order"] = f"""WITH {duck('calls')}, p AS (SELECT CASE lower(provider) WHEN 'kap' THEN 'kapowarr' WHEN 'comic_vine' THEN 'comicvine' ELSE lower(provider) END AS provider, min(call_id) AS r FROM calls GROUP BY 1)
SELECT provider, CAST(row_number() OVER (ORDER BY CASE provider WHEN 'gcd' THEN 1 WHEN 'comicvine' THEN 2 ELSE 9 END, r) AS INT) AS place FROM p"""


@query("O5_library_listing")
def _(spark, sf):
    """The library's folders, those of the preferred source first."""
    status = QUERIES["A9_library_status"](spark, sf)
    return status.select(F.when(c("in_catalog"), 0).otherwise(1).alias("block"), "folder", "label").orderBy("block", "folder")


ORACLES["O5_library_listing"] = f"SELECT CASE WHEN in_catalog THEN 0 ELSE 1 END AS block, folder, label FROM ({ORACLES['A9_library_status']}) ORDER BY 1, 2"


@query("F35_folder_title")
def _(spark, sf):
    return derive(spark, sf, "folders").select("folder_id", T.folder_title(c("rel_path")).alias("title"))


ORACLES["F35_folder_title"] = f"""WITH {duck('folders')} SELECT folder_id, split_part(rel_path, '/', 1) || CASE WHEN NOT contains(rel_path, '/') THEN '' WHEN contains(lower(split_part(rel_path, '/', 2)), 'volume') THEN ' - ' || split_part(rel_path, '/', 2) ELSE ' (' || split_part(rel_path, '/', 2) || ')' END AS title FROM folders"""
QUERIES["F36_status_label"] = lambda spark, sf: QUERIES["A9_library_status"](spark, sf).select("folder", "label")
ORACLES["F36_status_label"] = f"SELECT folder, label FROM ({ORACLES['A9_library_status']})"


@query("F38_pasted_text")
def _(spark, sf):
    u = F.when(c("id") % 3 == 0, F.concat_ws("\n", "url", "day_text", "creator")).otherwise(c("url"))
    return derive(spark, sf, "urls").select("id", T.is_pasted(u).alias("pasted"))


ORACLES["F38_pasted_text"] = f"WITH {duck('urls')} SELECT id, contains(url, 'Script:') OR (id % 3 = 0 AND contains(url, 'comics.org')) AS pasted FROM urls"


@query("F37_explanations")
def _(spark, sf):
    """What speaks for and against each candidate, line by line."""
    pairs = D.agreement(D.pool_pairs(parsed(spark, sf), derive(spark, sf, "candidates")))
    return pairs.select("file_id", "pool_pos", F.array_join(S.explanations(S.terms(agreement=c("n_agree"))), "; ").alias("told"))


ORACLES["F37_explanations"] = f"""{DECIDED} SELECT file_id, pool_pos, concat_ws('; ', CASE WHEN e1 <> 0 THEN 'source: ' || concat_ws(' ', provider, CASE WHEN issue_id <> '' THEN issue_id END) || printf(' (%+.0f)', e1::DOUBLE) END, CASE WHEN n_agree >= 2 THEN 'agreement: providers agree (+15)' END,
  CASE WHEN e2 <> 0 THEN 'issue_number: #' || issue_number || ' against #' || f_number || printf(' (%+.0f)', e2::DOUBLE) END, CASE WHEN e3 <> 0 THEN 'format: collected edition against single issue (-50)' END,
  CASE WHEN e4 <> 0 THEN 'series_name: ' || series_name || ' against ' || f_series || printf(' (%+.0f)', e4::DOUBLE) END, CASE WHEN e5 <> 0 THEN 'year: ' || publication_year || ' against ' || f_year || printf(' (%+.0f)', e5::DOUBLE) END) AS told FROM s1"""


@query("P6_resolved")
def _(spark, sf):
    return D.decide(evaluated(spark, sf)).where((c("score") >= 50) & (T.text(c("series_name")) != "")).select("file_id", "score")


ORACLES["P6_resolved"] = f"{DECIDED} SELECT file_id, score FROM dec WHERE score >= 50 AND series_name <> ''"


@query("P10_path_quarantine")
def _(spark, sf):
    bad = F.when(c("file_id") % 9 == 0, F.concat(F.lit("/etc"), "path")).when(c("file_id") % 9 == 1, F.concat(F.lit("/lib/../x"), "path")).when(c("file_id") % 9 == 2, F.concat("path", F.lit(".pdf"))).when(c("file_id") % 9 == 3, F.concat(F.lit("/library"), "path"))
    files = derive(spark, sf, "lib_files").select("file_id", F.coalesce(bad, c("path")).alias("path"))
    return K.quarantine_paths(files, ["/lib"]).select("file_id", "reason", (c("reason") == "").alias("good"))


ORACLES["P10_path_quarantine"] = f"WITH {duck('lib_files')} SELECT file_id, reason, reason = '' AS good FROM (SELECT file_id, CASE file_id % 9 WHEN 0 THEN 'system folder' WHEN 1 THEN 'outside roots' WHEN 2 THEN 'extension' WHEN 3 THEN 'outside roots' ELSE '' END AS reason FROM lib_files)"


@query("Q1_local_candidates")
def _(spark, sf):
    return V.local_candidates(parsed(spark, sf), derive(spark, sf, "existing"))


ORACLES["Q1_local_candidates"] = rf"""WITH {PARSED}, {duck('existing')}, j AS (SELECT p.file_id, x.*, x.file_id IS NOT NULL AND suffix(lower(path), '.cbz') AS has, string_split(path, '/')[-2] AS parent FROM parsed p LEFT JOIN existing x USING (file_id)),
k AS (SELECT file_id, CASE WHEN has THEN 'ExistingXML' ELSE 'DirectoryStructure' END AS provider, CASE WHEN has AND contains(web, '/4000-') THEN regexp_extract(web, '(4000-[0-9]+)', 1) ELSE '' END AS issue_id,
  CASE WHEN has AND series <> '' THEN series ELSE trim(regexp_replace(regexp_replace(parent, '[(\[](?:19|20)[0-9]{{2}}[)\]]', '', 'g'), '[_\-.()\[\]]+', ' ', 'g')) END AS series_name, CASE WHEN has THEN number ELSE '' END AS issue_number,
  CASE WHEN has AND year > 0 THEN year ELSE coalesce(TRY_CAST(regexp_extract(parent, '[(\[]((?:19|20)[0-9]{{2}})[)\]]', 1) AS INT), 0) END AS publication_year FROM j)
SELECT file_id, 0 AS pool_pos, 'FilenameParser' AS provider, '' AS issue_id, series_name, issue_number, year AS publication_year, publisher, CASE WHEN is_tpb THEN 'TPB' WHEN is_annual THEN 'Annual' ELSE 'Issue' END AS identity_type FROM parsed
UNION ALL SELECT file_id, 1, provider, issue_id, series_name, issue_number, publication_year, '', 'Issue' FROM k WHERE series_name <> '' OR issue_number <> ''"""


@query("L7_provider_results")
def _(spark, sf):
    told = F.transform(F.sort_array(F.map_entries("results")), lambda e: F.concat_ws(":", e["key"], e["value"]["status"], e["value"]["candidates"].cast("string")))
    return V.provider_results(derive(spark, sf, "candidates")).select("file_id", F.array_join(told, "|").alias("results"))


def _status(name: str) -> str:
    n = f"count(*) FILTER (provider = '{name}')"
    return f"'{name}:' || CASE WHEN {n} > 0 THEN 'SUCCESS:' ELSE 'NO_RESULTS:' END || {n}"


ORACLES["L7_provider_results"] = f"WITH {duck('candidates')} SELECT file_id, concat_ws('|', {', '.join(map(_status, ('ComicVine', 'GCD', 'Kapowarr')))}) AS results FROM candidates GROUP BY 1"


# Upkeep, batches and whole jobs


@query("F28_content_hash")
def _(spark, sf):
    rows = derive(spark, sf, "existing")
    return rows.select("file_id", T.content_hash({k: c(k) for k in ("title", "series", "year", "number")}).alias("hash"))


def _hash(**columns: str) -> str:
    parts = " || ', ' || ".join(f"""'"{k}": ' || {columns[k]}""" for k in sorted(columns))
    return f"left(sha256(chr(123) || {parts} || chr(125)), 16)"


_QUOTED = """'"' || replace({0}, '"', chr(92) || '"') || '"'"""
ORACLES["F28_content_hash"] = f"WITH {duck('existing')} SELECT file_id, {_hash(number=_QUOTED.format('number'), series=_QUOTED.format('series'), title=_QUOTED.format('title'), year='year')} AS hash FROM existing"


@query("M5_hash_upsert")
def _(spark, sf):
    seen = K.first_by(derive(spark, sf, "seen_files"), ["path"], [F.desc("seen_id")])
    done = seen.where("seen_id % 2 = 0").withColumn("status", F.lit("SUCCESS"))
    known = K.latest(derive(spark, sf, "known_files"), ["path"], "updated_at")
    return K.hash_upsert(known, done, NOW)


ORACLES["M5_hash_upsert"] = f"""WITH {duck('seen_files')}, {duck('known_files')}, n AS (SELECT path, size, mtime, sha256, 'SUCCESS' AS status, CAST(1250 AS BIGINT) AS updated_at FROM (SELECT * FROM seen_files QUALIFY row_number() OVER (PARTITION BY path ORDER BY seen_id DESC) = 1) WHERE seen_id % 2 = 0)
SELECT * FROM n UNION ALL SELECT path, size, mtime, sha256, status, updated_at FROM known_files WHERE path NOT IN (SELECT path FROM n) QUALIFY row_number() OVER (PARTITION BY path ORDER BY updated_at DESC) = 1"""


@query("M6_changed_sources")
def _(spark, sf):
    keys = ["provider", "kind", "cache_key"]
    old = K.latest(derive(spark, sf, "cache_rows"), keys, "updated_at")
    new = old.withColumn("data_json", F.when(c("updated_at") % 3 == 0, F.lit("[]")).otherwise(c("data_json")))
    return K.changed_sources(old, new, keys, ["data_json", "schema_version"])


_H = _hash(data_json=_QUOTED.format("data_json"), schema_version=_QUOTED.format("schema_version"))
ORACLES["M6_changed_sources"] = f"""WITH {_CR} SELECT provider, kind, cache_key, {_H} AS old_hash, {_H.replace("replace(data_json,", "replace('[]',")} AS new_hash
FROM (SELECT * FROM cache_rows QUALIFY row_number() OVER (PARTITION BY provider, kind, cache_key ORDER BY updated_at DESC) = 1) WHERE updated_at % 3 = 0"""


@query("A15_batch_summary")
def _(spark, sf):
    there = derive(spark, sf, "lib_files").where(F.pmod(c("file_id"), F.lit(10)) != 3)  # files still there
    return K.batch_summary(QUERIES["J8_batch_match"](spark, sf), there)


ORACLES["A15_batch_summary"] = f"SELECT folder, count(*) AS files, count(*) FILTER (status = 'ready') AS matched, count(*) FILTER (status = 'ready' AND file_id % 10 <> 3) AS processed, count(*) FILTER (status <> 'ready') AS skipped, count(*) FILTER (status = 'ready' AND file_id % 10 = 3) AS errors FROM ({ORACLES['J8_batch_match']}) GROUP BY 1"


@query("A16_arc_rewrites")
def _(spark, sf):
    """Counts of renaming an arc and of adding one, over all tag lists; some files cannot be read."""
    rows = derive(spark, sf, "arcs")
    before = R.tag_list(c("arcs"), c("nums"))
    error = F.when(c("id") % 50 == 0, F.lit("cannot be read"))
    renamed = rows.select(F.lit("rename").alias("action"), before.alias("before"), R.rename_arc(before, F.lit("night one"), F.lit("Dawn")).alias("after"), error.alias("error"))
    added = rows.select(F.lit("upsert").alias("action"), before.alias("before"), R.upsert_arc(before, F.lit("Night One"), c("pos")).alias("after"), error.alias("error"))
    return X.arc_rewrites(renamed.union(added))


_MATCH = arc_match("'night one'", "arc")
ORACLES["A16_arc_rewrites"] = f"""WITH {tags(chr(39) + '1' + chr(39))}, m AS (SELECT id, arg_min(arc, i) AS arc, arg_min(num, i) AS num FROM tg WHERE {_MATCH} GROUP BY 1), j AS (SELECT arcs.id, arcs.pos, m.id AS hit, arc, num FROM arcs LEFT JOIN m USING (id)),
r AS (SELECT 'rename' AS action, id, hit IS NOT NULL AND arc <> 'Dawn' AS changed FROM j UNION ALL SELECT 'upsert', id, NOT coalesce(arc = 'Night One' AND num = CAST(pos AS VARCHAR), FALSE) FROM j)
SELECT action, count(*) FILTER (id % 50 <> 0 AND changed) AS updated, count(*) FILTER (id % 50 <> 0 AND NOT changed) AS skipped, count(*) FILTER (id % 50 = 0) AS errors FROM r GROUP BY 1"""


@query("Q6_dry_run")
def _(spark, sf):
    """Archives with their embedded records, evaluated without writing anything: one plan per archive."""
    files = derive(spark, sf, "lib_files")
    own = derive(spark, sf, "existing").join(files, "file_id")
    slim = F.struct(c("title").alias("Title"), c("series").alias("Series"), c("number").alias("Number"), c("year").cast("string").alias("Year"), F.nullif("web", F.lit("")).alias("Web"))
    named = F.concat(F.lit("/lib/a"), "file_id", F.regexp_extract("path", r"(\.[^.]*)$", 1))
    entries = own.select(named.alias("path"), F.lit("ComicInfo.xml").alias("entry"), F.to_xml(slim, {"rowTag": "ComicInfo"}).cast("binary").alias("data"))
    entries = entries.union(files.select(named.alias("path"), F.lit("p1.jpg").alias("entry"), F.lit("x").cast("binary").alias("data")))
    read = A.parse_record(A.read_entries(A.pack_archives(entries)).where("record IS NOT NULL AND lower(path) LIKE '%.cbz'"))
    web_id = F.regexp_extract("web", "(4000-[0-9]+)", 1)
    found = read.select(F.regexp_extract("path", "([0-9]+)", 1).cast("bigint").alias("file_id"), "series", "title", "number", "year", "publisher", "volume", web_id.alias("provider_id"), "web", "malformed")
    found = written(found, "found")  # read by every stage
    won = V.resolve(parsed(spark, sf), derive(spark, sf, "candidates"), found)
    return V.plan_files(V.retrieve(won, records(spark, sf)), files, found)


_DRY = f"existing AS (SELECT * REPLACE (regexp_extract(web, '(4000-[0-9]+)', 1) AS provider_id) FROM existing0 JOIN lib_files USING (file_id) WHERE suffix(lower(path), '.cbz'))"
ORACLES["Q6_dry_run"] = (
    ORACLES["Q5_plan"]
    .replace(duck("existing"), duck("existing").replace("existing AS", "existing0 AS", 1) + ", " + _DRY.replace("SELECT * REPLACE", "SELECT existing0.* REPLACE"), 1)
    .replace(duck("overrides"), "overrides AS (SELECT * FROM (" + duck("overrides").partition("(")[2][:-1] + ") WHERE FALSE)", 1)
    .replace(duck("cached"), "cached AS (SELECT * FROM (" + duck("cached").partition("(")[2][:-1] + ") WHERE FALSE)", 1)
)


def catalog_issues(spark, sf):
    """Records of catalog issues by id, as merges take them."""
    pool = derive(spark, sf, "candidates").where("provider = 'ComicVine'")
    first = pool.groupBy("issue_id").agg(F.min_by(F.struct("file_id", "series_name", "issue_number", "publication_year"), "file_id").alias("r")).select("issue_id", "r.*")
    blank = {k: F.lit("").alias(k) for k in ("publisher", "volume_id", "summary", "notes", "provider_id", "genre", "language", *K.LISTS[1:])}
    return first.select(
        "issue_id", "series_name", "issue_number", F.concat("series_name", F.lit(" #"), "issue_number").alias("title"), c("publication_year").alias("year"), F.lit(1).alias("month"), F.lit(0).alias("day"),
        F.concat(F.lit("http://u/"), "issue_id").alias("web"), F.concat(F.lit("W"), c("file_id") % 3).alias("writers"), *blank.values(),
    )


# Streams' batch twins


def _events(spark, sf):
    from foliate.plans.queries import file_events

    return file_events(spark, sf)


@query("T2_settled_paths")
def _(spark, sf):
    """Bursts that do not end in a deletion, moves split into deletion and creation."""
    from foliate.streaming import events as E

    e = E.split_moves(_events(spark, sf)).withColumn("ts", F.date_trunc("second", "ts"))
    return E.still_there(E.debounce(e, "30 minutes")).groupBy("path").agg(F.count("*").alias("bursts"))


@query("T3_stability")
def _(spark, sf):
    from foliate.streaming import events as E

    e = _events(spark, sf).withColumn("ts", F.date_trunc("second", "ts"))
    settled = E.debounce(e, "30 minutes", max_wait="2 hours")
    return settled.groupBy("path").agg(F.count_if("stable").alias("stable"), F.count_if("gave_up").alias("gave_up"), F.count("*").alias("bursts"))


@query("T4_unknown_events")
def _(spark, sf):
    """Events on files that are not recorded as they are."""
    from foliate.streaming import events as E

    e = _events(spark, sf).select("event_id", "path", "size", (c("size") % 7).alias("mtime"), F.concat(F.lit("h"), c("size") % 5).alias("sha256"))
    return E.without_known(e, e.where("event_id % 3 = 0")).select("event_id", "path")


@query("T8_provider_windows")
def _(spark, sf):
    from foliate.streaming import events as E

    calls = _events(spark, sf).select("ts", F.concat(F.lit("p"), c("event_id") % 3).alias("provider"), F.when(c("event_id") % 5 == 0, 503).otherwise(200).alias("http_status"), c("size").alias("ms"))
    return E.windowed_health(calls).withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


@query("T9_resume")
def _(spark, sf):
    """Events left over when an earlier run had handled the first ones."""
    from foliate.streaming import events as E

    e = _events(spark, sf)
    return E.not_yet_done(e, e.where("event_id % 4 <> 1")).select("event_id", "path")


_EV = """ev AS (SELECT event_id, date_trunc('second', ts) AS ts, '/lib/' || user_id || '.cbz' AS path, '/new/' || user_id || '.cbz' AS dest, CASE WHEN event_id % 11 = 0 THEN 'moved' WHEN event_id % 7 = 0 THEN 'deleted' WHEN event_id % 2 = 0 THEN 'created' ELSE 'modified' END AS event_type, CAST(floor(value) AS BIGINT) AS size FROM events)"""
_BURSTS = """b AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY path ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY path ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM t),
k AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM b)"""
ORACLES["T2_settled_paths"] = f"""WITH {_EV}, t AS (SELECT path, ts, CASE WHEN event_type = 'moved' THEN 'deleted' ELSE event_type END AS e FROM ev UNION ALL SELECT dest, ts, 'created' FROM ev WHERE event_type = 'moved'), {_BURSTS},
s AS (SELECT path, k, max({{'t': ts, 'e': e}}) AS last FROM k GROUP BY 1, 2) SELECT path, count(*) AS bursts FROM s WHERE last.e <> 'deleted' GROUP BY 1"""
ORACLES["T3_stability"] = f"""WITH {_EV}, t AS (SELECT * FROM ev), {_BURSTS}, s AS (SELECT path, k, list(size ORDER BY ts DESC, size DESC) AS z, max(ts) - min(ts) AS d FROM k GROUP BY 1, 2), r AS (SELECT path, coalesce(z[1] = z[2], FALSE) AS stable, d FROM s)
SELECT path, count(*) FILTER (stable) AS stable, count(*) FILTER (NOT stable AND d >= INTERVAL 2 HOUR) AS gave_up, count(*) AS bursts FROM r GROUP BY 1"""
ORACLES["T4_unknown_events"] = f"WITH {_EV} SELECT event_id, path FROM ev e WHERE NOT EXISTS (SELECT 1 FROM ev k WHERE k.event_id % 3 = 0 AND k.path = e.path AND k.size = e.size)"
ORACLES["T8_provider_windows"] = f"WITH {_EV} SELECT 'p' || event_id % 3 AS provider, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS calls, count(*) FILTER (event_id % 5 = 0) AS failures, round(avg(size), 1) AS avg_ms FROM ev GROUP BY 1, 2"
ORACLES["T9_resume"] = f"WITH {_EV} SELECT event_id, path FROM ev WHERE event_id % 4 = 1"


# Pages

ORACLES["S11_issue_pages"] = """WITH p AS (SELECT *, p_size || '' AS n, p_name || ' #' || p_size AS made FROM part)
SELECT p_partkey AS page_id, p_name AS series, n AS number, CASE WHEN p_partkey % 4 = 0 THEN 'Deep ' || p_type WHEN p_partkey % 4 = 1 THEN 'Tale of ' || p_type WHEN p_partkey % 4 = 2 AND p_partkey % 3 <> 0 THEN 'Part ' || p_type ELSE made END AS title,
  CASE p_partkey % 3 WHEN 0 THEN 'Blue Moon' WHEN 1 THEN 'Red Star' ELSE '' END AS publisher, CAST(CASE WHEN p_partkey % 5 <= 1 THEN 1950 + p_size WHEN p_partkey % 3 = 0 THEN 1999 ELSE 0 END AS INT) AS year, CASE WHEN p_partkey % 5 = 0 THEN 5 WHEN p_partkey % 5 = 1 THEN 6 WHEN p_partkey % 3 = 0 THEN 3 ELSE 0 END AS month,
  CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size % 28 + 1 WHEN p_partkey % 5 = 1 THEN 0 WHEN p_partkey % 3 = 0 THEN 5 ELSE 0 END AS INT) AS day, CASE WHEN p_partkey % 2 = 0 THEN 'The story of ' || p_type ELSE 'About ' || p_name END AS summary FROM p"""
ORACLES["S12_page_creators"] = "SELECT p_partkey AS page_id, r.role, CAST(r.pos AS INT) AS pos, CASE r.name WHEN 'Bob' THEN 'Bob' ELSE 'Ann ' || p_size END AS name FROM part, (VALUES ('writers', 0, 'Ann'), ('pencillers', 1, 'Bob'), ('pencillers', 2, 'Ann')) AS r(role, pos, name)"
ORACLES["S13_page_names"] = """SELECT p_partkey AS page_id, 'characters' AS kind, r.name || CASE WHEN r.name = 'Moss' THEN ' ' || p_size ELSE '' END AS name, CAST(r.pos AS INT) AS pos FROM part, (VALUES ('Moss', 4), ('Fern', 5)) AS r(name, pos)
UNION ALL SELECT p_partkey, k, n, CAST(p AS INT) FROM part, (VALUES ('teams', 'The Six', 8), ('story_arcs', 'Dark Age', 10)) AS t(k, n, p) WHERE p_partkey % 7 = 0"""
ORACLES["S14_search_results"] = """WITH a AS (SELECT *, trim(p_name || ' (' || (1950 + p_size) || ') (' || p_size || ' issues) ' || repeat(p_type || ' ', 12)) AS d FROM part)
SELECT p_partkey AS page_id, '/x/4050-' || p_partkey || '/' AS href, p_name AS name, 'Volume' AS kind, CAST(1950 + p_size AS INT) AS year, CAST(p_size AS INT) AS n_issues, left(d, 160) AS description FROM a
UNION ALL SELECT p_partkey, '/y/4000-' || p_partkey || '/', p_type, 'Issue', 2001, 0, 'of 2001 ' || p_type FROM part"""
