"""Queries over catalogs as data sources, sinks, stored versions, pools and tables of searches, each with its DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from foliate.operators import curate as K
from foliate.operators import editions as E
from foliate.operators import pools as P
from foliate.operators import versions as V
from foliate.plans import resolve as R
from foliate.plans.datasets import derive, duck
from foliate.plans.oracles import _ACTION, PARSED, RESOLVED, title
from foliate.plans.queries import NOW, QUERIES, parsed, query
from foliate.plans.searches import _CR, ORACLES
from foliate.sources import connectors as C
from foliate.sources.tables import shared_dir, spread, written

c = F.col


# Catalogs, reports and logs in folders


@query("S21_catalog_source")
def _(spark, sf):
    """A vendor's files read through the catalog data source."""
    C.register(spark)
    folder = shared_dir(spark)
    derive(spark, sf, "vendor_rows").write.json(folder)
    columns = {"series_name": "label", "issue_number": "issue_no", "publication_year": "yr", "issue_id": "code"}
    return spark.read.format("vendor_catalog").option("path", folder).option("provider", "Vendor").option("columns", json.dumps(columns)).load()


ORACLES["S21_catalog_source"] = ORACLES["S21_pluggable_catalog"]


@query("S19_review_files")
def _(spark, sf):
    """Reports written as one file each, and read back."""
    C.register(spark)
    folder = shared_dir(spark)
    reports = written(QUERIES["S19_review_reports"](spark, sf), "reports")  # read twice for the names
    C.write_reports(spread(C.unique_names(reports), "name"), folder)  # a file is dear, its row is small
    return C.read_reports(spark, folder)


ORACLES["S19_review_files"] = f"""SELECT CASE WHEN k > 1 THEN replace(name, '.md', '_' || k || '.md') ELSE name END AS name, report
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_id) AS k FROM ({ORACLES["S19_review_reports"]}))"""


def job_events(spark, sf):
    jobs = derive(spark, sf, "jobs")
    failed = c("status") == "FAILED"
    return jobs.select(
        "event_id", F.concat(F.lit("j"), "job_id").alias("job_id"), F.concat(F.lit("/lib/"), c("job_id").cast("string"), F.lit(".cbz")).alias("archive"), F.when(c("event_id") % 3 > 0, F.sha2(c("job_id").cast("string"), 256)).otherwise("").alias("sha256"),
        F.when(c("event_id") % 2 == 0, "ComicVine").otherwise("").alias("provider"), F.when(c("event_id") % 4 == 0, F.concat(F.lit("4000-"), "job_id")).alias("provider_id"), c("value").alias("confidence"), "status", (c("value") * 4).alias("duration_ms"),
        F.when(failed, "E1").otherwise("").alias("error_code"), F.when(failed & (c("event_id") % 2 == 0), "it's gone").when(failed, 'no "entry"').otherwise("").alias("error_message"),
    )


@query("S20_event_log")
def _(spark, sf):
    """Job events as lines of logs, one log a task, read back."""
    C.register(spark)
    folder = shared_dir(spark)
    C.write_log(job_events(spark, sf).select(C.event_line().alias("line")), folder)
    return spark.read.text(folder).select(c("value").alias("line"))


@query("S20_event_json")
def _(spark, sf):
    told = job_events(spark, sf).select("event_id", F.from_json(C.event_json(), "job_id string, archive string, sha256 string, provider string, provider_id string, confidence double, status string, duration_ms double, error_code string, error_message string").alias("e"))
    return told.select("event_id", "e.*")


_EVENTS = f"""{duck("jobs")}, je AS (SELECT event_id, 'j' || job_id AS job_id, '/lib/' || job_id || '.cbz' AS archive, CASE WHEN event_id % 3 > 0 THEN sha256(CAST(job_id AS VARCHAR)) ELSE '' END AS sha256,
  CASE WHEN event_id % 2 = 0 THEN 'ComicVine' ELSE '' END AS provider, CASE WHEN event_id % 4 = 0 THEN '4000-' || job_id ELSE '' END AS provider_id, value AS confidence, status, value * 4 AS duration_ms,
  CASE WHEN status = 'FAILED' THEN 'E1' ELSE '' END AS error_code, CASE WHEN status <> 'FAILED' THEN '' WHEN event_id % 2 = 0 THEN 'it''s gone' ELSE 'no "entry"' END AS error_message FROM jobs)"""
ORACLES["S20_event_log"] = f"""WITH {_EVENTS} SELECT concat_ws(' ', 'job=' || job_id, 'archive=' || archive, 'sha256=' || nullif(left(sha256, 12), '') || '…', 'provider=' || nullif(provider, ''), 'issue=' || nullif(provider_id, ''),
  CASE WHEN confidence <> 0 THEN 'confidence=' || CAST(round_even(confidence, 0) AS BIGINT) END, 'status=' || status, CASE WHEN duration_ms <> 0 THEN 'duration=' || CAST(round_even(duration_ms, 0) AS BIGINT) || 'ms' END, 'error_code=' || nullif(error_code, ''),
  'error=' || CASE WHEN error_message = '' THEN NULL WHEN contains(error_message, '''') THEN '"' || error_message || '"' ELSE '''' || error_message || '''' END) AS line FROM je"""
ORACLES["S20_event_json"] = f"WITH {_EVENTS} SELECT event_id, job_id, archive, sha256, provider, provider_id, confidence, status, duration_ms, error_code, error_message FROM je"


@query("S18_whole_records")
def _(spark, sf):
    """Records of all fields to JSON and back; lists go as arrays, or as text between commas."""
    m = derive(spark, sf, "members")
    texts = {x: F.split(x, ";") if x in ("writers", "characters", "teams") else F.regexp_replace(x, ";", ",") for x in C.LISTS}
    given = m.withColumns({**texts, "series": c("series_name"), "number": c("issue_number"), "volume": c("volume_id"), "language": F.when(c("language") != "", c("language")), "provider": F.lit("CV")})
    back = given.select("collection_id", "pos", C.record_from_json(C.record_to_json(given.columns)).alias("r")).select("collection_id", "pos", "r.*")
    return back.select("collection_id", "pos", *C.TEXTS, *C.NUMBERS, *[F.array_join(x, "|").alias(x) for x in C.LISTS])


def _parted(x: str) -> str:
    cut = ";" if x in ("writers", "characters", "teams") else ","
    given = x if cut == ";" else f"replace({x}, ';', ',')"
    return f"array_to_string([trim(y) FOR y IN string_split({given}, '{cut}') IF trim(y) <> ''], '|') AS {x}"


ORACLES["S18_whole_records"] = f"""WITH {duck("members")} SELECT collection_id, pos, title, series_name AS series, issue_number AS number, volume_id AS volume, summary, notes, publisher, genre, web, CASE WHEN language = '' THEN 'en' ELSE language END AS language, 'Comic' AS format,
  CAST(1 AS INT) AS count, year, month, day, {", ".join(_parted(x) for x in C.LISTS)} FROM members"""


# Stored versions


@query("M1_stored_cache")
def _(spark, sf):
    """The cache as a stored table, new rows upserted into it."""
    cache = derive(spark, sf, "cache_rows").withColumn("expires_at", c("expires_at").cast("bigint"))
    table = V.Versions(shared_dir(spark), ("provider", "kind", "cache_key"), 16)
    table.upsert(cache, V.newest(table.keys, F.desc("updated_at")))
    fresh = cache.where("updated_at % 5 = 0").select(*table.keys).distinct().withColumn("data_json", F.lit("new"))
    table.upsert(fresh, lambda old, new: K.cache_upsert(old, new, NOW, "3"), cache.schema)
    return table.read(spark, cache.schema)


@query("M5_stored_hashes")
def _(spark, sf):
    """The file-hash table as a stored one, files processed since upserted into it."""
    known = derive(spark, sf, "known_files")
    seen = K.first_by(derive(spark, sf, "seen_files"), ["path"], [F.desc("seen_id")])
    table = V.Versions(shared_dir(spark), ("path",), 16)
    table.upsert(known, V.newest(table.keys, F.desc("updated_at")))
    done = seen.where("seen_id % 2 = 0").withColumn("status", F.lit("SUCCESS"))
    table.upsert(done, lambda old, new: K.hash_upsert(old, new, NOW), known.schema)
    return table.read(spark, known.schema)


ORACLES["M1_stored_cache"] = ORACLES["M1_cache_upsert"]
ORACLES["M5_stored_hashes"] = ORACLES["M5_hash_upsert"]


# Pools and searches by tables of queries


def catalog(spark, sf):
    """All catalogs' rows, without the files that they were made from."""
    return derive(spark, sf, "candidates").where("provider <> 'Filename'").drop("file_id", "pool_pos").distinct()


@query("J1_catalog_pools")
def _(spark, sf):
    """Each file's best candidates of each catalog, found by its title and number."""
    return P.pools(parsed(spark, sf), catalog(spark, sf))


@query("Q3_from_catalogs")
def _(spark, sf):
    """Identities settled from the catalogs' tables alone: pools are found, then resolved."""
    found = P.pools(parsed(spark, sf), catalog(spark, sf))
    named = derive(spark, sf, "candidates").where("provider = 'Filename'")
    pool = named.unionByName(found.withColumn("pool_pos", c("pool_pos") + 1))
    out = R.resolve(parsed(spark, sf), pool, derive(spark, sf, "existing"), derive(spark, sf, "cached"), derive(spark, sf, "overrides"))
    return out.select("file_id", "provider", "series_name", "issue_number", "score", "level", "action", "source")


_POOLS = f"""cat AS (SELECT DISTINCT provider, issue_id, series_id, series_name, issue_number, publication_year, publisher, volume, {title("series_name")} AS t, ltrim(issue_number, '0') AS tn FROM made WHERE provider <> 'Filename'),
own AS (SELECT file_id, {title("series_name")} AS f, ltrim(issue_number, '0') AS fn, year AS fy FROM parsed),
tp AS (SELECT f, t FROM (SELECT DISTINCT f FROM own WHERE f <> '') CROSS JOIN (SELECT DISTINCT t FROM cat WHERE t <> '') WHERE contains(t, f) OR starts_with(f, t)),
pk AS (
  SELECT own.file_id, cat.*, row_number() OVER (PARTITION BY own.file_id, provider ORDER BY t = f DESC, tn = fn DESC, CASE WHEN fy > 0 AND publication_year > 0 THEN abs(fy - publication_year) ELSE 1000 END, issue_id, series_id, series_name, issue_number, publication_year, publisher, volume) AS k
  FROM own JOIN tp USING (f) JOIN cat USING (t) WHERE fn = '' OR tn = '' OR tn = fn),
pool AS (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY provider, k) AS INT) AS pool_pos, provider, issue_id, series_id, series_name, issue_number, publication_year, publisher, volume FROM pk WHERE k <= 5)"""
_MADE = duck("candidates").replace("candidates AS", "made AS", 1)
ORACLES["J1_catalog_pools"] = f"WITH {PARSED}, {_MADE}, {_POOLS} SELECT * FROM pool"
ORACLES["Q3_from_catalogs"] = RESOLVED.replace(duck("candidates").replace("candidates AS", "candidates0 AS", 1), f"{_MADE}, {_POOLS}, candidates0 AS (SELECT * FROM made WHERE provider = 'Filename' UNION ALL BY NAME SELECT * REPLACE (pool_pos + 1 AS pool_pos) FROM pool)") + f" SELECT file_id, provider, series_name, issue_number, score, level, {_ACTION} AS action, source FROM re"


def asked(spark, sf):
    """Many queries: parts of titles, short ones, numbers, kinds of issues, some that nothing holds."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    k = c("p_partkey")
    given = F.array(
        F.concat(F.lit(" "), F.substring("p_name", 2, 6)), F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1)), F.concat(F.lit("#"), c("p_size")), F.concat(F.lit("Issue "), c("p_size")), F.concat("p_name", F.lit(" "), k), F.lit(" ")
    )
    return part.select(F.explode(given).alias("query")).distinct()


def titled(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    name = F.when(c("p_partkey") % 5 == 0, "").when(c("p_partkey") % 7 == 0, F.concat("p_name", F.lit(" "), c("p_partkey") + 7)).otherwise(c("p_name"))
    return part.select(c("p_partkey").alias("issue_id"), name.alias("title"), c("p_size").cast("string").alias("number"))


@query("P2_search_table")
def _(spark, sf):
    """Issues found by each of a table of queries, counted by query."""
    return P.search_many(titled(spark, sf), asked(spark, sf)).groupBy("query").agg(F.count("*").alias("found"), F.min("issue_id").alias("first"), F.min("shown").alias("shown"))


@query("U2_search_table")
def _(spark, sf):
    """Catalogs' series found by each of a table of queries."""
    return P.search_series(catalog(spark, sf), asked(spark, sf)).select("query", "provider", "series_name").distinct()


_ASKED = """aq AS (SELECT DISTINCT trim(lower(q)) AS query FROM (SELECT unnest([' ' || substr(p_name, 2, 6), upper(p_name[1]) || p_name[2], '#' || p_size, 'Issue ' || p_size, p_name || ' ' || p_partkey, ' ']) AS q FROM part) WHERE trim(q) <> '')"""
ORACLES["P2_search_table"] = f"""WITH {_ASKED}, i AS (SELECT p_partkey AS issue_id, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN p_name || ' ' || (p_partkey + 7) ELSE p_name END AS title, CAST(p_size AS VARCHAR) AS number FROM part)
SELECT query, count(*) AS found, min(issue_id) AS first, min(CASE WHEN title <> '' THEN title ELSE 'Issue #' || number END) AS shown FROM aq JOIN i ON contains(lower(title), query) OR contains('issue ' || number, query) OR contains('#' || number, query) GROUP BY query"""
ORACLES["U2_search_table"] = f"WITH {_MADE}, {_ASKED} SELECT DISTINCT query, provider, series_name FROM aq JOIN made ON provider <> 'Filename' AND contains(lower(series_name), query)"


# Editions by classes


def keyed(spark, sf, blank: int):
    """Files and candidates with canonical keys; every `blank`-th row has no series and the number 1."""
    pool = derive(spark, sf, "candidates").withColumn("candidate_id", c("file_id") * 10 + c("pool_pos"))

    def some(rows, year):
        hot = c("file_id") % blank == 0
        return K.canonical_key(rows.withColumns({"series_name": F.when(hot, "").otherwise(c("series_name")), "issue_number": F.when(hot, "1").otherwise(c("issue_number"))}), year=year)

    return some(parsed(spark, sf), "year"), some(pool, "publication_year")


@query("J2_matched_classes")
def _(spark, sf):
    """Candidates that each file matches, a third of all rows being without series and numbered 1."""
    files, pool = keyed(spark, sf, 3)
    return E.matches(E.match_classes(files, pool), E.members(files, "file_id")).select(c("row_id").alias("file_id"), "n_matches")


_J2 = ORACLES["J2_canonical_match"]
_HOT = "* REPLACE (CASE WHEN file_id % 3 = 0 THEN '' ELSE series_name END AS series_name, CASE WHEN file_id % 3 = 0 THEN '1' ELSE issue_number END AS issue_number)"
ORACLES["J2_matched_classes"] = "SELECT left_id AS file_id, count(*) AS n_matches FROM (" + _J2.replace("FROM parsed", f"FROM (SELECT {_HOT} FROM parsed)").replace("FROM candidates", f"FROM (SELECT {_HOT} FROM candidates)") + ") GROUP BY 1"
