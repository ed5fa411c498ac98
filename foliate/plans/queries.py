"""Linkage queries by the ids of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import names
from foliate.functions import numbers as N
from foliate.functions import text as T
from foliate.operators import arcs as R
from foliate.operators import curate as K
from foliate.operators import decide as D
from foliate.operators import metrics as X
from foliate.operators import score as S
from foliate.plans import resolve as V
from foliate.plans.datasets import derive
from foliate.sources import catalogs as B
from foliate.sources import pages as G
from foliate.sources.tables import written
from foliate.streaming import events as E

#: The time that cache and lease queries take for now, so that their rows do not depend on the clock.
NOW = 1250

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return names.parse_filename(derive(spark, sf, "lib_files"))


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return D.evaluate(D.pool_pairs(parsed(spark, sf), derive(spark, sf, "candidates"), derive(spark, sf, "existing")))


@query("F1_F9_parse_filename")
def _(spark, sf):
    return parsed(spark, sf)


@query("A1_evidence_score")
def _(spark, sf):
    return evaluated(spark, sf).select("file_id", "pool_pos", "score", "n_agree")


@query("A3_conflicts")
def _(spark, sf):
    pairs = D.pool_pairs(parsed(spark, sf), derive(spark, sf, "candidates"))
    told = F.transform(S.conflicts(), lambda c: F.concat(c["type"], F.lit(":"), c["severity"]))
    return pairs.select("file_id", "pool_pos", F.array_join(told, ",").alias("conflicts"))


@query("A2_tier")
def _(spark, sf):
    return evaluated(spark, sf).select("file_id", "pool_pos", "level", "action", "critical")


@query("A4_pool_decision")
def _(spark, sf):
    return D.decide(evaluated(spark, sf)).select(
        "file_id", "provider", "issue_id", "series_name", "issue_number", "publication_year", "score", "second_best", "margin", "ambiguous", "level", "action", "critical", "n_candidates"
    )


# Scalar functions


def scalar(name: str, dataset: str, key: list[str], /, **columns):
    """A query that adds column expressions to a derived table."""

    @query(name)
    def _(spark, sf):
        return derive(spark, sf, dataset).select(*key, *[f().alias(k) for k, f in columns.items()])


c = F.col
scalar("F10_title_form", "candidates", ["file_id", "pool_pos"], form=lambda: T.title_form(c("series_name")))
scalar("F11_key_form", "candidates", ["file_id", "pool_pos"], form=lambda: T.key_form(c("series_name")))
scalar("F12_collection_form", "members", ["collection_id", "pos"], series=lambda: T.collection_form(c("series_name")), publisher_norm=lambda: T.publisher_form(c("publisher")))
scalar("F13_issue_number", "numbers", ["id"], **{k: (lambda k=k: N.issue_number(c("raw"))[k]) for k in ("clean", "number", "suffix", "is_annual", "is_special")})
scalar("F15_issue_order", "numbers", ["id"], **{k: (lambda k=k: N.issue_order(c("raw"))[k]) for k in ("numeric", "suffix", "is_named")})
scalar("F17_batch_number", "lib_files", ["file_id"], number=lambda: N.batch_number(F.element_at(F.split("path", "/"), -1)))
scalar("F18_reading_number", "lib_files", ["file_id"], number=lambda: N.reading_number(F.element_at(F.split("path", "/"), -1)))
scalar("F19_date_parts", "urls", ["id"], **{k: (lambda k=k: T.date_parts(c("day_text"))[k]) for k in ("year", "month", "day")})
scalar("F20_route", "urls", ["id"], source=lambda: T.route(c("url"), "http://kap.local"))
scalar("F21_provider_id", "urls", ["id"], provider_id=lambda: T.provider_id(c("url")))
scalar("F22_creator_form", "urls", ["id"], form=lambda: T.creator_form(c("creator")))
scalar("F23_volume_slug", "urls", ["id"], slug=lambda: T.volume_slug(c("url")))
scalar("F24_arc_form", "arcs", ["id"], form=lambda: T.arc_form(c("arcs")), shown=lambda: T.arc_display(c("arcs")))
scalar("F25_provider_alias", "calls", ["call_id"], name=lambda: T.provider_name(c("provider")))
scalar("F26_mask_secret", "urls", ["id"], masked=lambda: T.mask(c("day_text")), creator_masked=lambda: T.mask(c("creator")))
scalar("F27_redact", "urls", ["id"], shown=lambda: T.redact(c("url")))
scalar("F29_url_list", "urls", ["id"], urls=lambda: F.array_join(T.url_list(F.concat_ws(" ", c("url"), c("day_text"), c("url"))), "|"))
scalar("F30_http_state", "calls", ["call_id"], state=lambda: T.http_state(c("http_status"))["state"], retryable=lambda: T.http_state(c("http_status"))["retryable"])
scalar("F33_target_path", "lib_files", ["file_id"], target=lambda: F.regexp_replace("path", r"(?i)\.cbr$", ".cbz"), is_cbr=lambda: F.lower("path").endswith(".cbr"))
scalar("L5_split_list", "arcs", ["id"], items=lambda: F.array_join(T.split_list(c("arcs")), "|"))
scalar("P1_archive_extension", "lib_files", ["file_id"], is_archive=lambda: F.lower("path").rlike(r"\.cb[zr]$"))
scalar("P4_range_listing", "reading", ["line_id"], is_range=lambda: c("line").rlike(r"#[0-9]+\s*[-–][0-9]+|\([0-9]+-[0-9]+\)"))


@query("F14_same_issue")
def _(spark, sf):
    n = derive(spark, sf, "numbers").select("id", N.issue_number(c("raw")).alias("n"))
    other = n.select((c("id") - 1).alias("id"), c("n").alias("m"))
    return n.join(other, "id").select("id", N.same_issue(c("n"), c("m")).alias("same"))


@query("F16_canonical_key")
def _(spark, sf):
    return K.canonical_key(derive(spark, sf, "candidates")).select(
        "file_id", "pool_pos", "series_norm", "issue_numeric", "issue_suffix", "is_named", "volume_norm", "key_year", "publisher_norm"
    )


@query("F34_identity_type")
def _(spark, sf):
    kind = F.when(c("is_tpb"), "TPB").when(c("is_annual"), "Annual").otherwise("Issue")
    return parsed(spark, sf).select("file_id", kind.alias("identity_type"))


@query("P7_arc_match")
def _(spark, sf):
    return derive(spark, sf, "arcs").select("id", R.arcs_match(F.lit('The "Dark" Age'), c("arcs")).alias("matches"))


@query("P10_input_quarantine")
def _(spark, sf):
    u = F.trim(T.text(c("url")))
    reason = F.when(F.length(u) == 0, "empty").when(F.length(u) > 250, "too long").when(~u.rlike("^https?://[^/]+"), "scheme").otherwise("")
    return derive(spark, sf, "urls").select("id", reason.alias("reason"), (reason == "").alias("good"))


@query("P5_live_cache")
def _(spark, sf):
    return derive(spark, sf, "cache_rows").where((c("schema_version") == "2") & (c("expires_at") > NOW)).select("provider", "kind", "cache_key", "updated_at")


@query("P11_active_jobs")
def _(spark, sf):
    return derive(spark, sf, "leases").where(c("status").isin(K.ACTIVE)).select("job_id", "status")


# Joins


@query("J2_canonical_match")
def _(spark, sf):
    pool = K.canonical_key(derive(spark, sf, "candidates")).withColumn("candidate_id", c("file_id") * 10 + c("pool_pos"))
    files = K.canonical_key(parsed(spark, sf), year="year").select("file_id", *KEYS)
    return K.match_keys(files, pool, "file_id", "candidate_id")


KEYS = ["series_norm", "issue_numeric", "issue_suffix", "is_named", "volume_norm", "key_year"]


@query("J1_title_pairs")
def _(spark, sf):
    return D.title_pairs(parsed(spark, sf), derive(spark, sf, "candidates"))


@query("J3_agreement")
def _(spark, sf):
    pairs = D.pool_pairs(parsed(spark, sf), derive(spark, sf, "candidates"))
    return D.agreement(pairs).select("file_id", "pool_pos", "n_agree")


@query("J4_disagreement")
def _(spark, sf):
    pairs = D.pool_pairs(parsed(spark, sf), derive(spark, sf, "candidates"))
    return D.disagreements(pairs).select("file_id", F.size("disagreements").cast("bigint").alias("n"))


@query("J5_existing_vs_file")
def _(spark, sf):
    pairs = D.pool_pairs(parsed(spark, sf), derive(spark, sf, "candidates"), derive(spark, sf, "existing")).where("pool_pos = 3")
    return pairs.select("file_id", F.size(S.existing_conflicts()).alias("n"))


@query("J6_existing_vs_candidate")
def _(spark, sf):
    pairs = D.pool_pairs(parsed(spark, sf), derive(spark, sf, "candidates"), derive(spark, sf, "existing"))
    return pairs.select("file_id", "pool_pos", F.size(S.existing_candidate_conflicts()).alias("n"))


@query("J7_issue_files")
def _(spark, sf):
    """Each catalog issue with its first file by path."""
    issues = derive(spark, sf, "candidates").select(T.title_form(c("series_name")).alias("s"), N.unpadded(c("issue_number")).alias("n"), "series_name", "issue_number").distinct()
    files = parsed(spark, sf).select(T.title_form(c("series_name")).alias("s"), N.unpadded(c("issue_number")).alias("n"), "path").groupBy("s", "n").agg(F.min("path").alias("path"))
    return issues.join(files, ["s", "n"], "left").select("series_name", "issue_number", F.coalesce("path", F.lit("")).alias("path"))


@query("J8_batch_match")
def _(spark, sf):
    issues = spark.sql("SELECT DISTINCT p_name AS folder, CAST(p_size AS STRING) AS number, concat('u/', p_name, '/', p_size) AS url FROM {part}", part=spark.read.parquet(f"{sf}/part.parquet"))
    files = derive(spark, sf, "lib_files").select("file_id", F.element_at(F.split("path", "/"), -1).alias("name"))
    files = files.join(spark.read.parquet(f"{sf}/part.parquet").select(c("p_partkey").alias("file_id"), c("p_name").alias("folder")), "file_id")
    return K.match_batch(issues, files)


@query("J9_reading_files")
def _(spark, sf):
    return R.reading_files(R.expand_ranges(derive(spark, sf, "reading")), derive(spark, sf, "lib_files"))


@query("J10_changed_files")
def _(spark, sf):
    return K.new_or_changed(derive(spark, sf, "seen_files"), derive(spark, sf, "known_files")).select("seen_id", "path")


@query("J11_job_dedup")
def _(spark, sf):
    return K.without_active_jobs(derive(spark, sf, "seen_files"), derive(spark, sf, "leases")).select("seen_id", "path", "sha256")


@query("J12_manifest_diff")
def _(spark, sf):
    return K.manifest_diff(derive(spark, sf, "manifest"), derive(spark, sf, "manifest_new"))


@query("J13_uncovered_folders")
def _(spark, sf):
    local = derive(spark, sf, "lib_files").select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()
    covered = derive(spark, sf, "existing").select(F.concat("series", F.lit(" ("), "year", F.lit(")")).alias("folder")).distinct()
    return local.join(covered, "folder", "left_anti")


@query("J15_cache_lookup")
def _(spark, sf):
    cache = derive(spark, sf, "cache_rows")
    asked = cache.select("kind", F.concat(F.lit(" "), F.upper("cache_key")).alias("cache_key")).distinct()
    return K.cache_lookup(asked, cache, NOW, "2").select("kind", "cache_key", "hit_provider", "data_json")


# Aggregates and windows


@query("A5_list_union")
def _(spark, sf):
    rows = derive(spark, sf, "members").select("collection_id", "pos", F.split("writers", ";").alias("w"))
    return K.union_lists(rows, "collection_id", "pos", "w").select("collection_id", F.array_join("items", "|").alias("items"))


@query("A6_merge_simple")
def _(spark, sf):
    return K.merge_issues(derive(spark, sf, "members"))


@query("A7_merge_policy")
def _(spark, sf):
    return K.merge_issues(derive(spark, sf, "members"), policy=True, **overrides(spark, sf))


def overrides(spark, sf):
    """Each collection's own values, most of them blank, and its publisher in the catalog."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")

    def own(n, value, blank):
        return F.when(c("o_orderkey") % n == 0, value).otherwise(blank)

    over = orders.select(
        c("o_orderkey").alias("collection_id"), own(12, c("o_orderpriority"), "").alias("title"), F.lit("").alias("publisher"), own(18, 1999, 0).alias("year"), F.lit(5).alias("month"), F.lit(0).alias("day"),
        F.lit("").alias("summary"), own(6, "own", "").alias("notes"), F.lit("").alias("web"), own(30, "oid", "").alias("provider_id"),
    )
    return {"override": over, "identity": orders.select(c("o_orderkey").alias("collection_id"), own(12, "Kap", "").alias("publisher"))}


@query("A8_collection_validation")
def _(spark, sf):
    return K.validate_collections(derive(spark, sf, "members"))


@query("A9_library_status")
def _(spark, sf):
    folder = F.element_at(F.split("path", "/"), -2).alias("folder")
    files = derive(spark, sf, "lib_files").select("path", folder, (c("file_id") % 3 != 0).alias("has_metadata"))
    volumes = derive(spark, sf, "existing").groupBy(F.concat("series", F.lit(" ("), "year", F.lit(")")).alias("folder")).agg(F.count("*").alias("issue_count"))
    return X.library_status(files, volumes)


@query("A10_reading_coverage")
def _(spark, sf):
    entries = written(R.expand_ranges(derive(spark, sf, "reading")), "lines")
    hits = R.reading_files(entries, derive(spark, sf, "lib_files"))
    tags = derive(spark, sf, "lib_files").groupBy("path").agg(F.max(F.when(c("file_id") % 4 == 0, "Long Dark").otherwise("")).alias("tag"))  # the files' arc tags
    found = entries.join(hits, ["series", "number"], "left").join(tags, "path", "left")
    named = R.arcs_match(F.lit('The "Dark" Age'), T.text(c("tag")))
    return X.coverage(found.select(c("path").isNotNull().alias("is_found"), F.coalesce(F.lower("path").endswith(".cbz"), F.lit(False)).alias("is_tagged"), named.alias("is_arc_tagged")))


@query("A11_job_metrics")
def _(spark, sf):
    return X.job_outcomes(derive(spark, sf, "jobs"), ["job_id"], order="event_id")


@query("A12_provider_metrics")
def _(spark, sf):
    return X.provider_health(derive(spark, sf, "calls"))


@query("A13_cache_stats")
def _(spark, sf):
    return X.cache_stats(derive(spark, sf, "cache_rows"), NOW)


@query("A14_resolution_rates")
def _(spark, sf):
    return X.resolution_rates(D.decide(evaluated(spark, sf)).withColumn("is_right", c("issue_number") != "99"), seconds=60.0)


@query("W1_ranked_pool")
def _(spark, sf):
    return D.rank(evaluated(spark, sf)).select("file_id", "pool_pos", "rank")


@query("W4_first_per_provider")
def _(spark, sf):
    return K.first_by(derive(spark, sf, "calls"), ["provider"], ["call_id"]).select("provider", "call_id")


@query("W5_reading_position")
def _(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("series").orderBy("line_id", "at"))
    entries = written(R.expand_ranges(derive(spark, sf, "reading")), "lines")
    found = R.reading_files(entries, derive(spark, sf, "lib_files")).select("series", "number")
    return entries.select("series", "line_id", "at", "number", place.alias("arc_number")).join(found, ["series", "number"], "left_semi")


@query("W6_latest_row")
def _(spark, sf):
    return K.latest(derive(spark, sf, "known_files"), ["path"], "updated_at").select("path", "updated_at", "status")


@query("W7_oldest_job")
def _(spark, sf):
    return K.first_by(derive(spark, sf, "leases").where("status in ('PENDING', 'RETRYING')"), ["path"], ["created_at", "job_id"]).select("path", "job_id")


@query("O1_natural_order")
def _(spark, sf):
    o = N.issue_order(c("issue_number"))
    ordered = F.sort_array(F.collect_list(F.struct(o["numeric"].alias("a"), o["suffix"].alias("b"), "pos", c("issue_number").alias("raw"))))
    return derive(spark, sf, "members").groupBy("collection_id").agg(F.array_join(F.transform(ordered, lambda x: x["raw"]), ",").alias("numbers"))


@query("O2_digits_order")
def _(spark, sf):
    return derive(spark, sf, "numbers").select("id", N.digits_order(c("raw")).alias("place"))


@query("O3_newest_jobs")
def _(spark, sf):
    return derive(spark, sf, "leases").where("status = 'FAILED'").orderBy(F.desc("created_at"), "job_id").limit(100).select("job_id", "created_at")


@query("U1_candidate_pool")
def _(spark, sf):
    local = parsed(spark, sf).select("file_id", F.lit(0).alias("pool_pos"), F.lit("Filename").alias("provider"), "series_name", "issue_number")
    return local.unionByName(derive(spark, sf, "candidates").select("file_id", "pool_pos", "provider", "series_name", "issue_number"))


@query("U3_entry_difference")
def _(spark, sf):
    a, b = derive(spark, sf, "manifest"), derive(spark, sf, "manifest_new")
    return a.select("archive", F.lower("entry").alias("entry")).exceptAll(b.select("archive", F.lower("entry").alias("entry")))


# Arc tags, maintenance


@query("L1_range_expansion")
def _(spark, sf):
    return R.expand_ranges(derive(spark, sf, "reading")).select("line_id", "at", "series", "number", "title")


def told(tags):
    return F.array_join(F.transform(tags, lambda t: F.concat(t["arc"], F.lit("="), t["num"])), "|")


@query("L2_tag_list")
def _(spark, sf):
    return derive(spark, sf, "arcs").select("id", told(R.tag_list(c("arcs"), c("nums"))).alias("tags"))


@query("L3_arc_upsert")
def _(spark, sf):
    tags = R.tag_list(c("arcs"), c("nums"), c("pos").cast("string"))
    return derive(spark, sf, "arcs").select("id", told(R.upsert_arc(tags, F.lit("Night One"), c("pos"))).alias("tags"))


@query("L4_arc_rename")
def _(spark, sf):
    return derive(spark, sf, "arcs").select("id", told(R.rename_arc(R.tag_list(c("arcs"), c("nums")), F.lit("night one"), F.lit("Dawn"))).alias("tags"))


@query("M1_cache_upsert")
def _(spark, sf):
    cache = derive(spark, sf, "cache_rows")
    fresh = cache.where("updated_at % 5 = 0").select("provider", "kind", "cache_key").distinct().withColumn("data_json", F.lit("new"))
    return K.cache_upsert(cache, fresh, NOW, "3")


@query("M2_cache_invalidate")
def _(spark, sf):
    cache = derive(spark, sf, "cache_rows")
    return K.cache_invalidate(cache, cache.where("updated_at % 7 = 0")).select("provider", "kind", "cache_key", "updated_at", c("expires_at").cast("bigint").alias("expires_at"))


@query("M3_cache_purge")
def _(spark, sf):
    return K.cache_purge(derive(spark, sf, "cache_rows"), NOW).select("provider", "kind", "cache_key", "updated_at")


@query("M4_stale_versions")
def _(spark, sf):
    return derive(spark, sf, "cache_rows").where("schema_version = '2'").select("provider", "kind", "cache_key", "updated_at")


@query("M7_expired_leases")
def _(spark, sf):
    return K.expire_leases(derive(spark, sf, "leases"), 500).select("job_id", "status", "error_code")


# Compositions


def resolved(spark, sf):
    return V.resolve(parsed(spark, sf), derive(spark, sf, "candidates"), derive(spark, sf, "existing"), derive(spark, sf, "cached"), derive(spark, sf, "overrides"))


@query("Q2_existing_state")
def _(spark, sf):
    existing = derive(spark, sf, "existing").withColumn("malformed", c("file_id") % 35 == 0)
    return V.classify_existing(parsed(spark, sf), existing).select("file_id", "state", F.coalesce("score", F.lit(0.0)).alias("score"))


@query("Q3_resolve")
def _(spark, sf):
    return resolved(spark, sf).select("file_id", "provider", "series_name", "issue_number", "score", "level", "action", "source", "fallback_used", "fallback_reason")


def records(spark, sf):
    """Catalog records by provider and issue id; some lack their titles."""
    pool = derive(spark, sf, "candidates").where("issue_id <> ''")
    blank = F.pmod(F.col("file_id"), F.lit(14)) == 0
    row = F.struct(
        F.when(blank, "").otherwise(F.col("series_name")).alias("record_series"), F.when(blank, "").otherwise(F.concat("series_name", F.lit(" #"), "issue_number")).alias("record_title"),
        F.col("issue_number").alias("record_number"), F.col("publisher").alias("record_publisher"), F.col("publication_year").alias("record_year"),
        F.when(c("file_id") % 2 == 0, "Ann").otherwise("").alias("record_writers"), F.lit("").alias("record_pencillers"), F.when(c("file_id") % 3 == 0, "Fern").otherwise("").alias("record_characters"), F.when(c("file_id") % 4 == 1, "Long ago").otherwise("").alias("record_summary"),
    )
    return pool.where("file_id % 9 <> 0").groupBy("provider", "issue_id").agg(F.min_by(row, "file_id").alias("r")).select("provider", "issue_id", "r.*")


@query("J14_retrieval")
def _(spark, sf):
    failed = derive(spark, sf, "candidates").where("provider = 'Kapowarr' AND issue_id <> ''").where("file_id % 31 = 0")  # calls that failed
    return V.retrieve(resolved(spark, sf), records(spark, sf), failed).select("file_id", "state", F.coalesce("record_title", F.lit("")).alias("title"))


@query("Q5_plan")
def _(spark, sf):
    files = derive(spark, sf, "lib_files")
    return V.plan_files(V.retrieve(resolved(spark, sf), records(spark, sf)), files, derive(spark, sf, "existing"))


@query("Q7_review")
def _(spark, sf):
    """Files to review with their best-scored candidate."""
    best = evaluated(spark, sf).groupBy("file_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "pool_pos", "provider", "series_name")).alias("r"))
    review = resolved(spark, sf).where("action = 'REVIEW'").select("file_id", "score")
    return review.join(best, "file_id").select("file_id", "score", F.col("r.provider").alias("recommended"), F.col("r.series_name").alias("series_name"), (-F.col("r.s")).alias("best_score"))


@query("Q12_incremental_ingest")
def _(spark, sf):
    """New and changed files without an active job are planned; the hash table then knows those that were written."""
    files = derive(spark, sf, "lib_files").select(
        "file_id", F.concat(F.lit("/lib/f"), "file_id").alias("path"), (c("file_id") % 97).cast("bigint").alias("size"), (c("file_id") % 89).cast("bigint").alias("mtime"), F.concat(F.lit("h"), (c("file_id") % 83)).alias("sha256"), c("file_id").alias("seen_id"),
    )
    known = files.where("file_id % 3 <> 0").select("path", "size", F.when(c("file_id") % 5 == 0, c("mtime") + 1).otherwise(c("mtime")).alias("mtime"), "sha256", F.lit("SUCCESS").alias("status"), F.lit(1).cast("bigint").alias("updated_at"))
    jobs = files.select("path", "sha256", F.when(c("file_id") % 13 == 0, "RUNNING").otherwise("COMPLETED").alias("status"))
    fresh = K.without_active_jobs(K.new_or_changed(files, known), jobs)
    some = parsed(spark, sf).join(fresh.select("file_id"), "file_id", "left_semi")
    won = V.resolve(some, derive(spark, sf, "candidates"), derive(spark, sf, "existing"), derive(spark, sf, "cached"), derive(spark, sf, "overrides"))
    plan = V.plan_files(V.retrieve(won, records(spark, sf)), derive(spark, sf, "lib_files").join(fresh.select("file_id"), "file_id", "left_semi"), derive(spark, sf, "existing"))
    done = fresh.join(plan.where("action IN ('UPDATE', 'EMBED')").select("file_id", c("action").alias("status")), "file_id")
    return K.hash_upsert(known, done, NOW)


@query("Q10_collection_build")
def _(spark, sf):
    """Accepted collections, merged."""
    members = derive(spark, sf, "members", shared=True)
    good = K.validate_collections(members).where("n_problems = 0").select("collection_id").hint("merge")  # both sides lie by collection
    return K.merge_issues(members.join(good, "collection_id", "left_semi"), policy=True, **overrides(spark, sf))


# Streams' batch twins, pages and sinks


def file_events(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.when(c("event_id") % 11 == 0, "moved").when(c("event_id") % 7 == 0, "deleted").when(c("event_id") % 2 == 0, "created").otherwise("modified")
    return e.select(
        "event_id", c("ts").cast("timestamp").alias("ts"), F.concat(F.lit("/lib/"), "user_id", F.lit(".cbz")).alias("path"), F.concat(F.lit("/new/"), "user_id", F.lit(".cbz")).alias("dest_path"),
        kind.alias("event_type"), F.floor("value").alias("size"),
    )


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("T1_debounce")
def _(spark, sf):
    e = file_events(spark, sf).withColumn("ts", F.date_trunc("second", "ts"))
    return E.debounce(e, "30 minutes").groupBy("path").agg(F.count("*").alias("bursts"), F.max("n_events").alias("largest"), F.min(F.date_format("started", "yyyy-MM-dd HH:mm:ss")).alias("first"))


@query("T2_moves")
def _(spark, sf):
    return E.split_moves(file_events(spark, sf)).select("event_id", "path", "event_type")


@query("T5_archive_events")
def _(spark, sf):
    return E.only_archives(file_events(spark, sf)).select("event_id", "path")


@query("T6_new_jobs")
def _(spark, sf):
    e = file_events(spark, sf).withColumn("sha256", (c("size") % 5).cast("string"))
    return E.new_jobs(e).select("path", "sha256")


@query("T7_job_lifecycle")
def _(spark, sf):
    jobs = derive(spark, sf, "jobs").withColumn("ts", c("ts").cast("timestamp"))
    return E.lifecycle(jobs)


@query("T8_windowed_metrics")
def _(spark, sf):
    jobs = derive(spark, sf, "jobs").withColumn("ts", c("ts").cast("timestamp"))
    return E.windowed_outcomes(jobs).withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


@query("S11_issue_pages")
def _(spark, sf):
    return G.issue_records(G.issue_page_texts(derive(spark, sf, "issue_pages")))


@query("S11_page_titles")
def _(spark, sf):
    return G.page_titles(G.page_parts(spark.read.parquet(f"{sf}/pages.parquet")))


@query("S12_page_creators")
def _(spark, sf):
    return G.creators(G.issue_page_texts(derive(spark, sf, "issue_pages")))


@query("S13_page_names")
def _(spark, sf):
    return G.page_names(G.issue_page_texts(derive(spark, sf, "issue_pages")))


@query("S13_page_links")
def _(spark, sf):
    return G.links(G.page_parts(spark.read.parquet(f"{sf}/pages.parquet"))).select("page_id", "pos", "href", "name")


@query("S14_search_results")
def _(spark, sf):
    return G.search_results(G.links(G.page_parts(derive(spark, sf, "search_pages"))))


@query("S18_record_json")
def _(spark, sf):
    """Records to JSON and back, with the defaults of missing fields; lists go as text between commas."""
    x = derive(spark, sf, "existing").withColumn("people", F.concat(c("title"), F.lit(", Ann ,, Bob")))
    text = F.to_json(F.struct("series", "title", "number", "year", F.nullif("volume", F.lit("")).alias("volume"), F.nullif("publisher", F.lit("")).alias("publisher"), "web", "people"))
    back = F.from_json(text, "series string, title string, number string, year int, volume string, publisher string, web string, people string, count int, language string")
    r = x.select("file_id", back.alias("r"))
    blank = {k: F.coalesce(f"r.{k}", F.lit("")).alias(k) for k in ("volume", "publisher", "web", "language")}
    return r.select("file_id", "r.series", "r.title", "r.number", "r.year", *blank.values(), F.coalesce("r.count", F.lit(1)).alias("count"), F.array_join(T.split_list(c("r.people")), "|").alias("writers"))


@query("S20_job_event_lines")
def _(spark, sf):
    line = F.concat_ws(" ", F.concat(F.lit("job_id="), "job_id"), F.concat(F.lit("status="), "status"), F.when(c("status") == "FAILED", F.lit("error=1")))
    as_json = F.to_json(F.struct("job_id", "status", F.when(c("status") == "FAILED", F.lit("1")).alias("error")))
    return derive(spark, sf, "jobs").select("event_id", line.alias("line"), as_json.alias("json"))


@query("S7_catalog_volumes")
def _(spark, sf):
    return B.volumes(derive(spark, sf, "catalog_json")).select("row_id", "volume_id", "series", "year", "issue_id", "number")


@query("S8_issue_index")
def _(spark, sf):
    return B.issue_index(B.volumes(derive(spark, sf, "catalog_json")), "row_id").select("issue_id", "row_id", "number")


@query("S9_issue_record")
def _(spark, sf):
    return B.issue_record(B.issue_index(B.volumes(derive(spark, sf, "catalog_json")), "row_id"))


@query("S19_review_reports")
def _(spark, sf):
    decided = D.decide(evaluated(spark, sf)).where("action = 'REVIEW'")
    return B.review_reports(decided.join(derive(spark, sf, "lib_files"), "file_id"))


@query("S10_related_records")
def _(spark, sf):
    return B.related_records(*[derive(spark, sf, f"related_{x}") for x in ("issues", "series", "publishers")])


@query("S15_volume_issues")
def _(spark, sf):
    return G.volume_issues(derive(spark, sf, "volume_pages"))


@query("S16_reading_entries")
def _(spark, sf):
    return G.reading_entries(G.page_parts(derive(spark, sf, "order_pages")))
