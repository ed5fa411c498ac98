"""The resolution waterfall and what follows it, as operations on whole tables.

Stages run in a fixed order, each written once; each takes the files that none before settled:
override, embedded record, cache, then pools that grow by one catalog at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import names
from foliate.functions.text import provider_id, route, text, url_list
from foliate.operators import decide as D
from foliate.operators import score as S
from foliate.sources.tables import written

#: Catalogs in the order they are asked, with the name their result is stamped with.
CATALOGS = [("Kapowarr", "kapowarr"), ("ComicVine", "comicvine_fallback"), ("GCD", "gcd_fallback")]
RESULT = ["file_id", "provider", "issue_id", "series_name", "issue_number", "publication_year", "score", "level", "action", "critical", "source"]


def inherit(candidates: DataFrame, parsed: DataFrame) -> DataFrame:
    """Catalog results without a number or series take the file's own."""
    own = parsed.select("file_id", F.col("issue_number").alias("_n"), F.col("series_name").alias("_s"))
    both = candidates.join(own, "file_id")
    return both.withColumns(
        {
            "issue_number": F.when(text(F.col("issue_number")) == "", F.col("_n")).otherwise(F.col("issue_number")),
            "series_name": F.when(text(F.col("series_name")) == "", F.col("_s")).otherwise(F.col("series_name")),
        }
    ).drop("_n", "_s")


def classify_existing(parsed: DataFrame, existing: DataFrame) -> DataFrame:
    """state (MISSING, VALID, PARTIAL, CONFLICTING, MALFORMED), score and id of each file's embedded record.

    A record that cannot be read (column malformed, if there is one) is MALFORMED; only
    zip archives hold records, so files of any other kind are MISSING.
    """
    series = F.when(text(F.col("series")) != "", F.col("series")).otherwise(F.col("title"))
    issue_id = F.regexp_extract("web", r"comicvine\.gamespot\.com/.*?/4000-([0-9]+)", 1)
    cand = existing.select(
        "file_id",
        F.lit(0).alias("pool_pos"),
        F.lit("ExistingXML").alias("provider"),
        F.when(issue_id != "", F.concat(F.lit("4000-"), issue_id)).otherwise("").alias("issue_id"),
        F.lit("").alias("series_id"),
        series.alias("series_name"),
        F.col("number").alias("issue_number"),
        F.col("year").alias("publication_year"),
        "publisher",
        "volume",
    )
    bad = F.coalesce(F.col("malformed"), F.lit(False)) if "malformed" in existing.columns else F.lit(False)
    broken = existing.where(bad).select("file_id", F.lit(True).alias("_broken")).distinct()
    pairs = D.pool_pairs(parsed, cand.join(broken, "file_id", "left_anti"), existing)
    found = F.concat(S.conflicts(), S.existing_conflicts())
    scored = pairs.withColumns({"score": S.score(S.terms()), "critical": S.critical(found)})
    partial = (text(F.col("series_name")) == "") | (text(F.col("issue_number")) == "")
    state = F.when(F.col("critical"), "CONFLICTING").when(partial, "PARTIAL").otherwise("VALID")
    known = scored.select("file_id", "provider", "issue_id", "series_name", "issue_number", "publication_year", "score", "critical", state.alias("state"))
    zipped = F.lower("path").endswith(".cbz") if "path" in parsed.columns else F.lit(True)
    files = parsed.select("file_id", zipped.alias("_zipped"))
    out = files.join(known, "file_id", "left").join(broken, "file_id", "left")
    told = F.when(~F.col("_zipped"), "MISSING").when(F.col("_broken"), "MALFORMED").otherwise(F.coalesce("state", F.lit("MISSING")))
    return out.withColumn("state", told).drop("_zipped", "_broken")


def resolve(parsed: DataFrame, candidates: DataFrame, existing: DataFrame, cached: DataFrame | None = None, override: DataFrame | None = None, gate: float = 70.0) -> DataFrame:
    """One row per file: the chosen identity, its tier, the stage that settled it, and why the catalog before did not.

    A stage of a catalog settles files whose best candidate scores `gate` or more
    without a critical conflict; the last pool decides the rest.
    """
    settled = []
    left = parsed = written(parsed, "parsed")
    own = F.col("provider") == "Filename"
    known = candidates.select("provider", *[c for c in candidates.columns if c != "provider"])
    # beside their files and in normal form once; each catalog's stage then shuffles its pools once
    pairs = written(D.pool_pairs(parsed, known.where(own).unionByName(inherit(known.where(~own), parsed)), existing), "candidates")
    if override is not None:
        won = left.select("file_id").join(override, "file_id").select(
            "file_id", F.lit("Override").alias("provider"), "issue_id", "series_name", "issue_number", F.col("year").alias("publication_year"),
            F.lit(100.0).alias("score"), F.lit("AUTO_ACCEPT").alias("level"), F.lit("UPDATE").alias("action"), F.lit(False).alias("critical"), F.lit("url_override").alias("source"),
        )
        settled.append(won)
        left = left.join(override.select("file_id"), "file_id", "left_anti")
    states = classify_existing(left, existing)
    usable = written(states, "existing").where((F.col("state") == "VALID") & (text(F.col("issue_id")) != "") & ~F.col("critical") & (F.col("score") >= 80))
    level = F.when(F.col("score") >= 90, "AUTO_ACCEPT").otherwise("ACCEPT_WITH_WARNING")
    settled.append(usable.withColumns({"level": level, "action": F.lit("UPDATE"), "source": F.lit("existing_comicinfo")}).select(*RESULT))
    left = left.join(usable.select("file_id"), "file_id", "left_anti")
    if cached is not None:
        best = written(D.decide(D.evaluate(D.pool_pairs(left, cached, existing))), "cached").where("score >= 80 and not critical")
        settled.append(best.withColumn("source", F.lit("persistent_cache")).select(*RESULT))
        left = left.join(best.select("file_id"), "file_id", "left_anti")
    for n, (_, source) in enumerate(CATALOGS):
        pool = pairs.where(F.col("provider").isin("Filename", *[name for name, _ in CATALOGS[: n + 1]])).repartition("file_id")
        best = written(D.decide(D.evaluate(pool.join(left.select("file_id"), "file_id", "left_semi"))), source).withColumn("source", F.lit(source))
        last = n == len(CATALOGS) - 1
        won = best if last else best.where((F.col("score") >= gate) & ~F.col("critical"))
        settled.append(won.select(*RESULT))
        if not last:
            left = left.join(won.select("file_id"), "file_id", "left_anti")
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    files = parsed.select("file_id").join(out, "file_id", "left")
    has = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    provider = F.col("provider")
    asked = pairs.groupBy("file_id").agg(has(provider != "Filename", "_asked"), *[has(provider == name, f"_{name}") for name, _ in CATALOGS])
    files = files.join(asked, "file_id", "left").join(existing.select("file_id", F.lit(True).alias("_own")).distinct(), "file_id", "left")
    asked = F.coalesce(F.col("_asked"), F.lit(False)) | F.coalesce(F.col("_own"), F.lit(False))
    known = F.coalesce((asked & F.col("provider").isNotNull()) | (F.col("source") == "url_override"), F.lit(False))
    level = F.when(known, F.col("level")).otherwise("UNRESOLVED")
    fallback = F.coalesce(F.col("source").endswith("_fallback") & known, F.lit(False))
    before = F.when(F.col("source") == "comicvine_fallback", F.col("_Kapowarr")).otherwise(F.col("_ComicVine"))
    reason = F.when(fallback, F.when(F.coalesce(before, F.lit(False)), "insufficient").otherwise("no results")).otherwise("")
    return files.withColumns(
        {"level": level, "action": S.action(level), "source": F.when(known, F.col("source")).otherwise(""), "fallback_used": fallback, "fallback_reason": reason}
    ).drop("_asked", "_own", *[f"_{name}" for name, _ in CATALOGS])


def retrieve(resolved: DataFrame, records: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The record of each identity from its own provider, with state FOUND, INVALID, NOT_FOUND or PROVIDER_ERROR."""
    keyed = records.withColumnRenamed("file_id", "_record_file") if "file_id" in records.columns else records
    joined = resolved.join(keyed, ["provider", "issue_id"], "left")
    if failed is not None:
        joined = joined.join(failed.select("provider", "issue_id").distinct().withColumn("_failed", F.lit(True)), ["provider", "issue_id"], "left")
    else:
        joined = joined.withColumn("_failed", F.lit(None).cast("boolean"))
    valid = (text(F.col("record_series")) != "") | (text(F.col("record_title")) != "")
    state = (
        F.when(F.col("_failed"), "PROVIDER_ERROR")
        .when(F.col("record_series").isNull() & F.col("record_title").isNull(), "NOT_FOUND")
        .when(valid, "FOUND")
        .otherwise("INVALID")
    )
    return joined.withColumn("state", state).drop("_failed", "_record_file")


def routed_records(requests: DataFrame, catalogs: dict[str, DataFrame], key: str = "request_id", urls: str = "urls", base: str = "") -> DataFrame:
    """A row per url of each request, in order: key, pos, url, route, issue_id, state, and the record of its own catalog.

    catalogs: records by route ("ComicVine", "GCP" and "Kapowarr"; see `text.route`) with
    issue_id as text; columns that a catalog lacks are null.  state is FOUND, NOT_FOUND where
    its catalog has no such record, or NO_CATALOG.  Of equal ids in a catalog one must be given.
    """
    asked = requests.select(key, F.posexplode(url_list(F.col(urls))).alias("pos", "url"))
    asked = asked.withColumns({"route": route(F.col("url"), base), "issue_id": provider_id(F.col("url"))})
    records = None
    for name, rows in catalogs.items():
        named = rows.withColumns({"route": F.lit(name), "issue_id": F.col("issue_id").cast("string"), "_found": F.lit(True)})
        records = named if records is None else records.unionByName(named, allowMissingColumns=True)
    if records is None:
        return asked.withColumn("state", F.lit("NO_CATALOG"))
    state = F.when(F.col("_found"), "FOUND").when(F.col("route").isin(list(catalogs)), "NOT_FOUND").otherwise("NO_CATALOG")
    return asked.join(records, ["route", "issue_id"], "left").withColumn("state", state).drop("_found")


def provider_results(candidates: DataFrame) -> DataFrame:
    """file_id and results: map from each catalog to its struct(status, candidates), as the decision reports it."""
    counts = [F.count_if(F.col("provider") == name).alias(name) for name, _ in CATALOGS]
    per = candidates.groupBy("file_id").agg(*counts)

    def told(name: str) -> Column:
        n = F.col(name)
        return F.struct(F.lit(name), F.struct(F.when(n > 0, "SUCCESS").otherwise("NO_RESULTS").alias("status"), n.alias("candidates")))

    return per.select("file_id", F.map_from_entries(F.array(*[told(name) for name, _ in CATALOGS])).alias("results"))


def local_candidates(parsed: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates of the file itself: pool_pos 0 from its name, 1 from its embedded record or else its folder.

    A record's blank series and year come from the folder; a second candidate without
    series and number is left out.
    """
    kind = F.when(F.col("is_tpb"), "TPB").when(F.col("is_annual"), "Annual").otherwise("Issue")
    by_name = parsed.select("file_id", F.lit(0).alias("pool_pos"), F.lit("FilenameParser").alias("provider"), F.lit("").alias("issue_id"), "series_name", "issue_number", F.col("year").alias("publication_year"), "publisher", kind.alias("identity_type"))
    parts = F.split("path", "/")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    plain = (parent == "") | F.lower(parent).isin(names.PLAIN_FOLDERS)
    folder = F.when(plain, "").otherwise(F.trim(F.regexp_replace(F.regexp_replace(parent, names.YEAR, ""), r"[_\-.()\[\]]+", " ")))
    folder_year = F.when(plain, 0).otherwise(F.coalesce(F.regexp_extract(parent, names.YEAR, 1).try_cast("int"), F.lit(0)))
    zipped = parsed.select("file_id", "path", F.lower("path").endswith(".cbz").alias("_zip"), folder.alias("_folder"), folder_year.alias("_year"))
    x = existing.select("file_id", F.lit(True).alias("_has"), "series", "number", F.col("year").alias("_own_year"), F.col("publisher").alias("_publisher"), F.regexp_extract("web", r"comicvine\.gamespot\.com/.*?/4000-([0-9]+)", 1).alias("_id"))
    both = zipped.join(x, "file_id", "left")
    has = F.coalesce(F.col("_has") & F.col("_zip"), F.lit(False))
    own = lambda c: F.when(has, text(F.col(c))).otherwise("")
    year = F.when(has & (F.coalesce("_own_year", F.lit(0)) > 0), F.col("_own_year")).otherwise(F.col("_year"))
    second = both.select(
        "file_id", F.lit(1).alias("pool_pos"), F.when(has, "ExistingXML").otherwise("DirectoryStructure").alias("provider"), F.when(own("_id") != "", F.concat(F.lit("4000-"), own("_id"))).otherwise("").alias("issue_id"),
        F.when(own("series") != "", own("series")).otherwise(F.col("_folder")).alias("series_name"), own("number").alias("issue_number"), year.alias("publication_year"), own("_publisher").alias("publisher"), F.lit("Issue").alias("identity_type"),
    )
    return by_name.unionByName(second.where("series_name <> '' OR issue_number <> ''"))


#: Names of the record's fields that a plan lists, beside their columns.
PLAN_FIELDS = {"Title": "record_title", "Series": "record_series", "Number": "record_number", "Publisher": "record_publisher", "Year": "record_year", "Writer": "record_writers", "Penciller": "record_pencillers", "Characters": "record_characters", "Summary": "record_summary"}


def plan_files(retrieved: DataFrame, files: DataFrame, existing: DataFrame, allow_update: bool = True) -> DataFrame:
    """SKIP, REVIEW, UPDATE or EMBED per file, with the fields that would be written and the target path."""
    has = existing.select("file_id").distinct().withColumn("_has", F.lit(True))
    rows = files.select("file_id", "path").join(retrieved, "file_id", "left").join(has, "file_id", "left")
    found = F.coalesce(F.col("state") == "FOUND", F.lit(False))
    skip = F.col("action").isNull() | (F.col("action") == "SKIP")
    action = (
        F.when(skip, "SKIP")
        .when(F.col("action") == "REVIEW", "REVIEW")
        .when(~found, "SKIP")
        .when(F.col("_has"), "UPDATE" if allow_update else "SKIP")
        .otherwise("EMBED")
    )
    filled = F.filter(
        F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"), None).otherwise(F.lit(k)) for k, c in PLAN_FIELDS.items() if c in retrieved.columns]), lambda x: x.isNotNull()
    )
    reason = (
        F.when(skip, "below threshold").when(~found, F.concat(F.lit("metadata "), F.lower("state"))).when(F.col("action") == "REVIEW", "needs review").when(F.col("_has"), "existing record").otherwise("resolved")
    )
    return rows.select(
        "file_id",
        action.alias("action"),
        F.when(~skip & found, F.array_join(filled, ",")).otherwise("").alias("fields"),
        F.coalesce("provider", F.lit("")).alias("provider"),
        F.coalesce("score", F.lit(0.0)).alias("confidence"),
        F.coalesce("state", F.lit("NOT_FOUND")).alias("metadata_state"),
        reason.alias("reason"),
        F.regexp_replace("path", r"(?i)\.cbr$", ".cbz").alias("target_path"),
    )
