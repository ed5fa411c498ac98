"""Joins, merges and upkeep of catalog tables, files and jobs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import numbers
from foliate.functions.text import collection_form, content_hash, key_form, provider_name, publisher_form, text
from foliate.sources.tables import written

ACTIVE = ["DISCOVERED", "QUEUED", "PENDING", "PROCESSING", "RUNNING", "RETRYING"]
#: Folders of the system.
SYSTEM_FOLDERS = ["/etc", "/root", "/proc", "/sys", "/dev", "/boot", "/var/run", "/bin", "/sbin", "/usr/bin", "/usr/sbin"]
#: Seconds that a cache row lives, by kind.
TTL = {"issue": 7 * 86400, "series": 7 * 86400, "search": 86400, "url": 12 * 3600}


def canonical_key(df: DataFrame, series: str = "series_name", number: str = "issue_number", volume: str = "volume", year: str = "publication_year", publisher: str = "publisher") -> DataFrame:
    """Add series_norm, issue_numeric, issue_suffix, is_named, volume_norm, key_year, publisher_norm."""
    order = numbers.issue_order(F.col(number))
    return df.withColumn("_o", order).withColumns(
        {
            "series_norm": key_form(F.col(series)),
            "issue_numeric": F.col("_o.numeric"),
            "issue_suffix": F.col("_o.suffix"),
            "is_named": F.col("_o.is_named"),
            "volume_norm": F.trim(F.lower(text(F.col(volume)))),
            "key_year": F.coalesce(F.col(year), F.lit(0)),
            "publisher_norm": key_form(F.col(publisher)),
        }
    ).drop("_o")


def match_keys(left: DataFrame, right: DataFrame, left_id: str, right_id: str, year_tolerance: int = 1) -> DataFrame:
    """Pairs of ids whose canonical keys name one edition; blank series or volume match any.

    Rows with a series meet by equi-join on series and number; those without meet by
    number alone in a branch of their own, so wildcards do not widen the main join.
    Years are keys as well: a row on the left meets each year near its own, and year 0, which
    stands for none; left rows without a year, which match any, are a branch of their own.
    Both sides are written, as several branches read them, and all joins are merge joins: the
    written files are so well compressed that by their size Spark would broadcast, and the
    driver hold, millions of rows.
    """
    keys = ["series_norm", "issue_numeric", "issue_suffix", "is_named", "volume_norm", "key_year"]
    a = written(left.select(F.col(left_id).alias("left_id"), *[F.col(k).alias(f"l_{k}") for k in keys]), "left")
    b = written(right.select(F.col(right_id).alias("right_id"), *[F.col(k).alias(f"r_{k}") for k in keys]), "right")
    number = (F.col("l_issue_numeric") == F.col("r_issue_numeric")) & (F.col("l_issue_suffix") == F.col("r_issue_suffix")) & (F.col("l_is_named") == F.col("r_is_named"))
    volume = (F.col("l_volume_norm") == "") | (F.col("r_volume_norm") == "") | (F.col("l_volume_norm") == F.col("r_volume_norm"))
    series = F.col("l_series_norm") == F.col("r_series_norm")
    year = F.col("l_key_year")
    near = F.filter(F.sequence(year - year_tolerance, year + year_tolerance), lambda y: y > 0)
    dated = a.where(F.coalesce(year > 0, F.lit(True))).withColumn("_year", F.explode(F.concat(F.coalesce(near, F.array().cast("array<int>")), F.array(F.lit(0)))))
    undated, b = a.where(year <= 0), b.withColumn("_r_year", F.when(F.col("r_key_year").isNotNull(), F.greatest("r_key_year", F.lit(0))))
    blank, told = b.where("r_series_norm = ''").hint("merge"), b.where("r_series_norm <> ''").hint("merge")
    out = None
    for rows, meets in ((dated, number & (F.col("_year") == F.col("_r_year"))), (undated, number)):
        pairs = [
            rows.where("l_series_norm <> ''").join(told, series & meets),
            rows.join(blank, meets),
            rows.where("l_series_norm = ''").join(told, meets),
        ]
        for p in pairs:
            p = p.where(volume).select("left_id", "right_id")
            out = p if out is None else out.union(p)
    return out


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest(df: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """The newest row of each key; of equally new ones always the same."""
    return first_by(df, keys, [F.desc(stamp), F.xxhash64(*df.columns)])


def ordered_unique(items: Column, loose: bool = True) -> Column:
    """Items in first-seen order without repeats or blanks.

    loose compares trimmed and lower-cased and keeps the first spelling; otherwise
    spellings count, and only empty items are blank.
    """
    if not loose:
        return F.array_distinct(F.filter(items, lambda x: x != ""))
    kept = F.filter(items, lambda x: F.trim(x) != "")
    forms = F.transform(kept, lambda x: F.trim(F.lower(x)))
    return F.filter(kept, lambda x, i: F.array_position(forms, F.trim(F.lower(x))) == i + 1)


def union_lists(rows: DataFrame, group: str, order: str, lists: str, loose: bool = True) -> DataFrame:
    """Ordered unique union of the rows' lists per group: (group, items).

    Items meet by key, so no group's lists are gathered before repeats are gone.
    """
    item = rows.select(group, order, F.posexplode(lists).alias("at", "item"))
    form = F.trim(F.lower("item")) if loose else F.col("item")
    item = item.withColumn("_k", form).where("_k <> ''")
    first = item.groupBy(group, "_k").agg(F.min(F.struct(order, "at", "item")).alias("m"))
    return first.groupBy(group).agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["item"]).alias("items"))


def _spellings(ordered: str) -> Column:
    """Of numbers in issue order: repeated, those that several issues bear in one spelling, and variants, those in several.

    Equal numbers are neighbours, so one pass counts them.
    """
    zero = F.lit(0).cast("bigint")

    def state(a: Column, first: Column, n: Column, varied: Column, repeated: Column, variants: Column) -> Column:
        return F.struct(a.alias("a"), first.alias("first"), n.alias("n"), varied.alias("varied"), repeated.alias("repeated"), variants.alias("variants"))

    def ended(s: Column) -> tuple[Column, Column]:
        return (
            s["repeated"] + F.when((s["n"] > 1) & ~s["varied"] & s["first"].isNotNull(), 1).otherwise(0),
            s["variants"] + F.when(s["varied"], 1).otherwise(0),
        )

    def add(s: Column, x: Column) -> Column:
        varied = s["varied"] | F.coalesce(x["issue_number"] != s["first"], F.lit(False))
        more = state(s["a"], F.coalesce(s["first"], x["issue_number"]), s["n"] + 1, varied, s["repeated"], s["variants"])
        return F.when((s["n"] > 0) & s["a"].eqNullSafe(x["a"]), more).otherwise(state(x["a"], x["issue_number"], zero + 1, F.lit(False), *ended(s)))

    def finish(s: Column) -> Column:
        repeated, variants = ended(s)
        return F.struct(repeated.alias("repeated"), variants.alias("variants"))

    none = state(F.lit(None).cast("double"), F.lit(None).cast("string"), zero, F.lit(False), zero, zero)
    return F.aggregate(ordered, none, add, finish)


def validate_collections(members: DataFrame, group: str = "collection_id") -> DataFrame:
    """result (ACCEPT, WARN, REJECT), n_problems, n_warnings and the sorted numbers of each collection."""
    o = numbers.issue_order(F.col("issue_number"))
    m = members.withColumns({"_o": o, "_s": collection_form(F.col("series_name")), "_p": publisher_form(F.col("publisher"))})
    whole = m.groupBy(group).agg(
        F.size(F.collect_set("_s")).alias("series"),
        F.size(F.collect_set(F.when(F.col("publisher") != "", F.col("_p")))).alias("publishers"),
        F.size(F.collect_set(F.when(F.col("volume_id") != "", F.col("volume_id")))).alias("volumes"),
        F.sort_array(F.collect_list(F.struct(F.col("_o.numeric").alias("a"), F.col("_o.suffix").alias("b"), "pos", "issue_number"))).alias("sorted"),
    )
    out = whole.select("*", _spellings("sorted").alias("_n")).select("*", "_n.repeated", "_n.variants")
    problems = (F.col("series") > 1).cast("int") + (F.col("volumes") > 1).cast("int") + F.col("repeated").cast("int")
    warnings = (F.col("publishers") > 1).cast("int") + F.col("variants").cast("int")
    return out.select(
        group,
        F.when(problems > 0, "REJECT").when(warnings > 0, "WARN").otherwise("ACCEPT").alias("result"),
        problems.alias("n_problems"),
        warnings.alias("n_warnings"),
        F.array_join(F.transform("sorted", lambda x: x["issue_number"]), ",").alias("sorted_numbers"),
    )


#: List columns of a record, in its order; each holds items between semicolons.
LISTS = ["writers", "pencillers", "inkers", "colorists", "letterers", "cover_artists", "characters", "teams", "story_arcs", "story_arc_numbers"]


def _united(rows: Column, name: str, loose: bool) -> Column:
    """The ordered unique union of a list column over a group's rows in order, again between semicolons.

    Each array is bound to a lambda's variable, so that it is made once and not for every item.
    """
    items = F.filter(F.flatten(F.transform(rows, lambda r: F.split(text(r[name]), ";"))), lambda x: F.trim(x) != "" if loose else x != "")
    if not loose:
        return F.array_join(F.array_distinct(items), ";")

    def first_spellings(both: Column) -> Column:
        return F.transform(F.array_distinct(both["forms"]), lambda f: F.element_at(both["items"], F.array_position(both["forms"], f).cast("int")))

    told = F.transform(F.array(items), lambda xs: F.struct(xs.alias("items"), F.transform(xs, lambda x: F.trim(F.lower(x))).alias("forms")))
    return F.array_join(F.transform(told, first_spellings)[0], ";")


def _told(value: Callable[[Column], Column], keep: Callable[[Column], Column]) -> Column:
    """Values of a group's rows in their order, where keep holds."""
    return F.transform(F.filter("_rows", keep), value)


def merge_issues(members: DataFrame, group: str = "collection_id", policy: bool = False, override: DataFrame | None = None, identity: DataFrame | None = None) -> DataFrame:
    """One record per collection from its issues in the order of pos.

    policy=False joins numbers as a range or list and returns the record of a single
    issue as it is; policy=True orders numbers by issue order and lets override (highest)
    and catalog identity win per field, with the source of each in provenance.  Lists are
    united in first-seen order: by exact spelling, or with policy by trimmed lower case.
    A group's issues are one publication's, so they fit a row.
    """
    o = numbers.issue_order(F.col("issue_number"))
    fields = ["series_name", "publisher", "issue_number", "title", "year", "month", "day", "web", "summary", "notes", "provider_id", "genre", "language"]
    row = F.struct("pos", *fields, *LISTS, F.col("_o.numeric").alias("_a"), F.col("_o.suffix").alias("_b"))
    # the rows of a group are gathered once; all that follows is read from them
    g = members.withColumn("_o", o).groupBy(group).agg(F.count("*").cast("int").alias("count"), F.sort_array(F.collect_list(row)).alias("_rows"))
    numbered = lambda r: r["issue_number"] != ""
    filled = lambda c: lambda r: r[c] != ""
    one = lambda x: F.when(x == 0, 1).otherwise(x)
    dates = _told(lambda r: F.struct(r["year"].alias("year"), one(r["month"]).alias("_m"), one(r["day"]).alias("_d"), r["pos"].alias("pos"), r["month"].alias("month"), r["day"].alias("day")), lambda r: r["year"] > 0)

    def headed(r: Column) -> Column:
        label = F.when(numbered(r), F.concat(F.lit("Issue #"), r["issue_number"])).otherwise(F.when(r["title"] != "", r["title"]).otherwise("Issue" if policy else ""))
        return F.concat(F.lit("--- "), label, F.lit(" ---\n"), r["summary"])

    by_order = _told(lambda r: F.struct(r["_a"].alias("a"), r["_b"].alias("b"), r["pos"].alias("pos"), r["issue_number"].alias("n")), numbered)
    first = F.get("_rows", F.lit(0))
    g = g.select(
        group,
        "count",
        first["series_name"].alias("series"),
        first["publisher"].alias("first_publisher"),
        _told(lambda r: r["issue_number"], numbered).alias("_numbers"),
        F.transform(F.sort_array(by_order), lambda x: x["n"]).alias("_sorted"),
        _told(lambda r: r["title"], filled("title")).alias("_titles"),
        F.array_min(dates).alias("_date"),
        F.array_join(_told(lambda r: r["web"], filled("web")), ", ").alias("_web"),
        F.array_join(_told(headed, filled("summary")), "\n\n").alias("_summary"),
        F.array_join(_told(lambda r: r["notes"], filled("notes")), "\n").alias("_notes"),
        F.get(F.filter("_rows", filled("provider_id")), F.lit(0)).alias("_id"),
        first.alias("_one"),
        *[_united(F.col("_rows"), c, loose=policy).alias(f"l_{c}") for c in LISTS],
    )
    whole = F.forall("_numbers", lambda n: n.rlike("^[0-9]+$"))
    ints = F.transform("_numbers", lambda n: n.cast("bigint"))
    if not policy:
        number = (
            F.when(F.size("_numbers") == 0, "")
            .when(whole & (F.size("_numbers") > 1), F.concat(F.array_min(ints), F.lit("-"), F.array_max(ints)))
            .when(whole, F.array_min(ints).cast("string"))
            .otherwise(F.array_join("_numbers", ", "))
        )
        g = g.withColumn("number", number)
        title = F.when(F.size("_titles") == 0, "").when(F.col("series") != "", F.concat("series", F.lit(" #"), "number")).otherwise(F.array_join("_titles", " / "))
        alone = F.col("count") == 1

        def either(own: str, merged: Column, name: str) -> Column:
            return F.when(alone, F.col(f"_one.{own}")).otherwise(merged).alias(name)

        return g.select(
            group,
            "series",
            F.col("first_publisher").alias("publisher"),
            "count",
            either("issue_number", F.col("number"), "number"),
            either("title", title, "title"),
            *[either(x, F.coalesce(F.col(f"_date.{x}"), F.lit(0)), x) for x in ("year", "month", "day")],
            either("web", F.col("_web"), "web"),
            either("summary", F.col("_summary"), "summary"),
            F.col("_one.genre").alias("genre"),
            F.col("_one.language").alias("language"),
            F.when(alone, "").otherwise("Trade Paperback").alias("format"),
            *[either(c, text(F.col(f"l_{c}")), c) for c in LISTS],
        )
    over = ["title", "publisher", "year", "month", "day", "summary", "notes", "web", "provider_id"]
    if override is None:
        g = g.withColumns({f"o_{c}": F.lit(None).cast("int" if c in ("year", "month", "day") else "string") for c in over})
    else:
        g = g.join(override.select(group, *[F.col(c).alias(f"o_{c}") for c in over]), group, "left")
    g = g.withColumn("i_publisher", F.lit(None).cast("string")) if identity is None else g.join(identity.select(group, F.col("publisher").alias("i_publisher")), group, "left")
    n = F.size("_sorted")
    span = F.when(n > 1, F.concat(F.get("_sorted", F.lit(0)), F.lit("-"), F.element_at("_sorted", -1))).when(n == 1, F.get("_sorted", F.lit(0))).otherwise("")
    own = lambda c: text(F.col(f"o_{c}")) != ""
    own_year = F.coalesce(F.col("o_year") > 0, F.lit(False))
    made = F.when(span == "", "").when(F.col("series") != "", F.concat("series", F.lit(" #"), span)).otherwise(span)
    publisher = F.when(text(F.col("i_publisher")) != "", F.col("i_publisher")).when(own("publisher"), F.col("o_publisher")).otherwise(F.col("first_publisher"))
    dates = [F.when(own_year, F.col(f"o_{c}")).otherwise(F.coalesce(F.col(f"_date.{c}"), F.lit(0))).alias(c) for c in ("year", "month", "day")]
    told = F.array(
        F.lit("series=first_issue"),
        F.when(own("title"), "title=collection_override").otherwise("title=generated_range"),
        F.when(text(F.col("i_publisher")) != "", "publisher=Kapowarr").when(own("publisher"), "publisher=collection_override").when(F.col("first_publisher") != "", "publisher=first_issue_provider"),
        F.when(own_year, "year=collection_override").when(F.col("_date").isNotNull(), "year=earliest_issue"),
        F.when(own("summary"), "summary=collection_override").otherwise("summary=issue_union"),
        F.when(own("web"), "web=collection_override").otherwise("web=issue_urls_joined"),
        *[F.lit(f"{c}=issue_union_dedup") for c in LISTS if c not in ("teams", "story_arc_numbers")],
        F.when(own("provider_id"), "provider_id=collection_override").when(F.col("_id").isNotNull(), "provider_id=first_issue"),
    )
    return g.select(
        group,
        "series",
        "count",
        F.when(own("title"), F.col("o_title")).otherwise(made).alias("title"),
        F.when(own("title"), "").otherwise(span).alias("number"),
        publisher.alias("publisher"),
        *dates,
        F.when(own("summary"), F.col("o_summary")).otherwise(F.col("_summary")).alias("summary"),
        F.concat_ws("\n", F.when(own("notes"), F.col("o_notes")), F.when(F.col("_notes") != "", F.col("_notes"))).alias("notes"),
        F.when(own("web"), F.col("o_web")).otherwise(F.col("_web")).alias("web"),
        F.when(own("provider_id"), F.col("o_provider_id")).otherwise(F.coalesce("_id.provider_id", F.lit(""))).alias("provider_id"),
        F.col("_one.genre").alias("genre"),
        F.when(F.col("_one.language") == "", "en").otherwise(F.col("_one.language")).alias("language"),
        F.lit("Trade Paperback").alias("format"),
        *[text(F.col(f"l_{c}")).alias(c) for c in LISTS if c != "story_arc_numbers"],
        F.array_join(F.filter(told, lambda x: x.isNotNull()), ",").alias("provenance"),
    )


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status of each entry: same, missing, changed_size, changed_hash or extra; the metadata entry is left out."""

    def listed(df: DataFrame, p: str) -> DataFrame:
        entry = F.lower("entry")
        return df.where((entry != "comicinfo.xml") & ~entry.endswith("/")).select("archive", entry.alias("entry"), *[F.col(c).alias(f"{p}_{c}") for c in ("crc", "size", "sha256")])

    both = listed(old, "a").join(listed(new, "b"), ["archive", "entry"], "full")
    status = (
        F.when(F.col("b_crc").isNull(), "missing")
        .when(F.col("a_crc").isNull(), "extra")
        .when((F.col("a_crc") != F.col("b_crc")) | (F.col("a_size") != F.col("b_size")), "changed_size")
        .when(F.col("a_sha256") != F.col("b_sha256"), "changed_hash")
        .otherwise("same")
    )
    return both.select("archive", "entry", status.alias("status"))


def new_or_changed(seen: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path, size, mtime and hash are not all as recorded."""
    return seen.join(latest(known, ["path"], "updated_at").select("path", "size", "mtime", "sha256"), ["path", "size", "mtime", "sha256"], "left_anti")


def without_active_jobs(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files that no active job holds; a blank hash is compared by path alone.  One row per path and hash."""
    active = jobs.where(F.col("status").isin(ACTIVE))
    blank = files.where("sha256 = ''").join(active.select("path"), "path", "left_anti")
    hashed = files.where("sha256 <> ''").join(active.select("path", "sha256"), ["path", "sha256"], "left_anti")
    return first_by(blank.unionByName(hashed), ["path", "sha256"], ["seen_id"])


def cache_lookup(requests: DataFrame, cache: DataFrame, now: int, version: str) -> DataFrame:
    """Requests (kind, cache_key) with the live row of the first catalog that has one.

    Keys are compared trimmed and in lower case; only payloads that name a series count.
    """
    form = F.trim(F.lower("cache_key"))
    named = F.from_json("data_json", "array<struct<series_name:string>>")
    usable = F.coalesce(F.exists(named, lambda x: F.coalesce(x["series_name"], F.lit("")) != ""), F.lit(False))
    newest = latest(cache.withColumn("_key", form), ["provider", "kind", "_key"], "updated_at")
    live = newest.where((F.col("schema_version") == version) & (F.col("expires_at") > now) & usable)
    ranked = live.withColumn("_rank", F.when(F.col("provider") == "Kapowarr", 0).otherwise(1))
    best = first_by(ranked, ["kind", "_key"], ["_rank", "provider"]).select("kind", "_key", F.col("provider").alias("hit_provider"), "data_json")
    return requests.withColumn("_key", form).join(best, ["kind", "_key"], "left").drop("_key")


def cache_upsert(cache: DataFrame, new: DataFrame, now: int, version: str) -> DataFrame:
    """The cache with new rows (provider, kind, cache_key, data_json) in place of old ones of their key."""
    ttl = F.create_map(*[F.lit(x) for pair in TTL.items() for x in pair])
    fresh = new.select("provider", "kind", "cache_key", "data_json", F.lit(now).cast("bigint").alias("updated_at"), (F.lit(now) + ttl[F.col("kind")]).cast("bigint").alias("expires_at"), F.lit(version).alias("schema_version"))
    old = cache.select("provider", "kind", "cache_key", "data_json", "updated_at", F.col("expires_at").cast("bigint").alias("expires_at"), "schema_version")
    return first_by(old.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1))), ["provider", "kind", "cache_key"], [F.desc("_new"), F.desc("updated_at")]).drop("_new")


def cache_invalidate(cache: DataFrame, keys: DataFrame) -> DataFrame:
    marked = cache.join(keys.select("provider", "kind", "cache_key").distinct().withColumn("_gone", F.lit(True)), ["provider", "kind", "cache_key"], "left")
    return marked.withColumn("expires_at", F.when(F.col("_gone"), 0).otherwise(F.col("expires_at"))).drop("_gone")


def cache_purge(cache: DataFrame, now: int) -> DataFrame:
    """Expired rows go; rows marked invalid (0) and rows that expire just now stay."""
    return cache.where(~((F.col("expires_at") > 0) & (F.col("expires_at") < now)))


def hash_upsert(known: DataFrame, processed: DataFrame, now: int) -> DataFrame:
    """The file-hash table (path, size, mtime, sha256, status, updated_at) with processed files in place of their old rows."""
    columns = ["path", "size", "mtime", "sha256", "status"]
    fresh = processed.select(*columns, F.lit(now).cast("bigint").alias("updated_at")).withColumn("_new", F.lit(1))
    both = known.select(*columns, "updated_at").withColumn("_new", F.lit(0)).unionByName(fresh)
    return first_by(both, ["path"], [F.desc("_new"), F.desc("updated_at"), F.xxhash64(*columns)]).drop("_new")


def changed_sources(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, old_hash, new_hash of rows of `new` whose content differs from the row of their key in `old`."""

    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, content_hash({c: F.col(c) for c in columns}).alias(name))

    return hashed(new, "new_hash").join(hashed(old, "old_hash"), keys).where("old_hash <> new_hash")


def batch_summary(matches: DataFrame, present: DataFrame, folder: str = "folder") -> DataFrame:
    """Per folder: files, matched, processed, skipped (no match) and errors (matched files that are not there any more)."""
    rows = matches.join(present.select("file_id").distinct().withColumn("_there", F.lit(True)), "file_id", "left")
    ready, there = F.col("status") == "ready", F.coalesce("_there", F.lit(False))
    count = lambda c: F.count_if(c)
    return rows.groupBy(folder).agg(
        F.count("*").alias("files"), count(ready).alias("matched"), count(ready & there).alias("processed"), count(~ready).alias("skipped"), count(ready & ~there).alias("errors")
    )


def provider_order(providers: DataFrame, priority: list[str], name: str = "provider") -> DataFrame:
    """Distinct providers with their place: those of the priority list first, in its order, then the others by first registration.

    providers: name and a column `registered` to order by; aliases name one provider.
    """
    known = providers.select(provider_name(F.col(name)).alias("provider"), "registered").groupBy("provider").agg(F.min("registered").alias("registered"))
    listed = F.array_distinct(F.array(*[provider_name(F.lit(p)) for p in priority]))
    at = F.array_position(listed, F.col("provider"))
    order = Window.orderBy(F.when(at > 0, at).otherwise(1 << 30), "registered", "provider")  # a row per provider
    return known.select("provider", F.row_number().over(order).alias("place"))


def quarantine_paths(files: DataFrame, roots: list[str], path: str = "path") -> DataFrame:
    """Add reason: why a path may not be used ("" if it may): a system folder, outside the roots, or no archive."""
    p = text(F.col(path))
    under = lambda folders: reduce(lambda a, r: a | (p == r) | p.startswith(r.rstrip("/") + "/"), folders, F.lit(False))
    climbs = p.rlike(r"(?:^|/)\.\.(?:/|$)")
    reason = (
        F.when(p == "", "empty")
        .when(under(SYSTEM_FOLDERS), "system folder")
        .when(climbs | ~under(roots), "outside roots")
        .when(~F.lower(p).rlike(r"\.cb[zr]$"), "extension")
        .otherwise("")
    )
    return files.withColumn("reason", reason)


def expire_leases(jobs: DataFrame, now: int) -> DataFrame:
    """Running jobs whose lease ended: failed when out of attempts, else retried."""
    ended = (F.col("status") == "RUNNING") & (F.col("lease_until") < now)
    spent = F.col("attempts") >= F.col("max_attempts")
    return jobs.withColumns(
        {
            "error_code": F.when(ended & spent, "MAX_ATTEMPTS_EXCEEDED").otherwise(""),
            "status": F.when(ended & spent, "FAILED").when(ended, "RETRYING").otherwise(F.col("status")),
        }
    )


def match_batch(issues: DataFrame, files: DataFrame, folder: str = "folder") -> DataFrame:
    """For each file the issue of its folder's volume: by number, bare number, half or zero alias, or issue 1 of a single file.

    Candidates of all rules are equi-joined on (folder, number) and the best rule wins.
    """
    alias = F.array(
        F.struct(F.lit(0).alias("rule"), F.col("number").alias("key")),
        F.struct(F.lit(1).alias("rule"), F.when(numbers.unpadded(F.col("number")) == "", "0").otherwise(numbers.unpadded(F.col("number"))).alias("key")),
        F.when(F.col("number").isin("0.5", "½", "1/2"), F.struct(F.lit(2).alias("rule"), F.lit("0.5").alias("key"))),
    )
    keyed = issues.select(folder, "url", F.inline(F.filter(alias, lambda x: x.isNotNull())))
    sized = files.withColumn("_n", F.count("*").over(Window.partitionBy(folder))).withColumn("number", numbers.batch_number(F.col("name")))
    wanted = F.array(F.struct(F.lit(0).alias("add"), F.col("number").alias("key")), F.when(F.col("_n") == 1, F.struct(F.lit(5).alias("add"), F.lit("1").alias("key"))))
    asks = sized.select("file_id", folder, F.inline(F.filter(wanted, lambda x: x.isNotNull())))
    hits = asks.join(keyed, [folder, "key"]).groupBy("file_id").agg(F.min(F.struct((F.col("add") + F.col("rule")).alias("rule"), "url")).alias("m"))
    return sized.select("file_id", folder, "number").join(hits, "file_id", "left").select(
        "file_id", folder, "number", F.coalesce("m.url", F.lit("")).alias("url"), F.when(F.col("m").isNull(), "unmatched").otherwise("ready").alias("status")
    )


#: Parts of slugs that mark collected editions; words that may follow a series in an issue's slug.
COLLECTED = [
    "-tpb", "-hc", "-gn", "-graphic-novel", "-trade-paperback", "-hardcover", "-softcover", "-collection", "-collected", "-omnibus", "-compendium", "-deluxe", "-edition", "-masterworks",
    "-box-set", "-slipcase", "-treasury", "-digest", "-epic-collection", "-ultimate-collection", "-must-haves", "-volume-", "-vol-", "coleccionable",
]
SPECIAL = ["annual", "special", "super", "giant", "fcbd", "free", "ashcan", "preview", "oneshot", "one", "zero", "issue"]


def slug_belongs(slug: Column, series: Column) -> Column:
    """Whether a page slug is of the series itself: prefix, then end, number or a special word, and no collected edition."""
    bare = F.regexp_replace(F.lower(slug), "^(?:the-)?(?:a-)?(?:an-)?", "")
    want = F.regexp_replace(F.regexp_replace(F.lower(series), " ", "-"), "^(?:the-)?(?:a-)?(?:an-)?", "")
    rest = F.substring(bare, F.length(want) + 1, F.lit(1 << 20))
    follows = (rest == "") | rest.rlike("^-(?:$|[0-9])") | rest.rlike(f"^-(?:{'|'.join(SPECIAL)})(?:-|$)")
    return ~F.lower(slug).rlike("|".join(COLLECTED)) & bare.startswith(want) & follows
