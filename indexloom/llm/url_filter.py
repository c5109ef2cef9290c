"""URL filters whose lists change: every capture is judged by the entries active when it was fetched.

Dated list entries (a key is added or removed on a day) become validity intervals by a window over each
key's few events.  A capture's keys are its host and the host's parent domains; it meets intervals on
(key, month), so a host with a third of all captures and a key with a long history do not multiply, and
adaptive execution splits the hot keys of the join.  The most specific active entry decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a bucket of the interval join.
BUCKET = 30


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without user, port and a closing dot; empty where there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(host, r"\.+$", "")


def domains_of(host: Column) -> Column:
    """A host and its parent domains of at least two names."""
    names = F.split(host, r"\.")
    n = F.size(names)
    starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array(F.lit(1)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(names, i, n), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, category, since, until): entries (key, category, day, action "add" or "remove") as intervals [since, until).

    until is NULL while an entry stays.  Adding what is there and removing what is not changes nothing; of
    events of one day the removal comes first.  Entries with a null key or day are left out.
    """
    w = Window.partitionBy("key", "category").orderBy("day", F.col("action") != "remove")
    on = F.col("action") == "add"
    rows = entries.where("key is not null and day is not null and action in ('add', 'remove')")
    changes = rows.withColumn("_before", F.coalesce(F.lag(on).over(w), F.lit(False))).where(on != F.col("_before"))
    return changes.withColumn("until", F.lead("day").over(w)).where(on).select("key", "category", F.col("day").alias("since"), "until").where("until is null or until > since")


def temporal_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """id, host, day, blocked, category, list_key, since for every capture.

    A null or hostless URL and a null day match nothing.  Of several active entries the one with the longest
    key decides, then the earlier, then the smaller category.  Repeated captures are judged each.
    """
    at = captures.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), F.col(day_col).alias("day"))
    valid = intervals(entries)
    days = at.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))

    def bucket(day: Column) -> Column:
        return F.floor(F.unix_date(day) / BUCKET).cast("int")

    first = F.greatest(F.col("since"), F.col("lo"))
    last = F.least(F.coalesce(F.date_sub("until", 1), F.col("hi")), F.col("hi"))
    spread = valid.crossJoin(F.broadcast(days)).where(first <= last).withColumn("_m", F.explode(F.sequence(bucket(first), bucket(last)))).drop("lo", "hi")  # days: one row
    # what meets is decided per distinct (host, day), of which a hot host has no more than days
    asked = at.where("host <> '' and day is not null").select("host", "day").distinct()
    keys = asked.select("host", "day", F.explode(domains_of(F.col("host"))).alias("key"), bucket(F.col("day")).alias("_m"))
    met = keys.join(spread, ["key", "_m"]).where((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    best = met.groupBy("host", "day").agg(F.min(F.struct((-F.length("key")).alias("n"), F.col("since"), F.col("category"), F.col("key"))).alias("x"))
    out = at.join(best, ["host", "day"], "left")
    return out.select(F.col("_id").alias(id_col), "host", "day", F.col("x").isNotNull().alias("blocked"), F.col("x.category").alias("category"), F.col("x.key").alias("list_key"), F.col("x.since").alias("since"))


def sample_entries(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """A dated list over the hosts of ``pages`` by a fixed rule, for tables that bring no list of their own.

    Of the sites (hosts without their first name if they have more than three) some are added, removed
    60 to 239 days later, and added again; hosts with "adult" in them stay listed.
    """
    hosts = pages.select(host_of(F.col(url_col)).alias("host")).where("host <> ''").distinct()
    names = F.split("host", r"\.")
    site = F.when(F.size(names) > 3, F.array_join(F.slice(names, 2, 100), ".")).otherwise(F.col("host"))
    keys = hosts.select(site.alias("key")).unionByName(hosts.select(F.col("host").alias("key")).where("host like '%adult%'")).distinct()
    n = F.length("key") * 37 + F.ascii("key") * 11 + F.ascii(F.substring("key", 4, 1)) * 17
    adult = F.col("key").like("%adult%")
    k = keys.select("key", n.cast("int").alias("n"), F.when(adult, "adult").otherwise("spam").alias("category"), adult.alias("adult"))
    start = F.to_date(F.lit("2023-01-01"))
    add = k.where("adult or n % 3 = 0").select("key", "category", F.date_add(start, F.col("n") % 300).alias("day"), F.lit("add").alias("action"))
    gone = k.where("not adult and n % 3 = 0 and n % 4 <> 0").select("key", "category", F.date_add(start, F.col("n") % 300 + 60 + F.col("n") % 180).alias("day"), F.lit("remove").alias("action"))
    again = k.where("not adult and n % 3 = 0 and n % 2 = 1").select("key", "category", F.date_add(start, F.col("n") % 300 + 400).alias("day"), F.lit("add").alias("action"))
    return add.unionByName(gone).unionByName(again)
