"""URL filters by a temporal list join.

Dated entries (domain, list, action, time) put a domain on a list or take it off; per domain and list they become
validity intervals. Every capture is evaluated against the intervals that hold at its fetch time, for its host and
all parent domains; the entry of the longest domain decides, and an ``allow`` list beats a ``block`` list there.

The answer depends on host and time only, so captures are first reduced to distinct (host, time); each of these meets
the intervals of its domains by equality and the time bounds, and the answers join the captures back.

Defined cases: entries without domain, list or time are void; of entries for one domain, list and time an ``add`` wins;
repeated entries change nothing; captures without a host or time match nothing; equal captures get equal results;
names compare in lower case without a final dot; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _domain(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\.+$", "")


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, empty if it has none."""
    return _domain(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def intervals(entries: DataFrame) -> DataFrame:
    """``domain, list, since, until``: when each domain is on each list; ``until`` is null while it stays there."""
    known = (entries.select(_domain(F.col("domain")).alias("domain"), "list", (F.col("action") == "add").alias("on"), F.col("time").alias("since"))
             .filter("domain != '' and list is not null and since is not null and `on` is not null"))
    # One state per moment; a domain that flaps has one row per moment after the map side.
    states = known.groupBy("domain", "list", "since").agg(F.max("on").alias("on"))
    order = Window.partitionBy("domain", "list").orderBy("since")
    changes = states.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).filter("`on` != was")
    return (changes.withColumn("until", F.lead("since").over(order)).filter("`on`")
            .select("domain", "list", "since", "until"))


def _domains(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda at: F.array_join(F.slice(labels, at, F.size(labels)), "."))


def evaluate(captures: DataFrame, entries: DataFrame, lists: DataFrame) -> DataFrame:
    """``captures`` (id, url, fetched) with ``host, domain, lists, blocked``.

    ``entries`` has domain, list, action (add or remove) and time; ``lists`` has list and kind (block or allow).
    ``lists`` names the active lists of the deciding domain, sorted and comma-joined.
    """
    rows = captures.select("id", "url", "fetched", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"))
    asked = rows.filter("host != '' and fetched is not null").select("host", "fetched").distinct()
    spread = asked.select("host", "fetched", F.posexplode(_domains(F.col("host"))).alias("up", "domain"))
    active = intervals(entries).join(lists.filter("list is not null").groupBy("list").agg(F.max(F.col("kind") == "allow").alias("allow")), "list")
    hits = spread.join(active, "domain").filter((F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    per = hits.groupBy("host", "fetched", "up", "domain").agg(
        F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"), F.max("allow").alias("allow"))
    nearest = Window.partitionBy("host", "fetched").orderBy("up")
    decided = (per.withColumn("turn", F.row_number().over(nearest)).filter("turn = 1")
               .select("host", "fetched", "domain", "lists", (~F.col("allow")).alias("blocked")))
    return (rows.join(decided, ["host", "fetched"], "left")
            .select("id", "url", "fetched", "host", "domain", "lists", F.coalesce("blocked", F.lit(False)).alias("blocked")))
