"""URL filters by a temporal list join.

A list is a log of dated entries (pattern, kind, action, at).  ``intervals`` turns it into validity
intervals [valid_from, valid_to); ``as_of`` joins each capture with the entries that were active when
it was fetched.  Kinds: ``domain`` (the host or a host below it), ``prefix`` (host and a path prefix
that ends at a segment).

A capture looks itself up by the names it can match: its host and each parent domain, its host with
each path prefix.  A name is a chain of steps (labels from the right, or host and segments), and its
first i steps are named by the combined hash of (step, place), a running XOR, so a URL costs one short row for
each step however long its names are.  Both kinds are one equi-join on (kind, depth, hash) with the
interval as a second condition; hits are compared sign by sign afterwards.  No list is broadcast,
and Spark splits the partitions of a hot host.

Defined results: null or unreadable URLs, null fetch dates and null ids match nothing and stay; entries
with a null pattern, kind, action or date have no effect; of several entries for a pattern on one
date a removal wins; repeated entries count once, repeated captures stay; columns other than those
named are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Host in lower case, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (pattern, kind, action: add or remove, at) -> pattern, kind, valid_from, valid_to (null: still
    valid).  Entries that change nothing are passed over, so the intervals of a pattern are disjoint."""
    known = entries.select(F.lower("pattern").alias("pattern"), "kind", "action", "at").where("pattern is not null and kind in ('domain', 'prefix') and action in ('add', 'remove') and at is not null")
    days = known.groupBy("pattern", "kind", "at").agg(F.max(F.col("action") == "remove").alias("gone"))
    w = Window.partitionBy("pattern", "kind").orderBy("at")
    turns = days.withColumn("before", F.coalesce(F.lag("gone").over(w), F.lit(True))).where("gone != before")
    return turns.withColumn("valid_to", F.lead("at").over(w)).where("not gone").select("pattern", "kind", F.col("at").alias("valid_from"), "valid_to")


def _hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, depth, hash of each leading part of the chains in ``chains`` (kind, steps)."""
    steps = rows.select(*keys, F.explode("chains").alias("c")).select(*keys, F.col("c.kind").alias("kind"), F.posexplode("c.steps").alias("place", "step"))
    upto = Window.partitionBy(*keys, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*keys, "kind", (F.col("place") + 1).alias("depth"), F.bit_xor(F.xxhash64("step", "place")).over(upto).alias("hash"))


def _chain(kind: str, steps: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), steps.alias("steps"))


def _asked(rows: DataFrame) -> DataFrame:
    """Adds host, path (canonical: host/a/b in lower case) and the chains of a URL."""
    staged = rows.withColumn("host", host_of(F.col("url"))).where("host is not null")
    parts = F.filter(F.split(F.lower(F.regexp_extract("url", PATH, 1)), "/"), lambda x: x != "")
    staged = staged.withColumn("parts", F.concat(F.array("host"), parts))
    chains = F.array(_chain("domain", F.reverse(F.split("host", r"\."))), _chain("prefix", F.col("parts")))
    return staged.withColumn("path", F.concat(F.array_join("parts", "/"), F.lit("/"))).withColumn("chains", chains)


def _listed(valid: DataFrame) -> DataFrame:
    """The intervals with depth and hash of their whole pattern; prefixes that are not written as a URL's
    (``host/`` or ``host/a/b``) match nothing and go."""
    parts = F.filter(F.split("pattern", "/"), lambda x: x != "")
    written = F.when(F.size(parts) == 1, F.concat(parts[0], F.lit("/"))).otherwise(F.array_join(parts, "/"))
    chain = F.when(F.col("kind") == "domain", _chain("domain", F.reverse(F.split("pattern", r"\.")))).otherwise(_chain("prefix", parts))
    named = valid.where((F.col("kind") == "domain") | (F.col("pattern") == written)).select("pattern", "kind").distinct()
    depths = _hashed(named.select("pattern", F.array(chain).alias("chains")), ["pattern"])
    whole = depths.groupBy("pattern", "kind").agg(F.max(F.struct("depth", "hash")).alias("last")).select("pattern", "kind", "last.depth", "last.hash")
    return valid.join(whole, ["pattern", "kind"])


def as_of(captures: DataFrame, valid: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_on") -> DataFrame:
    """page_id, url, fetched_on, blocked, pattern, kind, valid_from of each capture; of several active
    entries the one valid longest (then kind and pattern) is named."""
    rows = captures.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{at_col}`").alias("fetched_on")).withColumn("key", F.xxhash64("page_id", "url", "fetched_on"))
    asked = _asked(rows.where("fetched_on is not null").distinct())
    live = (F.col("valid_from") <= F.col("fetched_on")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    found = _hashed(asked.select("key", "fetched_on", "chains"), ["key", "fetched_on"]).join(_listed(valid), ["kind", "depth", "hash"]).where(live)
    hits = found.select("key", "kind", "pattern", "valid_from").join(asked.select("key", "host", "path"), "key")
    same = F.when(F.col("kind") == "domain", F.endswith(F.concat(F.lit("."), "host"), F.concat(F.lit("."), "pattern"))).otherwise(
        F.startswith("path", F.concat(F.rtrim("pattern", F.lit("/")), F.lit("/")))
    )
    best = hits.where(same).groupBy("key").agg(F.min(F.struct("valid_from", "kind", "pattern")).alias("hit"))
    out = rows.join(best, "key", "left")
    return out.select("page_id", "url", "fetched_on", F.col("hit").isNotNull().alias("blocked"), F.col("hit.pattern").alias("pattern"), F.col("hit.kind").alias("kind"), F.col("hit.valid_from").alias("valid_from"))
