"""URL filters by a temporal list join (operator 2). DataFrame expressions only.

Dated entries of block lists become validity intervals; every capture is held against the entries that
were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AUTHORITY = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a closing dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1)), r"\.+$", "")


def keys_of(url: Column) -> Column:
    """What an entry can name of a URL: its host, each parent domain, and each directory of its path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1), "/"), lambda p: p != "")
    dirs = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, dirs)))


def intervals(entries: DataFrame) -> DataFrame:
    """entries(pattern, category, action, at) -> (pattern, category, since, until): an 'add' holds until
    the list's next entry for the pattern; at one time 'remove' comes last and wins; until null: open.
    Entries without pattern or date are void."""
    order = Window.partitionBy("pattern", "category").orderBy("at", "action")
    return (
        entries.where("pattern IS NOT NULL AND at IS NOT NULL")
        .select("pattern", F.coalesce("category", F.lit("")).alias("category"), "action", "at")
        .withColumn("until", F.lead("at").over(order))
        .where("action = 'add' AND (until IS NULL OR at < until)")
        .select("pattern", "category", F.col("at").alias("since"), "until")
        .distinct()
    )


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched, n_entries, categories, blocked for every row of captures(page_id, url,
    fetched): the active entries at the time of the fetch, how many and of which categories.

    Verdicts are made once for each distinct (url, fetched), which folds repeated captures before the
    join; only matching keys pass it, so a domain with a third of all captures costs its matches alone,
    and both joins leave skewed keys to adaptive splitting. A null url, one without a host, or a null
    time matches nothing (0, '', false); repeated rows give a row each; other columns are never read;
    empty tables give no rows or no matches."""
    rows = captures.select("page_id", "url", "fetched")
    looked = rows.where("url IS NOT NULL AND fetched IS NOT NULL").select("url", "fetched").distinct()
    keys = looked.select("url", "fetched", F.explode(keys_of(F.col("url"))).alias("pattern"))
    spans = intervals(entries)
    hits = keys.join(spans, "pattern").where("since <= fetched AND (until IS NULL OR fetched < until)")
    verdict = hits.groupBy("url", "fetched").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("c"))
    return rows.join(verdict, ["url", "fetched"], "left").select(
        "page_id", "url", "fetched", F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("c", F.lit("")).alias("categories"), F.col("n").isNotNull().alias("blocked")
    )
