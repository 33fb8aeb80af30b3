"""Dated URL lists as a temporal join.

List entries are dated events: an entry is added to, or removed from, a list at a time. Each
addition becomes a validity interval that ends at the next event of the same entry and list. A
capture is judged by the entries for its host, or for a domain above it, that are active at its
fetch time: an as-of join by equality of domain and containment of the time in the interval.

Distinct (host, time) pairs are judged once and joined back, so a host that holds a third of all
captures is looked up once a time; the join back is an equi-join that skew splitting covers. Whether
the list is broadcast is left to Spark, which knows its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and final dots; null where there is none."""
    found = F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"[.]+$", "")
    return F.when(found != "", found)


def intervals(events: DataFrame) -> DataFrame:
    """Events (list, domain, at, added boolean) as intervals: list, domain, valid_from, valid_to (null: open), end exclusive.

    Of several events of one entry at one time the removal counts. Rows with a null domain, list or
    time say nothing.
    """
    clean = events.select("list", F.lower("domain").alias("domain"), "at", "added").filter("list is not null and domain is not null and at is not null and added is not null")
    once = clean.groupBy("list", "domain", "at").agg(F.min("added").alias("added"))
    order = Window.partitionBy("list", "domain").orderBy("at")
    return once.withColumn("valid_to", F.lead("at").over(order)).filter("added").select("list", "domain", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """id, host, fetched, n_active, lists (sorted, comma-joined), blocked, one row for each capture.

    A null or hostless URL and a null time match nothing: n_active 0, blocked false. Repeated
    captures are judged alike and all stay. Columns that captures has beside these don't matter.
    """
    rows = captures.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), F.col(time_col).alias("fetched"))
    labels = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = rows.filter("host is not null and fetched is not null").select("host", "fetched").distinct()
    named = pairs.select("host", "fetched", F.explode(above).alias("domain"))
    valid = intervals(events)
    hit = named.join(valid, (named["domain"] == valid["domain"]) & (named["fetched"] >= valid["valid_from"]) & (valid["valid_to"].isNull() | (named["fetched"] < valid["valid_to"])))
    active = hit.groupBy("host", "fetched").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    return rows.join(active, ["host", "fetched"], "left").select("id", "host", "fetched", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("n_active").isNotNull().alias("blocked"))
