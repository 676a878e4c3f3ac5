"""URL filters: lists of domains that change over time, joined to captures as of their fetch.

Dated list entries become intervals of validity, each until the next entry of
the same list and domain.  A capture is held against the entries of its host
and of every domain above it that were valid when it was fetched; the most
specific one decides, and of equals the allow list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADD, REMOVE = "add", "remove"


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, category, valid_from, valid_to) from (list, domain, action, category, dated).

    An entry holds from its day up to the next entry of its list and domain; an
    entry that removes ends the one before and begins nothing.  Of entries of
    one day the last in the order of action and category counts, so that a
    removal beats an addition; repeated entries count once.  Null lists, domains
    and days are left out; domains are compared in lower case.
    """
    own = entries.select("list", F.lower("domain").alias("domain"), "action", "category", "dated")
    own = own.where("list is not null and domain is not null and dated is not null and action is not null")
    latest = own.groupBy("list", "domain", "dated").agg(F.max(F.struct("action", "category")).alias("said"))
    following = F.lead("dated").over(Window.partitionBy("list", "domain").orderBy("dated"))
    held = latest.withColumn("valid_to", following)
    return held.where(F.col("said.action") == ADD).select(
        "list", "domain", F.col("said.category").alias("category"), F.col("dated").alias("valid_from"), "valid_to"
    )


def host(url: Column) -> Column:
    """Host of a URL in lower case, without port; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(found != "", found)


def domains_of(name: Column) -> Column:
    """A host and the domains above it, down to two labels."""
    labels = F.split(name, "[.]")
    first = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.transform(first, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def filtered(captures: DataFrame, entries: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id_col, host, fetched, verdict, domain, category, n_active) for every capture (id_col, url, fetched).

    verdict is "allow", "block" or "none"; domain and category are those of the
    entry that decides, ``n_active`` counts the entries that were valid.  A null
    or hostless URL and a null fetch day meet no entry; rows that repeat an id
    are judged each for itself.

    Captures of one host and day meet the same entries, so these are judged
    once, before captures are joined to the verdict.
    """
    valid = intervals(entries)
    rows = captures.select(F.col(id_col), host(F.col("url")).alias("host"), "fetched")
    kinds = rows.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    asked = kinds.withColumn("domain", F.explode(domains_of(F.col("host"))))
    active = asked.join(valid, "domain").where(
        (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    )
    said = F.struct(
        F.length("domain").alias("specific"),
        (F.col("list") == "allow").alias("allows"),
        F.col("list").alias("list"),
        F.col("domain").alias("domain"),
        F.col("category").alias("category"),
    )
    judged = active.groupBy("host", "fetched").agg(F.max(said).alias("said"), F.count("*").alias("n_active"))
    return rows.join(judged, ["host", "fetched"], "left").select(
        id_col,
        "host",
        "fetched",
        F.coalesce("said.list", F.lit("none")).alias("verdict"),
        F.col("said.domain").alias("domain"),
        F.col("said.category").alias("category"),
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
    )


def dated_captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched): pages have no fetch day, so their id gives one within the year 2024."""
    day = F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """(list, domain, action, category, dated): lists drawn from the domains of the pages by their md5.

    A quarter of the domains come onto the block list, an eighth onto the allow
    list; most change their category later, and every other one is removed.
    """
    domains = pages.select(host(F.col("url")).alias("h")).where("h is not null").distinct()
    domains = domains.select(F.explode(domains_of(F.col("h"))).alias("domain")).distinct()
    hexed = F.md5("domain")
    number = lambda at, width: F.conv(F.substring(hexed, at, width), 16, 10).cast("int")
    start = F.lit("2024-01-01").cast("date")
    first, later, last = number(3, 2), number(5, 2), number(7, 2)
    steps = [
        ("block", number(1, 1) < 4, ADD, "adult", first),
        ("block", (number(1, 1) < 4) & (number(2, 1) < 10), ADD, "phishing", first + later),
        ("block", (number(1, 1) < 4) & (number(2, 1) % 2 == 0), REMOVE, None, first + later + last),
        ("allow", number(9, 1) < 2, ADD, "partner", later),
        ("allow", (number(9, 1) < 2) & (number(2, 1) % 2 == 1), REMOVE, None, later + last),
    ]
    events = F.array(
        *(
            F.when(
                when,
                F.struct(
                    F.lit(name).alias("list"),
                    F.lit(action).alias("action"),
                    F.lit(category).cast("string").alias("category"),
                    F.date_add(start, days).alias("dated"),
                ),
            )
            for name, when, action, category, days in steps
        )
    )
    return domains.select("domain", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select(
        "e.list", "domain", "e.action", "e.category", "e.dated"
    )
