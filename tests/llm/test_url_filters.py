import datetime as dt

from oracle_check import compare, oracle_connection

from ronda.llm import url_filters
from ronda.llm.oracle import ORACLE
from ronda.llm.queries import llm_queries

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def judged(spark, captures, entries):
    c = spark.createDataFrame(captures, "page_id long, url string, fetched date, said int, domain string")
    e = spark.createDataFrame(entries, "list string, domain string, action string, category string, dated date, verdict int")
    out = url_filters.filtered(c, e)
    return sorted(((r.page_id, r.host, r.verdict, r.domain, r.category, r.n_active) for r in out.collect()), key=repr)


def test_entries_hold_from_their_day_to_the_next(spark):
    entries = [
        ("block", "Bad.example", "add", "one", day(10), 0),
        ("block", "bad.example", "add", "one", day(10), 0),
        ("block", "bad.example", "add", "two", day(20), 0),
        ("block", "bad.example", "remove", None, day(30), 0),
        ("block", "bad.example", "add", "three", day(30), 0),
        ("allow", "good.bad.example", "add", "ok", day(15), 0),
        ("allow", "bad.example", "add", "tie", day(25), 0),
        (None, "bad.example", "add", "x", day(0), 0),
        ("block", None, "add", "x", day(0), 0),
        ("block", "bad.example", "add", "x", None, 0),
    ]
    captures = [
        (k, url, when, 0, "x")
        for k, (url, when) in enumerate(
            [
                ("http://bad.example/a", day(9)),
                ("http://BAD.example:80/a", day(10)),
                ("https://user@www.bad.example?q", day(24)),
                ("http://bad.example", day(25)),
                ("http://bad.example", day(30)),
                ("http://x.good.bad.example/", day(20)),
                ("http://notbad.example/", day(20)),
                ("no url", day(20)),
                (None, day(20)),
                ("http://bad.example/", None),
            ]
        )
    ] + [(None, "http://bad.example/", day(10), 0, "x"), (1, "http://bad.example/", day(21), 0, "x")]
    assert judged(spark, captures, entries) == sorted(
        [
            (0, "bad.example", "none", None, None, 0),
            (1, "bad.example", "block", "bad.example", "one", 1),
            (1, "bad.example", "block", "bad.example", "two", 1),
            (2, "www.bad.example", "block", "bad.example", "two", 1),
            (3, "bad.example", "allow", "bad.example", "tie", 2),
            (4, "bad.example", "allow", "bad.example", "tie", 1),
            (5, "x.good.bad.example", "allow", "good.bad.example", "ok", 2),
            (6, "notbad.example", "none", None, None, 0),
            (7, None, "none", None, None, 0),
            (8, None, "none", None, None, 0),
            (9, "bad.example", "none", None, None, 0),
            (None, "bad.example", "block", "bad.example", "one", 1),
        ],
        key=repr,
    )


def test_empty_tables(spark):
    assert judged(spark, [], []) == []
    assert judged(spark, [(1, "http://a.b/", DAY, 0, "x")], []) == [(1, "a.b", "none", None, None, 0)]


def test_query_gives_what_its_sql_gives(spark, sf_dir):
    name = "op6_url_filters"
    assert compare(spark, oracle_connection(sf_dir), name, llm_queries()[name], ORACLE[name], sf_dir) is None
