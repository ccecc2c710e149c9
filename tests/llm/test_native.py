"""Line dedup and the url filter against plain-Python versions, and the SQL twins."""

import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cardlake.llm import linededup, queries, urlfilter
from cardlake.session import TABLES, table
from tests.conftest import SF_SMALL
from tests.test_entry import _fp


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert _fp(df.columns, rows) == _fp(cols, cur.fetchall())


@pytest.mark.parametrize("name", ["op3_line_dedup", "op6_url_filter"])
def test_no_python_in_the_plan(spark, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def brute_lines(rows, ratio, min_pages):
    pages = defaultdict(set)
    for host, text in rows:
        if host is not None and text is not None:
            pages[host].add(text)
    gone = set()
    for host, texts in pages.items():
        n = defaultdict(int)
        for t in texts:
            for line in {x.strip(" ") for x in t.split("\n")} - {""}:
                n[line] += 1
        gone |= {(host, x) for x, k in n.items() if k >= min_pages and k / len(texts) > ratio}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in gone) for h, t in rows]


LINE_ROWS = [("a", "Home\nx1\n  Home \n\nend"), ("a", "Home\nx2"), ("a", "Home \nx3\nx3"), ("a", "Home"), ("a", None), ("a", ""),
             (None, "Home\nx1"), ("b", "Home\nonly"), ("b", "only here"), ("c", "copy\nof\nme"), ("c", "copy\nof\nme"), ("c", "copy\nof\nme"),
             ("c", "copy\nother"), ("d", None), ("e", "\n\n"), ("f", "z\n" * 50_000), ("f", "z"), ("f", "z\ny")]


@pytest.mark.parametrize("limit", ["10m", "-1"])
@pytest.mark.parametrize("ratio, min_pages", [(0.5, 3), (0.0, 1), (0.5, 1), (1.0, 1)])
def test_lines_match_brute_force(spark, limit, ratio, min_pages):
    docs = spark.createDataFrame([(i, h, t, 9) for i, (h, t) in enumerate(LINE_ROWS)], "id int, source string, text string, host int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        out = linededup.drop_boilerplate(docs, ratio=ratio, min_pages=min_pages)
        assert out.columns == docs.columns
        got = [r.text for r in out.orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == brute_lines(LINE_ROWS, ratio, min_pages)


def test_line_counts_and_empty_table(spark):
    docs = spark.createDataFrame(LINE_ROWS, "source string, text string")
    out = linededup.drop_boilerplate(docs, ratio=0.5, counts=("n", "gone")).collect()
    assert sorted((r.n, r.gone) for r in out if r.source == "a") == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 1), (5, 2)]
    assert linededup.drop_boilerplate(docs.where("false")).count() == 0


def brute_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for h, p, v in rules:
        if h and p is not None and v is not None and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h + p), len(h), h + p, v))
    return host, path, *(best[2:] if best else (None, default))


RULES = [("org", "/", "allow"), ("example.org", "/a/", "block"), ("example.org", "/a/b", "allow"), ("example.org", "/a/bc", "block"),
         ("x.example.org", "/", "block"), ("com", "", "block"), ("com", "/k", "allow"), ("com", "/k", "block"), ("b.com", "", "allow"),
         ("", "/", "block"), (None, "/", "block"), ("net", None, "block"), ("ö.de", "/ü", "block"), ("a,b.org", "/", "block")]
URLS = [None, "", "no scheme", "http://", "HTTP://Example.ORG/a/b?x=/a/bc", "http://example.org/a/bcd#f", "http://example.org/a/bd", "http://example.org",
        "http://example.org?x", "http://y.x.example.org/a/bc", "http://com/k", "http://a.b.com/k", "http://organic/", "http://a..org/", "http://org./",
        "http://.org/", "ftp://z.com#/k", "x://y://z.org/", "http://Ö.de/ü", "http://ö.de/üx", "http://b.a.org/", "http://a,b.org/", "http://net/",
        "http://user@w.com:80/k", "http://" + "l." * 2000 + "com/k" + "k" * 50_000, "http://exa\nmple.org/a/\nb"]


@pytest.mark.parametrize("sweep", [200_000, 1])
def test_urls_match_brute_force(spark, monkeypatch, sweep):
    monkeypatch.setattr(urlfilter, "SWEEP", sweep)
    r = random.Random(4)
    urls = URLS + ["http://" + ".".join(r.choice(["a", "b", "x", "example", "org", "com"]) for _ in range(r.randint(1, 4)))
                   + "".join(r.choice(["/", "a", "b", "c", "k"]) for _ in range(r.randint(0, 6))) for _ in range(300)]
    rows = [(i if i % 5 else None, u, "p", 1) for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, path string, id int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(tuple, urlfilter.judge_urls(pages, rules).collect()), key=str)
    assert got == sorted([(i, *brute_url(u, RULES)) for i, u, _, _ in rows], key=str)
    assert urlfilter.judge_urls(pages.where("false"), rules).count() == 0
    none = urlfilter.judge_urls(pages, rules.where("false"), default="block").where("rule is null and verdict = 'block'")
    assert none.count() == len(rows)


def test_hot_url_and_line(spark):
    pages = table(spark, SF_SMALL, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "http://hot.org/x").otherwise(F.col("url")).alias("url"))
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge_urls(pages, rules).collect()}
    assert got == {r.page_id: brute_url(r.url, queries.URL_RULES) for r in pages.collect()}
