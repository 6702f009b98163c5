"""Hosts of many labels."""

from gridloom.llm import url_filters


def test_long_host(spark):
    """A host of 50,000 labels costs its length; rules of its own depth still fit."""
    host = ".".join(["a"] * 49_998 + ["example", "com"])
    pages = spark.createDataFrame([(1, f"http://{host}/en/x"), (2, "http://" + "." * 30_000), (3, f"http://b.{host}/")], "page_id long, url string")
    rules = url_filters.rules_table(spark, [("example.com", "/en/", "block"), ("a.a.example.com", "/", "allow"), (host, "/en/x", "block"), ("", "", "block")])
    got = {r.page_id: (len(r.rule or ""), r.verdict) for r in url_filters.judge_urls(pages, rules).collect()}
    assert got == {1: (len(host) + 5, "block"), 2: (0, "block"), 3: (len("a.a.example.com/"), "allow")}
