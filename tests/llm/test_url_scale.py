"""Verdicts of linked hosts don't depend on how many other pages there are."""

from pyspark.sql import functions as F

from evigraph.llm import url_filters

SCHEMA = "page_id bigint, url string, html string"


def test_verdicts_of_linked_hosts_do_not_change_with_size(spark):
    """A host links to a one-page blocked host that has 300 inlinks: blocked among few pages and among many seeds."""
    rows = [(0, "http://bad.net/fr/", None)] + [(k, f"http://h{k}.org/", '<a href="http://bad.net/fr/">') for k in range(1, 301)]
    few = spark.createDataFrame(rows, SCHEMA)
    more = spark.range(1_000_000).select((F.col("id") + 1000).alias("page_id"), F.lit("http://other.net/fr/").alias("url"), F.lit(None).cast("string").alias("html"))
    for pages in (few, few.unionByName(more)):
        got = url_filters.judge(pages).filter("page_id between 1 and 300").groupBy("verdict").count().collect()
        assert [tuple(r) for r in got] == [("block", 300)]


def test_distrust_goes_as_far_as_links_go(spark):
    """A chain of 12 links to a blocked host: all of it is blocked, where 8 sweeps end before its far end."""
    rows = [(k, f"http://h{k}.org/", f'<a href="http://h{k + 1}.org/">') for k in range(11)] + [(11, "http://h11.org/", '<a href="http://bad.net/fr/">'), (12, "http://bad.net/fr/", None)]
    got = {r.page_id: r.verdict for r in url_filters.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: "block" for k in range(13)}


def test_settled_scores_solve_the_equations(spark):
    """On a graph with a cycle: trust = 0.15 seeds + 0.85 of what links bring, distrust backwards."""
    edges = [("a.com", "b.org"), ("b.org", "c.org"), ("c.org", "b.org"), ("d.net", "c.org"), ("c.org", "d.net"), ("e.org", "d.net")]
    rows = [(k, f"http://{a}/{'fr/' if a == 'd.net' else ''}", f'<a href="http://{b}/x">') for k, (a, b) in enumerate(edges)]
    got = {r.host: (r.trust, r.distrust) for r in url_filters.host_scores(spark.createDataFrame(rows, SCHEMA), sweeps=None).collect()}
    out, into = [{h: sum(e[j] == h for e in edges) for e in edges for h in e} for j in (0, 1)]
    for h in out:
        trust = 0.15 * (h == "a.com") + 0.85 * sum(got[a][0] / out[a] for a, b in edges if b == h)
        distrust = 0.15 * (h == "d.net") + 0.85 * sum(got[b][1] / into[b] for a, b in edges if a == h)
        assert abs(got[h][0] - trust) <= 1e-6 * trust and abs(got[h][1] - distrust) <= 1e-6 * distrust
