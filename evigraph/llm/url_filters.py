"""URL filters: rules by host and path, else personalised PageRank from trusted and reversed distrust from blocked seeds.

DataFrame functions only; one row for each pair of linked hosts takes part in the iterations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: (host, path, verdict): fixed rules of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""
SWEEPS = 8  # of the SQL; judge() goes on until scores settle
#: Scores have settled when a sweep adds no more than this part to any host's trust or distrust.
SETTLED = 1e-7
DAMPING = 0.85
#: A host is blocked where its distrust is over this many times its trust.
BLOCK_RATIO = 1.0
#: Scores are shares of a mass of one and shrink with the number of pages, so they are compared by their ratio: distrust
#: within this part of the threshold counts as equal to it.
TIE = 1e-6


#: Links that name a host: after a scheme, or at once.
ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host, path, rules=RULES):
    """(rule, verdict) of the longest rule that fits, null without one: a chain of conditions, longest rule first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts with their numbers; relative links stay on their host and give no edge, whatever other
    address they name in a query. Pages without html give none."""
    links = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1))
    far = F.filter(links, lambda x: x.rlike(ABSOLUTE))
    far = F.transform(far, lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))
    out = pages.select(host_of(F.col("url")).alias("src"), F.explode(far).alias("link")).select("src", host_of(F.col("link")).alias("dst"))
    return out.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(pages: DataFrame, rules=RULES, sweeps: int | None = SWEEPS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust after ``sweeps`` rounds; with None, after as many as it takes until they settle.

    Trust starts on the hosts of allowed pages (in proportion to those pages) and follows links; distrust starts on the
    hosts of blocked pages and follows links backwards. Both scores sum to one at most.
    """
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    _, verdict = best_rule(F.col("host"), F.col("path"), rules)
    seeds = pages.select(host.alias("host"), path.alias("path")).select("host", verdict.alias("verdict")).filter("host <> ''").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    total = seeds.agg(F.greatest(F.sum("a"), F.lit(1)).alias("sa"), F.greatest(F.sum("b"), F.lit(1)).alias("sb"))
    seeds = materialize(seeds.join(F.broadcast(total)).select("host", (F.col("a") / F.col("sa")).alias("trust0"), (F.col("b") / F.col("sb")).alias("distrust0")))
    edges = materialize(host_edges(pages))
    out_n, in_n = edges.groupBy("src").agg(F.sum("n").alias("out_n")), edges.groupBy("dst").agg(F.sum("n").alias("in_n"))
    steps = edges.join(out_n, "src").join(in_n, "dst")
    forth = steps.select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("n") / F.col("out_n")).alias("wt"), F.lit(0.0).alias("wd"))
    back = steps.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("wt"), (F.col("n") / F.col("in_n")).alias("wd"))
    steps = materialize(forth.unionByName(back).groupBy("from", "to").agg(F.sum("wt").alias("wt"), F.sum("wd").alias("wd")))
    score = seeds.select("host", F.col("trust0").alias("trust"), F.col("distrust0").alias("distrust"))
    if steps.isEmpty():  # every round would give (1 - damping) times the seeds: the same thresholds
        return score.select("host", (F.lit(1 - damping) * F.col("trust")).alias("trust"), (F.lit(1 - damping) * F.col("distrust")).alias("distrust"))
    if sweeps is None:
        return _settled(seeds, steps, damping)
    for i in range(sweeps):
        sent = steps.join(score, steps["from"] == score["host"]).groupBy("to").agg(F.sum(F.col("wt") * F.col("trust")).alias("t"), F.sum(F.col("wd") * F.col("distrust")).alias("d"))
        score = seeds.join(sent, seeds["host"] == sent["to"], "full").select(F.coalesce("host", "to").alias("host"), *((F.lit(1 - damping) * F.coalesce(s, F.lit(0.0)) + F.lit(damping) * F.coalesce(m, F.lit(0.0))).alias(n) for s, m, n in (("trust0", "t", "trust"), ("distrust0", "d", "distrust"))))
        if i % 4 == 3:
            score = materialize(score)
    return score


def _settled(seeds: DataFrame, steps: DataFrame, damping: float) -> DataFrame:
    """Sums of what each sweep adds: scores only grow, and a host that is reached for the first time is a change."""
    start = lambda n: (F.lit(1 - damping) * F.col(f"{n}0")).alias(n)
    score = added = seeds.select("host", start("trust"), start("distrust"))
    held = []
    while True:
        new = []
        for _ in range(4):
            added = steps.join(added, steps["from"] == added["host"]).groupBy(F.col("to").alias("host")).agg((F.lit(damping) * F.sum(F.col("wt") * F.col("trust"))).alias("trust"), (F.lit(damping) * F.sum(F.col("wd") * F.col("distrust"))).alias("distrust")).filter("trust > 0 or distrust > 0")
            added = materialize(added)
            new.append(added)
        last = [F.lit(0.0).alias(n) for n in ("dt", "dd")]
        parts = [score, *new[:-1]]
        rows = new[-1].select("host", "trust", "distrust", F.col("trust").alias("dt"), F.col("distrust").alias("dd"))
        for p in parts:
            rows = rows.unionByName(p.select("host", "trust", "distrust", *last))
        total = materialize(rows.groupBy("host").agg(*(F.sum(n).alias(n) for n in ("trust", "distrust", "dt", "dd"))))
        score = total.select("host", "trust", "distrust")
        discard(*held)
        held = [total, *new]
        if total.filter((F.col("dt") > SETTLED * F.col("trust")) | (F.col("dd") > SETTLED * F.col("distrust"))).isEmpty():
            return score


def judge(pages: DataFrame, rules=RULES, sweeps: int | None = None, damping: float = DAMPING, ratio: float = BLOCK_RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust.

    The longest rule that fits decides; else a host whose distrust is over ``ratio`` times its trust is blocked, any
    other allowed. Null urls and urls without ``://`` have an empty host, fit no rule and are allowed. Repeated rows and
    null page_ids stay, each row on its own; an empty table gives no rows.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("__v"))
    score = host_scores(pages, rules, sweeps, damping)
    out = rows.join(score, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(distrust > F.lit(ratio * (1 + TIE)) * trust, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("__v", method).alias("verdict"), F.round(trust, 6).alias("trust"), F.round(distrust, 6).alias("distrust"))


def oracle(sweeps: int = SWEEPS, damping: float = DAMPING, ratio: float = BLOCK_RATIO, rules=RULES) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r[0], r[1]))
    case = lambda out: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out(h, p, v)}'" for h, p, v in ordered) + " END"
    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    host = lambda x: low(f"coalesce(regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1), '')")
    sql = [
        f"pg AS MATERIALIZED (SELECT page_id, {host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages)",
        f"ru AS MATERIALIZED (SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS v FROM pg)",
        "se AS MATERIALIZED (SELECT host, a / greatest(sum(a) OVER (), 1) AS t0, b / greatest(sum(b) OVER (), 1) AS d0 FROM (SELECT host, (count(*) FILTER (v = 'allow'))::DOUBLE AS a, (count(*) FILTER (v = 'block'))::DOUBLE AS b FROM ru WHERE host <> '' GROUP BY host))",
        f"""li AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']?([^"''\\s>]+)', 1))) AS x FROM pg)""",
        f"ed AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS n FROM (SELECT src, {host('CASE WHEN starts_with(x, ' + chr(39) + '//' + chr(39) + ') THEN ' + chr(39) + 'http:' + chr(39) + ' || x ELSE x END')} AS dst FROM li WHERE contains(x, '//')) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL)",
        "st AS MATERIALIZED (SELECT f, t, sum(wt) AS wt, sum(wd) AS wd FROM (SELECT src AS f, dst AS t, n / sum(n) OVER (PARTITION BY src) AS wt, 0.0::DOUBLE AS wd FROM ed UNION ALL SELECT dst, src, 0.0, n / sum(n) OVER (PARTITION BY dst) FROM ed) GROUP BY ALL)",
        "s0 AS MATERIALIZED (SELECT host, t0 AS trust, d0 AS distrust FROM se)",
    ]
    for i in range(sweeps):
        sql.append(f"s{i + 1} AS MATERIALIZED (SELECT coalesce(se.host, m.t) AS host, round({1 - damping} * coalesce(t0, 0) + {damping} * coalesce(mt, 0), 12) AS trust, round({1 - damping} * coalesce(d0, 0) + {damping} * coalesce(md, 0), 12) AS distrust FROM se FULL JOIN (SELECT st.t, sum(wt * trust) AS mt, sum(wd * distrust) AS md FROM st JOIN s{i} ON st.f = s{i}.host GROUP BY st.t) m ON se.host = m.t)")
    return "WITH " + ",\n".join(sql) + f"\nSELECT page_id, ru.host, path, rule, coalesce(v, CASE WHEN round(coalesce(distrust, 0), 9) > round({ratio} * coalesce(trust, 0), 9) THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust FROM ru LEFT JOIN s{sweeps} s ON ru.host = s.host"
