"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_or_empty, word_array

#: Fixed targets of the query: language shares; a source's share is its tokens to this power; topics share evenly in this proportion.
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
SOURCE_POWER = 0.7
TOPICS = {"prose": 0.7, "table": 0.1, "legal": 0.1, "config": 0.1}
SWEEPS = 12
RATE = 0.6
SEED = "mix-1"


def topic(text):
    """A document's topic by its first matching mark: a licence word, a column bar, an assignment, else prose."""
    return F.when(F.lower(text).contains("licen"), "legal").when(text.contains(" | "), "table").when(text.contains(" = "), "config").otherwise("prose")


def cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").cast("double").alias("tokens"))


def targets(cell: DataFrame, languages=LANGUAGES, topics=TOPICS, power=SOURCE_POWER) -> list[tuple[str, DataFrame]]:
    """The target share of each value of a dimension that has tokens; values without a stated share take their own share."""
    out = []
    for dim, stated in (("source", None), ("lang", languages), ("topic", topics)):
        own = cell.groupBy(dim).agg(F.sum("tokens").alias("own")).filter("own > 0")
        if stated is None:
            raw = F.pow("own", F.lit(power))
        else:
            share = reduce(lambda c, kv: c.when(F.col(dim) == kv[0], F.lit(float(kv[1]))), stated.items(), F.when(F.lit(False), F.lit(0.0)))
            total = own.agg(F.sum("own").alias("all_tokens"))
            own = own.join(F.broadcast(total))
            raw = F.coalesce(share, F.col("own") / F.col("all_tokens"))
        own = own.select(dim, raw.alias("raw"))
        out.append((dim, own.join(F.broadcast(own.agg(F.sum("raw").alias("sum_raw")))).select(dim, (F.col("raw") / F.col("sum_raw")).alias("target"))))
    return out


def rake(cell_rows: list[tuple], target_rows: dict[str, dict], sweeps: int = SWEEPS) -> list[float]:
    """Weights of cells (source, lang, topic, tokens): each sweep scales every dimension's shares to its targets in turn."""
    weight = [float(c[3]) for c in cell_rows]
    all_tokens = sum(weight)
    for _ in range(sweeps):
        for d, dim in enumerate(("source", "lang", "topic")):
            now: dict = {}
            for c, w in zip(cell_rows, weight, strict=True):
                now[c[d]] = now.get(c[d], 0.0) + w
            weight = [w * target_rows[dim][c[d]] * all_tokens / now[c[d]] if now[c[d]] > 0 else 0.0 for c, w in zip(cell_rows, weight, strict=True)]
    return weight


def probabilities(tokens: list[float], weight: list[float], rate: float = RATE) -> list[float]:
    """min(1, scale * weight / tokens) with the scale that keeps ``rate`` of all tokens in expectation."""
    factor = [w / t if t > 0 else 0.0 for w, t in zip(weight, tokens, strict=True)]
    goal, low, high = rate * sum(tokens), 0.0, 1.0
    kept = lambda s: sum(t * min(1.0, s * f) for t, f in zip(tokens, factor, strict=True))
    while kept(high) < goal * (1 - 1e-12) and high < 1e12:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if kept(mid) < goal else (low, mid)
    return [round(min(1.0, high * f), 9) for f in factor]


#: Most cells (distinct source, lang, topic) the driver fits; more are fitted as tables. Their number is that of groups.
MOST_CELLS = 1_000_000
#: Scales tried at once when cells are tables, and rounds of them: 64 ** 9 steps are finer than a double's.
POINTS, ROUNDS = 64, 9
CELLS = "source string, lang string, topic string, cell_tokens double, cell_weight double, probability double"


def _fitted(spark, cell: DataFrame, rate: float, sweeps: int) -> DataFrame:
    found = sorted((tuple(r) for r in cell.filter("tokens > 0").collect()), key=lambda c: tuple((x is None, x or "") for x in c[:3]))  # MOST_CELLS rows at most
    goal = {dim: {r[0]: r[1] for r in t.collect()} for dim, t in targets(cell)} if found else {}
    weight = rake(found, goal, sweeps) if found else []
    p = probabilities([c[3] for c in found], weight, rate) if found else []
    return spark.createDataFrame([(*c[:3], c[3], w, q) for c, w, q in zip(found, weight, p, strict=True)], CELLS)


def _fitted_tables(cell: DataFrame, rate: float, sweeps: int) -> DataFrame:
    """The same by joins, one written table a sweep; the scale comes from rounds of sums at many scales at once."""
    goal = [(dim, t.withColumnRenamed(dim, "__v")) for dim, t in targets(cell)]
    all_tokens = cell.agg(F.sum("tokens")).first()[0]
    now = materialize(cell.filter("tokens > 0").withColumn("w", F.col("tokens")))
    for _ in range(sweeps):
        step = now
        for dim, t in goal:
            own = step.groupBy(F.col(dim).alias("__v")).agg(F.sum("w").alias("__own"))
            factor = own.join(t, own["__v"].eqNullSafe(t["__v"])).select(own["__v"], F.when(F.col("__own") > 0, F.col("target") * F.lit(all_tokens) / F.col("__own")).otherwise(0.0).alias("__f"))
            step = step.join(factor, F.col(dim).eqNullSafe(F.col("__v"))).withColumn("w", F.col("w") * F.col("__f")).drop("__v", "__f")
        last, now = now, materialize(step)
        discard(last)
    f = F.col("w") / F.col("tokens")
    goal_tokens, low, high = rate * all_tokens, 0.0, 1.0
    kept = lambda scales: now.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(s) * f)).alias(f"k{i}") for i, s in enumerate(scales)]).first()
    powers = [2.0**k for k in range(41)]
    reached = [s for s, k in zip(powers, kept(powers), strict=True) if k >= goal_tokens * (1 - 1e-12)]
    high = reached[0] if reached else powers[-1]
    for _ in range(ROUNDS):
        scales = [low + (high - low) * k / POINTS for k in range(1, POINTS)]
        less = [s for s, k in zip(scales, kept(scales), strict=True) if k < goal_tokens]
        at = len(less)
        low, high = (less[-1] if less else low), (scales[at] if at < len(scales) else high)
    return now.select("source", "lang", "topic", F.col("tokens").alias("cell_tokens"), F.col("w").alias("cell_weight"), F.round(F.least(F.lit(1.0), F.lit(high) * f), 9).alias("probability"))


def cell_probabilities(rows: DataFrame, rate: float = RATE, sweeps: int = SWEEPS, most_cells: int = MOST_CELLS) -> tuple[DataFrame, bool]:
    """Inclusion probability of each cell, and whether the cells are few: up to ``most_cells`` rows reach the driver and come
    back as a table that may be broadcast, more are raked as tables."""
    cell = materialize(cells(rows))
    few = cell.limit(most_cells + 1).count() <= most_cells
    out = _fitted(rows.sparkSession, cell, rate, sweeps) if few else _fitted_tables(cell, rate, sweeps)
    if few:
        discard(cell)
    return out, few


def draw(doc_id, seed: str = SEED):
    """A uniform number in [0, 1) from 32 bits of the document's hash: the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(docs: DataFrame, rate: float = RATE, sweeps: int = SWEEPS, seed: str = SEED, most_cells: int = MOST_CELLS) -> DataFrame:
    """All rows with ``__probability``, ``__tokens``, ``__topic`` and the decision ``__sampled``.

    Token weight: words of the text. A null source or language is a value of its own; rows without tokens have
    probability 1 (they carry no weight, so dropping them cannot help the mix). Repeated rows draw alike. Very long texts count
    whole; an empty table gives no rows.
    """
    text = text_or_empty()
    rows = docs.withColumns({"__tokens": F.size(word_array(text)).cast("bigint"), "__topic": topic(text)})
    slim = rows.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"))
    p, few = cell_probabilities(slim, rate, sweeps, most_cells)
    p = p.select(F.col("source").alias("__s"), F.col("lang").alias("__l"), F.col("topic").alias("__t"), F.col("probability").alias("__p"))
    out = rows.join(F.broadcast(p) if few else p, rows["source"].eqNullSafe(p["__s"]) & rows["lang"].eqNullSafe(p["__l"]) & rows["__topic"].eqNullSafe(p["__t"]), "left").drop("__s", "__l", "__t")
    out = out.withColumn("__probability", F.when(F.col("__tokens") > 0, F.coalesce("__p", F.lit(1.0))).otherwise(1.0)).drop("__p")
    return out.withColumn("__sampled", draw(F.col("doc_id"), seed) < F.col("__probability"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows with the columns of ``docs``."""
    return mixed(docs, **options).filter("__sampled").select(*docs.columns)


def oracle(sweeps: int = SWEEPS, rate: float = RATE) -> str:
    """The same in SQL: one common table for each step of each sweep, and bisection written as a recursion."""
    case = lambda dim, d: "CASE " + " ".join(f"WHEN {dim} = '{k}' THEN {v}" for k, v in d.items()) + f" ELSE own / (SELECT sum(tokens) FROM cell) END"
    sql = [
        r"""RECURSIVE rows_ AS (SELECT doc_id, source, lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS tokens,
 CASE WHEN contains(lower(text), 'licen') THEN 'legal' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, ' = ') THEN 'config' ELSE 'prose' END AS topic FROM documents)""",
        "cell AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM rows_ GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for dim, raw in (("source", f"pow(own, {SOURCE_POWER})"), ("lang", case("lang", LANGUAGES)), ("topic", case("topic", TOPICS))):
        sql.append(f"t_{dim} AS MATERIALIZED (SELECT {dim}, raw / sum(raw) OVER () AS target FROM (SELECT {dim}, {raw} AS raw FROM (SELECT {dim}, sum(tokens) AS own FROM cell GROUP BY ALL)))")
    last, n = "cell", 0
    for _ in range(sweeps):
        for dim in ("source", "lang", "topic"):
            n += 1
            w = "tokens" if last == "cell" else "w"
            sql.append(f"k{n} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.{w} * t.target * (SELECT sum(tokens) FROM cell) / sum(c.{w}) OVER (PARTITION BY c.{dim}) AS w FROM {last} c JOIN t_{dim} t ON c.{dim} IS NOT DISTINCT FROM t.{dim})")
            last = f"k{n}"
    sql.append(f"f AS MATERIALIZED (SELECT *, w / tokens AS factor FROM {last})")
    sql.append("up AS (SELECT 1.0::DOUBLE AS high UNION ALL SELECT high * 2 FROM up WHERE high < 1e12 AND (SELECT sum(tokens * least(1.0, high * factor)) FROM f) < " + f"{rate} * (SELECT sum(tokens) FROM f) * (1 - 1e-12))")
    sql.append(f"bis AS (SELECT 0 AS i, 0.0::DOUBLE AS low, (SELECT max(high) FROM up) AS high UNION ALL SELECT i + 1, CASE WHEN less THEN (low + high) / 2 ELSE low END, CASE WHEN less THEN high ELSE (low + high) / 2 END FROM (SELECT *, (SELECT sum(tokens * least(1.0, (low + high) / 2 * factor)) FROM f) < {rate} * (SELECT sum(tokens) FROM f) AS less FROM bis WHERE i < 100))")
    sql.append("p AS (SELECT source, lang, topic, round(least(1.0, (SELECT high FROM bis WHERE i = 100) * factor), 9) AS probability FROM f)")
    return "WITH " + ",\n".join(sql) + f"""
SELECT doc_id, tokens::BIGINT AS n_tokens, topic, round(probability, 6) AS probability, u < probability AS sampled FROM (
 SELECT r.doc_id, r.tokens, r.topic, CASE WHEN r.tokens > 0 THEN coalesce(p.probability, 1.0) ELSE 1.0 END AS probability, ('0x' || substr(md5('{SEED}:' || coalesce(r.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
 FROM rows_ r LEFT JOIN p ON r.source IS NOT DISTINCT FROM p.source AND r.lang IS NOT DISTINCT FROM p.lang AND r.topic = p.topic)"""
