"""Quality rules: text statistics as column expressions and decision lists learned by sequential covering.

The list is an ordered chain of conditional expressions; only DataFrame functions touch the documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, text_or_empty, word_array

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Labelled rows a list is fitted on, at most: those of least hash.
MOST_LABELLED = 6000
FEATURES = ("n_words", "repeat_share", "symbol_share", "upper_share", "bang_share", "distinct_share", "dup_line_share", "mean_word")


def _let(value, use):
    """Evaluate a value once and use it many times."""
    return F.transform(F.array(value), use)[0]


def _covered(windows):
    """Words within windows that occur twice or more, from the window hashes in text order."""

    def of_sorted(s):
        twice = F.filter(s, lambda e, i: (F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))) | (F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))))
        places = F.array_sort(F.transform(twice, lambda e: e["i"]))
        gaps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return _let(places, lambda p: F.aggregate(gaps(p), F.lit(0), lambda a, x: a + x))

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(F.array_sort(pairs), of_sorted))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and, as ``__s_<name>``, the base statistics and the features of FEATURES."""
    rows = docs.withColumn("__text", text_or_empty(text))
    rows = rows.withColumns({"__words": word_array(F.col("__text")), "__lines": F.filter(F.split("__text", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))})
    n = F.size("__words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumns(
        {
            "__windows": windows,
            "__s_n_words": n.cast("bigint"),
            "__s_word_chars": F.char_length(F.translate("__text", " \t\n\x0b\x0c\r", "")).cast("bigint"),
            "__s_n_symbols": (F.char_length("__text") - F.char_length(F.translate("__text", SYMBOLS, ""))).cast("bigint"),
            "__s_n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "__upper": F.char_length("__text") - F.char_length(F.translate("__text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
            "__bang": F.char_length("__text") - F.char_length(F.translate("__text", "!", "")),
            "__distinct": F.size(F.array_distinct("__words")),
            "__n_lines": F.size("__lines"),
        }
    )
    rows = rows.withColumn("__s_n_repeat_words", _covered(F.col("__windows")).cast("bigint"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), 6)
    rows = rows.withColumns(
        {
            "__s_repeat_share": share("__s_n_repeat_words", "__s_n_words"),
            "__s_symbol_share": share("__s_n_symbols", "__s_word_chars"),
            "__s_upper_share": share("__upper", "__s_word_chars"),
            "__s_bang_share": share("__bang", "__s_n_words"),
            "__s_distinct_share": share("__distinct", "__s_n_words"),
            "__s_dup_line_share": share("__s_n_dup_lines", "__n_lines"),
            "__s_mean_word": share("__s_word_chars", "__s_n_words"),
        }
    )
    return rows.drop("__text", "__words", "__lines", "__windows", "__upper", "__bang", "__distinct", "__n_lines")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= value, else feature <= value
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.value if self.above else row[self.feature] <= self.value

    def column(self):
        c = F.col("__s_" + self.feature)
        return c >= F.lit(self.value) if self.above else c <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.value:g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _grow(rows: list[dict], most: int, not_first: frozenset = frozenset()) -> Rule:
    """Add the condition of most information gain until only bad rows are covered; ``not_first`` names what must not begin it."""
    rule: Rule = ()
    while len(rule) < most:
        p, n = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
        if not p or not n:
            break
        before, best = math.log2(p / (p + n)), (0.0, None)
        for f in FEATURES:
            for above in (True, False):
                if not rule and (f, above) in not_first:
                    continue
                ordered = sorted(rows, key=lambda r: -r[f] if above else r[f])
                cp = cn = 0
                for k, r in enumerate(ordered):
                    cp, cn = cp + r["bad"], cn + (not r["bad"])
                    if cp and (k + 1 == len(ordered) or ordered[k + 1][f] != r[f]):
                        gain = cp * (math.log2(cp / (cp + cn)) - before)
                        if gain > best[0] + 1e-9:
                            # The threshold stands halfway to the next value.
                            value = r[f] if k + 1 == len(ordered) else (r[f] + ordered[k + 1][f]) / 2
                            best = (gain, Condition(f, above, round(value, 6)))
        if best[1] is None:
            break
        rule += (best[1],)
        rows = [r for r in rows if best[1].holds(r)]
    return rule


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """Drop final conditions while (bad - clean) / covered on the rows held out does not fall."""

    def worth(x: Rule) -> float:
        hit = [r["bad"] for r in rows if _covers(x, r)]
        return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def cover(rows: list[dict], precision: float = 0.98, least: int = 5, most_rules: int = 12, most_conditions: int = 4) -> list[Rule]:
    """Rules for bad rows in order: grow on two thirds, prune on the rest, remove what is covered, go on.

    A rule must reach ``precision`` and cover ``least`` bad rows of all rows left. One that doesn't, pruned or whole, is
    given up, and others are grown that begin with another condition; the list ends when none is left to try.
    """
    rules: list[Rule] = []
    while len(rules) < most_rules:
        if sum(r["bad"] for r in rows) < least:
            break
        grow, prune = [r for i, r in enumerate(rows) if i % 3], rows[::3]
        tried: frozenset = frozenset()
        found: Rule = ()
        while not found:
            whole = _grow(grow, most_conditions, tried)
            if not whole:
                return rules
            for rule in (_prune(whole, prune), whole):
                hit = [r["bad"] for r in rows if _covers(rule, r)]
                if sum(hit) >= least and sum(hit) >= precision * len(hit):
                    found = rule
                    break
            tried |= {(whole[0].feature, whole[0].above)}
        rules.append(found)
        rows = [r for r in rows if not _covers(found, r)]
    return rules


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, **options) -> list[Rule]:
    """Fit on at most ``most_labelled`` labelled documents (quality 0 is bad), those whose ids have the least hashes."""
    chosen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).withColumnRenamed("doc_id", "__doc_id")
    slim = docs.select(F.col("doc_id"), F.col("text"))
    rows = statistics(slim.join(F.broadcast(chosen), slim["doc_id"] == chosen["__doc_id"]))  # most_labelled rows of two numbers
    # One row an id, the least: repeated ids can't pass the bound.
    values = F.struct((F.col("__quality") == 0).alias("bad"), *(F.col("__s_" + f).cast("double").alias(f) for f in FEATURES))
    found = rows.groupBy("doc_id").agg(F.min(values).alias("x")).select("doc_id", "x.*").collect()
    rows = sorted((r.asDict() for r in found), key=lambda r: (r["doc_id"] * 2654435761 % 4294967296, r["doc_id"]))
    return cover(rows, **options)


def verdict(rules: list[Rule]):
    """(kept, rule) as ordered conditional expressions over the statistics: the first rule that holds rejects."""
    failed = base_failed()
    name = F.lit(None).cast("string")
    for k in range(len(rules), 0, -1):
        holds = rules[k - 1][0].column()
        for c in rules[k - 1][1:]:
            holds = holds & c.column()
        name = F.when(holds, f"{k}: " + " and ".join(map(str, rules[k - 1]))).otherwise(name)
    name = F.when(failed, "base").otherwise(name)
    return name.isNull(), name


def base_failed():
    return (F.col("__s_n_words") < 20) | (100 * F.col("__s_n_repeat_words") > 30 * F.col("__s_n_words"))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """All columns of ``docs`` with the statistics ``__s_*``, ``__base_failed``, ``__kept`` and the deciding ``__rule``.

    Null and empty texts have no words and fail the base rule. Without labelled bad documents the list is empty and the
    base rule alone decides. Null and repeated doc_ids stay, each row on its own; an empty table gives no rows.
    """
    rules = learn(docs, labels, **options)
    kept, rule = verdict(rules)
    return statistics(docs).withColumns({"__base_failed": base_failed(), "__kept": kept, "__rule": rule})


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that no rule rejects, with the columns of ``docs``."""
    # The test of the row number keeps the filter where it is: pushed below, it would compute the statistics over again.
    rows = judge(docs, labels, **options).withColumn("__row", F.monotonically_increasing_id())
    return rows.filter("__kept AND __row >= 0").select(*docs.columns)
