"""Subject-predicate-object lines in four formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("tsv", "pipe", "rdf", "token")
#: White space at the ends of lines and values, as a regular expression class.
SPACE = r"[ \t\r\n\x0B\f]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def _named(words: Column, keys: tuple[str, str]) -> Column:
    """The value of the last word that gives one of the keys."""
    mine = F.filter(words, lambda w: F.substring_index(w, "=", 1).isin(*keys) & w.contains("="))
    last = F.element_at(mine, -1)
    return F.when(F.size(mine) > 0, trimmed(F.regexp_replace(last, "^[^=]*=", ""))).otherwise("")


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^<(.*)>$", "$1")


def parse(lines: DataFrame, fmt: str) -> DataFrame:
    """``lines`` (line_number, value, ...) with subject, predicate, object, subject_type, object_type and, of a line that
    doesn't parse, error. Blank lines and those that start with # drop out.

    tsv and pipe: three fields at least, then types. rdf: three words, angle brackets dropped, a last dot allowed. token:
    words key=value with the keys SUBJ or S, REL or P, OBJ or O; the last of a key counts.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown relation format {fmt!r}")
    rows = lines.withColumn("value", trimmed(F.col("value"))).filter("value <> '' AND value NOT LIKE '#%'")
    if fmt in ("tsv", "pipe"):
        p = F.transform(F.split("value", r"\t" if fmt == "tsv" else r"\|", -1), trimmed)
        parts = [F.get(p, F.lit(k)) for k in range(5)]
        ok = F.size(p) >= 3
    elif fmt == "rdf":
        p = F.filter(F.split(F.regexp_replace("value", r"\.$", ""), f"{SPACE}+"), lambda w: w != "")
        parts = [_bare(F.get(p, F.lit(k))) for k in range(3)] + [F.lit(None).cast("string")] * 2
        ok = F.size(p) >= 3
    else:
        p = F.split("value", f"{SPACE}+")
        parts = [_named(p, keys) for keys in (("SUBJ", "S"), ("REL", "P"), ("OBJ", "O"))] + [F.lit(None).cast("string")] * 2
        ok = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    names = ("subject", "predicate", "object", "subject_type", "object_type")
    error = F.when(~ok, F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(f": cannot parse {fmt} relation")))
    return rows.select(*lines.columns, *[F.when(ok, F.coalesce(c, F.lit(""))).alias(n) for c, n in zip(parts, names, strict=True)], error.alias("error"))
