"""JSON texts: escapes, nesting and fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The deepest nesting that is read, and characters with an escape of their own.
MOST_DEPTH = 16
SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def escaped(text: Column) -> Column:
    """A text as it stands between quotation marks in JSON; other control characters become four hexadecimal digits."""
    for c, to in SHORT.items():
        text = F.replace(text, F.lit(c), F.lit(to))
    for k in set(range(32)) - {ord(c) for c in SHORT}:
        text = F.replace(text, F.lit(chr(k)), F.lit(f"\\u{k:04x}"))
    return text


def depth(text: Column) -> Column:
    """How deep brackets nest outside of strings."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    opens = F.transform(F.split(marks, ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    walk = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(opens, walk, lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most")), lambda s: s["most"])


def parsed(text: Column) -> Column:
    """The value of a JSON text, null where it is malformed or nests too deep."""
    return F.when(depth(text) <= MOST_DEPTH, F.try_parse_json(text))
