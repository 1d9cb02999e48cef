"""Reasons mined from logs: an ordered table of rules over the last lines of a log, newest line first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines that are looked at, from the end, and characters of a tail that are shown.
LAST, SHOWN = 40, 160
#: A file path, with or without a drive, up to the next white space.
PATH = r"([A-Za-z]:)?[\\/][^\s]+"


def lines_of(logs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line: the lines that are not blank, without white space at their ends."""
    flat = logs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    return flat.select(key, "pos", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line")).filter("line <> ''")


def masked(line: Column, variables: Sequence[tuple[str, str]] = ()) -> Column:
    """A line that may be shown: a leading 'skip:' goes, names of variables and paths are replaced, and it is cut to ``SHOWN`` characters."""
    out = F.regexp_replace(line, r"^skip:\s*", "")
    for pattern, text in variables:
        out = F.regexp_replace(out, pattern, text)
    return F.substring(F.regexp_replace(out, PATH, "…"), 1, SHOWN)


def reasons(lines: DataFrame, key: str, rules: Sequence[tuple[str, str]], code: str | None = None, variables: Sequence[tuple[str, str]] = (), last: int = LAST) -> DataFrame:
    """key, reason, by_rule of every key of ``lines`` (key, pos, line and, if named, the exit code).

    Of the last ``last`` lines the newest that matches a rule decides, with its first rule;
    without one the masked last line stands, as an error where the exit code is not 0."""
    newest = Window.partitionBy(key).orderBy(F.col("pos").desc())
    tail = lines.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= last)
    rule = F.coalesce(*[F.when(F.col("line").rlike(p), F.lit(t)) for p, t in rules]) if rules else F.lit(None).cast("string")
    place = F.when(F.col("__rule").isNotNull(), F.col("pos"))
    extra = [F.max(code).alias("__code")] if code else [F.lit(0).alias("__code")]
    found = tail.withColumn("__rule", rule).groupBy(key).agg(F.max_by("__rule", place).alias("by"), F.max_by("line", "pos").alias("line"), *extra)
    shown = masked(F.col("line"), variables)
    failed = F.coalesce(F.col("__code"), F.lit(0)) != 0
    plain = F.when(failed, F.concat(F.lit("failed (code "), F.col("__code").cast("string"), F.lit("): "), shown)).otherwise(shown)
    return found.select(key, F.coalesce("by", plain).alias("reason"), F.col("by").isNotNull().alias("by_rule"))
