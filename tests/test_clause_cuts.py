"""Clauses and token estimates by cheap signs are those of the plain patterns."""

import itertools

from pyspark.sql import functions as F

from regulith.functions import text as t
from regulith.plans import chunking as c

BITS = ["第一条", "（一）", "(3)", "12.", "3、", "。", "；", "：", ": ", "同时", "其中", " ", "\n", "abc", "é", "中文", "7", "\x0b"]


def cut(pattern):
    return lambda s: F.transform(F.split(s, pattern), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def test_cuts_are_those_of_the_patterns(spark):
    texts = ["", None, " \t\x0b"] + ["".join(x) for x in itertools.product(BITS, repeat=2)]
    df = spark.createDataFrame([(x,) for x in texts], "s string").withColumn("p", F.array("s"))
    plain = F.col("p")
    for pattern in c.CLAUSE_STARTS:
        plain = F.flatten(F.transform(plain, cut(pattern)))
        plain = F.filter(plain, lambda x: F.length(x) > 0)
    same = c.split_clauses("p", 1).eqNullSafe(plain)
    cjk = F.regexp_count("s", F.lit(t.CJK))
    words = F.regexp_count(F.regexp_replace("s", t.CJK, ""), F.lit(t.WORD))
    estimate = (cjk * 1.5 + words * 1.3 + (F.length("s") - F.length(F.replace("s", F.lit(" "), F.lit("")))) * 0.5).cast("int")
    estimate = F.when(F.col("s").isNull() | (F.length("s") == 0), F.lit(0)).otherwise(F.greatest(F.lit(1), estimate))
    assert df.filter(~same | ~t.token_estimate("s").eqNullSafe(estimate)).collect() == []


def test_white_space_before_a_line_separator_stays(spark):
    """Only the ends are stripped; the pattern used before also took blanks before a last U+2028."""
    assert spark.createDataFrame([(" a \u2028",)], "s string").select(t.strip("s")).first()[0] == "a \u2028"
