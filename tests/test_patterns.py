"""A service's patterns: whatever is let through runs in Spark and matches what Python's reading of it matches."""

import random
import re

from pyspark.sql import functions as F

from tidemill.operators import conventions as C

TEXTS = ("301-12", "A1234-b", "see 7.2.1 {x}", "a]b[c", "", "aa\nbb", "^$|&&")
REFUSED = (None, "", "(", "[a", "a{,3}", "{", "x}", "(?(1)a|b)", "(?P=n)", "[[a]]", "[a&&b]", "[]a]", r"\0", r"\Z", r"[\b]", r"\U0001F600", "(?x) a", "(?a)a", "a**", r"(a)\2", "(?#c)a")
TAKEN = {r"(?P<n>\d{3})-\d+": r"(\d{3})-\d+", r"\(?P<n>x": r"\(?P<n>x", "[A-Z][0-9]{4}(?:-[a-z])?": "[A-Z][0-9]{4}(?:-[a-z])?", "(?i)see ([0-9.]+)": "(?i)see ([0-9.]+)", r"(?<=see )\d+?": r"(?<=see )\d+?"}


def _table(spark, patterns):
    return spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "i int, pattern string")


def test_patterns_are_refused_or_made_plain(spark):
    assert C.usable(_table(spark, REFUSED)).count() == 0
    assert {r.pattern for r in C.usable(_table(spark, TAKEN)).collect()} == set(TAKEN.values())


def test_patterns_of_random_pieces_never_fail_a_job(spark):
    r = random.Random(11)
    pieces = [*"ab1-.^$|*+?()[]{}&\\", "(?:", "(?P<n>", "(?=", "(?<!", "(?i)", "[^a-c]", "[\\d.]", "{2,}", "{,2}", "\\d", "\\b", "\\1", "\\Z", "[a-"]
    tried = ["".join(r.choices(pieces, k=r.randrange(1, 7))) for _ in range(20_000)]
    good = C.usable(_table(spark, tried))
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    found = good.join(F.broadcast(texts)).select("i", "text", "pattern", F.expr("rlike(text, pattern)").alias("hit"), F.expr("regexp_count(text, pattern)").alias("n")).collect()
    assert len(found) > 10_000
    # $ and ^ by lines are the engines' own; all else is read alike
    assert [x for x in found if "\n" not in x.text and bool(re.search(tried[x.i], x.text)) != x.hit] == []


def test_a_service_answer_for_python_alone_does_not_fail_the_job(spark):
    bands = spark.createDataFrame([("m", 1, "quote Procedure 301-1 Edition 2", "", 0), ("n", 1, "quote Procedure 301-1 Edition 2", "", 0)], "manual_id string, page int, header string, footer string, drawings int")
    answers = spark.createDataFrame([("m", r"(?P<n>\d{3})-\d+", "edition", None, ["Data"]), ("n", "a{,3}(?(1)b)", "edition", None, ["Data"])], "manual_id string, pattern string, revision_field string, granularity string, label_words array<string>")
    got = {r.manual_id: (r.pattern, r.source) for r in C.replaced(C.detect(bands), answers, bands).collect()}
    assert got["m"] == (r"(\d{3})-\d+", "service")
    assert got["n"][1] != "service"
