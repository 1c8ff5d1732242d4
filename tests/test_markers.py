"""Marker terms of shape fingerprints, worked out by hand from the reference's list."""

from pyspark.sql import functions as F

from coppice.functions import text

CASES = [
    ("if_statement>return_statement", 24, ["control:if", "flow:return", "size:small"]),
    ("match_expression>case", 25, ["control:branch", "size:medium"]),
    ("if_let>for_in>while_let>string_literal>try_block", 81, ["size:large"]),
    ("while_expression>loop_expression>await_expression", 1, ["control:loop", "flow:defer_or_try", "size:small"]),
    ("let_declaration>call_expression>field_expression", 1, ["data:binding", "shape:call", "shape:member", "size:small"]),
    ("augmented_assignment_expression>func_literal", 1, ["data:assignment", "shape:closure", "size:small"]),
    ("", 1, ["size:small"]),
]


def test_marker_terms(spark):
    df = spark.createDataFrame([(k, f, n) for k, (f, n, _) in enumerate(CASES)], "k int, f string, n int")
    got = {r["k"]: r["t"] for r in df.select("k", text.marker_terms(F.col("f"), F.col("n")).alias("t")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(CASES)}
