import hashlib
import random

import pytest
from pyspark.sql import functions as F

from samerow.functions import (
    WHITESPACE,
    decode_ignore,
    is_blank,
    key_digest,
    key_fields,
    line_prefix,
    strip_py,
)
from tests.model import key_of


def run(spark, values, expr, column_type="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {column_type}")
    return [r["out"] for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def random_texts(alphabet, count, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(count)]


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip_and_blank_agree_with_python(spark):
    texts = random_texts(WHITESPACE + "ab;é​\U0001f600", 3000, 8, 1)
    assert run(spark, texts, strip_py(F.col("v"))) == [t.strip() for t in texts]
    assert run(spark, texts, is_blank(F.col("v"))) == [not t.strip() for t in texts]


def test_decode_agrees_with_python_on_random_bytes(spark):
    rng = random.Random(2)
    pieces = [b"a", b";", b"0", b"1", "é".encode(), "�".encode(), "".encode(), "\U0001f600".encode()]
    pieces += [b"\xff", b"\xc3", b"\xe2\x82", b"\xf0\x9f", b"\x80", b"\xed\xa0\x80", b"\xc0\xaf", b"\xee\x80"]
    raw = [b"".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(5000)]
    got = run(spark, [bytearray(b) for b in raw], decode_ignore(F.col("v").cast("string")), "binary")
    assert got == [b.decode("utf-8", "ignore") for b in raw]


@pytest.mark.parametrize("delimiter", [";", "|", ".", "\t", "aa", "aba", "||", ", ", "é", "\\E", "$^"])
@pytest.mark.parametrize("n", [1, 2, 6])
def test_key_is_the_first_fields(spark, delimiter, n):
    texts = random_texts(delimiter + delimiter + "abx;E", 400, 14, n)
    assert run(spark, texts, key_fields(F.col("v"), delimiter, n)) == [key_of(t, delimiter, n) for t in texts]


def test_key_keeps_quotes_case_and_blanks(spark):
    line = '"010";"a;b"; X ;x'
    assert run(spark, [line], key_fields(F.col("v"), ";", 3)) == ['"010";"a;b"']
    assert run(spark, ["A;b ;c"], key_fields(F.col("v"), ";", 2)) == ["A;b "]
    assert run(spark, ["a;b", "a;b;"], key_fields(F.col("v"), ";", 2)) == ["a;b", "a;b"]
    assert run(spark, [";x"], key_fields(F.col("v"), ";", 1)) == [""]


def test_prefix_counts_code_points(spark):
    texts = ["\U0001f600" * 60, "é" * 47 + "x", "short", "a\tb"]
    assert run(spark, texts, line_prefix(F.col("v"))) == [t[:47] for t in texts]
    assert run(spark, texts, line_prefix(F.col("v"), 3, tabs_to_spaces=True))[3] == "a b"


def test_digest(spark):
    assert run(spark, ["é;1"], key_digest(F.col("v"))) == [hashlib.sha256("é;1".encode()).hexdigest()]


@pytest.mark.parametrize(
    "call",
    [
        lambda: key_fields(F.col("v"), ";", 0),
        lambda: key_fields(F.col("v"), "", 1),
        lambda: line_prefix(F.col("v"), 0),
    ],
)
def test_bad_parameters_are_refused(spark, call):
    with pytest.raises(ValueError):
        call()
