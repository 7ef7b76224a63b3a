"""Number parsing against the grammar published for Java's Double.valueOf.

The Java API documentation of ``Double.valueOf(String)`` gives a regular
expression for exactly the strings it accepts; it is restated here (Python
syntax) as the test oracle. A cell is a number iff it matches, else a
true/false word, else not a number.
"""

import math
import random
import re

from pyspark.sql import functions as F

from glmframe.functions.numeric import lenient_number

DIGITS = r"([0-9]+)"  # \p{Digit} in Java regex is ASCII only
HEX_DIGITS = r"([0-9a-fA-F]+)"
EXP = r"[eE][+-]?" + DIGITS
JAVA_DOUBLE = re.compile(
    r"[\x00-\x20]*[+-]?("
    r"NaN|Infinity|"
    r"(((" + DIGITS + r"(\.)?(" + DIGITS + r"?)(" + EXP + r")?)|"
    r"(\.(" + DIGITS + r")(" + EXP + r")?)|"
    r"(((0[xX]" + HEX_DIGITS + r"(\.)?)|(0[xX]" + HEX_DIGITS + r"?(\.)" + HEX_DIGITS + r"))"
    r"[pP][+-]?" + DIGITS + r"))[fFdD]?))[\x00-\x20]*"
)

TRICKY = [
    "1", "-1", "+1", "1.", ".5", ".", "1.5e3", "1.5E-3", "1e", "e5", "1e+", "1e5d", "1.0f", "2D", "3F",
    "0x1p3", "0X1P-2", "0x1.8p1", "0x.8p1", "0x1", "0xp1", "1p3", "NaN", "+NaN", "-NaN", "nan", "NAN",
    "Infinity", "-Infinity", "+Infinity", "infinity", "inf", "-inf", "Inf", "1_000", "1,5", "١٢",
    "", " ", "\t7\t", " 8 ", "00012", "1e400", "-1e400", "4.9e-324", "1e-400", "--1", "+-1", "1..2",
    "1.2.3", "0x", "0x1p", "true", "FALSE", "TrUe", "yes", "t", "1d5", "d", "+", "-", "NaNd", "Infinityf",
]


def java_accepts(text: str) -> bool:
    return JAVA_DOUBLE.fullmatch(text) is not None


def expected(text: str):
    t = text.strip("".join(chr(i) for i in range(0x21)))
    if java_accepts(t):
        core = t.rstrip("fFdD") if not t.endswith(("NaN", "Infinity")) else t
        if "x" in core.lower():
            sign = -1.0 if core.startswith("-") else 1.0
            return sign * float.fromhex(core.lstrip("+-"))
        return float(core)
    if t.lower() in ("true", "false"):
        return 1.0 if t.lower() == "true" else 0.0
    return None


def test_lenient_number_follows_java_grammar(spark):
    rnd = random.Random(11)
    alphabet = "0123456789.eE+-xXpPdDfFaN In"
    cells = TRICKY + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i INT, c STRING")
    got = {r["i"]: r["x"] for r in df.select("i", lenient_number(F.col("c"), on_error="null").alias("x")).collect()}
    mismatches = []
    for i, c in enumerate(cells):
        want, have = expected(c), got[i]
        same = (want is None and have is None) or (
            want is not None and have is not None and (want == have or (math.isnan(want) and math.isnan(have)))
        )
        if not same:
            mismatches.append((c, want, have))
    assert mismatches == []
