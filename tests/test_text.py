import random

from pyspark.sql import functions as F

from feedyard.functions import text as X
from feedyard.schemas import FALSE_TOKENS, TRUE_TOKENS

WS = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())


def test_strip_matches_python(spark):
    samples = [WS + "abc" + WS, "  TEST-001  ", "\tx ", "​keep​", "a b", ""]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(X.py_strip("s")).collect()]
    assert got == [s.strip() for s in samples]


def test_flags(spark):
    casings = (str.lower, str.upper, str.title, lambda s: f" {s}\t")
    toks = [case(s) for s in TRUE_TOKENS + FALSE_TOKENS for case in casings] + ["2", "truth", "", None]
    df = spark.createDataFrame([(t,) for t in toks], "v string")
    rows = df.select("v", X.lenient_flag("v").alias("l"), X.strict_flag("v").alias("s")).collect()
    for r in rows:
        v = (r["v"] or "").strip().lower()
        assert r["l"] == (v not in FALSE_TOKENS)
        assert r["s"] == (True if v in TRUE_TOKENS else False if v in FALSE_TOKENS else None)


def test_percent_rounds_like_python(spark):
    rnd = random.Random(7)
    pairs = [(250, 1000), (500, 1000), (0, 0), (5, -1)] + [(rnd.randint(0, 999), rnd.randint(1, 999))
                                                          for _ in range(300)]
    df = spark.createDataFrame(pairs, "p long, t long")
    for p, t, got in df.select("p", "t", X.percent("p", "t")).collect():
        assert got == (round(p / t * 100, 2) if t > 0 else 0)


def test_truncate_body(spark):
    df = spark.createDataFrame([("a" * 1000,), ("b" * 1001,), (None,)], "b string")
    r = df.select(X.truncate_body("b").alias("x"), X.cut_text("b").alias("y")).collect()
    assert r[0]["x"] == "a" * 1000
    assert r[1]["x"] == "b" * 1000 + "... (truncated)"
    assert r[1]["y"] == "b" * 1000
    assert r[2]["x"] is None


def test_like_escape_and_wildcards(spark):
    df = spark.createDataFrame([("100%",), ("1000",), ("a_b",), ("axb",), ("back\\slash",), ("end\\",)], "s string")

    def hits(text):
        return sorted(r[0] for r in df.filter(X.contains_ci("s", text)).collect())

    assert hits("0%") == ["100%", "1000"]          # % stays a wildcard
    assert hits("a_b") == ["a_b", "axb"]            # _ stays a wildcard
    assert hits("a\\_b") == ["a_b"]                 # escaped underscore is literal
    assert hits("k\\slash") == []                   # an escaped letter is the letter itself
    assert hits("k\\\\slash") == ["back\\slash"]   # a doubled backslash is a literal one
    assert hits("\\") == ["100%"]                   # trailing backslash -> literal %
    assert hits("BACK") == ["back\\slash"]          # case-insensitive


def test_error_text_and_keys(spark):
    df = spark.createDataFrame([("ValueError", "bad", "j1")], "t string, m string, j string")
    h, c = X.progress_keys("j")
    r = df.select(X.error_text("t", "m"), h, c, X.size_mb(F.lit(5 * 1024 * 1024))).first()
    assert tuple(r) == ("ValueError: bad", "import_progress:hash:j1", "import_progress:channel:j1", "5.00")


def test_codec_round_trip_and_fallback(spark):
    from feedyard.functions import codec as CD
    df = spark.createDataFrame([("importing",), ('"importing"',), ("123",), ("12.5",), ('{"k": 7}',), ("true",)],
                               "v string")
    rows = df.select("v", CD.decode_text("v").alias("d"), CD.is_json("v").alias("j"),
                     CD.encode(F.lit("a\"b")).alias("e"), CD.get_long("v", "$.k").alias("k")).collect()
    got = {r["v"]: (r["d"], r["j"]) for r in rows}
    assert got["importing"] == ("importing", False)       # str() text falls back to raw
    assert got['"importing"'] == ("importing", True)
    assert got["123"] == ("123", True) and got["12.5"] == ("12.5", True)
    assert rows[0]["e"] == '"a\\"b"'
    assert [r["k"] for r in rows if r["v"].startswith("{")] == [7]
