from pyspark.sql import functions as F

from proseweave.functions import labels as L
from proseweave.functions import predicates as P
from proseweave.functions import text as T

# the rules drop the period of a company suffix before a sentence starter
EDGE = [
    ("Mr. Smith went home. He slept.", ["Mr. Smith went home.", "He slept."]),
    ("We like Acme Inc. They pay.", ["We like Acme Inc", "They pay."]),
    ("Made in the U.S. He left.", ["Made in the U.S.", "He left."]),
    ("It costs 3.14 euros. Visit site.com now.", ["It costs 3.14 euros.", "Visit site.com now."]),
    ("She has a Ph.D. in art.", ["She has a Ph.D. in art."]),
    ("Wait... what? Yes!", ["Wait...", "what?", "Yes!"]),
    ('He said "go." Then left.', ['He said "go".', "Then left."]),
    ("no end", ["no end"]),
    ("", []),
    ("One. . Two.", ["One.", ".", "Two."]),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EDGE)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", T.sentences(F.col("t")).alias("s")).collect()}
    for i, (t, want) in enumerate(EDGE):
        assert got[i] == want, t
    assert spark.sql("select cast(null as string) t").select(T.sentences(F.col("t")).alias("s")).first()["s"] is None


def test_predicates(spark):
    rows = [
        ("Call 555-123-4567 now", "phone"), ("Call (555) 123 4567", None), ("I live at 12 Old Mill Road today", "address"),
        ("write to a.b@c.org please", "mail"), ("Items. 1. first", "list"), ("see www.x", "link"), ("plain words", None),
    ]
    df = spark.createDataFrame(rows, "t string, kind string")
    t = F.col("t")
    out = df.select("t", "kind", P.has_phone(t).alias("phone"), P.has_address(t).alias("address"), P.has_mail(t).alias("mail"), P.looks_like_list(t).alias("list"), P.has_link(t).alias("link")).collect()
    for r in out:
        if r["kind"]:
            assert r[r["kind"]], r
    assert not any(out[-1][k] for k in ("phone", "address", "mail", "list", "link"))


def test_index_and_flags(spark):
    df = spark.createDataFrame([("(3, 5)",), ("[1, 2]",), ("junk",), ("7",), (None,), ("(0, 1)",)], "raw string").select("raw", T.index_list(F.col("raw")).alias("i"))
    got = {r["raw"]: r["i"] for r in df.collect()}
    assert got == {"(3, 5)": [3, 5], "[1, 2]": [1, 2], "junk": [], "7": [], None: [], "(0, 1)": [0, 1]}
    s = F.array(F.lit("a b c d e"), F.lit("x y"), F.lit("last one"))
    flags = df.select("raw", L.first_flag(F.col("i")).alias("first"), L.consecutive_flag(F.col("i")).alias("cons"), L.short_flag(F.col("i"), s).alias("short"), L.end_flag(F.col("i"), F.lit(5)).alias("end"))
    g = {r["raw"]: r for r in flags.collect()}
    assert (g["[1, 2]"]["first"], g["[1, 2]"]["cons"], g["[1, 2]"]["short"]) == (1, 1, 0)
    assert g["(0, 1)"]["short"] == 1  # position wraps to the last sentence
    assert g["(3, 5)"]["end"] == 1 and g["junk"]["first"] is None


def test_kinds_and_spacing(spark):
    df = spark.createDataFrame([("absent",), ("['close']",), ("['distant']",), ("[]",)], "k string")
    assert [r[0] for r in df.select(L.kind_code(F.col("k"))).collect()] == [0, 1, 2, 0]
    one = spark.range(1)
    assert one.select(T.space_after_stop(F.lit("a.b 3.14 ...x"))).first()[0] == "a. b 3. 14 . .. x"
    assert one.select(T.tidy_generated(F.lit("One, two. Three! Four"))).first()[0] == "One two.Three"
