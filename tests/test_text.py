from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.functions import views as V


def one(spark, expression, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} string" for n in names)).select(expression).first()[0]


def test_names(spark):
    tokens = lambda raw: one(spark, T.name_core(T.name_tokens(F.lower(T.clean_name(F.col("x"))))), x=raw)
    assert tokens("-- Holloway Peak Inc") == ["holloway", "peak"]
    assert tokens("<< Team Ecole") == ["team", "ecole"]
    assert tokens("M/s Galaxy Tech") == ["galaxy", "tech"]
    assert tokens("galaxytechprivate.com") == ["galaxytechprivate"]
    assert tokens("Shell Holdings LLC d/b/a Blue Cafe") == ["blue", "cafe"]
    assert tokens("22Nd Street Bakery") == ["22", "street", "bakery"]
    assert tokens("") == [] and tokens(None) == [] and tokens("NA") == ["na"]


def test_addresses(spark):
    tokens = lambda raw: one(spark, T.address_tokens(F.lower(T.strip_junk(F.col("x")))), x=raw)
    assert tokens("##16939 VANILLA ORCHID DR") == ["16939", "vanilla", "orchid", "drive"]
    assert tokens("Plot No.F-003, N Main St") == ["plot", "number", "f", "3", "north", "main", "street"]
    assert tokens("f003 000") == ["f3", "0"]


def test_scripts(spark):
    assert one(spark, T.fold(F.col("x")), x="Président ＡＢ") == "president ab"
    assert one(spark, T.romanise(F.col("x")), x="Straße œuvre Łódź") == "Strasse oeuvre Lodz"
    gujarati = one(spark, F.lower(T.romanise(F.col("x"))), x="શિવ મા ટેક્નોલોજી")
    assert gujarati.isascii() and gujarati.split()[0].startswith("shiv") and len(gujarati.split()) == 3
    assert one(spark, T.romanise(F.col("x")), x="plain") == "plain"
    assert one(spark, T.non_latin(F.col("x")), x="é") is True


def test_ngrams_and_views(spark):
    assert one(spark, T.char_ngrams(F.col("x")), x="ab cd") == ["abc", "bcd", "abcd"]
    assert one(spark, T.char_ngrams(F.col("x")), x="a") == []
    rows = spark.createDataFrame([("1", "x", "Dhule Roadlines Ltd", "Plot F-003, Midc Avadhan, Dhule"), ("2", "x", "", "")], "id string, country string, name string, address string")
    p = V.parsed(rows)
    keys = {r.id: set(r.k) for r in p.select("id", V.VIEWS["composite"]().alias("k")).collect()}
    assert {"n:dhule", "n:roadlines", "a:avadhan", "d:3", "c:3|dhule"} <= keys["1"] and keys["2"] == set()
    assert V.postings(p, ("full", "addr_ngram")).where("token like 'h:%'").count() > 0
    assert {r.key: r.value for r in V.exact_keys(p).where("id = '1'").collect()}["numbers"] == "3"
