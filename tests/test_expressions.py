"""Known answers of column expressions."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from netquarry.functions import fingerprints as fp
from netquarry.functions import network, text
from netquarry.operators import markov, sketches, stats, windows


def value(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column).first()[0]


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<int>")


@pytest.mark.parametrize(("s", "bits"), [("aaaa", 0), ("abcd", 2), ("aabb", 1), ("", 0), ("google", 1.918), ("facebook", 2.75), ("applepine", 2.419)])
def test_char_entropy(spark, s, bits):
    assert value(spark, text.char_entropy(F.lit(s))) == pytest.approx(bits, abs=1e-3)


def test_lexical_measures(spark):
    assert value(spark, text.ngram_entropy(F.lit("a"))) == 0 and value(spark, text.ngram_entropy(F.lit("abab"))) == pytest.approx(0.918, abs=1e-3)
    assert value(spark, text.digit_ratio(F.lit("a1b2"))) == 0.5 and value(spark, text.digit_ratio(F.lit(""))) == 0
    assert value(spark, text.vowel_ratio(F.lit("AbEc"))) == 0.5
    assert value(spark, text.domain_label(F.lit("a.b.com"))) == "a" and value(spark, text.domain_label(F.lit(""))) == ""
    assert value(spark, text.entropy_of_counts(ints(2, 2, 0))) == 1.0 and value(spark, text.entropy_of_counts(ints())) == 0.0


def test_ja3(spark):
    first = fp.ja3(F.lit(769), ints(47, 53, 5, 10, 49161, 49162, 49171, 49172, 50, 56, 19, 4), ints(0, 10, 11), ints(23, 24, 25), ints(0))
    assert value(spark, first) == "ada70206e40642a3e4461f35503241d5"
    assert value(spark, fp.ja3(F.lit(769), ints(4, 5, 10, 9, 100, 98, 3, 6, 19, 18, 99), ints(), ints(), ints())) == "de350869b8c85de67a350c8d186f11e6"
    greased = fp.ja3(F.lit(769), ints(0x0A0A, 47, 53, 5, 10, 49161, 49162, 49171, 49172, 50, 56, 19, 4), ints(0, 0xFAFA, 10, 11), ints(0x1A1A, 23, 24, 25), ints(0))
    assert value(spark, greased) == "ada70206e40642a3e4461f35503241d5"


CIPHERS = (0x1301, 0x1302, 0x1303, 0xC02B, 0xC02F, 0xC02C, 0xC030, 0xCCA9, 0xCCA8, 0xC013, 0xC014, 0x009C, 0x009D, 0x002F, 0x0035)
EXTENSIONS = (0x001B, 0x0000, 0x0033, 0x0010, 0x4469, 0x0017, 0x002D, 0x000D, 0x0005, 0x0023, 0x0012, 0x002B, 0xFF01, 0x000B, 0x000A, 0x0015)
SIGNATURES = (0x0403, 0x0804, 0x0401, 0x0503, 0x0805, 0x0501, 0x0806, 0x0601)


def test_ja4(spark):
    alpn = F.array(F.lit("h2").cast("binary"))
    whole = fp.ja4(F.lit(0x0303), ints(0x0304), F.lit("example.com"), ints(*CIPHERS), ints(*EXTENSIONS), ints(*SIGNATURES), alpn)
    assert value(spark, whole) == "t13d1516h2_8daaf6152771_e5627efa2ab1"
    assert value(spark, fp.ja4_extension_hash(ints(0, 16), ints())) == value(spark, fp.ja4_cipher_hash(ints(0x2A2A))) == "000000000000"
    bare = fp.ja4(F.lit(0x0299), ints(), F.lit(""), ints(*[*range(1, 150)]), ints(), ints(), F.array().cast("array<binary>"))
    assert value(spark, bare).startswith("t00i990000_")


@pytest.mark.parametrize(("hexed", "code"), [("6832", "h2"), ("687474702F312E31", "h1"), ("AB", "ab"), ("20", "20"), ("ABCD", "ad"), ("2061", "21"), ("30AB", "3b"), ("6120", "60"), ("3031ABCD", "3d"), ("30ABCD31", "01"), ("68", "hh"), ("", "00")])
def test_ja4_alpn(spark, hexed, code):
    assert value(spark, fp.ja4_alpn(F.array(F.unhex(F.lit(hexed))))) == code


def test_canonical_direction_is_by_text(spark):
    ahead = network.is_forward(F.lit("10.0.0.9"), F.lit(1), F.lit("10.0.0.10"), F.lit(1))
    assert value(spark, ahead) is False  # '9' sorts after '1'
    assert value(spark, network.is_forward(F.lit("a"), F.lit(2), F.lit("a"), F.lit(2))) is True
    assert value(spark, network.rcode_name(F.lit(3))) == "NXDOMAIN" and value(spark, network.qtype_name(F.lit(99))) == "OTHER"
    assert value(spark, network.ratio(F.lit(0), F.lit(0), 0.5)) == 0.5


def test_markov_by_hand(spark):
    corpus = spark.createDataFrame([("ab",)] * 3, "s string")
    model = markov.fit(corpus, "s", order=1)
    asked = spark.createDataFrame([(1, "ab"), (2, "ba"), (3, "")], "id int, s string")
    found = {r.id: r.score for r in markov.score(asked, "id", "s", model, order=1).collect()}
    assert found[1] == pytest.approx(math.log(0.8)) and found[2] == pytest.approx((math.log(0.2) + math.log(0.5)) / 2) and found[3] is None
    twice = markov.fit(corpus, "s", 1, earlier=model)
    assert twice.agg(F.sum("n")).first()[0] == 12
    nothing = model.where("false")
    assert {r.score for r in markov.score(asked, "id", "s", nothing, order=1).collect()} == {None}


def test_moments_against_the_standard_library(spark):
    data = [1.7e9 + x for x in (0.0, 0.5, 3.25, -2.0, 8.0)]
    df = spark.createDataFrame([("a", x) for x in data] + [("b", 4.0)], "k string, x double")
    rows = {r.k: r for r in stats.summary(df, ["k"], F.col("x")).collect()}
    assert rows["a"].variance == pytest.approx(statistics.pvariance(data), rel=1e-6) and rows["b"].variance == 0 and rows["b"].n == 1
    assert df.groupBy("k").agg(stats.sample_variance(F.col("x")).alias("v")).where("k = 'b'").first().v == 0
    negative = spark.createDataFrame([("a", -1.0), ("a", -3.0)], "k string, x double")
    assert stats.summary(negative, ["k"], F.col("x")).first().cv == 0


def test_sketches_keep_their_bounds(spark):
    rows = spark.range(500).select(F.lit("s").alias("src_ip"), (F.col("id") % 100).alias("v"), F.col("id"))
    sketch = sketches.cms_build(rows, "src_ip", "v", 64, 4)
    found = sketches.cms_estimate(sketch, rows, "src_ip", "v", 64, 4)
    assert found.where("estimate < 5").count() == 0 and found.count() == 100
    unknown = spark.createDataFrame([("other", 1)], "src_ip string, v long")
    assert sketches.cms_estimate(sketch, unknown, "src_ip", "v", 64, 4).first().estimate == 0
    estimate = rows.agg(F.hll_sketch_estimate(F.hll_sketch_agg("id", F.lit(12))).alias("e")).first().e
    assert abs(estimate - 500) < 25


def test_dns_windows(spark):
    schema = "event_id long, us long, src_ip string, dst_ip string, is_response boolean, rcode int, questions array<struct<qname:string,qtype:string>>, answers array<struct<ttl:int>>"
    q = [("x.com", "A")]
    rows = [(1, 0, "c", "r", False, 0, q * 2, []), (2, 1, "r", "c", True, 3, q, []), (3, 2, "r", "c", True, 3, q, []), (4, 3, "r", "c", True, 3, q, [(60,), (30,)]), (5, 4, "r", "c", True, 0, q, [(50,)])]
    got = windows.dns_vector(spark.createDataFrame(rows, schema), 1_000_000).collect()
    assert len(got) == 1 and got[0].client_ip == "c"
    v = got[0]
    assert (v.query_count, v.domain_n, v.unique_domains_est, v.response_count, v.nxdomain_count, v.nxdomain_rate, v.ttl_n, v.ttl_mean) == (1, 2, 1, 4, 3, 0.75, 2, 40)
