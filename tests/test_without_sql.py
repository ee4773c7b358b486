"""Queries that SQL can't check: samples, sketches, and Spark's own hashes."""

import zlib
from collections import Counter

import xxhash

import sluice.plans  # noqa: F401
from sluice.registry import ENTRIES

DATA = "/root/testdata/sf0.01"


def rows(spark, name):
    return ENTRIES[name].run(spark, DATA).collect()


def test_samples_are_steady_parts_of_about_the_size(spark):
    orders = {r.o_orderkey: r.o_orderstatus for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_orderstatus").collect()}
    got = rows(spark, "sample_bernoulli")
    assert got == rows(spark, "sample_bernoulli")
    keys = [r.o_orderkey for r in got]
    assert len(set(keys)) == len(keys) and set(keys) <= orders.keys()
    assert abs(len(keys) - 0.1 * len(orders)) < 6 * (0.09 * len(orders)) ** 0.5
    strata = rows(spark, "sample_stratified")
    assert all(orders[r.o_orderkey] == r.o_orderstatus for r in strata)
    have, took = Counter(orders.values()), Counter(r.o_orderstatus for r in strata)
    for kind, share in (("F", 0.2), ("O", 0.1), ("P", 0.5)):
        assert abs(took[kind] - share * have[kind]) < 6 * (share * (1 - share) * have[kind]) ** 0.5 + 1


def test_sketches_are_near_the_exact_figures(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_returnflag", "l_partkey", "l_extendedprice").collect()
    for r in rows(spark, "agg_sketches"):
        own = [x for x in lines if x.l_returnflag == r.l_returnflag]
        distinct = len({x.l_partkey for x in own})
        for found in (r.hll, r.hll_sketch, r.theta):
            assert abs(found - distinct) < 0.1 * distinct
        prices = sorted(x.l_extendedprice for x in own)
        assert abs(sum(p <= r.median for p in prices) / len(prices) - 0.5) < 0.01 and r.cms_bytes > 0


def test_merged_quantile_sketches_are_near_the_exact_figures(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_returnflag", "l_extendedprice").collect()
    for r in rows(spark, "agg_quantile_sketch"):
        prices = [x.l_extendedprice for x in lines if x.l_returnflag == r.l_returnflag]
        assert r.n == len(prices)
        for found, share in ((r.median, 0.5), (r.p90, 0.9)):
            assert abs(sum(p <= found for p in prices) / len(prices) - share) < 0.03


def soundex(word):
    """The American code as Spark gives it."""
    codes = {c: d for d, own in {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}.items() for c in own}
    out, last = word[0].upper(), codes.get(word[0].upper(), "0")
    for c in word[1:].upper():
        if not "A" <= c <= "Z":
            last = "0"
            continue
        if c in "HW":
            continue
        d = codes.get(c, "0")
        if d != "0" and d != last:
            out += d
        last = d
        if len(out) == 4:
            break
    return out.ljust(4, "0")


def test_hashes_and_codes_equal_other_libraries(spark):
    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", "p_name").collect()}
    for r in rows(spark, "strings_spark"):
        raw = names[r.p_partkey].encode()
        assert r.crc == zlib.crc32(raw) and r.hash % (1 << 64) == xxhash.xxh64_intdigest(raw, 42)
        assert r.title == " ".join(w.capitalize() for w in names[r.p_partkey].split(" ")) and r.sound == soundex(names[r.p_partkey])
