"""Scalar functions, by type."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.registry import query
from sluice.sources.tables import load


@query("strings", """SELECT p_partkey, upper(p_name) AS up, p_brand || '/' || p_type AS joined, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, split_part(p_name, ' ', 2) AS second, replace(p_name, 'e', '3') AS leet,
levenshtein(p_name, p_type) AS dist, substring(p_name, 2, 3) AS sub, reverse(p_name) AS rev, position('i' IN p_name) AS pos, sha256(p_name) AS sha, md5(p_brand) AS md5, regexp_extract(p_brand, '([0-9]+)', 1) AS num, trim('  ' || p_type || ' ') AS trimmed, starts_with(p_name, 'red') AS red FROM part""")
def strings(spark, sf_dir):
    n = F.col("p_name")
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.concat_ws("/", "p_brand", "p_type").alias("joined"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.split_part(n, F.lit(" "), F.lit(2)).alias("second"),
        F.replace(n, F.lit("e"), F.lit("3")).alias("leet"), F.levenshtein(n, F.col("p_type")).cast("long").alias("dist"), F.substring(n, 2, 3).alias("sub"), F.reverse(n).alias("rev"), F.position(F.lit("i"), n).cast("long").alias("pos"),
        F.sha2(n, 256).alias("sha"), F.md5("p_brand").alias("md5"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("num"), F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("trimmed"), F.startswith(n, F.lit("red")).alias("red"))


@query("strings_title", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: concat(upper(x[1]), lower(x[2:]))), ' ') AS title FROM part")
def strings_title(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.initcap("p_name").alias("title"))


@query("intervals", """SELECT o_orderkey, date_diff('month', DATE '1995-01-01', date_trunc('month', CAST(o_orderdate AS DATE))) AS months, o_orderdate + INTERVAL 1 DAY + INTERVAL 2 HOUR AS due, CAST(round(o_totalprice / 1000) * 1000 AS BIGINT) AS about,
CAST(CASE WHEN (o_orderkey + 5) % 20 = 10 THEN (floor((o_orderkey + 5) / 20) + floor((o_orderkey + 5) / 20) % 2) * 20 ELSE floor((o_orderkey + 15) / 20) * 20 END AS BIGINT) AS even FROM orders""")
def intervals(spark, sf_dir):
    """Months between dates, intervals made from numbers, and rounding to twenties, half to even."""
    due = F.col("o_orderdate") + F.make_dt_interval(F.lit(1), F.lit(2))
    even = F.bround((F.col("o_orderkey") + 5) / 20, 0) * 20
    months = F.months_between(F.date_trunc("month", "o_orderdate"), F.lit("1995-01-01").cast("timestamp"))
    return load(spark, sf_dir, "orders").select("o_orderkey", months.cast("long").alias("months"), due.alias("due"), (F.round(F.col("o_totalprice") / 1000) * 1000).cast("long").alias("about"), even.cast("long").alias("even"))


@query("strings_spark")
def strings_spark(spark, sf_dir):
    """String functions that DuckDB lacks or defines otherwise."""
    n = F.col("p_name")
    return load(spark, sf_dir, "part").select("p_partkey", F.initcap(n).alias("title"), F.soundex(n).alias("sound"), F.xxhash64(n).alias("hash"), F.crc32(n.cast("binary")).alias("crc"))


@query("dates", """SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, dayofyear(o_orderdate) AS doy, CAST(date_trunc('month', o_orderdate) AS DATE) AS mon, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days,
CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month, last_day(CAST(o_orderdate AS DATE)) AS last, strftime(o_orderdate, '%Y-%m') AS label FROM orders""")
def dates(spark, sf_dir):
    d = F.col("o_orderdate")
    big = lambda c: c.cast("long")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", big(F.year(d)).alias("y"), big(F.quarter(d)).alias("q"), big(F.month(d)).alias("m"), big(F.dayofyear(d)).alias("doy"), F.trunc(d, "month").alias("mon"), big(F.date_diff(d, F.lit("1995-01-01").cast("date"))).alias("days"),
        F.add_months(d.cast("date"), 1).alias("next_month"), F.last_day(d).alias("last"), F.date_format(d, "yyyy-MM").alias("label"))


@query("hourly_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_counts(spark, sf_dir):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return load(spark, sf_dir, "events").groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("math", """SELECT event_id, round(sqrt(value), 6) AS root, round(ln(value + 1), 6) AS log, floor(value)::BIGINT AS lo, ceil(value)::BIGINT AS hi, abs(value - 10) AS dist, ((event_id - 7) % 5 + 5) % 5 AS pm, sign(value - 10)::DOUBLE AS sgn,
CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_id / (user_id % 3) END AS quotient, least(value, 5.0) AS capped, round(pow(value, 2), 4) AS sq FROM events""")
def math(spark, sf_dir):
    v, e = F.col("value"), F.col("event_id")
    return load(spark, sf_dir, "events").select(
        "event_id", F.round(F.sqrt(v), 6).alias("root"), F.round(F.log(v + 1), 6).alias("log"), F.floor(v).alias("lo"), F.ceil(v).alias("hi"), F.abs(v - 10).alias("dist"), F.pmod(e - 7, F.lit(5)).alias("pm"), F.signum(v - 10).alias("sgn"),
        F.try_divide(e, F.col("user_id") % 3).alias("quotient"), F.least(v, F.lit(5.0)).alias("capped"), F.round(F.pow(v, F.lit(2)), 4).alias("sq"))


@query("math_buckets", "SELECT p_partkey, CAST(floor((p_retailprice - 900) / 110) + 1 AS BIGINT) AS bucket FROM part WHERE p_retailprice >= 900 AND p_retailprice < 2000")
def math_buckets(spark, sf_dir):
    rows = load(spark, sf_dir, "part").where("p_retailprice >= 900 AND p_retailprice < 2000")
    return rows.select("p_partkey", F.width_bucket("p_retailprice", F.lit(900.0), F.lit(2000.0), F.lit(10)).alias("bucket"))


@query("arrays", """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm2, round(list_max(embedding)::DOUBLE, 6) AS top, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive, round(embedding[1]::DOUBLE, 6) AS head FROM embeddings""")
def arrays(spark, sf_dir):
    e = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(e).alias("n"), F.round(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm2"), F.round(F.array_max(e).cast("double"), 6).alias("top"),
        F.size(F.filter(e, lambda x: x > 0)).alias("positive"), F.round(F.element_at(e, 1).cast("double"), 6).alias("head"))


@query("arrays_explode", "SELECT label, i AS pos, round(avg(x), 4) AS mean FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def arrays_explode(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 4).alias("mean"))


@query("arrays_zip_sort", "SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1)))[1] AS least FROM pages")
def arrays_zip_sort(spark, sf_dir):
    hrefs = F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))
    return load(spark, sf_dir, "pages").select("page_id", F.get(F.array_sort(F.array_distinct(hrefs)), F.lit(0)).alias("least"))


@query("maps", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(DISTINCT event_type)::INTEGER AS kinds FROM events GROUP BY 1")
def maps(spark, sf_dir):
    """Counts by type gathered into a map of at most as many keys as there are types, and looked up."""
    per = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    doubled = F.transform_values("m", lambda k, v: v * 2)
    return m.select("user_id", F.coalesce((doubled[F.lit("click")] / 2).cast("long"), F.lit(0)).alias("clicks"), F.size(F.map_keys(F.map_filter("m", lambda k, v: v > 0))).alias("kinds"))


@query("json", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.from_json("props", "k long")["k"].alias("k")).agg(F.count("*").alias("n"))


@query("json_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{\"id\":' || event_id || ',\"t\":\"' || event_type || '\"}' AS out FROM events")
def json_paths(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("t"))).alias("out"))


@query("variants", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def variants(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("xml", "SELECT p_partkey, p_name AS name, CAST(p_size AS INTEGER) AS size FROM part")
def xml(spark, sf_dir):
    """Well-formed XML made of columns, read by schema and by path."""
    doc = F.concat(F.lit("<p><name>"), "p_name", F.lit("</name><size>"), F.col("p_size").cast("string"), F.lit("</size></p>"))
    rows = load(spark, sf_dir, "part").select("p_partkey", doc.alias("doc"))
    return rows.select("p_partkey", F.from_xml("doc", "name string, size int")["name"].alias("name"), F.xpath_int("doc", F.lit("/p/size")).alias("size"))


@query("conditionals", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS class, coalesce(nullif(c_mktsegment, 'BUILDING'), 'other') AS segment, TRY_CAST(substring(c_name, 10) AS INTEGER) AS number, TRY_CAST(c_mktsegment AS INTEGER) AS none FROM customer")
def conditionals(spark, sf_dir):
    b = F.col("c_acctbal")
    return load(spark, sf_dir, "customer").select(
        "c_custkey", F.when(b < 0, "debt").when(b < 5000, "some").otherwise("much").alias("class"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("other")).alias("segment"),
        F.substring("c_name", 10, 20).try_cast("int").alias("number"), F.col("c_mktsegment").try_cast("int").alias("none"))


@query("urls", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def urls(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path"))
