"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import html as H
from sluice.functions import locale as L
from sluice.operators import ranking
from sluice.registry import query
from sluice.sources.tables import load

LINKS_SQL = """SELECT page_id, CAST(i AS INTEGER) AS ord, links[i] AS href FROM (
  SELECT page_id, links, unnest(range(1, len(links) + 1)) AS i FROM (
    SELECT page_id, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS links FROM pages))"""


def _links(spark, sf_dir):
    rows = load(spark, sf_dir, "pages").select("page_id", F.posexplode(H.links(F.col("html"))).alias("ord", "href"))
    return rows.withColumn("ord", F.col("ord") + 1)


@query("r01_language_visibility", """SELECT page_id, lang FROM (SELECT page_id, nullif(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1), '') AS lang FROM pages) WHERE lang IS NULL OR lang = 'es'""", "R")
def language_visibility(spark, sf_dir):
    """Pages that show under a root language other than pt: unmarked ones and those in es."""
    rows = load(spark, sf_dir, "pages").select("page_id", H.lang(F.col("html")).alias("lang"))
    return rows.where(H.visible(F.col("lang"), "xx"))


@query("r02_set_language", """SELECT root, count(*) AS n FROM (SELECT nullif(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1), '') AS lang FROM pages), (VALUES ('es'), ('pt'), ('xx')) AS r(root)
WHERE lang IS NULL OR lang = CASE WHEN root = 'pt' THEN 'pt' ELSE 'es' END GROUP BY root""", "R")
def set_language(spark, sf_dir):
    """How many pages show for each choice of root language, given as a parameter of the plan."""
    langs = load(spark, sf_dir, "pages").select(H.lang(F.col("html")).alias("lang"))
    roots = F.explode(F.array(*(F.lit(x) for x in ("es", "pt", "xx"))))
    return langs.withColumn("root", roots).where(H.visible(F.col("lang"), F.col("root"))).groupBy("root").agg(F.count("*").alias("n"))


@query("r03_language_flags", """SELECT page_id, coalesce(lang = 'es', false) AS is_es, coalesce(lang = 'pt', false) AS is_pt FROM (SELECT page_id, nullif(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1), '') AS lang FROM pages)""", "R")
def language_flags(spark, sf_dir):
    """The flag that each language button gets."""
    lang = H.lang(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", lang.eqNullSafe("es").alias("is_es"), lang.eqNullSafe("pt").alias("is_pt"))


@query("r06_lookup_by_id", "SELECT page_id, url FROM pages WHERE page_id = 7", "R")
def lookup_by_id(spark, sf_dir):
    return load(spark, sf_dir, "pages").where("page_id = 7").select("page_id", "url")


@query("r07_first_match", f"SELECT page_id, min_by(href, ord) AS href FROM ({LINKS_SQL}) WHERE length(href) > 4 GROUP BY page_id", "R")
def first_match(spark, sf_dir):
    """The first link of each page that matches, in document order."""
    return _links(spark, sf_dir).where(F.length("href") > 4).groupBy("page_id").agg(F.min_by("href", "ord").alias("href"))


@query("r08_all_matches", LINKS_SQL, "R")
def all_matches(spark, sf_dir):
    """Every link of every page with its place."""
    return _links(spark, sf_dir)


@query("r11_presence_guard", """SELECT page_id FROM pages WHERE html LIKE '%<nav>%' AND regexp_extract(html, '<a[^>]*href="([^"]*)"', 1) <> ''""", "R")
def presence_guard(spark, sf_dir):
    """Pages that have both a menu and links."""
    nav = F.nullif(F.regexp_extract("html", "(<nav>)", 1), F.lit(""))
    link = F.get(H.links(F.col("html")), F.lit(0))
    return load(spark, sf_dir, "pages").where(nav.isNotNull() & link.isNotNull()).select("page_id")


@query("r12_responsive", "SELECT doc_id, CASE WHEN n_chars <= 768 THEN 'narrow' ELSE 'wide' END AS layout FROM documents", "R")
def responsive(spark, sf_dir):
    """Which of two sets of rules holds for a width."""
    return load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") <= 768, "narrow").otherwise("wide").alias("layout"))


@query("r13_nth_child", f"SELECT page_id, ord, href FROM ({LINKS_SQL}) WHERE ord = 3", "R")
def nth_child(spark, sf_dir):
    """The third link of each page."""
    return ranking.nth(_links(spark, sf_dir), "page_id", "ord", 3)


@query("r14_variables", "SELECT doc_id, value FROM documents JOIN (VALUES ('en', '#112233'), ('fr', '#445566'), ('de', '#778899'), ('es', '#aabbcc')) AS v(name, value) ON lang = name", "R")
def variables(spark, sf_dir):
    """Named constants used by reference: a map literal, no join at all."""
    pairs = {"en": "#112233", "fr": "#445566", "de": "#778899", "es": "#aabbcc"}
    names = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return load(spark, sf_dir, "documents").select("doc_id", names[F.col("lang")].alias("value")).where("value IS NOT NULL")


@query("r15_cascade", """SELECT p_brand, p_size, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) AS rn FROM part) WHERE rn = 1""", "R")
def cascade(spark, sf_dir):
    """The winning rule of each element: most specific (size stands in), then latest (key)."""
    return ranking.cascade(load(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", "p_name"), "p_brand", "p_size", "p_partkey")


@query("r16_static_table", """SELECT p_partkey, CAST(floor(p_retailprice) * p_size AS DECIMAL(10,2)) AS price_lo, CAST(floor(p_retailprice) * p_size + 1250 AS DECIMAL(10,2)) AS price_hi, CAST(p_size / 10.0 AS DECIMAL(10,2)) AS dose,
CAST(CASE WHEN p_size % 3 = 0 THEN 35 ELSE p_size END AS DECIMAL(10,2)) AS saving_lo, CAST(CASE WHEN p_size % 3 = 0 THEN 35 ELSE p_size + 10 END AS DECIMAL(10,2)) AS saving_hi, p_size % 3 = 0 AS approximate FROM part""", "R")
def static_table(spark, sf_dir):
    """A table of costs as pages print it, read back as numbers: decimal commas, thousands dots, two kinds of dash and a tilde."""
    size, whole = F.col("p_size"), F.floor("p_retailprice") * F.col("p_size")
    dots = lambda c: F.translate(F.format_number(c, 0), ",", ".")
    printed = load(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("R$ "), dots(whole), F.when(size % 2 == 0, "-").otherwise("–"), dots(whole + 1250)).alias("price"),
        F.translate(F.format_number(size / 10, 1), ".", ",").alias("dose"),
        F.when(size % 3 == 0, "~35%").otherwise(F.concat(size.cast("string"), F.lit("–"), (size + 10).cast("string"), F.lit("%"))).alias("saving"))
    price, saving = L.span(F.col("price")), L.span(F.col("saving"))
    return printed.select("p_partkey", price["lo"].alias("price_lo"), price["hi"].alias("price_hi"), L.number(F.col("dose")).alias("dose"), saving["lo"].alias("saving_lo"), saving["hi"].alias("saving_hi"), saving["approx"].alias("approximate"))


@query("r17_static_list", """SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, tags[i] AS tag FROM (SELECT page_id, tags, unnest(range(1, len(tags) + 1)) AS i FROM (
SELECT page_id, CASE regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) WHEN 'es' THEN ['suelo', 'hoja', 'agua', 'zona', 'mapa', 'dosis'] WHEN 'pt' THEN ['solo', 'folha', 'água', 'zona', 'mapa', 'dose'] ELSE ['soil', 'leaf', 'water', 'zone', 'map', 'dose'] END AS tags FROM pages))""", "R")
def static_list(spark, sf_dir):
    """Each page's list of tags, of its language, in order."""
    words = {"es": "suelo hoja agua zona mapa dosis", "pt": "solo folha água zona mapa dose", "en": "soil leaf water zone map dose"}
    lists = {k: F.array(*(F.lit(x) for x in v.split())) for k, v in words.items()}
    lang = H.lang(F.col("html"))
    tags = F.when(lang == "es", lists["es"]).when(lang == "pt", lists["pt"]).otherwise(lists["en"])
    return load(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("ord", "tag"))


@query("r18_link_template", "SELECT c_custkey, 'https://m.example.com/send?text=' || replace(replace(url_encode(c_name || ' & ' || c_mktsegment), '%20', '+'), '%2A', '*') AS link, c_name || ' & ' || c_mktsegment AS message FROM customer", "R")
def link_template(spark, sf_dir):
    """A fixed base with an encoded text, and the text read back from it."""
    text = F.concat("c_name", F.lit(" & "), "c_mktsegment")
    rows = load(spark, sf_dir, "customer").select("c_custkey", H.message_link("https://m.example.com/send?text=", text).alias("link"))
    return rows.withColumn("message", H.message_of(F.col("link")))


@query("r19_unresolved_links", f"SELECT DISTINCT href FROM ({LINKS_SQL}) WHERE href NOT IN (SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) FROM pages)", "R")
def unresolved_links(spark, sf_dir):
    """Link targets that are no page's path."""
    known = load(spark, sf_dir, "pages").select(H.path(F.col("url")).alias("href"))
    return _links(spark, sf_dir).select("href").distinct().join(known, "href", "left_anti")


@query("page_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages", "R")
def page_title(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query("page_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""", "R")
def page_text(spark, sf_dir):
    """What a page shows, without scripts, styles, comments and tags."""
    return load(spark, sf_dir, "pages").select("page_id", H.visible_text(F.col("html")).alias("text"))


@query("page_boilerplate", f"SELECT href, count(DISTINCT page_id) AS pages FROM ({LINKS_SQL}) GROUP BY href HAVING count(DISTINCT page_id) > 1", "R")
def page_boilerplate(spark, sf_dir):
    """Links that more than one page has."""
    return _links(spark, sf_dir).groupBy("href").agg(F.countDistinct("page_id").alias("pages")).where("pages > 1")
