"""Queries of websites (F90-F102, A13, A14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import half_up
from ..operators import web
from ..sources.listings import listings
from .registry import query


def host_sql(u: str) -> str:
    full = f"(CASE WHEN regexp_matches(trim({u}), '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN trim({u}) ELSE 'http://' || trim({u}) END)"
    name = f"regexp_replace(regexp_replace(lower(regexp_extract({full}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', ''), '\\.$', '')"
    return f"(CASE WHEN regexp_matches({name}, '^[a-z0-9.-]+$') AND contains({name}, '.') THEN {name} END)"


@query(f"SELECT k, {host_sql('u')} AS host, CASE WHEN {host_sql('u')} IS NOT NULL THEN 'info@' || {host_sql('u')} END AS email, CASE WHEN {host_sql('u')} IS NOT NULL THEN 10 ELSE 0 END AS n FROM (SELECT k, CASE k % 5 WHEN 0 THEN 'localhost' WHEN 1 THEN ' WWW.Foo' || CAST(k AS VARCHAR) || '.ORG./x' ELSE website END AS u FROM L )")
def email_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hosts and role addresses."""
    k = F.col("k")
    url = F.when(k % 5 == 0, "localhost").when(k % 5 == 1, F.concat(F.lit(" WWW.Foo"), k.cast("string"), F.lit(".ORG./x"))).otherwise(F.col("website"))
    d = listings(spark, sf_dir).select("k", web.host(url).alias("host"), web.candidates(url).alias("all"))
    return d.select("k", "host", F.get("all", F.lit(0)).alias("email"), F.size("all").alias("n"))


@query(f"SELECT count(*)::BIGINT AS total, count({host_sql('website')})::BIGINT AS with_email, count(*) FILTER (WHERE {host_sql('website')} IS NOT NULL)::BIGINT AS unverified, (count(*) - count({host_sql('website')}))::BIGINT AS skipped FROM L")
def email_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with an address; none is verified, as nothing is probed."""
    h = web.host(F.col("website"))
    return listings(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count(h).alias("with_email"), F.count(h).alias("unverified"), F.count_if(h.isNull()).alias("skipped"))


_EMAIL = "[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}"


@query(f"""
SELECT doc_id, email, {host_sql("split_part(email, '@', 2)")} AS domain FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{_EMAIL}')) AS email FROM documents)
UNION ALL SELECT -1 - page_id, email, split_part(email, '@', 2) FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(coalesce(html, '') || ' mailto:Sales@shop' || page_id || '.example.com?x=1 A.B@x.example.org'), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}')) AS email FROM pages)
""")
def emails_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addresses in documents, and in pages to which two were added."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(web.emails(F.col("text"))).alias("email"))
    extra = F.concat(F.col("html"), F.lit('<a href="mailto:Sales@shop'), F.col("page_id").cast("string"), F.lit('.example.com?x=1">y</a> A.B@x.example.org'))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select((-1 - F.col("page_id")).alias("doc_id"), F.explode(web.emails(extra)).alias("email"))
    return docs.unionByName(pages).select("doc_id", "email", web.email_domain(F.col("email")).alias("domain"))


_MARKS = [
    '<meta name="generator" content="WordPress 6"><link href="/wp-content/x.css">',
    '<script src="/js/jquery-3.min.js"></script><link href="bootstrap.min.css">',
    '<div data-reactroot id="__NEXT_DATA__"></div><script src="/_next/static/a.js"></script>',
    '<script async src="https://www.googletagmanager.com/gtag/js?id=G-1"></script><script>gtag(1)</script>',
    '<img src="https://cdn.shopify.com/x"><script src="https://www.googletagmanager.com/gtm.js"></script>',
    "",
]
_PAGES_SQL = "V AS (SELECT page_id, url, html || CASE page_id % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MARKS)) + """ END AS html, CASE page_id % 4 WHEN 0 THEN MAP {'server': 'nginx/1.2', 'x-powered-by': 'Next.js'} WHEN 1 THEN MAP {'server': 'cloudflare', 'cf-ray': '1'} WHEN 2 THEN MAP {'server': 'Vercel', 'x-vercel-id': 'z'} ELSE MAP {'server': 'Apache'} END AS headers,
  CASE WHEN page_id % 7 = 0 THEN ['_ga', 'WordPress_x'] WHEN page_id % 7 = 1 THEN ['dwsid'] ELSE [] END AS cookies FROM pages)"""
_TECH_SQL = f"WITH {_PAGES_SQL}, T AS (SELECT page_id, {web.technologies_sql('url', 'html', 'headers', 'cookies')} AS techs FROM V)"


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    pair = lambda *v: F.create_map(*[F.lit(x) for x in v])
    headers = F.when(k % 4 == 0, pair("server", "nginx/1.2", "x-powered-by", "Next.js")).when(k % 4 == 1, pair("server", "cloudflare", "cf-ray", "1")).when(k % 4 == 2, pair("server", "Vercel", "x-vercel-id", "z")).otherwise(pair("server", "Apache"))
    cookies = F.when(k % 7 == 0, F.array(F.lit("_ga"), F.lit("WordPress_x"))).when(k % 7 == 1, F.array(F.lit("dwsid"))).otherwise(F.array().cast("array<string>"))
    html = F.concat("html", F.element_at(F.array(*[F.lit(m) for m in _MARKS]), (k % 6 + 1).cast("int")))
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", html.alias("html"), headers.alias("headers"), cookies.alias("cookies"))
    return d.select("page_id", web.technologies(F.col("url"), F.col("html"), F.col("headers"), F.col("cookies")).alias("techs"))


@query(f"{_TECH_SQL} SELECT page_id, array_to_string(techs, '|') AS technologies, {web.sophistication_sql('techs')}::INT AS sophistication FROM T")
def tech_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F97-F100: technologies of pages, to which marks, headers and cookies were added."""
    return _detected(spark, sf_dir).select("page_id", F.array_join(F.transform("techs", lambda t: t["name"]), "|").alias("technologies"), web.sophistication(F.col("techs")).alias("sophistication"))


@query(f"{_TECH_SQL} SELECT count(*)::BIGINT AS analyzed, floor(avg({web.sophistication_sql('techs')}) * 100 + 0.5) / 100 AS avg_sophistication, count(*) FILTER (WHERE list_has_any(techs, ['WordPress', 'Drupal', 'Wix', 'Squarespace', 'Webflow', 'Joomla', 'Adobe Experience Manager']))::BIGINT AS with_cms FROM T")
def tech_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's mean sophistication and pages with a content system."""
    d = _detected(spark, sf_dir)
    return d.agg(F.count(F.lit(1)).alias("analyzed"), half_up(F.avg(web.sophistication(F.col("techs"))), 2).alias("avg_sophistication"), F.count(web.first_of(F.col("techs"), "cms")).alias("with_cms"))


@query("SELECT k, CASE k % 4 WHEN 0 THEN 'http://a.bc' WHEN 1 THEN 'http://shop/x' WHEN 2 THEN 'http://shop//' ELSE '' END AS url FROM L")
def plain_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F102: trimmed addresses without a closing slash."""
    k = F.col("k") % 4
    return listings(spark, sf_dir).select("k", web.plain_url(F.when(k == 0, " http://a.bc/ ").when(k == 1, "http://shop/x/").when(k == 2, "http://shop//")).alias("url"))
