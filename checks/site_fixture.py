"""Sites derived from the given ``pages`` table; the same SQL text runs in Spark and DuckDB.

The raw pages have no media, no stylesheets and no links to one another.  Each raw page becomes one
page and one stylesheet of a site.  Page n belongs to the large site ``hub`` if n % 3 = 0 (a third of
all pages), else to one of 25 small ones; it links to the children 2m+1 and 2m+2 of its place m in
the site, so the graph is as deep as the logarithm of the site and grows with the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from webloom.functions.binding import pin


def site(n: str) -> str:
    return f"CASE WHEN {n} % 3 = 0 THEN 'hub.example.org' ELSE concat('site', {n} % 25, '.example.net') END"


def url(n: str) -> str:
    return f"""concat('https://', {site(n)}, '/p', {n}, CASE {n} % 6 WHEN 0 THEN '.html' WHEN 1 THEN '/'
        WHEN 2 THEN '?page=2&ref=x/y' WHEN 3 THEN '' WHEN 4 THEN '/a/b.htm' ELSE '.php?id=1' END)"""


PAGES = f"""
SELECT page_id, {url('page_id')} AS url, {site('page_id')} AS target_domain,
  CASE WHEN page_id % 17 = 0 THEN replace(replace(body, '<head>', ''), '</head>', '')
       WHEN page_id % 19 = 0 THEN replace(replace(body, '<body>', concat('<body> ', page_id % 10, ' <template>')), '</body>', '</template></body>')
       WHEN page_id % 31 = 0 THEN replace(body, '</head>', '')
       WHEN page_id % 23 = 0 THEN concat(body, chr(127))
       WHEN page_id % 29 = 0 THEN replace(replace(body, '<body>', ''), '</body>', '')
       ELSE body END AS html
FROM (
  SELECT page_id, replace(replace(html, '</head>', concat(
    '<link rel="preconnect" href="https://fonts.example.org">',
    '<link rel="stylesheet" crossorigin="anonymous" integrity="sha384-x" href="https://cdn', page_id % 5,
    '.example.net/s/site', page_id % 11, '.css?v=', page_id, '">',
    '<LINK REL="stylesheet" HREF=''/s/', page_id, '.css''>',
    CASE WHEN page_id % 3 = 0 THEN '<script>var _paq=[];_paq.push(["trackPageView"]);</script>' ELSE '' END,
    CASE WHEN page_id % 5 = 1 THEN '<script>var q=[];q.push(["trackPageView"]);start();</script>' ELSE '' END,
    CASE WHEN page_id % 4 = 0 THEN '<link rel="alternate" type="application/rss+xml" href="/feed.rss">' ELSE '' END,
    CASE WHEN page_id % 4 = 1 THEN '<link rel="stylesheet" href="https://wiki.example.org/w/load.php?m=x">' ELSE '' END,
    CASE WHEN page_id % 7 = 2 THEN '<script async src="https://www.google-analytics.com/ga.js"></script>' ELSE '' END,
    CASE WHEN page_id % 7 = 3 THEN '<script>setup();ga("create", "UA-1", "auto");</script>' ELSE '' END,
    '</head>')), '</body>', concat(
    '<img src="https://img.example.org/p/', page_id % 40, '.PNG"><img data-src="/img/l', page_id % 7, '.jpg">',
    CASE WHEN page_id % 6 = 3 THEN '<noscript><img alt=x src="https://matomo.example.org/m.php?a=1"></noscript>' ELSE '' END,
    CASE WHEN page_id % 6 = 4 THEN '<noscript><p>on</p></noscript>' ELSE '' END,
    CASE WHEN page_id % 8 = 5 THEN concat('<script>document.write(''<a href="search.php">x</a>'');go()</script>',
      '<!-- <a href="ucp.php">c</a><noscript><img src="https://matomo.example.org/c.php"></noscript> -->',
      '<textarea><noscript><img src="https://matomo.example.org/t.php"></noscript><a href="mcp.php">t</a></textarea>') ELSE '' END,
    CASE WHEN page_id % 9 = 4 THEN concat('<noscript><link rel="stylesheet" href="https://use.fontawesome.com/a.css">',
      '<img src="https://matomo.example.org/n.php"></noscript>') ELSE '' END,
    '<a href="', replace({url('left_id')}, '&', '&amp;'), '">next</a>',
    '<a class=n href="', replace({url('right_id')}, '&', '&amp;'), '#c">skip</a>',
    '<a href="/w/index.php?title=Special:Log&amp;action=edit">edit</a><a href="../up/./x">up</a>',
    '<a href="mailto:a@b.c">m</a><a href="http://analytics.example.org/x">o</a>',
    '<a href="search.php?q=1"><b>s</b></a></body>')) AS body
  FROM (
    SELECT page_id, html, page_id % step + step * (2 * place + 1) AS left_id,
           page_id % step + step * (2 * place + 2) AS right_id
    FROM (SELECT page_id, html, CASE WHEN page_id % 3 = 0 THEN 3 ELSE 75 END AS step,
            CAST(floor(page_id / CASE WHEN page_id % 3 = 0 THEN 3 ELSE 75 END) AS BIGINT) AS place
          FROM pages) numbered) linked) built
"""

SHEETS = f"""
SELECT {site('page_id')} AS target_domain, concat('s/', page_id, '.css') AS path,
  concat('https://', {site('page_id')}, '/s/', page_id, '.css') AS url,
  concat(
    CASE WHEN page_id % 5 = 0 THEN '@import url("https://fonts.googleapis.com/css?family=X");' ELSE '' END,
    CASE WHEN page_id % 7 = 0 THEN '@import "https://other.example.com/x.css";' ELSE '' END,
    CASE WHEN page_id % 6 = 1 THEN '@import ''gone.css'';' ELSE '' END,
    CASE WHEN page_id % 10 = 3 THEN '@import "../../s/0.css";' ELSE '' END,
    CASE WHEN page_id % 12 = 5 THEN concat('h5{{content:"', chr(1), '"}}') ELSE '' END,
    CASE WHEN page_id % 18 = 9 THEN concat('@import "', page_id, '.css";') ELSE '' END,
    CASE WHEN page_id % 3 = 0 AND page_id % 48 < 45 THEN concat('@import "./', page_id + 3, '.css";')
         WHEN page_id % 3 <> 0 THEN concat('@import url( "', page_id % 75 + 75 * (2 * CAST(floor(page_id / 75) AS BIGINT) + 1), '.css" );')
         ELSE '' END,
    regexp_extract(html, '<style>([^<]*)</style>', 1),
    ' h1{{background:url(https://img.example.org/p/', page_id % 40, '.PNG?x=1)}}',
    'h2{{background:url(''/img/l', page_id % 7, '.jpg'')}}',
    'h3{{background:url( "https://img.example.org/q/', page_id % 13, '.gif" )}}',
    CASE WHEN page_id % 4 = 0 THEN 'h4{{background:url(/bg/x.svg)}}' ELSE '' END) AS css
FROM pages
""".replace("{{", "{").replace("}}", "}")


# Rules of the sites, 48 for each page: texts in the host and expressions over the URL.
RULES = f"""
SELECT target_domain, CAST(page_id * 48 + r AS INT) AS rule,
  CASE WHEN r % 4 = 1 THEN 'pattern' ELSE 'host' END AS kind,
  CASE WHEN r % 12 = 1 THEN concat('/p', page_id, '[.]html$')
       WHEN r % 12 = 5 THEN concat('/p', page_id + r, '[?]page=[0-9]+&ref')
       WHEN r % 12 = 9 THEN concat('/(p', page_id, '|q', r, ')/a/')
       ELSE concat('x', page_id, '-', r, '.example') END AS text
FROM (SELECT page_id, {site('page_id')} AS target_domain, {{each}} AS r FROM pages) numbered
"""


# A link of each page with two numbers, and rules whose ranges have a million and a thousand values.
NUMBERED = f"""
SELECT page_id, target_domain, f, p, concat('https://', target_domain, '/v?f=', f, '&p=', p, '&x') AS url
FROM (SELECT page_id, {site('page_id')} AS target_domain, page_id * 48271 % 2000003 AS f, page_id * 7 % 1501 AS p
      FROM pages) numbered
"""
WIDE_RULES = """SELECT DISTINCT target_domain, 7 AS rule, 'pattern' AS kind, 'f={1..1000000%48271,77}&p={0..999}&' AS text
FROM ({numbered}) links UNION ALL
SELECT DISTINCT target_domain, 9, 'pattern', 'f={1500000..1100000..-1}&p={990..1500..2}&' FROM ({numbered}) links
""".replace("{numbered}", NUMBERED)


# Pages with nested elements: page n opens n % 4 and n % 3 of them and closes more, as many or fewer.
NESTED = """
SELECT page_id, concat('<p>', page_id, '</p>', repeat('<noscript>', CAST(page_id % 4 AS INT)), '<i>x</i>',
  repeat('<NOSCRIPT class=a>', CAST(page_id % 3 AS INT)),
  CASE page_id % 5 WHEN 0 THEN '<img src="https://matomo.example.org/a.png">' WHEN 1 THEN '<img src="/b.png">'
    WHEN 2 THEN '<!-- <noscript> <img src="//matomo.example.org/x"> -->'
    WHEN 3 THEN '<textarea></noscript><img src="//matomo.example.org/y"></textarea>' ELSE 'text' END,
  repeat('</noscript>', CAST(page_id % 3 AS INT)), '<b>y</b>',
  CASE page_id % 7 WHEN 3 THEN '<img alt=a src="//doubleclick.example.org/i">' ELSE '' END,
  repeat('</noscript >', CAST(page_id % 4 + page_id % 11 % 3 - 1 AS INT)), html) AS html
FROM pages
"""


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _from_pages(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return built(derived(spark, raw_pages(spark, sf_dir), text))


def derived(spark: SparkSession, pages: DataFrame, text: str) -> DataFrame:
    """The SQL over these pages; their view has a name of its own."""
    view = f"pages_{uuid.uuid4().hex}"
    pages.createOrReplaceTempView(view)
    return spark.sql(text.replace("FROM pages", f"FROM {view}"))


def built(site: DataFrame) -> DataFrame:
    """Keep the long expressions of the derived texts out of the plans of the queries."""
    return pin(site, **{c: site[c] for c in site.columns})


def site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_pages(spark, sf_dir, RULES.replace("{each}", "explode(sequence(0, 47))"))


def numbered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_pages(spark, sf_dir, NUMBERED)


def wide_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_pages(spark, sf_dir, WIDE_RULES)


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_pages(spark, sf_dir, PAGES)


def site_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_pages(spark, sf_dir, SHEETS)
