"""Messy inputs derived from the given tables; the SQL text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PRICE = "cast(cast(p_retailprice as decimal(12,2)) as string)"

ITEMS = f"""
select p_partkey as id,
  case when p_partkey%5=0 then concat('  ',p_name,'  ') else p_name end as name,
  case p_partkey%6 when 0 then concat('$',{_PRICE}) when 1 then concat('USD ',replace({_PRICE},'.',','))
    when 2 then concat('1,',{_PRICE}) when 3 then concat('1.',replace({_PRICE},'.',','))
    when 4 then 'call us' else null end as price,
  concat(cast(p_size as string), case p_partkey%4 when 0 then '/10' when 1 then ' out of 5'
    when 2 then '%' else '/100' end) as rating,
  concat(case when p_partkey%2=0 then 'https://' else '' end,'shop',cast(p_partkey%7 as string),
    '.example.com/p ',cast(p_partkey%100 as string)) as link,
  concat('<p>',p_type,'&nbsp;&amp;  ',p_brand,'</p>') as description
from part"""

_Y = "cast(year(o_orderdate) as string)"
_M = "lpad(cast(month(o_orderdate) as string),2,'0')"
_D = "lpad(cast(day(o_orderdate) as string),2,'0')"

DATES = f"""
select o_orderkey as id, case o_orderkey%6
  when 0 then concat({_Y},'-',{_M},'-',{_D}) when 1 then concat({_D},'/',{_M},'/',{_Y})
  when 2 then concat({_M},'/',{_D},'/',{_Y})
  when 3 then concat('posted ',{_Y},'/',{_M},'/',{_D},' ok')
  when 4 then concat({_Y},'-',{_M},'-',{_D},'T10:30:00.5Z')
  else 'yesterday' end as published_date
from orders"""

FEEDBACK = """
select md5(concat('t',cast(user_id%50 as string))) as task_id,
  concat('https://site',cast(user_id%10 as string),'.example.com/x') as url,
  concat('data ',event_type) as data_description,
  case when event_id%11=0 then null else cast(event_id%10+1 as int) end as rating,
  case event_id%5 when 0 then 'Missing data and TIMEOUT' when 1 then 'duplicate rows' when 2 then ''
    when 3 then 'captcha; blocked' else null end as feedback,
  cast(event_id as double) * 1.5 + 1700000000 as timestamp
from events"""

# One task per page: the page's address and its heading as the description.
TASKS = """
select page_id, url, regexp_extract(html, '<h1>(.*?)</h1>', 1) as data_description,
  md5(concat(url, '_', regexp_extract(html, '<h1>(.*?)</h1>', 1))) as task_id
from pages"""

# Requests for other addresses on the same host, worded like the stored task but
# without its last word, or twice over, or with another first word.
REQUESTS = f"""
select page_id as request_id, concat(url, '/more') as url,
  case page_id%4 when 0 then data_description
    when 1 then regexp_replace(data_description, ' [^ ]*$', '')
    when 2 then concat(data_description, ' ', data_description)
    else concat('other ', data_description, ' words') end as data_description
from ({TASKS}) t"""

# One host whose descriptions follow a template; a request has a number of its own,
# or the stored one, one word more, or half the words.
HOT_STORED = """
select p_partkey, md5(cast(p_partkey as string)) as task_id, 'https://one.example.com/list' as url,
  concat('name price and full size of the item number ', cast(p_partkey as string), ' sold in the shop') as data_description
from part"""
HOT_REQUESTS = """
select p_partkey as request_id, 'https://one.example.com/more' as url,
  case p_partkey%5 when 0 then concat('name price and full size of the item number ', cast(p_partkey as string), ' sold in the shop today')
    when 1 then concat('name price and full size of the item number r', cast(p_partkey as string), ' sold in the shop')
    when 2 then concat('price of item number ', cast(p_partkey as string), ' r', cast(p_partkey as string))
    when 3 then concat('price r', cast(p_partkey as string), ' and colour with all other things')
    else concat('name price and full size of the item number ', cast(p_partkey as string), ' r', cast(p_partkey as string), ' shop') end as data_description
from part"""

LINKS = """
select page_id, case page_id%4
  when 0 then concat(url, case when url like '%?%' then '&' else '?' end, 'q=a%26b%3Dc&a=1&b=&a=3&flag')
  when 1 then concat(url, case when url like '%?%' then '&' else '?' end, 'x=a+b~*(c)/d&x=%C3%A9')
  when 2 then concat(' ', url)
  else url end as url
from pages"""


def sql(spark: SparkSession, sf: str, text: str, *tables: str) -> DataFrame:
    """Run ``text`` in Spark over the named tables of a scale-factor folder."""
    for name in tables:
        text = _named(text, name)
    frames = {name: table(spark, sf, name) for name in tables}
    return spark.sql(text, **frames)


def _named(text: str, name: str) -> str:
    return text.replace(f"from {name}", f"from {{{name}}}")


def spread(scan: DataFrame) -> DataFrame:
    """The small test tables have one split each; deal their rows to all cores."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark, sf) -> DataFrame:
    return sql(spark, sf, ITEMS, "part")


def dates(spark, sf) -> DataFrame:
    return sql(spark, sf, DATES, "orders")


def feedback(spark, sf) -> DataFrame:
    return sql(spark, sf, FEEDBACK, "events")


def tasks(spark, sf) -> DataFrame:
    return sql(spark, sf, TASKS, "pages")


def requests(spark, sf) -> DataFrame:
    return sql(spark, sf, REQUESTS, "pages")


def hot_stored(spark, sf) -> DataFrame:
    return sql(spark, sf, HOT_STORED, "part")


def hot_requests(spark, sf) -> DataFrame:
    return sql(spark, sf, HOT_REQUESTS, "part")


def links(spark, sf) -> DataFrame:
    return sql(spark, sf, LINKS, "pages")
