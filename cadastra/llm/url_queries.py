"""Registered query on the URLs of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadastra.llm.core import query, table
from cadastra.llm.url_filter import judge_urls, rule_table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

SQL = rf"""
with rules(rhost, rpath, rverdict) as (values {_RULES_SQL}),
rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
parts as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path
  from rest),
fits as (
  select page_id, host, path, rhost || rpath as rule, rverdict,
         row_number() over (partition by page_id order by length(rhost || rpath) desc) as n
  from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select p.page_id, p.host, p.path, f.rule, coalesce(f.rverdict, 'allow') as verdict
from parts p left join fits f on p.page_id = f.page_id and f.n = 1
"""


@query("op4_url_filter", SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and the verdict of every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))
