"""Pages are read into lines once."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.llm.line_dedup import html_lines, site_lines, url_host
from tests.session import session


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_read_into_lines_once_to_count_them():
    spark = session()
    pages = spark.createDataFrame([(f"p{i}", "http://h/", f"<p>menu<p>text {i}") for i in range(4)] + [("x", None, None)], "page_id string, url string, html string")
    common = site_lines(pages, url_host(F.col("url")), html_lines(F.col("html")), 0.1, 2)
    assert plan_of(common.select("common")).count("(?is)") == 1
    assert [(r["site"], r["pages"], len(r["common"] or [])) for r in common.orderBy("site").collect()] == [(None, 1, 0), ("h", 4, 1)]
