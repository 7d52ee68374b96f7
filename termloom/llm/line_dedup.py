"""Boilerplate lines by how many pages of their site hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import fresh, join_groups
from termloom.plans.staging import write_stage

# A line is dropped if more than this part of its site's pages hold it; a line of one page is no repetition.
MAX_RATIO = 0.1
MIN_PAGES = 2
BLANK = " \t\n\x0b\f\r"


def _through(begin: str, mark: str, rest: str) -> str:
    """Pattern from ``begin`` through the first ``mark`` that ``rest`` follows, or through the end of the page."""
    return rf"{begin}[^{mark}]*+(?:{mark}(?!{rest})[^{mark}]*+)*+(?:{mark}{rest}|\z)"


# What is open at the end of a page reaches to it, as in a browser, so that each is looked for once.
HIDDEN = "(?is)<(?:{}|{}|{})".format(
    _through(r"script\b", "<", r"/script\s*>"), _through(r"style\b", "<", r"/style\s*>"), _through("!--", "-", "->")
)
INLINE = r"(?i)</?(?:a|b|i|u|em|strong|span|small|sup|sub|code)(?:>|\s[^>]*(?:>|\z))"
# A tag begins with a letter, a slash or a mark; any other angle bracket is text.
TAG = r"<[A-Za-z/!?][^>]*(?:>|\z)|\n"


def url_host(url: Column) -> Column:
    """Host of a URL in lower case; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def html_lines(html: Column) -> Column:
    """Visible lines of a page: scripts, styles and comments go, inline tags vanish, others end a line.

    A script, style, comment or tag that the page does not close reaches to its end.
    """
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    return F.filter(F.split(F.regexp_replace(text, INLINE, ""), TAG, -1), _has_word)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _code(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANK)))


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK)) != ""


def site_lines(
    pages: DataFrame, site: Column, lines: Column, max_ratio: float, min_pages: int, once: Column | None = None
) -> DataFrame:
    """(site, pages, common): page total and codes of the common lines of every site.

    A page counts once for a line that it repeats. With ``once``, the pages of a site that are equal in
    it are one page, in the total as well. A site has at most (mean lines of a page) /
    ``max_ratio`` common lines, so the array is small however large the site. All counts are
    combined in the tasks before they are shuffled, so a large site is many small partial sums.
    """
    codes = F.array_distinct(F.transform(F.filter(lines, _has_word), _code))
    held = pages.select(site.alias("site"), codes.alias("codes"))
    if once is not None:
        single = pages.select(site.alias("site"), once.alias("once"), codes.alias("codes")).groupBy("site", "once")
        held = write_stage(single.agg(F.first("codes").alias("codes")).drop("once"), "texts")
    totals = write_stage(held.groupBy("site").agg(F.count("*").alias("pages")), "sites")
    # Spark tests the number of codes below a plain explode, and reads every page into lines once more for it.
    codes_held = held.select("site", F.explode_outer("codes").alias("code")).filter(F.col("code").isNotNull())
    counts = codes_held.groupBy("site", "code").count()
    frequent = counts.filter(F.col("count") >= min_pages)
    # Only common lines meet in one row of their site; rare ones are filtered before.
    common = join_groups(frequent, totals, ["site"]).filter(F.col("count") > max_ratio * F.col("pages"))
    lists = common.groupBy("site").agg(F.collect_list("code").alias("common")).alias("c")
    t = totals.alias("t")
    return t.join(lists, F.col("c.site").eqNullSafe(F.col("t.site")), "left").select("t.site", "t.pages", "c.common")


def drop_common_lines(
    pages: DataFrame,
    site: Column,
    lines: Column,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    once: Column | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """``pages`` with the lines that are left, and the names of the added columns by meaning.

    Lines are compared without white space around them, by 64-bit hash; blank lines stay. Null sites
    are one site; sites with fewer than ``min_pages`` pages lose nothing; repeated rows are pages of
    their own; a null text has no lines; an empty table gives no rows.
    """
    names = ("site", "pages", "common", "lines", "kept_lines")
    at = dict(zip(names, fresh(pages, *(f"line_{n}" for n in names))))
    common = site_lines(pages, site, lines, max_ratio, min_pages, once)
    staged = pages.withColumns({at["site"]: site, at["lines"]: lines})
    joined = join_groups(
        staged, common.withColumnsRenamed({n: at[n] for n in ("site", "pages", "common")}), [at["site"]]
    )
    bad = F.coalesce(F.col(at["common"]), F.array().cast("array<bigint>"))
    left = F.filter(at["lines"], lambda x: ~(_has_word(x) & F.array_contains(bad, _code(x))))
    return joined.withColumn(at["kept_lines"], F.when(F.size(bad) == 0, F.col(at["lines"])).otherwise(left)), at


def page_report(pages: DataFrame) -> DataFrame:
    """page_id, host, host_pages, n_lines, n_kept and the MD5 of the text left, for every web page.

    A null or empty page has no lines; pages without a host are those of one site; repeated rows are pages of
    their own; an empty table gives no rows.
    """
    done, at = drop_common_lines(pages, url_host(F.col("url")), html_lines(F.col("html")))
    return done.select(
        "page_id",
        F.col(at["site"]).alias("host"),
        F.col(at["pages"]).alias("host_pages"),
        F.size(at["lines"]).cast("long").alias("n_lines"),
        F.size(at["kept_lines"]).cast("long").alias("n_kept"),
        F.md5(F.concat_ws("\n", at["kept_lines"])).alias("kept_md5"),
    )


def drop_lines_of_documents(docs: DataFrame, text_column: str = "text", site_column: str = "source") -> DataFrame:
    """``docs`` without the common lines of their source; null texts stay null, no row is dropped.

    A line counts once for every different text of the source, so a group of copies does not make its
    own lines common; one copy of it is left to the stage that removes near copies.
    """
    text = F.col(text_column)
    once = F.md5(F.coalesce(text, F.lit("")))
    done, at = drop_common_lines(docs, F.col(site_column), text_lines(text), once=once)
    left = F.when(text.isNotNull(), F.concat_ws("\n", at["kept_lines"]))
    return done.withColumn(text_column, left).select(*docs.columns)
