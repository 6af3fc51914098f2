"""Line dedup by site-relative frequency, in DataFrame operations only.

For each site, the share of its pages that contain a line is the number of pages with that line over the number of all
pages of the site. Lines whose share exceeds a boilerplate ratio are dropped.

Lines are what \\n separates, compared without white space at their ends; blank lines are kept and never counted. A page
counts a line once, however often it has it. Null text stays null and has no lines. Pages with a null site form one
site. Repeated rows are pages of their own. All columns of the input come back, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, shielded

RATIO, MIN_PAGES = 0.05, 5
#: White space that Java's and other engines' trim agree on.
BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANK)))


def boilerplate_lines(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(dg_site, dg_line, dg_pages, dg_total): keys of the lines that stand on more than ratio of their site's pages, and on min_pages at least.

    Only 8-byte keys of lines are dealt out, summed by task first, so that one site or one line with a third of all rows
    makes one row a task.
    """
    keys = F.array_distinct(F.transform(F.filter(lines_of(F.col("dg_text")), lambda x: F.btrim(x, F.lit(BLANK)) != ""), line_key))
    own = docs.select(F.xxhash64(F.col(site)).alias("dg_site"), F.col(text).alias("dg_text"))
    counts = own.select("dg_site", F.explode(keys).alias("dg_line")).groupBy("dg_site", "dg_line").agg(F.count(F.lit(1)).alias("dg_pages")).where(F.col("dg_pages") >= min_pages)
    totals = own.groupBy("dg_site").agg(F.count(F.lit(1)).alias("dg_total"))
    return counts.join(totals, "dg_site").where(F.col("dg_pages") > F.lit(ratio) * F.col("dg_total"))


def drop_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """The same rows and columns, the text without boilerplate lines; with counts also dg_lines and dg_dropped.

    A page all of whose lines exceed the ratio has no content around boilerplate: it is a copy of a page that is common
    on its site, which near-duplicate removal thins out, and stays as it is.

    The dropped keys of a site, at most (lines a page) / ratio, become one array a site in a written table. Spark joins
    that by its known size: it is broadcast below the session's threshold, so that texts are not dealt out, and beyond
    it both sides are dealt by site, of which AQE splits a hot one.
    """
    drops = saved(boilerplate_lines(docs, site, text, ratio, min_pages).groupBy("dg_site").agg(F.sort_array(F.collect_set("dg_line")).alias("dg_drop")), "boilerplate")
    plain, names, back = shielded(docs)
    whole = plain.withColumn("dg_site", F.xxhash64(F.col(names[site]))).join(drops, "dg_site", "left")
    out = apply_drops(whole, names[text])
    return back(out, "dg_lines", "dg_dropped") if counts else back(out)


def apply_drops(whole: DataFrame, text: str) -> DataFrame:
    lines = lines_of(F.col(text))
    kept = F.filter("dg_all", lambda x: (F.btrim(x, F.lit(BLANK)) == "") | ~F.array_contains(F.col("dg_drop"), line_key(x)))
    filled = lambda a: F.exists(a, lambda x: F.btrim(x, F.lit(BLANK)) != "")
    split = whole.withColumn("dg_all", lines).withColumn("dg_some", F.when(F.col("dg_drop").isNotNull(), kept))
    use = F.col("dg_some").isNotNull() & (F.size("dg_some") < F.size("dg_all")) & filled(F.col("dg_some"))
    dropped = F.when(F.col("dg_use"), F.size("dg_all") - F.size("dg_some")).otherwise(F.lit(0))
    out = split.withColumn("dg_use", use).withColumn(text, F.when(F.col("dg_use"), F.array_join("dg_some", "\n")).otherwise(F.col(text)))
    return out.withColumn("dg_lines", F.size("dg_all").cast("long")).withColumn("dg_dropped", dropped.cast("long"))
