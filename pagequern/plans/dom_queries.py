"""Queries over pages' node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.operators import dom
from pagequern.session import settle, table


def _pages(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "pages").select(F.col("page_id").alias("page"), "html")


def dom_nodes(spark: SparkSession, base: str) -> DataFrame:
    """Number of elements and greatest depth by tag."""
    return dom.node_table(_pages(spark, base)).groupBy("tag").agg(F.count("*").alias("nodes"), F.max("level").alias("deepest"))


def dom_select(spark: SparkSession, base: str) -> DataFrame:
    """How many elements some selectors pick on each page."""
    nodes = settle(dom.node_table(_pages(spark, base)))
    selectors = ["h1", "ul > li a[href]", "body div p", "h1 ~ p", "td:first-child", '[role="main"], main, article']
    out = None
    for s in selectors:
        one = dom.select(nodes, s).groupBy("page").agg(F.count("*").alias("picked")).select(F.col("page").alias("page_id"), F.lit(s).alias("selector"), "picked")
        out = one if out is None else out.unionByName(one)
    return out


def css_extract(spark: SparkSession, base: str) -> DataFrame:
    """Fields by selector: the first match's text."""
    nodes = settle(dom.node_table(_pages(spark, base)))
    fields = {"heading": "h1", "code": dom.xpath_to_css("//pre/code"), "link": 'a[href^="/"]'}
    out = None
    for name, s in fields.items():
        one = dom.select(nodes, s).groupBy("page").agg(F.min_by("text", "pre").alias("value")).select(F.col("page").alias("page_id"), F.lit(name).alias("field"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def main_content(spark: SparkSession, base: str) -> DataFrame:
    """The best candidate for each page's main content."""
    return dom.rank_main(settle(dom.node_table(_pages(spark, base)))).where("rank = 1").select(F.col("page").alias("page_id"), "selector", "chars", F.round("density", 6).alias("density"), F.round("score", 3).alias("score"))


def heal_selector(spark: SparkSession, base: str) -> DataFrame:
    """The h1 of page 1 looked for on every page by its fingerprint, without its tag's selector. The stored side of
    the join is one row."""
    marks = settle(dom.fingerprints(settle(dom.node_table(_pages(spark, base)))))
    stored = marks.where("tag = 'h1'").orderBy("page", "pre").limit(1).select(F.lit(1).alias("k"), F.struct(*[F.col(c) for c in marks.columns]).alias("old"))
    scored = marks.select(F.lit(1).alias("k"), F.struct(*[F.col(c) for c in marks.columns]).alias("new")).join(F.broadcast(stored), "k").select(F.col("new.page").alias("page_id"), "new.pre", "new.tag", dom.fingerprint_similarity("old", "new").alias("likeness"))
    return scored.where("likeness >= 0.35").groupBy("page_id").agg(F.max(F.struct("likeness", (-F.col("pre")).alias("p"), "tag")).alias("m")).select("page_id", F.col("m.tag").alias("tag"), F.col("m.likeness").alias("likeness"))


def readable_pages(spark: SparkSession, base: str) -> DataFrame:
    return dom.read_pages(_pages(spark, base)).select(F.col("page").alias("page_id"), "ok", F.length("readable").alias("readable_chars"), F.length("markdown").alias("markdown_chars"), F.size("islands").alias("islands"))


QUERIES = {f.__name__: f for f in (dom_nodes, dom_select, css_extract, main_content, heal_selector, readable_pages)}
ORACLES: dict[str, str] = {}
