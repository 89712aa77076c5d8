"""Page boilerplate mixed with main content (problem 3): flat text blocks and a decision tree.

Every non-blank line of a page's markdown is a block. Its features are the words and link density of the
block and its neighbours, its form, its place, how it lies to the element that holds the page's title in the
HTML (if there is any), and how many of the site's pages and how many sites carry the same line with numbers
and names masked. The first are made page by page in Python; the shares are two aggregations over
(site, line hash). A small decision tree, trained at first use on a labelled table of bounded size, becomes a
column expression, so the classification itself is code-generated and runs where the joined features are.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.session import measured_join, settle, table

#: At most so many labelled rows are used for training.
LABELLED_ROWS = 7000
DEPTH, LEAF = 9, 6

_CONTAINERS = {"div", "section", "article", "main", "aside", "nav", "header", "footer", "td", "form"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "col", "area", "base", "embed", "track"}
_TAG = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_BLOCKS = _CONTAINERS | {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "pre", "ul", "ol", "table", "figure", "figcaption", "blockquote", "body", "html", "dl", "dt", "dd", "tbody", "thead"}
_LINK = re.compile(r"\[([^\]\n]*)\]\(([^)\n]*)\)")
_WORDS = re.compile(r"\w+")
_NAME = re.compile(r"(?<=\S )[A-Z][a-z]+")
_KEEP = re.compile(r"[^\W_]+")

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "item", "row", "code", "sentence", "colon", "marks", "place", "from_title", "rel", "rel_before", "rel_after", "has_html", "slug", "share", "sites", "focus"]
_LINES = "page_id bigint, line_no int, s bigint, g bigint, " + ", ".join(f"{f} float" for f in FEATURES[:-3])


def _flat(text: str) -> str:
    return "".join(_KEEP.findall(text)).lower()


def html_blocks(source: str) -> dict[str, list[int]]:
    """How a page's text blocks lie, by their letters and digits: 1 in the element of the title heading,
    2 in an element of its own inside that, 3 outside. Tolerates what browsers tolerate."""
    blocks: list[tuple[str, tuple[int, ...]]] = []
    stack: list[tuple[str, int]] = []
    marked: dict[int, bool] = {}
    number = 0
    text: list[str] = []
    title: tuple[int, ...] | None = None
    in_title = False
    pre = 0

    def path() -> tuple[int, ...]:
        return tuple(n for t, n in stack if t in _CONTAINERS)

    def flush() -> None:
        nonlocal text
        if text:
            whole = html_lib.unescape("".join(text))
            for line in whole.split("\n") if pre else (whole,):
                if line.strip():
                    blocks.append((line, path()))
        text = []

    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name == "title":
            if m.group(2):
                text = []
            in_title = not m.group(2)
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if name not in _BLOCKS:
            continue
        flush()
        if name == "pre":
            pre = 0 if m.group(2) else 1
        if m.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "div", "section", "figure", "pre") and stack and stack[-1][0] == "p":
            stack.pop()
        elif name in ("li", "td", "tr"):
            inner = {"li": ("ul", "ol"), "td": ("tr", "table"), "tr": ("table", "tbody", "thead")}[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in inner:
                    break
                if stack[k][0] == name:
                    del stack[k:]
                    break
        number += 1
        stack.append((name, number))
        if name in _CONTAINERS:
            marked[number] = bool(m.group(4).strip()) or name in ("aside", "nav", "footer", "form")
        if name == "h1" and title is None:
            title = path()
    if at < len(source):
        text.append(source[at:])
    flush()
    out: dict[str, list[int]] = {}
    depth = len(title) if title is not None else 0
    for block, where in blocks:
        key = _flat(block)
        if not key:
            continue
        if title is None or not depth:
            rel = 0
        elif where[:depth] != title:
            rel = 3
        else:
            rel = 2 if any(marked[n] for n in where[depth:]) else 1
        out.setdefault(key, []).append(rel)
    return out


_LABEL = re.compile(r"([A-Z][\w ]{1,24}):\s+\S")


def _skeleton(shown: str) -> str:
    """A line with numbers and names masked; of "Label: anything", the label."""
    label = _LABEL.match(shown)
    if label:
        return label.group(1) + ":"
    return _NAME.sub("N", re.sub(r"\d+", "0", " ".join(shown.split())))


def line_features(page_id: int, site: str | None, markdown: str | None, source: str | None) -> list[tuple]:
    """A row per non-blank line of the markdown; none for NULL."""
    if not markdown:
        return []
    known = html_blocks(source) if source else {}
    # the converter may join what the HTML breaks: such a line lies where its beginning lies
    starts = {k[:24]: v[0] for k, v in known.items() if len(k) >= 12}
    rows = []
    shown, no = [], []
    for k, line in enumerate(markdown.split("\n")):
        if line.strip():
            no.append(k)
            shown.append(line.strip())
    fence = False
    title_at = next((i for i, x in enumerate(shown) if x.startswith("# ")), None)
    plain, rels, codes = [], [], []
    for x in shown:
        opens = x.startswith(("```", "~~~"))
        codes.append(fence or opens)
        if opens:
            fence = not fence
        t = _LINK.sub(r"\1", x) if "](" in x else x
        plain.append(t)
        key = _flat(t)
        found = known.get(key) or (known.get(_flat(t.strip("| ").split("|")[0])) if x.startswith("|") else None)
        if found:
            rels.append(found.pop(0) if len(found) > 1 else found[0])
        else:
            rels.append(starts.get(key[:24], 0))
    if title_at is None:
        title_at = next((i for i, r in enumerate(rels) if r == 1), 0)
    for i, x in enumerate(shown):
        # a fence lies where its code does
        if not rels[i] and codes[i] and x.startswith(("```", "~~~")):
            rels[i] = next((r for r in (rels[i + 1 : i + 2] + rels[i - 1 : i]) if r), 0) if i else 0
    before = after = 0
    filled_before, filled_after = [], [0] * len(rels)
    for r in rels:
        before = r or before
        filled_before.append(before)
    for i in range(len(rels) - 1, -1, -1):
        after = rels[i] or after
        filled_after[i] = after
    words, links = [], []
    for x, t in zip(shown, plain, strict=True):
        n = len(_WORDS.findall(t))
        words.append(n)
        links.append(sum(len(_WORDS.findall(m.group(1))) for m in _LINK.finditer(x)) / n if n and "](" in x else 0.0)
    s = xxhash.xxh64_intdigest(site or "") - 2**63
    total = len(shown)
    for i, (x, t) in enumerate(zip(shown, plain, strict=True)):
        item = x.startswith(("- ", "* ", "+ ")) or bool(re.match(r"\d+[.)] ", x))
        slug = 0.0
        if "](" in x:
            m = _LINK.search(x)
            slug = 1.0 if m and re.sub(r"[^a-z0-9]+", "", m.group(1).lower()) == re.sub(r"[^a-z0-9]+", "", m.group(2).lower()) else 0.5
        rows.append(
            (
                page_id, no[i], s, xxhash.xxh64_intdigest(_skeleton(t)) - 2**63,
                min(words[i], 200), links[i], min(words[i - 1], 200) if i else -1, links[i - 1] if i else -1, min(words[i + 1], 200) if i + 1 < total else -1, links[i + 1] if i + 1 < total else -1,
                float(x.startswith("#")), float(item), float(x.startswith("|")), float(codes[i]), float(t.endswith((".", "!", "?", "。", "？"))), float(t.endswith(":")),
                float(t.count("|") * (not x.startswith("|")) + t.count(" > ") + t.count("·") + t.count("©")), i / total, float(max(-60, min(60, i - title_at))),
                float(rels[i]), float(filled_before[i]), float(filled_after[i]), float(bool(known)), slug,
            )
        )
    return rows


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _LINES.split(", ")]
    for pdf in batches:
        rows = [r for p in zip(pdf["page_id"], pdf["site"], pdf["markdown"], pdf["html"], strict=True) for r in line_features(*p)]
        yield pd.DataFrame(rows, columns=columns)


def block_features(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, s, g, FEATURES) of pages (page_id, site, markdown, html)."""
    lines = settle(pages.select("page_id", "site", "markdown", "html").where(F.length("markdown") > 0).mapInPandas(_features, _LINES))
    sizes = lines.groupBy("s", "page_id").agg(F.lit(1).alias("x")).groupBy("s").agg(F.count("*").alias("pages"))
    counted = lines.groupBy("s", "g", "page_id").agg(F.lit(1).alias("x")).groupBy("s", "g").agg(F.count("*").alias("n"))
    spread = counted.groupBy("g").agg(F.count("*").alias("sites")).where("sites > 1")
    all_sites = sizes.count()
    shares = measured_join(counted.where("n > 1"), sizes, ["s"]).select("s", "g", (F.col("n") / F.greatest("pages", F.lit(5))).cast("float").alias("share"))
    with_share = measured_join(lines, shares, ["s", "g"], "left")
    with_sites = measured_join(with_share, spread.select("g", (F.col("sites") / F.lit(float(max(1, all_sites)))).cast("float").alias("sites")), ["g"], "left")
    filled = with_sites.withColumns({"share": F.coalesce("share", F.lit(0.0)).cast("float"), "sites": F.coalesce("sites", F.lit(0.0)).cast("float")})
    # prompts fill their own site and few others; what every site says now and then is language
    return filled.withColumn("focus", (F.col("share") / (F.col("sites") + 0.05)).cast("float"))


class Tree:
    """A binary decision tree (Gini), grown on rows of features and 0/1 labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF):
        self.root = self._grow(x, y.astype(np.float64), depth, leaf)

    def _grow(self, x, y, depth, leaf):
        p = y.mean()
        if depth == 0 or len(y) < 2 * leaf or p in (0.0, 1.0):
            return float(p)
        best = (1e-6, 0, 0.0)
        whole = len(y) * p * (1 - p)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            left = c[:-1] / n
            right = (c[-1] - c[:-1]) / (len(y) - n)
            cost = n * left * (1 - left) + (len(y) - n) * right * (1 - right)
            ok = (v[1:] > v[:-1]) & (n >= leaf) & (len(y) - n >= leaf)
            if ok.any():
                i = np.flatnonzero(ok)[np.argmin(cost[ok])]
                if whole - cost[i] > best[0]:
                    best = (whole - cost[i], f, float((v[i] + v[i + 1]) / 2))
        if best[0] <= 1e-6:
            return float(p)
        _, f, at = best
        low = x[:, f] <= at
        return f, at, self._grow(x[low], y[low], depth - 1, leaf), self._grow(x[~low], y[~low], depth - 1, leaf)

    def column(self, names: list[str], node=None) -> Column:
        node = self.root if node is None else node
        if isinstance(node, float):
            return F.lit(node)
        f, at, low, high = node
        return F.when(F.col(names[f]) <= at, self.column(names, low)).otherwise(self.column(names, high))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))

        def walk(node, at):
            if isinstance(node, float):
                out[at] = node
                return
            f, value, low, high = node
            go = x[at, f] <= value
            walk(low, at[go])
            walk(high, at[~go])

        walk(self.root, np.arange(len(x)))
        return out


@cache
def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: boilerplate) of blocks.tsv, at most LABELLED_ROWS."""
    path = Path(__file__).with_name("blocks.tsv")
    data = np.loadtxt(path, delimiter="\t", skiprows=1, max_rows=LABELLED_ROWS)
    return data[:, 1:], data[:, 0]


@cache
def trained() -> Tree:
    return Tree(*labelled())


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, score) of the non-blank lines outside the main body.

    NULL, empty and blank markdown gives no line; NULL html and site count as unknown.
    """
    scored = block_features(pages).select("page_id", "line_no", trained().column(FEATURES).alias("score"))
    return scored.where("score > 0.5")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return boilerplate_lines(table(spark, base, "pages")).select("page_id", "line_no")


def p3_main(spark: SparkSession, base: str) -> DataFrame:
    """Each page's markdown without the lines outside its main body (NULL stays NULL)."""
    pages = table(spark, base, "pages").select("page_id", "site", "markdown", "html")
    gone = boilerplate_lines(pages).groupBy("page_id").agg(F.collect_list("line_no").alias("gone"))
    kept = F.array_join(F.filter(F.split("markdown", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return pages.select("page_id", "markdown").join(gone, "page_id", "left").select("page_id", F.when(F.col("gone").isNull(), F.col("markdown")).otherwise(kept).alias("main"))


QUERIES = {"p3_found": p3_found, "p3_main": p3_main}
ORACLES: dict[str, str] = {}
