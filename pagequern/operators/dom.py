"""HTML as a node table, selectors as joins over it, and what is read off a page's tree.

One pass of the standard library's tolerant parser per page gives rows (page, pre, post, level, parent, tag,
attrs, own, text, path): in pre-order numbers, so that a descendant is an interval and a child an equality. Selectors are
compiled on the driver into filters and equi-joins on the page with such residual conditions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NODES = "page bigint, pre int, post int, level int, parent int, tag string, attrs map<string,string>, own string, text string, links int, path array<string>"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENDS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_CLOSE_P = {"div", "section", "article", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "form", "main", "nav", "aside", "header", "footer", "p"}
_SCOPE = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_HIDDEN = {"script", "style", "noscript", "template", "head", "title"}


class Node:
    __slots__ = ("attrs", "children", "level", "parent", "post", "pre", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.level = parent.level + 1 if parent else 0
        self.pre = self.post = 0

    def shown(self) -> str:
        """Text of the subtree, without scripts and styles."""
        out: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in _HIDDEN or x is self:
                stack.extend(reversed(x.children))
        return " ".join("".join(out).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSE_P:
            self._close({"p"}, _CLOSE_P - {"p"} | {"td", "li", "body"})
        if tag in _ENDS:
            self._close(_ENDS[tag], _SCOPE.get(tag, _CLOSE_P - {"p"} | {"body"}))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def _close(self, tags: set[str], stop: set[str]) -> None:
        x = self.at
        while x is not self.root and x.tag not in stop:
            if x.tag in tags:
                self.at = x.parent
                x = self.at
                continue
            x = x.parent

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        while x is not self.root and x.tag != tag:
            x = x.parent
        if x is not self.root:
            self.at = x.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    try:
        tree.feed(html or "")
        tree.close()
    except (AssertionError, ValueError):
        pass  # what was parsed so far stands
    return tree.root


def walk(root: Node) -> list[Node]:
    """Nodes in pre-order, numbered, without recursion."""
    out, stack, post = [], [(root, False)], 0
    while stack:
        node, done = stack.pop()
        if done:
            node.post, post = post, post + 1
            continue
        node.pre = len(out)
        out.append(node)
        stack.append((node, True))
        stack.extend((c, False) for c in reversed(node.children) if not isinstance(c, str))
    return out


def node_table(pages: DataFrame) -> DataFrame:
    """pages (page, html) -> NODES; NULL html gives no node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in NODES.split(", ")]
        for pdf in batches:
            rows = []
            for page, html in zip(pdf["page"], pdf["html"], strict=True):
                if html is None:
                    continue
                path: dict[int, list[str]] = {0: []}
                for x in walk(parse(html))[1:]:
                    path[x.pre] = [*path[x.parent.pre], x.tag]
                    own = " ".join("".join(c for c in x.children if isinstance(c, str)).split())
                    links = sum(len(a.shown()) for a in walk_links(x))
                    rows.append((page, x.pre, x.post, x.level, x.parent.pre, x.tag, x.attrs, own, x.shown(), links, path[x.pre]))
            yield pd.DataFrame(rows, columns=columns)

    return pages.select("page", "html").mapInPandas(run, NODES)


def walk_links(node: Node) -> list[Node]:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        for c in x.children:
            if not isinstance(c, str):
                if c.tag == "a":
                    out.append(c)
                else:
                    stack.append(c)
    return out


# Selectors ---------------------------------------------------------------------------------------------------

_PART = re.compile(r"""\s*(>|\+|~)?\s*((?:\*|[A-Za-z][\w-]*)?(?:\.[\w-]+|\#[\w-]+|\[[^\]]+\]|:first-child|:last-child|:nth-child\(\d+\))*)""")
_TEST = re.compile(r"\.([\w-]+)|\#([\w-]+)|\[\s*([\w-]+)\s*(?:([*~^$|]?=)\s*[\"']?([^\"'\]]*?)[\"']?\s*(i)?)?\s*\]|:(first-child|last-child|nth-child\((\d+)\))")


def _compound(text: str) -> tuple[Column, list[str]]:
    tag = re.match(r"\*|[A-Za-z][\w-]*", text)
    out = F.lit(True) if not tag or tag.group() == "*" else F.col("tag") == tag.group().lower()
    places = []
    for m in _TEST.finditer(text):
        cls, ident, name, op, value, fold, pseudo, _ = m.groups()
        a = F.col("attrs")[name] if name else None
        if a is not None and fold:
            a, value = F.lower(a), value.lower()
        if cls:
            out = out & F.coalesce(F.concat(F.lit(" "), F.regexp_replace(F.col("attrs")["class"], r"\s+", " "), F.lit(" ")).contains(f" {cls} "), F.lit(False))
        elif ident:
            out = out & F.coalesce(F.col("attrs")["id"] == ident, F.lit(False))
        elif pseudo:
            places.append(pseudo)
        elif op is None:
            out = out & a.isNotNull()
        else:
            test = {"=": a == value, "*=": a.contains(value), "^=": a.startswith(value), "$=": a.endswith(value), "~=": F.concat(F.lit(" "), a, F.lit(" ")).contains(f" {value} "), "|=": (a == value) | a.startswith(f"{value}-")}[op]
            out = out & F.coalesce(test, F.lit(False))
    return out, places


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """The nodes a CSS selector picks, each once: types, *, classes, ids, attributes, descendants, >, +, ~,
    first, last and nth child, and comma lists. Raises ValueError for anything else."""
    found = None
    for one in selector.split(","):
        found_one = _select_one(nodes, one.strip())
        found = found_one if found is None else found.unionByName(found_one)
    return found.dropDuplicates(["page", "pre"]) if "," in selector else found


def _select_one(nodes: DataFrame, selector: str) -> DataFrame:
    at, parts = 0, []
    while at < len(selector):
        m = _PART.match(selector, at)
        if not m or not m.group(2) or m.end() == at:
            raise ValueError(f"unsupported selector: {selector}")
        parts.append((m.group(1) or " ", m.group(2)))
        at = m.end()
    if not parts:
        raise ValueError("empty selector")
    siblings = W.partitionBy("page", "parent").orderBy("pre")
    placed = nodes
    if any(x in selector for x in (":", "+")):
        placed = nodes.withColumns({"nth": F.row_number().over(siblings), "last": F.row_number().over(W.partitionBy("page", "parent").orderBy(F.desc("pre")))})
    current = None
    for axis, text in parts:
        test, places = _compound(text)
        mine = placed.where(test)
        for p in places:
            mine = mine.where({"first-child": F.col("nth") == 1, "last-child": F.col("last") == 1}.get(p, F.col("nth") == int(re.sub(r"\D", "", p) or 0)))
        if current is None:
            current = mine
            continue
        up = current.select(F.col("page"), F.col("pre").alias("u_pre"), F.col("post").alias("u_post"), F.col("parent").alias("u_parent"), *([F.col("nth").alias("u_nth")] if "nth" in current.columns else []))
        joined = {
            " ": lambda: _semi(mine, up, (F.col("pre") > F.col("u_pre")) & (F.col("post") < F.col("u_post"))),
            ">": lambda: _semi(mine, up, F.col("parent") == F.col("u_pre")),
            "~": lambda: _semi(mine, up, (F.col("parent") == F.col("u_parent")) & (F.col("pre") > F.col("u_pre"))),
            "+": lambda: _semi(mine, up, (F.col("parent") == F.col("u_parent")) & (F.col("nth") == F.col("u_nth") + 1)),
        }
        current = joined[axis]()
    return current.select(*nodes.columns)


def _semi(mine: DataFrame, up: DataFrame, condition: Column) -> DataFrame:
    up = up.withColumnRenamed("page", "u_page")
    return mine.join(up, (F.col("page") == F.col("u_page")) & condition, "left_semi")


def xpath_to_css(path: str) -> str:
    """The subset //tag[@a="v"], contains(@a,"v"), /a/b as a CSS selector; ValueError for anything else."""
    out = ""
    rest = path.strip()
    while rest:
        m = re.match(r"(//|/)(\*|[A-Za-z][\w-]*)((?:\[[^\]]+\])*)", rest)
        if not m:
            raise ValueError(f"unsupported XPath: {path}")
        out += (" " if m.group(1) == "//" else " > ") if out else ""
        out += m.group(2).lower()
        for test in re.findall(r"\[([^\]]+)\]", m.group(3)):
            has = re.fullmatch(r"\s*@([\w-]+)\s*(?:=\s*[\"']([^\"']*)[\"'])?\s*", test)
            part = re.fullmatch(r"\s*contains\(\s*@([\w-]+)\s*,\s*[\"']([^\"']*)[\"']\s*\)\s*", test)
            if has:
                out += f'[{has.group(1)}="{has.group(2)}"]' if has.group(2) is not None else f"[{has.group(1)}]"
            elif part:
                out += f'[{part.group(1)}*="{part.group(2)}"]'
            elif test.strip().isdigit():
                out += f":nth-child({test.strip()})"
            else:
                raise ValueError(f"unsupported XPath: {path}")
        rest = rest[m.end() :]
    return out


# Where main content is looked for, in order.
MAIN_SELECTORS = ["main", "article", '[role="main"]', ".content", ".main-content", "#content", "#main", "body"]


def rank_main(nodes: DataFrame) -> DataFrame:
    """(page, selector, pre, chars, density, score, rank): candidates for the main content, best first."""
    found = None
    for k, s in enumerate(MAIN_SELECTORS):
        one = select(nodes, s).select("page", "pre", F.lit(s).alias("selector"), F.lit(k).alias("k"), F.length("text").alias("chars"), "links")
        found = one if found is None else found.unionByName(one)
    density = F.least(F.lit(1.0), F.col("links") / F.col("chars"))
    boost = F.when(F.col("selector").isin("main", "article", '[role="main"]'), 500).otherwise(0)
    scored = found.where("chars > 0").withColumn("density", density).withColumn("score", F.col("chars") * (1 - F.col("density")) + boost)
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("page").orderBy(F.desc("score"), "k", "pre"))).select("page", "selector", "pre", "chars", "density", "score", "rank")


def fingerprints(nodes: DataFrame) -> DataFrame:
    """(page, pre, tag, attrs, text, path, parent_tag, siblings, children) of every element."""
    up = nodes.select("page", F.col("pre").alias("parent"), F.col("tag").alias("parent_tag"))
    kids = nodes.groupBy("page", F.col("parent").alias("pre")).agg(F.array_sort(F.collect_list(F.struct("pre", "tag")))["tag"].alias("children"))
    mates = nodes.groupBy("page", "parent").agg(F.array_sort(F.collect_list(F.struct("pre", "tag")))["tag"].alias("siblings"))
    out = nodes.join(up, ["page", "parent"], "left").join(kids, ["page", "pre"], "left").join(mates, ["page", "parent"])
    return out.select("page", "pre", "tag", "attrs", "own", "path", "parent_tag", "siblings", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def fingerprint_similarity(a: str, b: str) -> Column:
    """Likeness of two fingerprints in columns of struct: tag .1, text .25, attributes .25, path .15,
    parent .1, siblings .075, children .075; three decimals."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))

    def share(l: Column, r: Column) -> Column:
        n = F.size(F.array_union(l, r))
        return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(l, r)) / n)

    words = [F.filter(F.split(F.lower(z("own")), r"\W+"), lambda w: w != "") for z in (x, y)]
    pairs = [F.transform(F.map_entries(z("attrs")), lambda e: F.concat_ws("=", e["key"], e["value"])) for z in (x, y)]
    score = (
        0.1 * F.when(x("tag") == y("tag"), 1.0).otherwise(0.0)
        + 0.25 * share(*words)
        + 0.25 * share(*pairs)
        + 0.15 * share(x("path"), y("path"))
        + 0.1 * F.when(x("parent_tag").eqNullSafe(y("parent_tag")), 1.0).otherwise(0.0)
        + 0.075 * share(x("siblings"), y("siblings"))
        + 0.075 * share(x("children"), y("children"))
    )
    return F.round(score, 3)


# Serialisers -------------------------------------------------------------------------------------------------


def to_markdown(node: Node) -> str:
    """Markdown of a subtree: headings, paragraphs, lists, tables, code, quotes, links, emphasis, images."""
    out = _block(node).strip()
    return re.sub(r"\n{3,}", "\n\n", out)


def _inline(node: Node) -> str:
    parts = []
    for c in node.children:
        if isinstance(c, str):
            parts.append(re.sub(r"\s+", " ", c))
        elif c.tag in _HIDDEN:
            continue
        elif c.tag == "br":
            parts.append("\n")
        elif c.tag in ("b", "strong"):
            parts.append(f"**{_inline(c).strip()}**")
        elif c.tag in ("i", "em"):
            parts.append(f"_{_inline(c).strip()}_")
        elif c.tag == "code":
            parts.append(f"`{c.shown()}`")
        elif c.tag == "a":
            parts.append(f"[{_inline(c).strip()}]({c.attrs['href']})" if c.attrs.get("href") else _inline(c))
        elif c.tag == "img":
            parts.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})" if c.attrs.get("src") else "")
        else:
            parts.append(_inline(c))
    return "".join(parts)


_BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "pre", "blockquote", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "aside", "header", "footer", "body", "html", "form", "tr", "li", "td", "#root", "tbody", "thead"}


def _block(node: Node) -> str:
    out, line = [], []

    def flush() -> None:
        text = "".join(line).strip()
        if text:
            out.append(text)
        line.clear()

    for c in node.children:
        if isinstance(c, str):
            line.append(re.sub(r"\s+", " ", c))
        elif c.tag in _HIDDEN:
            continue
        elif c.tag in _BLOCK:
            flush()
            if c.tag[0] == "h" and c.tag[1:].isdigit():
                out.append("#" * int(c.tag[1]) + " " + _inline(c).strip())
            elif c.tag in ("ul", "ol"):
                items = [x for x in c.children if not isinstance(x, str) and x.tag == "li"]
                out.append("\n".join(("- " if c.tag == "ul" else f"{i}. ") + _block(x).strip().replace("\n", "\n  ") for i, x in enumerate(items, 1)))
            elif c.tag == "pre":
                text = "".join(x if isinstance(x, str) else "".join(y for y in x.children if isinstance(y, str)) for x in c.children)
                out.append("```\n" + text.strip("\n") + "\n```")
            elif c.tag == "blockquote":
                out.append("\n".join("> " + x for x in _block(c).strip().split("\n")))
            elif c.tag == "table":
                rows = [[_inline(d).strip() for d in r.children if not isinstance(d, str) and d.tag in ("td", "th")] for r in walk(c) if r.tag == "tr"]
                out.append("\n".join("| " + " | ".join(r) + " |" for r in rows if r))
            else:
                out.append(_block(c).strip())
        elif c.tag == "hr":
            flush()
            out.append("---")
        else:
            wrap = Node("span", {}, None)
            wrap.children = [c]
            line.append(_inline(wrap))
    flush()
    return "\n\n".join(x for x in out if x)


def readable(root: Node) -> tuple[bool, str]:
    """(ok, text): the element whose own paragraphs hold most text and few links, and its like siblings."""
    scores: dict[int, float] = {}
    nodes = {}
    for x in walk(root):
        if x.tag in ("p", "pre", "td", "li", "h2", "h3", "blockquote") and x.parent is not None:
            text = x.shown()
            if len(text) < 25:
                continue
            gain = 1 + text.count(",") + min(3, len(text) // 100)
            for k, up in enumerate((x.parent, x.parent.parent)):
                if up is not None:
                    nodes[up.pre] = up
                    scores[up.pre] = scores.get(up.pre, 0.0) + gain / (k + 1)
    if not scores:
        return False, ""

    def final(pre: int) -> float:
        whole = len(nodes[pre].shown()) or 1
        linked = sum(len(a.shown()) for a in walk_links(nodes[pre]))
        return scores[pre] * (1 - linked / whole)

    best = max(scores, key=lambda p: (final(p), -p))
    text = nodes[best].shown()
    return len(text) >= 140, text


def data_islands(root: Node) -> list[tuple[str, str, str]]:
    """(source, title, text) of JSON in scripts: linked data, framework payloads, hydration data."""
    useful = {"title", "name", "headline", "description", "text", "body", "content", "summary"}
    out = []
    for x in walk(root):
        if x.tag != "script":
            continue
        kind, ident = x.attrs.get("type", "").lower(), x.attrs.get("id", "")
        if "json" not in kind and ident != "__NEXT_DATA__":
            continue
        try:
            data = json.loads("".join(c for c in x.children if isinstance(c, str)))
        except ValueError:
            continue
        source = "json_ld" if "ld+json" in kind else "next_data" if ident == "__NEXT_DATA__" else "hydration" if ident else "json_script"
        texts, title, stack = [], "", [("", data)]
        while stack:
            key, v = stack.pop()
            if isinstance(v, dict):
                stack.extend(reversed(list(v.items())))
            elif isinstance(v, list):
                stack.extend((key, y) for y in reversed(v))
            elif isinstance(v, str) and v.strip():
                if not title and key in ("title", "name", "headline"):
                    title = v.strip()
                if key in useful or (len(v) >= 40 and " " in v and not v.startswith("http")):
                    texts.append(" ".join(v.split()))
        out.append((source, title, "\n".join(dict.fromkeys(texts))))
    return out


_READ = "page bigint, ok boolean, readable string, markdown string, islands array<struct<source:string,title:string,text:string>>"


def read_pages(pages: DataFrame) -> DataFrame:
    """pages (page, html) -> readable text, markdown and data islands, in one parse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, html in zip(pdf["page"], pdf["html"], strict=True):
                if html is None:
                    rows.append((page, False, None, None, []))
                    continue
                root = parse(html)
                ok, text = readable(root)
                rows.append((page, ok, text, to_markdown(root), [{"source": a, "title": b, "text": c} for a, b, c in data_islands(root)]))
            yield pd.DataFrame(rows, columns=["page", "ok", "readable", "markdown", "islands"])

    return pages.select("page", "html").mapInPandas(run, _READ)


def docstrings(text: str, file: str = "source.js") -> list[dict]:
    """Documented functions and classes of a JavaScript, TypeScript or Python source."""
    out = []
    if file.endswith(".py"):
        for m in re.finditer(r'^([ \t]*)(class|def|async def)\s+(\w+)([^\n]*):\s*\n\s+(?:"""|\'\'\')(.*?)(?:"""|\'\'\')', text, re.M | re.S):
            out.append({"name": m.group(3), "kind": "class" if m.group(2) == "class" else "function", "description": " ".join(m.group(5).split()), "line": text.count("\n", 0, m.start()) + 1, "params": []})
        return out
    for m in re.finditer(r"/\*\*(.*?)\*/\s*\n\s*((?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|interface|const|let|var)\s+(\w+)[^\n]*)", text, re.S):
        lines = [re.sub(r"^\s*\*?\s?", "", x).rstrip() for x in m.group(1).split("\n")]
        params = [x.group(1) for x in (re.match(r"@param\s+(?:\{[^}]*\}\s*)?\[?(\w+)", y) for y in lines) if x]
        kind = m.group(3) if m.group(3) in ("function", "class", "interface") else "variable"
        out.append({"name": m.group(4), "kind": kind, "description": " ".join(x for x in lines if x and not x.startswith("@")), "line": text.count("\n", 0, m.start()) + 1, "params": params})
    return out
