"""Graph expansion: a level-synchronous frontier over a link table, redirect chains, robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagequern.functions.page import best_first_score
from pagequern.functions.url import host, matches_any
from pagequern.session import measured_join, settle


def admitted(url: Column, seed: Column, depth: Column, max_depth: int = 3, same_origin: bool = True, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a link may enter the frontier."""
    ok = depth <= max_depth
    if same_origin:
        ok = ok & (host(url) == host(seed))
    if exclude:
        ok = ok & ~matches_any(url, exclude)
    if include:
        ok = ok & matches_any(url, include)
    return ok


def crawl_levels(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int | None = None) -> DataFrame:
    """edges (src, dst, pos) from seeds (url) -> (url, depth, parent): breadth first, a page at its least
    depth with its first parent by order. Each level is written, so lineage stays short and a lost executor
    costs one level. max_pages keeps the first pages by depth, then URL."""
    level = settle(seeds.select("url").distinct().select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    seen = level
    for depth in range(1, max_depth + 1):
        steps = level.select(F.col("url").alias("src")).join(edges, "src")
        first = steps.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("src", "pos")).alias("m"))
        level = settle(first.join(seen.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"), F.col("m.src").alias("parent")))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    if max_pages is not None:
        seen = seen.orderBy("depth", "url").limit(max_pages)
    return seen


def frontier_order(items: DataFrame, strategy: str = "bfs") -> DataFrame:
    """items (seed, url, depth, seq) with turn, the order in which a strategy takes those of one seed."""
    score = best_first_score(F.col("url"), F.col("depth"))
    keys = {"bfs": [F.col("seq")], "dfs": [F.desc("depth"), F.desc("seq")], "best-first": [F.desc(score), F.col("seq"), F.col("url")]}[strategy]
    return items.withColumn("turn", F.row_number().over(W.partitionBy("seed").orderBy(*keys)))


def redirect_targets(hops: DataFrame, limit: int = 5) -> DataFrame:
    """hops (url, target) -> (url, final, hops, status): ok, loop or limit. Pointers are followed one join at
    a time, at most limit times."""
    state = hops.select("url", F.col("target").alias("final"), F.array("url", "target").alias("path"), F.lit("open").alias("status"))
    state = state.withColumn("status", F.when(F.col("url") == F.col("final"), "loop").otherwise("open"))
    step = hops.select(F.col("url").alias("final"), F.col("target").alias("next"))
    for _ in range(limit):
        joined = state.join(step, "final", "left")
        moves = (F.col("status") == "open") & F.col("next").isNotNull()
        loops = moves & F.array_contains("path", F.col("next"))
        state = joined.select(
            "url",
            F.when(moves & ~loops, F.col("next")).otherwise(F.col("final")).alias("final"),
            F.when(moves & ~loops, F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"),
            F.when(loops, "loop").when((F.col("status") == "open") & F.col("next").isNull(), "ok").otherwise(F.col("status")).alias("status"),
        )
    return state.select("url", "final", (F.size("path") - 1).alias("hops"), F.when(F.col("status") == "open", "limit").otherwise(F.col("status")).alias("status"))


def _robots_lines(bodies: DataFrame) -> DataFrame:
    """bodies (host, body) -> (host, pos, field, value) of the lines of robots.txt that say something."""
    lines = bodies.select("host", F.posexplode(F.split("body", "\r\n?|\n")).alias("pos", "line"))
    field = F.lower(F.trim(F.substring_index("line", ":", 1)))
    value = F.trim(F.regexp_replace(F.regexp_replace("line", "^[^:]*:", ""), r"(?:^|\s)#.*$", ""))
    return lines.where((F.instr("line", ":") > 0) & ~F.trim("line").startswith("#")).select("host", "pos", field.alias("field"), value.alias("value"))


def _robots_groups(bodies: DataFrame) -> DataFrame:
    """(host, agent, field, value, pos): each line of a group for each of the group's agents."""
    w = W.partitionBy("host").orderBy("pos")
    said = _robots_lines(bodies).where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    grouped = said.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(w)).drop("opens")
    agents = grouped.where("field = 'user-agent'").select("host", "group", F.lower("value").alias("agent"))
    return grouped.where("field <> 'user-agent'").join(agents.distinct(), ["host", "group"]).select("host", "agent", "field", "value", "pos")


def robots_rules(bodies: DataFrame) -> DataFrame:
    """bodies (host, body) -> (host, agent, allow, path, pos) of the groups of robots.txt; of several agents over
    one group each has its rules. Rules before the first agent, and empty ones, are none."""
    found = _robots_groups(bodies).where(F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    return found.select("host", "agent", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"), "pos")


def crawl_delays(bodies: DataFrame) -> DataFrame:
    """bodies (host, body) -> (host, agent, seconds): the first crawl-delay of each agent that is a number."""
    found = _robots_groups(bodies).where("field = 'crawl-delay'").withColumn("seconds", F.col("value").try_cast("double")).where("seconds >= 0")
    return found.groupBy("host", "agent").agg(F.min_by("seconds", "pos").alias("seconds"))


def robots_sitemaps(bodies: DataFrame) -> DataFrame:
    """bodies (host, body) -> (host, sitemap): the sitemaps that robots.txt names, each once."""
    return _robots_lines(bodies).where("field = 'sitemap' AND value <> ''").select("host", F.col("value").alias("sitemap")).distinct()


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """urls (url, host, path): the longest matching rule decides, allow at ties; no rule allows. In a rule * is
    any run of characters, and $ at its end the path's end."""
    escaped = F.regexp_replace(F.regexp_replace("path", r"[.+?()\[\]{}|^\\$]", r"\\$0"), r"\*", ".*")
    pattern = F.concat(F.lit("^"), F.regexp_replace(escaped, r"\\\$$", r"\$"))
    own = rules.where(F.col("agent") == agent).select("host", "allow", F.length("path").alias("n"), pattern.alias("pattern"))
    matched = measured_join(urls, own, ["host"], "left").withColumn("hit", F.regexp_like("path", F.col("pattern")))
    best = F.max(F.when(F.col("hit"), F.struct("n", F.col("allow").alias("a"))))
    return matched.groupBy("url").agg(F.coalesce(best["a"], F.lit(True)).alias("allowed"))


def sitemap_entry(block: str) -> Column:
    """struct(kind, loc, lastmod) of a <url> or <sitemap> element."""

    def tag(name: str) -> Column:
        inner = F.regexp_extract(block, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1)
        return F.nullif(F.trim(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit(""))

    return F.struct(F.lower(F.regexp_extract(block, "(?i)^<(url|sitemap)", 1)).alias("kind"), tag("loc").alias("loc"), tag("lastmod").alias("lastmod"))


def sitemap_entries(files: DataFrame) -> DataFrame:
    """files (source, body) -> (source, kind: url or sitemap, loc, lastmod)."""
    block = r"(?is)<(url|sitemap)>\s*(.*?)\s*</\1>"
    blocks = files.select("source", F.explode(F.regexp_extract_all("body", F.lit(block), F.lit(0))).alias("b"))
    return blocks.select("source", sitemap_entry("b").alias("e")).select("source", "e.*").where("loc IS NOT NULL")


def discover_urls(files: DataFrame, max_sitemaps: int = 20) -> DataFrame:
    """files (site, url, kind: robots, sitemap or llms, body) -> (site, url, source, source_url, lastmod, title).

    A site's sitemaps are those its robots.txt names, in order, then /sitemap.xml, then what these name in turn;
    the first max_sitemaps of a site are read. Of a URL named several times the last counts, links of llms.txt
    after all sitemaps. NULL bodies hold nothing. The queue of a site has at most max_sitemaps rows.
    """
    named = _robots_lines(files.where("kind = 'robots'").select(F.col("site").alias("host"), "body")).where("field = 'sitemap' AND value <> ''")
    default = files.select("site").distinct().select("site", F.concat("site", F.lit("/sitemap.xml")).alias("url"), F.lit(2**31 - 1).alias("pos"))
    first = named.select(F.col("host").alias("site"), F.col("value").alias("url"), "pos").unionByName(default).groupBy("site", "url").agg(F.min("pos").alias("pos"))
    turn = lambda before: (F.row_number().over(W.partitionBy("site").orderBy(*before))).alias("turn")
    queue = settle(first.select("site", "url", turn(["pos", "url"])).where(F.col("turn") <= max_sitemaps))
    bodies = files.where("kind = 'sitemap'").select("site", "url", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<(url|sitemap)>\s*(.*?)\s*</\1>"), F.lit(0))).alias("pos", "body"))
    entries = settle(bodies.select("site", "url", "pos", sitemap_entry("body").alias("e")).where("e.loc IS NOT NULL"))
    while True:
        found = entries.where("e.kind = 'sitemap'").join(queue, ["site", "url"]).groupBy("site", F.col("e.loc").alias("url")).agg(F.min(F.struct("turn", "pos")).alias("at"))
        fresh = found.join(queue, ["site", "url"], "left_anti").select("site", "url", "at.turn", "at.pos", F.lit(1).alias("new"))
        both = queue.select("site", "url", "turn", F.lit(0).alias("pos"), F.lit(0).alias("new")).unionByName(fresh)
        grown = settle(both.select("site", "url", turn(["new", "turn", "pos", "url"])).where(F.col("turn") <= max_sitemaps))
        if grown.count() == queue.count():
            break
        queue = grown
    nothing = F.lit(None).cast("string")
    mapped = entries.where("e.kind = 'url'").join(queue, ["site", "url"]).select("site", F.col("e.loc").alias("url"), F.struct(F.lit(0).alias("k"), "turn", "pos").alias("o"), F.lit("sitemap").alias("source"), F.col("url").alias("source_url"), F.col("e.lastmod").alias("lastmod"), nothing.alias("title"))
    llms = files.where("kind = 'llms'")
    listed = llms_links(llms.select(F.struct("site", "url").alias("source"), "body"))
    listed = listed.select("source.site", "url", F.struct(F.lit(1).alias("k"), F.lit(0).alias("turn"), F.lit(0).alias("pos")).alias("o"), F.lit("llms").alias("source"), F.col("source.url").alias("source_url"), nothing.alias("lastmod"), "title")
    last = mapped.unionByName(listed).groupBy("site", "url").agg(F.max_by(F.struct("source", "source_url", "lastmod", "title"), "o").alias("r"))
    return last.select("site", "url", "r.*")


def llms_links(files: DataFrame) -> DataFrame:
    """files (source, body) -> (source, url, title): markdown links, then bare URLs; the first of a URL counts."""
    marked = files.select("source", F.posexplode(F.regexp_extract_all("body", F.lit(r"\[([^\]]+)\]\(([^)\s]+)"), F.lit(0))).alias("pos", "m"))
    marked = marked.select("source", "pos", F.regexp_extract("m", r"\]\((.*)$", 1).alias("url"), F.regexp_extract("m", r"^\[([^\]]+)", 1).alias("title"), F.lit(0).alias("pass"))
    bare = files.select("source", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?:^|\s)(https?://[^\s)]+)"), F.lit(1))).alias("pos", "url"))
    both = marked.unionByName(bare.select("source", "pos", "url", F.lit(None).cast("string").alias("title"), F.lit(1).alias("pass")))
    return both.groupBy("source", "url").agg(F.min_by("title", F.struct("pass", "pos")).alias("title"))


def nearest_parent(urls: DataFrame) -> DataFrame:
    """urls (url) -> (url, parent): the longest other URL of the table that is a path prefix; by an equi-join
    on all prefixes."""
    segments = F.split(F.regexp_replace("url", "/+$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(3), F.greatest(F.size(segments) - 1, F.lit(3))), lambda n: F.array_join(F.slice(segments, 1, n), "/"))
    asked = urls.select("url", F.explode(F.array_distinct(prefixes)).alias("p")).where(F.col("p") != F.regexp_replace("url", "/+$", ""))
    known = urls.select(F.regexp_replace("url", "/+$", "").alias("p"), F.col("url").alias("parent"))
    found = asked.join(known, "p").groupBy("url").agg(F.max_by("parent", F.length("p")).alias("parent"))
    return urls.join(found, "url", "left")
