"""One entry to the extraction actions, the capability table, context packages and symbol selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagequern.functions import text as T
from pagequern.functions.markup import EXCERPT_LADDER, regex_matches
from pagequern.functions.url import url_label
from pagequern.operators import dom, manifest, ranking

# The order in which an action is inferred from the parameters given.
PRECEDENCE = [("selector", "selector"), ("selectors", "css"), ("list", "list"), ("surface", "surface"), ("manifest", "vertical"), ("pattern", "pattern"), ("summarize", "summarize"), ("query", "cosine")]


class ExtractError(ValueError):
    """code says what is wrong with a request."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def infer_action(**given: object) -> str:
    """An explicit action, else the first of PRECEDENCE whose parameter is given, else adhoc."""
    if given.get("action"):
        return str(given["action"])
    return next((a for p, a in PRECEDENCE if given.get(p)), "adhoc")


def resolve_source(frame: DataFrame) -> DataFrame:
    """frame (id, content, url, response) -> with error: exactly one of the three must be given."""
    n = sum(F.col(c).isNotNull().cast("int") for c in ("content", "url", "response"))
    return frame.withColumn("error", F.when(n == 0, "EXTRACT_INPUT_MISSING").when(n > 1, "EXTRACT_SOURCE_AMBIGUOUS"))


def extract(pages: DataFrame, **given: object) -> DataFrame:
    """pages (page, url, html, text) through an action: selector, css, xpath, pattern, regex, cosine, vertical.

    Actions that call a model (summarize, adhoc) raise; their grounding is manifest.grounded_fields.
    """
    action = infer_action(**given)
    if action == "selector":
        picked = dom.select(dom.node_table(pages), str(given["selector"]))
        order = F.row_number().over(W.partitionBy("page").orderBy("pre"))
        return picked.withColumn("k", order).where(F.col("k") <= int(given.get("limit", 10))).select("page", (F.col("k") - 1).alias("pos"), "tag", "text")
    if action in ("css", "xpath"):
        nodes = dom.node_table(pages)
        out = None
        for field, s in dict(given["selectors"]).items():  # type: ignore[call-overload]
            picked = dom.select(nodes, dom.xpath_to_css(s) if action == "xpath" else s)
            one = picked.groupBy("page").agg(F.min_by("text", "pre").alias("value")).select("page", F.lit(field).alias("field"), "value")
            out = one if out is None else out.unionByName(one)
        return out
    if action in ("pattern", "regex"):
        return pages.select("page", F.posexplode(regex_matches(F.col("text"), str(given["pattern"]), limit=int(given.get("limit", 50)))).alias("pos", "value"))
    if action == "cosine":
        return ranking.cosine_top(ranking.with_blocks(pages.select(F.col("page").alias("doc"), "text")), str(given["query"]), int(given.get("top", 5)), float(given.get("least", 0.0))).withColumnRenamed("doc", "page")
    if action == "vertical":
        columns = manifest.compile_manifest(given["manifest"], F.col("url"), F.try_parse_json("text"))  # type: ignore[arg-type]
        return pages.select("page", *[v.alias(k) for k, v in columns.items()])
    raise ExtractError("EXTRACT_ACTION_UNSUPPORTED", f"action {action} needs a model or isn't known")


def capabilities(spark: SparkSession, manifests: list[dict]) -> DataFrame:
    rows = [(m["name"], m.get("description", ""), m.get("order"), len(m["urlPatterns"])) for m in manifest.overlay([manifests])]
    return spark.createDataFrame(rows, "name string, description string, turn int, patterns int")


def search_operations(operations: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """operations (name, description) by the number of the query's words they hold, then by name."""
    words = [w for w in query.lower().split() if w]
    hay = F.lower(F.concat_ws(" ", "name", "description"))
    score = sum((hay.contains(w).cast("int") for w in words), F.lit(0))
    return operations.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "name").limit(limit)


def context_package(pages: DataFrame, budget_bytes: int = 50 * 1024) -> DataFrame:
    """pages (package, url, text) -> (package, url, label, excerpt): of the ladder's excerpt lengths the first
    under which a package stays within its budget; under the last, entries in URL order as far as it reaches."""
    sized = pages.select("package", "url", url_label(F.col("url")).alias("label"), T.clean_text(F.col("text")).alias("clean"))
    by = W.partitionBy("package")
    for n in EXCERPT_LADDER:
        sized = sized.withColumn(f"at_{n}", F.sum(F.octet_length(F.substring("clean", 1, n)) + F.octet_length("url") + F.octet_length("label")).over(by))
    chosen = F.lit(0)
    for n in reversed(EXCERPT_LADDER):
        chosen = F.when(F.col(f"at_{n}") <= budget_bytes, n).otherwise(chosen)
    picked = sized.withColumn("n", chosen).withColumn("excerpt", F.expr("substring(clean, 1, n)"))
    running = F.sum(F.octet_length("excerpt") + F.octet_length("url") + F.octet_length("label")).over(by.orderBy("url").rowsBetween(W.unboundedPreceding, 0))
    return picked.withColumn("running", running).where(F.col("running") <= budget_bytes).select("package", "url", "label", "excerpt")


def api_symbols(docs: DataFrame) -> DataFrame:
    """docs (doc, text: markdown) -> (doc, module, symbol, kind, line): symbols named in code of headings under
    the document's nearest heading above of a higher level."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    heads = lines.where(F.col("line").rlike(r"^#{1,6}\s+\S")).select("doc", "pos", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("line", r"^#+\s+|\s*#*$", "")).alias("title"))
    name = F.regexp_extract("title", r"`?(?:class\s+|function\s+)?([A-Za-z_$][\w.$]*)\s*(\(|`)", 1)
    kind: Column = F.when(F.col("title").rlike(r"`?class\s"), "class").when(F.col("title").contains("("), "function").otherwise("value")
    module = F.last(F.when(F.col("level") <= 2, F.col("title")), True).over(W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return heads.withColumns({"symbol": name, "kind": kind, "module": module}).where("symbol <> ''").select("doc", "module", "symbol", "kind", (F.col("pos") + 1).alias("line"))
