"""Queries over texts: lines, excerpts, sections, patterns, markdown tables, ranking, search, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagequern.functions import text as T
from pagequern.operators import line_diff, ranking
from pagequern.session import table

NEEDLE = "queue"
QUERY = "compressed queue hashes pages"


def _docs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").where("text IS NOT NULL")


def line_grep(spark: SparkSession, base: str) -> DataFrame:
    hits = _docs(spark, base).select("doc_id", F.explode(T.matching_lines(F.col("text"), NEEDLE)).alias("m"))
    return hits.select("doc_id", "m.line", "m.text")


def line_grep_context(spark: SparkSession, base: str) -> DataFrame:
    """Matches with one line before and after, case-sensitive."""
    hits = _docs(spark, base).select("doc_id", F.explode(T.matching_lines(F.col("text"), NEEDLE, 1, True)).alias("m"))
    return hits.select("doc_id", "m.line", F.array_join("m.before", "¦").alias("before"), F.array_join("m.after", "¦").alias("after"))


def line_preview(spark: SparkSession, base: str) -> DataFrame:
    """Of each document the first eight matches, as far as 3200 characters go, clipped to 240 each."""
    hits = line_grep(spark, base).withColumn("clip", F.substring("text", 1, 240))
    by_doc = W.partitionBy("doc_id").orderBy("line")
    kept = hits.withColumns({"k": F.row_number().over(by_doc), "chars": F.sum(F.length("clip")).over(by_doc.rowsBetween(W.unboundedPreceding, 0))})
    return kept.where("k <= 8 AND chars <= 3200").select("doc_id", "line", "clip")


def excerpts(spark: SparkSession, base: str) -> DataFrame:
    found = _docs(spark, base).select("doc_id", F.explode(T.excerpts(F.col("text"), "the queue", 20, 20)).alias("e"))
    return found.select("doc_id", "e.occurrence", "e.index", "e.text")


def sections(spark: SparkSession, base: str) -> DataFrame:
    s = T.section_between(F.col("text"), "```js\n", "\n```", include_start=False)
    return _docs(spark, base).select("doc_id", s.alias("s")).where("s.found").select("doc_id", "s.start_index", "s.end_index", "s.text")


def regex_extract(spark: SparkSession, base: str) -> DataFrame:
    found = _docs(spark, base).select("doc_id", T.regex_values(F.col("text"), r"[\w.]+@[\w.]+\.example").alias("v"))
    return found.where(F.size("v") > 0).select("doc_id", F.array_join("v", ",").alias("addresses"))


def contains_markers(spark: SparkSession, base: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, base).select("doc_id", T.marker_index(t, "```").alias("fence"), T.marker_index(t, "note that", False).alias("note"))


def text_metrics(spark: SparkSession, base: str) -> DataFrame:
    """Token estimate, normalised text's hash, distinct lines and preview length."""
    t = F.col("text")
    return _docs(spark, base).select("doc_id", T.token_estimate(t).alias("tokens"), F.sha2(T.normalize_whitespace(t), 256).alias("normal_hash"), F.length(T.dedupe_lines(t)).alias("deduped_chars"), F.length(T.preview(t, 500, 5)).alias("preview_chars"), F.length(T.plain_text_from_markdown(t)).alias("plain_chars"))


def _lines(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "chunk_inputs").where("markdown IS NOT NULL").select("input_id", F.posexplode(F.split("markdown", "\n", -1)).alias("pos", "line"))


def markdown_headings(spark: SparkSession, base: str) -> DataFrame:
    pattern = r"^(#{1,6})\s+(.+?)\s*#*$"
    return _lines(spark, base).where(F.col("line").rlike(pattern)).select("input_id", (F.col("pos") + 1).alias("line_no"), F.length(F.regexp_extract("line", pattern, 1)).alias("level"), F.regexp_extract("line", pattern, 2).alias("heading"))


def markdown_links(spark: SparkSession, base: str) -> DataFrame:
    pattern = r"\[([^\]]+)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"
    found = _lines(spark, base).select("input_id", "pos", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("m"))
    return found.select("input_id", (F.col("pos") + 1).alias("line_no"), F.regexp_extract("m", pattern, 1).alias("label"), F.regexp_extract("m", pattern, 2).alias("href")).groupBy("input_id", "line_no", "label", "href").agg(F.count("*").alias("n"))


def markdown_code(spark: SparkSession, base: str) -> DataFrame:
    """Fenced code blocks with language, first line and number of lines: an opening fence is one with an even
    number of fences before it."""
    w = W.partitionBy("input_id").orderBy("pos")
    fences = _lines(spark, base).where(F.col("line").startswith("```")).withColumns({"k": F.row_number().over(w), "close": F.lead("pos").over(w)})
    opened = fences.where("k % 2 = 1 AND close IS NOT NULL")
    return opened.select("input_id", (F.col("pos") + 1).alias("line_no"), F.nullif(F.trim(F.substring("line", 4, 1000)), F.lit("")).alias("language"), (F.col("close") - F.col("pos") - 1).alias("code_lines"))


def markdown_sections(spark: SparkSession, base: str) -> DataFrame:
    """Each heading's section: to the line before the next heading of its level or higher. For every level the
    nearest such line is a running minimum from the end, so a document is sorted once and no pairs are made."""
    heads = markdown_headings(spark, base)
    later = W.partitionBy("input_id").orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, -1)
    ends = F.lit(None).cast("int")
    for level in range(1, 7):
        ends = F.when(F.col("level") == level, F.min(F.when(F.col("level") <= level, F.col("line_no"))).over(later)).otherwise(ends)
    return heads.select("input_id", "line_no", "level", ends.alias("end_no"))


def cosine_topk(spark: SparkSession, base: str) -> DataFrame:
    """The paragraphs of each document that fit the query best."""
    paragraphs = _docs(spark, base).select(F.col("doc_id").alias("doc"), F.split("text", "\n").alias("blocks"))
    top = ranking.cosine_top(paragraphs, QUERY, top=3, least=0.05)
    return top.select(F.col("doc").alias("doc_id"), "block", F.round("score", 6).alias("score"))


def split_blocks(spark: SparkSession, base: str) -> DataFrame:
    return ranking.text_blocks(_docs(spark, base).select(F.col("doc_id").alias("doc"), "text"))


def fts_search(spark: SparkSession, base: str) -> DataFrame:
    return ranking.search_tokens(_docs(spark, base).select(F.col("doc_id").alias("doc"), "text"), ["queue", "pages"]).select(F.col("doc").alias("doc_id"), "hits")


def content_hash_dedupe(spark: SparkSession, base: str) -> DataFrame:
    """Content-addressed storage: each distinct text once, under its hash, with its first document."""
    return _docs(spark, base).groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("bytes"))


def _pairs(spark: SparkSession, base: str) -> DataFrame:
    """Each snapshot's paragraphs with those of the same URL and name in the delivery before."""
    s = table(spark, base, "snapshots").where("paragraphs IS NOT NULL")
    last = s.groupBy("url", F.coalesce("snapshot_name", F.lit("")).alias("name"), "delivery").agg(F.max(F.struct("taken_at", "snapshot_id", "paragraphs")).alias("r")).select("url", "name", "delivery", "r.snapshot_id", "r.paragraphs")
    before = last.select("url", "name", (F.col("delivery") + 1).alias("delivery"), F.col("paragraphs").alias("previous"))
    return last.join(before, ["url", "name", "delivery"]).select(F.col("snapshot_id").alias("pair"), "previous", F.col("paragraphs").alias("current"))


def diff_multiset(spark: SparkSession, base: str) -> DataFrame:
    return line_diff.multiset_diff(_pairs(spark, base)).withColumnRenamed("pair", "snapshot_id")


def diff_paired(spark: SparkSession, base: str) -> DataFrame:
    return line_diff.paired_diff(_pairs(spark, base)).groupBy(F.col("pair").alias("snapshot_id"), "kind").agg(F.count("*").alias("lines"), F.round(F.avg("similarity"), 6).alias("similarity"))


def links_changed(spark: SparkSession, base: str) -> DataFrame:
    """Links of each delivery that the same URL did not have in the one before, by anti join."""
    s = table(spark, base, "snapshots").select("url", "delivery", F.explode("links.url").alias("link")).distinct()
    have = s.select("url", "delivery").distinct()
    before = s.select("url", (F.col("delivery") + 1).alias("delivery"), "link")
    fresh = s.join(before, ["url", "delivery", "link"], "left_anti").join(have.select("url", (F.col("delivery") + 1).alias("delivery")).distinct(), ["url", "delivery"], "left_semi")
    return fresh.groupBy("delivery").agg(F.count("*").alias("links_added"))


def _title_pairs(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "snapshots").where("title IS NOT NULL").select("snapshot_id", "title")
    after = s.select((F.col("snapshot_id") - 1).alias("snapshot_id"), F.col("title").alias("other"))
    return s.join(after, "snapshot_id")


def line_similarity(spark: SparkSession, base: str) -> DataFrame:
    """Similarity of consecutive snapshots' titles (ASCII ones)."""
    ascii_only = _title_pairs(spark, base).where(~F.col("title").rlike(r"[^\x00-\x7f]") & ~F.col("other").rlike(r"[^\x00-\x7f]"))
    return ascii_only.select("snapshot_id", F.round(T.line_similarity(F.col("title"), F.col("other")), 6).alias("similarity"))


def line_similarity_all(spark: SparkSession, base: str) -> DataFrame:
    """Similarity of all consecutive snapshots' titles; without SQL."""
    return _title_pairs(spark, base).select("snapshot_id", F.round(T.line_similarity(F.col("title"), F.col("other")), 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (line_grep, line_grep_context, line_preview, excerpts, sections, regex_extract, contains_markers, text_metrics, markdown_headings, markdown_links, markdown_code, markdown_sections, cosine_topk, split_blocks, fts_search, content_hash_dedupe, diff_multiset, diff_paired, links_changed, line_similarity, line_similarity_all)}

_D = "(SELECT doc_id, text, lang FROM documents WHERE text IS NOT NULL)"
_L = r"(SELECT doc_id, unnest(x) AS text, generate_subscripts(x, 1) AS line, x FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS x FROM documents WHERE text IS NOT NULL))"
_ML = "(SELECT input_id, unnest(x) AS line, generate_subscripts(x, 1) AS line_no FROM (SELECT input_id, string_split(markdown, chr(10)) AS x FROM chunk_inputs WHERE markdown IS NOT NULL))"
_HEADS = rf"(SELECT input_id, line_no, length(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*#*$', 1)) AS level, regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*#*$', 2) AS heading FROM {_ML} WHERE regexp_matches(line, '^(#{{1,6}})\s+(.+?)\s*#*$'))"
_GREP = f"(SELECT doc_id, line, text FROM {_L} WHERE contains(lower(text), '{NEEDLE}'))"
_PAIR = """p AS (SELECT url, coalesce(snapshot_name, '') AS name, delivery, snapshot_id, paragraphs FROM snapshots WHERE paragraphs IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url, coalesce(snapshot_name, ''), delivery ORDER BY taken_at DESC, snapshot_id DESC) = 1),
q AS (SELECT b.snapshot_id, a.paragraphs AS previous, b.paragraphs AS current FROM p b JOIN p a ON a.url = b.url AND a.name = b.name AND a.delivery + 1 = b.delivery)"""
_WS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\t ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
ORACLES = {
    "line_grep": f"SELECT doc_id, line, text FROM {_GREP}",
    "line_grep_context": f"SELECT doc_id, line, CASE WHEN line > 1 THEN x[line - 1] ELSE '' END AS before, CASE WHEN line < len(x) THEN x[line + 1] ELSE '' END AS after FROM {_L} WHERE contains(text, '{NEEDLE}')",
    "line_preview": f"SELECT doc_id, line, clip FROM (SELECT doc_id, line, clip, row_number() OVER w AS k, sum(length(clip)) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS chars FROM (SELECT *, substr(text, 1, 240) AS clip FROM {_GREP}) WINDOW w AS (PARTITION BY doc_id ORDER BY line)) WHERE k <= 8 AND chars <= 3200",
    "excerpts": f"""WITH s AS (SELECT doc_id, text, string_split(lower(text), 'the queue') AS x FROM {_D}),
o AS (SELECT doc_id, text, i AS occurrence, list_sum(list_transform(x[1:i], lambda y: length(y))) + 9 * (i - 1) AS idx FROM s, unnest(range(1, least(len(x), 11))) AS r(i) WHERE len(x) > 1)
SELECT doc_id, CAST(occurrence AS INTEGER) AS occurrence, CAST(idx AS INTEGER) AS index, substr(text, CAST(greatest(idx - 20, 0) + 1 AS BIGINT), CAST(least(idx + 29, length(text)) - greatest(idx - 20, 0) AS BIGINT)) AS text FROM o""",
    "sections": f"WITH a AS (SELECT doc_id, text, instr(text, '```js' || chr(10)) - 1 AS s FROM {_D}), b AS (SELECT *, instr(substr(text, s + 7), chr(10) || '```') AS e FROM a WHERE s >= 0) SELECT doc_id, s AS start_index, CASE WHEN e > 0 THEN s + 6 + e - 1 END AS end_index, substr(text, s + 7, least(CASE WHEN e > 0 THEN e - 1 ELSE length(text) END, 40000)) AS text FROM b",
    "regex_extract": rf"SELECT doc_id, array_to_string(v[1:5], ',') AS addresses FROM (SELECT doc_id, regexp_extract_all(text, '[\w.]+@[\w.]+\.example') AS v FROM {_D}) WHERE len(v) > 0",
    "contains_markers": f"SELECT doc_id, instr(text, '```') - 1 AS fence, instr(lower(text), 'note that') - 1 AS note FROM {_D}",
    "text_metrics": rf"""SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS tokens, sha256({_WS}) AS normal_hash,
length(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y, i: y <> '' AND list_position(list_transform(string_split(text, chr(10)), lambda z: regexp_replace(z, '^\s+|\s+$', '', 'g')), y) = i), chr(10))) AS deduped_chars,
length(substr(array_to_string(string_split(text, chr(10))[1:5], chr(10)), 1, 500)) AS preview_chars,
length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '(?m)^#{{1,6}}\s+', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[*_`>~-]', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS plain_chars FROM {_D}""".replace("{{1,6}}", "{1,6}"),
    "markdown_headings": f"SELECT * FROM {_HEADS}",
    "markdown_links": rf"""SELECT input_id, line_no, regexp_extract(m, '\[([^\]]+)\]\(([^)\s]+)', 1) AS label, regexp_extract(m, '\[([^\]]+)\]\(([^)\s]+)', 2) AS href, count(*) AS n FROM (SELECT input_id, line_no, unnest(regexp_extract_all(line, '\[[^\]]+\]\([^)\s]+(?:\s+"[^"]*")?\)')) AS m FROM {_ML}) GROUP BY ALL""",
    "markdown_code": f"SELECT input_id, line_no, nullif(trim(substr(line, 4)), '') AS language, close - line_no - 1 AS code_lines FROM (SELECT *, row_number() OVER w AS k, lead(line_no) OVER w AS close FROM {_ML} WHERE line LIKE '```%' WINDOW w AS (PARTITION BY input_id ORDER BY line_no)) WHERE k % 2 = 1 AND close IS NOT NULL",
    "markdown_sections": f"WITH h AS {_HEADS} SELECT a.input_id, a.line_no, a.level, min(b.line_no) AS end_no FROM h a LEFT JOIN h b ON a.input_id = b.input_id AND b.line_no > a.line_no AND b.level <= a.level GROUP BY ALL",
    "cosine_topk": rf"""WITH b AS (SELECT doc_id, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS block FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, block, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s''-]', ' ', 'g'), '\s+'), lambda y: length(y) > 1) AS w FROM b),
e AS (SELECT doc_id, block, len(w) AS n, unnest(w) AS term FROM t), tf AS (SELECT doc_id, block, term, count(*) / any_value(n) AS tf FROM e GROUP BY ALL),
sz AS (SELECT doc_id, count(*) AS blocks FROM b GROUP BY doc_id), idf AS (SELECT doc_id, term, ln((any_value(blocks) + 1) / (count(*) + 1)) + 1 AS idf FROM tf JOIN sz USING (doc_id) GROUP BY doc_id, term),
q AS (SELECT unnest(['compressed', 'queue', 'hashes', 'pages']) AS term, 0.25 AS qtf), qn AS (SELECT doc_id, sqrt(sum((qtf * idf) ** 2)) AS qn FROM idf JOIN q USING (term) GROUP BY doc_id),
s AS (SELECT doc_id, block, sum(tf * idf * coalesce(qtf, 0) * idf) AS dot, sqrt(sum((tf * idf) ** 2)) AS norm FROM tf JOIN idf USING (doc_id, term) LEFT JOIN q USING (term) GROUP BY doc_id, block),
r AS (SELECT doc_id, block, dot / (norm * qn) AS score FROM s JOIN qn USING (doc_id) WHERE norm > 0 AND qn > 0)
SELECT doc_id, block, round(score, 6) AS score FROM r WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, block) <= 3""",
    "fts_search": rf"SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS token FROM {_D}) WHERE token IN ('queue', 'pages') GROUP BY doc_id HAVING count(DISTINCT token) = 2",
    "content_hash_dedupe": f"SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies, max(strlen(text)) AS bytes FROM {_D} GROUP BY 1",
    "diff_multiset": f"""WITH {_PAIR}, a AS (SELECT snapshot_id, line, row_number() OVER (PARTITION BY snapshot_id, line) AS k FROM (SELECT snapshot_id, unnest(previous) AS line FROM q) WHERE line <> ''),
b AS (SELECT snapshot_id, line, row_number() OVER (PARTITION BY snapshot_id, line) AS k FROM (SELECT snapshot_id, unnest(current) AS line FROM q) WHERE line <> '')
SELECT coalesce(a.snapshot_id, b.snapshot_id) AS snapshot_id, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS unchanged, count(*) FILTER (a.k IS NULL) AS added, count(*) FILTER (b.k IS NULL) AS removed FROM a FULL JOIN b ON a.snapshot_id = b.snapshot_id AND a.line = b.line AND a.k = b.k GROUP BY 1""",
    "links_changed": "WITH s AS (SELECT DISTINCT url, delivery, unnest(list_transform(links, lambda x: x.url)) AS link FROM snapshots), h AS (SELECT DISTINCT url, delivery FROM s) SELECT s.delivery, count(*) AS links_added FROM s JOIN h ON h.url = s.url AND h.delivery + 1 = s.delivery LEFT JOIN s p ON p.url = s.url AND p.delivery + 1 = s.delivery AND p.link = s.link WHERE p.link IS NULL GROUP BY 1",
    "line_similarity": r"""WITH t AS (SELECT a.snapshot_id, a.title AS l, b.title AS r FROM snapshots a JOIN snapshots b ON b.snapshot_id = a.snapshot_id + 1 WHERE a.title IS NOT NULL AND b.title IS NOT NULL AND NOT regexp_matches(a.title, '[^\x00-\x7f]') AND NOT regexp_matches(b.title, '[^\x00-\x7f]')),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(l), '[\p{L}\p{N}]+')) AS x, list_distinct(regexp_extract_all(lower(r), '[\p{L}\p{N}]+')) AS y FROM t)
SELECT snapshot_id, round(CASE WHEN l = r THEN 1.0 WHEN l = '' OR r = '' THEN 0.0 ELSE greatest(1 - levenshtein(l, r) / greatest(length(l), length(r)), CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END) END, 6) AS similarity FROM w""",
}
