"""Lines repeated across one site's documents (problem 5): distributed PrefixSpan.

A document is the sequence of its normalised lines' hashes, per source. The sequences are pruned to lines
that are frequent by themselves, and equal ones of a document become one. Then prefixes grow: a prefix's
projected database holds, of every sequence with it, the place where its first occurrence ends; each line
behind that place is a possible next one, and those with enough distinct documents make the next level, until
a level is empty. Gaps are allowed, and no length is set. A level is one explode and two hash aggregations
keyed by source, sequence and document, so a source that holds a third of all rows is spread like any other.

What is deleted are the occurrences of frequent sequences: at every level, each place where such a sequence
can end in a document is marked, and the marks of all levels return to the rows. Of the sequences whose
projected databases are the same only one is grown (their continuations are the same), which keeps pages of
one fixed frame from growing every subset of its lines; the marks don't change by that. p5_patterns grows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.functions.url import host, url_key
from pagequern.session import measured_join, settle, table

MIN_DOCUMENTS = 4
MIN_SHARE = 0.2

_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def normal_line(line: Column) -> Column:
    """Lower case, white space trimmed and collapsed, every run of digits 0-9 as 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), _SPACE, " "), "[0-9]+", "0"))


def line_sequences(docs: DataFrame, *, row_id: str, source: Column, document: Column, lines: Column) -> DataFrame:
    """(row id, s, doc, h): hashes of source and document, and of the row's lines in order; written once.

    NULL lines keep their place as NULL and are never repeated; NULL arrays are empty ones.
    """
    return settle(
        docs.select(
            F.col(row_id).alias("row_id"),
            F.xxhash64(source).alias("s"),
            F.xxhash64(document).alias("doc"),
            F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.when(x.isNotNull(), F.xxhash64(normal_line(x)))).alias("h"),
        )
    )


def _supported(grown: DataFrame, sizes: DataFrame, min_documents: int, min_share: float) -> DataFrame:
    """grown (s, doc, g, ends, ...) -> (s, g, n, low, high) of the sequences with enough distinct documents;
    low and high are sums that tell their projected databases apart."""
    entry = F.xxhash64("doc", "k", F.array_min("ends"))
    by_doc = grown.groupBy("s", "g", "doc").agg(F.sum(entry.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned(entry, 32)).alias("high"))
    counted = by_doc.groupBy("s", "g").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"))
    return measured_join(counted.where(F.col("n") >= min_documents), sizes, ["s"]).where(F.col("n") >= F.col("docs") * min_share - 1e-9).drop("docs")


def _grown(projected: DataFrame) -> DataFrame:
    """A row for every line behind a prefix's first end: the longer sequence, and all places where it ends."""
    places = F.sequence(F.lit(0), F.size("q") - 1)
    behind = F.filter(places, lambda j: j > F.col("at"))
    lines = F.array_distinct(F.transform(behind, lambda j: F.get("q", j)))
    steps = F.transform(lines, lambda x: F.struct(x.alias("x"), F.filter(behind, lambda j: F.get("q", j) == x).alias("ends")))
    out = projected.where(F.col("at") + 1 < F.size("q")).select("s", "doc", "k", "q", "g", F.explode(steps).alias("t"))
    return out.select("s", "doc", "k", "q", F.when(F.col("g").isNull(), F.col("t.x")).otherwise(F.xxhash64("g", "t.x")).alias("g"), "t.ends")


def frequent_sequences(sequences: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, grow_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """(patterns, marked): patterns (s, g, length, n) are the frequent sequences, without those that continue
    one whose projected database another has too unless grow_all; g is a line's hash, or of longer sequences
    that of prefix and line. marked (row_id, f): the places in each row's lines at which occurrences of
    frequent sequences lie, in no order; rows without any are missing.
    """
    sizes = settle(sequences.groupBy("s", "doc").agg(F.lit(1).alias("one")).groupBy("s").agg(F.count("*").alias("docs")))
    lines = sequences.select("s", "doc", F.explode(F.array_distinct(F.filter("h", lambda x: x.isNotNull()))).alias("x"))
    known = lines.groupBy("s", "x", "doc").agg(F.lit(1).alias("one")).groupBy("s", "x").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents)
    known = measured_join(known, sizes, ["s"]).where(F.col("n") >= F.col("docs") * min_share - 1e-9)
    # a source has at most 1 / min_share times its lines a document of such lines: the list is short
    lists = known.groupBy("s").agg(F.collect_list("x").alias("known"))
    kept = F.filter(F.transform("h", lambda x, i: F.struct(i.alias("pos"), x.alias("x"))), lambda p: F.array_contains("known", p["x"]))
    pruned = measured_join(sequences, lists, ["s"]).select("row_id", "s", "doc", kept.alias("f")).where(F.size("f") > 0)
    pruned = settle(pruned.select("row_id", "s", "doc", F.col("f.pos").alias("pos"), F.col("f.x").alias("q")).withColumn("k", F.xxhash64("q")))

    projected = pruned.groupBy("s", "doc", "k").agg(F.first("q").alias("q")).select("s", "doc", "k", "q", F.lit(None).cast("bigint").alias("g"), F.lit(-1).alias("at"))
    patterns = marks = None
    length = 0
    while True:
        length += 1
        grown = _grown(projected)
        level = settle(_supported(grown, sizes, min_documents, min_share))
        if level.isEmpty() and patterns is not None:
            break
        held = settle(measured_join(grown, level.select("s", "g"), ["s", "g"], "left_semi"))
        found = level.select("s", "g", F.lit(length).alias("length"), "n")
        patterns = found if patterns is None else patterns.unionByName(found)
        ends = held.select("s", "k", F.explode("ends").alias("j"))
        marks = ends if marks is None else marks.unionByName(ends)
        if not grow_all:
            one = level.groupBy("s", "n", "low", "high").agg(F.min("g").alias("g")).select("s", "g")
            held = measured_join(held, one, ["s", "g"], "left_semi")
        projected = held.select("s", "doc", "k", "q", "g", F.array_min("ends").alias("at"))
    places = marks.groupBy("s", "k", "j").agg(F.lit(1).alias("one")).groupBy("s", "k").agg(F.collect_list("j").alias("places"))
    marked = measured_join(pruned.select("row_id", "s", "k", "pos"), places, ["s", "k"])
    return patterns, marked.select("row_id", F.transform("places", lambda j: F.get("pos", j)).alias("f"))


def repeated_positions(marked: DataFrame) -> DataFrame:
    """(row id, pos) of every line that lies in an occurrence of a frequent sequence."""
    return marked.select("row_id", F.explode("f").alias("pos"))


def snapshot_sequences(snapshots: DataFrame) -> DataFrame:
    key = url_key(F.col("url"))
    return line_sequences(snapshots, row_id="snapshot_id", source=host(key), document=key, lines=F.col("paragraphs"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    _, marked = frequent_sequences(snapshot_sequences(table(spark, base, "snapshots")))
    return repeated_positions(marked).select(F.col("row_id").alias("snapshot_id"), "pos")


def p5_patterns(spark: SparkSession, base: str) -> DataFrame:
    """Number of frequent sequences by length, over all sources, and the documents they have."""
    found, _ = frequent_sequences(snapshot_sequences(table(spark, base, "snapshots")), grow_all=True)
    return found.groupBy("length").agg(F.count("*").alias("patterns"), F.sum("n").alias("documents"))


def p5_clean(spark: SparkSession, base: str) -> DataFrame:
    """Each row's paragraphs without the repeated ones (NULL stays NULL)."""
    snapshots = table(spark, base, "snapshots")
    _, marked = frequent_sequences(snapshot_sequences(snapshots))
    at = marked.select(F.col("row_id").alias("snapshot_id"), F.col("f").alias("drop"))
    kept = F.filter("paragraphs", lambda x, i: ~F.array_contains("drop", i))
    return snapshots.join(at, "snapshot_id", "left").select("snapshot_id", F.when(F.col("drop").isNull(), F.col("paragraphs")).otherwise(kept).alias("paragraphs"))


QUERIES = {"p5_found": p5_found, "p5_patterns": p5_patterns, "p5_clean": p5_clean}

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
_TRACKING = "('fbclid','gclid','igshid','mc_cid','mc_eid','msclkid','utm_campaign','utm_content','utm_medium','utm_source','utm_term')"
_LINES = rf"""
WITH parts AS (
  SELECT snapshot_id, paragraphs, lower(regexp_extract(url, '{_URL}', 1)) AS sch, lower(regexp_extract(url, '{_URL}', 2)) AS hst, regexp_extract(url, '{_URL}', 3) AS pth,
    list_sort(list_filter(string_split(substr(regexp_extract(url, '{_URL}', 4), 2), '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN {_TRACKING})) AS prm
  FROM snapshots),
keyed AS (
  SELECT snapshot_id, paragraphs, regexp_replace(hst, ':[0-9]*$', '') AS site,
    sch || '://' || regexp_replace(hst, CASE WHEN sch = 'https' THEN ':443$' ELSE ':80$' END, '') || CASE WHEN pth = '' THEN '/' WHEN length(pth) > 1 THEN coalesce(nullif(regexp_replace(pth, '/+$', ''), ''), '/') ELSE pth END
    || CASE WHEN len(prm) > 0 THEN '?' || array_to_string(prm, '&') ELSE '' END AS page
  FROM parts),
lines AS (
  SELECT snapshot_id, site, page, pos - 1 AS pos, trim(regexp_replace(regexp_replace(lower(p), '[\s\x{{00A0}}\x{{3000}}\x{{2000}}-\x{{200A}}]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS line
  FROM (SELECT snapshot_id, site, page, unnest(paragraphs) AS p, generate_subscripts(paragraphs, 1) AS pos FROM keyed)),
pages_ AS (SELECT site, count(DISTINCT page) AS pages FROM keyed GROUP BY site),
frequent AS (
  SELECT site, line FROM (SELECT site, line, count(DISTINCT page) AS n FROM lines GROUP BY site, line) JOIN pages_ USING (site) WHERE n >= 4 AND n * 5 >= pages)
"""
ORACLES = {
    "p5_found": f"{_LINES} SELECT snapshot_id, pos FROM lines SEMI JOIN frequent USING (site, line)",
    "p5_clean": f"{_LINES} SELECT k.snapshot_id, CASE WHEN k.paragraphs IS NULL THEN NULL ELSE coalesce(kept, []) END AS paragraphs FROM keyed k LEFT JOIN (SELECT l.snapshot_id, list(s.paragraphs[l.pos + 1] ORDER BY l.pos) AS kept FROM lines l ANTI JOIN frequent USING (site, line) JOIN snapshots s ON s.snapshot_id = l.snapshot_id GROUP BY l.snapshot_id) USING (snapshot_id)",
    "p5_patterns": f"""{_LINES},
rows_ AS (SELECT site, page, snapshot_id, list(line ORDER BY pos) AS q FROM lines SEMI JOIN frequent USING (site, line) GROUP BY ALL),
seqs AS (SELECT DISTINCT site, page, q FROM rows_),
subs AS (SELECT site, page, list_transform(list_filter(range(len(q)), lambda i: (m >> i) & 1 = 1), lambda i: q[i + 1]) AS p FROM (SELECT site, page, q, unnest(range(1, 1 << len(q))) AS m FROM seqs)),
counted AS (SELECT site, p, count(DISTINCT page) AS n FROM subs GROUP BY site, p)
SELECT len(p) AS length, count(*) AS patterns, sum(n) AS documents FROM counted JOIN pages_ USING (site) WHERE n >= 4 AND n * 5 >= pages GROUP BY len(p)""",
}
