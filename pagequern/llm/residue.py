"""Template residue and error-page text (problem 4): message templates from a fixed-depth prefix tree.

Every line is masked (numbers, ids, hosts, paths; in the tree the names of longer lines too) and falls into the
leaf of a tree of fixed depth: its number of tokens, then its first three tokens. A leaf's distinct lines form
groups of lines that share most tokens, and a group's template is what all its lines have in common. Templates
are classified once, by a logistic regression fitted at first use on a labelled table of bounded size: their
words, and how they behave (in how many records and sites, how much of their records' text they are, how
often the fetch was refused), so that messages in other languages or wordings are known by what they do.
Templates that hardly ever occur without a message are its companions. The verdicts are joined back to the
lines, and a record is residue if it holds a message and no sentence of its own. Unfilled slots and unrendered
values are looked for in every record, outside of code and of sentences that explain them.
"""

from __future__ import annotations

import csv
import itertools
import re
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.session import measured_join, settle, table

DEPTH = 3
#: Lines of a group share at least this part of their tokens with its first line; distinct lines are compared
#: within leaves, in portions of about so many.
SIMILAR, PORTION = 0.6, 1500
#: At most so many labelled templates are used for fitting; words are hashed into so many places.
LABELLED_ROWS, WORD_PLACES = 6000, 1 << 17
#: A companion occurs in at least so many records, and in this share of them with a message.
COMPANION_RECORDS, COMPANION_SHARE = 3, 0.8
#: A line of so many characters or tokens is a sentence, unless it opens the record like a title.
SENTENCE_CHARS, SENTENCE_TOKENS = 35, 6

# Unfilled slots as various template languages write them.
SLOT = (
    r"\{\{[^{}\n]+\}\}|\{%[^%\n]+%\}|<%=?[^%\n]+%>|(?<!\$)\$\{[^{}\n]+\}|#\{[^{}\n]+\}|\{[a-z][a-z0-9_.]+\}|\*\|[A-Z0-9_:]{2,}\|\*"
    r"|(?<![A-Za-z0-9%])%[A-Z][A-Z0-9_]{2,}%|(?<![A-Za-z0-9_])__[A-Z][A-Z0-9_]+__|(?<![A-Za-z0-9$])\$[A-Z][A-Z0-9_]{2,}\$|@@[A-Za-z][\w.]+@@|\[\[[a-zA-Z][\w. ]+\]\]"
    r"|\[(?i:insert|your) [A-Za-z ]{2,}\]|<(?!/?(?:a|abbr|article|aside|b|blockquote|body|br|button|code|details|div|em|footer|form|h[1-6]|head|header|hr|html|i|id|iframe|img|input|label|li|link|main|meta|n|nav|noscript|ol|option|p|path|pre|script|section|select|small|span|strong|style|sub|summary|sup|svg|table|tbody|td|template|th|thead|title|tr|u|ul|video)[ />])(?i:your |insert )?[a-z]{3,}(?: [a-z]{2,}){0,2}>|\[object Object\]|(?<![\w%])%[sd](?![\w%])"
)
# Values that a page shows where its data was missing.
_VALUE = r"(?<![\w.$-])(?:undefined|NaN)(?![\w(-])"
# Words of sentences that explain such things.
_EXPLAINS = r"(?i)\b(?:returns?|printf|stands? for|means?|layout|fills? it in|syntax|placeholders?|template language|write|variable|is not defined|typeof|when the)\b"

# A page's frame.
_FRAME = r"(?:home|menu|contact|kontakt|search|back to (?:start|top)|go back home|skip to content|loading|©.{0,60}|<host>|```\w*|[^\p{L}\p{N}]*)"


def _masked(line: Column) -> Column:
    out = F.regexp_replace(F.trim(line), r"\b[0-9a-fA-F]*[0-9][0-9a-fA-F]{7,}\b|\b[0-9a-fA-F]{8,}[0-9][0-9a-fA-F]*\b", "<id>")
    out = F.regexp_replace(out, r"(?:https?://)?\b[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{4,8}(?::\d+)?(?=[\s.,;:!?)]|$)", "<host>")
    out = F.regexp_replace(out, r"(?<=\s)/[\w./-]+", "<path>")
    return F.regexp_replace(out, r"\d+", "<n>")


def _leaf(tokens: Column) -> Column:
    first = F.transform(F.slice(tokens, 1, DEPTH), lambda t, i: F.when((i > 0) & (F.size(tokens) > 5) & t.rlike("^[A-Z][a-z]+$"), F.lit("<name>")).otherwise(F.lower(t)))
    return F.xxhash64(F.size(tokens), F.array_join(first, " "))


def record_lines(records: DataFrame) -> DataFrame:
    """(id, masked, h, leaf, content, share, site, bad) of the non-blank lines outside code blocks of records (id,
    text and, if there are, site and a boolean bad); written once. masked is in lower case; content says that the line is
    a sentence, not a title or the page's frame; share is its part of the record's text; bad says that the
    fetch was refused."""
    bare = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"(?m)^\s*```[^\n]*\n(?:(?!\s*```)[^\n]*\n)*?\s*```[^\n]*$", "```")
    bare = F.when(F.instr("text", "```") > 0, bare).otherwise(F.replace("text", F.lit("\r"), F.lit("\n")))
    site = F.xxhash64("site") if "site" in records.columns else F.lit(0).cast("bigint")
    bad = F.col("bad") if dict(records.dtypes).get("bad") == "boolean" else F.lit(None).cast("boolean")
    lines = records.select("id", site.alias("site"), bad.alias("bad"), F.length("text").alias("chars"), F.posexplode(F.split(bare, "\n")).alias("pos", "line")).where(F.trim("line") != "")
    masked = lines.select("*", _masked(F.col("line")).alias("masked")).select("*", F.split("masked", r"\s+").alias("tokens"))
    sentence = (F.length("line") >= SENTENCE_CHARS) | (F.size("tokens") >= SENTENCE_TOKENS) | F.col("line").rlike(r"[\u3040-\u9FFF]{6}")
    title = (F.col("pos") <= 1) & ~F.trim("line").rlike(r"[.!?。…:]$") & (F.size("tokens") <= 12)
    frame = (F.length("line") < 80) & F.lower("masked").rlike(f"^{_FRAME}$")
    return settle(masked.select("id", F.lower("masked").alias("masked"), F.xxhash64(F.lower("masked")).alias("h"), _leaf(F.col("tokens")).alias("leaf"), (sentence & ~title & ~frame).alias("content"), (F.length("line") / F.col("chars")).cast("float").alias("share"), "site", "bad"))


#: What is known of a template besides its words: its lines, the least and greatest of its sites, the sum of its
#: lines' shares, and its lines in refused and in all fetches of which that is known.
BEHAVIOUR = ["lines", "low", "high", "share", "bad", "known"]


def _sums() -> list[Column]:
    return [F.sum("lines").alias("lines"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("share").alias("share"), F.sum("bad").alias("bad"), F.sum("known").alias("known")]


_MEMBERS = "leaf bigint, h bigint, template string, lines bigint, low bigint, high bigint, share double, bad bigint, known bigint"


def _group_lines(pdf: pd.DataFrame) -> pd.DataFrame:
    """Groups within each leaf of a bucket: the first line left leads, and all alike enough follow it. masked
    becomes the group's template."""
    template = np.array(pdf["masked"], dtype=object)
    leaf = pdf["leaf"].to_numpy()
    order = np.lexsort((template.astype(str), leaf))
    for at in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
        if len(at) < 2:
            continue
        tokens = [pdf["masked"].iat[i].split() for i in at]
        size = min(map(len, tokens))
        names, codes = np.unique(np.array([t for x in tokens for t in x[:size]], dtype=str), return_inverse=True)
        codes = codes.reshape(len(at), size)
        left = np.arange(len(at))
        while len(left) > 1:
            near = (codes[left] == codes[left[0]]).mean(1) >= SIMILAR
            group = left[near]
            if len(group) > 1:
                same = (codes[group] == codes[group[0]]).all(0)
                template[at[group]] = " ".join(names[c] if k else "<*>" for c, k in zip(codes[group[0]], same, strict=True))
            left = left[~near]
    return pdf.drop(columns=["masked", "b"], errors="ignore").assign(template=template)[["leaf", "template", *[c for c in pdf.columns if c not in ("leaf", "masked", "b")]]]


def line_groups(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, members, distinct): groups (leaf, t, template, BEHAVIOUR), the distinct lines (leaf, h, t) in them,
    and these lines' texts (leaf, h, masked). A leaf of many distinct lines is compared in portions, by hash;
    groups of different portions with the same template are one. h and t are hashes of line and template."""
    distinct = settle(
        lines.groupBy("leaf", "h").agg(
            F.first("masked").alias("masked"), F.count("*").alias("lines"), F.min("site").alias("low"), F.max("site").alias("high"), F.sum("share").alias("share"), F.count_if("bad").alias("bad"), F.count("bad").alias("known")
        )
    )
    sizes = distinct.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    portions = F.ceil(F.col("n") / PORTION)
    mixed = measured_join(distinct, sizes, ["leaf"], "left")
    names = [c.split()[0] for c in _MEMBERS.split(", ")]
    alone = mixed.where("n IS NULL").withColumnRenamed("masked", "template").select(*names)
    buckets = max(1, distinct.count() // PORTION)
    bucket = F.pmod(F.xxhash64("leaf", F.pmod("h", portions)), F.lit(buckets))
    grouped = mixed.where("n > 1").select("leaf", "h", "masked", *BEHAVIOUR, bucket.alias("b")).groupBy("b").applyInPandas(lambda pdf: _group_lines(pdf)[names], _MEMBERS)
    members = settle(alone.unionByName(grouped).withColumn("t", F.xxhash64("template")))
    groups = settle(members.groupBy("leaf", "t").agg(F.first("template").alias("template"), *_sums()))
    return groups, members.select("leaf", "h", "t", "lines"), distinct.select("leaf", "h", "masked")


class Features:
    """Rows of behaviour, and of hashed words and pairs of them (of scripts without blanks, pairs of letters):
    (row, place, value) of what isn't 0, each row's of length 3."""

    def __init__(self, pdf: pd.DataFrame):
        lines = pdf["lines"].to_numpy(np.float64)
        share = pdf["share"].to_numpy(np.float64) / lines
        sites = (pdf["low"].to_numpy() < pdf["high"].to_numpy()).astype(np.float64)
        bad = (pdf["bad"].to_numpy(np.float64) + 0.5) / (pdf["known"].to_numpy(np.float64) + 2)
        often = np.minimum(np.log2(lines), 4) / 4
        count = np.array([len(t.split()) for t in pdf["template"]], np.float64)
        stops = np.array([t.rstrip()[-1:] in ".!?。" for t in pdf["template"]], np.float64)
        self.known = np.stack([np.ones(len(pdf)), often, sites, share, sites * share, sites * share * often, bad, bad * share, np.minimum(count, 40) / 10, stops], 1)
        rows, places, values = [], [], []
        for i, t in enumerate(pdf["template"]):
            found = re.findall(r"<\w+>|[^\W\d_]+|[\[\]{}<>:“”\"`«»「」]", t)
            keys = found + [f"{a} {b}" for a, b in itertools.pairwise(found)]
            keys += [w[k : k + 2] for w in found if ord(w[0]) > 0x2E80 for k in range(len(w) - 1)]
            hashed = np.unique([zlib.crc32(w.encode()) % WORD_PLACES for w in keys])
            rows.append(np.full(len(hashed), i))
            places.append(hashed.astype(np.int64))
            values.append(np.full(len(hashed), 3 / np.sqrt(len(hashed) or 1)))
        self.row, self.place, self.value = (np.concatenate(x) if x else np.array([], t) for x, t in ((rows, np.int64), (places, np.int64), (values, np.float64)))

    def times(self, w: np.ndarray) -> np.ndarray:
        k = self.known.shape[1]
        return self.known @ w[:k] + np.bincount(self.row, self.value * w[k + self.place], len(self.known))

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([self.known.T @ r, np.bincount(self.place, self.value * r[self.row], WORD_PLACES)])


def fit(x: Features, y: np.ndarray, penalty: float = 0.02, steps: int = 300) -> np.ndarray:
    """Weights of a logistic regression, by accelerated gradient steps."""
    n = max(1, len(y))
    size = x.known.shape[1] + WORD_PLACES
    top = np.ones(size)
    for _ in range(12):
        top = x.back(x.times(top))
        top /= np.linalg.norm(top) or 1
    rate = 3.6 * n / (float((x.times(top) ** 2).sum()) or 1)
    w = past = np.zeros(size)
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - past)
        p = 1 / (1 + np.exp(-x.times(ahead)))
        past, w = w, ahead - rate / n * (x.back(p - y) + penalty * ahead)
    return w


def labelled() -> tuple[pd.DataFrame, np.ndarray]:
    """The labelled templates and their labels (1: message), at most LABELLED_ROWS."""
    known = pd.read_csv(Path(__file__).with_name("templates.tsv"), sep="\t", quoting=csv.QUOTE_MINIMAL, keep_default_na=False, nrows=LABELLED_ROWS)
    return known, known["label"].to_numpy(np.float64)


def fit_both(known: pd.DataFrame, y: np.ndarray) -> list[np.ndarray]:
    """Weights fitted on all rows, copies of messages as seen once included, which go by words; and without the
    copies, which go more by behaviour. What either knows is a message."""
    own = known["copy"].to_numpy() == 0
    return [fit(Features(known), y), fit(Features(known[own]), y[own])]


def score(known: pd.DataFrame, weights: list[np.ndarray]) -> np.ndarray:
    x = Features(known)
    return np.max([x.times(w) for w in weights], axis=0)


@cache
def fitted() -> list[np.ndarray]:
    return fit_both(*labelled())


def message_templates(groups: DataFrame) -> DataFrame:
    """(leaf, t, template) of the groups that are messages."""
    sent = groups.sparkSession.sparkContext.broadcast(fitted())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[score(pdf, sent.value) > 0, ["leaf", "t", "template"]] if len(pdf) else pdf[["leaf", "t", "template"]]

    # a page's frame is never a message, whatever stands beside it
    judged = groups.where(~F.col("template").rlike(f"^{_FRAME}$"))
    return judged.select("leaf", "t", "template", *BEHAVIOUR).mapInPandas(run, "leaf bigint, t bigint, template string")


def messages(lines: DataFrame) -> DataFrame:
    """(leaf, h, template, group, lines) of the distinct lines whose group is a message; template is the line as
    masked, group what its whole group shares. Settled."""
    groups, members, distinct = line_groups(lines)
    found = measured_join(members, settle(message_templates(groups)).withColumnRenamed("template", "group"), ["leaf", "t"])
    texts = measured_join(distinct, found.select("leaf", "h", "group", "lines"), ["leaf", "h"])
    return settle(texts.select("leaf", "h", F.col("masked").alias("template"), "group", "lines"))


def slot_shown(text: Column) -> Column:
    """Whether a text shows an unfilled slot or unrendered value: outside code blocks, inline code and
    lines of program text, in a sentence that doesn't explain it."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?m)^\s*```[^\n]*\n(?:(?!\s*```)[^\n]*\n)*?\s*```[^\n]*$", " ")
    bare = F.regexp_replace(bare, r"`[^`\n]+`", " ")
    sentences = F.split(bare, r"\n|(?<=[.!?。])\s+")
    code = r"^\s*(?:export |run |if: |const |let |var |function |return |import |def |class |echo |\$ )|[;{]\s*$|=>"
    shown = F.exists(sentences, lambda s: s.rlike(SLOT) & ~s.rlike(code) & ~(s.rlike(_EXPLAINS) & s.rlike(r"%[sd]|`|printf|layout")))
    value = F.exists(sentences, lambda s: s.rlike(_VALUE) & ~s.rlike(_EXPLAINS) & ~s.rlike(code))
    return F.when(text.rlike(r"[{%$@|\[<]|__|undefined|NaN"), shown | value).otherwise(F.lit(False))


def residue_records(records: DataFrame) -> DataFrame:
    """(id, slot, message) of the records (id, text) that are residue, and why.

    NULL, empty and blank texts, and titles by themselves, are none. Extra columns are ignored.
    """
    lines = record_lines(records)
    known = messages(lines).select("leaf", "h", F.lit(True).alias("message"))
    marked = measured_join(lines.select("id", "leaf", "h", "content"), known, ["leaf", "h"], "left")
    own = F.coalesce("message", F.lit(False))
    flags = marked.select("id", "leaf", own.alias("message"), (F.col("content") & ~own).alias("content"))
    by_record = flags.groupBy("id").agg(F.bool_or("message").alias("has"), F.collect_set(F.when(F.col("content"), F.col("leaf"))).alias("own"))
    some = by_record.select("id", "has", F.explode("own").alias("leaf"))
    companions = some.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("has").alias("with")).where((F.col("n") >= COMPANION_RECORDS) & (F.col("with") >= COMPANION_SHARE * F.col("n"))).select("leaf")
    suspects = by_record.where("has").select("id", F.explode_outer("own").alias("leaf"))
    rest = measured_join(suspects, companions.withColumn("companion", F.lit(True)), ["leaf"], "left").groupBy("id").agg(F.count_if(F.col("leaf").isNotNull() & F.col("companion").isNull()).alias("content"))
    found = rest.where("content = 0").select("id", F.lit(True).alias("message"))
    slots = records.where(slot_shown(F.col("text"))).select("id", F.lit(True).alias("slot"))
    both = found.join(slots, "id", "full")
    return both.select("id", F.coalesce("slot", F.lit(False)).alias("slot"), F.coalesce("message", F.lit(False)).alias("message"))


def scrape_records(scrapes: DataFrame) -> DataFrame:
    """Scrapes as records (id, text, site, bad); bad is NULL where neither status nor blocked is known."""
    bad = F.when(F.col("status_code").isNotNull() | F.col("blocked").isNotNull(), F.coalesce(F.col("status_code") >= 400, F.lit(False)) | F.coalesce("blocked", F.lit(False)))
    return scrapes.select(F.col("scrape_id").alias("id"), "text", "site", bad.alias("bad"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return residue_records(scrape_records(table(spark, base, "scrapes"))).select(F.col("id").alias("scrape_id"))


def p4_templates(spark: SparkSession, base: str) -> DataFrame:
    """The templates that are messages, with the number of their lines."""
    found = messages(record_lines(scrape_records(table(spark, base, "scrapes"))))
    return found.groupBy(F.col("group").alias("template")).agg(F.sum("lines").alias("lines"))


QUERIES = {"p4_found": p4_found, "p4_templates": p4_templates}
ORACLES: dict[str, str] = {}
