"""Evaluation texts leaking into training text (problem 8): an FM-index per shard of the corpus.

The alphabet is the words of the test items; any other word ends a run, and runs shorter than the shortest
phrase can't hold one and are left out. A shard's runs, joined by separators, get a suffix array (prefix
doubling in numpy), its Burrows-Wheeler transform a wavelet matrix, and every eighth suffix position is kept.
All phrases of all items (13 consecutive words, or a whole shorter item) are searched backward at once:
two ranks per word and bit for all phrases still alive. Occurrences are located by walking to the nearest
sampled position, counted per document and item, and their spans merged for removal.

Shards are independent: the corpus isn't shuffled. The test items are a stated query set; they are counted
first and searched in blocks of BLOCK_ITEMS, so what is sent to the executors is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.session import table

PHRASE_WORDS = 13
#: Words of the reduced text in one shard's index.
SHARD_WORDS = 1 << 20
BLOCK_ITEMS = 20_000
SAMPLE = 8

_WORD = re.compile(r"[^\W_]+")
_HITS = "doc_id bigint, item_id bigint, char_start int, char_end int"


def words_of(text: str) -> list[str]:
    """Maximal runs of Unicode letters and digits, in lower case."""
    low = text.lower()
    if len(low) == len(text):
        return _WORD.findall(low)
    return [w.lower() for w in _WORD.findall(text)]


class Phrases:
    """The distinct phrases of a block of items, as arrays of word numbers, by length."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = PHRASE_WORDS):
        self.vocabulary: dict[str, int] = {}
        grams: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text or "")]
            for k in range(max(1, len(ids) - size + 1)) if ids else ():
                grams.setdefault(tuple(ids[k : k + size]), []).append(item)
        by_length: dict[int, list[tuple[tuple[int, ...], list[int]]]] = {}
        for g, found in grams.items():
            by_length.setdefault(len(g), []).append((g, found))
        self.groups = [(n, np.array([g for g, _ in x], np.int64), [list(dict.fromkeys(i)) for _, i in x]) for n, x in sorted(by_length.items())]
        self.shortest = self.groups[0][0] if self.groups else 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; only suffixes whose rank is still shared are sorted again."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    first = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    k = 1
    while True:
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, n))
        open_ = np.repeat(sizes > 1, sizes)
        at = np.flatnonzero(open_)
        if not len(at) or k >= n:
            return order
        who = order[at]
        follow = who + k
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1)
        lead = rank[who]
        new = np.lexsort((second, lead))
        who, second, lead = who[new], second[new], lead[new]
        order[at] = who
        first[at] = np.concatenate([[True], (lead[1:] != lead[:-1]) | (second[1:] != second[:-1])])
        rank[who] = at[np.maximum.accumulate(np.where(first[at], np.arange(len(at)), 0))]
        k *= 2


class FMIndex:
    """Of a sequence of numbers that ends with its only 0: counts and ranks by a wavelet matrix."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n, self.bits = n, max(1, int(text.max()).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        self.levels, self.zeros = [], []
        rest = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (rest >> b) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(n - bit.sum()))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        self.marked = sa % sample == 0
        self.kept = sa[self.marked]
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.bwt = bwt

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs in the first i places of the transform."""
        start = np.zeros_like(i)
        for depth, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - depth)) & 1
            one_i, one_s = ones[i], ones[start]
            i = np.where(bit == 1, zeros + one_i, i - one_i)
            start = np.where(bit == 1, zeros + one_s, start - one_s)
        return i - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high) of the phrases that occur, as ranges of the suffix array."""
        alive = np.arange(len(phrases))
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            known = c < len(self.before) - 1
            alive, low, high, c = alive[known], low[known], high[known], c[known]
            low, high = self.before[c] + self.rank(c, low), self.before[c] + self.rank(c, high)
            left = low < high
            alive, low, high = alive[left], low[left], high[left]
            if not len(alive):
                break
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        steps = np.zeros(len(rows), np.int64)
        rows = rows.copy()
        out = np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marked[rows[todo]]
            done = todo[hit]
            out[done] = self.kept[self.mark_rank[rows[done]]] + steps[done]
            todo = todo[~hit]
            c = self.bwt[rows[todo]]
            rows[todo] = self.before[c] + self.rank(c, rows[todo])
            steps[todo] += 1
        return out % self.n


def _search_shard(docs: list[tuple[int, str]], ids: list[np.ndarray], phrases: Phrases) -> list[tuple[int, int, int, int]]:
    """Rows of _HITS for one shard."""
    lengths = np.array([len(x) for x in ids], np.int64)
    words = np.concatenate(ids)
    known = words > 0
    edge = np.ones(len(words) + 1, bool)
    edge[1:-1] = known[1:] != known[:-1]
    ends = np.cumsum(lengths)
    edge[ends[:-1]] = True
    starts = np.flatnonzero(edge[:-1])
    stops = np.flatnonzero(edge[1:]) + 1
    good = known[starts] & (stops - starts >= phrases.shortest)
    starts, stops = starts[good], stops[good]
    if not len(starts):
        return []
    # symbols: 0 ends the text, 1 ends a run, word w is w + 1
    sizes = stops - starts + 1
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    at = np.arange(total) - np.repeat(begin, sizes) + np.repeat(starts, sizes)
    text = np.where(np.arange(total) == np.repeat(begin + sizes - 1, sizes), 1, words[np.minimum(at, len(words) - 1)] + 1)
    index = FMIndex(np.append(text, 0))
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for n, grams, owners in phrases.groups:
        which, low, high = index.search(grams + 1)
        if not len(which):
            continue
        count = high - low
        rows = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        place = at[index.locate(rows)]
        doc = np.searchsorted(ends, place, side="right")
        first = place - (ends[doc] - lengths[doc])
        for d, f, w in zip(doc.tolist(), first.tolist(), np.repeat(which, count).tolist(), strict=True):
            for item in owners[w]:
                spans.setdefault((d, item), []).append((f, f + n))
    out = []
    offsets: dict[int, list[tuple[int, int]]] = {}
    for (d, item), found in spans.items():
        doc_id, whole = docs[d]
        if d not in offsets:
            offsets[d] = [m.span() for m in _WORD.finditer(whole)]
        found.sort()
        a, b = found[0]
        merged = []
        for x, y in found[1:]:
            if x <= b:
                b = max(b, y)
            else:
                merged.append((a, b))
                a, b = x, y
        merged.append((a, b))
        out += [(doc_id, item, offsets[d][x][0], offsets[d][min(y, len(offsets[d])) - 1][1]) for x, y in merged if x < len(offsets[d])]
    return out


def _search(sent, shard_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases: Phrases = sent.value
        number = phrases.vocabulary.get
        columns = [c.split()[0] for c in _HITS.split(", ")]
        docs: list[tuple[int, str]] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame(_search_shard(docs, ids, phrases), columns=columns)

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if not text:
                    continue
                numbers = np.array([number(w, 0) for w in words_of(text)], np.int64)
                if np.count_nonzero(numbers) < phrases.shortest:
                    continue
                docs.append((doc_id, text))
                ids.append(numbers)
                held += len(numbers)
                if held >= shard_words:
                    yield flush()
                    docs, ids, held = [], [], 0
        if docs:
            yield flush()

    return run


def leaked_spans(docs: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, char_start, char_end): merged spans of docs (doc_id, text) that hold 13 consecutive
    words of an item (item_id, text), or all of a shorter one. NULL texts and items without a word give none.
    """
    spark = docs.sparkSession
    blocks = -(-items.count() // block_items)
    if not blocks:
        return spark.createDataFrame([], _HITS)
    found = None
    numbered = items.select("item_id", "text", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")) if blocks > 1 else items.select("item_id", "text", F.lit(0).alias("block"))
    for b in range(blocks):
        phrases = Phrases([(r["item_id"], r["text"]) for r in numbered.where(F.col("block") == b).collect()])
        if not phrases.groups:
            continue
        hits = docs.select("doc_id", "text").where(F.length("text") > 0).mapInPandas(_search(spark.sparkContext.broadcast(phrases), shard_words), _HITS)
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], _HITS) if found is None else found


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the spans of all items cut out, overlapping ones as one."""
    cuts = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("char_start", "char_end"))).alias("cuts"))
    kept = F.aggregate(
        F.col("cuts"),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, c: F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(c["char_start"] - acc["at"], F.lit(0)))).alias("out"), F.greatest(acc["at"], c["char_end"]).alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return docs.join(cuts, "doc_id", "left").select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(kept).alias("text"))


def p8_spans(spark: SparkSession, base: str) -> DataFrame:
    return leaked_spans(table(spark, base, "documents"), table(spark, base, "eval_items"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return p8_spans(spark, base).select("doc_id", "item_id").distinct()


def p8_clean(spark: SparkSession, base: str) -> DataFrame:
    """Number of documents that leaked, and of characters removed from them."""
    docs = table(spark, base, "documents").select("doc_id", "text")
    spans = leaked_spans(docs, table(spark, base, "eval_items"))
    clean = remove_spans(docs, spans).withColumnRenamed("text", "clean")
    both = docs.join(clean, "doc_id").where(F.col("text") != F.col("clean"))
    return both.agg(F.count("*").alias("documents"), F.sum(F.length("text") - F.length("clean")).alias("removed"))


QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans, "p8_clean": p8_clean}
_W = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
ORACLES = {
    "p8_found": f"""
WITH d AS (SELECT doc_id, {_W.format('text')} AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, {_W.format('text')} AS w FROM eval_items WHERE text IS NOT NULL),
g AS (SELECT item_id, least(len(w), 13) AS n, unnest([array_to_string(w[i:i + least(len(w), 13) - 1], ' ') for i in range(1, greatest(len(w) - 12, 1) + 1)]) AS gram FROM e WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM g),
t AS (SELECT doc_id, n, unnest([array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)]) AS gram FROM d, sizes WHERE len(w) >= n)
SELECT DISTINCT doc_id, item_id FROM t JOIN g USING (n, gram)"""
}
