"""TF-IDF cosine ranking of text blocks, and a token index for full-text search."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A block's characters, and how far beyond them a blank line may begin and end, or a sentence end.
BLOCK_CHARS, GAP_BEGINS, GAP_ENDS, STOP_BEGINS = 512, 100, 200, 50

_GAP = re.compile(r"\n(?=[^\S\n]*(\n))")
_STOP = re.compile(r"[.!?](?=\s)")
_NO_TOKEN = re.compile(r"[^a-z0-9\s'-]", re.ASCII)


def rank_tokens(text: Column) -> Column:
    """Lower case, all but letters, digits, ' and - as blanks, tokens of more than one character."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s'-]", " "), r"\s+"), lambda t: F.length(t) > 1)


def _tokens(text: str) -> list[str]:
    return [t for t in _NO_TOKEN.sub(" ", text.lower()).split() if len(t) > 1]


def block_scores(blocks: list[str], query: dict[str, float]) -> list[float]:
    """Cosine of each block with the query (term -> share), the terms weighted by tf x (ln((n + 1) / (df + 1)) + 1)
    over these blocks. 0 for blocks without a term and where no block holds a term of the query."""
    counts = [Counter(_tokens(b)) for b in blocks]
    df: Counter[str] = Counter()
    for c in counts:
        df.update(c.keys())
    n = len(blocks) + 1
    idf = {t: math.log(n / (k + 1)) + 1 for t, k in df.items()}
    wanted = {t: share * idf[t] for t, share in query.items() if t in idf}
    size = math.sqrt(sum(w * w for w in wanted.values()))
    out = []
    for c in counts:
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        dot = sum(c[t] * idf[t] * w for t, w in wanted.items() if t in c)
        out.append(dot / (norm * size) if norm and size else 0.0)
    return out


def cosine_top(docs: DataFrame, query: str, top: int = 5, least: float = 0.0) -> DataFrame:
    """docs (doc, blocks: array of string) -> (doc, block, score, rank): the best blocks of each doc for the query.

    A document is one row, so its frequencies and norms are found in one pass, an Arrow batch at a time, and
    nothing is shuffled. An empty query gives no row, NULL blocks none; ties go to the earlier block. Rows
    that repeat a doc are ranked each by itself.
    """
    terms = _tokens(query)
    share = {t: terms.count(t) / len(terms) for t in dict.fromkeys(terms)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, blocks in zip(pdf["doc"], pdf["blocks"], strict=True):
                if blocks is None or not share:
                    continue
                scores = block_scores(["" if b is None else b for b in blocks], share)
                best = sorted((-round(x, 12), i) for i, x in enumerate(scores) if x >= least)[:top]
                rows += [(doc, i, scores[i], k) for k, (_, i) in enumerate(best, 1)]
            yield pd.DataFrame(rows, columns=["doc", "block", "score", "rank"])

    return docs.select("doc", "blocks").mapInPandas(run, "doc bigint, block int, score double, rank int")


def split_blocks(text: str, size: int = BLOCK_CHARS) -> list[tuple[int, int, str]]:
    """(start, end, trimmed text) of pieces of size characters, each drawn out to a blank line that begins
    within GAP_BEGINS characters, or else to the end of a sentence within STOP_BEGINS. A text within the size
    is one piece as it is; an empty one gives none."""
    n = len(text)
    if n <= size:
        return [(0, n, text)] if n else []
    gaps = [(m.start(), m.end(1)) for m in _GAP.finditer(text)]
    gap = np.array([g[0] for g in gaps] + [2 * n + GAP_BEGINS], np.int64)
    gap_end = np.array([g[1] for g in gaps] + [2 * n + GAP_ENDS], np.int64)
    stop = np.array([m.start() for m in _STOP.finditer(text)] + [2 * n + STOP_BEGINS], np.int64)
    edges = [0]
    while edges[-1] < n:
        due = min(edges[-1] + size, n)
        g, s = np.searchsorted(gap, due), np.searchsorted(stop, due)
        if gap[g] - due < GAP_BEGINS and gap_end[g] - due <= GAP_ENDS:
            due = int(gap[g]) + 2
        elif stop[s] - due < STOP_BEGINS:
            due = int(stop[s]) + 1
        edges.append(min(due, n))
    pieces = ((a, b, text[a:b].strip()) for a, b in itertools.pairwise(edges))
    return [p for p in pieces if p[2]]


def text_blocks(docs: DataFrame, size: int = BLOCK_CHARS) -> DataFrame:
    """docs (doc, text) -> (doc, block, start, end, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, a, b, t) for d, x in zip(pdf["doc"], pdf["text"], strict=True) for i, (a, b, t) in enumerate(split_blocks(x or "", size))]
            yield pd.DataFrame(rows, columns=["doc", "block", "start", "end", "text"])

    return docs.select("doc", "text").mapInPandas(run, "doc bigint, block int, start int, end int, text string")


def with_blocks(docs: DataFrame, size: int = BLOCK_CHARS) -> DataFrame:
    """docs (doc, text) -> (doc, blocks): the texts of split_blocks, a row a document; NULL texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf["doc"], "blocks": [[t for _, _, t in split_blocks(x or "", size)] for x in pdf["text"]]})

    return docs.select("doc", "text").mapInPandas(run, "doc bigint, blocks array<string>")


def search_tokens(docs: DataFrame, words: list[str]) -> DataFrame:
    """docs (doc, text) that hold every word (letters and digits, any case), with the words' counts."""
    token = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("token")
    wanted = [w.lower() for w in dict.fromkeys(words)]
    hits = docs.select("doc", token).where(F.col("token").isin(wanted)).groupBy("doc").agg(F.count_distinct("token").alias("kinds"), F.count("*").alias("hits"))
    return hits.where(F.col("kinds") == len(wanted)).select("doc", "hits")
