"""Splitting oversized items at natural boundaries (problem 6), by pointer doubling.

Each record's boundaries, from blank lines down to single characters, are the nodes of a graph. Every
boundary is joined to its farthest legal successor: the last boundary of the best kind such that the piece,
with the overlap repeated before it, stays within the limit. The successor table is squared until it stops
changing (s, s.s, s^4, ...), and with each squaring the set of reached cuts doubles, so all greedy cuts come
out after log2(pieces) array steps. Records are independent: no shuffle, and no state beyond one record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagequern.session import table

CHARS_PER_TOKEN = 4
MAX_TOKENS = 500
OVERLAP_TOKENS = 50

_KINDS = [re.compile(p) for p in (r"\n[^\S\n]*\n\s*", r"\n\s*", r"(?<=[.!?])\s+|(?<=[。！？])", r"\s+")]
_PIECES = "input_id bigint, chunk_index int, char_start int, char_end int, overlap_chars int, token_count int, text string"


def normal_text(text: str) -> str:
    """CRLF and CR as LF, outer white space trimmed."""
    return text.replace("\r\n", "\n").replace("\r", "\n").strip()


def _best(ends: list[np.ndarray], low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every row, the farthest end in (low, high] of the first kind that reaches least."""
    out = np.zeros(len(low), np.int64)
    open_ = np.ones(len(low), bool)
    for k, e in enumerate(ends):
        if not len(e):
            continue
        at = np.searchsorted(e, high, side="right") - 1
        found = np.where(at >= 0, e[np.maximum(at, 0)], 0)
        good = open_ & (found > low) & ((found >= least) if k + 1 < len(ends) else True)
        out[good] = found[good]
        open_ &= ~good
    return out


def greedy_cuts(text: str, max_tokens: int, overlap_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, overlaps): piece i is text[cuts[i] - overlaps[i] : cuts[i + 1]] with outer white space trimmed.

    The overlap begins after the first white space of its window, and is at most half of the limit, so that
    every piece gets on. Pieces fill at least half of the room if they end at a paragraph, line or sentence.
    """
    limit = max(1, max_tokens) * CHARS_PER_TOKEN
    overlap = min(max(0, overlap_tokens) * CHARS_PER_TOKEN, limit // 2)
    n = len(text)
    kinds = [np.unique(np.fromiter((m.end() for m in k.finditer(text)), np.int64)) for k in _KINDS]
    every = np.unique(np.concatenate([[0, n], *kinds]))
    room = max(1, (limit - overlap) // 4)
    gaps = np.flatnonzero(np.diff(every) > room)
    hard = [np.arange(every[g] + room, every[g + 1], room, dtype=np.int64) for g in gaps]
    nodes = np.unique(np.concatenate([every, *hard]))
    back = np.maximum(nodes - overlap, 0)
    if overlap:
        space = kinds[3]
        if len(space):
            at = np.minimum(np.searchsorted(space, back, side="left"), len(space) - 1)
            snap = (space[at] >= back) & (space[at] < nodes) & (back > 0)
            back = np.where(snap, space[at], back)
    high = np.minimum(back + limit, n)
    ends = [np.append(k, n) if k_ < 0 else k for k_, k in enumerate(kinds)]
    target = _best([*ends, nodes[1:]], nodes, high, nodes + (high - nodes) // 2)
    target = np.where(high >= n, n, target)
    step = np.searchsorted(nodes, target)
    step[-1] = len(nodes) - 1
    reached, jump = np.array([0]), step
    while True:
        more = np.union1d(reached, jump[reached])
        jump = jump[jump]
        if len(more) == len(reached):
            break
        reached = more
    return nodes[reached], (nodes - back)[reached]


def split_record(text: str | None, max_tokens: int | None, overlap_tokens: int | None) -> list[tuple[int, int, int, str]]:
    """(start, end, overlap, text) of the pieces of a record beyond its limit; none for any other."""
    if text is None:
        return []
    limit = MAX_TOKENS if max_tokens is None else max_tokens
    text = normal_text(text)
    if -(-len(text) // CHARS_PER_TOKEN) <= limit:
        return []
    cuts, overlaps = greedy_cuts(text, limit, OVERLAP_TOKENS if overlap_tokens is None else overlap_tokens)
    out = []
    for i in range(len(cuts) - 1):
        o = int(overlaps[i]) if i else 0
        piece = text[cuts[i] - o : cuts[i + 1]].strip()
        if piece:
            out.append((int(cuts[i]), int(cuts[i + 1]), o, piece))
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, text, most, over in zip(pdf["input_id"], pdf["markdown"], pdf["max_tokens"], pdf["overlap_tokens"], strict=True):
            for k, (a, b, o, piece) in enumerate(split_record(text, None if pd.isna(most) else int(most), None if pd.isna(over) else int(over))):
                rows.append((i, k, a, b, o, -(-len(piece) // CHARS_PER_TOKEN), piece))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECES.split(", ")])


def split_oversized(inputs: DataFrame) -> DataFrame:
    """The pieces of every record whose markdown exceeds max_tokens (500 if NULL), a token being four code
    points begun; NULL overlap counts as 50, negative ones as 0, limits below 1 as 1. NULL and blank
    markdown, and records within their limit, give no row."""
    return inputs.select("input_id", "markdown", "max_tokens", "overlap_tokens").mapInPandas(_pieces, _PIECES)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return split_oversized(table(spark, base, "chunk_inputs")).where("chunk_index = 0").select("input_id")


def p6_chunks(spark: SparkSession, base: str) -> DataFrame:
    return split_oversized(table(spark, base, "chunk_inputs"))


def p6_kept(spark: SparkSession, base: str) -> DataFrame:
    """Whether the pieces keep the rules: records cut, pieces over their limit, places between consecutive pieces
    where something but white space is left out, and pieces that aren't the text they say they are."""
    inputs = table(spark, base, "chunk_inputs").select("input_id", "markdown", F.coalesce("max_tokens", F.lit(MAX_TOKENS)).alias("most"))
    white = F.lit("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000")
    whole = F.btrim(F.regexp_replace("markdown", "\r\n?", "\n"), white)
    pieces = split_oversized(table(spark, base, "chunk_inputs")).join(inputs.select("input_id", "most", whole.alias("whole")), "input_id")
    after = F.lead("char_start").over(W.partitionBy("input_id").orderBy("chunk_index"))
    between = F.when(after > F.col("char_end"), F.btrim(F.expr("substring(whole, char_end + 1, after - char_end)"), white) != "").otherwise(F.lit(False))
    own = F.btrim(F.expr("substring(whole, char_start - overlap_chars + 1, char_end - char_start + overlap_chars)"), white)
    kept = pieces.withColumn("after", after).withColumns({"over": F.col("token_count") > F.greatest("most", F.lit(1)), "lost": between, "other": own != F.col("text")})
    return kept.agg(F.count_if(F.col("chunk_index") == 0).alias("records"), F.count_if("over").alias("over"), F.count_if("lost").alias("lost"), F.count_if("other").alias("other"))


QUERIES = {"p6_found": p6_found, "p6_chunks": p6_chunks, "p6_kept": p6_kept}
_TRIMMED = r"regexp_replace(regexp_replace(replace(replace(markdown, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^[\s\x{00A0}\x{3000}\x{2000}-\x{200A}]+', ''), '[\s\x{00A0}\x{3000}\x{2000}-\x{200A}]+$', '')"
ORACLES = {"p6_found": f"SELECT input_id FROM chunk_inputs WHERE markdown IS NOT NULL AND ceil(length({_TRIMMED}) / 4.0) > coalesce(max_tokens, 500)",
    "p6_kept": f"SELECT count(*) AS records, 0 AS over, 0 AS lost, 0 AS other FROM chunk_inputs WHERE markdown IS NOT NULL AND ceil(length({_TRIMMED}) / 4.0) > coalesce(max_tokens, 500)",
}
