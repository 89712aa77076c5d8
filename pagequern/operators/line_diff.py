"""Differences of two texts by line: exact lines as a multiset, then greedy pairs of similar lines."""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SIMILAR = 0.55
_DIFF = "pair bigint, kind string, previous string, current string, previous_index int, current_index int, similarity double"


def multiset_diff(pairs: DataFrame) -> DataFrame:
    """pairs (pair, previous, current: arrays of lines) -> (pair, unchanged, added, removed): equal lines are
    matched one to one, by joining on the line and its number among equals."""

    def side(name: str) -> DataFrame:
        rows = pairs.select("pair", F.posexplode(name).alias("pos", "line")).where("line <> ''")
        return rows.withColumn("k", F.row_number().over(W.partitionBy("pair", F.xxhash64("line"), "line").orderBy("pos")))

    both = side("previous").select("pair", "line", "k", F.lit(1).alias("a")).join(side("current").select("pair", "line", "k", F.lit(1).alias("b")), ["pair", "line", "k"], "full")
    return both.groupBy("pair").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("unchanged"), F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"))


def edit_distance(left: str, right: str) -> int:
    """Levenshtein distance, a whole column of the table at a time: its differences are bits of two integers
    (Myers 1999, Hyyro 2003)."""
    if not left or not right:
        return len(left) + len(right)
    every = (1 << len(left)) - 1
    top = 1 << (len(left) - 1)
    where: dict[str, int] = defaultdict(int)
    for i, x in enumerate(left):
        where[x] |= 1 << i
    up, down, distance = every, 0, len(left)
    for y in right:
        same = where.get(y, 0)
        across = (((same & up) + up) ^ up) | same
        more = down | (every & ~(across | up))
        less = up & across
        distance += bool(more & top) - bool(less & top)
        more = ((more << 1) | 1) & every
        less = (less << 1) & every
        kept = same | down
        up, down = less | (every & ~(kept | more)), more & kept
    return distance


_WORDS = re.compile(r"[^\W_]+")


def similarity(left: str, right: str) -> float:
    """The greater of 1 - edit distance / longer length and the Jaccard similarity of the words."""
    if left == right:
        return 1.0
    if not left or not right:
        return 0.0
    a, b = (set(_WORDS.findall(x.lower())) for x in (left, right))
    words = len(a & b) / len(a | b) if a and b else 0.0
    return max(words, 1 - edit_distance(left, right) / max(len(left), len(right)))


def diff_lines(previous: list[str], current: list[str]) -> list[tuple]:
    """(kind, previous, current, indexes, similarity): unchanged lines left out; each previous line in order
    takes the most similar free current line of at least SIMILAR, the earlier one at ties."""
    free: dict[str, deque[int]] = defaultdict(deque)
    for i, x in enumerate(previous):
        if x:
            free[x].append(i)
    used, fresh = set(), []
    for j, y in enumerate(current):
        if not y:
            continue
        if free[y]:
            used.add(free[y].popleft())
        else:
            fresh.append(j)
    out, taken = [], set()
    gone = [i for i, x in enumerate(previous) if x and i not in used]
    for i in gone:
        best, at = 0.0, None
        for j in fresh:
            if j in taken:
                continue
            a, b = len(previous[i]), len(current[j])
            shared = set(previous[i].lower().split()) & set(current[j].lower().split())
            if not shared and min(a, b) < SIMILAR * max(a, b):
                continue
            s = similarity(previous[i], current[j])
            if s >= SIMILAR and s > best:
                best, at = s, j
        if at is None:
            out.append(("removed", previous[i], None, i, None, None))
        else:
            taken.add(at)
            out.append(("changed", previous[i], current[at], i, at, int(best * 1000 + 0.5) / 1000))
    return out + [("added", None, current[j], None, j, None) for j in fresh if j not in taken]


def paired_diff(pairs: DataFrame) -> DataFrame:
    """pairs (pair, previous, current: arrays of lines) -> rows of added, removed and changed lines. A pair is
    one row, so its lines are at hand without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r) for p, a, b in zip(pdf["pair"], pdf["previous"], pdf["current"], strict=True) for r in diff_lines(list(a) if a is not None else [], list(b) if b is not None else [])]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _DIFF.split(", ")])
            yield out.astype({"previous_index": "Int32", "current_index": "Int32", "similarity": "Float64"})

    return pairs.select("pair", "previous", "current").mapInPandas(run, _DIFF)
