"""Text cut off by field limits or broken transfers (problem 9): a backward character n-gram model.

At every place of every text the model asks what the last characters, read backward, are followed by: the
end of a line, the stop of a sentence, or more text. Contexts of several lengths are hashed, with the kind of
line they stand in, into a space of fixed size. Only contexts at some text's own end matter: they are marked in
a bitmap of that space, each partition counts what follows them in sorted batches, and the counts are summed
by slot and joined back to the ends that ask for them. A text's score is the log-odds of ending against going
on after its final context, at contexts of growing length, each smoothed by the next shorter one, without the
text's own end and those of its copies. One-line texts of a few words, mostly titles, are scored as what they
would be in a longer text, where a title's last word also comes before a stop. Texts whose score lies below
their language's threshold, the valley between the two heaps of scores, are cut, as are texts that end inside
a code block or a broken character. What was put after the cut (dots, "(more)") is taken off first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.session import measured_join, settle, table

ORDERS = (2, 3, 4, 5, 6)
#: Besides these, two contexts of shape and the last three characters without the kind of line.
CONTEXTS = len(ORDERS) + 3
#: The table has 2**TABLE_BITS slots for each context length, whatever the corpus.
TABLE_BITS = 23
#: Tokens of a line's start whose shape is looked up as a whole.
SHAPE_TOKENS = 12
#: Weight, in sightings, of the next shorter context's share when a longer one is added.
PRIOR = 12.0
#: A line's shape counts from this many sightings on.
MIN_SEEN = 12
#: The valley between cut and whole ends is looked for between these log-odds, in bins of BIN; a language's own
#: ends count beside so many of the whole corpus.
#: Closed sentences are known to be whole: no more than this share of them may lie below the valley.
VALLEY, BIN, CORPUS_ENDS, WHOLE_BELOW = (-8.0, -1.0), 0.5, 200.0, 0.01
#: A length limit is where, within NEAR characters, at least LIMIT_CUTS cut texts and LIMIT_SHARE of those of a
#: source and language end. There the threshold rises by what cuts are more likely there than elsewhere.
NEAR, LIMIT_CUTS, LIMIT_SHARE = 12, 5, 0.25
#: Ends that a title's context may have though none was seen (of n places without one, at most 3 in n are ends at
#: 95 % confidence): few sightings never make a title a cut.
UNSEEN = 3.0
#: Distinct contexts a worker holds before it hands its counts on.
HELD = 2_000_000
#: Characters of a text's end that are looked at besides its last line's start.
TAIL = 200

_MARK = re.compile(r"(?:…|\.{2,}|\[(?:…|\.\.\.|\+|\+ ?\d+ \w+|more|truncated|cut|continued)\]|\((?:…|\.\.\.|more|truncated|cut|continued|continues)\)|(?:Read|Show|See) more|Continue reading|\[truncated\])$", re.I)
#: The longest mark by itself; any number may follow each other.
MARK = 200
#: An end that closes a sentence, other than a number's point: no cut, whatever comes before it.
_CLOSED = re.compile(r"(?:[^\d\s.]|\w{4})[.!?。？！]$")
_CLOSERS = "\"'”’»)]"
_FENCE = re.compile(r"^[ \t]*(```|~~~)[ \t]*(\S*)", re.M)
_M, _GOLD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _char_table() -> np.ndarray:
    """Digits as 0, capitals as A, white space as blank, all else as it is (16 bits)."""
    out = np.arange(65536, dtype=np.uint32)
    for c in range(65536):
        x = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        if x.isdigit():
            out[c] = ord("0")
        elif x.isupper():
            out[c] = ord("A")
        elif x.isspace() and x != "\n":
            out[c] = ord(" ")
    return out


_CHARS = _char_table()


def strip_mark(text: str) -> str:
    """Without outer white space, and without what was put after a cut."""
    text = text.rstrip().rstrip("�").rstrip() if text.rstrip().endswith("�") else text.rstrip()
    while found := _MARK.search(text, max(0, len(text) - MARK)):
        text = text[: found.start()].rstrip()
    return text


def _ends_closed(text: str) -> bool:
    bare = text.rstrip(_CLOSERS)
    return bool(_CLOSED.search(bare, max(0, len(bare) - 6)))


_STOPS = np.array(sorted(map(ord, ".!?。？！")), np.uint32)
#: What follows a place.
END, STOP, ON = 0, 1, 2


def _slots(texts: list[str], short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots by context and place, END, STOP or ON of each place) over the texts' joined lines.

    After the contexts of ORDERS come two of shape, at the ends of tokens only: the line so far, its words
    reduced to their first letter's kind, up to SHAPE_TOKENS tokens (not for scripts without spaces); and, in headings and labelled lines,
    the last two tokens where the last is a capitalised word, since names are never seen often enough.
    Places without such a context have slot -1, as have line breaks.
    """
    joined = "\n" + "\n".join(texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _CHARS[np.minimum(raw, 65535)]
    n = len(codes)
    breaks = np.flatnonzero(codes == 10)
    starts, stops = breaks[:-1] + 1, breaks[1:]
    first = codes[np.minimum(starts, n - 1)]
    latin = ((first >= 97) & (first <= 122)) | (first == 65)
    kind = np.where(stops > starts, np.where(latin | (first >= 0xC0), 97, first), 0).astype(np.uint32)

    def nearest(c: int) -> np.ndarray:
        at = np.flatnonzero(codes == c)
        return np.append(at, n)[np.searchsorted(at, starts)]

    colon, blank = nearest(58), nearest(32)
    label = (colon < stops) & (colon < blank) & (colon - starts < 14) & latin
    kind = kind * np.uint32(4) + label.astype(np.uint32) * np.uint32(2)
    lengths = np.array([t.count("\n") + 1 for t in texts], np.int64)
    kind += np.repeat(short.astype(np.uint32), lengths)
    fence = (first == 96) & (codes[np.minimum(starts + 2, n - 1)] == 96) & (stops > starts + 2)
    opened = np.cumsum(fence)
    base = np.repeat((opened - fence)[np.cumsum(lengths) - lengths], lengths)
    kind[((opened - base) % 2 == 1) & ~fence] = 96 * 4 + 3
    wide = np.bincount(np.searchsorted(stops, np.flatnonzero(codes >= 0x2E80)), minlength=len(stops))[: len(stops)] > 0
    line = np.repeat(np.arange(len(starts)), stops - starts + 1)
    seed = np.zeros(n, np.uint32)
    seed[1:] = kind[line]
    follow = np.full(n, ON, np.int32)
    follow[:-1][np.isin(codes[1:], _STOPS)] = STOP
    follow[:-1][codes[1:] == 10] = END
    inside = codes != 10
    out = np.full((CONTEXTS, n), -1, np.int32)

    def slot(h: np.ndarray, order: int) -> np.ndarray:
        mixed = (h ^ (h >> np.uint32(15))) * _GOLD
        mixed ^= mixed >> np.uint32(13)
        return (mixed >> np.uint32(32 - TABLE_BITS)).astype(np.int32) + np.int32(order << TABLE_BITS)

    h = seed * _M + np.uint32(7)
    for k in range(1, max(ORDERS) + 1):
        back = np.zeros(n, np.uint32)
        if k - 1 < n:
            back[k - 1 :] = codes[: n - k + 1]
        h = (h ^ (h >> np.uint32(11))) * _M + back
        if k in ORDERS:
            out[ORDERS.index(k)] = np.where(inside, slot(h, ORDERS.index(k)), -1)

    if n > 2:
        free = (codes[2:] * _M + codes[1:-1]) * _M + codes[:-2]
        out[len(ORDERS) + 2, 2:] = np.where(inside[2:], slot(free, len(ORDERS) + 2), -1)

    letter = ((codes >= 97) & (codes <= 122)) | (codes == 65) | (codes >= 0xC0)
    group = np.where(letter, 1, np.where(codes == 48, 2, 0))
    begins = inside & (codes != 32)
    begins[1:] &= (group[1:] == 0) | (group[1:] != group[:-1])
    at = np.flatnonzero(begins)
    if len(at):
        token = np.where(letter[at], np.where(codes[at] == 65, 65, 97), codes[at]).astype(np.uint32)
        of = line[at - 1]
        new = np.ones(len(at), bool)
        new[1:] = of[1:] != of[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        index = np.arange(len(at)) - head
        count = np.bincount(of, minlength=len(starts))
        alone = np.zeros(len(starts), np.uint32)
        alone[1:] = count[:-1] == 1
        shape = np.zeros(len(at), np.uint32)
        for j in range(SHAPE_TOKENS):
            who = np.flatnonzero(index == j)
            before = alone[of[who]] + np.uint32(3) if j == 0 else shape[who - 1]
            shape[who] = (before ^ (before >> np.uint32(11))) * _M + token[who]
        # a token's last place: before the next token, line break or blank
        follows = np.zeros(n, bool)
        follows[:-1] = begins[1:] | ~inside[1:] | (codes[1:] == 32)
        last = np.append(at[1:], n)
        stop = np.flatnonzero(follows & inside & (codes != 32))
        close = stop[np.searchsorted(stop, at)]
        good = (close < last) & (index < SHAPE_TOKENS) & ~wide[of]
        out[len(ORDERS), close[good]] = slot(shape[good], len(ORDERS))
        tail = np.zeros(len(at), np.uint32)
        tail[1:] = token[:-1]
        named = (close < last) & (token == 65) & (index > 1) & (label[of] | (first[of] == 35))
        out[len(ORDERS) + 1, close[named]] = slot((kind[of[named]] * _M + tail[named]) * _M + np.uint32(5), len(ORDERS) + 1)
    return out, follow


def _short(texts: list[str]) -> np.ndarray:
    """Texts of one line of at most 60 characters: mostly names and titles by themselves. Their lines are
    counted apart from those of longer texts."""
    return np.array([len(t) <= 60 and "\n" not in t for t in texts], bool)


def _open_fence(text: str) -> bool:
    """Whether the text ends inside a fenced code block: a block closes with its own kind of fence, and a
    fence that names a language opens one."""
    inside = ""
    for m in _FENCE.finditer(text):
        kind = m.group(1)
        inside = kind if m.group(2) else "" if inside == kind else inside or kind
    return bool(inside)


def _tail(text: str) -> str:
    """The last lines, with an opening fence before them if they start inside a code block."""
    start = text.rfind("\n", 0, max(0, len(text) - TAIL)) + 1
    return ("```\n" if _open_fence(text[:start]) else "") + text[start:]


_TAILS = "row bigint, doc_id bigint, h bigint, lang string, source string, slots array<int>, fence boolean, broken boolean, marked boolean, closed boolean, title boolean, word boolean, chars int"


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _TAILS.split(", ")]
    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 33
    for batch in batches:
        whole = [t or "" for t in batch.column("text").to_pylist()]
        texts = [strip_mark(t) for t in whole]
        marked = [bool(t) and len(t) < len(w.rstrip()) for t, w in zip(texts, whole, strict=True)]
        short = _short(texts)
        cut = [_tail(t) for t in texts]
        slots, _ = _slots(cut, np.zeros(len(cut), bool))
        last = np.maximum(np.cumsum(np.array([len(t) + 1 for t in cut], np.int64)) - 1, 0)
        rows = slots[:, last].T.copy()
        columns = [
            pa.array(np.arange(row, row + len(texts))),
            batch.column("doc_id"),
            batch.column("h"),
            batch.column("lang"),
            batch.column("source"),
            pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), CONTEXTS).cast(pa.list_(pa.int32())),
            pa.array([_open_fence(t) for t in texts]),
            pa.array([w.rstrip().endswith("�") for w in whole]),
            pa.array(marked),
            pa.array([not m and _ends_closed(t) for t, m in zip(texts, marked, strict=True)]),
            pa.array(short),
            pa.array([bool(s) and len(t.split()) < 2 for s, t in zip(short, texts, strict=True)]),
            pa.array([len(w) for w in whole], pa.int32()),
        ]
        row += len(texts)
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _asked(tails: DataFrame) -> np.ndarray:
    """The slots that some end asks about, as a bitmap of the whole space: of fixed size, whatever the corpus."""
    slot = tails.select(F.explode(F.transform("slots", lambda s: s + 1)).alias("s")).where("s > 0")
    found = slot.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    out = np.zeros((CONTEXTS << TABLE_BITS) // 8, np.uint8)
    for r in found.toLocalIterator():
        piece = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["b"] - 1) * len(piece) : r["b"] * len(piece)] = piece
    return out


def _totals(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs (or its weights' sum)."""
    order = None if weights is None else np.argsort(keys, kind="stable")
    keys = np.sort(keys) if order is None else keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([], np.int64)
    if order is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else np.array([], np.int64)


def _counts(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: np.ndarray = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def handed() -> pa.RecordBatch:
            keys, n = _totals(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys >> 2, pa.int32()), pa.array(keys & 3, pa.int32()), pa.array(n, pa.int64())], names=["slot", "follow", "n"])

        def counted(group: list[str]) -> None:
            slots, follow = _slots(group, _short(group))
            keys = []
            for of_context in slots:
                real = of_context >= 0
                s, f = of_context[real], follow[real]
                hit = (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
                keys.append(s[hit] * 4 + f[hit])
            held.append(_totals(np.concatenate(keys)))

        for batch in batches:
            group: list[str] = []
            size = 0
            for t in batch.column("text").to_pylist():
                t = strip_mark(t) if t else ""
                if t:
                    group.append(t)
                    size += len(t)
                if size > 300_000:
                    counted(group)
                    group, size = [], 0
            if group:
                counted(group)
            if sum(len(k) for k, _ in held) > HELD:
                yield handed()
        if held:
            yield handed()

    return run


_SCORED = "row bigint, score double"


def _scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scores of rows with their contexts' counts, context by context: END, STOP, ON; -1 where there is none."""
    for pdf in batches:
        n = np.stack(pdf["n"].to_list()).astype(np.float64).reshape(-1, CONTEXTS, 3) if len(pdf) else np.zeros((0, CONTEXTS, 3))
        has = n[:, :, END] >= 0
        title = pdf["title"].to_numpy(bool)
        # the end of a title stands in longer texts before a stop too; any other has its own and its copies' end
        ends = np.where(title[:, None], n[:, :, END] + n[:, :, STOP] + UNSEEN, n[:, :, END] - pdf["copies"].to_numpy(np.float64)[:, None])
        goes = np.where(title[:, None], n[:, :, ON], n[:, :, ON] + n[:, :, STOP])
        ends, goes = np.where(has, np.maximum(ends, 0), 0), np.where(has, goes, 0)
        share = np.full(len(pdf), 0.02)
        for k in (len(ORDERS) + 2, *range(len(ORDERS))):
            share = (ends[:, k] + PRIOR * share) / (ends[:, k] + goes[:, k] + PRIOR)
        share = np.clip(share, 1e-7, 1 - 1e-7)
        score = np.log(share) - np.log(1 - share)
        for k in (len(ORDERS), len(ORDERS) + 1):
            odds = np.log(ends[:, k] + 1e-3) - np.log(goes[:, k] + 1e-3)
            score = np.where(has[:, k] & (ends[:, k] + goes[:, k] >= MIN_SEEN), np.maximum(score, odds), score)
        yield pd.DataFrame({"row": pdf["row"], "score": score})


def end_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, score, fence, broken, marked, closed, title, word, chars, copies) of docs
    (doc_id, text, lang, source), a row for each of its rows; title: a line of at most 60 characters by
    itself; word: a single word by itself. Settled."""
    spark = docs.sparkSession
    tails = settle(docs.select("doc_id", F.xxhash64("text").alias("h"), "lang", "source", "text").mapInArrow(_tails, _TAILS))
    bits = spark.sparkContext.broadcast(_asked(tails))
    counted = docs.select("text").where(F.length("text") > 0).mapInArrow(_counts(bits), "slot int, follow int, n bigint")
    by_follow = [F.sum(F.when(F.col("follow") == f, F.col("n")).otherwise(0)).cast("bigint") for f in (END, STOP, ON)]
    model = settle(counted.groupBy("slot").agg(F.array(*by_follow).alias("n")))
    asked = tails.select("row", F.posexplode("slots").alias("k", "slot")).where("slot >= 0")
    none = F.array(F.lit(-1), F.lit(-1), F.lit(-1)).cast("array<bigint>")
    nothing = F.array(F.lit(0), F.lit(0), F.lit(0)).cast("array<bigint>")
    by_row = measured_join(asked, model, ["slot"], "left").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("k", F.coalesce("n", nothing).alias("n")))).alias("m"))
    counts = by_row.select("row", F.flatten(F.array(*[F.coalesce(F.try_element_at("m", F.lit(k)), none) for k in range(CONTEXTS)])).alias("n"))
    copies = tails.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1")
    facts = measured_join(tails.drop("slots"), copies, ["h"], "left").withColumn("copies", F.coalesce("copies", F.lit(1))).drop("h")
    scored = counts.join(facts.select("row", "title", "copies"), "row").mapInPandas(_scores, _SCORED)
    return settle(facts.join(scored, "row", "left").drop("row"))


def _of_group(*columns: str) -> list[Column]:
    """The columns as keys to join by, with NULL as a value of its own."""
    return [F.coalesce(F.col(c), F.lit("\x00")).alias(f"{c}_") for c in columns]


def thresholds(scores: DataFrame) -> DataFrame:
    """(lang_, threshold, odds): the log-odds in the middle of the emptiest bin between a language's cut and whole
    ends, and the odds of an end below it. Each language's bins, smoothed by their neighbours, count beside
    CORPUS_ENDS ends spread like all of the corpus, so that a rare language takes the corpus's threshold."""
    low, high = VALLEY
    bins = round((high - low) / BIN)
    ends = scores.where(F.col("score").isNotNull() & ~F.col("title")).select(*_of_group("lang"), "score", "closed")
    place = F.floor((F.col("score") - low) / BIN)
    by_lang = settle(ends.groupBy("lang_").agg(F.count("*").alias("all"), F.array(*[F.count_if(place == k) for k in range(bins)]).alias("n"), F.array(*[F.count_if(place < k) for k in range(bins)]).alias("below"), F.array(*[F.count_if(F.col("closed") & (place <= k)) for k in range(bins)]).alias("low"), F.count_if("closed").alias("closed")))
    total = by_lang.agg(F.sum("all").alias("all"), *[F.sum(F.get("n", F.lit(k))).alias(f"n{k}") for k in range(bins)], *[F.sum(F.get("below", F.lit(k))).alias(f"b{k}") for k in range(bins)], *[F.sum(F.get("low", F.lit(k))).alias(f"c{k}") for k in range(bins)], F.sum("closed").alias("closed")).first()
    whole = float(total["all"] or 1)

    def beside(name: str, prefix: str) -> Column:
        return F.zip_with(name, F.array(*[F.lit(CORPUS_ENDS * (total[f"{prefix}{k}"] or 0) / whole) for k in range(bins)]), lambda a, b: a + b)

    smooth = F.transform("m", lambda x, i: x * 2 + F.coalesce(F.get("m", i - 1), x) + F.coalesce(F.get("m", i + 1), x))
    # the emptiest bin with some end below it, below all but WHOLE_BELOW of the closed ends; of the
    # uppermost bins in a row that are as empty the middle one, and if there is none such, the lowest
    found = by_lang.withColumn("m", beside("n", "n")).withColumn("m", smooth).withColumn("u", beside("below", "b")).withColumn("c", beside("low", "c"))
    most = WHOLE_BELOW * (F.col("closed") + CORPUS_ENDS * (total["closed"] or 0) / whole)
    inner = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: (F.get("u", i) > 0) & (F.get("c", i) <= most))
    least = F.array_min(F.transform(inner, lambda i: F.get("m", i)))
    tied = F.filter(inner, lambda i: F.get("m", i) == least)
    emptiest = F.filter(tied, lambda i, k: F.array_max(tied) - i == F.size(tied) - 1 - k)
    found = found.withColumn("at", F.coalesce(F.get(emptiest, F.floor(F.size(emptiest) / 2).cast("int")), F.lit(0)))
    share = (F.get("u", F.col("at")) + 1) / (F.col("all") + CORPUS_ENDS + 2)
    return found.select("lang_", (F.col("at") * BIN + low + BIN / 2).alias("threshold"), (share / (1 - share)).alias("odds"))


def cut_texts(docs: DataFrame) -> DataFrame:
    """end_scores with model (what the score alone says) and cut: a text ends inside a sentence, word, code
    block or character.

    NULL, empty and blank texts are never cut. A text that is a single word is cut only by an open code block or
    a broken last character: no context tells part of a word from a name. A closed sentence is whole. NULL
    languages and sources form groups of their own.
    """
    scores = end_scores(docs)
    keyed = scores.select("*", *_of_group("lang", "source"))
    keyed = settle(measured_join(keyed, thresholds(scores), ["lang_"], "left"))
    open_ = ~F.col("closed") & ~F.col("word")
    plain = F.col("fence") | F.col("broken")
    low = F.coalesce(F.col("score") < F.col("threshold"), F.lit(False))
    sure = plain | (open_ & low)
    band = F.floor(F.col("chars") / NEAR).alias("band")
    bands = keyed.where(sure).groupBy("lang_", "source_", band).agg(F.count("*").alias("n"), F.max("chars").alias("limit"))
    best = bands.groupBy("lang_", "source_").agg(F.max(F.struct("n", "limit")).alias("m"), F.sum("n").alias("all"))
    limits = best.where((F.col("m.n") >= LIMIT_CUTS) & (F.col("m.n") >= LIMIT_SHARE * F.col("all"))).select("lang_", "source_", F.col("m.limit").alias("limit"))
    near = F.coalesce(F.abs(F.col("chars") - F.col("limit")) <= NEAR, F.lit(False))
    known = measured_join(keyed, limits, ["lang_", "source_"], "left").withColumn("near", near)
    there = known.where("near").groupBy("lang_", "source_").agg(((F.count_if(sure) + 1) / (F.count_if(~sure) + 1)).alias("odds_there"))
    known = measured_join(known, there, ["lang_", "source_"], "left")
    rise = F.when(F.col("near"), F.greatest(F.lit(0.0), F.log(F.col("odds_there") / F.col("odds")))).otherwise(0.0)
    model = F.coalesce(F.col("score") < F.col("threshold") + rise, F.lit(False))
    return known.select(*scores.columns, "threshold", model.alias("model"), (plain | (open_ & model)).alias("cut"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return cut_texts(table(spark, base, "documents")).where("cut").select("doc_id")


def p9_by_source(spark: SparkSession, base: str) -> DataFrame:
    """Of each source, its records and the share that is cut."""
    return cut_texts(table(spark, base, "documents")).groupBy("source").agg(F.count("*").alias("records"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"))


QUERIES = {"p9_found": p9_found, "p9_by_source": p9_by_source}
ORACLES: dict[str, str] = {}
