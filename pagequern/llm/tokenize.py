"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

Spark cuts texts into words with the tokenizer's pattern. A word that is a token takes its id from a literal
rank map: an array of small maps, indexed by the word's CRC-32, so that a lookup costs one index and a scan
of a few entries. All other words are made distinct over the corpus and encoded once. A word's bytes are cut
where two bytes meet that no token holds side by side, as no merge can cross there; on each piece an
aggregate() folds ranked merges over the array of its bytes, carrying the ranks of adjacent pairs along, so
each step is one minimum and two lookups. Where the lowest pair occurs more than once and merging it can't
make a pair of lower rank, all its occurrences merge in one step. Words of any length take this one way.
The encoded words stay in the shared folder, where the Python workers read them: all of them if their bytes, which
are added up first, are within DICTIONARY_BYTES, else those of one slice of the documents at a time, for which
the words of each slice are joined with their ids. Nothing of either passes through the driver. Only if the
folder can't be opened outside the JVM do the ids return by a join by word and another by row.

Decoding looks each id up in a literal array of byte pieces and concatenates these.
"""

from __future__ import annotations

import base64
import itertools
import json
import os
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.session import bytes_of, scratch, settle, table

TOKENIZER_DIR = os.environ.get("PAGEQUERN_TOKENIZERS", "/opt/tokenizers")
#: A worker holds the dictionary of all encoded words only up to this size.
DICTIONARY_BYTES = 64 << 20
#: A slice is the documents whose row numbers differ in so many of the last bits only.
SLICE_BITS = 14
BUCKETS = 8192

_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The tokenizer's pattern, its white space written out, since that of the JVM is ASCII only.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_NONE = 2**31 - 1


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_bpe_50k(folder: str = TOKENIZER_DIR) -> str:
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


def _bucketed(ranks: dict[str, int]) -> Column:
    """An array of maps as a literal: parsed once, when the plan is optimised."""
    parts: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for k, v in ranks.items():
        parts[zlib.crc32(k.encode()) % BUCKETS][k] = v
    return F.from_json(F.lit(json.dumps(parts)), "array<map<string,int>>")


@cache
def _word_map(path: str) -> Column:
    """Ids of whole words, by the word."""
    out = {}
    for k, v in load_ranks(path).items():
        try:
            out[k.decode()] = v
        except UnicodeDecodeError:
            continue
    return _bucketed(out)


@cache
def _piece_map(path: str) -> Column:
    """Ranks of byte pieces, each byte written as the character of its number."""
    return _bucketed({k.decode("latin-1"): v for k, v in load_ranks(path).items()})


def _look(table_: Column, key: Column) -> Column:
    return F.try_element_at(F.get(table_, F.pmod(F.crc32(key.cast("binary")), F.lit(BUCKETS)).cast("int")), key)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _flags(values: list[bool]) -> Column:
    """A literal array of 0 and 1."""
    return F.from_json(F.lit("[" + ",".join("1" if v else "0" for v in values) + "]"), "array<tinyint>")


@cache
def _neighbours(path: str) -> Column:
    """By 256 times the first byte and the second: whether any token holds the two side by side."""
    met = [False] * 65536
    for token in load_ranks(path):
        for a, b in itertools.pairwise(token):
            met[a * 256 + b] = True
    return _flags(met)


@cache
def _settled_ranks(path: str) -> Column:
    """By rank: whether every token that begins or ends with that token has a higher rank, so that merging it
    makes no pair that should have been merged before."""
    ranks = load_ranks(path)
    good = [True] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        for i in range(1, len(token)):
            for part in (token[:i], token[i:]):
                if ranks.get(part, -1) > r:
                    good[ranks[part]] = False
    return _flags(good)


def _uncrossed(letters: Column, path: str) -> Column:
    """An array of letters cut between letters that no token holds side by side."""
    table_ = _neighbours(path)
    places = F.when(F.size(letters) > 1, F.sequence(F.lit(1), F.size(letters) - 1)).otherwise(F.array().cast("array<int>"))
    cuts = F.filter(places, lambda i: F.get(table_, F.ascii(F.get(letters, i - 1)) * 256 + F.ascii(F.get(letters, i))) == 0)
    return _let(
        F.concat(F.array(F.lit(0)), cuts, F.array(F.size(letters))),
        lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda a, k: F.slice(letters, a + 1, F.get(c, k + 1) - a)),
    )


def fold_merges(word: Column, path: str) -> Column:
    """Ids of one word: the pair of lowest rank is merged, the leftmost first, until no pair has a rank."""
    # bound once: else the plan, and each copy and text of it in the driver, holds the ranks for every place of use
    return _let(_piece_map(path), lambda ranks: _folded(word, path, ranks, _settled_ranks(path)))


def _folded(word: Column, path: str, ranks: Column, settled_: Column) -> Column:
    def rank(piece: Column) -> Column:
        return F.coalesce(_look(ranks, piece), F.lit(_NONE))

    def start(letters: Column) -> Column:
        return F.struct(letters.alias("p"), F.zip_with(F.slice(letters, 1, F.size(letters) - 1), F.slice(letters, 2, F.size(letters)), lambda a, b: rank(F.concat(a, b))).alias("r"))

    def one(acc: Column, i: Column) -> Column:
        p, r, n = acc["p"], acc["r"], F.size(acc["p"])
        none = F.array().cast("array<int>")
        return _let(
            F.concat(F.get(p, i - 1), F.get(p, i)),
            lambda m: F.struct(
                F.concat(F.slice(p, F.lit(1), i - 1), F.array(m), F.slice(p, i + 2, n)).alias("p"),
                F.concat(
                    F.when(i > 1, F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0)))).otherwise(none),
                    F.when(i > 1, F.array(rank(F.concat(F.get(p, i - 2), m)))).otherwise(none),
                    F.when(i + 1 < n, F.array(rank(F.concat(m, F.get(p, i + 1))))).otherwise(none),
                    F.slice(r, i + 2, n),
                ).alias("r"),
            ),
        )

    def all_of(acc: Column, low: Column) -> Column:
        # of pairs that overlap, every second one from the left is merged
        p, r = acc["p"], acc["r"]
        marks = F.split(F.regexp_replace(F.array_join(F.transform(r, lambda x: F.when(x == low, "1").otherwise("0")), ""), "11", "1x"), "")

        def joined(c: Column, kept: Column) -> Column:
            pieces = F.transform(kept, lambda i: F.when(F.get(c, i) == "1", F.concat(F.get(p, i), F.get(p, i + 1))).otherwise(F.get(p, i)))
            beside = lambda made: F.transform(
                F.slice(kept, F.lit(2), F.size(kept)),
                lambda j, k: F.when((F.get(c, F.get(kept, k)) == "1") | F.coalesce(F.get(c, j) == "1", F.lit(False)), rank(F.concat(F.get(made, k), F.get(made, k + 1)))).otherwise(F.get(r, j - 1)),
            )
            return _let(pieces, lambda made: F.struct(made.alias("p"), beside(made).alias("r")))

        return _let(marks, lambda c: _let(F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(c, i - 1) != "1")), lambda kept: joined(c, kept)))

    def merged(acc: Column, low: Column, i: Column) -> Column:
        again = F.array_position(F.slice(acc["r"], i + 1, F.size(acc["r"])), low) > 0
        return F.when(again & (F.get(settled_, low) == 1), all_of(acc, low)).otherwise(one(acc, i))

    def step(acc: Column, _: Column) -> Column:
        return _let(F.array_min(acc["r"]), lambda low: F.when(low.isNull() | (low == _NONE), acc).otherwise(_let(F.array_position(acc["r"], low).cast("int"), lambda i: merged(acc, low, i))))

    def fold(letters: Column) -> Column:
        steps = F.when(F.size(letters) > 1, F.sequence(F.lit(1), F.size(letters) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start(letters), step, lambda acc: F.transform(acc["p"], lambda x: _look(ranks, x)))

    return _let(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda letters: F.flatten(F.transform(_uncrossed(letters, path), fold)))


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _opens(path: str) -> bool:
    """Whether what Spark wrote there is found without the JVM."""
    try:
        where, at = _opened(path)
        return where.get_file_info(at).type == pafs.FileType.Directory
    except (OSError, ValueError, NotImplementedError):
        return False


@lru_cache(maxsize=1)
def _held(path: str) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """A folder of encoded words: their numbers, where the ids of each begin, and all ids."""
    where, at = _opened(path)
    found = pq.read_table(at, columns=["word", "ids"], filesystem=where)
    lists = found.column("ids").combine_chunks()
    starts = np.asarray(lists.offsets).astype(np.int64)
    return {w: i for i, w in enumerate(found.column("word").to_pylist())}, starts - starts[0], lists.flatten().to_numpy()


def _weave(path: str, sliced: bool):
    """Puts the ids of encoded words in the places where a document's codes are NULL, a batch at a time; sliced:
    path has a folder for each slice of the documents."""

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
        if not sliced:
            yield path, batch
            return
        slices = np.asarray(batch.column("row")) >> SLICE_BITS
        ends = [0, *(np.flatnonzero(np.diff(slices)) + 1), len(slices)]
        for a, b in itertools.pairwise(ends):
            if b > a:
                yield f"{path}/slice={slices[a]}", batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder, batch in itertools.chain.from_iterable(map(parts, batches)):
            codes, unknown = batch.column("codes"), batch.column("unknown")
            values, offsets = codes.flatten(), np.asarray(codes.offsets) - codes.offsets[0].as_py()
            empty = np.asarray(values.is_null())
            coded = unknown.flatten().dictionary_encode()
            number, starts, flat = _held(folder) if len(coded) else ({}, np.zeros(1, np.int64), np.array([], np.int32))
            known = np.array([number[w] for w in coded.dictionary.to_pylist()], np.int64)[np.asarray(coded.indices)] if len(coded) else np.array([], np.int64)
            sizes = np.ones(len(values), np.int64)
            sizes[empty] = starts[known + 1] - starts[known]
            begin = np.concatenate([[0], np.cumsum(sizes)])
            source = np.arange(begin[-1])
            out = np.repeat(values.fill_null(0).to_numpy(zero_copy_only=False), sizes)
            inside = np.repeat(empty, sizes)
            shift = np.repeat(starts[known] - begin[:-1][empty], sizes[empty])
            out[inside] = flat[source[inside] + shift]
            ids = pa.ListArray.from_arrays(pa.array(begin[offsets], pa.int32()), pa.array(out, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return run


def _weave_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same for rows that bring the ids of their own words along."""
    for pdf in batches:
        out = []
        for codes, unknown, words, ids in zip(*[pdf[c] for c in ("codes", "unknown", "word", "ids")], strict=True):
            own = dict(zip(words, ids, strict=True)) if words is not None else {}
            spelled = iter(unknown)
            out.append([i for c in codes for i in ((int(c),) if c == c and c is not None else own[next(spelled)])])
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": out})


def encode_corpus(docs: DataFrame, path: str | None = None, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text): the ids of the text without special tokens, whose strings are
    ordinary text; an empty list for NULL and empty texts. Repeated doc_ids give as many rows."""
    path = path or byte_bpe_50k()
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORDS), F.lit(0))
    coded = docs.select("doc_id", words.alias("w")).select("doc_id", "w", F.transform("w", lambda w: _look(_word_map(path), w)).alias("codes"))
    # the row's number has the task's above the last 33 bits
    coded = settle(coded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "codes", F.filter("w", lambda _, i: F.get(F.col("codes"), i).isNull()).alias("unknown")))
    distinct = coded.select(F.explode(F.array_distinct("unknown")).alias("word")).groupBy("word").agg(F.lit(1).alias("one"))
    kept = scratch(spark)
    distinct.select("word", fold_merges(F.col("word"), path).alias("ids")).write.parquet(kept)
    encoded = spark.read.schema("word string, ids array<int>").parquet(kept)
    if _opens(kept):
        if whole := bytes_of(encoded) <= dictionary_bytes:
            folder = kept
        else:
            # a word is there once for each slice, so no word is hot
            asked = coded.select(F.shiftright("row", SLICE_BITS).alias("slice"), F.explode(F.array_distinct("unknown")).alias("word")).distinct()
            folder = scratch(spark)
            asked.join(encoded.hint("merge"), "word").repartition("slice").write.partitionBy("slice").parquet(folder)
        return coded.mapInArrow(_weave(folder, not whole), "doc_id bigint, ids array<int>")
    # by word and back by row; a word of a third of all documents is split by salt
    rows = coded
    asked = rows.select("row", F.explode(F.array_distinct("unknown")).alias("word")).withColumn("salt", F.pmod("row", F.lit(16)))
    copies = encoded.select("word", "ids", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(16)])).alias("salt"))
    back = asked.join(copies, ["word", "salt"]).groupBy("row").agg(F.collect_list(F.struct("word", "ids")).alias("known"))
    return rows.join(back, "row", "left").select("doc_id", "codes", "unknown", "known.word", "known.ids").mapInPandas(_weave_rows, "doc_id bigint, ids array<int>")


@cache
def _pieces(path: str) -> Column:
    ranks = load_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        pieces[v] = k.hex()
    return F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def decode_ids(ids: Column, path: str | None = None) -> Column:
    """The text of a list of ids: its pieces of bytes concatenated, then read as UTF-8."""
    pieces = _pieces(path or byte_bpe_50k())
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "UTF-8")


def p7_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode_corpus(table(spark, base, "documents").select("doc_id", "text"))


def p7_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Documents, and those whose decoded ids give the text again (NULL counts as empty)."""
    docs = table(spark, base, "documents").select("doc_id", "text")
    back = docs.join(encode_corpus(docs), "doc_id").select((decode_ids(F.col("ids")) == F.coalesce("text", F.lit(""))).alias("same"))
    return back.agg(F.count("*").alias("documents"), F.count_if("same").alias("same"))


QUERIES = {"p7_ids": p7_ids, "p7_round_trip": p7_round_trip}
ORACLES = {"p7_round_trip": "SELECT count(*) AS documents, count(*) AS same FROM documents"}
