"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (``WINDOW`` consecutive words; the whole item if it is shorter) are sets of word shingles that a
document must contain in full.  Shingles are ordered by their document frequency in the corpus; as all shingles of a
window are needed, its prefix is one shingle, the rarest.  Documents are probed at the places of prefix shingles alone;
the place and both lengths bound where the window can start, and the words there are compared one by one.

Scale: two scans of the documents (frequencies, then probes), no shuffle of text.  The index of windows is broadcast in
blocks of at most ``BLOCK_WINDOWS`` rows, which come to the driver as Arrow; a full block is about 130 MB when it is probed, and
its distinct shingles (up to 64 MB) are sent alone for the frequencies: one block for usual benchmarks; more blocks are probed one after the other against all documents and their hits united
by row.  Words are compared by 64-bit hashes.

Nulls and odd input: a null or wordless text has no words and no hits, a null or wordless item has no windows; a null
item id isn't reported but its windows hit; repeated items are one item; equal rows each get a row; an empty benchmark hits
nothing, an empty table gives an empty result; very long texts are read whole (a block of bytes is never cut inside a text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 1_000_000
SLOTS = 1 << 22


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = C.LOWER[data]
    starts, ends, rows = C.words_of(data, offsets, C.ALPHANUMERIC)
    return C.word_hashes(data, starts, ends), rows


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id string, words array<long>: the distinct windows of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for first, _, data, offsets in C.utf8_blocks(batch.column("text")):
                words, rows = _words(data, offsets)
                for i in range(len(rows) - 1):
                    own = words[rows[i] : rows[i + 1]].view(np.int64)
                    n = min(window, len(own))
                    if n:
                        cuts = np.lib.stride_tricks.sliding_window_view(own, n)
                        for at in range(0, len(cuts), 50_000):
                            part = cuts[at : at + 50_000]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([ids[first + i]] * len(part), pa.string()),
                                 C.lists(part.ravel(), np.full(len(part), n), pa.int64())],
                                ["item_id", "words"],
                            )

    text = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return text.mapInArrow(cut, "item_id string, words array<long>").distinct()


class Index:
    """The windows of one block: words (n x WINDOW, 0 behind shorter ones), lengths, item numbers, prefix shingles."""

    def __init__(self, rows: pa.Table, window: int = WINDOW):
        ids, words = (rows.column(c).combine_chunks() for c in ("item_id", "words"))
        self.items = sorted(x for x in pc.unique(ids).to_pylist() if x is not None)
        found = pc.index_in(ids, pa.array(self.items, ids.type), skip_nulls=True)
        self.item = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.length = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = np.zeros((len(rows), window), np.uint64)
        self.words[np.arange(window) < self.length[:, None]] = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        flat, at, offset, self.sizes = [], [], [], sorted({min(SHINGLE, int(n)) for n in np.unique(self.length)})
        for n in np.unique(self.length):
            k, own = min(SHINGLE, int(n)), np.flatnonzero(self.length == n)
            for j in range(int(n) - k + 1):
                flat.append(_shingle(self.words[own, j : j + k].T))
                at.append(own)
                offset.append(np.full(len(own), j))
        self._flat, self._at, self._offset = (np.concatenate(x) if x else np.zeros(0, int) for x in (flat, at, offset))
        self.vocabulary = np.unique(self._flat).astype(np.uint64)

    def order(self, frequency: np.ndarray) -> None:
        """Take each window's rarest shingle (ties: the smaller hash) as its prefix."""
        f = frequency[np.searchsorted(self.vocabulary, self._flat)]
        first = np.lexsort((self._offset, self._flat, f, self._at))
        first = first[np.r_[True, np.diff(self._at[first]) > 0]] if len(first) else first
        by = first[np.argsort(self._flat[first], kind="stable")]
        self.prefix, self.window, self.offset = self._flat[by].astype(np.uint64), self._at[by], self._offset[by]
        self._flat = self._at = self._offset = self.vocabulary = None
        self.wanted = np.unique(self.prefix)
        self.filter = _slots(self.prefix)


def _shingle(columns) -> np.ndarray:
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        out = C.mix(out * np.uint64(0x9E3779B97F4A7C15) + c)
    return out


def _slots(hashes: np.ndarray) -> np.ndarray:
    table = np.zeros(SLOTS, bool)
    table[(hashes >> np.uint64(42)).astype(np.int64)] = True
    return table


def _places(words: np.ndarray, rows: np.ndarray, sizes: list[int], table: np.ndarray, wanted: np.ndarray):
    """Places and shingles (of the sizes, within their row) that are among the sorted ``wanted``."""
    for k in sizes:
        n = len(words) - k + 1
        if n <= 0 or not len(wanted):
            continue
        hashes = _shingle([words[j : j + n] for j in range(k)])
        at = np.flatnonzero(table[(hashes >> np.uint64(42)).astype(np.int64)])
        found = np.searchsorted(wanted, hashes[at])
        found[found == len(wanted)] = 0
        at = at[wanted[found] == hashes[at]]
        row = np.searchsorted(rows, at, "right") - 1
        at = at[at + k <= rows[row + 1]]
        yield at, hashes[at]


def _frequencies(docs: DataFrame, vocabulary: np.ndarray, sizes: list[int]) -> pa.Table:
    """shingle (its place in ``vocabulary``) and n, the number of documents that hold it."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        table, total = _slots(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, data, offsets in C.utf8_blocks(batch.column(0)):
                words, rows = _words(data, offsets)
                for at, hashes in _places(words, rows, sizes, table, vocabulary):
                    row = np.searchsorted(rows, at, "right") - 1
                    pairs = np.unique(row * len(total) + np.searchsorted(vocabulary, hashes))
                    total += np.bincount(pairs % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["shingle", "n"])

    counted = docs.select("text").mapInArrow(count, "shingle long, n long")
    out = counted.groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    return out


def _probe(docs: DataFrame, carry: list[str], index) -> DataFrame:
    """``carry`` of every row, n_words, disjoint hit ranges [from, to) of word numbers and the items that occur."""
    schema = docs.select(*carry).schema
    added = (("__n_words", T.LongType()), ("__from", T.ArrayType(T.IntegerType())), ("__to", T.ArrayType(T.IntegerType())), ("__items", T.ArrayType(T.StringType())))
    full = T.StructType([*schema, *(T.StructField(*a) for a in added)])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for batch in batches:
            n = batch.num_rows
            n_words, low, high, items = np.zeros(n, np.int64), [()] * n, [()] * n, [()] * n
            for first, end, data, offsets in C.utf8_blocks(batch.column("__text")):
                words, rows = _words(data, offsets)
                n_words[first:end] = np.diff(rows)
                starts, found = [], []
                for at, hashes in _places(words, rows, x.sizes, x.filter, x.wanted):
                    low_i, high_i = np.searchsorted(x.prefix, hashes, "left"), np.searchsorted(x.prefix, hashes, "right")
                    times = high_i - low_i
                    entry = np.repeat(low_i - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
                    start, w = np.repeat(at, times) - x.offset[entry], x.window[entry]
                    row = np.searchsorted(rows, np.repeat(at, times), "right") - 1
                    fits = (start >= rows[row]) & (start + x.length[w] <= rows[row + 1])
                    start, w = start[fits], w[fits]
                    for j in range(x.words.shape[1]):
                        here = x.length[w] > j
                        same = ~here
                        same[here] = words[start[here] + j] == x.words[w[here], j]
                        start, w = start[same], w[same]
                    starts.append(start)
                    found.append(w)
                if not starts or not sum(map(len, starts)):
                    continue
                start, w = np.concatenate(starts), np.concatenate(found)
                hit = np.zeros(len(words) + 1, np.int64)
                np.add.at(hit, start, 1)
                np.add.at(hit, start + x.length[w], -1)
                hit = np.cumsum(hit)[:-1] > 0
                row = np.searchsorted(rows, start, "right") - 1
                for r in np.unique(row):
                    own = np.r_[False, hit[rows[r] : rows[r + 1]], False].astype(np.int8)
                    edge = np.diff(own)
                    low[first + r], high[first + r] = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
                    numbers = np.unique(x.item[w[row == r]])
                    items[first + r] = [x.items[i] for i in numbers if i >= 0]
            kept = [batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n_words), pa.array(low, pa.list_(pa.int32())), pa.array(high, pa.list_(pa.int32())),
                 pa.array(items, pa.list_(pa.string()))],
                [*carry, "__n_words", "__from", "__to", "__items"],
            )

    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(probe, full)


def decontaminate(docs: DataFrame, benchmark: DataFrame, carry: list[str], block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Every row's ``carry`` columns with __n_words, __n_hit long, __items array<string> (sorted) and __ranges."""
    spark = docs.sparkSession
    cuts = C.settle(windows(benchmark), "windows")
    blocks = max(1, -(-cuts.count() // block_windows))
    if blocks > 1:
        docs = C.settle(docs.withColumn("__row", F.monotonically_increasing_id()), "decontamination")
    out = None
    for b in range(blocks):
        own = cuts.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b)
        index = Index(own.toArrow())
        frequency = np.zeros(len(index.vocabulary), np.int64)
        counted = _frequencies(docs, index.vocabulary, index.sizes)
        frequency[counted.column("shingle").to_numpy()] = counted.column("n").to_numpy()
        index.order(frequency)
        part = _probe(docs, carry if blocks == 1 else [*carry, "__row"], spark.sparkContext.broadcast(index))
        out = part if out is None else out.unionByName(part)
    if blocks > 1:
        out = out.groupBy("__row").agg(
            *[F.first(c).alias(c) for c in carry], F.max("__n_words").alias("__n_words"),
            F.flatten(F.collect_list("__from")).alias("__from"), F.flatten(F.collect_list("__to")).alias("__to"),
            F.flatten(F.collect_list("__items")).alias("__items"),
        ).drop("__row")
    ranges = F.array_sort(F.arrays_zip("__from", "__to"))
    merged = F.aggregate(
        ranges,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, r: F.struct(
            F.greatest(s["end"], r["__to"]).alias("end"),
            (s["n"] + F.greatest(F.lit(0), r["__to"] - F.greatest(s["end"], r["__from"]))).alias("n"),
        ),
        lambda s: s["n"],
    )
    return out.select(
        *carry, "__n_words", merged.alias("__n_hit"), F.array_sort(F.array_distinct("__items")).alias("__items"),
        ranges.alias("__ranges"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark window; columns as in ``docs``."""
    docs, names = C.renamed(docs, "text")
    columns = docs.columns
    return decontaminate(docs, benchmark, columns).filter("__n_hit = 0").select(*columns).toDF(*names)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.col("__n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, p, p + least(len(ws), 10) - 1), ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT r, n, p, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS win
  FROM (SELECT r, n, ws, unnest(range(1, CAST(len(ws) - n + 2 AS BIGINT))) AS p
        FROM w, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), m AS (SELECT r, dw.n AS n, p, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p + j) AS n_hit FROM (SELECT DISTINCT r, p, unnest(range(0, n)) AS j FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
