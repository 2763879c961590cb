"""Importance resampling towards a target distribution, by bit-sliced aggregation.

Features are runs of 1 to ``LONGEST`` words; a feature's bucket is its CRC-32 modulo ``BUCKETS``.  The gain of a bucket is the
logarithm of how much likelier the target's texts are to hold it than the documents, in whole thousandths.  A document's
weight is the sum of its features' gains; Gumbel noise of a hash of its id is added, and the greatest sums are drawn, which is
a draw without replacement in proportion to exp(weight / 1000).

The weights are exact integers: a document's bucket counts are cut into bit planes of ``BUCKETS`` bits (plane p holds bit p of
every count), the gains into planes of their positive and of their negative parts; the popcount of the AND of a count plane p
and a gain plane q counts 2 ** (p + q).  The sum over all planes is the dot product.

CRCs of runs are put together from those of their words: a CRC over GF(2) is linear, so that of "a b" is that of "a " moved on by
the length of b, exclusive-or that of b.  No feature's bytes are ever built.

Scale: two passes over the texts.  The first leaves ``BUCKETS`` sums a task (all that is shuffled, and ``BUCKETS`` sums for the driver,
whatever the corpus); the second is row by row, and the planes of the gains go along with it (some 40 KB).  Ranks are by ranges
of (score, id), counts and offsets; texts aren't shuffled.  A text's counts are as large as ``BUCKETS``, whatever its length.

Nulls and odd input: a null text has no words (weight 0, never drawn); a null doc_id is hashed as an empty one and is
the last of its ties; repeated rows are ranked one after the other; long texts are read whole; an empty table gives an empty result;
without target texts (or documents) the counts of that side are zero; further columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import dense_index
from . import common as C

BUCKETS = 10_000
LONGEST = 3
SEED = 42
#: Of a hundred documents with at least ``LEAST_WORDS`` words so many are drawn.
PERCENT = 5
LEAST_WORDS = 20
#: Documents whose counts are cut into planes at once.
STEP_ROWS = 32
#: Words up to this length are hashed together and moved by tables; longer ones one by one.
TABLE_BYTES = 64

U32 = np.uint32
#: Bytes of one plane, in whole 64-bit words.
PLANE_BYTES = -(-BUCKETS // 64) * 8


def _crc_table() -> np.ndarray:
    """The 256 CRCs of one byte, from the reflected polynomial."""
    c = np.arange(256, dtype=U32)
    for _ in range(8):
        c = np.where(c & U32(1), U32(0xEDB88320) ^ (c >> U32(1)), c >> U32(1))
    return c


_BYTE = _crc_table()


def _after_zeros(table: np.ndarray) -> np.ndarray:
    return _BYTE[table & U32(255)] ^ (table >> U32(8))


def _moves() -> np.ndarray:
    """[n, j, v]: the value v in byte j of a CRC, moved on by n zero bytes."""
    now = np.arange(256, dtype=U32)[None, :] << (U32(8) * np.arange(4, dtype=U32))[:, None]
    out = [now]
    for _ in range(TABLE_BYTES):
        out.append(_after_zeros(out[-1]))
    return np.stack(out)


_MOVE = _moves()


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRCs under one linear map, given as what it makes of every byte in every place."""
    out = table[0][crc & U32(255)]
    for j in (1, 2, 3):
        out = out ^ table[j][(crc >> U32(8 * j)) & U32(255)]
    return out


def _moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each CRC moved on by its number of bytes."""
    short = np.minimum(by, TABLE_BYTES)
    out = _MOVE[short, 0, crc & U32(255)]
    for j in (1, 2, 3):
        out ^= _MOVE[short, j, (crc >> U32(8 * j)) & U32(255)]
    rest = by - short
    table = _MOVE[1]
    while (rest > 0).any():  # by powers of two
        odd = (rest & 1) > 0
        out[odd] = _through(table, out[odd])
        rest, table = rest >> 1, _through(table, table)
    return out


def _followed(crc: np.ndarray, byte: int) -> np.ndarray:
    """CRCs with one more byte."""
    raw = ~crc
    return ~(_BYTE[(raw ^ U32(byte)) & U32(255)] ^ (raw >> U32(8)))


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every word's bytes."""
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, TABLE_BYTES + 1), kind="stable")
    n_long = int((lengths > TABLE_BYTES).sum())
    raw = np.full(len(starts), U32(0xFFFFFFFF))
    at, size = starts[order[n_long:]], lengths[order[n_long:]]
    state = raw[n_long:]
    for k in range(int(size.max(initial=0))):
        left = int(np.searchsorted(-size, -k, "left"))  # words longer than k come first
        state[:left] = _BYTE[(state[:left] ^ data[at[:left] + k]) & U32(255)] ^ (state[:left] >> U32(8))
    out = np.empty(len(starts), U32)
    out[order[n_long:]] = ~state
    for i in order[:n_long]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each feature, its bucket, words of each row) of the texts in ``data``."""
    lower = C.LOWER[data]
    starts, ends, rows = C.words_of(lower, offsets, C.ALPHANUMERIC)
    n_words = np.diff(rows)
    crc, length = word_crcs(lower, starts, ends), ends - starts
    row = np.repeat(np.arange(len(n_words)), n_words)
    run, kept_rows, kept = crc, [row], [crc]
    for n in range(2, LONGEST + 1):
        m = max(len(crc) - n + 1, 0)
        run = _moved(_followed(run[:m], 0x20), length[n - 1 :][:m]) ^ crc[n - 1 :][:m]
        whole = row[:m] == row[n - 1 :][:m]
        kept_rows.append(row[:m][whole])
        kept.append(run[whole])
    return np.concatenate(kept_rows), (np.concatenate(kept) % U32(BUCKETS)).astype(np.int64), n_words


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all of ``texts`` (text): an array of ``BUCKETS`` sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in C.utf8_blocks(batch.column("text")):
                total += np.bincount(features(data, offsets)[1], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths, rounded down."""
    s, t = documents.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def planes(values: np.ndarray) -> list[np.ndarray]:
    """The bit planes of rows of ``BUCKETS`` numbers from 0: for each bit, one row of packed 64-bit words a row."""
    out = []
    for p in range(int(values.max(initial=0)).bit_length()):
        packed = np.packbits((values >> p & 1).astype(np.uint8), axis=1)
        out.append(np.pad(packed, ((0, 0), (0, PLANE_BYTES - packed.shape[1]))).view(np.uint64))
    return out


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planes, signed power of two of each) of the positive and of the negative gains."""
    found, worth = [], []
    for sign in (1, -1):
        for q, plane in enumerate(planes(np.maximum(sign * gain, 0)[None, :])):
            found.append(plane[0])
            worth.append(sign << q)
    return np.array(found, np.uint64).reshape(-1, PLANE_BYTES // 8), np.array(worth, np.int64)


def dot(counts: np.ndarray, gain: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each row of counts the sum of count * gain, by popcounts of ANDs of planes."""
    cut, worth = gain
    out = np.zeros(len(counts), np.int64)
    for p, plane in enumerate(planes(counts)):
        for q in range(len(worth)):
            out += np.bitwise_count(plane & cut[q]).sum(1, dtype=np.int64) * (worth[q] << p)
    return out


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row of ``docs`` (doc_id, text)."""
    cut = gain_planes(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in C.utf8_blocks(batch.column("text")):
                row, bucket, n_words = features(data, offsets)
                order = np.argsort(row, kind="stable")
                row, bucket = row[order], bucket[order]
                n_features = np.bincount(row, minlength=end - first)
                weight = np.zeros(end - first, np.int64)
                for at in range(0, end - first, STEP_ROWS):
                    to = min(at + STEP_ROWS, end - first)
                    a, b = np.searchsorted(row, [at, to])
                    counts = np.bincount((row[a:b] - at) * BUCKETS + bucket[a:b], minlength=(to - at) * BUCKETS)
                    weight[at:to] = dot(counts.astype(np.min_scalar_type(counts.max())).reshape(to - at, BUCKETS), cut)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:end], pa.array(n_words.astype(np.int64)), pa.array(n_features.astype(np.int64)), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of the id, in thousandths, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1; null for what isn't drawn) for every row of ``docs`` (doc_id, text)."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = C.settle(weights(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    can = rows.filter(F.col("n_words") >= LEAST_WORDS)
    drawn = percent * can.count() // 100
    order = F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("last"), "doc_id", "n_features", "weight")
    placed = dense_index(can.withColumn("order", order), "order", "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank")
    out = ["doc_id", "n_features", "weight", "score"]
    rest = rows.filter(F.col("n_words") < LEAST_WORDS).select(*out, F.lit(None).cast("long").alias("rank"))
    return placed.select(*out, rank).unionByName(rest)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 goes by half bytes (a table of 16), the low half first.
OP11_SQL = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(16)) AS BIGINT) AS i))
), d AS (
  SELECT row_number() OVER () AS r, 'd' AS side, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT 0 AS r, 'b' AS side, NULL AS doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark
), texts AS (SELECT * FROM d UNION ALL SELECT * FROM b),
runs AS (
  SELECT side, r, array_to_string(list_slice(w, p, p + n - 1), ' ') AS f
  FROM (SELECT side, r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS p FROM texts, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)
), counted AS (SELECT side, r, f, count(*) AS k FROM runs GROUP BY ALL),
names AS (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           list_transform(range(CAST(length(hex(f)) AS BIGINT)), lambda i: CAST(strpos('0123456789ABCDEF', substr(hex(f), i + 2 - 2 * (i % 2), 1)) - 1 AS BIGINT))),
           lambda c, h: xor(c >> 4, t[(xor(c, h) & 15) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), crc
), found AS (SELECT side, r, bucket, sum(k) AS k FROM counted JOIN names USING (f) GROUP BY ALL),
s AS (SELECT bucket, sum(k) AS s FROM found WHERE side = 'd' GROUP BY bucket),
t AS (SELECT bucket, sum(k) AS t FROM found WHERE side = 'b' GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
gain AS (
  SELECT bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS g
  FROM s LEFT JOIN t USING (bucket), totals
), weighed AS (
  SELECT r, sum(k) AS n, CAST(sum(CAST(k AS BIGINT) * CAST(g AS BIGINT)) AS BIGINT) AS weight FROM found JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed USING (r)
), ranked AS (
  SELECT *, n_words >= 20 AS can, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
         count(*) FILTER (WHERE n_words >= 20) OVER () AS n_all FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN can AND place <= 5 * n_all // 100 THEN place END AS rank FROM ranked
"""
