"""Substring dedup by level-wise doubling.

A window of ``WINDOW`` words can be repeated only if the shorter runs in it are.  Level one looks at runs of ``SHORTEST`` words, of
which each text puts forward the locally minimal ones by hash (any ``WINDOW`` words hold at least one of them, in every text
alike).  Those found in more than one text survive.  Each further level doubles the length: the runs of twice the length that hold
a survivor are the candidates, of which again those survive that are found in more than one text, until no candidates survive or
the length is ``WINDOW`` (longer repeats are unions of such windows).  A word goes if it is covered by a window that also starts
in a document with a smaller doc_id.

Scale: equal texts are one text, owned by its smallest doc_id, before anything else is shuffled (combined map-side; the copies'
rows need no windows).  Level one shuffles about 2 / (WINDOW - SHORTEST + 2) of the places, later levels those around survivors;
text is shuffled once (by text and document, so groups of copies spread) and later only that with survivors.  Texts are told
apart by 128 bits of md5, windows by 128 bits at the last level (64 at those before, where a clash only adds a candidate).
With ``SHORTEST`` at 25 there are two levels; starting at 13 gives the same result by three, and more candidates on the way.

Nulls and odd input: a null text has no words; texts of fewer words than a window keep all; a null doc_id counts as
larger than any and never as smaller; rows with equal doc_id keep what they share; long texts are never cut; an empty table gives
an empty result; further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 50
SHORTEST = 25
EMPTY = hashlib.sha256(b"").hexdigest()
#: Stands for a null doc_id where the smallest is asked for.
NO_ID = (1 << 63) - 1


def levels(shortest: int, window: int) -> list[int]:
    """``shortest``, doubled until it is ``window``."""
    out = [min(shortest, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _anchors(words: np.ndarray, rows: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (and hashes) of the runs of ``length`` words that are minimal within some window; for rows of a window at least."""
    hashes = C.window_hashes(words, length)
    if not len(hashes):
        return np.zeros(0, np.int64), hashes
    ok = C.within_rows(rows, length, len(words))
    span = window - length + 1
    masked = np.where(ok, hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
    n = len(masked) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), masked[:0]
    least, width = masked, 1  # sliding minimum over span places, by doubling
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    # A place is chosen if the largest minimum of the windows that hold it is its own hash.
    floor = np.zeros(len(masked), np.uint64)
    floor[:n] = np.where(C.within_rows(rows, window, len(words)), least, np.uint64(0))
    top, width = np.r_[np.zeros(span - 1, np.uint64), floor], 1
    while width * 2 <= span:
        top = np.maximum(top[: len(top) - width], top[width:])
        width *= 2
    top = np.maximum(top[: len(masked)], top[span - width : span - width + len(masked)])
    chosen = ok & (top == hashes)
    at = np.flatnonzero(chosen)
    return at, hashes[at]


def digests(docs: DataFrame, length: int, window: int) -> DataFrame:
    """doc_id, text_id (md5), n_words, sha256 of all words joined, anchors: hashes and places of level one."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in C.utf8_blocks(batch.column("text")):
                starts, ends, rows = C.words_of(data, offsets, C.NOT_SPACE)
                words = C.word_hashes(data, starts, ends)
                at, hashes = _anchors(words, rows, length, window)
                row = np.searchsorted(rows, at, "right") - 1
                counts = np.bincount(row, minlength=end - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:end], batch.column("text_id")[first:end], pa.array(np.diff(rows)),
                     pa.array([hashlib.sha256(x).digest() for x in _joined(data, offsets, starts, ends, rows)], pa.binary()),
                     C.lists(hashes.view(np.int64), counts, pa.int64()), C.lists((at - rows[row]).astype(np.int32), counts, pa.int32())],
                    ["doc_id", "text_id", "n_words", "sha", "hashes", "places"],
                )

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("text_id"), "text")
    return text.mapInArrow(digest, "doc_id long, text_id binary, n_words long, sha binary, hashes array<long>, places array<int>")


def _joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, kept=None) -> Iterator[bytes]:
    """The (kept) words of each row, joined by one space."""
    for i in range(len(rows) - 1):
        s, e = starts[rows[i] : rows[i + 1]], ends[rows[i] : rows[i + 1]]
        if kept is not None:
            own = kept[rows[i] : rows[i + 1]]
            s, e = s[own], e[own]
        if not len(s):
            yield b""
            continue
        base = offsets[i]
        here = np.zeros(offsets[i + 1] - base + 1, np.int8)
        here[s - base] += 1
        here[e - base] -= 1
        mask = np.cumsum(here[:-1], dtype=np.int8).view(bool)
        body = data[base : offsets[i + 1]]
        # A word's end is followed by white space or by a removed word; one space takes its place.
        out = np.full(int((e - s).sum()) + len(s) - 1, 0x20, np.uint8)
        lengths = e - s
        gaps = np.zeros(len(out), bool)
        gaps[np.cumsum(lengths[:-1]) + np.arange(len(s) - 1)] = True
        out[~gaps] = body[mask]
        yield out.tobytes()


def _around(rows: np.ndarray, at: np.ndarray, row: np.ndarray, shorter: int, length: int, n: int) -> np.ndarray:
    """For each place, whether a run of ``length`` words from there lies in its row and holds a survivor of ``shorter`` words.

    ``at`` are the survivors' places in their ``row``.
    """
    near = np.zeros(n + length + 1, np.int32)
    own = at + rows[row]
    np.add.at(near, np.maximum(own - (length - shorter), 0), 1)
    np.add.at(near, own + 1, -1)
    return (np.cumsum(near)[: max(n - length + 1, 0)] > 0) & C.within_rows(rows, length, n)


def _candidates(found: DataFrame, shorter: int, length: int, wide: bool, places: str = "places") -> DataFrame:
    """row, owner, h, h2, at: the runs of ``length`` words around surviving ones; h2 is 0 unless ``wide``."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(places)
            flat, sizes = own.flatten().to_numpy(zero_copy_only=False), np.diff(own.offsets.to_numpy())
            upto = np.r_[0, np.cumsum(sizes)]
            for first, end, data, offsets in C.utf8_blocks(batch.column("text")):
                starts, ends, rows = C.words_of(data, offsets, C.NOT_SPACE)
                words = C.word_hashes(data, starts, ends)
                here = np.repeat(np.arange(end - first), sizes[first:end])
                at = np.flatnonzero(_around(rows, flat[upto[first] : upto[end]], here, shorter, length, len(words)))
                if not len(at):
                    continue
                row = np.searchsorted(rows, at, "right") - 1
                take = pa.array(row + first)
                second = C.window_hashes(C.mix(words ^ np.uint64(0x5851F42D4C957F2D)), length)[at] if wide else np.zeros(len(at), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(take), batch.column("owner").take(take), pa.array(C.window_hashes(words, length)[at].view(np.int64)),
                     pa.array(second.view(np.int64)), pa.array((at - rows[row]).astype(np.int32))],
                    ["row", "owner", "h", "h2", "at"],
                )

    rows = found.filter(F.size(places) > 0).select("row", "owner", "text", places)
    return rows.mapInArrow(extend, "row long, owner long, h long, h2 long, at int")


def _smaller(least: str, owner: str) -> Column:
    """Whether a document other than the owner's, with a smaller id, has the run."""
    return F.coalesce(F.col(least) < F.col(owner), F.col(least).isNotNull() & F.col(owner).isNull(), F.lit(False))


def _repeated(runs: DataFrame) -> DataFrame:
    """h, h2, least (smallest owner) of the runs found in more than one text."""
    several = runs.groupBy("h", "h2").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("owner").alias("least")).filter("r0 <> r1")
    # Written, so that the join with it has two plain sides, whose skewed keys Spark can split.
    return C.settle(several.select("h", "h2", "least"), "repeated")


def _survivors(runs: DataFrame, repeated: DataFrame) -> DataFrame:
    """row, the places of its repeated runs, and those of them (``asked``) that a smaller document has."""
    return runs.join(repeated, ["h", "h2"]).groupBy("row").agg(
        F.array_sort(F.collect_set("at")).alias("places"),
        F.array_sort(F.collect_set(F.when(_smaller("least", "owner"), F.col("at")))).alias("asked"),
    )


def _cut(found: DataFrame, window: int) -> DataFrame:
    """text_id, n_removed, sha of what is left, for texts with removed windows (``at``: their first words)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = batch.column("at").flatten().to_numpy(zero_copy_only=False), np.diff(batch.column("at").offsets.to_numpy())
            upto = np.r_[0, np.cumsum(sizes)]
            for first, end, data, offsets in C.utf8_blocks(batch.column("text")):
                starts, ends, rows = C.words_of(data, offsets, C.NOT_SPACE)
                own = flat[upto[first] : upto[end]] + np.repeat(rows[:-1], sizes[first:end])
                gone = np.zeros(len(starts) + 1, np.int32)
                np.add.at(gone, own, 1)
                np.add.at(gone, own + window, -1)
                kept = np.cumsum(gone)[:-1] == 0
                sums = np.r_[0, np.cumsum(~kept)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text_id")[first:end], pa.array(sums[rows[1:]] - sums[rows[:-1]]),
                     pa.array([hashlib.sha256(x).digest() for x in _joined(data, offsets, starts, ends, rows, kept)], pa.binary())],
                    ["text_id", "n_removed", "left_sha"],
                )

    return found.select("text_id", "text", "at").mapInArrow(cut, "text_id binary, n_removed long, left_sha binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text)."""
    lengths = levels(shortest, window)
    numbered = digests(docs, lengths[0], window).withColumn("row", F.monotonically_increasing_id())
    table = C.settle(numbered, "digests")  # written, so the numbers stay as they are
    # One row of each text: that of its smallest doc_id.
    own = F.struct(F.coalesce("doc_id", F.lit(NO_ID)), "row")
    texts = table.filter("text_id IS NOT NULL").groupBy("text_id").agg(
        F.min_by(F.struct("row", F.col("doc_id").alias("owner"), "hashes", "places"), own).alias("x"), F.count(F.lit(1)).alias("copies")
    )
    texts = C.settle(texts.select("text_id", "copies", "x.*"), "texts")
    runs = texts.select("text_id", "row", "owner", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select(
        "text_id", "row", "owner", F.col("x.hashes").alias("h"), F.lit(0).cast("long").alias("h2"), F.col("x.places").alias("at")
    )
    left = _survivors(runs, _repeated(runs))
    left = left.join(texts.select("row", "text_id", "owner"), "row")
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5("text")).alias("own"), "text")
    found = C.settle(
        whole.join(left, (F.col("own") == F.col("text_id")) & F.col("id").eqNullSafe(F.col("owner"))).select("row", "text_id", "owner", "text", "places", "asked"), "survivors"
    )
    removed = None
    for shorter, length in zip(lengths, lengths[1:]):
        if found.isEmpty():
            break
        last = length == window
        repeated = _repeated(_candidates(found, shorter, length, last))
        # At the last level only what may go is looked up; before, all that survives.
        runs = _candidates(found, shorter, length, last, "asked" if last else "places")
        if last:
            gone = runs.join(repeated, ["h", "h2"]).filter(_smaller("least", "owner"))
            removed = gone.groupBy("row").agg(F.collect_set("at").alias("at"))
        else:
            found = C.settle(found.drop("places", "asked").join(_survivors(runs, repeated), "row"), "survivors")
    if len(lengths) == 1:
        removed = left.filter(F.size("asked") > 0).select("row", F.col("asked").alias("at"))
    # What becomes of a text with copies or removed windows, once a text: the join with all rows has two plain sides.
    fate = texts.filter("copies > 1").select("text_id", "owner")
    if removed is not None:
        cuts = _cut(found.join(removed, "row"), window).dropDuplicates(["text_id"])
        fate = fate.join(cuts, "text_id", "full")
    else:
        fate = fate.withColumns({"n_removed": F.lit(0).cast("long"), "left_sha": F.lit(None).cast("binary")})
    fate = C.settle(fate, "fate")
    rows = table.select("doc_id", "text_id", "n_words", "sha").join(fate, "text_id", "left")
    copy = (F.col("n_words") >= window) & F.col("owner").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("owner")))
    return rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.lower(F.hex(F.coalesce("left_sha", "sha")))).alias("kept_sha256"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), x AS (
  SELECT r, doc_id, p, md5(array_to_string(list_slice(ws, p, p + 49), ' ')) AS h
  FROM (SELECT r, doc_id, ws, unnest(range(1, CAST(len(ws) - 48 AS BIGINT))) AS p FROM d WHERE len(ws) >= 50)
), least_id AS (SELECT h, min(doc_id) AS m FROM x GROUP BY h),
gone AS (SELECT r, p FROM x JOIN least_id USING (h) WHERE m < doc_id OR (doc_id IS NULL AND m IS NOT NULL)),
w AS (SELECT r, i, ws[i] AS word FROM (SELECT r, ws, unnest(range(1, CAST(len(ws) + 1 AS BIGINT))) AS i FROM d)),
c AS (
  SELECT w.r AS r, i, word, coalesce(max(gone.p) OVER (PARTITION BY w.r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS cut
  FROM w LEFT JOIN gone ON w.r = gone.r AND w.i = gone.p
), k AS (
  SELECT r, sum(CASE WHEN cut THEN 1 ELSE 0 END) AS n_removed, string_agg(CASE WHEN cut THEN NULL ELSE word END, ' ' ORDER BY i) AS kept
  FROM c GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
