"""Secret scans: fixed patterns, and password guess cost for values in a credential context.

The three base kinds (assign, access, hex) are patterns.  Beyond them, a value that follows a credential word ("pwd is
...", "passphrase: ...") is cut into segments at the least total cost by dynamic programming; the cost of a segment is the
decimal logarithm of the guesses it takes: words by rank (as they are or with common replacements of letters), dates, repeats,
keyboard walks, or brute force by character class.  Values that cost ``LEAST_COST`` or more are secrets of kind guess, unless
a base span has them.  Base spans get the cost of their value too.  Ranks are those of common passwords and of the words of
all documents, counted outside of the values themselves (``word_ranks``).

Scale: one pass that counts words (combined before the shuffle), one without a shuffle; the table of ranks has at most
``TABLE_WORDS`` words, which only sets costs.  Words are found by an Aho-Corasick automaton, repeats and walks by run lengths
computed once a value, so the work is linear in the text and in each value, however long.

Nulls and odd input: a null text counts as empty; an empty table gives an empty result; further columns don't matter; offsets
are code points, end exclusive; texts and values are scanned whole; repeated rows each get a row.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Fixed by the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")
#: A credential word, a joint, a value.
CONTEXT = re.compile(
    r"""\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth(?:orization)?|bearer)["']?\s{0,3}(?:=>|:=|=|:|\bis\b)\s{0,3}["']?([^\s"'<>,;]{8,})""",
    re.I | re.A,
)
LEAST_COST = 10.0
#: Parameters of the cost model: most words in the table of ranks (whole levels of frequency from the top), and the code points of the longest
#: of them; others cost brute force.
TABLE_WORDS = 50_000
LONGEST_WORD = 64
#: Also parameters of the cost model: longest unit of a repeat, and least length of a keyboard walk.
UNITS = 6
LEAST_WALK = 4
#: Common parts of passwords, most common first.
WORDS = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou sunshine princess football shadow "
    "secret superman michael jordan hello charlie freedom whatever trust baseball summer winter spring autumn hunter test user "
    "root guest default changeme access pass love money angel star flower ninja cookie pepper ginger orange banana purple silver "
    "golden tiger eagle falcon phoenix soccer hockey computer internet server system oracle mysql linux windows apple google "
    "facebook twitter example sample demo temp public private token key house family friend happy forever london paris berlin "
    "america monday friday january june july august october december"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujm")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")
LEET = str.maketrans("4@310$57", "aaeiosst")


#: For each line, the place of every character in it, by code; -1 for others, which the last entry stands for.
LINES = [np.array([*(line.find(chr(c)) for c in range(128)), -1]) for line in WALKS]


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


def _runs(same: np.ndarray) -> np.ndarray:
    """At each place, how many places in a row from here on are true."""
    ends = np.flatnonzero(~np.r_[same, False])
    return ends[np.searchsorted(ends, np.arange(len(same)))] - np.arange(len(same))


class _Repeats:
    """The cheapest repeats of one unit length that end at each place, of all their lengths, as the places come.

    A repeat from s to j costs best[s], its unit, and the logarithm of its number of units.  Within one run (where
    every character equals that one unit before) units cost the same, and of two starts that differ by whole units the earlier one, once
    it is as cheap, stays so.  So the starts worth keeping form a stack with the cheapest now on top; each entry holds the
    place from which the one below it is cheaper, and each start is pushed and popped once.
    """

    def __init__(self, unit: int, least: int, runs: list[int]):
        self.unit, self.least, self.runs = unit, least, runs
        self.run, self.stacks = -1, {}

    def _overtaken(self, old: tuple, new: tuple) -> float:
        """The place from which ``old`` (base, start) is at most as dear as the later ``new``."""
        if new[0] <= old[0]:
            return math.inf
        ratio = 10 ** min(new[0] - old[0], 300)
        return (new[1] * ratio - old[1]) / (ratio - 1) if ratio > 1 else math.inf

    def cheapest(self, j: int, best: list[float], cost: list[float]) -> float:
        """The least cost of a prefix of length j that ends with a repeat; ``cost`` has the sums of single characters' costs."""
        s = j - self.unit * self.least
        if s < 0:
            return math.inf
        if s < len(self.runs) and self.runs[s] // self.unit + 1 >= self.least:
            if s + self.runs[s] != self.run:
                self.run, self.stacks = s + self.runs[s], {}
            stack, new = self.stacks.setdefault(s % self.unit, []), (best[s] + cost[s + self.unit] - cost[s], s)
            while stack and stack[-1][2] <= j:
                stack.pop()
            if not stack or self._value(new, j) < self._value(stack[-1], j):
                until = self._overtaken(stack[-1], new) if stack else math.inf
                while stack and until >= stack[-1][2]:
                    stack.pop()
                    until = self._overtaken(stack[-1], new) if stack else math.inf
                if until == math.inf:
                    stack.clear()
                stack.append((*new, until))
            return self._value(stack[-1], j)
        return math.inf

    def _value(self, entry: tuple, j: int) -> float:
        return entry[0] + math.log10((j - entry[1]) // self.unit)


def word_ranks(docs: DataFrame, most: int = TABLE_WORDS) -> dict[str, int]:
    """Ranks of the most common words of ``docs`` (text): those that occur twice or more outside of credential values."""
    left = F.regexp_replace("text", "(?i)" + CONTEXT.pattern, " ")
    words = docs.select(F.explode(F.split(F.lower(left), r"[^\p{L}\p{N}]+")).alias("word")).filter(F.length("word").between(3, LONGEST_WORD))
    counted = C.settle(words.groupBy("word").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "words")
    # Whole levels of about 2 % from the top, as many as the table has room for.
    level = F.floor(F.log10("times") * 100)
    least, room = None, most
    for row in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row["level"]
    if least is None:
        return {}
    found = sorted((-r.times, r.word) for r in counted.filter(level >= least).collect())
    return {word: i + 1 for i, (_, word) in enumerate(found)}


class Guesser:
    """Costs of values under a table of word ranks."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.words = ahocorasick.Automaton()
        for word, rank in ranks.items():
            if len(word) > 2:
                self.words.add_word(word, (len(word), rank))
        if len(self.words):
            self.words.make_automaton()

    def _words(self, low: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, rank) of all words in ``low``."""
        if len(self.words):
            for last, (n, rank) in self.words.iter(low):
                yield last + 1 - n, last + 1, rank

    def cost(self, value: str) -> float:
        """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` takes.

        Repeats (of units of up to ``UNITS`` characters, three of one character or two of more at least), walks and words have all their lengths.
        """
        n = len(value)
        low = value.lower()
        if len(low) != n:  # some capitals have two small letters
            low = "".join(x if len(x := c.lower()) == 1 else c for c in value)
        codes = np.fromiter(map(ord, value), np.int64, n)
        small = np.fromiter(map(ord, low), np.int64, n)
        each = [_brute(c) for c in value]
        repeats = []
        for unit in range(1, min(UNITS, n - 1) + 1):
            same = codes[unit:] == codes[:-unit]
            least = 3 if unit == 1 else 2
            if same.any() and (runs := _runs(same)).max() // unit + 1 >= least:
                repeats.append(_Repeats(unit, least, runs.tolist()))
        singly = [0.0, *accumulate(each)] if repeats else []
        walk = np.zeros(max(n - 1, 0), np.int64)
        for at in LINES:
            place = at[np.minimum(small, len(at) - 1)]
            step = np.where((place[1:] >= 0) & (place[:-1] >= 0), place[1:] - place[:-1], 0)
            for way in (1, -1):
                if (step == way).any():
                    walk = np.maximum(walk, _runs(step == way))
        walk = walk.tolist()
        words = defaultdict(list)
        capitals = [0, *accumulate(c.isupper() for c in value)]
        plain = low.translate(LEET)
        for text, changed in ((low, 0), (plain, 1)) if plain != low else ((low, 0),):
            for start, end, rank in self._words(text):
                extra = (capitals[end] > capitals[start]) + (changed and low[start:end] != plain[start:end])
                words[start].append((end, math.log10(rank + 1) + math.log10(2) * extra))
        best = [0.0] + [math.inf] * n
        for i in range(n):
            for r in repeats:
                best[i] = min(best[i], r.cheapest(i, best, singly))
            base = best[i]
            if base + each[i] < best[i + 1]:
                best[i + 1] = base + each[i]
            if i < len(walk) and walk[i] + 1 >= LEAST_WALK:
                for k in range(LEAST_WALK, walk[i] + 2):
                    best[i + k] = min(best[i + k], base + math.log10(2 * len(WALKS) * 12 * k))
            for end, cost in words.get(i, ()):
                best[end] = min(best[end], base + cost)
            if "0" <= value[i] <= "3" and (m := DATE.match(value, i)):
                best[m.end()] = min(best[m.end()], base + (math.log10(366 * 120) if len(m[0]) > 4 else math.log10(120)))
        return min([best[-1], *(r.cheapest(n, best, singly) for r in repeats)])


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    return Guesser(ranks).cost(value)


def spans(text: str, guesser: Guesser) -> list[tuple[int, int, int, float]]:
    """(start, kind's number, end, cost of the value), sorted."""
    out, low = [], text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end(), guesser.cost(m[2])) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), guesser.cost(m[0])) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), guesser.cost(m[0])) for m in HEX.finditer(text)]
    if any(k in low for k in ("pass", "pwd", "secret", "token", "api", "credential", "auth", "bearer")):
        out.sort()
        starts, reach = [x[0] for x in out], list(accumulate((x[2] for x in out), max))
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            while end > start and text[end - 1] in ".!?)":
                end -= 1
            before = bisect_left(starts, end)  # base spans that begin before the value ends
            if end - start < 8 or (before and reach[before - 1] > start):
                continue
            cost = guesser.cost(text[start:end])
            if cost >= LEAST_COST:
                out.append((start, 3, end, cost))
    return sorted(out)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, cost>> of every row of ``docs`` (doc_id, text)."""
    ranks = word_ranks(docs)
    ranks |= {w: min(r, ranks.get(w, r)) for w, r in RANK.items()}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(ranks)
        for whole in batches:
            for batch in C.by_bytes(whole, "text"):
                found = []
                for text in batch.column("text"):
                    found.append([{"kind": KINDS[k], "start": s, "end": e, "cost": c} for s, k, e, c in spans(text.as_py() or "", guesser)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(find, "doc_id long, spans array<struct<kind:string,start:int,end:int,cost:double>>")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.transform("spans", lambda s: F.round(s["cost"], 2)).alias("costs"),
    )
