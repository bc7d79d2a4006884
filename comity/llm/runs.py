"""Operator 11: periodic runs of words, by Lyndon roots from the first phase of a suffix sorter.

A run is a stretch of words with smallest period q, at least ``min_exponent`` periods and
``min_length`` words long, that no neighbouring word extends. Every run of two periods or
more holds a Lyndon root: the longest Lyndon word that starts at some position, under the
order of words or under the reversed order, has length q there. So the work is

1. Grouping (``lyndon_lengths``): positions are grouped by their first word, and groups are
   closed from the greatest down. Closing a group with context u appends u to the context of
   the nearest open position left of each of its members, once for each member that names it,
   and moves that position to a group just above its old one. When all are closed, the length
   of a position's context is the length of its longest Lyndon word. No suffix array is made.
2. Roots (``runs_of``): each (position, length), under both orders, is extended to both sides
   by longest common extensions, which ranks of the substrings of 2^k words answer exactly for
   all roots at once.

A word that stands fewer than ``min_exponent`` times in its stretch of a document is in no
run, so texts are cut at such words first, again and again; only what is left is grouped.

Documents are worked on where they are read, in blocks of bounded size; nothing is shuffled. A
longer document is a block of its own, and needs about 100 bytes a word of what is left of it.

Defined results: null and empty texts have no words, no runs and an empty collapsed text;
null, repeated and tied ids keep a row each; other columns are ignored, and clashing names
cannot arise, since the result holds the ``keep`` columns and the four it adds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from comity.llm.common import bounded_batches, text_of
from comity.llm.words import Split, blocks

MIN_LENGTH = 6
MIN_EXPONENT = 4
ROUNDS = 12  # of cutting; more would only spare later work
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
WORD = r"[^\x20\x09-\x0D]+"


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position; symbols are 0..k-1."""
    size = [1] * (max(symbols) + 1)
    members: list[list[int]] = [[] for _ in size]
    for i, symbol in enumerate(symbols):
        members[symbol].append(i)
    below, above = list(range(-1, len(size) - 1)), list(range(1, len(size) + 1))
    of = list(symbols)
    # open_at[i + 1] leads to the nearest open position at or left of i; 0 stands for none.
    open_at = list(range(len(symbols) + 1))
    group = len(size) - 1
    while group >= 0:
        closing = [i for i in members[group] if of[i] == group]
        members[group] = []
        for i in closing:
            open_at[i + 1] = i
        named: dict[int, int] = {}
        for i in closing:
            at = i
            while open_at[at] != at:
                open_at[at] = open_at[open_at[at]]
                at = open_at[at]
            open_at[i + 1] = at
            if at:
                named[at - 1] = named.get(at - 1, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for i, times in named.items():
            moved.setdefault((times, of[i]), []).append(i)
        # Most often named first: each new group comes just above its old one.
        for times, old in sorted(moved, reverse=True):
            new, higher = len(size), above[old]
            size.append(size[old] + times * size[group])
            members.append(moved[times, old])
            below.append(old)
            above.append(higher)
            above[old], below[higher] = new, new
            for i in moved[times, old]:
                of[i] = new
        group = below[group]
    return [size[g] for g in of]


class Extensions:
    """Longest common extensions of positions, from ranks of the substrings of 2^k symbols."""

    def __init__(self, symbols: np.ndarray):
        self.size = len(symbols)
        self.levels = [symbols.astype(np.int64)]
        step = 1
        while 2 * step <= self.size:
            rank = self.levels[-1]
            stop = self.size - 2 * step + 1
            pairs = rank[:stop] * (int(rank.max()) + 1) + rank[step:step + stop]
            distinct, ranks = np.unique(pairs, return_inverse=True)
            self.levels.append(ranks)
            step *= 2
            if len(distinct) == len(pairs):
                break
        self.levels = [level.astype(np.int32) for level in self.levels]

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols from a and b on, a < b."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            fits = b + length + step <= self.size
            x, y = (a + length)[fits], (b + length)[fits]
            length[np.flatnonzero(fits)[level[x] == level[y]]] += step
        return length

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols that end just before a and b, a < b."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            fits = a - length - step >= 0
            x, y = (a - length)[fits] - step, (b - length)[fits] - step
            length[np.flatnonzero(fits)[level[x] == level[y]]] += step
        return length


def runs_of(symbols: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """start, length and period of every run, by start, then period."""
    _, ranks = np.unique(symbols, return_inverse=True)
    top = int(ranks.max())
    roots = []
    for order in (ranks, top - ranks):
        length = np.array(lyndon_lengths(order.tolist()), np.int64)
        start = np.flatnonzero(length * min_exponent <= len(ranks))
        start = start[start + length[start] < len(ranks)]
        start = start[ranks[start] == ranks[start + length[start]]]
        roots.append(np.stack([start, length[start]], 1))
    start, period = np.unique(np.concatenate(roots), axis=0).T
    if not len(start):
        return np.empty((0, 3), np.int64)
    extend = Extensions(ranks)
    before = extend.left(start, start + period)
    length = before + extend.right(start, start + period) + period
    long = length >= np.maximum(min_length, min_exponent * period)
    found = np.stack([start - before, period, length], 1)[long]
    return np.unique(found, axis=0)[:, [0, 2, 1]]


def repeated_stretches(
    codes: np.ndarray, documents: np.ndarray, min_length: int, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """Positions that may lie in a run, and their stretch: each word of it stands there
    ``least`` times or more, or cutting was given up."""
    at, stretch = np.arange(len(codes)), documents
    for _ in range(ROUNDS):
        if not len(at):
            break
        width = int(codes[at].max()) + 1
        _, which, counts = np.unique(
            stretch * width + codes[at], return_inverse=True, return_counts=True)
        often = (counts >= least)[which]
        at, old = at[often], stretch[often]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(old) != 0)
        stretch = np.cumsum(new) - 1
        long = np.bincount(stretch, minlength=1)[stretch] >= min_length
        at, stretch = at[long], stretch[long]
        if often.all() and long.all():
            break
    return at, stretch


def block_runs(
    codes: np.ndarray, counts: np.ndarray, min_length: int, min_exponent: int
) -> tuple[np.ndarray, np.ndarray]:
    """The document of each run of a block, and its start, length and period there."""
    documents = np.repeat(np.arange(len(counts)), counts)
    at, stretch = repeated_stretches(
        codes.astype(np.int64), documents, min_length, min_exponent)
    if not len(at):
        return np.empty(0, np.int64), np.empty((0, 3), np.int64)
    # Stretches in one string, each ended by a symbol of its own, which no run can hold.
    where = np.arange(len(at)) + stretch
    symbols = np.empty(len(at) + int(stretch[-1]) + 1, np.int64)
    origin = np.full(len(symbols), -1, np.int64)
    origin[where] = at
    symbols[where] = codes[at]
    ends = np.flatnonzero(origin < 0)
    symbols[ends] = int(codes.max()) + 1 + np.arange(len(ends))
    found = runs_of(symbols, min_length, min_exponent)
    found[:, 0] = origin[found[:, 0]]
    of = documents[found[:, 0]]
    found[:, 0] -= (np.cumsum(counts) - counts)[of]
    order = np.lexsort((found[:, 2], found[:, 0], of))
    return of[order], found[order]


def periodic_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
    keep: tuple[str, ...] = ("doc_id",), text: str = "text",
) -> DataFrame:
    """The ``keep`` columns, ``n_words``, ``runs``, ``strongest`` and ``collapsed``.

    ``runs`` lists (start, length, period) by start, then period, words counted from 0.
    ``strongest`` is the run with the greatest length / period (ties: smallest start, then
    period), null without runs. ``collapsed`` is the text without the words that any run
    holds after its first period, words joined by one space.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods or more")
    bounded_batches(docs.sparkSession)
    keep = list(keep)
    schema = T.StructType([
        *[docs.schema[k] for k in keep], T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)), T.StructField("strongest", RUN),
        T.StructField("collapsed", T.StringType())])
    arrow_schema = to_arrow_schema(schema)

    def work(batches):
        for block in blocks(batches, text):
            split = Split(block.column(text))
            codes, _ = split.coded()
            of, found = block_runs(codes, split.counts, min_length, min_exponent)
            first = np.cumsum(split.counts) - split.counts
            begin = first[of] + found[:, 0]
            dropped = np.zeros(len(codes) + 1, np.int64)
            np.add.at(dropped, begin + found[:, 2], 1)
            np.add.at(dropped, begin + found[:, 1], -1)
            kept = np.cumsum(dropped)[:-1] == 0
            lists = pa.LargeListArray.from_arrays(
                np.concatenate([[0], np.cumsum(kept)])[np.append(first, len(codes))],
                split.words.filter(pa.array(kept)).cast(pa.large_string()))
            # The strongest run of each document comes first in this order.
            order = np.lexsort((found[:, 2], found[:, 0], -found[:, 1] / found[:, 2], of))
            best = np.full(len(split.counts), -1)
            best[of[order][::-1]] = order[::-1]
            structs = pa.StructArray.from_arrays(
                [pa.array(column) for column in found.T.copy()], fields=list(
                    arrow_schema.field("strongest").type))
            out = {name: block.column(name) for name in keep} | {
                "n_words": pa.array(split.counts, pa.int64()),
                "runs": pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(len(first) + 1)), pa.int32()), structs),
                "strongest": structs.take(pa.array(best, mask=best < 0)),
                "collapsed": pc.binary_join(lists, pa.scalar(" ", pa.large_string())),
            }
            yield from pa.table(out).cast(arrow_schema).to_batches()

    return docs.select(*keep, text).mapInArrow(work, schema)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, by a hash of the id, turn periodic.

    Let h be the crc32 of the decimal id and g = floor(h / 10). If 10 divides h, each word i
    from a = g mod n on becomes word a + (i - a) mod p, with p = 1 + floor((n - a) / (3 + g mod
    8)), words joined by one space. Others, null ids too, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(text_of(docs), F.lit(WORD), F.lit(0))
    n = F.size(words)
    g = F.floor(h / 10).cast("long")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    turned = F.slice(F.concat(
        F.slice(words, F.lit(1), a),
        F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))), F.lit(1), n)
    return docs.select(
        "doc_id", F.when((h % 10 == 0) & (n > 0), F.array_join(turned, " "))
        .otherwise(docs["text"]).alias("text"))


def listed(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n"))), "")


def run_digests(docs: DataFrame) -> DataFrame:
    """The runs of the documents of ``with_repeats``, as counts, strongest run and digests."""
    found = periodic_runs(with_repeats(docs))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
