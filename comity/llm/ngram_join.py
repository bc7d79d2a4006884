"""Operator 7: n-gram Jaccard join of texts by a MinHash LSH forest.

A text is the set of its SHINGLE-word shingles (lower case, split at white space; a shorter
text is one shingle). Texts whose sets have Jaccard similarity THRESHOLD or more are linked.

1. Each text gets a signature: TREES labels of DEPTH min-hashes. Texts with equal sets are
   one class from here on.
2. A tree is the sorted trie of its labels; classes with the same prefix are a node of it. The
   walk starts at whole labels and shortens the prefixes by STEP hashes. At each depth a class
   meets those that share its shorter prefix but not its longer one in some tree, and pairs whose
   whole signatures agree on AGREEMENT or more of their places match. Each pair is looked at
   once: in the first tree of its longest shared prefix. A class stops where the matches it
   has found say that RECALL of its links are among them (``settled``): a match at similarity s
   shares a prefix of d hashes in some tree with chance c = 1 - (1 - s^d)^TREES and stands
   for 1/c - 1 pairs that are not met yet, and one further link at the threshold is taken to
   exist. So crowded nodes are left early by classes that have found many, and the others go
   on, to the depth at which even a single pair at the threshold is found with RECALL
   (``last_depth``). A pair is met where either of its classes still walks; nodes whose classes
   all walk no more, or all share the longer prefix, are passed over.
   Edges of the matches join the classes into clusters.
3. Within a cluster all pairs of classes are verified on their real shingle sets, taken
   from the texts again: exact similarity, every pair once. Clusters and nodes over a
   bounded size are cut into slices, and every pair of slices is a task of its own.

What leaves a task are counts per class and one edge of each class at most, so neither copies
nor a large family of near copies are written out as pairs. The edges of a slice are the same
whatever slice it meets, so those of a family stay in proportion to its classes.

Defined results: null and empty texts have an empty set, which equals other empty sets and
links with nothing else; null or repeated ids are rows of their own; a group's class_id is
its smallest doc_id, null if all are null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comity.llm.common import (
    at, bounded_batches, in_runs, original, renamed, row_hash, slice_pairs, stored, text_of,
)
from comity.llm.components import components, merge, stars
from comity.llm.words import Split, blocks

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
STEP = 2  # hashes by which the walk shortens prefixes
RECALL = 0.999
AGREEMENT = 0.65
LEVELS = 16  # steps of similarity in which matches are counted
NODE = 512  # classes of a trie node that one task compares
SLICE = 128  # classes of a cluster slice


def last_depth(
    threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL
) -> int:
    """The longest prefix at which any one pair at the threshold is found often enough."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words, from all their bytes."""
    out = np.empty(len(words), np.uint64)
    for i, word in enumerate(words.cast(pa.binary()).to_pylist()):
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out


def shingle_sets(texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = Split(pc.utf8_lower(pc.fill_null(texts, "")))
    codes, words = split.coded()
    hashes = word_hashes(words)[codes] if len(words) else np.empty(0, np.uint64)
    ends = np.concatenate([[0], np.cumsum(split.counts)])
    rolled = np.zeros(len(hashes), np.uint64)
    for i in range(SHINGLE):
        # The word i places on; those of a text's last places are cut off below.
        later = np.concatenate([hashes[i:], np.zeros(min(i, len(hashes)), np.uint64)])
        rolled = (rolled ^ later) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(31)
    out = []
    for d, n in enumerate(split.counts):
        if n >= SHINGLE:
            out.append(np.unique(rolled[ends[d]:ends[d + 1] - SHINGLE + 1]))
        elif n:
            short = np.full(1, n, np.uint64)
            for h in hashes[ends[d]:ends[d + 1]]:
                short = (short ^ h) * np.uint64(0xD6E8FEB86659FD93)
                short ^= short >> np.uint64(31)
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TREES x DEPTH min-hashes of each set, 16 bits each; empty sets get zeros."""
    rng = np.random.default_rng(5)
    factors = rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(sets), TREES * DEPTH), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])])[:-1]
    for j, factor in enumerate(factors):
        mixed = (flat >> np.uint64(32)) ^ flat
        mixed = mixed * factor
        least = np.minimum.reduceat(mixed, starts)
        out[full, j] = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
    return out


def printed(batches):
    """doc_id, key of the text, digest of its set, signature."""
    for block in blocks(batches):
        sets = shingle_sets(block.column("text"))
        marks = signatures(sets)
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id").combine_chunks(), block.column("_key").combine_chunks(),
             pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                      pa.binary()),
             pa.array([m.tobytes() if len(s) else None for m, s in zip(marks, sets)],
                      pa.binary())],
            ["doc_id", "_key", "digest", "signature"])


def ranks(digests: pa.Array) -> np.ndarray:
    """Their places in order, equal ones alike."""
    return pc.rank(digests, tiebreaker="dense").to_numpy().astype(np.int64)


def matches(depth: int, before: int | None = None):
    def found(columns: dict, cuts: np.ndarray) -> pa.Table:
        """Matches first met at ``depth``, in trie nodes or between two slices of a node.

        Those that share the prefix of the depth ``before`` have met there.

        Gives the number of each class's matches by level of similarity, and edges that join them.
        """
        side, left, right, tree = (columns[c].to_numpy() for c in ("slice", "left", "right", "tree"))
        walks = columns["walks"].to_numpy(zero_copy_only=False)
        marks = np.frombuffer(columns["signature"].buffers()[2], np.uint16)
        marks = marks.reshape(-1, TREES * DEPTH)[columns["signature"].offset:][:len(side)]
        needed = math.ceil(AGREEMENT * TREES * DEPTH)
        digests = columns["digest"]
        rank = ranks(digests)
        counts = np.zeros((len(side), LEVELS + 1), np.int64)
        to = np.full(len(side), -1)
        for lo, hi in zip(cuts, cuts[1:]):
            a = lo + np.flatnonzero(side[lo:hi] == left[lo])
            b = lo + np.flatnonzero(side[lo:hi] == right[lo])
            # The hashes up to the longer prefix in this tree.
            begin = tree[lo] * DEPTH
            after = marks[:, begin + depth:begin + before] if before else None
            part = np.arange(hi - lo)
            for i in a:
                rest = b[b > i] if left[lo] == right[lo] else b
                if not walks[i]:
                    rest = rest[walks[rest]]
                if after is not None:
                    rest = rest[(after[rest] != after[i]).any(1)]
                if not len(rest):
                    continue
                same = marks[rest] == marks[i]
                agreed = same.sum(1)
                near = agreed >= needed
                rest, agreed = rest[near], agreed[near]
                shared = np.logical_and.accumulate(
                    same[near].reshape(-1, TREES, DEPTH), axis=2).sum(2)
                # In the first tree of the longest prefix that the two share.
                longest = shared.max(1, initial=0)
                first = (longest >= depth) & (shared.argmax(1) == tree[lo])
                if before:
                    first &= longest < before
                rest, level = rest[first], agreed[first] * LEVELS // (TREES * DEPTH)
                counts[i] += np.bincount(level, minlength=LEVELS + 1)
                counts[rest, level] += 1
                merge(part, i - lo, rest - lo)
            x, y = stars(part, side[lo:hi], rank[lo:hi])
            to[lo + x] = lo + y
        some, level = np.nonzero(counts)
        # An edge goes with the first count of its row: a row that has one has matches.
        again = np.zeros(len(some), bool)
        again[1:] = some[1:] == some[:-1]
        return pa.table({
            "digest": digests.take(pa.array(some)),
            "level": pa.array(level),
            "n": pa.array(counts[some, level]),
            "b": digests.take(pa.array(to[some], mask=again | (to[some] < 0))),
        })

    return found


def settled(met: DataFrame, depth: int, threshold: float, recall: float) -> DataFrame:
    """The classes whose matches found so far are ``recall`` of those to be expected.

    Matches below the threshold say nothing about links and do not count.
    """
    near = met.filter(F.col("level") >= math.floor(threshold * LEVELS))
    chance = 1 - F.pow(1 - F.pow(F.col("level") / LEVELS, F.lit(depth)), F.lit(TREES))
    further = (1 - threshold ** depth) ** TREES
    return near.groupBy("digest").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * (1 / chance - 1)) + further).alias("missed")
    ).filter(F.col("n") >= recall * (F.col("n") + F.col("missed"))).select("digest")


def in_shared(entries: DataFrame, depth: int, *more) -> DataFrame:
    """``entries`` (digest, tree, label) with the ``prefix`` and ``_size`` of their node.

    Only nodes of several classes; ``more`` are further facts of a node, named aggregates of
    (part, node). A node's classes are dealt to parts, so a large one is never in one task.
    """
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.withColumns({
        "prefix": F.substring("label", 1, 2 * depth),
        "_part": F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int")})
    some = dealt.groupBy("tree", "prefix", "_part").agg(
        F.count(F.lit(1)).alias("_size"), *[of_part for of_part, _ in more])
    nodes = some.groupBy("tree", "prefix").agg(
        F.sum("_size").alias("_size"), *[of_node for _, of_node in more])
    nodes = nodes.filter(F.col("_size") > 1)
    known = some.select("tree", "prefix", "_part").join(nodes, ["tree", "prefix"])
    return dealt.join(known, ["tree", "prefix", "_part"]).drop("_part")


def walked(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """digest, level, n (matches of the class at that level) and b (a class of its cluster, or null).

    ``classes`` has a ``digest`` and its ``signature``.
    """
    width, last = 2 * DEPTH, last_depth(threshold, recall=recall)
    marks = classes.filter(F.col("signature").isNotNull()).select("digest", "signature")
    labels = marks.select(
        "digest", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.lit(TREES - 1)),
            lambda t: F.substring(F.col("signature"), t * width + 1, F.lit(width)))
        ).alias("tree", "label"))
    # Classes that share not even the shortest prefix meet no other.
    entries = stored(in_shared(labels, last).select("digest", "tree", "label"), "trie")
    met, before = None, None
    for depth in [*range(DEPTH, last, -STEP), last]:
        if met is None:
            now = entries.withColumn("walks", F.lit(True))
        else:
            done = settled(met, before, threshold, recall).withColumn("_done", F.lit(True))
            # Written, as the nodes read it several times.
            now = stored(
                entries.join(done, "digest", "left").withColumn(
                    "walks", F.col("_done").isNull()).drop("_done"), "trie")
        after = F.substring("label", 2 * depth + 1, 2 * ((before or DEPTH) - depth))
        nodes = in_shared(
            now, depth,
            (F.max("walks").alias("_walks"), F.max("_walks").alias("_walks")),
            (F.min(after).alias("_least"), F.min("_least").alias("_least")),
            (F.max(after).alias("_most"), F.max("_most").alias("_most")))
        nodes = nodes.filter(F.col("_walks"))
        if before:
            nodes = nodes.filter(F.col("_least") != F.col("_most"))
        sliced = slice_pairs(
            nodes.select("digest", "tree", "prefix", "walks", "_size"), "digest", "_size", NODE)
        found = stored(
            in_runs(sliced.drop("_size").join(marks, "digest"), ["tree", "prefix", "left", "right"],
                    matches(depth, before), "digest binary, level long, n long, b binary"),
            "matches")
        met, before = found if met is None else met.unionByName(found), depth
    return met


def verified(threshold: float):
    def links(columns: dict, cuts: np.ndarray) -> pa.Table:
        """Exact similarities within cluster slices, or between two slices of a cluster.

        Gives each class the number of rows it is linked to here, and edges that join them.
        """
        side, left, right = (columns[c].to_numpy() for c in ("slice", "left", "right"))
        sizes = columns["size"].to_numpy()
        digests = columns["digest"]
        rank = ranks(digests)
        counts, to = np.zeros(len(side), np.int64), np.full(len(side), -1)
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo < 2:
                continue
            sets = shingle_sets(columns["text"].slice(lo, hi - lo))
            lengths = np.array([len(s) for s in sets])
            _, places = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            a = np.flatnonzero(side[lo:hi] == left[lo])
            b = np.flatnonzero(side[lo:hi] == right[lo])
            # The sets of b that hold each shingle.
            member = np.concatenate([np.arange(ends[j], ends[j + 1]) for j in b] or [ends[:0]])
            order = np.argsort(places[member], kind="stable")
            owner = np.repeat(np.arange(len(b)), lengths[b])[order]
            held = np.bincount(places[member], minlength=places.max(initial=0) + 1)
            first = np.concatenate([[0], np.cumsum(held)])
            part = np.arange(hi - lo)
            for i in a:
                mine = places[ends[i]:ends[i + 1]]
                n = held[mine]
                at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(b))
                good = common >= threshold * (lengths[i] + lengths[b] - common)
                if left[lo] == right[lo]:
                    good &= b > i
                rest = lo + b[good]
                counts[lo + i] += sizes[rest].sum()
                counts[rest] += sizes[lo + i]
                merge(part, i, b[good])
            x, y = stars(part, side[lo:hi], rank[lo:hi])
            to[lo + x] = lo + y
        some = np.flatnonzero(counts)
        return pa.table({
            "digest": digests.take(pa.array(some)),
            "n": pa.array(counts[some]),
            "b": digests.take(pa.array(to[some], mask=to[some] < 0)),
        })

    return links


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and n_links (other rows linked directly) of each row.

    class_id is the smallest doc_id reachable by links.
    """
    return linked(docs, threshold).select("doc_id", "class_id", "n_links")


def linked(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """jaccard_join's rows with the text's ``_key`` and the ``component`` they are linked in."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    rows = rows.withColumn("_key", F.md5("text"))
    prints = stored(
        rows.mapInArrow(
            printed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _key string, "
                     "digest binary, signature binary"),
        "prints")
    classes = stored(
        prints.groupBy("digest", "signature").agg(
            F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least_id"),
            F.min("_key").alias("_key")),
        "classes")
    edges = walked(classes, threshold).filter(F.col("b").isNotNull()).select(
        F.col("digest").alias("a"), "b")
    clusters = components(edges)
    members = clusters.join(classes, clusters["node"] == classes["digest"]).select(
        "component", "digest", "_key", "size")
    sized = members.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    sliced = slice_pairs(
        members.join(sized, "component"), "digest", "_size", SLICE).drop("_size")
    # One text for each key; copies fold in their own task before they meet.
    texts = rows.select("_key", "text").dropDuplicates(["_key"])
    found = stored(
        in_runs(sliced.join(texts, "_key"), ["component", "left", "right"],
                verified(threshold), "digest binary, n long, b binary"),
        "links")
    counts = found.groupBy("digest").agg(F.sum("n").alias("n"))
    groups = components(found.filter(F.col("b").isNotNull()).select(F.col("digest").alias("a"), "b"))
    named = (
        classes.select("digest", "size", "least_id")
        .join(counts, "digest", "left")
        .join(groups, F.col("digest") == F.col("node"), "left")
        .withColumn("component", F.coalesce("component", "digest"))
    )
    least = named.groupBy("component").agg(F.min("least_id").alias("class_id"))
    result = named.join(least, "component").select(
        "digest", "class_id", "component",
        (F.coalesce("n", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"))
    return prints.select("doc_id", "digest", "_key").join(result, "digest").select(
        "doc_id", "class_id", "n_links", "_key", "component")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies, with all its columns.

    Rows with null ids stay; of rows that repeat an id and are linked, one stays. Rows that
    repeat an id without being linked are of groups of their own.
    """
    kept = linked(docs, threshold).filter(F.col("doc_id") == F.col("class_id"))
    # One text for each group: a row is found by its id and its text.
    kept = kept.groupBy("component").agg(
        F.min("doc_id").alias("_kept"), F.min("_key").alias("_text"))
    held, names = renamed(docs)
    known = held.withColumns({
        "_id": at(docs, "doc_id"),
        "_key": F.md5(F.coalesce(at(docs, "text").cast("string"), F.lit("")))})
    found = known.join(
        kept, (F.col("_id") == F.col("_kept")) & (F.col("_key") == F.col("_text")), "left_semi")
    # Of rows that agree in both, the one with the least hash of all columns.
    one = found.groupBy("_id", "_key").agg(
        F.min_by(F.struct(*names), row_hash(docs, names)).alias("_row")).select("_row.*")
    return original(one.unionByName(known.filter(F.col("_id").isNull()).select(*names)), docs)
