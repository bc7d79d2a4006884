"""Operator 12: repeated lines dropped through a sharded minimal perfect hash.

Lines are compared by key: white space stripped at both ends, A-Z in lower case, named by 128
bits of xxh3. Keys that ``least_documents`` documents or more hold lose their lines in all
documents but the one with the largest id.

1. Blocks of documents (words.blocks) send each distinct key once, with how many of their
   documents hold it and the largest id among them; these are added up by key.
2. ``line_index``: distinct keys are dealt to shards by hash, and each shard gets a minimal
   perfect hash: bit arrays, one a level, where a key that falls alone on a bit is placed
   there and the others go on to the next level. The number of set bits before a key's bit
   is its place in compact arrays of fingerprints (32 bits), document counts and largest ids.
3. Documents probe the arrays: a block asks each shard once for its distinct keys and gets
   back those that repeat. No line is joined, and a line that half of a corpus holds is asked
   for once a block.

Shards are as many as hold SHARD requests each, so index, requests and answers of a task stay
small at any size; the requests of a crowded shard are dealt to several copies of it.

Defined results: null and empty texts are one empty line; null or repeated ids are documents
of their own, null counts as the smallest id, and all rows of the largest id keep their
lines; extra columns are ignored. ``docs`` must give the same rows in the same order each time
it is read, as files do; otherwise the job fails. Keys of other texts that share all 128 bits
would count as one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from comity.llm.common import bounded_batches, stored
from comity.llm.words import blocks

LEAST_LENGTH = 40
LEAST_DOCUMENTS = 5
SHARD = 1 << 17
WHITE = b" \t\n\x0b\x0c\r"
NONE = np.uint64(0)


def key_of(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def points(key: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(key) if key.isascii() else len(key.decode())


def _mixed(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    mixed = high ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ low ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


class PerfectHash:
    """Places 0 to n - 1 for n distinct keys of two 64-bit halves."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        """``sizes``: words of 64 bits in each level; ``words``: all levels in a row."""
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], np.arange(len(high))
        while len(left):
            size = (2 * len(left) + 63) // 64
            at = _mixed(high[left], low[left], len(sizes)) % np.uint64(64 * size)
            at = at.astype(np.int64)
            alone = np.bincount(at, minlength=64 * size)[at] == 1
            bits = np.zeros(64 * size, np.uint8)
            bits[at[alone]] = 1
            sizes.append(size)
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~alone]
        return cls(np.array(sizes, np.int64),
                   np.concatenate([np.empty(0, np.uint64), *levels]))

    def places(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for one that no level holds; a key that is not among
        those placed may get the place of another."""
        out, left, base = np.full(len(high), -1, np.int64), np.arange(len(high)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _mixed(high[left], low[left], level) % np.uint64(64 * size)
            word, bit = base + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = self.words[word]
            here = (held >> bit) & np.uint64(1) > NONE
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (self.before[word] + below)[here]
            left, base = left[~here], base + size
        return out


class BlockLines:
    """The long lines of a block of documents, and their distinct keys in order of coming."""

    def __init__(self, block: pa.Table, columns: list[str], text: str, least_length: int):
        self.texts = [t or b"" for t in block.column(text).to_pylist()]
        codes: dict[bytes, int] = {}
        code, document, line = [], [], []
        digest = xxhash.xxh3_128_digest
        for d, data in enumerate(self.texts):
            if len(data) < least_length:
                continue
            for i, raw in enumerate(data.lower().split(b"\n")):
                if len(raw) < least_length:
                    continue
                key = raw.strip(WHITE)
                if len(key) >= least_length and points(key) >= least_length:
                    code.append(codes.setdefault(digest(key), len(codes)))
                    document.append(d)
                    line.append(i)
        self.code, self.document, self.line = (
            np.array(x, np.int64) for x in (code, document, line))
        halves = np.frombuffer(b"".join(codes), "<u8").reshape(-1, 2)
        self.high, self.low = halves[:, 0], halves[:, 1]
        name = hashlib.blake2b(digest_size=16)
        for data in self.texts:
            name.update(len(data).to_bytes(8, "little"))
            name.update(data)
        for column in columns:
            name.update(repr(block.column(column).to_pylist()).encode())
        self.name = name.digest()

    def shards(self, count: int) -> np.ndarray:
        return self.high.view(np.int64) % count


def _largest(ids: pa.Array, code: np.ndarray, document: np.ndarray, count: int) -> np.ndarray:
    """For each code the document with the largest id that holds it; null is the smallest."""
    order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    best = np.full(count, -1)
    np.maximum.at(best, code, rank[document])
    return order[best]


def distinct_lines(
    docs: DataFrame, text: str = "text", ids: str = "doc_id", least_length: int = LEAST_LENGTH,
) -> DataFrame:
    """high, low, documents, largest and blocks of every distinct key of ``least_length`` code
    points or more; ``docs`` has its text as binary."""
    schema = T.StructType([
        *[T.StructField(c, T.LongType()) for c in ("high", "low", "documents")],
        T.StructField("largest", docs.schema[ids].dataType)])
    arrow_schema = to_arrow_schema(schema)

    def work(batches):
        for block in blocks(batches, text):
            lines = BlockLines(block, [], text, least_length)
            if not len(lines.high):
                continue
            pair = np.unique(lines.code * len(lines.texts) + lines.document)
            code, document = np.divmod(pair, len(lines.texts))
            column = block.column(ids).combine_chunks()
            at = _largest(column, code, document, len(lines.high))
            yield from pa.table({
                "high": lines.high.view(np.int64), "low": lines.low.view(np.int64),
                "documents": np.bincount(code, minlength=len(lines.high)),
                "largest": column.take(pa.array(at)),
            }).cast(arrow_schema).to_batches()

    return docs.select(ids, text).mapInArrow(work, schema).groupBy("high", "low").agg(
        F.sum("documents").alias("documents"), F.max("largest").alias("largest"),
        F.count(F.lit(1)).alias("blocks"))


def line_index(lines: DataFrame) -> tuple[DataFrame, int]:
    """One row a shard of ``distinct_lines``, stored, and the number of shards.

    ``sizes`` and ``words`` are its perfect hash; ``fingerprints`` (uint32), ``counts``
    (int64) and ``largest`` lie in the order of its places; ``pieces`` is the number of
    tasks that its requests are dealt to.
    """
    asked = lines.agg(F.sum("blocks")).first()[0] or 0
    shards = max(1, math.ceil(asked / SHARD))
    ids = lines.schema["largest"].dataType
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("pieces", T.IntegerType()),
        *[T.StructField(c, T.BinaryType()) for c in ("sizes", "words", "fingerprints", "counts")],
        T.StructField("largest", T.ArrayType(ids))])
    arrow_schema = to_arrow_schema(schema)

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        high, low = (group.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
        perfect = PerfectHash.of(high, low)
        order = np.empty(len(high), np.int64)
        order[perfect.places(high, low)] = np.arange(len(high))
        largest = group.column("largest").take(pa.array(order)).combine_chunks()
        pieces = math.ceil(pc.sum(group.column("blocks")).as_py() / (2 * SHARD))
        return pa.table({
            "shard": group.column("shard").slice(0, 1), "pieces": pa.array([pieces], pa.int32()),
            "sizes": [perfect.sizes.tobytes()], "words": [perfect.words.tobytes()],
            "fingerprints": [low[order].astype("<u4").tobytes()],
            "counts": [group.column("documents").to_numpy()[order].tobytes()],
            "largest": pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), largest),
        }).cast(arrow_schema)

    return stored(
        lines.withColumn("shard", F.pmod("high", F.lit(shards)).cast("long")).groupBy("shard").applyInArrow(work, schema),
        "line-index"), shards


def _answers(requests: pa.Table, index: pa.Table, least: int, schema: pa.Schema) -> pa.Table:
    """For each request the codes of its keys that ``least`` documents hold, and their
    largest ids."""
    if not requests.num_rows:
        return schema.empty_table()
    perfect = PerfectHash(*(np.frombuffer(index.column(c)[0].as_py(), t)
                            for c, t in (("sizes", np.int64), ("words", "<u8"))))
    fingerprints = np.frombuffer(index.column("fingerprints")[0].as_py(), "<u4")
    counts = np.frombuffer(index.column("counts")[0].as_py(), np.int64)
    largest = index.column("largest").combine_chunks().flatten()
    keys = [np.frombuffer(k.as_py(), "<u8").reshape(2, -1) for k in requests.column("keys")]
    code = np.concatenate(
        [np.frombuffer(c.as_py(), "<i4") for c in requests.column("codes")])
    high, low = np.concatenate(keys, axis=1)
    place = perfect.places(high, low)
    known = (place >= 0) & (fingerprints[place] == low.astype("<u4"))
    if not known.all():
        raise ValueError("the documents changed between two readings of them")
    often = counts[place] >= least
    ends = np.concatenate([[0], np.cumsum([k.shape[1] for k in keys])])
    cuts = pa.array(np.concatenate([[0], np.cumsum(often)])[ends], pa.int32())
    return pa.table({
        "block": requests.column("block"), "shard": requests.column("shard"),
        "codes": pa.ListArray.from_arrays(cuts, pa.array(code[often], pa.int32())),
        "largest": pa.ListArray.from_arrays(cuts, largest.take(pa.array(place[often]))),
    }).cast(schema)


def dedup_lines(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS,
    keep: tuple[str, ...] = ("doc_id",), text: str = "text", ids: str = "doc_id",
) -> DataFrame:
    """The ``keep`` columns, ``n_lines`` (before), ``n_dropped`` and ``kept``, the text left."""
    bounded_batches(docs.sparkSession)
    keep = list(keep)
    columns = list(dict.fromkeys([ids, *keep]))
    source = docs.select(*columns, F.col(text).cast("string").cast("binary").alias("_text"))
    lines = stored(distinct_lines(source, "_text", ids, least_length), "distinct-lines")
    index, shards = line_index(lines)
    id_type = docs.schema[ids].dataType

    def asked(batches):
        for block in blocks(batches, "_text"):
            found = BlockLines(block, columns, "_text", least_length)
            shard = found.shards(shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
            parts = [order[a:b] for a, b in zip(cuts, cuts[1:])]
            if parts:
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([found.name] * len(parts), pa.binary()),
                    "shard": pa.array(shard[order][cuts[:-1]], pa.int64()),
                    "codes": pa.array([p.astype("<i4").tobytes() for p in parts], pa.binary()),
                    "keys": pa.array([found.high[p].tobytes() + found.low[p].tobytes()
                                      for p in parts], pa.binary())})

    def whole(batches):
        for block in blocks(batches, "_text"):
            found = BlockLines(block, columns, "_text", least_length)
            lists = {
                "block": pa.array([found.name], pa.binary()),
                "shards": pa.array([len(np.unique(found.shards(shards)))], pa.int32())}
            for i, column in enumerate([*columns, "_text"]):
                flat = block.column(column).combine_chunks()
                lists[f"c{i}"] = pa.ListArray.from_arrays(
                    pa.array([0, len(flat)], pa.int32()), flat)
            yield pa.RecordBatch.from_pydict(lists)

    def probed(left: pa.Table, right: pa.Table) -> pa.Table:
        # Blocks with the same rows have the same name: one set of answers serves them.
        first = np.unique(right.column("shard").to_numpy(), return_index=True)[1]
        right = right.take(pa.array(first)).combine_chunks()
        codes = [c for cs in right.column("codes").to_pylist() for c in cs]
        largest = pa.concat_arrays(
            [pa.array([], to_arrow_type(id_type)),
             *[c.flatten().cast(to_arrow_type(id_type)) for c in right.column("largest").chunks]])
        made = []
        for i in range(left.num_rows):
            row = left.slice(i, 1).combine_chunks()
            block = pa.table({c: row.column(f"c{k}").chunk(0).flatten()
                              for k, c in enumerate([*columns, "_text"])})
            if row.column("shards")[0].as_py() != right.num_rows:
                raise ValueError("the documents changed between two readings of them")
            made.append(_kept(block, codes, largest))
        return pa.concat_tables(made).cast(arrow_schema)

    def _kept(block: pa.Table, codes: list[int], largest: pa.Array) -> pa.Table:
        found = BlockLines(block, [], "_text", least_length)
        answer = np.full(max(1, len(found.high)), -1)
        answer[codes] = np.arange(len(codes))
        hit = answer[found.code] >= 0
        document, line = found.document[hit], found.line[hit]
        mine = block.column(ids).combine_chunks().take(pa.array(document)).cast(largest.type)
        theirs = largest.take(pa.array(answer[found.code][hit]))
        # Null is the smallest id, so a key whose largest id is null stands in null ids only.
        same = pc.or_(pc.fill_null(pc.equal(mine, theirs), False), pc.is_null(theirs))
        gone = ~same.to_numpy(zero_copy_only=False) if len(document) else np.empty(0, bool)
        dropped: dict[int, set[int]] = {}
        for d, i in zip(document[gone].tolist(), line[gone].tolist()):
            dropped.setdefault(d, set()).add(i)
        kept = [
            data if d not in dropped else b"\n".join(
                [raw for i, raw in enumerate(data.split(b"\n")) if i not in dropped[d]])
            for d, data in enumerate(found.texts)]
        return pa.table({name: block.column(name) for name in keep} | {
            "n_lines": pa.array([data.count(b"\n") + 1 for data in found.texts], pa.int64()),
            "n_dropped": pa.array([len(dropped.get(d, ())) for d in range(len(kept))], pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    schema = T.StructType([
        *[docs.schema[k] for k in keep], T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    arrow_schema = to_arrow_schema(schema)
    answer_schema = T.StructType([
        T.StructField("block", T.BinaryType()), T.StructField("shard", T.LongType()),
        T.StructField("codes", T.ArrayType(T.IntegerType())),
        T.StructField("largest", T.ArrayType(id_type))])
    arrow_answers = to_arrow_schema(answer_schema)
    block_schema = T.StructType([
        T.StructField("block", T.BinaryType()), T.StructField("shards", T.IntegerType()),
        *[T.StructField(f"c{i}", T.ArrayType(source.schema[c].dataType))
          for i, c in enumerate([*columns, "_text"])]])

    pieces = index.select("shard", "pieces").filter("pieces > 1")
    requests = (
        source.mapInArrow(asked, "block binary, shard long, codes binary, keys binary")
        .join(pieces, "shard", "left")
        .withColumn("piece", F.pmod(F.xxhash64("block"), F.coalesce("pieces", F.lit(1))).cast("int"))
        .drop("pieces"))
    copies = index.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    answers = requests.groupBy("shard", "piece").cogroup(
        copies.groupBy("shard", "piece")
    ).applyInArrow(
        lambda left, right: _answers(left, right, least_documents, arrow_answers), answer_schema)
    return source.mapInArrow(whole, block_schema).groupBy("block").cogroup(
        answers.groupBy("block")).applyInArrow(probed, schema)


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows. DuckDB's trim takes the characters to strip; translate lowers A-Z only.
ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, n, i, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (
    SELECT doc_id, n, unnest(parts) AS line, unnest(range(len(parts))) AS i
    FROM (SELECT doc_id, row_number() OVER () AS n,
                 string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
often AS (
  SELECT k, max(doc_id) AS largest FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT n) >= 5),
marked AS (
  SELECT l.*, o.k IS NOT NULL AND o.largest IS NOT NULL
              AND l.doc_id IS DISTINCT FROM o.largest AS gone
  FROM lines l LEFT JOIN often o USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
  count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY n
"""
