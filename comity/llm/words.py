"""Texts as dictionary-coded words, and a Spark-wide table of distinct words.

A block is a run of documents of one input task, at most BLOCK_BYTES of text (a longer
document is a block of its own) and BLOCK_ROWS rows. A block codes its words by a dictionary of its own.
``map_words`` sends the dictionaries, never the words in order, through the shuffle:

    block dictionaries -> by word -> one call per distinct word -> back by block

so a word that makes up a third of a corpus moves once per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from comity.llm.common import bounded_batches

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1 << 16


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.Table]:
    """Batches cut and joined into tables of about BLOCK_BYTES of text, BLOCK_ROWS at most."""
    held, size, rows = [], 0, 0
    for batch in batches:
        lengths = text_lengths(batch.column(column))
        start = 0
        for end in range(batch.num_rows):
            if size and size + lengths[end] > BLOCK_BYTES or rows == BLOCK_ROWS:
                held.append(batch.slice(start, end - start))
                yield pa.Table.from_batches(held)
                held, size, rows, start = [], 0, 0, end
            size += int(lengths[end])
            rows += 1
        held.append(batch.slice(start))
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def text_lengths(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, 0 for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


class Split:
    """The words of some texts: runs of characters other than ASCII white space.

    ``words`` holds them in order, ``counts`` how many each text has, ``starts`` and
    ``ends`` where they lie in ``data``, the texts' bytes, ``offsets`` where each text does.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        if data is None:
            data = np.empty(0, np.uint8)
        else:
            data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        solid = (data != 32) & ((data < 9) | (data > 13))
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[begins] = solid[begins]
        ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[ends] = solid[ends]
        self.data, self.offsets = data, offsets
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        bounds = np.zeros(len(self.starts) + 1, np.int32)
        np.cumsum(self.ends - self.starts, out=bounds[1:])
        self.words = pa.StringArray.from_buffers(
            len(self.starts), pa.py_buffer(bounds), pa.py_buffer(data[solid])
        )
        self.counts = np.diff(np.searchsorted(self.starts, offsets))

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """The code of each word, and the distinct words by code."""
        if not len(self.words):
            return np.empty(0, np.int32), pa.array([], pa.string())
        coded = self.words.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary


def _dealt(words: pa.Array, parts: int) -> np.ndarray:
    """The part of each word, by a hash of its bytes that is the same everywhere."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    place = (np.arange(len(data)) - np.repeat(offsets[:-1], lengths)).astype(np.uint64)
    data = (data + np.uint64(1) + (place << np.uint64(8))) * np.uint64(0x9E3779B97F4A7C15)
    data ^= data >> np.uint64(29)
    data *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.add.reduceat(data, offsets[:-1])
    total ^= total >> np.uint64(32)
    return (total % np.uint64(parts)).astype(np.int32)


def _coded_block(block: pa.Table, column: str, parts: int):
    """Name, split, codes, the distinct words, and their parts.

    Words and codes go by falling count, so that codes press well; the name is a digest of
    the block's texts.
    """
    split = Split(block.column(column))
    codes, words = split.coded()
    order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    words = words.take(pa.array(order))
    name = hashlib.blake2b(digest_size=16)
    name.update(split.data)
    name.update(split.offsets)
    part = _dealt(words, parts) if len(words) else np.empty(0, np.int32)
    return name.digest(), split, rank[codes], words, part


def map_words(
    docs: DataFrame,
    keep: list[str],
    per_word: Callable[[list[str]], list],
    per_block: Callable[[dict], pa.Table],
    schema: T.StructType,
    text: str = "text",
    parts: int | None = None,
    with_gaps: bool = False,
) -> DataFrame:
    """Apply ``per_word`` once to each distinct word of all texts, then ``per_block``.

    per_word: distinct words -> one list of int32 for each.
    per_block: a dict of ``values`` (that list of every word, in text order, as a list
    array), ``counts`` (words per text), the ``keep`` columns by name, and with
    ``with_gaps`` ``starts``, ``ends`` (character positions of the words in their text)
    and ``lengths`` (characters per text) -> a table of ``schema``.

    ``docs`` must give the same rows in the same order each time it is read, as a scan
    of files does: it is read once for the dictionaries and once for the order of words.
    Blocks are named by a digest of their words; a block without its dictionary fails.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounded_batches(spark)
    source = docs.select(*keep, text)

    def dictionaries(batches):
        for block in blocks(batches, text):
            name, _, _, words, part = _coded_block(block, text, parts)
            order = np.argsort(part, kind="stable")
            part, words = part[order], words.take(pa.array(order))
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            lists = [_pressed_words(words[a:b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(lists), pa.binary()),
                 pa.array(part[cuts[:-1]], pa.int32()), pa.array(lists, pa.binary())],
                ["block", "part", "words"],
            )

    def valued(group: pa.Table) -> pa.Table:
        lists = [_opened_words(words) for words in group.column("words")]
        coded = pa.concat_arrays(lists).dictionary_encode()
        values = pa.array(per_word(coded.dictionary.to_pylist()), pa.list_(pa.int32()))
        values = values.take(coded.indices)
        sizes = pc.list_value_length(values)
        bounds = np.concatenate([[0], np.cumsum([len(words) for words in lists])])
        ends = np.concatenate([[0], np.cumsum(sizes.to_numpy())])[bounds]
        flat = values.flatten().to_numpy()
        return pa.Table.from_arrays(
            [group.column("block"), group.column("part"),
             pa.array([_pressed(sizes.to_numpy()[a:b]) for a, b in zip(bounds, bounds[1:])]),
             pa.array([_pressed(flat[a:b]) for a, b in zip(ends, ends[1:])])],
            ["block", "part", "sizes", "flat"],
        )

    def orders(batches):
        for block in blocks(batches, text):
            name, split, codes, _, part = _coded_block(block, text, parts)
            arrays = {"block": name, "codes": _pressed(codes), "parts": _pressed(part), "counts": _pressed(split.counts.astype(np.int32)),
                      "gaps": b"", "spans": b"", "lengths": b""}
            if with_gaps:
                # Continuation bytes are not characters: count the others.
                at = np.concatenate([[0], np.cumsum((split.data & 0xC0) != 0x80)])
                base = np.repeat(at[split.offsets[:-1]], split.counts)
                starts, ends = at[split.starts] - base, at[split.ends] - base
                before = np.concatenate([[0], ends])[:len(ends)]
                before[(np.cumsum(split.counts) - split.counts)[split.counts > 0]] = 0
                arrays |= {"gaps": _pressed((starts - before).astype(np.int32)),
                           "spans": _pressed((ends - starts).astype(np.int32)),
                           "lengths": _pressed(np.diff(at[split.offsets]).astype(np.int32))}
            arrays = {k: pa.array([v], pa.binary()) for k, v in arrays.items()}
            for name_ in keep:
                column = block.column(name_).combine_chunks()
                arrays[f"k_{name_}"] = pa.ListArray.from_arrays(
                    pa.array([0, len(column)], pa.int32()), column)
            yield pa.RecordBatch.from_pydict(arrays)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("the documents changed between two readings of them")
        # Blocks with the same words have the same dictionary: one copy of it serves.
        right = right.sort_by("part")
        part = right.column("part").to_numpy()
        right = right.take(pa.array(np.flatnonzero(np.diff(part, prepend=-1))))
        sizes = [_opened(x) for x in right.column("sizes")]
        flat = [_opened(x) for x in right.column("flat")]
        none = np.empty(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(np.concatenate([none, *sizes]))])
        table = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(np.concatenate([none, *flat])))
        made = []
        for row in left.to_batches():
            for i in range(row.num_rows):
                made.append(_applied(row.slice(i, 1), table))
        return pa.concat_tables(made).cast(arrow_schema)

    def _applied(row: pa.RecordBatch, table: pa.ListArray) -> pa.Table:
        part = _opened(row.column("parts")[0])
        if len(part) != len(table):
            raise ValueError("the documents changed between two readings of them")
        place = np.empty(len(part), np.int32)
        place[np.argsort(part, kind="stable")] = np.arange(len(part), dtype=np.int32)
        given = {"values": table.take(pa.array(place[_opened(row.column("codes")[0])])),
                 "counts": _opened(row.column("counts")[0]).astype(np.int64)}
        if with_gaps:
            gaps = _opened(row.column("gaps")[0]).astype(np.int64)
            spans = _opened(row.column("spans")[0])
            total = np.cumsum(gaps + spans)
            bounds = np.concatenate([[0], np.cumsum(given["counts"])])
            base = np.concatenate([[0], total])[bounds[:-1]]
            given["ends"] = total - np.repeat(base, given["counts"])
            given["starts"] = given["ends"] - spans
            given["lengths"] = _opened(row.column("lengths")[0])
        given |= {name: row.column(f"k_{name}").flatten() for name in keep}
        return per_block(given)

    arrow_schema = to_arrow_schema(schema)
    by_word = source.mapInArrow(
        dictionaries, "block binary, part int, words binary"
    ).groupBy("part").applyInArrow(
        valued, "block binary, part int, sizes binary, flat binary"
    )
    kept = [T.StructField(f"k_{f.name}", T.ArrayType(f.dataType)) for f in source.schema
            if f.name in keep]
    order_schema = T.StructType([
        *[T.StructField(c, T.BinaryType())
          for c in ("block", "codes", "parts", "counts", "gaps", "spans", "lengths")], *kept])
    in_order = source.mapInArrow(orders, order_schema)
    return in_order.groupBy("block").cogroup(by_word.groupBy("block")).applyInArrow(joined, schema)


def _pressed(values: np.ndarray) -> bytes:
    """int32 values, the four bytes of all of them apart, compressed."""
    planes = np.ascontiguousarray(values, "<i4").view(np.uint8).reshape(-1, 4).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _opened(data: pa.Scalar) -> np.ndarray:
    data = data.as_py()
    size = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], 4 * size, "zstd", asbytes=True)
    return np.ascontiguousarray(
        np.frombuffer(planes, np.uint8).reshape(4, size).T).view("<i4").reshape(size)


def _pressed_words(words: pa.Array) -> bytes:
    """Words, which hold no white space, joined by it and compressed."""
    raw = "\n".join(words.to_pylist()).encode()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _opened_words(data: pa.Scalar) -> pa.Array:
    data = data.as_py()
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return pa.array(raw.decode().split("\n"), pa.string())
