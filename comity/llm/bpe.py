"""Operator 1: BPE encoding and decoding over a distinct-word table.

``encode`` splits texts at ASCII white space, which no merge of a word tokenizer crosses,
encodes each distinct word of the corpus once and joins the ids back by position.
``decode`` joins ids to their pieces. The piece table has one row per vocabulary entry,
so it is bounded by MAX_VOCABULARY, which is checked, and the join runs map-side.

Defined results: a null or empty text has no ids and decodes to the empty text; a null id
list decodes as an empty one; null or repeated ids of documents are kept as they are; ids
outside the vocabulary fail. Further columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comity.llm.words import map_words

MAX_VOCABULARY = 1 << 20


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_OPEN: dict[str, tuple] = {}


def open_tokenizer(path: str):
    """The library's tokenizer, without truncation and padding; one per worker."""
    return _opened(path)[0]


def opened_pieces(path: str) -> pa.Array:
    """Piece by id; ids without a piece are null. One table per worker."""
    return _opened(path)[1]


def _opened(path: str) -> tuple:
    from tokenizers import Tokenizer

    if path not in _OPEN:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        if size > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of {size} ids is too large to send to every task")
        table = [None] * size
        for piece, i in vocabulary.items():
            table[i] = piece
        _OPEN[path] = tokenizer, pa.array(table, pa.string())
    return _OPEN[path]


def word_encoder(path: str) -> Callable[[list[str]], list]:
    def encode_words(words: list[str]) -> list:
        tokenizer = open_tokenizer(path)
        ids = []
        for i in range(0, len(words), 8192):
            ids += [e.ids for e in tokenizer.encode_batch_fast(
                words[i:i + 8192], add_special_tokens=False)]
        return ids

    return encode_words


def ids_of(given: dict) -> pa.ListArray:
    """The ids of each text of a block: those of its words, one after the other."""
    lists = given["values"]
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    words = np.concatenate([[0], np.cumsum(given["counts"])])
    return pa.ListArray.from_arrays(pa.array(ends[words], pa.int32()), lists.flatten())


def encode(
    docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """The ``keep`` columns and ``ids``, the token ids of each whole text."""
    keep = list(keep)
    schema = T.StructType([*[docs.schema[k] for k in keep],
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def per_block(given: dict) -> pa.Table:
        return pa.table({**{k: given[k] for k in keep}, "ids": ids_of(given)})

    return map_words(docs, keep, word_encoder(path or tokenizer_file()), per_block, schema, text)


def joined_pieces(lists: pa.ListArray, table: pa.Array) -> pa.Array:
    """The pieces of each list of ids, joined by a space."""
    flat = lists.flatten()
    known = not len(flat) or (pc.min(flat).as_py() >= 0 and pc.max(flat).as_py() < len(table))
    found = table.take(flat) if known and not flat.null_count else None
    if found is None or found.null_count:
        raise ValueError("an id without a piece")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found), " ")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the pieces of its ids, joined by a space.

    That is what the library gives for a tokenizer without a decoder of its own.
    """
    path = path or tokenizer_file()
    schema = T.StructType([f for f in encoded.schema if f.name != "decoded"] +
                          [T.StructField("decoded", T.StringType())])
    names = schema.names[:-1]

    def decoded(batches):
        table = opened_pieces(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], joined_pieces(part.column(ids), table)],
                    schema.names)

    return encoded.select(*names).mapInArrow(decoded, schema)


def encode_decode(
    docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """``encode`` followed by ``decode``, block by block: ``ids`` and ``decoded``."""
    path, keep = path or tokenizer_file(), list(keep)
    schema = T.StructType([*[docs.schema[k] for k in keep],
                           T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType())])

    def per_block(given: dict) -> pa.Table:
        ids = ids_of(given)
        return pa.table({**{k: given[k] for k in keep}, "ids": ids,
                         "decoded": joined_pieces(ids, opened_pieces(path))})

    return map_words(docs, keep, word_encoder(path), per_block, schema, text)


def round_trip(
    docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",),
    with_ids: bool = False,
) -> DataFrame:
    """The ``keep`` columns, n_tokens, and digests of the ids and of the decoded text.

    ``with_ids`` gives the ``ids`` themselves too.
    """
    return encode_decode(docs, path, keep).select(
        *keep, *(["ids"] if with_ids else []),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
