"""Operator 5: exact token counts at every prefix, by prefix dynamic programming.

The table this builds holds, for each document, the token count of every prefix of its
text. Budget and truncation questions then are look-ups: ``count_at`` reads one entry,
``fits`` finds the longest prefix within a limit; nothing is encoded again.

Within a word the counts come from one pass over its characters. If BPE puts a token
boundary at p, what stands before p is split exactly as the prefix of length p alone. So
the last token of each prefix, and with it the count, follows from shorter prefixes: it is
the one vocabulary entry that ends there and may stand next to the last token before it.
Each distinct word of the corpus is worked out once (words.map_words).

Words are cut as the tokenizer cuts them: runs of letters, runs of marks, single digits,
contractions, special strings. Sequences that compose to one character are read again for
each of their prefixes, which grows with the square of such a sequence's length alone.

Defined results: null and empty texts count 0 tokens and 0 bytes; null or repeated document
ids stay as they are; white space adds no token; other columns are ignored. Longest texts
need four bytes a character while their block is worked on, and the longest word without
ASCII white space about 100 bytes a byte.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comity.llm.bpe import open_tokenizer, tokenizer_file
from comity.llm.words import map_words

LIMIT = 2048
PAIRS = 1 << 20  # neighbours a worker remembers; then it starts anew
LETTERS = re.compile(r"[^\W\d_]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class PrefixCounter:
    """Token counts of all prefixes of words, for a byte-level BPE with word ends."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.tokenizer = open_tokenizer(path)
        self.end = model["end_of_word_suffix"]
        # Each token leads to itself: lists of tokens hold no copies.
        self.vocabulary = {token: token for token in model["vocab"]}
        self.widest = max(map(len, self.vocabulary), default=1)
        self.ended = {t.removesuffix(self.end): t for t in self.vocabulary
                      if t.endswith(self.end) and t != self.end}
        self.ends = set(self.ended.values())
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        self.symbols = byte_symbols()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.state = [""], [0], [], ""
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.specials = re.compile("|".join(map(re.escape, added))) if added else None
        self.normals: dict[str, str] = {}
        self.kinds: dict[str, str] = {}
        self.wholes: dict[str, int] = {}

    def stands(self, left: str, right: str) -> bool:
        """Whether BPE splits the text of both tokens into just these two; remembered."""
        parts = [*left, *right.removesuffix(self.end)] if right in self.ends else [*left, *right]
        if right in self.ends:
            parts[-1] += self.end
        ranks, none = self.ranks, len(self.ranks)
        while len(parts) > 1:
            found = [ranks.get(pair, none) for pair in zip(parts, parts[1:])]
            best = min(found)
            if best == none:
                break
            at = found.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        fit = parts == ([left, right] if left else [right])
        self.pairs[left, right] = fit
        return fit

    def run(self, text: str) -> list[int]:
        """Counts after each character of a run of letters in lower case, composed form."""
        data = text.encode()
        plain_text = text.isascii() and text.isprintable()
        word = text if plain_text else "".join([self.symbols[b] for b in data])
        plain, ended, pairs, stands = self.vocabulary, self.ended, self.pairs, self.stands
        # What the run before shares with this one is worked out already.
        last, count, out, same = self.state
        shared = len(os.path.commonprefix((word, same)))
        characters = len(data[:shared].decode(errors="ignore"))
        if shared < len(word) and data[shared] & 0xC0 == 0x80:
            shared = len(text[:characters].encode())
        del last[shared + 1:], count[shared + 1:]
        out = out[:characters]
        for i in range(shared + 1, len(word) + 1):
            whole = i == len(word) or data[i] & 0xC0 != 0x80
            inner = outer = -1
            for p in range(i - 1, -1, -1):
                token = word[p:i]
                if inner < 0 and token in plain:
                    fit = pairs.get((last[p], token))
                    if fit or fit is None and stands(last[p], token):
                        inner = p
                if outer < 0 and whole and token in ended:
                    fit = pairs.get((last[p], ended[token]))
                    if fit or fit is None and stands(last[p], ended[token]):
                        outer = p
                if inner >= 0 and (outer >= 0 or not whole):
                    break
            last.append(plain[word[inner:i]])
            count.append(count[inner] + 1)
            if whole:
                out.append(count[outer] + 1)
        self.state = last, count, out, word
        return out

    def word(self, text: str) -> list[int]:
        """Counts after each character of a word without ASCII white space."""
        lower = text.lower()
        if (
            len(lower) == len(text) and "'" not in text and "<|" not in text
            and "\u03a3" not in text  # whose lower case depends on its place only in Python
            and (text.isascii() or (all(c.isascii() or c.isalpha() for c in text)
                                    and unicodedata.is_normalized("NFC", text)
                                    and unicodedata.is_normalized("NFC", lower)))
        ):
            out, base, at = [], 0, 0
            for run in LETTERS.finditer(lower):
                counts = self.marks(lower[at:run.start()])
                counts += [(counts[-1] if counts else 0) + c for c in self.run(run[0])]
                out += [base + c for c in counts]
                base, at = out[-1], run.end()
            return out + [base + c for c in self.marks(lower[at:])]
        return self.general(text)

    def marks(self, text: str) -> list[int]:
        """Counts after each character of ASCII digits and punctuation."""
        out, base = [], 0
        for piece in re.findall(r"[0-9]|[^0-9]+", text):
            counts = [1] if piece.isdigit() else self.run(piece)
            out += [base + c for c in counts]
            base += counts[-1]
        return out

    def general(self, text: str) -> list[int]:
        """Counts of a word with special strings or characters of any kind."""
        out, base, at = [], 0, 0
        for found in self.specials.finditer(text) if self.specials else ():
            # Until its last character a special string is text like any other; then the
            # text before it ends and it is one token.
            out += [base + c for c in self.ordinary(text[at:found.end() - 1])]
            base = (out[found.start() - 1] if found.start() > at else base) + 1
            out.append(base)
            at = found.end()
        return out + [base + c for c in self.ordinary(text[at:])]

    def ordinary(self, text: str) -> list[int]:
        """Counts after each character, which composes with those after it at most until the
        next that starts a letter anew; such a sequence is read again for each of its prefixes."""
        out, reader, start = [], Reader(self), 0
        while start < len(text):
            end = start + 1
            while end < len(text) and composes(text[end]):
                end += 1
            if end - start > 1:
                mark = reader.mark()
                for i in range(start + 1, end):
                    out.append(reader.feed(self.normal(text[start:i])))
                    reader.back_to(mark)
            out.append(reader.feed(self.normal(text[start:end])))
            start = end
        return out

    def normal(self, text: str) -> str:
        """The tokenizer's own normal form; that of single characters is remembered."""
        if len(text) > 1:
            return self.tokenizer.normalizer.normalize_str(text)
        if text not in self.normals:
            self.normals[text] = self.tokenizer.normalizer.normalize_str(text)
        return self.normals[text]

    def kind(self, character: str) -> str:
        """How the tokenizer cuts at a character: runs of letters and of marks stay whole,
        numbers stand alone, blanks are dropped."""
        if character not in self.kinds:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            pieces = len(cut(character * 2))
            if pieces == 1:
                kind = "letter" if len(cut("a" + character)) == 1 else "mark"
            else:
                kind = "number" if pieces else "blank"
            self.kinds[character] = kind
        return self.kinds[character]

    def whole(self, piece: str) -> int:
        """Tokens of a short piece, remembered."""
        if piece not in self.wholes:
            run = Run(self)
            for character in piece:
                run.extend(character)
            self.wholes[piece] = run.value
        return self.wholes[piece]


class Run:
    """One growing piece: for each byte the last token and the count up to it.

    Tokens have ``widest`` bytes at most, so only the end of the text is kept.
    """

    __slots__ = ("counter", "last", "count", "tail", "value")

    def __init__(self, counter: PrefixCounter):
        self.counter, self.last, self.count = counter, [""], array("i", [0])
        self.tail, self.value = "", 0

    def extend(self, character: str) -> None:
        counter = self.counter
        plain, ended, pairs, stands = (
            counter.vocabulary, counter.ended, counter.pairs, counter.stands)
        last, count = self.last, self.count
        data = character.encode()
        for k, byte in enumerate(data):
            tail = self.tail = (self.tail + counter.symbols[byte])[-counter.widest:]
            here, whole, size = len(last), k == len(data) - 1, len(tail)
            inner = outer = 0
            for width in range(1, size + 1):
                token, before = tail[size - width:], last[here - width]
                if not inner and token in plain:
                    fit = pairs.get((before, token))
                    if fit or fit is None and stands(before, token):
                        inner = width
                        taken = plain[token]
                if not outer and whole and token in ended:
                    fit = pairs.get((before, ended[token]))
                    if fit or fit is None and stands(before, ended[token]):
                        outer = width
                if inner and (outer or not whole):
                    break
            if whole:
                self.value = count[here - outer] + 1
            last.append(taken)
            count.append(count[here - inner] + 1)

    def mark(self) -> tuple:
        return len(self.last), self.tail, self.value

    def back_to(self, mark: tuple) -> None:
        size, self.tail, self.value = mark
        del self.last[size:], self.count[size:]


CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")  # fixed values of the tokenizer


class Reader:
    """Cuts normal text into pieces as it comes, and counts their tokens.

    An apostrophe that stands alone before a letter may begin a contraction, which is a
    piece of its own; the reader then takes back the apostrophe it has counted.
    """

    def __init__(self, counter: PrefixCounter):
        self.counter = counter
        self.closed, self.run, self.kind, self.piece = 0, None, "", ""
        self.quoted = None  # the count before an apostrophe that the piece follows

    def mark(self) -> tuple:
        held = self.run and self.run.mark()
        return self.closed, self.run, self.kind, self.piece, self.quoted, held

    def back_to(self, mark: tuple) -> None:
        self.closed, self.run, self.kind, self.piece, self.quoted, held = mark
        if self.run:
            self.run.back_to(held)

    @property
    def total(self) -> int:
        return self.closed + (self.run.value if self.run else 0)

    def feed(self, text: str) -> int:
        for character in text:
            self._feed(character)
        return self.total

    def _close(self, total: int) -> None:
        self.closed, self.run, self.kind, self.piece, self.quoted = total, None, "", "", None

    def _feed(self, character: str) -> None:
        counter = self.counter
        kind = counter.kind(character)
        if kind == "blank":
            self._close(self.total)
        elif kind == "number":
            self._close(self.total + counter.whole(character))
        elif kind == self.kind:
            if self.quoted is not None and f"'{self.piece}{character}" in CONTRACTIONS:
                self._close(self.quoted + counter.whole(f"'{self.piece}{character}"))
                return
            self.run.extend(character)
            # Only the first two characters of a piece matter to its neighbours.
            self.piece, self.quoted = (self.piece + character)[:2], None
        else:
            before = self.closed if kind == "letter" and self.piece == "'" else None
            if before is not None and f"'{character}" in CONTRACTIONS:
                self._close(before + counter.whole(f"'{character}"))
                return
            self._close(self.total)
            self.run, self.kind, self.piece, self.quoted = Run(counter), kind, character, before
            self.run.extend(character)


@functools.cache
def _seconds() -> frozenset[str]:
    """Characters that compose with one before them."""
    found = {chr(c) for c in range(0x1161, 0x11C3)}
    for code in range(0x20000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def composes(character: str) -> bool:
    """Whether a character may change with those before it when they are composed."""
    return not character.isascii() and (
        unicodedata.combining(character) > 0 or character in _seconds())


def prefix_block(limit: int, keep: list[str], store: bool):
    def per_block(given: dict) -> pa.Table:
        """The prefix table of a block's documents, and the answers asked of it."""
        values, counts, lengths = given["values"], given["counts"], given["lengths"]
        spans = (given["ends"] - given["starts"]).astype(np.int64)
        inside = values.flatten().to_numpy(zero_copy_only=False)
        totals = inside[np.cumsum(spans) - 1] if len(spans) else np.empty(0, np.int32)
        words = np.concatenate([[0], np.cumsum(counts)])
        run = np.concatenate([[0], np.cumsum(totals)])
        before = run[:-1] - np.repeat(run[words[:-1]], counts)
        at = np.concatenate([[0], np.cumsum(spans)])
        tokens, fits, tables = [], [], []
        for d in range(len(counts)):
            w = slice(words[d], words[d + 1])
            table = np.zeros(lengths[d] + 1, np.int32)
            chars = at[words[d + 1]] - at[words[d]]
            if chars:
                # Characters of words, in text order; white space keeps the count so far.
                where = np.arange(chars) - np.repeat(at[w] - at[words[d]], spans[w])
                where += np.repeat(given["starts"][w], spans[w])
                table[where + 1] = inside[at[words[d]]:at[words[d + 1]]] + \
                    np.repeat(before[w], spans[w])
                gaps = np.ones(lengths[d] + 1, bool)
                gaps[where + 1] = False
                gaps[0] = False
                if gaps.any():
                    source = np.where(gaps, 0, np.arange(lengths[d] + 1))
                    table = table[np.maximum.accumulate(source)]
            tokens.append(int(table[-1]))
            over = np.flatnonzero(table > limit)
            fits.append(int(over[0]) - 1 if len(over) else int(lengths[d]))
            if store:
                tables.append(table)
        out = {**{name: given[name] for name in keep},
               "n_tokens": pa.array(tokens, pa.int64()), "fits_chars": pa.array(fits, pa.int64())}
        if store:
            out["prefix_tokens"] = pa.array(tables, pa.list_(pa.int32()))
        return pa.table(out)

    return per_block


def prefix_counts(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT,
    keep: tuple[str, ...] = ("doc_id",), text: str = "text", store: bool = True,
) -> DataFrame:
    """The ``keep`` columns, ``n_tokens``, ``fits_chars`` and ``prefix_tokens``.

    ``prefix_tokens[i]`` is the token count of the first i characters, for i from 0 to the
    length of the text. ``fits_chars`` is the largest i up to which no prefix exceeds
    ``limit`` tokens. ``store=False`` answers from the table and drops it.
    """
    path, keep = path or tokenizer_file(), list(keep)
    schema = T.StructType([
        *[docs.schema[k] for k in keep], T.StructField("n_tokens", T.LongType()),
        T.StructField("fits_chars", T.LongType()),
        *[T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))] * store])

    def per_word(words: list[str]) -> list:
        counter, out = _counter(path), [[]] * len(words)
        for i in sorted(range(len(words)), key=words.__getitem__):
            out[i] = counter.word(words[i])
        return out

    return map_words(
        docs, keep, per_word, prefix_block(limit, keep, store), schema, text, with_gaps=True)


_OPEN: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    """One counter per worker, with what it has learnt of neighbouring tokens."""
    if path not in _OPEN:
        _OPEN[path] = PrefixCounter(path)
    return _OPEN[path]


def count_at(prefix_tokens, chars):
    """Column: tokens of the first ``chars`` characters."""
    return F.element_at(prefix_tokens, chars + 1)


def count_documents(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fits_chars of every whole text."""
    sized = docs.select(
        "doc_id", "text",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = prefix_counts(sized, path, limit, ("doc_id", "n_bytes"), store=False)
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
        "fits_chars")
