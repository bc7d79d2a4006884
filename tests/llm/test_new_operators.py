"""Periodic runs, line dedup and whitening against brute-force versions of them."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from comity.llm import line_dedup, queries, runs, whitening
from tests.llm.test_operators import SF_DIR, awkward, digest, nothing, plain, same  # noqa: F401

# Operator 11


def lyndon_by_definition(symbols):
    out = []
    for i in range(len(symbols)):
        j = i + 1
        while j < len(symbols) and symbols[j:] > symbols[i:]:
            j += 1
        out.append(j - i)
    return out


def runs_by_definition(words, min_length=6, min_exponent=4):
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, min_exponent * q) and not any(
                words[i:i + length - d] == words[i + d:i + length] for d in range(1, q)
            ):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
def test_contexts_of_groups_are_lyndon_words(symbols):
    ranks = [sorted(set(symbols)).index(s) for s in symbols]
    assert runs.lyndon_lengths(ranks) == lyndon_by_definition(ranks)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 5),
       st.lists(st.integers(0, 2), max_size=6), st.sampled_from([(6, 4), (2, 2), (1, 3)]))
def test_runs_of_any_word(root, times, tail, least):
    word = root * times + tail
    found = runs.runs_of(np.array(word), *least)
    assert [tuple(r) for r in found.tolist()] == runs_by_definition(word, *least)
    of, cut = runs.block_runs(np.array(word * 2), np.array([len(word), 0, len(word)]), *least)
    want = runs_by_definition(word, *least)
    assert [(d, *r) for d, r in zip(of.tolist(), map(tuple, cut.tolist()))] == [
        (d, *r) for d in (0, 2) for r in want]


def run_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs_by_definition(words)
    kept = [True] * n
    for start, length, period in found:
        kept[start + period:start + length] = [False] * (length - period)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            digest("".join(f"{s},{le},{p}\n" for s, le, p in found)),
            digest(" ".join(w for w, k in zip(words, kept) if k)))


def test_periodic_runs_equal_a_plain_search(spark, awkward, nothing):  # noqa: F811
    repeated = [(i, " ".join(["a b c"] * 9 + ["x"] * i + ["b c"] * 4)) for i in range(20, 260)]
    docs = awkward.select("doc_id", "text", F.lit(0).alias("runs"), F.lit(1).alias("n_words")) \
        .filter("n_chars < 100000").unionByName(
            spark.createDataFrame(repeated, "doc_id long, text string"), allowMissingColumns=True)
    got = runs.run_digests(docs)
    same(plain(got), [run_row(r.doc_id, r.text) for r in docs.collect()])
    assert got.filter("n_runs > 0").count() > 200
    assert runs.run_digests(nothing).count() == 0


def test_the_operator_gives_runs_and_text(spark):
    docs = spark.createDataFrame(
        [(1, "so so so so so so it is"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.periodic_runs(docs).collect()}
    assert got[1].runs == [(0, 6, 1)] and got[1].collapsed == "so it is"
    assert got[1].strongest == (0, 6, 1) and got[1].n_words == 8
    for i in (2, 3):
        assert (got[i].runs, got[i].strongest, got[i].collapsed, got[i].n_words) == ([], None, "", 0)


def test_a_very_long_periodic_text(spark):
    text = "the quick brown fox " * 50_000
    docs = spark.createDataFrame([(2, text)], "doc_id long, text string")
    got = runs.periodic_runs(docs).first()
    assert got.runs == [(0, 200_000, 4)] and got.collapsed == "the quick brown fox"


def test_runs_of_the_test_documents(spark):
    got = queries.op11_runs(spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    same(plain(got), [run_row(r.doc_id, r.text) for r in docs])


# Operator 12


def kept_lines(rows, least_length=40, least_documents=5):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = [(i, [(ln, ln.strip(strip).translate(lower)) for ln in (t or "").split("\n")])
             for i, t in rows]
    holders = defaultdict(list)
    for d, (i, lines) in enumerate(split):
        for key in {k for _, k in lines if len(k) >= least_length}:
            holders[key].append(i)
    last = {k: max((i for i in ids if i is not None), default=None)
            for k, ids in holders.items() if len(ids) >= least_documents}
    out = []
    for i, lines in split:
        kept = [ln for ln, k in lines if last.get(k) is None or last[k] == i]
        out.append((i, len(lines), len(lines) - len(kept), digest("\n".join(kept))))
    return out


def line_rows(count=400):
    rng = random.Random(3)
    shared = [f"Line {i:02} is shared by documents, and long enough é" for i in range(60)]
    shared += ["x" * 40, "é" * 40, "É" * 40, "é" * 39, "x" * 39, "Y" * 40, "y" * 40]
    rows = [(None, None), (1, ""), (2, "\n\n"), (3, " \t"), (3, " \t")]
    for i in range(count):
        lines = [rng.choice(["", "\t", "  "]) + rng.choice(shared).upper()[:rng.choice([40, 90])]
                 + rng.choice(["", " \r", "\x0b"]) for _ in range(rng.randrange(6))]
        lines += [f"own line number {i} {rng.random()} of this document, no other"] * (i % 3)
        rng.shuffle(lines)
        rows.append((rng.choice([None, *range(10, 200)]), "\n".join(lines)))
    rows += [(None, "only documents without an id hold this line of text")] * 6
    rows.append((900, "\n".join(shared[0].upper() if j % 2 else f"long text {j} " * 5
                                for j in range(30_000))))
    return rows


@pytest.mark.parametrize("shard", [None, 16])
def test_line_dedup_equals_a_plain_count(spark, monkeypatch, shard):
    if shard:  # many shards, and crowded ones in pieces
        monkeypatch.setattr(line_dedup, "SHARD", shard)
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"kept": F.lit(1), "n_lines": F.lit("x"), "block": F.lit(None)}).repartition(7)
    docs = queries_table(docs)
    same(plain(line_dedup.line_digests(docs)), kept_lines([(r[0], r[1]) for r in rows]))


def queries_table(docs):
    from comity.llm.common import stored
    return stored(docs.drop("block"), "lines-in")


def test_line_dedup_of_awkward_tables(spark, awkward, nothing):  # noqa: F811
    docs = queries_table(awkward)
    same(plain(line_dedup.line_digests(docs)),
         kept_lines([(r.doc_id, r.text) for r in awkward.collect()]))
    assert line_dedup.line_digests(queries_table(nothing)).count() == 0
    text_ids = spark.createDataFrame(
        [(c, "\n".join(["z" * 50, c])) for c in "abcdef"], "name string, body string")
    got = line_dedup.dedup_lines(text_ids, keep=("name",), text="body", ids="name")
    assert {r.name: r.kept for r in got.collect()} == {
        **{c: c for c in "abcde"}, "f": "z" * 50 + "\nf"}


def test_line_dedup_equals_its_sql(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    rel = con.sql(line_dedup.ORACLE_SQL)
    got = queries.op12_line_dedup(spark, SF_DIR)
    assert rel.columns == got.columns
    same(plain(got), rel.fetchall())


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=300))
def test_perfect_hash_is_minimal(keys):
    halves = np.array(sorted(keys), np.uint64).reshape(-1, 2)
    perfect = line_dedup.PerfectHash.of(halves[:, 0], halves[:, 1])
    again = line_dedup.PerfectHash(perfect.sizes, perfect.words)
    assert sorted(again.places(halves[:, 0], halves[:, 1])) == list(range(len(halves)))


def test_changed_documents_are_noticed(spark):
    from comity.llm.common import stored
    docs = spark.createDataFrame([(i, f"{i} " + "l" * 60) for i in range(9)], "doc_id long, text string")
    lines = stored(line_dedup.distinct_lines(
        docs.select("doc_id", F.col("text").cast("binary").alias("text"))), "lines")
    index, shards = line_dedup.line_index(lines)
    assert shards == 1 and lines.count() == 9
    table = index.toArrow()
    asked = line_dedup.BlockLines(docs.selectExpr(
        "doc_id", "cast(concat(text, 'other') as binary) text").toArrow(), ["doc_id"], "text", 40)
    import pyarrow as pa
    request = pa.table({
        "block": [asked.name], "shard": [0],
        "codes": [np.arange(9, dtype="<i4").tobytes()],
        "keys": [asked.high.tobytes() + asked.low.tobytes()]})
    with pytest.raises(ValueError, match="changed"):
        line_dedup._answers(request, table, 5, pa.schema([]))


# Operator 13


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n int, whitened int")


def whitened_by_definition(rows):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    off = x * n - s
    cov = np.array((off.T @ off), float) / float(n) ** 3
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e)[:32]
    return [int(d) for d in (off * off).sum(1)], e[order] / np.trace(cov), e[order], u[:, order], \
        np.array(off, float) / n


def check_whitened(df, rows):
    deviations, explained, e, u, off = whitened_by_definition(rows)
    got = defaultdict(list)
    for r in df.collect():
        got[r.vec_id].append(r)
    assert sorted(got) == sorted(i for i, _ in rows)
    signs = None
    errors = {r.identity_error for found in got.values() for r in found}
    assert len(errors) == 1 and errors.pop() < 1e-9
    for k, (i, _) in enumerate(rows):
        found = sorted(got[i], key=lambda r: r.component)
        assert [r.component for r in found] == list(range(1, len(e) + 1))
        assert {r.deviation for r in found} == {deviations[k]}
        assert {r.n for r in found} == {len(rows)}
        assert np.allclose([r.explained for r in found], explained, rtol=1e-9)
        white = np.array([r.whitened for r in found])
        want = off[k] @ u / np.sqrt(e)
        signs = np.sign(white * want) if signs is None else signs
        assert np.allclose(white, signs * want, atol=1e-7)


def test_whitening_equals_plain_arithmetic(spark):
    rng = np.random.default_rng(5)
    mixing = rng.normal(size=(6, 6)) * np.arange(1, 7)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6) @ mixing]) for i in range(300)]
    bad = [(900, None), (901, [1.0, None, 1, 1, 1, 1]), (902, [float("nan")] * 6),
           (903, [float("inf"), 0, 0, 0, 0, 0]), (904, [1.0, 2.0]), (905, [])]
    df = vectors_of(spark, [(i, v and [c if c is None else float(c) for c in v], 0, 1)
                            for i, v in rows + bad])
    check_whitened(whitening.whiten(df.repartition(5)), rows)


def test_whitening_of_the_test_vectors(spark):
    rows = [(r.vec_id, r.embedding)
            for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    check_whitened(queries.op13_whitening(spark, SF_DIR), rows)


def test_whitening_without_variance(spark):
    none = vectors_of(spark, [(1, None, 0, 0), (None, [], 0, 0)])
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(none.limit(0)).count() == 0
    one = whitening.whiten(vectors_of(spark, [(1, [0.5, 2.0], 0, 0)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error)
            for r in one] == [(c, 1, 0, None, 0.0, None) for c in (1, 2)]
    # Two ids alike and a dimension that is the same everywhere.
    flat = whitening.whiten(vectors_of(
        spark, [(1, [0.0, 2.0], 0, 0), (1, [1.0, 2.0], 0, 0), (None, [2.0, 2.0], 0, 0)])).collect()
    assert [(r.vec_id, r.deviation) for r in flat if r.component == 1] == [
        (1, 192 ** 2), (1, 0), (None, 192 ** 2)]
    assert all(r.whitened is None and r.explained == 0 for r in flat if r.component == 2)
    assert {r.explained for r in flat if r.component == 1} == {1.0}


def test_whitening_of_great_numbers(spark):
    rows = [(i, [float((-1) ** i * i * 2 ** 44), float(i % 3), 1e-3 * i * i]) for i in range(40)]
    got = whitening.whiten(vectors_of(spark, [(*r, 0, 0) for r in rows], "double")).collect()
    deviations, *_ = whitened_by_definition(rows)
    for r in got:
        want = deviations[r.vec_id]
        assert r.deviation == (want if want < 2 ** 63 else None)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2**40)] * 3), min_size=1, max_size=130))
def test_bit_planes_give_exact_products(rows):
    x = np.array(rows, np.int64)
    bits = [int(c).bit_length() for c in x.max(0)]
    wide = x.astype(object)
    assert (whitening.cross_products(x, bits) == wide.T @ wide).all()
