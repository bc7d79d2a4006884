"""Operator 3: toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic examples are the positives; a sample of all texts is the unlabelled set,
whatever their labels say. Hashed words and word beginnings get the strength of their association with the
positives; a numpy classifier over a text's strongest ones is fitted to the
class-prior-corrected risk

    prior * R+(positives, toxic) + max(0, R-(unlabelled) - prior * R-(positives, clean))

with the logistic loss. Where the second part falls below zero the step goes the other way
(the classifier has begun to fit unlabelled toxic texts as clean). The prior, the toxic share of
the corpus, can be given as ``prior``; otherwise it is the share of toxic rows among the
labelled ones that may be learnt from, which is right where labels look like the corpus. The
cut-off is a quantile: as large a share of the sample's unlabelled texts as the prior reaches
THRESHOLD.

Only rows whose crc32(doc_id as text) mod 4 is not 2 take part in learning, as positives
and as unlabelled text. Training uses a bounded sample, POSITIVES and UNLABELLED texts at
most, those with the smallest hash of their id; their features, not their texts, reach
the driver. Scoring covers every whole text, task by task.

Defined results: null and empty texts have no features and score as such a text does;
documents without a label or with a null one are unlabelled; null ids count as held out;
without any positive example or any text all scores are 0; repeated rows are scored alike;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comity.llm.common import bounded_batches, original, renamed, table
from comity.llm.words import Split, blocks

POSITIVES = 4_000
UNLABELLED = 12_000
SLOTS = 1 << 22
BEGINNING = 5  # characters of a word's beginning
THRESHOLD = 0.3
PSEUDO = 3.0
LEVELS = (0.5, 0.75, 1.0, 1.25)
EDGES = ".,;:!?\"'()[]{}<>|$%&*#"


def held_out() -> Column:
    """Rows that learning never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the distinct features of each text, and how many each text has.

    A word in lower case without punctuation at its edges gives one feature, its first
    characters another.
    """
    split = Split(texts)
    codes, words = split.coded()
    if not len(words):
        return np.empty(0, np.int64), np.zeros(len(split.counts), np.int64)
    words = pc.utf8_trim(pc.utf8_lower(words), EDGES)
    begin = pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(words, 0, BEGINNING), "")
    slots = np.stack([hashed(words), hashed(begin)], 1)
    used = np.asarray(pc.greater(pc.utf8_length(words), 1))
    slots[~used] = -1
    rows = np.repeat(np.arange(len(split.counts)), split.counts)
    # One entry per text and feature.
    pairs = np.unique((rows[:, None] * np.int64(SLOTS + 1) + slots[codes] + 1).ravel())
    rows, slots = np.divmod(pairs, SLOTS + 1)
    rows, slots = rows[slots > 0], slots[slots > 0] - 1
    return slots, np.bincount(rows, minlength=len(split.counts))


def hashed(words: pa.Array) -> np.ndarray:
    """A slot for each word from its bytes."""
    words = words.cast(pa.large_binary())
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    mixed = (data.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(9)) + np.uint64(1))
    mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    total = np.cumsum(np.concatenate([[np.uint64(0)], mixed]), dtype=np.uint64)
    total = total[offsets[1:]] - total[offsets[:-1]]
    total ^= total >> np.uint64(29)
    return (total % np.uint64(SLOTS)).astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded training sample: text and whether it is a confirmed toxic one."""
    order = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    known = labels.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    positive = known.filter(F.col("_toxic") == 1).select(
        "doc_id", F.lit(True).alias("_positive")).orderBy(order, "doc_id").limit(POSITIVES)
    unlabelled = (
        docs.select("doc_id").filter(~held_out()).distinct()
        .select("doc_id", F.lit(False).alias("_positive")).orderBy(order, "doc_id")
        .limit(UNLABELLED)
    )
    # At most POSITIVES + UNLABELLED ids, so every task can hold them.
    chosen = F.broadcast(positive.unionByName(unlabelled))
    # An id that repeats gives one text.
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy(
        "doc_id", "_positive").agg(F.min("text").alias("text"))


def sample_features(texts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and their number per text, of positives and of unlabelled texts.

    They come to the driver: a bounded number of rows.
    """
    def slots_of(batches):
        for block in blocks(batches):
            slots, counts = features(block.column("text"))
            ends = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").combine_chunks(),
                 block.column("_positive").combine_chunks(),
                 pa.ListArray.from_arrays(
                     pa.array(ends, pa.int32()), pa.array(slots, pa.int32()))],
                ["doc_id", "_positive", "slots"])

    made = texts.mapInArrow(slots_of, T.StructType([
        T.StructField("doc_id", texts.schema["doc_id"].dataType),
        T.StructField("_positive", T.BooleanType()),
        T.StructField("slots", T.ArrayType(T.IntegerType()))]))
    found = made.toArrow()
    order = pc.sort_indices(found, [("doc_id", "ascending")])
    positive = found.column("_positive").take(order)
    groups = []
    for kind in (True, False):
        lists = found.column("slots").take(order.filter(pc.equal(positive, kind)))
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        groups.append((lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()))
    del found, lists
    pa.default_memory_pool().release_unused()
    return groups


Texts = tuple[np.ndarray, np.ndarray]


def half(texts: Texts, which: int) -> Texts:
    """Every other text."""
    slots, counts = texts
    chosen = np.arange(len(counts)) % 2 == which
    return slots[np.repeat(chosen, counts)], counts[chosen]


def slot_counts(slots: np.ndarray) -> np.ndarray:
    """How often each slot comes, counted in place: the driver holds no wider copy."""
    counts = np.zeros(SLOTS, np.int32)
    np.add.at(counts, slots, 1)
    return counts.astype(np.float32)


def associations(positives: Texts, unlabelled: Texts) -> np.ndarray:
    """How much more often each feature is met in positives than in all, as a logarithm.

    PSEUDO expected and met cases keep rare features near 0.
    """
    plus, rest = (slot_counts(t[0]) for t in (positives, unlabelled))
    share = len(positives[1]) / max(1, len(positives[1]) + len(unlabelled[1]))
    return np.log((plus + PSEUDO) / ((plus + rest) * share + PSEUDO)).astype(np.float32)


def inputs(strength: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A text's inputs: its strongest feature, how many are strong, their sum, its length."""
    out = np.zeros((len(counts), len(LEVELS) + 3))
    out[:, -1] = np.log1p(counts)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        out[full, 0] = np.maximum.reduceat(strength, starts)
        for i, level in enumerate(LEVELS):
            out[full, 1 + i] = np.log1p(
                np.add.reduceat(strength > level, starts, dtype=np.float64))
        out[full, -2] = np.log1p(np.add.reduceat(np.maximum(strength - LEVELS[0], 0), starts))
    return out


def of_texts(ratios: np.ndarray, texts: Texts) -> np.ndarray:
    return inputs(ratios[texts[0]], texts[1])


def fit(positives: Texts, unlabelled: Texts, prior: float, steps: int = 1500,
        rate: float = 0.02, decay: float = 1e-4) -> dict:
    """Associations, and the weights over a text's inputs that keep the nnPU risk small.

    The inputs of each half of the sample use the associations of the other half, so that
    they are not stronger in training than on new texts.
    """
    halves = []
    for h in (0, 1):
        ratios = associations(half(positives, 1 - h), half(unlabelled, 1 - h))
        halves.append((of_texts(ratios, half(positives, h)), of_texts(ratios, half(unlabelled, h))))
    plus, rest = (np.concatenate([x[i] for x in halves]) for i in (0, 1))
    mean, scale = rest.mean(0), rest.std(0) + 1e-6
    plus, rest = (plus - mean) / scale, (rest - mean) / scale
    weights = np.zeros(plus.shape[1] + 1)
    weights[-1] = np.log(prior / (1 - prior))
    plus, rest = (np.hstack([x, np.ones((len(x), 1))]) for x in (plus, rest))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        of_plus, of_rest = plus @ weights, rest @ weights
        excess = np.logaddexp(0, of_rest).mean() - prior * np.logaddexp(0, of_plus).mean()
        chance, base = _chance(of_plus), _chance(of_rest)
        toxic = prior * (plus.T @ (chance - 1)) / len(plus)
        other = rest.T @ base / len(rest) - prior * (plus.T @ chance) / len(plus)
        grad = (toxic + other if excess >= 0 else -other) + decay * weights
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        weights -= rate * first / (1 - 0.9 ** step) / (
            np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    ratios = associations(positives, unlabelled)
    value = ((of_texts(ratios, unlabelled) - mean) / scale) @ weights[:-1]
    # The prior says how many unlabelled texts are toxic: as many reach the threshold.
    bias = np.log(THRESHOLD / (1 - THRESHOLD)) - np.quantile(value, 1 - prior)
    return {"ratios": ratios, "mean": mean, "scale": scale, "weights": weights[:-1], "bias": bias}


def _chance(value: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> dict | None:
    """Fit on the bounded sample; None where there is nothing to learn from."""
    if prior is not None and not 0 < prior < 1:
        raise ValueError("the prior is a share between 0 and 1")
    bounded_batches(docs.sparkSession)
    if prior is None:
        known = labels.filter(~held_out() & F.col("toxic").isNotNull())
        prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    positives, unlabelled = sample_features(sample(docs, labels))
    if not prior or not len(positives[1]) or not len(unlabelled[1]):
        return None
    return fit(positives, unlabelled, min(prior, 0.99))


def score(
    docs: DataFrame, model: dict | None, keep: list[str], text: str = "text"
) -> DataFrame:
    """The ``keep`` columns with ``score`` and ``predicted``."""
    bounded_batches(docs.sparkSession)
    # One model for all tasks; its size is set by SLOTS.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[docs.schema[k] for k in keep],
                           T.StructField("score", T.DoubleType())])

    def scored(batches):
        for block in blocks(batches, text):
            model = shared.value
            if model is None:
                chance = np.zeros(block.num_rows)
            else:
                slots, counts = features(block.column(text))
                given = (inputs(model["ratios"][slots], counts) - model["mean"]) / model["scale"]
                chance = _chance(given @ model["weights"] + model["bias"])
            yield pa.RecordBatch.from_arrays(
                [*[block.column(k).combine_chunks() for k in keep], pa.array(chance)],
                schema.names)

    used = docs.select(*dict.fromkeys([*keep, text]))
    return used.mapInArrow(scored, schema).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, train(docs, labels, prior), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def clean_documents(
    docs: DataFrame, labels: DataFrame, prior: float | None = None
) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, whatever their names."""
    held, names = renamed(docs)
    text = names[docs.columns.index("text")]
    scored = score(held, train(docs, labels, prior), names, text)
    return original(scored.filter(F.col("predicted") == 0), docs)


def labels_of(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "toxic")
