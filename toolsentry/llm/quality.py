"""A quality classifier by co-training two views of a document.

One view is the text's content (which words stand in it, and shares of kinds of characters), the other the page's
metadata (source, language, and the layout's sizes). Each view has a logistic classifier of its own. Over rounds, each
labels the unlabelled rows it is surest of, and the other one learns from them (Blum and Mitchell, Combining Labeled and
Unlabeled Data with Co-Training, 1998). Both are calibrated on labelled rows that neither has seen, and their evidence is added.

Training takes a bounded sample (``LABELLED`` and ``UNLABELLED`` rows, those of the smallest hashes of their ids);
scoring takes every document whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolsentry.llm.arrays import LETTERS, byte_prefix, flat, slices, span_hash, words
from toolsentry.llm.tables import arrow_schema

LABELLED, UNLABELLED, HELD_OUT = 8000, 4000, 4
ROUNDS, PSEUDO, SURE, PSEUDO_WEIGHT = 2, 400, 0.97, 0.3
VOCABULARY, LEAST_DOCUMENTS = 4096, 8
CATEGORIES, WORD_BITS = 64, 44
STEPS, RATE, PENALTY = 120, 0.15, 1e-4
TARGETS = ("quality", "toxic")
EXTRA = ("quality_score", "toxic_score", "accepted")

FEATURES, FEATURES_DDL = arrow_schema([
    ("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("words", pa.list_(pa.int64())),
    ("content", pa.list_(pa.float32())), ("layout", pa.list_(pa.float32())),
])

#: Kinds of bytes whose shares are content features: upper case, lower case, digits, white space, beyond ASCII, and each
#: sign of ASCII by itself.
_KINDS = np.zeros(256, np.int64)
_KINDS[0x41:0x5B], _KINDS[0x61:0x7B], _KINDS[0x30:0x3A], _KINDS[0x80:] = 1, 2, 3, 5
_KINDS[[0x20, *range(0x09, 0x0E)]] = 4
_SIGNS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
_KINDS[_SIGNS] = 6 + np.arange(len(_SIGNS))
_N_KINDS = 6 + len(_SIGNS)


class Features(NamedTuple):
    """Of many texts: distinct word hashes with the text they stand in, and two dense tables."""

    row: np.ndarray
    word: np.ndarray
    content: np.ndarray
    layout: np.ndarray


def features(column: pa.Array) -> Features:
    """What both views see of whole texts; null and empty texts have no words and zero shares."""
    data, bounds = flat(column)
    size = np.diff(bounds)
    n = len(size)
    text = np.repeat(np.arange(n), size)
    kinds = np.bincount(text * _N_KINDS + _KINDS[data], minlength=n * _N_KINDS).reshape(n, _N_KINDS)
    lowered = np.where((data >= 0x41) & (data < 0x5B), data + 0x20, data).astype(np.uint8)
    starts, ends, places = words(lowered, bounds, LETTERS)
    hashes = span_hash(byte_prefix(lowered), starts, ends)
    count = np.diff(places)
    cells = np.unique((np.repeat(np.arange(n, dtype=np.uint64), count) << np.uint64(WORD_BITS)) | (hashes >> np.uint64(64 - WORD_BITS)))
    row, word = (cells >> np.uint64(WORD_BITS)).astype(np.int64), (cells & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    distinct = np.bincount(row, minlength=n)
    shares = np.sqrt(kinds / np.maximum(size, 1)[:, None])
    length = size / np.maximum(count, 1)
    content = np.column_stack([shares, distinct / np.maximum(count, 1), np.log1p(length)]).astype(np.float32)
    lines = np.bincount(text[data == 10], minlength=n) + 1
    layout = np.column_stack([np.log1p(size), np.log1p(lines), np.log1p(size / lines), np.log1p(count / lines)]).astype(np.float32)
    return Features(row, word, content, layout)


class Linear(NamedTuple):
    """A logistic classifier over known words and standardised numbers."""

    known: np.ndarray
    word_weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    dense_weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, row: np.ndarray, word: np.ndarray, dense: np.ndarray) -> np.ndarray:
        found = (np.clip((dense - self.centre) / self.scale, -5, 5) @ self.dense_weights).astype(float) + self.bias
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, word), len(self.known) - 1)
            held = self.known[at] == word
            found += np.bincount(row[held], self.word_weights[at[held]], len(dense))
        return self.slope * found + self.shift


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def chosen_words(row: np.ndarray, word: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The words most associated with the label, by chi-square, among those in enough labelled documents. The statistic
    must be beyond what the best of so many unrelated words would reach."""
    known, at = np.unique(word, return_inverse=True)
    total = np.bincount(at, minlength=len(known))
    with_label = np.bincount(at, label[row], len(known))
    rate = label.mean()
    chi = (with_label - total * rate) ** 2 / np.maximum(total * rate * (1 - rate), 1e-12)
    chi[total < LEAST_DOCUMENTS] = 0
    best = np.argsort(chi, kind="stable")[::-1][:VOCABULARY]
    return np.sort(known[best[chi[best] > 2 * np.log(len(known) + 1) + 6]])


def fitted(row: np.ndarray, word: np.ndarray, dense: np.ndarray, label: np.ndarray, weight: np.ndarray, known: np.ndarray) -> Linear:
    """Full-batch logistic regression with momentum and adaptive steps."""
    centre, scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3)
    numbers = np.clip((dense - centre) / scale, -5, 5)
    at = np.minimum(np.searchsorted(known, word), max(0, len(known) - 1))
    held = known[at] == word if len(known) else np.zeros(len(word), bool)
    row, at = row[held], at[held]
    size = len(known) + numbers.shape[1] + 1
    w, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    rate = np.average(label, weights=weight)
    w[-1] = np.log(rate / (1 - rate))
    share = weight / weight.sum()
    for step in range(1, STEPS + 1):
        z = numbers @ w[len(known):-1] + w[-1] + np.bincount(row, w[at], len(label))
        off = (sigmoid(z) - label) * share
        grad = np.concatenate([np.bincount(at, off[row], len(known)), numbers.T @ off, [off.sum()]])
        grad[:-1] += PENALTY * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Linear(known, w[:len(known)], centre, scale, w[len(known):-1], float(w[-1]))


def calibrated(model: Linear, z: np.ndarray, label: np.ndarray) -> Linear:
    """Platt scaling on held-out logits, with Platt's targets against overconfidence; Newton steps."""
    yes, no = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.column_stack([z, np.ones(len(z))])
    theta = np.array([0.0, np.log((yes + 1) / (no + 1))])
    for _ in range(25):
        p = sigmoid(x @ theta)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta -= np.clip(np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * theta * [1, 0]), -2, 2)
    if theta[0] <= 0:  # a view that knows nothing says the prior
        return model._replace(slope=0.0, shift=float(np.log((yes + 1) / (no + 1))))
    return model._replace(slope=float(theta[0]), shift=float(theta[1]))


class Model(NamedTuple):
    content: Linear
    layout: Linear
    prior: float
    sources: list[str]
    langs: list[str]

    def score(self, found: Features, sources: list, langs: list) -> np.ndarray:
        """The probability of the label, from the evidence of both views beyond the prior."""
        a = self.content.logits(found.row, found.word, found.content)
        b = self.layout.logits(found.row[:0], found.word[:0], metadata(found.layout, sources, langs, self.sources, self.langs))
        return sigmoid(self.prior + (a - self.prior) + (b - self.prior))


def metadata(layout: np.ndarray, sources: list, langs: list, known_sources: list[str], known_langs: list[str]) -> np.ndarray:
    """Layout numbers and one column for each known source and language; null and unknown ones have none."""
    columns = [layout]
    for values, known in ((sources, known_sources), (langs, known_langs)):
        place = {v: i for i, v in enumerate(known)}
        table = np.zeros((len(values), len(known)), np.float32)
        for i, v in enumerate(values):
            if v in place:
                table[i, place[v]] = 1
        columns.append(table)
    return np.column_stack(columns)


def co_trained(found: Features, sources: list, langs: list, label: np.ndarray) -> Model:
    """Both classifiers for one label; rows whose label is NaN are the unlabelled pool."""
    known_rows = np.flatnonzero(~np.isnan(label))
    names = [sorted(v for v, _ in Counter(x for x in values if x is not None).most_common(CATEGORIES)) for values in (sources, langs)]
    table = metadata(found.layout, sources, langs, *names)
    held_out, taught = known_rows[::HELD_OUT], np.setdiff1d(known_rows, known_rows[::HELD_OUT])
    yes, no = (label[known_rows] == 1).sum(), (label[known_rows] == 0).sum()
    prior = float(np.log((yes + 1) / (no + 1)))
    if min((label[taught] == 1).sum(), (label[taught] == 0).sum()) == 0 or min((label[held_out] == 1).sum(), (label[held_out] == 0).sum()) == 0:
        nothing = [Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(t.shape[1]), np.ones(t.shape[1]), np.zeros(t.shape[1]), 0.0, 0.0, prior) for t in (found.content, table)]
        return Model(*nothing, prior, *names)
    in_taught = np.isin(found.row, taught)
    spot = np.searchsorted(taught, found.row[in_taught])
    vocabulary = chosen_words(spot, found.word[in_taught], label[taught])
    none = found.row[:0], found.word[:0]
    views = [(found.row, found.word, found.content, vocabulary), (*none, table, vocabulary[:0])]
    pool = np.flatnonzero(np.isnan(label))
    lessons = [{int(i): (label[i], 1.0) for i in taught} for _ in views]
    models: list[Linear] = []
    for turn in range(ROUNDS + 1):
        models = []
        for (row, word, dense, known), lesson in zip(views, lessons):
            rows = np.array(sorted(lesson))
            y, weight = np.array([lesson[i] for i in rows.tolist()]).T
            mine = np.isin(row, rows)
            model = fitted(np.searchsorted(rows, row[mine]), word[mine], dense[rows], y, weight, known)
            models.append(calibrated(model, model.logits(row, word, dense)[held_out], label[held_out]))
        if turn == ROUNDS:
            break
        for me, other in ((0, 1), (1, 0)):
            sure = sigmoid(models[me].logits(*views[me][:3])[pool])
            for value, confidence in ((1.0, sure), (0.0, 1 - sure)):
                for i in np.argsort(confidence, kind="stable")[::-1][:PSEUDO]:
                    if confidence[i] >= SURE:
                        lessons[other][int(pool[i])] = (value, PSEUDO_WEIGHT)
    return Model(*models, prior, *names)


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, quality, toxic)`` of the training rows, at most ``LABELLED + UNLABELLED``; pool rows have null labels."""
    shuffled = F.xxhash64(F.col("doc_id"), F.lit(17))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*[F.max(F.col(t).cast("double")).alias(t) for t in TARGETS])
    marked = marks.orderBy(shuffled, "doc_id").limit(LABELLED)
    pool = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().join(marks, "doc_id", "left_anti").orderBy(shuffled, "doc_id").limit(UNLABELLED)
    return marked.unionByName(pool.select("doc_id", *[F.lit(None).cast("double").alias(t) for t in TARGETS]))


def trained(docs: DataFrame, labels: DataFrame) -> dict[str, Model]:
    """Models of all targets, fitted on the sample; its rows travel to the driver as features of bounded number."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = features(part.column("text"))
            places = np.searchsorted(found.row, np.arange(part.num_rows + 1)).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(places), pa.array(found.word))
            tables = [pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * t.shape[1]), pa.array(t.ravel())) for t in (found.content, found.layout)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("lang"), listed, *tables], schema=FEATURES)

    chosen = sampled(docs, labels).collect()
    marks = {r.doc_id: r for r in chosen}
    ids = docs.sparkSession.createDataFrame([(r.doc_id,) for r in chosen], "doc_id bigint")
    own = _viewed(docs).join(F.broadcast(ids), "doc_id", "left_semi")
    table = own.mapInArrow(describe, FEATURES_DDL).toArrow().sort_by("doc_id").combine_chunks()
    lists = table.column("words").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64()))
    count = np.diff(lists.offsets.to_numpy())
    dense = [np.array(table.column(c).to_pylist(), np.float32).reshape(table.num_rows, like.shape[1]) for c, like in zip(("content", "layout"), features(pa.array([""]))[2:])]
    found = Features(np.repeat(np.arange(table.num_rows), count), lists.flatten().to_numpy(), *dense)
    sources, langs = (table.column(c).to_pylist() for c in ("source", "lang"))
    doc_ids = table.column("doc_id").to_pylist()
    models = {}
    for target in TARGETS:
        label = np.array([getattr(marks[i], target) if getattr(marks[i], target) is not None else np.nan for i in doc_ids], float)
        models[target] = co_trained(found, sources, langs, label)
    return models


def _viewed(docs: DataFrame) -> DataFrame:
    """Ids, texts and the metadata that a table has; one without sources or languages has nulls."""
    meta = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *meta, F.coalesce("text", F.lit("")).alias("text"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with their own columns, ``quality_score``, ``toxic_score`` and ``accepted``, one row for each row.

    A document is accepted if it is rather of good quality than not, and rather not toxic than toxic. Null texts are empty.
    A label that all training rows share, or that none has, gives every document the same score; without any label
    all are accepted. Labels of unknown documents and null labels teach nothing; of several labels the largest counts.
    """
    models = trained(docs, labels)
    own = [c for c in docs.columns if c not in EXTRA]
    kept = docs.select(*own)
    schema = T.StructType(kept.schema.fields + [T.StructField(n, t) for n, t in zip(EXTRA, (T.DoubleType(), T.DoubleType(), T.BooleanType()))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = features(part.column("text"))
            sources, langs = (part.column(c).to_pylist() if c in own else [None] * part.num_rows for c in ("source", "lang"))
            quality, toxic = (models[t].score(found, sources, langs) for t in TARGETS)
            extra = [pa.array(quality.round(6)), pa.array(toxic.round(6)), pa.array((quality >= 0.5) & (toxic <= 0.5))]
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*own, *EXTRA])

    return kept.mapInArrow(judge, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    judged = scored(docs, labels)
    return judged.filter("accepted").select(*[c for c in docs.columns])
