"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - w . x): all thresholds share the weights w, so severity is one scale. x holds
the words (runs of letters and digits, A-Z lower-cased) that a text has, out of those that are associated with the
grade in the labelled sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm import kernel
from gridlark.llm.common import text_blocks

BLOCK = 1 << 20


@dataclass
class OrdinalModel:
    """Sorted word hashes, their weights, and increasing thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, given w . x."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - x[:, None], -50, 50)))


def graded_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade): 0 not toxic, 1 toxic, 2 toxic and of low quality. Labels without `toxic` are left out."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.coalesce(F.col("quality"), F.lit(1)) == 0, 2).otherwise(1)
    return labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), grade.alias("grade")).distinct()


def _row_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, counts = kernel.word_spans(data, offsets, kernel.IS_GAP)
    return kernel.word_hashes(data, starts, ends), counts


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text."""
    for rows, data, offsets in text_blocks(batches, "text", BLOCK):
        sets = kernel.sets_of(*_row_words(data, offsets))
        ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([rows.column("grade"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["grade", "words"])


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, max_words: int = 4096, least_rows: int = 5, penalty: float = 2e-4, steps: int = 300) -> OrdinalModel:
    """Fits shared weights and ordered thresholds by full-batch Adam steps on the mean log loss."""
    n_grades = max(int(grades.max()) if len(grades) else 0, 1)
    none = OrdinalModel(np.zeros(0, dtype=np.uint64), np.zeros(0), np.full(n_grades, 30.0))
    if not len(grades) or not (grades > 0).any():
        return none
    sizes = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    words, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    mean, spread = grades.mean(), grades.std() + 1e-9
    z = (np.bincount(column, weights=grades[owner], minlength=len(words)) - df * mean) / (spread * np.sqrt(df))
    strength = np.where(df >= least_rows, np.abs(z), 0)
    chosen = np.sort(np.argsort(-strength, kind="stable")[:max_words])
    chosen = chosen[strength[chosen] >= 3]
    if not len(chosen):
        return none
    number = np.full(len(words), -1)
    number[chosen] = np.arange(len(chosen))
    use = number[column] >= 0
    col, row = number[column[use]], owner[use]
    del flat, owner, column, number, use
    w, gaps = np.zeros(len(chosen)), np.zeros(n_grades)  # thresholds: first, then logs of gaps
    share = np.array([(grades > k).mean() for k in range(n_grades)]).clip(1e-6, 1 - 1e-6)
    first = np.log((1 - share) / share)
    gaps[0], gaps[1:] = first[0], np.log(np.maximum(np.diff(first), 0.05))
    m, v = [np.zeros_like(w), np.zeros_like(gaps)], [np.zeros_like(w), np.zeros_like(gaps)]
    at = np.arange(len(grades))
    for step in range(1, steps + 1):
        thresholds = gaps[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps[1:]))])
        x = np.bincount(row, weights=w[col], minlength=len(rows))
        p = 1 / (1 + np.exp(np.clip(thresholds[None, :] - x[:, None], -50, 50)))  # P(grade > k)
        full = np.concatenate([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))], axis=1)
        mass = np.maximum(full[at, grades] - full[at, grades + 1], 1e-9)
        slope = np.concatenate([np.zeros((len(rows), 1)), p * (1 - p), np.zeros((len(rows), 1))], axis=1)
        dx = -(slope[at, grades] - slope[at, grades + 1]) / mass / len(rows)
        d_threshold = np.zeros(n_grades)
        np.add.at(d_threshold, np.maximum(grades - 1, 0), np.where(grades > 0, slope[at, grades] / mass, 0) / len(rows))
        np.add.at(d_threshold, np.minimum(grades, n_grades - 1), np.where(grades < n_grades, -slope[at, np.minimum(grades + 1, n_grades)] / mass, 0) / len(rows))
        d_gaps = np.array([d_threshold.sum(), *(d_threshold[k:].sum() * np.exp(gaps[k]) for k in range(1, n_grades))])
        dw = np.bincount(col, weights=dx[row], minlength=len(w)) + penalty * w
        for k, (value, g) in enumerate(((w, dw), (gaps, d_gaps))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            value -= 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    thresholds = gaps[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps[1:]))])
    return OrdinalModel(words[chosen], w, thresholds)


def _scorer(shared, kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: OrdinalModel = shared.value
        for rows, data, offsets in text_blocks(batches, "text", BLOCK):
            x = np.zeros(len(rows))
            if len(model.words):
                hashes, counts = _row_words(data, offsets)
                owner = np.repeat(np.arange(len(rows)), counts)
                at = np.searchsorted(model.words, hashes)
                at[at == len(model.words)] = 0
                hit = model.words[at] == hashes
                once = np.unique(owner[hit] * len(model.words) + at[hit])
                x = np.bincount(once // len(model.words), weights=model.weights[once % len(model.words)], minlength=len(rows))
            p = model.at_least(x)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(p.sum(axis=1)), pa.array(p[:, 0])], names=[*kept, "severity", "p_toxic"])

    return score


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> OrdinalModel:
    """Fits on at most max_rows labelled documents (id, text), those with the smallest hashed ids.

    The chosen labels are a bounded table and may be broadcast, so texts aren't shuffled."""
    some = labels.orderBy(F.xxhash64("id"), "id", "grade").limit(max_rows)
    found = docs.join(F.broadcast(some), "id").select("grade", "text").mapInArrow(_features, "grade int, words array<long>").toArrow()
    rows = [np.asarray(r.values.to_numpy()).view(np.uint64) for r in found.column("words")]
    model = fit_ordinal(rows, found.column("grade").to_numpy().astype(np.int64))
    del rows, found
    pa.default_memory_pool().release_unused()  # the sample's memory goes back before the next stage
    return model


def score_severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 12_000, reject_at: float = 0.5) -> DataFrame:
    """One row per input row: id, severity (expected grade), p_toxic (of any grade over 0), rejected.

    Null and empty texts have no words. Without labels over grade 0 nothing is rejected. Rows that repeat an id are
    each scored by their own text; a null id is scored too. Empty in, empty out."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted(texts, labels, max_rows))
    scored = texts.mapInArrow(_scorer(shared, ["id"]), f"id {kind}, severity double, p_toxic double")
    return scored.select(F.col("id").alias(id_col), "severity", "p_toxic", (F.col("p_toxic") >= reject_at).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 12_000, reject_at: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score_severity doesn't reject.

    Null and empty texts have no words and stay, unless the fitted thresholds alone reject. Repeated rows and ids and
    null ids are each judged by their own text; ties at the cut go. A text has to fit a task. Empty in, empty out."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted(texts, labels, max_rows))
    names = docs.columns
    # own names, so that no column of docs can clash with those of the scores
    wide = docs.toDF(*(f"c{k}" for k in range(len(names)))).withColumn("text", F.col(f"c{names.index(text_col)}"))
    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))
    scored = wide.mapInArrow(_scorer(shared, [f"c{k}" for k in range(len(names))]), f"{kinds}, severity double, p_toxic double")
    return scored.where(F.col("p_toxic") < reject_at).select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)))
