"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkstone.llm.common import crc_of, free_name, map_arrow, short_batches, slices, whole_text

ORDERS = (3, 4, 5)
BITS = 18
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def features(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """Numbers of the distinct hashed character n-grams of a whole text, in lower case and with a space at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    rolled, out = codes, []
    for n in range(2, max(orders) + 1):
        if len(codes) < n:
            break
        rolled = rolled[:-1] * np.uint64(1_000_003) + codes[n - 1 :]
        if n in orders:
            place = ((rolled * SPREAD) >> np.uint64(64 - bits)).astype(np.int32)
            out.append(distinct(place, 1 << bits) + (orders.index(n) << bits))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int32)


def distinct(places: np.ndarray, size: int) -> np.ndarray:
    if len(places) > size // 4:
        return np.flatnonzero(np.bincount(places, minlength=size)).astype(np.int32)
    places = np.sort(places)
    return places[np.append(True, places[1:] != places[:-1])]


class Model:
    """Weights of the hashed n-grams and an intercept; score is their logistic sum."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, text: str) -> float:
        z = self.intercept + float(self.weights[features(text)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def minimum(slope_of, start: np.ndarray, rounds: int, memory: int = 8, enough: float = 1e-4) -> np.ndarray:
    """Limited-memory BFGS; ``slope_of`` gives the value and the gradient. Steps halve until the value falls."""
    x, (value, slope) = start, slope_of(start)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < enough:
            break
        way, shares = -slope, []
        for s, y, scale in reversed(moves):
            shares.append(scale * (s @ way))
            way = way - shares[-1] * y
        if moves:
            s, y, scale = moves[-1]
            way = way / (scale * (y @ y))
        for (s, y, scale), share in zip(moves, reversed(shares)):
            way = way + (share - scale * (y @ way)) * s
        step = 1.0 if moves else 1 / max(1.0, float(np.abs(slope).sum()))
        while True:
            new = x + step * way
            new_value, new_slope = slope_of(new)
            if new_value <= value + 1e-4 * step * (slope @ way) or step < 1e-9:
                break
            step /= 2
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            moves = [*moves[1 - memory :], (s, y, 1 / (s @ y))]
        x, value, slope = new, new_value, new_slope
    return x


def fit(texts: list[str], labels: list[int], share: float, smooth: float = 1.0, penalty: float = 0.1, rounds: int = 40, least: float = 0.25) -> Model:
    """Log-count ratios, then logistic regression on the presence of n-grams times their ratio.

    N-grams whose ratio is under ``least`` either way tell the classes hardly apart and get no weight.
    ``share`` is that of label 1 among all labelled texts: classes weigh as they occur there, whatever
    the sample. Without texts of both labels the share itself is every text's score.
    """
    size = len(ORDERS) << BITS
    y = np.array(labels, dtype=np.float64)
    prior = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(size, dtype=np.float32), prior)
    rows = [features(t) for t in texts]
    place = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    bad = y[row] == 1
    found = [np.bincount(place[bad == k], minlength=size) for k in (False, True)]
    # shares of texts with the n-gram, so that the number and length of texts of a class do not tip every ratio
    ratio = np.log((found[1] + smooth) / ((y == 1).sum() + 2 * smooth)) - np.log((found[0] + smooth) / ((y == 0).sum() + 2 * smooth))
    used = np.flatnonzero((found[0] + found[1] > 0) & (np.abs(ratio) >= least))
    number = np.full(size, -1, dtype=np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    ratio = ratio[used]
    kept = number[place] >= 0
    row, place = row[kept], number[place[kept]]
    scaled = ratio[place]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    sign = 2 * y - 1

    def slope_of(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = v[:-1], v[-1]
        margin = sign * (np.bincount(row, weights=scaled * w[place], minlength=len(rows)) + b)
        value = float(weight @ np.logaddexp(0, -margin)) + penalty / 2 * float(w @ w)
        error = -weight * sign * np.exp(-np.logaddexp(0, margin))
        slope = np.bincount(place, weights=scaled * error[row], minlength=len(used)) + penalty * w
        return value, np.append(slope, error.sum())

    best = minimum(slope_of, np.append(np.zeros(len(used)), prior), rounds, enough=1e-3)
    weights = np.zeros(size, dtype=np.float32)
    weights[used] = best[:-1] * ratio
    return Model(weights, float(best[-1]))


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int], per_class: int, id_col: str, text_col: str, label_col: str) -> Model:
    """Fit on at most ``per_class`` texts of each label, those whose ids have the least hashes; the labels are counted whole."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.pmod(crc_of(id_col), F.lit(fold[0])) != fold[1]))
    marked = marked.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    total = marked.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    if not total["n"]:
        return fit([], [], 0.0)
    picked = [marked.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    # at most 2 * per_class rows of two numbers
    sample = F.broadcast(picked[0].union(picked[1]))
    rows = docs.select(F.col(id_col).alias("d_id"), whole_text(text_col).alias("text")).join(sample, F.col("d_id") == F.col("id"))
    found = sorted((r["id"], r["text"], r["label"]) for r in rows.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).collect())
    return fit([t for _, t, _ in found], [k for _, _, k in found], total["ones"] / total["n"])


def score(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.7,
    fold: tuple[int, int] = (3, 1),
    per_class: int = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    keep: bool = False,
) -> DataFrame:
    """(id, held_out, score, predicted) of every row, or with ``keep`` all columns and a struct ``toxicity``.

    A row is held out if crc32 of its id modulo fold[0] is fold[1]; no such label is learnt from. The classifier is
    fitted on ``per_class`` labelled texts of each class at most (a bound on the driver's work), all with
    their whole text. Only texts are inputs of a score. Null and empty texts get the score of a text without n-grams;
    a label that is null or no 0 or 1 is none; ids with several labels count as toxic if one is; without labels of
    both classes every score is the share of toxic labels. Repeated rows score alike.
    """
    model = train(docs, labels, fold, per_class, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 MB at any size of the input
    held = F.pmod(crc_of(id_col), F.lit(fold[0])) == fold[1]

    if keep:
        out, text = free_name(docs, "toxicity"), whole_text(text_col)

        short_batches(docs.sparkSession)

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            return pa.array([shared.value.score(t) for t in texts.to_pylist()], type=pa.float64())

        named = free_name(docs, "toxicity_score")
        both = docs.withColumn(named, scored(text))
        return both.withColumn(out, F.struct(held.alias("held_out"), F.col(named).alias("score"), (F.col(named) >= threshold).cast("int").alias("predicted"))).drop(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, type=pa.float64())], names=["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), held.alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    out = map_arrow(rows, run, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
