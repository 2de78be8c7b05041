"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed inside tasks, vectorised over the
bytes of an Arrow batch.  Trees grow level by level on binned features
(at most 64 bins, cut at quantiles of the training sample), with logistic
loss.  A trained forest is flattened into arrays (feature, threshold, left
child, value), and scoring walks all rows of a batch down one tree at a time
with numpy indexing.

Only the fit is bounded: `MAX_TRAIN_ROWS` labelled rows, those with the
smallest hash of doc_id.  Every row is scored.  Neither labels nor lang,
source or doc_id enter the statistics.

Edge cases: null and empty texts have all-zero statistics and are scored
like any other; with no labelled rows, or labels of one class only, the
score of every row is the smoothed base rate; label rows with null doc_id or
label are ignored, and of several labels for one document the largest
counts; an empty table gives an empty result; columns besides doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .storage import crc_mod, hash_sample, staged
from .wordhash import hashed_slices, window_hashes

MAX_TRAIN_ROWS = 20_000
FEATURES = (
    "log_bytes", "log_words", "mean_word_bytes", "upper_share", "digit_share", "punct_share", "symbol_share",
    "bang_share", "pipe_share", "comma_share", "stop_share", "space_share", "non_ascii_share", "words_per_line",
    "repeated_line_share", "distinct_word_share", "repeated_window_share", "long_word_share", "same_as_next_share",
)


def _classes() -> np.ndarray:
    """A class number for each byte value: 0 none of interest."""
    k = np.zeros(256, np.int64)
    k[65:91] = 1
    k[48:58] = 2
    for b in b"\"'()-/:;?@[]_`{}~\\^+=":
        k[b] = 3
    for b in b"#*$%&<>":
        k[b] = 4
    k[ord("!")], k[ord("|")], k[ord(",")], k[ord(".")], k[ord("\n")] = 5, 6, 7, 8, 9
    for b in b" \t\r\x0b\x0c":
        k[b] = 10
    k[128:] = 11
    return k


_CLASS = _classes()
_LINE_ENDS = np.zeros(256, dtype=bool)
_LINE_ENDS[10] = True


def _distinct_per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at) - 1)
    for i in range(len(at) - 1):
        part = values[at[i] : at[i + 1]]
        if len(part):
            ordered = np.sort(part)
            out[i] = 1 + np.count_nonzero(ordered[1:] != ordered[:-1])
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text of an Arrow string column."""
    from .wordhash import hash_words

    out = np.zeros((len(column), len(FEATURES)))
    for s in hashed_slices(column):
        row_of_byte = np.repeat(np.arange(s.rows), np.diff(s.row_at))
        per = np.bincount(row_of_byte * 12 + _CLASS[s.data], minlength=12 * s.rows).reshape(s.rows, 12).astype(float)
        size = np.diff(s.row_at).astype(float)
        words = np.diff(s.word_at).astype(float)
        line_hash, line_at = hash_words(s.data, s.row_at, _LINE_ENDS)
        lines = np.diff(line_at).astype(float)
        windows = window_hashes(s.hashes, 8)
        window_at = np.minimum(s.word_at, len(windows))
        inside = np.zeros(s.rows)
        for i in range(s.rows):
            n = int(words[i]) - 7
            if n > 1:
                ordered = np.sort(windows[window_at[i] : window_at[i] + n])
                inside[i] = np.count_nonzero(ordered[1:] == ordered[:-1]) / n
        twins = np.append(s.hashes[1:] == s.hashes[:-1], False)
        twin_sum = np.concatenate([[0], np.cumsum(twins)])
        chars = np.maximum(size - per[:, 9] - per[:, 10], 1)
        some_words, some_lines = np.maximum(words, 1), np.maximum(lines, 1)
        rows = slice(s.first, s.first + s.rows)
        f = {
            "log_bytes": np.log1p(size), "log_words": np.log1p(words), "mean_word_bytes": chars * (words > 0) / some_words,
            "upper_share": per[:, 1] / chars, "digit_share": per[:, 2] / chars, "punct_share": per[:, 3] / chars,
            "symbol_share": per[:, 4] / chars, "bang_share": per[:, 5] / chars, "pipe_share": per[:, 6] / chars,
            "comma_share": per[:, 7] / some_words, "stop_share": per[:, 8] / some_words, "space_share": per[:, 10] / np.maximum(size, 1),
            "non_ascii_share": per[:, 11] / chars, "words_per_line": words / some_lines,
            "repeated_line_share": (lines - _distinct_per_row(line_hash, line_at)) / some_lines,
            "distinct_word_share": _distinct_per_row(s.hashes, s.word_at) / some_words,
            "repeated_window_share": inside, "long_word_share": np.log1p(chars / some_words),
            "same_as_next_share": (twin_sum[s.word_at[1:]] - twin_sum[s.word_at[:-1]]) / some_words,
        }
        out[rows] = np.column_stack([f[name] for name in FEATURES])
    return out


class Forest(NamedTuple):
    """Complete binary trees of one depth, flattened: arrays are (trees, nodes)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray  # of the leaves
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 8) -> Forest:
    """Grow `trees` trees by histograms of gradients; no randomness."""
    y = y.astype(float)
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    inner, leaves, columns = 2**depth - 1, 2**depth, x.shape[1] if x.ndim == 2 else len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(columns)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(columns)])
    flat = binned + np.arange(columns) * bins
    allowed = np.zeros((columns, bins), dtype=bool)
    for j in range(columns):
        allowed[j, : len(cuts[j])] = True
    raw = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (columns * bins) + flat).ravel()
            shape, size = (width, columns, bins), width * columns * bins
            sums = [np.cumsum(np.bincount(key, weights=np.repeat(v, columns), minlength=size).reshape(shape), axis=2) for v in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (ga, ha, na) = sums, [v[:, :, -1:] for v in sums]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain = np.where(allowed[None] & (nl >= least) & (na - nl >= least), gain, -1.0).reshape(width, -1)
            best = gain.argmax(axis=1)
            for k in range(width):
                if gain[k, best[k]] > 1e-6:
                    j, b = divmod(int(best[k]), bins)
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + ridge)
        raw += value[leaf]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Forest(base, np.array(features), np.array(thresholds), np.array(values), depth)


def document_statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, carried columns, stats array<double>) for every row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("string").alias("text"))
    kept = rows.drop("text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(batch.num_columns - 1))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], stats], [*batch.schema.names[:-1], "stats"])

    return rows.mapInArrow(compute, StructType([*kept.schema.fields, StructField("stats", ArrayType(DoubleType()))]))


def quality_scores(docs: DataFrame, labels: DataFrame, hold_modulus: int = 3, hold_remainder: int = 1, max_train_rows: int = MAX_TRAIN_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, carried columns, held_out, score, predicted), one per row of `docs`.

    Labels are learnt only from rows whose crc32 of doc_id modulo
    `hold_modulus` is not `hold_remainder`.  `carry` names columns of `docs`
    that are returned as they are and never looked at.
    """
    stats = staged(document_statistics(docs, carry), "quality-statistics")
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    usable = usable.filter(crc_mod(F.col("doc_id"), hold_modulus) != hold_remainder).groupBy("doc_id").agg(F.max("quality").alias("y"))
    # At most max_train_rows rows of two dozen numbers go to the driver.
    chosen = hash_sample(usable, "doc_id", max_train_rows)
    sample = stats.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("stats").alias("stats"), F.max("y").alias("y")).toPandas().sort_values("doc_id", ignore_index=True)
    x = np.array(sample["stats"].tolist(), dtype=float).reshape(len(sample), len(FEATURES))
    forest = fit(x, sample["y"].to_numpy(dtype=float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(forest.score(x))], [*batch.schema.names[:-1], "score"])

    scored = stats.mapInArrow(score, StructType([*stats.drop("stats").schema.fields, StructField("score", DoubleType())]))
    held = F.coalesce(crc_mod(F.col("doc_id"), hold_modulus) == hold_remainder, F.lit(False))
    return scored.select("doc_id", *carry, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
