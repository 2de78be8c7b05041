"""Toxicity scores from a convolutional text classifier trained in numpy.

Words (runs of letters and digits, ASCII case folded) are hashed twice into
tables of embeddings; a word's vector is the sum of its two entries, so two
words share a vector only if both hashes collide.  Filters one, two and three
words wide run over the whole text, each is max-pooled over it, and a
logistic layer gives the score.  For scoring, embeddings times filters are
multiplied out once per task, so that a word costs two table look-ups.

Every labelled row that may be learnt from is learnt from, over its whole
text.  Rows are dealt by a hash of doc_id into shards; in each epoch every
shard descends from the common model in a task of its own, and what the
shards changed is averaged (a word's entries over the shards that changed
them), so that only models pass through the driver.  One row in five is
kept out of the descent: a Platt step on all of these calibrates the model,
and a threshold is chosen on them for each language, from counts of all
their scores on a grid of GRID steps.  Neither labels nor lang, source or
doc_id enter a score; lang only selects the additional threshold.

Edge cases: null and empty texts are scored as padding alone; with no
labelled rows, or one class only, every score is the smoothed base rate; of
several labels for one document the largest counts, label rows with null
doc_id or label are ignored; a null or unseen language takes the overall
threshold; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import crc_mod, discard, staged
from .wordhash import hashed_slices

EPOCHS = 6
#: About as many rows, and words at most, are in a shard.
SHARD_ROWS = 16_384
SHARD_WORDS = 3_000_000
#: One learning row in so many is kept for the calibration and the thresholds.
PROOF_ONE_IN = 5
#: Steps between score 0 and score 1 for the thresholds by language.
GRID = 10_000
#: Labelled ids are sent to all tasks while they number at most this many, else both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Longer labelled texts were left out of the fit once; nothing is left out by it any more.
MAX_TEXT_BYTES = 750_000
BUCKETS = 1 << 16
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PADS = 3
SLICE_WORDS = 1 << 16

NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False


class Words(NamedTuple):
    """Padded bucket ids of a run of texts; each text begins at `start` and has `size` words."""

    one: np.ndarray
    two: np.ndarray
    start: np.ndarray
    size: np.ndarray


def padded(hashes: np.ndarray, at: np.ndarray) -> Words:
    """Texts one after another, each followed by PADS entries of the zero bucket."""
    size = np.diff(at)
    start = at[:-1] - at[0] + PADS * np.arange(len(size))
    total = int(at[-1] - at[0]) + PADS * len(size)
    one, two = np.full(total, BUCKETS, np.int32), np.full(total, BUCKETS, np.int32)
    to = np.arange(len(hashes)) + np.repeat(PADS * np.arange(len(size)), size)
    one[to], two[to] = hashes & np.uint64(BUCKETS - 1), (hashes >> np.uint64(16)) & np.uint64(BUCKETS - 1)
    return Words(one, two, start, size)


class Model(NamedTuple):
    one: np.ndarray  # (BUCKETS + 1, DIM), the last row zero
    two: np.ndarray
    kernel: np.ndarray  # (DIM, 6 * FILTERS): w1j0 w2j0 w3j0 | w2j1 w3j1 | w3j2
    bias: np.ndarray  # (3 * FILTERS)
    out: np.ndarray  # (3 * FILTERS)
    shift: float


_K = len(WIDTHS) * FILTERS


def convolve(z: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filter responses at each position from the per-word products `z`."""
    c = z[:, :_K] + bias
    c[:-1, FILTERS:] += z[1:, _K : _K + 2 * FILTERS]
    c[:-2, 2 * FILTERS :] += z[2:, _K + 2 * FILTERS :]
    return c


def pooled(c: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Maximum over each text; an empty text has its first padding position."""
    edges = np.column_stack([start, start + np.maximum(size, 1)]).ravel()
    return np.maximum.reduceat(c, edges, axis=0)[::2] if len(start) else np.zeros((0, c.shape[1]))


def _presence(words: Words, ids: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted number of texts in which each bucket occurs."""
    text = np.repeat(np.arange(len(words.size)), words.size)
    at = np.repeat(words.start, words.size) + np.arange(len(text)) - np.repeat(np.cumsum(words.size) - words.size, words.size)
    seen = np.unique(text * (BUCKETS + 1) + ids[at])
    return np.bincount(seen % (BUCKETS + 1), weights=weight[seen // (BUCKETS + 1)], minlength=BUCKETS + 1)


def winners(model: dict[str, np.ndarray], words: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of the filters over each text and their first places, at most about SLICE_WORDS words at a time."""
    size, start = np.maximum(words.size[rows], 1), words.start[rows]
    pieces = -(-size // SLICE_WORDS)
    edges = np.cumsum(pieces) - pieces
    text = np.repeat(np.arange(len(rows)), pieces)
    begin = start[text] + SLICE_WORDS * (np.arange(len(text)) - edges[text])
    length = np.minimum(SLICE_WORDS, (start + size)[text] - begin)
    ends = np.cumsum(length)
    top, at = np.empty((len(text), _K), np.float32), np.empty((len(text), _K), np.int64)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - length[first] + SLICE_WORDS, side="right")))
        full = length[first:last] + PADS - 1
        to = np.cumsum(full) - full
        take = np.repeat(begin[first:last] - to, full) + np.arange(int(full.sum()))
        c = convolve((model["one"][words.one[take]] + model["two"][words.two[take]]) @ model["kernel"], model["bias"])
        top[first:last] = pooled(c, to, length[first:last])
        part = np.repeat(np.arange(last - first), full)
        won = (c == top[first:last][part]) & (np.arange(len(take)) < (to + length[first:last])[part])[:, None]
        for f in range(_K):
            where = np.flatnonzero(won[:, f])
            which, k = np.unique(part[where], return_index=True)
            at[first + which, f] = take[where[k]]
        first = last
    if len(text) == len(rows):
        return top, at
    best = [k + top[k : k + n].argmax(axis=0) for k, n in zip(edges.tolist(), pieces.tolist(), strict=True)]
    best, column = np.array(best), np.arange(_K)
    return top[best, column], at[best, column]


def start(evidence: np.ndarray, toxic: float, others: float, seed: int = 7) -> dict[str, np.ndarray]:
    """The model before its first epoch and its sums of squares; evidence: texts of both classes with a bucket, (table, class, bucket)."""
    rng = np.random.default_rng(seed)
    state = {}
    for name, (ones, rest) in zip(("one", "two"), evidence, strict=True):
        table = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
        odds = np.log((ones + 0.5) / (toxic + 1)) - np.log((rest + 0.5) / (others + 1))
        # The first coordinate starts at the evidence of presence, nought for buckets never seen.
        table[:, 0] = np.where(ones + rest > 1, 0.25 * odds, 0)
        table[ones + rest == 0] = 0
        table[BUCKETS] = 0
        state[name] = table
    kernel = rng.normal(0, 0.3, (DIM, 6 * FILTERS)).astype(np.float32)
    kernel[0, :_K] = np.abs(kernel[0, :_K]) + 0.3
    state |= {"kernel": kernel, "bias": np.zeros(_K, np.float32), "out": np.full(_K, 0.1, np.float32), "shift": np.full(1, -1.0, np.float32)}
    return state | {f"sq_{k}": np.full(v.shape, 0.1, np.float32) for k, v in state.items()}


def descend(state: dict[str, np.ndarray], words: Words, y: np.ndarray, rng: np.random.Generator, batch: int = 32, rate: float = 0.08) -> None:
    """An epoch of Adagrad on the logistic loss, in place; gradients reach only the positions that won the pooling."""
    kernel, out = state["kernel"], state["out"]
    # For each filter: its kernel columns by offset.
    columns = [[f] if f < FILTERS else [f, _K + f - FILTERS] if f < 2 * FILTERS else [f, _K + f - FILTERS, _K + f] for f in range(_K)]

    def step(name: str, grad: np.ndarray, at: np.ndarray | slice = slice(None)) -> None:
        state[f"sq_{name}"][at] += grad**2
        state[name][at] -= rate * grad / np.sqrt(state[f"sq_{name}"][at])

    order = rng.permutation(len(y))
    for b in range(0, len(order), batch):
        rows = order[b : b + batch]
        top, places = winners(state, words, rows)
        h = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ out + state["shift"], -30, 30)))
        d = ((p - y[rows]) / len(rows)).astype(np.float32)
        dh = d[:, None] * out * (top > 0)
        g_kernel = np.zeros_like(kernel)
        touched, g_touched = [], []
        for f in range(_K):
            live = np.flatnonzero(dh[:, f])
            at, g = places[live, f], dh[live, f]
            for j, col in enumerate(columns[f]):
                g_kernel[:, col] += g @ (state["one"][words.one[at + j]] + state["two"][words.two[at + j]])
                touched.append(at + j)
                g_touched.append(g[:, None] * kernel[:, col])
        at, g = np.concatenate(touched), np.concatenate(g_touched)
        for name, ids in (("one", words.one), ("two", words.two)):
            known, back = np.unique(ids[at], return_inverse=True)
            total = np.zeros((len(known), DIM), np.float32)
            np.add.at(total, back, g)
            keep = known < BUCKETS
            step(name, total[keep] + 1e-5 * state[name][known[keep]], known[keep])
        step("kernel", g_kernel + 1e-5 * kernel)
        step("bias", dh.sum(axis=0))
        step("out", h.T @ d + 1e-5 * out)
        step("shift", d.sum(keepdims=True))


def evidence_of(words: Words, y: np.ndarray) -> np.ndarray:
    return np.array([[_presence(words, ids, weight) for weight in (y, 1 - y)] for ids in (words.one, words.two)])


def model_of(state: dict[str, np.ndarray]) -> Model:
    return Model(*(state[k] for k in ("one", "two", "kernel", "bias", "out")), float(state["shift"][0]))


def train(words: Words, y: np.ndarray, epochs: int = 8, seed: int = 7) -> Model:
    """All epochs over rows at hand."""
    state, rng = start(evidence_of(words, y), y.sum(), (1 - y).sum(), seed), np.random.default_rng(seed)
    for _ in range(epochs):
        descend(state, words, y, rng)
    return model_of(state)


class Scorer:
    """A model multiplied out to one row of filter products for each bucket."""

    def __init__(self, model: Model):
        self.model = model
        self.one, self.two = model.one @ model.kernel, model.two @ model.kernel

    def raw(self, words: Words) -> np.ndarray:
        """Logits, in slices of about SLICE_WORDS words; a longer text is pooled piece by piece."""
        top = np.full((len(words.size), _K), -np.inf, np.float32)
        ends = words.start + np.maximum(words.size, 1)
        first = 0
        while first < len(words.size):
            last = max(first + 1, int(np.searchsorted(ends, words.start[first] + SLICE_WORDS)))
            a, b = int(words.start[first]), int(ends[last - 1])
            for lo in range(a, b, SLICE_WORDS):
                hi = min(b, lo + SLICE_WORDS)
                span = slice(lo, hi + PADS - 1)
                c = convolve(self.one[words.one[span]] + self.two[words.two[span]], self.model.bias)[: hi - lo]
                begin = np.maximum(words.start[first:last], lo) - lo
                size = np.minimum(ends[first:last], hi) - lo - begin
                top[first:last] = np.maximum(top[first:last], pooled(np.vstack([c, np.full((1, _K), -np.inf, c.dtype)]), begin, size))
            first = last
        return np.maximum(top, 0) @ self.model.out + self.model.shift


def platt(proof: DataFrame) -> tuple[float, float]:
    """Slope and offset of a logistic fit of y on raw (Newton, lightly held to slope 1), by sums over all rows."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * F.col("raw") + b))))
        g, h = p - F.col("y"), F.greatest(F.lit(1e-6), p * (1 - p))
        gx, g0, hxx, hx, h0 = proof.agg(*(F.sum(x) for x in (g * F.col("raw"), g, h * F.col("raw") * F.col("raw"), h * F.col("raw"), h))).first()
        da, db = np.linalg.solve(np.array([[hxx + 1, hx], [hx, h0 + 0.01]]), np.array([gx + (a - 1), g0 + 0.01 * b]))
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -2, 2))
        if max(abs(da), abs(db)) < 1e-7:
            break
    return a, b


def best_thresholds(scored: DataFrame) -> dict[str | None, float]:
    """For each language with ten toxic rows, and overall (None), the threshold of the largest F1 on the grid, in the middle of a gap; 0.5 without both classes.

    scored: (lang, y, score), of which all rows are counted.
    """
    grid = scored.groupBy("lang", F.floor(F.col("score") * GRID).alias("bin")).agg(F.sum("y").alias("ones"), F.count("y").alias("rows"))
    overall = grid.groupBy("bin").agg(F.sum("ones").alias("ones"), F.sum("rows").alias("rows")).select(F.lit(None).cast("string").alias("lang"), "bin", "ones", "rows")
    w = Window.partitionBy("lang")
    # A language has GRID + 1 bins at most.
    steps = grid.filter("lang is not null").unionByName(overall).select(
        "lang", "bin", F.lead("bin").over(w.orderBy(F.desc("bin"))).alias("next"), F.sum("ones").over(w).alias("toxic"), F.sum("rows").over(w).alias("all"),
        F.sum("ones").over(w.orderBy(F.desc("bin"))).alias("hit"), F.sum("rows").over(w.orderBy(F.desc("bin"))).alias("chosen"),
    )
    steps = steps.filter("lang is null or toxic >= 10").withColumn("f1", 2 * F.col("hit") / (F.col("chosen") + F.col("toxic")))
    best = steps.groupBy("lang").agg(F.max_by(F.struct("bin", "next"), F.struct("f1", "bin")).alias("at"), F.first("toxic").alias("toxic"), F.first("all").alias("all"))
    found: dict[str | None, float] = {None: 0.5}
    for r in best.collect():
        below = 0 if r["at"]["next"] is None else r["at"]["next"] + 1
        found[r["lang"]] = 0.5 if r["toxic"] in (0, r["all"]) else (r["at"]["bin"] + below) / (2 * GRID)
    return found


def _hashed(batches: Iterator[pa.RecordBatch], extra: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in hashed_slices(batch.column(extra), NOT_WORD):
            lists = pa.ListArray.from_arrays(pa.array(s.word_at.astype(np.int32)), pa.array(s.hashes.astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(s.first, s.rows) for i in range(extra)], lists], [*batch.schema.names[:extra], "words"])


def learning_rows(docs: DataFrame, labels: DataFrame, hold_modulus: int, hold_remainder: int) -> tuple[DataFrame, int, int]:
    """(doc_id, lang, y, words) of every labelled row that may be learnt from, and how many labels are toxic and not."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    usable = usable.filter(crc_mod(F.col("doc_id"), hold_modulus) != hold_remainder).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    usable = usable.withColumn("y", (F.col("y") == 1).cast("int"))
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    chosen = F.broadcast(usable) if sum(counts.values()) <= BROADCAST_ROWS else usable
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    # Of texts that share a doc_id the smallest counts.
    held = texts.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("t")).select("doc_id", "t.lang", "y", "t.text")
    rows = held.mapInArrow(lambda it: _hashed(it, 3), "doc_id long, lang string, y int, words array<int>")
    return staged(rows, "toxicity-words"), counts.get(1, 0), counts.get(0, 0)


def _words(lists: pa.Array) -> Words:
    at = lists.offsets.to_numpy().astype(np.int64)
    return padded(lists.values.to_numpy()[at[0] : at[-1]].view(np.uint32).astype(np.uint64), at)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, y, words), those of a shard together, to one row (shard, y, sizes, hashes) for each shard."""
    shard, parts = None, []

    def row() -> pa.RecordBatch:
        blobs = [pa.array([b"".join(x.tobytes() for x in part)], pa.binary()) for part in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *blobs], ["shard", "y", "sizes", "hashes"])

    for batch in batches:
        shards = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if parts and shards[a] != shard:
                yield row()
                parts = []
            shard = int(shards[a])
            lists = batch.column(2).slice(a, b - a)
            at = lists.offsets.to_numpy()
            parts.append((batch.column(1).slice(a, b - a).to_numpy().astype(np.float32), np.diff(at).astype(np.int64), lists.values.to_numpy()[at[0] : at[-1]].copy()))
    if parts:
        yield row()


def _over_shards(shards: DataFrame, change: Callable[[int, Words, np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The sums over all shards of the arrays that change(shard, words, y) gives by name, added block by block in the order of shards."""
    block = 8192

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, y, sizes, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
                arrays = change(shard, padded(np.frombuffer(hashes, np.uint32).astype(np.uint64), at), np.frombuffer(y, np.float32))
                for name, value in arrays.items():
                    cut = [value[k : k + block].astype(np.float32).tobytes() for k in range(0, len(value), block)]
                    yield pa.RecordBatch.from_pydict({"name": [name] * len(cut), "block": pa.array(range(len(cut)), pa.int32()), "shard": pa.array([shard] * len(cut), pa.int32()), "value": pa.array(cut, pa.binary())})

    def folded(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        total = 0
        for value in group.column("value"):
            total = total + np.frombuffer(value.as_buffer(), np.float32).astype(np.float64)
        return pa.table({"name": group.column("name")[:1], "block": group.column("block")[:1], "value": pa.array([total.tobytes()], pa.binary())})

    rows = shards.mapInArrow(changed, "name string, block int, shard int, value binary").groupBy("name", "block").applyInArrow(folded, "name string, block int, value binary").collect()
    parts: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["name"], r["block"])):
        parts.setdefault(r["name"], []).append(np.frombuffer(bytes(r["value"])))
    return {k: np.concatenate(v) for k, v in parts.items()}


def descended(spark: SparkSession, shards: DataFrame, toxic: int, others: int, seed: int = 7) -> Model:
    """EPOCHS epochs over all shards, whose changes are averaged after each."""

    def seen(_: int, words: Words, y: np.ndarray) -> dict[str, np.ndarray]:
        return dict(zip("abcd", evidence_of(words, y).reshape(4, -1), strict=True))

    found = _over_shards(shards, seen)
    state = start(np.array([found[k] for k in "abcd"]).reshape(2, 2, -1), toxic, others, seed)
    for epoch in range(EPOCHS):
        shared = spark.sparkContext.broadcast(state)

        def change(shard: int, words: Words, y: np.ndarray, shared=shared, epoch=epoch) -> dict[str, np.ndarray]:
            before = shared.value
            after = {k: v.copy() for k, v in before.items()}
            descend(after, words, y, np.random.default_rng((seed, epoch, shard)))
            out = {k: (after[k] - before[k]).ravel() for k in after}
            return out | {f"n_{k}": (after[f"sq_{k}"] != before[f"sq_{k}"]).any(axis=-1).astype(np.float32) for k in ("one", "two")} | {"n": np.ones(1)}

        total = _over_shards(shards, change)
        shared.unpersist()
        for name, value in state.items():
            table = name.removeprefix("sq_")
            times = np.maximum(total[f"n_{table}"], 1)[:, None] if table in ("one", "two") else total["n"]
            state[name] = (value + total[name].reshape(value.shape) / times).astype(np.float32)
    return model_of(state)


def fit(rows: DataFrame, toxic: int, others: int) -> tuple[Model | None, tuple[float, float], dict[str | None, float]]:
    """Model, Platt step and thresholds by language (None: overall), from all of `rows`."""
    spark = rows.sparkSession
    rows = rows.withColumn("proof", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PROOF_ONE_IN)) == 0)
    sums = {(r["proof"], r["y"]): (r["n"], r["words"]) for r in rows.groupBy("proof", "y").agg(F.count("y").alias("n"), F.sum(F.size("words")).alias("words")).collect()}
    if len({y for _, y in sums}) < 2:
        return None, (0.0, float(np.log((toxic + 1) / (others + 1)))), {None: 0.5}
    # With few labels, where one part lacks a class, both parts are all rows.
    both = len(sums) < 4
    learnt = {k: v for k, v in sums.items() if both or not k[0]}
    n, words = (sum(v[i] for v in learnt.values()) for i in range(2))
    count = max(1, -(-n // SHARD_ROWS), -(-words // SHARD_WORDS))
    dealt = (rows if both else rows.filter("not proof")).select(F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("shard"), "y", "words", "doc_id")
    packed = dealt.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "doc_id").drop("doc_id").mapInArrow(_packed, "shard int, y binary, sizes binary, hashes binary")
    shards = staged(packed, "toxicity-shards")
    model = descended(spark, shards, *(sum(v[0] for k, v in learnt.items() if k[1] == y) for y in (1, 0)))
    discard(shards)
    shared = spark.sparkContext.broadcast(model)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            values = [scorer.raw(_words(batch.column(2).slice(k, 512))) for k in range(0, batch.num_rows, 512)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([*values, np.zeros(0)]), pa.float64())], ["lang", "y", "raw"])

    proof = staged((rows if both else rows.filter("proof")).select("lang", "y", "words").mapInArrow(raw, "lang string, y int, raw double"), "toxicity-proof")
    a, b = platt(proof)
    thresholds = best_thresholds(proof.select("lang", "y", (1 / (1 + F.exp(-(a * F.col("raw") + b)))).alias("score")))
    discard(proof)
    return model, (a, b), thresholds


def toxicity_scores(docs: DataFrame, labels: DataFrame, hold_modulus: int = 4, hold_remainder: int = 2, cutoff: float = 0.3) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, lang_threshold, flagged), one per row of `docs`.

    predicted holds the score against `cutoff`, flagged against the threshold
    calibrated for the row's language.
    """
    spark = docs.sparkSession
    rows, toxic, others = learning_rows(docs, labels, hold_modulus, hold_remainder)
    model, (a, b), thresholds = fit(rows, toxic, others)
    discard(rows)
    shared = spark.sparkContext.broadcast(model)  # two tables of BUCKETS x DIM floats: 4 MB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for s in hashed_slices(batch.column(2), NOT_WORD):
                if scorer:
                    out[s.first : s.first + s.rows] = scorer.raw(padded(s.hashes, s.word_at))
            scores = 1 / (1 + np.exp(-np.clip(a * out + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], ["doc_id", "lang", "score"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, lang string, score double")
    by_lang = F.lit(thresholds[None])
    for lang_name, value in thresholds.items():
        if lang_name is not None:
            by_lang = F.when(F.col("lang") == lang_name, F.lit(value)).otherwise(by_lang)
    held = F.coalesce(crc_mod(F.col("doc_id"), hold_modulus) == hold_remainder, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), by_lang.alias("lang_threshold"), (F.col("score") >= by_lang).alias("flagged"))
