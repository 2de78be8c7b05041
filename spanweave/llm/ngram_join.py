"""N-gram Jaccard join by vertical partitioning.

A global order of all shingles puts those that recur most in a sample of
the documents last and the rest by hash; any fixed order gives the same
links, this one gives few candidates.  The order is cut into fragments:

1. each text, once, gives its set size, a 128-bit signature of its set, and
   its *prefix* (the shingles among which a partner must share one), dealt
   out by fragment of the order;
2. each fragment on its own counts, for each pair of sets that share a
   *plain* shingle (one of at most POSTING sets), how many they share: a row
   for a pair and fragment.  The sums over the fragments rule most pairs out;
3. *hot* shingles (of more sets, or common in the sample) stay rows that Spark
   deals out and splits.  Round by round their sets are held against a few
   centres of the largest group that shares the shingle, so that a large
   group of near copies costs links in proportion to its size; then every
   pair that shares one and still lies in different components is a
   candidate, so no link is lost;
4. candidates are verified exactly: whole sets are cut by the fragments of
   the order, partial overlaps are counted for each fragment by itself and
   summed per pair.  A set is shipped once for each hub it is held against.

Documents of one set are one node throughout, so exact copies cost nothing
beyond step 1.

Edge cases: a text without words (or null) has an empty set, links with
nothing and is its own component; with fewer words than a shingle the whole
sequence is the one shingle; repeated rows are copies of one set; a row with
null doc_id is measured but has a null component, and names no component;
an empty table gives an empty result; columns besides doc_id and text are
not read.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, renamed, sent
from .storage import discard, staged
from .wordhash import hashed_slices, mix

WORDS = 5
PERCENT = 75
#: Efficiency only: share of documents sampled for the order, and the most shingles that are put last.
SAMPLE_ONE_IN = 8
MOST_COMMON = 400_000
FRAGMENT_SHINGLES = 4_000_000
LEAST_FRAGMENTS = 64
#: About as many shingles of a fragment are brought together at a time, and counted at a time for the order.
MEET_SHINGLES = 1 << 18
#: Texts whose prefixes are gathered before they are sent on.
BLOCK_TEXTS = 2048
#: A shingle of more sets than this is hot: its pairs aren't listed at once.
POSTING = 32
#: Centres that a hot shingle's sets are held against in the first round, twice as many in each further one up to
#: MOST_CENTRES; rounds end once fewer than SETTLED of the sets find a link.
CENTRES = 3
MOST_CENTRES = 24
SETTLED = 0.1
#: Efficiency only: pairs still apart are verified up to these places of likelihood in turn, then all others.
TURNS = (2, 16, 64, 256)
#: Vertical fragments of the sets under verification: hash ranges, and the common shingles as one more.
HASH_BITS = 1
#: Most members that one copy of a hub's set is held against, and sets in a task's group.
BUNDLE = 256
GROUP_SETS = 1024
BROADCAST_ROWS = 500_000

_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the column."""
    factors = mix(np.arange(1, words + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    for s in hashed_slices(column):
        n = max(0, len(s.hashes) - words + 1)
        runs = np.zeros(n, np.uint64)
        for j in range(words):
            runs += s.hashes[j : j + n] * factors[j]
        runs = mix(runs)
        for i in range(s.rows):
            a, b = int(s.word_at[i]), int(s.word_at[i + 1])
            if b - a >= words:
                found = np.sort(runs[a : b - words + 1])
                keep = np.empty(len(found), dtype=bool)
                keep[0] = True
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            elif b > a:
                short = np.array([b - a], np.uint64)
                for h in s.hashes[a:b]:
                    short = mix(short * _STEP ^ h)
                yield short
            else:
                yield np.zeros(0, np.uint64)


def _signature(found: np.ndarray) -> tuple[int, int]:
    return int(np.add.reduce(mix(found)).view(np.int64)) if len(found) else 0, int(np.add.reduce(mix(found ^ _STEP)).view(np.int64)) if len(found) else 0


def _pieces(sets: Iterator[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    """The sets in lists that end once they hold `most` shingles."""
    piece, size = [], 0
    for found in sets:
        piece.append(found)
        size += len(found)
        if size >= most:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def common_shingles(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Up to MOST_COMMON shingles that recur in a sample, rarest first.

    This sets the order in which shingles are looked at, not which are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(0), words)
            for piece in _pieces(sets, MEET_SHINGLES):
                values, counts = np.unique(np.concatenate(piece), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["shingle", "n"])

    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_IN)) == 0)
    counted = sample.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter("n > 1")
    counted = staged(counted, "ngram-common")
    # The cut is the lowest count that leaves at most MOST_COMMON shingles.
    sizes = counted.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy("n").toPandas()
    above = sizes["count"][::-1].cumsum()[::-1]
    fitting = sizes["n"][above <= MOST_COMMON]
    if fitting.empty:
        return np.zeros(0, np.uint64)
    top = counted.filter(F.col("n") >= int(fitting.min())).toPandas().sort_values(["n", "shingle"])
    return top["shingle"].to_numpy(np.int64).view(np.uint64).copy()


def _prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _ordered(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The set in global order, and how many of it aren't common."""
    if not len(common):
        return found, len(found)
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    is_common = common[at] == found
    last = found[is_common]
    return np.concatenate([found[~is_common], last[np.argsort(rank[at[is_common]])]]), len(found) - len(last)


_HEAD = np.dtype([("sig1", "i8"), ("n", "i4"), ("start", "i4"), ("count", "i4")])


def _measure(docs: DataFrame, common_in_order: np.ndarray, fragments: int, words: int, percent: int) -> DataFrame:
    """Rows of three kinds: (doc_id, n, sig1, sig2) for a document, (frag, heads, shingles) for a block of prefixes
    without their common shingles, (shingle, sig1, n, pos) for a common shingle in a prefix."""
    by_value = np.argsort(common_in_order)
    common = common_in_order[by_value]
    fields = ["doc_id", "n", "sig1", "sig2", "frag", "heads", "shingles", "shingle", "pos"]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def rows_of(rows: int, /, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f, pa.nulls(rows, t)) for f, t in zip(fields, kinds, strict=True)], fields)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(65 - int(fragments).bit_length())
        for batch in (b.slice(k, BLOCK_TEXTS) for b in batches for k in range(0, b.num_rows, BLOCK_TEXTS)):
            ids, rows, blocks, seen, hot = batch.column(0).to_pylist(), [], {}, set(), []
            for doc_id, found in zip(ids, shingle_sets(batch.column(1), words), strict=True):
                n = len(found)
                one, two = _signature(found)
                rows.append((n, one, two))
                if n == 0 or doc_id is None or (one, two) in seen:
                    continue
                seen.add((one, two))
                ordered, plain = _ordered(found, common, by_value)
                prefix = ordered[: _prefix_size(n, percent)]
                if len(prefix) > plain:
                    hot.append((one, n, plain, prefix[plain:]))
                    prefix = prefix[:plain]
                if not len(prefix):
                    continue
                part = (prefix >> shift).astype(np.int64)
                starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
                ends = np.append(starts[1:], len(prefix))
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    heads, shingles = blocks.setdefault(int(part[a]), ([], []))
                    heads.append((one, n, a, b - a))
                    shingles.append(prefix[a:b])
            n, one, two = (pa.array([r[i] for r in rows], pa.int64()) for i in range(3))
            yield rows_of(len(rows), doc_id=pa.array(ids, pa.int64()), n=n, sig1=one, sig2=two)
            if blocks:
                heads = pa.array([np.array(h, _HEAD).tobytes() for h, _ in blocks.values()], pa.binary())
                yield rows_of(len(blocks), frag=pa.array(list(blocks), pa.int32()), heads=heads, shingles=pa.array([np.concatenate(x).tobytes() for _, x in blocks.values()], pa.binary()))
            if hot:
                held = [len(h[3]) for h in hot]
                one, n, first = (np.repeat(np.array([h[i] for h in hot], np.int64), held) for i in range(3))
                pos = first + np.arange(len(first)) - np.repeat(np.cumsum(held) - held, held)
                shingle = np.concatenate([h[3] for h in hot]).view(np.int64)
                yield rows_of(len(pos), n=pa.array(n), sig1=pa.array(one), shingle=pa.array(shingle), pos=pa.array(pos))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, "doc_id long, n long, sig1 long, sig2 long, frag int, heads binary, shingles binary, shingle long, pos long")


_MET = ["a", "b", "n_a", "n_b", "shared", "first_a", "first_b", "last_a", "last_b"]


def _runs(u: np.ndarray, v: np.ndarray, shared: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """A row for each pair (u, v): what it shares summed, the least of both first places and the greatest of both last ones."""
    order = np.lexsort((v, u))
    u, v, shared, ends = u[order], v[order], shared[order], [c[order] for c in ends]
    cut = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))) if len(u) else np.zeros(0, np.int64)
    if not len(cut):
        return [u, v, shared, *ends]
    folds = (np.minimum, np.minimum, np.maximum, np.maximum)
    return [u[cut], v[cut], np.add.reduceat(shared, cut), *(f.reduceat(c, cut) for f, c in zip(folds, ends, strict=True))]


def _met(blocks: DataFrame, percent: int) -> DataFrame:
    """Of each fragment the pairs of sets that share its plain shingles, a row each, and the rows of its hot shingles."""
    fields = [*_MET, "shingle", "sig", "n", "pos"]

    def turn_of(value: np.ndarray, of: np.ndarray, pos: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of some of the shingles all rows: the pairs (u, v, shared, ends), and the hot rows (shingle, of, pos)."""
        order = np.lexsort((of, value))
        value, of, pos = value[order], of[order], pos[order]
        # A set that is there twice counts once.
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
        value, of, pos = value[fresh], of[fresh], pos[fresh]
        start = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        held = np.diff(np.append(start, len(value)))
        lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in range(2, POSTING + 1):
            at = start[held == m]
            if len(at):
                x, y = np.triu_indices(m, 1)
                x, y = (at[:, None] + x).ravel(), (at[:, None] + y).ravel()
                small, large = np.minimum(sizes[of[x]], sizes[of[y]]), np.maximum(sizes[of[x]], sizes[of[y]])
                near = 100 * small >= percent * large
                lefts.append(x[near]), rights.append(y[near])
        x, y = np.concatenate(lefts), np.concatenate(rights)
        hot = np.repeat(held > POSTING, held)
        return _runs(of[x], of[y], np.ones(len(x), np.int64), pos[x], pos[y], pos[x], pos[y]), [value[hot], of[hot], pos[hot]]

    def meet(group: pa.Table) -> pa.Table:
        heads = np.frombuffer(b"".join(group.column("heads").to_pylist()), _HEAD)
        shingle = np.frombuffer(b"".join(group.column("shingles").to_pylist()), np.uint64)
        count = heads["count"].astype(np.int64)
        sigs, first, which = np.unique(heads["sig1"], return_index=True, return_inverse=True)
        sizes = heads["n"][first].astype(np.int64)
        of = np.repeat(which.astype(np.int32), count)
        pos = np.arange(len(shingle), dtype=np.int32) + np.repeat((heads["start"] - (np.cumsum(count) - count)).astype(np.int32), count)
        # All rows of a shingle fall in one turn, so that a worker's memory doesn't follow the fragment's size.
        turns = 1 << (len(shingle) // MEET_SHINGLES).bit_length()
        met, kept = [], []
        for turn in range(turns):
            at = np.flatnonzero((shingle & np.uint64(turns - 1)) == turn)
            pairs, rows = turn_of(shingle[at], of[at], pos[at], sizes)
            met.append(pairs), kept.append(rows)
        u, v, *sums = _runs(*(np.concatenate(c) for c in zip(*met, strict=True)))
        value, of, pos = (np.concatenate(c) for c in zip(*kept, strict=True))
        k, h = len(u), len(value)
        pairs = [sigs[u], sigs[v], sizes[u], sizes[v], *sums]
        rows = [value.view(np.int64), sigs[of], sizes[of], pos]
        columns = [pa.chunked_array([pa.array(c.astype(np.int64)), pa.nulls(h, pa.int64())]) for c in pairs] + [pa.chunked_array([pa.nulls(k, pa.int64()), pa.array(c.astype(np.int64))]) for c in rows]
        return pa.Table.from_arrays(columns, fields)

    return blocks.groupBy("frag").applyInArrow(meet, ", ".join(f"{f} long" for f in fields))


def _near(percent: int) -> Column:
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _least_overlap(percent: int) -> Column:
    return F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))


def _summed(pairs: DataFrame) -> DataFrame:
    """The partial overlaps of the plain shingles, summed over the fragments."""
    ends = [f(c).alias(c) for f, c in ((F.min, "first_a"), (F.min, "first_b"), (F.max, "last_a"), (F.max, "last_b"))]
    return pairs.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"), *ends)


def _possible(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The summed pairs that can still reach the similarity, whatever hot shingles they share; held: (sig, hot).

    Up to the last shingle that both prefixes hold, and up to the end of the
    prefix that ends first, all that isn't shared is known to differ.  A pair
    without plain shingles in common has null ends.
    """
    for side in "ab":
        pairs = pairs.join(held.select(F.col("sig").alias(side), F.col("hot").alias(f"hot_{side}")), side, "left")
    more = F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0)))
    pairs = pairs.withColumn("more", more).withColumn("most", F.col("shared") + F.col("more"))
    size = lambda n: F.col(n) - F.ceil(F.lit(percent) * F.col(n) / 100) + 1
    left_over = lambda s: F.col(f"n_{s}") - size(f"n_{s}") + F.col("most")
    upto_last = lambda s: F.col(f"n_{s}") - F.col(f"last_{s}") - 1 + F.col("most")
    reach = F.least(F.col("n_a") - F.col("first_a"), F.col("n_b") - F.col("first_b")) + F.col("more")
    least = _least_overlap(percent)
    met = (F.least(upto_last("a"), upto_last("b")) >= least) & (reach >= least)
    return pairs.filter((F.greatest(left_over("a"), left_over("b")) >= least) & F.coalesce(met, F.lit(True)))


def _cut_sets(texts: DataFrame, common_in_order: np.ndarray, words: int) -> DataFrame:
    """(sig, bucket, hub, text) to (bucket, frag, hub, member, n, shingles): the whole set, cut by the fragments of the order."""
    common = np.sort(common_in_order)
    fields = ["bucket", "frag", "hub", "member", "n", "shingles"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(1, 2**HASH_BITS, dtype=np.uint64) << np.uint64(64 - HASH_BITS)) if HASH_BITS else np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, bucket, hub = (batch.column(i).to_numpy() for i in range(3))
            # The seats of one text stand together, and it is read once; documents that share a doc_id may alternate.
            texts = batch.column(3)
            other = pc.fill_null(pc.not_equal(texts[1:], texts[:-1]), True).to_numpy(zero_copy_only=False)
            fresh = np.append(True, (sig[1:] != sig[:-1]) | other)
            turn = np.append(np.flatnonzero(fresh), len(sig))
            out, size = [[] for _ in fields], 0
            for i, found in enumerate(shingle_sets(texts.filter(pa.array(fresh)), words)):
                if _signature(found)[0] != sig[turn[i]]:
                    continue
                is_common = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found if len(common) else np.zeros(len(found), bool)
                plain = found[~is_common]
                pieces = [p.tobytes() for p in (*np.split(plain, np.searchsorted(plain, edges)), found[is_common])]
                for at in range(turn[i], turn[i + 1]):
                    for frag, piece in enumerate(pieces):
                        if piece:
                            for column, x in zip(out, (bucket[at], frag, hub[at], sig[at], len(found), piece), strict=True):
                                column.append(x)
                            size += len(piece)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _CUT, strict=True)], fields)
                        out, size = [[] for _ in fields], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _CUT, strict=True)], fields)

    return texts.mapInArrow(cut, "bucket int, frag int, hub long, member long, n long, shingles binary")


_CUT = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _partial_overlaps(group: pa.Table) -> pa.Table:
    """Of one fragment and group of hubs: how much of each hub's set its members share."""
    hub, member, n = (group.column(c).to_numpy() for c in ("hub", "member", "n"))
    sets = group.column("shingles").to_pylist()
    order = np.lexsort((member, member != hub, hub))
    order = order[np.append(True, (hub[order][1:] != hub[order][:-1]) | (member[order][1:] != member[order][:-1]))] if len(order) else order
    turn = np.append(np.flatnonzero(np.append(True, hub[order][1:] != hub[order][:-1])), len(order)) if len(order) else np.zeros(1, np.int64)
    out = [[], [], [], [], []]
    for a, b in zip(turn[:-1].tolist(), turn[1:].tolist(), strict=True):
        rows = order[a:b]
        if member[rows[0]] != hub[rows[0]] or b - a < 2:
            continue  # the hub or all others have nothing in this fragment
        base, others = np.frombuffer(sets[rows[0]], np.uint64), rows[1:]
        size = np.array([len(sets[r]) // 8 for r in others])
        values = np.frombuffer(b"".join([sets[r] for r in others]), np.uint64)
        same = base[np.minimum(np.searchsorted(base, values), len(base) - 1)] == values
        shared = np.add.reduceat(same.astype(np.int64), np.cumsum(size) - size)
        some = shared > 0
        for column, x in zip(out, (hub[others], member[others], np.full(len(others), n[rows[0]]), n[others], shared), strict=True):
            column.append(x[some])
    return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], ["a", "b", "n_a", "n_b", "overlap"])


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of `docs`.

    component_id is the smallest doc_id reachable by links (100 * intersection
    >= percent * union) or by equal sets.
    """
    common = common_shingles(docs, words)
    # About six bytes a word, a quarter of the shingles in a prefix, and those in the lower quarter of the hashes.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, 1 << int(size / 6 / FRAGMENT_SHINGLES).bit_length())
    measured = staged(_measure(docs, common, fragments, words, percent), "ngram-measured")
    sets = staged(measured.filter("frag is null and shingle is null").select("doc_id", "n", "sig1", "sig2"), "ngram-sets")
    classes = staged(sets.filter("n > 0 and doc_id is not null").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("class_id")), "ngram-classes")
    met = staged(_met(measured.filter("frag is not null").select("frag", "heads", "shingles"), percent), "ngram-met")
    common_rows = measured.filter("shingle is not null").select("shingle", F.col("sig1").alias("sig"), "n", "pos").distinct()
    hot = staged(met.filter("shingle is not null").select("shingle", "sig", "n", "pos").union(common_rows), "ngram-hot")
    discard(measured)
    joined = _Linker(docs, classes, met.filter("a is not null").select(*_MET), hot, common, words, percent).components()
    discard(met)
    named = classes.join(joined.select(F.col("node").alias("sig1"), "component"), "sig1", "left").withColumn("component", F.coalesce("component", "sig1"))
    heads = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(heads, "component").select("sig1", "sig2", "component_id")
    out = sets.join(named, ["sig1", "sig2"], "left")
    own = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


class _Linker:
    """Finds enough verified links (a, b) to connect all that any links connect."""

    def __init__(self, docs: DataFrame, classes: DataFrame, met: DataFrame, hot: DataFrame, common: np.ndarray, words: int, percent: int):
        self.docs, self.hot, self.common, self.words, self.percent = docs, hot, common, words, percent
        self.met = staged(_summed(met), "ngram-summed")
        self.held = staged(hot.groupBy("sig").agg(F.count("shingle").alias("hot")), "ngram-held")
        self.doc_of = staged(classes.groupBy(F.col("sig1").alias("sig")).agg(F.min("class_id").alias("doc_id")), "ngram-docs")
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        # Broadcasts of names and counts: a join with a few of them shuffles nothing.
        self.of_held = sent(self.held, self.held.count())

    def verify(self, pairs: DataFrame) -> tuple[int, int]:
        """Adds the links among `pairs` (hub, member); about how many members there were, and how many of them found a link."""
        pairs = staged(pairs.filter("hub <> member").groupBy(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b")).agg(F.min("hub").alias("hub"), F.min_by("member", "hub").alias("member")).select("hub", "member"), "ngram-pairs")
        # How many members there are only says when rounds have settled, so that about is enough.
        count, members = pairs.agg(F.count("member"), F.approx_count_distinct("member")).first()
        if not count:
            return 0, 0
        bundles = staged(pairs.groupBy("hub").agg(F.ceil(F.count("member") / BUNDLE).alias("bundles")), "ngram-bundles")
        groups = -(-count // GROUP_SETS)
        bucket = F.pmod(F.xxhash64("hub", "bundle"), F.lit(groups)).cast("int").alias("bucket")
        placed = pairs.join(sent(bundles, count), "hub").withColumn("bundle", F.pmod(F.xxhash64("member"), "bundles")).select(F.col("member").alias("sig"), bucket, "hub")
        # Bundles of one hub may fall in one bucket; its set is needed there once.
        numbers = F.transform(F.sequence(F.lit(0).cast("long"), F.col("bundles") - 1), lambda k: F.pmod(F.xxhash64("hub", k), F.lit(groups)).cast("int"))
        own = bundles.select(F.col("hub").alias("sig"), F.explode(F.array_distinct(numbers)).alias("bucket"), "hub")
        seats = placed.union(own)
        seats = staged(self.doc_of.join(sent(seats, 2 * count), "sig").select("sig", "bucket", "hub", "doc_id"), "ngram-seats")
        # Names of a few numbers each are sent to all tasks only while they are few; beyond that both sides are shuffled.
        named = F.broadcast(seats) if seats.count() <= BROADCAST_ROWS else seats
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(named, "doc_id").select("sig", "bucket", "hub", "text")
        partial = _cut_sets(texts, self.common, self.words).groupBy("bucket", "frag").applyInArrow(_partial_overlaps, "a long, b long, n_a long, n_b long, overlap long")
        total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
        found = staged(total.filter(100 * F.col("overlap") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b"), "ngram-links")
        gained = found.agg(F.approx_count_distinct("b")).first()[0]
        discard(seats), discard(pairs), discard(bundles)
        if gained:
            # Known components and the new links connect what all links so far connect.
            held = found if self.labels is None else found.union(self.labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
            self.labels = connected_components(held, "ngram-round")
            self.names = sent(self.labels, self.labels.count())
        return members, gained

    def grouped(self, rows: DataFrame, name: str, group: str) -> DataFrame:
        """`rows` with the component of the set in column `name`."""
        if self.labels is None:
            return rows.withColumn(group, F.col(name))
        return renamed(rows.withColumn(group, F.col(name)), group, self.names)

    def main_groups(self) -> DataFrame:
        """Hot rows that share their shingle with another group, with its largest group."""
        marked = self.grouped(self.hot, "sig", "group")
        sizes = marked.groupBy("shingle", "group").agg(F.count("sig").alias("held"))
        largest = sizes.groupBy("shingle").agg(F.max_by("group", F.struct("held", "group")).alias("main"), F.count("group").alias("groups")).filter("groups > 1")
        return staged(marked.join(largest.select("shingle", "main"), "shingle"), "ngram-marked")

    def star_pairs(self, marked: DataFrame, step: int) -> DataFrame:
        """The sets outside a hot shingle's largest group against a few of that group, the same few wherever it meets them."""
        count = min(CENTRES << max(step - 1, 0), max(CENTRES, MOST_CENTRES))
        turns = [F.min(F.struct(F.xxhash64("sig", F.lit(step), F.lit(j)).alias("turn"), "sig", "n")).alias(f"c{j}") for j in range(count)]
        # While each set is its own group, any set is as good as a centre.
        inside = marked if self.labels is None else marked.filter("group = main")
        centres = inside.groupBy("shingle").agg(*turns).select("shingle", F.array(*[f"c{j}" for j in range(count)]).alias("c"))
        outside = marked if self.labels is None else marked.filter("group <> main")
        near = outside.join(centres, "shingle").select(F.col("sig").alias("member"), F.col("n").alias("n_a"), F.explode(F.array_distinct("c")).alias("c"))
        return near.select(F.col("c.sig").alias("hub"), "member", "n_a", F.col("c.n").alias("n_b")).filter(_near(self.percent)).select("hub", "member")

    def apart(self, marked: DataFrame) -> DataFrame:
        """Every pair of sets of different groups that shares a hot shingle and can reach the similarity.

        `place` orders the members of a group by what they are known to share with the hub.
        """
        x = marked.filter("group <> main").select("shingle", F.col("sig").alias("hub"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("group").alias("group_a"))
        y = marked.select("shingle", F.col("sig").alias("member"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("group").alias("group_b"), "main")
        reach = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
        # Held for the first shingle that a pair shares; later ones may fail it.
        met = x.join(y, "shingle").filter("group_a <> group_b and (group_b = main or hub < member)")
        met = met.filter(_near(self.percent) & (reach >= _least_overlap(self.percent))).groupBy("hub", "member", "n_a", "n_b", "group_b").agg(F.count("shingle").alias("met"))
        # What they share of plain shingles is known, of hot ones no more than either holds.
        swap = F.col("hub") > F.col("member")
        pairs = met.select("hub", "member", "group_b", "met", F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b"), F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"))
        pairs = pairs.join(self.met.drop("n_a", "n_b"), ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
        left = _possible(pairs, self.of_held, self.percent)
        share = (F.col("met") + F.col("shared")) / (F.col("n_a") + F.col("n_b"))
        return left.select("hub", "member", F.row_number().over(Window.partitionBy("hub", "group_b").orderBy(share.desc(), "member")).alias("place"))

    def components(self) -> DataFrame:
        """Rows (node, component)."""
        pairs = staged(_possible(self.met, self.of_held, self.percent).select("a", "b", (F.col("shared") / (F.col("n_a") + F.col("n_b"))).alias("share")), "ngram-possible")
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "share"))
        # Of the partners that share about as much as any, the one that most sets have for a partner: few hubs then serve many.
        wanted = both.groupBy(F.col("a").alias("b")).agg(F.count("b").alias("partners"))
        best = both.join(wanted, "b").groupBy("a").agg(F.max_by("b", F.struct(F.floor(F.col("share") * 16).alias("about"), "partners", "b")).alias("b"))
        first = best.select(F.col("b").alias("hub"), F.col("a").alias("member"))
        # The best partner of each set, and the first centres of the hot shingles.
        self.verify(first.union(self.star_pairs(self.hot, 0)))
        # All pairs of plain shingles that are still apart, and further centres.
        rest = self.grouped(self.grouped(pairs, "a", "group_a"), "b", "group_b").filter("group_a <> group_b").select(F.col("a").alias("hub"), F.col("b").alias("member"))
        self.verify(rest)
        step = 1
        while True:
            marked = self.main_groups()
            tried, gained = self.verify(self.star_pairs(marked, step))
            step += 1
            if gained <= SETTLED * tried:
                break
        # What is still apart pair by pair, likely links first: sets that these tie in need no more.
        apart = staged(self.apart(self.main_groups() if gained else marked), "ngram-apart")
        for low, high in itertools.pairwise((0, *TURNS, None)):
            turn = apart.filter((F.col("place") > low) & (F.col("place") <= high) if high else F.col("place") > low)
            still = self.grouped(self.grouped(turn, "hub", "group_a"), "member", "group_b").filter("group_a <> group_b")
            self.verify(still.select("hub", "member"))
        return self.labels if self.labels is not None else pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
