"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Equal vectors are one node that keeps all its rows' ids, so a vector that
holds any share of the rows costs no more than another, and ties come out in
order of vec_id.

Nodes are laid in order of random-hyperplane codes; runs of that order, and a
few pivots, give first neighbours.  NN-descent then improves the graph round
by round: the members of a node (its neighbours and those that name it) meet
each other, and the best pairs that beat a member's worst neighbour are
proposed to it.  A round is three Spark joins on dealt keys: edges meet the
nodes that they name (by part), the nodes, with small copies of their vectors,
meet in the blocks of all that they are members of, and proposals meet the
lists that they are for (by part).  A node sits in at most as many blocks as it
has members, however many blocks there are.  Rounds end when few neighbours
change; `max_rounds` is a bound that raises an error when it is reached.

Queries start from their own neighbours in the graph; each step expands the
best nodes not yet expanded, again by joins on the graph and the vectors, and
scores what they lead to exactly, in double precision, until a step changes no
query's first k.

A node's members beyond twice the degree are thinned by hash, and a member is
proposed its OFFERS best of each meeting: the sampling steps of the method. All
vectors are indexed and all queries answered.  Recall against brute force is
measured by the tests.

Edge cases: vectors that are null, empty, zero, hold null or non-finite
components, or have another length than most take no part, as candidate or
query; repeated rows and repeated vec_ids are candidates each for itself, and
each such query row gets its own result; a null vec_id takes no part; equal
scores order by vec_id; with fewer candidates than asked for, all that were
found are returned; an empty table gives an empty result; other columns are not
read.  Vectors are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, staged

DEGREE = 32
RUN = 256
ORDERS = 3
PIVOTS = 64
BLOCK = 512
PART = 4096
OFFERS = 6
MAX_ROUNDS = 30
#: Rounds end once fewer than this share of all neighbours change.
SETTLED = 0.02
POOL = 128
EXPAND = 24
MAX_STEPS = 30
#: Steps end once fewer than this share of the queries get other first k.
STEADY = 0.002


def usable_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(sound)
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.filter(F.size("v") == sizes[0]["size"]) if sizes else rows


def _matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def best_of(owner: np.ndarray, other: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `keep` best distinct others of each owner, best first, ties to the smaller other; sorted by owner.

    A pair has one score wherever it is met.
    """
    order = np.lexsort((other, -score, owner))
    owner, other, score = owner[order], other[order], score[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, score = owner[fresh], other[fresh], score[fresh]
    first = np.searchsorted(owner, owner, side="left")
    top = np.arange(len(owner)) - first < keep
    return owner[top], other[top], score[top]


def small_copies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components as whole numbers from -127 to 127 and a scale for each row: products of copies are exact, whatever the order."""
    scale = np.abs(x).max(axis=1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def _products(q: np.ndarray, scale: np.ndarray, p: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Scores of all rows of q against all of p."""
    kind = np.float32 if q.shape[-1] <= 1000 else np.float64
    return (q.astype(kind) @ p.astype(kind).swapaxes(-1, -2)).astype(np.float64) * (scale[..., :, None] * other[..., None, :])


def _prime_from(n: int) -> int:
    """A prime of at least n, so that ids in steps spread over so many parts."""
    n = max(3, n) | 1
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


_NODE = "part int, id long, q binary, scale double"
_GRAPH = f"{_NODE}, nbrs array<long>, scores array<double>, changed int"
_FLAT = "part int, owner array<long>, other array<long>, score array<double>"
_SEATS = "block int, id array<long>, q binary, scale array<double>, worst array<double>, seat array<int>, node array<long>, named array<boolean>"


def _dealt(owner: np.ndarray, other: np.ndarray, score: np.ndarray, parts: int) -> pa.RecordBatch:
    """Flat proposals, a row for each part that any of them is for."""
    part = owner % parts
    order = np.argsort(part, kind="stable")
    found, counts = np.unique(part, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), _lists(counts, owner[order].astype(np.int64)), _lists(counts, other[order].astype(np.int64)), _lists(counts, score[order].astype(np.float64))], ["part", "owner", "other", "score"])


def _gathered(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(n).chunks] or [np.zeros(0)]) for n in names]


def _copies(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(rows, -1) if rows else np.zeros((0, 1), np.int8)


def coded_nodes(nodes: DataFrame, parts: int) -> DataFrame:
    """(part, id, q, scale, code_0, ...): the small copy of each vector and its hyperplane codes."""
    names = ["part", "id", "q", "scale", *[f"code_{i}" for i in range(ORDERS)]]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), np.float64)
            q, scale = small_copies(x)
            codes = []
            for seed in range(ORDERS):
                planes = np.random.default_rng(seed + 1).normal(size=(x.shape[1], 24))
                codes.append(pa.array(((q @ planes > 0) * (1 << np.arange(24)[::-1])).sum(axis=1).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array((ids % parts).astype(np.int32)), pa.array(ids), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), *codes], names)

    return nodes.select("id", "v").mapInArrow(coded, _NODE + "".join(f", code_{i} long" for i in range(ORDERS)))


def first_edges(coded: DataFrame, degree: int, parts: int, count: int) -> DataFrame:
    """Flat proposals: neighbours within runs of the orders of codes, and the nearest of a few pivots.

    No group is gathered whole, and whatever the partitions hold, the pivots tie each node in.
    """
    few = coded.select("id", "q", "scale").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).toArrow()
    pivots, pivot_q, pivot_scale = few.column("id").to_numpy(), _copies(few.column("q"), few.num_rows), few.column("scale").to_numpy()

    def top(ids: np.ndarray, others: np.ndarray, g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g = np.where(ids[:, None] == others, -np.inf, g)
        k = min(k, len(others))
        best = np.argpartition(-g, k - 1, axis=1)[:, :k]
        owner, other, score = np.repeat(ids, k), others[best.ravel()], np.take_along_axis(g, best, 1).ravel()
        real = owner != other
        return owner[real], other[real], score[real]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, RUN):
                run = batch.slice(max(0, min(at, batch.num_rows - RUN)), RUN)
                ids, q, scale = run.column(0).to_numpy(), _copies(run.column(1), run.num_rows), run.column(2).to_numpy()
                found.append(top(ids, ids, _products(q, scale, q, scale), degree))
                found.append(top(ids, pivots, _products(q, scale, pivot_q, pivot_scale), degree // 4))
            if found:
                yield _dealt(*best_of(*(np.concatenate(c) for c in zip(*found, strict=True)), degree), parts)

    edges = None
    for i in range(ORDERS):
        order = coded.repartitionByRange(max(1, count // PART), f"code_{i}", F.xxhash64("id")).sortWithinPartitions(f"code_{i}", F.xxhash64("id"))
        own = order.select("id", "q", "scale").mapInArrow(scored, _FLAT)
        edges = own if edges is None else edges.union(own)
    return edges


def merged_graph(graph: DataFrame, proposals: DataFrame, degree: int) -> DataFrame:
    """The graph with the best of each node's list and what is proposed to it; `changed` counts the new neighbours."""

    def merge(nodes: pa.Table, flat: pa.Table) -> pa.Table:
        ids = nodes.column("id").to_numpy()
        counts = np.concatenate([np.zeros(0, np.int64), *[c.value_lengths().to_numpy() for c in nodes.column("nbrs").chunks]]).astype(np.int64)
        had, had_score = _gathered(nodes, "nbrs", "scores")
        had_owner, had = np.repeat(ids, counts), had.astype(np.int64)
        owner, other, score = _gathered(flat, "owner", "other", "score")
        owner, other, score = best_of(np.concatenate([had_owner, owner.astype(np.int64)]), np.concatenate([had, other.astype(np.int64)]), np.concatenate([had_score.astype(np.float64), score.astype(np.float64)]), degree)
        pair = np.dtype([("a", "i8"), ("b", "i8")])
        keys = lambda a, b: np.rec.fromarrays([a, b], dtype=pair)
        new = ~np.isin(keys(owner, other), keys(had_owner, had))
        by = np.argsort(ids, kind="stable")
        at = np.searchsorted(owner, ids[by])
        held = np.searchsorted(owner, ids[by], side="right") - at
        changed = np.add.reduceat(np.append(new, False).astype(np.int64), np.minimum(at, len(new))) * (held > 0) if len(ids) else held
        rows = nodes.take(pa.array(by))
        return pa.Table.from_arrays([rows.column("part"), rows.column("id"), rows.column("q"), rows.column("scale"), _lists(held, other), _lists(held, score), pa.array(changed.astype(np.int32))], ["part", "id", "q", "scale", "nbrs", "scores", "changed"])

    return graph.groupBy("part").cogroup(proposals.groupBy("part")).applyInArrow(merge, _GRAPH)


def seats(graph: DataFrame, degree: int, parts: int, blocks: int) -> DataFrame:
    """Each node in the blocks of all nodes that it is a member of: neighbours of theirs, or naming them."""

    def reversed_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            owner, other = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            if len(owner):
                yield _dealt(other, owner, np.zeros(len(owner)), parts).select(["part", "owner", "other"])

    def seat(nodes: pa.Table, named: pa.Table) -> pa.Table:
        n = nodes.num_rows
        ids, scale = nodes.column("id").to_numpy(), nodes.column("scale").to_numpy()
        q = _copies(nodes.column("q"), n)
        counts = np.concatenate([np.zeros(0, np.int64), *[c.value_lengths().to_numpy() for c in nodes.column("nbrs").chunks]]).astype(np.int64)
        nbrs, scores = _gathered(nodes, "nbrs", "scores")
        ends = np.cumsum(counts)
        # Lists are best first.
        worst = np.where(counts >= degree, np.append(scores, 0.0)[np.maximum(ends - 1, 0)], -np.inf) if n else np.zeros(0)
        by = np.argsort(ids, kind="stable")
        owner, other = (x.astype(np.int64) for x in _gathered(named, "owner", "other"))
        row = np.concatenate([by[np.minimum(np.searchsorted(ids[by], owner), max(n - 1, 0))] if n else np.zeros(0, np.int64), np.repeat(np.arange(n), counts), np.arange(n)])
        node = np.concatenate([other, nbrs.astype(np.int64), ids])
        is_named = np.concatenate([np.zeros(len(other), bool), np.ones(len(nbrs), bool), np.zeros(n, bool)])
        block = node % blocks
        order = np.lexsort((row, block))
        row, node, block, is_named = row[order], node[order], block[order], is_named[order]
        fresh = np.append(True, (block[1:] != block[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(row) else np.zeros(0, np.int64)
        seat_no = np.cumsum(fresh) - 1
        seat_no = seat_no - np.repeat(seat_no[cuts], np.diff(np.append(cuts, len(row))))
        held = np.add.reduceat(fresh.astype(np.int64), cuts) if len(cuts) else np.zeros(0, np.int64)
        who, each = row[fresh], np.diff(np.append(cuts, len(row)))
        at = np.concatenate([[0], np.cumsum(held)])
        blobs = pa.array([q[who[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
        return pa.Table.from_arrays([pa.array(block[cuts].astype(np.int32)), _lists(held, ids[who]), blobs, _lists(held, scale[who]), _lists(held, worst[who]), _lists(each, seat_no.astype(np.int32)), _lists(each, node), _lists(each, is_named)], [f.split()[0] for f in _SEATS.split(", ")])

    named = graph.select("id", "nbrs").mapInArrow(reversed_edges, "part int, owner array<long>, other array<long>")
    return graph.groupBy("part").cogroup(named.groupBy("part")).applyInArrow(seat, _SEATS)


def descent_round(graph: DataFrame, degree: int, parts: int, blocks: int) -> DataFrame:
    """Flat proposals from the local joins of all nodes: a block gives a row for each part, not for each node."""

    def local_joins(block: pa.Table) -> pa.Table:
        ids, scale, worst = _gathered(block, "id", "scale", "worst")
        q = _copies(block.column("q"), len(ids))
        held = np.concatenate([c.value_lengths().to_numpy() for c in block.column("id").chunks])
        each = np.concatenate([c.value_lengths().to_numpy() for c in block.column("seat").chunks])
        seat_no, node, is_named = _gathered(block, "seat", "node", "named")
        seat_no = seat_no + np.repeat(np.cumsum(held) - held, each)
        # Members in a fixed order: the node and its neighbours first, then those that name it, by hash.
        turn = (node * np.int64(0x2545F4914F6CDD1D)) ^ (ids[seat_no] * np.int64(0x61C8864680B583EB))
        order = np.lexsort((turn, is_named, node))
        seat_no, node = seat_no[order], node[order]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.minimum(np.diff(np.append(starts, len(node))), 2 * degree)
        by_size = np.argsort(size, kind="stable")
        owner, other, score, waiting, kept = [], [], [], 0, None
        for at in range(0, len(by_size), 64):
            some = by_size[at : at + 64]
            m = int(size[some].max())
            if m < 2:
                continue
            slot = np.arange(m)
            real = slot < size[some][:, None]
            member = seat_no[np.minimum(starts[some][:, None] + slot, len(seat_no) - 1)]
            g = _products(q[member], scale[member], q[member], scale[member])
            other_ids = ids[member]
            g[~(real[:, :, None] & real[:, None, :]) | (other_ids[:, :, None] == other_ids[:, None, :])] = -np.inf
            k = min(OFFERS, m - 1)
            best = np.argpartition(-g, k - 1, axis=2)[:, :, :k]
            value = np.take_along_axis(g, best, 2)
            b, i, j = np.nonzero(value > np.maximum(worst[member], -np.finfo(np.float64).max)[:, :, None])
            owner.append(other_ids[b, i]), other.append(other_ids[b, best[b, i, j]]), score.append(value[b, i, j])
            waiting += len(b)
            if waiting > 2_000_000:
                kept = best_of(*(np.concatenate(c) for c in (owner, other, score)), degree)
                owner, other, score = ([c] for c in kept)
                waiting = 0
        if owner:
            kept = best_of(*(np.concatenate(c) for c in (owner, other, score)), degree)
        if not kept:
            kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.Table.from_batches([_dealt(*kept, parts)])

    return seats(graph, degree, parts, blocks).groupBy("block").applyInArrow(local_joins, _FLAT)


def neighbour_graph(nodes: DataFrame, degree: int = DEGREE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Staged (id, nbrs, scores, ...): about the `degree` best neighbours of each node (id, v), best first."""
    count = nodes.count()
    parts, blocks = _prime_from(-(-count // PART)), max(1, -(-count // BLOCK))
    coded = staged(coded_nodes(nodes, parts), "nn-coded")
    bare = coded.select("part", "id", "q", "scale", F.array().cast("array<bigint>").alias("nbrs"), F.array().cast("array<double>").alias("scores"), F.lit(0).alias("changed"))
    if not count:
        return bare
    graph = staged(merged_graph(bare, first_edges(coded, degree, parts, count), degree), "nn-graph")
    discard(coded)
    for _ in range(max_rounds):
        following = staged(merged_graph(graph, descent_round(graph, degree, parts, blocks), degree), "nn-graph")
        changed = following.agg(F.sum("changed")).first()[0] or 0
        discard(graph)
        graph = following
        if changed <= SETTLED * count * degree:
            return graph
    raise RuntimeError(f"the graph still changes after {max_rounds} rounds: raise max_rounds")


def _score_candidates(wanted: DataFrame, queries: DataFrame, vectors: DataFrame, pool: int, per_block: int) -> DataFrame:
    """Exact scores of wanted (q, u), best `pool` per query: (id, nbrs, scores array<double>)."""
    blocked = wanted.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(per_block)).cast("int"))
    seats = blocked.groupBy("block", "u").agg(F.collect_list("q").alias("asked")).join(vectors.select(F.col("id").alias("u"), F.col("v").alias("x")), "u")
    asking = queries.select(F.pmod(F.xxhash64("id"), F.lit(per_block)).cast("int").alias("block"), "id", "v")

    def score(seats: pa.Table, asking: pa.Table) -> pa.Table:
        empty = pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float64()))], ["id", "nbrs", "scores"])
        if not seats.num_rows or not asking.num_rows:
            return empty
        ids, x = seats.column("u").to_numpy(), _matrix(seats.column("x"), np.float64)
        lists = seats.column("asked").combine_chunks()
        seat = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        q = lists.flatten().to_numpy()
        names, y = asking.column("id").to_numpy(), _matrix(asking.column("v"), np.float64)
        by = np.argsort(names)
        row = by[np.searchsorted(names[by], q)]
        value = np.empty(len(q))
        for a in range(0, len(q), 50_000):
            value[a : a + 50_000] = (x[seat[a : a + 50_000]] * y[row[a : a + 50_000]]).sum(axis=1)
        owner, other, value = best_of(q, ids[seat], value, pool)
        found, counts = np.unique(owner, return_counts=True)
        return pa.Table.from_arrays([pa.array(found, pa.int64()), _lists(counts, other.astype(np.int64)), _lists(counts, value)], ["id", "nbrs", "scores"])

    return seats.groupBy("block").cogroup(asking.groupBy("block")).applyInArrow(score, "id long, nbrs array<long>, scores array<double>")


def graph_search(graph: DataFrame, vectors: DataFrame, asked: DataFrame, k: int = 20, pool: int = POOL, expand: int = EXPAND, max_steps: int = MAX_STEPS) -> DataFrame:
    """Staged (id, nbrs, scores): the best nodes found for each node (id) in `asked`, itself among them, best first."""
    queries = staged(vectors.join(asked, "id", "left_semi"), "nn-queries")
    n = queries.count()
    per_block = max(1, -(-n // 512))
    own = queries.select(F.col("id").alias("q"), F.col("id").alias("u"))
    wanted = graph.join(asked, "id", "left_semi").select(F.col("id").alias("q"), F.explode("nbrs").alias("u")).union(own)
    pools = staged(_score_candidates(wanted, queries, vectors, pool, per_block), "nn-pool")
    expanded = None
    for _ in range(max_steps):
        front = pools.select(F.col("id").alias("q"), F.posexplode("nbrs").alias("at", "u"))
        if expanded is not None:
            front = front.join(expanded, ["q", "u"], "left_anti")
        best = front.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "u"))), 1, expand).alias("open"))
        taken = staged(best.select("q", F.explode("open.u").alias("u")), "nn-front")
        reached = taken.join(graph.select(F.col("id").alias("u"), "nbrs"), "u").select("q", F.explode("nbrs").alias("u")).distinct()
        seen = pools.select(F.col("id").alias("q"), F.explode("nbrs").alias("u"))
        fresh = _score_candidates(reached.join(seen, ["q", "u"], "left_anti"), queries, vectors, pool, per_block)
        was = pools.select("id", F.slice("nbrs", 1, k).alias("was"), F.lit(0).alias("moved"), F.arrays_zip("nbrs", "scores").alias("z"))
        more = fresh.select("id", F.lit(None).cast("array<bigint>").alias("was"), F.lit(0).alias("moved"), F.arrays_zip("nbrs", "scores").alias("z"))
        both = was.union(more).groupBy("id").agg(F.max("was").alias("was"), F.flatten(F.collect_list("z")).alias("z"))
        ordered = F.slice(F.array_sort(F.transform("z", lambda e: F.struct((-e["scores"]).alias("s"), e["nbrs"].alias("u")))), 1, pool)
        found = both.select("id", "was", F.transform(ordered, lambda e: e["u"]).alias("nbrs"), F.transform(ordered, lambda e: -e["s"]).alias("scores"))
        following = staged(found.select("id", "nbrs", "scores", (F.slice("nbrs", 1, k) != F.col("was")).cast("int").alias("moved")), "nn-pool")
        moved = following.agg(F.sum("moved")).first()[0] or 0
        discard(pools)
        pools, expanded = following.drop("moved"), taken if expanded is None else expanded.union(taken)
        pools._staged_at = following._staged_at
        if moved <= STEADY * n:
            return pools
    raise RuntimeError(f"the search still moves after {max_steps} steps: raise max_steps")


def nearest(table: DataFrame, k: int = 20, query_modulus: int = 20) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the `k` nearest of each vector whose id is divisible by `query_modulus`."""
    rows = staged(usable_vectors(table).withColumn("node", F.xxhash64("v")), "nn-rows")
    nodes = staged(rows.groupBy(F.col("node").alias("id")).agg(F.min("v").alias("v")), "nn-vectors")
    of_query = rows.filter(F.pmod("id", F.lit(query_modulus)) == 0).select("id", "node")
    asked = of_query.select(F.col("node").alias("id")).distinct()
    graph = neighbour_graph(nodes)
    pools = graph_search(graph, nodes, asked, k)
    # The k + 1 smallest ids of a node are all that a result can need of it, own row included.
    first = rows.select("node", "id", F.row_number().over(Window.partitionBy("node").orderBy("id")).alias("at")).filter(F.col("at") <= k + 1).select("node", "id")
    hits = pools.select(F.col("id").alias("q"), F.explode(F.slice(F.arrays_zip("nbrs", "scores"), 1, k + 1)).alias("hit")).select("q", F.col("hit.nbrs").alias("node"), F.col("hit.scores").alias("score"))
    entry = F.struct((-F.col("score")).alias("s"), "id", "node", "score")
    lists = hits.join(first, "node").groupBy("q").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("found"))
    answers = of_query.join(lists.withColumnRenamed("q", "node"), "node")
    own = F.array_position(F.transform("found", lambda e: F.struct(e["id"], e["node"])), F.struct("id", "node"))
    others = F.filter("found", lambda e, i: i + 1 != F.col("own"))
    out = answers.withColumn("own", own).select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
