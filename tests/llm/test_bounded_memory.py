"""Memory of the tasks: what is brought together at a time doesn't follow the size of a fragment or of a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from spanweave.llm import ngram_join, quality_gbt


class _Caught:
    """Stands for the blocks: keeps the function that a fragment is given to."""

    def groupBy(self, *_):  # noqa: N802
        return self

    def applyInArrow(self, meet, _):  # noqa: N802
        return meet


def _fragment(sets: int, size: int, of: int, own: int = 0) -> tuple[pa.Table, list[np.ndarray]]:
    """Each set: `size` shingles of `of`, and `own` that no other has."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, of).astype(np.uint64)
    held = [np.sort(np.append(rng.choice(values, size, replace=False), rng.integers(0, 1 << 63, own).astype(np.uint64))) for _ in range(sets)]
    heads = np.array([(k * 10, 400, 5, size + own) for k in range(sets)], ngram_join._HEAD)
    group = pa.table({"heads": pa.array([heads.tobytes()], pa.binary()), "shingles": pa.array([np.concatenate(held).tobytes()], pa.binary())})
    return group, held


def test_shingles_meet_in_turns(monkeypatch):
    group, held = _fragment(60, 40, 200)
    meet = ngram_join._met(_Caught(), 75)
    want = {}
    for a in range(60):
        for b in range(a + 1, 60):
            both = [x for x in np.intersect1d(held[a], held[b]) if sum(x in h for h in held) <= ngram_join.POSTING]
            if both:
                at = [5 + np.searchsorted(h, x) for x in (both[0], both[-1]) for h in (held[a], held[b])]
                want[a * 10, b * 10] = (len(both), *at)
    for shingles in (ngram_join.MEET_SHINGLES, 100):
        monkeypatch.setattr(ngram_join, "MEET_SHINGLES", shingles)
        rows = [r for r in meet(group).to_pylist() if r["a"] is not None]
        assert {(r["a"], r["b"]): (r["shared"], r["first_a"], r["first_b"], r["last_a"], r["last_b"]) for r in rows} == want and len(rows) == len(want)


def test_a_large_fragment_takes_bounded_memory():
    group, _ = _fragment(12_000, 2, 2000, own=98)
    meet = ngram_join._met(_Caught(), 75)
    tracemalloc.start()
    meet(group)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 60 * 1_200_000


def test_statistics_of_a_batch_take_bounded_memory():
    rng = np.random.default_rng(1)
    column = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 10_000, 350)) for _ in range(2000)])
    tracemalloc.start()
    quality_gbt.statistics(column)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 60_000_000
