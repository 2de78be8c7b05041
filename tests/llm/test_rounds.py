"""Rounds of joins: few shuffles each, and as few rounds as the sets that find links ask for."""

import random

from spanweave.llm import components, ngram_join


def test_components_shuffle_once_a_round(spark, monkeypatch):
    shuffles, real = [], components.staged

    def counted(rows, label):
        shuffles.append(rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return real(rows, label)

    monkeypatch.setattr(components, "staged", counted)
    # A chain that goes up and down, a star around its largest node, and what is ignored.
    edges = [(k, 40 - k) for k in range(20)] + [(40 - k, k + 1) for k in range(20)] + [(200, 100 + k) for k in range(50)] + [(7, 7), (None, 3), (1, 39), (39, 1)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in [*range(100, 150), 200]}
    assert sum(shuffles) <= 3


def test_components_where_hooks_are_many(spark, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_ROWS", 3)
    edges = [(k, 12 - k) for k in range(6)] + [(12 - k, k + 1) for k in range(6)]
    assert dict(components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()) == dict.fromkeys(range(13), 0)


def test_a_set_that_finds_several_links_counts_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "POSTING", 4)
    rounds, real = [], ngram_join._Linker.verify
    monkeypatch.setattr(ngram_join._Linker, "verify", lambda self, pairs: rounds.append(real(self, pairs)) or rounds[-1])
    rng = random.Random(3)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(40):
        words = list(base)
        words[rng.randrange(400)] = f"x{rng.random()}"
        texts.append(" ".join(words))
    got = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {0}
    assert rounds[0][0] > 30 and all(gained <= 1.2 * tried for tried, gained in rounds)
