from collections import Counter, defaultdict

from shardflow.llm import near_dedup


def test_two_nodes_that_ask_meet_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "ASK", 4)
    # Node 0 is of the largest component; node 5 asks in the first two buckets, but not in the third.
    rows = [(band, i, 0, i, i > 0) for band in (1, 2) for i in range(20)] + [(3, 5, 0, 5, False), (3, 30, 0, 30, True)]
    opened = spark.createDataFrame(rows, "band long, id long, center long, of long, asks boolean")
    dealt, _ = near_dedup._with_buckets(opened, spark.createDataFrame([(i, 10) for i in range(31)], "id long, n_shingles long"))
    tasks = defaultdict(lambda: ([], []))
    for r in dealt.collect():
        tasks[r.center, r.block, r.part][r.answers].append(r.id)
    assert len(tasks) > 3
    met = Counter(frozenset((a, b)) for asks, answers in tasks.values() for a in asks for b in answers if a != b and b not in asks)
    met += Counter({frozenset((a, b)): 1 for asks, _ in tasks.values() for a in asks for b in asks if a < b})
    assert {frozenset((a, b)) for a in range(20) for b in range(a)} | {frozenset((5, 30))} <= set(met)
    asking = range(1, 20)
    assert all(met[frozenset((a, b))] == 1 for a in asking for b in asking if a < b)
