"""Lists are gathered only after their rows were made few."""

from lorevane import catalogue
from lorevane.operators import grids as G
from lorevane.operators import retrieval as R

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_sources_are_made_distinct_before_they_are_gathered(spark):
    rows = [("q", 5, "b"), ("q", 1, "a"), ("q", 2, "b"), ("q", 3, "a"), ("q", 2, "aa"), ("r", None, "z"), ("r", 1, "z"), ("r", 0, "y")]
    nodes = spark.createDataFrame(rows, "k string, rank int, f string").selectExpr("k", "rank", "map('file_name', f) AS metadata")
    made = R.ordered_sources(nodes, "k")
    assert {r.k: r.sources for r in made.collect()} == {"q": ["a", "aa", "b"], "r": ["z", "y"]}
    assert plan(made).count("Aggregate [") == 2


def test_chunks_of_a_large_key_are_numbered_in_slices(spark):
    rows = [(0 if i % 3 else i, i * i, f"t{i}") for i in range(500)] + [(None, 7, "x"), (None, 3, None)]
    items = spark.createDataFrame(rows, "u long, i long, t string")
    want = {}
    for u, _, t in sorted(rows, key=lambda r: r[1]):
        want.setdefault(u, []).append(t)
    got = {(r.u, r.n): r.chunk for r in G.list_chunks(items, "u", "i", "t").collect()}
    assert got == {(u, k // 3): x[k : k + 3] for u, x in want.items() for k in range(0, len(x), 3)}
    assert G.list_chunks(items.where("false"), "u", "i", "t").collect() == []
    gathering = next(x for x in plan(catalogue.chunk3(spark, SF)).splitlines() if "collect_list" in x)
    assert gathering.split("Aggregate [")[1].split("]")[0].count("#") == 2  # by user and number of the chunk
