"""Components around a hub, with adaptive execution off: no join relies on it for its rows."""

from tidemark.llm.components import connected_components


def test_a_hub_without_adaptive_execution(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        star = [(0, i) for i in range(1, 3000)] + [(2999 + i, 3000 + i) for i in range(200)] + [(9000, 9001)]
        got = {r.node: r.root for r in connected_components(spark.createDataFrame(star, "a long, b long")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {i: 0 for i in range(3200)} | {9000: 9000, 9001: 9000}
