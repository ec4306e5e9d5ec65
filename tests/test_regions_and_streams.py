"""Regions without a task for a layout, and the history whose state is in the stream."""

import random

from frameloom.operators import layout
from frameloom.operators.catalog import history_upsert
from frameloom.streaming.history import keyed_history, keyed_history_stream

SEGMENT = "layout_id long, kind string, pos double, lo double, hi double"


def rows_of(df):
    return sorted((r["layout_id"], r["region"], *(round(r[c], 6) for c in ("x0", "y0", "x1", "y1")), r["cells"]) for r in df.collect())


def test_region_forms_agree(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(12):
        grid = [i / rnd.choice((2, 3, 4, 7)) for i in range(12)]
        for _ in range(rnd.randrange(1, 14)):
            kind = rnd.choice("vh")
            side, other = (3, 2) if kind == "v" else (2, 3)
            lo, hi = sorted((rnd.choice([g for g in grid if g <= other]), rnd.choice([g for g in grid if g <= other])))
            rows.append((k, kind, rnd.choice([g for g in grid if g < side]), lo, hi))
    rows += [(50, "v", 1.5, 0.0, 2.0), (50, "v", 1.5, 0.0, 2.0), (51, "h", 1.0, 2.0, 1.0), (52, "v", 1.0, -4.0, 9.0)]
    df = spark.createDataFrame(rows, SEGMENT)
    want = rows_of(layout.grid_regions(df, 3, 2))
    got = rows_of(layout.spread_regions(df, 3, 2))
    assert got == want and len({r[0] for r in got}) == 15
    assert layout.spread_regions(df.limit(0), 3, 2).count() == 0


def test_one_large_layout(spark):
    """A full grid of 60 by 40 in small pieces: every cell is a region."""
    rows = [(1, "v", x * 0.05, y * 0.05, (y + 1) * 0.05) for x in range(1, 60) for y in range(40)] + [(1, "h", y * 0.05, x * 0.05, (x + 1) * 0.05) for y in range(1, 40) for x in range(60)]
    got = layout.spread_regions(spark.createDataFrame(rows, SEGMENT).repartition(4), 3, 2).collect()
    assert len(got) == 2400 and {r["cells"] for r in got} == {1} and sorted(r["region"] for r in got) == list(range(2400))


def test_state_in_the_stream_survives_restarts(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "id long, type string, dedupe_key string, content binary"
    batches = [[(1, "a", "x", b"1"), (5, "a", "x", b"5"), (3, "b", None, b"3")], [(4, "a", "x", b"4"), (6, "b", "", b"6"), (7, None, "x", b"7")], [(9, "a", "y", None), (8, "a", "x", b"8"), (8, "a", "x", b"8")]]

    def run():
        for q in keyed_history_stream(spark, source + "/*", schema, sink, state):
            q.awaitTermination()

    assert keyed_history(spark, schema, sink).count() == 0
    seen = []
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        df.write.parquet(f"{source}/{n}")
        seen += rows
        run()
        run()  # nothing new
        known = spark.createDataFrame(seen, schema)
        want = sorted(map(repr, history_upsert(known.limit(0), known).select("id", "type", "dedupe_key").distinct().collect()))
        got = keyed_history(spark, schema, sink)
        assert sorted(map(repr, got.select("id", "type", "dedupe_key").collect())) == want
    assert {r["id"]: r["sha256"] is None for r in got.collect()} == {3: False, 6: False, 7: False, 8: False, 9: True}
