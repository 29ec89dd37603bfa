"""Last wins with late materialisation: null keys and orders, ties."""

from pyspark.sql import functions as F

from conftest import make
from scanloom.operators import keyed


def test_nulls_and_ties(spark):
    rows = [
        (1.0, b"a", 1), (1.0, b"b", 3), (1.0, b"c", None),  # the largest order wins; a null order loses
        (None, b"d", 2), (None, b"e", 5),  # a null key is a key of its own
        (2.0, b"f", None), (2.0, b"g", None),  # only null orders: one of them
        (3.0, b"h", 4), (3.0, b"h", 4),  # a tie: one row
    ]
    df = make(spark, [(d, p, 1, 1, o) for d, p, o in rows], "depth double, image_png binary, width int, height int, o long")
    got = {r.depth: (bytes(r.image_png), r.times_seen) for r in keyed.last_wins(df, F.col("o")).collect()}
    assert got[1.0] == (b"b", 3) and got[None] == (b"e", 2) and got[3.0] == (b"h", 2)
    assert got[2.0][0] in (b"f", b"g") and got[2.0][1] == 2 and len(got) == 4
    assert keyed.last_wins(df.where("false"), F.col("o")).count() == 0
