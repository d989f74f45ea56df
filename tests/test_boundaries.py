import random

import pytest

from tileforge.errors import EngineError
from tileforge.operators import boundaries, keys, ranges
from tileforge.operators.keys import Key


def frame(spark, values, schema="id long"):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


GOLDEN = [
    (range(1, 11), 4, [1, 5, 9, 10]),
    ([1, 2, 5, 8, 10, 11, 15, 20, 24, 30], 4, [1, 10, 24, 30]),
    ([42], 10, [42, 42]),
    ([1, 2, 3], 1, [1, 2, 3, 3]),
    ([1, 2, 3], 10, [1, 3]),
    (range(1, 5), 2, [1, 3, 4]),
    ([], 3, []),
]


@pytest.mark.parametrize("values, size, expected", GOLDEN)
def test_golden_boundaries(spark, values, size, expected):
    df = frame(spark, list(values))
    found = boundaries.boundaries(df, Key(("id",)).resolve(df.schema), size).orderBy("boundary_no").collect()
    assert [(r.boundary_no, r.k1) for r in found] == list(enumerate(expected))


def test_boxes_agree_with_tuple_comparison(spark):
    """Random ranges of one to three columns: a row is in the range exactly when in one box."""
    draw = random.Random(7)
    for n in (1, 2, 3):
        rows = [tuple(draw.randrange(3) for _ in range(n)) for _ in range(60)]
        key = Key(tuple("abc"[:n]), ("bigint",) * n)
        for _ in range(60):
            low, high = sorted((tuple(draw.randrange(3) for _ in range(n)), tuple(draw.randrange(3) for _ in range(n))))
            final = low == high or draw.random() < 0.5
            d = ranges.first_difference(key.kinds, list(low), list(high))
            found = ranges.boxes(list("abc"[:n]), [str(x) for x in low], [str(x) for x in high], d, final)
            assert len(found) == (1 if d in (0, n) else 2 * (n - d) + 1)
            code = [x.replace(" = ", " == ").replace("AND", "and") for x in found]
            for row in rows:
                hits = sum(bool(eval(c, dict(zip("abc", row, strict=False)))) for c in code)
                assert hits == int(low <= row < high or (final and row == high))


def test_range_is_pushed_to_the_scan(spark, tmp_path):
    spark.createDataFrame([(a, b) for a in range(9) for b in range(9)], "a long, b long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    where = ranges.condition(Key(("a", "b"), ("bigint", "bigint")), ["2", "3"], ["5", "1"], False)
    assert df.where(where).count() == sum((2, 3) <= (a, b) < (5, 1) for a in range(9) for b in range(9))
    plan = df.where(where)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "Or(" in plan


def test_bad_ranges_and_keys(spark):
    key = Key(("a",), ("bigint",))
    for start, end, final in ((["5"], ["4"], True), (["5"], ["5"], False), ([None], ["5"], True), (["x"], ["5"], True)):
        with pytest.raises(EngineError) as error:
            ranges.condition(key, start, end, final)
        assert error.value.code == "22023"
    for df, columns in ((frame(spark, [1.5], "id double"), ("id",)), (frame(spark, [(1, 2, 3, 4)], "a int, b int, c int, d int"), tuple("abcd"))):
        with pytest.raises(EngineError):
            Key(columns).resolve(df.schema)
    for values in ([1, None], [1, 1]):
        df = frame(spark, values)
        with pytest.raises(EngineError):
            keys.assert_usable(df, Key(("id",)).resolve(df.schema))


def test_packed_keys(spark):
    df = spark.createDataFrame([(3, "x")], "a int, b string")
    key = Key(("b", "a")).resolve(df.schema)
    row = df.select(*key.select()).select(keys.pack(key).alias("packed")).select("packed", keys.is_canonical().alias("ok"), keys.unpack(key.kinds).alias("values")).first()
    assert row.ok and row["values"] == ["x", "3"] and row.packed.bigint_values == [None, 3]
    broken = spark.sql(f"select cast(named_struct('a', array(1L), 'b', array('x'), 'c', array(cast(null as string)), 'd', array(cast(null as timestamp))) as {keys.PACKED_TYPE}) as packed")
    assert not broken.select(keys.is_canonical().alias("ok")).first().ok


def test_leaf_boundaries(spark):
    df = spark.createDataFrame([("b", 1), ("b", 2), ("b", 3), ("a", 7), ("a", 9)], "leaf string, id long")
    found = boundaries.leaf_boundaries(df, "leaf", Key(("id",)).resolve(df.schema), 2).orderBy("boundary_no").collect()
    assert [(r.leaf_ordinal, r.boundary_no, r.k1) for r in found] == [(1, 0, 7), (2, 1, 1), (2, 2, 3), (2, 3, 3)]
