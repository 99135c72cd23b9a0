"""$match against a plain evaluator on generated rows and conditions."""

from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st

from quarryframe.plans.pipeline import aggregate

ROWS = [(str(i), n, s, b) for i, (n, s, b) in enumerate((n, s, b) for n in (None, -1, 0, 2) for s in (None, "", "ab", "b") for b in (None, True, False))]
VALUES = st.sampled_from([None, -1, 0, 2, 1.5, "", "a", "b", True, False])
NAMES = st.sampled_from(["n", "s", "b", "zz"])


def kind(x):
    return "bool" if isinstance(x, bool) else "num" if isinstance(x, (int, float)) else "str" if isinstance(x, str) else None


def same(a, b):
    return kind(a) == kind(b) and a == b


def holds(row, name, op, value):
    a = row.get(name)
    if op in ("$eq", "$ne"):
        return same(a, value) == (op == "$eq")
    if op in ("$in", "$nin"):
        return any(same(a, v) for v in value) == (op == "$in")
    if op == "$exists":
        return (a is not None) == value
    if kind(a) != kind(value) or kind(a) not in ("num", "str"):
        return False
    return {"$gt": a > value, "$gte": a >= value, "$lt": a < value, "$lte": a <= value}[op]


def evaluate(row, spec):
    out = True
    for k, v in spec.items():
        if k == "$or":
            out &= any(evaluate(row, s) for s in v) if v else True
        elif k == "$nor":
            out &= not any(evaluate(row, s) for s in v)
        elif k == "$and":
            out &= all(evaluate(row, s) for s in v)
        else:
            out &= all(holds(row, k, op, x) for op, x in v.items()) if isinstance(v, dict) else same(row.get(k), v)
    return out


ops = st.one_of(
    st.tuples(st.sampled_from(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte"]), VALUES), st.tuples(st.sampled_from(["$in", "$nin"]), st.lists(VALUES, max_size=3)), st.tuples(st.just("$exists"), st.booleans())
).map(lambda x: {x[0]: x[1]})
simple = st.dictionaries(NAMES, ops, min_size=1, max_size=2)
specs = st.recursive(simple, lambda s: st.tuples(st.sampled_from(["$or", "$nor", "$and"]), st.lists(s, min_size=1, max_size=3)).map(lambda x: {x[0]: x[1]}), max_leaves=5)


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(specs)
@example({"n": {"$ne": True}})
def test_match(spark, spec):
    df = spark.createDataFrame(ROWS, "_id string, n int, s string, b boolean")
    got = {r[0] for r in aggregate(df, [{"$match": spec}]).select("_id").collect()}
    assert got == {i for i, n, s, b in ROWS if evaluate({"n": n, "s": s, "b": b}, spec)}
