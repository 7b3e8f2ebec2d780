"""Checks: null rules, counts, errors, the gate, composite keys, empty tables."""

import pytest

from tablewarden.operators import quality as q


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "ann", "ann@x.org", 30), (2, None, "bob@x.org", 25), (3, "cy", "nope", 41), (4, "di", "di@x.org", None)]
    return spark.createDataFrame(rows, "id long, name string, email string, age long")


def results(df, *checks):
    return {r["check"]: r for r in q.run_suite(df, list(checks)).collect()}


def test_cells_and_rows(people):
    r = results(people, q.NotNull(name="n", columns=("name", "age")))["n"]
    assert (r["outcome"], r["failed_count"], r["failed_rows"], r["total_count"]) == ("failed", 2, 2, 4)


def test_null_rules(people):
    r = results(
        people,
        q.InRange(name="skip", column="age", low=26),
        q.InRange(name="fail", column="age", low=26, nulls="fail"),
        q.Accepted(name="a", column="name", values=("ann", "cy", "di")),
        q.Accepted(name="b", column="name", values=("ann", "cy", "di"), nulls="fail"),
        q.Matches(name="m", column="email", pattern="@"),
    )
    assert [r[k]["failed_count"] for k in ("skip", "fail", "a", "b", "m")] == [1, 2, 0, 1, 1]


def test_composite_keys_do_not_collide(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), (None, "c")], "x string, y string")
    assert results(df, q.Unique(name="u", columns=("x", "y")))["u"]["failed_count"] == 1


def test_errors_block(spark, people):
    found = q.run_suite(people, [q.NotNull(name="gone", columns=("nope",)), q.Matches(name="bad", column="email", pattern="("), q.References(name="ref", column="id")])
    assert {r["check"]: r["outcome"] for r in found.collect()} == {"gone": "error", "bad": "error", "ref": "error"}
    assert q.gate(found).first().asDict() == {"open": False, "blockers": 3}
    with pytest.raises(q.BlockingCheckError):
        q.validate(people, [q.NotNull(columns=("name",))])
    assert q.validate(people, [q.NotNull(columns=("name",), severity="warning")]) is people


def test_empty_table(spark):
    df = spark.createDataFrame([], "x int, ts timestamp_ntz")
    r = results(df, q.NotNull(name="n", columns=("x",)), q.Unique(name="u", columns=("x",)), q.RowCount(name="r", low=1), q.Freshness(name="f", column="ts", max_age_s=1, as_of="2024-01-01"))
    assert {k: v["outcome"] for k, v in r.items()} == {"n": "passed", "u": "passed", "r": "failed", "f": "failed"}
    assert r["r"]["failed_count"] == 0


def test_one_aggregation(people):
    checks = [q.NotNull(columns=("name",)), q.InRange(column="age", low=0), q.Matches(column="email", pattern="@"), q.RowCount(low=1)]
    plan = q.run_suite(people, checks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_quarantine_and_samples(people):
    marked = q.quarantine(people, [q.NotNull(name="name", columns=("name",)), q.Matches(name="email", column="email", pattern="@")])
    assert {r["id"]: r["violations"] for r in marked.collect()} == {1: [], 2: ["name"], 3: ["email"], 4: []}
    assert [r["id"] for r in q.failed_samples(people, q.InRange(column="age", high=26), ["id"], 1).collect()] == [1]


def test_decorator(people):
    @q.checked(q.NotNull(name="id", columns=("id",)))
    def asset():
        return people

    assert q.run_checks("asset", asset()).first()["outcome"] == "passed"


def test_assets_are_composed_of_their_inputs(spark):
    from tablewarden.operators.assets import Assets

    calls, assets = [], Assets()

    @assets.asset()
    def doubled(numbers):
        calls.append("doubled")
        return numbers.selectExpr("id * 2 AS id")

    @assets.asset(inputs={"a": "doubled", "b": "doubled"})
    def both(a, b):
        return a.unionByName(b)

    assert sorted(r.id for r in assets.compute("both", {"numbers": spark.range(3)}).collect()) == [0, 0, 2, 2, 4, 4] and calls == ["doubled"]
    assert {tuple(r) for r in assets.edges(spark).collect()} == {("numbers", "doubled"), ("doubled", "both")}
    with pytest.raises(KeyError):
        assets.compute("both", {})
    assets.asset("x")(lambda y: y)
    assets.asset("y")(lambda x: x)
    with pytest.raises(ValueError):
        assets.compute("x", {})


def test_samples_name_column_value_and_cause(spark):
    df = spark.createDataFrame([(1, None, "5"), (2, "call 212-555-1234", "x"), (3, "ok", "900")], "id int, note string, n string")
    got = q.failed_samples(df, q.NotNull(columns=("note", "n")), ["id"]).collect()
    assert [(r.id, r.failed_column, r.reason) for r in got] == [(1, "note", "null value")]
    got = q.failed_samples(df, q.InRange(column="n", low=1, high=100), ["id"]).collect()
    assert [(r.id, r.note, r.failed_value, r.reason) for r in got] == [(2, "call [PHONE]", "x", "not a number"), (3, "ok", "900", "above 100")]
    got = q.failed_samples(df, q.Custom(predicate="note = 'ok'"), ["id"]).collect()
    assert [(r.id, r.failed_column, r.reason) for r in got] == [(1, None, "not so: note = 'ok'"), (2, None, "not so: note = 'ok'")]
