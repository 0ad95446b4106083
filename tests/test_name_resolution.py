"""A name that many symbols of one file bear is resolved without their pairs."""

from chronofold.operators import emission


def test_symbols_are_grouped_before_the_join(spark):
    n = 20_000  # all uses and symbols of one key: pairs would be 400 million
    symbols = spark.range(n).selectExpr("1L AS file_id", "'f' AS name", "array('a') AS owners", "id AS symbol_id").unionByName(spark.range(1).selectExpr("1L AS file_id", "'g' AS name", "array('a') AS owners", "7L AS symbol_id"))
    uses = spark.range(n).selectExpr("id AS use_id", "1L AS file_id", "IF(id = 3, 'g', 'f') AS name", "array('a') AS chain")
    out = emission.owner_chain(uses, symbols)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate [file_id")
    assert [(r["use_id"], r["symbol_id"]) for r in out.collect()] == [(3, 7)]


def test_the_same_symbol_twice_is_one(spark):
    symbols = spark.createDataFrame([(1, "f", ["a"], 5), (1, "f", ["a"], 5), (2, "f", ["a"], 6)], "file_id long, name string, owners array<string>, symbol_id long")
    uses = spark.createDataFrame([(1, 1, "f", ["a"]), (2, 2, "f", ["a"]), (2, 1, "f", ["a"])], "use_id long, file_id long, name string, chain array<string>")
    assert [(r["use_id"], r["symbol_id"]) for r in emission.owner_chain(uses, symbols).collect()] == [(1, 5)]
