"""Row expressions: missing stays missing."""

from pyspark.sql import functions as F

from evidrank.functions import rows as X


def first(spark, expr, ddl="a double, b double, c double", values=(None, 2.0, 4.0)):
    return spark.createDataFrame([values], ddl).select(expr.alias("r")).first()["r"]


def test_known_sum_mean_max(spark):
    cols = ["a", "b", "c"]
    assert first(spark, X.known_sum(cols)) == 6.0
    assert first(spark, X.known_mean(cols)) == 3.0
    assert first(spark, X.known_max(cols)) == 4.0
    nothing = (None, None, None)
    assert first(spark, X.known_sum(cols), values=nothing) is None
    assert first(spark, X.known_mean(cols), values=nothing) is None
    assert first(spark, X.known_max(cols), values=nothing) is None
    assert first(spark, X.known_count(cols)) == 2
    assert first(spark, X.all_known(cols)) is False
    assert first(spark, X.any_known(cols)) is True


def test_clip(spark):
    assert first(spark, X.clip("a"), values=(1.5, 0.0, 0.0)) == 1.0
    assert first(spark, X.clip("a"), values=(-1.0, 0.0, 0.0)) == 0.0
    assert first(spark, X.clip("a")) is None


def test_ladder_takes_the_first_match(spark):
    expr = X.ladder([(F.col("b") > 1, "low"), (F.col("b") > 0, "any")], "none")
    assert first(spark, expr) == "low"
    assert first(spark, expr, values=(None, None, None)) == "none"


def test_lookup(spark):
    expr = X.lookup("s", {"x": 1.0})
    assert first(spark, expr, "s string", ("x",)) == 1.0
    assert first(spark, expr, "s string", ("y",)) is None
    assert first(spark, X.lookup("s", {"x": 1.0}, 0.0), "s string", (None,)) == 0.0


def test_contains_and_mentions(spark):
    assert first(spark, X.contains_any("s", ["CILI"]), "s string", ("Basal cilium",)) is True
    assert first(spark, X.contains_any("s", ["cili"]), "s string", (None,)) is None
    for text, hit in [
        ("the hair cell.", True),
        ("hair-cell", False),
        ("xhair cell", False),
        ("hair cells", False),
        ("HAIR CELL", True),
        ("hair cells and a hair cell", True),
        ("éhair cellé", True),
    ]:
        assert first(spark, X.mentions_any("s", ["hair cell"]), "s string", (text,)) is hit, text
    assert first(spark, X.mentions_any("s", ["c++ (x)"]), "s string", ("uses c++ (x) now",)) is True


def test_array_match_is_three_valued(spark):
    expr = X.any_element_contains("s", ["PDZ"])
    ddl = "s array<string>"
    assert first(spark, expr, ddl, (["a", "pdz domain"],)) is True
    assert first(spark, expr, ddl, (["a", None],)) is False
    assert first(spark, expr, ddl, ([],)) is None
    assert first(spark, expr, ddl, (None,)) is None


def test_join_known_and_names(spark):
    parts = X.join_known(["a", "b", "c"], ";")
    ddl = "a string, b string, c string"
    assert first(spark, parts, ddl, ("x", "", " y ")) == "x;y"
    assert first(spark, parts, ddl, ("", None, " ")) is None
    names = {"one": "a", "two": "b"}
    assert first(spark, X.present_names(names), ddl, (None, None, None)) == ""
    assert first(spark, X.present_names(names), ddl, ("v", None, None)) == "one"
    assert first(spark, X.absent_names(names), ddl, ("v", None, None)) == "two"


def test_lists_and_versions(spark):
    assert first(spark, X.list_length("s"), "s string", ("a,b,c",)) == 3
    assert first(spark, X.list_length("s"), "s string", (None,)) is None
    assert first(spark, X.strip_version("s"), "s string", ("ENSG01.12",)) == "ENSG01"
    both = "a array<string>, b array<string>"
    assert first(spark, X.union_distinct("a", "b"), both, (["x", "x"], ["y", "x"])) == ["x", "y"]
    assert first(spark, X.union_distinct("a", "b"), both, (["x", "x"], [])) == ["x", "x"]
    assert first(spark, X.union_distinct("a", "b"), both, (["x"], None)) == ["x"]


def test_membership_sketch_never_misses(spark):
    words = spark.createDataFrame([(f"w{k}",) for k in range(0, 4000, 2)] + [(None,)], "w string")
    known = X.membership_sketch(words, "w")
    asked = spark.createDataFrame([(f"w{k}",) for k in range(4000)], "w string")
    kept = {r["w"] for r in asked.where(X.may_hold(known, F.col("w"))).collect()}
    assert {f"w{k}" for k in range(0, 4000, 2)} <= kept and len(kept) < 2100
    assert asked.where(X.may_hold(X.membership_sketch(words.limit(0), "w"), F.col("w"))).count() == 0
