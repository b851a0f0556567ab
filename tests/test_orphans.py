from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from citewise.operators.orphans import References, reference

T = datetime(2026, 6, 1)
CHILD = "id string, ref string, loaded_at timestamp_ntz, created_at timestamp_ntz"


def hours(n):
    return T + timedelta(hours=n)


def test_reference(spark):
    texts = ["abcdefghij1", " {ABCDEFGHIJ1}", "abcde-fghij1", "abcdefghij", "n/a", "", None, "äbcdefghij1", "abcdefghij1é"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(reference(F.col("t"))).collect()]
    assert got == ["abcdefghij1"] * 3 + [None] * 5 + ["abcdefghij1"]


def tables(spark, n_hot=0):
    child = [("c1", "aaaaaaaaaa1", hours(5), T), ("c2", "aaaaaaaaaa1", hours(1), T), ("c2", "aaaaaaaaaa1", hours(9), T), ("c3", "bbbbbbbbbb2", hours(1), T), ("c4", "cccccccccc3", hours(1), T), ("c5", "none", hours(1), T), (None, "cccccccccc3", hours(1), T), ("c6", "dddddddddd4", hours(3), None)]
    child += [(f"h{i}", "hothothoth9", hours(1), T) for i in range(n_hot)]
    a = spark.createDataFrame(child, CHILD).withColumn("key", F.lit("clash")).withColumn("period", F.lit(1))
    b = spark.createDataFrame([("c1", "cccccccccc3", hours(1), T)], CHILD)
    parents = spark.createDataFrame([("aaaaaaaaaa1", hours(3)), ("aaaaaaaaaa1", hours(2)), ("dddddddddd4", hours(3)), (None, hours(1))], "id string, loaded_at timestamp_ntz")
    gone = spark.createDataFrame([("bbbbbbbbbb2",), ("aaaaaaaaaa1",), (None,)], "audit_id string")
    return {"a": (a, "id", "ref", "own"), "b": (b, "id", "ref", "own")}, {"own": (parents, "id", gone, "audit_id")}


EXPECTED = [("a", "c2", "late"), ("a", "c3", "deleted"), ("a", "c4", "missing"), ("b", "c1", "missing")]


def test_states(spark):
    refs = References(*tables(spark))
    assert rows(refs.orphans().select("src_table", "record_id", "state")) == EXPECTED
    assert {(r["src_table"], r["state"]): (r["n"], r["n_keys"]) for r in refs.counts().collect()} == {("a", "late"): (1, 1), ("a", "deleted"): (1, 1), ("a", "missing"): (1, 1), ("b", "missing"): (1, 1)}


def test_hot_key(spark):
    refs = References(*tables(spark, 500))
    got = refs.orphans()
    assert rows(got.where("record_id not like 'h%'").select("src_table", "record_id", "state")) == EXPECTED
    assert got.where("record_id like 'h%' and state = 'missing'").count() == 500
    assert refs.keys.where("key = 'hothothoth9'").first()["n"] == 500
    assert refs.counts().where("src_table = 'a' and state = 'missing'").first()["n"] == 501


def test_key_counts_by_parent_table(spark):
    children, parents = tables(spark)
    own = parents["own"]
    other = spark.createDataFrame([("cccccccccc3", hours(0))], "id string, loaded_at timestamp_ntz")
    children["b"] = (*children["b"][:3], "other")
    got = References(children, {"own": own, "other": (other, "id", None, "")}).orphans()
    assert rows(got.select("src_table", "parent_table", "record_id", "state")) == [(t, "own", r, s) for t, r, s in EXPECTED if t == "a"]


def test_late_by_each_record(spark):
    child = spark.createDataFrame([("r1", "aaaaaaaaaa1", hours(1), T), ("r2", "aaaaaaaaaa1", hours(2), T), ("r3", "bbbbbbbbbb2", hours(1), T), ("r4", "bbbbbbbbbb2", hours(2), T), ("r5", "aaaaaaaaaa1", None, T)], CHILD)
    parents = spark.createDataFrame([("aaaaaaaaaa1", hours(2)), ("bbbbbbbbbb2", hours(9))], "id string, loaded_at timestamp_ntz")
    refs = References({"a": (child, "id", "ref", "own")}, {"own": (parents, "id", None, "")})
    assert rows(refs.orphans().select("record_id", "state")) == [("r1", "late"), ("r3", "late"), ("r4", "late")]
    assert [(r["n"], r["n_keys"]) for r in refs.counts().collect()] == [(3, 2)]


def test_empty(spark):
    children, parents = tables(spark)
    none = {n: (df.limit(0), *rest) for n, (df, *rest) in children.items()}
    df, pid, gone, did = parents["own"]
    no_parents = {"own": (df.limit(0), pid, gone.limit(0), did)}
    assert References(none, no_parents).orphans().count() == 0
    assert References(children, no_parents).orphans().where("state <> 'missing'").count() == 0
