"""Split sizes, disjointness, fold balance and global ranks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from assaylake.functions.hashing import hash32
from assaylake.operators import splits as SP
from assaylake.operators.ranking import placed
from assaylake.sources import tables as S

from .conftest import SF_SMALL


def test_global_rank_matches_row_number(spark):
    m = S.molecules(spark, SF_SMALL).withColumn("h", hash32("mol_id", seed=5))
    ours = placed(m, ["h", "mol_id"], rank="rank")
    ref = m.withColumn("rn", F.row_number().over(Window.orderBy("h", "mol_id")))
    bad = ours.join(ref.select("mol_id", "rn"), "mol_id").where("rank <> rn").count()
    assert bad == 0
    ours2 = placed(m, ["pic50", "mol_id"], rank="rank")
    ref2 = m.withColumn("rn", F.row_number().over(Window.orderBy("pic50", "mol_id")))
    assert ours2.join(ref2.select("mol_id", "rn"), "mol_id").where("rank <> rn").count() == 0


def test_random_and_nested_split_sizes(spark):
    m = S.molecules(spark, SF_SMALL)
    n = m.count()
    sp = SP.random_split(m, "mol_id", 0.3, seed=1)
    c = {r.split: r["count"] for r in sp.groupBy("split").count().collect()}
    assert c["test"] == -(-3 * n // 10) and c["test"] + c["train"] == n
    ns = SP.nested_split(m, "mol_id", 0.1, 0.05, seed=1)
    assert ns.count() == n and ns.select("mol_id").distinct().count() == n


def test_kfold_balance_and_stratified(spark):
    m = S.molecules(spark, SF_SMALL)
    sizes = [r["count"] for r in SP.kfold(m, "mol_id", 5).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 5
    st = SP.stratified_kfold(m.withColumn("lab", F.floor("pic50")), "mol_id", "lab", 3)
    per = st.groupBy("lab", "fold").count().groupBy("lab").agg((F.max("count") - F.min("count")).alias("d"))
    assert per.agg(F.max("d")).first()[0] <= 1


def test_batches_drop_last(spark):
    m = S.molecules(spark, SF_SMALL)
    n = m.count()
    b = SP.batches(m, "mol_id", 64, drop_last=True)
    assert b.count() == (n // 64) * 64
    assert SP.batches(m, "mol_id", 64, drop_last=False).count() == n
