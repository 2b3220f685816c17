"""Graph invariants, encode/decode identity and streaming = batch."""

from pyspark.sql import functions as F

from assaylake.operators import graph as G
from assaylake.operators import tokens as TK
from assaylake.plans.q_graph import mol_nodes_edges
from assaylake.sources import tables as S

from .conftest import SF_SMALL


def test_all_pairs_invariants(spark):
    nodes, edges = mol_nodes_edges(spark, SF_SMALL)
    ap = G.all_pairs(edges, nodes, key="mol_id").cache()
    assert ap.where("i = j AND dist <> 0").count() == 0
    rev = ap.select("mol_id", F.col("i").alias("j"), F.col("j").alias("i"), F.col("dist").alias("d2"))
    assert ap.join(rev, ["mol_id", "i", "j"]).where("dist <> d2").count() == 0
    # distance 1 exactly on bonds
    assert ap.where("dist = 1").count() == edges.select("mol_id", "src", "dst").distinct().count()


def test_char_encode_decode_identity(spark):
    m = S.molecules(spark, SF_SMALL)
    cs, pad = TK.charset_fit(m, "smiles")
    codes = TK.char_encode(m, "mol_id", "smiles", cs, pad)
    back = TK.char_decode(codes, "mol_id", cs)
    assert back.join(m, "mol_id").where("decoded <> smiles").count() == 0


def test_stream_buffer_equals_batch(spark):
    import __spark_entry__ as entry
    q = entry.queries()["stream_bounded_buffer"](spark, SF_SMALL)
    ev = S.table(spark, SF_SMALL, "events")
    from pyspark.sql import Window
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    batch = ev.withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "event_id")
    assert q.select("user_id", "event_id").exceptAll(batch).count() == 0
    assert batch.exceptAll(q.select("user_id", "event_id")).count() == 0
