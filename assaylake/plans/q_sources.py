"""Registered source / sink queries (S1-S9, S11). Each writes a table Spark
derives from the driver data into the shared checkpoint folder in the
reference's file format, then scans it back with an explicit schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import to_ic50
from ..operators import splits as SP
from ..session import scratch_path
from ..sources import io as IO
from ..sources import tables as S
from .common import r, rounded
from .registry import query, with_ctes
from . import q_splits as QS
from .q_metrics import FOLD_RESULTS_SQL

MOL = {"molecules": S.MOLECULES_SQL}


@query("scan_assay_csv", with_ctes(f"SELECT smiles, {r('pic50')} AS pic50 FROM molecules", **MOL))
def q_scan_assay_csv(spark, sf):
    path = scratch_path(spark, "assay_csv")
    S.molecules(spark, sf).select("mol_id", "smiles", "pic50").write.option("header", True).csv(path)
    df = IO.scan_csv(spark, path, "idx LONG, smiles STRING, pic50 DOUBLE", drop_first=True)
    return rounded(df)


@query("scan_unlabelled", with_ctes("""
SELECT 'T' || CAST(mol_id AS VARCHAR) AS ID, smiles AS Smiles, 0.0 AS label FROM molecules""", **MOL))
def q_scan_unlabelled(spark, sf):
    path = scratch_path(spark, "test_csv")
    S.molecules(spark, sf).select(F.concat(F.lit("T"), F.col("mol_id").cast("string")).alias("ID"),
                                  F.col("smiles").alias("Smiles")).write.option("header", True).csv(path)
    return IO.with_constant_label(IO.scan_csv(spark, path, "ID STRING, Smiles STRING"))


BIO_SCHEMA = ("Ambit_InchiKey STRING, Original_Entry_ID STRING, Entrez_ID LONG, Activity_Flag STRING, "
              "pXC50 DOUBLE, DB STRING, Original_Assay_ID LONG, Tax_ID LONG, Gene_Symbol STRING, "
              "Ortholog_Group LONG, InChI STRING, SMILES STRING")


@query("scan_bioactivity_tsv", with_ctes(f"""
SELECT Ambit_InchiKey, Original_Entry_ID, Entrez_ID, Activity_Flag, {r('pXC50')} AS pXC50, DB,
       CAST(Original_Assay_ID AS BIGINT) AS Original_Assay_ID, Tax_ID, Gene_Symbol, Ortholog_Group, InChI, SMILES
FROM bio""", bio=S.BIOACTIVITY_SQL))
def q_scan_bioactivity(spark, sf):
    path = scratch_path(spark, "bio_tsv")
    S.bioactivity(spark, sf).write.option("header", True).option("sep", "\t").csv(path)
    return rounded(IO.scan_csv(spark, path, BIO_SCHEMA, sep="\t"))


@query("materialize_if_absent", with_ctes(f"""
SELECT Original_Entry_ID, SMILES, {r('pXC50')} AS pXC50 FROM bio WHERE Activity_Flag = 'A'""", bio=S.BIOACTIVITY_SQL))
def q_materialize(spark, sf):
    path = scratch_path(spark, "active_cache")

    def build():
        return S.bioactivity(spark, sf).where("Activity_Flag = 'A'").select("Original_Entry_ID", "SMILES", "pXC50")
    IO.materialize_if_absent(spark, path, build)        # computes and writes
    return rounded(IO.materialize_if_absent(spark, path, build))  # second call reads the cache


@query("scan_triples", with_ctes("SELECT head, relation, tail, file FROM t", t=S.TRIPLES_SQL))
def q_scan_triples(spark, sf):
    base = scratch_path(spark, "triples")
    t = S.triples(spark, sf)
    paths = []
    for f in ("train", "valid", "test"):
        p = f"{base}/{f}"
        t.where(F.col("file") == f).select(F.concat_ws(" ", "head", "relation", "tail")).write.text(p)
        paths.append(p + "/*.txt")
    out = IO.scan_triples(spark, paths)
    # part files are named part-*; the split name is the parent folder
    return out.withColumn("file", F.regexp_extract(F.input_file_name(), r"/(train|valid|test)/[^/]*$", 1))


@query("scan_delimited_text", r"""
SELECT split_part(line, '|', 1) AS text, CAST(split_part(line, '|', 2) AS INTEGER) AS label
FROM (SELECT replace(trim(regexp_replace(d.text, '[\r\n|]+', ' ', 'g') || '|' || CAST(l.toxic AS VARCHAR)), '/', ' ') AS line
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id) t""")
def q_scan_delimited_text(spark, sf):
    path = scratch_path(spark, "text_lines")
    lab = S.table(spark, sf, "labels")
    docs = S.table(spark, sf, "documents").select("doc_id", "text")
    # whole texts, one per line: line breaks and the separator become spaces
    lines = lab.join(docs, "doc_id").select(F.concat(
        F.regexp_replace("text", r"[\r\n|]+", " "), F.lit("|"), F.col("toxic").cast("string")).alias("value"))
    lines.write.text(path)
    return IO.scan_delimited_text(spark, [path])


@query("snapshot_splits", with_ctes("""
SELECT mol_id, split FROM (SELECT mol_id, CASE WHEN rnk <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM rk) t
WHERE split = 'test'""", **MOL, rk=QS._ranked_sql("molecules", "mol_id", 42)))
def q_snapshot(spark, sf):
    path = scratch_path(spark, "snap")
    IO.snapshot(SP.random_split(S.molecules(spark, sf), "mol_id", 0.2, seed=42).select("mol_id", "split"), path)
    return IO.read_snapshot(spark, path, "split", "test").select("mol_id", "split")


@query("chunked_fold_store", with_ctes("SELECT mol_id, fold FROM kf", **MOL,
                                       rk=QS._ranked_sql("molecules", "mol_id", 41), kf=QS.KFOLD_SQL))
def q_chunked(spark, sf):
    path = scratch_path(spark, "folds")
    IO.chunked_store(SP.kfold(S.molecules(spark, sf), "mol_id", 5, seed=41).select("mol_id", "fold"), path)
    return spark.read.parquet(path).select("mol_id", F.col("fold").cast("bigint"))


@query("write_submission", with_ctes(f"""
SELECT 'T' || CAST(id AS VARCHAR) AS ID, {r('pow(10.0, 9 - pred)', 3)} AS IC50_nM FROM predictions""",
                                     predictions=S.PREDICTIONS_SQL))
def q_write_submission(spark, sf):
    path = scratch_path(spark, "submission")
    p = S.predictions(spark, sf).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("ID"),
                                        F.round(to_ic50("pred"), 3).alias("IC50_nM"))
    IO.write_submission(p, path)
    return IO.scan_csv(spark, path, "ID STRING, IC50_nM DOUBLE")


@query("append_results", with_ctes(f"""
SELECT run, metric, {r('mean')} AS mean, {r('std')} AS std FROM (
  SELECT 1 AS run, metric, avg(value) AS mean, stddev_pop(value) AS std FROM fold_results GROUP BY metric
  UNION ALL SELECT 2 AS run, metric, avg(value), stddev_pop(value) FROM fold_results GROUP BY metric) t""",
                                   predictions=S.PREDICTIONS_SQL,
                                   fold_results=FOLD_RESULTS_SQL))
def q_append_results(spark, sf):
    from ..operators.metrics import results_summary
    from .q_metrics import fold_results
    path = scratch_path(spark, "results")
    summary = results_summary(fold_results(spark, sf)).select("metric", "mean", "std")
    for run in (1, 2):
        IO.append_results(summary.withColumn("run", F.lit(run)), path)
    back = spark.read.schema("metric STRING, mean DOUBLE, std DOUBLE, run LONG").json(path)
    return rounded(back.select(F.col("run").cast("int").alias("run"), "metric", "mean", "std"))
