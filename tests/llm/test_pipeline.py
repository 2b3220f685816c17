"""Every stage of the corpus pipeline on odd rows and on no rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from assaylake.llm import frames, minhash

from ..conftest import SF_SMALL

CLASH = ("id", "score", "label", "node", "spans", "n", "chunk", "length", "y", "__id", "grp")


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(900_001, None), (900_002, ""), (900_003, " \n "), (None, "The same words for a row without an id."),
            (None, "The same words for a row without an id."), (900_004, "one"), (900_005, "12345 !!"),
            (900_006, "a long text of many words " * 60_000), (900_007, "password = abcdef123"), (900_007, "password = abcdef123")]
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    both = docs.unionByName(more.select(docs.columns))
    return both.withColumns({c: F.lit("x") for c in CLASH})


def test_stages_keep_columns_and_clean_rows(spark, odd):
    docs = odd
    for name, stage in P.STAGES[:-1]:
        out = P.written(stage(spark, docs, SF_SMALL), f"test-{name}")
        assert out.columns == odd.columns, name
        assert out.where("score <> 'x' OR grp <> 'x'").count() == 0
        docs = out
        left = {r["doc_id"]: r["text"] for r in out.where("doc_id > 900000").select("doc_id", "text").collect()}
        if name == "language":
            # rejected: no text, no letter; kept: the rest, repeated rows and rows without an id too
            assert set(left) == {900_004, 900_006, 900_007} and out.where("doc_id = 900007").count() == 2
            assert out.where("doc_id IS NULL").count() == 2
        if name == "near_dedup":
            # rows with one id are one document; rows without an id are never duplicates
            assert out.where("doc_id = 900007").count() == 2 and out.where("doc_id IS NULL").count() == 2
        if name == "redact_secrets":
            assert left[900_007] == "[SECRET]"
            assert len(left[900_006]) == len("a long text of many words " * 60_000)
    pieces = P.pack(spark, docs, SF_SMALL)
    copies = docs.groupBy("doc_id").agg(F.count("*").alias("copies"))
    total = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    both = total.where("doc_id IS NOT NULL").join(copies, "doc_id")
    assert both.where("n <> t * copies").count() == 0 and both.count() == copies.where("doc_id IS NOT NULL").count()


def test_no_documents(spark, odd):
    docs = odd.limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.count() == 0


class Taken:
    """Stands for a table: holds the function that mapInArrow would run."""
    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def where(self, cond):
        return self

    drop = repartition = where


TEXTS = {"id": [1, 2], "cls": [1, 2], "text": ["a b c d e f", None]}
BLOCK = {"key": [1], "i": [0], "j": [0], "cls": [1], "label": [1], "long": [b""], "keys": [b""], "shingles": [b""]}


@pytest.mark.parametrize("step, rows", [(minhash.signatures, TEXTS), (minhash._payload, TEXTS), (minhash._across, BLOCK)])
def test_near_dedup_tasks_give_their_memory_back(monkeypatch, step, rows):
    given = []
    monkeypatch.setattr(frames, "give_back", lambda: given.append(True))
    rows = step(Taken(), 5).run(iter([pa.RecordBatch.from_pydict(rows)]))
    next(rows)
    assert not given
    list(rows)
    assert given == [True]


def test_near_dedup_sends_small_batches(spark, monkeypatch):
    """Every table of the stage that Python makes meets it in batches of at most 1000 rows."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, most = spark.conf.get(conf), {}

    def kept(df, name, *args, **kw):
        if "MapInArrow" in df._jdf.queryExecution().toString():
            seen = frames.written(spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long"), name, *args, **kw)
            most[name] = seen.agg(F.max("n")).first()[0]
        return frames.written(df, name, *args, **kw)

    monkeypatch.setattr(minhash, "written", kept)
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(8)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in minhash.keep_one(docs).collect()) == [0, 2, 4, 6]
    assert set(most) == {"minhash-signatures", "minhash-sets", "minhash-links", "minhash-more"} and max(most.values()) <= 1000
    assert spark.conf.get(conf) == before
