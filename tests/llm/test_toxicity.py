"""The string kernel against a plain sum over triples, and what the machine learns."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import queries, toxicity

from ..conftest import SF_CHECK


def _plain(unit):
    """Triple -> weight, by trying every three places."""
    s, out = "\x01" + unit + "\x02", {}
    for i, j, k in itertools.combinations(range(len(s)), 3):
        if k - i < toxicity.SPAN:
            t = s[i] + s[j] + s[k]
            out[t] = out.get(t, 0) + toxicity.DECAY ** (k - i - 2)
    norm = sum(v * v for v in out.values()) ** 0.5
    return {t: v / norm for t, v in out.items()}


def test_kernel_equals_the_plain_sum():
    rng = random.Random(5)
    names = ["".join(rng.choice("abcx-") for _ in range(rng.randrange(1, 14))) for _ in range(40)] + ["", "a", "aaaaaaaaaa", "m.o.r.o.n"]
    got = toxicity.Landmarks(names[:15]).kernel(names)
    for i, j in itertools.product(range(len(names)), range(15)):
        a, b = _plain(names[i]), _plain(names[j])
        want = sum(v * b.get(t, 0) for t, v in a.items()) ** toxicity.POWER
        assert got[i, j] == pytest.approx(want, abs=1e-5)


def test_units_join_gapped_letters():
    assert toxicity.units("You  I d i o t! ('Fool') a b") == ["you", "i", "d", "o", "t", "fool", "a", "b", "idiot"]
    assert toxicity.units("b.l-a, x") == ["b.l-a", "x", "bla"]
    assert toxicity.units(None) == toxicity.units(" ") == []


def test_machine_separates_and_logistic_is_calibrated():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(2, 1, (200, 3)), rng.normal(-2, 1, (200, 3))])
    y = np.repeat([1.0, -1.0], 200)
    w, b = toxicity.support_vectors(x, y, np.ones(400))
    assert ((x @ w + b > 0) == (y > 0)).mean() > 0.98
    p = rng.random(20_000)
    z = np.log(p / (1 - p))[:, None]
    w = toxicity._logistic(z, (rng.random(20_000) < p).astype(float), np.ones(20_000))
    assert w[0] == pytest.approx(1, abs=0.1) and w[1] == pytest.approx(0, abs=0.1)


def _corpus(spark, n=600):
    rng = random.Random(11)
    syllables = ["ba", "re", "to", "lin", "mu", "sca", "ped", "or", "wi", "ne"]
    insults = ["blockhead", "numbskull", "scoundrel"]

    def text(bad):
        w = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(30)]
        return " ".join([*w[:15], *([rng.choice(insults)] if bad else []), *w[15:]])
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int"), text


def test_gaps_and_inserted_characters_are_tolerated(spark):
    docs, text = _corpus(spark)
    machine = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), F.lit(True))
    plain = text(False)
    bad = ["blockhead", "BLOCKHEAD!!", "block-head", "b.l.o.c.k.h.e.a.d", "numb*skull", "s c o u n d r e l", "scoun9drel"]
    rows = [(k, f"{plain} {u} {plain}") for k, u in enumerate(bad)] + [(100 + k, text(False)) for k in range(30)]
    rows += [(200, "block " + plain + " head"), (201, plain * 2000 + " numbskull")]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), machine).collect()}
    assert all(got[k]["score"] >= 0.5 for k in range(len(bad))), [got[k] for k in range(len(bad))]
    assert sum(got[100 + k]["score"] >= 0.5 for k in range(30)) == 0
    assert got[201]["score"] >= 0.5 and got[201]["unit"] == "numbskull" and got[200]["score"] < 0.5


def test_odd_rows_labels_and_tables(spark):
    docs, _ = _corpus(spark, 400)
    labels = docs.select("doc_id", "toxic")
    odd = labels.unionAll(spark.createDataFrame([(1, 1), (3, None), (None, 1), (7, 5)], "doc_id long, toxic int"))
    clash = docs.drop("toxic").withColumns({c: F.lit(1) for c in ("id", "y", "back", "unit", "score", "toxic")})
    machine = toxicity.fit(clash, odd, F.lit(True))
    rows = [(None, None), (1, ""), (1, ""), (2, " \n"), (3, "!!! ???"), (4, "x" * 2_000_000), (5, "\U0001f600 éé")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), machine).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] < 0.5 for r in got)
    assert toxicity.score(docs.limit(0), machine).count() == 0
    for one, share in ((labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0), (labels.limit(0), 0.5)):
        constant = toxicity.fit(docs.drop("toxic"), one, F.lit(True))
        assert {r["score"] for r in toxicity.score(docs.limit(3), constant).collect()} == {share}


def test_held_out_labels_are_predicted(spark):
    got = queries.op13_string_kernel_toxicity(spark, SF_CHECK)
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet").select("doc_id", "toxic")
    assert got.count() == spark.read.parquet(f"{SF_CHECK}/documents.parquet").count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert len(toxic) > 5 and np.mean(toxic) > 0.6 and np.mean(clean) < 0.05
