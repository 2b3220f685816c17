"""Toxicity scores from a subsequence string kernel with Nyström landmarks.

A text is a bag of units: its lower-cased words (runs of anything but white
space, without punctuation at their ends, and once more without any inside), and every row of three or more single characters as one unit, so that an
insult spelt with gaps is one again. The kernel of two units counts the letter
triples they share in order, not only next to each other: a triple that spans
``2 + g`` places weighs ``DECAY ** g``, up to ``SPAN`` places, with marks for the
unit's two ends. Inserted characters therefore cost some weight and not the match.
Each unit is scaled to length one, and the kernel is the cube of what is left, so
that likeness by chance stays low.

Landmarks are units that the labelled texts set apart (by the G2 statistic, none
too close to another) and the most common clean ones. Units are mapped to the
landmarks' space (kernel values times the inverse root of the landmarks' own
kernel matrix), where a linear support vector machine with squared hinge loss is
fitted by Newton steps. Labels belong to whole texts: a clean text's units are all
negative, a toxic text has a positive unit, its witness, chosen anew by each
round's machine; further passes add the clean units that score highest, also as
landmarks. Positives and negatives are also learned with inserted characters.

A text's highest margins go through a logistic curve, fitted on texts held back
from the machine and weighted to the labels' true shares. For scoring, map and machine are one weight a landmark.

Landmarks and machine are learned from about ``TRAIN_ROWS`` labelled texts a label
(those whose id's hash is under a bound): a documented bound for fitting only.

Cases: null and empty texts have no unit and get the score of a unit without any
triple; a long unit is taken in overlapping pieces, a long text whole; labels that
are null or contradict each other are not learned from; with one label only (or
none) every score is that label's share (0.5 without labels), and so it is when
no unit sets the labels apart; repeated rows keep their own result, as do rows
without an id; extra columns are ignored; an empty table gives an empty result.
Ties between landmarks go to the smaller unit, between units to the first one.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from heapq import nlargest, nsmallest
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import drop_written, written

SPAN = 5
DECAY = 0.6
#: the kernel is this power of the shared triples' share, which keeps chance likeness low
POWER = 3
#: longest piece of a unit, and how far pieces are apart
PIECE, STEP = 48, 32
TOXIC_LANDMARKS, CLEAN_LANDMARKS, HARD_LANDMARKS = 64, 32, 48
#: candidates for landmarks, per kind
CANDIDATES = 600
#: a kernel value that two landmarks do not reach
APART = 0.35
TRAIN_ROWS = 4000
#: units a training text sends to the machine
WITNESSES = 24
#: passes over the training texts, and rounds of the machine in each
PASSES, ROUNDS = 3, 3
#: highest units of a text that its probability is made of
WORST = 3
#: scores of units that a task remembers
MEMO = 200_000

_MARKS = re.compile(r"[\W_]+")
#: rows of single characters, each with a mark after it or not
_GAPPED = re.compile(r"(?<!\S)\S[^\w\s]?(?!\S)(?:\s+\S[^\w\s]?(?!\S)){2,}")
#: marks that do not count at a word's ends
_EDGE = string.punctuation + "\u00a1\u00bf\u00ab\u00bb\u2018\u2019\u201c\u201d\u2026\u2013\u2014"
#: places of the second and third letter from the first
_TRIPLES = list(combinations(range(1, SPAN), 2))
_WEIGHTS = DECAY ** np.arange(8.0)


def units(text: str | None) -> list[str]:
    """The distinct units of a text, in order of first occurrence."""
    text = (text or "").lower()
    found = dict.fromkeys(w.strip(_EDGE) or w for w in text.split())
    for w in [w for w in found if not w.isalnum()]:
        found[_MARKS.sub("", w) or w] = None
    for m in _GAPPED.finditer(text):
        found["".join(w.strip(_EDGE) or w for w in m.group().split())] = None
    return list(found)


def _pieces(unit: str) -> list[str]:
    return [unit] if len(unit) <= PIECE else [unit[i:i + PIECE] for i in range(0, len(unit) - PIECE + STEP, STEP)]


def triples(parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, triple, weight) of the ordered letter triples of units, sorted;
    the weights of a unit have length one."""
    text = "".join(f"\x01{u}\x02" for u in parts)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    # 7 bits a letter: ASCII as it is, others share the places of unused control characters
    code = np.where(code < 128, code, 3 + code % 29)
    own = np.repeat(np.arange(len(parts)), [len(u) + 2 for u in parts])
    found = [np.zeros(0, np.int64)]
    for a, b in _TRIPLES:
        at = np.flatnonzero(own[b:] == own[:-b]) if len(own) > b else np.zeros(0, np.int64)
        # one number to sort by: unit, three letters, places that the triple skips
        found.append(own[at] << 24 | code[at] << 17 | code[at + a] << 10 | code[at + b] << 3 | b - 2)
    flat = np.sort(np.concatenate(found))
    if not len(flat):
        return flat, flat, np.zeros(0, np.float32)
    first = np.flatnonzero(np.concatenate(([True], flat[1:] >> 3 != flat[:-1] >> 3)))
    weight = np.add.reduceat(_WEIGHTS[flat & 7], first)
    who = flat[first] >> 24
    norm = np.sqrt(np.bincount(who, weight * weight, len(parts)))
    return who, flat[first] >> 3 & (1 << 21) - 1, weight / norm[who]


class Landmarks:
    """Kernel values against fixed units, from the triples these have."""

    def __init__(self, marks: Sequence[str]):
        who, key, self.weight = triples(marks)
        order = np.argsort(key, kind="stable")
        self.n, self.mark, self.weight = len(marks), who[order], self.weight[order]
        self.known, self.first, self.size = np.unique(key[order], return_index=True, return_counts=True)
        self.place = np.full(1 << 21, -1, np.int32)
        self.place[self.known] = np.arange(len(self.known))

    def kernel(self, parts: Sequence[str]) -> np.ndarray:
        """Kernel values of units (rows) and landmarks (columns)."""
        out = np.zeros((len(parts), self.n), np.float32)
        for i in range(0, len(parts), 4096):
            some = parts[i:i + 4096]
            who, key, weight = triples(some)
            at = self.place[key]
            hit = np.flatnonzero(at >= 0)
            at = at[hit]
            # a triple meets each landmark that has it
            size = self.size[at]
            meet = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            cell = np.repeat(who[hit], size) * self.n + self.mark[meet]
            total = np.bincount(cell, np.repeat(weight[hit], size) * self.weight[meet], len(some) * self.n)
            out[i:i + len(some)] = total.reshape(len(some), self.n) ** POWER
        return out


@dataclass
class Machine:
    """Landmarks, a weight for each kernel value, a bias, and the logistic curve
    (a weight for each of the highest margins of a text, and a constant)."""
    marks: list[str]
    weights: np.ndarray
    bias: float
    curve: np.ndarray | None = None
    constant: float | None = None

    def prob(self, worst: np.ndarray) -> np.ndarray:
        """Probabilities of texts from their ``WORST`` highest margins (rows)."""
        if self.constant is not None:
            return np.full(len(worst), self.constant)
        return 1 / (1 + np.exp(-np.clip(worst @ self.curve[:-1] + self.curve[-1], -60, 60)))

    def highest(self, values: Iterable[float]) -> list[float]:
        """The ``WORST`` highest margins, filled up with that of a unit without triples."""
        got = nlargest(WORST, values)
        return got + [self.bias] * (WORST - len(got))


def margins(found: Sequence[str], machine: Machine, marks: Landmarks) -> np.ndarray:
    """Margins of units; the worst piece counts."""
    pieces = [_pieces(u) for u in found]
    flat = [p for ps in pieces for p in ps]
    if not flat:
        return np.zeros(0)
    out = marks.kernel(flat) @ machine.weights + machine.bias
    return np.maximum.reduceat(out, np.concatenate(([0], np.cumsum([len(p) for p in pieces])[:-1])))


class Scores:
    """Margins of units, remembered up to ``MEMO`` of them. Lives as long as its
    task's iterator."""

    def __init__(self, machine: Machine):
        self.machine, self.marks, self.memo = machine, Landmarks(machine.marks), {}

    def look_up(self, bags: list[list[str]]) -> dict[str, float]:
        if len(self.memo) > MEMO:
            self.memo = {}
        new = list({u for bag in bags for u in bag if u not in self.memo})
        self.memo.update(zip(new, margins(new, self.machine, self.marks).tolist(), strict=True))
        return self.memo


def _groups(texts: list[str | None], size: int = 1 << 20) -> Iterator[list[list[str]]]:
    """Bags of units of successive texts, about ``size`` letters together."""
    held, n = [], 0
    for t in texts:
        held.append(units(t))
        n += len(t or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _unit_counts(rows: DataFrame) -> DataFrame:
    """(unit, toxic, clean): in how many texts of (y, text) each unit occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(count: dict[str, list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array([c[1] for c in count.values()], pa.int64()),
                                               pa.array([c[0] for c in count.values()], pa.int64())], ["unit", "toxic", "clean"])
        count: dict[str, list[int]] = {}
        for b in batches:
            for y, t in zip(b["y"].to_pylist(), b["text"].to_pylist(), strict=True):
                for u in units(t):
                    count.setdefault(u, [0, 0])[y] += 1
                if len(count) > MEMO:
                    yield sent(count)
                    count = {}
        if count:
            yield sent(count)
    return (rows.select("y", "text").mapInArrow(run, "unit string, toxic long, clean long")
            .groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _apart(candidates: list[str], most: int) -> list[str]:
    """The first candidates that are not too close to one taken before."""
    if not candidates:
        return []
    near = Landmarks(candidates).kernel(candidates)
    taken: list[int] = []
    for i in range(len(candidates)):
        if len(taken) < most and (not taken or near[i, taken].max() < APART):
            taken.append(i)
    return [candidates[i] for i in taken]


def choose_landmarks(counts: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    """(toxic, clean) landmarks. Candidates are the first ``CANDIDATES`` units
    of each kind, a report of the best over all units."""
    n = n_toxic + n_clean
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    both = a + b

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    g2 = 2 * (part(a, both * n_toxic / n) + part(b, both * n_clean / n)
              + part(n_toxic - a, (n - both) * n_toxic / n) + part(n_clean - b, (n - both) * n_clean / n))
    # surely more than half of the texts with the unit are toxic, were both labels as common
    worse = counts.where((a - 3 * F.sqrt(a)) / n_toxic > b / n_clean).withColumn("g2", g2)
    toxic = [r["unit"] for r in worse.orderBy(F.desc("g2"), "unit").limit(CANDIDATES).collect()]
    clean = [r["unit"] for r in counts.where("clean > toxic").orderBy(F.desc("clean"), "unit").limit(CANDIDATES).collect()]
    toxic = _apart([u for u in toxic if len(u) <= PIECE], TOXIC_LANDMARKS)
    return toxic, _apart([u for u in clean if len(u) <= PIECE and u not in toxic], CLEAN_LANDMARKS)


def support_vectors(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 30.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge machine, by Newton steps."""
    n = x.shape[1] + 1
    keep = np.ones(n)
    keep[-1] = 1e-6                       # the bias is not drawn to zero
    w, active = np.zeros(n), None
    for _ in range(steps):
        now = 1 - y * (x @ w[:-1] + w[-1]) > 0
        if active is not None and (now == active).all():
            break
        active = now
        left, right = np.diag(keep), np.zeros(n)
        for at in np.array_split(np.flatnonzero(active), len(x) // 8192 + 1):
            xa = np.concatenate([x[at], np.ones((len(at), 1))], 1).astype(np.float64)
            wa = cost * weight[at]
            left += (xa * wa[:, None]).T @ xa
            right += xa.T @ (wa * y[at])
        w = np.linalg.solve(left, right)
    return w[:-1], float(w[-1])


def _spoilt(unit: str, rng: np.random.Generator) -> list[str]:
    """The unit with one character put in, and with one between all letters."""
    if len(unit) < 3 or len(unit) > PIECE // 2:
        return []
    at, mark = int(rng.integers(1, len(unit))), str(rng.choice(list("*.-_x1")))
    return [unit[:at] + mark + unit[at:], str(rng.choice(list("*.-_"))).join(unit)]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and constant of the weighted logistic curve, by damped Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-2 * w)
        w -= step / max(1.0, np.abs(step).max() / 5)
    return w


def _trained(machine: Machine, seen: list, toxic: list[str], clean: list[str], rng: np.random.Generator) -> Machine:
    """The machine after ``ROUNDS`` rounds on the highest units of the texts."""
    names, marks = machine.marks, Landmarks(machine.marks)
    value, vector = np.linalg.eigh(marks.kernel(names).astype(np.float64))
    root = (vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T).astype(np.float32)
    machine = Machine(names, np.append(machine.weights, np.zeros(len(names) - len(machine.weights))), machine.bias)
    negative = sorted({u for y, back, us in seen if not y and not back for u, _ in us if len(u) <= PIECE} - set(toxic) | set(clean))
    bags = [[u for u, _ in us] for y, back, us in seen if y and not back]
    cache = sorted({u for us in bags for u in us} - set(negative))
    less = negative + [v for u in negative for v in _spoilt(u, rng)[:1]]
    x_less = marks.kernel(less) @ root
    for _ in range(ROUNDS):
        m = dict(zip(cache, margins(cache, machine, marks).tolist(), strict=True))
        at = {max(us, key=lambda u: m.get(u, -np.inf), default="") for us in bags}
        positive = sorted({u for u in at if m.get(u, -1.0) > 0 and len(u) <= PIECE} | set(toxic))
        more = positive + [v for u in positive for v in _spoilt(u, rng)]
        x = np.concatenate([marks.kernel(more) @ root, x_less])
        y = np.repeat([1.0, -1.0], [len(more), len(less)])
        beta, bias = support_vectors(x, y, np.where(y > 0, 50 / len(more), 50 / len(less)))
        machine = Machine(names, root @ beta, bias)
    return machine


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", train_rows: int = TRAIN_ROWS, seed: int = 3) -> Machine:
    """Learn from the labels of the ids where ``allowed`` (a condition on
    ``doc_id``) holds."""
    known = (labels.where(allowed & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
             .groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("y2"))
             .where("y = y2 and y in (0, 1)").select("id", F.col("y").cast("int").alias("y")))
    # about train_rows ids a label, by a bound on the id's hash: few enough to be broadcast
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = {y: min(1.0, train_rows / c) for y, c in n.items()}
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    taken = known.where(place < F.when(F.col("y") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(taken), "id").withColumn("back", F.pmod(F.xxhash64("id"), F.lit(5)) == 0)
    sample = written(rows, "toxicity-sample")
    seen_of = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(seen_of) < 2:
        return Machine([], np.zeros(0), 0.0, constant=float(next(iter(n), 0.5)) if len(n) < 2 else n[1] / (n[0] + n[1]))
    toxic, clean = choose_landmarks(written(_unit_counts(sample), "toxicity-units"), seen_of[1], seen_of[0])
    if not toxic:
        return Machine([], np.zeros(0), 0.0, constant=n[1] / (n[0] + n[1]))
    def worst(machine: Machine) -> list[tuple[int, bool, list[tuple[str, float]]]]:
        """(label, held back, highest units with margins) of the sample's texts."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scores = Scores(machine)
            for b in batches:
                out = []
                for bags in _groups(b["text"].to_pylist()):
                    m = scores.look_up(bags)
                    out += [nsmallest(WITNESSES, bag, key=lambda u, m=m: (-m[u], u)) for bag in bags]
                value = [[scores.memo[u] for u in us] for us in out]
                yield pa.RecordBatch.from_arrays([b["y"], b["back"], pa.array(out, pa.list_(pa.string())), pa.array(value, pa.list_(pa.float64()))],
                                                 ["y", "back", "units", "value"])
        got = sample.select("y", "back", "text").mapInArrow(run, "y int, back boolean, units array<string>, value array<double>").toArrow()
        return sorted((r["y"], r["back"], list(zip(r["units"], r["value"], strict=True))) for r in got.to_pylist())

    # at first, a unit is as bad as the toxic landmarks it is like
    machine = Machine(toxic + clean, np.repeat([1.0, -1.0], [len(toxic), len(clean)]), 0.0)
    rng = np.random.default_rng(seed)
    for k in range(PASSES):
        seen = worst(machine)
        if k:
            # clean units on the wrong side are landmarks from now on
            value = {u: m for y, back, us in seen if not y and not back for u, m in us if u not in toxic and len(u) <= PIECE}
            hard = _apart(sorted(value, key=lambda u: (-value[u], u))[:CANDIDATES], HARD_LANDMARKS)
            machine.marks += [u for u in hard if u not in machine.marks]
        machine = _trained(machine, seen, toxic, clean, rng)
    held = [r for r in worst(machine) if r[1]] or seen
    y = np.array([r[0] for r in held], np.float64)
    x = np.array([machine.highest(m for _, m in us) for *_, us in held])
    # the sample has more toxic texts than the labels do
    true = np.where(y > 0, n[1] / max(y.sum(), 1), n[0] / max(len(y) - y.sum(), 1))
    machine.curve = _logistic(x, y, true / true.mean())
    drop_written(sample)
    return machine


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, unit), one row a document: its probability and its worst
    unit (null without units)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = Scores(model)
        for b in batches:
            worst, value = [], []
            for bags in _groups(b["text"].to_pylist()):
                m = scores.look_up(bags)
                for bag in bags:
                    worst.append(max(bag, key=m.__getitem__, default=None))
                    value.append(model.highest(map(m.__getitem__, bag)))
            prob = model.prob(np.array(value, np.float64).reshape(-1, WORST))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(prob, pa.float64()), pa.array(worst, pa.string())],
                                             ["doc_id", "score", "unit"])
    return (docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, score double, unit string"))
