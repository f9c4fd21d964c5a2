"""Quality rules: exact base counts, then a calibrated logistic regression on hashed n-grams.

Features are the relative frequencies of hashed words, word pairs and character triples of a text. The classifier is trained
with numpy on a bounded sample of labelled rows, calibrated on held-back rows of it (Platt), and scored in Arrow batches.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: Base limits: fewest words; most per cent of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A text is kept if its calibrated probability of good quality is at least this.
KEEP_PROBABILITY = 0.5
#: Labelled rows of each class that the classifier learns from, at most, and the share of them kept for calibration.
SAMPLE_ROWS, HELD_SHARE = 1500, 0.25
#: Bytes of text that it learns from, at most: what it holds on the driver is bounded by that.
SAMPLE_BYTES = 64 << 20
BITS = 16
SIZE = 1 << BITS
ROUNDS, RATE, DECAY = 40, 0.5, 1e-6


def word_windows(ids: np.ndarray, distinct: int) -> np.ndarray:
    """One number for each 5-word window; equal numbers stand for equal windows and only for them."""
    n = len(ids) - WINDOW + 1
    bits = max(1, int(distinct - 1).bit_length())
    if bits * WINDOW <= 63:
        out = np.zeros(n, np.int64)
        for k in range(WINDOW):
            out = out << bits | ids[k : k + n]
        return out
    _, two = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
    span = int(two.max()) + 1
    _, four = np.unique(two[:-2] * span + two[2:], return_inverse=True)
    return four[:n] * distinct + ids[WINDOW - 1 :]


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words that stand in a 5-word window found twice or more."""
    if len(ids) <= WINDOW or distinct == len(ids):
        return 0
    _, at, counts = np.unique(word_windows(ids, distinct), return_inverse=True, return_counts=True)
    again = counts[at] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


class Document:
    """What one text gives: its base counts and its hashed n-grams."""

    def __init__(self, text: str | None):
        self.text = text or ""
        raw = self.text.encode("utf-8", "surrogatepass")
        words = raw.split()  # bytes split at the six ASCII spaces, as the rule's words do
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        word_bytes = sum(map(len, words))
        self.base = (len(words), len(self.text) - (len(raw) - word_bytes), symbols, len(lines) - len(set(lines)), repeat_words(ids, len(number)))
        self.hashes = np.fromiter((zlib.crc32(w) for w in number), np.uint64, len(number))[ids]

    def failed(self) -> bool:
        n, repeated = self.base[0], self.base[4]
        return n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n

    def slots(self) -> list[np.ndarray]:
        """Slots of its words, word pairs and character triples, each family in a range of its own."""
        h, c = self.hashes, np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        mix = np.uint64(0x9E3779B97F4A7C15)
        one = (h * mix) >> np.uint64(64 - BITS)
        two = ((h[:-1] * np.uint64(31) + h[1:]) * mix) >> np.uint64(64 - BITS)
        three = ((c[:-2] * np.uint32(0x85EBCA6B) + c[1:-1] * np.uint32(0xC2B2AE35) + c[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        return [one.astype(np.int32), two.astype(np.int32) + np.int32(SIZE), three.astype(np.int32) + np.int32(2 * SIZE)]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Its distinct slots and their relative frequencies within their family."""
        slot, value = [], []
        for family in self.slots():
            if len(family):
                k, n = np.unique(family, return_counts=True)
                slot.append(k)
                value.append(n / len(family))
        return (np.concatenate(slot), np.concatenate(value)) if slot else (np.zeros(0, np.int32), np.zeros(0))


class Classifier:
    """Weights of the n-grams, and the calibration of their sum."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def probability(self, doc: Document) -> float:
        z = self.bias + sum(float(self.weights[family].mean()) for family in doc.slots() if len(family))
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30))))


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * z + shift) a probability (Platt), by damped Newton steps."""
    slope, shift = 1.0, 0.0
    target = np.where(y > 0, (np.sum(y) + 1) / (np.sum(y) + 2), 1 / (np.sum(1 - y) + 2))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        d, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([np.sum(d * z), np.sum(d)])
        hess = np.array([[np.sum(h * z * z), np.sum(h * z)], [np.sum(h * z), np.sum(h)]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        slope, shift = slope - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
    return max(float(slope), 1e-3), float(shift)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, prior: float, seed: int = 7) -> Classifier:
    """Logistic regression by Adagrad on rows of (slots, values); prior: the share of good rows among all labelled."""
    rng = np.random.default_rng(seed)
    w, bias, square, b_square = np.zeros(3 * SIZE), 0.0, np.full(3 * SIZE, 1e-8), 1e-8
    if not len(y) or len(set(y.tolist())) < 2:  # nothing to tell apart: every text has the prior
        p = min(max(prior, 0.01), 0.99)
        return Classifier(w, 0.0, 1.0, float(np.log(p / (1 - p))))
    order = rng.permutation(len(y))
    held = order[: max(2, int(HELD_SHARE * len(y)))]
    learn = order[len(held) :] if len(order) - len(held) >= 2 else order
    for _ in range(ROUNDS):
        for at in np.array_split(rng.permutation(learn), max(1, len(learn) // 32)):
            slot, value = np.concatenate([rows[i][0] for i in at]), np.concatenate([rows[i][1] for i in at])
            owner = np.repeat(np.arange(len(at)), [len(rows[i][0]) for i in at])
            z = bias + np.bincount(owner, w[slot] * value, len(at))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)
            touched, back = np.unique(slot, return_inverse=True)
            g = np.bincount(back, d[owner] * value) + DECAY * w[touched]
            square[touched] += g * g
            w[touched] -= RATE * g / np.sqrt(square[touched])
            b_square += d.sum() ** 2
            bias -= RATE * d.sum() / np.sqrt(b_square)
    z = np.array([bias + np.dot(w[rows[i][0]], rows[i][1]) for i in held])
    good = y[held].mean()
    weight = np.where(y[held] > 0, prior / max(good, 1e-6), (1 - prior) / max(1 - good, 1e-6))
    slope, shift = calibrate(z, y[held], weight)
    return Classifier(w, bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Classifier:
    """A classifier from at most sample_rows labelled documents of each class and sample_bytes of their texts, in the order
    of a hash of the id. An id with several labels that differ teaches nothing; of rows of equal id the longest text counts."""
    given = F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()
    known = labels.where(given).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("y2")).where("y = y2").drop("y2")
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y, n in sorted(totals.items()):
        share = min(1.0, 1.2 * sample_rows / n)
        some = known.where((F.col("y") == y) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * share))).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return fit([], np.zeros(0), 0.5)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(picked), "id")  # sample_rows rows a class at most
    sizes = texts.groupBy("id").agg(F.max(F.coalesce(F.octet_length("t"), F.lit(0))).alias("size"), F.xxhash64("id").alias("h")).collect()
    ids, left = [], sample_bytes
    for r in sorted(sizes, key=lambda r: (r.h, r.id)):
        if r.size <= left:  # a text that is too large is passed over, and the next are tried
            left -= r.size
            ids.append(r.id)
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], f"id {picked.schema['id'].dataType.simpleString()}")

    def run(batches):
        for batch in batches:
            found = [Document(t).features() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype("<i4").tobytes() for s, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], ["y", "slots", "counts"])

    longest = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max(F.struct(F.octet_length("t").alias("size"), "t")).alias("top"), F.first("y").alias("y"))
    got = longest.select("y", "top.t").mapInArrow(run, "y int, slots binary, counts binary").collect()  # bounded rows and bytes
    got.sort(key=lambda r: (r.y, bytes(r.slots), bytes(r.counts)))
    rows = [(np.frombuffer(r.slots, "<i4"), np.frombuffer(r.counts, "<f4")) for r in got]
    return fit(rows, np.array([r.y for r in got], float), totals.get(1, 0) / max(1, sum(totals.values())))


def score_quality(docs: DataFrame, classifier: Classifier, *, text_col: str = "text", keep: list[str] | None = None, min_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """docs' columns (or those named in keep) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, quality_score, kept.

    A null text has no words and fails. Every row is judged alone, repeated or not; an empty table gives no rows.
    Columns of docs with those names give way to the results."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    made = [*names, "base_failed", "quality_score", "kept"]
    columns = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = docs.select(*columns, F.col(text_col).alias("_text"))
    fields = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns), *(f"{n} long" for n in names), "base_failed boolean, quality_score double, kept boolean"])

    def run(batches):
        model = shared.value
        for batch in batches:
            base, failed, score = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                doc = Document(text)
                base.append(doc.base)
                failed.append(doc.failed())
                score.append(model.probability(doc))
            kept = [not f and s >= min_probability for f, s in zip(failed, score)]
            counts = np.array(base, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(counts[:, k]) for k in range(len(names))), pa.array(failed, pa.bool_()), pa.array(score, pa.float64()), pa.array(kept, pa.bool_())], [*columns, *made])

    return rows.mapInArrow(run, fields)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules and the classifier keep, with their own columns, whatever their names. A null text
    fails; repeated rows and rows without an id are judged each; an empty table gives no rows."""
    own = {c: f"_own_{k}" for k, c in enumerate(docs.columns)}
    scored = score_quality(docs.withColumnsRenamed(own), train(docs, labels), text_col=own["text"])
    return scored.where("kept").select(*[F.col(new).alias(c) for c, new in own.items()])
