"""Language of a text by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a run of letters from both ends and labels every byte with a distribution over the
languages; a document's distribution is the mean over all its bytes. Its state starts anew at every run of letters,
so a run that comes back has the same labels again: each worker keeps the sums of the runs that it has seen, and only
new runs pass through the network. Training is numpy only, by backpropagation through time.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches

#: Most documents of each language and letter runs of each of them that the network learns from.
SAMPLE_DOCS, SAMPLE_RUNS, SAMPLE_CHARS = 250, 300, 20_000
#: Longest run that is read in one go; longer ones are cut.
RUN_BYTES = 48
HIDDEN, EMBED = 16, 12
ROUNDS, BATCH, RATE = 6, 256, 0.01
CACHE_SIZE = 250_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def runs_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def packed(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the runs, one more than each and 0 beyond its end; and which places are filled."""
    width = max(map(len, runs))
    raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in runs), np.uint8).reshape(len(runs), width)
    filled = np.arange(width) < np.array([len(r) for r in runs])[:, None]
    return np.where(filled, raw.astype(np.int64) + 1, 0), filled


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """An embedding of bytes, a gated recurrent cell for each direction and a linear layer on both states."""

    def __init__(self, n_labels: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"embed": draw(257, EMBED) * 4, "out": draw(2 * HIDDEN, n_labels), "out_b": np.zeros(n_labels, np.float32)}
        for d in "fb":
            self.p |= {f"{d}x": draw(EMBED, 3 * HIDDEN), f"{d}h": draw(HIDDEN, 3 * HIDDEN), f"{d}b": np.zeros(3 * HIDDEN, np.float32)}

    def sweep(self, d: str, codes: np.ndarray, filled: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States after each byte, read forwards (f) or backwards (b); a place beyond a run's end keeps the state."""
        n, width = codes.shape
        table = self.p["embed"] @ self.p[f"{d}x"] + self.p[f"{d}b"]
        gate, cand = self.p[f"{d}h"][:, : 2 * HIDDEN], self.p[f"{d}h"][:, 2 * HIDDEN :]
        state, states = np.zeros((n, HIDDEN), np.float32), np.empty((n, width, HIDDEN), np.float32)
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            x = table[codes[:, t]]
            zr = sigmoid(x[:, : 2 * HIDDEN] + state @ gate)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + (r * state) @ cand)
            on = filled[:, t : t + 1]
            if trace is not None:
                trace.append((t, state, z, r, new))
            state = np.where(on, z * state + (1 - z) * new, state)
            states[:, t] = state
        return states

    def labels(self, codes: np.ndarray, filled: np.ndarray, traces: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The distribution at every byte, and the states it came from."""
        both = np.concatenate([self.sweep(d, codes, filled, traces and traces[k]) for k, d in enumerate("fb")], axis=2)
        logits = both @ self.p["out"] + self.p["out_b"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), both

    def gradients(self, runs: list[bytes], target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy at every byte against the run's target distribution."""
        codes, filled = packed(runs)
        traces: tuple[list, list] = ([], [])
        prob, both = self.labels(codes, filled, traces)
        d_logit = (prob - target[:, None, :]) * (filled * weight[:, None])[:, :, None]
        d_logit = (d_logit / max(1e-9, float((filled * weight[:, None]).sum()))).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["out_b"] = np.tensordot(both, d_logit, ((0, 1), (0, 1))), d_logit.sum((0, 1))
        d_both = d_logit @ self.p["out"].T
        for k, d in enumerate("fb"):
            w, h_w = self.p[f"{d}x"], self.p[f"{d}h"]
            d_state, own = np.zeros((len(runs), HIDDEN), np.float32), d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            for t, before, z, r, new in reversed(traces[k]):
                on = filled[:, t : t + 1]
                d_state = d_state + own[:, t] * on
                d_new = d_state * (1 - z) * (1 - new * new) * on
                d_z = d_state * (before - new) * z * (1 - z) * on
                d_gated = d_new @ h_w[:, 2 * HIDDEN :].T
                d_r = d_gated * before * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_new], axis=1)
                x = self.p["embed"][codes[:, t]]
                g[f"{d}x"] += x.T @ d_in
                g[f"{d}b"] += d_in.sum(0)
                g[f"{d}h"][:, : 2 * HIDDEN] += before.T @ d_in[:, : 2 * HIDDEN]
                g[f"{d}h"][:, 2 * HIDDEN :] += (r * before).T @ d_new
                np.add.at(g["embed"], codes[:, t], d_in @ w.T)
                d_state = np.where(on, d_state * z + d_gated * r + d_in[:, : 2 * HIDDEN] @ h_w[:, : 2 * HIDDEN].T, d_state)
        return g

    def fit(self, runs: list[bytes], target: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, seed: int = 5) -> None:
        """Adam over shuffled batches of runs of like length."""
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        sizes = np.array([len(r) for r in runs])
        for turn in range(rounds):
            order = np.argsort(sizes + rng.random(len(runs)) * 3, kind="stable")
            parts = np.array_split(order, max(1, len(runs) // BATCH))
            for k in rng.permutation(len(parts)):
                at, step = parts[k], step + 1
                for name, g in self.gradients([runs[i] for i in at], target[at], weight[at]).items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    rate = RATE * 0.6**turn * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    self.p[name] -= (rate * first[name] / (np.sqrt(second[name]) + 1e-7)).astype(np.float32)


class Model:
    """A trained network and its languages."""

    def __init__(self, network: Network | None, languages: list[str]):
        self.network, self.languages = network, languages


def cut_run(run: str) -> list[bytes]:
    """The bytes of a run, as many at a time as are read in one go."""
    raw = "".join(filter(str.isalpha, run)).encode()
    return [raw[k : k + RUN_BYTES] for k in range(0, len(raw), RUN_BYTES)]


def sample(known: DataFrame, sample_docs: int) -> DataFrame:
    """(y, t): at most so many different texts t of each language y, those whose hashes come first, so that every run over
    the same rows picks the same ones. A hash lets some more than are wanted through, and only these are ranked."""
    hashed = known.withColumn("h", F.xxhash64("t"))
    totals = hashed.groupBy("y").agg(F.approx_count_distinct("h").alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * sample_docs) / F.col("n"))
    some = hashed.join(F.broadcast(totals), "y").where(F.pmod("h", F.lit(1_000_000)) < 1_000_000 * share)  # a row a language
    first = some.groupBy("y", "h").agg(F.min("t").alias("t")).withColumn("h", F.pmod("h", F.lit(1_000_000)))
    return first.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h", "t"))).where(F.col("k") <= sample_docs).select("y", "t")


def train(docs: DataFrame, *, text_col: str = "text", label_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_runs: int = SAMPLE_RUNS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from at most sample_docs texts of each language, picked by their hashes, and sample_runs letter runs of each, up
    to sample_chars characters (a letter run may be as long as its text).
    A run that several languages use has their shares as its target. Null texts and labels teach nothing."""
    known = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(label_col).alias("y"), F.col(text_col).alias("t"))

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                runs = runs_of(text)
                step = max(1, len(runs) // sample_runs)
                out.append(" ".join(runs[::step][:sample_runs])[:sample_chars])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["y", "runs"])

    per_doc = sample(known, sample_docs).mapInArrow(run, "y string, runs string").collect()  # sample_docs rows a language at most
    languages = sorted({r.y for r in per_doc})
    if not languages:
        return Model(None, [])
    counts: Counter = Counter()
    size: Counter = Counter()
    for r in per_doc:
        size[r.y] += len(r.runs.split())
    for r in sorted(per_doc):
        for w in r.runs.split():
            for part in cut_run(w):
                counts[part, r.y] += 1 / size[r.y]
    parts = sorted({w for w, _ in counts})
    if not parts:
        return Model(None, [])
    target = np.array([[counts[w, y] for y in languages] for w in parts], np.float32)
    weight = target.sum(1)
    network = Network(len(languages))
    network.fit(parts, target / weight[:, None], np.sqrt(weight / weight.mean()).astype(np.float32))
    return Model(network, languages)


class RunScores(dict):
    """Letter run to a row of sums: the labels of its bytes, and how many bytes it has."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, np.zeros((1024, len(model.languages) + 1), np.float32)

    def learn(self, runs: list[str]) -> None:
        """Pass the runs through the network, those of like length together."""
        need = len(self) + len(runs)
        if need > len(self.rows):
            more = np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]), np.float32)
            self.rows = np.concatenate([self.rows, more])
        owner, cut = [], []
        for run in runs:
            self[run] = at = len(self)
            self.rows[at] = 0
            for part in cut_run(run):
                owner.append(at)
                cut.append(part)
        order = sorted(range(len(cut)), key=lambda k: len(cut[k]))
        for k in range(0, len(order), 2048):
            part = order[k : k + 2048]
            codes, filled = packed([cut[i] for i in part])
            prob, _ = self.model.network.labels(codes, filled)
            sums = np.concatenate([(prob * filled[:, :, None]).sum(1), filled.sum(1)[:, None]], axis=1)
            np.add.at(self.rows, [owner[i] for i in part], sums.astype(np.float32))

    def pool(self, texts: list[str | None]) -> np.ndarray:
        """One row a text: the sums of its bytes' labels, and its number of labelled bytes."""
        found = [runs_of(t) if t else [] for t in texts]
        out = np.zeros((len(texts), self.rows.shape[1]))
        at = 0
        while at < len(found):
            if len(self) > CACHE_SIZE:
                self.clear()
            new: dict[str, None] = {}
            end = at
            while end < len(found) and (end == at or len(new) < 50_000):
                new.update(dict.fromkeys(w for w in found[end] if w not in self))
                end += 1
            self.learn(list(new))
            for k in range(at, end):
                if found[k]:
                    rows = np.fromiter(map(self.__getitem__, found[k]), np.int64, len(found[k]))
                    out[k] = self.rows[rows].sum(0, dtype=np.float64)
            at = end
        return out


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, lang_pred, score (the mean probability of that language over the text's bytes).

    A text that is null, empty or without a letter, and any text where nothing was learnt, is `und` with score 0. Equal
    probabilities go to the first language in alphabetical order. No other column of docs is read."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = RunScores(shared.value)
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column(1).to_pylist() if shared.value.languages else [None] * batch.num_rows
            sums = scores.pool(texts)
            prob = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
            best = prob.argmax(1) if prob.shape[1] else np.zeros(len(prob), int)
            top = np.where(sums[:, -1] > 0, prob.max(1, initial=0.0), 0.0)
            lang = names[np.where(sums[:, -1] > 0, best, len(names) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(np.clip(top, 0, 1), pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
