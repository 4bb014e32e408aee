"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

Labels are of documents, not of sentences.  Units are the words of all sentences of a text (lower case, letters and digits only, between the marks ``^``
and ``$``), neighbouring words of 2 to ``SHORT`` letters joined ("id iot"), and runs of single letters joined ("i d i o t").  k(u, v) sums, over all character subsequences of length ``LENGTH`` that u and v share, DECAY to the power of the
spans they take in both, scaled to k(u, u) = 1: letters inserted, dropped or spaced out lower it gradually.  It is taken to the power
``SHARPEN``, which keeps it a kernel.  A landmark of whose letters a unit holds less than three quarters counts as 0.

Landmarks are the character sequences of ``GRAM`` with the highest log-likelihood ratio for the toxic label among at most ``TRAIN_ROWS``
labelled documents (counted by Spark), none close to one before.  A document's kernel with a landmark is the sum over its units, as for sets,
dampened by log(1 + x), so that one insult in a long text counts, and several count more.  With W the landmarks' kernel matrix, z = W^-1/2 k(document, landmarks)
goes into a linear machine with squared hinge loss, both labels weighing the same, fitted by accelerated
gradient steps no longer than the loss allows; a sigmoid turns its values into scores.  A word's kernel is
computed once and kept in a table of bounded size.

Defined results: null texts count as empty; a text without units has the value of one far from all landmarks; without labelled rows every score is
0.5; repeated rows get equal scores; null ids are not held out.  Columns besides doc_id, text and the labels' are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import store
from llm.features import training_rows

LENGTH, DECAY, SHARPEN, GRAM, LANDMARKS, TRAIN_ROWS, THRESHOLD = 3, 0.6, 2, 6, 64, 4000, 0.7
LONGEST, KEPT_WORDS, LEAST, APART, PULL, SHORT = 24, 500_000, 0.05, 0.25, 1e-3, 3
_DROP = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\w)\w(?:[\W_]{1,3}\w(?!\w)){2,}")


def units(text: str | None, neighbours: bool = True) -> Counter:
    """Raw words, neighbouring short words joined, and joined runs of single letters, counted."""
    text = (text or "").lower()
    words = text.split()
    out = Counter(words)
    if neighbours:
        out.update(a + b for a, b in zip(words, words[1:], strict=False) if 2 <= len(a) <= SHORT and 2 <= len(b) <= SHORT)
    out.update(_DROP.sub("", run) for run in _SPACED.findall(text))
    return out


def forms(word: str) -> list[str]:
    """What the kernel sees of a word: one marked string, or overlapping windows of a very long one."""
    own = _DROP.sub("", word)
    if len(own) < LENGTH:
        return []
    marked = f"^{own}$"
    if len(marked) <= LONGEST:
        return [marked]
    return [marked[a : a + LONGEST] for a in range(0, len(marked) - LONGEST // 2, LONGEST // 2)]


def coded(strings: list[str], width: int) -> np.ndarray:
    joined = "".join(s[:width].ljust(width, "\0") for s in strings)
    return np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).reshape(len(strings), width)


def letters(codes: np.ndarray) -> np.ndarray:
    """Set of letters as 64 bits, without the marks."""
    bit = np.uint64(1) << (codes % np.uint32(61)).astype(np.uint64)
    return np.bitwise_or.reduce(np.where((codes == 0) | (codes == ord("^")) | (codes == ord("$")), np.uint64(0), bit), axis=1)


def subsequence_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Unscaled kernel of row i of s and row i of t (codes, padded with 0), by dynamic programming over all rows at once."""
    n, m, rows = s.shape[1], t.shape[1], len(s)
    decay, square = np.float32(DECAY), np.float32(DECAY**2)
    same = [[((s[:, a] == t[:, b]) & (s[:, a] != 0)).astype(np.float32) * square for b in range(m)] for a in range(n)]
    before = [[np.float32(1)] * (m + 1) for _ in range(n + 1)]
    for _ in range(LENGTH - 1):
        zero = np.zeros(rows, np.float32)
        now = [[zero] * (m + 1)]
        for a in range(n):
            run, row = zero, [zero]
            for b in range(m):
                run = decay * run + same[a][b] * before[a][b]
                row.append(decay * now[a][b + 1] + run)
            now.append(row)
        before = now
    total = np.zeros(rows, np.float32)
    for a in range(n):
        for b in range(m):
            total += same[a][b] * before[a][b]
    return total


def self_kernel(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), np.float32)
    sizes = (codes != 0).sum(axis=1)
    for top in (8, 12, 16, 24):  # rows of about one width together
        own = np.flatnonzero((sizes <= top) & (sizes > {8: 0, 12: 8, 16: 12, 24: 16}[top]))
        if len(own):
            out[own] = subsequence_kernel(codes[own][:, :top], codes[own][:, :top])
    return out


@dataclass
class Landmarks:
    names: list[str]
    codes: np.ndarray = field(init=False)
    letters: np.ndarray = field(init=False)
    own: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.codes = coded(self.names, GRAM)
        self.letters = letters(self.codes)
        self.own = self_kernel(self.codes)

    def kernel(self, strings: list[str]) -> np.ndarray:
        """Scaled and sharpened kernel of each string with each landmark."""
        out = np.zeros((len(strings), len(self.names)), np.float32)
        if not len(out) or not self.names:
            return out
        codes = coded(strings, LONGEST)
        shared = np.bitwise_count(letters(codes)[:, None] & self.letters[None, :])
        near = 4 * shared.astype(np.int64) >= 3 * np.bitwise_count(self.letters)[None, :]
        rows = np.flatnonzero(near.any(axis=1))
        scale = np.zeros(len(strings), np.float32)
        scale[rows] = self_kernel(codes[rows])
        sizes = (codes != 0).sum(axis=1)
        word, mark = np.nonzero(near)
        order = np.argsort(sizes[word], kind="stable")
        word, mark = word[order], mark[order]
        for at in range(0, len(word), 4096):
            u, v = word[at : at + 4096], mark[at : at + 4096]
            got = subsequence_kernel(codes[u][:, : sizes[u].max()], self.codes[v])
            out[u, v] = got / np.sqrt(np.maximum(scale[u] * self.own[v], 1e-20))
        return out**SHARPEN


@dataclass
class Sums:
    """Kernel of whole texts with landmarks."""

    landmarks: Landmarks
    kept: dict[str, tuple[np.ndarray, np.ndarray] | None] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"landmarks": self.landmarks, "kept": {}}

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 8192):
            part = words[at : at + 8192]
            strings, of = [], []
            for i, word in enumerate(part):
                for form in forms(word):
                    strings.append(form)
                    of.append(i)
            self.kept.update(dict.fromkeys(part))
            k = self.landmarks.kernel(strings)
            near: dict[int, np.ndarray] = {}
            for row in np.flatnonzero(k.max(axis=1, initial=0) > LEAST):
                near[of[row]] = np.maximum(near[of[row]], k[row]) if of[row] in near else k[row]
            for i, row in near.items():
                columns = np.flatnonzero(row > LEAST)
                self.kept[part[i]] = columns, row[columns]

    def of(self, texts: list[str | None]) -> np.ndarray:
        own = [units(t) for t in texts]
        every = set().union(*own)
        new = every.difference(self.kept)
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept, new = {}, every
        self._learn(list(new))
        out = np.zeros((len(texts), len(self.landmarks.names)))
        for i, words in enumerate(own):
            for word in words:
                found = self.kept[word]
                if found is not None:
                    out[i, found[0]] += words[word] * found[1]
        return np.log1p(out)


@dataclass
class Model:
    sums: Sums
    weights: np.ndarray  # on kernel values: W^-1/2 times the machine's
    bias: float
    slope: float
    offset: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        value = self.sums.of(texts) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -30, 30)))


def choose_landmarks(rows: DataFrame, n: int = LANDMARKS) -> list[str]:
    """Character sequences that the toxic label makes likelier, by log-likelihood ratio over documents.  rows: text, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                strings = [s for w in units(text.as_py(), neighbours=False) for s in forms(w)]
                grams = list({s[a : a + GRAM] for s in strings for a in range(max(1, len(s) - GRAM + 1))})
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([label] * len(grams), pa.int32())], ["gram", "label"])

    total = rows.groupBy("label").count().collect()
    yes, no = (sum(r["count"] for r in total if (r["label"] == 1) == want) for want in (True, False))
    if not yes or not no:
        return []
    a, b = F.col("a"), F.col("b")
    expect_a, expect_b = (a + b) * yes / (yes + no), (a + b) * no / (yes + no)
    ratio = a * F.log(a / expect_a) + F.when(b > 0, b * F.log(b / expect_b)).otherwise(0)
    counted = rows.mapInArrow(run, "gram string, label int").groupBy("gram").agg(F.sum((F.col("label") == 1).cast("int")).alias("a"), F.sum((F.col("label") != 1).cast("int")).alias("b"))
    top = counted.filter((a >= 2) & (a > 2 * expect_a)).orderBy(ratio.desc(), "gram").limit(8 * n).select("gram").collect()
    chosen: list[str] = []
    for (gram,) in top:
        if len(chosen) < n and (not chosen or Landmarks(chosen).kernel([gram]).max() < APART):
            chosen.append(gram)
    return chosen


def fit(landmarks: Landmarks, sums: np.ndarray, labels: np.ndarray, steps: int = 1500) -> Model:
    """sums: a row of landmark kernels for each document."""
    if not landmarks.names or labels.min(initial=1) == labels.max(initial=0):
        return Model(Sums(landmarks), np.zeros(len(landmarks.names)), 0.0, 0.0, 0.0)
    values, vectors = np.linalg.eigh(landmarks.kernel(landmarks.names).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    x, y = sums @ root, 2 * labels - 1
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    wide = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    pull = np.append(np.full(x.shape[1], PULL), 0.0)
    bound = 2 * np.linalg.eigvalsh((wide * share[:, None]).T @ wide)[-1] + PULL  # no step is longer than the loss bends
    theta, ahead, pace = np.zeros(wide.shape[1]), np.zeros(wide.shape[1]), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (wide @ ahead)) * y * share
        new = ahead + (2 * wide.T @ slack - pull * ahead) / bound
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        theta, ahead, pace = new, new + (pace - 1) / faster * (new - theta), faster
    w, bias = theta[:-1], theta[-1]
    f = x @ w + bias
    slope, offset = 1.0, 0.0
    for _ in range(200):  # sigmoid by Newton steps with a weak pull to slope 1
        p = 1 / (1 + np.exp(-np.clip(slope * f + offset, -30, 30)))
        g = np.array([((p - labels) * f).sum() + 0.05 * (slope - 1), (p - labels).sum()])
        h = np.array([[(p * (1 - p) * f * f).sum() + 0.05, (p * (1 - p) * f).sum()], [(p * (1 - p) * f).sum(), (p * (1 - p)).sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 1.0 / max(1e-12, np.abs(move).max()))
        slope, offset = slope - move[0], offset - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return Model(Sums(landmarks), root @ w, float(bias), float(slope), float(offset))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, n: int = LANDMARKS) -> Model:
    """From at most ``rows`` labelled documents outside the held-out third."""
    sample = store(training_rows(docs, labels, "toxic", 3, 1, rows).select("doc_id", "text", F.col("label").cast("int").alias("label")), "toxic-sample")
    sample = sample.repartition(max(1, min(rows // 64, sample.sparkSession.sparkContext.defaultParallelism * 2)))
    landmarks = Landmarks(choose_landmarks(sample, n))
    if not landmarks.names:
        return fit(landmarks, np.zeros((0, 0)), np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sums(landmarks)
        for batch in batches:
            sums = [row.tobytes() for row in own.of(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(sums, pa.binary())], ["doc_id", "label", "sums"])

    got = sample.mapInArrow(run, "doc_id long, label int, sums binary").toPandas().sort_values(["doc_id", "sums"])
    return fit(landmarks, np.stack([np.frombuffer(k, np.float64) for k in got["sums"]]), got["label"].to_numpy().astype(float))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS, n: int = LANDMARKS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows, n))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = np.concatenate([np.zeros(0), *(held.value.scores(texts[a : a + 128]) for a in range(0, len(texts), 128))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows_in.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
