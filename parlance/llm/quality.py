"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes each but the last; only documents have labels. Every passage is encoded by a layer
over its byte frequencies, its pairs of byte classes and the repetition of its words. A gated attention, the product of
a tanh and a sigmoid layer, learns from the documents' labels how much each passage counts: the weights are a softmax
over the bag, and the weighted mean of the encoded passages is what is scored. All layers are learned together, by
Adam over whole bags.

The model is fitted on a bounded sample (``SAMPLE_DOCS`` labelled documents of each label, drawn by a hash of doc_id,
of at most ``SAMPLE_BYTES`` each) and broadcast. Each label weighs as much in the fit as it has rows, so that scores
are probabilities. Every text is scored whole: passages are taken in pieces of bounded size, and the softmax is carried
over from piece to piece by its maximum and sums.

Defined results: a null or empty text is one empty passage and is scored like any other; a doc_id with several labels
has their mean for its label, the nearer of 0 and 1 for its class; labels without a doc_id or quality teach nothing;
without any label to learn from, all scores are 0.5; equal texts get equal scores; a null doc_id counts as an empty one
where its checksum is asked for; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import encoded, hash_words, mix64, slices
from parlance.llm.langid import fold

#: Bytes of a passage, and how many passages are encoded at a time.
PASSAGE, AT_A_TIME = 512, 2048
#: The bounded sample: documents of each label, and bytes of each of them.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 1 << 14
#: Sizes of the encoding and of the attention layers; passes over the sample.
WIDTH, GATES, EPOCHS, BATCH = 24, 16, 30, 128

# Classes of bytes whose pairs are counted; the last is that of the ends of texts, which is left out.
_KINDS = 11
_KIND = np.full(256, 8, dtype=np.int64)
for _k, _of in enumerate([b" ", b"\t\n\r\v\f", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", bytes(range(128, 256)), b".", b",", None, b"!?;:'\"-()"]):
    if _of is not None:
        _KIND[list(_of)] = _k
_PAIRS = np.flatnonzero([a < _KINDS - 1 and b < _KINDS - 1 for a in range(_KINDS) for b in range(_KINDS)])
FEATURES = 256 + len(_PAIRS) + 6


def features(passages: list[bytes], sizes: list[int]) -> np.ndarray:
    """A row for each passage, of nothing but its bytes and the size of its whole text."""
    n = np.array([len(p) for p in passages], dtype=np.int64)
    starts = np.cumsum(n + 1) - (n + 1)
    line = b"\n".join(passages) + b"\n"
    raw = np.frombuffer(line, dtype=np.uint8).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n + 1)
    count = np.bincount(of * 256 + raw, minlength=256 * len(n)).reshape(-1, 256).astype(np.float64)
    count[:, 10] -= 1  # the line break after each passage
    kind = _KIND[raw]
    kind[starts + n] = _KINDS - 1
    pairs = np.bincount(of[:-1] * _KINDS**2 + kind[:-1] * _KINDS + kind[1:], minlength=_KINDS**2 * len(n)).reshape(-1, _KINDS**2)[:, _PAIRS]
    h, at, end = hash_words(line)
    place = of[at]
    words = np.bincount(place, minlength=len(n))
    again = np.bincount(place[1:][(h[1:] == h[:-1]) & (place[1:] == place[:-1])], minlength=len(n))
    _, first = np.unique(mix64(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    distinct = np.bincount(place[first], minlength=len(n))
    long = np.bincount(place, weights=end - at, minlength=len(n))
    per, many = 1 / np.maximum(n, 1), 1 / np.maximum(words, 1)
    more = [words * per, long * many, again * many, distinct * many, n / PASSAGE, np.log1p(np.array(sizes, dtype=np.float64))]
    return np.hstack([np.sqrt(count * per[:, None]), np.sqrt(pairs * per[:, None]), np.stack(more, axis=1)]).astype(np.float32)


def passages_of(text: bytes) -> list[bytes]:
    """A text cut into passages; an empty one is one."""
    return [text[i : i + PASSAGE] for i in range(0, max(1, len(text)), PASSAGE)]


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """All passages in order, at most AT_A_TIME together, and of which text each is."""
    whose, held = [], []
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), PASSAGE):
            whose.append(i)
            held.append(text[at : at + PASSAGE])
            if len(held) == AT_A_TIME:
                yield np.array(whose), held
                whose, held = [], []
    if held:
        yield np.array(whose), held


@dataclass
class Attention:
    """The layers: encoding, the gates of the attention, and the score."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    @classmethod
    def new(cls, rows: np.ndarray, prior: float, seed: int = 7) -> Attention:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        parts = {
            "encode": draw(rows.shape[1], WIDTH), "encode0": np.zeros(WIDTH), "tanh": draw(WIDTH, GATES), "tanh0": np.zeros(GATES), "gate": draw(WIDTH, GATES), "gate0": np.zeros(GATES),
            "weigh": draw(GATES, 1)[:, 0], "score": draw(WIDTH, 1)[:, 0], "score0": np.array([np.log(prior / (1 - prior))]),
        }
        return cls(rows.mean(axis=0), rows.std(axis=0) + 1e-3, parts)

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -5, 5)

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Encoded passages, both gates and the attention before the softmax."""
        p = self.parts
        h = np.tanh(x @ p["encode"] + p["encode0"])
        t = np.tanh(h @ p["tanh"] + p["tanh0"])
        s = 1 / (1 + np.exp(-(h @ p["gate"] + p["gate0"])))
        return h, t, s, (t * s) @ p["weigh"]

    def probability(self, bags: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(bags @ self.parts["score"] + self.parts["score0"], -500, 500)))

    def slopes(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The loss of some bags, whose passages stand together from ``starts``, and its derivatives."""
        p = self.parts
        sizes = np.diff(np.append(starts, len(x)))
        h, t, s, e = self.passages(x)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        bags = np.add.reduceat(a[:, None] * h, starts)
        q = self.probability(bags)
        loss = -(weight * (label * np.log(q + 1e-12) + (1 - label) * np.log(1 - q + 1e-12))).sum() / weight.sum()
        off = weight * (q - label) / weight.sum()
        to_bag = np.repeat(off[:, None] * p["score"], sizes, axis=0)
        to_a = (h * to_bag).sum(axis=1)
        to_e = a * (to_a - np.repeat(np.add.reduceat(a * to_a, starts), sizes))
        to_t = to_e[:, None] * p["weigh"] * s * (1 - t * t)
        to_s = to_e[:, None] * p["weigh"] * t * s * (1 - s)
        to_h = (a[:, None] * to_bag + to_t @ p["tanh"].T + to_s @ p["gate"].T) * (1 - h * h)
        return loss, {"encode": x.T @ to_h, "encode0": to_h.sum(axis=0), "tanh": h.T @ to_t, "tanh0": to_t.sum(axis=0), "gate": h.T @ to_s, "gate0": to_s.sum(axis=0), "weigh": (t * s).T @ to_e, "score": bags.T @ off, "score0": off.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 11, rate: float = 3e-3, decay: float = 1e-3) -> None:
        """Adam over batches of whole bags, with a rate that falls to nothing and decaying weights."""
        rng = np.random.default_rng(seed)
        bags = [self.scaled(b) for b in bags]
        m, v, step = {k: np.zeros_like(p) for k, p in self.parts.items()}, {k: np.zeros_like(p) for k, p in self.parts.items()}, 0
        most = epochs * -(-len(bags) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(bags), BATCH):
                some = order[at : at + BATCH]
                x = np.concatenate([bags[i] for i in some])
                starts = np.cumsum([0] + [len(bags[i]) for i in some[:-1]])
                _, slope = self.slopes(x, starts, label[some], weight[some])
                step += 1
                now = rate * (1 - (step - 1) / most)
                for k, g in slope.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.parts[k] -= now * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * self.parts[k] * (self.parts[k].ndim > 1))

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its probability, how many passages it has, the most attended one, and that one's weight."""
        n, sizes = len(texts), [len(t) for t in texts]
        top, total, bags = np.full(n, -np.inf), np.zeros(n), np.zeros((n, WIDTH))
        count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for whose, held in pieces(texts):
            h, _, _, e = self.passages(self.scaled(features(held, [sizes[i] for i in whose])))
            starts = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
            ends = np.append(starts[1:], len(whose))
            own, peak = whose[starts], np.maximum.reduceat(e, starts)
            share = np.exp(e - np.repeat(peak, ends - starts))
            new = np.maximum(top[own], peak)
            old, fresh = np.exp(top[own] - new), np.exp(peak - new)
            total[own] = total[own] * old + np.add.reduceat(share, starts) * fresh
            bags[own] = bags[own] * old[:, None] + np.add.reduceat(share[:, None] * h, starts) * fresh[:, None]
            for i, a, b in zip(own.tolist(), starts.tolist(), ends.tolist(), strict=True):
                k = a + int(e[a:b].argmax())
                if e[k] > top[i]:
                    best[i] = count[i] + k - a
                count[i] += b - a
            top[own] = new
        return self.probability(bags / total[:, None]), count, best, 1 / total


# --------------------------------------------------------------------- Spark


def _told(labels: DataFrame) -> DataFrame:
    """(doc_id, label, good) of each doc_id that has labels."""
    own = labels.where("doc_id is not null and quality is not null")
    return own.groupBy("doc_id").agg(F.avg((F.col("quality") == 1).cast("double")).alias("label")).withColumn("good", F.col("label") >= 0.5)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES, epochs: int = EPOCHS) -> Attention | None:
    """The model of the documents (doc_id, text) that labels (doc_id, quality) tell of; None if they tell of none."""
    told = _told(labels.select(labels["doc_id"], labels["quality"]))
    share = {r.good: r.n for r in told.groupBy("good").agg(F.count("*").alias("n")).collect()}
    own = docs.select(docs["doc_id"], docs["text"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(passages_of(t or b""), [len(t or b"")] * len(passages_of(t or b""))).astype(np.float16).tobytes() for t in encoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["label", "rows"])

    bags, label, weight = [], [], []
    for good, n in sorted(share.items()):
        by_hash = lambda c: F.xxhash64(c, F.lit(12))
        some = told.where(F.col("good") == good).orderBy(by_hash("doc_id"), "doc_id").limit(sample)
        short = F.coalesce(F.octet_length("text"), F.lit(0)) <= size
        drawn = own.where(short).join(F.broadcast(some), "doc_id").orderBy(by_hash("doc_id"), "doc_id", F.xxhash64("text")).limit(sample)
        got = drawn.select("label", "text").mapInArrow(measured, "label double, rows binary").collect()
        bags += [np.frombuffer(r.rows, np.float16).reshape(-1, FEATURES).astype(np.float32) for r in got]
        label += [r.label for r in got]
        weight += [n / max(1, len(got))] * len(got)
    if not bags:
        return None
    label, weight = np.array(label), np.array(weight)
    prior = float(np.clip((label * weight).sum() / weight.sum(), 0.001, 0.999))
    model = Attention.new(np.concatenate(bags), prior)
    model.fit(bags, label, weight / weight.mean(), epochs)
    return model


def score(docs: DataFrame, model: Attention | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and score, passages, attended (the passage that counts most) and weight (its own)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[docs[k].alias(f"_{i}") for i, k in enumerate(keep)], docs["text"].alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    names = [f"_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts = [t or b"" for t in encoded(batch.column(len(keep)))]
            if not texts:
                continue
            if shared.value is None:
                told = np.full(len(texts), 0.5), np.array([max(1, -(-len(t) // PASSAGE)) for t in texts]), np.zeros(len(texts), np.int64), np.full(len(texts), np.nan)
            else:
                told = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, told)], [*names, "score", "passages", "attended", "weight"])

    found = rows.mapInArrow(run, f"{schema}, score double, passages long, attended long, weight double")
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keep, strict=True)], "score", "passages", "attended", "weight")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from labels of the two folds that are not held out."""
    learned = labels.where(fold(labels["doc_id"], 3) != 1)
    found = score(docs, train(docs, learned), ["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
