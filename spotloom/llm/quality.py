"""Quality classifier from supervised subword embeddings (operator 9).

A text is the average of learned vectors for its words, the words' character n-grams and the event that a word repeats
the one before, all hashed into ``BUCKETS`` rows; a softmax layer turns it into a probability. Vectors and layer are
trained together by stochastic gradient descent in numpy on the driver, on a sample of labelled rows whose size is a
parameter. For scoring, the layer is folded into the rows: a text's score needs one number per feature.

Edge cases: a null or empty text has no features and gets the score of the bias alone. Labels that are null, belong to
no document or to held-out documents are not used; of several labels for one doc_id the least counts. Without usable
labels every score is 0.5. A null doc_id is scored and is not held out. Repeated rows are scored each by itself.
``score_documents`` ignores other columns, ``keep_good`` keeps them all.
"""

from __future__ import annotations

import math
import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotloom.llm.common import crc_mod, hash_share, map_slices, on_texts, text_list

BUCKETS = 1 << 16
REPEAT = 0
SHORTEST, LONGEST = 3, 4
#: Bound of the training sample: rows, and characters of each (scoring reads whole texts).
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 20_000
MAX_WORDS = 200_000
HELD_OUT = 1


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, the word's ends marked."""
    crc = zlib.crc32
    marked = f"<{word}>"
    found = [crc(marked.encode("utf-8", "surrogatepass"))]
    if marked.isascii():
        data = marked.encode()
        for size in range(SHORTEST, LONGEST + 1):
            found += [crc(data[i:i + size]) for i in range(len(data) - size + 1)]
    else:
        for size in range(SHORTEST, LONGEST + 1):
            found += [crc(marked[i:i + size].encode("utf-8", "surrogatepass")) for i in range(len(marked) - size + 1)]
    return [1 + h % (BUCKETS - 1) for h in found]


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    ids = [REPEAT] * sum(map(operator.eq, words, words[1:]))
    for word in words:
        ids += word_features(word)
    ids, n = np.unique(np.array(ids, dtype=np.int64), return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float32)


@dataclass(frozen=True)
class Model:
    values: np.ndarray  # log odds that a feature brings, weighted by its share of the text's features
    bias: float

    def scorer(self):
        values, bias, known = self.values.tolist(), self.bias, {}

        def score(text: str) -> float:
            words = text.split()
            if not words:
                return 1 / (1 + math.exp(-bias))
            repeats = sum(map(operator.eq, words, words[1:]))
            total, n = repeats * values[REPEAT], repeats
            for word in words:
                pair = known.get(word)
                if pair is None:
                    ids = word_features(word)
                    pair = sum([values[i] for i in ids]), len(ids)
                    if len(known) >= MAX_WORDS:
                        known.clear()
                    known[word] = pair
                total += pair[0]
                n += pair[1]
            return 1 / (1 + math.exp(-max(-700.0, min(700.0, bias + total / n))))

        return score


def train(texts: list[str], labels: list[int], size: int = 10, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Embedding rows and softmax layer by stochastic gradient descent, rate falling to zero."""
    if not texts:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    rows = rng.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
    layer, bias = np.zeros((size, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    known = [_counts(t[:SAMPLE_CHARS]) for t in texts]
    targets = np.eye(2, dtype=np.float32)[np.array(labels)]
    step, steps = 0, epochs * len(texts)
    for _ in range(epochs):
        for k in rng.permutation(len(texts)):
            ids, share = known[k]
            hidden = share @ rows[ids]
            logits = hidden @ layer + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum() - targets[k]
            now = rate * (1 - step / steps)
            back = layer @ error
            layer -= now * np.outer(hidden, error)
            bias -= 0.1 * now * error
            # Shares are small: a row moves by its share of the text's features times their number.
            rows[ids] -= now * np.outer(share * len(ids), back)
            step += 1
    return Model((rows @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from about ``sample_rows`` labelled documents outside the held-out third."""
    usable = labels.where(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), 3) != HELD_OUT))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = usable.where(hash_share(F.col("doc_id"), sample_rows, usable.count()))
    # About sample_rows rows of two numbers: small whatever the corpus.
    chosen = docs.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = sorted((r.doc_id, r.quality, r.text or "") for r in chosen.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect())
    return train([t for *_, t in rows], [int(q) for _, q, _ in rows])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""
    state: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(model.scorer())
        scores = [state[0](t) for t in text_list(batch.column(2))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
            names=["doc_id", "held_out", "score", "predicted"])

    key = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == HELD_OUT, F.lit(False)).alias("held_out")
    return map_slices(docs.select("doc_id", held_out, "text"), run, f"doc_id {key}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model accepts, unchanged."""
    state: list = []

    def good(texts: list[str]) -> pa.Array:
        if not state:
            state.append(model.scorer())
        return pa.array([state[0](t) >= 0.5 for t in texts], pa.bool_())

    return docs.where(on_texts(good, "boolean")(F.col("text")))
