"""Language identification by cross-parsing (operator 3).

For each language a suffix automaton of labelled text is built. A text is parsed against it from left to right into the
longest phrases that occur in the labelled text; the language that needs the fewest phrases per character wins. Walking
the automaton and starting a new phrase where no transition exists is one table of moves, so many texts advance
together, one character at a time, by array indexing. Long texts are parsed in segments of ``SEGMENT`` characters that
advance side by side; a segment's end ends a phrase.

Before parsing, letters are put in lower case and each other character becomes a blank.

Edge cases: a null text or one without a letter is ``und`` with score 0, as is every text if no labelled text has a
letter. Ties go to the first language in the order of names. Null labels are not learned from. A null doc_id is
predicted, is not held out and is not learned from. Repeated rows are predicted each by itself. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotloom.llm.common import crc_mod, hash_share, map_slices, text_list

#: Bounds of the training sample: rows per language, characters per row, characters per language.
SAMPLE_ROWS, ROW_CHARS, LANGUAGE_CHARS = 48, 2000, 30_000
SEGMENT = 4096
#: Letters with a symbol of their own; rarer ones share one symbol.
LETTERS = 62
SHARPNESS = 40.0
HELD_OUT = 0
NEW_PHRASE = 1 << 30


class Automaton:
    """Table of moves over symbols: entry = next state * symbols, plus ``NEW_PHRASE`` where a phrase ends before it."""

    def __init__(self, symbols: np.ndarray, size: int):
        links, lengths, moves = [-1], [0], [{}]
        last = 0
        for s in symbols.tolist():
            now = len(moves)
            links.append(0)
            lengths.append(lengths[last] + 1)
            moves.append({})
            p = last
            while p >= 0 and s not in moves[p]:
                moves[p][s] = now
                p = links[p]
            if p >= 0:
                q = moves[p][s]
                if lengths[p] + 1 == lengths[q]:
                    links[now] = q
                else:
                    copy = len(moves)
                    links.append(links[q])
                    lengths.append(lengths[p] + 1)
                    moves.append(dict(moves[q]))
                    while p >= 0 and moves[p].get(s) == q:
                        moves[p][s] = copy
                        p = links[p]
                    links[q] = links[now] = copy
            last = now
        states = len(moves)
        # One more state follows a symbol that the language lacks: it is a phrase of its own, so the next begins another.
        root = np.full(size, states * size, dtype=np.int32)
        for s, target in moves[0].items():
            root[s] = target * size
        table = np.tile(root + NEW_PHRASE, (states + 1, 1)).astype(np.int32)
        table[0] = root
        rows = np.repeat(np.arange(states), [len(m) for m in moves])
        table[rows, [s for m in moves for s in m]] = np.array([t * size for m in moves for t in m.values()], dtype=np.int32)
        self.table = table.reshape(-1)


class Model:
    def __init__(self, samples: list[tuple[str, str]]):
        """``samples``: (language, labelled text), one per language, in the order of names."""
        self.languages = [lang for lang, _ in samples]
        clean = [text.lower() for _, text in samples]
        points, counts = np.unique(np.array([ord(c) for t in clean for c in t if c.isalpha()], dtype=np.int64), return_counts=True)
        common = points[np.lexsort((points, -counts))][:LETTERS]
        self.lookup = np.zeros(0x110000, dtype=np.uint8)
        self.lookup[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
        self.lookup[common] = np.arange(2, 2 + len(common))
        self.size = 2 + len(common)
        self.automata = [Automaton(self.symbols(t), self.size).table for t in clean]

    def symbols(self, text: str) -> np.ndarray:
        """0 is a blank, 1 a rare letter."""
        return self.lookup[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text needs in each language."""
        pieces = [(i, t[a:a + SEGMENT]) for i, t in enumerate(texts) for a in range(0, len(t), SEGMENT)]
        pieces.sort(key=lambda p: -len(p[1]))
        out = np.zeros((len(texts), len(self.automata)))
        if not pieces:
            return out
        owner = np.array([i for i, _ in pieces])
        sizes = np.array([len(p) for _, p in pieces])
        grid = np.zeros((sizes[0], len(pieces)), dtype=np.int32)
        for lane, (_, p) in enumerate(pieces):
            grid[:len(p), lane] = p
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # lanes longer than the step
        for k, table in enumerate(self.automata):
            # The first character begins a phrase although it is reached without a break.
            at, ends = np.zeros(len(pieces), dtype=np.int32), np.ones(len(pieces), dtype=np.int64)
            for step, n in enumerate(active.tolist()):
                move = table[at[:n] + grid[step, :n]]
                ends[:n] += move >> 30
                at[:n] = move & (NEW_PHRASE - 1)
            out[:, k] = np.bincount(owner, weights=ends, minlength=len(texts))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        found = [(i, s) for i, t in enumerate(texts) if t and (s := self.symbols(t.lower())).any()]
        if not found:
            return langs, scores
        rates = self.phrases([s for _, s in found]) / np.array([[len(s)] for _, s in found])
        best = rates.argmin(axis=1)
        weight = np.exp(SHARPNESS * (rates.min(axis=1, keepdims=True) - rates))
        share = 1 / weight.sum(axis=1)
        for (i, _), b, s in zip(found, best.tolist(), share.tolist()):
            langs[i], scores[i] = self.languages[b], s
        return langs, scores


@functools.lru_cache(maxsize=2)
def _model(packed: bytes) -> Model:
    return Model(pickle.loads(packed))


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """A bounded text per language from documents outside the held-out fifth, chosen by a hash of doc_id."""
    usable = docs.where(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 5) != HELD_OUT))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()  # one row per language
    if not counts:
        return []
    chosen = None
    for lang, n in counts:
        rule = (F.col("lang") == lang) & hash_share(F.col("doc_id"), sample_rows, n)
        chosen = rule if chosen is None else chosen | rule
    # The least text of a doc_id, so copies of one row cannot swell the sample.
    rows = usable.where(chosen).select("lang", "doc_id", F.substring("text", 1, ROW_CHARS).alias("text")).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    texts: dict[str, str] = {}
    for row in sorted(rows.collect(), key=lambda r: (r.lang, r.doc_id)):
        texts[row.lang] = (texts.get(row.lang, "") + "\n" + (row.text or ""))[:LANGUAGE_CHARS]
    return [(lang, text) for lang, text in sorted(texts.items()) if any(map(str.isalpha, text))]


def identify(docs: DataFrame, samples: list[tuple[str, str]]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; only the text is looked at."""
    packed = pickle.dumps(samples)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = _model(packed).predict(text_list(batch.column(2)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    key = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == HELD_OUT, F.lit(False)).alias("held_out")
    return map_slices(docs.select("doc_id", held_out, "text"), run, f"doc_id {key}, held_out boolean, lang_pred string, score double", rows=2048)
