"""Personal data: rules, and a character-level bidirectional LSTM with a CRF on top (operator 8).

Four kinds are looked for: email, ip, card, phone. The rules find the well-formed ones; their spans always stay. A
network trained in numpy on windows with labelled spans then adds spans in other spellings. Each window holds ``WINDOW``
characters and overlaps its neighbours by half; labels are decoded by Viterbi over begin / inside labels with learned
transitions. Where windows overlap, a character belongs to the window in which it lies farther from the edge, and the
labels of the whole text so put together are read as spans. Added spans must not touch a rule's span.

A span that is added must hold a digit or an at sign, as every kind does by definition, and has at most half a window
of characters. So only windows near such a character can add one, and only they are computed; the result is that of
computing all windows (``everywhere=True`` does so, and a test compares the two).

Edge cases: null and empty texts have no spans. Repeated rows are treated each by itself. Without training windows (no
labelled span in the table) only the rules speak. Offsets are code points, the end exclusive. An empty table gives an
empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotloom.llm.common import hash_share, map_slices, text_list

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # 0 outside, 2 k + 1 begins kind k, 2 k + 2 goes on
WINDOW = 128
#: Bounds of the training sample: rows with labelled spans, and windows.
SAMPLE_ROWS, SAMPLE_WINDOWS = 400, 900
HIDDEN = 12

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behind only spares starts inside a run of digits, where the leftmost match cannot begin.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches: from each at sign back over its local part, so a long word costs its length once."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        if at >= floor:
            start = at
            while start > floor and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            found = _DOMAIN.match(text, at) if start < at else None
            if found:
                yield start, found.end()
                floor = found.end()
        at = text.find("@", at + 1)


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the well-formed data, by start and kind."""
    spans = []
    if "@" in text:
        spans += [(a, 0, b) for a, b in _emails(text)]
    if _ANCHOR.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def symbols(text: str) -> np.ndarray:
    """Classes of characters: most printable ASCII by itself, digits as one, other letters, other space, the rest."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return _TABLE[np.minimum(codes, len(_TABLE) - 1)]


def _table() -> np.ndarray:
    table = np.full(0x251, 3, dtype=np.int64)
    for c in range(len(table) - 1):
        ch = chr(c)
        table[c] = 1 if ch.isdigit() else 2 if ch.isspace() else 4 + c - 33 if 33 <= c < 127 else 3
    return table


_TABLE = _table()
SYMBOLS = 98


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters, forward pass, Viterbi and training. Arrays are (time, lane, feature)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, scale = HIDDEN, 0.3
        self.p = {"trans": np.zeros((LABELS, LABELS)), "out": rng.normal(0, scale, (2 * h, LABELS)), "bias": np.zeros(LABELS)}
        for side in "fb":
            self.p[side + "in"] = rng.normal(0, scale, (SYMBOLS, 4 * h))
            self.p[side + "rec"] = rng.normal(0, scale, (h, 4 * h))
        self.p["bias"][0] = 2.0

    def _side(self, side: str, x: np.ndarray, keep: bool):
        steps, lanes = x.shape
        h = HIDDEN
        given, rec = self.p[side + "in"], self.p[side + "rec"]
        hidden, cell = np.zeros((lanes, h), given.dtype), np.zeros((lanes, h), given.dtype)
        out, saved = np.empty((steps, lanes, h), given.dtype), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gates = given[x[t]] + hidden @ rec
            i, f, o = _sigmoid(gates[:, :h]), _sigmoid(gates[:, h:2 * h] + 1), _sigmoid(gates[:, 2 * h:3 * h])
            g = np.tanh(gates[:, 3 * h:])
            before, previous = cell, hidden
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            hidden = o * squashed
            out[t] = hidden
            if keep:
                saved.append((t, i, f, o, g, before, squashed, previous))
        return out, saved

    def emissions(self, x: np.ndarray, keep: bool = False):
        forward, fs = self._side("f", x, keep)
        backward, bs = self._side("b", x, keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.p["out"] + self.p["bias"], both, fs, bs

    def _back(self, side: str, x, saved, into, grads) -> None:
        h, rec = HIDDEN, self.p[side + "rec"]
        later_h = later_c = 0.0
        for t, i, f, o, g, before, squashed, previous in reversed(saved):
            dh = into[t] + later_h
            dc = dh * o * (1 - squashed ** 2) + later_c
            d = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g ** 2)], axis=1)
            np.add.at(grads[side + "in"], x[t], d)
            grads[side + "rec"] += previous.T @ d
            later_h, later_c = d @ rec.T, dc * f

    def step(self, x: np.ndarray, y: np.ndarray):
        """Loss (negative log likelihood a window) and gradients of all parameters."""
        emit, both, fs, bs = self.emissions(x, keep=True)
        trans = self.p["trans"]
        steps, lanes, _ = emit.shape

        def total(a, axis):
            top = a.max(axis=axis, keepdims=True)
            return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0]
        for t in range(1, steps):
            alpha[t] = total(alpha[t - 1][:, :, None] + trans, 1) + emit[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = total(trans[None] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        z = total(alpha[-1], 1)
        lane = np.arange(lanes)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        d_emit = np.exp(alpha + beta - z[None, :, None])
        gold = np.zeros(lanes)
        for t in range(steps):
            gold += emit[t, lane, y[t]]
            d_emit[t, lane, y[t]] -= 1
            if t:
                gold += trans[y[t - 1], y[t]]
                grads["trans"] += np.exp(alpha[t - 1][:, :, None] + trans + (emit[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
                np.add.at(grads["trans"], (y[t - 1], y[t]), -1)
        grads["out"] = np.einsum("tlh,tlk->hk", both, d_emit)
        grads["bias"] = d_emit.sum(axis=(0, 1))
        into = d_emit @ self.p["out"].T
        self._back("f", x, fs, into[:, :, :HIDDEN], grads)
        self._back("b", x, bs, into[:, :, HIDDEN:], grads)
        return float((z - gold).mean()), {k: g / lanes for k, g in grads.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam over shuffled batches; ``x`` and ``y`` are (window, time)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, n, steps = [], 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                take = order[at:at + batch]
                loss, grads = self.step(x[take].T, y[take].T)
                losses.append(loss)
                n += 1
                now = rate * (1 - 0.9 * n / steps)
                for k, g in grads.items():
                    g = np.clip(g, -5, 5)
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.005 * (g * g - s[k])
                    self.p[k] -= now * (m[k] / (1 - 0.9 ** n)) / (np.sqrt(s[k] / (1 - 0.995 ** n)) + 1e-8)
        return losses

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best labels of windows (time, lane)."""
        emit = self.emissions(x)[0]
        trans, steps = self.p["trans"], len(emit)
        back = np.empty(emit.shape, dtype=np.int8)
        score = emit[0]
        for t in range(1, steps):
            paths = score[:, :, None] + trans
            back[t] = paths.argmax(axis=1)
            score = paths.max(axis=1) + emit[t]
        out = np.empty(emit.shape[:2], dtype=np.int8)
        out[-1] = score.argmax(axis=1)
        lane = np.arange(emit.shape[1])
        for t in range(steps - 1, 0, -1):
            out[t - 1] = back[t, lane, out[t]]
        return out


def windows(n: int) -> list[int]:
    """Starts of the windows of a text of n characters: half a window apart."""
    return list(range(0, max(1, n - WINDOW // 2), WINDOW // 2))


def _spans(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans that begin / inside labels spell; an inside label without its begin begins a span."""
    spans, inside = [], np.flatnonzero(labels)
    start = kind = last = None
    for i in inside.tolist():
        k, begins = (int(labels[i]) - 1) // 2, labels[i] % 2 == 1
        if start is not None and i == last + 1 and k == kind and not begins:
            last = i
            continue
        if start is not None:
            spans.append((start, kind, last + 1))
        start, kind, last = i, k, i
    if start is not None:
        spans.append((start, kind, last + 1))
    return spans


def found_spans(texts: list[str], network: Network | None, everywhere: bool = False, lanes: int = 512):
    """For each text its rule spans and all spans, by start and kind."""
    rules = [rule_spans(t) for t in texts]
    if network is None:
        return [(r, r) for r in rules]
    jobs = []
    for n, text in enumerate(texts):
        if everywhere:
            jobs += [(n, a) for a in windows(len(text))]
        else:
            starts, half = len(windows(len(text))), WINDOW // 2
            hit = {w for m in _ANCHOR.finditer(text) for w in (m.start() // half - 1, m.start() // half)}
            # A span may leave the window that holds its anchor: the neighbours are computed too.
            hit = {v for w in hit for v in (w - 1, w, w + 1)}
            jobs += [(n, w * half) for w in sorted(hit) if 0 <= w < starts]
    labels: dict[int, np.ndarray] = {}
    coded: dict[int, np.ndarray] = {}
    for at in range(0, len(jobs), lanes):
        group = jobs[at:at + lanes]
        x = np.zeros((WINDOW, len(group)), dtype=np.int64)
        for lane, (n, a) in enumerate(group):
            if n not in coded:
                coded = {n: symbols(texts[n])}
            part = coded[n][a:a + WINDOW]
            x[:len(part), lane] = part
        found = network.decode(x)
        for lane, (n, a) in enumerate(group):
            size = len(texts[n])
            if n not in labels:
                labels[n] = np.zeros(size, dtype=np.int8)
            # The middle half is this window's own; at the ends of the text the margin is too.
            low = 0 if a == 0 else WINDOW // 4
            high = WINDOW if a + WINDOW >= size else 3 * WINDOW // 4
            high = min(high, size - a)
            labels[n][a + low:a + high] = found[low:high, lane]
    out = []
    for n, (text, base) in enumerate(zip(texts, rules)):
        added = []
        if n in labels:
            for start, kind, end in _spans(labels[n]):
                if end - start > WINDOW // 2:
                    continue
                while start < end and text[start] in " \t\n":
                    start += 1
                while end > start and text[end - 1] in " \t\n.,;":
                    end -= 1
                if _plausible(text[start:end], kind) and not any(s < end and start < e for s, _, e in base):
                    added.append((start, kind, end))
        out.append((base, sorted(base + added)))
    return out


def _plausible(piece: str, kind: int) -> bool:
    """What every spelling of a kind has: an email a separator between two names, a number enough digits."""
    digits = sum(c.isdigit() for c in piece)
    if kind == 0:
        return len(piece) >= 6 and ("@" in piece)
    return digits >= (4, 12, 7)[kind - 1] and digits <= (12, 19, 15)[kind - 1]


def training_windows(texts: list[str], seed: int = 11, limit: int = SAMPLE_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Windows around labelled spans, as they are and with the spans spelt otherwise, and windows without spans.

    Other spellings: no country code, dots or blanks for the separators of phones and cards, blanks around the at sign
    or the dots of an email, brackets around the dots of an address. Lookalikes without meaning stay unlabelled: hex
    strings, long plain numbers, dates and decimals.
    """
    rng = np.random.default_rng(seed)
    x, y = [], []

    def spell(piece: str, kind: int) -> str:
        way = int(rng.integers(5))
        if kind == 0:
            return (piece, piece.replace("@", " @ "), piece.replace(".", " . "), piece.replace("@", "(@)"), piece.upper())[way]
        if kind == 1:
            return (piece, piece.replace(".", "[.]"), piece.replace(".", " . "), piece, piece.replace(".", "(.)"))[way]
        if kind == 2:
            digits = re.sub("[^0-9]", "", piece)
            fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
            return (piece, ".".join(fours), " ".join(fours), "/".join(fours), "-".join(fours))[way]
        short = re.sub(r"^\+[0-9]+[ -]?", "", piece)
        return (piece, short, re.sub("[() ]+", ".", short).strip("."), re.sub("[()]", "", short), re.sub("[() ]+", "-", short).strip("-"))[way]

    def noise() -> str:
        way = int(rng.integers(5))
        if way == 0:
            return "".join(rng.choice(list("0123456789abcdef"), int(rng.integers(16, 41))))
        if way == 1:
            return "".join(rng.choice(list("0123456789"), int(rng.integers(1, 7))))
        if way == 2:
            return f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
        if way == 3:
            return f"{rng.integers(0, 1000)}.{rng.integers(0, 100)}"
        return f"{rng.integers(0, 24)}:{rng.integers(0, 60):02d}"

    def add(text: str, spans: list[tuple[int, int, int]]) -> None:
        codes, labels = np.zeros(WINDOW, dtype=np.int64), np.zeros(WINDOW, dtype=np.int64)
        part = symbols(text)[:WINDOW]
        codes[:len(part)] = part
        for a, kind, b in spans:
            labels[a:min(b, WINDOW)] = 2 * kind + 2
            if a < WINDOW:
                labels[a] = 2 * kind + 1
        x.append(codes)
        y.append(labels)

    for text in texts:
        for start, kind, end in rule_spans(text):
            piece = text[start:end]
            for other in (piece, spell(piece, kind), spell(piece, kind)):
                left = text[max(0, start - int(rng.integers(4, 90))):start]
                spans = [(a, k, b) for a, k, b in rule_spans(left)]
                add(left + other + text[end:end + WINDOW], [*spans, (len(left), kind, len(left) + len(other))])
            clear = [a for a in range(0, max(1, len(text) - 60), 60) if not _ANCHOR.search(text[a:a + 60])]
            if clear:
                a = clear[int(rng.integers(len(clear)))]
                cut = int(rng.integers(5, 55))
                add(text[a:a + cut] + " " + noise() + " " + text[a + cut:a + 60], [])
    take = rng.permutation(len(x))[:limit]
    shape = (-1, WINDOW)
    return np.array(x, dtype=np.int64).reshape(shape)[take], np.array(y, dtype=np.int64).reshape(shape)[take]


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> bytes:
    """Trained network, packed; empty if the table has no labelled span.

    The labelled spans are those of the rules, in about ``sample_rows`` texts that hold an at sign or a run of ten
    figures and blanks, chosen by a hash of doc_id.
    """
    likely = docs.where(F.col("text").rlike(r"@|[0-9](?:[\x20().-]*[0-9]){9}")).select("doc_id", "text")
    n = likely.agg(F.approx_count_distinct("doc_id")).first()[0]
    rows = likely.where(hash_share(F.col("doc_id"), sample_rows, n)).groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = [r.text for r in rows.orderBy(F.col("doc_id").asc_nulls_last(), "text").collect()]
    x, y = training_windows(texts)
    if not len(x):
        return b""
    network = Network()
    network.fit(x, y)
    network.p = {k: v.astype(np.float32) for k, v in network.p.items()}
    return pickle.dumps(network)


@functools.lru_cache(maxsize=2)
def _network(packed: bytes) -> Network | None:
    return pickle.loads(packed) if packed else None


def find(docs: DataFrame, packed: bytes) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, stop) of the rules and of rules and network together."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = found_spans(text_list(batch.column(1)), _network(packed))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("stop", pa.int32())]))
        rows = lambda side: pa.array([[{"start": a, "kind": KINDS[k], "stop": b} for a, k, b in f[side]] for f in found], kind)
        return pa.RecordBatch.from_arrays([batch.column(0), rows(0), rows(1)], names=["doc_id", "base", "spans"])

    key = docs.schema["doc_id"].dataType.simpleString()
    span = "array<struct<start: int, kind: string, stop: int>>"
    return map_slices(docs.select("doc_id", "text"), run, f"doc_id {key}, base {span}, spans {span}")
