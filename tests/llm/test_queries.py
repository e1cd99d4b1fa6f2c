"""The registered queries, column by column, against plain versions on the smallest tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from spotloom.llm import bpe, decontam, langid, pii, quality
from spotloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_bpe_equals_the_library(spark, texts):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for doc, text in texts.items():
        ids = library.encode_ordinary(text or "")
        want[doc] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op7_bpe")} == want


def luhn(digits):
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))]
    return sum(doubled) % 10 == 0


def base_spans(text):
    """The patterns as they are written, leftmost and without overlaps per kind."""
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    found = [(m.start(), n, kind, m.end()) for n, (kind, pattern, fits) in enumerate(kinds) for m in re.finditer(pattern, text, re.ASCII) if fits(m.group())]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_pii_keeps_every_base_span(spark, texts):
    seen = 0
    for r in rows(spark, "op8_pii"):
        base = base_spans(texts[r.doc_id] or "")
        counts = Counter(kind for kind, *_ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.KINDS)
        shown = [f"{kind}:{a}:{b}" for kind, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert set(shown) <= {":".join(s) for s in spans}
        assert [(int(a), pii.KINDS.index(k)) for k, a, _ in spans] == sorted((int(a), pii.KINDS.index(k)) for k, a, _ in spans)
        assert all(0 <= int(a) < int(b) <= len(texts[r.doc_id]) for _, a, b in spans)
        seen += len(base)
    assert seen > 10


def test_pii_of_rows_without_an_id(spark):
    table = spark.createDataFrame([(None, "write to a.b@example.org or 10.0.0.1"), (1, "call +1 (555) 010-9999 now"), (None, "c@d.example"), (2, None)], "doc_id bigint, text string")
    got = {(r.doc_id, len(r.base)) for r in pii.find(table, pii.learn(table)).collect()}
    assert got == {(None, 2), (1, 1), (None, 1), (2, 0)}


def plain_phrases(text, sample):
    """Greedy longest matches of ``text`` in ``sample``; a symbol that the sample lacks is a phrase of its own."""
    count, at = 0, 0
    while at < len(text):
        size, place = 0, 0
        while at + size < len(text) and (place := sample.find(text[at:at + size + 1], place)) >= 0:
            size += 1
        at += max(1, size)
        count += 1
    return count


def test_language_equals_plain_cross_parsing(spark, texts):
    samples = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    model = langid.Model(samples)
    shown = lambda text: "".join(map(chr, model.symbols(text.lower()) + 33))
    learned = [shown(text) for _, text in samples]
    for r in rows(spark, "op3_language"):
        text = texts[r.doc_id] or ""
        assert r.held_out == (crc(r.doc_id, 5) == 0)
        if not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        parts = shown(text)
        pieces = [parts[i:i + langid.SEGMENT] for i in range(0, len(parts), langid.SEGMENT)]
        rates = [sum(plain_phrases(p, sample) for p in pieces) / len(parts) for sample in learned]
        best = int(np.argmin(rates))
        assert r.lang_pred == samples[best][0]
        assert r.score == pytest.approx(1 / sum(np.exp(langid.SHARPNESS * (rates[best] - x)) for x in rates))


def test_quality_equals_a_plain_average(spark, texts):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = []
    for r in rows(spark, "op9_quality"):
        words = (texts[r.doc_id] or "").split()
        values = [model.values[i] for w in words for i in quality.word_features(w)]
        values += [model.values[quality.REPEAT]] * sum(a == b for a, b in zip(words, words[1:]))
        want = 1 / (1 + np.exp(-(model.bias + (sum(values) / len(values) if values else 0.0))))
        assert r.score == pytest.approx(want, abs=1e-9)
        assert r.held_out == (crc(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.5)
        if r.held_out and truth.get(r.doc_id) is not None:
            right.append(r.predicted == truth[r.doc_id])
    assert np.mean(right) > 0.9


def least_distances(text, items):
    """Least edit distance of each item to any part of the text, all items side by side."""
    width = max(map(len, items))
    letters = np.full((len(items), width), -1, dtype=np.int32)
    for n, item in enumerate(items):
        letters[n, :len(item)] = [ord(c) for c in item]
    ends, along = np.array([len(i) for i in items]), np.arange(width + 1, dtype=np.int16)
    now = np.tile(along, (len(items), 1))
    best = ends.copy()
    for c in map(ord, text):
        new = np.zeros_like(now)
        new[:, 1:] = np.minimum(now[:, :-1] + (letters != c), now[:, 1:] + 1)
        now = np.minimum.accumulate(new - along, axis=1) + along
        best = np.minimum(best, now[np.arange(len(items)), ends])
    return best


def edit_distance(a, b):
    now = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, now = now, [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
    return now[-1]


def test_decontamination_equals_plain_edit_distances(spark, texts):
    items = {r.item_id: decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    items = {i: t for i, t in items.items() if t}
    found = {(r.doc_id, r.item_id): r for r in rows(spark, "op6_decontamination")}
    listed = list(items)
    want = {}
    for doc, text in texts.items():
        for item, distance in zip(listed, least_distances(decontam.normal(text or ""), [items[i] for i in listed])):
            if distance <= int(decontam.RATE * len(items[item])):
                want[doc, item] = distance
    assert {k: r.distance for k, r in found.items()} == want and len(want) >= 3
    for (doc, item), r in found.items():
        assert edit_distance(items[item], decontam.normal(texts[doc])[r.start:r.stop]) == r.distance


def test_chat_recovers_most_roles(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    got = {}
    for r in rows(spark, "op10_chat"):
        assert r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>"
        got.setdefault(r.conv_id, []).append((r.turn_no, r.role, r.text))
    assert set(got) == {t.conv_id for t in turns}
    lines, right = 0, 0
    for conv, found in got.items():
        assert [n for n, *_ in sorted(found)] == list(range(1, len(found) + 1))
        said = [(t.role, line) for t in turns if t.conv_id == conv for line in (t.text or "").split("\n")]
        heard = [(role, line) for _, role, text in sorted(found) for line in text.split("\n")]
        assert [line for _, line in said] == [line for _, line in heard]  # no line is lost
        lines += len(said)
        right += sum(a == b for a, b in zip(said, heard))
    assert right / lines > 0.8
