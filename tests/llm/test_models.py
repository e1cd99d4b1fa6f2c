import re
import zlib

import numpy as np

from shapes import awkward, empty
from spotloom.llm import langid, pii, quality

SF = "/root/testdata/sf0.01"


def test_phrases_against_plain_parsing():
    rng = np.random.default_rng(1)
    train = "".join(rng.choice(list("abcd "), 400))
    model = langid.Model([("x", train), ("y", "dede fgh" * 20)])
    known = model.symbols(train.lower()).tobytes()
    for text in ("abcdabcd", "zzz", "a", "".join(rng.choice(list("abcdz "), 300)), "dcba" * 50):
        codes = model.symbols(text)
        count, i = 0, 0
        while i < len(codes):
            j = i + 1
            while j <= len(codes) and codes[i:j].tobytes() in known:
                j += 1
            count, i = count + 1, max(i + 1, j - 1)
        assert model.phrases([codes])[0, 0] == count


def test_languages_are_found_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in langid.identify(docs, langid.learn(docs)).collect() if r.held_out]
    assert {r.doc_id for r in rows} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark):
    table = awkward(spark)
    rows = langid.identify(table, langid.learn(table)).collect()
    assert len(rows) == 10
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (2, 3, 7)} == {2: "und", 3: "und", 7: "und"}
    assert {r.lang_pred for r in rows} <= {"en", "und"} and all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(empty(spark), langid.learn(empty(spark))).count() == 0
    assert {r.lang_pred for r in langid.identify(table, []).collect()} == {"und"}


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.score_documents(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]) > 0.95
    assert quality.keep_good(docs, model).count() == sum(r.predicted for r in rows)


def test_quality_score_equals_the_unfolded_network():
    texts = ["good words here", "BAD!! WORDS!!", "good good good", "more good words"] * 5
    model = quality.train(texts, [1, 0, 1, 1] * 5)
    for text in ("good BAD!! words", "", "x", "ü ü"):
        ids, share = quality._counts(text)
        logit = model.bias + float(share @ model.values[ids])
        assert abs(model.scorer()(text) - 1 / (1 + np.exp(-logit))) < 1e-6
    assert model.scorer()("good words") > 0.5 > model.scorer()("BAD!! WORDS!!")


def test_quality_of_awkward_rows(spark):
    table = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, None, 0), (None, 1, 0), (99, 1, 0), (5, 7, 0)], "doc_id bigint, quality int, text int")
    model = quality.learn(table, labels)
    rows = quality.score_documents(table, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score_documents(table, quality.learn(table, labels.where("false"))).collect()} == {0.5}
    assert quality.keep_good(empty(spark), model).count() == 0
    assert quality.keep_good(table, model).columns == table.columns


RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
)


def plain_rules(text):
    return sorted((m.start(), k, m.end()) for k, (_, pattern, passes) in enumerate(RULES) for m in re.finditer(pattern, text) if passes(m.group()))


def test_rules_against_the_patterns():
    rng = np.random.default_rng(6)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "+1 (743) 555-3824", "4994226020900891", "4994 2260 2090 0891", " ", "x", "+", "9", "a.b@c-d.e.f", "@@", "-", "1.2.3.4.5.6.7.8.9", "é", "00012.1.1.1"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 9)))
        assert pii.rule_spans(text) == plain_rules(text)
    assert pii.rule_spans("a" * 200_000 + "1" * 200_000) == []


def test_gradients_and_exact_decoding():
    net, rng = pii.Network(), np.random.default_rng(0)
    x, y = rng.integers(0, pii.SYMBOLS, (6, 3)), rng.integers(0, pii.LABELS, (6, 3))
    _, grads = net.step(x, y)
    for name, g in grads.items():
        at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        kept, ends = net.p[name][at], []
        for move in (1e-5, -1e-5):
            net.p[name][at] = kept + move
            ends.append(net.step(x, y)[0])
        net.p[name][at] = kept
        assert abs(g[at] - (ends[0] - ends[1]) / 2e-5) < 1e-5
    emit = net.emissions(x[:3])[0]
    best = net.decode(x[:3])
    for lane in range(3):
        paths = [(emit[0, lane, a] + emit[1, lane, b] + emit[2, lane, c] + net.p["trans"][a, b] + net.p["trans"][b, c], (a, b, c)) for a in range(9) for b in range(9) for c in range(9)]
        assert tuple(best[:, lane]) == max(paths)[1]


def test_pii_windows_spared_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = pii._network(pii.learn(docs))
    texts = [r.text for r in docs.limit(60).collect()] + ["call 743.555.3824 now " * 9, "mail me at ann @ mail.example.org or not", "x" * 500 + " 4994 2260 2090 0891 " + "y" * 500]
    spared, full = pii.found_spans(texts, network), pii.found_spans(texts, network, everywhere=True)
    assert spared == full
    for text, (base, spans) in zip(texts, spared):
        assert base == plain_rules(text) and set(base) <= set(spans)


def test_pii_of_awkward_rows(spark):
    rows = pii.find(awkward(spark), pii.learn(awkward(spark))).collect()
    assert len(rows) == 10
    assert {r.doc_id: [tuple(s) for s in r.base] for r in rows}[8] == [(16, "email", 31)]
    assert all(r.spans == [] for r in rows if r.doc_id in (2, 3, 7))
    assert pii.find(empty(spark), pii.learn(empty(spark))).count() == 0
