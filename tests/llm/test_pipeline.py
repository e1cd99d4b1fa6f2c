"""Each stage against a plain version on its own input, and the edge cases of all."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from shapes import awkward
from spotloom.llm import bpe, decontam, quality
from spotloom.session import stage
from test_linededup import plain

SF = "/root/testdata/sf0.001"


def shingles(text):
    """Distinct runs of five words in lower case; the whole text if it is shorter."""
    words = text.encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(sets):
    """Least document reachable over links of Jaccard similarity 0.8 or more, and over equal sets."""
    head = {i: i for i in sets}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] == sets[j] or both and both >= 0.8 * either:
                a, b = sorted((root(i), root(j)))
                head[b] = a
    return {i: root(i) for i in ids}


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    score = quality.learn(docs, labels).scorer()
    good = stage(steps["quality classifier"](spark, docs, SF))
    assert sorted(map(tuple, good.collect())) == sorted(tuple(r) for r in docs.collect() if score(r.text) >= 0.5)

    lines = stage(steps["line dedup"](spark, good, SF))
    want = plain(sorted((r.doc_id, r.text) for r in good.collect()))
    assert {r.doc_id: r.text for r in lines.collect()} == {i: t for i, (_, t) in want.items()}
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    apart = stage(steps["SimHash near-dedup"](spark, lines, SF))
    sets = {r.doc_id: shingles(r.text) for r in lines.collect()}
    heads = set(plain_components(sets).values())
    assert len(heads) < len(sets)
    assert sorted(map(tuple, apart.collect())) == sorted(tuple(r) for r in lines.collect() if r.doc_id in heads)

    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stage(steps["benchmark decontamination"](spark, apart, SF))
    exact = {r.doc_id for r in apart.collect() if any(i in decontam.normal(r.text) for i in items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in apart.collect()} - exact

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    last = steps["byte-level BPE"](spark, clean, SF).collect()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id: (r.n_tokens, r.decoded) for r in last} == {i: (len(library.encode_ordinary(t)), t) for i, t in texts.items()}
    for frame in (good, lines, apart, clean):
        assert frame.columns == names
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(texts)


def test_stages_take_awkward_and_empty_tables(spark):
    docs = awkward(spark).selectExpr("*", "cast(length(text) AS bigint) AS n_chars")
    for table in (docs, docs.where("false")):
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = stage(step(spark, table, SF))
            assert out.columns == docs.columns, name
            assert out.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == table.count()
