import pickle

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F
from shapes import awkward, empty
from spotloom.llm import bpe, chat, tokenscan
from spotloom.session import scratch_path

SF = "/root/testdata/sf0.001"
TOKENIZER = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def write_files(spark, tmp_path, files, width="<u2"):
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, dtype=width).tobytes())
    return str(tmp_path)


@pytest.mark.parametrize("width", ["<u2", "<u4"])
def test_counts_across_blocks(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(tokenscan, "GROUP", 3)
    rng = np.random.default_rng(1)
    files = {f"f{n}": rng.choice([0, 5, 6, 7, 0x100, 0x2000], 500, p=[0.02, 0.2, 0.2, 0.2, 0.19, 0.19]) for n in range(3)}
    files |= {"empty": [], "none": [5] * 40, "ends": [0, 0, 0], "long": [9] * 300 + [0, 4, 4, 0]}
    folder = write_files(spark, tmp_path, files, width)
    rows = tokenscan.count_tokens(spark, folder, width=width, block=16).collect()
    got = sorted((r.file.rsplit("/", 1)[1], r.doc_no, r.n_tokens, r.complete) for r in rows)
    want = []
    for name, ids in files.items():
        n = no = 0
        for i in ids:
            if i == 0:
                want.append((name, no, n, True))
                n, no = 0, no + 1
            else:
                n += 1
        want += [(name, no, n, False)] * (n > 0)
    assert got == sorted(want)


def test_partial_id_is_an_error(spark, tmp_path):
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="no token file"):
        tokenscan.count_tokens(spark, str(tmp_path)).collect()


def test_written_files_and_query(spark):
    from spotloom.llm.queries import QUERIES

    coder = bpe.codec(*TOKENIZER)
    want = {r.doc_id: len(coder.encode(r.text)) // 4 for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op5_token_counts"](spark, SF).collect()} == want
    folder = scratch_path(spark, "tokens")
    tokenscan.write_token_files(awkward(spark), folder, *TOKENIZER)
    got = sorted(r.n_tokens for r in tokenscan.count_tokens(spark, folder).collect())
    assert got == sorted(len(coder.encode(r.text or "")) // 4 for r in awkward(spark).collect())
    folder = scratch_path(spark, "tokens")
    tokenscan.write_token_files(empty(spark), folder, *TOKENIZER)
    assert tokenscan.count_tokens(spark, folder).count() == 0


def test_markers_and_features():
    assert chat.marker_of("Human: hi") == (1, "hi") and chat.marker_of("[AI]: yes") == (2, "yes")
    assert chat.marker_of("Note: this") == (3, "Note: this") and chat.marker_of("") == (3, "")


def test_path_is_the_best_path():
    model = chat.Model([chat.label([("user", "User: what?"), ("assistant", "Assistant: a\nb\nc"), ("user", "more?")])])
    lines = ["User: what?", "Assistant: x", "y", "and?"]
    seen = np.array([chat.features(line, i == 0)[0] for i, line in enumerate(lines)])
    scores, n = model.scores(seen), len(chat.STATES)
    best = max((model.start[a] + scores[0, a] + model.move[a, b] + scores[1, b] + model.move[b, c] + scores[2, c] + model.move[c, d] + scores[3, d], -a, -b, -c, -d)
               for a in range(n) for b in range(n) for c in range(n) for d in range(n))
    path = model.path(seen, None, None)
    total = model.start[path[0]] + scores[0, path[0]] + sum(model.move[path[i], path[i + 1]] + scores[i + 1, path[i + 1]] for i in range(3))
    assert abs(total - best[0]) < 1e-9


def whole(model, texts):
    """Turns of one transcript from its single best path."""
    lines = [line for t in texts for line in (t or "").split("\n")]
    made = [chat.features(line, i == 0) for i, line in enumerate(lines)]
    turns = []
    for state, (_, rest) in zip(model.path(np.array([f for f, _ in made]), None, None), made):
        role, begins = chat.STATES[state]
        if begins or not turns:
            turns.append([role, [rest]])
        else:
            turns[-1][1].append(rest)
    return [(n + 1, role, "\n".join(part)) for n, (role, part) in enumerate(turns)]


def test_blocks_give_the_path_of_the_whole(spark, monkeypatch):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    one = turns.select(F.lit(-1).cast("bigint").alias("conv_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("turn"), "role", "text")
    rows = chat.transcripts(turns.unionByName(one), F.col("turn") % 3 != 1)
    packed = chat.learn(rows)
    model = chat.Model(pickle.loads(packed))
    by = {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn, r.text)):
        by.setdefault(r.conv_id, []).append(r.text)
    want = sorted((c, *t) for c, texts in by.items() for t in whole(model, texts))
    monkeypatch.setattr(chat, "BLOCK", 4)
    got = sorted((r.conv_id, r.turn_no, r.role, r.text) for r in chat.parse(rows, packed).collect())
    assert got == want


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", "hello?", 7), (1, None, "assistant", None, 7), (1, 1, None, "", 7), (None, 0, "user", "a", 7), (None, 0, "user", "a", 7), (2, 0, "robot", "x" * 100_000, 7), (2, 0, "user", "tie", 7), (2, 0, "user", "tie", 7)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, block int")
    shown = chat.transcripts(table, F.lit(True))
    got = chat.parse(shown, chat.learn(shown)).collect()
    text = "".join(r.text for r in got)
    assert text.count("x") == 100_000 and text.count("tie") == 2
    assert sum(r.conv_id is None for r in got) == 2
    assert all(r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>" for r in got)
    assert chat.parse(shown.where("false"), chat.learn(shown.where("false"))).count() == 0


def test_counts_find_their_documents_over_many_files(spark, tmp_path):
    from spotloom.llm.queries import QUERIES

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text"))
    rows.repartition(7, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    coder = bpe.codec(*TOKENIZER)
    want = {r.doc_id: len(coder.encode(r.text)) // 4 for r in rows.collect()}
    kept = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = QUERIES["op5_token_counts"](spark, str(tmp_path))
        assert {r.doc_id: r.n_tokens for r in found.collect()} == want
        assert spark.read.parquet(str(tmp_path / "documents.parquet")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", kept)


def test_token_counts_when_the_second_scan_is_cut_otherwise(spark, tmp_path):
    from spotloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(2)
    docs.write.option("parquet.block.size", 20_000).option("parquet.page.size", 2_000).option("parquet.page.row.count.limit", 20).parquet(str(tmp_path / "documents.parquet"))
    coder = bpe.codec(*TOKENIZER)
    want = {r.doc_id: len(coder.encode(r.text)) // 4 for r in docs.collect()}
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = [spark.conf.get(n) for n in names]
    cuts = lambda: spark.read.parquet(str(tmp_path / "documents.parquet")).rdd.getNumPartitions()
    try:
        for n, value in zip(names, ("40000", "1")):
            spark.conf.set(n, value)
        first = cuts()
        found = QUERIES["op5_token_counts"](spark, str(tmp_path))  # writes the token files
        for n, value in zip(names, kept):
            spark.conf.set(n, value)
        assert cuts() != first > 3
        assert {r.doc_id: r.n_tokens for r in found.collect()} == want
    finally:
        for n, value in zip(names, kept):
            spark.conf.set(n, value)
