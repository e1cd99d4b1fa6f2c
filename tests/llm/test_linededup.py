import random

from shapes import awkward, empty
from spotloom.llm import linededup

SF = "/root/testdata/sf0.001"


def pieces(text):
    """(first line, line after the last one) of chunks of several lines that are not blank, and of the least runs of
    lines with more than 50 words from and up to each line, by trying all of them."""
    lines, at, found = text.split("\n"), 0, set()
    for chunk in linededup.chunks(text) if text else ():
        if len(chunk) > 1 and "".join(chunk).strip():
            found.add((at, at + len(chunk)))
        at += len(chunk)
    words = [len(x.split()) for x in lines]
    for n in range(len(lines)):
        onward = next((b for b in range(n + 1, len(lines) + 1) if sum(words[n:b]) > 50), None)
        upto = next((a for a in range(n, -1, -1) if sum(words[a:n + 1]) > 50), None)
        found |= {(n, onward)} if onward else set()
        found |= {(upto, n + 1)} if upto is not None else set()
    return found


def plain(docs):
    """docs: (doc_id, text), in the order of places. Number of chunks that lost lines and what is left of each text."""
    places, out = {}, {}
    for doc, text in docs:
        for a, b in pieces(text):
            places.setdefault("\n".join(text.split("\n")[a:b]), []).append((doc is None, doc or 0, a, b))
    gone = {}
    for found in places.values():
        first = min(found)
        for place in found:
            if place != first:
                start = max(place[2], first[3]) if place[:2] == first[:2] else place[2]
                gone.setdefault(place[:2], set()).update(range(start, place[3]))
    for doc, text in docs:
        drop, at, hit = gone.get((doc is None, doc or 0), set()), 0, 0
        for chunk in linededup.chunks(text) if text else ():
            hit += any(n in drop for n in range(at, at + len(chunk)))
            at += len(chunk)
        out[doc] = (hit, "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drop) if hit else text)
    return out


def test_query_against_a_plain_version(spark):
    from spotloom.llm.queries import QUERIES

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: (r.chunks_removed, r.text) for r in QUERIES["op4_line_dedup"](spark, SF).collect()}
    assert got == plain(docs)
    assert sum(n for n, _ in got.values()) > 0


def test_boundaries_resist_shifts():
    rng = random.Random(1)
    lines = [f"line {rng.random()}" for _ in range(200)]
    whole = {"\n".join(c) for c in linededup.chunks("\n".join(lines))}
    shifted = {"\n".join(c) for c in linededup.chunks("\n".join(["new", *lines[:90], "another", *lines[90:]]))}
    assert len(whole - shifted) <= 4
    assert "\n".join("\n".join(c) for c in linededup.chunks("\n".join(lines))) == "\n".join(lines)


def test_run_hashes_depend_on_the_lines_alone():
    rng = random.Random(8)
    lines = [f"line {rng.randrange(12)}" for _ in range(400)]
    hashes = linededup._line_hashes(lines)
    runs = [(a, b) for a in range(0, 400, 3) for b in range(a + 1, min(a + 7, 400))]
    starts, stops = (linededup.np.array(c) for c in zip(*runs))
    by = {}
    for (a, b), h in zip(runs, linededup._run_hashes(hashes, starts, stops).tolist()):
        by.setdefault(tuple(lines[a:b]), set()).add(h)
    assert all(len(found) == 1 for found in by.values())
    assert len(set().union(*by.values())) == len(by) < len(runs)


def test_pieces_of_a_long_text_of_short_lines_take_little_memory():
    import tracemalloc

    text = "\n".join(f"ab {n % 1000}" for n in range(200_000))
    tracemalloc.start()
    found = linededup._pieces(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) > 200_000 and peak < 60e6, peak


def test_passage_between_own_lines(spark):
    passage = "\n".join(f"common line {i}" for i in range(40))
    rows = [(i, f"own start {i}\n{passage}\nown end {i}", "x") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, body string")
    got = {r.doc_id: r.text for r in linededup.deduplicate_lines(docs).collect()}
    assert got == {i: t for i, (_, t) in plain([(i, t) for i, t, _ in rows]).items()}
    assert got[0] == rows[0][1] and all(got[i] == f"own start {i}\nown end {i}" for i in range(1, 30))


def test_awkward_rows(spark):
    table = awkward(spark)
    out = linededup.deduplicate_lines(table)
    assert out.columns == table.columns
    # The long text is one line and occurs twice: it goes from its second place. No other row loses anything.
    want = [r if r.doc_id != 5 else r.asDict() | {"text": ""} for r in table.collect()]
    want = [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in want]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    twice = spark.createDataFrame([(1, "a\nb\nc\nd\ne\nf\ng\nh", 0)] * 2 + [(None, "a\nb\nc\nd\ne\nf\ng\nh", 0)], "doc_id bigint, text string, n int")
    texts = {r.doc_id: r.text for r in linededup.deduplicate_lines(twice).collect()}
    assert texts[1] == "a\nb\nc\nd\ne\nf\ng\nh" and len(texts[None]) < len(texts[1])
    assert linededup.deduplicate_lines(empty(spark), "gone").columns == [*table.columns, "gone"]
    assert linededup.deduplicate_lines(empty(spark)).count() == 0


def left_over(before, after, words=50):
    """Later, separate occurrences of maximal repeated runs of more than ``words`` words that still have a line.
    ``before``: (doc_id, text) in the order of places; ``after``: doc_id to text."""
    rows = [(doc, n, line) for doc, text in before for n, line in enumerate(text.split("\n"))]
    kept = {}
    for doc, text in before:  # lines of the result are a subsequence of the text's
        old, new, at, stays = text.split("\n"), after[doc].split("\n") if after[doc] else [], 0, []
        for line in old:
            stay = at < len(new) and new[at] == line
            at += stay
            stays.append(stay)
        assert at == len(new)
        kept[doc] = stays
    places = {}
    for at, (_, _, line) in enumerate(rows):
        places.setdefault(line, []).append(at)
    found = seen = 0
    for at, (doc, n, line) in enumerate(rows):
        for other in places[line]:
            if other >= at:
                break
            if other and n and rows[other][1] and rows[other - 1][2] == rows[at - 1][2]:
                continue  # not the start of a maximal run
            size = 0
            while at + size < len(rows) and rows[at + size][0] == doc and rows[other + size][0] == rows[other][0] and rows[at + size][2] == rows[other + size][2]:
                size += 1
            if other + size > at or sum(len(rows[at + k][2].split()) for k in range(size)) <= words:
                continue
            seen += 1
            found += any(kept[doc][n:n + size])
    return found, seen


def test_every_long_repeated_run_goes(spark):
    rng = random.Random(4)
    line = lambda words: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(words))
    runs = [[line(rng.choice((1, 8, 20, 30, 55))) for _ in range(size)] for size in (1, 2, 3, 4, 5, 9) for _ in range(8)]
    texts = []
    for _ in range(150):
        text = []
        for run in rng.sample(runs, 3):
            text += [line(7) for _ in range(rng.randrange(3))] + run[rng.randrange(2) and len(run) // 3:]
        texts.append("\n".join(text))
    texts += ["\n".join(runs[-1]), line(60), texts[0]]
    texts.append(texts[-2])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in linededup.deduplicate_lines(docs).collect()}
    found, seen = left_over(list(enumerate(texts)), got)
    assert seen > 300 and found == 0
    lines = lambda all_texts: {x for t in all_texts for x in t.split("\n") if x}
    assert lines(got.values()) == lines(texts)  # no line is lost everywhere
    again = "\n".join(["ten words of a line that comes again and again"] * 30)
    same = spark.createDataFrame([(1, again), (2, "other\n" + again)], "doc_id bigint, text string")
    texts = {r.doc_id: r.text for r in linededup.deduplicate_lines(same).collect()}
    assert texts[1] == "\n".join(again.split("\n")[:6]) and texts[2] == "other"


def test_equal_hashes_of_pieces_are_not_enough(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = linededup.piece_table
    monkeypatch.setattr(linededup, "piece_table", lambda docs: real(docs).withColumn("hash", F.lit(1).cast("long")))
    rows = [(i, "\n".join(f"line {n} of text {i} " + "word " * 20 for n in range(12))) for i in range(4)]
    out = linededup.deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == dict(rows)
