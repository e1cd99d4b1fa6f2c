import random

from shapes import LONG, awkward, empty
from spotloom.llm import decontam


def distance(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != c))
    return min(row)


def change(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, way = rng.randrange(len(out)), rng.randrange(3)
        if way == 0:
            out[at] = rng.choice("abcxyz")
        elif way == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("abcxyz"))
    return "".join(out)


def test_against_plain_edit_distance():
    rng = random.Random(4)
    words = ["the", "ing", "and", "on", "tion", "er"]
    text = lambda n: decontam.normal(" ".join("".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(n)))
    items = [(n, text(12)) for n in range(6)]
    matcher = decontam.Matcher(items, 0.1)
    hits = 0
    for _ in range(60):
        body = text(30)
        if rng.random() < 0.7:
            _, item = rng.choice(items)
            at = rng.randrange(len(body))
            body = decontam.normal(body[:at] + " " + change(rng, item, rng.randint(0, len(item) // 8)) + " " + body[at:])
        found = {key: d for key, d, *_ in matcher.find(body)}
        want = {key: distance(item, body) for key, item in items}
        assert found == {key: d for key, d in want.items() if d <= int(0.1 * len(dict(items)[key]))}
        for key, d, start, stop in matcher.find(body):
            assert distance(dict(items)[key], body[start:stop]) == d
        hits += len(found)
    assert hits > 20


def test_many_repeats_stay_cheap_and_right():
    item = "he he he he he he he he he he he he"
    matcher = decontam.Matcher([(1, item)], 0.1)
    assert [h[:2] for h in matcher.find("he " * 20_000)] == [(1, 0)]
    assert matcher.find("ha " * 20_000) == []


def test_awkward_rows(spark, monkeypatch):
    items = spark.createDataFrame([(1, "one  TWO three four five six seven. A line", 0), (2, None, 0), (3, "  ", 0), (4, "stone river cloud stone river cloud", 0), (4, "stone river cloud stone river cloud", 0), (None, "nowhere to be found", 0)], "item_id bigint, text string, doc_id int")
    for size in (decontam.BLOCK_CHARS, 50):  # one block, and a block an item
        monkeypatch.setattr(decontam, "BLOCK_CHARS", size)
        found = sorted(tuple(r)[:3] for r in decontam.contaminated(awkward(spark), items).collect())
        assert found == [(1, 1, 0), (4, 4, 0), (4, 4, 0), (5, 4, 0), (5, 4, 0)]
        clean = decontam.decontaminate(awkward(spark), items)
        assert clean.columns == awkward(spark).columns
        assert sorted(r.doc_id or 0 for r in clean.collect()) == [0, 2, 3, 6, 6, 7, 8]
    assert decontam.contaminated(empty(spark), items).count() == 0
    assert decontam.contaminated(awkward(spark), items.where("false")).count() == 0
    assert decontam.decontaminate(awkward(spark), items.where("false")).count() == 10
    assert len(LONG) > 50_000
