"""The edit-distance join against comparing all pairs, with parts that very many words share."""

import random

import pytest

from riskspark.operators import editjoin


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(seed, n, alphabet):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.3:
            w, at = r.choice(out), r.randrange(12)
            w = r.choice([w[:at] + r.choice(alphabet) + w[at:], w[:at] + w[at + 1 :], w[:at] + r.choice(alphabet) + w[at + 1 :]])
        else:
            w = r.choice(["common", "common-prefix-", "", "aaaa"]) + "".join(r.choices(alphabet, k=r.randint(0, 9))) + r.choice(["", ".example"])
        out.append(w)
    return out


@pytest.mark.parametrize(("hot", "most"), [(300, 1), (1500, 3), (1_000_000, 2)])
def test_all_pairs(spark, monkeypatch, hot, most):
    monkeypatch.setattr(editjoin, "HOT_PAIRS", hot)
    a, b = words(1, 100, "abc1"), words(2, 100, "abc1")
    want = {(x, y, distance(x, y)) for x in set(a) for y in set(b) if abs(len(x) - len(y)) <= most and distance(x, y) <= most}
    got = editjoin.edit_join(spark.createDataFrame([(x,) for x in a] + [(None,)], "q string"), spark.createDataFrame([(x,) for x in b] + [(None,)], "w string"), "q", "w", most)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20


def test_a_part_that_all_words_share(spark, monkeypatch):
    """2,000 words with one beginning: what is compared grows with the words, not with their square."""
    r = random.Random(3)
    rows = [("shared-beginning-of-all-" + f"{r.randrange(10**12):012}",) for _ in range(2000)]
    monkeypatch.setattr(editjoin, "HOT_PAIRS", 40_000)
    levels, real = [], editjoin.stored
    monkeypatch.setattr(editjoin, "stored", lambda d: levels.append(real(d)) or levels[-1])
    df = spark.createDataFrame(rows, "w string")
    got = editjoin.edit_join(df, df, "w", "w", 2)
    assert got.count() == len({x for (x,) in rows})  # each is near itself alone
    assert len(levels) > 3
