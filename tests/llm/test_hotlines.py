"""Lines that share long segments: the same classes as comparing every pair."""

import random

import pytest

from riskspark.llm import graph, lines


def classes(rows):
    """The first line of each class of chained near lines, by comparing all pairs."""
    distinct = list(dict.fromkeys(rows))
    root = list(range(len(distinct)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(distinct):
        for j in range(i):
            if find(i) != find(j) and abs(len(a) - len(distinct[j])) < 60 and lines.near(a, distinct[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {k for k in range(len(distinct)) if find(k) == k}, distinct


def changed(r, text, alphabet):
    """The text after an edit or two."""
    for _ in range(r.randint(1, 2)):
        at = r.randrange(len(text) + 1)
        text = r.choice([text[:at] + r.choice(alphabet) + text[at:], text[:at] + text[at + 1 :], text[:at] + r.choice(alphabet) + text[at + 1 :]])
    return text


def posted(r, n):
    head = "This message was posted here by "
    rows = []
    for _ in range(n):
        k = r.random()
        if rows and k < 0.25:
            rows.append(changed(r, r.choice(rows), "0123456789"))
        elif k < 0.35:
            rows.append(head + f"{r.randrange(10**4):04}")  # few digits: all are near
        else:
            rows.append(f"{head}{r.randrange(10**9):09}-{r.randrange(10**9):09}" + r.choice(["", " of them", " at all times"]))
    return rows


def listed(r, n):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    head = ["common"] * 3 + words + ["and", "then", "again"]
    rows = []
    for _ in range(n):
        if rows and r.random() < 0.3:
            w = r.choice(rows).split()
            w[r.randrange(len(w))] = r.choice(words)
            rows.append(" ".join(w))
        else:
            rows.append(" ".join(head + [f"{r.choice(words)}{r.randrange(50)}" for _ in range(r.randint(8, 40))]))
    return rows


def repetitive(r, n):
    return ["".join(r.choices("ab", k=r.randint(18, 46))) if r.random() < 0.7 else "a" * r.randint(15, 60) for _ in range(n)]


@pytest.mark.parametrize(("make", "n"), [(posted, 260), (listed, 160), (repetitive, 200)])
@pytest.mark.parametrize("hot", [200])
def test_hot_segments_lose_no_link(spark, tmp_path, monkeypatch, make, n, hot):
    monkeypatch.setattr(graph, "HOT_PAIRS", hot)
    rows = make(random.Random(n + hot), n)
    path = str(tmp_path / "t")
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(2).write.parquet(path)
    kept, distinct = classes(rows)
    first = {t: k for k, t in reversed(list(enumerate(rows)))}
    got = {r.doc_id for r in lines.dedup_lines(spark.read.parquet(path)).where("n_removed = 0").collect()}
    assert got == {first[distinct[k]] for k in kept}


def test_unlike_lines_are_not_paired_out(spark, tmp_path, monkeypatch):
    """3,000 lines that share their beginning: no bucket that is paired out at last is large."""
    r, largest, real = random.Random(3), [], graph._links_between

    def spied(u, v, *rest):
        largest.append(v.groupBy("bucket").count().agg({"count": "max"}).first()[0] or 0)
        return real(u, v, *rest)

    monkeypatch.setattr(graph, "_links_between", spied)
    path = str(tmp_path / "t")
    rows = [(k, f"This message was posted here by {r.randrange(10**18):018}-{r.randrange(10**18):018}") for k in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    assert lines.dedup_lines(spark.read.parquet(path)).where("n_removed > 0").count() == 0
    assert largest and max(largest) ** 2 <= graph.HOT_PAIRS < len(rows) ** 2
