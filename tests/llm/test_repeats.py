import hashlib
import random
import re

import pytest
from frames import docs, odd
from textweave.llm.repeats import remove_repeats


def brute(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0))
    for n in order:
        for i in range(len(split[n]) - window + 1):
            first.setdefault(tuple(split[n][i : i + window]), (rows[n], i))
    for row, words in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] != (row, i):
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((row[0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1):
    draw = random.Random(seed)
    line = lambda n: [draw.choice("abcdefghijklmnopqrst") * draw.randint(1, 3) for _ in range(n)]
    shared, common = line(40), line(25)
    rows = []
    for i in range(60):
        words = line(draw.randint(0, 60))
        for passage in (shared, common):
            if draw.random() < 0.4:
                at, cut = draw.randint(0, len(words)), draw.randint(0, 8)
                words[at:at] = passage[cut:]
        rows.append((i, " ".join(words)))
    rows += [(60 + i, rows[i][1]) for i in range(5)]
    rows.append((70, " ".join(["x"] * 50)))
    rows.append((71, "\n".join(shared * 3)))
    return rows


@pytest.mark.parametrize(("window", "base"), [(20, 10), (20, 5), (8, 8)])
def test_equals_brute_force(spark, window, base):
    rows = corpus()
    got = [tuple(r) for r in remove_repeats(docs(spark, rows).repartition(7), window, base).collect()]
    assert sorted(got, key=str) == brute(rows, window)


def test_odd_rows_and_empty_table(spark):
    df = odd(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = [tuple(r) for r in remove_repeats(df).collect()]
    assert sorted(got, key=str) == brute(rows, 20)
    assert remove_repeats(docs(spark, [])).count() == 0


def test_kept_text(spark):
    text = " ".join(f"w{i}" for i in range(25))
    kept = {r.doc_id: r.kept_text for r in remove_repeats(docs(spark, [(1, text), (2, f"new {text} end")]), with_text=True).collect()}
    assert kept == {1: text, 2: "new end"}
    with pytest.raises(ValueError):
        remove_repeats(docs(spark, []), 20, 7)
