import re

import numpy as np
import pytest
import xxhash
from frames import docs, odd
from textweave.llm import ball_hashing
from textweave.llm.components import components


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def tied(values, radius):
    names = list(range(len(values)))
    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            if bin(a ^ b).count("1") <= radius and names[i] != names[j]:
                names = [names[j] if n == names[i] else n for n in names]
    return names


def test_fingerprints_and_components_of_odd_rows(spark):
    df = odd(spark, 3_000)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    prints = [brute_print(t) for _, t in rows]
    names = tied(prints, 4)
    least = {}
    for (i, _), n in zip(rows, names, strict=True):
        least[n] = min((x for x in (i, least.get(n)) if x is not None), default=None)
    expected = [(i, f"{p:016x}", least[n]) for (i, _), p, n in zip(rows, prints, names, strict=True)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in ball_hashing.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert ball_hashing.near_duplicates(docs(spark, [])).count() == 0
    assert ball_hashing.keep_one(df).columns == df.columns


@pytest.mark.parametrize("parts", [1, 2])
@pytest.mark.parametrize("block", [4, 2048])
def test_links_tie_what_all_pairs_tie(spark, monkeypatch, parts, block):
    monkeypatch.setattr(ball_hashing, "BLOCK", block)
    rng = np.random.default_rng(3)
    values = set()
    for centre in rng.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(12):
            x = centre
            for bit in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << bit
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    found = ball_hashing.links(prints, 4, parts).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in found)
    named = {r.node: r.component for r in components(ball_hashing.links(prints, 4, parts)).collect()}
    names = tied(values, 4)
    groups = [named.get(s, s) for s in signed]
    assert len(set(zip(names, groups, strict=True))) == len(set(names)) == len(set(groups))


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    links = spark.createDataFrame([*chain, *star, (5, 4), (7, 7), (None, 3)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(links.limit(0)).count() == 0


def test_keep_one_tells_rows_by_id_and_text(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "quite another text of more words"), (2, "quite another text of more words"), (None, "x y z"), (None, "x y z"), (None, "a b c d e")]
    kept = ball_hashing.keep_one(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == [(1, "a b c d e"), (2, "quite another text of more words"), (None, "x y z")]


def test_large_component_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ball_hashing, "EMITTED", 200)
    prints = [0] + [1 << b for b in range(40)]
    marked = spark.createDataFrame([(100 - i, p) for i, p in enumerate(prints)], "id bigint, fingerprint bigint")
    assert {r.component_id for r in ball_hashing._grouped(marked, 4, 2).collect()} == {60}
