import struct
import zlib

import numpy as np
import public_tokenizers
from frames import docs, odd
from hypothesis import given, settings
from hypothesis import strategies as st
from textweave.llm import token_counts, window_packing
from tokenizers import Tokenizer

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = st.lists(st.text(alphabet=st.sampled_from(list("abe tion'sS.!1\t\né日\U0001f389 <|>")), max_size=40) | st.just("<|endoftext|>"), max_size=6).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_counts_equal_the_library(text):
    whole = Tokenizer.from_file(BYTES) if not hasattr(test_counts_equal_the_library, "t") else test_counts_equal_the_library.t
    test_counts_equal_the_library.t = whole
    assert token_counts.loaded(BYTES).count([text]) == [len(whole.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_word_ids_equal_the_library(text):
    whole = Tokenizer.from_file(WORDS) if not hasattr(test_word_ids_equal_the_library, "t") else test_word_ids_equal_the_library.t
    test_word_ids_equal_the_library.t = whole
    ids, stops = next(window_packing.loaded(WORDS).encode([text.encode()]))
    assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
    assert all(0 <= s <= len(ids) for s in stops)


def test_counts_of_odd_rows(spark):
    whole = Tokenizer.from_file(BYTES)
    df = odd(spark, 5_000)
    expected = []
    for r in df.collect():
        text = r.text or ""
        n = len(whole.encode(text, add_special_tokens=False).ids)
        expected.append((r.doc_id, len(text.encode()), n, n > 512))
    got = [tuple(r) for r in token_counts.count_tokens(df, BYTES).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert token_counts.count_tokens(docs(spark, []), BYTES).count() == 0


def cost(places, penalty, chosen, s):
    total = 0.0
    for a, b in zip(chosen[:-1], chosen[1:], strict=True):
        n = b - a
        free = n >= s.least_unpadded and n & (n - 1) == 0
        total += (0 if free else s.limit - n) + s.window_cost + penalty[np.searchsorted(places, b)]
    return total


def test_cuts_have_the_least_cost():
    rng = np.random.default_rng(5)
    s = window_packing.Settings(limit=64, window_cost=3, sentence_cut=2, other_cut=9, longest_gap=16, least_unpadded=8)
    for _ in range(40):
        ends = np.cumsum(rng.integers(1, 90, rng.integers(1, 9)))
        marks = np.unique(rng.integers(1, ends[-1] + 1, rng.integers(0, 20)))
        places, penalty = window_packing.cuts(ends, marks, s)
        best = [0.0] + [np.inf] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                n = places[j] - places[i]
                if n <= s.limit:
                    free = n >= s.least_unpadded and n & (n - 1) == 0
                    best[j] = min(best[j], best[i] + (0 if free else s.limit - n) + s.window_cost + penalty[j])
        chosen = window_packing.best_cuts(places, penalty, s)
        assert chosen[0] == 0 and chosen[-1] == ends[-1] and (np.diff(chosen) <= s.limit).all()
        assert cost(places, penalty, chosen, s) == best[-1]


def test_packing_is_whole(spark):
    whole = Tokenizer.from_file(WORDS)
    df = odd(spark, 9_000).filter("doc_id is not null").dropDuplicates(["doc_id"]).repartition(3)
    rows = window_packing.pack(df, WORDS, with_ids=True).toPandas()
    for r in df.collect():
        own = rows[rows.doc_id == r.doc_id].sort_values("start")
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert [i for part in own.ids for i in part] == ids
        assert set(own.doc_tokens) == {len(ids)}
        for p in own.itertuples():
            assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *p.ids))
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 2048
    assert window_packing.pack(docs(spark, []), WORDS).count() == 0


def test_rows_given_twice_and_null_ids_are_packed(spark):
    df = odd(spark, 100)
    rows = window_packing.pack(df, WORDS).toPandas()
    assert (rows.doc_id == 4).sum() >= 2 and rows.doc_id.isna().any()


def test_a_word_is_looked_up_once_in_a_slice_of_texts():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

    tokens = window_packing.Tokens(WORDS)
    tokens.place = Counted()
    texts = [b"one two. " * 500, None, b"", b" \x0b\t", b"\ntwo.\x0cone\r" * 500, "\xa0\x1cone\x85".encode()]
    found = [(ids.tolist(), stops.tolist()) for ids, stops in tokens.encode(texts)]
    assert tokens.place.asked == 3
    for text, (ids, stops) in zip(texts, found, strict=True):
        assert ids == tokens.tokenizer.encode((text or b"").decode(), add_special_tokens=False).ids
        assert len(stops) == (text or b"").count(b"two.")


def test_words_that_come_again_stay_when_the_table_is_full(monkeypatch):
    monkeypatch.setattr(window_packing, "MOST_WORDS", 8)
    tokens = window_packing.Tokens(WORDS)
    batches = [[f"often again word{n}a Word{n}b. {n}".encode(), b"often"] for n in range(12)]
    for batch in batches:
        found = [ids.tolist() for ids, _ in tokens.encode(batch)]
        assert found == [tokens.tokenizer.encode(text.decode(), add_special_tokens=False).ids for text in batch]
        assert len(tokens.place) <= 8 + 5
    assert {b"often", b"again"} <= set(tokens.place)
