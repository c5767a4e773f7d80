"""Base spans against the plain patterns, reliabilities against known votes, added spans on planted texts."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frames import odd
from textweave.llm import weak_pii
from textweave.llm.tables import load

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id bigint, text string, id string, kind string"


def plain(text):
    """The contract's patterns, one after the other."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c in "0123456789"]
        total = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("0123456789ab@.+-() %é\n_"), max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert weak_pii.base_spans(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4010124877152593", "255.1.2.3", "1.2.3.4.5.6.7.8", "+1 (602) 555-9039", "a.b@c.d-e.fr", "@", " ", "x", "0000300.1.1.1", "5-"]), max_size=8))
def test_base_spans_of_pieces_put_together(parts):
    assert weak_pii.base_spans("".join(parts)) == plain("".join(parts))


def test_long_texts_take_time_in_proportion():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 200_000, "a@" * 200_000, "+1" + " " * 300_000, "+1(" * 100_000, "5 " * 200_000, "@" * 300_000):
        base, added = weak_pii.spans_of(text, np.zeros(weak_pii.PLACES), 0.9)
        assert not added and len(base) < 3 * len(text)


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.85, 0.9, 0.5, 0.8])
    shown = np.where(rng.random((len(truth), 6)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    shown[rng.random(shown.shape) < 0.2] = 0
    patterns, counts = np.unique(shown, axis=0, return_counts=True)
    posterior, table = weak_pii.reliabilities(patterns, counts.astype(float), 60)
    agree = table[:, 1, 2] / (table[:, 1, 2] + table[:, 1, 0])
    assert np.abs(agree - right).max() < 0.04
    where = {tuple(p): q for p, q in zip(patterns.tolist(), posterior, strict=True)}
    assert np.mean([(where[tuple(v)] > 0.5) == t for v, t in zip(shown.tolist(), truth, strict=True)]) > 0.97


def planted(n=240):
    rows = []
    for i in range(n):
        end = f"{1000 + 7 * i % 9000:04d}"
        rows.append((4 * i, f"please call +1 ({200 + i}) 555-{end} or mail me{i}@mail{i % 9}.example.com today"))
        rows.append((4 * i + 1, f"phone 00{49 + i % 3}/30/{100 + i}/{end} and contact me{i} [at] example [dot] com today"))
        rows.append((4 * i + 2, f"version {i}.{i % 7}.{900 + i}.{i + 400} of order {5_000_000 + 31 * i} in token=ab{70_000_000 + i}cd"))
        rows.append((4 * i + 3, "nothing to see here at all"))
    return rows


def test_loose_forms_are_added_and_decoys_are_not(spark):
    rows = {r["doc_id"]: r for r in weak_pii.personal_data(spark.createDataFrame(planted(), "doc_id bigint, text string")).collect()}
    assert len(rows) == 960
    kinds = [[s.split(":")[0] for s in rows[i]["spans"].split(",") if s] for i in range(960)]
    assert all(k == ["phone", "email"] for k in kinds[0::4])
    assert np.mean([k == ["phone", "email"] for k in kinds[1::4]]) > 0.9
    assert np.mean([not k for k in kinds[2::4]]) > 0.9
    assert not any(kinds[3::4])
    assert all(r["n_phone"] + r["n_email"] == (2 if i % 4 == 0 else 0) for i, r in rows.items())


def test_every_base_span_stays(spark):
    docs = load(spark, SF, "documents")
    found = {r["doc_id"]: r for r in weak_pii.personal_data(docs).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        base, row = plain(text or ""), found[doc_id]
        assert row["base_spans"] == weak_pii.written(base)
        assert set(filter(None, row["base_spans"].split(","))) <= set(row["spans"].split(","))
        assert [row[f"n_{k}"] for k in weak_pii.KINDS] == [sum(j == i for _, j, _ in base) for i in range(4)]


@pytest.mark.parametrize("rows", [[], [(None, None, "x", "y"), (None, None, "x", "y"), (1, "", "x", None), (2, "a@b.cd", None, None), (2, "a@b.cd", None, None)]])
def test_odd_rows(spark, rows):
    found = weak_pii.personal_data(spark.createDataFrame(rows, SCHEMA))
    assert found.columns[:5] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone"]
    assert sorted((str(r["doc_id"]), r["spans"]) for r in found.collect()) == sorted((str(r[0]), "email:0:6" if r[1] else "") for r in rows)


def test_awkward_table(spark):
    docs = odd(spark)
    assert weak_pii.personal_data(docs).count() == docs.count()
