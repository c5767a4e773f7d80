from collections import defaultdict

from pyspark.sql import functions as F
from textweave.llm.perspectives import BEGIN, END, rotate

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, size):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, (role or "").strip() or "unknown", text or ""))
    out = []
    for conv, turns in talks.items():
        turns.sort()
        for person in {t[2] for t in turns} - {"system"}:
            for part in range(0, len(turns), size):
                text, spans = "", []
                for _, _, speaker, said in turns[part : part + size]:
                    head = "assistant" if speaker == person else "system" if speaker == "system" else f"user name={speaker}"
                    text += f"{BEGIN}{head}\n"
                    begin = len(text)
                    text += said + END
                    if speaker == person:
                        spans.append((begin, len(text)))
                out.append((conv, person, part // size, len(turns[part : part + size]), text, spans))
    return sorted(out, key=str)


def got(df, size):
    return sorted(((r.conv_id, r.participant, r.part, r.n_turns, r.text, [tuple(s) for s in r.spans]) for r in rotate(df, size).collect()), key=str)


def test_equals_brute_force(spark):
    rows = [(c, t, ("system" if t == 0 else ["ann", "bob", "cy"][(c * t) % (2 + c % 2)]), f"turn {t} of {c} é🎉") for c in range(12) for t in range(1 + c)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"place": F.lit("x"), "part": F.lit("x"), "speaker": F.lit("x"), "participant": F.lit("x")})
    assert got(df, 4) == brute(rows, 4)
    assert got(df, 64) == brute(rows, 64)


def test_odd_turns(spark):
    rows = [(1, None, None, None), (1, 1, " ", "a"), (1, 1, "user", "b"), (1, 1, "user", "b"), (None, 0, "user", ""), (None, 1, "assistant", "x" * 3000), (2, 0, "system", "alone")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, 2) == brute(rows, 2)
    assert rotate(df.limit(0)).count() == 0


def test_one_hot_dialogue(spark):
    rows = [(1, t, "ab"[t % 2], str(t)) for t in range(1500)] + [(c, 0, "a", "x") for c in range(2, 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, 64) == brute(rows, 64)
    plan = rotate(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
