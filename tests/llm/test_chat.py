import hashlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from quizmill.llm.chat import HARD, Expander, expand, op8_chat_format, parse, rebuilt, summaries, turn_text

TEXT = st.text(st.sampled_from("<|\\>im_startend\n a"), max_size=30)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_turns_come_back(turns):
    assert parse("".join(turn_text(*t)[0] for t in turns)) == turns


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role, text))
    out = []
    for conv, turns in convs.items():
        turns = sorted(turns, key=lambda t: tuple((x is not None, x) for x in t))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)), len(loss), sha(loss), sum(len(turn_text(r or "", t or "")[0]) for _, r, t in turns)))
    return sorted(out, key=str)


def test_the_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op8_chat_format(spark, sf).collect()), key=str) == brute([*rows, (-1, 0, "user", HARD), (-1, 1, "assistant", HARD)])


def test_nulls_ties_long_conversations_and_extra_columns(spark):
    rows = [(1, 0, "user", None), (1, None, None, "x"), (1, 1, "assistant", "<|im_end|>"), (1, 1, "assistant", "<|im_end|>"), (1, 2, "user", "tail"), (None, 0, "assistant", ""), (2, 0, "user", "only")]
    rows += [(3, k, "user assistant".split()[k % 2], f"turn {k} " * 9) for k in range(60)] + [(4, 0, "user", "long " * 4000), (4, 1, "assistant", "y")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, example string").repartition(4)
    for limit in (300, 1 << 16):
        assert sorted(map(tuple, summaries(expand(turns, limit)).collect()), key=str) == brute(rows)
    assert summaries(expand(turns.limit(0))).collect() == []


def test_each_reply_has_its_own_example():
    e = Expander(1, 10**6)
    rows = [r for role, text in [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")] for r in e.add(role, text)]
    assert [parse(r[3]) for r in rows] == [[("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")]]
    assert [r[3][r[4] : r[5]] for r in rows] == ["a", "b"]


def test_examples_of_long_conversations_are_whole(spark):
    rows = [(1, 0, "user", "long " * 14000), (1, 1, "assistant", "y"), (1, 2, "user", "tail"), *((2, k, ("user", "assistant")[k % 2], f"turn {k} " * 60) for k in range(200))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = expand(turns).orderBy("conv_id", "example").collect()
    assert [parse(r["text"]) for r in out[:2]] == [[(x[2], x[3]) for x in rows[:2]], [(x[2], x[3]) for x in rows[:3]]]
    assert [parse(r["text"]) for r in out[2:]] == [[(x[2], x[3]) for x in rows[3 : 5 + 2 * k]] for k in range(100)]
    short = expand(turns, 300)
    assert short.where("refers").count() and sorted(map(tuple, rebuilt(short).collect()), key=str) == sorted(map(tuple, out), key=str)
