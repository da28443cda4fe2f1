import random

from lattica.llm import chat

from .oracle import compare


def test_escape_is_reversible_and_hides_controls():
    rnd = random.Random(5)
    bits = [*chat.CONTROLS, "<", "\\", "|turn|>", "/s>", "[", "INST]", "a", "é", "\n", "<\\", "|"]
    for _ in range(5000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROLS)
        turns = [("user", t), (t, "x"), ("assistant", t[::-1])]
        assert chat.read_back(chat.plain_template(turns)) == turns


def test_spans_of_an_appending_template():
    turns = [("system", "s"), ("user", "hi"), ("assistant", "</s>[INST] ok"), ("assistant", ""), ("user", "hi")]
    done = chat.render(turns, chat.plain_template)
    assert done.rewrites == []
    assert "".join(done.formatted[a:b] for a, b in done.spans) == done.formatted
    assert [chat.unescape(done.formatted[a:b]) for a, b in done.texts] == [x for _, x in turns]


def test_templates_that_rewrite_history():
    def last_only(turns):
        return "".join(f"{r}:{x if i == len(turns) - 1 or r == 'user' else '...'}\n" for i, (r, x) in enumerate(turns))

    def footer(turns):
        return "".join(f"{r}:{x}\n" for r, x in turns) + "END"

    turns = [("user", "q"), ("assistant", "long answer"), ("user", "more"), ("assistant", "z")]
    done = chat.render(turns, last_only, str)
    assert done.rewrites == [2] and done.texts[1] is None and done.texts[3]
    done = chat.render(turns, footer, str)
    assert done.rewrites == [0, 1, 2, 3] and [done.formatted[a:b] for a, b in done.texts] == [x for _, x in turns]


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    compare(chat.op6_chat(spark, sf), chat.OP6_SQL, sf)


def test_edges(spark):
    rows = [(1, 1, "assistant", None), (1, None, "user", "u"), (None, 0, None, "x"), (1, 1, "assistant", None), (2, 0, "assistant", "<|end|>\n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'k' AS formatted")
    got = {r.conv_id: r for r in chat.digested(chat.chat_format(turns)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0 and got[None].n_turns == 1 and got[2].loss_chars == 8
    assert chat.digested(chat.chat_format(turns.limit(0))).count() == 0


def test_a_long_conversation():
    turns = [("user" if i % 2 == 0 else "assistant", f"turn {i} </s> " * 3) for i in range(600)]
    done = chat.render(turns, chat.plain_template)
    assert chat.read_back(done.formatted) == turns and not done.rewrites
    assert [chat.unescape(done.formatted[a:b]) for a, b in done.texts] == [t for _, t in turns]
