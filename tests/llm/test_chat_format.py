import hashlib
import random

import pytest
from pyspark.sql import functions as F

from basketry.llm import chat_format
from basketry.llm.chat_format import ChatTemplate

SCHEMA = ("conv_id long, turn long, role string, text string, position long, block long, start string, length long, "
          "lead string, head string, loss string, learnt string, turns string, before string")
T = ChatTemplate()


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, 1, 2, "s", 3, "l", "h", "x", "y", "z", "b") for r in rows], SCHEMA).repartition(partitions)


def awkward_rows():
    rng = random.Random(5)
    bits = [*T.control_strings(), "\\", "<", "[", "|", ">", "a", " ", "\n", "é", "\U0001F600", "<\\|im_end|>", "[\\\\INST]", "|im_end|>"]

    def text():
        return "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))

    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, None, None, "first"), (2, 0, "", "second"), (2, 1, "user", "x"),
        (3, 0, "assistant", "tie b"), (3, 0, "assistant", "tie a"), (3, 0, "assistant", "tie a"), (3, 0, "user", "tie"),
        (None, 0, "user", "no id"), (None, 1, "assistant", "no id either"), (4, 7, "assistant", "x" * 100_000),
        (5, 0, "<|im_sep|>odd\nrole\\", "</s>[INST] ok [/INST]"), (5, 1, "assistant", "<\\\\</s> <|im_end|><|im_more|>"),
        (2**62, 0, "system", "s"), (-7, 0, "assistant", "<<SYS>> <</SYS>>"),
    ]
    for c in range(100, 160):
        rows += [(c, k, rng.choice(["user", "assistant", "assistant", "tool"]), text()) for k in range(rng.randrange(1, 9))]
    return rows


def brute(rows):
    """Whole formatted text, turns and learnt texts of every conversation, in plain Python."""
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))

    def escape(s):
        out, k = [], 0
        rests = [x[max(x.rfind("<"), x.rfind("[")) + 1:] for x in T.control_strings()]
        while k < len(s):
            out.append(s[k])
            if s[k] in "<[":
                j = k + 1
                while j < len(s) and s[j] == "\\":
                    j += 1
                if any(s.startswith(r, j) for r in rests):
                    out.append("\\")
            k += 1
        return "".join(out)

    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        text, before = "", None
        for k, (_, role, said) in enumerate(turns):
            if k and role == before:
                text += T.more + escape(said)
            else:
                text += (T.end if k else "") + T.start + escape(role) + T.sep + escape(said)
            before = role
        yield c, text + T.end, [(r, s) for _, r, s in turns], [s for _, r, s in turns if r == "assistant"]


def test_formatted_texts_masks_and_round_trip_equal_plain_python(spark):
    rows = awkward_rows()
    chats = chat_format.format_chats(table(spark, rows))
    got = {r["conv_id"]: r for r in chats.select("conv_id", "text", "loss", chat_format.read_turns(F.col("text")).alias("turns"),
                                                 chat_format.read_loss(F.col("text"), F.col("loss")).alias("learnt")).collect()}
    want = list(brute(rows))
    assert len(got) == len(want)
    for c, text, turns, learnt in want:
        r = got[c]
        assert r["text"] == text and [tuple(t) for t in r["turns"]] == turns and r["learnt"] == learnt
        data = text.encode()
        for span in r["loss"]:                       # no mark lies under the mask
            under = data[span["start"]:span["start"] + span["length"]].decode()
            assert not any(mark in under for mark in T.control_strings())


def test_no_text_brings_a_control_string_into_the_output(spark):
    chats = chat_format.format_chats(table(spark, awkward_rows())).collect()
    for r in chats:
        rest = r["text"]
        for mark in (T.start, T.sep, T.more, T.end):
            rest = rest.replace(mark, "\0")
        assert not any(mark in rest for mark in T.control_strings())


def test_long_conversation_in_one_block_each(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
                                 F.concat(F.lit("turn "), "id").alias("text"))
    chats = chat_format.format_chats(rows)
    r = chats.select(F.size(chat_format.read_turns(F.col("text"))).alias("n"),
                     F.sha2(F.array_join(chat_format.read_loss(F.col("text"), F.col("loss")), ""), 256).alias("sha")).first()
    want = "".join(f"turn {k}" for k in range(n) if k % 3)
    assert r["n"] == n and r["sha"] == hashlib.sha256(want.encode()).hexdigest()


def test_empty_table_and_clashing_columns(spark):
    assert chat_format.format_chats(table(spark, [])).collect() == []
    assert chat_format.format_chats(table(spark, awkward_rows())).columns == ["conv_id", "text", "loss"]


def test_other_template(spark):
    t = ChatTemplate(start="{(}", sep="{:}", more="{+}", end="{)}", foreign=("<s>",), loss_roles=("user",))
    rows = [(1, 0, "user", "a {(} b {\\\\:} <s>"), (1, 1, "user", "{"), (1, 2, "bot", "{)}")]
    chats = chat_format.format_chats(table(spark, rows), t)
    r = chats.select("text", chat_format.read_turns(F.col("text"), t).alias("turns"),
                     chat_format.read_loss(F.col("text"), F.col("loss"), t).alias("learnt")).first()
    assert [tuple(x) for x in r["turns"]] == [x[2:] for x in rows] and r["learnt"] == [x[3] for x in rows[:2]]


@pytest.mark.parametrize("bad", ["<", "<\\x>", "<a b>"])
def test_control_strings_that_cannot_be_escaped_are_refused(bad):
    with pytest.raises(ValueError):
        ChatTemplate(foreign=(bad,)).pattern()
