import hashlib
import random

from pyspark.sql import functions as F

from lodestrata.llm import chat

TURNS = "conv_id long, turn long, role string, text string, formatted string, `__c` int, `__p` int, t int, r int, s int, a int, x int"


def both(spark, rows):
    made = chat.format_chats(spark.createDataFrame([(*r, *range(7)) for r in rows], TURNS))
    return {r.conv_id: r for r in made.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("masked", chat.masked_text(F.col("formatted"), F.col("loss"))).collect()}


def test_round_trip_of_odd_texts(spark):
    rng = random.Random(5)
    bits = ["\\", "\\s", "\\l", "<", "#", "</turn>", "### ", ":\n", "\n", "a", "é", "😀", "### assistant:\n", "\\\\", ""]
    rows, want = [], {}
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            role, text = rng.choice(["user", "assistant", "system", "a#<b:\\", "a:\nb", ":\n", "\\c"]), "".join(rng.choices(bits, k=rng.randint(0, 9)))
            rows.append((c, t, role, text, "clash"))
            want.setdefault(c, []).append((role, text))
    got = both(spark, rows)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].masked == "".join(x for r, x in turns if r == "assistant")


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None, ""), (1, 0, None, "b", ""), (1, 0, "assistant", "x", ""), (1, 0, "assistant", "x", ""), (None, 5, "assistant", "y", ""), (2, None, "user", "z" * 100_000, "")]
    got = both(spark, rows)
    assert [tuple(t) for t in got[1].turns] == [("", "b"), ("assistant", "x"), ("assistant", "x"), ("user", "")]
    assert got[1].masked == "xx" and got[None].masked == "y" and len(got[2].turns[0].text) == 100_000


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_parts_become_placeholders(spark):
    rows = [(1, 0, "user", [("text", "look <here>", None, None), ("image", None, "a.png", 2), (None, "and", None, None), ("audio", None, "b.wav", None), ("document", None, "c.pdf", 0)]), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    row = chat.format_chats(df, parts="parts").first()
    assert row.formatted == "### user:\nlook \\lhere><image:1>and<audio:3><document:4></turn>\n### assistant:\n</turn>\n"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, 1, "image", "a.png", 512), (0, 3, "audio", "b.wav", 50), (0, 4, "document", "c.pdf", 512)]
    assert row.attachment_tokens == 1074 and [tuple(x) for x in row.loss] == [(len(row.formatted) - len(chat.CLOSE), 0)]


def test_query_has_the_odd_conversation(spark):
    from lodestrata.llm.queries import op9_chat_formatting

    rows = {r.conv_id: r for r in op9_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    odd = r"\### Assistant: </turn> ok"
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len(odd)
    assert rows[-7].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest()
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()


def test_any_kind_with_a_reference_is_kept_and_read_back(spark):
    kind = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,units:int>>"
    rows = [
        (1, 0, "user", [("text", "see <this> # a:b>", None, None), ("video", None, "v.mp4", 3), ("Image", "alt", "i.png", 2), ("text", "and", None, None), ("text", " more", None, None)]),
        (1, 1, "assistant", [("odd>:<kind\\", "x", "ref://1", None), ("poll", "no reference", None, None), (None, "plain", "r", None)]),
        (1, 2, "user", [("image", None, None, None)]), (1, 3, "", []),
    ]
    made = chat.format_chats(spark.createDataFrame(rows, kind), parts="parts")
    r = made.select("attachments", "attachment_tokens", chat.read_parts(made.formatted, made.attachments).alias("turns"), chat.read_back(made.formatted).alias("plain")).first()
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "video", "v.mp4", 3), (0, 2, "image", "i.png", 512), (1, 0, "odd>:<kind\\", "ref://1", 1), (2, 0, "image", None, 256)]
    assert r.attachment_tokens == 772 and [t.role for t in r.plain] == ["user", "assistant", "user", ""]
    assert [(t.role, [tuple(p) for p in t.parts]) for t in r.turns] == [
        ("user", [("text", "see <this> # a:b>", None), ("video", None, "v.mp4"), ("image", None, "i.png"), ("text", "and more", None)]),
        ("assistant", [("odd>:<kind\\", None, "ref://1"), ("text", "no referenceplain", None)]), ("user", [("image", None, None)]), ("", []),
    ]
