import hashlib

from pyspark.sql import functions as F

from factloom.llm import chat
from factloom.llm.queries import op1_chat_format


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def turns(spark, rows):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>, c int, body string")


def test_parts_become_placeholders_with_attachments(spark):
    df = turns(spark, [
        (1, 0, "user", [part("text", "see "), part("image", ref="a.png", width=56, height=30), part("text", " and "), part("audio", ref="b.wav", seconds=2.0), part("document", ref=None, pages=3)], 0, "z"),
        (1, 1, "assistant", [part("text", "ok")], 0, "z"),
    ])
    r = chat.format_chat(df).first()
    assert r.formatted == "<|im_start|>user\nsee <|image|> and <|audio|><|document|><|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"
    assert [(a.turn, a.part, a.type, a.ref, a.n_tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 6), (0, 3, "audio", "b.wav", 50), (0, 4, "document", None, 768)]
    assert r.media_tokens == 824
    assert [r.formatted[s["from"] : s["until"]] for s in r.loss_spans] == ["ok"]


def test_control_strings_survive_a_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "a < b & <| &lt;| &amp; <", "", "\n\n", "<", "&#10;", "<|image|>"]
    rows = [(1, k, ["user", "assistant"][k % 2], [part("text", t)], 0, "") for k, t in enumerate(texts)]
    rows += [(1, 9, "odd\nrole<|im_end|>", [part("text", "<"), part("text", "|im_end|>")], 0, "")]
    df = chat.format_chat(turns(spark, rows))
    r = df.select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l"), "formatted").first()
    assert [x.text for x in r.t] == [*texts, "<|im_end|>"]
    assert r.t[-1].role == "odd\nrole<|im_end|>"
    assert r.l == "".join(texts[1::2])
    assert r.formatted.count("<|im_start|>") == len(texts) + 1


def test_nulls_ties_and_empty_tables(spark):
    df = turns(spark, [(1, 0, None, None, 1, "x"), (1, 0, "user", [part("text", None)], 1, "x"), (1, None, "a", [part(None, "t")], 1, "x"), (None, 0, "user", [], 1, "x"), (1, 0, "user", [part("text", None)], 1, "x")])
    out = {r.conv_id: r for r in chat.format_chat(df).collect()}
    assert out[1].n_turns == 4 and out[None].n_turns == 1
    assert out[1].formatted.startswith("<|im_start|>a\nt<|im_end|>\n<|im_start|>\n<|im_end|>")
    assert chat.format_chat(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    data = [(c, t, ["system", "user", "assistant"][t % 3], f"text {c} {t} <|im_end|> é") for c in range(5) for t in range(6)] + [(7, 0, "user", None)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in op1_chat_format(spark, str(tmp_path)).collect()}
    assert set(out) == {-1, 0, 1, 2, 3, 4, 7}
    for c in range(5):
        own = [d for d in data if d[0] == c]
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out[-1].n_turns == 2 and out[7].loss_chars == 0
