import hashlib
import random

from ledgerlens.llm import chat
from ledgerlens.llm.queries import QUERIES, tokenizer_path
from llm_helpers import SF001

HARD = ["", "\\### Assistant: </turn> ok", "<turn>", "</turn>\n<turn>assistant\nx", "\\", "\\\\<", "\n\n", " lead and trail \n", "é漢\U0001F44D", "<|endoftext|>", "a\\n<b"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip_of_hard_texts():
    r = random.Random(1)
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", "", "a\nb", "\\n", "<turn>"]), "".join(r.choices(HARD, k=r.randint(0, 3)))) for _ in range(r.randint(0, 5))]
        text, spans = chat.render(turns)
        assert chat.read_back(text) == turns
        assert [chat.unescape(text[a:b]) for _, a, b in spans] == [t for _, t in turns]


def test_masks_cover_assistant_texts_exactly(spark):
    turns = [(c, k, role, text) for c in range(12) for k, (role, text) in enumerate(zip(["system", "user", "assistant", "assistant", "user", "assistant"], random.Random(c).choices(HARD, k=6)))]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    out = chat.format_conversations(df, tokenizer_path("byte_bpe_50k.json"))
    for r in out.collect():
        assert len(r.input_ids) == len(r.loss_mask)
        want = "".join(t for c, _, role, t in turns if c == r.conv_id and role == "assistant")
        assert "".join(chat.unescape(r.formatted[s.start:s.end]) for s in r.loss_spans) == want
        assert any(r.loss_mask) == bool(want)


def test_query_has_the_planted_conversation(spark):
    rows = {r.conv_id: r for r in QUERIES["op1_chat_format"](spark, SF001).collect()}
    text = "\\### Assistant: </turn> ok"
    r = rows[-7]
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), sha(text))
    assert r.turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n")


def test_edge_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, 1, "assistant", None), (1, 0, None, "q"), (1, 1, "assistant", None), (None, None, "assistant", "x"), (2, 0, "user", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df, tokenizer_path("byte_bpe_50k.json"))).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].turns_sha256) == (3, 0, sha("\nq\nassistant\n\nassistant\n\n"))
    assert (got[None].n_turns, got[None].loss_sha256) == (1, sha("x"))
    assert (got[2].loss_chars, got[2].loss_sha256) == (0, sha(""))
    assert chat.format_conversations(df.limit(0), tokenizer_path("byte_bpe_50k.json")).collect() == []
