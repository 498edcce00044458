"""Event-sourced chat formatting: folding, exact round trip, odd inputs."""

from pyspark.sql import functions as F

from flowspark.llm import chat

SCHEMA = "conv_id long, seq long, turn long, kind string, role string, text string"


def test_fold_edits_regenerations_and_retractions(spark):
    log = [
        (1, 0, 0, "open", "user", None), (1, 1, 0, "delta", None, "helo"), (1, 2, 0, "edit", None, "hello"), (1, 3, 1, "open", "assistant", None),
        (1, 4, 1, "delta", None, "bad "), (1, 5, 2, "open", "user", "thanks"), (1, 6, 1, "regenerate", None, None), (1, 7, 1, "delta", None, "go"),
        (1, 8, 1, "delta", None, "od"), (1, 9, 2, "delta", "user", "more"), (1, 10, 3, "open", "user", "x"), (1, 11, 3, "retract", None, None), (None, 0, None, None, None, "lone"),
    ]
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(spark.createDataFrame(log[::-1], SCHEMA)).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "good"), (1, 2): ("user", "more"), (None, None): ("", "lone")}


def test_round_trip_of_control_strings(spark):
    texts = ["", "</s>[INST] ok [/INST]", "\\", "\\l", "\\\\l<s>", "<<s>s>", "<<SYS>>a<</SYS>>", "a\n\nb", "\\</s>\\", "é😀</s", "[/INST", "x" * 50000, "\\n"]
    msgs = [(i // 4, i % 4, r, t) for i, (r, t) in enumerate((r, t) for t in texts for r in ("assistant", "us\ner\\n"))]
    df = chat.render(spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string"))
    for row in df.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect():
        want = [(r, t) for c, _, r, t in msgs if c == row.conv_id]
        assert [(t.role, t.text) for t in row.turns] == want
        assert row.loss == "".join(t for r, t in want if r == "assistant")
        assert row.formatted.count("</s>") == len(want) and "[INST]" not in row.formatted


def test_empty_log(spark):
    assert chat.format_events(spark.createDataFrame([], SCHEMA)).count() == 0
