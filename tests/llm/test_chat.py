from testlog.llm import chat


def test_every_view(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello"), (1, 3, "ann", None), (1, 4, None, "who?"),
        (2, 0, "system", "alone"), (None, 1, "ann", "lost"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = {(r.conv_id, r.speaker): r for r in chat.rotate(table).collect()}
    assert sorted(out, key=str) == sorted([(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")], key=str)
    bob = out[1, "bob"]
    assert bob.text == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=ann\nHi<|im_end|>\n"
        "<|im_start|>assistant\nHello<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
        "<|im_start|>user name=unknown\nwho?<|im_end|>\n"
    )
    assert [bob.text[s.start : s.end] for s in bob.spans] == ["Hello<|im_end|>"]
    assert [out[1, "ann"].text[s.start : s.end] for s in out[1, "ann"].spans] == ["Hi<|im_end|>", "<|im_end|>"]
    assert (bob.n_turns, bob.n_own, bob.n_chars, bob.n_masked) == (5, 1, len(bob.text), 15)
    assert chat.rotate(table.limit(0)).count() == 0


def test_long_dialogues_and_equal_turns(spark):
    rows = [(1, i, "ab"[i % 2], f"t{i}") for i in range(1000)] + [(2, 5, "ab"[i % 2], "same") for i in range(9000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.rotate(table).collect()
    parts = sorted((r.part, r.n_turns) for r in out if r.conv_id == 1 and r.speaker == "a")
    assert parts == [(0, 256), (1, 256), (2, 256), (3, 232)]
    large = [r for r in out if r.conv_id == 2 and r.speaker == "b"]
    assert sum(r.n_turns for r in large) == 9000 and sum(r.n_own for r in large) == 4500
    assert max(r.n_turns for r in large) <= chat.PIECE_ROWS
