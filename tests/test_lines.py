"""Chunk cutting is independent of where chunks are cut; format detection."""

import random
import re

import pytest

from testlog.operators.lines import binary_chunks_to_lines, chunks_to_lines, detect_format, valid_utf8_runs


def expected_lines(text):
    parts = re.split(r"\r\n|\r|\n", text)
    return parts[:-1] if parts[-1] == "" else parts


@pytest.mark.parametrize("block", [4096, 3])
def test_any_cut_gives_the_same_lines(spark, block):
    rng = random.Random(5)
    texts, rows = [], []
    for i in range(300):
        text = "".join(rng.choice(["a", "é", "\n", "\r", "\r\n", " ", "ok"]) for _ in range(rng.randint(0, 25)))
        texts.append(text)
        at, seq = 0, 0
        while at < len(text):
            size = rng.randint(0, 4)
            rows.append((i, seq, text[at : at + size]))
            at, seq = at + size, seq + 1
    chunks = spark.createDataFrame(rows, "run_id bigint, seq bigint, chunk string")
    got, sizes = {}, {}
    for r in chunks_to_lines(chunks, block=block).collect():
        got.setdefault(r.run_id, []).append((r.line_no, r.line))
        sizes.setdefault(r.run_id, []).append((r.line_no, r.bytes))
    for i, text in enumerate(texts):
        lines = sorted(got.get(i, []))
        raw = [len(part.encode()) for part in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z", text)]
        assert [n for _, n in sorted(sizes.get(i, []))] == raw, repr(text)
        assert [n for n, _ in lines] == list(range(1, len(lines) + 1))
        assert [line for _, line in lines] == expected_lines(text), repr(text)


def test_invalid_bytes_reject_the_run_but_cut_characters_do_not(spark):
    rows = [(1, 0, "é".encode()[:1]), (1, 1, "é".encode()[1:]), (2, 0, b"ok\n\xc3(")]
    chunks = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "run_id bigint, seq bigint, chunk binary")
    good, rejected = valid_utf8_runs(binary_chunks_to_lines(chunks))
    assert [(r.run_id, r.line) for r in good.collect()] == [(1, "é")]
    assert [r.run_id for r in rejected.collect()] == [2]


CASES = [
    (["{}"], "json"), (["", "  [1]"], "json"), (["TAP version 14"], "tap"), (["noise", "ok 1"], "tap"),
    (["1..3"], "tap"), (["+1 .. 2x"], "tap"), (["Bail out!"], "tap"), (["bail out!", "Ran 3 tests"], "bun"),
    (["(pass) x"], "bun"), (["FAILURES:"], "bun"), (["..F s"], "bun"), (["okay"], "tap"), ([""], "tap"),
    (["~" * 65535, "Ran x"], "bun"), (["~" * 65536, "Ran x"], "tap"), (["text", "{"], "json"),
]


def test_first_telling_line_decides(spark):
    rows = [(i, n + 1, line) for i, (lines, _) in enumerate(CASES) for n, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "run_id bigint, line_no int, line string")
    got = {r.run_id: r.format for r in detect_format(lines).collect()}
    assert got == {i: f for i, (_, f) in enumerate(CASES)}


def test_line_ends_count_in_the_budget(spark):
    texts = ["x\r\n" * 22000 + "Ran 3 tests\n", "x\n" * 22000 + "Ran 3 tests\n", "x\r\n" * 21846 + "{", "x\r\n" * 21845 + "y{\r\n{"]
    rows = [(i, k, part) for i, t in enumerate(texts) for k, part in enumerate((t[:7777], t[7777:]))]
    chunks = spark.createDataFrame(rows, "run_id bigint, seq bigint, chunk string")
    got = {r.run_id: r.format for r in detect_format(chunks_to_lines(chunks)).collect()}
    assert got == {0: "tap", 1: "bun", 2: "tap", 3: "tap"}
