"""Documents read line by line agree with documents parsed whole."""

import json
import random

import pytest

from testlog.operators import jsonlog

COLUMNS = ("total", "passed", "failed", "todo", "skipped", "parse_warning_count")


def random_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 4:
        return rng.choice([1, -2.5, True, None, "", 'a "quoted" {text}, [here]\\', "é x", "tab\t"])
    if kind == 4:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice("abc"): random_value(rng, depth + 1) for _ in range(rng.randrange(3))}


def random_document(rng):
    doc = {"x": random_value(rng)}
    if rng.random() < 0.5:
        doc |= {"numTotalTests": rng.randrange(9), "numTodoTests": 1, "numPassedTests": rng.choice([1, -1, "1"])}
    if rng.random() < 0.6:
        doc["stats"] = rng.choice([{"tests": 4, "passes": 3, "failures": {"n": 1}}, {}, [{"tests": 1}], 5])
    if rng.random() < 0.2:
        doc |= {"type": "test", "event": {"status": "failed", "message": "m"}, "name": "n"}
    entries = []
    for i in range(rng.randrange(5)):
        entry = {"name": f"s{i}", "status": rng.choice(["failed", "passed"]), "x": random_value(rng)}
        if rng.random() < 0.6:
            entry["assertionResults"] = [
                {"status": rng.choice(["failed", "passed"]), "title": f"t{k}", "failureMessages": ["no {"]}
                for k in range(rng.randrange(3))
            ]
        entries.append(rng.choice([entry, entry, entry, 7]))
    doc["testResults"] = rng.choice([entries, entries, entries, {"a": 1}])
    items = list(doc.items())
    rng.shuffle(items)
    return dict(items)


def is_value(line):
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def spread(text, rng):
    """Line ends and blanks put between tokens, where no line becomes a value by itself."""
    out, inside, skip, line = [], False, False, ""
    for c in text:
        out.append(c)
        line += c
        if inside:
            skip, inside = c == "\\" and not skip, c != '"' or skip
        else:
            inside = c == '"'
            if c in "{}[],:" and rng.random() < 0.4:
                gap = rng.choice([" ", "\n", "\r\n", "\t\n ", "\n\n"])
                if "\n" not in gap or not is_value(line):
                    out.append(gap)
                    line = "" if "\n" in gap else line
    return "".join(out)


def broken(text, rng):
    """A document with one character lost, doubled or exchanged."""
    at = rng.randrange(len(text))
    return text[:at] + rng.choice(["", text[at] * 2, "]", "}", ",", "{", "[", '"', "1"]) + text[at + 1 :]


def results(spark, lines, limit, monkeypatch):
    monkeypatch.setattr(jsonlog, "GATHERED_BYTES", limit)
    states = {r.run_id: tuple(r[c] for c in COLUMNS) for r in jsonlog.json_run_state(lines).collect()}
    failures = sorted(map(str, jsonlog.json_failures(lines).collect()))
    return states, failures


def test_scanned_like_parsed(spark, monkeypatch):
    rng = random.Random(11)
    texts = []
    for _ in range(350):
        value = rng.choice([random_document(rng)] * 9 + [[random_document(rng)]])
        text = spread(json.dumps(value, ensure_ascii=False, indent=rng.choice([None, 1, 2])), rng)
        texts.append("\n" + text if "\n" not in text else text)
        texts.append(broken(text, rng))
    texts += ['{\n"stats": {"tests": 1},\n"stats": {"tests": 2}\n}', '{"testResults": [{"status":"failed"}],\n"testResults": 3, "numTotalTests": 1}',
              "[\n]", "{\n}", "[\n,]", "{\n,}", '{"a":\n}', "[\n[1],,2]", "[\n[1] 2]", '{"a":1\n[2]}', '{"a":\n{"b":1}"c":2}', "[1}\n", "{\n]", "[[\n}]", " [\n1] "]
    rows = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate(t.replace("\r\n", "\n").split("\n"), 1)]
    lines = spark.createDataFrame(rows, "run_id bigint, line_no int, line string").repartition(8).cache()
    whole = results(spark, lines, 1 << 20, monkeypatch)
    scanned = results(spark, lines, -1, monkeypatch)
    assert len(whole[1]) > 50 and sum(s[5] for s in whole[0].values()) > 50
    for run, state in whole[0].items():
        assert scanned[0][run] == state, (state, scanned[0][run], texts[run])
    assert scanned[1] == whole[1]


@pytest.mark.parametrize("value, found", [
    ("{", False), ('"', False), ("7", True), ("-", False), ("-7", True), ("true", True), ("{}", True), ('"x",', False),
    ('"a" "b"', False), ("1e5", True), ("[1] 2]", False), ("null", True), ("tree", False),
])
def test_one_value(spark, value, found):
    from testlog.functions.jsonvalue import json_value
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(value,)], "t string").select(json_value(F.col("t")).isNotNull().alias("x")).first()
    assert row.x == found
