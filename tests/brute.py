"""Plain sequential folds used only to check the Spark operators on small inputs."""

from __future__ import annotations

import re

WS = " \t\n\x0b\x0c\r\x85\xa0       　"
ZERO = dict(
    planned=None, total=0, passed=0, failed=0, todo=0, skipped=0,
    bailout_reason=None, parse_warning_count=0, protocol_failures=0,
)
MAX = 2**64 - 1


def number(text):
    return int(text) if re.fullmatch(r"\+?[0-9]+", text) and int(text) <= MAX else None


def unescape(text):
    return re.sub(r"\\([\\#])", r"\1", text.strip(WS))


def good(s):
    return (
        s["failed"] == 0 and s["bailout_reason"] is None and s["protocol_failures"] == 0
        and s["planned"] in (None, s["total"])
    )


def parse_point(t):
    for word in ("not ok", "ok"):
        if t == word or t.startswith(word + " "):
            m = re.fullmatch(r"\s*([0-9]*)\s*-?\s*(.*)", t[len(word):], re.S)
            digits, body = m.groups()
            directive, text = None, body
            at = re.search(r"\s#\s", body)
            if at:
                words = body[at.end() - 1:].split()
                if words and words[0].upper() in ("TODO", "SKIP"):
                    directive, text = words[0].upper(), body[: at.start()]
            return word == "ok", number(digits) if digits else None, directive, unescape(text) or None
    return None


def tap(lines, strict=False, enforced=None):
    """Returns (state, labels of listed failures)."""
    enforced = strict if enforced is None else enforced
    s, labels = dict(ZERO), []
    yaml = may_open = False
    body = None  # lines of the open subtest
    waiting = None  # state of a finished subtest
    version = content = False
    plan = None
    trailing = False
    last_id, ids = 0, set()

    def warn(bad=True):
        s["parse_warning_count"] += 1
        s["protocol_failures"] += int(bool(strict))

    def violation(n=1):
        s["protocol_failures"] += n

    def close(inner):
        child, _ = tap(inner, strict, enforced)
        s["parse_warning_count"] += child["parse_warning_count"]
        violation(child["protocol_failures"] + (child["bailout_reason"] is not None))
        return child

    for line in lines:
        t = line.strip(WS)
        if body is not None:
            if line.startswith("    "):
                body.append(line[4:])
                continue
            if not body and not t:
                continue
            if body:
                waiting = close(body)
            body = None
        if yaml:
            yaml = line.startswith("  ") and not line.startswith("  ...")
            if not line.startswith("  "):
                warn()
            continue
        if not t:
            continue
        if t.startswith("TAP version "):
            violation(version + content)
            version = True
            if re.sub(r"^(TAP version )+", "", t).strip(WS) not in ("13", "14"):
                warn()
            continue
        content = True
        opening, may_open = may_open, False
        if opening and line.startswith("  ---"):
            yaml = True
            continue
        if t[0] == "#":
            violation(waiting is not None)
            waiting = None
            if t.startswith("# Subtest:"):
                body = []
            continue
        if line[0] in " \t":
            warn()
            continue
        if waiting is not None and not t.startswith(("ok", "not ok")):
            violation()
            waiting = None
        if t[:9].lower() == "bail out!":
            if s["bailout_reason"] is None:
                s["bailout_reason"] = unescape(t[9:])
            continue
        m = re.fullmatch(r"pragma ([+-])([A-Za-z0-9_-]+)", t)
        if m:
            if m[2].lower() == "strict" and not enforced:
                strict = m[1] == "+"
            continue
        left, dots, right = t.partition("..")
        bounds = (number(left.strip(WS)), number(right.split(" #", 1)[0].strip(WS)))
        if dots and None not in bounds:
            if plan:
                violation()
                continue
            plan, trailing = bounds, s["total"] > 0
            violation(bounds[0] != 1)
            if bounds == (1, 0):
                s["planned"] = 0
            elif bounds[0] > bounds[1]:
                violation()
            else:
                s["planned"] = bounds[1] - bounds[0] + 1
            continue
        if trailing:
            violation()
            continue
        point = parse_point(t)
        if point:
            ok, raw, directive, text = point
            if waiting is not None:
                violation(directive is None and ok != good(waiting))
                waiting = None
            last_id = min(last_id + 1, MAX) if raw is None else raw
            violation(last_id in ids)
            ids.add(last_id)
            s["total"] += 1
            kind = {"TODO": "todo", "SKIP": "skipped", None: "passed" if ok else "failed"}[directive]
            s[kind] += 1
            if kind == "failed":
                labels.append(text or "unnamed test")
            may_open = True
            continue
        warn()
    if body is not None:
        waiting = close(body)
    violation(waiting is not None)
    violation(plan is None)
    violation(s["planned"] == 0 and s["total"] > 0)
    if plan:
        violation(any(not plan[0] <= i <= plan[1] for i in ids))
    return s, labels
