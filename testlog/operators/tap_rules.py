"""How TAP lines act on one level of a stream, as a lookup table.

Each level (the top stream or one subtest body) is in one of 160 states; each
line falls in one of 60 classes.  ``transition`` states the rule once; the table
built from it drives an order-preserving fold inside Spark, and its columns are
functions on states, so the effect of a whole block of lines is again a small
array that can be combined with the next block's.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cache

from testlog.functions.tap import KIND, KINDS

# Modes of a level: idle, after a point (a YAML block may open), inside YAML,
# after a subtest heading without body, inside a subtest body.
IDLE, AFTER_POINT, YAML, HEADED, BODY = range(5)
# What is known of plan and points.
NOTHING, POINTS_ONLY, PLAN_FIRST, PLAN_LAST = range(4)
# Indentation of a line relative to its level.
FLUSH, STRAY, TWO, FOUR = range(4)

N_STATES = 5 * 4 * 2 * 2 * 2
N_KINDS = len(KINDS)

ROLES = (
    "captured",
    "yaml",
    "invalid_yaml",
    "blank",
    "version",
    "comment",
    "subtest",
    "indented",
    "bailout",
    "pragma",
    "plan",
    "extra_plan",
    "after_plan",
    "point",
    "resolving_point",
    "unsupported",
)
ROLE = {name: i for i, name in enumerate(ROLES)}


@dataclass(frozen=True)
class Level:
    mode: int = IDLE
    plan: int = NOTHING
    strict: bool = False
    content: bool = False  # a line other than blank or version was seen
    pending: bool = False  # a finished subtest waits for its parent point

    def index(self) -> int:
        flags = self.strict + 2 * self.content + 4 * self.pending
        return self.mode + 5 * (self.plan + 4 * flags)


def level_at(index: int) -> Level:
    mode, rest = index % 5, index // 5
    plan, flags = rest % 4, rest // 4
    return Level(mode, plan, bool(flags & 1), bool(flags & 2), bool(flags & 4))


def transition(now: Level, indent: int, kind: str) -> tuple[Level, str, int, int]:
    """State after a line, the line's role, its parse warnings and protocol failures."""
    penalty = 1 if now.strict else 0

    if now.mode in (HEADED, BODY):
        if indent == FOUR:
            return replace(now, mode=BODY), "captured", 0, 0
        if now.mode == HEADED and kind == "blank":
            return now, "blank", 0, 0
        now = replace(now, mode=IDLE, pending=now.pending or now.mode == BODY)
    elif now.mode == YAML:
        if indent == TWO and kind == "yaml_close":
            return replace(now, mode=IDLE), "yaml", 0, 0
        if indent in (TWO, FOUR):
            return now, "yaml", 0, 0
        return replace(now, mode=IDLE), "invalid_yaml", 1, penalty

    if kind == "blank":
        return now, "blank", 0, 0
    if kind in ("version", "bad_version"):
        bad = kind == "bad_version"
        return now, "version", int(bad), int(now.content) + (penalty if bad else 0)

    opens = now.mode == AFTER_POINT and indent == TWO and kind == "yaml_open"
    now = replace(now, content=True, mode=YAML if opens else IDLE)
    if opens:
        return now, "yaml", 0, 0

    unresolved = int(now.pending)
    if kind in ("subtest", "comment"):
        mode = HEADED if kind == "subtest" else IDLE
        return replace(now, mode=mode, pending=False), kind, 0, unresolved
    if indent != FLUSH:
        return now, "indented", 1, penalty

    waiting = now.pending
    if kind in ("point", "ok_like"):
        unresolved = 0
    else:
        now = replace(now, pending=False)

    if kind == "bailout":
        return now, "bailout", 0, unresolved
    if kind in ("strict_on", "strict_off"):
        return replace(now, strict=kind == "strict_on"), "pragma", 0, unresolved
    if kind == "pragma":
        return now, "pragma", 0, unresolved
    if kind == "plan":
        if now.plan in (PLAN_FIRST, PLAN_LAST):
            return now, "extra_plan", 0, unresolved + 1
        plan = PLAN_LAST if now.plan == POINTS_ONLY else PLAN_FIRST
        return replace(now, plan=plan), "plan", 0, unresolved
    if now.plan == PLAN_LAST:
        return now, "after_plan", 0, unresolved + 1
    if kind == "point":
        plan = POINTS_ONLY if now.plan == NOTHING else now.plan
        after = replace(now, plan=plan, mode=AFTER_POINT, pending=False)
        return after, "resolving_point" if waiting else "point", 0, 0
    return now, "unsupported", 1, unresolved + penalty


def line_class(indent: int, kind: int) -> int:
    return indent * N_KINDS + kind


# Lowest class of a line that belongs to an open subtest body.
FIRST_FOUR = line_class(FOUR, 0)


def pack(state: int, role: int, warnings: int, failures: int) -> int:
    return ((state * 16 + role) * 2 + warnings) * 4 + failures


@cache
def table() -> tuple[int, ...]:
    """Packed outcome for class * N_STATES + state."""
    cells = []
    for indent in (FLUSH, STRAY, TWO, FOUR):
        for kind in KINDS:
            for index in range(N_STATES):
                after, role, warnings, failures = transition(level_at(index), indent, kind)
                cells.append(pack(after.index(), ROLE[role], warnings, failures))
    return tuple(cells)


def start_state(strict: bool) -> int:
    return Level(strict=strict).index()


KIND_STRICT = (KIND["strict_on"], KIND["strict_off"])
