"""TAP streams: levels, protocol rules and the state of each run.

Lines of a run act on each other (plans, YAML blocks, subtests), so they are
folded in order.  A run of at most ``block_lines`` lines is one bounded group.  A longer run is cut into blocks;
per nesting depth the effect of every block is computed as a function on level
states, the functions are composed along the run, and each block is then folded
from its exact starting state.  No group ever exceeds ``block_lines`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from testlog.functions.tap import KIND, PAYLOAD, SUBTEST_PREFIX, UNNAMED_TEST, tap_tokens
from testlog.functions.text import MAX_UNSIGNED, to_bigint
from testlog.operators import tap_rules as R
from testlog.operators.durable import BLOCK_LINES, exceeds, materialize
from testlog.operators.tapfold import fold_streams
from testlog.schema import STATE_COLUMNS

SLICE = 64  # lines folded before their results are appended to the block's

_NO_PATH = "cast(array() as array<int>)"


def _with_table(fold: str) -> Column:
    """Evaluate a fold with the rule table bound to ``tbl`` (one constant)."""
    text = ",".join(map(str, R.table()))
    return F.expr(f"transform(array(cast(split('{text}', ',') as array<int>)), tbl -> {fold})[0]")


def _class_sql(depth: int) -> str:
    """Line class as seen ``depth`` subtests deep."""
    n = f"(spaces - {4 * depth})"
    off_by_one = f"{n} = 3 and kind in ({KIND['yaml_open']}, {KIND['yaml_close']})"
    indent = (
        f"case when {n} >= 4 then {R.FOUR} when {n} >= 2 then {R.TWO} "
        f"when {n} = 1 or ({n} = 0 and tab) then {R.STRAY} else {R.FLUSH} end"
    )
    return f"({indent}) * {R.N_KINDS} + if({off_by_one}, {KIND['other']}, kind)"


def _is_open(state: str) -> str:
    """Does a level in this state have an open subtest heading or body?"""
    return f"({state} % 5 >= {R.HEADED})"


def _lookup(cls: str, state: str) -> str:
    return f"tbl[{cls} * {R.N_STATES} + {state}]"


def _step_sql(depth: int, known: int, tail: str) -> str:
    """Accumulator after a line that lands ``depth`` levels down.

    ``known`` levels have a definite state; ``tail`` renders the remaining
    accumulator fields from ``c`` (the looked-up outcome) and ``depth``.
    """
    became = "cast(c div 128 as int)"
    states = []
    for k in range(known):
        if k < depth:
            states.append(f"a.st[{k}] - a.st[{k}] % 5 + {R.BODY}")
        elif k == depth:
            states.append(became)
        elif k == depth + 1:
            # a heading opens a fresh stream that inherits the strict flag
            strict = f"(({became} div 20) % 2)"
            fresh = f"if({strict} = 1, {R.start_state(True)}, {R.start_state(False)})"
            heading = f"((c div 8) % 16 = {R.ROLE['subtest']})"
            states.append(f"if({heading}, {fresh}, a.st[{k}])")
        else:
            states.append(f"a.st[{k}]")
    heads = []
    for k in range(known):
        if k == depth:
            heads.append(f"if((c div 8) % 16 = {R.ROLE['subtest']}, t.line_no, a.hd[{k}])")
        else:
            heads.append(f"a.hd[{k}]")
    body = f"named_struct('st', array({', '.join(states)}), 'hd', array({', '.join(heads)}){tail})"
    return f"transform(array({_lookup(f't.cls[{depth}]', f'a.st[{depth}]')}), c -> {body})[0]"


def _landing_case(known: int, branches: list[str]) -> str:
    """CASE over the depth at which a line is not captured any further."""
    whens = []
    for depth in range(known):
        captured = f"{_is_open(f'a.st[{depth}]')} and t.cls[{depth}] >= {R.FIRST_FOUR}"
        last = depth == len(branches) - 1
        whens.append("" if last else f"when not ({captured}) then {branches[depth]}")
    tail = branches[-1]
    return f"case {' '.join(w for w in whens if w)} else {tail} end" if any(whens) else tail


def _fold_sql(depths: int) -> str:
    """Fold an ordered token array from stack ``st``/``hd``; one result per token."""
    branches = []
    for depth in range(depths):
        path = f"slice(a.hd, 1, {depth})" if depth else _NO_PATH
        item = f"named_struct('path', {path}, 'mark', c, 'heading', a.hd[{depth}])"
        branches.append(_step_sql(depth, depths, f", 'out', concat(a.out, array({item}))"))
    merge = _landing_case(depths, branches)
    out_type = "array<struct<path:array<int>,mark:int,heading:int>>"
    empty = f"cast(array() as {out_type})"
    inner = (
        f"aggregate(slice(toks, i * {SLICE} + 1, {SLICE}), "
        f"named_struct('st', b.st, 'hd', b.hd, 'out', {empty}), (a, t) -> {merge})"
    )
    outer = (
        f"aggregate(sequence(0, (size(toks) - 1) div {SLICE}), "
        f"named_struct('st', st, 'hd', hd, 'out', {empty}), "
        f"(b, i) -> transform(array({inner}), r -> "
        f"named_struct('st', r.st, 'hd', r.hd, 'out', concat(b.out, r.out)))[0], z -> z.out)"
    )
    return outer


def _effect_sql(known: int) -> str:
    """Effect of a block on level ``known`` when the levels above it are known."""
    every_state = ",".join(map(str, range(R.N_STATES)))
    branches = []
    for depth in range(known):
        vec = "a.vec"
        if depth == known - 1:
            strict = "((c div 128) div 20) % 2"
            fresh = f"if({strict} = 1, {R.start_state(True)}, {R.start_state(False)})"
            vec = (
                f"if((c div 8) % 16 = {R.ROLE['subtest']}, "
                f"array_repeat({fresh}, {R.N_STATES}), a.vec)"
            )
        branches.append(_step_sql(depth, known, f", 'vec', {vec}"))
    apply = f"transform(a.vec, s -> cast({_lookup(f't.cls[{known}]', 's')} div 128 as int))"
    states = ", ".join(f"a.st[{k}] - a.st[{k}] % 5 + {R.BODY}" for k in range(known))
    st = f"array({states})" if known else _NO_PATH
    branches.append(f"named_struct('st', {st}, 'hd', a.hd, 'vec', {apply})")
    merge = _landing_case(known + 1, branches)
    start = f"named_struct('st', st, 'hd', hd, 'vec', array({every_state}))"
    return f"aggregate(toks, {start}, (a, t) -> {merge})"


def _classes(depths: int) -> Column:
    """Class of a line as seen from every depth."""
    return F.array(*[F.expr(_class_sql(d)).cast("int") for d in range(depths)])


def _blocks(tokens: DataFrame, keys: list[str], depths: int, payload: tuple[str, ...]) -> DataFrame:
    """Collect each group's tokens in line order; groups are bounded by the caller."""
    item = F.struct("line_no", _classes(depths).alias("cls"), "kind", *payload)
    return tokens.groupBy(*keys).agg(
        F.sort_array(F.collect_list(item)).alias("toks"), F.first("strict").alias("strict")
    )


def _null_heads(n: int) -> Column:
    return F.array(*[F.lit(None).cast("int") for _ in range(n)])


def _start_stack(depths: int) -> list[Column]:
    start = F.when(F.col("strict"), R.start_state(True)).otherwise(R.start_state(False))
    idle = [F.lit(R.start_state(False))] * (depths - 1)
    return [F.array(start, *idle).alias("st"), _null_heads(depths).alias("hd")]


def _with_strict(tokens: DataFrame, strict: DataFrame | bool) -> DataFrame:
    """Attach the enforced strict flag; enforced runs ignore strict pragmas."""
    if isinstance(strict, bool):
        tokens = tokens.withColumn("strict", F.lit(strict))
    else:
        tokens = tokens.join(strict.select("run_id", "strict"), "run_id", "left").withColumn(
            "strict", F.coalesce("strict", F.lit(False))
        )
    is_strict = F.col("kind").isin(*R.KIND_STRICT)
    return tokens.withColumn(
        "kind", F.when(F.col("strict") & is_strict, KIND["pragma"]).otherwise(F.col("kind"))
    )


def _explode(blocks: DataFrame, keys: list[str], depths: int, payload: tuple[str, ...]) -> DataFrame:
    mark = F.col("x.o.mark")
    folded = blocks.withColumn("out", _with_table(_fold_sql(depths)))
    rows = folded.select(
        *keys, F.explode_outer(F.arrays_zip(F.col("toks").alias("k"), F.col("out").alias("o"))).alias("x")
    )
    return rows.select(
        *keys,
        F.col("x.k.line_no").alias("line_no"),
        F.col("x.o.path").alias("path"),
        (F.expr("x.o.mark div 128")).cast("int").alias("state"),
        (F.expr("(x.o.mark div 8) % 16")).cast("int").alias("role"),
        (F.expr("(x.o.mark div 4) % 2")).cast("int").alias("warnings"),
        (mark % 4).cast("int").alias("violations"),
        F.col("x.o.heading").alias("heading"),
        F.col("x.k.kind").alias("kind"),
        *[F.col(f"x.k.{p}").alias(p) for p in payload],
    )


def _compose(blocks: DataFrame, fan: int) -> DataFrame:
    """Starting state of every block of a run, from the blocks' state functions.

    ``blocks(run_id, block, vec, start)``; ``start`` is the state of the first
    block.  Blocks are composed in groups of ``fan``, groups once more per run,
    so collected arrays stay short even for runs of billions of lines.
    """
    chain = (
        "aggregate(fs, array({ids}), (a, f) -> transform(a, s -> f.vec[s]))"
    ).format(ids=",".join(map(str, range(R.N_STATES))))
    walk = (
        "aggregate(fs, named_struct('s', start, 'out', cast(array() as array<struct<n:bigint,s:int>>)), "
        "(a, f) -> named_struct('s', f.vec[a.s], 'out', "
        "concat(a.out, array(named_struct('n', f.n, 's', a.s)))), z -> z.out)"
    )
    grouped = blocks.withColumn("grp", F.expr(f"block div {fan}"))
    lists = grouped.groupBy("run_id", "grp").agg(
        F.array_sort(F.collect_list(F.struct(F.col("block").alias("n"), "vec"))).alias("fs"),
        F.first("start").alias("start0"),
    )
    tops = (
        lists.select("run_id", "grp", "start0", F.expr(chain).alias("vec"))
        .groupBy("run_id")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col("grp").alias("n"), "vec"))).alias("fs"),
            F.first("start0").alias("start"),
        )
        .select("run_id", F.explode_outer(F.expr(walk)).alias("w"))
        .select("run_id", F.col("w.n").alias("grp"), F.col("w.s").alias("start"))
    )
    return (
        lists.join(tops, ["run_id", "grp"])
        .select("run_id", F.explode_outer(F.expr(walk)).alias("w"))
        .select("run_id", F.col("w.n").alias("block"), F.col("w.s").alias("start"))
    )


def _carry_heading(blocks: DataFrame, fan: int) -> DataFrame:
    """Last heading line before each block, carried over blocks in two steps."""
    grouped = blocks.withColumn("grp", F.expr(f"block div {fan}"))
    inner = W.partitionBy("run_id", "grp").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("run_id").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)
    tops = (
        grouped.groupBy("run_id", "grp")
        .agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("block"))).alias("last"))
        .select("run_id", "grp", F.last("last", ignorenulls=True).over(outer).alias("before"))
    )
    return grouped.join(tops, ["run_id", "grp"]).select(
        "run_id",
        "block",
        F.coalesce(F.last("head", ignorenulls=True).over(inner), F.col("before")).alias("head"),
    )


def _block_starts(blocks: DataFrame, depths: int, fan: int) -> DataFrame:
    """Exact stack (``st``, ``hd``) at the start of every block of long runs.

    One round per nesting depth: with the levels above settled, a block's effect
    on the next level is a function, and the functions are composed.
    """
    start = F.when(F.col("strict"), R.start_state(True)).otherwise(R.start_state(False))
    known = blocks.select("run_id", "block").withColumn("st", F.expr(_NO_PATH)).withColumn(
        "hd", F.expr(_NO_PATH)
    )
    for depth in range(depths):
        folded = blocks.join(known, ["run_id", "block"]).withColumn(
            "acc", _with_table(_effect_sql(depth))
        )
        effect = materialize(
            folded.select(
                "run_id",
                "block",
                "st",
                "hd",
                F.col("acc.vec").alias("vec"),
                (F.expr(f"acc.hd[{depth - 1}]") if depth else F.lit(None).cast("int")).alias("head"),
                (start if depth == 0 else F.lit(R.start_state(False))).alias("start"),
            )
        )
        states = _compose(effect.select("run_id", "block", "vec", "start"), fan)
        if depth == 0:
            settled = effect.join(states.select("run_id", "block", F.col("start").alias("s")), ["run_id", "block"])
        else:
            heads = _carry_heading(effect.select("run_id", "block", "head"), fan)
            settled = effect.join(
                states.select("run_id", "block", F.col("start").alias("s")), ["run_id", "block"]
            ).join(heads.select("run_id", "block", F.col("head").alias("h")), ["run_id", "block"])
            slots = [F.col("hd")[k] for k in range(depth - 1)] + [F.col("h")]
            settled = settled.withColumn("hd", F.array(*slots))
        settled = settled.select(
            "run_id",
            "block",
            F.concat("st", F.array("s")).alias("st"),
            F.concat("hd", F.array(F.lit(None).cast("int"))).alias("hd"),
        )
        known = materialize(settled)
    # The deepest level's own heading also needs its carry for resolving points.
    final = blocks.join(known, ["run_id", "block"]).withColumn(
        "acc", _with_table(_effect_sql_full(depths))
    )
    heads = _carry_heading(
        final.select("run_id", "block", F.expr(f"acc.hd[{depths - 1}]").alias("head")), fan
    )
    slots = [F.col("hd")[k] for k in range(depths - 1)] + [F.col("h")]
    return known.join(
        heads.select("run_id", "block", F.col("head").alias("h")), ["run_id", "block"]
    ).select("run_id", "block", "st", F.array(*slots).alias("hd"))


def _effect_sql_full(depths: int) -> str:
    branches = [_step_sql(d, depths, "") for d in range(depths)]
    return f"aggregate(toks, named_struct('st', st, 'hd', hd), (a, t) -> {_landing_case(depths, branches)})"


def nesting(lines: DataFrame) -> int:
    """How deep subtests of any run can be nested.

    A level needs a heading on the level above it, indented by four spaces per level, so
    the levels are those reached by headings without a gap.  The driver gets one
    number per indentation in use.
    """
    body = F.ltrim(F.col("line"))
    spaces = F.char_length("line") - F.char_length(body)
    headings = lines.filter(body.startswith(SUBTEST_PREFIX)).select((spaces / 4).cast("int").alias("level"))
    levels = {r.level for r in headings.distinct().collect()}
    depth = 0
    while depth in levels:
        depth += 1
    return depth


def tap_events(
    lines: DataFrame,
    strict: DataFrame | bool = False,
    max_depth: int | None = None,
    block_lines: int = BLOCK_LINES,
    payload: tuple[str, ...] = PAYLOAD,
    long_runs: bool | None = None,
) -> DataFrame:
    """Place every line of every run on its level and settle its role.

    ``strict`` is a flag for all runs or a table ``(run_id, strict)``.
    ``long_runs`` says whether some run has more than ``block_lines`` lines;
    leave it out to have that checked.  ``max_depth`` bounds the nesting of subtests;
    leave it out to follow them as deep as they go.
    """
    depths = (nesting(lines) if max_depth is None else max_depth) + 1
    tokens = _with_strict(tap_tokens(lines.select("run_id", "line_no", "line")), strict)
    if long_runs is None:
        long_runs = exceeds(lines, "line_no", block_lines)
    if not long_runs:
        short = _blocks(tokens, ["run_id"], depths, payload)
        return _explode(short.select("*", *_start_stack(depths)), ["run_id"], depths, payload)

    tokens = materialize(tokens)
    ids = materialize(tokens.filter(F.col("line_no") > block_lines).select("run_id").distinct())
    short = _blocks(tokens.join(ids, "run_id", "left_anti"), ["run_id"], depths, payload)
    events = _explode(short.select("*", *_start_stack(depths)), ["run_id"], depths, payload)
    cut = tokens.join(ids, "run_id", "left_semi").withColumn(
        "block", F.expr(f"(line_no - 1) div {block_lines}")
    )
    blocks = materialize(_blocks(cut, ["run_id", "block"], depths, payload))
    starts = _block_starts(blocks, depths, fan=block_lines)
    long = _explode(
        blocks.join(starts, ["run_id", "block"]), ["run_id", "block"], depths, payload
    )
    return events.unionByName(long.drop("block"))


def tap_levels(lines: DataFrame, **options) -> DataFrame:
    """Each line's (sub)stream: ``path`` holds the line numbers of enclosing headings."""
    events = tap_events(lines, payload=(), **options)
    return events.select(
        "run_id",
        "line_no",
        "path",
        (F.col("role") == R.ROLE["captured"]).alias("depth_exceeded"),
    )


def tap_classify(lines: DataFrame, **options) -> DataFrame:
    """Each line's role on its level, with the warnings and violations it causes."""
    names = F.array(*[F.lit(r) for r in R.ROLES])
    events = tap_events(lines, payload=(), **options)
    return events.select(
        "run_id",
        "line_no",
        "path",
        F.replace(names[F.col("role")], F.lit("resolving_"), F.lit("")).alias("kind"),
        "warnings",
        "violations",
    )


def _points_only(events: DataFrame) -> DataFrame:
    return events.filter(F.col("role").isin(R.ROLE["point"], R.ROLE["resolving_point"]))


def tap_points(events: DataFrame, block_lines: int | None = BLOCK_LINES) -> DataFrame:
    """Test points with their ids, missing ids filled in, a block of lines at a time."""
    return _points_only(fill_ids(events, block_lines)).select(
        "run_id", "path", "line_no", "ok", "raw_id", "id", "description", "directive"
    )


def fill_ids(events: DataFrame, block_lines: int | None = None) -> DataFrame:
    """A point without id takes the previous id on its level plus one.

    With ``block_lines`` windows cover a block of lines each, and the count and
    the id offset reached before a block are carried in from the blocks before.
    """
    is_point = F.col("role").isin(R.ROLE["point"], R.ROLE["resolving_point"])
    keys = ["run_id", "path"] if block_lines is None else ["run_id", "path", "block"]
    if block_lines is not None:
        events = events.withColumn("block", F.expr(f"(line_no - 1) div {block_lines}"))
    w = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rank = F.count(F.when(is_point, 1)).over(w)
    ranked = events.withColumn("rank", rank.cast("decimal(20,0)")).withColumn(
        "shift", F.when(is_point, F.col("raw_id") - F.col("rank"))
    )
    ranked = ranked.withColumn("shift_here", F.last("shift", ignorenulls=True).over(w))
    if block_lines is None:
        number = F.col("rank") + F.coalesce("shift_here", F.lit(0))
    else:
        over = W.partitionBy("run_id", "path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        carried = (
            ranked.groupBy(*keys)
            .agg(
                F.max("rank").alias("n"),
                F.max_by("shift", F.when(F.col("shift").isNotNull(), F.col("line_no"))).alias("s"),
            )
            .withColumn("n0", F.coalesce(F.sum("n").over(over), F.lit(0)).cast("decimal(20,0)"))
            .withColumn("s0", F.last(F.col("s") - F.col("n0"), ignorenulls=True).over(over))
            .select(*keys, "n0", "s0")
        )
        ranked = ranked.join(carried, keys)
        number = (
            F.col("rank")
            + F.col("n0")
            + F.coalesce(F.col("shift_here") - F.col("n0"), F.col("s0"), F.lit(0))
        )
    capped = F.least(number, F.lit(str(MAX_UNSIGNED)).cast("decimal(20,0)")).cast("decimal(20,0)")
    return ranked.withColumn("id", F.when(is_point, capped)).drop(
        "rank", "shift", "shift_here", "n0", "s0", "block"
    )


def tap_stream_states(
    events: DataFrame, long_runs: bool = False, block_lines: int = BLOCK_LINES
) -> DataFrame:
    """Counters of every TAP (sub)stream by itself, one row per (run_id, path).

    Nothing is passed between levels yet; see ``rollup_subtests``.
    """
    numbered = fill_ids(events, block_lines if long_runs else None)
    resolving = F.col("role") == R.ROLE["resolving_point"]
    # A resolving point also reports to the subtest it stands for.
    rows = numbered.withColumn(
        "about_child",
        F.explode_outer(F.when(resolving, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))),
    ).withColumn(
        "path",
        F.when(F.col("about_child"), F.concat("path", F.array("heading"))).otherwise(F.col("path")),
    )
    own = ~F.col("about_child")
    point = own & F.col("id").isNotNull()
    plain = point & F.col("directive").isNull()
    is_plan = own & (F.col("role") == R.ROLE["plan"])
    is_bailout = own & (F.col("role") == R.ROLE["bailout"])
    version = own & (F.col("role") == R.ROLE["version"])
    only = F.when
    agg = rows.groupBy("run_id", "path").agg(
        F.count_if(point).alias("total"),
        F.count_if(plain & F.col("ok")).alias("passed"),
        F.count_if(plain & ~F.col("ok")).alias("failed"),
        F.count_if(point & (F.col("directive") == "TODO")).alias("todo"),
        F.count_if(point & (F.col("directive") == "SKIP")).alias("skipped"),
        F.min_by("reason", only(is_bailout, F.col("line_no"))).alias("bailout_reason"),
        F.sum(only(own, F.col("warnings")).otherwise(0)).alias("parse_warning_count"),
        F.sum(only(own, F.col("violations")).otherwise(0)).alias("violations"),
        F.count_if(version).alias("versions"),
        F.max(only(is_plan, F.col("plan_start"))).alias("plan_start"),
        F.max(only(is_plan, F.col("plan_end"))).alias("plan_end"),
        F.min(only(point, F.col("id"))).alias("low_id"),
        F.max(only(point, F.col("id"))).alias("high_id"),
        F.count_distinct(only(point, F.col("id"))).alias("ids"),
        F.max(only(own, F.struct("line_no", "state")))["state"].alias("last_state"),
        F.max(only(own & (F.col("role") == R.ROLE["subtest"]), F.col("line_no"))).alias("last_heading"),
        F.count_if(own & (F.col("role") == R.ROLE["captured"])).alias("depth_exceeded"),
        F.bool_or(only(~own, F.col("ok"))).alias("parent_ok"),
        F.max(only(~own, F.col("directive"))).alias("parent_directive"),
    )
    return _judged(agg)


def _judged(counts: DataFrame) -> DataFrame:
    """Planned tests and protocol failures of streams by themselves, from what they count."""
    start, end = F.col("plan_start"), F.col("plan_end")
    empty_plan = (start == 1) & (end == 0)
    planned = (
        F.when(empty_plan, F.lit(0).cast("bigint"))
        .when(start <= end, to_bigint((end - start + 1).cast("decimal(21,0)")))
    )
    no_plan = start.isNull()

    def one(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    own_failures = (
        F.col("violations")
        + F.greatest(F.col("versions") - 1, F.lit(0))
        + one(no_plan)
        + one(start != 1)
        + one((start > end) & ~empty_plan)
        + one(empty_plan & (F.col("total") > 0))
        + one((F.col("low_id") < start) | (F.col("high_id") > end))
        + (F.col("total") - F.col("ids"))
    )
    return counts.select(
        "run_id",
        "path",
        planned.alias("planned"),
        "total",
        "passed",
        "failed",
        "todo",
        "skipped",
        "bailout_reason",
        "parse_warning_count",
        own_failures.cast("bigint").alias("protocol_failures"),
        "last_state",
        "last_heading",
        "depth_exceeded",
        "parent_ok",
        "parent_directive",
    )


def _closing_failures() -> Column:
    """Violations found when a stream ends with a subtest still open or unresolved."""
    mode = F.col("last_state") % 5
    pending = F.expr("(last_state div 80) % 2") == 1
    has_body = F.col("last_heading") == F.col("last_child")
    return (
        F.when(mode == R.HEADED, F.when(has_body, 1).otherwise(2))
        .when((mode == R.BODY) | pending, 1)
        .otherwise(0)
    )


def _success() -> Column:
    return (
        (F.col("failed") == 0)
        & F.col("bailout_reason").isNull()
        & (F.col("planned").isNull() | (F.col("planned") == F.col("total")))
        & (F.col("protocol_failures") == 0)
    )


def rollup_subtests(streams: DataFrame) -> DataFrame:
    """Pass warnings and violations of subtests up, deepest level first.

    A subtest that bailed out, or whose parent point contradicts it, adds one
    violation to its parent.  Test counts are not passed up.  ``streams`` holds
    one row per stream, so each pass is one small aggregate.
    """
    streams = materialize(streams)
    deepest = streams.agg(F.max(F.size("path"))).first()[0] or 0

    def closed(level: DataFrame) -> DataFrame:
        return level.withColumn(
            "protocol_failures", F.col("protocol_failures") + _closing_failures()
        )

    done = []
    level = streams.filter(F.size("path") == deepest).withColumn(
        "last_child", F.lit(None).cast("int")
    )
    for depth in range(deepest, 0, -1):
        level = closed(level)
        done.append(level)
        mismatch = F.col("parent_directive").isNull() & (F.col("parent_ok") != _success())
        added = level.groupBy("run_id", F.slice("path", 1, depth - 1).alias("path")).agg(
            F.sum("parse_warning_count").alias("add_warnings"),
            F.sum(
                F.col("protocol_failures")
                + F.when(F.col("bailout_reason").isNotNull(), 1).otherwise(0)
                + F.when(mismatch, 1).otherwise(0)
            ).alias("add_failures"),
            F.max(F.element_at("path", -1)).alias("last_child"),
        )
        parents = streams.filter(F.size("path") == depth - 1)
        zero = F.lit(0)
        level = (
            parents.join(added, ["run_id", "path"], "left")
            .withColumn(
                "parse_warning_count",
                F.col("parse_warning_count") + F.coalesce("add_warnings", zero),
            )
            .withColumn(
                "protocol_failures",
                F.col("protocol_failures") + F.coalesce("add_failures", zero),
            )
            .drop("add_warnings", "add_failures")
        )
        level = materialize(level) if depth > 1 else level
    done.append(closed(level))
    columns = ["run_id", "path", *STATE_COLUMNS, "depth_exceeded", "parent_ok", "parent_directive"]
    return reduce(DataFrame.unionByName, [d.select(*columns) for d in done])


def correlate_subtests(states: DataFrame) -> DataFrame:
    """Does each subtest agree with its parent point?  (null: nothing to compare)"""
    subtests = states.filter(F.size("path") > 0)
    agrees = F.when(F.col("parent_directive").isNull(), F.col("parent_ok") == _success())
    return subtests.select(
        "run_id", "path", _success().alias("success"), "parent_ok", agrees.alias("agrees")
    )


def tap_states(
    lines: DataFrame,
    strict: DataFrame | bool = False,
    max_depth: int | None = None,
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """State of every stream, subtests included, one row per (run_id, path)."""
    return rollup_subtests(line_stream_states(lines, strict, max_depth, block_lines))


def line_stream_states(
    lines: DataFrame,
    strict: DataFrame | bool = False,
    max_depth: int | None = None,
    block_lines: int = BLOCK_LINES,
    long_runs: bool | None = None,
) -> DataFrame:
    """``tap_stream_states`` of the lines' events; short runs are folded without making events of their lines."""
    depth = nesting(lines) if max_depth is None else max_depth
    if long_runs is None:
        long_runs = exceeds(lines, "line_no", block_lines)
    short = lines
    if long_runs:
        ids = materialize(lines.filter(F.col("line_no") > block_lines).select("run_id").distinct())
        short = lines.join(ids, "run_id", "left_anti")
    tokens = _with_strict(tap_tokens(short.select("run_id", "line_no", "line")), strict)
    streams = _judged(fold_streams(tokens, depth + 1, _classes(depth + 1)))
    if not long_runs:
        return streams
    events = tap_events(lines.join(ids, "run_id", "left_semi"), strict, depth, block_lines, long_runs=True)
    return streams.unionByName(tap_stream_states(events, True, block_lines))


def tap_run_state(
    lines: DataFrame,
    strict: DataFrame | bool = False,
    max_depth: int | None = None,
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """State of every TAP run: one row per run_id."""
    states = tap_states(lines, strict, max_depth, block_lines)
    return states.filter(F.size("path") == 0).select("run_id", *STATE_COLUMNS)


def tap_failures(events: DataFrame) -> DataFrame:
    """Failing top-level points; failures inside subtests are not listed."""
    failing = (
        (F.size("path") == 0)
        & F.col("role").isin(R.ROLE["point"], R.ROLE["resolving_point"])
        & ~F.col("ok")
        & F.col("directive").isNull()
    )
    label = F.coalesce("description", F.lit(UNNAMED_TEST))
    none = F.lit(None).cast("string")
    return events.filter(failing).select(
        "run_id",
        "line_no",
        F.lit(0).alias("item_no"),
        F.lit("TAP").alias("source"),
        label.alias("label"),
        none.alias("suite"),
        none.alias("test_file"),
        label.alias("reason"),
    )
