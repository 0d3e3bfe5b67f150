"""Run level: verdicts, merging of states, settings and report choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testlog.functions.text import unsigned, to_bigint, utrim
from testlog.schema import COUNTERS, STATE_COLUMNS

# Report locations of each build tool, as path patterns.
REPORT_GLOBS = {
    "gradle": ("**/build/test-results/**/*.xml",),
    "maven": ("**/target/surefire-reports/TEST-*.xml", "**/target/failsafe-reports/TEST-*.xml"),
}
TOOL_PROGRAMS = {"gradle": "gradle", "gradlew": "gradle", "mvn": "maven", "mvnw": "maven"}

# Fixed value: file times may lag behind the clock by this much.
FRESHNESS_TOLERANCE = "INTERVAL 2 SECONDS"

# Setting layers from weakest to strongest, and the settings.
LAYERS = ("default", "user", "local", "env", "cli")
TRUE_WORDS = ("1", "true", "yes", "on")
FALSE_WORDS = ("0", "false", "no", "off")
BOOLEANS = {
    "quiet_parse_errors": False,
    "strict": False,
    "enabled": True,
    "include_project_context": True,
    "auto_runner_adapt": True,
    "junit_only": False,
    "auto_junit_reports": True,
    "dedup_failures": True,
    "trace_detection": False,
}
CHOICES = {
    "desktop": ("auto", "force-on", "force-off"),
    "input_format": ("auto", "tap", "json", "bun"),
    "summary_format": ("none", "text", "json"),
    "run_output": ("split", "merged", "off"),
}
CHOICE_DEFAULTS = {
    "desktop": "auto", "input_format": "auto", "summary_format": "none", "run_output": "split",
}
DESKTOP_WORDS = {
    "force_on": "force-on", "on": "force-on", "enabled": "force-on",
    "force_off": "force-off", "off": "force-off", "disabled": "force-off",
}
LISTS = ("junit_file", "junit_dir", "junit_glob")
TEXTS = ("project_label", "summary_file")
NUMBERS = ("max_failure_notifications",)


def plan_mismatch() -> Column:
    return F.coalesce(F.col("planned") != F.col("total"), F.lit(False))


def is_success() -> Column:
    """Parse warnings do not matter."""
    return (
        (F.col("failed") == 0)
        & F.col("bailout_reason").isNull()
        & ~plan_mismatch()
        & (F.col("protocol_failures") == 0)
    )


def _switch(value: Column, mapping: dict[str, str]) -> Column:
    return F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), value), value
    )


def _canonical() -> Column:
    """A setting's value in one spelling; null when it does not parse."""
    key, value, env = F.col("key"), F.col("value"), F.col("layer") == "env"
    word = F.when(env, F.lower(utrim(value))).otherwise(value)
    yes = F.when(env, word.isin(*TRUE_WORDS)).otherwise(word == "true")
    no = F.when(env, word.isin(*FALSE_WORDS)).otherwise(word == "false")
    truth = F.when(yes, F.lit("true")).when(no, F.lit("false"))
    out = F.when(key.isin(*BOOLEANS), truth)
    for name, allowed in CHOICES.items():
        spelled = F.when(env, _switch(word, DESKTOP_WORDS)).otherwise(word) if name == "desktop" else word
        out = out.when(key == name, F.when(spelled.isin(*allowed), spelled))
    number = utrim(value)
    out = out.when(
        key.isin(*NUMBERS), F.when(number.rlike(r"\A[+]?[0-9]+\z") & unsigned(number).isNotNull(), number)
    )
    # an empty list from the environment or command line counts as not given
    entries = F.array_join(
        F.filter(F.transform(F.split(value, ","), lambda e: utrim(e)), lambda e: e != ""), ","
    )
    out = out.when(
        key.isin(*LISTS),
        F.when((entries != "") | F.col("layer").isin("user", "local"), entries),
    )
    label = F.when(F.col("layer").isin("user", "local"), value).otherwise(utrim(value))
    out = out.when(key == "project_label", F.when(utrim(value) == "", F.lit("")).otherwise(label))
    path = F.when(env, F.nullif(utrim(value), F.lit(""))).otherwise(value)
    return out.when(key == "summary_file", path)


def ranked_settings(settings: DataFrame) -> DataFrame:
    """Parsed settings with their precedence; what does not parse is left out."""
    inverted = F.col("key") == "no_notify"
    rows = settings.withColumn("inverted", inverted).withColumn(
        "key", F.when(inverted, F.lit("enabled")).otherwise(F.col("key"))
    )
    value = _canonical()
    flipped = F.when(value == "true", "false").when(value == "false", "true")
    rank = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer")) * 2
    return rows.select(
        "run_id",
        "layer",
        "key",
        F.when(F.col("inverted"), flipped).otherwise(value).alias("value"),
        # within a layer the positive switch is read after the negative one
        (rank + F.when(F.col("inverted"), 0).otherwise(1)).cast("int").alias("rank"),
    ).filter((F.col("value").isNotNull()) & (F.col("rank") >= 2))


def winning_settings(settings: DataFrame) -> DataFrame:
    """Per run and key the value of the strongest layer, and that layer."""
    best = F.max_by(F.struct("value", "layer"), "rank")
    return (
        ranked_settings(settings)
        .groupBy("run_id", "key")
        .agg(best.alias("best"))
        .select("run_id", "key", "best.value", "best.layer")
    )


def resolve_settings(runs: DataFrame, settings: DataFrame) -> DataFrame:
    """One typed row of effective settings per run, built-in defaults filled in.

    ``enabled_layer`` and ``desktop_layer`` tell where those two came from.
    """
    keys = (*BOOLEANS, *CHOICES, *LISTS, *TEXTS, *NUMBERS)
    best = [
        F.max_by(F.struct("value", "layer"), F.when(F.col("key") == k, F.col("rank"))).alias(k)
        for k in keys
    ]
    wide = ranked_settings(settings).groupBy("run_id").agg(*best)
    rows = runs.select("run_id").join(wide, "run_id", "left")

    def value(k: str) -> Column:
        return F.col(f"{k}.value")

    typed = [F.coalesce(value(k) == "true", F.lit(d)).alias(k) for k, d in BOOLEANS.items()]
    typed += [F.coalesce(value(k), F.lit(CHOICE_DEFAULTS[k])).alias(k) for k in CHOICES]
    empty = F.array().cast("array<string>")
    typed += [
        F.when(F.coalesce(value(k), F.lit("")) == "", empty).otherwise(F.split(value(k), ",")).alias(k)
        for k in LISTS
    ]
    typed += [F.nullif(value(k), F.lit("")).alias(k) for k in TEXTS]
    typed += [to_bigint(unsigned(value(k))).alias(k) for k in NUMBERS]
    layers = [
        F.coalesce(F.col(f"{k}.layer"), F.lit("default")).alias(f"{k}_layer")
        for k in ("enabled", "desktop")
    ]
    return rows.select("run_id", *typed, *layers)


def executable(program: Column) -> Column:
    """Lower-cased base name of a program path."""
    return F.lower(F.regexp_extract(program, r"([^/]*)/*\z", 1))


def infer_tool(runs: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Build tool a run's command stands for: gradle, maven, pytest or null.

    Only where reports are looked for automatically and none was configured;
    pytest counts when the runner may be adapted and writes no report of its own.
    """
    command = F.col("command")
    program = executable(F.get(command, F.lit(0)))
    tools = F.create_map(*[F.lit(x) for kv in TOOL_PROGRAMS.items() for x in kv])
    arg1, arg2, arg3 = (F.get(command, F.lit(i)) for i in (1, 2, 3))
    as_module = F.expr(
        "exists(sequence(1, greatest(size(command) - 1, 1)), "
        "i -> get(command, i - 1) = '-m' and get(command, i) = 'pytest')"
    )
    wrapped = (arg1 == "run") & ((arg2 == "pytest") | ((arg2 == "--") & (arg3 == "pytest")))
    pytest = (
        (program == "pytest")
        | (((program == "python") | program.startswith("python3")) & as_module)
        | (program.isin("uv", "poetry") & wrapped)
    )
    reports_itself = F.exists(command, lambda a: (a == "--junitxml") | a.startswith("--junitxml="))
    adapt, auto, explicit = F.lit(True), F.lit(True), F.lit(False)
    if settings is not None:
        runs = runs.join(
            settings.select("run_id", "auto_runner_adapt", "auto_junit_reports", *LISTS), "run_id", "left"
        )
        adapt = F.coalesce("auto_runner_adapt", F.lit(True))
        auto = F.coalesce("auto_junit_reports", F.lit(True))
        explicit = F.coalesce(
            (F.size("junit_file") + F.size("junit_dir") + F.size("junit_glob")) > 0, F.lit(False)
        )
    found = F.when(F.coalesce(pytest & ~reports_itself, F.lit(False)) & adapt, F.lit("pytest")).otherwise(
        F.element_at(tools, program)
    )
    return runs.select("run_id", explicit.alias("explicit"), F.when(auto & ~explicit, found).alias("tool"))


def glob_pattern(glob: str) -> str:
    """A path glob as an anchored regular expression."""
    out = ""
    i = 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in ".^$+?()[]{}|" else glob[i]), i + 1
    return rf"\A{out}\z"


def infer_report_globs(runs: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Report path globs of runs whose tool is known to leave reports: (run_id, tool, glob)."""
    globs = F.create_map(
        *[x for tool, gs in REPORT_GLOBS.items() for x in (F.lit(tool), F.array(*map(F.lit, gs)))]
    )
    return infer_tool(runs, settings).select(
        "run_id", "tool", F.explode_outer(F.element_at(globs, F.col("tool"))).alias("glob")
    ).filter(F.col("glob").isNotNull())


def inferred_reports(reports: DataFrame, globs: DataFrame) -> DataFrame:
    """Reports whose path matches one of the run's inferred globs."""
    by_tool = [
        (F.col("tool") == tool) & F.col("path").rlike("|".join(glob_pattern(g) for g in gs))
        for tool, gs in REPORT_GLOBS.items()
    ]
    tools = globs.select("run_id", "tool").distinct()
    match = by_tool[0] | by_tool[1]
    return reports.join(tools, "run_id").filter(match).select(reports.columns)


def glob_regex(glob: Column) -> Column:
    """A column of path globs as anchored regular expressions.

    ``**/`` stands for any folders or none, ``*`` and ``?`` stay within one name, ``[...]`` is a choice
    of characters and ``[!...]`` all others.
    """
    out = F.regexp_replace(glob, r"[.^$+(){}|\\]", r"\\$0")
    out = F.regexp_replace(out, r"\[!", "[^")
    out = F.regexp_replace(out, r"\?", "[^/]")
    # wild cards are set aside, since what stands for one holds others
    out = F.replace(F.replace(out, F.lit("**/"), F.lit("\x01")), F.lit("**"), F.lit("\x02"))
    out = F.replace(out, F.lit("*"), F.lit("[^/]*"))
    out = F.replace(F.replace(out, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*"))
    return F.concat(F.lit(r"\A"), out, F.lit(r"\z"))


def report_inputs(settings: DataFrame) -> DataFrame:
    """The configured report inputs of every run: (run_id, kind, pattern, folder).

    A directory stands for all ``*.xml`` below it.  ``folder`` is the part of a pattern before its first
    wild card, up to a slash; a named file has none.
    """
    below = F.transform("junit_dir", lambda d: F.concat(F.regexp_replace(d, "/+$", ""), F.lit("/**/*.xml")))

    def named(kind: str, patterns: Column) -> Column:
        return F.transform(patterns, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("pattern")))

    each = [named("file", F.col("junit_file")), named("dir", below), named("glob", F.col("junit_glob"))]
    rows = settings.select("run_id", F.explode(F.concat(*each)).alias("x")).select("run_id", "x.*").distinct()
    folder = F.regexp_extract("pattern", r"\A((?:[^*?\[/]*/)*)", 1)
    return rows.withColumn("folder", F.when(F.col("kind") != "file", folder))


def match_reports(reports: DataFrame, inputs: DataFrame) -> DataFrame:
    """(run_id, path) of the reports that a run's configured inputs name.

    Paths meet patterns in the pattern's folder: each path is listed under all its folders, of which
    there are few, and only patterns of the same run and folder are tried on it.
    """
    paths = reports.select("run_id", "path").join(inputs.select("run_id").distinct(), "run_id", "left_semi")
    named = inputs.filter("kind = 'file'").select("run_id", F.col("pattern").alias("path"))
    parts = F.split("path", "/")
    folders = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))),
    )
    listed = paths.select("run_id", "path", F.explode(folders).alias("folder"))
    globs = inputs.filter("kind != 'file'").select("run_id", "folder", glob_regex(F.col("pattern")).alias("regex"))
    found = listed.join(globs, ["run_id", "folder"]).filter(F.expr("path rlike regex")).select("run_id", "path")
    return found.unionByName(paths.join(named, ["run_id", "path"], "left_semi").select("run_id", "path")).distinct()


def report_tools(runs: DataFrame, settings: DataFrame, matched: DataFrame) -> DataFrame:
    """(run_id, explicit, named, tool): the tool whose usual report places are looked at.

    That is done where no report was configured, or none of the directories and globs matched; a named
    file counts as found even if it is absent.
    """
    base = infer_tool(runs, settings).withColumnRenamed("tool", "inferred")
    given = settings.select("run_id", "auto_junit_reports", (F.size("junit_file") > 0).alias("named"))
    hits = matched.select("run_id", F.lit(True).alias("hit")).distinct()
    tools = F.create_map(*[F.lit(x) for kv in TOOL_PROGRAMS.items() for x in kv])
    again = F.element_at(tools, executable(F.get("command", F.lit(0))))
    fallback = (
        F.col("explicit") & F.coalesce("auto_junit_reports", F.lit(True)) & ~F.col("named") & F.col("hit").isNull()
    )
    rows = base.join(runs.select("run_id", "command"), "run_id").join(given, "run_id", "left").join(hits, "run_id", "left")
    rows = rows.withColumn("named", F.coalesce("named", F.lit(False)))
    return rows.select(
        "run_id", "explicit", "named", F.when(F.col("explicit"), F.when(fallback, again)).otherwise(F.col("inferred")).alias("tool")
    )


def chosen_reports(reports: DataFrame, matched: DataFrame, tools: DataFrame) -> DataFrame:
    """The candidate reports that are read: configured ones, pytest's, or those at the tool's usual places."""
    configured = reports.join(matched, ["run_id", "path"], "left_semi")
    pytest = reports.join(tools.filter("tool = 'pytest'"), "run_id", "left_semi")
    usual = inferred_reports(reports, tools.filter("tool is not null"))
    return configured.unionByName(pytest).unionByName(usual).dropDuplicates(["run_id", "path"])


def absent_files(runs: DataFrame, reports: DataFrame, inputs: DataFrame) -> DataFrame:
    """(run_id, absent): named report files that are not there, of runs without a start.

    Where a start is known they fall to the freshness filter; elsewhere each is an unreadable report.
    """
    named = inputs.filter("kind = 'file'").select("run_id", F.col("pattern").alias("path"))
    absent = named.join(reports.select("run_id", "path"), ["run_id", "path"], "left_anti")
    undated = runs.filter(F.col("started_at").isNull()).select("run_id")
    return absent.join(undated, "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("absent"))


def _dated(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """Reports with ``fresh``; ``runs(run_id, started_at, explicit, tool)``."""
    chosen = runs.select(
        "run_id",
        F.when(F.col("explicit") | F.col("tool").isin(*REPORT_GLOBS), F.col("started_at")).alias("since"),
    )
    fresh = F.col("since").isNull() | (F.col("modified") >= F.col("since") - F.expr(FRESHNESS_TOLERANCE))
    return reports.join(chosen, "run_id", "left").withColumn("fresh", fresh)


def fresh_reports(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """Reports not older than their run's start, where that is asked for."""
    return _dated(reports, runs).filter("fresh").select(reports.columns)


def only_stale(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """Ids of runs that have reports, none of them fresh."""
    narrow = reports.select("run_id", "modified")
    return (
        _dated(narrow, runs)
        .groupBy("run_id")
        .agg(F.bool_or("fresh").alias("any_fresh"))
        .filter(~F.col("any_fresh"))
        .select("run_id")
    )


def skips_stream(tools: DataFrame, settings: DataFrame) -> DataFrame:
    """Ids of runs whose log is not parsed: reports decide, or only reports are asked for."""
    both = settings.select("run_id", "input_format", "junit_only").join(
        tools.select("run_id", "tool"), "run_id", "left"
    )
    by_tool = F.col("tool").isNotNull() & (F.col("input_format") == "auto")
    return both.filter(F.col("junit_only") | by_tool).select("run_id")


def prefer_reports(stream: DataFrame, junit: DataFrame, tools: DataFrame) -> DataFrame:
    """Stream states without those that only hold protocol noise beside real reports."""
    reports = junit.select("run_id", F.col("total").alias("report_total"))
    inferred = tools.filter(F.col("tool").isin(*REPORT_GLOBS)).select("run_id")
    noise = (
        stream.join(reports, "run_id")
        .join(inferred, "run_id", "left_semi")
        .filter(
            (F.col("report_total") > 0)
            & (F.col("total") == 0)
            & (F.col("failed") == 0)
            & (F.col("protocol_failures") > 0)
        )
        .select("run_id")
    )
    return stream.join(noise, "run_id", "left_anti")


def suppress_stale(
    states: DataFrame, skipped: DataFrame, stale: DataFrame, junit: DataFrame
) -> DataFrame:
    """Drop states of runs with no parsed log, only stale reports and no report results."""
    with_results = junit.filter(F.col("total") > 0).select("run_id")
    silent = (
        stale.join(skipped.select("run_id"), "run_id", "left_semi")
        .join(with_results, "run_id", "left_anti")
    )
    return states.join(silent, "run_id", "left_anti")


NO_REPORTS = "no_reports: only reports are asked for and there is none"


def missing_reports(settings: DataFrame, reports: DataFrame) -> DataFrame:
    """Error rows of runs that only want reports but have none at all, fresh or stale.

    A named report file counts as a report even if it is absent.
    """
    return (
        settings.filter(F.col("junit_only") & (F.size("junit_file") == 0))
        .select("run_id")
        .join(reports.select("run_id").distinct(), "run_id", "left_anti")
        .withColumn("error", F.lit(NO_REPORTS))
    )


def merge_columns(order: Column) -> list[Column]:
    """Aggregates that merge states in ``order``.

    The first state's plan survives only if no other state has tests; the first
    bailout wins.
    """
    tests = F.count_if(F.col("total") > 0) - F.when(F.min_by("total", order) > 0, 1).otherwise(0)
    bailed = F.when(F.col("bailout_reason").isNotNull(), order)
    return [
        F.when(tests == 0, F.min_by("planned", order)).alias("planned"),
        *[F.sum(c).cast("bigint").alias(c) for c in COUNTERS],
        F.min_by("bailout_reason", bailed).alias("bailout_reason"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("parse_warning_count", "protocol_failures")],
    ]


def merge_run_states(states: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return states.groupBy(*keys).agg(*merge_columns(F.struct(*order)))


def merge_levels(states: DataFrame, levels: list[str], order: list[str]) -> DataFrame:
    """Merged states per run, per project and for the fleet in one job (null = all)."""
    # the order columns are copied: rollup nulls out its keys
    rows = states.withColumn("merge_order", F.struct(*order))
    return rows.rollup(*levels).agg(*merge_columns(F.col("merge_order")))


def run_verdict(states: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Success, plan mismatch and exit code of every run.

    With ``runs(run_id, exit_code)`` a child's nonzero code wins; a run listed
    there without a code was ended by a signal and exits with 1.  Where ``runs`` has a
    ``command``, rows without one are piped logs: nothing was launched, so their own
    result decides.
    """
    own = F.when(is_success(), 0).otherwise(1)
    if runs is None:
        code = own
    else:
        launched = F.col("command").isNotNull() if "command" in runs.columns else F.lit(True)
        child = runs.select("run_id", "exit_code", launched.alias("launched"))
        states = states.join(child, "run_id", "left")
        code = (
            F.when(F.col("launched") & F.col("exit_code").isNull(), 1)
            .when(F.col("launched") & (F.col("exit_code") != 0), F.col("exit_code"))
            .otherwise(own)
        )
    return states.select(
        "run_id",
        *STATE_COLUMNS,
        is_success().alias("success"),
        plan_mismatch().alias("plan_mismatch"),
        code.cast("int").alias("exit_status"),
    )
