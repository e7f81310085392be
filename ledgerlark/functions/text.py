"""Column functions over error traces, progress lines and source text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import arrays

# Exceptions that give no signature, the marker of progress lines, the placeholder.
SYNTAX_ERRORS = ("SyntaxError", "IndentationError", "TabError")
PROGRESS_MARK = "[last_progress] "
PLACEHOLDER = "<val>"

# What varies between equal errors, in the order it is replaced.
VOLATILE = (
    r"'[^']*'",
    r'"[^"]*"',
    r"\b0x[0-9a-fA-F]+\b",
    r"\b\d+\.\d+\b",
    r"\b\d+\b",
    r"(/[\w./\\-]+)",
)
# Line shapes and words looked for.
EXCEPTION_LINE = r"^([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*):\s*(.+)$"
RUNNER_EXIT = r"^runner exited without output\.json \(rc=(-?\d+)\)$"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C]"
MODEL_CLASS = r"\b(?:XGB|LGBM|CatBoost|HistGradientBoosting|RandomForest|ExtraTrees)\w*?(?:Classifier|Regressor)\b|\bLogisticRegression\b"
ALIAS_CALL = r"""\.alias\(\s*['"]([^'"]+)['"]\s*\)"""
WEIGHTING_WORD = r"\b(sample_weight|class_weight|auto_class_weights|scale_pos_weight)\b"


def lines_of(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def scrub(text: Column) -> Column:
    """Replace literals, addresses, numbers and paths, then collapse white space."""
    for pattern in VOLATILE:
        text = F.regexp_replace(text, pattern, PLACEHOLDER)
    return strip(F.regexp_replace(text, r"\s+", " "))


def error_signature(trace: Column) -> Column:
    """The recurring shape of an error: its last ``Class: message`` line without the volatile parts.

    Syntax errors give none. Without such a line the last line that is neither blank nor a progress line is taken;
    the exit code of a runner stays readable.
    """
    kept = F.filter(
        F.transform(lines_of(trace), strip), lambda x: (x != "") & ~F.startswith(x, F.lit(PROGRESS_MARK))
    )

    def from_exception(line: Column) -> Column:
        name = F.substring_index(F.regexp_extract(line, EXCEPTION_LINE, 1), ".", -1)
        message = F.regexp_extract(line, EXCEPTION_LINE, 2)
        return arrays.let(name, lambda n: F.when(~n.isin(*SYNTAX_ERRORS), F.concat(n, F.lit(": "), scrub(message))))

    def from_last(line: Column) -> Column:
        return F.when(line.rlike(RUNNER_EXIT), line).otherwise(arrays.let(scrub(line), lambda s: F.nullif(s, F.lit(""))))

    def signature(lines: Column) -> Column:
        last = F.element_at(F.filter(F.concat(F.array(F.lit(None).cast("string")), lines), lambda x: x.isNull() | x.rlike(EXCEPTION_LINE)), -1)
        fallback = F.get(lines, F.size(lines) - 1)
        return arrays.let(last, lambda e: F.when(e.isNotNull(), from_exception(e)).otherwise(from_last(fallback)))

    return arrays.let(kept, signature)


def kill_stage(trace: Column) -> Column:
    """Stage and fold of the last progress line as a struct; null fields where there is none."""
    stage = F.regexp_extract(trace, r"\[last_progress\] stage=(\S+)( fold=\d+/\d+)?", 1)
    fold = F.regexp_extract(trace, r"\[last_progress\] stage=\S+ (fold=\d+/\d+)", 1)
    return F.struct(F.nullif(stage, F.lit("")).alias("stage"), F.nullif(fold, F.lit("")).alias("fold"))


def code_facts(source: Column, columns_shown: int | None = None) -> Column:
    """Distinct model classes, alias columns (or the first of them) and weighting words of a source text, in reading order."""
    names = F.array_distinct(F.regexp_extract_all(source, F.lit(ALIAS_CALL), F.lit(1)))
    return F.struct(
        F.array_distinct(F.regexp_extract_all(source, F.lit(MODEL_CLASS), F.lit(0))).alias("models"),
        (names if columns_shown is None else F.slice(names, 1, columns_shown)).alias("columns"),
        F.array_distinct(F.regexp_extract_all(source, F.lit(WEIGHTING_WORD), F.lit(1))).alias("weighting"),
    )


def failure_class(trace: Column, action: Column) -> Column:
    """Which repair advice an error asks for."""
    cpu = F.startswith(trace, F.lit("cpu budget exceeded"))
    mismatch = r"conversion from `str` to|cannot compare string with numeric|could not convert string to float"
    return (
        F.when(cpu & (action == "ensemble"), "cpu_ensemble")
        .when(cpu & action.isin("feature_engineering", "preprocessing"), "cpu_features")
        .when(F.contains(trace, F.lit("during preselect")), "cpu_preselect")
        .when(cpu, "cpu")
        .when(F.startswith(trace, F.lit("memory watchdog")), "memory")
        .when(trace.rlike(mismatch), "dtype")
        .when(trace.isNotNull(), "other")
    )


def squeeze(text: Column, n: int | None = None) -> Column:
    """White space collapsed; the first ``n`` characters if given."""
    flat = strip(F.regexp_replace(text, r"\s+", " "))
    return flat if n is None else F.left(flat, F.lit(n))
