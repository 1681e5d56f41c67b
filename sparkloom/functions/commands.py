"""Expressions over shell commands and their output: families, verdicts, signatures, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What tells a build or test command, a failed and a passed run, and a harness that talks about itself.
BUILD_OR_TEST = ("cargo test", "cargo check", "cargo build", "cargo clippy", "npm test", "npm run test", "npm run build", "vitest", "jest", "pytest", "go test", "gradlew", "dotnet test")
FAILED = ("test result: FAILED", "error[E", "error: could not compile", "error: test failed", "FAILED (", "panicked at", "Tests  0 passed", "failed |", "BUILD FAILED", "FAIL  ")
PASSED = ("test result: ok", "Finished `dev`", "Finished `release`", "Finished `test`", "Test Files  ", "ok. ", "BUILD SUCCESSFUL")
CHATTER = ("test result:", "failures:", "running tests", "error: test failed", "note: run with")
SEARCHES, WAITS = ("grep ", "rg ", "egrep ", "sls "), ("sleep ", "start-sleep ")
#: Prefixes that a command's program comes after: assignments, env, and words that take an argument up to a separator.
_ENV = r"(?:[^\s=-][^\s=]*=\S*|=\S*|env)\s+"
_STEP = r"(?:cd|sudo|time|nohup)(?=\s)(?:(?!&&)[^;\n])*(?:&&|;|\n)\s*"


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(text, F.lit(n))
    return found


def is_build_or_test(command: Column) -> Column:
    return _any(F.lower(command), BUILD_OR_TEST)


def verdict(command: Column, output: Column) -> Column:
    """False for a failed build or test, True for one that passed, null for anything else; failure wins."""
    return F.when(is_build_or_test(command) & _any(output, FAILED), False).when(is_build_or_test(command) & _any(output, PASSED), True)


def after_cd(command: Column) -> Column:
    """The command after its leading changes of folder."""
    return F.regexp_replace(F.trim(command), r"(?i)^(?:(?:cd|set-location|sl|pushd|push-location) (?:(?!&&|;)[\s\S])*(?:&&|;)\s*)+", "")


def comparable(command: Column) -> Column:
    """The first line, after changes of folder, with single spaces."""
    return F.trim(F.regexp_replace(after_cd(F.split(F.trim(command), "\n")[0]), r"\s+", " "))


def family(command: Column) -> Column:
    """The program of a command: lower-cased, without path, after assignments and prefixes.

    A prefix without a separator after it is stepped over, and what follows counts as the program.
    """
    rest = F.regexp_replace(F.trim(command), rf"^(?:{_ENV}|{_STEP})*(?:(?:cd|sudo|time|nohup)(?:\s+|$))?", "")
    head = F.regexp_replace(F.regexp_extract(rest, r"^(\S*)", 1), "^[\"'(]+|[\"'(]+$", "")
    base = F.regexp_extract(head, r"([^/\\]*)$", 1)
    return F.when(base == "", "(unknown)").otherwise(F.lower(base))


def shell_kind(command: Column) -> Column:
    """grep, sed or wait for commands that search, read lines or wait."""
    first = F.split(after_cd(command), "\n")[0]
    starts = lambda words: F.lower(first).rlike("^(" + "|".join(words) + ")")
    return F.when(starts(SEARCHES), "grep").when(F.contains(first, F.lit("sed -n")) & first.rlike("[0-9]") & F.contains(first, F.lit("p")), "sed").when(starts(WAITS), "wait")


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[^@-~]*[@-~]?", "")


def last_lines(output: Column, n: int) -> Column:
    """The last n lines that aren't empty, without colour codes."""
    kept = F.filter(F.split(without_ansi(output), "\n"), lambda x: F.trim(x) != "")
    return F.array_join(F.slice(kept, F.greatest(F.size(kept) - n + 1, F.lit(1)), n), "\n")


def shape(message: Column) -> Column:
    """Without digits, with single spaces: what repeats of a message have in common."""
    return F.trim(F.regexp_replace(F.substring(F.regexp_replace(message, "[0-9]", ""), 1, 80), r"\s+", " "))


def _basename(path: Column) -> Column:
    return F.trim(F.regexp_extract(path, r"([^/\\]*)$", 1))


def signature(output: Column) -> Column:
    """An identity for a failure: error code with the name it is about, or the assertion's message with its test or file."""
    code, line = F.regexp_extract(output, r"error\[E([0-9A-Za-z]+)", 1), F.regexp_extract(output, r"(error\[E[^\n]*)", 1)
    code = F.concat(F.lit("E"), code)
    symbol, file = F.trim(F.regexp_extract(line, "`([^`]*)`", 1)), _basename(F.trim(F.regexp_extract(output, r"--> ([^:\n]*)", 1)))
    message = shape(F.regexp_extract(line, r"^[^\n]*?: (.*)$", 1))
    of_code = F.when(symbol != "", F.concat_ws(":", F.lit("rust"), code, symbol)).otherwise(
        F.concat(F.lit("rust:"), code, F.when(message != "", F.concat(F.lit(":"), message)).when(file != "", ":").otherwise(""), F.when(file != "", F.concat(F.lit("@"), file)).otherwise(""))
    )
    said = shape(F.trim(F.regexp_extract(output, r"panicked at [^\n]*\n([^\n]*)", 1)))
    test, site = F.trim(F.regexp_extract(output, r"---- ([\s\S]*?) stdout", 1)), _basename(F.trim(F.regexp_extract(output, r"panicked at ([^:\n]*)", 1)))
    where = F.when(test != "", test).when(site != "", site).otherwise("?")
    noise = F.lit(False)
    for n in CHATTER:
        noise = noise | said.startswith(n)
    of_panic = F.when((F.octet_length(said) > 12) & ~noise, F.concat(F.lit("assert:"), said, F.lit("@"), where)).when(where != "?", F.concat(F.lit("assert:@"), where))
    return F.when(F.contains(output, F.lit("error[E")), of_code).when(F.contains(output, F.lit("panicked at ")), of_panic)


def excerpt(output: Column, lines: int = 4) -> Column:
    """The first lines that aren't empty from where the failure begins."""
    begin = F.coalesce(*[F.when(F.locate(n, output) > 0, F.locate(n, output)) for n in ("error[E", "panicked at ", "error:")], F.lit(1))
    return F.array_join(F.slice(F.filter(F.split(F.substring(output, begin, F.length(output)), "\n"), lambda x: F.trim(x) != ""), 1, lines), "\n")


def tool_source(tool: Column) -> Column:
    return F.when(tool.startswith("kb__"), "knowledge").when(tool.startswith("code__"), "structure").when(tool.isin("Bash", "PowerShell"), "shell").otherwise("other")
