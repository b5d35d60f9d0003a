"""Predicates over terminal commands and file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runloom.functions.text import blank

# Patterns that must agree with published labels. They are
# RE2-safe (no look-ahead) so any SQL engine can evaluate them.
TEST_FILE = (r"(?i)(?:^|[/\\])(?:test_[^/\\]*|[^/\\]*_test\.|tests?[/\\]|spec[/\\]|__tests__[/\\]"
             r"|[^/\\]*\.test\.|[^/\\]*\.spec\.|conftest\.|pytest)")
SUMMARY_FILE = (r"(?i)(?:(?:^|/)(?:FIX_SUMMARY|NOTES|CHANGELOG|SUMMARY|REPORT)"
                r"|_summary|_report|_notes)\.[a-zA-Z]+$")
TEST_COMMAND = (r"(?i)(?:^|\s|&&|;|/)(?:pytest|python\d?\s+(?:-m\s+)?(?:pytest|unittest)"
                r"|python\d?\s+(?:test_|tests/|run_tests)|npm\s+(?:test|run\s+test)"
                r"|npx\s+(?:jest|mocha|vitest)|jest|mocha|cargo\s+test|go\s+test|dotnet\s+test"
                r"|make\s+test|tox|nosetests)")
EXPLORATION_COMMAND = (r"(?i)^\s*(?:cd\s+[^&;]+[&;]+\s*)?(?:grep|rg|ag|ack|find\b|head\b|tail\b"
                       r"|sed\s+-?n|less\b|more\b|wc\b|ls\b|dir\b|tree\b|git\s+(?:log|show|blame)"
                       r"|file\b|jq\b|realpath\b)")
CAT_COMMAND = r"(?i)^\s*(?:cd\s+[^&;]+[&;]+\s*)?cat\b"
CAT_REDIRECT = r"(?i)^\s*(?:cd\s+[^&;]+[&;]+\s*)?cat\b\s*>"
GIT_REVIEW_COMMAND = r"(?i)\bgit\s+(?:diff|status)\b"
ORCHESTRATION_COMMAND = (r"(?i)^\s*(?:cd\s+[^&;]+[&;]+\s*)*(?:rm\s+(?:-[rfv]+\s+)*\S+"
                         r"|git\s+stash(?:\s+(?:pop|drop|apply))?|git\s+checkout\s+--\s*\."
                         r"|git\s+restore\b|git\s+clean\b|mkdir\s+-?p?\s)\s*$")
TMP_WRITE = r"(?i)(?:cat|echo|printf|tee)\s+.*>\s*/tmp/"
CD_PREFIX_ONE = r"(?i)^\s*cd\s+[^&;]+[&;]+\s*"
CD_PREFIX_ALL = r"(?i)^\s*(?:cd\s+[^&;]+[&;]+\s*)+"
VERIFICATION_COMMAND = "|".join([
    r"(?i)(?:\bpython\d?\s+(?:-\S+\s+)*\S+\.py\b",
    r"\bpython\d?\s+-m\s+\S+",
    r"\bnode\s+(?:-\S+\s+)*\S+\.(?:js|ts|mjs|cjs)\b",
    r"\b(?:bash|sh|zsh|ksh)\s+(?:-\S+\s+)*\S+\.sh\b",
    r"\bruby\s+(?:-\S+\s+)*\S+\.rb\b",
    r"\bphp\s+(?:-\S+\s+)*\S+\.php\b",
    r"\bperl\s+(?:-\S+\s+)*\S+\.pl\b",
    r"\bjava\s+(?:-\S+\s+)*\S+",
    r"\b(?:make|cmake|cargo\s+run|go\s+run|go\s+build|npm\s+(?:start|run|exec)|npx\s+\S+"
    r"|yarn\s+(?:start|run)|pnpm\s+(?:start|run)|pip\s+install|dotnet\s+run|dotnet\s+build"
    r"|mvn\s+(?:compile|package|exec)|gradle\s+(?:run|build)|docker\s+(?:run|compose|build)"
    r"|uvicorn|gunicorn|flask\s+run|streamlit\s+run)\b",
    r"\b(?:curl|wget|http|https)\s",
    r"\./\S+)",
])
MODIFYING_COMMAND = (r"(?i)(?:\bsed\s+-i\b|\bpatch\b|\btee\s|>\s*\S|\bchmod\b|\bmv\b|\bcp\b"
                     r"|\binstall\b|\bpip\s+install\b|\bnpm\s+install\b|\brm\s"
                     r"|\bgit\s+checkout\s+--|\bgit\s+restore\b)")
_SRC = "py|js|ts|java|cs|rb|go|rs|cpp|c|h"
CODE_WRITING_COMMAND = "|".join([
    r"(?is)(?:python\d?\s+-c\s+[\"'].*(?:open\(|write\(|with\s+open)",
    r"cat\s+>\s*\S+\.(?:py|js|ts|jsx|tsx|java|cs|rb|go|rs|cpp|c|h|csproj|json|yaml|yml|xml|toml"
    r"|cfg|ini|sh)\s*<<",
    rf"(?:echo|printf)\s+[^\n]*>\s*\S+\.(?:{_SRC})",
    rf"sed\s+-i\s+[^\n]*\S+\.(?:{_SRC}|csproj|json|yaml|yml|xml|toml)",
    rf"tee\s+\S+\.(?:{_SRC}))",
])
WRITTEN_FILE = rf"['\"]?([^'\"\s>]+\.(?:{_SRC}))"


def _stripped(cmd: Column, prefix: str = CD_PREFIX_ALL) -> Column:
    return F.trim(F.regexp_replace(blank(cmd), prefix, ""))


def is_test_file(path: Column) -> Column:
    return blank(path).rlike(TEST_FILE)


def is_summary_file(path: Column) -> Column:
    path = blank(path)
    return path.startswith("/tmp/") | path.startswith("tmp/") | path.rlike(SUMMARY_FILE)


def is_test_command(cmd: Column) -> Column:
    return blank(cmd).rlike(TEST_COMMAND)


def is_git_review_command(cmd: Column) -> Column:
    return blank(cmd).rlike(GIT_REVIEW_COMMAND)


def is_exploration_command(cmd: Column) -> Column:
    """Read-only command; ``cat`` counts only when it does not write a file."""
    cmd = blank(cmd)
    return cmd.rlike(EXPLORATION_COMMAND) | (cmd.rlike(CAT_COMMAND) & ~cmd.rlike(CAT_REDIRECT))


def is_orchestration_command(cmd: Column) -> Column:
    rest = _stripped(cmd)
    return (rest != "") & (rest.rlike(TMP_WRITE) | blank(cmd).rlike(ORCHESTRATION_COMMAND))


def is_verification_command(cmd: Column) -> Column:
    rest = _stripped(cmd, CD_PREFIX_ONE)
    return (rest != "") & ~blank(cmd).rlike(EXPLORATION_COMMAND) & rest.rlike(VERIFICATION_COMMAND)


def is_modifying_command(cmd: Column) -> Column:
    return blank(cmd).rlike(MODIFYING_COMMAND)


def is_code_writing_command(cmd: Column) -> Column:
    return _stripped(cmd).rlike(CODE_WRITING_COMMAND)


def written_file(cmd: Column) -> Column:
    return F.regexp_extract(blank(cmd), WRITTEN_FILE, 1)
