"""Column functions on paths, code snippets and observation texts."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes removed from paths, in this order.
WORKSPACE_PREFIXES = ("workspace/", "workspaces/", "home/", "tmp/")
MATCH_PREFIXES = ("/workspace/", "/workspaces/", "/home/", "/tmp/", "workspace/", "workspaces/")
REPO_MARKERS = ("repo-copilot/", "repo-claude/", "repo-clone/", "repo/")

# File extension to language.
EXTENSION_LANGUAGE = {
    "py": "python",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "tsx",
    "java": "java",
    "cs": "c_sharp",
    "go": "go",
    "rs": "rust",
    "rb": "ruby",
    "php": "php",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "c": "c",
    "h": "c",
    "hpp": "cpp",
    "swift": "swift",
    "kt": "kotlin",
    "kts": "kotlin",
    "scala": "scala",
    "lua": "lua",
    "r": "r",
    "jl": "julia",
    "ex": "elixir",
    "exs": "elixir",
    "erl": "erlang",
    "hs": "haskell",
    "ml": "ocaml",
    "fs": "c_sharp",
    "clj": "clojure",
    "lisp": "commonlisp",
    "el": "elisp",
    "vim": "vim",
    "sh": "bash",
    "bash": "bash",
    "zsh": "bash",
    "ps1": "powershell",
    "sql": "sql",
    "html": "html",
    "htm": "html",
    "xml": "xml",
    "css": "css",
    "scss": "scss",
    "json": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "toml": "toml",
    "md": "markdown",
    "markdown": "markdown",
}
# Language to display name.
LANGUAGE_NAMES = {
    "python": "Python", "javascript": "JavaScript", "typescript": "TypeScript",
    "tsx": "TypeScript/React", "java": "Java", "c_sharp": "C#", "go": "Go",
    "rust": "Rust", "ruby": "Ruby", "php": "PHP", "cpp": "C++", "c": "C",
}
# Definition patterns per language family, and words never taken
# as a symbol from a description.
FUNCTION_PATTERNS = (
    r"\bdef\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"\bfunction\s+([A-Za-z_$][A-Za-z0-9_$]*)",
    r"\bfunc\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)",
    r"\bfn\s+([A-Za-z_][A-Za-z0-9_]*)",
)
CLASS_PATTERN = r"\b(?:class|struct|interface|trait)\s+([A-Za-z_][A-Za-z0-9_]*)"
IMPORT_PATTERN = r"(?m)^\s*((?:import|from|use|using|require|#include)\b[^\n]*)"
SYMBOL_STOP_WORDS = ("in to from the and or with modified added removed renamed imports code "
                     "file created python javascript").split()
IDENT = r"[a-zA-Z_][a-zA-Z0-9_]*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """Text null is stored as the empty string."""
    return F.coalesce(_col(c), F.lit(""))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent to one place, halves up. Multiplied first: 23 of 80 is 28.75, while 23 / 80 * 100 falls short of it."""
    return F.round(part * 100.0 / whole, 1)


def norm_path(c: Column | str) -> Column:
    """Strip leading slashes and each workspace prefix in turn; lower-case; forward slashes."""
    out = F.regexp_replace(blank(c), r"^[/\\]+", "")
    for prefix in WORKSPACE_PREFIXES:
        out = F.regexp_replace(out, f"(?i)^{prefix}", "")
    return F.replace(F.lower(out), F.lit("\\"), F.lit("/"))


def norm_path_testbed(c: Column | str) -> Column:
    """Strip the ``/testbed`` root; the result always starts with one slash."""
    c = blank(c)
    bare = F.regexp_replace(c, r"^[/\\]+", "")
    cut = F.when(F.lower(bare) == "testbed", "").otherwise(
        F.regexp_replace(bare, "(?i)^testbed/", ""))
    return F.when(c == "", "").otherwise(F.concat(F.lit("/"), cut))


def norm_match_path(c: Column | str) -> Column:
    """Strip only the first matching prefix, then leading slashes; lower-case."""
    c = F.trim(F.replace(blank(c), F.lit("\\"), F.lit("/")))
    pattern = "|".join(MATCH_PREFIXES)
    return F.lower(F.regexp_replace(F.regexp_replace(c, f"(?i)^(?:{pattern})", ""), "^/+", ""))


def norm_run_path(c: Column | str, root: Column | None = None,
                  host_prefixes: tuple[str, ...] = ("home/", "tmp/")) -> Column:
    """Workspace-relative path: after a repository marker, else below ``root``,
    else below a known host prefix."""
    raw = blank(c)
    path = F.replace(raw, F.lit("\\"), F.lit("/"))
    out = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    bare = F.regexp_replace(path, "^/+", "")
    for prefix in reversed(host_prefixes):
        rest = F.substr(bare, F.lit(len(prefix) + 1))
        inner = F.regexp_replace(rest, r"^(?:[^/]*/)*?(?:repo-[^/]*|repo)(?:/|$)", "")
        out = F.when(F.lower(bare).startswith(prefix), F.concat(F.lit("/"), inner)).otherwise(out)
    if root is not None:
        def no_drive(p: Column) -> Column:
            return F.regexp_replace(F.regexp_replace(p, r"^.:", ""), "^/+", "")
        base = no_drive(root)
        below = F.substr(no_drive(path), F.length(base) + 1)
        out = F.when(root.isNotNull() & F.startswith(F.lower(no_drive(path)), F.lower(base)),
                     F.concat(F.lit("/"), below)).otherwise(out)
    for marker in reversed(REPO_MARKERS):
        at = F.instr(path, marker)
        out = F.when(at > 0, F.concat(F.lit("/"), F.substr(path, at + len(marker)))).otherwise(out)
    return F.when(raw == "", "").otherwise(out)


def line_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def short_hash(c: Column, n: int) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, n)


def cut(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def file_name(c: Column) -> Column:
    return F.when(blank(c) == "", "unknown").otherwise(F.regexp_extract(c, r"([^/\\]*)$", 1))


def edit_type(old: Column, new: Column) -> Column:
    old, new = blank(old), blank(new)
    return (F.when((old == "") & (new != ""), "add").when((old != "") & (new == ""), "remove")
            .when((old == "") & (new == ""), "")
            .when(F.length(new) > F.length(old) * 1.5, "expand")
            .when(F.length(new) < F.length(old) * 0.5, "shrink").otherwise("replace"))


def relative_position(start: Column, end: Column, length: Column) -> Column:
    ratio = (start + end) / 2 / F.nullif(length, F.lit(0.0))
    return (F.when(start.isNull() | (length <= 0), "").when(ratio <= 0.33, "early")
            .when(ratio <= 0.66, "middle").otherwise("late"))


def language_of(path: Column, content: Column) -> Column:
    """Language by extension, else by the first content marker that occurs."""
    table = F.from_json(F.lit(json.dumps(EXTENSION_LANGUAGE)), "map<string,string>")
    path, content = blank(path), blank(content)
    ext = F.when(F.contains(path, F.lit(".")),
                 F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))).otherwise("")

    def has(*needles):
        cond = F.lit(True)
        for n in needles:
            cond = cond & F.contains(content, F.lit(n))
        return cond
    sniffed = (F.when(has("#!/usr/bin/env python") | has("#!/usr/bin/python"), "python")
               .when(has("#!/bin/bash") | has("#!/usr/bin/env bash"), "bash")
               .when(has("package main", "func "), "go")
               .when(has("fn main()") | has("impl "), "rust")
               .when(has("public class ") | has("public static void main"), "java")
               .when(has("def ", ":"), "python")
               .when(has("function ") | has("const ") | has("=>"), "javascript")
               .otherwise("unknown"))
    return F.coalesce(F.try_element_at(table, ext), sniffed)


def language_name(lang: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, lang), F.initcap(lang))


def function_names(code: Column) -> Column:
    code = blank(code)
    found = [F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in FUNCTION_PATTERNS]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def class_names(code: Column) -> Column:
    return F.array_sort(F.array_distinct(
        F.regexp_extract_all(blank(code), F.lit(CLASS_PATTERN), F.lit(1))))


def import_lines(code: Column) -> Column:
    return F.array_sort(F.array_distinct(
        F.regexp_extract_all(blank(code), F.lit(IMPORT_PATTERN), F.lit(1))))


def first_or_blank(names: Column) -> Column:
    return F.coalesce(F.try_element_at(names, F.lit(1)), F.lit(""))


def scope_path(func: Column, cls: Column) -> Column:
    return F.when((func != "") & (cls != ""), F.concat_ws(".", cls, func)).otherwise(
        F.when(func != "", func).otherwise(cls))


def change_words(c: Column) -> Column:
    """Text of one analysed change: renamed, added and removed symbols, else imports,
    else length. ``c`` carries names (f/c), imports (i) and length (n) of both sides."""
    told = []
    for word, tag in (("function", "f"), ("class", "c")):
        added = F.array_except(c[tag + "n"], c[tag + "o"])
        gone = F.array_except(c[tag + "o"], c[tag + "n"])

        def say(verb, arr, word=word):
            return F.transform(arr, lambda n: F.concat(F.lit(f"{verb} {word} '"), n, F.lit("'")))
        renamed = F.array(F.concat(F.lit(f"renamed {word} '"), gone[0], F.lit("' to '"), added[0], F.lit("'")))
        told.append(F.when((F.size(added) == 1) & (F.size(gone) == 1), renamed)
                    .otherwise(F.concat(say("added", added), say("removed", gone))))
    text = F.array_join(F.concat(*told), "; ")
    other = (F.when(c["io"] != c["in"], "modified imports")
             .when(c["nn"] > c["no"] * 1.2, "added content")
             .when(c["nn"] < c["no"] * 0.8, "removed content")
             .otherwise("modified content"))
    return F.when(text != "", text).otherwise(other)


def creation_description(path: Column, content: Column, funcs: Column, classes: Column) -> Column:

    def listing(names, label):
        return (F.when(F.size(names) == 0, None)
                .when(F.size(names) <= 3, F.concat(F.lit(f"{label}: "), F.array_join(names, ", ")))
                .otherwise(F.concat(F.size(names).cast("string"), F.lit(f" {label}"))))
    cls = F.concat(F.lit("with "), listing(classes, "classes"))
    head = F.concat(F.lit("Created "), language_name(language_of(path, content)),
                    F.lit(" file '"), file_name(path), F.lit("'"))
    return F.concat_ws(" ", head, cls, listing(funcs, "functions"))


def command_description(command: Column) -> Column:
    base = F.lower(F.regexp_extract(F.trim(command), r"^(\S+)", 1))
    word = (F.when(F.contains(base, F.lit("python")), "Python")
            .when(F.contains(base, F.lit("npm")) | F.contains(base, F.lit("node")), "Node.js")
            .when(F.contains(base, F.lit("git")), "Git").otherwise("terminal"))
    return F.when(blank(command) == "", "").otherwise(F.concat(
        F.lit("Ran "), word, F.lit(" command: "), F.substring(command, 1, 100)))


def patch_hunks(patch: Column) -> Column:
    """``array<struct<file, old_code, new_code>>``: one element per file section."""
    pieces = F.split(F.concat(F.lit("\n"), blank(patch)), r"\n(?=\*\*\* Update File:|\+\+\+ )")

    def section(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        named = F.when(F.contains(head, F.lit(":")), F.trim(F.regexp_extract(head, r":(.*)$", 1))) \
            .otherwise(F.trim(F.substring(head, 5, 100000)))
        body = F.filter(F.split(piece, "\n"), lambda x, i: (i > 0) & ~(
            x.startswith("@@") | x.startswith("***") | x.startswith("---") | x.startswith("+++")))

        def side(skip):
            kept = F.filter(body, lambda x: ~x.startswith(skip))
            return F.array_join(F.transform(kept, lambda x: F.when(
                x.rlike(r"^[-+ ]"), F.substr(x, F.lit(2))).otherwise(x)), "\n")
        return F.struct(named.alias("file"), side("+").alias("old_code"),
                        side("-").alias("new_code"), (F.size(body) > 0).alias("any"))
    sections = F.transform(F.filter(pieces, lambda _, i: i > 0), section)
    return F.transform(F.filter(sections, lambda h: (h["file"] != "") & h["any"]),
                       lambda h: F.struct(h["file"].alias("file"), h["old_code"].alias("old_code"),
                                          h["new_code"].alias("new_code")))


def symbols_from_description(desc: Column) -> Column:
    """Identifiers named by a description, minus stop words."""
    desc = blank(desc)

    def every(pattern, group=1):
        return F.regexp_extract_all(desc, F.lit(pattern), F.lit(group))

    def listed(word):
        runs = every(rf"(?i){word}:\s*([a-zA-Z_][a-zA-Z0-9_,\s]*)")
        names = F.transform(F.flatten(F.transform(runs, lambda r: F.split(r, ","))),
                            lambda n: F.trim(n))
        return F.filter(names, lambda n: n.rlike(f"^{IDENT}$"))
    quote = "['\"]?"
    found = F.flatten(F.array(
        every(f"'({IDENT})'"), listed("functions?"), listed("classes?"),
        every(rf"(?i)(?:added|removed)\s+(?:function|class|method)\s+{quote}({IDENT}){quote}"),
        every(rf"(?i)(?:function|method|class|def)\s+{quote}({IDENT}){quote}"),
        every(rf"(?i)renamed\s+(?:\w+\s+)?{quote}({IDENT}){quote}\s+to\s+{quote}({IDENT}){quote}", 1),
        every(rf"(?i)renamed\s+(?:\w+\s+)?{quote}({IDENT}){quote}\s+to\s+{quote}({IDENT}){quote}", 2),
    ))
    stop = F.array(*[F.lit(w) for w in SYMBOL_STOP_WORDS])
    return F.array_sort(F.array_except(F.array_distinct(found), stop))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(blank(c)), r"\s+"), lambda w: w != ""))


def word_jaccard(a: Column, b: Column) -> Column:
    wa, wb = word_set(a), word_set(b)
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb)))


def range_jaccard(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    inter = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)
    union = F.greatest(e1, e2) - F.least(s1, s2) + 1
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def norm_command(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(blank(c)), r"\s+", " "))


def patch_check(diff: Column) -> Column:
    """Rule-based diff check: struct of issues, score and validity."""
    lines = F.split(blank(diff), "\n")
    adds = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")))
    dels = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---")))
    dup = F.contains(blank(diff), F.lit("\n+\n+def "))
    only_adds = (adds > 0) & (dels == 0)
    score = (F.lit(1.0) - F.when(dup, 0.3).otherwise(0.0) - F.when(only_adds, 0.2).otherwise(0.0))
    issues = F.array_compact(F.array(F.when(dup, F.lit("duplicate_definition")),
                                     F.when(only_adds, F.lit("additions_only"))))
    return F.struct(issues.alias("issues"), F.greatest(F.lit(0.0), score).alias("score"),
                    ((F.size(issues) == 0) & (score > 0.5)).alias("is_valid"),
                    adds.alias("additions"), dels.alias("deletions"))
