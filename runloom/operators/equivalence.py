"""When do two steps do the same thing? A cascade of rules, evaluated as a join.

Distinct step contents (signatures) meet once per task. Every rule that can
answer "yes" implies equality of some derived value, so each signature emits the values
it could match on (block keys) and only signatures sharing a key are compared; the full
cascade then decides. No all-pairs product is ever formed. A signature is a digest of its
content, so keys, words and verdicts are worked out once per content or pair of contents,
however many tasks they occur in; tasks move signatures only.

Rules on word overlap use prefixes: a set's words are ordered by rarity in the task, and two
sets of a Jaccard similarity of t share one of the first n - ceil(t n) + 1 words of each. The
join on keys moves ids only; contents meet the distinct pairs once, afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import text as T
from runloom.functions.text import blank
from runloom.plans.store import written

# Command groups, viewer file suffixes and effect prefixes naming files.
SEARCH_COMMAND = r"(?i)^(?:grep|rg|ag|ack|fgrep|egrep)\b|\bgrep\b"
VIEW_COMMAND = r"(?i)^(?:cat|head|tail|less|more)\b|^sed\s+-?n"
EXECUTE_COMMAND = r"(?i)^(?:python|node|bash|sh|ruby|perl)\s"
EXECUTE_TARGET = r"\b(?:python|node|bash|sh|ruby|perl)\s+(\S+)"
VIEW_SUFFIX = r"/|\.(?:py|js|ts|c|h|java|rs|go|rb|txt|md|json|yaml|yml|toml|cfg|ini)$"
FILE_EFFECTS = (r"^(?:file_modified|file_patched|file_created|files_modified|file_modify_failed"
                r"|file_create_failed):(.*)$")
LINE_OVERLAP, SEARCH_OVERLAP, QUERY_OVERLAP = 0.3, 0.5, 0.8

COMPARED = ("tool", "fam", "grp_tool", "category", "strategy", "stage", "hash", "effect", "obs",
            "file", "l0", "l1", "scope", "func", "cls", "symbols", "files", "kind", "initial",
            "command", "norm", "cgroup", "target", "base", "query", "args", "arg_path", "cmd_flat")


def norm_terminal(cmd: Column) -> Column:
    c = F.regexp_replace(F.trim(blank(cmd)), r"^cd\s+[^\s&;]+\s*[&;]+\s*", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\bpython3?\b", "python"), r"\bnpm i\b", "npm install")
    return T.norm_command(c)


def command_group(norm: Column) -> Column:
    return F.when(norm == "", "").when(norm.rlike(SEARCH_COMMAND), "search") \
        .when(norm.rlike(VIEW_COMMAND), "view").when(norm.rlike(EXECUTE_COMMAND), "execute").otherwise("")


def command_target(norm: Column, group: Column) -> Column:
    words = F.split(norm, " ")
    quoted = F.regexp_extract(norm, r"['\"]([^'\"]+)['\"]", 1)
    plain = F.filter(words, lambda w, i: (i > 0) & ~w.startswith("-") & ~w.startswith("/"))
    viewed = F.filter(words, lambda w: w.rlike(VIEW_SUFFIX))
    return (F.when(group == "search", F.when(quoted != "", quoted).otherwise(T.first_or_blank(plain)))
            .when(group == "view", F.coalesce(F.try_element_at(viewed, F.lit(-1)), F.lit("")))
            .when(group == "execute", F.regexp_extract(norm, EXECUTE_TARGET, 1)).otherwise(""))


def modified_files(file_path: Column, effect: Column) -> Column:
    """File path plus the files an effect string names, normalised."""
    named = F.transform(F.split(F.regexp_extract(effect, FILE_EFFECTS, 1), ","),
                        lambda p: T.norm_path(F.trim(p)))
    return F.array_distinct(F.filter(F.concat(F.array(T.norm_path(file_path)), named), lambda p: p != ""))


def with_signature(states: DataFrame) -> DataFrame:
    """Add ``c`` (compared fields as a struct) and ``sig`` (their digest)."""
    group = blank("equivalence_group")
    norm = norm_terminal(F.col("command"))
    df = states.withColumn("_norm", norm).withColumn("_grp", command_group(F.col("_norm")))
    args = F.concat_ws("\u0001", *[blank(c) for c in (
        "args_json", "path_arg", "query", "command", "content", "old_string", "new_string", "patch_input")])
    fields = {
        "tool": blank("tool_used"), "fam": F.when(group != "", group).otherwise(blank("tool_used")),
        "grp_tool": group, "category": F.col("category"), "strategy": F.col("comparison_strategy"),
        "stage": blank("intent_stage"), "hash": blank("content_hash"), "effect": blank("resulting_state"),
        "obs": F.md5(blank("observation").cast("binary")), "file": blank("file_path"), "l0": F.col("line_start"),
        "l1": F.col("line_end"), "scope": blank("scope_path"), "func": blank("function_name"),
        "cls": blank("class_name"), "symbols": T.symbols_from_description(F.col("content_description")),
        "files": modified_files(F.col("file_path"), blank("resulting_state")), "kind": blank("kind"),
        "initial": F.col("is_initial"), "command": F.trim(blank("command")), "norm": F.col("_norm"),
        "cgroup": F.col("_grp"), "target": command_target(F.col("_norm"), F.col("_grp")),
        "base": F.split("_norm", " ")[0], "query": blank("query"), "args": F.md5(args.cast("binary")),
        "arg_path": T.norm_path("path_arg"), "cmd_flat": T.norm_command(F.col("command")),
    }
    df = df.withColumn("c", F.struct(*[fields[n].alias(n) for n in COMPARED])).drop("_norm", "_grp")
    return df.withColumn("sig", F.md5(F.to_json("c").cast("binary")))


def block_keys(c: Column, side: str) -> Column:
    """Values on which a match could rest. ``side`` is ``ref`` or ``cand``: where a blank on
    either side may match anything of its kind, one side emits the wildcard, the other offers it."""
    fam = c["fam"]
    wild, offer = ("R", "C") if side == "ref" else ("C", "R")

    def key(tag, *parts, when=None):
        k = F.concat_ws("\u0001", F.lit(tag), fam, *parts)
        return F.when(when, k) if when is not None else k
    command = (c["strategy"] == "command") & (c["command"] != "")
    file_op = c["category"].isin("edit", "read")
    no_entry = c["kind"] == ""
    single = F.array_compact(F.array(
        key("hash", c["hash"], when=c["hash"] != ""), key("effect", c["effect"], when=c["effect"] != ""),
        key("obs", c["obs"]), key("file", c["file"], when=file_op & (c["file"] != "")),
        key("path", c["arg_path"], when=c["strategy"] == "file_path"),
        key("norm", c["norm"], when=command), key("base", c["base"], when=command & (c["base"] != "")),
        key("target", c["cgroup"], c["target"], when=command & (c["cgroup"] != "") & (c["target"] != "")),
        key(f"wild{wild}", c["cgroup"], when=command & (c["cgroup"] != "") & (c["target"] == "")),
        key(f"wild{offer}", c["cgroup"], when=command & (c["cgroup"] != "")),
        key("flat", c["cmd_flat"], when=c["strategy"] == "command"),
        key("query", c["query"], when=c["strategy"] == "query"), key("args", c["args"]),
        key("request", when=c["kind"] == "request"),
        key(f"bare{wild}", when=no_entry), key(f"bare{offer}")))
    files = F.transform(F.when(c["grp_tool"] != "", c["files"]).otherwise(F.array().cast("array<string>")),
                        lambda f: F.concat_ws("\u0001", F.lit("mod"), fam, f))
    return F.array_distinct(F.concat(single, files))


def compared_words(c: Column) -> Column:
    """(rule, words) of contents that a word-overlap rule can compare: search targets, queries."""
    search = (c["strategy"] == "command") & (c["command"] != "") & (c["cgroup"] == "search")

    def row(rule, words):
        return F.struct(F.concat_ws("\u0001", F.lit(rule), c["fam"]).alias("rule"), words.alias("words"))
    return F.when(search, row("search", T.word_set(c["target"]))).when(c["strategy"] == "query", row("query", T.word_set(c["query"])))


def stream_keys(c: Column, side: str) -> Column:
    """All keys of one content, every compared word included: for sides that are not seen as a whole."""
    w = compared_words(c)
    words = F.transform(F.coalesce(w["words"], F.array().cast("array<string>")), lambda x: F.xxhash64(w["rule"], x))
    return F.array_distinct(F.concat(F.transform(block_keys(c, side), lambda k: F.xxhash64(k)), words))


def contents(*sides: DataFrame) -> DataFrame:
    """``sig`` and ``c`` of every distinct content. By grouping alone: ``first`` of a struct would sort all rows."""
    out = sides[0].select("sig", "c")
    for df in sides[1:]:
        out = out.unionByName(df.select("sig", "c"))
    return out.distinct()


def word_keys(ref: DataFrame, cand: DataFrame, keys: Sequence[str], every: bool = False, book: DataFrame | None = None) -> DataFrame:
    """Prefix words of both sides: keys, side, sig, key, n (size of the word set), per_cent (of the rule).

    Rarity is counted over the distinct contents of a task (one row each, ``c`` in it or in ``book``); ties go
    by the word. With ``every`` all words are keys, for rules that ask for less overlap."""
    keys = list(keys)
    words = (contents(ref, cand) if book is None else book).withColumn("_w", compared_words(F.col("c"))).where(
        "size(_w.words) > 0").select("sig", "_w.rule", "_w.words", F.size("_w.words").alias("n"))

    def rows(df, side):
        return df.select(*keys, "sig").join(words, "sig").select(*keys, F.lit(side).alias("side"), "sig", "rule", "words", "n")
    both = rows(ref, "ref").unionByName(rows(cand, "cand"))
    word = both.select(*keys, "side", "sig", "rule", "n", F.explode("words").alias("word"))
    count = word.groupBy(*keys, "rule", "word").agg(F.count(F.lit(1)).alias("_c"))
    per_cent = F.when(F.col("rule").startswith("search"), int(SEARCH_OVERLAP * 100)).otherwise(int(QUERY_OVERLAP * 100))
    per_cent = F.lit(1) if every else per_cent
    first = F.col("n") - F.ceil(F.col("n") * F.col("per_cent") / 100).cast("int") + 1
    ordered = word.join(count, [*keys, "rule", "word"]).groupBy(*keys, "side", "sig", "rule", "n").agg(
        F.array_sort(F.collect_list(F.struct("_c", "word"))).alias("_o")).withColumn("per_cent", per_cent)
    return ordered.select(*keys, "side", "sig", "rule", "n", "per_cent", F.explode(F.slice("_o", 1, first)).alias("_f")).select(
        *keys, "side", "sig", F.xxhash64("rule", "_f.word").alias("key"), "n", "per_cent")


def cascade(a: Column, b: Column, use_stage: bool = True,
            resolver: Callable[[Column, Column], Column] | None = None) -> Column:
    """Struct (equivalent, confidence, method) for a reference step and a candidate step.

    ``resolver`` may answer pairs whose heuristic confidence is below 0.8; it builds a
    column of the same struct type, null where it has no opinion.
    """
    def say(eq, conf, method):
        conf = F.lit(conf) if isinstance(conf, float) else conf
        return F.struct(F.lit(eq).alias("equivalent"), conf.cast("double").alias("confidence"),
                        F.lit(method).alias("method"))

    def both(f):
        return (a[f] != "") & (b[f] != "")

    def same(f):
        return both(f) & (a[f] == b[f])

    def pick(cond, yes, no):
        return F.when(cond, yes).otherwise(no)
    same_tool = a["tool"] == b["tool"]
    same_grp = (a["grp_tool"] != "") & (a["grp_tool"] == b["grp_tool"])
    edit, file_op = a["category"] == "edit", a["category"].isin("edit", "read")
    has_sym = (F.size(a["symbols"]) > 0) & (F.size(b["symbols"]) > 0)
    common_sym = F.arrays_overlap(a["symbols"], b["symbols"])
    ranges = a["l0"].isNotNull() & b["l0"].isNotNull() & a["l1"].isNotNull() & b["l1"].isNotNull()
    over = T.range_jaccard(a["l0"], a["l1"], b["l0"], b["l1"])
    hashes_differ = both("hash") & (a["hash"] != b["hash"])

    scope = F.when(edit & same_tool & same("file"),
        F.when(both("scope"), pick(same("scope"), say(True, 0.9, "scope_match"), say(False, 0.85, "scope_match")))
        .when(both("func"), pick(same("func"), say(True, 0.85, "scope_match"), say(False, 0.8, "scope_match")))
        .when(both("cls"), pick(same("cls"), say(True, 0.8, "scope_match"), say(False, 0.75, "scope_match")))
        .when(has_sym, pick(common_sym, say(True, 0.75, "scope_match_extracted"),
                            say(False, 0.7, "scope_match_extracted"))))
    lines = F.when(file_op & same_tool & both("file"),
        F.when(a["file"] != b["file"], say(False, 0.9, "line_overlap"))
        .when(~ranges, F.when(a["category"] == "read", say(True, 0.8, "line_overlap")))
        .when(over >= LINE_OVERLAP, say(True, 0.8 + over * 0.15, "line_overlap"))
        .when(over == 0, say(False, 0.8, "line_overlap")))
    effect = F.when(~file_op & same("effect") & ~hashes_differ, say(True, 0.95, "resulting_state"))
    like = T.word_jaccard(a["target"], b["target"])
    term = "terminal_similarity"
    same_cgroup = same("cgroup")
    terminal = F.when((a["strategy"] == "command") & both("command"),
        F.when(a["norm"] == b["norm"], say(True, 0.9, term))
        .when(same_cgroup & ~both("target"), say(True, 0.7, term))
        .when(same_cgroup & (a["target"] == b["target"]), say(True, 0.85, term))
        .when(same_cgroup & (a["cgroup"] == "search") & (like >= SEARCH_OVERLAP), say(True, 0.7 + like * 0.15, term))
        .when(same("base"), say(True, 0.75, term)))
    h = "heuristic"
    scopes_meet = F.arrays_overlap(F.transform(F.split(a["scope"], ","), F.trim),
                                   F.transform(F.split(b["scope"], ","), F.trim))
    cross = F.when(F.arrays_overlap(a["files"], b["files"]),
        F.when(hashes_differ & both("scope"), pick(scopes_meet, say(True, 0.85, h), say(False, 0.8, h)))
        .when(hashes_differ & has_sym, pick(common_sym, say(True, 0.8, h), say(False, 0.75, h)))
        .otherwise(say(True, 0.85, h))).otherwise(say(False, 0.95, h))
    bare = (F.when(a["initial"] & b["initial"], say(True, 1.0, h))
            .when(a["initial"] | b["initial"], say(False, 0.95, h))
            .when(a["tool"] == "", say(True, 0.5, h)).when(~both("file"), say(True, 0.75, h))
            .otherwise(pick(a["file"] == b["file"], say(True, 0.85, h), say(False, 0.85, h))))
    alike = T.word_jaccard(a["query"], b["query"])
    calls = (
        F.when(a["strategy"] == "file_path",
               F.when(a["arg_path"] != b["arg_path"], say(False, 0.9, h))
               .when((a["tool"] == "read_file") & ranges,
                     pick(over >= LINE_OVERLAP, say(True, 0.85 + over * 0.1, h), say(False, 0.85, h)))
               .otherwise(say(True, 0.9, h)))
        .when(a["strategy"] == "query",
              F.when(a["query"] == b["query"], say(True, 0.9, h))
              .when(alike > QUERY_OVERLAP, say(True, alike * 0.9, h)).otherwise(say(False, 0.7, h)))
        .when(a["strategy"] == "command", pick(a["cmd_flat"] == b["cmd_flat"], say(True, 0.9, h), say(False, 0.8, h)))
        .otherwise(pick(a["args"] == b["args"], say(True, 0.85, h), say(False, 0.6, h))))
    heuristic = (F.when(~same_tool, cross).when((a["kind"] == "") | (b["kind"] == ""), bare)
                 .when((a["kind"] == "toolCall") & (b["kind"] == "toolCall"), calls)
                 .when((a["kind"] == "request") & (b["kind"] == "request"), say(True, 0.85, h))
                 .otherwise(say(False, 0.8, h)))
    if resolver is not None:
        heuristic = F.when(heuristic["confidence"] < 0.8, F.coalesce(resolver(a, b), heuristic)).otherwise(heuristic)
    exact = (F.when(same_tool & same("hash"), say(True, 1.0, "content_hash"))
             .when(same_tool & same("effect") & ~both("hash"), say(True, 1.0, "resulting_state"))
             .when(same_tool & (a["obs"] == b["obs"]), say(True, 1.0, "exact_match")))
    out = F.coalesce(F.when(~same_tool & ~same_grp, say(False, 1.0, "exact_match")),
                     exact, scope, lines, effect, terminal, heuristic)
    if use_stage:
        out = F.when(both("stage") & (a["stage"] != b["stage"]), say(False, 0.95, "stage_mismatch")).otherwise(out)
    return out


def equivalence_pairs(ref: DataFrame, cand: DataFrame, keys: Sequence[str] = ("task_id",),
                      use_stage: bool = True, resolver=None,
                      extra_keys: Callable[[Column], Column] | None = None, book: DataFrame | None = None) -> DataFrame:
    """Equivalent signature pairs: keys, ref_sig, cand_sig, confidence, method.

    A ``resolver`` sees the pairs that share a block key or any word; ``extra_keys`` adds keys (an array
    of text per content) for rules that match on something else.

    Inputs carry ``c`` and ``sig``, or ``sig`` only if ``book`` has the contents of both (``sig`` and ``c``,
    each once). The reference side is one graph per key; candidates may be many, so the work is
    linear in distinct candidate signatures.
    """
    keys = list(keys)
    same = ref is cand
    # Written, as each is used several times: plans stay short, and wide steps are read once for each table.
    if book is None:
        book = contents(ref) if same else contents(ref, cand)
    book = written(book, "contents")
    ref = written(ref.select(*keys, "sig").distinct(), "ref_sigs")
    cand = ref if same else written(cand.select(*keys, "sig").distinct(), "cand_sigs")
    pairs = written(candidate_pairs(ref, cand, book, keys, use_stage, extra_keys, every_word=resolver is not None), "met")
    # The rules see contents only, so a pair of contents is decided once for all keys it occurs in.
    met = pairs.select("ref_sig", "cand_sig").distinct()
    for name in ("ref", "cand"):
        met = met.join(book.select(F.col("sig").alias(f"{name}_sig"), F.col("c").alias(name)), f"{name}_sig")
    # Exploded instead of filtered: a filter would be pushed down with a second copy of the long rule.
    verdict = F.filter(F.array(cascade(F.col("ref"), F.col("cand"), use_stage, resolver)), lambda v: v["equivalent"])
    decided = met.select("ref_sig", "cand_sig", F.explode(verdict).alias("_v"))
    return pairs.join(decided, ["ref_sig", "cand_sig"]).select(
        *keys, "ref_sig", "cand_sig", "_v.confidence", "_v.method")


def candidate_pairs(ref: DataFrame, cand: DataFrame, book: DataFrame, keys: Sequence[str], use_stage: bool = True,
                    extra_keys: Callable[[Column], Column] | None = None, every_word: bool = False) -> DataFrame:
    """Distinct (keys, ref_sig, cand_sig) of contents that some rule may accept.

    ``ref`` and ``cand`` hold keys and ``sig``, each once; ``book`` has the contents of both."""
    keys = list(keys)
    words = word_keys(ref, cand, keys, every_word, book)

    def side(df, name):
        found = block_keys(F.col("c"), name)
        if extra_keys is not None:
            found = F.array_distinct(F.concat(found, extra_keys(F.col("c"))))
        offered = book.select("sig", F.explode(F.transform(found, lambda k: F.xxhash64(k))).alias("key"), F.lit(None).cast("int").alias("n"),
                              F.lit(None).cast("int").alias("per_cent"))
        out = df.join(offered, "sig").unionByName(words.where(F.col("side") == name).drop("side"))
        if use_stage:
            out = out.join(book.select("sig", F.col("c.stage").alias("stage")), "sig")
        return out.select(*keys, "key", F.col("sig").alias(f"{name}_sig"), F.col("n").alias(f"{name}_n"),
                          *([F.col("stage").alias(f"{name}_stage")] if use_stage else []), *(["per_cent"] if name == "ref" else []))
    met = side(ref, "ref").join(side(cand, "cand"), [*keys, "key"])
    long_enough = F.least("ref_n", "cand_n") * 100 >= F.greatest("ref_n", "cand_n") * F.col("per_cent")
    met = met.where(F.coalesce(long_enough, F.lit(True)))
    if use_stage:
        met = met.where("ref_stage = '' OR cand_stage = '' OR ref_stage = cand_stage")
    return met.select(*keys, "ref_sig", "cand_sig").distinct()


def equivalence_stats(ref: DataFrame, cand: DataFrame, pairs: DataFrame,
                      keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Step pairs per outcome. Totals come from counts per stage, not from pairs."""
    keys = list(keys)

    def by(df, name, *cols):
        return df.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias(name))
    r, c = by(ref, "nr", "intent_stage"), by(cand, "nc", "intent_stage")
    total = by(ref, "nr").join(by(cand, "nc"), keys).select(*keys, (F.col("nr") * F.col("nc")).alias("total"))
    rl, cl = (x.where(F.col("intent_stage") != "") for x in (r, c))
    lab = rl.groupBy(*keys).agg(F.sum("nr").alias("nr")).join(
        cl.groupBy(*keys).agg(F.sum("nc").alias("nc")), keys).select(*keys, (F.col("nr") * F.col("nc")).alias("lab"))
    agree = rl.join(cl, [*keys, "intent_stage"]).groupBy(*keys).agg(F.sum(F.col("nr") * F.col("nc")).alias("agree"))
    rs, cs = by(ref, "nr", "sig").withColumnRenamed("sig", "ref_sig"), by(cand, "nc", "sig").withColumnRenamed("sig", "cand_sig")
    hits = pairs.join(rs, [*keys, "ref_sig"]).join(cs, [*keys, "cand_sig"]).withColumn("_n", F.col("nr") * F.col("nc"))
    exact = F.col("method").isin("content_hash", "exact_match") | (
        (F.col("method") == "resulting_state") & (F.col("confidence") == 1.0))
    found = hits.groupBy(*keys).agg(
        F.sum("_n").alias("equivalent"), F.sum(F.when(exact, F.col("_n")).otherwise(0)).alias("exact_matches"),
        F.sum(F.when((F.col("method") == "heuristic") & (F.col("confidence") >= 0.8), F.col("_n")).otherwise(0))
        .alias("heuristic_matches"))
    out = total.join(lab, keys, "left").join(agree, keys, "left").join(found, keys, "left").fillna(0)
    return out.select(*keys, F.col("total").alias("total_checks"),
                      (F.col("lab") - F.col("agree")).alias("stage_rejections"),
                      "equivalent", "exact_matches", "heuristic_matches")
