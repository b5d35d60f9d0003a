"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of the last ``WINDOW`` (two) lines decides where a chunk ends, so
boundaries depend on nearby content alone and re-align after an insertion. A line of ``long_line``
words or more stands alone. A chunk takes part if it has two or more lines and ``min_words`` words,
or is such a long line. Of chunks with equal bytes the first place, by (doc_id, chunk number),
stays; the others go.

Chunks are grouped by their bytes themselves, with map-side counting, so a passage that a third of
all documents share arrives as one row per task. Places of repeated chunks then join on the digest
as a plain two-sided join, which adaptive execution can split.

``passage_words`` adds what chunk boundaries hide: every run of lines of that many words or more that
also stands at an earlier place goes, line by line. A run of that size is covered by its shortest
windows of that size, those that begin and those that end at each of its lines, and a window depends
on its own lines alone; so windows are grouped as chunks are. A line has one word at least, so a
window has at most ``passage_words`` lines. Both are judged on the unchanged texts, so a line that
goes has an equal one at an earlier place that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE_IN = 3
LONG_LINE = 50
MIN_WORDS = 20
PASSAGE_WORDS = 50
#: Fixed values of the rolling hash.
BASE, PRIME = 31, 2147483647


def line_hash(line: Column) -> Column:
    """32 bits of the line's MD5 as a long."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def with_chunks(docs: DataFrame, text_col: str, out: str, one_in: int, long_line: int, min_words: int) -> DataFrame:
    """Add ``out``: array of (no, body, eligible) and ``out``_lines, the number of lines."""
    lines, hashes, words, ends = (f"{out}_{x}" for x in ("lines_", "hash_", "words_", "ends_"))
    df = docs.withColumn(lines, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    df = df.withColumn(hashes, F.transform(lines, line_hash)).withColumn(
        words, F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1))

    def ends_here(i: Column) -> Column:
        before = F.coalesce(F.get(F.col(hashes), i - 1), F.lit(0))
        rolled = (before * BASE + F.get(F.col(hashes), i)) % PRIME
        return ((rolled % one_in == 0) | (F.get(F.col(words), i) >= long_line)
                | F.coalesce(F.get(F.col(words), i + 1) >= long_line, F.lit(True)))

    df = df.withColumn(ends, F.filter(F.sequence(F.lit(0), F.size(lines) - 1), ends_here))

    def chunk(end: Column, no: Column) -> Column:
        start = F.when(no == 0, F.lit(0)).otherwise(F.get(F.col(ends), no - 1) + 1)
        count = F.aggregate(F.slice(F.col(words), start + 1, end - start + 1), F.lit(0), lambda a, x: a + x)
        long_one = F.get(F.col(words), end) >= long_line
        return F.struct(no.alias("no"), start.alias("start"), end.alias("end"), F.array_join(F.slice(F.col(lines), start + 1, end - start + 1), "\n").alias("body"),
                        (((end > start) & (count >= min_words)) | long_one).alias("eligible"))

    return (df.withColumn(out, F.transform(ends, chunk)).withColumn(f"{out}_lines", F.size(lines))
            .drop(lines, hashes, words, ends))


def repeated_places(places: DataFrame) -> DataFrame:
    """Of (doc_id, no, digest, body): the places to remove, (doc_id, no, digest)."""
    # One mutable key for "first place", so that the grouping stays a hash aggregate.
    order = F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(12,0)") + F.col("no")
    first = (places.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("copies"),
                                                  F.min(order.cast("decimal(38,0)")).alias("first"))
             .where("copies > 1").select("digest", "first"))
    refs = places.select("doc_id", "no", "digest", order.cast("decimal(38,0)").alias("here"))
    return refs.join(first, "digest").where(F.col("here") != F.col("first")).select("doc_id", "no", "digest")


def repeated_passages(texts: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """Of (doc_id, body): the runs of lines to remove, (doc_id, version, start, end), both ends included.

    ``version`` tells rows apart that share an id; equal windows at one line of one id are one place.
    """
    def digest(x: Column) -> Column:
        return F.substring(F.sha2(x, 256), 1, 32)

    df = texts.select("doc_id", F.xxhash64("body").alias("version"), F.split("body", "\n", -1).alias("lines"))
    df = df.select("doc_id", "version", F.transform("lines", digest).alias("hash"), F.transform("lines", lambda x: F.least(
        F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1, F.lit(words)).cast("long")).alias("w"))
    one = 1 << 20  # lines and words share one number

    def window(part: Column, start) -> Column:
        """(start, n) of the least lines of ``part`` that hold ``words``, or null."""
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: F.when(a % one >= words, a).otherwise(a + one + x),
                           lambda a: F.when(a % one >= words, F.struct(start(F.shiftright(a, 20).cast("int")).alias("start"),
                                                                       F.shiftright(a, 20).cast("int").alias("n"))))

    def ahead(i: Column) -> Column:
        return window(F.slice("w", i + 1, F.lit(words)), lambda n: i)

    def back(i: Column) -> Column:
        low = F.greatest(i - (words - 1), F.lit(0))
        return window(F.reverse(F.slice("w", low + 1, i - low + 1)), lambda n: i - n + 1)

    every = F.sequence(F.lit(0), F.size("hash") - 1)
    found = F.array_distinct(F.array_compact(F.concat(F.transform(every, ahead), F.transform(every, back))))
    places = df.select("doc_id", "version", F.explode(F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), x["n"].alias("n"),
        F.unhex(digest(F.array_join(F.slice("hash", x["start"] + 1, x["n"]), ""))).alias("key")))).alias("x"))
    order = F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(12,0)") + F.col("start")
    places = places.select("doc_id", "version", "x.*").withColumn("here", order.cast("decimal(38,0)"))
    first = (places.groupBy("key").agg(F.min("here").alias("first"), F.max("here").alias("last"))
             .where("first < last").select("key", "first"))
    again = places.join(first, "key").where(F.col("here") > F.col("first"))
    # A place that overlaps its own first one leaves it the lines they share.
    shared = F.col("n") - F.least(F.col("here") - F.col("first"), F.col("n")).cast("int")
    return again.select("doc_id", "version", (F.col("start") + shared).alias("start"), (F.col("start") + F.col("n") - 1).alias("end"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN,
               long_line: int = LONG_LINE, min_words: int = MIN_WORDS, passage_words: int | None = None) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, plus n_lines, n_chunks, n_removed_chunks in a
    struct ``_line_dedup``; with ``passage_words`` also n_removed_lines, of chunks and passages.

    Rows are never dropped. Words are counted as blanks plus one. Null text stays null and an empty
    one stays empty; rows without an id pass unchanged and lend no chunk. Rows that repeat an id
    and a text count as one place, so a chunk they hold first stays in each of them.
    """
    chunked = with_chunks(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"),
                                      F.col(text_col).alias("body")), "body", "chunks", one_in, long_line, min_words)
    places = (chunked.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.filter("chunks", lambda c: c["eligible"])).alias("c"))
              .select("doc_id", F.col("c.no").alias("no"), F.unhex(F.sha2("c.body", 256)).alias("digest"),
                      F.col("c.body").alias("body")))
    gone = repeated_places(places)
    if passage_words is None:
        gone = gone.groupBy("doc_id").agg(F.collect_set(F.struct("no", "digest")).alias("gone"))
    else:
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body")).where("doc_id IS NOT NULL AND body IS NOT NULL")
        runs = repeated_passages(texts, passage_words).select("doc_id", F.struct("version", "start", "end").alias("run"))
        gone = (gone.select("doc_id", F.struct("no", "digest").alias("chunk")).unionByName(runs, allowMissingColumns=True)
                .groupBy("doc_id").agg(F.collect_set("chunk").alias("gone"), F.collect_list("run").alias("runs")))
    # Only texts that lose something are cut again; the digest guards against rows that share an id.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"))
    out = rows.join(gone, "doc_id", "left").withColumn("body", F.col(f"row.{text_col}"))
    out = with_chunks(out, "body", "chunks", one_in, long_line, min_words)
    kept = F.filter("chunks", lambda c: F.col("gone").isNull() | ~F.array_contains(
        "gone", F.struct(c["no"].alias("no"), F.unhex(F.sha2(c["body"], 256)).alias("digest"))))
    out = out.withColumn("kept", kept)
    if passage_words is not None:
        return _without_lines(out, docs.columns, text_col)
    text = F.when(F.col("body").isNull() | F.col("gone").isNull(), F.col("body")).otherwise(
        F.array_join(F.transform("kept", lambda c: c["body"]), "\n"))
    removed = (F.size("chunks") - F.size("kept")).cast("long")
    stats = F.struct(F.col("chunks_lines").cast("long").alias("n_lines"), F.size("chunks").cast("long").alias("n_chunks"),
                     removed.alias("n_removed_chunks"))
    return out.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns],
                      stats.alias("_line_dedup"))


def _without_lines(out: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """The rows without the lines of removed chunks and passages; sets of line numbers, so linear in the text."""
    span = lambda x: F.sequence(x["start"], x["end"])
    here = F.filter("runs", lambda r: r["version"] == F.col("version"))
    lost = F.concat(F.flatten(F.transform(F.array_except("chunks", "kept"), span)), F.flatten(F.transform(here, span)))
    out = out.withColumn("version", F.xxhash64("body")).withColumn("lost", F.when(F.col("gone").isNotNull(), lost))
    out = out.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("body", "\n", -1)))
    # Two uses of the lines keep the optimizer from splitting the text once per line.
    out = out.withColumn("left", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost"))
    lines_gone = F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long")
    text = F.when(F.col("body").isNull() | F.col("gone").isNull(), F.col("body")).otherwise(
        F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    stats = F.struct(F.col("chunks_lines").cast("long").alias("n_lines"), F.size("chunks").cast("long").alias("n_chunks"),
                     (F.size("chunks") - F.size("kept")).cast("long").alias("n_removed_chunks"), lines_gone.alias("n_removed_lines"))
    return out.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in columns], stats.alias("_line_dedup"))
