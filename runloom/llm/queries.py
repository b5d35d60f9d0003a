"""Registered queries of the text operators: name -> (function of session and folder, check SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runloom.llm.exact_dedup import exact_groups
    return exact_groups(_table(spark, sf_dir, "documents"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runloom.llm.line_dedup import line_dedup
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "_line_dedup.n_lines", "_line_dedup.n_chunks", "_line_dedup.n_removed_chunks", "text")


#: The same chunks by window functions: line hashes, boundaries, numbering, first places, reassembly.
LINE_DEDUP_SQL = """
line AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS body,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i
  FROM {source}),
hashed AS (
  SELECT *, ('0x' || substr(md5(body), 1, 8))::BIGINT AS h, length(body) - length(replace(body, ' ', '')) + 1 AS w FROM line),
seen AS (
  SELECT *, coalesce(lag(h) OVER d, 0) AS before, lead(w) OVER d AS next_w FROM hashed
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
cut AS (
  SELECT *, ((before * 31 + h) % 2147483647) % 3 = 0 OR w >= 50 OR coalesce(next_w >= 50, TRUE) AS is_end FROM seen),
numbered AS (
  SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no
  FROM cut),
chunk AS (
  SELECT doc_id, no, string_agg(body, chr(10) ORDER BY i) AS body, count(*) AS lines, sum(w) AS words FROM numbered GROUP BY doc_id, no),
ranked AS (
  SELECT *, (lines > 1 AND words >= 20) OR words >= 50 AS eligible FROM chunk),
placed AS (
  SELECT *, eligible AND row_number() OVER (PARTITION BY eligible, body ORDER BY doc_id, no) > 1 AS gone FROM ranked),
deduped AS (
  SELECT doc_id, sum(lines)::BIGINT AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed_chunks,
         coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text
  FROM placed GROUP BY doc_id)
"""
OP3_SQL = f"WITH {LINE_DEDUP_SQL.format(source='documents')} SELECT * FROM deduped"


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runloom.llm.near_dedup import near_groups
    return near_groups(_table(spark, sf_dir, "documents"), similarity=0.85)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runloom.llm.decontaminate import contamination
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runloom.llm.quality import score
    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("digest")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runloom.llm.bpe import encode_digests
    return encode_digests(_table(spark, sf_dir, "documents"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runloom.llm.token_files import round_trip
    return round_trip(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runloom.llm.secret_scan import scan
    return scan(_table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runloom.llm.html_extract import extract_pages
    return extract_pages(_table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runloom.llm.license_scan import scan
    listed = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], *[x[c].cast("string") for c in ("first", "end", "coverage")]))
    return scan(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(listed, ",").alias("licenses"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runloom.llm.merkle import verify_tampered
    return verify_tampered(_table(spark, sf_dir, "documents"))


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode({name}::VARCHAR)) || ':' || {name}::VARCHAR, '-')"


def _merkle_sql(group_levels: int = 6, top_levels: int = 4) -> str:
    """Trees, proofs and folds by string aggregation, a fixed number of levels (16 ** levels rows): a lone node of a
    group passes a level unchanged. A hash of hex digests in the order of their places is one aggregate."""
    def row(text: str) -> str:
        return " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text)))
    lower = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    ctes = [
        # CRC-32 bit by bit: a step of -1 shifts the register, other steps add a byte.
        """crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT::HUGEINT, flatten(list_transform(
           string_split(doc_id::VARCHAR, ''), lambda ch: [ord(ch)::HUGEINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::HUGEINT * (c & 1::HUGEINT)) END), 4294967295::HUGEINT) AS h
           FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))""",
        f"""leaf AS (SELECT d.doc_id, coalesce('=' || source, '') AS key, sha256({row('text')}) AS d,
            CASE WHEN h % 5 = 0 THEN sha256({row(lower)}) END AS other FROM documents d LEFT JOIN crc USING (doc_id))""",
        """g0 AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, d, other) - 1 AS pos,
           count(*) OVER (PARTITION BY key) AS n, d, doc_id, other FROM leaf)"""]
    climb = """SELECT key, pos // 16 AS pos, (max(n) + 15) // 16 AS n,
               CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {} GROUP BY key, pos // 16"""
    ctes += [f"g{k + 1} AS ({climb.format(f'g{k}')})" for k in range(group_levels)]
    ctes.append(f"t0 AS (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n, d, key AS grp FROM g{group_levels})")
    ctes += [f"t{k + 1} AS ({climb.format(f't{k}')})" for k in range(top_levels)]
    step = """SELECT f.id, any_value(f.doc_id) AS doc_id, f.key, f.pos // 16 AS pos, any_value(f.leaf) AS leaf, any_value(f.grp) AS grp,
              CASE WHEN max(t.n) = 1 THEN any_value(f.cur) ELSE sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.cur ELSE t.d END, '' ORDER BY t.pos)) END AS cur,
              any_value(f.proof) || coalesce(string_agg(t.d, '' ORDER BY t.pos) FILTER (t.pos <> f.pos), '') AS proof
              FROM {} f JOIN {} t ON t.key = f.key AND t.pos // 16 = f.pos // 16 GROUP BY f.id, f.key, f.pos // 16"""
    ctes.append("f0 AS (SELECT row_number() OVER () AS id, doc_id, key, pos, d AS leaf, key AS grp, coalesce(other, d) AS cur, '' AS proof FROM g0)")
    ctes += [f"f{k + 1} AS ({step.format(f'f{k}', f'g{k}')})" for k in range(group_levels)]
    ctes.append(f"u0 AS (SELECT f.id, f.doc_id, '' AS key, t0.pos, f.leaf, f.grp, f.cur, f.proof FROM f{group_levels} f JOIN t0 ON t0.grp = f.grp)")
    ctes += [f"u{k + 1} AS ({step.format(f'u{k}', f't{k}')})" for k in range(top_levels)]
    return f"""WITH {", ".join(ctes)}
SELECT u.doc_id, u.leaf, s.d AS subroot, r.d AS root, sha256(u.proof) AS proof_sha256, u.cur AS folded_root, u.cur = r.d AS verified
FROM u{top_levels} u JOIN t0 s ON s.grp = u.grp CROSS JOIN t{top_levels} r"""


OP11_SQL = _merkle_sql()


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runloom.llm.periodic_runs import run_digests
    return run_digests(_table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runloom.llm.ngram_join import jaccard_groups
    return jaccard_groups(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


#: The classifier's fit, sketches, merges, coding, trees and alignments can't be expressed in SQL;
#: those queries are tested against brute-force versions.
QUERIES = {
    "op1_token_files": (op1_token_files, None),
    "op2_near_dedup": (op2_near_dedup, None),
    "op3_line_dedup": (op3_line_dedup, OP3_SQL),
    "op4_quality": (op4_quality, None),
    "op5_bpe": (op5_bpe, None),
    "op6_secret_scan": (op6_secret_scan, None),
    "op7_exact_dedup": (op7_exact_dedup, OP7_SQL),
    "op8_html_extract": (op8_html_extract, None),
    "op9_license_scan": (op9_license_scan, None),
    "op10_decontamination": (op10_decontamination, None),
    "op11_merkle_manifest": (op11_merkle_manifest, OP11_SQL),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_ngram_join": (op13_ngram_join, None),
    "pipeline": (pipeline, None),
}
