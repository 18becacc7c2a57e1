"""The registered ``opN_*`` queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavekit.llm.common import read_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return deco


@_register("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavekit.llm.simhash import simhash_components

    return simhash_components(read_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (SELECT norm, count(*) AS group_size,
             first(doc_id ORDER BY length(text) DESC, doc_id ASC NULLS LAST) AS keep_id
      FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


@_register("op10_exact_dedup", EXACT_SQL)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavekit.llm.exact import exact_dedup

    return exact_dedup(read_documents(spark, sf_dir))


@_register("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavekit.llm.quality import score_quality, train_quality

    docs = read_documents(spark, sf_dir)
    model = train_quality(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    return score_quality(docs, model).select("doc_id", held_out, "score", "predicted")


@_register("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavekit.llm.mixing import mix_sources

    return mix_sources(read_documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


@_register("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    """Per document: tokens, byte-fallback tokens, a digest of the ids, and whether decoding gives the text back."""
    from wavekit.llm.pieces import MODEL_FILE, PieceTable, encode_pieces

    table = PieceTable.from_model(model_file or MODEL_FILE)
    text = F.coalesce("text", F.lit(""))
    coded = encode_pieces(read_documents(spark, sf_dir).select("doc_id", text.alias("text")), table, decoded_col="decoded")
    lo, hi = int(table.byte_ids.min()), int(table.byte_ids.max())
    return coded.select(
        "doc_id",
        F.size("ids").alias("n_tokens"),
        F.size(F.filter("ids", lambda i: i.between(lo, hi))).alias("n_byte_tokens"),
        F.lower(F.hex(F.xxhash64("ids"))).alias("ids_xxh64"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


@_register("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavekit.llm.pii import BASE, find_pii

    found = find_pii(read_documents(spark, sf_dir))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.base)
    return found.select(
        "doc_id",
        *(count(kind) for kind in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0)).alias("top_score"),
    )


@_register("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavekit.llm.digest import neighbour_fingerprints

    return neighbour_fingerprints(read_documents(spark, sf_dir))


LINES_SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i, len(lines) AS n_lines FROM t),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, length(line) - length(replace(line, ' ', '')) >= 19 AS long FROM l),
p AS (SELECT *, (lag(h) OVER w * 31 + h) % 4294967296 AS p, lag(long) OVER w AS long_before FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, CASE WHEN i = 0 OR long OR long_before OR (p < lag(p) OVER w AND p < lead(p) OVER w) THEN 1 ELSE 0 END AS cut
      FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e),
chunk AS (SELECT doc_id, k, min(i) AS start, count(*) AS n, bool_or(long) AS long, any_value(n_lines) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS txt
          FROM c GROUP BY doc_id, k),
r AS (SELECT *, (n >= 2 OR long) AND row_number() OVER (PARTITION BY txt, n >= 2 OR long ORDER BY doc_id, start) > 1 AS gone FROM chunk)
SELECT doc_id, CAST(any_value(n_lines) AS INTEGER) AS n_lines,
       CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS INTEGER) AS n_removed,
       sha256(coalesce(string_agg(txt, chr(10) ORDER BY start) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""


@_register("op9_line_dedup", LINES_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavekit.llm.lines import dedup_lines

    return dedup_lines(read_documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@_register("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: confirmed licence paragraphs, their families, and what the classifier found unconfirmed."""
    from wavekit.llm.license import scan_licences, train_licences

    docs = read_documents(spark, sf_dir)
    found = scan_licences(docs, train_licences(docs))
    sure = F.filter("found", lambda x: x.confirmed)
    return found.select(
        "doc_id",
        F.size(sure).alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x.family))), ",").alias("families"),
        F.array_join(F.transform(sure, lambda x: F.concat_ws(":", x.paragraph.cast("string"), x.family)), ",").alias("paragraphs"),
        (F.size("found") - F.size(sure)).alias("n_unconfirmed"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x.probability)), F.lit(0.0)).alias("top_probability"),
    )


SUBSTRING_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
           FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM t WHERE len(ws) >= 13)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS gone FROM win),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM t),
f AS (SELECT w.doc_id, w.p, w.word,
             max(CASE WHEN m.gone THEN 1 ELSE 0 END)
               OVER (PARTITION BY w.doc_id ORDER BY w.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone
      FROM w LEFT JOIN m ON m.doc_id = w.doc_id AND m.i = w.p),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r,
             string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM f GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_words, CAST(coalesce(g.r, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(g.kept, '')) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id)
"""


@_register("op2_substring_dedup", SUBSTRING_SQL)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavekit.llm.substring import dedup_substrings

    return dedup_substrings(read_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


#: The vocabularies of op11 and op12: files of the installed module, the same on every machine or read on the driver.
BYTE_LEVEL, PIECES, WORD_ENDS = "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_register("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str, file_a: str | None = None, file_b: str | None = None) -> DataFrame:
    from wavekit.llm.alignment import align_tokenizers

    found = align_tokenizers(read_documents(spark, sf_dir), file_a or _tokenizer(BYTE_LEVEL), file_b or _tokenizer(PIECES), groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@_register("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from wavekit.llm.packing import pack_sequences

    pieces = pack_sequences(read_documents(spark, sf_dir).select("doc_id", "text"), tokenizer or _tokenizer(WORD_ENDS))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# The checksum of a decimal number, bit by bit over its digits' bytes (ASCII), lowest bit first.
_CRC_SQL = """
SELECT doc_id, list_reduce(bits, lambda c, b: CASE WHEN (c & 1) <> b THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT) AS c
FROM (SELECT DISTINCT doc_id, list_transform(range(0, 8 * length(doc_id::VARCHAR)),
             lambda i: ((ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1)::BIGINT) AS bits
      FROM documents WHERE doc_id IS NOT NULL)
"""

MERKLE_SQL = rf"""
WITH RECURSIVE crc AS ({_CRC_SQL}),
f AS (SELECT d.doc_id, lang, coalesce(xor(c, 4294967295) % 7 = 0, false) AS tampered,
        coalesce(octet_length(encode(d.doc_id::VARCHAR)) || ':' || d.doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
          || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a,
        coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS m,
        coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS m2,
        coalesce(octet_length(encode(text)) || ':' || text, '-') AS z
      FROM documents d LEFT JOIN crc USING (doc_id)),
leaf AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, h, t
         FROM (SELECT doc_id, lang, sha256(a || m || z) AS h, CASE WHEN tampered THEN sha256(a || m2 || z) ELSE sha256(a || m || z) END AS t FROM f)),
node AS (SELECT lang, 0 AS lv, i, n, h FROM leaf
         UNION ALL
         SELECT lang, lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lang, lv, i // 2, n),
sub AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, lv AS top FROM node WHERE n = 1),
high AS (SELECT 0 AS lv, i, n, h FROM sub
         UNION ALL
         SELECT lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lv, i // 2, n),
fold AS (SELECT l.doc_id, l.lang, l.i AS leaf_i, l.h AS leaf, s.h AS subroot, s.i AS k, s.top, 0 AS lv, l.i, l.n, l.t AS acc, '' AS proof
         FROM leaf l JOIN sub s ON l.lang IS NOT DISTINCT FROM s.lang
         UNION ALL
         SELECT f.doc_id, f.lang, f.leaf_i, f.leaf, f.subroot, f.k, f.top, f.lv + 1, f.i // 2, (f.n + 1) // 2,
                sha256(CASE WHEN f.i % 2 = 0 THEN f.acc || coalesce(x.h, '') ELSE x.h || f.acc END), f.proof || coalesce(x.h, '')
         FROM fold f LEFT JOIN node x ON x.lv = f.lv AND x.lang IS NOT DISTINCT FROM f.lang AND x.i = xor(f.i, 1)
         WHERE f.n > 1),
fold2 AS (SELECT doc_id, lang, leaf_i, leaf, subroot, 0 AS lv, k AS i, (SELECT count(*) FROM sub) AS n, acc, proof FROM fold WHERE n = 1
          UNION ALL
          SELECT f.doc_id, f.lang, f.leaf_i, f.leaf, f.subroot, f.lv + 1, f.i // 2, (f.n + 1) // 2,
                 sha256(CASE WHEN f.i % 2 = 0 THEN f.acc || coalesce(x.h, '') ELSE x.h || f.acc END), f.proof || coalesce(x.h, '')
          FROM fold2 f LEFT JOIN high x ON x.lv = f.lv AND x.i = xor(f.i, 1)
          WHERE f.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM (SELECT *, (SELECT h FROM high WHERE n = 1) AS root FROM fold2 WHERE n = 1)
"""


@_register("op13_manifest", MERKLE_SQL)
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavekit.llm.merkle import manifest

    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    found = manifest(read_documents(spark, sf_dir), tampered={"n_chars": F.col("n_chars") + 1}, tamper_where=chosen)
    proof = F.lower(F.array_join(F.transform("proof", lambda s: F.hex(F.concat(s["left"], s["right"]))), ""))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", "verified")
