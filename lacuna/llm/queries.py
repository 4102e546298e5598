"""Registered queries of the operators: thin contracts over whole tables, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import addressable, alignment, classifier, collocations, ctw, fingerprints, jaccard, mixing, packing, pages, repeats, rules, secret_scan
from .columns import learns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("set_id")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_file() -> str:
    """The default vocabulary of the packing query; any path can be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.token_pieces(docs, tokenizer_file()))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, at = rules.quality_rules(docs, table(spark, sf_dir, "labels"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return rows.select("doc_id", *(f"{at}.{c}" for c in names))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, at = classifier.quality_scores(docs, table(spark, sf_dir, "labels"))
    rows = rows.select("doc_id", (~learns("doc_id", 5, 0)).alias("held_out"), F.col(at).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= classifier.CUT).cast("int"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, at = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", f"{at}.n_assign", f"{at}.n_access", f"{at}.n_hex", F.sha2(f"{at}.base_spans", 256).alias("base_sha256"),
        f"{at}.spans", f"{at}.n_unscanned",
    )


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows, at = mixing.mix_sources(docs)
    return rows.select("doc_id", f"{at}.size", f"{at}.source_size", f"{at}.target", f"{at}.taken")


def op11_addressable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    images = addressable.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return addressable.read_documents(images, docs.schema["doc_id"].dataType)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), *files).drop("groups")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (SELECT *, cap::DOUBLE / w AS rate, sum(source_size) OVER () * 1.5::DOUBLE AS everything FROM w),
c AS (SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY rate, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(w) OVER (ORDER BY rate, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS common FROM r),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT common FROM c WHERE common <= rate ORDER BY rate, source NULLS LAST LIMIT 1) * w) AS target FROM c),
b AS (SELECT *, CASE WHEN target >= source_size THEN 1 ELSE 0 END AS base,
             target - CASE WHEN target >= source_size THEN source_size ELSE 0 END AS budget FROM t),
x AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.base, b.budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING)::BIGINT AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h)::BIGINT AS same
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       size * (base + CASE WHEN upto <= budget OR (upto - same <= budget AND upto - budget < budget - (upto - same)) THEN 1 ELSE 0 END) AS taken
FROM x
"""

_LEAVES = r"""list_transform(string_split({0}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p:
  list_transform(range(1, len(string_split(p, ' ')) + 1, 16), lambda i:
    substr(sha256(array_to_string(list_slice(string_split(p, ' '), i, i + 15), ' ')), 1, 16))))"""

_RENDERED = r"""sha256(array_to_string({0}_s, ',')) || ';' || array_to_string({0}_s, ',') || ';' ||
  array_to_string(list_transform({0}, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(p, ' ')), '|')), chr(10))"""

_SECTIONS = r"""list_transform({0}, lambda s: substr(sha256(array_to_string(list_transform(s, lambda p: substr(sha256(array_to_string(p, ' ')), 1, 32)), '|')), 1, 32))"""

OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, text),
                         first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text)) AS nxt FROM d),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(nxt, 1, length(text) // 2) AS edited FROM n),
l AS (SELECT *, {_LEAVES.format('text')} AS a, {_LEAVES.format('edited')} AS b, {_LEAVES.format('nxt')} AS c FROM e),
x AS (SELECT *, {_SECTIONS.format('a')} AS a_s, {_SECTIONS.format('b')} AS b_s,
             list_distinct(flatten(flatten(a))) AS sa, list_distinct(flatten(flatten(b))) AS sb, list_distinct(flatten(flatten(c))) AS sc FROM l)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
       {_RENDERED.format('a')} AS fingerprint, {_RENDERED.format('b')} AS edited_fingerprint,
       2.0::DOUBLE * len(list_intersect(sa, sb)) / (len(sa) + len(sb)) AS near_edited,
       2.0::DOUBLE * len(list_intersect(sa, sc)) / (len(sa) + len(sc)) AS near_next
FROM x
"""

OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, w
  FROM (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
        FROM documents)),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
      FROM p, range(1, 5) AS ks(k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.a AS l, y.a AS r, (c.a::HUGEINT * 2000000) // (x.a::HUGEINT + y.a::HUGEINT) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.cut], ' ')
             JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT DISTINCT i.lang, i.phrase FROM (
        SELECT lang, a, array_to_string(w[j : j + m - 1], ' ') AS phrase
        FROM (SELECT lang, k, a, string_split(phrase, ' ') AS w FROM f WHERE k > 2), range(2, 4) AS ms(m),
             LATERAL (SELECT unnest(range(1, k - m + 2)) AS j) WHERE m < k) i
      JOIN b ON b.lang = i.lang AND b.phrase = i.phrase WHERE 100 * i.a >= 80 * b.a)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, t.n, b.score::BIGINT AS score
FROM b JOIN t ON t.lang = b.lang ANTI JOIN d ON d.lang = b.lang AND d.phrase = b.phrase
QUALIFY rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_fingerprints": op2_fingerprints,
    "op3_ctw": op3_ctw,
    "op4_pack": op4_pack,
    "op5_repeats": op5_repeats,
    "op6_pages": op6_pages,
    "op7_rules": op7_rules,
    "op8_quality": op8_quality,
    "op9_mix": op9_mix,
    "op10_secrets": op10_secrets,
    "op11_addressable": op11_addressable,
    "op12_collocations": op12_collocations,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op2_fingerprints": OP2_SQL,
    "op9_mix": OP9_SQL,
    "op12_collocations": OP12_SQL,
}
