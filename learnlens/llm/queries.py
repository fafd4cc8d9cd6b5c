"""The registered queries of the operators: each applies one operator with
its production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    caps, common, decontaminate, exact, fim, fmindex, licenses, lm, merkle, packing, quality, simhash, toxicity, urlfilter)
from .common import ship, table


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urlfilter.verdicts(table(spark, folder, "pages"))


def op2_interpolated_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scores(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.scores(docs, model).select(
        "doc_id", (common.crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", "fingerprint", "component_id")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"), "quality")
    return quality.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out"),
        F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op6_cap_filters(spark: SparkSession, folder: str) -> DataFrame:
    return caps.near_duplicates(table(spark, folder, "embeddings"))


def op7_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pieces(table(spark, folder, "documents")).drop("ids")


def op8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return fmindex.kept_words(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"),
        F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


def _digest(text: str) -> Column:
    return F.sha2(F.col(text), 256)


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return exact.classes(table(spark, folder, "documents"), carry={"text_sha256": sha}).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    rows = merkle.manifest(table(spark, folder, "documents"), tampered=common.crc_mod("doc_id", 5) == 0)
    siblings = F.array_join(F.transform("proof", merkle.hexed), "")
    return rows.select(
        "doc_id", *[merkle.hexed(c).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(siblings, 256).alias("proof_sha256"), merkle.hexed("folded_root").alias("folded_root"), "verified")


def op13_fim(spark: SparkSession, folder: str) -> DataFrame:
    made = fim.restore(fim.transform(table(spark, folder, "documents"), seed=42, fim_percent=50, spm_percent=80))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       _digest("output").alias("output_sha256"), _digest("restored").alias("restored_sha256"))


def _shipping(query):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)
    return run


def registered() -> dict:
    return {f.__name__: _shipping(f) for f in (
        op1_url_filter, op2_interpolated_lm, op3_toxicity, op4_simhash, op5_quality_rules,
        op6_cap_filters, op7_pack, op8_repeats, op9_decontaminate, op10_licenses, op11_exact_dedup,
        op12_merkle, op13_fim)}


# ---- DuckDB SQL of the queries that SQL can express

_LOWER = f"translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}')"

_DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{common.ALNUM_WORD}') AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (
  SELECT item_id, regexp_extract_all({_LOWER}, '{common.ALNUM_WORD}') AS w FROM benchmark) WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
spots AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins))),
hits AS (SELECT s.*, item_id FROM spots s JOIN wins USING (n, win)),
covered AS (
  SELECT doc_id, COUNT(DISTINCT k) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (
  SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

_REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k
  FROM (SELECT doc_id, i, MIN(doc_id) OVER (PARTITION BY win) AS first FROM spots) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
kept AS (
  SELECT doc_id, COUNT(*) AS n, string_agg(word, ' ' ORDER BY k) AS text
  FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

_CAPS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a, COUNT(*) AS n FROM links GROUP BY a) c ON c.a = vec_id
LEFT JOIN (SELECT a, MIN(b) AS low FROM reach GROUP BY a) r ON r.a = vec_id"""


_EXACT = """
SELECT doc_id, MAX(doc_id) OVER same AS keep_id, COUNT(*) OVER same AS group_size,
       doc_id = MAX(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def _merkle(levels: int = 6) -> str:
    """The manifest with the levels written out: up to 16^levels rows in a source,
    and as many sources."""
    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(
            f"coalesce(concat(strlen({v}), ':', {v}), '-')" for v in
            ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + "))"

    # CRC-32 bit by bit: over the bytes of the id's digits, and eight times a byte.
    crc = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(
        string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
        lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)))"""
    ctes = [f"""d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0
  THEN {leaf(f"translate(text, '{common.UPPER}', '{common.LOWER}')")} ELSE {leaf('text')} END AS start FROM documents)""",
            """a0 AS (SELECT doc_id, leaf, start, leaf AS h, DENSE_RANK() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS no,
  COUNT(*) OVER (PARTITION BY source) AS n FROM d)"""]
    for own in "ab":
        for k in range(1, levels + 1):
            ctes.append(f"""{own}{k} AS (SELECT p.tree, p.no // 16 AS no, (ANY_VALUE(p.n) + 15) // 16 AS n,
  list(p.h ORDER BY p.no) AS kids, sha256(string_agg(p.h, '' ORDER BY p.no)) AS h
  FROM {own}{k - 1} p WHERE p.n > 1 GROUP BY p.tree, p.no // 16)""")
        every = " UNION ALL ".join(f"SELECT tree, no, h FROM {own}{k} WHERE n = 1" for k in range(levels + 1))
        ctes.append(f"{own}_top AS ({every})")
        if own == "a":
            ctes.append("b0 AS (SELECT -1 AS tree, tree AS no, COUNT(*) OVER () AS n, h FROM a_top)")
    ctes.append("c0 AS (SELECT doc_id, leaf, a_top.h AS subroot, a0.tree, a0.no, a0.n, start AS f, '' AS proof FROM a0 JOIN a_top USING (tree))")
    last = "c0"
    for own in "ab":
        for k in range(1, levels + 1):
            if own == "b" and k == 1:
                ctes.append(f"""u AS (SELECT c.doc_id, c.leaf, c.subroot, b0.tree, b0.no, b0.n, c.f, c.proof
  FROM {last} c JOIN b0 ON b0.no = c.tree)""")
                last = "u"
            at = "c.no % 16"
            ctes.append(f"""{own}c{k} AS (SELECT c.doc_id, c.leaf, c.subroot, c.tree, c.no // 16 AS no, (c.n + 15) // 16 AS n,
  CASE WHEN p.no IS NULL THEN c.f ELSE sha256(concat(array_to_string(p.kids[1:{at}], ''), c.f,
    array_to_string(p.kids[{at} + 2:], ''))) END AS f,
  concat(c.proof, array_to_string(p.kids[1:{at}], ''), array_to_string(p.kids[{at} + 2:], '')) AS proof
  FROM {last} c LEFT JOIN {own}{k} p ON p.tree = c.tree AND p.no = c.no // 16 AND c.n > 1)""")
            last = f"{own}c{k}"
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, b_top.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b_top.h AS verified
FROM {last}, b_top"""


_FIM = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', doc_id)) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
g AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
       THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
  array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid)
              ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""


def oracle() -> dict[str, str]:
    return {"op6_cap_filters": _CAPS, "op8_repeats": _REPEATS, "op9_decontaminate": _DECONTAMINATE,
            "op11_exact_dedup": _EXACT, "op12_merkle": _merkle(), "op13_fim": _FIM}
