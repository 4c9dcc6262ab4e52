"""Registered queries of this package: thin wrappers that give each operator's contract columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, exact_dedup, filter_audit, line_dedup, media, packing, quality, quality_rules, secrets, simhash, token_counts, toxicity, whitening
from lectern.llm.common import documents, held_out_column
from lectern.session import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans by kind with their digest, and all spans with those of the entropy scan."""
    found = secrets.find(documents(spark, sf_dir))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.listing("assign", "access", "hex"), 256).alias("base_sha256"), secrets.listing("assign", "access", "hex", "entropy").alias("spans"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a network trained on the rows that are not held out."""
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to ids and back: token count and digests of the ids and the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents in windows with the corpus's own mixture of sources."""
    return packing.pack(documents(spark, sf_dir, "doc_id", "text", "source"), public_tokenizers.path("word_bpe_49k.json"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's WAV file, of the samples read back and of its spectral-peak pairs."""
    found = media.media_table(documents(spark, sf_dir))
    feature = F.concat_ws(":", F.size("peak_times").cast("string"), F.size("pair_times").cast("string"), F.lower(F.hex(F.xxhash64("pair_times", "pair_codes"))))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document, by a model of the rows that are not held out."""
    docs = documents(spark, sf_dir)
    model = quality.train(docs, quality.ratings(table(spark, sf_dir, "labels")))
    return quality.select(docs, model).select("doc_id", held_out_column().alias("held_out"), "expected_grade", F.col("tail_probability").alias("score"), F.col("kept").cast("int").alias("predicted"), "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which occurrence stays for every line of every document."""
    return line_dedup.line_groups(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row stays of each group of equal texts, for every document."""
    return exact_dedup.exact_groups(documents(spark, sf_dir))


#: Personal data that op10's edits take out of the texts: mail addresses, phone and card numbers. The repeated group is
#: possessive: Java's matcher recurses for any other, once for each repetition.
PERSONAL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++|\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}|(?<![0-9])[0-9]{16}(?![0-9])"


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its personal data is masked, by trees that are kept."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    trees = token_counts.kept_trees(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    spans = secrets.spans(F.coalesce("text", F.lit("")), PERSONAL, 0)
    edits = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("[PII]").alias("new")))
    return token_counts.recounted(trees.withColumn("edits", edits), path, public_tokenizers.PATTERN).drop("text", "leaves")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes in each order of the five, for each language."""
    return filter_audit.audit(documents(spark, sf_dir, "doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' counts of every document, its log-likelihood ratio and whether it stays."""
    docs = documents(spark, sf_dir)
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's deviation and its whitened principal components."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_media": op6_media,
    "op7_quality": op7_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_quality_rules": op12_quality_rules,
    "op13_whitening": op13_whitening,
}

_OP9 = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""



def _op1() -> str:
    """The base spans by split texts, the entropy of each window by itself."""

    def quoted(s: str) -> str:
        return s.replace("'", "''")

    def spans(kind: int, pattern: str, group: int = 0) -> str:
        p = quoted(pattern)
        return f"SELECT doc_id, t, {kind} AS kind, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d"

    classes = list(secrets.CLASSES.items())
    lists = [spans(0, secrets.ASSIGN, 2), spans(1, secrets.ACCESS), spans(2, secrets.HEX), *(spans(secrets.KINDS.index(k), c[1]) for k, c in classes)]
    hot = []
    for kind, (symbols, _, _, limit) in classes:
        low = "s" if len(symbols) > 22 else "lower(s)"
        needs = "regexp_matches(s, '[A-Fa-f]')" if kind == "entropy_hex" else "regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]')"
        finds = lambda a: " AND ".join([*(f"regexp_matches(s, '{quoted(p)}')" for p in a.every), *(f"NOT regexp_matches(s, '{quoted(p)}')" for p in a.none)])
        allowed = " AND ".join(f"NOT ({finds(a)})" for a in secrets.ALLOWED)
        windows = f"list_filter(range(0, length(s) - {secrets.WINDOW - 1}), lambda i: list_aggregate(string_split(substr({low}, i + 1, {secrets.WINDOW}), ''), 'entropy') >= {limit} - 1e-9)"
        hot.append(f"SELECT doc_id, kind, start, {windows} AS w FROM found WHERE kind = {secrets.KINDS.index(kind)} AND {needs} AND {allowed}")
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    listing = f"string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lists AS ({" UNION ALL ".join(lists)}),
numbered AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM lists),
found AS (
  SELECT doc_id, kind, m[i] AS s, v[i] AS value,
    cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS bigint) AS start
  FROM numbered
),
hot AS ({" UNION ALL ".join(hot)}),
spans AS (
  SELECT doc_id, kind, start, start + length(s) AS stop FROM found WHERE kind = 0 AND length(value) >= {secrets.LEAST_VALUE} OR kind IN (1, 2)
  UNION ALL SELECT doc_id, kind, start + list_min(w), start + list_max(w) + {secrets.WINDOW} FROM hot WHERE len(w) > 0
),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    {listing} FILTER (kind < 3) AS base, {listing} AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""


_OP11 = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
truth AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM d JOIN firsts USING (t) LEFT JOIN truth USING (doc_id)
),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || l FROM o, letters WHERE length(filter_order) < 5 AND NOT contains(filter_order, l)),
s AS (SELECT filter_order, step, filter_order[step] AS l, filter_order[:step - 1] AS before FROM o, unnest(range(1, 6)) AS r(step) WHERE length(filter_order) = 5),
x AS (
  SELECT part, filter_order, step, l, n, good, toxic, contains(fails, l) AS bad, before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone, fails = l AS alone FROM c, s
),
g AS (
  SELECT part, filter_order, cast(step AS integer) AS step, l,
    sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bad AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN bad AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed, cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails,
  cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, l) AS bigint) AS shapley
FROM g
"""

ORACLES: dict[str, str] = {
    "op1_secret_scans": _op1(),
    "op9_exact_dedup": _OP9,
    "op11_filter_audit": _OP11,
}
