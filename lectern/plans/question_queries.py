"""Queries over what questions and texts say: terms, markers, routes, scalar functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import questions as qs
from lectern.functions import text as tx
from lectern.plans.registry import Registry
from lectern.session import table
from lectern.sources import library

R = Registry()


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.questions(spark, sf_dir)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _listed(terms) -> F.Column:
    return F.array_join(F.array_sort(terms), "|")


# The same conditions in DuckDB's SQL, for the oracles.
def _words(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w).replace("\\ ", " ") for w in sorted(words, key=lambda w: (-len(w), w))).replace("'", "''")


def _in(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_STRUCTURAL = _words(qs.RELATIVE_DATES + qs.STRUCTURAL_WORDS)
_HELD = _words(qs.RELATIVE_DATES + tuple(e for e in qs.EXTENSIONS if len(e) >= 2) + tuple(w for w in qs.STRUCTURAL_WORDS if not w.isascii()))
_SPLIT = r"regexp_split_to_array({}, '[^\p{{L}}\p{{N}}]+')"


def _bounded(e: str) -> str:
    for a, b in (("([a-z0-9])([A-Z])", r"\1 \2"), ("([A-Z])([A-Z][a-z])", r"\1 \2"), (r"(\p{Han})([A-Za-z0-9])", r"\1 \2"), (r"([A-Za-z0-9])(\p{Han})", r"\1 \2")):
        e = f"regexp_replace({e}, '{a}', '{b}', 'g')"
    return e


def _variants(e: str) -> str:
    return f"list_filter(list_transform(list_concat([trim({e}), {_bounded(f'trim({e})')}], regexp_split_to_array({_bounded(f'trim({e})')}, '\\s+')), lambda t: trim(t)), lambda t: t <> '')"


def _evidence(t: str) -> str:
    words = _SPLIT.format(f"lower({t})")
    return f"(length({t}) >= 2 AND NOT regexp_matches(lower({t}), '{_HELD}') AND NOT list_has_any({words}, [{_in(qs.STRUCTURAL_WORDS + qs.EXTENSIONS)}]) AND lower({t}) NOT IN ({_in(qs.CLOSED_WORDS)}))"


def _relevant(e: str) -> str:
    return f"list_filter({_SPLIT.format(f'lower({e})')}, lambda w: length(w) >= 2 AND w NOT IN ({_in(qs.STOP_WORDS)}))"


_STRIPPED = f"regexp_replace(question, '(?i){_STRUCTURAL}', ' ', 'g')"
_CONTENT = f"list_filter(list_distinct(flatten(list_transform({_variants('s')}, lambda v: {_relevant('v')}))), lambda t: {_evidence('t')})"
_CONTENT_FROM = f"(SELECT id, question, {_STRIPPED} AS s FROM questions)"


@R.add("SELECT p_partkey AS id, concat(chr(9), trim(lower(p_name)), chr(9), instr(p_name, 'a')) AS t, length(p_type) AS n FROM part")
def str01_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.chr(F.lit(9)), F.trim(F.lower("p_name")), F.chr(F.lit(9)), F.instr("p_name", "a").cast("string")).alias("t"), F.length("p_type").cast("long").alias("n"))


@R.add("SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents ORDER BY low, doc_id LIMIT 100")
def str03_nocase_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred texts in an order that is blind to ASCII case."""
    return _docs(spark, sf_dir).select("doc_id", qs.nocase(F.col("text")).alias("low")).orderBy("low", "doc_id").limit(100)


@R.add("SELECT id, strip_accents(lower(trim(name))) AS q FROM files", "files")
def str05_normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir).select("id", tx.folded(F.col("name")).alias("q"))


@R.add()
def str06_compatible_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", qs.compatible(F.col("text")).alias("plain"))


@R.add(f"SELECT id, {_bounded('question')} AS bounded FROM questions", "questions")
def str07_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", tx.boundaries(F.col("question")).alias("bounded"))


@R.add(f"SELECT id, array_to_string(list_sort(list_distinct(list_transform({_variants('question')}, lambda t: lower(t)))), '|') AS terms FROM questions", "questions")
def str08_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", _listed(F.transform(qs.variants(F.col("question")), F.lower)).alias("terms"))


@R.add(f"SELECT id, array_to_string(list_sort(list_distinct({_relevant('question')})), '|') AS terms FROM questions", "questions")
def str09_relevance_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", _listed(qs.relevance_terms(F.col("question"))).alias("terms"))


@R.add(f"SELECT id, {_STRIPPED} AS rest FROM questions", "questions")
def str10_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", qs.stripped(F.col("question")).alias("rest"))


@R.add(f"SELECT id, w AS term, {_evidence('w')} AS evidence FROM (SELECT id, unnest(regexp_split_to_array(trim(question), '\\s+')) AS w FROM questions)", "questions")
def str11_evidence_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _asked(spark, sf_dir).select("id", F.explode(F.split(F.trim("question"), "\\s+")).alias("term"))
    return words.withColumn("evidence", qs.evidence_term(F.col("term")))


@R.add(r"SELECT id, (len(list_filter(regexp_split_to_array(trim(question), '\s+'), lambda w: w <> '')) >= 2 OR len(regexp_extract_all(question, '\p{Han}')) >= 4) AND NOT regexp_full_match(question, '[A-Za-z0-9]{2,32}') AS strong FROM questions", "questions")
def str13_strong_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", tx.strong_phrase(F.col("question")).alias("strong"))


@R.add(f"SELECT id, NOT regexp_matches(question, '[?？]') AND len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) BETWEEN 1 AND 2 AS allowed FROM {_CONTENT_FROM}", "questions")
def str14_single_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", qs.single_identifier_allowed(F.col("question")).alias("allowed"))


@R.add()
def str17_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("that"))).select("doc_id", qs.snippet(F.col("text"), "that", 96).alias("snippet"))


@R.add(r"SELECT id, trim(regexp_extract(content_text, '(?s)^((?:.*?[.!?。！？]+(?:\s+|$)){1,3}|.*)', 1)) AS head FROM files", "files")
def str29_first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sentences of every text."""
    return library.files(spark, sf_dir).select("id", tx.first_sentences(F.col("content_text")).alias("head"))


@R.add(r"""SELECT file_id, chunk_idx, CASE WHEN regexp_full_match(text, '(?i)\[Page\s+[0-9]+\]') THEN 'page' WHEN regexp_full_match(text, '#{1,6}\s+.+') THEN 'heading' WHEN trim(text, ' ') = '' THEN 'blank'
  WHEN regexp_matches(text, '[\t|]') THEN 'table' WHEN regexp_matches(text, '^\s*(?:[-*•]|[0-9]+[.)])\s+') THEN 'list' ELSE 'text' END AS kind FROM chunks""", "chunks")
def str32_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.chunks(spark, sf_dir).select("file_id", "chunk_idx", qs.line_kind(F.col("text")).alias("kind"))


@R.add("SELECT event_id AS id, try_cast(json_extract(props || '', '$.k') AS bigint) AS k FROM events")
def str34_repaired_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with something around them and a comma too many, read again."""
    broken = F.concat(F.lit("Answer: "), F.regexp_replace("props", "\\}$", ",}"), F.lit(" done"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.from_json(tx.repaired_json(broken), "k bigint")["k"].alias("k"))


@R.add("SELECT id, regexp_full_match(lower(name), 'doc_.*[.]md|.*[.]txt|doc_1.[.]py') AS fits FROM files", "files")
def str35_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.organize import matches_any

    return library.files(spark, sf_dir).select("id", matches_any(F.col("name"), ("doc_*.md", "*.txt", "doc_1?.py")).alias("fits"))


@R.add(f"SELECT id, array_to_string(list_sort({_CONTENT}), '|') AS terms, regexp_matches(lower(question), '{_words(qs.CONTENT_MARKERS)}') OR len(regexp_extract_all(question, '[\"“”「」]')) >= 2 AS content FROM {_CONTENT_FROM}", "questions")
def str36_content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return _asked(spark, sf_dir).select("id", _listed(qs.content_terms(q)).alias("terms"), qs.asks_for_content(q).alias("content"))


@R.add(f"""SELECT id, array_to_string(list_sort(list_distinct(list_concat({_CONTENT}, list_filter([lower(n), 'budget', 'the', 'notes.md'], lambda t: {_evidence('t')} OR regexp_extract(t, '\\.([a-z0-9]+)$', 1) IN ({_in(qs.EXTENSIONS)}))))), '|') AS terms
  FROM (SELECT q.id, f.name AS n, {_STRIPPED} AS s FROM questions q JOIN files f ON q.id = f.id)""", "questions")
def str37_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question's terms with those of a plan: a file's name, a word of content, one of none."""
    rows = _asked(spark, sf_dir).join(library.files(spark, sf_dir).select("id", "name"), "id")
    more = F.array(F.lower("name"), F.lit("budget"), F.lit("the"), F.lit("notes.md"))
    return rows.select("id", _listed(qs.search_terms(F.col("question"), more)).alias("terms"))


@R.add("SELECT id, CASE WHEN id % 8 = 4 THEN concat('inv-', id, CASE WHEN id % 16 = 4 THEN '' ELSE '' END) ELSE '' END AS terms FROM questions WHERE id % 8 IN (2, 4, 6)", "questions")
def str38_routed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the questions about reports and days, where a date filter has the years."""
    some = _asked(spark, sf_dir).where(F.col("id") % 8 % 2 == 0).where(F.col("id") % 8 > 0)
    return some.select("id", F.array_join(qs.routed_entities(F.col("question"), F.lit(True)), "|").alias("terms"))


@R.add(f"SELECT id, regexp_matches(lower(question), '{_words(qs.RECENCY_MARKERS)}') AS recent FROM questions", "questions")
def str39_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", qs.prefers_recent(F.col("question")).alias("recent"))


@R.add(f"SELECT doc_id, trim(regexp_replace(text, '[\\s]+', ' ', 'g'), ' ') AS flat, regexp_matches(lower(text), '{_words(qs.UNSAFE)}') AS unsafe FROM documents")
def str43_learned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", qs.collapsed(F.col("text")).alias("flat"), qs.unsafe(F.col("text")).alias("unsafe"))


@R.add(r"""SELECT a.doc_id, NOT (len(regexp_extract_all(a.text, '\p{L}')) >= 48 AND len(regexp_extract_all(a.text, '\p{Ll}')) >= 12)
  OR (regexp_replace(lower(a.text), '[^\p{L}\p{N}]', '', 'g') <> regexp_replace(lower(b.text), '[^\p{L}\p{N}]', '', 'g') AND len(regexp_extract_all(b.text, '[\x{4E00}-\x{9FFF}]')) >= 8) AS plausible
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def str44_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the next document could be each one's translation into Chinese."""
    after = _docs(spark, sf_dir).select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after"))
    return _docs(spark, sf_dir).join(after, "doc_id").select("doc_id", qs.plausible_translation(F.col("text"), F.col("after"), "zh").alias("plausible"))


@R.add("SELECT file_id, parent_idx, concat('doc ', file_id, ' > part ', parent_idx) AS path, CASE WHEN page_start IS NULL THEN 'unknown' WHEN chars < 400 THEN cast(page_start AS varchar) ELSE concat(page_start, '-', page_start + 1) END AS pages FROM parents", "parents")
def str46_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.array(F.concat_ws(" ", F.lit("doc"), F.col("file_id").cast("string")), F.concat_ws(" ", F.lit("part"), F.col("parent_idx").cast("string")))
    end = F.when(F.col("chars") < 400, F.col("page_start")).otherwise(F.col("page_start") + 1)
    return library.parents(spark, sf_dir).select("file_id", "parent_idx", qs.path_label(path, F.lit("-")).alias("path"), qs.page_label(F.col("page_start"), end).alias("pages"))


@R.add(f"SELECT id, NOT regexp_matches(regexp_replace(regexp_replace(lower(question), '{_words(qs.RELATIVE_DATES)}', ' ', 'g'), '{_words(qs.DATE_ONLY_WORDS)}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]') AS dates FROM questions", "questions")
def dat04_date_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", qs.date_only(F.col("question")).alias("dates"))


@R.add(r"SELECT doc_id, list_contains(regexp_extract_all(text, '\p{N}+'), '2021') AS held FROM documents")
def dat06_standalone_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", qs.standalone_year(F.col("text"), F.lit(2021)).alias("held"))


@R.add("SELECT event_id AS id, cast(round(100 * least(greatest(value / 100, 0), 1)) AS bigint) AS percent, cast(ceil(value) AS bigint) AS up FROM events")
def mth04_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent = F.round(F.lit(100) * F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), percent.alias("percent"), F.ceil("value").alias("up"))


@R.add("SELECT p_partkey AS id, least(greatest(a, 0), greatest(b, 0)) AS low, greatest(a, b, 0) AS high FROM (SELECT p_partkey, cast(p_size AS bigint) - 10 AS a, p_partkey % 40 - 5 AS b FROM part)")
def mth13_size_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds that neither fall below zero nor stand the wrong way round."""
    a, b = (F.greatest(x, F.lit(0)) for x in (F.col("p_size").cast("long") - 10, F.col("p_partkey") % 40 - 5))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


@R.add("SELECT event_id AS id, event_type AS intent FROM events")
def jsn02_streamed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of objects whose end has not come yet."""
    begun = F.concat(F.lit('{"intent": "'), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, '", "keyw').otherwise(""))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), qs.streamed_field(begun, "intent").alias("intent"))


@R.add("SELECT conv_id AS id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE concat(role, '|', conv_id) END AS items FROM conversations")
def arr01_string_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("turn") % 3 == 0, F.lit("not a list")).otherwise(F.to_json(F.array("role", F.col("conv_id").cast("string"))))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", F.array_join(qs.string_list(told), "|").alias("items"))


@R.add("SELECT id, array_to_string(string_split(path, '/')[2:3], '>') AS head, right(path, 3) AS tail FROM files", "files")
def arr03_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir).select("id", F.array_join(F.slice(F.split("path", "/"), 2, 2), ">").alias("head"), F.right("path", F.lit(3)).alias("tail"))


@R.add("SELECT source_dir, max(CASE WHEN category = 'document' THEN n END) AS documents, max(CASE WHEN category = 'code' THEN n END) AS code FROM (SELECT source_dir, category, count(*) AS n FROM files GROUP BY ALL) GROUP BY source_dir", "files")
def map01_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by category as a map of each source, looked up."""
    counts = library.files(spark, sf_dir).groupBy("source_dir", "category").agg(F.count("*").alias("n"))
    maps = counts.groupBy("source_dir").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("m"))
    return maps.select("source_dir", F.try_element_at("m", F.lit("document")).alias("documents"), F.try_element_at("m", F.lit("code")).alias("code"))


@R.add("SELECT id, cast(CASE WHEN id % 7 = 0 THEN 0.30 WHEN id % 2 = 0 THEN 0.20 WHEN id % 3 = 0 THEN 0.60 ELSE 0.30 END AS double) AS confidence FROM files", "files")
def ret19_structured_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return library.files(spark, sf_dir).select("id", qs.structured_confidence(i % 7 != 0, i % 2 == 0, i % 3 == 0).alias("confidence"))


@R.add(f"""SELECT id, CASE WHEN NOT content AND id % 8 <> 4 THEN 'disabled' WHEN id % 3 > 0 THEN 'scoped' ELSE 'global' END AS route
  FROM (SELECT id, regexp_matches(lower(question), '{_words(qs.CONTENT_MARKERS)}') OR len(regexp_extract_all(question, '[\"“”「」]')) >= 2 AS content FROM questions) WHERE id % 8 IN (1, 2, 4, 6)""", "questions")
def ret22_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the questions that say so look into chunks: those of the candidates, of which some have none, or all."""
    q = F.col("question")
    some = _asked(spark, sf_dir).where((F.col("id") % 8).isin(1, 2, 4, 6))
    entity = F.when(F.col("id") % 8 == 4, tx.entities(q)).otherwise(F.array().cast("array<string>"))
    return some.select("id", qs.chunk_route(qs.asks_for_content(q), entity, F.col("id") % 3, F.lit(True)).alias("route"))
