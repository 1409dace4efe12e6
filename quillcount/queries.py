"""The catalogue: every operator of the library as a query over the tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels, pieces
from .functions import text as T
from .operators import counting, tokenizers
from .operators import invalidation as inv
from .plans import methods, registry
from .sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL of the statistics of a text column t.
_WORDS = r"len(regexp_extract_all({t}, '[^\p{{P}}\p{{Z}}\t-\r\x{{85}}]+'))"
_LINES = "CAST(length({t}) - length(replace({t}, chr(10), '')) + CASE WHEN {t} = '' OR ends_with({t}, chr(10)) THEN 0 ELSE 1 END AS BIGINT)"


def _stats(t: str = "text") -> str:
    return f"CAST(strlen({t}) AS BIGINT) AS characters, CAST({_WORDS.format(t=t)} AS BIGINT) AS words, {_LINES.format(t=t)} AS lines"


def _sums(keys: str, source: str, t: str = "text") -> str:
    group = f" GROUP BY {keys}" if keys else ""
    return f"SELECT {keys + ', ' if keys else ''}COUNT(*) AS file_count, CAST(SUM(characters) AS BIGINT) AS characters, CAST(SUM(words) AS BIGINT) AS words, CAST(SUM(lines) AS BIGINT) AS lines FROM (SELECT *, {_stats(t)} FROM {source}) s{group}"


def _sum_stats(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    return T.with_stats(df.select(*by, text), text).groupBy(*by).agg(F.count("*").alias("file_count"), *(F.sum(c).alias(c) for c in ("characters", "words", "lines")))


def _models_sql() -> str:
    rows = ", ".join(f"('{n}', '{p}', '{e}', {w})" for n, p, e, w in registry.MODELS)
    return f"(VALUES {rows}) AS m(name, provider, encoding, context_window)"


@query(f"SELECT doc_id, {_stats()} FROM documents")
def doc_text_stats(spark, sf_dir):
    return T.with_stats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query(_sums("source", "documents"))
def corpus_stats_by_source(spark, sf_dir):
    return _sum_stats(table(spark, sf_dir, "documents"), ["source"])


@query(_sums("", "documents"))
def corpus_totals(spark, sf_dir):
    return _sum_stats(table(spark, sf_dir, "documents"), [])


@query(_sums("1 AS page_table", "pages", "html").replace(" GROUP BY 1 AS page_table", ""))
def html_page_stats(spark, sf_dir):
    return _sum_stats(table(spark, sf_dir, "pages"), [], "html").select(F.lit(1).alias("page_table"), "*")


@query(_sums("role", "conversations"))
def chat_stats_by_role(spark, sf_dir):
    return _sum_stats(table(spark, sf_dir, "conversations"), ["role"])


@query(_sums("conv_id", "conversations"))
def conversation_totals(spark, sf_dir):
    return _sum_stats(table(spark, sf_dir, "conversations"), ["conv_id"])


@query(f"SELECT item_id, {_stats()} FROM benchmark")
def benchmark_stats(spark, sf_dir):
    return T.with_stats(table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("text")


@query("SELECT doc_id, CAST(trunc(strlen(text) / 3.8::DOUBLE) AS BIGINT) AS claude_tokens, CAST(trunc(strlen(text) / 4.0::DOUBLE) AS BIGINT) AS gemini_tokens FROM documents")
def approx_per_doc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.claude_tokens(F.col("text")).alias("claude_tokens"), T.gemini_tokens(F.col("text")).alias("gemini_tokens"))


def _report_sql(by: str, chars: float = 4.0, words: float = 0.75, planned: tuple[str, ...] = ("claude", "gemini")) -> str:
    rows = {"claude": ("claude_3_approx", "Claude (approx)", "SUM(trunc(characters / 3.8::DOUBLE))"), "gemini": ("gemini_approx", "Gemini (approx)", "SUM(trunc(characters / 4.0::DOUBLE))")}
    chosen = [rows[p] for p in planned]
    chosen += [(f"character_based_div{chars:.0f}", f"Character-based (÷{chars:.1f})", f"trunc(SUM(characters) / {chars}::DOUBLE)"), (f"word_based_mul{100 / words:.0f}", f"Word-based (×{1 / words:.2f})", f"trunc(SUM(words) / {words}::DOUBLE)"), ("whitespace_split", "Whitespace split", "SUM(words)")]
    parts = [f"SELECT {by}, {i} AS ord, '{n}' AS name, '{d}' AS display_name, CAST({e} AS BIGINT) AS tokens FROM s GROUP BY {by}" for i, (n, d, e) in enumerate(chosen)]
    return f"WITH s AS (SELECT {by}, {_stats()} FROM documents) " + " UNION ALL ".join(parts)


def _method_rows(df: DataFrame, by: list[str], plan: methods.Plan) -> DataFrame:
    return counting.method_rows(counting.report(df, plan, by)).select(*by, "ord", "name", "display_name", "tokens")


def _approximations(**options) -> methods.Plan:
    """The all-methods plan without those that need a rank table."""
    plan = methods.plan("", True, methods.Options(**options, vocabularies={e: "/nowhere" for e in methods.REPORTED_BPE}))
    return plan


@query(_report_sql("lang"))
def approx_methods_by_lang(spark, sf_dir):
    return _method_rows(table(spark, sf_dir, "documents"), ["lang"], _approximations())


@query(_report_sql("source", 3.3, 0.6))
def custom_ratio_report(spark, sf_dir):
    return _method_rows(table(spark, sf_dir, "documents"), ["source"], _approximations(chars_per_token=3.3, words_per_token=0.6))


@query(_report_sql("lang", planned=("gemini",)))
def provider_filtered_methods(spark, sf_dir):
    return _method_rows(table(spark, sf_dir, "documents"), ["lang"], _approximations(provider="google"))


@query("SELECT * FROM (VALUES (0, 'claude_3_approx', 'Claude (approx)', false), (1, 'gemini_approx', 'Gemini (approx)', false)) AS p(ord, name, display_name, is_exact)")
def method_plan_all(spark, sf_dir):
    return spark.createDataFrame([(m.ord, m.name, m.display_name, m.is_exact) for m in _approximations().methods], "ord int, name string, display_name string, is_exact boolean")


@query(f"SELECT lang, ord, name, tokens FROM ({_report_sql('lang')}) WHERE ord = 0")
def primary_method(spark, sf_dir):
    rows = counting.method_rows(counting.report(table(spark, sf_dir, "documents"), _approximations(), ["lang"]))
    return counting.primary_method(rows, ["lang"]).select("lang", "ord", "name", "tokens")


@query("WITH s AS (SELECT source, strlen(text) AS c, CASE WHEN doc_id % 97 = 0 THEN NULL ELSE trunc(strlen(text) / 4.0::DOUBLE) END AS g FROM documents) SELECT source, 'claude_3_approx' AS name, CAST(SUM(trunc(c / 3.8::DOUBLE)) AS BIGINT) AS tokens FROM s GROUP BY source UNION ALL SELECT source, 'gemini_approx', CAST(SUM(g) AS BIGINT) FROM s GROUP BY source HAVING COUNT(g) = COUNT(*)")
def method_all_or_nothing(spark, sf_dir):
    """A method that fails on some documents is left out of the groups that hold one."""
    plan = _approximations()
    counts = counting.document_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), plan)
    counts = counts.withColumn("m1", F.when(F.col("doc_id") % 97 != 0, F.col("m1")))
    rows = counting.method_rows(counting.totals(counts, plan, ["source"]))
    return rows.where("ord < 2").select("source", "name", "tokens")


@query(f"SELECT doc_id, COUNT(*) OVER w AS files_done, CAST(SUM(characters) OVER w AS BIGINT) AS running_characters, CAST(SUM(words) OVER w AS BIGINT) AS running_words, CAST(SUM(lines) OVER w AS BIGINT) AS running_lines FROM (SELECT doc_id, {_stats()} FROM documents) WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)")
def running_progress(spark, sf_dir):
    counts = T.with_stats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return counting.running_totals(counts, "doc_id", ["characters", "words", "lines"]).select("doc_id", "files_done", "running_characters", "running_words", "running_lines")


@query(f"SELECT d.doc_id, m.name AS model, m.context_window, CAST(trunc(strlen(d.text) / 3.8::DOUBLE) AS BIGINT) AS tokens, trunc(strlen(d.text) / 3.8::DOUBLE) / m.context_window * 100 AS context_pct FROM documents d JOIN {_models_sql()} ON m.encoding = 'claude_approx'")
def context_usage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.claude_tokens(F.col("text")).alias("tokens"))
    known = registry.models(spark).where("encoding = 'claude_approx'").select(F.col("name").alias("model"), "context_window")
    return counting.with_context(docs.join(F.broadcast(known), how="cross")).select("doc_id", "model", "context_window", "tokens", "context_pct")  # eleven rows of a constant


@query(f"SELECT encoding, string_agg(name, ', ' ORDER BY name) AS models FROM {_models_sql()} GROUP BY encoding")
def models_by_encoding(spark, sf_dir):
    return registry.by_encoding(spark)


@query(f"SELECT provider, COUNT(*) AS n, string_agg(name, ', ' ORDER BY name) AS models FROM {_models_sql()} GROUP BY provider")
def models_by_provider(spark, sf_dir):
    return registry.models(spark).groupBy("provider").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("models"))


@query(f"SELECT name, provider, encoding, context_window FROM {_models_sql()} WHERE provider NOT IN ('openai', 'anthropic', 'google')")
def open_source_models(spark, sf_dir):
    return registry.models(spark).where(registry.open_source(F.col("provider"))).orderBy("name")


@query(f"SELECT r.asked, m.provider, m.encoding, m.context_window FROM (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN 'gpt-5' WHEN 1 THEN 'phi-3-mini' ELSE 'Gpt-5' END AS asked FROM documents) r LEFT JOIN {_models_sql()} ON m.name = r.asked")
def model_lookup(spark, sf_dir):
    asked = F.when(F.col("doc_id") % 3 == 0, "gpt-5").when(F.col("doc_id") % 3 == 1, "phi-3-mini").otherwise("Gpt-5")
    return registry.with_models(table(spark, sf_dir, "documents").select(asked.alias("asked")).distinct(), "asked")


@query(f"SELECT name, 'bpe_' || replace(name, '-', '_') AS method, CASE WHEN regexp_matches(lower(name), '^(gpt-5|gpt-4\\.1|gpt-4o|o3|o4)') THEN 'o200k_base' WHEN regexp_matches(lower(name), '^(gpt-4|gpt-3\\.5|llama-|deepseek-|qwen-|phi-)') THEN 'cl100k_base' ELSE 'o200k_base' END AS guessed FROM {_models_sql()}")
def model_names(spark, sf_dir):
    return registry.models(spark).select("name", labels.method_name(F.col("name")).alias("method"), labels.encoding_column(F.col("name")).alias("guessed"))


@query(f"SELECT lang, name, CASE WHEN name = 'bpe_r50k_base' THEN 'Exact' WHEN name = 'claude_3_approx' THEN 'Estimated' ELSE 'Approx' END AS accuracy FROM ({_report_sql('lang')})")
def accuracy_labels(spark, sf_dir):
    rows = counting.method_rows(counting.report(table(spark, sf_dir, "documents"), _approximations(), ["lang"]))
    return rows.select("lang", "name", labels.accuracy(F.col("name"), F.col("is_exact")).alias("accuracy"))


@query("SELECT doc_id, format('{:,}', (doc_id - 400) * n_chars * 131) AS formatted FROM documents")
def thousands_separators(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", labels.thousands_column((F.col("doc_id") - 400) * F.col("n_chars") * 131).alias("formatted"))


_WINDOW_SQL = "CASE WHEN {w} >= 1000000 THEN CASE WHEN {w} % 1000000 = 0 THEN ({w} // 1000000) || 'M' ELSE printf('%.1fM', {w} / 1000000.0::DOUBLE) END WHEN {w} >= 1000 THEN ({w} // 1000) || 'K' ELSE {w}::VARCHAR END"


@query(f"SELECT name, {_WINDOW_SQL.format(w='context_window')} AS label FROM {_models_sql()}")
def window_labels(spark, sf_dir):
    return registry.models(spark).select("name", labels.window_column(F.col("context_window")).alias("label"))


@query(f"SELECT doc_id, {_WINDOW_SQL.format(w='w')} AS label FROM (SELECT doc_id, n_chars * (doc_id % 1000) AS w FROM documents) WHERE w % 100000 != 50000")
def number_labels(spark, sf_dir):
    """Labels of numbers of all sizes; ties of the rounded decimal, which no window has, are left to binary doubles."""
    w = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * (F.col("doc_id") % 1000)).alias("w")).where("w % 100000 != 50000")
    return w.select("doc_id", labels.window_column(F.col("w")).alias("label"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'stdin' WHEN 1 THEN url || ' (directory)' ELSE url END AS shown FROM pages")
def display_paths(spark, sf_dir):
    path = F.when(F.col("page_id") % 3 == 0, "-").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", labels.display_path(path, F.col("page_id") % 3 == 1).alias("shown"))


@query("SELECT page_id, CASE WHEN length(url) <= 21 THEN url ELSE left(url, 10) || '…' || right(url, 10) END AS middle, CASE WHEN length(url) <= 16 THEN url ELSE left(url, 7) || '…' || right(url, 8) END AS uneven FROM pages")
def shortened_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", labels.shortened(F.col("url"), 21).alias("middle"), labels.shortened(F.col("url"), 16).alias("uneven"))


@query(f"SELECT d.doc_id, c.chars // 4 AS tokens, CASE WHEN share >= 10 THEN printf('%.0f', share) WHEN share >= 1 THEN printf('%.1f', share) WHEN share >= 0.1 THEN printf('%.2f', share) ELSE '<0.1' END || '% of 200K' AS usage FROM documents d JOIN (SELECT doc_id, strlen(text) AS chars, (strlen(text) // 4) / 200000::DOUBLE * 100 AS share FROM documents) c USING (doc_id)")
def usage_texts(spark, sf_dir):
    """The share of a window as a report prints it."""
    tokens = T.characters(F.col("text")) / 4
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(tokens).alias("tokens")).select("doc_id", "tokens", labels.context_usage_text("tokens", F.lit(200_000)).alias("usage"))


_PATH_SQL = "CASE page_id % 4 WHEN 0 THEN 'img/' || page_id || '.PNG' WHEN 1 THEN 'a.b/' || page_id WHEN 2 THEN 'src/.tiktoken' ELSE 'doc/' || page_id || '.html' END"


def _paths() -> Column:
    i = F.col("page_id").cast("string")
    return F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("img/"), i, F.lit(".PNG"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("a.b/"), i)).when(F.col("page_id") % 4 == 2, "src/.tiktoken").otherwise(F.concat(F.lit("doc/"), i, F.lit(".html")))


@query(f"SELECT page_id, path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ({', '.join(repr(e) for e in sorted(files.BINARY_EXTENSIONS))}) OR (page_id % 5 = 0 AND page_id % 10 = 0) AS is_binary FROM (SELECT page_id, {_PATH_SQL} AS path FROM pages)")
def binary_filter(spark, sf_dir):
    """Of every fifth page a NUL is put at byte 3, or, of every second of these, at byte 513, where it isn't seen."""
    raw = F.rpad(F.lit("x"), 600, "x")
    nul = F.when(F.col("page_id") % 10 == 0, F.concat(F.substring(raw, 1, 2), F.lit("\0"), raw)).when(F.col("page_id") % 5 == 0, F.concat(F.substring(raw, 1, 512), F.lit("\0"))).otherwise(F.col("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", _paths().alias("path"), nul.cast("binary").alias("content"))
    return pages.select("page_id", "path", files.binary(F.col("path"), F.col("content")).alias("is_binary"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.digest(F.col("text").cast("binary")).alias("digest"))


# Snapshots made of documents: the stored one lacks every 11th, the current one every 13th; some fields differ.
_OLD = "SELECT 'd' || doc_id AS path, strlen(text) AS size, doc_id * 10 AS mtime_ns, sha256(text) AS digest, 'text' AS classification, doc_id, text FROM documents WHERE doc_id % 11 != 0"
_NEW = "SELECT 'd' || doc_id AS path, strlen(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, doc_id * 10 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mtime_ns, CASE WHEN doc_id % 3 = 0 THEN 'changed' ELSE sha256(text) END AS digest, CASE WHEN doc_id % 17 = 0 THEN 'binary' ELSE 'text' END AS classification, doc_id FROM documents WHERE doc_id % 13 != 0"


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored: the claude method everywhere, gemini for documents with an even id."""
    docs = T.with_stats(table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id % 11 != 0"))
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    have = F.filter(F.array(pair("claude", T.claude_tokens(F.col("text"))), F.when(F.col("doc_id") % 2 == 0, pair("gemini", T.gemini_tokens(F.col("text"))))), lambda p: p.isNotNull())
    return docs.select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("characters").alias("size"), (F.col("doc_id") * 10).alias("mtime_ns"), T.digest(F.col("text").cast("binary")).alias("digest"), F.lit("text").alias("classification"), "characters", "words", "lines", F.map_from_entries(have).alias("methods"))


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id % 13 != 0")
    i = F.col("doc_id")
    return docs.select(F.concat(F.lit("d"), "doc_id").alias("path"), (T.characters(F.col("text")) + F.when(i % 7 == 0, 1).otherwise(0)).alias("size"), (i * 10 + F.when(i % 5 == 0, 1).otherwise(0)).alias("mtime_ns"), F.when(i % 3 == 0, "changed").otherwise(T.digest(F.col("text").cast("binary"))).alias("digest"), F.when(i % 17 == 0, "binary").otherwise("text").alias("classification"))


def _decisions_sql(mode: str) -> str:
    verified = "WHEN n.digest != o.digest THEN 'miss,content_changed' " if mode == inv.VERIFIED else ""
    hit = "verified_match" if mode == inv.VERIFIED else "metadata_assumed"
    case = f"CASE WHEN n.path IS NULL THEN 'stale,stale_entry' WHEN o.path IS NULL THEN 'miss,entry_missing' WHEN n.classification != o.classification THEN 'miss,classification_changed' WHEN n.size != o.size THEN 'miss,size_changed' WHEN n.mtime_ns != o.mtime_ns THEN 'miss,modtime_changed' {verified}WHEN o.doc_id % 2 = 0 THEN 'hit,{hit}' ELSE 'partial_hit,contract_missing' END"
    return f"SELECT path, split_part(d, ',', 1) AS kind, split_part(d, ',', 2) AS reason, CASE split_part(d, ',', 1) WHEN 'hit' THEN 'claude,gemini' WHEN 'partial_hit' THEN 'claude' ELSE '' END AS reusable, CASE split_part(d, ',', 1) WHEN 'miss' THEN 'claude,gemini' WHEN 'partial_hit' THEN 'gemini' ELSE '' END AS missing FROM (SELECT COALESCE(n.path, o.path) AS path, {case} AS d FROM ({_NEW}) n FULL JOIN ({_OLD}) o ON n.path = o.path)"


def _decided(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return inv.plan(_new(spark, sf_dir), _old(spark, sf_dir), ["gemini", "claude"], mode)


def _flat(decisions: DataFrame) -> DataFrame:
    return decisions.select("path", "kind", "reason", F.array_join("reusable", ",").alias("reusable"), F.array_join("missing", ",").alias("missing"))


@query(_decisions_sql(inv.METADATA))
def invalidation_plan_metadata(spark, sf_dir):
    return _flat(_decided(spark, sf_dir, inv.METADATA))


@query(_decisions_sql(inv.VERIFIED))
def invalidation_plan_verified(spark, sf_dir):
    return _flat(_decided(spark, sf_dir, inv.VERIFIED))


@query("SELECT 'd' || doc_id AS path, 'miss' AS kind, 'schema_mismatch' AS reason FROM documents WHERE doc_id % 13 != 0")
def invalidation_plan_cold(spark, sf_dir):
    return inv.plan(_new(spark, sf_dir), None, ["claude"], inv.METADATA).select("path", "kind", "reason")


@query(f"WITH d AS ({_decisions_sql(inv.VERIFIED)}) SELECT COUNT(*) FILTER (kind = 'hit') AS hits, COUNT(*) FILTER (kind = 'partial_hit') AS partial_hits, COUNT(*) FILTER (kind IN ('miss', 'partial_hit')) AS misses, COUNT(*) FILTER (kind = 'stale') AS stale, COUNT(*) FILTER (reason NOT IN ('entry_missing', 'stale_entry', 'verified_match')) AS incompatibilities, (SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT reason || '=' || COUNT(*) AS r FROM d WHERE kind != 'stale' GROUP BY reason)) AS reasons FROM d")
def invalidation_summary(spark, sf_dir):
    return inv.summary(_decided(spark, sf_dir, inv.VERIFIED))


_METHODS_SQL = "'claude=' || CAST(trunc(strlen(text) / 3.8::DOUBLE) AS BIGINT)"


def _listed(entries: DataFrame) -> DataFrame:
    pairs = F.transform(F.array_sort(F.map_entries("methods")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return entries.select("path", "size", "mtime_ns", "classification", F.array_join(pairs, ",").alias("methods"))


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates to every third document, with another size for every ninth; one method, other."""
    docs = T.with_stats(table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id % 3 = 0"))
    i = F.col("doc_id")
    return docs.select(F.concat(F.lit("d"), "doc_id").alias("path"), (F.col("characters") + F.when(i % 9 == 0, 5).otherwise(0)).alias("size"), (i * 10).alias("mtime_ns"), T.digest(F.col("text").cast("binary")).alias("digest"), F.lit("text").alias("classification"), "characters", "words", "lines", F.create_map(F.lit("other"), i).alias("methods"))


_OLD_METHODS = f"{_METHODS_SQL} || CASE WHEN doc_id % 2 = 0 THEN ',gemini=' || CAST(trunc(strlen(text) / 4.0::DOUBLE) AS BIGINT) ELSE '' END"


@query(f"SELECT 'd' || doc_id AS path, CAST(strlen(text) + CASE WHEN doc_id % 9 = 0 THEN 5 ELSE 0 END AS BIGINT) AS size, doc_id * 10 AS mtime_ns, 'text' AS classification, CASE WHEN doc_id % 3 != 0 THEN {_OLD_METHODS} WHEN doc_id % 9 = 0 OR doc_id % 11 = 0 THEN 'other=' || doc_id ELSE {_OLD_METHODS} || ',other=' || doc_id END AS methods FROM documents WHERE doc_id % 11 != 0 OR doc_id % 3 = 0")
def cache_merge(spark, sf_dir):
    return _listed(inv.merge(_old(spark, sf_dir), _updates(spark, sf_dir)))


@query("SELECT 'd' || doc_id AS path FROM documents WHERE doc_id % 3 = 0 AND (doc_id % 11 = 0 OR doc_id % 9 != 0)")
def compatible_updates(spark, sf_dir):
    return inv.compatible_updates(_old(spark, sf_dir), _updates(spark, sf_dir)).select("path")


@query("SELECT 'd' || doc_id AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE doc_id % 11 != 0 AND doc_id % 13 != 0")
def cache_prune(spark, sf_dir):
    return inv.prune(_old(spark, sf_dir), _new(spark, sf_dir), True).select("path", "size")


@query("WITH s AS (SELECT strlen(text) AS c FROM documents WHERE doc_id % 13 != 0) SELECT 'claude' AS contract, COUNT(*) AS files, CAST(SUM(trunc(c / 3.8::DOUBLE)) AS BIGINT) AS tokens FROM s UNION ALL SELECT 'gemini', COUNT(*), CAST(SUM(trunc(c / 4.0::DOUBLE)) AS BIGINT) FROM s")
def cached_equals_cold(spark, sf_dir):
    """Totals from stored and fresh counts together; the SQL counts all anew."""
    old = _old(spark, sf_dir)
    docs = T.with_stats(table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id % 13 != 0"))
    current = docs.select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("characters").alias("size"), (F.col("doc_id") * 10).alias("mtime_ns"), T.digest(F.col("text").cast("binary")).alias("digest"), F.lit("text").alias("classification"), "characters", "words", "lines", "text")
    decisions = inv.plan(current, old, ["claude", "gemini"], inv.VERIFIED)
    todo = decisions.where("kind in ('miss', 'partial_hit')").select("path", "missing")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    made = F.filter(F.array(pair("claude", T.claude_tokens(F.col("text"))), pair("gemini", T.gemini_tokens(F.col("text")))), lambda p: F.array_contains("missing", p["key"]))
    fresh = current.join(todo, "path").withColumn("methods", F.map_from_entries(made)).select("path", *inv.ENTRY)
    return inv.contract_totals(inv.materialise(decisions, old, fresh))


# The pattern without its look-ahead: a mark before the last white-space character that a word follows does the same.
_MARKED = r"regexp_replace(text, '([\t-\r\x{85}\p{Z}])([\t-\r\x{85}\p{Z}][^\t-\r\x{85}\p{Z}])', '\1' || chr(1) || '\2', 'g')"
_PIECES = rf"regexp_extract_all({_MARKED}, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^\t-\r\x{{85}}\p{{Z}}\p{{L}}\p{{N}}\x01]+|[\t-\r\x{{85}}\p{{Z}}]+')"


@query(f"SELECT doc_id, CAST(len({_PIECES}) AS BIGINT) AS n_pieces FROM documents")
def pretoken_counts_r50k(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pieces.piece_count(F.col("text")).alias("n_pieces"))


# In these two a run of white space that ends in a line end is one piece, so no mark stands before that.
_MARKED_LINES = r"regexp_replace(text, '([\t-\r\x{85}\p{Z}])([\t\x0B\x0C\x{85}\p{Z}][^\t-\r\x{85}\p{Z}])', '\1' || chr(1) || '\2', 'g')"
_SUFFIXES = "(?i:''s|''t|''re|''ve|''m|''ll|''d)"
_REST = r"\p{N}{1,3}| ?[^\t-\r\x{85}\p{Z}\p{L}\p{N}\x01]+[%s]*|[\t-\r\x{85}\p{Z}]*[\r\n]+|[\t-\r\x{85}\p{Z}]+"
_UPPER, _LOWER = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]", r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]"
_LEAD = r"[^\r\n\p{L}\p{N}\x01]?"
_CL100K = rf"{_SUFFIXES}|{_LEAD}\p{{L}}+|{_REST % r'\r\n'}"
_O200K = rf"{_LEAD}{_UPPER}*{_LOWER}+{_SUFFIXES}?|{_LEAD}{_UPPER}+{_LOWER}*{_SUFFIXES}?|{_REST % r'\r\n/'}"


def _pieces_sql(pattern: str) -> str:
    return f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n_pieces, md5(array_to_string(p, chr(2))) AS pieces_md5 FROM (SELECT doc_id, regexp_extract_all({_MARKED_LINES}, '{pattern}') AS p FROM documents)"


def _pieces_of(spark: SparkSession, sf_dir: str, encoding: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", pieces.pieces(F.col("text"), encoding).alias("p"))
    return docs.select("doc_id", F.size("p").cast("long").alias("n_pieces"), F.md5(F.array_join("p", "\2").cast("binary")).alias("pieces_md5"))


@query(_pieces_sql(_CL100K))
def pretokens_cl100k(spark, sf_dir):
    return _pieces_of(spark, sf_dir, "cl100k_base")


@query(_pieces_sql(_O200K))
def pretokens_o200k(spark, sf_dir):
    return _pieces_of(spark, sf_dir, "o200k_base")


@query(f"SELECT doc_id, CAST(len({_PIECES}) AS BIGINT) AS n_pieces FROM documents")
def pretoken_counts_p50k(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pieces.piece_count(F.col("text"), "p50k_base").alias("n_pieces"))


@query(f"SELECT piece, COUNT(*) AS n FROM (SELECT unnest({_PIECES}) AS piece FROM documents) GROUP BY piece ORDER BY n DESC, piece LIMIT 50")
def top_pieces(spark, sf_dir):
    """The 50 most frequent pieces; the report is a top list."""
    return tokenizers.piece_frequencies(table(spark, sf_dir, "documents").select("text")).orderBy(F.desc("n"), "piece").limit(50)


def _r50k() -> str:
    path = tokenizers.vocabulary_path("r50k_base")
    if path is None:
        raise methods.VocabularyUnavailable("r50k_base")
    return path


# Merges as a recursion over distinct pieces: each step joins the adjacent pair of the lowest rank, of equal ones the
# first. Parts are hex strings. A piece that is a token itself is one.
_MERGED = rf"""WITH RECURSIVE ranks AS MATERIALIZED (
  SELECT hex(from_base64(split_part(line, ' ', 1))) AS token, CAST(split_part(line, ' ', 2) AS BIGINT) AS rank FROM read_csv('{tokenizers.FOLDER}/{tokenizers.FILES["r50k_base"]}', columns = {{'line': 'VARCHAR'}}, delim = '\t', quote = '', escape = '', header = false)
), said AS (
  SELECT doc_id, lang, unnest({_PIECES}) AS piece FROM documents
), counts AS (
  SELECT doc_id, lang, piece, COUNT(*) AS n FROM said GROUP BY ALL
), distinct_pieces AS (
  SELECT DISTINCT piece, hex(encode(piece)) AS h FROM counts
), steps AS (
  SELECT piece, list_transform(range(1, CAST(length(h) AS BIGINT), 2), lambda i: h[i:i + 1]) AS parts FROM distinct_pieces WHERE h NOT IN (SELECT token FROM ranks)
  UNION ALL
  SELECT piece, parts[:k - 1] || [parts[k] || parts[k + 1]] || parts[k + 2:] FROM (
    SELECT p.piece, any_value(p.parts) AS parts, arg_min(p.k, r.rank * 1000000 + p.k) AS k FROM (SELECT piece, parts, unnest(range(1, len(parts))) AS k FROM steps) p JOIN ranks r ON r.token = p.parts[p.k] || p.parts[p.k + 1] GROUP BY p.piece
  )
), sized AS (
  SELECT piece, MIN(len(parts)) AS n_tokens FROM steps GROUP BY piece
), per_doc AS (
  SELECT doc_id, lang, CAST(SUM(n * coalesce(n_tokens, 1)) AS BIGINT) AS tokens FROM counts LEFT JOIN sized USING (piece) GROUP BY doc_id, lang
)"""
_TOKENS = f"{_MERGED} SELECT d.doc_id, coalesce(tokens, 0) AS tokens FROM documents d LEFT JOIN per_doc USING (doc_id)"


@query(_TOKENS)
def bpe_tokens_50k(spark, sf_dir):
    count = tokenizers.bpe_count("r50k_base", _r50k())
    return table(spark, sf_dir, "documents").select("doc_id", count("text").alias("tokens"))


@query(_TOKENS)
def bpe_tokens_relational(spark, sf_dir):
    return tokenizers.relational_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", _r50k())


@query(_TOKENS.replace("coalesce(tokens, 0) AS tokens", "coalesce(tokens, 0) + 2 AS tokens"))
def bpe_special_tokens(spark, sf_dir):
    """Ids of texts between two special tokens, which are allowed and so one token each."""
    encode = tokenizers.bpe_encode("r50k_base", _r50k(), allowed="all")
    end = F.lit("<|endoftext|>")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(encode(F.concat(end, "text", end))).cast("long").alias("tokens"))


@query()
def spm_tokens_32k(spark, sf_dir):
    count = tokenizers.spm_count(f"{tokenizers.FOLDER}/piece_bpe_32k.model")
    return table(spark, sf_dir, "documents").select("doc_id", count("text").alias("tokens"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def encode_decode_roundtrip(spark, sf_dir):
    ids = tokenizers.bpe_encode("r50k_base", _r50k())
    decoded = tokenizers.bpe_decode("r50k_base", _r50k())
    docs = table(spark, sf_dir, "documents").select("doc_id", ids("text").alias("ids"))
    return docs.select("doc_id", T.digest(decoded("ids")).alias("digest"))


@query(f"{_MERGED} SELECT lang, 'bpe_r50k_base' AS name, CAST(SUM(tokens) AS BIGINT) AS tokens, true AS is_exact FROM per_doc GROUP BY lang")
def bpe_report_by_lang(spark, sf_dir):
    """The report of one encoding, by language."""
    plan = methods.plan("r50k_base")
    return counting.method_rows(counting.report(table(spark, sf_dir, "documents"), plan, ["lang"])).select("lang", "name", "tokens", "is_exact")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def concatenated_conversations(spark, sf_dir):
    return counting.concatenated(table(spark, sf_dir, "conversations"), "turn", by=["conv_id"])


@query("SELECT quantile_disc(strlen(text), 0.5) AS median, quantile_disc(strlen(text), 0.95) AS p95 FROM documents")
def size_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(T.characters(F.col("text")).alias("c")).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY c)").cast("long").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY c)").cast("long").alias("p95"))


@query("SELECT source, lang, COUNT(*) AS file_count, CAST(SUM(strlen(text)) AS BIGINT) AS characters FROM documents GROUP BY ROLLUP (source, lang)")
def subtotals(spark, sf_dir):
    """An extension: totals by source and language with their subtotals."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", T.characters(F.col("text")).alias("characters"))
    return docs.rollup("source", "lang").agg(F.count("*").alias("file_count"), F.sum("characters").alias("characters"))
