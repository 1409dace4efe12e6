import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillcount.operators import counting, sinks, tokenizers
from quillcount.plans import methods, registry

NO_TABLES = {e: "/nowhere" for e in methods.REPORTED_BPE}
PLAN = methods.plan("", True, methods.Options(vocabularies=NO_TABLES))
needs_ranks = pytest.mark.skipif(tokenizers.vocabulary_path("r50k_base") is None, reason="no rank table")


def one(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_registry(spark):
    assert len(registry.MODELS) == 45 and registry.models(spark).count() == 45
    per = {r.encoding: len(r.models.split(", ")) for r in registry.by_encoding(spark).collect()}
    assert per == {"o200k_base": 13, "cl100k_base": 18, "claude_approx": 11, "gemini_approx": 3}
    assert [r.name for r in registry.by_provider(spark, "google").collect()] == ["gemini-2.5-flash", "gemini-2.5-flash-lite", "gemini-2.5-pro"]
    assert registry.valid_model("") and not registry.valid_model("GPT-5") and not registry.valid_provider("")
    assert [registry.provider_allows("cl100k_base", p) for p in ("openai", "meta", "google", "all", "")] == [True, True, False, True, True]


def test_plans(tmp_path):
    assert [m.name for m in PLAN.methods] == ["claude_3_approx", "gemini_approx"] and PLAN.approximations
    unknown = methods.plan("no-such-model")
    assert unknown.methods == () and unknown.approximations
    claude = methods.plan("claude-opus-4").methods[0]
    assert (claude.name, claude.display_name, claude.is_exact, claude.context_window) == ("bpe_claude_opus_4", "claude_approx (claude-opus-4)", False, 200000)
    with pytest.raises(methods.VocabularyUnavailable):
        methods.plan("gpt-5", options=methods.Options(vocabularies=NO_TABLES))
    with pytest.raises(ValueError):
        methods.plan(options=methods.Options(chars_per_token=-1))
    with pytest.raises(FileNotFoundError):
        methods.plan("spm", options=methods.Options(vocab_file=str(tmp_path / "none")))
    only = methods.plan("", True, methods.Options(provider="google", vocabularies=NO_TABLES))
    assert [m.name for m in only.methods] == ["gemini_approx"]
    assert all(m.contract.valid() for m in PLAN.methods)


def test_single_text_report(spark):
    row = counting.report(one(spark, "The quick brown fox jumps over the lazy dog."), PLAN).first()
    assert (row.characters, row.words, row.lines, len(row.methods)) == (44, 9, 1, 5)
    assert [(m["name"], m["tokens"]) for m in row.methods] == [("claude_3_approx", 11), ("gemini_approx", 11), ("character_based_div4", 11), ("word_based_mul133", 12), ("whitespace_split", 9)]


def test_truncation_before_and_after_the_sum(spark):
    row = counting.report(one(spark, "abc", "abc", "abc", "abc"), PLAN).first()
    by = {m["name"]: m["tokens"] for m in row.methods}
    assert by["gemini_approx"] == 0 and by["character_based_div4"] == 3


def test_empty_table(spark):
    row = counting.report(one(spark).limit(0), PLAN).first()
    assert (row.file_count, row.characters) == (0, 0) and {m["tokens"] for m in row.methods} == {0}


def test_method_that_fails(spark):
    counts = counting.document_counts(one(spark, "abcd", "abcdefgh"), PLAN).withColumn("m0", F.when(F.col("characters") > 4, F.col("m0")))
    row = counting.totals(counts, PLAN).first()
    assert [m["name"] for m in row.methods][:2] == ["gemini_approx", "character_based_div4"]
    with pytest.raises(PySparkException):
        counting.totals(counts, PLAN, skip_errors=False).collect()


def test_directory_is_the_sum_of_its_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = counting.report(docs, PLAN).first()
    per = counting.document_counts(docs.select("doc_id", "text"), PLAN)
    assert per.agg(F.sum("m0"), F.sum("words"), F.count("*")).first() == (whole.methods[0]["tokens"], whole.words, whole.file_count)


def test_sinks(spark):
    row = counting.report(one(spark, "The quick brown fox jumps over the lazy dog."), PLAN).first()
    d = sinks.as_dict(row, "x", False)
    assert [*d] == ["file_path", "file_size", "characters", "words", "lines", "methods"] and "context_window" not in d["methods"][0]
    assert sinks.tokens_only(row) == "11"
    table = sinks.as_table(row, "-", False, show_models=True)
    assert "Token Count Report for: stdin" in table and "Estimated" in table and "claude_approx: claude-haiku-3," in table
    with pytest.raises(ValueError):
        sinks.tokens_only({"methods": []})


@needs_ranks
def test_bpe(spark):
    path = tokenizers.vocabulary_path("r50k_base")
    df = one(spark, "hello world", "", None, "<|endoftext|>", "x" * 4096)
    ids = [r[0] for r in df.select(tokenizers.bpe_encode("r50k_base", path)("text")).collect()]
    assert ids[0] == [31373, 995] and ids[1] == [] and ids[2] is None and len(ids[3]) > 1
    allowed = df.select(tokenizers.bpe_encode("r50k_base", path, allowed="all")("text")).collect()
    assert allowed[3][0] == [50256]
    with pytest.raises(PySparkException):
        df.select(tokenizers.bpe_encode("r50k_base", path, disallowed="all")("text")).collect()
    assert [r[0] for r in df.select(tokenizers.bpe_count("r50k_base", path)("text")).collect()] == [2, 0, None, len(ids[3]), len(ids[4])]
    listed = spark.createDataFrame([([31373, 995, 10**8, 50256],), (None,)], "ids array<int>")
    assert [r[0] and bytes(r[0]) for r in listed.select(tokenizers.bpe_decode("r50k_base", path)("ids")).collect()] == [b"hello world<|endoftext|>", None]
    assert tokenizers.vocabulary(spark, path).count() == 50256


@needs_ranks
def test_bpe_against_the_library_and_the_relational_form(spark):
    path = tokenizers.vocabulary_path("r50k_base")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    enc = tokenizers.encoder("r50k_base", path)
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n for r in docs.select("doc_id", tokenizers.bpe_count("r50k_base", path)("text").alias("n")).collect()} == want
    assert {r.doc_id: r.tokens for r in tokenizers.relational_counts(docs, "doc_id", path).collect()} == want


@needs_ranks
def test_spm(spark):
    path = f"{tokenizers.FOLDER}/piece_bpe_32k.model"
    texts = ["hello world", "", None, "日本"]
    got = [r[0] for r in one(spark, *texts).select(tokenizers.spm_count(path)("text")).collect()]
    assert got == [None if t is None else len(tokenizers.processor(path).encode(t)) for t in texts]
    plan = methods.plan("", True, methods.Options(vocab_file=path, vocabularies=NO_TABLES))
    assert [m.name for m in plan.methods] == ["claude_3_approx", "gemini_approx", "spm"]


def test_stream_equals_batch(spark, tmp_path):
    from quillcount.streaming.progress import stream_totals

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    stream_totals(stream, PLAN, seen.append, str(tmp_path / "checkpoint")).awaitTermination(120)
    whole = counting.report(docs, PLAN).first()
    assert len(seen) == 3 and [s.files_done for s in seen] == sorted(s.files_done for s in seen)
    assert (seen[-1].files_done, seen[-1].words, seen[-1].tokens["gemini_approx"]) == (whole.file_count, whole.words, whole.methods[1]["tokens"])


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from quillcount.streaming.progress import stream_totals

    folder, seen = str(tmp_path / "in"), []
    for text in ("one document here", "a second one"):
        spark.createDataFrame([(text,)], "text string").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("text string").parquet(folder)
        stream_totals(stream, PLAN, seen.append, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert [(s.files_done, s.words) for s in seen] == [(1, 3), (2, 6)]
