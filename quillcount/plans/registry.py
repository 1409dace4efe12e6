"""The model registry: a constant table and the look-ups on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Encoding, provider, models by context window.
_GROUPS = (
    ("o200k_base", "openai", {400000: "gpt-5 gpt-5-mini gpt-5-nano gpt-5.1 gpt-5.2", 1047576: "gpt-4.1 gpt-4.1-mini gpt-4.1-nano", 128000: "gpt-4o gpt-4o-mini", 200000: "o3 o3-mini o4-mini"}),
    ("cl100k_base", "openai", {8192: "gpt-4", 128000: "gpt-4-turbo", 16385: "gpt-3.5-turbo"}),
    ("claude_approx", "anthropic", {1000000: "claude-opus-4.6 claude-opus-4.5 claude-sonnet-4.6 claude-sonnet-4.5", 200000: "claude-opus-4.1 claude-opus-4 claude-sonnet-4 claude-haiku-4.5 claude-haiku-3.5 claude-haiku-3 claude-opus-3"}),
    ("gemini_approx", "google", {1000000: "gemini-2.5-pro gemini-2.5-flash gemini-2.5-flash-lite"}),
    ("cl100k_base", "meta", {128000: "llama-3.1-8b llama-3.1-70b llama-3.1-405b", 10000000: "llama-4-scout", 1000000: "llama-4-maverick"}),
    ("cl100k_base", "deepseek", {128000: "deepseek-v2 deepseek-v3 deepseek-coder-v2"}),
    ("cl100k_base", "alibaba", {128000: "qwen-2.5-7b qwen-2.5-14b qwen-2.5-72b qwen-3-72b"}),
    ("cl100k_base", "microsoft", {128000: "phi-3-mini phi-3-small phi-3-medium"}),
)
PROVIDERS = ("openai", "anthropic", "google", "meta", "deepseek", "alibaba", "microsoft", "all")
CLOSED = ("openai", "anthropic", "google")
#: Order of encodings in the look-up table of a report.
ENCODINGS = ("o200k_base", "cl100k_base", "claude_approx", "gemini_approx")

#: (name, provider, encoding, context_window) of every model.
MODELS = tuple((name, provider, encoding, window) for encoding, provider, windows in _GROUPS for window, names in windows.items() for name in names.split())
_BY_NAME = {m[0]: m for m in MODELS}


def models(spark: SparkSession) -> DataFrame:
    """name, provider, encoding, context_window."""
    return spark.createDataFrame(MODELS, "name string, provider string, encoding string, context_window long")


def lookup(name: str) -> tuple[str, str, str, int] | None:
    return _BY_NAME.get(name)


def valid_model(name: str) -> bool:
    return name == "" or name in _BY_NAME


def valid_provider(name: str) -> bool:
    return name in PROVIDERS


def with_models(df: DataFrame, model: str) -> DataFrame:
    """df with provider, encoding and context_window of the models its column names; null where unknown."""
    known = models(df.sparkSession).withColumnRenamed("name", model)
    return df.join(F.broadcast(known), model, "left")  # the registry is a constant of 45 rows


def by_provider(spark: SparkSession, provider: str) -> DataFrame:
    return models(spark).where(F.col("provider") == provider).orderBy("name")


def by_encoding(spark: SparkSession) -> DataFrame:
    """encoding, models: the names of each encoding, sorted and joined."""
    return models(spark).groupBy("encoding").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("models"))


def open_source(provider: Column) -> Column:
    """Whether a known provider publishes its models' weights."""
    return provider.isNotNull() & ~provider.isin(*CLOSED)


def provider_allows(encoding: str, provider: str) -> bool:
    """Whether an all-methods report of a provider shows an encoding; approximations from totals are always shown."""
    if provider in ("", "all"):
        return True
    return any(e == encoding and p == provider for _, p, e, _ in MODELS)


def encoding_providers(spark: SparkSession) -> DataFrame:
    return models(spark).select("encoding", "provider").distinct()
