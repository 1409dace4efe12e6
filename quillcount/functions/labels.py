"""Names, labels and number formats of a report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def encoding_of(model: str) -> tuple[str, bool]:
    """Encoding by the beginning of a model's name, and whether the name was recognised."""
    name = model.lower()
    for prefixes, encoding in ((("gpt-5", "gpt-4.1", "gpt-4o", "o3", "o4"), "o200k_base"), (("gpt-4", "gpt-3.5", "llama-", "deepseek-", "qwen-", "phi-"), "cl100k_base")):
        if name.startswith(prefixes):
            return encoding, True
    if "davinci" in name or "curie" in name:
        return "p50k_base", True
    return "o200k_base", False


def encoding_column(model: Column) -> Column:
    """encoding_of() as an expression."""
    name = F.lower(model)
    return F.when(name.rlike(r"^(gpt-5|gpt-4\.1|gpt-4o|o3|o4)"), "o200k_base").when(name.rlike(r"^(gpt-4|gpt-3\.5|llama-|deepseek-|qwen-|phi-)"), "cl100k_base").when(name.rlike("davinci|curie"), "p50k_base").otherwise("o200k_base")


def method_name(model: Column) -> Column:
    return F.concat(F.lit("bpe_"), F.replace(model, F.lit("-"), F.lit("_")))


def accuracy(name: Column, is_exact: Column) -> Column:
    return F.when(is_exact, "Exact").when(name == "claude_3_approx", "Estimated").otherwise("Approx")


def thousands(n: int) -> str:
    return f"{n:,}"


def thousands_column(n: Column) -> Column:
    return F.format_number(n, 0)


def window_column(n: Column) -> Column:
    """window_label() as an expression."""
    million = F.when(n % 1_000_000 == 0, F.concat(F.floor(n / 1_000_000).cast("string"), F.lit("M"))).otherwise(F.format_string("%.1fM", n.cast("double") / 1e6))
    return F.when(n >= 1_000_000, million).when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def window_label(n: int) -> str:
    """1M, 1.5M, 128K or the number."""
    if n >= 1_000_000:
        return f"{n // 1_000_000}M" if n % 1_000_000 == 0 else f"{n / 1_000_000:.1f}M"
    return f"{n // 1000}K" if n >= 1000 else str(n)


def context_usage(tokens: int, window: int | None) -> str:
    """Share of a context window, rounded as C's printf does; empty without a window."""
    if not window or window <= 0:
        return ""
    share = tokens / window * 100
    for least, places in ((10, 0), (1, 1), (0.1, 2)):
        if share >= least:
            return f"{share:.{places}f}% of {window_label(window)}"
    return f"<0.1% of {window_label(window)}"


@F.pandas_udf(StringType())
def context_usage_text(tokens: pd.Series, windows: pd.Series) -> pd.Series:
    """context_usage() of columns; in Python, as binary doubles have to be rounded as printf does. One value a report row."""
    return pd.Series([None if pd.isna(t) else context_usage(int(t), None if pd.isna(w) else int(w)) for t, w in zip(tokens, windows, strict=True)])


def context_share(tokens: Column, window: Column) -> Column:
    """Percent of a window, null without one."""
    return F.when(window > 0, tokens.cast("double") / window * 100)


def display_path(path: Column, is_directory: Column) -> Column:
    return F.when(path == "-", "stdin").when(is_directory, F.concat(path, F.lit(" (directory)"))).otherwise(path)


def shortened(path: Column, width: int) -> Column:
    """path with its middle left out where it's longer than width characters."""
    head = (width - 1) // 2
    tail = width - 1 - head
    return F.when(F.length(path) <= width, path).otherwise(F.concat(F.substring(path, 1, head), F.lit("…"), F.substring(path, -tail, tail) if tail else F.lit("")))
