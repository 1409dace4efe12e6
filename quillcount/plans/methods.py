"""Which counting methods a report has: resolved once on the driver, then part of the query as literals."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tokenizers
from . import registry

#: Encodings that an all-methods report tries.
REPORTED_BPE = ("o200k_base", "cl100k_base")


class VocabularyUnavailable(LookupError):
    """An encoding's rank table isn't there."""


@dataclass(frozen=True)
class Contract:
    """What a stored count depends on. Ratios aren't part of it: they apply to totals."""

    method: str
    encoding: str
    implementation: str
    vocabulary_digest: str
    normalization_policy: str
    special_token_policy: str

    def valid(self) -> bool:
        return all((self.method, self.encoding, self.implementation, self.normalization_policy, self.special_token_policy))


@dataclass(frozen=True)
class Method:
    """One method of a report. tokens: text column to a count. A method without a contract is never stored."""

    ord: int
    name: str
    display_name: str
    is_exact: bool
    encoding: str
    tokens: Callable[[Column], Column] = field(compare=False)
    context_window: int | None = None
    contract: Contract | None = None


@dataclass(frozen=True)
class Plan:
    methods: tuple[Method, ...]
    approximations: bool
    skip_errors: bool
    chars_per_token: float = T.CHARS_PER_TOKEN
    words_per_token: float = T.WORDS_PER_TOKEN


@dataclass(frozen=True)
class Options:
    """Counting options; a ratio of 0 is the default. vocabularies: encoding to the path of its rank table."""

    chars_per_token: float = 0.0
    words_per_token: float = 0.0
    vocab_file: str = ""
    provider: str = "all"
    vocabularies: dict[str, str] = field(default_factory=dict)

    def ratios(self) -> tuple[float, float]:
        ratios = self.chars_per_token or T.CHARS_PER_TOKEN, self.words_per_token or T.WORDS_PER_TOKEN
        if min(ratios) <= 0:
            raise ValueError("a ratio has to be positive")
        return ratios


def _approximation(encoding: str, name: str, display: str, count: Callable[[Column], Column]) -> Method:
    return Method(0, name, display, False, encoding, count, None, Contract("approximation", encoding, "approx-v1", "", "none-v1", "none-v1"))


def _digest(path: str) -> str:
    """Of a vocabulary file, so that counts made with another one are never reused."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def tokenizer(encoding: str, options: Options) -> Method | None:
    """The method of an encoding's name; None for an unknown one."""
    if encoding == "claude_approx":
        return _approximation(encoding, "claude_3_approx", "Claude (approx)", T.claude_tokens)
    if encoding == "gemini_approx":
        return _approximation(encoding, "gemini_approx", "Gemini (approx)", T.gemini_tokens)
    if encoding == "spm":
        if not options.vocab_file:
            return None
        if not os.path.exists(options.vocab_file):
            raise FileNotFoundError(f"vocab file not found: {options.vocab_file}")
        digest = _digest(options.vocab_file)
        path = options.vocab_file
        return Method(0, "spm", "SentencePiece", True, "spm", lambda c: tokenizers.spm_count(path)(c), None, Contract("sentencepiece", "spm", "sentencepiece-v1", digest, "processor-default-v1", "processor-default-v1"))
    if encoding in tokenizers.ENCODINGS:
        path = tokenizers.vocabulary_path(encoding, options.vocabularies)
        if path is None:
            raise VocabularyUnavailable(f"no rank table for {encoding}")
        return Method(0, f"bpe_{encoding}", encoding, True, encoding, lambda c: tokenizers.bpe_count(encoding, path)(c), None, Contract("bpe", encoding, "bpe-v1", _digest(path), "none-v1", "ordinary-no-special-tokens-v1"))
    return None


def plan(model: str = "", every: bool = False, options: Options | None = None) -> Plan:
    """Methods for a model, or for all encodings that a provider's models use.

    All methods: those whose vocabulary is there, sorted by encoding, then the approximations from totals. A
    model: its encoding's method alone. A name that is no model is tried as an encoding, else only the
    approximations remain.
    """
    options = options or Options()
    chars, words = options.ratios()
    if every or not model:
        found = {}
        for encoding in (*REPORTED_BPE, "claude_approx", "gemini_approx", "spm"):
            if encoding == "spm" and options.provider not in ("", "all"):
                continue
            if registry.provider_allows(encoding, options.provider):
                try:
                    method = tokenizer(encoding, options)
                except VocabularyUnavailable:
                    continue
                if method:
                    found[encoding] = method
        methods = tuple(Method(i, m.name, m.display_name, m.is_exact, m.encoding, m.tokens, None, m.contract) for i, (_, m) in enumerate(sorted(found.items())))
        return Plan(methods, True, True, chars, words)
    known = registry.lookup(model)
    method = tokenizer(known[2] if known else model, options)
    if method is None:
        return Plan((), True, False, chars, words)
    if known:
        method = Method(0, "bpe_" + model.replace("-", "_"), f"{known[2]} ({model})", method.is_exact, method.encoding, method.tokens, known[3], method.contract)
    return Plan((method,), False, False, chars, words)


def approximation_rows(chars: Column, words: Column, plan: Plan, first: int) -> Column:
    """Array of method rows derived from totals."""
    factor = 1.0 / plan.words_per_token
    rows = (
        (f"character_based_div{plan.chars_per_token:.0f}", f"Character-based (÷{plan.chars_per_token:.1f})", T.truncated(chars, plan.chars_per_token)),
        (f"word_based_mul{factor * 100:.0f}", f"Word-based (×{factor:.2f})", T.truncated(words, plan.words_per_token)),
        ("whitespace_split", "Whitespace split", words),
    )
    return F.array(*(method_row(F.lit(first + i), F.lit(n), F.lit(d), t, F.lit(False), F.lit(None).cast("long")) for i, (n, d, t) in enumerate(rows)))


def method_row(ord: Column, name: Column, display: Column, tokens: Column, is_exact: Column, window: Column) -> Column:
    return F.struct(ord.cast("int").alias("ord"), name.alias("name"), display.alias("display_name"), tokens.cast("long").alias("tokens"), is_exact.alias("is_exact"), window.cast("long").alias("context_window"))
