"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document, from measurements of the whole text. The ledger
keeps the measurements and one failure bit a rule; a policy is a versioned mask, so keeping,
comparing policies and ablating a rule are bit operations on the ledger, and no text is read
again.

Defined cases: a null or empty text has no words, so all its measurements are 0 and it fails
`few_words`; repeated rows are judged each by itself; a null id stays null; an empty table
gives an empty ledger; texts of any length are measured whole; a measurement that ties with its limit passes where
the rule says `<` or `>`; extra columns are not read. Lines are split at \\n only, and a line
counts if it holds a word. Hashes of 64 bits stand for lines and windows, within one text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Words, chunks_of, free_name, mix, slice_hashes, starts_within, text_struct, window_hashes

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_upper_words"]
#: The symbol characters of the base measurement.
SYMBOLS = b"#*$%&|<>"

#: name -> condition on the measurements, in bit order; conditions are in integers.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "repeated_lines": "n_lines >= 5 AND 10 * n_dup_lines > 5 * n_lines",
    "few_letters": "10 * n_letter_words < 6 * n_words",
    "upper_case": "n_words > 0 AND 10 * n_upper_words > 6 * n_words",
    "many_words": "n_words > 1000000",
}
BITS = {name: k for k, name in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")
#: version -> rules that reject.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "short_words", "long_words"),
    "v2": (*BASE, "symbols", "short_words", "long_words", "repeated_lines", "few_letters", "upper_case"),
}


def mask_of(policy: str | tuple[str, ...]) -> int:
    return sum(1 << BITS[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more; which of them are not the first."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:]] = same
    any_ = later.copy()
    any_[order[:-1]] |= same
    return any_, later


def _per(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[ends] - sums[starts]


def _table(values, n: int = 256) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[list(values)] = True
    return out


_UPPER, _LOWER = _table(range(65, 91)), _table(range(97, 123))
_SYMBOL, _LETTER = _table(SYMBOLS), _table([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)])


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    parts = [_measure(texts[s:e]) for s, e in chunks_of(texts)]
    return {m: np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64) for m in MEASURES}


def _measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    w = Words(texts)
    first, last = w.first[:-1], w.first[1:]
    by_text = np.repeat(np.arange(len(texts)), w.counts)
    out = {"n_words": w.counts.astype(np.int64)}
    points = _per((w.buffer & 0xC0) != 0x80, w.starts, w.ends)
    out["word_chars"] = _per(points, first, last)
    out["n_symbols"] = _per(_SYMBOL[w.buffer], w.text_starts, w.text_ends)

    # lines, among them those with a word
    breaks = np.flatnonzero(w.buffer == 10)
    line_starts = np.sort(np.concatenate((w.text_starts, breaks + 1)))
    line_ends = np.sort(np.concatenate((breaks, w.text_ends - 1)))
    held = np.searchsorted(w.starts, line_ends) > np.searchsorted(w.starts, line_starts)
    line_starts, line_ends = line_starts[held], line_ends[held]
    text = np.searchsorted(w.text_ends, line_starts, side="right")
    line_hash = mix(slice_hashes(w.buffer, line_starts, line_ends) ^ mix(text.astype(np.uint64)))
    out["n_dup_lines"] = np.bincount(text[_repeats(line_hash)[1]], minlength=len(texts)).astype(np.int64)
    out["n_lines"] = np.bincount(text, minlength=len(texts)).astype(np.int64)

    # words in windows of three that occur twice or more in the text
    windows = window_hashes(w.hashes(), 3)
    inside = np.flatnonzero(starts_within(w.counts, 3)[: len(windows)])
    again = inside[_repeats(mix(windows[inside] ^ mix(by_text[inside].astype(np.uint64))))[0]]
    covered = np.zeros(len(w.starts), dtype=bool)
    for k in range(3):
        covered[again + k] = True
    out["n_repeat_words"] = _per(covered, first, last)

    letters = _per(_LETTER[w.buffer], w.starts, w.ends)
    out["n_letter_words"] = _per(letters > 0, first, last)
    upper, lower = _per(_UPPER[w.buffer], w.starts, w.ends), _per(_LOWER[w.buffer], w.starts, w.ends)
    out["n_upper_words"] = _per((upper > 0) & (lower == 0), first, last)
    return out


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with the ledger as one struct column, and its name."""
    name = free_name(docs, "ledger")
    m = docs.withColumn(name, text_struct(lambda: measure, ", ".join(f"{m} long" for m in MEASURES))(F.col(text)))
    fields = {x: F.col(f"{name}.{x}") for x in MEASURES}
    bits = F.lit(0).cast("long")
    for rule, condition in RULES.items():
        failed = F.expr(_on(condition, name))
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << BITS[rule]).cast("long")).otherwise(F.lit(0).cast("long")))
    return m.withColumn(name, F.struct(*[c.alias(x) for x, c in fields.items()], bits.alias("failed_bits"))), name


def _on(condition: str, struct: str) -> str:
    return " ".join(f"`{struct}`.{t}" if t in MEASURES else t for t in condition.split())


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its id, the measurements and `failed_bits`."""
    m, name = measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return m.select("doc_id", f"{name}.*")


def passes(bits: Column, policy: str | tuple[str, ...]) -> Column:
    return bits.bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def policy_report(ledger_: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Per policy: documents kept, and all documents. One pass over the bits."""
    bits = F.col("failed_bits")
    sums = ledger_.agg(F.count("*").alias("n"), *[F.count_if(passes(bits, p)).alias(v) for v, p in policies.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.col(v).alias("kept"), F.col("n").alias("documents")) for v in policies])).alias("r")).select("r.*")


def ablations(ledger_: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects."""
    masked = F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long"))
    sums = ledger_.select(masked.alias("b")).groupBy("b").count()  # at most 2 ** rules rows
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    return (
        sums.select("b", "count", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(F.sum(F.when(F.col("b").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("failing"), F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("only_this"))
    )


def filter_documents(docs: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with docs' own columns."""
    m, name = measured(docs, text)
    return m.filter(passes(F.col(f"{name}.failed_bits"), policy)).select(*[F.col(f"`{c}`") for c in docs.columns])
