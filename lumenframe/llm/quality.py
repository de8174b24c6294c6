"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements
and one long whose bit ``r`` says that rule ``r`` failed.  A policy is a
versioned set of rules, so applying another version or asking what a rule
contributes needs bitwise arithmetic on the ledger only, never the texts.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import own_name, tidy

SPACES = b" \t\n\x0b\x0c\r"
_NOT_A_CODE_POINT = SPACES + bytes(range(0x80, 0xC0))
#: Counted as symbols.
SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")
_TYPE = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


def measure(text: bytes | None, window: int = 3) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one whole text; null counts as empty.

    ``word_chars`` counts code points in words, ``n_dup_lines`` lines with a
    word that equal an earlier line, ``n_repeat_words`` words that lie in a
    window of ``window`` words found at least twice, ``n_upper`` A-Z.
    """
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = list(zip(*(words[i:] for i in range(window))))
    repeated = 0
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        inside = bytearray(n)
        mark = b"\x01" * window
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                inside[i : i + window] = mark
                inside[j : j + window] = mark
        repeated = sum(inside)
    return (
        n,
        len(text.translate(None, _NOT_A_CODE_POINT)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
        len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


@F.arrow_udf(_TYPE)
def _measures(texts: pa.Array) -> pa.Array:
    rows = [measure(x.as_py()) for x in texts.cast(pa.large_binary())]
    columns = zip(*rows) if rows else [()] * len(MEASURES)
    return tidy(pa.StructArray.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=list(MEASURES)))


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL predicate over the measurements."""

    name: str
    fails: str


#: Bit ``r`` of the ledger belongs to the rule at place ``r``.  Append only:
#: a stored ledger keeps its meaning.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("short_words", "2 * word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 30 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("capitals", "2 * n_upper > word_chars"),
    Rule("many_words", "n_words > 1000000"),
)

#: Versions of the policy: names of the rules that reject.
POLICIES: Mapping[str, Sequence[str]] = {
    "base": ("few_words", "repeated_words"),
    "2024-1": ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    "2024-2": ("few_words", "repeated_words", "symbols", "short_words", "long_words", "duplicate_lines", "capitals"),
}
CURRENT = "2024-2"


def policy_mask(policy: str, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> int:
    places = {r.name: i for i, r in enumerate(rules)}
    mask = 0
    for name in policies[policy]:
        mask |= 1 << places[name]
    return mask


def failed_bits(rules: Sequence[Rule] = RULES, measures: str = "") -> Column:
    """The mask of the rules that fail, from measurement columns or the struct of them named ``measures``."""
    failed = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        fails = re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"{measures}.\1", r.fails) if measures else r.fails
        failed = failed.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return failed


def ledger(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with its text replaced by the measurements and ``failed``.

    Columns of ``docs`` whose names clash with a measurement or ``failed`` are
    dropped in favour of the ledger's.  Null and empty texts have zero
    measurements; texts of any length are measured whole; repeated rows get a
    row each; a measurement exactly at a rule's bound passes it; an empty
    table gives an empty ledger.
    """
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    made = {*MEASURES, "failed"}
    (m,) = own_name(docs, "measures__")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c.lower() not in made]
    measured = docs.select(*kept, _measures(F.col(f"`{text_col}`")).alias(m))
    flat = measured.select(*kept, *[F.col(f"{m}.{x}").alias(x) for x in MEASURES])
    return flat.withColumn("failed", failed_bits(rules))


def passes(policy: str = CURRENT, failed: Column | None = None) -> Column:
    """Whether a row of the ledger passes a policy."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def keep(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose ledger mask passes a policy."""
    m, f = own_name(docs, "measures__", "failed__")
    measured = docs.withColumn(m, _measures(F.col(f"`{text_col}`"))).withColumn(f, failed_bits(measures=m))
    return measured.where(passes(policy, F.col(f))).drop(m, f)


def ablation(ledger_rows: DataFrame, policy: str = CURRENT, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of a policy: how many rows it fails, and how many it alone rejects.

    Equal masks are counted first, so the rest handles one row per mask.
    """
    mask = policy_mask(policy, rules=rules)
    counts = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("mask")).agg(F.count("*").alias("n"))
    chosen = [(i, r.name) for i, r in enumerate(rules) if mask >> i & 1]
    each = F.explode(F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(name).alias("rule")) for i, name in chosen]))
    hit = counts.select("mask", "n", each.alias("r")).select("n", "r.rule", (F.col("mask").bitwiseAND(F.col("r.bit")) != 0).alias("fails"), (F.col("mask") == F.col("r.bit")).alias("alone"))
    return hit.groupBy("rule").agg(
        F.sum(F.when(F.col("fails"), F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("alone"), F.col("n")).otherwise(0)).alias("n_only"),
    )
