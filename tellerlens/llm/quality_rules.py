"""Quality rules as a ledger of bits, in DataFrame functions only.

``ledger`` measures every text once and stores the measurements and one bit per failed rule. A policy is a version and a
mask: a document is kept if no bit of the mask is set, so new policies never look at the texts again. ``ablations``
counts, from the bits alone, what each rule of a policy decides.

Rows: a null text counts as empty and fails ``few_words``. Texts are taken whole. Equal rows get equal results, null ids
stay, other columns are ignored, an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored


@dataclass(frozen=True)
class Rule:
    """``failed`` sees the columns that ``measured`` adds. The place in RULES is the bit; append only."""

    name: str
    failed: Callable[[], Column]


RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("repeated_lines", lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 15 * F.col("n_words")),
)


def mask(*names: str) -> int:
    known = [r.name for r in RULES]
    return sum(1 << known.index(n) for n in names)


BASE = mask("few_words", "repeated_windows")
#: Versions of policies; a version's mask never changes once published.
POLICIES: dict[int, int] = {1: BASE, 2: mask(*(r.name for r in RULES))}
CURRENT = 2


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of each text.

    Windows of three words are compared by 64-bit hashes; only texts in which a hash occurs twice sort them to find the
    places. Arrays live in columns of their own, used more than once, so the optimizer does not copy them into loops.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("body"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    rows = rows.withColumns({
        "n_words": F.size("w").cast("long"),
        "lines": F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD)),
        "windows": F.when(F.size("w") < 4, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2]))
        ),
    })
    rows = rows.select(
        "doc_id", "n_words", F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "windows", (F.size(F.array_distinct("windows")) < F.size("windows")).alias("repeats"),
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn(
        "ranked", F.when(F.col("repeats"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)
    ).drop("windows")
    n = F.size("ranked")
    pairs = F.filter(
        F.zip_with(F.slice("ranked", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("ranked", F.lit(2), F.greatest(n - 1, F.lit(0))),
                   lambda a, b: F.struct((a["h"] == b["h"]).alias("same"), F.array(a["i"], b["i"]).alias("at"))),
        lambda p: p["same"],
    )
    rows = rows.withColumn("starts", F.when(F.col("repeats"), F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda p: p["at"]))))).otherwise(F.array().cast("array<int>")))
    s = F.size("starts")
    shared = F.aggregate(
        F.zip_with(F.slice("starts", F.lit(1), F.greatest(s - 1, F.lit(0))), F.slice("starts", F.lit(2), F.greatest(s - 1, F.lit(0))), lambda a, b: F.greatest(F.lit(0), 3 - (b - a))),
        F.lit(0), lambda acc, x: acc + x,
    )
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.col("repeats"), 3 * s - shared).otherwise(0).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, **cols: str) -> DataFrame:
    """Measurements and ``fail_bits``, written once to the shared folder: what follows reads bits, never texts."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rule.failed(), F.lit(1 << i)).otherwise(0).cast("long"))
    return stored(measured(docs, **cols).withColumn("fail_bits", bits))


def apply_policy(led: DataFrame, version: int = CURRENT) -> DataFrame:
    return led.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).withColumn(
        "kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0
    )


def ablations(led: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that are kept once it is left out.
    Works on counts per bit pattern: at most 2 ** rules rows, whatever the ledger's size."""
    of = POLICIES[version]
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(of)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if of >> i & 1])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )
