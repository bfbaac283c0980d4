"""Rule bitmask ledger: every rule is evaluated once for each document; policies are masks over the stored bits.

ledger() measures each text, sets one bit of fail_bits for each rule that fails, and stores the result. decide() applies a versioned
policy, a set of rule names, by one bitwise test; ablation() counts from the ledger alone, in one map-side combined
aggregation, what every rule rejects, what it alone rejects, and what would be kept without it. All is built-in column
expressions within the row: nothing is exploded, and only ablation() shuffles, one row for each task.

Measures: n_words; word_chars (code points in words); n_symbols (characters of SYMBOLS); n_dup_lines (lines with a
word that equal an earlier line); n_repeat_words (words inside five-word windows that occur twice or more, first ones
included). Windows are compared by a 64-bit hash of their five words, within one document only.

Defined results: null and wordless text measures 0 everywhere and fails too_few_words; repeated rows are measured
alike; an empty table gives an empty one. Only doc_id and text are read, so further columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES_RE, settle, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Rules in the order of their bits, each true where a document fails. Never reorder: ledgers are stored.
RULES: dict[str, Column | str] = {
    "too_few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "n_symbols > 0.3 * n_words",
    "duplicate_lines": "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines",
    "long_words": "word_chars > 30 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BASE = ("too_few_words", "repeated_words")
#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "2026-01": (*BASE, "symbols"),
    "2026-02": (*BASE, "symbols", "duplicate_lines", "long_words"),
    "all": tuple(RULES),
}
CURRENT = "2026-02"


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(x) for x in POLICIES[policy])


def repeated(w: Column) -> Column:
    """Words of w that lie in a window whose like occurs again in w."""

    def bound(value: Column, use) -> Column:  # evaluates value once, as a lambda's argument
        return F.transform(F.array(value), use)[0]

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(WINDOW))))
    ordered = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(ordered(h), lambda s: bound(places_of(s), covered_by)))
    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(bound(hashes, count))


def places_of(s: Column) -> Column:
    """Positions, in order, of entries of s (sorted by h) that have an equal neighbour."""
    same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
    return F.array_sort(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))


def covered_by(p: Column) -> Column:
    """Words that windows at the positions p cover."""
    return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, and fail_bits, in which bit k is set where rule k of RULES fails."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACES_RE, "") != "")
    measured = (
        docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w"), lines.alias("lines"))
        .select(
            "doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated(F.col("w")).cast("long").alias("n_repeat_words"),
        )
    )
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    # Stored, and so measured once for all policies; a filter above it would else be pushed down with copies of the rules.
    return settle(measured.withColumn("fail_bits", total.cast("long")), "ledger")


def decide(kept_ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy, and alone_bit: the bit of the one rule without which a rejected row would be kept, 0 if there is none."""
    failed = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m))
    whole = failed(mask("base") | mask(policy))
    alone = F.when(whole.bitwiseAND(whole - 1) == 0, whole).otherwise(F.lit(0).cast("long"))
    return kept_ledger.withColumns({"base_failed": failed(mask("base")) != 0, "kept": whole == 0, "alone_bit": alone})


def ablation(kept_ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A row for each rule of the policy: rule, rejects, rejects_alone, kept_without, and kept under the whole policy."""
    m, names = mask(policy), list(RULES)
    failed = F.col("fail_bits").bitwiseAND(F.lit(m))
    used = [k for k in range(len(names)) if m >> k & 1]
    sums = [F.count_if(failed == 0).alias("kept")]
    for k in used:
        sums += [F.count_if(failed.bitwiseAND(F.lit(1 << k)) != 0).alias(f"r{k}"), F.count_if(failed == 1 << k).alias(f"a{k}")]
    rows = F.array(*(F.struct(F.lit(names[k]).alias("rule"), F.col(f"r{k}").alias("rejects"), F.col(f"a{k}").alias("rejects_alone"), (F.col("kept") + F.col(f"a{k}")).alias("kept_without"), "kept") for k in used))
    return kept_ledger.agg(*sums).select(F.inline(rows))
