"""Quality rules as a ledger: every rule is evaluated once, and policies are bit masks over the outcome.

``evaluate`` writes one row per document: measurements and ``failed``, a bit mask with one bit per broken rule.
``decide`` applies a versioned policy (a mask) to the ledger; ``ablations`` tells what each rule of a policy does alone
and what would be kept without it. Both read only the masks, never a text again.

All of it is DataFrame expressions. Repeated windows are found in two steps inside a row: hashes of all windows say
whether anything can repeat at all, and only texts where something does compare the words themselves.

Null and empty texts have no words and fail the first rule. Documents are judged row by row, so repeated rows, ties and
further columns change nothing; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.tables import id_and_text

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """The limits of the rules, in the order of their bits."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_dup_line_percent: int = 60
    max_symbol_percent: int = 20
    min_mean_word: float = 1.5
    max_mean_word: float = 15.0
    max_words: int = 1_000_000

    def failures(self) -> dict[str, Column]:
        """Name and condition of each rule over the measurements; the position is the bit."""
        words, chars = F.col("n_words"), F.col("word_chars")
        return {
            "few_words": words < self.min_words,
            "repeated_windows": 100 * F.col("n_repeat_words") > self.max_repeat_percent * words,
            "repeated_lines": 100 * F.col("n_dup_lines") > self.max_dup_line_percent * F.col("n_lines"),
            "symbols": 100 * F.col("n_symbols") > self.max_symbol_percent * words,
            "short_words": chars < self.min_mean_word * words,
            "long_words": chars > self.max_mean_word * words,
            "many_words": words > self.max_words,
        }


BASE_RULES = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A named version: a document that breaks one of ``rules`` is rejected."""

    name: str
    rules: tuple[str, ...] = field(default=BASE_RULES)

    def mask(self, rules: Rules) -> int:
        names = list(rules.failures())
        return sum(1 << names.index(r) for r in self.rules)


POLICIES = (
    Policy("base"),
    Policy("v1", (*BASE_RULES, "repeated_lines", "symbols")),
    Policy("v2", (*BASE_RULES, "repeated_lines", "symbols", "short_words", "long_words")),
)
CURRENT = POLICIES[2]


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words in windows that the text holds at least twice.

    Sorting (hash, start) brings equal windows together; only starts with an equal neighbour go on, are sorted by their
    words, and count if a neighbour has the same words. Each start then adds what the next one does not cover.
    """

    def with_equal_neighbour(rows: Column, key: str) -> Column:
        def at(k: Column) -> Column:
            return F.get(rows, k)[key]

        same = lambda row, k: F.coalesce(row[key] == at(k - 1), F.lit(False)) | F.coalesce(row[key] == at(k + 1), F.lit(False))
        return F.filter(rows, same)

    by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("key"), i.alias("start"))))

    def of_candidates(candidates: Column) -> Column:
        rows = F.transform(candidates, lambda c: F.struct(F.slice(words, c["start"] + 1, WINDOW).alias("key"), c["start"].alias("start")))
        return F.array_sort(rows)

    def let(value: Column, body) -> Column:
        """The value is computed once and used several times in ``body``."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def covered(starts: Column) -> Column:
        step = lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s + WINDOW - acc["end"])).alias("n"), (s + WINDOW).alias("end"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]

    return let(
        by_hash,
        lambda sorted_hashes: let(
            of_candidates(with_equal_neighbour(sorted_hashes, "key")),
            lambda rows: covered(F.array_sort(F.transform(with_equal_neighbour(rows, "key"), lambda r: r["start"]))),
        ),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id and the measurements of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    With ``carry`` the input row comes along as the struct ``row``, so that a filter needs no join back to the texts.
    """
    text = F.col("text")
    source = docs.select(F.struct("*").alias("row")) if carry else id_and_text(docs, id_col, text_col)
    if carry:
        source = id_and_text(source.select("row", F.col(f"row.{id_col}").alias("i"), F.col(f"row.{text_col}").alias("t")), "i", "t", "row")
    kept = ["row"] if carry else []
    rows = source.select(
        *kept,
        "doc_id",
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0).alias("lines"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    words, n = F.col("words"), F.size("words")
    windows = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    )
    rows = rows.withColumn("hashes", windows)
    repeats = F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0)).otherwise(_repeat_words(words, F.col("hashes")))
    measured = F.struct(
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
    )
    # a generator keeps later filters from being pushed into, and repeating, the expressions above
    return rows.select(*kept, "doc_id", F.inline(F.array(measured)))


def evaluate(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:  # noqa: B008
    """The ledger: the measurements and ``failed`` (bigint), bit i set if rule i is broken."""
    bits = [F.when(condition, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, condition in enumerate(rules.failures().values())]
    return measure(docs, id_col, text_col, carry).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def decide(ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The ledger with one boolean ``kept_<policy>`` for each policy."""
    return ledger.withColumns({f"kept_{p.name}": F.col("failed").bitwiseAND(F.lit(p.mask(rules))) == 0 for p in policies})


def ablations(ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row per policy and rule in it: documents that break the rule, that only this rule rejects, and kept without it.

    The ledger is first counted by mask (at most two to the number of rules rows); each rule of each policy then is one
    bitwise condition on these counts.
    """
    masks = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    names = list(rules.failures())
    each = F.explode(
        F.array(*[F.struct(F.lit(p.name).alias("policy"), F.lit(r).alias("rule"), F.lit(p.mask(rules)).alias("mask"), F.lit(1 << names.index(r)).alias("bit")) for p in policies for r in p.rules])
    ).alias("x")
    rows = masks.select("failed", "n", each).select("failed", "n", "x.*")
    hit = F.col("failed").bitwiseAND(F.col("mask").cast("long"))
    bit = F.col("bit").cast("long")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias
    return rows.groupBy("policy", "rule").agg(
        total(hit.bitwiseAND(bit) != 0)("n_broken"),
        total(hit == bit)("n_rejected_by_it_alone"),
        total(hit == 0)("n_kept"),
        total((hit == 0) | (hit == bit))("n_kept_without_it"),
    )
