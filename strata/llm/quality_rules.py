"""Learned quality rules: an ordered decision list over document statistics, applied as one Spark expression.

The statistics are built-in functions on the text alone, so a document never leaves its task and nothing
is shuffled. Rules are learned by sequential covering: a conjunction of thresholds grows on one part of
the labelled rows, is pruned on the other, and the rows it covers are set aside for the next rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.repeats import written

#: Labelled rows that the rules are learned from; the least hashes of their ids.
LABELLED_ROWS = 10_000
#: Learning by sequential covering: rules, conditions of a rule, thresholds tried per statistic, rows that a rule covers at least, share of bad rows among those it covers.
MAX_RULES, MAX_CONDITIONS, THRESHOLDS, MIN_COVER, MIN_PRECISION = 24, 3, 24, 8, 0.95
#: Words of the learned list of words that stand in toxic documents only, and documents that must have one.
FLAGGED_WORDS, FLAGGED_DOCUMENTS = 128, 5

SPACE = "\\x20\\x09-\\x0D"
SPACES = " \t\n\x0b\x0c\r"
#: Statistics that the rules may use.
FEATURES = ("n_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "capitals", "marks", "digits", "flagged")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where ``use`` names it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def _repeated(own: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that stand in the array twice or more."""
    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda e, k: (e.h == F.get(s, k - 1).h) | (e.h == F.get(s, k + 1).h))
        places = _let(placed, lambda s: F.sort_array(F.transform(again(s), lambda e: e.i)))
        widths = _let(places, lambda p: F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(width), F.get(p, k + 1) - x), F.lit(width))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(F.aggregate(widths, F.lit(0), lambda a, x: a + x))

    hashes = F.transform(F.sequence(F.lit(1), F.size(own) - (width - 1)), lambda i: F.xxhash64(F.slice(own, i, width)))
    return F.when(F.size(own) <= width, F.lit(0)).otherwise(_let(hashes, covered))


def _matches(text: Column, pattern: str) -> Column:
    """Characters of ``text`` in a class of single UTF-16 units."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def statistics(documents: DataFrame, flagged: list[str] | None = None) -> DataFrame:
    """``documents`` with a struct ``stats``; a null text counts as empty, and an empty one has zeros throughout.

    The struct has the exact counts (``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``) and the other fields named in ``FEATURES``, ratios per word but for ``flagged``:
    1 if a word of that list stands in the text, in any case and beside any punctuation.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in documents.columns]
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACES)) != "")
    has = F.arrays_overlap(F.split(F.lower(text), "[^\\p{L}\\p{M}\\p{N}]+"), F.array(*[F.lit(w) for w in flagged])) if flagged else F.lit(False)
    step = documents.select(*kept, words(text).alias("__w"), lines.alias("__l"))
    n = F.size("__w")
    counts = step.select(*kept, F.struct(
        n.cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        _matches(text, "[#*$%&|<>]").cast("long").alias("n_symbols"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("__w")).cast("long").alias("n_repeat_words"), F.size("__l").alias("n_lines"), F.size(F.array_distinct("__w")).alias("n_distinct"),
        _matches(text, "[A-Z]").alias("n_capitals"), _matches(text, "[.,;:!?]").alias("n_marks"), _matches(text, "[0-9]").alias("n_digits"), has.cast("int").alias("flagged"),
    ).alias("__c"))
    c = F.col("__c")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return counts.select(*kept, F.struct(
        c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.flagged.cast("double").alias("flagged"),
        ratio(c.word_chars, c.n_words).alias("word_length"), ratio(c.n_symbols, c.n_words).alias("symbols"), ratio(c.n_dup_lines, c.n_lines).alias("dup_lines"),
        ratio(c.n_repeat_words, c.n_words).alias("repeats"), ratio(c.n_distinct, c.n_words).alias("distinct"), ratio(c.n_capitals, c.word_chars).alias("capitals"),
        ratio(c.n_marks, c.n_words).alias("marks"), ratio(c.n_digits, c.word_chars).alias("digits"),
    ).alias("stats"))


def base_failed(stats: str = "stats") -> Column:
    s = F.col(stats)
    return (s.n_words < 10) | (100 * s.n_repeat_words > 20 * s.n_words)


@dataclass(frozen=True)
class Condition:
    feature: str
    over: bool
    bound: float

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.over else '<'} {self.bound:g}"

    def column(self, stats: str) -> Column:
        value = F.col(stats)[self.feature]
        return value >= self.bound if self.over else value < self.bound


@dataclass
class DecisionList:
    """Rules in order: a document is rejected by the first whose conditions all hold, else kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)
    flagged: list[str] = field(default_factory=list)

    def expression(self, stats: str = "stats") -> Column:
        """Text of the first rule that holds; null where none does."""
        out = None
        for rule in self.rules:
            holds, text = F.lit(True), " and ".join(map(str, rule))
            for condition in rule:
                holds = holds & condition.column(stats)
            out = F.when(holds, F.lit(text)) if out is None else out.when(holds, F.lit(text))
        return F.lit(None).cast("string") if out is None else out


def learn_list(rows: list[dict[str, float]], bad: list[bool], *, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS,
               thresholds: int = THRESHOLDS, min_cover: int = MIN_COVER, min_precision: float = MIN_PRECISION) -> list[tuple[Condition, ...]]:
    """Sequential covering over a bounded list of rows; two of three rows grow a rule, the third prunes it.

    Rows are sets of bits in one integer, so a condition is counted by its bits. Without bad rows, or
    without a rule of the required precision, the list is empty. The outcome depends on the order of the
    rows only through the parts they fall into.
    """
    full = (1 << len(rows)) - 1
    positive = sum(1 << i for i, x in enumerate(bad) if x)
    prune_part = sum(1 << i for i in range(2, len(rows), 3))
    masks: dict[Condition, int] = {}
    for name in rows[0] if rows else ():
        order = sorted(range(len(rows)), key=lambda i: rows[i][name])
        values = sorted({r[name] for r in rows})
        cuts = {values[len(values) * k // thresholds] for k in range(1, thresholds)} | {rows[order[len(order) * k // thresholds]][name] for k in range(1, thresholds)}
        for cut in sorted(cuts - {values[0]}):
            over = sum(1 << i for i, r in enumerate(rows) if r[name] >= cut)
            masks[Condition(name, True, cut)], masks[Condition(name, False, cut)] = over, full ^ over

    def precision(mask: int, part: int) -> float:
        covered = (mask & part).bit_count()
        return ((mask & part & positive).bit_count() + 1) / (covered + 2)

    left, rules = full, []
    while len(rules) < max_rules and (left & positive).bit_count() >= min_cover:
        grow, rule, mask = left & ~prune_part, [], left
        while len(rule) < max_conditions and (mask & grow & ~positive).bit_count():
            held = (mask & grow & positive).bit_count()
            base = precision(mask, grow)
            best = max(masks, key=lambda c: ((n := (mask & masks[c] & grow & positive).bit_count()) * (_log(precision(mask & masks[c], grow)) - _log(base)), n))
            if not (mask & masks[best] & grow & positive).bit_count() or masks[best] & mask == mask or held == 0:
                break
            rule.append(best)
            mask &= masks[best]
        while len(rule) > 1:  # drop conditions while the held-out part does not get worse
            def without(k: int) -> int:
                out = left
                for i, c in enumerate(rule):
                    out &= masks[c] if i != k else full
                return out
            drop = max(range(len(rule)), key=lambda k: precision(without(k), left & prune_part))
            if precision(without(drop), left & prune_part) < precision(mask, left & prune_part):
                break
            mask = without(drop)
            del rule[drop]
        covered, right = (mask & left).bit_count(), (mask & left & positive).bit_count()
        if not rule or right < min_cover or right < min_precision * covered:
            break
        rules.append(tuple(rule))
        left &= ~mask
    return rules


def _log(x: float) -> float:
    from math import log2
    return log2(x)


def learn(documents: DataFrame, labels: DataFrame, *, limit: int = LABELLED_ROWS) -> DecisionList:
    """Rules from documents whose label says ``quality`` 0 or ``toxic`` 1.

    At most ``limit`` labels are used, those whose ids have the least hashes; a null label or id counts
    as no label, and of labels that contradict each other the worse holds. Without labels nothing is
    rejected. Ids of any type match as text. Where labelled ids repeat among the documents, the rules are
    fitted on at most twice ``limit`` rows, those whose ids have the least hashes.
    """
    marks = written(
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
        .agg((F.min("quality") == 0).alias("low"), (F.max("toxic") == 1).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        .select(F.col("doc_id").cast("string").alias("__id"), "low", "toxic"), "marks")
    known = documents.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id").cast("string") == F.col("__id")).drop("__id")
    # one word each of documents that are toxic, and of no other, by the number of documents
    standing = known.select("toxic", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+"))).alias("word"))
    found = (
        standing.where("length(word) > 2").groupBy("word").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
        .where((F.col("a") >= FLAGGED_DOCUMENTS) & (F.col("b") * 50 <= F.col("a"))).orderBy(F.desc("a"), "word").limit(FLAGGED_WORDS).collect()
    )
    flagged = [r.word for r in found]
    order = statistics(known, flagged).select("doc_id", (F.col("low") | F.col("toxic")).alias("bad"), *[F.col("stats")[f].cast("double").alias(f) for f in FEATURES]) \
        .orderBy(F.xxhash64("doc_id"), *FEATURES).limit(2 * limit).collect()
    if not order:
        return DecisionList()
    return DecisionList(learn_list([{f: r[f] for f in FEATURES} for r in order], [r.bad for r in order]), flagged)


def judge(documents: DataFrame, rules: DecisionList) -> DataFrame:
    """``documents`` with ``stats``, ``base_failed``, ``rule`` (the first learned rule that holds, or null) and ``kept``.

    A document fails the base rules with fewer than 10 words or with over a fifth of its words in repeated
    windows. Null and empty texts have no words and fail. Repeated rows get the same verdict; columns that
    have one of the four names are replaced.
    """
    source = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("stats", "base_failed", "rule", "kept")])
    out = statistics(source, rules.flagged)
    return out.withColumns({"base_failed": base_failed(), "rule": rules.expression()}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    out = judge(documents.select("doc_id", "text"), learn(documents, labels))
    s = F.col("stats")
    return out.select("doc_id", s.n_words.alias("n_words"), s.word_chars.alias("word_chars"), s.n_symbols.alias("n_symbols"), s.n_dup_lines.alias("n_dup_lines"),
                      s.n_repeat_words.alias("n_repeat_words"), "base_failed", "kept", "rule")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    judged = judge(documents, learn(documents, labels))
    # a row number in the condition keeps Spark from moving the filter below the statistics, where each use of one computes it anew
    return judged.withColumn("__row", F.monotonically_increasing_id()).where("kept AND __row >= 0").select(*[F.col(f"`{c}`") for c in documents.columns])
