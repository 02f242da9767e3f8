"""Quality rules: a learned decision list over text statistics, applied as one Spark conditional expression.

Sequential covering: a rule is grown on one part of the labelled rows, condition by condition, by information gain; pruned
on the other part; then the rows it covers leave, and the next rule is grown from what is left. The list ends when a rule
is not clean enough on rows it was not grown from. Rules only ever reject; what no rule covers is kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import labelled_sample, unused_name
from duskwatch.llm.textstats import COUNTS, MORE, with_counts

#: Statistic by name, as SQL over the counts; the same text gives Spark's column and the training matrix.
STATISTICS = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "top_word_share": "most_frequent / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_upper + n_lower, 1)",
    "shout_share": "n_shouts / greatest(n_words, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass
class Rule:
    """A conjunction of (statistic, is it 'at least', threshold)."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def covers(self, table: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(table.values()))), dtype=bool)
        for name, least, bound in self.conditions:
            hit &= table[name] >= bound if least else table[name] <= bound
        return hit

    def sql(self) -> str:
        return " and ".join(f"{STATISTICS[n]} {'>=' if least else '<='} {bound!r}D" for n, least, bound in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule]

    def kept(self) -> Column:
        """False where a rule covers the row, tried in order, else true."""
        verdict = F.when(F.expr("false"), F.lit(False))
        for rule in self.rules:
            verdict = verdict.when(F.expr(rule.sql()), F.lit(False))
        return verdict.otherwise(F.lit(True))

    def reason(self) -> Column:
        """Number from 1 of the first rule that covers the row, else null."""
        number = F.when(F.expr("false"), F.lit(0))
        for place, rule in enumerate(self.rules, 1):
            number = number.when(F.expr(rule.sql()), F.lit(place))
        return number


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _best_condition(table: dict[str, np.ndarray], bad: np.ndarray, grid: int) -> tuple[float, tuple[str, bool, float]] | None:
    best = None
    p0, n0 = int(bad.sum()), int((~bad).sum())
    for name, values in table.items():
        bounds = np.unique(np.quantile(values, np.linspace(0, 1, grid), method="nearest"))
        mids = (bounds[1:] + bounds[:-1]) / 2
        if not len(mids):
            continue
        order = np.sort(values[bad]), np.sort(values[~bad])
        above = [len(x) - np.searchsorted(x, mids, "left") for x in order]
        below = [np.searchsorted(x, mids, "right") for x in order]
        for least, (p, n) in ((True, above), (False, below)):
            gains = _gain(p, n, p0, n0)
            k = int(gains.argmax())
            if gains[k] > 1e-9 and (best is None or gains[k] > best[0]):
                best = float(gains[k]), (name, least, float(mids[k]))
    return best


def learn(table: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 20, most_conditions: int = 4, precision: float = 0.9, grid: int = 257) -> DecisionList:
    """Cover the rows marked ``bad`` rule by rule; without such rows, or without others, the list is empty."""
    rules: list[Rule] = []
    size = len(bad)
    grow = (np.arange(size) * 2654435761 % 2**32) % 3 != 0
    left = np.ones(size, dtype=bool)
    while len(rules) < most_rules and (left & grow & bad).any() and (left & grow & ~bad).any():
        rule, active = Rule(), left & grow
        while len(rule.conditions) < most_conditions and (active & ~bad).any():
            found = _best_condition({k: v[active] for k, v in table.items()}, bad[active], grid)
            if found is None:
                break
            rule.conditions.append(found[1])
            active = left & grow & rule.covers(table)
        if not rule.conditions:
            break

        def worth(candidate: Rule) -> float:
            hit = left & ~grow & candidate.covers(table)
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        # Prune: of all shorter heads of the conjunction, the cleanest on unseen rows; the shortest of equals.
        heads = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
        rule = max(heads, key=lambda r: (worth(r), -len(r.conditions)))
        hit = left & rule.covers(table)
        if (bad[hit].mean() if hit.any() else 0.0) < precision or worth(rule) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(rules)


def fit(documents: DataFrame, labels: DataFrame, rows: int = 20_000, **options) -> DecisionList:
    """A decision list from at most ``rows`` labelled documents outside the held-out fifth.

    Rows that the base rules reject say nothing about what is left to them and take no part. One row of numbers for each
    sampled document comes to the driver.
    """
    sample = with_counts(labelled_sample(documents, labels, "quality", rows), ["doc_id", "label"]).where(f"not ({BASE_FAILED})")
    got = sample.select("doc_id", "label", *(F.expr(sql).alias(name) for name, sql in STATISTICS.items())).toPandas()
    got = got.sort_values(list(got.columns)).reset_index(drop=True)
    return learn({name: got[name].to_numpy(dtype=float) for name in STATISTICS}, got["label"].to_numpy() == 0, **options)


def verdicts(documents: DataFrame, decide: DecisionList) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every document.

    Null and empty texts have no word, so base_failed. Repeated rows and null ids are judged each for itself; columns of
    other names are not looked at.
    """
    counted = with_counts(documents.select("doc_id", "text"), ["doc_id"])
    failed = F.expr(BASE_FAILED)
    return counted.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & decide.kept()).alias("kept"))


def keep(documents: DataFrame, decide: DecisionList) -> DataFrame:
    """The documents, all columns, that neither the base rules nor the list reject; one pass, no shuffle."""
    names = documents.columns
    inner = [unused_name(documents, f"c{k}_") for k in range(len(names))]
    taken = {n.lower() for n in [*COUNTS, *MORE]}
    assert not taken & set(inner)
    texts = documents.toDF(*inner)
    texts = texts.withColumn("text", F.col(inner[names.index("text")]))
    counted = with_counts(texts, inner)
    return counted.where(~F.expr(BASE_FAILED) & decide.kept()).select(*(F.col(i).alias(n) for i, n in zip(inner, names)))
