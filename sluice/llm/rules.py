"""Quality rules: a decision list learnt by sequential covering, emitted as one Spark conditional expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut, maybe_broadcast
from sluice.llm.labelled import labels_sample
from sluice.llm.stats import COUNTS, document_stats, ratios

#: Labelled rows that the list is learnt from, at most (by a hash of their ids).
LEARN_ROWS = 20_000


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def column(self, features: dict[str, Column]) -> Column:
        return features[self.feature] > self.bound if self.above else features[self.feature] <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    on = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        on &= x[c.feature] > c.bound if c.above else x[c.feature] <= c.bound
    return on


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Adds the condition of the greatest information gain until nothing good is covered or no condition helps."""
    rule: list[Condition] = []
    on = np.ones(len(bad), bool)
    while len(rule) < most:
        p, n = bad[on].sum(), (~bad[on]).sum()
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (0.0, None)
        for f, v in x.items():
            v = v[on]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, 41)))
            if len(cuts) < 2:
                continue
            cuts = (cuts[1:] + cuts[:-1]) / 2
            at = np.searchsorted(cuts, v, side="left")  # v <= cuts[k] where at <= k
            pb = np.cumsum(np.bincount(at[bad[on]], minlength=len(cuts) + 1))[:-1]
            nb = np.cumsum(np.bincount(at[~bad[on]], minlength=len(cuts) + 1))[:-1]
            for above, pp, nn in ((False, pb, nb), (True, p - pb, n - nb)):
                gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1)) - base), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), Condition(f, above, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        on &= _covers((best[1],), x)
    return tuple(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    on = _covers(rule, x)
    p, n = bad[on].sum(), (~bad[on]).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 16, most_conditions: int = 4, seed: int = 7) -> list[Rule]:
    """Ordered rules for what to reject. A third of the uncovered rows prunes what the rest has grown; covering ends with the first rule of no worth."""
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    left = np.arange(len(bad))
    while len(rules) < most_rules and bad[left].sum() >= 3:
        mixed = rng.permutation(left)
        prune, grow = mixed[: len(mixed) // 3], mixed[len(mixed) // 3 :]
        take = lambda i: {f: v[i] for f, v in x.items()}
        rule = _grow(take(grow), bad[grow], most_conditions)
        if not rule:
            break
        held = take(prune)
        short = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(short, key=lambda r: (_worth(r, held, bad[prune]), -len(r)))
        if _worth(rule, held, bad[prune]) <= 0.5 or _worth(rule, take(left), bad[left]) <= 0.5:  # three of four covered rows at least are to go
            break
        rules.append(rule)
        left = left[~_covers(rule, take(left))]
    return rules


def verdict(rules: list[Rule], features: dict[str, Column] | None = None) -> Column:
    """Whether a row is kept: the first rule that holds rejects it, and none keeps it."""
    features = features or ratios()
    out = None
    for r in rules:
        on = F.lit(True)
        for c in r:
            on = on & c.column(features)
        out = F.when(on, F.lit(False)) if out is None else out.when(on, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS) -> tuple[DataFrame, list[Rule]]:
    """(doc_id, COUNTS, base_failed, kept) of each document, and the rules.

    Needs doc_id and text of documents and doc_id and quality of labels; other columns are ignored. A null
    text has no words and fails the base rule. Null doc_ids are judged but never learnt from; repeated
    ids are judged row by row, and a labelled one is learnt from once, by its row with the least features. A very
    long text is held whole by one task. Without labels there are no rules, and the base rule alone decides; an
    empty table gives no rows.
    """
    stats = cut(document_stats(docs))
    sample = labels_sample(labels, "quality", F.lit(True), learn_rows)
    rows = stats.join(maybe_broadcast(sample, sample.count(), 4 * learn_rows), "doc_id").select("doc_id", "y", *[c.alias(f) for f, c in ratios().items()])
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("y", *ratios())).alias("r")).select("doc_id", "r.*")  # however often an id repeats
    got = rows.toPandas().sort_values("doc_id", kind="stable")  # learn_rows at about most
    x = {f: got[f].to_numpy(float) for f in ratios()}
    rules = learn(x, got["y"].to_numpy(float) < 0.5) if len(got) else []
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept")), rules
