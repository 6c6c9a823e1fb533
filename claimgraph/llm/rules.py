"""Ordered rule lists by incremental reduced-error pruning, and their SQL.

A rule is a conjunction of thresholds. For one class after the other, rarest
first, rules are grown on two thirds of the rows not yet covered, condition by
condition with the greatest information gain, and pruned on the other third; a
rule that errs too often there is dropped, and some such in a row, each from a new
split, end the class. The last class is the default.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

Condition = tuple[str, str, float]  # feature, '<=' or '>', threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    label: str

    def covers(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(columns.values())))
        kept = np.ones(n, bool)
        for feature, side, threshold in self.conditions:
            kept &= columns[feature] <= threshold if side == "<=" else columns[feature] > threshold
        return kept


@dataclass(frozen=True)
class RuleList:
    rules: tuple[Rule, ...]
    default: str
    labels: tuple[str, ...] = ()

    def predict(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(columns.values()))) if columns else 0
        out, free = np.full(n, self.default, object), np.ones(n, bool)
        for rule in self.rules:
            hit = rule.covers(columns) & free
            out[hit] = rule.label
            free &= ~hit
        return out

    def sql(self) -> str:
        """The list as a CASE expression over columns named like the features."""
        quoted = lambda s: "'" + s.replace("'", "''") + "'"
        if not self.rules:
            return quoted(self.default)
        when = " ".join(f"WHEN {' AND '.join(f'{f} {side} {threshold!r}D' for f, side, threshold in r.conditions) or 'true'} THEN {quoted(r.label)}" for r in self.rules)
        return f"CASE {when} ELSE {quoted(self.default)} END"


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, gain, -np.inf)


def _grow(columns: dict[str, np.ndarray], positive: np.ndarray, weight: np.ndarray, cuts: dict[str, np.ndarray], most: int, sides: dict[str, str], pure: float) -> list[Condition]:
    held, rule = np.ones(len(positive), bool), []
    while len(rule) < most:
        w, pos = weight[held], positive[held]
        p0, n0 = w[pos].sum(), w[~pos].sum()
        if p0 <= 0 or n0 <= pure * (p0 + n0):
            break
        best: tuple[float, Condition | None] = (1e-9, None)
        for feature, edges in cuts.items():
            at = np.searchsorted(edges, columns[feature][held], side="left")  # value <= edges[i] exactly if at <= i
            p = np.bincount(at[pos], weights=w[pos], minlength=len(edges) + 1).cumsum()[:-1]
            n = np.bincount(at[~pos], weights=w[~pos], minlength=len(edges) + 1).cumsum()[:-1]
            for side, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                if side not in sides.get(feature, "<= >"):
                    continue
                gains = _gain(np.maximum(a, 0), np.maximum(b, 0), p0, n0)
                i = int(np.argmax(gains)) if len(gains) else 0
                if len(gains) and gains[i] > best[0]:
                    best = (float(gains[i]), (feature, side, float(edges[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        held &= Rule((best[1],), "").covers(columns)
    return rule


def _prune(rule: list[Condition], columns: dict[str, np.ndarray], positive: np.ndarray, weight: np.ndarray) -> tuple[list[Condition], float]:
    """The prefix of the rule with the best (p - n) / (p + n) on the pruning rows, and that value."""
    best, kept = -1.0, len(rule)
    for size in range(len(rule), 0, -1):
        hit = Rule(tuple(rule[:size]), "").covers(columns)
        p, n = weight[hit & positive].sum(), weight[hit & ~positive].sum()
        worth = (p - n) / (p + n) if p + n > 0 else -1.0
        if worth >= best:
            best, kept = worth, size
    return rule[:kept], best


def induce(columns: dict[str, np.ndarray], labels: Sequence[str], weight: np.ndarray, *, order: Sequence[str] | None = None, sides: dict[str, str] | None = None, bins: int = 24, most: int = 6, pure: float = 0.01, rules: int = 12, least_worth: float = 0.5, least_share: float = 0.002, tries: int = 6, seed: int = 7) -> RuleList:
    """A rule list for `labels`. 

    Thresholds are quantiles of the features. Classes are learnt in `order`, or the
    rarest first; the last is the default. `sides` names the comparisons a feature
    may be used in for the first class ('<=', '>' or both); growth stops at a share of `pure` errors. Without rows the default is ''.
    """
    labels = np.asarray(labels, object)
    if not len(labels):
        return RuleList((), "", ())
    classes = list(order or sorted(set(labels), key=lambda c: (weight[labels == c].sum(), c)))
    rng = np.random.default_rng(seed)
    cuts = {}
    for f, v in columns.items():
        edges = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)))
        cuts[f] = np.round((edges[1:] + edges[:-1]) / 2, 6) if len(edges) > 1 else edges[:0]
        cuts[f] = np.unique(np.concatenate([cuts[f], [0.0]])) if len(edges) > 1 and edges[0] <= 0 else cuts[f]
    left, found = np.ones(len(labels), bool), []
    for label in classes[:-1]:
        made_here = misses = 0
        while made_here < rules and misses < tries:
            rows = np.flatnonzero(left)
            if not (labels[rows] == label).any():
                break
            rng.shuffle(rows)
            grow, prune = rows[len(rows) // 3 :], rows[: len(rows) // 3]
            part = lambda idx: ({f: v[idx] for f, v in columns.items()}, labels[idx] == label, weight[idx])  # noqa: E731,B023
            rule = _grow(*part(grow), cuts, most, (sides or {}) if label == classes[0] else {}, pure)
            if not rule:
                misses += 1
                continue
            rule, worth = _prune(rule, *part(prune))
            made = Rule(tuple(rule), label)
            hit = made.covers(columns) & left
            if worth < least_worth or weight[hit].sum() < least_share * weight.sum():
                misses += 1
                continue
            made_here, misses = made_here + 1, 0
            found.append(made)
            left &= ~hit
    return RuleList(tuple(found), classes[-1], tuple(classes))
