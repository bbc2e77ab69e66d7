"""Decision trees of pyspark.ml as Spark column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A rule: (feature number, whether it is at most the threshold, threshold), all of which hold.
Rule = tuple[tuple[int, bool, float], ...]


def paths(tree) -> list[tuple[Rule, bool, float]]:
    """(rule, is a leaf, prediction at the leaf) of each node but the root, top down, from the tree's printed form."""
    out, above = [], []
    for line in tree.toDebugString.splitlines()[1:]:
        depth = len(line) - len(line.lstrip())
        while above and above[-1][0] >= depth:
            above.pop()
        rule = tuple(c for _, c in above)
        if m := re.search(r"\(feature (\d+) (<=|>) (\S+)\)", line):
            above.append((depth, (int(m[1]), m[2] == "<=", float(m[3]))))
            out.append((tuple(c for _, c in above), False, 0.0))
        elif m := re.search(r"Predict: (\S+)", line):
            out.append((rule, True, float(m[1])))
    return out


def holds(rule: Rule, features: list[Column]) -> Column:
    out = F.lit(True)
    for feature, low, threshold in rule:
        out &= features[feature] <= threshold if low else features[feature] > threshold
    return out


def vote(model, features: list[Column]) -> Column:
    """The share of a regression forest's trees, by leaf values, for the label 1."""
    total = F.lit(0.0)
    for tree in model.trees:
        leaves = [(r, p) for r, leaf, p in paths(tree) if leaf]
        value = F.lit(leaves[-1][1] if leaves else 0.0)
        for rule, p in leaves[:-1]:
            value = F.when(holds(rule, features), F.lit(p)).otherwise(value)
        total += value
    return total / len(model.trees)
