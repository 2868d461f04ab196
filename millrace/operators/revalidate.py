"""Validation after corrections, of the changed rows and of those whose groups they were in or came into.

A rule of a row needs the changed rows alone. A rule over groups needs the groups with a key that a changed row had or has: their rows, of which only the columns
of rules are taken, are judged again, and the issues of all others are carried over. The result is that of a validation of the whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.contract import Contract
from ..sources.checkpoint import cut
from . import rules
from .pipeline import Flat
from .rules import ISSUE

#: By rule over groups: its issue code and the key of its groups. Rows of one coverage have one member.
GROUPS = {
    "identity_conflicts": ("duplicate_member_id_conflicting_identity", "member_id"),
    "duplicate_coverage": ("duplicate_coverage_period", "member_id"),
    "plan_conflicts": ("plan_id_conflicting_attributes", "plan_id"),
}
SUBSCRIBERS = "subscriber_id_not_found"
#: Keys and row numbers that are broadcast at most, counted before.
FEW = 500_000


def _small(df: DataFrame) -> DataFrame:
    """Written once, and broadcast where it is small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= FEW else df


def _keys(frames: list[DataFrame], column: str, name: str) -> DataFrame:
    found = frames[0].select(F.col(column).alias(name))
    for f in frames[1:]:
        found = found.unionByName(f.select(F.col(column).alias(name)))
    return _small(found.where(F.col(name).isNotNull()).distinct())


def _with_key(rows: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    return rows.join(keys, F.col(column) == F.col(name), "left_semi")


def corrected(typed: DataFrame, changed: DataFrame) -> DataFrame:
    """typed with the changed rows in place of those with their numbers."""
    return typed.join(_small(changed.select("source_row_number")), "source_row_number", "left_anti").unionByName(changed.select(*typed.columns))


def revalidate(typed: DataFrame, issues: DataFrame, changed: DataFrame, contract: Contract, flat: Flat | None = None, asof: Column | None = None) -> DataFrame:
    """The issue table of the corrected file. typed and issues: the normalised frame and the issues before; changed: the corrected rows, normalised, with typed's columns and numbers that are in it.

    flat: of the corrected rows or of the file; its mappings name the source columns. Rows of the rules of a contract's own presets are found by their keys; fields that different mappings
    fill are compared over all rows again, as one row that differs marks all.
    """
    asof = F.current_date() if asof is None else asof
    changed = cut(changed.select(*typed.columns))
    numbers = _small(changed.select("source_row_number"))
    columns = ["source_row_number", *[f for f in contract.by_name if f in typed.columns]]
    old = cut(typed.join(numbers, "source_row_number", "left_semi").select(*columns))
    after = typed.select(*columns).join(numbers, "source_row_number", "left_anti").unionByName(changed.select(*columns))

    own = [GROUPS[p][0] for p in rules.set_presets(contract) if p in GROUPS] + [SUBSCRIBERS]
    kept = issues.where(~F.col("issue_code").isin(*own, rules.CLASH)).join(numbers, "source_row_number", "left_anti").select(*ISSUE)
    found = kept.unionByName(rules.own_issues(changed, contract, flat, asof))
    for preset in rules.set_presets(contract):
        if preset in GROUPS:
            code, key = GROUPS[preset]
            judged = cut(_with_key(after, key, _keys([old, changed], key, "_key"), "_key"))
            again, made = judged.select("source_row_number").union(numbers).distinct(), rules.SET_PRESETS[preset][1](judged)
        else:
            code = SUBSCRIBERS
            members = _keys([old, changed], "member_id", "_key")
            asked = cut(_with_key(after, "subscriber_id", members, "_key").unionByName(changed.select(*columns)).dropDuplicates(["source_row_number"]))
            known = _with_key(after, "member_id", _keys([asked], "subscriber_id", "_key"), "_key")
            again = asked.select("source_row_number")
            met = asked.unionByName(known).dropDuplicates(["source_row_number"])
            made = rules.missing_subscribers(met).join(again, "source_row_number", "left_semi")
        found = found.unionByName(issues.where(F.col("issue_code") == code).join(_small(again), "source_row_number", "left_anti").select(*ISSUE))
        found = found.unionByName(rules.with_sources(made, contract, flat).select(*ISSUE))
    if flat is not None:
        whole = corrected(typed, changed)
        found = found.unionByName(rules.clash_issues(whole, contract, flat))
    return found
