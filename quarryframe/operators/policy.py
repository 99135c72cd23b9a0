"""Role policies: which collections, actions and columns a user may have. Denials win."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rule:
    resource: str
    actions: tuple[str, ...] = ("*",)
    effect: str = "allow"
    fields: tuple[str, ...] = ()


def matches(pattern: str, path: str) -> bool:
    """Segment by segment; * stands for one segment, and at the end for all that follow."""
    a, b = pattern.strip("/").split("/"), path.strip("/").split("/")
    if a[-1] == "*" and len(b) >= len(a):
        b = b[: len(a)]
    return len(a) == len(b) and all(x in ("*", y) for x, y in zip(a, b, strict=True))


def allowed(rules: list[Rule], resource: str, action: str) -> bool:
    mine = [r for r in rules if matches(r.resource, resource) and ("*" in r.actions or action in r.actions)]
    return any(r.effect == "allow" for r in mine) and not any(r.effect == "deny" for r in mine)


def visible(df: DataFrame, rules: list[Rule], resource: str, action: str = "read", key: str = "_id") -> DataFrame:
    """df with the columns that the rules let through; all of them if no rule that applies names columns."""
    if not allowed(rules, resource, action):
        raise PermissionError(f"{action} of {resource} isn't allowed")
    mine = [r for r in rules if r.effect == "allow" and matches(r.resource, resource) and ("*" in r.actions or action in r.actions)]
    if any(not r.fields for r in mine):
        return df
    names = {f for r in mine for f in r.fields} | {key}
    return df.select(*[c for c in df.columns if c in names])
