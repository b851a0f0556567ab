"""robots.txt: rules of each agent, and decisions by the longest match."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def robots_rules(text: str) -> list[tuple[str, str, str]]:
    """(agent, 'allow' or 'disallow', pattern) of a robots.txt, agents in lower case.

    Agents' lines in a row share the rules that follow; a blank line after a rule, or an agent after one, ends a group.
    Groups of the same agent add up. A rule without a pattern is none.
    """
    rules: list[tuple[str, str, str]] = []
    agents: list[str] = []
    open_group = True
    for line in text.splitlines():
        line = line.partition("#")[0].strip()
        name, colon, value = (x.strip() for x in line.partition(":"))
        if not line:
            agents = agents if open_group else []
            open_group = True
        elif colon and name.lower() == "user-agent":
            agents = agents if open_group else []
            open_group = True
            agents += [value.lower()] * bool(value)
        elif colon and name.lower() in ("allow", "disallow") and agents:
            open_group = False
            rules += [(a, name.lower(), value) for a in agents if value]
    return rules


def _decoded(path: str) -> str:
    return "%2F".join(unquote(p) for p in re.split("%2[Ff]", path))


def rule_pattern(pattern: str) -> str:
    """The regular expression of a rule: * stands for anything, $ at the end for the end."""
    body, end = (pattern[:-1], "$") if pattern.endswith("$") else (pattern, "")
    return "^" + ".*".join(re.escape(x) for x in _decoded(body).split("*")) + end


def robots_decisions(paths: DataFrame, agent: str, path: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The columns of paths and decision, matched_rule: the longest matching rule of the agent's group, else of '*'; Allow wins ties.

    The rules of one file are a short list, so they travel as a chain of conditions and paths aren't joined to
    anything. A path that no rule matches is allowed, with a null rule.
    """
    own = {a for a, _, _ in rules}
    kept = F.regexp_replace(F.regexp_replace(F.col(path), r"\+", "%2B"), "%2[Ff]", "%252F")
    rows = paths.withColumn("__path", F.when(F.col(path).contains("%"), F.coalesce(F.try_url_decode(kept), F.col(path))).otherwise(F.col(path)))
    group = F.when(F.lower(agent).isin(sorted(own)), F.lower(agent)).otherwise("*") if own else F.lit("*")
    ordered = sorted(rules, key=lambda r: (-len(_decoded(r[2])), r[1] != "allow", r[2]))
    hit = F.lit(None).cast("struct<decision:string,rule:string>")
    for a, kind, pattern in reversed(ordered):
        hit = F.when((group == a) & F.col("__path").rlike(rule_pattern(pattern)), F.struct(F.lit(kind).alias("decision"), F.lit(pattern).alias("rule"))).otherwise(hit)
    return rows.withColumn("__hit", hit).withColumns({"decision": F.coalesce("__hit.decision", F.lit("allow")), "matched_rule": F.col("__hit.rule")}).drop("__hit", "__path")
