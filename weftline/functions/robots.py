"""robots.txt: which group applies, which rule decides, when a host's next request may start."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .udfs import arrow


def applicable(text: str | None, agent: str) -> tuple[list[tuple[str, str]], float | None]:
    """(rules, crawl delay) of the group whose agent name is the longest one within ours, else of ``*``."""
    groups: list[dict] = []
    naming = False
    for raw in re.split(r"\r?\n", text or ""):
        m = re.fullmatch(r"([A-Za-z-]+)\s*:\s*(.*)", raw.partition("#")[0].strip())
        if not m:
            continue
        key, value = m[1].lower(), m[2].strip()
        if key == "user-agent":
            if not naming:
                groups.append({"agents": [], "rules": [], "delay": None})
            groups[-1]["agents"].append(value.lower())
            naming = True
            continue
        naming = False
        if not groups:
            continue
        if key in ("allow", "disallow"):
            groups[-1]["rules"].append((key, value))
        elif key == "crawl-delay" and re.fullmatch(r"[0-9]*\.?[0-9]+", value) and float(value) > 0:
            groups[-1]["delay"] = float(value)
    ranked = [
        (-1 if a == "*" else len(a), -i, g)
        for i, g in enumerate(groups)
        for a in g["agents"]
        if a == "*" or (a and a in agent.lower())
    ]
    if not ranked:
        return [], None
    best = max(ranked, key=lambda r: r[0] if r[0] >= 0 else -1)
    if best[0] < 0:  # of several groups for all, the last one
        best = max(ranked, key=lambda r: -r[1])
    return best[2]["rules"], best[2]["delay"]


def rule_pattern(path: str) -> str:
    """A rule's path as a regular expression: * for anything, $ for the end."""
    end = path.endswith("$")
    body = path[:-1] if end else path
    return "^" + r"[\s\S]*".join(re.escape(p) for p in body.split("*")) + ("$" if end else "")


def rules_of(text: Column, agent: str) -> Column:
    @arrow("array<struct<type:string,path:string,pattern:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"type": k, "path": p, "pattern": rule_pattern(p)} for k, p in applicable(t, agent)[0] if p], na_action=None)

    return run(text)


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, origin, path) with ``allowed``: the longest rule that fits decides, Allow in a tie. rules: origin, rules."""
    each = urls.join(rules, "origin", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<struct<type:string,path:string,pattern:string>>")))
    fit = F.filter("rules", lambda r: F.regexp(F.col("path"), r["pattern"]))
    best = F.array_max(F.transform(fit, lambda r: F.struct(F.length(r["path"]).alias("n"), (r["type"] == "allow").alias("allow"))))
    return each.select("url", "origin", "path", F.coalesce(best["allow"], F.lit(True)).alias("allowed"))


def pacing(arrivals: DataFrame) -> DataFrame:
    """arrivals (host, i, arrival_ms, delay_ms) with start_ms: no two starts of a host are closer than its delay.

    start(i) = max over j <= i of arrival(j) + (i - j) * delay, a running maximum.
    """
    w = W.partitionBy("host").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    n = F.row_number().over(W.partitionBy("host").orderBy("i")) - 1
    a = arrivals.withColumn("n", n).withColumn("lead", F.col("arrival_ms") - F.col("n") * F.col("delay_ms"))
    start = F.max("lead").over(w) + F.col("n") * F.col("delay_ms")
    return a.withColumn("start_ms", F.when(F.col("delay_ms") > 0, start).otherwise(F.col("arrival_ms"))).drop("n", "lead")
