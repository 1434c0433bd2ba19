"""robots.txt: parsing, decisions and delays (SRC-4, DF-10, DF-11, AG-1, FN-18 to FN-20).

Python turns a body into groups of rules once per site; which rule an url meets is decided by array functions in the JVM.
"""

from __future__ import annotations

import math
from urllib.parse import quote, unquote, urlparse, urlunparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.config import DEFAULT, Settings
from siteloom.functions.urls import robots_base, robots_path
from siteloom.schemas import ROBOTS

_RULE = pa.struct([("path", pa.string()), ("allow", pa.bool_())])
_TYPE = pa.struct([
    ("delay", pa.float64()), ("sitemaps", pa.list_(pa.string())),
    ("entries", pa.list_(pa.struct([("agents", pa.list_(pa.string())), ("rules", pa.list_(_RULE))]))),
    ("default_rules", pa.list_(_RULE)), ("complete", pa.bool_()),
])


class _Groups:
    """Agents and rules of a body as they come in; a group is kept once it is closed and has rules."""

    def __init__(self):
        self.entries: list[dict] = []
        self.default: list[dict] | None = None
        self.agents: list[str] = []
        self.rules: list[dict] = []

    def close(self) -> None:
        if self.agents and self.rules:
            if "*" in self.agents:
                # Of several groups for all agents the first is the default.
                self.default = self.rules if self.default is None else self.default
            else:
                self.entries.append({"agents": self.agents, "rules": self.rules})
        self.agents, self.rules = [], []

    def agent(self, name: str) -> None:
        if self.rules:
            self.close()
        self.agents.append(name)

    def rule(self, path: str, allow: bool) -> None:
        if self.agents:
            self.rules.append({"path": quote(urlunparse(urlparse(path))), "allow": allow or path == ""})


def parse_body(body: str, floor: float) -> dict:
    """DF-10. complete is False where a delay that is no number ended the parse; the groups closed by then count."""
    groups, sitemaps, delay = _Groups(), [], floor
    complete = True
    for raw in body.splitlines():
        if raw == "":
            groups.close()
            continue
        key, colon, value = raw.partition("#")[0].strip().partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), unquote(value.strip())
        if key == "user-agent":
            groups.agent(value)
        elif key in ("disallow", "allow"):
            groups.rule(value, key == "allow")
        elif key == "sitemap":
            sitemaps.append(value)
        elif key.startswith("crawl-delay"):
            try:
                asked = float(value)
            except ValueError:
                complete = False
                break
            delay = asked if asked > delay and not math.isnan(asked) else delay
    if complete:
        groups.close()
    return {"delay": delay, "sitemaps": sitemaps, "entries": groups.entries, "default_rules": groups.default, "complete": complete}


def parse(body: Column, settings: Settings = DEFAULT) -> Column:
    """struct<delay,sitemaps,entries,default_rules,complete>; null body gives null."""
    floor = float(settings.crawl_delay)

    @F.arrow_udf(ROBOTS)
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if x is None else parse_body(x, floor) for x in col.to_pylist()], _TYPE)

    return run(body)


def read_robots(docs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """SRC-4: (base, status, body) to (base, verdict, robots). verdict: all, none, rules, or null where nothing was read (a denial)."""
    status = F.col("status")
    verdict = F.when(status.isin(401, 403), "none").when((status >= 400) & (status < 500), "all").when((status >= 200) & (status < 300) & F.col("body").isNotNull(), "rules")
    return docs.withColumn("verdict", verdict).withColumn("robots", F.when(F.col("verdict") == "rules", parse(F.col("body"), settings))).select("base", "verdict", "robots")


def _allowance(rules: Column, path: Column) -> Column:
    """The first rule that is a prefix decides; without one the answer is yes."""
    return F.coalesce(F.get(F.filter(rules, lambda r: path.startswith(r["path"])), F.lit(0))["allow"], F.lit(True))


def allowed(verdict: Column, robots: Column, path: Column, settings: Settings = DEFAULT) -> Column:
    """DF-11: the first group that names the agent, else the default group, else yes."""
    agent = F.lit(settings.user_agent.split("/")[0].lower())
    mine = F.get(F.filter(robots["entries"], lambda e: F.exists(e["agents"], lambda a: F.contains(agent, F.lower(a)))), F.lit(0))
    by_rules = F.when(mine.isNotNull(), _allowance(mine["rules"], path)).when(robots["default_rules"].isNotNull(), _allowance(robots["default_rules"], path)).otherwise(F.lit(True))
    return F.when(verdict == "none", False).when(verdict == "all", True).when(verdict == "rules", by_rules).otherwise(F.lit(False))


def can_fetch(urls: DataFrame, robots: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """urls (base, url) with allowed. A site without a row is denied."""
    joined = urls.withColumn("_path", robots_path(F.col("url"))).join(robots, "base", "left")
    return joined.withColumn("allowed", allowed(F.col("verdict"), F.col("robots"), F.col("_path"), settings)).select(*urls.columns, "allowed")


def delays(robots: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """AG-1: seconds between two fetches of a site."""
    return robots.select("base", F.coalesce(F.col("robots.delay"), F.lit(float(settings.crawl_delay))).alias("delay"))


def sitemap_roots(robots: DataFrame, intent: bool = False) -> DataFrame:
    """(base, seq, url) of each Sitemap line; base as FN-20 strips it."""
    at = F.concat("base", F.lit("/robots.txt"))
    return robots.select("base", robots_base(at, intent).alias("sitemap_base"), F.posexplode("robots.sitemaps").alias("seq", "url"))
