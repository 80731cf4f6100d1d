"""Detection rules: selection, window, aggregate by a key, threshold, alert."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewatch.functions.columns import LEVELS, resolve_field, selection_predicate
from lodewatch.functions.times import timeframe

RULES = Path(__file__).resolve().parent.parent / "rules"
_CONDITION = re.compile(r"(count|dcount|sum)\s*\(\s*([\w.*]*)\s*\)(?:\s+by\s+([\w.]+))?\s*>\s*(\d+)", re.IGNORECASE)


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    selection: dict = field(default_factory=dict)
    function: str = "count"
    of: str = "*"
    by: str = "tenant_id"
    above: int = 5
    window_type: str = "tumbling"
    size: str = "5 minutes"
    slide: str | None = None
    level: str = "medium"
    description: str = ""

    def window(self, time: str = "time") -> Column:
        if self.window_type == "session":
            return F.session_window(time, self.size)
        return F.window(time, self.size, self.slide) if self.window_type == "sliding" else F.window(time, self.size)

    @property
    def spec(self) -> tuple:
        return self.window_type, self.size, self.slide, self.by


def parse_condition(text: str | None) -> dict:
    """`count|dcount|sum(field) by field > n`; what is missing has the defaults count, tenant_id, 5."""
    found = _CONDITION.search(text or "")
    if found:
        return {"function": found[1].lower(), "of": found[2] or "*", "by": found[3] or "tenant_id", "above": int(found[4])}
    n, by = re.search(r">\s*(\d+)", text or ""), re.search(r"\sby\s+([\w.]+)", text or "")
    return {"function": "count", "of": "*", "by": by[1] if by else "tenant_id", "above": int(n[1]) if n else 5}


def _half(interval: str) -> str:
    n, unit = interval.split()
    seconds = int(n) * {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}[unit]
    return f"{max(1, seconds // 2)} seconds"


def parse_rule(spec: dict) -> Rule:
    """A rule from its YAML mapping; title and detection are required."""
    if not spec.get("title") or not spec.get("detection"):
        raise ValueError("a rule needs a title and a detection")
    d = spec["detection"]
    condition = d.get("condition") or ""
    kind = str(d.get("window_type") or ("sliding" if "sliding" in condition else "session" if "session" in condition else "tumbling")).lower()
    kind = kind if kind in ("tumbling", "sliding", "session") else "tumbling"
    size = timeframe(d.get("timeframe"))
    if kind == "session":
        size = timeframe(d.get("session_gap") or d.get("gap") or d.get("inactivity_gap") or d.get("timeframe"))
    slide = None
    if kind == "sliding":
        given = d.get("slide_interval") or d.get("slide")
        slide = timeframe(given) if given else _half(size)
    return Rule(id=str(spec.get("id") or spec["title"]), title=spec["title"], selection=d.get("selection") or {}, window_type=kind, size=size, slide=slide, level=str(spec.get("level") or "medium"), description=spec.get("description") or "", **parse_condition(condition))


def load_rules(folder: str | Path = RULES) -> list[Rule]:
    """All rules of a folder. Rules are configuration: a few files, read by the driver."""
    import yaml

    return [parse_rule(yaml.safe_load(p.read_text(encoding="utf-8"))) for p in sorted(Path(folder).glob("*.yml"))]


def with_windows(rule: Rule, size: str, slide: str | None = None, above: int | None = None) -> Rule:
    return replace(rule, size=size, slide=slide if rule.window_type == "sliding" else None, above=rule.above if above is None else above)


def _value(rule: Rule, exact: bool) -> Column:
    chosen = selection_predicate(rule.selection, flat=True)
    if rule.function == "count":
        c = F.lit(1) if rule.of in ("", "*") else resolve_field(rule.of, flat=True)
        return F.count(F.when(chosen, c))
    c = F.when(chosen, resolve_field(rule.of, flat=True))
    if rule.function == "dcount":
        return F.count_distinct(c) if exact else F.approx_count_distinct(c)
    return F.coalesce(F.sum(c), F.lit(0))


def run_rules(events: DataFrame, rules: list[Rule], exact: bool = True) -> DataFrame:
    """(rule_id, tenant_id, window_start, window_end, key, value) over the threshold.

    Rules with one window and key share one aggregation, with a condition each. exact=False uses approximate distinct
    counts, as streams need.
    """
    out = None
    for spec in dict.fromkeys(r.spec for r in rules):
        own = [r for r in rules if r.spec == spec]
        chosen = selection_predicate(own[0].selection, flat=True)
        for r in own[1:]:
            chosen = chosen | selection_predicate(r.selection, flat=True)
        grouped = events.where(chosen).groupBy("tenant_id", own[0].window().alias("w"), resolve_field(own[0].by, flat=True).cast("string").alias("key"))
        wide = grouped.agg(*(_value(r, exact).cast("long").alias(f"v{i}") for i, r in enumerate(own)))
        values = F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.col(f"v{i}").alias("value"), F.lit(r.above).cast("long").alias("above")) for i, r in enumerate(own)))
        long = wide.select("tenant_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", F.explode(values).alias("x"))
        found = long.where("x.value > x.above").select("x.rule_id", "tenant_id", "window_start", "window_end", "key", "x.value")
        out = found if out is None else out.unionByName(found)
    return out


def count_by_source_ip(events: DataFrame, rule: Rule) -> DataFrame:
    """(tenant_id, window_start, window_end, most, total, sources, top): where a source address is over the threshold.

    top: the three addresses with most events, as structs (src_ip, n), ties by address. Counts stay rows until three are
    left, so a window with very many addresses is gathered nowhere.
    """
    each = events.where(selection_predicate(rule.selection, flat=True)).groupBy("tenant_id", rule.window().alias("w"), F.coalesce("src_ip", F.lit("unknown")).alias("src_ip")).agg(F.count("*").alias("n"))
    sums = each.groupBy("tenant_id", "w").agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("sources")).where(F.col("most") > rule.above)
    rank = F.row_number().over(Window.partitionBy("tenant_id", "w").orderBy(F.desc("n"), "src_ip"))
    first = each.withColumn("rank", rank).where("rank <= 3").groupBy("tenant_id", "w").agg(F.array_sort(F.collect_list(F.struct("rank", "src_ip", "n"))).alias("top"))
    return sums.join(first, ["tenant_id", "w"]).select("tenant_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "most", "total", "sources", "top")


def build_alerts(found: DataFrame, rule: Rule) -> DataFrame:
    """Alerts from count_by_source_ip: the id is a hash of rule, tenant and window, so a replay makes no second one.

    A rule without a description gets one from its counts.
    """
    top = F.concat_ws(", ", F.transform("top", lambda e: F.concat(e["src_ip"], F.lit(" ("), e["n"].cast("string"), F.lit(")"))))
    made = F.format_string(f"Detected pattern matching rule '{rule.title.replace('%', '%%')}'. Total events: %d, Unique sources: %d. Top contributors: %s.", "total", "sources", top)  # fixed wording
    return found.select(
        F.sha2(F.concat_ws("|", F.lit(rule.id), "tenant_id", F.col("window_start").cast("string")), 256).alias("id"),
        F.col("window_end").alias("time"), "tenant_id", F.lit(LEVELS.get(rule.level, 3)).alias("severity"), F.lit(rule.title).alias("title"), (F.lit(rule.description) if rule.description else made).alias("description"),
        F.lit(rule.id).alias("rule_id"), F.lit("open").alias("status"), "total", F.get("top", F.lit(0))["src_ip"].alias("top_contributor"), top.alias("top_contributors"),
    )


#: Port-scan variants as (name, ports, window).
SCAN_PATTERNS = (("fast", 100, "1 minute"), ("slow", 20, "30 minutes"), ("vertical", 1000, "1 minute"), ("horizontal", 500, "1 minute"))


def scan_patterns(events: DataFrame, patterns=SCAN_PATTERNS) -> DataFrame:
    """(pattern, tenant_id, src_ip, window_start, ports): one pass for each different window, all its thresholds together."""
    out = None
    for size in dict.fromkeys(p[2] for p in patterns):
        ports = events.where("class_uid = 4001").groupBy("tenant_id", "src_ip", F.window("time", size).alias("w")).agg(F.count_distinct("dst_port").alias("ports"))
        own = F.array(*(F.struct(F.lit(n).alias("pattern"), F.lit(k).alias("above")) for n, k, s in patterns if s == size))
        found = ports.select("tenant_id", "src_ip", F.col("w.start").alias("window_start"), "ports", F.explode(own).alias("p")).where("ports > p.above")
        found = found.select("p.pattern", "tenant_id", "src_ip", "window_start", "ports")
        out = found if out is None else out.unionByName(found)
    return out
