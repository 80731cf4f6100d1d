"""Many detection rules at once: an event meets only the rules that a value of its own leads to.

A rule's selection is an and of fields, each with one or more values. Field and value are an atom; a rule is kept under the
atoms of one of its fields, the one with most different values among all rules, so that an atom leads to few of them. An event's
atoms are looked up there by a hash join, and what else a rule found so asks for is checked against the event's atoms. No predicate is
worked out a rule, and rules with one window share one aggregation, whatever they count and by which key.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewatch.functions.columns import FIELD_ALIASES, resolve_field
from lodewatch.operators.detect import Rule

#: Entries of the index up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_ENTRIES = 200_000
#: What every event holds, for rules that select everything.
ALL = "*"


def _name(field: str) -> str:
    """One name for all aliases of a field."""
    known = field.strip().lower()
    return FIELD_ALIASES.get(known, "bytes_out" if known == "bytes_out" else "?")


def _atom(name: Column | str, text: Column, number: Column) -> tuple[Column, Column, Column]:
    """The atoms of a value as text, as a number, and of none; -0 is 0."""
    start = F.lit(name) if isinstance(name, str) else name
    return F.concat(start, F.lit("=t"), F.lower(F.trim(text))), F.concat(start, F.lit("=n"), (number + F.lit(0.0)).cast("string")), F.concat(start, F.lit("=0"))


def _event_atoms(kinds: dict[str, set[str]], columns: dict[str, Column], every: bool) -> Column:
    """The atoms of an event of the kinds (t, n, 0) that each name's rules ask for; every: with what all events hold."""
    out = [F.lit(ALL)] if every else []
    for name in sorted(kinds):
        text = columns[name].cast("string")
        atoms = dict(zip("tn0", _atom(name, text, text.try_cast("double"))))
        atoms["0"] = F.when(text.isNull(), atoms["0"])
        out += [atoms[k] for k in "tn0" if k in kinds[name]]
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def _rule_rows(rules: list[Rule]) -> list[tuple]:
    """(rule, field, kind, text, number, fields of the rule): a row for each value of each field."""
    rows = []
    for i, r in enumerate(rules):
        by_name: dict[int, tuple[str, list]] = {k: (_name(f), v if isinstance(v, list) else [v]) for k, (f, v) in enumerate((r.selection or {}).items())}
        for k, (name, values) in by_name.items():
            for v in values:
                if v is None:
                    rows.append((i, k, name, "0", None, None, len(by_name)))
                elif isinstance(v, (int, float)) and not isinstance(v, bool):
                    rows.append((i, k, name, "n", None, float(v), len(by_name)))
                else:
                    rows.append((i, k, name, "t", str(v).lower() if isinstance(v, bool) else str(v).strip(), None, len(by_name)))
            if not values:  # nothing fits
                rows.append((i, k, name, "-", None, None, len(by_name)))
    return rows


def _anchors(rows: list[tuple]) -> dict[int, int]:
    """The field of each rule under which it is kept."""
    different = defaultdict(set)
    for _, _, name, kind, text, number, _ in rows:
        different[name].add((kind, text, number))
    best: dict[int, tuple[int, int]] = {}
    for i, k, name, *_ in rows:
        best[i] = max(best.get(i, (-1, -1)), (len(different[name]), -k))
    return {i: -k for i, (_, k) in best.items()}


def rule_index(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """(atom, rule, rest): the rules under their atoms; rest: for each other field, the atoms of which an event must hold one."""
    spark, rows = events.sparkSession, _rule_rows(rules)
    at = _anchors(rows)
    table = spark.createDataFrame([(*r, at[r[0]] == r[1]) for r in rows], "rule int, field int, name string, kind string, text string, number double, fields int, anchor boolean")
    t, n, none = _atom(F.col("name"), F.col("text"), F.col("number"))
    atoms = table.withColumn("atom", F.when(F.col("kind") == "t", t).when(F.col("kind") == "n", n).when(F.col("kind") == "0", none))
    rest = atoms.where("not anchor").groupBy("rule", "field").agg(F.collect_set("atom").alias("any")).groupBy("rule").agg(F.collect_list("any").alias("rest"))
    kept = atoms.where("anchor and atom is not null").select("atom", "rule").distinct().join(rest, "rule", "left")
    free = [(ALL, i, None) for i, r in enumerate(rules) if not r.selection]
    kept = kept.select("atom", "rule", "rest").unionByName(spark.createDataFrame(free, "atom string, rule int, rest array<array<string>>"))
    return kept.withColumn("rest", F.coalesce("rest", F.array().cast("array<array<string>>")))


def matching(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """(tenant_id, time, rule, values): each event with each rule whose selection it meets; values: the rules' fields as text, in the order of _names()."""
    names, rows = _names(rules), _rule_rows(rules)
    columns = {n: resolve_field("bytes_out" if n == "bytes_out" else next((a for a, path in FIELD_ALIASES.items() if path == n), n), flat=True).cast("string") for n in names}
    at = _anchors(rows)
    look_up, others = defaultdict(set), defaultdict(set)
    for i, k, name, kind, *_ in rows:
        (look_up if at[i] == k else others)[name].add(kind)
    kept = {n: F.col("values")[k] for k, n in enumerate(names)}
    own = events.select("tenant_id", "time", F.array(*(columns[n] for n in names)).alias("values"), F.explode(_event_atoms(look_up, columns, any(not r.selection for r in rules))).alias("atom"))
    small = sum(len(r.selection) + sum(len(v) for v in r.selection.values() if isinstance(v, list)) + 1 for r in rules) <= BROADCAST_ENTRIES
    index = rule_index(events, rules)
    found = own.join(F.broadcast(index) if small else index, "atom").withColumn("atoms", _event_atoms(others, kept, False))
    return found.where(F.forall("rest", lambda some: F.arrays_overlap("atoms", some))).select("tenant_id", "time", "rule", "values")


def _names(rules: list[Rule]) -> list[str]:
    used = {_name(f) for r in rules for f in r.selection} | {_name(r.by) for r in rules} | {_name(r.of) for r in rules if r.of not in ("", "*")}
    return sorted(used)


def run_many_rules(events: DataFrame, rules: list[Rule], exact: bool = True) -> DataFrame:
    """(rule_id, tenant_id, window_start, window_end, key, value) as run_rules() gives it, for any number of rules.

    Sums are of numbers with six places after the point.
    """
    specs = list(dict.fromkeys((r.window_type, r.size, r.slide) for r in rules))
    # windows that don't overlap are worked out side by side on one matching; of the others, each kind has one of its own
    plain_specs = [s for s in specs if s[0] not in ("sliding", "session")]
    parts = [_counted(events, [r for r in rules if (r.window_type, r.size, r.slide) in group], exact) for group in ([plain_specs] if plain_specs else []) + [[s] for s in specs if s not in plain_specs]]
    found = reduce(DataFrame.unionByName, parts).where("value > above")
    return found.select("rule_id", "tenant_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", "value")


def _counted(events: DataFrame, rules: list[Rule], exact: bool) -> DataFrame:
    """(rule, rule_id, above, tenant_id, w, key, value) of rules with one window, or with any that don't overlap: all in one aggregation."""
    place = {n: k for k, n in enumerate(_names(rules))}
    windows = list({(r.window_type, r.size, r.slide): r.window() for r in rules}.items())
    kinds = [s for s, _ in windows]
    about = [(i, r.id, r.function, place[_name(r.by)], None if r.of in ("", "*") else place[_name(r.of)], r.above, kinds.index((r.window_type, r.size, r.slide))) for i, r in enumerate(rules)]
    about = events.sparkSession.createDataFrame(about, "rule int, rule_id string, function string, by_place int, of_place int, above long, kind int")
    rows = matching(events, rules).join(F.broadcast(about) if len(rules) <= BROADCAST_ENTRIES else about, "rule")
    rows = rows.select("tenant_id", "time", "rule_id", "rule", "function", "above", "kind", F.get("values", F.col("by_place")).alias("key"), F.col("of_place").isNull().alias("all"), F.get("values", F.col("of_place")).alias("of"))
    if len(windows) > 1:
        for k, (_, w) in enumerate(windows):
            rows = rows.withColumn(f"w{k}", w)
        rows = rows.withColumn("w", F.element_at(F.array(*(F.col(f"w{k}") for k in range(len(windows)))), F.col("kind") + 1))
    different = F.when(F.col("function") == "dcount", F.col("of"))
    value = F.when(F.first("function") == "dcount", F.count_distinct(different) if exact else F.approx_count_distinct(different)).when(
        F.first("function") == "sum", F.coalesce(F.sum(F.when(F.col("function") == "sum", F.col("of").try_cast("decimal(38,6)"))), F.lit(0)).cast("long")
    )
    value = value.otherwise(F.count_if(F.col("all") | F.col("of").isNotNull()))
    by = ["rule", "rule_id", "above", "tenant_id", F.col("w") if len(windows) > 1 else windows[0][1].alias("w"), "key"]
    return rows.groupBy(*by).agg(value.cast("long").alias("value"))
