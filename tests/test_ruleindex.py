"""The rule index against rules run one by one."""

import random

from pyspark.sql import functions as F

from lodewatch.operators import detect, ruleindex
from lodewatch.sources import views


def rules(n):
    r, out = random.Random(7), []
    values = {"user": ["user-1", " USER-2", "user-3", None], "severity": [1, 2.0, "3", 4], "class_uid": [3002, 4001], "outcome": ["success", "failure", True], "src_ip": ["10.0.1.5", "10.0.2.6"], "nothing": ["x", None], "bytes_out": [0, 1.5]}
    for i in range(n):
        fields = r.sample(sorted(values), r.randrange(0, 4))
        selection = {f: r.choice(values[f]) if r.random() < 0.6 else r.sample(values[f], r.randrange(0, 3) % (len(values[f]) + 1)) for f in fields}
        function, of = r.choice([("count", "*"), ("count", "dst_port"), ("dcount", "source_ip"), ("sum", "bytes_out"), ("sum", "user")])
        function, of = ("count", "user") if (function, of) == ("sum", "user") else (function, of)
        kind = r.choice(["tumbling", "sliding", "session"])
        out.append(detect.Rule(f"r{i}", "t", selection, function, of, r.choice(["tenant_id", "user", "dest_port", "unknown"]), r.randrange(0, 6), kind, r.choice(["6 hours", "1 days"]), "3 hours" if kind == "sliding" else None))
    return out


def test_the_index_gives_what_each_rule_gives(spark, sf):
    e = views.flat_events(spark, sf).withColumn("actor_user", F.when(F.col("uuid").cast("long") % 5 > 0, F.col("actor_user")))
    own = rules(40)
    want = sorted(map(str, detect.run_rules(e, own).collect()))
    assert sorted(map(str, ruleindex.run_many_rules(e, own).collect())) == want and len({x.split("'")[1] for x in want}) > 10


def test_the_plan_does_not_grow_with_the_rules(spark, sf):
    e = views.flat_events(spark, sf)
    many = lambda n: [detect.Rule(f"r{i}", "t", {"user": f"user-{i}", "outcome": "failure"}, above=0, size="1 hours") for i in range(n)]
    size = lambda n: len(ruleindex.run_many_rules(e, many(n))._jdf.queryExecution().optimizedPlan().toString())
    assert size(1000) < 1.5 * size(10)
    met = ruleindex.matching(e, many(1000))
    users = e.where("outcome = 'failure'").count()
    assert met.count() == users  # an event meets its own user's rule and no other
