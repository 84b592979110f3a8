"""Names of many namesakes: work that must not grow with the square of a group."""

from pyspark.sql import functions as F

from korvane.operators import slots


def most_rows(df) -> int:
    """Rows of the largest step of the executed plan."""
    df.collect()

    def rows(node) -> int:
        if node.nodeName() == "AdaptiveSparkPlan":
            return rows(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return rows(node.plan())
        at, kids = node.metrics().get("numOutputRows"), node.children()
        return max([at.get().value() if at.isDefined() else 0, *(rows(kids.apply(i)) for i in range(kids.size()))])

    return rows(df._jdf.queryExecution().executedPlan())


def test_namesakes_meet_no_askers(spark):
    folk = spark.range(600).select(F.col("id").alias("person"), F.lit("Carla Mendez").alias("name"), (F.col("id") % 2).alias("org")).unionByName(spark.createDataFrame([(900, "Carla Mendec", 5), (900, "Carla Mendec", 6), (None, "Una Null", 5)], "person long, name string, org long"))
    orgs = spark.createDataFrame([(0, "Physics"), (1, "History"), (5, "Law"), (6, "Law"), (7, None)], "org long, org_name string")
    asked = spark.range(500).select("id", F.lit("carla mendes").alias("name"), F.lit("the one in law please").alias("message")).unionByName(
        spark.createDataFrame([(1000, "carla mendec", None), (1001, "mendez", "x"), (1002, None, "x"), (1003, "una null", "x"), (1004, "carla mendes", "in physics now"), (1005, "carla mendes", None), (1005, "carla mendes", None)], "id long, name string, message string"))
    out = slots.person_slots(asked, folk, orgs, margin=9.0)
    got = [tuple(r) for r in out.collect()]
    told = {r[0]: r[1:] for r in got}
    assert len(got) == 507 and all(told[i] == ("ok", 900, "fuzzy", None) for i in range(500))
    many = ("ambiguous", None, None, "0,1,2,3,4")
    assert told[1000] == ("ok", 900, "exact", None) and told[1001] == many and told[1002] == ("none", None, None, None)
    assert told[1003] == ("ambiguous", None, None, "") and told[1004] == many and told[1005] == many
    assert most_rows(out) < 5000  # 300,000 when every asker met every namesake
