"""Engine output as variants: both shapes, what is malformed, and one parse for each payload."""

from pyspark.sql import functions as F

from pagewright.operators import detections as D

PAYLOADS = [
    (1, '{"rec_texts":["one line","two"],"rec_scores":[0.9,0.8],"dt_polys":[[[0,0],[40,0],[40,20],[0,20]],[[0,30],[40,30],[40,50],[0,50]]]}'),
    (2, '{"rec_texts":["a","b","c"],"rec_scores":[0.5,0.25],"rec_polys":[[[0,0],[40,0],[40,20],[0,20]],[[1,1],[2,2]],[[0,0],[9,9]]]}'),
    (3, '[[[[0,0],[40,0],[40,20],[0,20]],["legacy",0.75]],["bad"],[[[5,5],[60,5],[60,30],[5,30]],["more",0.5]]]'),
    (4, '{"rec_texts":[],"rec_scores":[],"dt_polys":[]}'),
    (5, "[]"),
    (6, "no json"), (7, None), (8, ""), (9, "3"), (10, '"text"'), (11, "null"), (12, "{}"), (13, '{"rec_texts":null,"rec_scores":[1],"dt_polys":[[[0,0],[40,40]]]}'),
    (14, '{"rec_texts":["late"],"rec_scores":["0.25"],"dt_polys":[],"rec_polys":[[[0.9,1.9],[40.9,41.1]]]}'),
    (15, '[["box"],{"a":1},3,null,[[[0,0],[40,40]],["short"]],[[[0,0],[40,40]],[7,1]],[[],["no box",1]],[[[0,0],[40,40]],["  ",1]],[[[0,0],[40,40]],["no number","x"]],[[[0,0],[40,40]],["text","1e-1"],5]]'),
]

EXPECTED = [
    (1, 1, "one line", 0.9, 0, 0, 40, 20), (1, 2, "two", 0.8, 0, 30, 40, 50), (2, 1, "a", 0.5, 0, 0, 40, 20), (3, 1, "legacy", 0.75, 0, 0, 40, 20), (3, 3, "more", 0.5, 5, 5, 60, 30),
    (14, 1, "late", 0.25, 0, 1, 40, 41), (15, 6, "7", 1.0, 0, 0, 40, 40), (15, 10, "text", 0.1, 0, 0, 40, 40),
]


def test_shapes(spark):
    rows = spark.createDataFrame(PAYLOADS, "id int, payload string")
    assert sorted(map(tuple, D.parse_engine_output(rows, ["id"]).collect())) == EXPECTED
    parsed = rows.withColumn("payload", F.try_parse_json("payload"))
    assert sorted(map(tuple, D.parse_engine_output(parsed, ["id"]).collect())) == EXPECTED


def test_parsed_once(spark):
    plan = D.parse_engine_output(spark.createDataFrame(PAYLOADS, "id int, payload string").repartition(2), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "get_json_object" not in plan and "from_json" not in plan, plan
