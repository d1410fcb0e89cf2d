from sessionloom.operators import recall


def test_one_turn_after_the_other():
    hot, durable = {}, {}
    recall.remember(hot, durable, 1, [("files", "a"), ("cmds", "pytest"), ("facts", "a:1"), ("questions", "why")])
    assert hot["files", "a"] == [2, 1] and durable == {("facts", "a:1"): [1, 1], ("questions", "why"): [1, 1]}
    recall.remember(hot, durable, 2, [("files", "a"), ("facts", "a:2")])
    assert hot["files", "a"] == [4, 2] and ("files", "a") in durable  # 4 >= 3
    assert ("facts", "a:1") not in hot and ("facts", "a:2") in durable and ("facts", "a:1") not in durable  # said otherwise
    assert ("cmds", "pytest") not in hot  # loses 2 a turn
    recall.remember(hot, durable, 9, [])
    assert ("questions", "why") not in hot and ("facts", "a:2") in hot  # questions age out, facts stay
    recall.remember(hot, durable, 10, [("files", f"f{i:02}") for i in range(40)])
    assert sum(f == "files" for f, _ in hot) == recall.HELD["files"]


def test_folds_over_frames(spark, rows):
    schema = "session_id string, turn int, pos int, part int, field string, value string"
    said = spark.createDataFrame([("s", 1, 0, 0, "files", "a/b.py"), ("s", 2, 0, 0, "files", "a/b.py"), ("s", 2, 1, 0, "files", "x"), ("t", 1, 0, 0, "files", "c.py"), (None, 1, 0, 0, "files", "n")], schema)
    got = {(r.session_id, r.bucket, r.value): r.score for r in recall.memories(said).collect()}
    assert got == {("s", "hot", "a/b.py"): 4, ("s", "hot", "x"): 2, ("s", "durable", "a/b.py"): 1, ("t", "hot", "c.py"): 2}
    assert [tuple(r)[4:] for r in recall.aliases(said).filter("session_id = 's'").orderBy("turn", "pos").collect()] == [("a/b.py", "*A", None), ("a/b.py", "*A", None), ("x", "x", None)]
    many = spark.createDataFrame([("s", i, 0, 0, "files", f"value{i % 60}") for i in range(70)], schema)
    assert recall.aliases(many).filter("evicted is not null").count() == 18  # 8 at first, then each of the ten that come back
    facts = spark.createDataFrame([("s", t, "k", v) for t, v in [(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "a"), (6, "a"), (7, "b"), (20, "b")]], "session_id string, turn int, key string, value string")
    assert [(r.stage, r.tier, r.changed) for r in recall.tiers(facts).orderBy("turn").collect()][-3:] == [(3, "permanent", False), (0, "hot", True), (3, "permanent", False)]
    assert recall.memories(said.limit(0)).isEmpty() and recall.aliases(said.limit(0)).isEmpty()
