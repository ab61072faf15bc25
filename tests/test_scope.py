"""P9: what a user may see, against sets."""

from lattice.operators import reviews

USERS = [("Ann", True, None, "a"), ("bob", False, "[1, 2, 2]", "b"), ("cat", False, "[bad", "c"), ("dan", False, "[3, null]", "d"), ("eve", None, "[1]", "e"), ("fay", False, "[1]", "f"), ("fay", True, "[2]", "f")]
REPOS = [("r1", 1, "CAT"), ("r1", 2, "dan"), ("r2", 2, "Bob"), ("r3", 3, "DAN"), ("r4", None, "cat"), ("r4", None, "nobody")]


def _scope(spark, **more):
    users = spark.createDataFrame(USERS, "login string, is_admin boolean, installation_ids string, name string")
    return reviews.scope_repos(spark.createDataFrame(REPOS, "repo string, installation_id long, created_by string"), users, **more)


EXPECTED = sorted([*(("Ann", f"r{i}") for i in range(1, 5)), *(("fay", f"r{i}") for i in range(1, 5)), ("bob", "r1"), ("bob", "r2"), ("cat", "r1"), ("cat", "r4"), ("dan", "r1"), ("dan", "r3")])


def test_scope_has_each_pair_once(spark):
    assert sorted(map(tuple, _scope(spark).collect())) == EXPECTED
    assert sorted((r.login, r.name, r.repo) for r in _scope(spark, carry=("name",)).collect()) == [(x, x[0].lower(), r) for x, r in EXPECTED]


def test_scope_does_not_shuffle_its_result(spark):
    plan = _scope(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Deduplicate" not in plan


def test_pairs_meet_once_in_blocks_of_any_size(spark):
    from lattice.operators import retrieval

    a, b = spark.range(30).withColumnRenamed("id", "a"), spark.range(40).withColumnRenamed("id", "b")
    for size in (7, 65_536):
        assert sorted(map(tuple, retrieval.in_blocks(a, b, size=size).collect())) == [(i, j) for i in range(30) for j in range(40)]
