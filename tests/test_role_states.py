from textweave.operators import roles

SCHEMA = "few int, many long, gaps int, high int, name string, share double"


def rows(first, end):
    return [(i % 12 + 1, i, None if i == 3 else 1, 99, "x", 0.5) for i in range(first, end)]


def plain(df):
    return {r["column"]: (r["role"], r["values"]) for r in df.collect()}


def test_merged_states_give_the_roles_of_the_whole(spark):
    first, second = (spark.createDataFrame(rows(*r), SCHEMA) for r in ((0, 5), (5, 300)))
    whole = first.unionByName(second)
    merged = roles.merge_role_states(roles.role_state(first), roles.role_state(second))
    found = plain(roles.roles_of_state(merged, whole))
    assert found == plain(roles.column_roles(whole))
    assert found["few"] == ("discrete", sorted(map(str, range(1, 13))))
    assert found["many"][0] == found["gaps"][0] == found["high"][0] == "continuous"


def test_thirteenth_value_in_a_later_batch(spark):
    first = spark.createDataFrame([(i,) for i in range(1, 13)] * 3, "v int")
    second = spark.createDataFrame([(13,)], "v int")
    assert plain(roles.roles_of_state(roles.role_state(first), first))["v"][0] == "discrete"
    merged = roles.merge_role_states(roles.role_state(first), roles.role_state(second))
    assert plain(roles.roles_of_state(merged, first.unionByName(second)))["v"] == ("continuous", None)


def test_empty_tables_and_no_whole_columns(spark):
    empty = spark.createDataFrame([], "v int, name string")
    assert plain(roles.roles_of_state(roles.role_state(empty), empty)) == plain(roles.column_roles(empty))
    words = spark.createDataFrame([("a",)], "name string")
    assert plain(roles.roles_of_state(roles.role_state(words), words)) == {"name": ("meta", None)}
