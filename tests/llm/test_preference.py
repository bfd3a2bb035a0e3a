"""Preference formatting."""

from cargoledger.llm import preference


def rows_of(df):
    return sorted((r["pair_id"], r["part"], r["turn"], r["role"], r["rendered"], r["trained"]) for r in df.collect())


def test_longest_common_prefix(spark):
    schema = "pair_id long, turn long, role string, text string, part string"
    chosen = [(1, 0, "system", "s", ""), (1, 1, "user", "q", ""), (1, 2, "assistant", "good", ""), (2, 0, "user", "same", ""), (3, 0, "user", "only chosen", "")]
    rejected = [(1, 0, "system", "s", ""), (1, 1, "user", "q", ""), (1, 2, "assistant", "bad", ""), (1, 3, "user", "why", ""), (2, 0, "user", "same", "")]
    chosen += [(None, 0, "user", "x", ""), (4, None, "user", "x", ""), (5, 0, None, None, ""), (5, 0, None, None, ""), (6, 0, "assistant", "b", ""), (6, 0, "assistant", "a", "")]
    found = rows_of(preference.preference_rows(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)))
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert found == [
        (1, "chosen", 2, "assistant", say("assistant", "good"), True),
        (1, "prompt", 0, "system", say("system", "s"), False),
        (1, "prompt", 1, "user", say("user", "q"), False),
        (1, "rejected", 2, "assistant", say("assistant", "bad"), True),
        (1, "rejected", 3, "user", say("user", "why"), False),
        (2, "prompt", 0, "user", say("user", "same"), False),
        (3, "chosen", 0, "user", say("user", "only chosen"), False),
        (5, "chosen", 0, "user", say("user", ""), False),
        (6, "chosen", 0, "assistant", say("assistant", "a"), True),
    ]


def test_swapped_replies(spark):
    turns = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "thanks"), (2, 0, "user", "q2"), (2, 1, "assistant", "a2"), (4, 0, "user", "q4")]
    chosen, rejected = preference.swapped_replies(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    second = [(2, 0, "user", "q2")]
    assert sorted(map(tuple, chosen.collect())) == [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), *second, (2, 1, "assistant", "a2")]
    assert sorted(map(tuple, rejected.collect())) == [(1, 0, "user", "q1"), (1, 1, "assistant", "a2"), *second, (2, 1, "assistant", "a1")]


def test_next_ids_at_every_distance(spark):
    ids = sorted({0, 1, 2, 9, 65_535, 65_536, 1 << 20, (1 << 20) + 5, 1 << 40, (1 << 40) + 70_000, (1 << 62) + 3, -1, -5, -(1 << 50)} | set(range(500, 900, 7)))
    table = spark.createDataFrame([(i,) for i in ids], "pair_id long")
    found = sorted((r["pair_id"], r["next_id"]) for r in preference.next_ids(table).collect())
    assert found == list(zip(ids, ids[1:] + ids[:1], strict=True))
    assert [tuple(r) for r in preference.next_ids(table.where("pair_id = 9")).collect()] == [(9, 9)]
    assert preference.next_ids(table.where("pair_id = 3")).count() == 0


def test_every_conversation_with_a_reply_is_formatted(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where("conv_id % 2 = 0")
    wanted = turns.where("role = 'assistant'").select("conv_id").distinct().count()
    rows = preference.preference_rows(*preference.swapped_replies(turns))
    assert wanted > 1 and rows.select("pair_id").distinct().count() == wanted


def test_a_very_long_conversation_and_no_rows(spark):
    long = spark.range(5000).selectExpr("1L AS pair_id", "id AS turn", "'user' AS role", "cast(id AS string) AS text")
    other = long.selectExpr("pair_id", "turn", "role", "if(turn = 4321, 'x', text) AS text")
    counts = preference.preference_rows(long, other).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in counts} == {"prompt": 4321, "chosen": 679, "rejected": 679}
    assert preference.preference_rows(long.where("turn < 0"), other.where("turn < 0")).count() == 0
