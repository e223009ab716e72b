"""Rules as a table: the labels of the compiled form, for any set, text and layout."""

import random

import pytest
from pyspark.sql import functions as F

from chatlens.functions.rules import RuleSet, default_topic_rules, tag_sql
from chatlens.operators import rule_table
from chatlens.operators.enrich import tag_texts
from chatlens.operators.rule_table import anchors, gram_counts, rule_rows, tag_by_table


def _texts(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def _compiled(df, rules):
    return {r[0]: r[1] for r in df.select("id", F.lower("text").alias("lt")).select("id", F.expr(tag_sql("lt", rules))).collect()}


def _by_table(df, table, **kw):
    return {r["id"]: r["topic"] for r in tag_by_table(df, table, **kw).select("id", "topic").collect()}


def _random_set(rng, rules, keywords, alphabet, longest):
    return RuleSet.of([(f"r{k}", ["".join(rng.choices(alphabet, k=rng.randint(1, longest))) for _ in range(keywords)]) for k in range(rules)])


@pytest.mark.parametrize("seed", range(3))
def test_same_labels_as_the_compiled_form(spark, seed):
    rng = random.Random(seed)
    alphabet = "abcdé ß\n𝒳İ'\\"
    rules = _random_set(rng, 6, 4, alphabet, 6)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(150)] + [None, "", "ABC", "A" * 20]
    df = _texts(spark, texts)
    assert _by_table(df, rule_rows(spark, rules)) == _compiled(df, rules)


def test_keywords_across_piece_borders(spark, monkeypatch):
    monkeypatch.setattr(rule_table, "PIECE", 5)
    rng = random.Random(9)
    rules = _random_set(rng, 8, 3, "abc", 9)
    df = _texts(spark, ["".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(200)])
    assert _by_table(df, rule_rows(spark, rules)) == _compiled(df, rules)


def test_five_thousand_keywords_and_one_plan_size(spark):
    rng = random.Random(4)
    vocabulary = sorted({"".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9))) for _ in range(6000)})
    rules = RuleSet.of([(f"rule {k}", vocabulary[k * 50:k * 50 + 50]) for k in range(100)])
    texts = [" ".join(rng.choices(vocabulary + ["zzzz", "yyyyy"] * 6000, k=8)) for _ in range(300)]
    expected = {}
    for i, t in enumerate(texts):  # by definition
        expected[i] = next((label for label, kws in rules.rules if any(k in t for k in kws)), rules.fallback)
    df = _texts(spark, texts)
    table = rule_rows(spark, rules)
    got = tag_by_table(df, table)
    assert {r["id"]: r["topic"] for r in got.collect()} == expected
    assert len(set(expected.values())) > 20
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    written = df.sparkSession.createDataFrame(table.limit(10).collect(), table.schema)
    assert abs(plan(got).count("\n") - plan(tag_by_table(df, written)).count("\n")) <= 2


def test_shuffled_beyond_the_broadcast_bound(spark, monkeypatch):
    df = _texts(spark, ["viết code python", "ngân sách", "x", None] * 5)
    rules = default_topic_rules()
    expected = _by_table(df, rule_rows(spark, rules))
    monkeypatch.setattr(rule_table, "BROADCAST_BYTES", 0)
    assert _by_table(df, rule_rows(spark, rules)) == expected == _compiled(df, rules)


def test_any_anchor_gives_the_same_labels(spark):
    rules = rule_rows(spark, RuleSet.of([("a", ["abcd", "xy"]), ("b", ["bcde", "q"])]))
    df = _texts(spark, ["abcde", "bcde", "q", "xyz", "abc abc abc bcd"])
    counts = gram_counts(df)
    held = {r["keyword"]: r["gram"] for r in anchors(rules, counts).collect()}
    assert held == {"abcd": "abc" if counts.where("gram = 'abc'").first()["n"] <= counts.where("gram = 'bcd'").first()["n"] else "bcd",
                    "bcde": "cde", "xy": "xy", "q": "q"}
    assert _by_table(df, rules, counts=counts) == _by_table(df, rules) == {0: "a", 1: "b", 2: "b", 3: "a", 4: "Khác"}


def test_edges_of_the_table(spark):
    schema = "rank int, label string, keyword string, text string"
    table = spark.createDataFrame([(2, "late", "ab", "x"), (1, None, "ab", "x"), (None, "n", "ab", "x"), (1, "n", None, "x"),
                                   (3, "b", "cd", "x"), (3, "a", "cd", "x"), (4, "rep", "AB", "x")], schema)
    df = _texts(spark, ["AB", "cd", "zz", None, "", "AB"])
    assert _by_table(df, table) == {0: "late", 1: "a", 2: "Khác", 3: "Khác", 4: "Khác", 5: "late"}
    every = table.unionByName(spark.createDataFrame([(9, "all", "", "x")], schema))
    assert _by_table(df, every) == {0: "late", 1: "a", 2: "all", 3: "Khác", 4: "all", 5: "late"}
    assert set(_by_table(df, table.limit(0)).values()) == {"Khác"}
    assert tag_by_table(df.limit(0), table).count() == 0


def test_keys_repeated_rows_and_clashing_columns(spark):
    rows = [(1, None, "ab", "old", 0), (1, None, "ab", "old", 0), (None, 2, "cd", "old", 1), (None, None, "zz", "old", 2)]
    df = spark.createDataFrame(rows, "a int, b int, text string, Topic string, rank int")
    table = spark.createDataFrame([(0, "x", "ab"), (1, "y", "cd")], "rank int, label string, keyword string")
    for key in (None, ["a", "b"]):
        got = tag_by_table(df, table, key=key)
        assert got.columns == ["a", "b", "text", "rank", "topic"]
        assert sorted((r["rank"], r["topic"]) for r in got.collect()) == [(0, "x"), (0, "x"), (1, "y"), (2, "Khác")]


def test_a_long_text_and_the_enriched_columns(spark):
    df = _texts(spark, ["lorem ipsum " * 60_000 + "needle", "needle", "lorem"])
    table = spark.createDataFrame([(0, "found", "NEEDLE")], "rank int, label string, keyword string")
    out = tag_texts(df, topic_rules=table)
    assert {r["id"]: r["topic"] for r in out.select("id", "topic").collect()} == {0: "found", 1: "found", 2: "Khác"}
    assert {"topic", "purpose", "prompt_quality", "word_count"} <= set(out.columns)


def test_the_side_joined_back_by_key_reads_no_text(spark, scratch_dir):
    _texts(spark, ["ab", "cd"]).write.parquet(f"{scratch_dir}/t")
    table = spark.createDataFrame([(0, "x", "ab")], "rank int, label string, keyword string")
    plan = tag_by_table(spark.read.parquet(f"{scratch_dir}/t"), table, key=["id"]).select("id", "topic")
    schemas = [line for line in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in line]
    assert len(schemas) == 2 and sum("text" in s.split("ReadSchema")[1] for s in schemas) == 1


def _rows_made(df, node):
    """(rows of all nodes whose name begins with ``node``) of the plan that ran."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            rows += p.metrics().apply("numOutputRows").value() if name.startswith(node) else 0
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows


def test_a_text_costs_its_words_of_the_keywords_lengths(spark):
    rng = random.Random(7)
    word = lambda low, high: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(low, high)))
    texts = [" ".join(word(8, 12) if k % 10 == 0 else word(1, 9) for k in range(700)) for _ in range(20)]
    rules = spark.createDataFrame([(k, f"r{k}", word(8, 12)) for k in range(50)] + [(50, "in", texts[3].split()[10][-8:])],
                                  "rank int, label string, keyword string")
    got = tag_by_table(_texts(spark, texts), rules)
    assert _rows_made(got, "Generate") < sum(map(len, texts)) / 5
    assert {r["id"] for r in got.collect() if r["topic"] == "in"} == {3}


@pytest.mark.parametrize("shortest", [3, 5, 8, 13])
@pytest.mark.parametrize("bound", [None, 0, 2500])
def test_long_keywords_of_words_and_gaps(spark, monkeypatch, shortest, bound):
    monkeypatch.setattr(rule_table, "PIECE", 17)
    if bound is not None:
        monkeypatch.setattr(rule_table, "BROADCAST_BYTES", bound)
    rng = random.Random(shortest)
    some = lambda low, high: "".join(rng.choices("ab𝒳 \n\t", [6, 6, 1, 2, 1, 1], k=rng.randint(low, high)))
    texts = [some(0, 90) for _ in range(150)] + ["a" * 50, " " * 30, "\n\n", None, ""]
    cut = [t[i:i + rng.randint(shortest, shortest + 8)] for t in texts[:12] for i in [rng.randint(0, 20)]]
    for words in ([k.replace(" ", "").replace("\n", "").replace("\t", "") + "b" * shortest for k in cut], cut, cut + ["  ", "\n\t", " "]):
        rules = RuleSet.of([(f"r{n}", [k]) for n, k in enumerate(k for k in words if k)])
        df = _texts(spark, texts)
        expected = _compiled(df, rules)
        assert _by_table(df, rule_rows(spark, rules)) == expected
    assert _by_table(df, rule_rows(spark, rules), counts=gram_counts(df)) == expected
    assert len(set(expected.values())) > 3


def test_anchors_in_a_row_meet_every_place_of_a_keyword(spark):
    rules = rule_rows(spark, RuleSet.of([("a", ["abcdefghij", "aaaaaaaa", "xy"])]))
    held = {}
    for r in anchors(rules, None, 5, 4).collect():
        held.setdefault(r["keyword"], set()).add(r["gram"])
    assert held == {"abcdefghij": {"abcde", "bcdef", "cdefg", "defgh"}, "aaaaaaaa": {"aaaaa"}, "xy": {"xy"}}
    df = _texts(spark, ["z" * k + "ABCDEFGHIJ" + "z" * (9 - k) for k in range(10)] + ["abcdefghi j"])
    long = rule_rows(spark, RuleSet.of([("a", ["abcdefghij"])]))
    assert _by_table(df, long) == {k: "a" for k in range(10)} | {10: "Khác"}
