from pyspark.sql import functions as F

from skarn.operators import encode, usage

CHAT = "messages array<struct<role:string,content:string>>"


def encoded(spark, prompt, answer, max_len):
    df = spark.createDataFrame([(prompt, answer)], "p string, c string")
    return encode.encode(df, encode.code_points(F.col("p")), encode.code_points(F.col("c")), max_len).first()


def test_prompt_leaves_the_answer_out(spark):
    df = spark.createDataFrame([([("system", "s"), ("user", "u"), ("assistant", "x")],)], CHAT)
    assert df.select(encode.render_prompt(F.col("messages"))).first()[0] == "<|system|>s<|user|>u<|assistant|>"


def test_only_the_answer_is_supervised(spark):
    r = encoded(spark, "ab", '{"é":1}', 100)
    own = [x for x in r.labels if x != encode.IGNORE]
    assert "".join(map(chr, own[:-1])) == '{"é":1}' and own[-1] == encode.EOS and len(r.labels) == len(r.input_ids) == len(r.attention_mask)


def test_the_middle_goes(spark):
    r = encoded(spark, "HEAD" + "x" * 500 + "TAIL", "y" * 9, 120)
    said = "".join(map(chr, r.input_ids[:110]))
    assert r.truncated and len(r.input_ids) == 120 and said.startswith("HEAD") and said.endswith("TAIL")


def test_a_target_that_cannot_fit(spark):
    r = encoded(spark, "p", "y" * 200, 50)
    assert not r.fits and r.input_ids is None


def test_padding(spark):
    df = spark.createDataFrame([(i, "p" * (i % 13), "c") for i in range(40)], "id int, p string, c string").repartition(5)
    e = encode.encode(df, encode.code_points(F.col("p")), encode.code_points(F.col("c")), 64).select("id", "input_ids", "labels", "attention_mask")
    rows = sorted(encode.pad_batches(e, ["id"], 8).collect(), key=lambda r: r["id"])
    assert [r["batch"] for r in rows] == [i // 8 for i in range(40)]
    for r in rows:
        pad = len(r.attention_mask) - sum(r.attention_mask)
        assert r.width % 8 == 0 and len(r.input_ids) == len(r.labels) == r.width
        assert pad == 0 or (set(r.labels[-pad:]) == {-100} and set(r.input_ids[-pad:]) == {0})


def test_lengths_follow_the_index_rule(spark):
    df = spark.createDataFrame([(i, 1) for i in [5, 1, 9, 9, 3, 7, 2, 8, 6, 4]], "t int, c int")
    r = encode.length_distribution(df, "t", "c").first()
    s = sorted([5, 1, 9, 9, 3, 7, 2, 8, 6, 4])
    assert (r.median, r.p90, r.p99, r.max) == (5.5, s[9], s[9], 9)


def test_costs(spark):
    ddl = "model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long"
    rows = [("a", 1_000_000, 1_000_000, None, None), ("b", 0, 0, 1_000_000, 0), ("c", 1, 1, 1, 1)]
    prices = spark.createDataFrame([("a", 1.0, 5.0), ("b", 1.0, 5.0)], "model string, in_rate double, out_rate double")
    got = {r["model"]: r["cost_usd"] for r in usage.usage_cost(spark.createDataFrame(rows, ddl), prices).collect()}
    assert got == {"a": 6.0, "b": 0.1, "c": None}
    stats = spark.createDataFrame([(0, 0), (1_000_000, 500_000)], "input_tokens long, output_tokens long")
    assert [r["cost_usd"] for r in usage.run_cost(stats, 2.0, 10.0).collect()] == [None, 7.0]
