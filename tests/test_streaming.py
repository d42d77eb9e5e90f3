"""The streaming chat session agrees with the batch operators."""

import os
import random
import tempfile

from touchline.operators import text as T
from touchline.sources.rules import adjustment_rules
from touchline.sources.testdata import messages
from touchline.streaming import chat


def test_stream_matches_batch(spark, sf):
    root = tempfile.mkdtemp(prefix="touchline-stream-")
    src = os.path.join(root, "in")
    handmade = spark.createDataFrame([
        (900001, 0, "rainy"), (900001, 1, "reset"), (900001, 2, "derby game"), (900001, 3, "windy too"),
        (900001, 4, "predict"), (900001, 5, "quit"), (900001, 6, "predict")], chat.MESSAGE_SCHEMA)
    msgs = messages(spark, sf).unionByName(handmade)
    # two files written in turn order, so the state has to carry over between
    # micro-batches (a conversation's turns arrive in order)
    msgs.where("turn < 3").coalesce(1).write.parquet(os.path.join(src, "a"))
    msgs.where("turn >= 3").coalesce(1).write.parquet(os.path.join(src, "b"))
    stream = spark.readStream.schema(chat.MESSAGE_SCHEMA).option("maxFilesPerTrigger", 1) \
        .parquet(os.path.join(src, "*"))
    q = (chat.session_multipliers(stream).writeStream.format("memory").queryName("chat_out")
         .outputMode("append").option("checkpointLocation", os.path.join(root, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.conv_id, r.predict_turn): (r.n_active, round(r.total_multiplier, 9))
           for r in spark.sql("SELECT * FROM chat_out").collect()}
    want = {(r.conv_id, r.predict_turn): (r.n_active, round(r.total_multiplier, 9))
            for r in T.total_multiplier(msgs, adjustment_rules(spark)).collect()}
    assert got == want
    assert got[(900001, 4)] == (2, round((1.2 * 1.15) ** 0.5, 9))


def test_turns_in_any_order_match_batch(spark):
    """Shuffled micro-batches, with repeats, give what the batch query gives."""
    rng = random.Random(3)
    texts = ["rainy", "reset", "derby game", "windy too", "predict", "predict", "nothing", "quit", "cold day"]
    rows = [(c, t, rng.choice(texts[:7] if rng.random() < 0.95 else texts)) for c in range(40) for t in range(rng.randint(1, 14))]
    parts = [[] for _ in range(4)]
    for r in rows:
        for k in {rng.randrange(4), rng.randrange(4)} if rng.random() < 0.3 else {rng.randrange(4)}:
            parts[k].append(r)
    root = tempfile.mkdtemp(prefix="touchline-stream-")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, chat.MESSAGE_SCHEMA).coalesce(1).write.parquet(os.path.join(root, "in", str(k)))
    stream = spark.readStream.schema(chat.MESSAGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(os.path.join(root, "in", "*"))
    q = (chat.session_multipliers(stream, any_order=True).writeStream.format("memory").queryName("chat_any")
         .outputMode("append").option("checkpointLocation", os.path.join(root, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = sorted((r.conv_id, r.predict_turn, r.n_active, round(r.total_multiplier, 9))
                 for r in spark.sql("SELECT * FROM chat_any").collect())
    want = sorted((r.conv_id, r.predict_turn, r.n_active, round(r.total_multiplier, 9)) for r in
                  T.total_multiplier(spark.createDataFrame(rows, chat.MESSAGE_SCHEMA), adjustment_rules(spark)).collect())
    assert got == want and len(want) > 50
