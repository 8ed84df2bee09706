import json
import sys
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from warraq.functions import tools
from warraq.sources import readers as R
from warraq.sources import writers as W
from warraq.streaming import windows as S


def test_manifest_round_trip_and_guards(spark, tmp_path):
    df = spark.createDataFrame([("a.wav", "x y"), ("00015.wav", 'he said "no"')], "path string, sentence string").coalesce(1)
    W.write_manifest(df, str(tmp_path / "m"), ["path", "sentence"])
    assert sorted(map(tuple, R.manifest(spark, str(tmp_path / "m")).collect())) == [("00015.wav", 'he said "no"'), ("a.wav", "x y")]
    with pytest.raises(ValueError, match="empty"):
        W.write_manifest(df.limit(0), str(tmp_path / "e"), ["path", "sentence"])
    with pytest.raises(ValueError, match="tab"):
        W.write_manifest(df.withColumn("sentence", F.lit("a\tb")), str(tmp_path / "t"), ["path", "sentence"])
    (tmp_path / "bad.tsv").write_text("id\tsentence\nx\ty\n")
    with pytest.raises(ValueError, match="header"):
        R.manifest(spark, str(tmp_path / "bad.tsv"))
    (tmp_path / "short.tsv").write_text("path\tsentence\nx\n")
    with pytest.raises(Exception, match="wrong number"):
        R.manifest(spark, str(tmp_path / "short.tsv")).collect()


def test_ark(spark, tmp_path):
    (tmp_path / "h.ark").write_text("a x  y\nb\n")
    x = R.ark(spark, str(tmp_path / "h.ark"))
    assert {r.id: r.tokens for r in x.collect()} == {"a": ["x", "y"], "b": []}
    assert [tuple(r) for r in W.ark_predictions(x, 2).collect()] == [("a", "x y"), ("b", "")]
    with pytest.raises(ValueError):
        W.ark_predictions(x, 3)
    W.write_ark_triple(x, str(tmp_path / "out"), {"hyp": "tokens"})
    assert {r.id: r.tokens for r in R.ark(spark, str(tmp_path / "out/hyp.ark")).collect()} == {"a": ["x", "y"], "b": []}
    (tmp_path / "d.ark").write_text("a x\na y\n")
    with pytest.raises(ValueError, match="repeated"):
        R.ark(spark, str(tmp_path / "d.ark"))


def test_json(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"00015": "a b", "x": ""}))
    p = R.predictions_json(spark, str(tmp_path / "p.json"))
    assert {r.id: r.prediction for r in p.collect()} == {"00015": "a b", "x": ""}
    W.write_predictions_json(p, str(tmp_path / "q.json"))
    assert json.loads((tmp_path / "q.json").read_text()) == {"00015": "a b", "x": ""}
    (tmp_path / "r.json").write_text(json.dumps({"k": {"prediction": "a", "speaker": "s"}}))
    r = R.records_json(spark, str(tmp_path / "r.json")).first()
    assert (r.id, r.prediction, r.phoneme_ref, r.speaker) == ("k", "a", None, "s")
    (tmp_path / "h.json").write_text(json.dumps({"holdout_train_ids": ["1"], "holdout_dev_ids": [], "holdout_phoneme_refs": ["a  b"]}))
    assert sorted(map(tuple, R.holdout_json(spark, str(tmp_path / "h.json")).collect())) == [("phoneme", "a b"), ("train", "1")]
    W.write_document(spark.createDataFrame([(1,)], "n int"), str(tmp_path / "d.json"), {"seed": "3"})
    assert json.loads((tmp_path / "d.json").read_text()) == {"provenance": {"seed": "3"}, "n": 1}
    with pytest.raises(ValueError, match="partial"):
        W.write_document(spark.range(1), str(tmp_path / "d.json"), {}, partial=True)
    with pytest.raises(ValueError, match="one row"):
        W.write_document(spark.range(2), str(tmp_path / "d.json"), {})
    (tmp_path / "l.jsonl").write_text('{"id": "007", "sentence": "s"}\n')
    assert R.jsonl(spark, str(tmp_path / "l.jsonl")).first().id == "007"


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.txt").write_text("bb\nx\nyy\n")
    assert [tuple(r) for r in R.vocabulary(spark, str(tmp_path / "v.txt")).orderBy("index").collect()] == [(0, "bb"), (1, "x"), (2, "yy")]
    for bad in ("", "a b\n", "a\na\n"):
        (tmp_path / "w.txt").write_text(bad)
        with pytest.raises(ValueError):
            R.vocabulary(spark, str(tmp_path / "w.txt"))


def test_verses_xml(spark, tmp_path):
    (tmp_path / "v.xml").write_text('<quran><sura index="1" name="a"><aya index="1" text="x"/><aya index="2" text="y" bismillah="z"/></sura><sura index="2"><aya index="1" text="q"/></sura></quran>')
    assert sorted(map(tuple, R.verses_xml(spark, str(tmp_path / "v.xml")).collect())) == [(1, 1, "x"), (1, 2, "y"), (2, 1, "q")]
    (tmp_path / "e.xml").write_text("<quran></quran>")
    with pytest.raises(ValueError):
        R.verses_xml(spark, str(tmp_path / "e.xml"))


def test_segments_and_submission(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("dediac\tg\tm\ta\nكتب\tكَتَبَ\tx\nلا\tلَا\tx\ty\n\n# s\nabc\tq\nنعم\tنَعَم\n")
    got = [[w.dediac for w in r.words] for r in R.word_segments(spark, str(tmp_path / "w.tsv")).orderBy("segment").collect()]
    assert got == [["كتب", "لا"], ["نعم"]]
    assert R.word_segments(spark, str(tmp_path / "w.tsv")).columns == ["file", "segment", "words"]
    (tmp_path / "s.md").write_text("# t\n> early\n## Item 1 of 2\ntext\n> one\n> two\n## Item 2 of 2\n>  \n")
    assert [tuple(r)[1:] for r in R.submission(R.numbered_lines(spark, str(tmp_path / "s.md"))).collect()] == [(1, "one")]


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("hello\n")
    x = R.sibling_texts(spark, spark.createDataFrame([("w/a.wav",), ("w/b.wav",)], "path string"), str(tmp_path / "t"))
    assert [tuple(r) for r in x.collect()] == [("w/a.wav", "hello")]
    (tmp_path / "w").mkdir()
    for name, n, ch in (("a.wav", 5, 1), ("b.wav", 9, 2)):
        with wave.open(str(tmp_path / "w" / name), "wb") as f:
            f.setnchannels(ch)
            f.setsampwidth(2)
            f.setframerate(16_000)
            f.writeframes(np.arange(n * ch, dtype="<i2").tobytes())
    assert [r.frames for r in R.wav_lengths(spark, str(tmp_path / "w")).collect()] == [9, 5]
    m = R.binary_files(spark, str(tmp_path / "w"), "b.wav").select(R.mono("content").alias("m")).first().m
    assert np.frombuffer(m, "<i2").tolist() == [0, 2, 4, 6, 8, 10, 12, 14, 16]
    assert len(R.binary_files(spark, str(tmp_path / "w")).first().sha256) == 64
    assert R.pick_column(spark.range(1), "x", "id") == "id"
    with pytest.raises(KeyError):
        R.pick_column(spark.range(1), "x")


def test_variant_and_speaker_sinks(spark, tmp_path):
    clips = spark.createDataFrame([("a", "s", "p1"), ("b", "s", "p2")], "path string, sentence string, prompt string")
    canon = spark.createDataFrame([("p1", "x", "gold"), ("p2", "y", "gold"), ("p1", "z", "auto")], "prompt string, canonical string, variant string")
    W.write_variants(clips, canon, str(tmp_path / "v"))
    assert (tmp_path / "v/variant=gold").exists() and (tmp_path / "v/variant=auto").exists()
    with pytest.raises(ValueError, match="no canonical"):
        W.write_variants(clips, canon.where("prompt = 'p1'"), str(tmp_path / "w"))
    W.write_speaker_splits(clips, str(tmp_path / "s"), "prompt", "p2")
    assert (tmp_path / "s/split=dev").exists()
    with pytest.raises(ValueError, match="pairing"):
        W.paired_or_fail(clips, clips.withColumn("sentence", F.lit("t")), "path", "sentence")


def test_packing_and_tools(spark):
    texts = spark.createDataFrame([(1, "aa bb  cc"), (2, "a  b"), (3, ""), (4, None), (5, "aaaa b cc dd")], "id int, text string")
    chunks = {r.id: r.c for r in texts.select("id", tools.word_chunks("text", 5).alias("c")).collect()}
    assert chunks == {1: ["aa bb", "cc"], 2: ["a  b"], 3: [""], 4: None, 5: ["aaaa", "b cc", "dd"]}
    with pytest.raises(Exception, match="longer than the limit"):
        texts.select(tools.word_chunks(F.lit("aaaaaa b"), 5)).collect()
    long = {r.id: (r.output, r.seams) for r in tools.apply_tool(texts, lambda: tools.MarkStripper(5), "text", limit=5).collect()}
    assert long == {1: ("aa bb cc", 1), 2: ("a  b", 0), 3: ("", 0), 4: (None, 0), 5: ("aaaa b cc dd", 2)}
    assert tools.apply_tool(texts.limit(0), lambda: tools.MarkStripper(5), "text", limit=5).count() == 0
    with pytest.raises(ValueError, match="unknown tool"):
        tools.build("x")
    df = spark.createDataFrame([(1, "كَتَبَ", "old"), (2, None, "old"), (3, "", "old")], "id int, text string, output string")
    got = {r.id: (r.output, r.seams) for r in tools.apply_tool(df, lambda: tools.build("strip"), "text").collect()}
    assert got == {1: ("كتب", 0), 2: (None, 0), 3: ("", 0)}
    echo = tools.CommandTool("cat", [sys.executable, "-c", "import sys; sys.stdout.write(sys.stdin.read())"], 4)
    two = spark.createDataFrame([(1, "ab cd"), (2, "x")], "id int, text string")
    assert sorted((r.id, r.output, r.seams) for r in tools.apply_tool(two, lambda: echo, "text", limit=4).collect()) == [(1, "ab cd", 1), (2, "x", 0)]

    class Loses(tools.MarkStripper):
        def run(self, texts):
            return texts[1:]

    with pytest.raises(Exception, match="answers to"):
        tools.apply_tool(two, Loses, "text").collect()
    short = tools.CommandTool("none", [sys.executable, "-c", ""])
    with pytest.raises(ValueError, match="returned"):
        short.run(["a"])


def test_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = S.read_stream(spark, str(tmp_path / "e"), e)
    got = S.run_once(S.tumbling(stream, "ts", "1 hour", "event_type", "10 days"), "tumbling_sums")
    key = lambda df: sorted((r.window_start, r.event_type, r.n, round(r.total, 4)) for r in df.collect())
    assert key(got) == key(S.tumbling(e, "ts", "1 hour", "event_type"))
    seen = S.run_once(S.first_seen(stream, "ts", ["user_id"], "3650 days"), "first_seen", "append")
    assert seen.count() == e.select("user_id").distinct().count()
