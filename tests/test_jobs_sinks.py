"""Sinks, end-to-end jobs and the scoring command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from precis.operators.bleu import corpus_bleu
from precis.operators.lines import map_lines, score_with
from precis.operators.vocab import build_vocabulary, encode
from precis.plans import jobs
from precis.plans.rouge_cli import main as rouge_main
from precis.sources.files import parse_generation_log, read_lines
from precis.sources.sinks import format_aggregate_csv, write_pairs_text


def read_parts(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            with open(os.path.join(folder, name)) as fh:
                out.extend(fh.read().splitlines())
    return out


def test_pairs_text_aligned_and_no_overwrite(spark, tmp_path):
    pairs = spark.createDataFrame([(i, f"art {i}\nx", f"sum {i}") for i in range(1000)], "id long, article string, summary string")
    a, s = write_pairs_text(pairs.repartition(5), str(tmp_path), "t", partitions=4)
    arts, sums = read_parts(a), read_parts(s)
    assert arts == [f"art {i} x" for i in range(1000)]
    assert sums == [f"sum {i}" for i in range(1000)]
    with pytest.raises(RuntimeError):
        write_pairs_text(pairs, str(tmp_path), "t")


def test_aggregate_csv_format():
    rows = [
        {"score_type": "rouge1-P", "low": 0.0078125, "mid": 0.5, "high": 1.0, "_type": "rouge1", "_ord": 1},
        {"score_type": "rouge1-R", "low": 0.0, "mid": 1 / 3, "high": 2 / 3, "_type": "rouge1", "_ord": 0},
    ]
    assert format_aggregate_csv(rows) == (
        "score_type,low,mid,high\nrouge1-R,0.000000,0.333333,0.666667\nrouge1-P,0.007812,0.500000,1.000000\n"
    )


def test_scoring_cli_end_to_end(spark, tmp_path):
    (tmp_path / "a.targets").write_text("one two three\none two five six\n")
    (tmp_path / "a.decodes").write_text("one two\nseven eight\n")
    out = str(tmp_path / "scores.csv")
    per = str(tmp_path / "per")
    text = rouge_main([
        "--target-filepattern", str(tmp_path / "*.targets"),
        "--prediction-filepattern", str(tmp_path / "*.decodes"),
        "--output-filename", out, "--rouge-types", "rouge1", "rougeL",
        "--per-example-output", per,
    ], spark=spark)
    lines = text.splitlines()
    assert lines[0] == "score_type,low,mid,high"
    assert [ln.split(",")[0] for ln in lines[1:]] == ["rouge1-R", "rouge1-P", "rouge1-F", "rougeL-R", "rougeL-P", "rougeL-F"]
    assert lines[2] == "rouge1-P,0.000000,0.500000,1.000000"
    csv_lines = [ln for ln in read_parts(per) if not ln.startswith("id")]
    assert csv_lines[0] == "0,1.000000,0.666667,0.800000,1.000000,0.666667,0.800000"


def test_scoring_uneven_files(spark, tmp_path):
    (tmp_path / "a.targets").write_text("one\ntwo\n")
    (tmp_path / "a.decodes").write_text("one\n")
    with pytest.raises(ValueError, match="uneven files"):
        jobs.score_files(spark, str(tmp_path / "*.targets"), str(tmp_path / "*.decodes"), str(tmp_path / "o"))
    (tmp_path / "b.decodes").write_text("x\n")
    with pytest.raises(ValueError, match="1 with targets, 2 with predictions"):
        jobs.score_files(spark, str(tmp_path / "*.targets"), str(tmp_path / "*.decodes"), str(tmp_path / "o2"))


def test_split_and_sample_jobs(spark, tmp_path):
    (tmp_path / "x.articles").write_text("".join(f"article {i}\n" for i in range(10)))
    (tmp_path / "x.summaries").write_text("".join(f"summary {i}\n" for i in range(10)))
    pairs = jobs.split_files(spark, str(tmp_path / "x.articles"), str(tmp_path / "x.summaries"), str(tmp_path / "split"))
    back = spark.read.parquet(str(tmp_path / "split"))
    assert back.count() == 10 and back.where(F.col("split") == "train").count() == 8
    share = jobs.sample_files(spark, str(tmp_path / "x.articles"), str(tmp_path / "x.summaries"),
                              str(tmp_path / "sampled"), length=11)
    assert share == 100.0
    with pytest.raises(ValueError):
        jobs.sample_files(spark, str(tmp_path / "x.articles"), str(tmp_path / "x.summaries"), str(tmp_path / "sampled"), length=3)
    (tmp_path / "y.summaries").write_text("only one\n")
    with pytest.raises(ValueError):
        jobs.read_aligned(spark, str(tmp_path / "x.articles"), str(tmp_path / "y.summaries"))


def test_news_job_writes_aligned_files(spark, tmp_path):
    src = tmp_path / "ria.json"
    src.write_text("\n".join(json.dumps({"text": f"<p>Новость {i}: текст</p>", "title": f"Заголовок {i}"}) for i in range(6)) + "\n")
    jobs.prepare_news(spark, str(src), str(tmp_path / "out"))
    arts, sums = read_parts(tmp_path / "out" / "ria.articles"), read_parts(tmp_path / "out" / "ria.summaries")
    assert sums == [f"Заголовок {i}" for i in range(6)]
    assert arts[3] == "новость 3 текст"


def test_bleu_hand_computed(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sat on a mat")], "target string, hypothesis string")
    r = corpus_bleu(df).first()
    # p1 5/6, p2 3/5, p3 2/4, p4 1/3; equal lengths -> BP 1
    import math
    assert r["p1"] == pytest.approx(500 / 6) and r["p2"] == pytest.approx(60.0)
    assert r["bleu"] == pytest.approx(100 * math.exp((math.log(5 / 6) + math.log(3 / 5) + math.log(2 / 4) + math.log(1 / 3)) / 4))
    df0 = spark.createDataFrame([("a b c d", "d c b a")], "target string, hypothesis string")
    assert corpus_bleu(df0).first()["bleu"] == 0.0  # no 2-gram hit, no smoothing
    df2 = spark.createDataFrame([("a b c d e", "a b c d")], "target string, hypothesis string")
    r2 = corpus_bleu(df2).first()
    import math
    assert r2["bleu"] == pytest.approx(100 * math.exp(1 - 5 / 4))


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(0, ["b", "a", "b"]), (1, ["c", "a", "b"])], "doc_id long, tokens array<string>")
    v = {r["token"]: (r["count"], r["id"]) for r in build_vocabulary(df, "tokens").collect()}
    assert v == {"b": (3, 0), "a": (2, 1), "c": (1, 2)}
    v2 = build_vocabulary(df, "tokens", min_count=2)
    enc = {r["doc_id"]: r["ids"] for r in encode(df, "tokens", v2, unk_id=-1).collect()}
    assert enc == {0: [0, 1, 0], 1: [-1, 1, 0]}


def test_map_lines_and_generation_log(spark, tmp_path):
    p = tmp_path / "in.txt"
    p.write_text("header\nalpha\n#skip\nbeta\n")
    lines = read_lines(spark, str(p), skip_lines=1)
    out = map_lines(lines, lambda line, suf: None if line.startswith("#") else line.upper() + suf, "!")
    assert [r["value"] for r in out.orderBy("line").collect()] == ["ALPHA!", "BETA!"]
    log = spark.createDataFrame([("T-0\tnew s ##ite opens",), ("H-0\t-0.5\tnew s ##ite open",), ("S-0\tx",)], "value string")
    r = parse_generation_log(log).first()
    assert (r["key"], r["target"], r["hypothesis"]) == ("-0", "new site opens", "new site open")


def test_custom_scorer(spark):
    class Len:
        def score(self, target, prediction):
            return {"len": (len(prediction), len(target), 0.0)}

    df = spark.createDataFrame([(3, "ab", "abc")], "id long, target string, prediction string")
    r = score_with(df, Len()).first()
    assert (r["id"], r["score_type"], r["precision"], r["recall"]) == (3, "len", 3.0, 2.0)


def test_streaming_ingest(spark, tmp_path):
    from precis.streaming.ingest import start_news_ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"text": "<p>Hello World!</p>", "title": "T"}) + "\n")
    q = start_news_ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"), language="english",
                          available_now=True)
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["article"], r["summary"]) for r in rows] == [("hello world", "T")]  # "!" is a punctuation token


def test_process_article_and_line_job(spark, tmp_path):
    (tmp_path / "art.txt").write_text("<p>Hello, World: one two!</p>\nsecond line")
    out = jobs.process_articles(spark, str(tmp_path / "art.txt"), str(tmp_path / "saved"), language="english")
    assert [r["article"] for r in out.collect()] == ["hello world one two ! second line"]
    assert read_parts(tmp_path / "saved") == ["hello world one two ! second line"]
    (tmp_path / "lines.txt").write_text("hdr\na\x0bb\n#c\nd\n")
    n = jobs.map_file_lines(spark, str(tmp_path / "lines.txt"), lambda x, s: None if x.startswith("#") else x + s,
                            ("!",), str(tmp_path / "lout"), skip_lines=1)
    assert n == 3 and read_parts(tmp_path / "lout") == ["a!", "b!", "d!"]


def test_train_split_vocabularies(spark):
    pairs = spark.createDataFrame(
        [(0, "a b a", "x", "train"), (1, "b c", "y y", "train"), (2, "z z z", "w", "test")],
        "id long, article string, summary string, split string",
    )
    v = jobs.corpus_vocabularies(pairs)
    src = {r["token"]: r["id"] for r in v["articles"].collect()}
    tgt = {r["token"]: r["id"] for r in v["summaries"].collect()}
    assert src == {"a": 0, "b": 1, "c": 2} and tgt == {"y": 0, "x": 1}
    enc = {r["id"]: (r["article_ids"], r["summary_ids"]) for r in jobs.encode_pairs(pairs, v).collect()}
    assert enc[0] == ([0, 1, 0], [1]) and enc[2] == ([-1, -1, -1], [-1])
    assert set(jobs.corpus_vocabularies(pairs, only_source=True)) == {"articles"}


def test_scoring_pairs_across_files(spark, tmp_path):
    from precis.sources.files import read_scoring_pairs

    (tmp_path / "b.targets").write_text("t3\nt4\n")
    (tmp_path / "a.targets").write_text("t1\nt2\n")
    (tmp_path / "a.decodes").write_text("p1\np2\n")
    (tmp_path / "b.decodes").write_text("p3\np4\n")
    rows = read_scoring_pairs(spark, str(tmp_path / "*.targets"), str(tmp_path / "*.decodes")).orderBy("id").collect()
    assert [(r["id"], r["target"], r["prediction"]) for r in rows] == [
        (0, "t1", "p1"), (1, "t2", "p2"), (2, "t3", "p3"), (3, "t4", "p4")]


def test_empty_aligned_files(spark, tmp_path):
    (tmp_path / "e.articles").write_text("")
    (tmp_path / "e.summaries").write_text("")
    pairs = jobs.read_aligned(spark, str(tmp_path / "e.articles"), str(tmp_path / "e.summaries"))
    assert pairs.count() == 0
    from precis.operators.split import ratio_split, sample_share

    assert ratio_split(pairs, "id").count() == 0
    share = sample_share(pairs, 10).first()
    assert (share["kept"], share["total"], share["share"]) == (0, 0, None)


def test_cli_stemmer_lsum_poisson(spark, tmp_path):
    (tmp_path / "a.targets").write_text("the cats were running\nfast dogs||one two||")
    (tmp_path / "a.decodes").write_text("a cat runs\nfast dog||one||")
    text = rouge_main([
        "--target-filepattern", str(tmp_path / "*.targets"),
        "--prediction-filepattern", str(tmp_path / "*.decodes"),
        "--output-filename", str(tmp_path / "s.csv"), "--delimiter", "||",
        "--rouge-types", "rouge1", "rougeLsum", "--use-stemmer", "--bootstrap", "poisson", "--n-samples", "50",
    ], spark=spark)
    names = [ln.split(",")[0] for ln in text.splitlines()[1:]]
    assert names == ["rouge1-R", "rouge1-P", "rouge1-F", "rougeLsum-R", "rougeLsum-P", "rougeLsum-F"]
    for ln in text.splitlines()[1:]:
        lo, mid, hi = map(float, ln.split(",")[1:])
        assert 0.0 <= lo <= mid <= hi <= 1.0


def test_story_job_and_size_split_job(spark, tmp_path):
    d = tmp_path / "stories"
    d.mkdir()
    for i in range(5):
        (d / f"s{i}.story").write_text(f"Body {i} text here.\n@highlight\nSummary {i}")
    jobs.prepare_stories(spark, [str(d)], str(tmp_path / "out"))
    arts = read_parts(tmp_path / "out" / "cnndm.articles")
    sums = read_parts(tmp_path / "out" / "cnndm.summaries")
    # "here" is a stop word; the appended " ." is a punctuation token
    assert arts == [f"body {i} text" for i in range(5)]
    assert sums == [f"<s> summary {i} . </s>" for i in range(5)]
    (tmp_path / "x.articles").write_text("".join(f"a{i}\n" for i in range(6)))
    (tmp_path / "x.summaries").write_text("".join(f"s{i}\n" for i in range(6)))
    out = jobs.split_by_size(spark, str(tmp_path / "x.articles"), str(tmp_path / "x.summaries"),
                             str(tmp_path / "sz"), 3, 2, overlap=True)
    back = spark.read.parquet(str(tmp_path / "sz"))
    assert back.count() == 8 and out.count() == 8


def test_encoding_through_salted_join(spark, monkeypatch):
    from precis import session

    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    hot = ["the"] * 50 + ["cat", "zzz"]
    df = spark.createDataFrame([(0, hot), (1, []), (2, ["cat", "the"])], "doc_id long, tokens array<string>")
    vocab = spark.createDataFrame([("the", 60, 0), ("cat", 3, 1)], "token string, count long, id long")
    enc = {r["doc_id"]: r["ids"] for r in encode(df, "tokens", vocab, unk_id=-1).collect()}
    assert enc == {0: [0] * 50 + [1, -1], 1: [], 2: [1, 0]}


def test_part_folders_are_read_back_aligned(spark, tmp_path):
    pairs = spark.createDataFrame([(i, f"art {i}", f"sum {i}") for i in range(100)], "id long, article string, summary string")
    a, s = write_pairs_text(pairs, str(tmp_path), "t", partitions=4)
    back = jobs.read_aligned(spark, a, s).orderBy("id").collect()
    assert [(r.id, r.article, r.summary) for r in back] == [(i, f"art {i}", f"sum {i}") for i in range(100)]
    out = jobs.split_files(spark, a, s, str(tmp_path / "texts"), as_text=True)
    assert out.count() == 100
    for name, ids in (("train", range(80)), ("val", range(80, 90)), ("test", range(90, 100))):
        assert read_parts(tmp_path / "texts" / f"{name}.articles") == [f"art {i}" for i in ids]
        assert read_parts(tmp_path / "texts" / f"{name}.summaries") == [f"sum {i}" for i in ids]


def test_odd_names_and_uneven_files(spark, tmp_path):
    from precis.sources.files import read_scoring_pairs

    folder = tmp_path / "s p é"
    folder.mkdir()
    (folder / "a b.t").write_text("t1\nt2\n")
    (folder / "a b.p").write_text("p1\np2\n")
    (folder / "b.t").write_text("")
    (folder / "b.p").write_text("")
    (folder / "ü.t").write_text("t3\n")
    (folder / "ü.p").write_text("p3\n")
    rows = read_scoring_pairs(spark, str(folder / "*.t"), str(folder / "*.p")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(0, "t1", "p1"), (1, "t2", "p2"), (2, "t3", "p3")]
    (folder / "b.p").write_text("p0\n")  # uneven in the middle, empty on one side
    with pytest.raises(ValueError, match="b.t"):
        read_scoring_pairs(spark, str(folder / "*.t"), str(folder / "*.p"))


def test_line_job_over_several_files_calls_the_function_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def worker(line, suffix):
        calls.add(1)
        return None if line == "drop" else line + suffix

    (tmp_path / "b.txt").write_text("head\nb0\nb1\x0bb1s\ndrop\n")
    (tmp_path / "a.txt").write_text("head\na0\na1\na2\n")
    n = jobs.map_file_lines(spark, str(tmp_path / "*.txt"), worker, ("!",), str(tmp_path / "out"), skip_lines=1)
    assert n == 6 and calls.value == 7
    assert read_parts(tmp_path / "out") == ["a0!", "a1!", "a2!", "b0!", "b1!", "b1s!"]


def test_delimiter_with_line_breaks(spark, tmp_path):
    from precis.sources.files import read_delimited

    (tmp_path / "x.txt").write_bytes(b"one\r\ntwo\r\n\r\nthree\r\n\r\n")
    rows = read_delimited(spark, str(tmp_path / "x.txt"), "\n\n").orderBy("line").collect()
    assert [r.value for r in rows] == ["one\ntwo", "three"]


@pytest.mark.parametrize("parts", [1, 5])
def test_example_csv_is_one_csv_at_any_number_of_parts(spark, tmp_path, parts):
    from precis.sources.sinks import join_parts, write_example_csv

    rows = [(i, i / 7, None if i == 3 else 0.5) for i in range(200)]
    wide = spark.createDataFrame(rows, "id long, `rouge1-P` double, `rouge1-R` double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_example_csv(wide.orderBy((wide.id * 37) % 200), str(tmp_path / "csv"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    join_parts(spark, str(tmp_path / "csv"), str(tmp_path / "one.csv"))
    want = "id,rouge1-P,rouge1-R\n" + "".join(f"{i},{a:f},{'' if b is None else '%f' % b}\n" for i, a, b in rows)
    assert (tmp_path / "one.csv").read_bytes() == want.encode()
    assert len(list((tmp_path / "csv").glob("part-*"))) >= min(parts, 2)
    with pytest.raises(RuntimeError, match="refusing"):
        join_parts(spark, str(tmp_path / "csv"), str(tmp_path / "one.csv"))
    write_example_csv(wide.where("false"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_aligned_output_is_all_or_nothing(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from precis.sources import sinks

    rows = [(i, f"article {i}", f"summary {i}", ("train", "val", "test", "other")[i % 4]) for i in range(400)]
    pairs = spark.createDataFrame(rows, "id long, article string, summary string, split string")
    names = lambda: sorted(p.name for p in tmp_path.iterdir())
    bad = pairs.withColumn("summary", F.when(F.col("id") == 333, F.raise_error(F.lit("broken"))).otherwise(F.col("summary")))
    for write in (lambda f: sinks.write_split_text(f, str(tmp_path)), lambda f: sinks.write_pairs_text(f, str(tmp_path), "all")):
        with pytest.raises(Exception, match="broken"):
            write(bad.where("split != 'other' or id = 333").withColumn("split", F.lit("test")))
        assert names() == []

    # an error while names are given takes back those already given
    give, calls = sinks._give_name, []

    def failing(files, path, source, target):
        calls.append(target)
        if len(calls) == 4:
            raise RuntimeError("no more names")
        give(files, path, source, target)

    monkeypatch.setattr(sinks, "_give_name", failing)
    with pytest.raises(RuntimeError, match="no more names"):
        sinks.write_split_text(pairs, str(tmp_path))
    assert names() == []

    # a writer that dies in between is completed by the next one
    monkeypatch.setattr(sinks, "_give_name", lambda *args: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        sinks.write_pairs_text(pairs, str(tmp_path), "first")
    assert len(names()) == 1 and names()[0].startswith(sinks.STAGED)
    monkeypatch.setattr(sinks, "_give_name", give)
    sinks.write_split_text(pairs, str(tmp_path))
    assert names() == sorted(f"{t}.{side}" for t in ("first", "train", "val", "test") for side in ("articles", "summaries"))
    for tag in ("train", "val", "test"):
        lines = [[line for part in sorted((tmp_path / f"{tag}.{side}").glob("part-*")) for line in part.read_text().splitlines()]
                 for side in ("articles", "summaries")]
        assert lines == [[f"{word} {r[0]}" for r in rows if r[3] == tag] for word in ("article", "summary")]
    empty = sinks.write_pairs_text(pairs.where("false"), str(tmp_path), "none")
    assert all(spark.read.text(p).count() == 0 for p in empty)
