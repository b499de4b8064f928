"""The source of page characters: batch, bad pages, stream with a restart."""

import json

from vellum.sources import characters


def page(doc, number, *lines):
    return json.dumps({"doc_id": doc, "page": number, "lines": [{"paragraph": p, "spans": [{"font": f, "size": 10, "chars": [{"c": c, "bbox": [i, 0, i + 1, 9]} for i, c in enumerate(t)]} for f, t in spans]} for p, spans in lines]})


def test_batch_keeps_bad_pages_apart(spark, tmp_path):
    characters.register(spark)
    (tmp_path / "a.json").write_text(page(1, 0, (3, [("A", "用x"), ("B", "y")]), (4, [("A", "z")])) + "\n\nnot json\n" + json.dumps({"doc_id": 1}) + "\n" + page(1, 1, (5, [("A", "q" * 70_000)])), "utf-8")
    (tmp_path / "b.json").write_text(page(2, 0, (1, [("A", "")])))
    (tmp_path / "_SUCCESS").write_text("")
    df = spark.read.format("page_characters").load(str(tmp_path))
    rows = [tuple(r) for r in df.where("page = 0").orderBy("place").collect()]
    assert [(r[2], r[3], r[4], r[5], r[6], r[7], r[11]) for r in rows] == [(0, 3, 0, 0, "用", 0.0, "A"), (0, 3, 0, 1, "x", 1.0, "A"), (0, 3, 1, 2, "y", 0.0, "B"), (1, 4, 2, 3, "z", 0.0, "A")]
    assert df.where("page = 1").count() == 70_000
    assert [r.error.split(": ")[:2] for r in df.where("error is not null").orderBy("error").collect()] == [["a.json:3", "JSONDecodeError"], ["a.json:4", "KeyError"]]
    (tmp_path / "none").mkdir()
    assert spark.read.format("page_characters").load(str(tmp_path / "none")).count() == 0


def test_stream_reads_each_file_once_over_a_restart(spark, tmp_path):
    characters.register(spark)
    folder, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("page_characters").load(str(folder))
        q = stream.select("doc_id", "c").writeStream.format("parquet").option("checkpointLocation", str(mark)).start(str(out))
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.read.parquet(str(out)).collect()))

    for i in range(3):
        (folder / f"{i}.json").write_text(page(i, 0, (0, [("A", "ab")])))
    assert run() == [(i, c) for i in range(3) for c in "ab"]
    for i in range(3, 5):
        (folder / f"{i}.json").write_text(page(i, 0, (0, [("A", "ab")])))
    assert run() == [(i, c) for i in range(5) for c in "ab"]
