"""Sources, sinks and the job stream."""

import io
import json
import sys
import types
import zipfile

import pytest

from folioflow.sources import readers
from folioflow.streaming import jobs


def test_uploads(spark, tmp_path):
    (tmp_path / "Aula 01.PDF").write_bytes(b"abc")
    (tmp_path / "x.txt").write_bytes(b"no")
    good, bad = readers.read_uploads(spark, str(tmp_path), "apostila")
    row = good.first()
    assert (row.slug, row.display_name, row.file_hash) == ("aula-01", "Aula_01", "ba7816bf8f01cfea")
    assert [r.original_filename for r in bad.collect()] == ["x.txt"]


def test_ocr_splice(spark):
    pages = spark.createDataFrame([(1, 0, "short"), (1, 1, "long enough to need no recognition at all")], "doc_id long, page_index int, text string")
    ocr = spark.createDataFrame([(1, 0, "read"), (1, 1, "unused")], "doc_id long, page_index int, text string")
    assert [r.text for r in readers.splice_ocr(pages, ocr).orderBy("page_index").collect()] == ["short\n\nread", "long enough to need no recognition at all"]
    assert readers.scanned_pages(pages).count() == 1


def test_archive_and_compression():
    z = zipfile.ZipFile(io.BytesIO(readers.archive("n.md", "# n", {"b.png": b"2", "a.png": b"1"}, ("o.pdf", b"p"))))
    assert z.namelist() == ["n.md", "images/a.png", "images/b.png", "o.pdf"]
    assert "-dPDFSETTINGS=/screen" in readers.compression_command("a", "b", "maior")
    with pytest.raises(ValueError, match="unknown"):
        readers.archive("n", "", {}, ("o", b""), "x")


def test_pdf_reader_contract(monkeypatch):
    with pytest.raises(RuntimeError, match="backend"):
        readers.PdfReader({})
    fake = types.ModuleType("fake_pdf")
    fake.__spec__ = types.SimpleNamespace(name="fake_pdf")
    fake.page_count, fake.spans = lambda p: 3, lambda p, k: (10.0, 20.0, [[("x", 1.0, 0, "F", (0.0, 0.0, 1.0, 1.0))]])
    monkeypatch.setitem(sys.modules, "fake_pdf", fake)
    r = readers.PdfReader({"backend": "fake_pdf", "paths": "a.pdf", "pages_per_task": "2"})
    rows = [x for p in r.partitions() for x in r.read(p)]
    assert len(r.partitions()) == 2 and [x[1] for x in rows] == [0, 1, 2]


def test_status_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("apostila", "1", "pendente", 1), ("apostila", "1", "processando", 2), ("apostila", "1", "concluido", 3), ("apostila", "1", "erro", 4), ("legislacao", "1", "pendente", 1), ("legislacao", "1", "cancelado", 2), ("apostila", "2", "pendente", 5)]
    data = tmp_path / "in"
    data.mkdir()
    got = {}
    keep = lambda df, _: got.update({(r.route, r.id): (r.status, r.n_refused) for r in df.collect()})
    for part in (rows[:2] + rows[4:5], rows[2:4] + rows[5:]):  # a restart from the checkpoint between the two
        for r, i, s, t in part:
            (data / f"{r}{i}{t}.json").write_text(json.dumps({"route": r, "id": i, "status": s, "created_at": f"2024-01-01T00:00:0{t}Z"}) + "\n")
        query = jobs.statuses(jobs.read_events(spark, str(data))).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    batch = {(r.route, r.id): (r.status, r.n_refused) for r in jobs.status_batch(spark.read.schema(jobs.EVENTS).json(str(data))).collect()}
    assert got == batch == {("apostila", "1"): ("concluido", 1), ("legislacao", "1"): ("cancelado", 0), ("apostila", "2"): ("pendente", 0)}
    assert [r.id for r in jobs.recover(spark.read.schema(jobs.EVENTS).json(str(data))).collect()] == ["2"]


def test_recognition_is_an_adapter(spark):
    rows = spark.createDataFrame([(1, bytearray(b"abc")), (2, None), (3, bytearray(b"bad"))], "figure_seq int, image binary")

    def read(picture):
        if picture == b"bad":
            raise OSError("no")
        return picture.decode().upper()

    assert sorted(tuple(r) for r in readers.recognise(rows, read).collect()) == [(1, "ABC"), (2, ""), (3, "")]


def test_files_are_replaced_whole(tmp_path):
    path = str(tmp_path / "n.md")
    readers.replace_file(path, "one")
    readers.replace_file(path, "two")
    assert open(path).read() == "two" and open(path + ".bak").read() == "one" and sorted(x.name for x in tmp_path.iterdir()) == ["n.md", "n.md.bak"]
    assert open(readers.keep_original(path, str(tmp_path / "job"))).read() == "two"


def test_notes_meet_their_files(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "pdf").mkdir()
    (tmp_path / "md" / "Acao_1.md").write_text("# a")
    (tmp_path / "md" / "other.md").write_text("# b")
    (tmp_path / "pdf" / "Ação 1.PDF").write_bytes(b"p")
    got = readers.pairs(spark, str(tmp_path / "md"), str(tmp_path / "pdf")).collect()
    assert [(r.name, r.text) for r in got] == [("acao 1", "# a")]


def test_queue_worker_and_cancels(spark, tmp_path):
    kind = "route string, id string, status string, created_at timestamp"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"route": "apostila", "id": i, "status": s, "created_at": f"2024-01-01T00:00:0{t}Z"}) for i, s, t in [("2", "pendente", 2), ("1", "pendente", 1), ("3", "erro", 0)]) + "\n")
    seen = []
    jobs.work(jobs.read_events(spark, str(tmp_path / "in")), lambda rows: seen.extend(r.id for r in rows.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert seen == ["1", "2"]
    events = spark.read.schema(kind).json(str(tmp_path / "in"))
    cancels = events.where("id in ('1', '3')").selectExpr("route", "id", "created_at + interval 1 minute as created_at")
    got = {r.id: (r.status, r.n_refused) for r in jobs.status_batch(jobs.with_cancels(events, cancels)).collect()}
    assert got == {"1": ("cancelado", 0), "2": ("pendente", 0), "3": ("erro", 1)}


def test_uploads_of_one_content_count_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"route": r, "file_hash": h, "created_at": f"2024-01-0{t}T00:00:00Z"}) for r, h, t in [("a", "x", 1), ("a", "x", 2), ("b", "x", 1), ("a", "y", 1)]) + "\n")
    stream = spark.readStream.schema("route string, file_hash string, created_at timestamp").json(str(tmp_path / "in"))
    got = []
    query = jobs.first_of_content(stream).writeStream.foreachBatch(lambda df, _: got.extend((r.route, r.file_hash) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(got) == [("a", "x"), ("a", "y"), ("b", "x")]
