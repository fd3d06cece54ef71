"""The folds that SQL does not express: small cases worked out by hand."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as S

from folioflow.operators import cells as C
from folioflow.operators import figures as G


def test_drawings_cluster_and_yield_to_rasters(spark):
    near = [(1, 0, 0.0, 0.0, 100.0, 50.0), (1, 0, 102.0, 0.0, 200.0, 50.0), (1, 0, 0.0, 300.0, 10.0, 310.0), (1, 0, 0.0, 400.0, 200.0, 500.0)]
    box = "doc_id long, page_index int, x0 double, y0 double, x1 double, y1 double"
    got = G.vector_figures(spark.createDataFrame(near, box), spark.createDataFrame([(1, 0, 0.0, 400.0, 200.0, 440.0)], box), 600.0, 600.0).collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in got] == [(0.0, 0.0, 200.0, 50.0)]


def test_characters_make_lines(spark):
    char = lambda c, x0, x1, y: (c, x0, y, x1, y + 10.0, 10.0)
    kind = "cell long, chars array<struct<text:string,x0:double,y0:double,x1:double,y1:double,size:double>>"
    line = [char("a", 0.0, 6.0, 5.0), char("b", 10.0, 20.0, 6.0), char(",", 24.0, 26.0, 5.0), char("c", 30.0, 36.0, 6.0), char(" ", 36.0, 38.0, 5.0), char("d", 38.0, 44.0, 5.0), char(".", 50.0, 52.0, 5.0)]
    rows = [(1, [char("z", 0.0, 5.0, 30.0), *line]), (2, None), (3, [])]
    got = {r.cell: r.lines for r in C.cell_lines(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ["a b,c d.", "z"], 2: [], 3: []}
    # the centre moves halfway to each character that joins, so a slope stays one line
    assert len(C.char_rows([char("x", 10.0 * k, 10.0 * k + 6, 2.0 * k) for k in range(4)])) == 1
    assert C.word_rows([("b", 10, 1, 20, 11), ("a", 0, 0, 8, 10), (".", 21, 0, 22, 10), ("c", 0, 20, 9, 30)]) == ["a b.", "c"]


def test_cell_texts(spark):
    lines = F.array(*[F.lit(x) for x in ("Crimes do art. 7º, II  do CP ,", "veja :", "-item", "goes on", "", "2) other | x")])
    got = spark.range(1).select(C.cell_text(lines).alias("t")).first().t
    assert got == "Crimes do art. 7º, II, do CP, veja:<br>- item goes on<br>2) other \\| x"
    rows = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, None), (1, 1, 0, " "), (1, 1, 1, ""), (1, 2, 0, "b"), (1, 2, 1, "c")], "t long, row_no int, col_no int, text string")
    assert tuple(C.table_rows(rows, ["t"]).first()) == (1, [["a", ""], ["b", "c"]], 1, 6)


def test_anchors_go_forward(spark):
    images = spark.createDataFrame([(1, 0, "two"), (1, 1, "one"), (1, 2, "two"), (2, 0, "x")], "doc_id long, image_seq int, anchor string")
    blocks = spark.createDataFrame([(1, 0, "one"), (1, 1, "one two"), (1, 2, "three")], "doc_id long, block_no long, text string")
    got = sorted((r.doc_id, r.image_seq, r.block_no) for r in G.anchors(images, blocks).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (1, 2, 1), (2, 0, None)]


def test_number_and_title_make_one_line(spark):
    rows = [(1, 0, 0, "1.", 10.0, 73.0, 80.0), (1, 0, 1, "Title", 11.0, 91.0, 200.0), (1, 0, 2, "2.", 30.0, 73.0, 80.0), (1, 0, 3, "far", 30.0, 150.0, 200.0), (1, 0, 4, "3)", 50.0, 73.0, 80.0)]
    got = G.joined_numbers(spark.createDataFrame(rows, "doc_id long, page_index int, line_seq int, text string, y0 double, x0 double, x1 double")).collect()
    assert sorted((r.line_seq, r.text) for r in got) == [(0, "1. Title"), (2, "2."), (3, "far"), (4, "3)")]


class Caught:
    """Stands for a table of cells: its operator's function over Arrow batches runs here."""

    schema = S.StructType([S.StructField("cell", S.LongType()), S.StructField("chars", S.StringType())])

    def mapInArrow(self, run, schema):
        return lambda cells: run([pa.RecordBatch.from_arrays([pa.array(range(len(cells))), pa.array(cells, CHARS)], ["cell", "chars"])])


CHARS = pa.list_(pa.struct([("text", pa.string()), *[(n, pa.float64()) for n in ("x0", "y0", "x1", "y1", "size")]]))


def placed(text, x, y, height=10.0, width=6.5, size=10.0):
    return {"text": text, "x0": x, "y0": y - height / 2, "x1": x + width, "y1": y + height / 2, "size": size}


def test_a_batch_of_cells_takes_little_memory():
    cells = [[placed("ab c,"[k % 5], k % 12 * 7.0, k // 12 * 12.0 + k % 3) for k in range(300)] for _ in range(3000)]
    size, lines = pa.array(cells, CHARS).nbytes, 0
    batches = C.cell_lines(Caught())(cells)
    tracemalloc.start()
    try:
        start = tracemalloc.get_traced_memory()[0]
        for batch in batches:
            lines += batch.num_rows
        peak = tracemalloc.get_traced_memory()[1] - start
    finally:
        tracemalloc.stop()
    assert lines == 3000 and peak < size


def test_lines_by_arrays_are_those_of_the_fold(monkeypatch):
    rnd = random.Random(1)
    cells = [None, [], [placed("", 0.0, 0.0)], [placed(" ", 0.0, 0.0)]]
    for _ in range(400):
        tall, odd, step, mine = rnd.random() < 0.2, rnd.random() < 0.1, rnd.choice([1, 3, 5, 12]), []
        for k in range(rnd.randint(1, 30)):
            text = rnd.choice(["ab", " a", "x "] if odd and rnd.random() < 0.3 else ["a", "é", "漢", "😀", ",", " ", ".", "\t", "b", "", "»", "\x1c"])
            y = rnd.randint(0, 4) * 12 + rnd.choice([0, 1, 2, 0.3]) * step / 3
            mine.append(placed(text, rnd.choice([k * 7.0, rnd.randint(0, 8) * 7.0, rnd.random() * 60]), y, rnd.choice([10.0, 4.0, 0.5]) if tall else 10.0, rnd.choice([6.5, 5.0, 3.0]), rnd.choice([10.0, 0.5, 30.0])))
        cells.append(mine)
    listed = [[tuple(x[f] for f in ("text", "x0", "y0", "x1", "y1", "size")) for x in c or [] if x["text"]] for c in cells]
    want = [[C.join_chars(r) for r in C.char_rows(c)] for c in listed]
    for piece in (1, 50, C.PIECE):
        monkeypatch.setattr(C, "PIECE", piece)
        assert [x for batch in C.cell_lines(Caught())(cells) for x in batch.column("lines").to_pylist()] == want
