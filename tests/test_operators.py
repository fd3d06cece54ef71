
import pytest
from pyspark.sql import functions as F

from folioflow.functions import symbols
from folioflow.functions import text as T
from folioflow.operators import catalog, layout, legal, postprocess, reflow, tables


def one(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("p -o q, forall x", "p → q, ∀ x"), ("x == y", "x ≡ y"), ("P = Q", "P ⇔ Q"), ("a > b", "a ⇒ b"), ("P A Q, ~~P -> Q~~", "P ∧ Q, ~~P -> Q~~"), ("a conjunção: P ? Q", "a conjunção: P ∧ Q"), ("P ? Q", "P ? Q"),
        ("disjunção P \ue111 Q", "disjunção P ∨ Q"), ("se e somente se, união: P ? Q", "se e somente se, união: P ↔ Q"), ("not exists y", "∄ y"), ("P -> Q", "P → Q"), ("P ^ Q v R -> ~S", "P ∧ Q ∨ R → ¬S"), ("plain v text here", "plain v text here"), ("| P -> Q |", "| P -> Q |"), ("considerou-o feito", "considerou-o feito")],
)
def test_symbols(spark, text, want):
    assert one(spark, symbols.symbols(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("P -> Q . " + "A " * 24 + "iner.", "P → Q . " + "A " * 24 + "iner."), ("A A A", "A A A"), ("of. A A A A a a", "of. A A A A a a"), ("y A A a a", "y A A a a"), ("P A A A Q", "P A A A Q"),
        ("A A B", "A ∧ B"), ("P A A", "P ∧ A"), ("~A A (B v C), ¬A A B", "¬A ∧ (B ∨ C), ¬A ∧ B"), ("(P v Q) A A", "(P ∨ Q) ∧ A"), ("e: p A q", "e: p ∧ q"), ("BA A B; P A A B", "BA A B; P ∧ A B")],
)
def test_a_repeated_word_is_no_formula(spark, text, want):
    assert one(spark, symbols.symbols(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("a<!-- x\ny -->b", "ab"), ("a<br>b", "a\nb"), ("| a<br>b |", "| a<br>b |"), ("<u>x</u>\r\n\r\n\r\n\r\ny", "x\n\ny"), ("<script>s</script>", "<script>s</script>")],
)
def test_clean_markdown(spark, text, want):
    assert one(spark, T.clean_markdown(F.col("t")), t=text) == want


def test_names(spark):
    assert one(spark, T.slugify(F.col("t")), t="Ação Pública 1ª.pdf") == "acao-publica-1a"
    assert one(spark, T.slugify(F.col("t")), t="???.pdf") == "documento"
    assert one(spark, T.display_name(F.col("t")), t="  DCA 1 (x).pdf") == "DCA_1_x"
    assert one(spark, T.lesson_number("t"), t="Aula_05_x.pdf") == "5"
    assert one(spark, T.tags(F.col("t")), t=" a, ,b ") == ["a", "b"]


def test_reflow_joins_lines_and_hyphenated_words(spark):
    rows = [(1, k, x) for k, x in enumerate(["- item one", "goes on in-", "side", "", "#### Head", "text --", "end"])]
    got = reflow.reflow(spark.createDataFrame(rows, "doc_id long, pos int, line string")).orderBy("block_no").collect()
    assert [r.text for r in got] == ["- item one goes on inside", "#### Head text -- end"]


def test_law_quote_takes_its_items(spark):
    rows = [(1, k, x) for k, x in enumerate(["Art. 5 All", "I - a", "a) b", "other", "II - c", "> Art. 1"])]
    got = reflow.law_quotes(spark.createDataFrame(rows, "doc_id long, block_no int, text string")).orderBy("block_no").collect()
    assert [r.text for r in got] == ["> [!quote] \n> LEI\n> Art. 5 All\n>\n> I - a\n>\n> a) b", "other", "II - c", "> Art. 1"]


def test_rows_have_a_fixed_anchor(spark):
    rows = [(1, 0, k, float(y), 0.0) for k, y in enumerate([0, 2, 4, 6.5, 6.9, 10])]
    got = layout.reading_order(spark.createDataFrame(rows, "doc_id long, page_index int, line_seq int, y0 double, x0 double")).orderBy("line_seq").collect()
    assert [r.row_no for r in got] == [1, 1, 2, 2, 2, 3]


def test_article(spark):
    law = "**Art. 12.** São: I – natos: a) um; b) dois; II – outros. § 1º A lei. **§ 2º** fica. Parágrafo único. Fim."
    arts = legal.articles(spark.createDataFrame([(1, law)], "doc_id long, law string"))
    units = legal.items(arts)
    assert [(r.label, r.text) for r in units.orderBy("unit_seq").collect()] == [("I", "natos"), ("II", "outros.")]
    assert [(r.label, r.text) for r in legal.letters(units).orderBy("letter_seq").collect()] == [("a", "um"), ("b", "dois")]
    assert [(r.label, r.text) for r in legal.paragraphs(arts).orderBy("par_seq").collect()] == [("§ 1º", "A lei."), ("§ 2º", "fica."), ("Parágrafo único", "Fim.")]
    assert legal.render(arts).first().text.startswith("#### Art. 12\n\nSão:\n\n- **I** – natos:\n  - **a)** um\n  - **b)** dois\n- **II** – outros.")


def test_tables(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(""), F.lit("c")), F.array(F.lit("d")))
    merged = tables.merge_cells(rows)
    assert one(spark, tables.markdown(F.concat(F.array(F.array(F.lit("h"), F.lit("i"))), merged)), t=1) == "|h|i|\n|---|---|\n|a|b<br>c|\n|d||"
    assert one(spark, tables.plain_text(merged), t=1) == "a | b\nc\nd"
    assert one(spark, tables.drop_blank_columns(F.array(F.array(F.lit("a"), F.lit(" "), F.lit("c"))), F.array(F.lit("x"), F.lit("y"), F.lit("z"))), t=1) == (["x", "z"], [["a", "c"]])
    assert one(spark, tables.grid(F.array(*[F.lit(float(x)) for x in (10, 12, 35, 60, 61, 90)])), t=1) == [11.0, 35.0, 60.5, 90.0]


def test_postprocess(spark):
    assert one(spark, postprocess.strikethrough("t"), t="a ¬¬x¬¬ b") == "a ~~x~~ b"
    assert one(spark, postprocess.clamp_headings("t"), t="## a\n##### b") == "#### a\n##### b"
    assert one(spark, postprocess.drop_page_number(F.col("t"), F.lit(7)), t="end 7") == "end"


def test_job_log(spark):
    log = spark.createDataFrame([("a", "1", "pendente", None, 1, False), ("a", "1", None, "m", 2, False), ("a", "1", "erro", None, 3, False), ("a", "2", "pendente", None, 1, True)], "route string, id string, status string, error_message string, updated_at int, deleted boolean")
    got = catalog.latest(log).collect()
    assert [(r.id, r.status, r.error_message) for r in got] == [("1", "erro", "m")]
