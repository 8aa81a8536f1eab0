"""Column functions and relational operators on literal rows."""

from pyspark.sql import functions as F

from leafloom.functions import headings as H
from leafloom.functions import text as X
from leafloom.operators import fidelity, folds, layout, notes, passages, sections, suspects
from leafloom.sources import readers
from leafloom.streaming import ingest as stream


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr).first()[0]


def test_paragraph_ids(spark):
    ids = {"The rioters at the Capitol": "rioters-capitol", "It was on the": "it-was-on-the", "!!! ???": "para", "": "para", "Été à Paris, 1990": "été-à-paris-1990"}
    for text, want in ids.items():
        assert one(spark, X.paragraph_id_base(F.col("t")), t=text) == want


def test_ids_where_a_number_meets_a_base(spark):
    md = spark.createDataFrame([(1, "\n\n".join(["same words here", "same words here 2", "same words here", "other"]))], "doc_id long, markdown string")
    got = [r.para_id for r in sections.paragraphs(md).orderBy("seq").collect()]
    assert got == folds.unique_ids(["same-words-here", "same-words-here-2", "same-words-here", "other"])


def test_headings_agree_with_the_fold(spark):
    lines = ["I. THE RESULTS", "A. Mr. Corbin's Pressure", "1. He should go", "THE TOTAL 12", "SAID THE 100 MEN", "C. Or", "", "AB", "TITLE, WITH, COMMAS", "Plain words."]
    for line in lines:
        got = H.with_heading(spark.createDataFrame([(line,)], "t string"), X.normalise(F.col("t"))).first().h
        assert (tuple(got) if got else None) == D_heading(line), line


def D_heading(line):
    return folds.heading(folds.normalise(line))


def test_ends_and_dangles(spark):
    assert not one(spark, H.ends_sentence(F.col("t")), t="said Mr.")
    assert one(spark, H.ends_sentence(F.col("t")), t="It ended.")
    assert one(spark, H.dangles(F.col("t")), t="The rule of the")


def test_cards_and_previews(spark):
    assert len(one(spark, X.truncate(F.col("t")), t="word " * 100)) <= 281
    assert one(spark, X.fit_to_card(F.col("t")), t="A sentence here. " * 40).endswith(".")
    assert one(spark, X.wrap_in_quotes(F.col("t")), t="plain") == "“plain”"
    assert one(spark, X.card_size(F.length("t")), t="x" * 300) == 40
    assert one(spark, X.strip_tags(F.col("t")), t="<h2>Moody&#39;s &amp; Poor</h2>") == "Moody's & Poor"


def test_page_lines_by_form_feed(spark):
    docs = spark.createDataFrame([(1, "a\nb\f \f c"), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.pg, r.ln, r.t) for r in layout.page_lines(docs).collect()}
    assert got == {(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 2, 0, " c")}


def test_margin_tie(spark):
    books = layout.doc_pages(spark.createDataFrame([(1, "  a\nb"), (2, " "), (3, None)], "doc_id long, text string"))
    assert {tuple(r) for r in layout.doc_margin(books).collect()} == {(1, 0)}


def test_notes(spark):
    md = spark.createDataFrame([(1, "Body.[^9] And.[^8]\n\n## Notes\n\n[^8]: one\n\n[^8]: two\n\n[^99]: left")], "doc_id long, markdown string")
    assert {(r.number, r.status) for r in notes.resolution(md).collect()} == {(9, "missing"), (8, "used"), (99, "orphan")}
    assert [r.text for r in notes.sidenotes(md).collect()] == ["two"]
    assert [r.number for r in notes.orphans(md).collect()] == [99]


def test_gates(spark):
    rows = [(1, "the cat sat on the mat", "the dog sat on the mat"), (2, "the cat", "the cat"), (3, None, "x"), (4, "a b", None), (5, "a", "")]
    pairs = spark.createDataFrame(rows, "doc_id long, source_text string, markdown string")
    assert {r.doc_id: r.ok for r in fidelity.lossless(pairs).collect()} == {1: False, 2: True, 3: None, 5: False}
    assert {r.doc_id: r.words for r in fidelity.foreign_samples(pairs.filter("doc_id = 1")).collect()} == {1: ["dog"]}
    assert {r.doc_id: r.ok for r in fidelity.retention(pairs).collect()}[2] is True
    checks = fidelity.structural_checks(spark.createDataFrame([(1, "Body.[^9]\n\n\n\n[^8]: a\n 12 ")], "doc_id long, markdown string"))
    assert {r.name: r.ok for r in checks.collect()} == {"no bare page-number lines": False, "no form feeds": True, "every reference has a note": False, "document has headings": False, "no runs of blank lines": False}


def test_suspects_have_places_and_contexts(spark):
    texts = spark.createDataFrame([(1, 1, "the cornment; then ofthe log, returned and cornment")], "doc_id long, page int, text string")
    found = suspects.suspects(texts)
    assert {(r.match, r["at"]) for r in found.collect()} == {("cornment", 4), ("cornment", 43), ("ofthe", 19)}
    ranked = suspects.ranked(found).orderBy("rank").collect()
    assert [(r.match, r.n) for r in ranked] == [("ofthe", 1), ("cornment", 2)]


def test_slivers_join(spark):
    md = spark.createDataFrame([(1, "## Short\n\nx\n\n## Long\n\n" + "word " * 50 + "\n\n### Tail\n\ny"), (2, None), (3, ""), (4, "## A\n\n## A\n\n%%page 7%%\n\n" + "word " * 50)], "doc_id long, markdown string")
    got = sections.sections(md.filter("doc_id < 4"), min_chars=100).collect()
    assert [(r.sec_ord, r.slug, r.first_seq, r.last_seq) for r in got] == [(1, "short", 0, 5)]


def test_redirects(spark):
    urls = [("https://www.a.example/x?y=1",), ("https://a.example/pages/z",), ("https://a.example/pagesx",), ("https://old.a.example/q",)]
    got = {r.url: (r.status, r.location) for r in passages.resolve_url(spark.createDataFrame(urls, "url string"), ["/pages"]).collect()}
    assert got == {urls[0][0]: (301, "https://a.example/x?y=1"), urls[1][0]: (301, "https://old.a.example/pages/z"), urls[2][0]: (200, None), urls[3][0]: (503, None)}


def test_cards_by_id_and_phrase(spark):
    paras = spark.createDataFrame([("r", 1, 0, "first-words", "First words here."), ("r", 1, 1, "other", "It holds the phrase twice.")], "report string, doc_id long, seq int, para_id string, text string")
    quotes = spark.createDataFrame([(1, "r", "first-words", None, None), (2, "r", "gone", "the phrase", None), (3, "x", "gone", "the phrase", "Kept.")], "quote_id long, report string, paragraph string, match_text string, quote_text string")
    got = {r.quote_id: (r.how, r.para_id, r.quote) for r in passages.card_quotes(quotes, paras).collect()}
    assert got == {1: ("id", "first-words", "“First words here.”"), 2: ("phrase", "other", "“It holds the phrase twice.”"), 3: ("none", None, "“Kept.”")}


def test_registry_source(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("reports:\n  - {id: a, title: A}\n  - {id: b, title: B, ingested: false, published_at: 1990}\n")
    reg = readers.read_registry(spark, str(tmp_path / "r.yaml"))
    assert [(r.id, r.ord, r.ingested) for r in reg.orderBy("ord").collect()] == [("a", 1, True), ("b", 2, False)]
    assert [r.id for r in passages.catalog(reg).collect()] == ["a"]


def test_text_source_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("page one\fpage two")
    docs = readers.read_page_text(spark, str(tmp_path / "in")).select(F.lit(1).cast("long").alias("doc_id"), "text")
    readers.write_markdown(folds.ingest(docs), str(tmp_path / "md"))
    assert spark.read.parquet(str(tmp_path / "md")).count() == 1


def test_stream(spark, tmp_path):
    src = spark.createDataFrame([(1, "     Body text\nhere."), (1, "     Body text\nhere."), (2, "Other.")], "doc_id long, text string").withColumn("run_at", F.lit("2025-01-01 00:00:00").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    q = stream.start(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_bundled_texts_and_changelog(spark, tmp_path):
    import pytest

    assert [r.markdown for r in readers.bundled(spark, {"a": "A", "b": "B"}, paths=["b"]).collect()] == ["B"]
    with pytest.raises(KeyError):
        readers.bundled(spark, {"a": "A"}, paths=["c"])
    (tmp_path / "c.md").write_text("# Changes\n\nA note.\n\n---\n\n## May\n\nA crane.")
    assert [r.entries for r in readers.read_changelog(spark, str(tmp_path / "c.md")).collect()] == ["## May\n\nA crane."]
    assert tuple(readers.one_quote(spark, "r", "p").first())[:2] == ("r", "p")


def test_review_queue_has_its_head(spark):
    ranked = spark.createDataFrame([(1, 1, "name", "of|the", 3, 2, "a | b", "likely"), (1, 2, "name", "x", 1, 2, "c", "possible")], "doc_id long, rank int, pattern string, match string, n int, page int, context string, confidence string")
    counts = spark.createDataFrame([(1, 9, 4, 2)], "doc_id long, pages int, footnotes int, auto_fixes int")
    lines = [r.line for r in readers.review_queue(ranked, counts, top=1).orderBy("rank").collect()]
    assert lines[0] == "Pages: 9  ·  Footnotes: 4  ·  Auto-fixes applied: 2" and lines[-1] == "| likely | name | `of|the` | 2 | a \\| b |" and len(lines) == 5


def test_verify_of_one_report_and_of_the_run(spark):
    good, bad = "## A\n\nthe cat sat", "the dog"
    pairs = spark.createDataFrame([("a", 1, "## A\n\nthe cat sat", good), ("b", 2, "the cat", bad), ("c", 3, "x", bad), ("a", 4, "y", None)], "report_id string, doc_id long, source_text string, markdown string")
    registry = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "id string, ingested boolean")
    assert {(r.report_id, r.ok) for r in fidelity.verify(pairs, registry).collect()} == {("a", True), ("b", False), (None, False)}
    assert {(r.report_id, r.ok) for r in fidelity.verify(pairs, registry, report="a").collect()} == {("a", True), (None, True)}


def test_sections_by_slug(spark):
    md = spark.createDataFrame([(1, "## Full\n\nx\n\n## One\n\ny[^1]\n\n## Notes\n\n[^1]: a < b")], "doc_id long, markdown string")
    secs = sections.section_texts(md, min_chars=1)
    asked = spark.createDataFrame([(1, "one"), (1, "full"), (1, "gone")], "doc_id long, slug string")
    got = {r.slug: (r.status, r.prev, r.text) for r in passages.section(asked, secs).collect()}
    assert got == {"one": (200, "full", "## One\n\ny[^1]"), "full": (404, None, None), "gone": (404, None, None)}
    body = notes.with_sidenotes(md).first()
    assert body.used == 1 and 'id="sn-1-1"' in body.body and "a &lt; b" in body.body and "[^1]" not in body.body


def moved(df):
    """Of each exchange that a join or grouping needs, the names of the columns that it moves."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, out = [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan], []
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Exchange" and "hashpartitioning" in node.simpleString(1000):
            out.append({node.output().apply(k).name() for k in range(node.output().size())})
    return out


def test_document_passage_moves_no_text(spark, small):
    from leafloom.plans import catalog_queries

    assert not [x for x in moved(catalog_queries()["document_passage"](spark, small)) if x & {"text", "markdown", "paragraphs", "doc_id"}]


def test_documents_by_passage(spark):
    md = spark.createDataFrame(
        [(1, "a", "---\nt: x\n---\nGrey boats[^1]\nleft harbour\n\nGrey boats left harbour"), (2, "a", ""), (3, "a", None), (4, "b", "Grey boats left harbour"), (5, None, "Grey boats left harbour"), (None, "a", "no key")],
        "doc_id long, report string, markdown string",
    )
    asked = [("a", "grey-boats-left-harbour"), ("a", "grey-boats-left-harbour"), ("a", "grey-boats-left-harbour-2"), ("a", None), ("c", "x"), (None, "grey-boats-left-harbour"), (None, None)]
    asked = spark.createDataFrame(asked, "report string, para_id string")
    whole = "Grey boats[^1]\nleft harbour\n\nGrey boats left harbour"
    said = "Grey boats left harbour"
    want = [(1, None, None, whole), (1, "grey-boats-left-harbour", said, whole), (1, "grey-boats-left-harbour-2", said, whole)]
    want += [(2, None, None, ""), (2, "grey-boats-left-harbour", None, ""), (2, "grey-boats-left-harbour-2", None, "")]
    for most in (100, 0):
        got = passages.documents(md, asked, max_broadcast=most)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        texts = [x for x in moved(got) if x & {"text", "markdown"}]
        assert texts == ([] if most else [{"doc_id", "report", "text", "paragraphs", "__salt"}])
