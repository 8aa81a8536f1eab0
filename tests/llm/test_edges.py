"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns: each operator has a defined result."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("leafloom.llm")
from leafloom.llm import channel, encode, leaks, markup, pieces, scans, sentences, sitelines, stuffing  # noqa: E402

LONG = "Plain words and more of them. " * 20_000
TEXTS = [(1, None), (2, ""), (3, " \n "), (4, "One. Two."), (4, "One. Two."), (None, "Three."), (5, LONG)]


def texts(spark, rows=TEXTS):
    df = spark.createDataFrame([("blocks", k, t) for k, t in rows], "tab string, row_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("families", "piece", "sentence", "site_n", "k1", "ids", "share")})


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "item_id", "share", "label", "term", "n")})


def test_encode(spark):
    got = encode.encode_ids(docs(spark), "doc_id", "text").collect()
    assert len(got) == len(TEXTS)
    assert [list(r.ids) for r in got if r.doc_id in (1, 2)] == [[], []]
    assert sum(r.doc_id is None for r in got) == 1
    assert encode.encode_ids(docs(spark, [(0, "x")]).limit(0), "doc_id", "text").count() == 0


def test_encode_hard_texts():
    e = encode.FragmentEncoder(encode.default_vocabulary())
    hard = ["<|endoftext|>", "I'd've 'll n't", "a  b\n\n c\t d", "é　。中", "x" * 5000, "\xa0 a", "…. ..", " ' s"]
    assert e.encode(hard) == [x.ids for x in e.tokenizer.encode_batch(hard, add_special_tokens=False)]


def test_cuts_lie_in_no_token():
    tokens = encode.vocabulary_tokens(encode.default_vocabulary())
    cuts = encode.ForcedCuts(tokens)
    for a, b in zip(*[iter(cuts.split("He said, don't go to St. Ives (now)."))] * 2):
        assert not cuts.joined[a.encode()[-1], b.encode()[0]]
    assert "".join(cuts.split("a b, c\n d")) == "a b, c\n d"


def test_sentences(spark):
    got = sentences.sentences(texts(spark)).collect()
    assert sum(r.row_id == 4 for r in got) == 4 and not [r for r in got if r.row_id in (1, 2, 3)]
    assert sum(r.row_id is None for r in got) == 1
    assert sentences.sentences(texts(spark).limit(0)).count() == 0


def test_markup(spark):
    rows = [*TEXTS, (7, "<b>bold"), (8, "a '''b''' c"), (9, "\\emph{x"), (10, "see **x** and `y`"), (11, "5 < 6 and 7 * 8 costs $3.10 and $4.20 in log_1_final.txt # 5 [inaudible] AT&T")]
    got = {r.row_id: r.families for r in markup.residue(texts(spark, rows)).collect()}
    assert got == {7: ["html"], 8: ["wiki"], 9: ["latex"], 10: ["markdown"]}
    assert markup.cleaned(texts(spark).limit(0)).count() == 0
    every = markup.cleaned(texts(spark, rows)).collect()
    assert len(every) == len(rows) and {r.row_id: r.clean for r in every if r.row_id in (1, 2, 5, 7, 8)} == {1: None, 2: "", 5: LONG, 7: "bold", 8: "a b c"}


def test_markup_prefilter_passes_every_rule(spark):
    forms = ["damaged word]] here", "|-", "so $x^2$ is", "then $$E=mc^2$$ holds", "[1]: https://a.example", "## Heading", "#REDIRECT Report", "--- | x", "1 - a\n- b\n- c"]
    got = {r.row_id for r in markup.residue(texts(spark, list(enumerate(forms)))).collect()}
    assert got == {k for k, x in enumerate(forms) if markup.families(x, False)} == set(range(len(forms)))


def test_markup_keeps_structure():
    t = "<h3>Title</h3><ul><li>one</li><li>two</li></ul><table><tr><td>1</td><td>2</td></tr></table><pre>x &lt; 1</pre>"
    out = markup.clean_text(t, False)
    assert all(x in out for x in ("### Title", "- one", "- two", "| 1 | 2 |", "```\nx < 1"))
    assert markup.clean_text("\\section{A}\n\\[ x^2 \\]\n\\emph{b}", False) == "## A\n\\[ x^2 \\]\nb"
    assert markup.clean_text("{| class=\"w\"\n! A !! B\n|-\n| 1 || 2\n|}\n[[x|y]] '''z'''", False).split("\n")[:2] == ["| A | B |", "| 1 | 2 |"]


def test_content_lines_drop_link_bars():
    text = "<a href=x>A</a> <a href=y>B</a>\n<a href=x>C</a> <a href=y>D</a>\n<a>E</a>\n" + "\n".join("A long line of ordinary running text with <b>one</b> mark in it, and more words after it." for _ in range(8))
    keep = markup.content_lines(text)
    assert keep[0] is False and all(keep[4:])


def test_site_lines(spark):
    note = "Share this passage with a friend (%d)"
    rows = [("t", "s", k, k, f"own text number {'abcdefghijklmnop'[k]}\n{note % k}") for k in range(10)] + [("t", None, 50, 50, note), ("t", "s", 51, None, note), ("t", "s", 52, 52, None), ("t", "s", 0, 0, "again")]
    df = spark.createDataFrame(rows, "tab string, site string, row_id long, doc long, text string").withColumn("scope", F.lit(1)).withColumn("word_no", F.lit(2))
    sites = df.select("site", "doc").distinct()
    got = sitelines.excess_lines(df, sites).collect()
    assert {(r.row_id, r.line_no) for r in got} == {(k, 1) for k in range(10)}
    assert {(r.row_id, r.line_no) for r in sitelines.excess_lines(df, sites, max_broadcast=0).collect()} == {(k, 1) for k in range(10)}
    for bound in (10, 0):
        clean = sitelines.clean_texts(df, sites, max_broadcast=bound).collect()
        assert len(clean) == len(rows) and {r.row_id: r.text for r in clean if r.row_id in (1, 50, 52)} == {1: "own text number b", 50: note, 52: None}
    assert sitelines.excess_lines(df.limit(0), sites).count() == 0


def test_site_line_thresholds_count_ties(spark):
    rows = [("t", "s", k, k, "the very same line" if k < 4 else f"nothing here {'qwertyuiopasdfghjklz'[k]}") for k in range(20)]
    df = spark.createDataFrame(rows, "tab string, site string, row_id long, doc long, text string")
    assert sitelines.excess_lines(df, df.select("site", "doc")).count() == 4
    assert sitelines.excess_lines(df, df.select("site", "doc"), min_share=0.21).count() == 0


def test_pieces(spark):
    got = pieces.pieces(texts(spark), limit=F.lit(2000), overlap=F.lit(200)).filter("row_id = 5").orderBy("piece_no").collect()
    assert all(len(r.piece) <= 2000 for r in got) and all(b.piece.startswith(a.piece[-200:]) for a, b in zip(got, got[1:]))
    assert got[0].piece + "".join(r.piece[200:] for r in got[1:]) == LONG
    assert {r.row_id for r in pieces.pieces(texts(spark), limit=F.lit(2000), overlap=F.lit(200)).filter("piece_no = 0").collect()} == {2, 3, 4, None, 5}
    assert pieces.pieces(texts(spark).limit(0), limit=F.lit(10), overlap=F.lit(2)).count() == 0


@pytest.mark.parametrize("text", ["x" * 5000, "## A\n\n" + "word " * 900 + "\n\n## B\n\n" + "word " * 100, "。" * 3000, "a\n" * 3000, " " * 3000])
def test_pieces_keep_everything(text):
    spans = pieces.split_text(text, 1000, 100)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b - a <= 1000 for a, b in spans)
    assert all(y[0] == max(x[0], x[1] - 100) for x, y in zip(spans, spans[1:]))


def test_pieces_cut_at_headings():
    text = "## A\n\n" + "one two. " * 60 + "\n\n## B\n\n" + "three four. " * 40
    assert text[pieces.split_text(text, 700, 50)[0][1] :].startswith("## B")


def test_leaks(spark):
    passage = " ".join(f"w{k}" for k in range(40))
    words = passage.split()
    rows = [(1, None), (2, ""), (3, " ".join(words[5:20])), (4, " ".join(words[5:19])), (5, "W5, " + " ".join(words[6:12]) + " xx " + " ".join(words[13:20])), (6, " ".join(["a", *words[0:8], "q", *words[9:13], "r", *words[14:15]])), (7, "filler " * 9000 + " ".join(words[10:30])), (8, " ".join(words[:10]) + "-\n" + " ".join(words[10:20]))]
    items = spark.createDataFrame([(1, passage), (2, None), (3, "too short"), (4, passage)], "item_id long, passage string").withColumn("doc_id", F.lit(0))
    leaked = lambda d, i, **kw: {(r.doc_id, r.item_id) for r in leaks.leaks(d, i, **kw).collect()}
    got = leaked(docs(spark, rows), items)
    assert got == {(d, i) for d in (3, 5, 7, 8) for i in (1, 4)}
    assert leaks.leaks(docs(spark, rows), items.limit(0)).count() == 0
    assert leaks.leaks(docs(spark, rows).limit(0), items).count() == 0
    assert leaked(docs(spark, rows), items, max_items=1) == got


def test_stuffing(spark):
    stuffed = "Free download cheap files. Free download cheap files! " * 10
    rows = [*[(k, f"{stuffed} {k}") for k in range(10, 16)], *TEXTS[:4], (7, "The clerk of the town wrote to the council about the bridge, and nobody answered him before May.")]
    none = spark.createDataFrame([], "doc_id long, label string")
    got = {r.doc_id for r in stuffing.stuffed_pages(docs(spark, rows), none).collect()}
    assert set(range(10, 16)) <= got and not got & {1, 2, 3, 4, 7}
    joined = {r.doc_id for r in stuffing.stuffed_pages(docs(spark, rows), none, max_broadcast=0).collect()}
    assert joined == got  # the way for many keywords gives the same
    assert stuffing.stuffed_pages(docs(spark, rows).limit(0), none).count() == 0


def test_scans(spark):
    body = "The committee heard the engineer of the harbour trust about the inspection of the well-known gate. " * 30
    page = "The committee heard the engin-\neer of the harbour trust.\n   12\nA well-\nknown inspcction ofthe gate and the har bour.\n"
    rows = [(k, body, body) for k in range(20)] + [(50, page, None), (51, None, ""), (52, "", None)]
    runs = spark.createDataFrame(rows, "row_id long, source_text string, markdown string")
    model = channel.learn(runs.select(F.explode(F.array("source_text", "markdown")).alias("text")))
    queue = spark.createDataFrame([(1, "inspcction", "of the inspcction of"), (2, "inspection", None), (3, None, "x"), (4, "", ""), (5, "har bour", "the har bour trust")], "row_id long, match_text string, context string")
    got = {tuple(r) for r in scans.scan_cases(runs.withColumn("kind", F.lit(1)), queue.withColumn("field", F.lit(1)), model).collect()}
    assert got == {("source_text", 50, 0, "break"), ("source_text", 50, 2, "furniture"), ("source_text", 50, 4, "misread"), ("suspect", 1, 0, "misread"), ("suspect", 5, 0, "misread")}
    fixed = {r.row_id: r.paragraphs for r in scans.repaired_texts(runs, model).collect()}
    assert fixed[50].startswith("The committee heard the engineer of the harbour trust.") and "inspection" in fixed[50] and fixed[51] is None
    empty = channel.learn(runs.select(F.col("source_text").alias("text")).limit(0))
    assert scans.scan_cases(runs.limit(0), queue.limit(0), empty).count() == 0


def scan_model(words="", pairs=None):
    """Words that are known well, the joined ones beside their parts."""
    counts = {w: 200 for w in f"repayment schedule lay in an arid store room report inspection harbour engineer well-known {words}".lower().split()}
    counts |= {"of": 3000, "the": 5000, "in": 1500, "and": 2000}
    return channel.Model(100_000, counts, set(counts), pairs or {}, set())


def test_repair_leaves_no_case():
    model = scan_model()
    text = "The inspcction ofthe har bour,\nOfthe rep- ort of l946 at 12 :30 and $l2.5O in the Inspcction\nof 0 3/04/1950. A well-\nknown INSPCCTION"
    assert {k for _, k in scans.read_text(model, text, "", markdown=False).cases} == {"break", "misread"}
    fixed = scans.repaired(model, text, "")
    assert fixed.startswith("The inspection of the harbour, Of the report of 1946 at 12:30 and $12.50 in the Inspection of 03/04/1950. A well-")
    assert fixed.endswith("known INSPECTION")
    assert not scans.read_text(model, fixed, "", markdown=False).cases


def test_repair_carries_notes_past_a_divided_word():
    text = "The harbour and its repay-\n56 Harbour Trust, Docket No. 613.\n57 See Report 12.\n\n   Page 1\n   REPORT BY 286/VASGUPELL   2\n\nment schedule lay in the well-\nknown room.\n\nAn engi-\nneer."
    assert scans.repaired(scan_model(), text, "").split("\n\n") == [
        "The harbour and its repayment schedule lay in the well-known room.",
        "56 Harbour Trust, Docket No. 613. 57 See Report 12.",
        "An engineer.",
    ]


def test_repair_of_markdown_keeps_its_forms(spark):
    front = '---\ntitle: "The Inspcction"\n---\n\n'
    text = front + (
        "%%page 1%%\n\n### Ofthe Harbour\n\n> The inspcction of  the rep- ort.[^5]\n\n- 1 -\n\nThe harbour and its repay-\n\n%%page 2%%\n\nment schedule lay in the\n\n[2]\n\n"
        "room.\n\n- Report — 12\n\n[^5]: See the well-\nknown har bour."
    )
    want = front + (
        "%%page 1%%\n\n### Of the Harbour\n\n> The inspection of  the report.[^5]\n\nThe harbour and its repayment schedule lay in the room.\n\n%%page 2%%\n\n"
        "- Report — 12\n\n[^5]: See the well-known harbour."
    )
    model = scan_model()
    assert scans.repaired_markdown(model, text, "") == want
    runs = spark.createDataFrame([(1, text, text), (2, None, None)], "row_id long, source_text string, markdown string")
    got = {(r.field, r.row_id): r.paragraphs for r in scans.repaired_texts(runs, model).collect()}
    assert len(got) == 4 and got["markdown", 1] == want and got["source_text", 2] is None and got["markdown", 2] is None


def test_rare_words_are_known_at_any_size(spark):
    rare = "The Quilthevane memorandum was inspcted. " * 5
    texts = spark.createDataFrame([(rare,), *[("the of and in " * 250_000,)] * 6], "text string")
    model = channel.learn(texts)
    assert model.total > 6_000_000 and model.count("quilthevane") == 5 and channel.corrected(model, "the memo randum")[0] == "the memorandum"


def test_shelves_give_the_same(spark, small):
    runs = spark.read.parquet(f"{small}/ingest_results.parquet").select(F.col("result_id").alias("row_id"), "source_text", "markdown")
    queue = spark.read.parquet(f"{small}/suspects.parquet").select(F.col("suspect_id").alias("row_id"), "match_text", "context")
    texts = runs.select(F.explode(F.array("source_text", "markdown")).alias("text"))
    sent, shelved = channel.learn(texts), channel.learn(texts, max_words=0, max_pairs=0)
    assert all(isinstance(x, channel.Shelf) for x in (shelved.words, shelved.lower, shelved.tracked, shelved.pairs))
    want = sorted(map(tuple, scans.scan_cases(runs, queue, sent).collect()))
    assert want and sorted(map(tuple, scans.scan_cases(runs, queue, shelved).collect())) == want
    assert scans.repaired_texts(runs, shelved).exceptAll(scans.repaired_texts(runs, sent)).count() == 0


def test_break_is_found_over_many_notes():
    notes = "".join(f"{k} See Exhibit {k}-2 of Woldal, at a very\n   long place, 314.\n" for k in range(50, 62))
    text = f"The harbour and its repay-\n{notes}\n   Page 1\n\n\nment schedule lay in the room."
    found = scans.read_text(scan_model(), text, "", markdown=False)
    assert (0, "break") in found.cases and text.split("\n")[found.divided[0]].startswith("ment")


def test_model_survives_sending():
    import pickle

    model = channel.Model(1000, {"the": 300, "of": 200}, {"the", "of"})
    assert pickle.loads(pickle.dumps(model)).words == model.words


def test_title_beyond_a_long_front_matter():
    from leafloom.llm import scans as s

    front = "---\n" + "".join(f'note_{k}: "{"x" * 60}"\n' for k in range(80)) + 'title: "Harbour Trust Accounts"\n---\n\nText.'
    assert s.title_of(front) == "Harbour Trust Accounts" and s.title_of(None) == "" and s.title_of("no front\ntitle: x") == ""


def test_every_odd_spelling_is_followed():
    model = scan_model("illlliillio")
    assert channel.corrected(model, "the 11111111110 of")[0] == "the 11111111110 of"  # a number
    assert channel.corrected(model, "the i1111ii111o of")[0] == "the illlliillio of"


def test_found_lines_are_the_repaired_ones(spark, small):
    runs = spark.read.parquet(f"{small}/ingest_results.parquet").select(F.col("result_id").alias("row_id"), "source_text", "markdown")
    model = channel.learn(runs.select(F.explode(F.array("source_text", "markdown")).alias("text")))
    for r in runs.collect():
        for text, md in ((r.source_text, False), (r.markdown, True)):
            if text:
                found = scans.read_text(model, text, scans.title_of(r.markdown), markdown=md)
                lines = text.split("\n")
                inline = {i for i, k in found.cases if k == "misread" or (k == "break" and i not in found.divided)}
                assert inline <= found.printed.keys() and all(found.printed[i] != lines[i] for i in inline)


def test_prose_of_any_language_is_no_stuffing(spark):
    prose = {
        "ja": "港長によれば、水門の修理後に費用が増えたが、理由は分からない。委員会は再提出を求めた。誰も署名していない。",
        "ar": "قال أمين المحفوظات إن القناة لم تفتح في ذلك اليوم ولم يبلغ أحد عن العطل في محطة الإشارات. وطلبت اللجنة نسخة أخرى من السجل.",
        "ru": "Начальник порта сообщил комиссии, что ворота шлюза не открывались до мая, и никто не мог объяснить, почему журнал был подписан дважды.",
        "hi": "बंदरगाह के अभिलेखपाल ने आयोग को बताया कि फाटक मई तक नहीं खुला और किसी ने रजिस्टर पर हस्ताक्षर नहीं किए।",
    }
    rows = [(k, t, lang) for k, (lang, t) in enumerate(prose.items())]
    stuffed = "Free download cheap files. Free download cheap files! " * 10
    df = spark.createDataFrame([*rows, *[(k, f"{stuffed} {k}", "en") for k in range(10, 16)]], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, label string")
    assert {r.doc_id for r in stuffing.stuffed_pages(df, none).collect()} == set(range(10, 16))


def test_copies_count_once_either_way(spark):
    df = spark.createDataFrame([(k, "one text" if k % 3 == 0 else f"text {k}") for k in range(30)], "doc_id long, text string")
    for bound in (10, 0):
        assert sorted(r.doc_id for r in stuffing.without_copies(df, max_broadcast=bound).collect()) == [0, *(k for k in range(30) if k % 3)]


def test_pieces_follow_the_tree():
    def section(name, n):
        return f"{name}\n\n" + "A sentence of Dr. Vasgupell stands here. " * n + "\n\n"

    text = "".join(section(f"# C{c}", 3) + "".join(section(f"## S{c}.{k}", 11) for k in (1, 2, 3)) for c in (1, 2, 3))
    spans = pieces.split_text(text, 1200, 100)
    ends = [b for _, b in spans]
    assert spans[0][0] == 0 and ends[-1] == len(text) and all(b - a <= 1200 for a, b in spans)
    for end in ends:
        assert not text[:end].rstrip().split("\n")[-1].startswith("#")  # no bare heading
        assert not text[:end].rstrip().endswith("Dr.")
    starts = [0, *ends[:-1]]
    for a, b in zip(starts, ends):  # a piece never takes the end of one chapter and the beginning of the next
        assert text[a:b].lstrip().startswith("#") and text[a:b].count("# C") - text[a:b].count("## C") <= 1


def test_pieces_keep_code_tables_and_lists_whole():
    code = "```\n" + "x = [1, 2]  # a line. Of code\n\n" * 12 + "```\n"
    table = "| a | b |\n|---|---|\n" + "| one. | two. |\n" * 15
    formula = "$$\na = b. \\\\\nc = d.\n$$\n"
    text = "Prose stands here. " * 20 + "\n\n" + code + "\n" + "More of it. " * 20 + "\n\n" + table + "\n" + formula + "\n- one\n  - under one\n- two\n\n" + "The end is near. " * 40
    for end in [b for _, b in pieces.split_text(text, 700, 50)][:-1]:
        for block in (code, table, formula):
            at = text.index(block)
            assert not at < end < at + len(block)


def test_markup_probes():
    code = "```\n[[1,2],[3,4]] and ''x''\nprint('<b>') # \\emph{y} **z**\n```"
    assert code in markup.clean_text(f"See **this** and <i>that</i> and [[a|b]].\n\n{code}\n\nEnd.", False)
    assert markup.clean_text("\\a{\\b{\\c{\\d{\\e{deep}}}}} x", False) == "deep x"
    assert markup.clean_text("A {{a|{{b|{{c|d}}}}}} b [[x|the [[y|inner]] link]] c", False) == "A  b the inner link c"
    formula = "$" + " + ".join(f"a_{{{k}}}" for k in range(200)) + "$"
    assert markup.clean_text(f"So {formula} holds, \\emph{{as said}}.", False) == f"So {formula} holds, as said."
    table = "\\begin{tabular}{lr}\nA & B \\\\\n\\hline\n1 & 2 \\\\\n\\end{tabular}\n"
    assert "| A | B |\n| 1 | 2 |" in markup.clean_text("\\section{T}\n" + table, False)
    assert markup.clean_text("\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}", False).split("\n")[:2] == ["- one", "- two"]
    assert markup.clean_text("Of the harbour\n=====\n\nIt was *shut*.\n```\na[7] = 1\n``` [[Category:X]]", False) == "# Of the harbour\n\nIt was shut.\n```\na[7] = 1\n``` "
    assert "x < 1 [[y]]" in markup.clean_text("<p>See [[a]]</p><pre>x &lt; 1 [[y]]</pre>", False)


def test_bars_of_links_go_in_every_language():
    prose = "\n".join("A long line of ordinary running text with ''one'' mark in it, and more words after it." for _ in range(8))
    bar = "[[A]] [[B]] [[C]] [[D]]\n[[E]] [[F]] [[G]]\n[[H]] [[I]]\n"
    out = markup.clean_text(bar + prose, False)
    assert not out.startswith("A B") and out.count("ordinary") == 8


def test_long_markup_is_linear():
    import time

    for t in ("{{a|" * 50_000, "\\emph{" * 50_000, "[[a|" * 50_000, "<b>" * 50_000, "$x " * 50_000, "'' " * 50_000, "| a\n" * 50_000):
        start = time.time()
        markup.clean_text(t, False)
        assert time.time() - start < 20


def test_hyphens_are_decided_one_by_one(spark):
    passage = "the chief engineering works of the well known gate were shut in may by order of the harbour trust and its clerk"
    text = "The chief engi-\nneering works of the well-\nknown gate were shut in May by order of the har-\nbour trust"
    items = spark.createDataFrame([(1, passage, "harbour trust"), (2, passage, "nobody")], "item_id long, passage string, answer string")
    got = {(r.item_id, r.answered) for r in leaks.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), items).collect()}
    assert got == {(1, True), (2, False)}


def test_long_passages_align_in_parts():
    import numpy as np

    a = np.arange(9000)
    assert leaks.shares_stretch(a[8500:8516], a) and not leaks.shares_stretch(a[8500:8514], a)
