"""The pN_ queries on the small tables, against SQL where it can say the same, else against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("leafloom.llm.queries")
from leafloom.llm import encode, leaks, sentences  # noqa: E402
from leafloom.llm.oracle import ORACLE  # noqa: E402

Q = llm.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(name, spark, small, same_rows):
    assert same_rows(Q[name](spark, small), ORACLE[name]) > 0


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "p7_found"])
def test_rows_are_distinct(name, spark, small):
    rows = Q[name](spark, small).collect()
    assert rows and len(rows) == len(set(rows))


def test_ids_equal_the_whole_encoding(spark, small):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(encode.default_vocabulary())
    whole.encode_special_tokens = True
    rows = Q["p6_ids"](spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    for r in rows:
        assert list(r.ids) == whole.encode(r.text or "", add_special_tokens=False).ids
        assert whole.decode(list(r.ids), skip_special_tokens=False) == (r.text or "")


def test_leaks_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{small}/eval_items.parquet").select("item_id", "passage").collect()
    number: dict = {}
    passages = [(i.item_id, np.array([number.setdefault(w, len(number)) for w in leaks.words(i.passage)])) for i in items]
    common = {w for w, _ in Counter(w for i in items for w in leaks.words(i.passage)).most_common(30)}
    rare = [{number[w] for w in leaks.words(i.passage) if w not in common} for i in items]
    want = set()
    for d in docs:
        for ws in leaks.readings(d.text or ""):
            a = np.array([number.get(w, -1) for w in ws], int)
            own = set(a.tolist())
            want |= {(d.doc_id, i) for (i, p), r in zip(passages, rare) if len(own & r) >= 4 and _brute(a, p)}
    assert want and {tuple(r) for r in Q["p7_found"](spark, small).collect()} == want


def test_candidates_recall(spark):
    """The cells miss at most a tenth of what comparing every window finds; measured on all documents of a table."""
    d = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").filter(F.length("text") > 0)
    held = leaks.held_out(spark.read.parquet(f"{d}/eval_items.parquet"))
    space = leaks.latent_space(texts, held)
    index = leaks.build_index(space, [tuple(r) for r in held.orderBy("item_id").collect()])
    assert len(index.cells) > leaks.PROBES
    read = [np.array([space.number.get(w, -1) for w in leaks.words(r.text)], np.int64) for r in texts.collect()]
    every = {(k, i) for k, i in leaks.candidates(space, index, read, probes=len(index.cells)) if leaks.shares_stretch(read[k], index.passages[i])}
    found = {(k, i) for k, i in leaks.candidates(space, index, read) if leaks.shares_stretch(read[k], index.passages[i])}
    assert every and len(found) >= 0.9 * len(every)


def _brute(a, p):
    """Every pair of places, every length."""
    equal = (a[:, None] == p[None, :]).astype(int)
    total = np.zeros_like(equal)
    for n in range(1, min(equal.shape) + 1):
        total = total[: equal.shape[0] - n + 1, : equal.shape[1] - n + 1] + equal[n - 1 :, n - 1 :]
        if n >= leaks.STRETCH and (n - total <= n // leaks.REPLACED).any():
            return True
    return False


def test_sentences_cover_their_texts(spark, small):
    texts = {r.quote_id: r.quote_text for r in spark.read.parquet(f"{small}/share_quotes.parquet").filter(F.col("quote_text").isNotNull()).collect()}
    rows = Q["p2_found"](spark, small).filter("tab = 'share_quotes'").collect()
    spans: dict = {}
    for r in rows:
        spans.setdefault(r.row_id, []).append((r.start_at, r.end_at))
    for k, text in texts.items():
        kept = "".join(text[a:b] for a, b in sorted(spans.get(k, [])))
        assert "".join(kept.split()) == "".join(text.split())


def test_stuffed_pages_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/doc_labels.parquet").dropDuplicates(["doc_id"])
    from leafloom.llm import stuffing

    fit, held = labels.filter("pmod(xxhash64(doc_id), 2) = 0"), labels.filter("pmod(xxhash64(doc_id), 2) = 1")
    found = {r.doc_id for r in stuffing.stuffed_pages(docs, fit).collect()}
    got = held.collect()
    right = sum((r.doc_id in found) == (r.label == "spam") for r in got)
    assert right >= 0.85 * len(got)  # some labels are wrong by design


def test_every_sentence_split_is_known():
    cases = {
        "The dispatcher wrote: “No one called.” (The chief engineer did not answer.) Done.": 3,
        "Dr. Dunnekin measured 40.68 cm, i.e. nearly 36.82 in. more than Ms. Torralisk had allowed.": 1,
        "Mardastad answered, “I read it. I signed it,” and sat down. Nobody knew!": 2,
        "“Was it ... burned?” Felrakin was asked; “Yes, all of it!” came the reply.": 1,
        "“It was not my signature.” Payments stopped in May.": 2,
        "The tribunal adjourned at 9 p.m. The claim came from Bralovane Bros. Ltd. in Ivedelby.": 2,
        "„Wer hat unterschrieben?“, fragte der Hafenmeister. Der Nachtrag wurde am 7. Oktober gesehen.": 2,
        "« Qui a signé ? » demanda le comptable. Voir l’art. 952 et la p. 294.": 2,
        "誰も知らなかった！港長は「署名していない。」と述べた。": 2,
        "“谁批准了锅炉房？”委员会问道。没有人知道！": 2,
        "ใครเป็นผู้สั่งปิดประตูน้ำ เสมียนเวรตอบว่า“ผมไม่ได้ลงชื่อ” ในปี 1992 ตรวจสอบ 864 ฉบับ": 3,
        "किसी को पता नहीं था! डॉ. Corthestad ने 26.77 मीटर मापा।": 2,
        "پل بند تھا۔ کسی نے دستخط نہیں کیے۔": 2,
        "Դուռը փակ էր։ Ոչ ոք չգիտեր։": 2,
        "በሩ ተዘግቶ ነበር። ማንም አያውቅም።": 2,
        "တံခါးပိတ်ထားသည်။ ဘယ်သူမှမသိပါ။": 2,
        "ទ្វារបិទ។ គ្មាននរណាដឹងទេ។": 2,
        "སྒོ་བརྒྱབ། སུས་ཀྱང་མི་ཤེས།": 2,
        "Он жил на ул. Ленина в доме 5. Никто не знал.": 2,
        "“I never saw it.” F. M. Jarragrave testified that the figure was wrong.": 2,
        "“Who signed it?” the deputy records clerk of the Vantelgarth Harbour and Ullenford Valley District Council of Assessors and Auditors in the Matter of the Lower Gate asked.": 1,
        "“It was shut.” Dr. Ulvador of the Torligrave Boiler Works Company said so. Nobody knew.": 2,
        "He named two:\n- “the gate\n- the lock. It was shut.": 4,
        "قال أمين المحفوظات: «لم أوقع.» لا أحد يعلم!": 2,
    }
    for text, n in cases.items():
        assert len(sentences.sentence_spans(text)) == n, [text[a:b] for a, b in sentences.sentence_spans(text)]
