import re
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from phraselode.llm import sentences
from phraselode.llm.sentences import Corpus, sentence_units

CORPUS = Corpus(common=frozenset("the it at in we they of to and a local was left said people".split()), starters=frozenset("the it at in we they".split()), stops={"p.m": (90, 3), "a.m": (0, 90), "hours": (90, 1)})

# Units are separated by |, which stands for white space between them or nothing where it is doubled.
CASES = [
    "Dr. Smith left at 5 p.m. | The road to Mt. Jade was closed.",
    "Flight no. 84 left at 5.24 a.m. local time. | It was late.",
    "The U.N. team stayed from Mon. to Thurs. of that week. | They left.",
    "Crews from A, Losto etc. were sent. | It fell from 27.27 to 27.92 m, i.e. 2 m.",
    "“We heard it twice. Then it went dark,” said Gisestol. | We left.",
    "Gen. Fizas (ret.) called it “one more like that.” | We left.",
    "\"Is the road open?\" Narutil asked. | It is.",
    "'Not again!' cried Dodo, 'not in Lapir.' | The farmers' union can't wait.",
    "(Jifi spoke before it left.) | Gojul waited.",
    "Release 2.464.1 is kept at maps.rarejil.example for now. | Why wait for Bobin?! | Nobody in Kru knows ... yet.",
    "See fig. 3 and pp. 5-6 of the survey by G. R. Hokremin et al. for Biso. | It held 5,000 t (see sec. 4.2).",
    "It was reported.||The people left.",
    "IT LEFT AT 5 P.M. | THE CREWS OF DR. BIB AND THE LIT CO. PLANT LEFT.",
    "It moved east\nand they left.\n | A Headline\n\n | The end",
    "Das Rote Lager meldete am 22. Mai Hagel. | Hans bat um 4,90 Mio. Kronen, z. B. mit Gold. | „Es war laut. Dann kam das Wasser“, sagte er.",
    "Le prix atteint 17,52 couronnes à Zakus ! | « Le pont a cédé. Nous avons couru », raconte Mme Gezubras. | M. Truzo a quitté Reme.",
    "¿Quién ayuda a Zevitrar? | «Se oyó un golpe. Luego nada», dijo la Dra. Nova. | El 21.",
    "W 1995 r. Sihul opisał Pebram. | Brakuje m.in. 163 ton, tj. o 9 m. | Kto pomoże?",
    "В 1995 г. Козебив описал Мигев. | На ул. Гоголя тихо. | «Был гул. Потом всё стихло», — сказал Иван.",
    "桥断了。||谁来帮助？||“桥断了。我们都跑了。”堡垣镇的居民说。||水位上升了0.55米！",
    "「橋が落ちた。みんな逃げた。」と住民は話した。||水位は13.9メートル上がった。",
    "डॉ. मुवेरीनगर ने बात की। | “पुल टूट गया। हम भागे,” लोगों ने कहा। | मदद कौन करेगा?",
    "قال د. اليعتشد إن أسرة غادرت. | «سقط الجسر. ثم هربنا»، قال سكان. | من يساعد؟",
    "ทีมกู้ภัยส่งข้าว183ตัน | การท่าเรือส่งข้าว815ตัน",
    "no marks at all just words on and on",
    "iMap users left. | iMap users came.",
]


@pytest.mark.parametrize("case", CASES)
def test_units(case):
    want = [u.strip() for u in case.replace("||", "|").split("|")]
    text = case.replace("||", "").replace(" | ", " ").replace("|", "")
    assert [text[a:b] for a, b in sentence_units(text, CORPUS)] == want


@given(st.text("aB.!? \n\r\t\"'()“”。1ก", max_size=80))
def test_every_character_is_in_one_unit(text):
    at = 0
    for a, b in sentence_units(text, CORPUS):
        assert text[at:a].strip() == "" and a < b and not text[a].isspace() and not text[b - 1].isspace()
        assert not sentences._PARAGRAPHS.search(text[a:b])
        at = b
    assert text[at:].strip() == ""


def test_blank_lines_end_units():
    for gap in ("\n\n", "\n \t\n", "\r\n\r\n", "\r\n \r\n", "\r\r"):
        assert len(sentence_units(f"one{gap}two")) == 2
    for gap in ("\n", "\r\n", "\r", " \n "):
        assert len(sentence_units(f"one{gap}two")) == 1


def test_documents(spark):
    schema = "doc_id bigint, text string, sent_start string, word string, n string"
    rows = [(1, None), (2, ""), (3, " \n "), (4, "A b. C d."), (None, "E."), (4, "A b. C d."), (5, "x. " * 30_000)]
    got = sentences.split_sentences(spark.createDataFrame([(*r, "x", "x", "x") for r in rows], schema)).collect()
    found = sorted((r.doc_id or -1, r.sent_start, r.sent_end) for r in got if r.doc_id != 5)
    assert found == [(-1, 0, 2), (4, 0, 4), (4, 0, 4), (4, 5, 9), (4, 5, 9)]
    assert sentences.split_sentences(spark.createDataFrame([], schema)).count() == 0


def test_statistics_come_from_all_texts(spark):
    texts = ["The plant of Zuta Xyz. said it was left. The people left." for _ in range(50)]
    c = sentences.corpus_statistics(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert c.stops["xyz"] == (0, 50) and c.stops["left"] == (50, 0) and "people" in c.common
    assert len(sentence_units("It was the Xyz. plant of old.", c)) == 1


def test_the_document_is_asked_before_the_corpus():
    common = Corpus(common=frozenset("mara the was of sent".split()))
    # A name of the document, though the corpus has a word spelt like it.
    assert len(sentence_units("“Stop!” Mara cried. They saw Mara, and so did Mara of Tes.", common)) == 2
    # An unlisted abbreviation of any length that the document itself has before lower case or a number.
    for word in ("Abteil", "Präfektur"):
        assert len(sentence_units(f"It was the {word}. of old. We saw {word}. Zuta there.", common)) == 2


def test_what_the_corpus_says_does_not_depend_on_its_size(spark):
    rare = ["The plant of Zuta Xyz. said it was left. The people left." for _ in range(10)]
    for n in (0, 3000):
        texts = [(i, t) for i, t in enumerate(rare + ["The road was long and it was open to all of them there. " * 100] * n + ["It was the Xyz. Plant of old."])]
        docs = spark.createDataFrame(texts, "doc_id bigint, text string")
        got = sentences.split_sentences(docs).filter(f"doc_id = {len(texts) - 1}").collect()
        assert len(got) == 1, n


def test_lists_are_the_last_resort(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    corpus = sentences.corpus_statistics(docs)
    texts = [r.text for r in docs.collect() if r.text]
    with_lists = [set(sentence_units(t, corpus)) for t in texts]
    for name in ("FOLLOWED", "MAY_END", "OF_YEAR", "MONTHS", "_AMBIGUOUS"):
        monkeypatch.setattr(sentences, name, frozenset())
    without = [set(sentence_units(t, corpus)) for t in texts]
    both = sum(len(a & b) for a, b in zip(with_lists, without))
    assert both > 0.99 * sum(map(len, with_lists)) and both > 0.99 * sum(map(len, without))


@pytest.mark.parametrize("copies,most", [(2, 0), (10_000, 0), (10_000, 32_000_000)])
def test_words_joined_say_the_same_as_words_sent(spark, monkeypatch, copies, most):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(docs.filter("doc_id < 20")).unionByName(docs.filter("doc_id < 10"))
    monkeypatch.setattr(sentences, "SENT_SHARE", 0.0)
    sent = sorted(map(tuple, sentences.split_sentences(docs).collect()))
    monkeypatch.setattr(sentences, "SENT_SHARE", 2.0)
    monkeypatch.setattr(sentences, "COPIES", copies)
    monkeypatch.setattr(sentences, "BROADCAST_BYTES", most)
    assert sorted(map(tuple, sentences.split_sentences(docs).collect())) == sent


def test_steps_of_a_sentence():
    """p6_found: calls that a sentence takes, which don't depend on the machine."""
    text = " ".join(f"The engine of number {k} ran well, and Dr. Smith saw it. Nobody knew why; it cost 3.50 a day." for k in range(200))
    corpus = sentences.Corpus(common=frozenset(["nobody", "the"]), stops={"it": (9, 0), "day": (9, 0), "dr": (0, 9)})
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = sentences.document_units(text, corpus.said)
    finally:
        sys.setprofile(None)
    assert len(found) == 400
    assert steps < 50 * len(found)


@given(st.text(st.sampled_from(list("abÉ1. .\u0130\n\r\u2029('«")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_lookups_against_plain_searches(text):
    """p6_found: paragraphs and stops before lower case or numbers are those of a search at every place."""
    out, begin = [], 0
    for m in sentences._PARAGRAPHS.finditer(text):
        out.append((begin, m.start()))
        begin = m.end()
    want = [sentences.trimmed(text, *x) for x in (*out, (begin, len(text)))]
    assert sentences.paragraphs(text) == [x for x in want if x[0] < x[1]]
    low = text.lower() if len(text.lower()) == len(text) else text
    for word in ("a", "b", "ab", "é", "1"):
        lower = number = 0
        for at in range(len(text)):
            after = at + len(word) + 1
            if low.startswith(word + ".", at) and not (at and text[at - 1].isalnum()) and (m := re.match(r"\s+[(['‘“„\"«¿¡]*(\w\w?)", text[after:])):
                lower, number = lower + (m[1][0].islower() and not sentences._mixed(m[1])), number + (m[1][0].isdigit() and not sentences._mixed(m[1]))
        assert sentences._Document(text, sentences.Silent({}))._goes_on(word) == ((lower, number) if low.count(word + ".") > 1 else (0, 0))
