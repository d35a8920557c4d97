import base64
import random

import pytest

from strandlake.llm.mail import message_body, own_paragraphs, own_words
from strandlake.llm.reading import reading_levels

HEAD = "From: a@b.example\nTo: l@b.example\nSubject: x\n"
PROSE = "We saw the file today. It was very slow and we do not know why.\n\nPlease look at it."


def mail(body, kind="text/plain; charset=utf-8", coding="8bit"):
    return f"{HEAD}MIME-Version: 1.0\nContent-Type: {kind}\nContent-Transfer-Encoding: {coding}\n\n{body}"


WANT = ["We saw the file today. It was very slow and we do not know why.", "Please look at it."]
B = "--=_x"


@pytest.mark.parametrize(
    "text",
    [
        mail(PROSE),
        mail(PROSE).replace("\n", "\r\n"),
        "From a@b.example Sun Jan  3 00:56:28 2016\n" + mail(PROSE),
        mail("Hi all,\n\n" + PROSE + "\n\n-- \nA Name\nphone 5"),
        mail(PROSE + "\n\n_______________________________________________\nlist mailing list"),
        mail("On Thu, 5 Mar 2015 06:04:17 -0800, A B wrote:\n> old words are here\n>> older\n\n" + PROSE),
        mail("A Name writes:\n: old words are here\n:\n\n" + PROSE),
        mail("Am Fri, 6 Mar 2015 schrieb A B:\n| alt\n\n" + PROSE),
        mail(PROSE + "\n\n-----Original Message-----\nFrom: C <c@d.example>\n\nold words are here and here."),
        mail(PROSE + "\n\n________________________________\nVon: C D\nBetreff: x\n\nalte Worte stehen hier."),
        mail(PROSE.replace("\n\n", "\n\nchr1\t5\t9\tp1\n>seq1\nACGTACGTACGTNNNNACGTACGTACGTACGT\n$ run --fast in > out\n[12:00:01] INFO reader: 1 rows\n\n")),
        mail(base64.encodebytes(PROSE.encode()).decode(), coding="base64"),
        mail(base64.encodebytes((PROSE + " ").encode()).decode().replace("\n", "\n"), coding="BASE64"),
        mail("We saw the file today. It was very slow and we do =\nnot know why.\n\nPlease look at it=2E", coding="quoted-printable"),
        mail("<html><body><p>Hello,<br>\n<br>\nWe saw the file today. It was very slow and<br>\nwe do not know why.<br>\n<br>\nPlease look at it.</p><blockquote>old words</blockquote></body></html>", kind="text/html"),
        mail(f'pre\n\n{B}\nContent-Type: text/plain\n\n{PROSE}\n{B}\nContent-Type: text/html\n\n<p>other</p>\n{B}--\n', kind='multipart/alternative; boundary="=_x"'),
        mail(f'{B}\nContent-Type: text/plain\n\n{PROSE}\n{B}\nContent-Type: text/plain; name="a.txt"\nContent-Disposition: attachment\n\nnot mine at all.\n', kind='multipart/mixed;\n boundary="other"'),
        mail("-----Original Message-----\n> old words are here\n>> older\n\n" + PROSE),
        mail("We saw the file today. It was very slow and we do not know why.\n\n----- Forwarded message -----\nFrom: C <c@d.example>\n\nold words are here.\n\n----- End of forwarded message -----\n\nPlease look at it."),
        mail("We saw the file today. It was very slow and we do not know why.\n\n==========\n> old\n> words\n\nPlease look at it."),
        mail(f'{B}\nContent-Type: text/plain\n\nWe saw the file today. It was very slow and we do not know why.\n{B}\nContent-Type: text/html\n\n<p>other</p>\n{B}\nContent-Type: text/plain\n\nPlease look at it.\n{B}--\n', kind='multipart/mixed; boundary="=_x"'),
        mail(f'{B}\nContent-Type: text/plain\n\n{PROSE}\n{B}\nContent-Type: text/plain; format=flowed\n\n{PROSE}\n{B}--\n', kind='multipart/alternative; boundary="=_x"'),
    ],
)
def test_own_prose(text):
    assert own_paragraphs(text) == WANT


@pytest.mark.parametrize("depth", [1, 7, 10, 40])
def test_parts_in_parts(depth):
    body = f"Content-Type: text/plain\n\n{PROSE}\n"
    for k in range(depth):
        body = f'Content-Type: multipart/mixed; boundary="b{k}."\n\n--b{k}.\n{body}\n--b{k}.--\n'
    assert own_paragraphs(HEAD + "MIME-Version: 1.0\n" + body) == WANT


def test_signature_and_unmarked_mail_end_a_message():
    below = "\n\nOld words that somebody else wrote."
    for line in ("-- ", "-----Original Message-----\nFrom: C <c@d.example>", "__________\nA Name"):
        assert own_paragraphs(mail(PROSE + "\n\n" + line + below)) == WANT


def test_many_rules_stay_linear():
    assert own_words(mail("-----\n> x\n\n" * 100_000 + PROSE)) == own_words(mail(PROSE))


@pytest.mark.parametrize("text", ["", " ", "\n\n", "From: x\n", "=_", mail(""), mail("=" * 5000, coding="quoted-printable"), mail("!!", coding="base64"), mail("x", kind="multipart/mixed"), "\0" * 100])
def test_odd_texts_do_not_fail(text):
    assert isinstance(message_body(text), str) and isinstance(own_words(text), list)


def corpus(n=160, seed=0):
    rng = random.Random(seed)
    words = {1: ["cat", "dog", "run", "sun"], 2: ["report", "server", "version", "column"], 3: ["ontology", "heuristic", "paradigm", "inference"]}
    rows, level = [], {}
    for i in range(n):
        k = level[i] = rng.choice([1, 2, 3])
        body = " ".join(rng.choice(words[k]) if rng.random() < 0.7 else rng.choice(["the", "and", "of", rng.choice(words[rng.choice([1, 2, 3])])]) for _ in range(60))
        rows.append((i, mail(body + ".") + "\n\n-- \nontology paradigm"))
    return rows, level


def test_levels(spark):
    rows, level = corpus()
    rows += [(1000, None), (1001, ""), (1002, mail("too short.")), (1003, mail("zzz " * 50 + "."))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_words int").repartition(3)
    graded = spark.createDataFrame([(i, level[i]) for i in range(40)] + [(1002, 3), (9999, 1), (5, None)], "doc_id bigint, read_level int")
    got = {r["doc_id"]: r for r in reading_levels(df, graded).collect()}
    # A grade doesn't bring out a document without prose.
    assert set(got) == set(level) | {1003}
    assert sum(got[i]["read_level"] == level[i] for i in level) >= 0.95 * len(level)
    assert all(got[i]["read_level"] == level[i] for i in range(40))
    assert got[1003]["read_level"] == 2 and got[1003]["difficulty"] is None


def test_words_in_a_table_give_the_same(spark):
    rows, level = corpus(60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    graded = spark.createDataFrame([(i, level[i]) for i in range(20)], "doc_id bigint, read_level int")
    hashed, exact = ({r["doc_id"]: r for r in reading_levels(df, graded, buckets=b).collect()} for b in (2**18, None))
    assert set(hashed) == set(exact) == set(level)
    assert all(abs(hashed[i]["difficulty"] - exact[i]["difficulty"]) < 1e-9 and hashed[i]["read_level"] == exact[i]["read_level"] for i in level)


def test_values_reach_documents_without_a_graded_word(spark):
    # Documents 2.. share words only with their neighbours in a chain that ends in a graded document on each side.
    chain = [[f"w{chr(97 + i)}{chr(97 + j)}x" for j in range(2)] for i in range(9)]
    rows = [(i, mail(" ".join((chain[i] + chain[i + 1]) * 12) + ".")) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    graded = spark.createDataFrame([(0, 1), (7, 3)], "doc_id bigint, read_level int")
    on = {r["doc_id"]: r["difficulty"] for r in reading_levels(df, graded, tolerance=1e-6).collect()}
    off = {r["doc_id"]: r["difficulty"] for r in reading_levels(df, graded, ungraded=0.0).collect()}
    assert {i for i in off if off[i] is None} == {0, 2, 3, 4, 5, 7}
    inner = [on[i] for i in range(1, 7)]
    # The harmonic solution of the chain: values rise in equal steps.
    assert inner == sorted(inner) and all(abs((b - a) - 2 / 7) < 1e-2 for a, b in zip(inner, inner[1:]))


def test_without_grades_or_documents(spark):
    rows, _ = corpus(5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, read_level int")
    assert reading_levels(df, none).collect() == []
    assert reading_levels(df.where("false"), spark.createDataFrame([(1, 1)], "doc_id bigint, read_level int")).collect() == []
