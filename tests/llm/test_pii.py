import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import empty, frame, rows
from tokenloom.llm import pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True, 16 <= len(digits) <= 19 and pii.luhn(digits), 8 <= len(digits) <= 15)[k]
            if ok:
                out.append((k, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab1234567890@.+-() é", max_size=50))
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_known_values():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4") == [(1, 0, 7), (1, 8, 15), (1, 26, 36)]


def test_long_texts_are_read_in_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "1 " * 200_000, "+1" + "(" * 400_000):
        pii.base_spans(text)
        list(pii.candidates(text, []))


def test_digest(spark):
    got = {(str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.span_digest(frame(spark)).collect()}
    want = set()
    for r in rows():
        found = brute(r[1] or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in found)
        want.add((str(r[0]), *(sum(k == n for k, _, _ in found) for n in range(4)), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want
    assert pii.span_digest(frame(spark)).count() == len(rows())


def contact_docs():
    out = [(i, f"plain words here. write to agent: user{i}@mail.example.com today please {i * 7919 % 97} more") for i in range(30)]
    out += [(100 + i, f"some other text. write to agent: user{i}_at_mail_x9 today please end") for i in range(5)]
    return out + [(200 + i, f"the part number is code{i}x{i} in stock") for i in range(20)]


def test_patterns_find_unseen_identifiers(spark):
    docs = spark.createDataFrame(contact_docs(), "doc_id long, text string")
    out = {r.doc_id: r.spans for r in pii.find_spans(docs).collect()}
    for i in range(5):
        text = dict(contact_docs())[100 + i]
        start = text.index("user")
        assert [(s.kind, s.start, s.end, s.base) for s in out[100 + i]] == [(0, start, text.index(" today"), False)]
    assert all(out[200 + i] == [] for i in range(20))  # clean documents stay clean


def test_one_side_is_enough(spark):
    pad = " " * 60 + "\n"
    seeds = [(i, f"note {i}\nphone: +1 (555) 555-{1000 + i} {'abcdefghij'[i % 10] * (i + 1)} free text") for i in range(30)]
    seeds += [(50 + i, f"{'klmnopqrst'[i % 10] * (i + 1)} user{i}@mail.example.com is my address") for i in range(30)]
    unseen = {
        100: (3, "see\nphone: ", "5554321987", " varying words behind"), 101: (3, "other\nphone:" + pad, "555-432-1988", ""),
        102: (3, "phone: ", "5554321989", " x"), 103: (0, "some text ", "user7_at_mail", " is my address"), 104: (0, "", "user8_at_mail", pad + "is my address"),
    }
    clean = [(200 + i, f"version 20{i}0101 of {'uvwxyz'[i % 6] * i} | | |") for i in range(10)]
    docs = spark.createDataFrame(seeds + [(i, a + x + b) for i, (_, a, x, b) in unseen.items()] + clean, "doc_id long, text string")
    out = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_spans(docs).collect()}
    for i, (kind, a, x, _) in unseen.items():
        assert out[i] == [(kind, len(a), len(a) + len(x), False)]
    assert all(out[i] == [] for i, _ in clean)


def test_context_is_read_by_tokens():
    text = "a" * 500 + " " * 300 + "tel" + " " * 200 + "123456" + "\n" * 100 + "b" * 300 + " c d"
    at = text.index("123456")
    assert pii.context(text, at, 3, False)[0] == "<s>" and pii.context(text, at, 2, False) == [pii.instance_name("a" * 500), "tel"]
    assert pii.context(text, at + 6, 2, True) == [pii.instance_name("b" * 300), "c"]
    assert pii.patterns("| 5 | 123456 | 5 |", 6, 12) == []


def test_groups_are_one_candidate():
    whole = {
        "555 123 4567", "(555) 123-4567", "(555)123.4567", "555 (123) 4567", "(5551234)", "01 23 45 67 89", "3782 822463 10005", "1 800 555 1234",
        "DE89 3704 0044 0532 0130 01", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "user7_at_mail", "12-345", "555-123-4567",
    }
    for x in whole:
        for text in (x, f"call {x} now", f"call: {x}, or", f"(see {x})"):
            assert not pii.base_spans(text)
            assert {text[a:b].strip("()") for a, b in pii.candidates(text, [])} == {x.strip("()")}, text
    text = "call (555) 123-4567 now"
    assert [text[a:b] for a, b in pii.candidates(text, [])] == ["(555) 123-4567"]
    for text in ("in 2019. 50 people", "12, 34, 56, 78", "1 2 3", "no 12 | 3456", "(12) 345"):
        assert list(pii.candidates(text, [])) == []
    text = "4111 1111 1111 1111 555 1234"
    assert [text[a:b] for a, b in pii.candidates(text, [(2, 0, 19)])] == ["555 1234"]
    assert list(pii.inner("id 123456 7 x", 3, 11)) == [(3, 9)]


def test_groups_are_read_in_linear_time():
    for text in ("1 " * 200_000, "(1) " * 100_000, "(" * 200_000 + "1" * 6, "AB12 " * 80_000, "AB12 ABCD 1234 " * 30_000, "1" + " " * 400_000 + "1"):
        list(pii.candidates(text, []))


def test_groups_are_redacted_whole(spark):
    seeds = [(i, f"phone: +1 (555) 555-{1000 + i} {'abcdefghij'[i % 10] * (i + 1)} text") for i in range(30)]
    seeds += [(40, "phone: (555) 123-4567 then"), (41, "phone: 555 123 4567"), (42, "phone: 555123 and"), (43, "elsewhere 555123 2 more")]
    docs = spark.createDataFrame(seeds, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert [out[i] for i in (40, 41, 42, 43)] == ["phone: <PHONE> then", "phone: <PHONE>", "phone: <PHONE> and", "elsewhere <PHONE> 2 more"]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de now", 17), (2, None, None), (3, "+1 (555) 555-0199, 4111 1111 1111 1111", 38), (4, "clean", 5)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert out == {1: ("mail <EMAIL> now", 16), 2: (None, None), 3: ("<PHONE>, <CARD>", 15), 4: ("clean", 5)}
    assert pii.redact(frame(spark)).columns == frame(spark).columns
    assert pii.redact(empty(spark)).collect() == []
    assert pii.span_digest(empty(spark)).collect() == []
