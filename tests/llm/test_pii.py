import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from dimlens.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else int(d) * 2 // 10 + int(d) * 2 % 10
               for i, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def brute_force(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(BASE[k], text or "")
            if valid(k, m.group())]


def base(found):
    return [(s["kind"], s["start"], s["end"]) for s in found if s["kind"] != pii.TERM]


def made_texts(n):
    r = random.Random(6)
    pieces = ["a.b@c.de", "x_y%z@q-r.s.t", "a@b.c_d@e.f", "a@b.", "@", "1.2.3.4.5.6.7.8", "255.0.00255.1", "256.1.1.1",
              "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111111", "+1 (555) 010-9999", "+49..",
              "+1234567", "+123456789012345", "+1234567890123456", " ", "  ", "\n", "😀", "é", "word", "-", "7", "12.5"]
    return ["".join(r.choices(pieces, k=r.randint(0, 12))) for _ in range(n)]


def test_base_spans_equal_brute_force(spark, hard_items):
    items = [*hard_items, *((1000 + i, t) for i, t in enumerate(made_texts(1500)))]
    items += [(5000, "1" * 20000), (5001, "a@b" + ".c" * 20000), (5002, "a." * 20000), (5003, "+1" + "(" * 20000)]
    frame = spark.createDataFrame(items, "doc_id long, text string").repartition(4)
    found = Counter((r.doc_id, *base(r.spans)) for r in pii.find(frame).collect())
    assert found == Counter((i, *brute_force(t)) for i, t in items)


def test_patterns_match_alike_everywhere():
    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet="a1@.-+ (_é", max_size=40))
    def alike(text):
        for kind in ("ip", "card"):  # the others need an anchor that this engine does not have
            own = pii.PATTERNS[kind].replace(r"\G|", "")
            assert [m.span() for m in re.finditer(own, text)] == [m.span() for m in re.finditer(BASE[kind], text)]

    alike()


def corpus():
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(80)]
    items = [(i, " ".join(r.choices(words, k=40))) for i in range(200)]
    for i in range(4):
        items.append((1000 + i, f"{' '.join(r.choices(words, k=9))} Quentin zebulon ask jane@corp.org ok {r.choice(words)}"))
    items.append((2000, "zebulon is no secret by itself here zebulon"))
    items.append((2001, "zebulon again and again"))
    items += [(2100 + i, "single joe%d@corp.org unique%s" % (i, "x" * i)) for i in range(9)]
    return items


def test_terms_that_tell_are_found(spark):
    rows = pii.find(spark.createDataFrame(corpus(), "doc_id long, text string")).collect()
    texts = dict(corpus())
    for r in rows:
        terms = {(texts[r.doc_id][s["start"]:s["end"]], s["action"]) for s in r.spans if s["kind"] == pii.TERM}
        if 1000 <= r.doc_id < 1004:
            assert ("Quentin", pii.REMOVED) in terms
            assert "zebulon" in {t for t, _ in terms}  # 4 of its 6 documents name the same person
        else:
            assert not terms
        assert base(r.spans) == brute_force(texts[r.doc_id])


def test_words_beside_reach_past_other_matches(spark):
    text = "Jane Roe, aged 42, card 4111 1111 1111 1111 phone +1 (555) 010-9999 or jo@corp.org then é last"
    emails = " ".join(f"w{c} {c}@b.org" for c in "abcdefghijklmno")
    frame = spark.createDataFrame([(1, text), (1, text), (2, emails), (3, "a@b.org " * 30 + "end")], "doc_id long, text string")
    found = {(r.doc_id, r.kind, r.value): r.terms for r in pii.base_spans(frame).collect()}
    assert found[1, "card", "4111 1111 1111 1111"] == ["Jane", "Roe", "aged", "card", "phone", "or", "then", "é", "last"]
    assert found[1, "email", "jo@corp.org"] == ["Jane", "Roe", "aged", "card", "phone", "or", "then", "é", "last"]
    assert found[2, "email", "j@b.org"] == [f"w{c}" for c in "cdefghijklmno"]
    assert found[3, "email", "a@b.org"] == ["end"]
    near = {(r.kind): r.terms for r in pii.base_spans(frame.where("doc_id = 1"), 1).collect()}
    assert near["card"] == ["card", "phone"] and near["email"] == ["or", "then"]


def test_window_is_passed_on(spark):
    items = [(i, f"Quentin so ask jane@corp.org {'x' * i}") for i in range(1, 5)] + [(9, "none"), (10, "so ask")]
    frame = spark.createDataFrame(items, "doc_id long, text string")
    for window, removed in ((8, True), (2, False)):
        assert all(("Quentin" in r.text) != removed for r in pii.sanitise(frame, window=window).collect() if r.doc_id < 9)
        spans = {r.doc_id: r.spans for r in pii.find(frame, window=window).collect()}
        assert any(s["kind"] == pii.TERM for s in spans[1]) == removed


def test_sanitised_texts(spark):
    rows = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(corpus(), "doc_id long, text string")).collect()}
    texts = dict(corpus())
    assert rows[3] == texts[3]
    assert rows[2100] == "single [email] unique"
    assert "Quentin" not in rows[1000] and "[email]" in rows[1000] and "jane" not in rows[1000]
    two = spark.createDataFrame([(1, "a1@b.12.13.14.15 é +1234567890 x"), (1, "none"), (None, "u@v.w")], "doc_id long, text string")
    assert sorted(r.text for r in pii.sanitise(two).collect()) == ["[email]", "[email] é [phone] x", "none"]


def test_letters_that_fold_together_find_the_action(spark):
    frame = spark.createDataFrame([(1, "the mass Maſſ MASS Kelvin \u212aelvin so")], "doc_id long, text string")
    content = frame.select(F.xxhash64("text")).first()[0]
    terms = spark.createDataFrame([(1, content, "mass", pii.REMOVED), (1, content, "kelvin", pii.GENERALISED)],
                                  "doc_id long, content long, term string, action int")
    base_spans = pii.base_spans(frame)
    text = frame.first().text
    found = {(text[r.start:r.end], r.action) for r in pii.term_spans(frame, terms, base_spans).collect()}
    assert found == {("mass", pii.REMOVED), ("Maſſ", pii.REMOVED), ("MASS", pii.REMOVED),
                     ("Kelvin", pii.GENERALISED), ("\u212aelvin", pii.GENERALISED)}


def test_empty(spark, no_documents, hard_documents):
    assert pii.find(no_documents).collect() == []
    assert pii.sanitise(no_documents).collect() == []
    assert pii.sanitise(hard_documents).count() == hard_documents.count()
