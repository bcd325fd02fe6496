import re

from hypothesis import given, settings
from hypothesis import strategies as st

from galerna.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


pieces = st.lists(st.sampled_from(["a", "@", ".", "b.c", "-", "1", "25", "300", " ", "+4", "(", ")", "x@y.z", "1.2.3.4", "4539578763621486", "é", "%", "_", "+1 (555) 010-9999"]), max_size=25).map("".join)


@settings(max_examples=500, deadline=None)
@given(pieces)
def test_base_spans_are_those_of_the_patterns(text):
    assert [s[:3] for s in pii.find(text) if s[0] in pii.BASE] == brute(text)


def test_checksums_and_context():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert [s[0] for s in pii.find("pay to GB82 WEST 1234 5698 7654 32 please")] == ["iban"]
    assert pii.find("pay to GB82 WEST 1234 5698 7654 31 please") == []
    assert [s[0] for s in pii.find("her SSN is 123-45-6789")] == ["ssn"] and pii.find("part 123-45-6789") == []
    plain, said = pii.find("x 10.0.0.1")[0][3], pii.find("server 10.0.0.1")[0][3]
    assert said > plain
    assert pii.mask_text("mail a@b.cd or +1 555 010 9999!") == "mail [EMAIL] or [PHONE]!" and pii.mask_text(None) is None


def test_frames(edges, nothing):
    rows = pii.detect(edges).collect()
    assert len(rows) == edges.count() and all(r.spans == [] for r in rows)
    assert pii.mask(edges).columns == edges.columns and sorted(map(str, pii.mask(edges).collect())) == sorted(map(str, edges.collect()))
    assert pii.detect(nothing).count() == 0 and pii.mask(nothing).count() == 0
