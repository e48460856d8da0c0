import hashlib
import re

from hypothesis import given, settings, strategies as st

from tidemark.llm import pii as P

PATTERNS = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (16 <= len(digits) <= 19 and luhn(digits))) \
                    or (k == 3 and not 8 <= len(digits) <= 15):
                continue
            out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "1", "2", "255", "256", ".", "@", "-", " ", "+", "%", "(", ")", "x.y", "@a.b",
                                 "4111111111111111", "é", "..", "0", "\n"]), max_size=24).map("".join))
def test_base_spans_follow_the_patterns(text):
    assert P.base_spans(text) == plain(text)


def test_scans_are_linear():
    import time
    start = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 100_000, "1 " * 150_000,
                 "12:xyzq:" * 60_000, "1:" * 150_000, "ab:12:" * 60_000, "a:b@c:1" * 50_000, "(1:2)" * 60_000):
        found = P.base_spans(text)
        P.candidates(text, found)
    assert time.time() - start < 20


def test_documents(documents):
    out = {r["doc_id"]: r for r in P.pii_digest(documents).collect()}
    for r in documents.collect():
        base = plain(r["text"] or "")
        named = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base)
        o = out[r["doc_id"]]
        assert [o[f"n_{k}"] for k in P.KINDS] == [sum(x[0] == k for x in base) for k in range(4)]
        assert o["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
        assert set(filter(None, named.split(","))) <= set(filter(None, o["spans"].split(",")))


def test_contexts_discover_unseen_identifiers(spark):
    valid = [f"40000000000000{n:02d}" for n in range(100)]
    seeds = [v for v in valid if luhn(v)][:8]
    rows = [(k, f"some words here card number {v} was charged today") for k, v in enumerate(seeds)]
    # same contexts, fails the check digit: only its surroundings give it away
    rows += [(20 + k, f"other words, card number {v} was charged again") for k, v in enumerate(["4000000000000014", "4000000000000022"])]
    rows += [(30 + k, f"the year {1990 + k} was long and order 12345678 came") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in P.pii_digest(docs).collect()}
    for k in (20, 21):
        text = dict(rows)[k]
        at = text.index("4000")
        assert out[k]["n_card"] == 0 and out[k]["spans"] == f"card:{at}:{at + 16}"
    assert all(out[30 + k]["spans"] == "" for k in range(9))
    masked = {r["doc_id"]: r["text"] for r in P.redact(docs, P.find(docs)).collect()}
    assert masked[20] == "other words, card number [CARD] was charged again"
    assert masked[0] == "some words here card number [CARD] was charged today"


def test_contexts_discover_other_forms(spark):
    rows = [(k, f"please call me at +1 555-01{k:02d}23 before noon") for k in range(12)]
    rows += [(20 + k, f"please write to some{k}.body@mail{k}.example.org for details") for k in range(12)]
    cards = [v for v in (f"40000000000000{n:02d}" for n in range(100)) if luhn(v)]
    rows += [(40 + k, f"debit the account no. {v} every month") for k, v in enumerate(cards)]
    new = {60: ("please call me at {} before noon", "555-0199", "phone"), 61: ("please call me at {} before noon", "(020) 7946 0018", "phone"),
           62: ("please call me at {} before noon", "01 23 45 67 89", "phone"), 63: ("please write to {} for details", "root@mailhost", "email"),
           64: ("please write to {} for details", "jane(at)example.org", "email"), 65: ("debit the account no. {} every month", "AB-7733-19", "card"),
           66: ("debit the account no. {} every month", "123456", "card")}
    rows += [(k, t.format(x)) for k, (t, x, _) in new.items()]
    rows += [(80, "we met at 1800 and in 2019 ate 555 plums"), (81, "the account of 123 people"), (82, "no. 77 in the list @home")]
    out = {r["doc_id"]: r["spans"] for r in P.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (t, x, kind) in new.items():
        assert out[k] == f"{kind}:{t.index('{')}:{t.index('{') + len(x)}", (k, out[k])
    assert not any(out[k] for k in (80, 81, 82))


def test_masking():
    assert P.mask("a x@y.z b", [(0, 2, 7)]) == "a [EMAIL] b"
    assert P.mask("0123456789", [(1, 2, 6), (2, 4, 8)]) == "01[IP]89"


def test_odd_rows(odd, nothing):
    found = P.find(odd)
    assert found.count() == odd.count()
    masked = P.redact(odd, found)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    assert P.pii_digest(nothing).count() == 0
