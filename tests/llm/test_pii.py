import hashlib
import re

from dqspark.llm import pii, queries
from hypothesis import given, settings
from hypothesis import strategies as st

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    """The fixed grammars, searched plainly."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(c) for c in s[::-1]]
        return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]


PIECES = st.sampled_from([
    "a@b.c", "@", ".", "-", "+", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (212) 555-0153", "x", " ",
    "%", "é", "\n", "00", "7", "(", "mail", "@d-e.f.g", "+49", "..", "iban DE89 3704 0044 0532 0130 00", "password=abcdefgh1", "İ",
])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_fixed_grammars_stay(text):
    found = pii.find(text)
    assert [s for s in found if s[0] in pii.BASE] == base(text)
    spans = sorted((a, b) for k, a, b in found if k in pii.ADDED)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_cues():
    kinds = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t)]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 ok") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert kinds("iban DE88 3704 0044 0532 0130 00") == []
    assert kinds("account no. 12345678 closed") == [("account", "12345678")]
    assert kinds("token = \"7ccfcfa5a2be58\"") == [("secret", "7ccfcfa5a2be58")]
    assert kinds("see ftp://bob:pw@host/x") == [("email", "pw@host")] or ("login", "bob:pw") in kinds("see ftp://bob:pw@host/x")
    assert kinds("jürgen@exämple.de") == [("mailbox", "jürgen@exämple.de")]
    assert kinds("of the accounting and passwords we said no") == []
    assert pii.mask("mail a@b.cd or +1 (212) 555-0153!") == "mail <email> or <phone>!"


def test_long_runs_take_no_square_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 100_000, "1 " * 150_000, "@" * 100_000):
        pii.find(text)


def test_rows(spark, documents, folder):
    rows = [(1, "x a@b.cd 1.2.3.4"), (1, "x a@b.cd 1.2.3.4"), (None, ""), (2, None), (3, "é +1 (212) 555-0153"), (4, "w " * 300_000)]
    out = sorted((tuple(r) for r in queries.op10_pii(spark, folder(documents=documents(rows))).collect()), key=str)
    want = []
    for d, t in rows:
        spans = base(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        n = [sum(s[0] == k for s in spans) for k in pii.BASE]
        want.append((d, *n, hashlib.sha256(text.encode()).hexdigest(), text))
    assert out == sorted(want, key=str)


def test_empty_table(documents):
    assert pii.report(pii.find_pii(documents([]))).count() == 0


def test_values_are_taken_to_their_end():
    for n in (300, 2_000, 100_000):
        assert pii.mask(f"token = {'eyJ0.-_' * (n // 7)} end") == "token = <secret> end"
        assert pii.mask(f"account no {'12' * (n // 2)} end") == "account no <account> end"
        assert pii.mask(f"see https://{'u' * n}@host/x") == "see https://<login>@host/x"
        assert pii.mask(f"call tel:{'1' * n} end") == "call tel:<login> end"
        assert pii.mask(f"to {'é' * n}@exämple.org end") == "to <mailbox> end"
    assert pii.mask("iban MT84 MALT 0110 0001 2345 MTLC AST0 01S end") == "iban <account> end"


def test_quoted_keys():
    assert pii.mask('{"password": "abcdefgh1", \'token\' : \'ijklmnop2\'}') == '{"password": "<secret>", \'token\' : \'<secret>\'}'


def test_many_cues_in_one_run_are_read_once():
    import time

    began = time.process_time()
    assert pii.mask("token=" * 200_000) == "token=<secret>"
    assert time.process_time() - began < 20


def test_plain_words_are_no_secrets():
    for text in ("password: forgotten", "the token: something", "secret=whatever", "password: \n\n"):
        assert pii.mask(text) == text
    assert pii.mask("x.org/?token=abc12345678&page=2&q=long") == "x.org/?token=<secret>&page=2&q=long"
    assert pii.mask("f(pwd=hunter2hunter2);next()") == "f(pwd=<secret>);next()"
    assert pii.mask("token: aBcDeFgHiJ and 'secret': 'lettersonly'") == "token: <secret> and 'secret': '<secret>'"
