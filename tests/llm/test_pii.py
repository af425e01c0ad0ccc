from __future__ import annotations

import hashlib
import random
import re

from llm.helpers import AWKWARD, collected, documents

from quillspark.llm import pii


def base(text: str) -> str:
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_are_the_patterns_matches():
    random.seed(7)
    for n in range(20_000):
        text = "".join(random.choices("0123456789012345678.. --@@aZ_%+() é٣\n", k=random.randint(0, 70)))
        text = re.sub("[aZé(]", "5", text) if n % 3 == 0 else text
        assert base(text) == pii.listed([s for s in pii.find(text) if s.kind in pii.BASE]), text


def test_planted_kinds():
    text = "Mail a.b@c.example.com or call +1 (415) 555-2671; card 4111 1111 1111 1111, host 10.0.0.255, IBAN DE89 3704 0044 0532 0130 00; ssn 123-45-6789"
    assert [s.kind for s in pii.find(text)] == ["email", "phone", "card", "ip", "iban", "ssn"]
    assert "4111" not in pii.redacted(text) and pii.redacted(text).startswith("Mail [EMAIL] or call [PHONE]; card [CARD], host [IP], IBAN [IBAN]")
    assert [s.kind for s in pii.find("part 123-45-6789, DE88 3704 0044 0532 0130 00")] == []


def test_words_behind_an_iban():
    numbers = ["AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "GB29NWBK60161331926819"]
    for number in numbers:
        for behind in (" BIC GIBAATWW", " BANK", " PAID IN FULL", " A", ", BIC", ".", "", " " + numbers[0], " 1234"):
            text = f"IBAN {number}{behind}"
            assert [text[s.start:s.end] for s in pii.find(text) if s.kind == "iban"] == [number] + [numbers[0]] * (numbers[0] in behind), text
        assert pii.redacted(f"IBAN {number} BIC GIBAATWW") == "IBAN [IBAN] BIC GIBAATWW"
    for text in ("IBAN AT61 1904 3002 3457 3202 BIC GIBAATWW", "IBAN " + numbers[0] + "X"):
        assert [s for s in pii.find(text) if s.kind == "iban"] == []


def test_context_moves_the_score():
    near, far, against = (next(s for s in pii.find(t) if s.kind == "ip").score for t in ("server 10.0.0.1", "10.0.0.1", "version 10.0.0.1"))
    assert near > far > against


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + "(" * 400_000, "1 " * 200_000, "a@" * 200_000, "A1" * 200_000):
        assert [s for s in pii.find(text) if s.kind == "email"] == []


def test_awkward_rows(spark):
    texts = [*AWKWARD, (11, "é a@b.co 日本 10.1.2.3"), (12, "999.1.1.1")]
    rows = collected(pii.digest(documents(spark, texts)))
    expected = []
    for i, text in texts:
        spans = base(text or "")
        expected.append(str((i, *(spans.count(k + ":") for k in pii.BASE), hashlib.sha256(spans.encode()).hexdigest(), spans)))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert sorted(expected) == sorted(str(tuple(r[c] for c in names)) for r in rows)
    assert pii.digest(documents(spark, [])).count() == 0
    clean = {r["doc_id"]: r["text"] for r in collected(pii.redact(documents(spark, texts)))}
    assert clean[1] is None and clean[11] == "é [EMAIL] 日本 [IP]" and clean[12] == "999.1.1.1"
