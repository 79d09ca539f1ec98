import re

import numpy as np

from tests.llm import odd
from zonecast.llm import licences, pii, quality_rules
from zonecast.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, again = set(), 0
    for x in lines:
        again += x in seen
        seen.add(x)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit), failed


def test_op6_equals_plain_rules(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_quality_rules"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k for q, k in judged if q == 1]) > 0.995
    assert np.mean([k for q, k in judged if q == 0]) < 0.3


def test_js_distance():
    p, q = np.array([0.5, 0.5, 0]), np.array([0, 0, 1.0])
    assert quality_rules.js_distance(p, p) == 0 and quality_rules.js_distance(p, q) == 1


def test_quality_rules_take_odd_tables(spark):
    docs = odd.documents(spark)
    refs = quality_rules.fit_references(docs)
    rows = quality_rules.quality_rules(docs, refs).collect()
    assert len(rows) == len(odd.TEXTS)
    for r in rows:
        if r.doc_id in (2, 3, 6):
            assert (r.n_words, r.word_chars, r.base_failed, r.kept) == (0, 0, True, False)
    kept = quality_rules.keep_good(docs, refs)
    assert kept.columns == docs.columns
    assert quality_rules.quality_rules(odd.nulls(spark), refs).where("base_failed").count() == len(odd.TEXTS)
    none = quality_rules.fit_references(odd.empty(spark))
    assert none == {} and quality_rules.quality_rules(odd.empty(spark), none).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def of_base(spans):
    return [s for s in spans.split(",") if s.split(":")[0] in PATTERNS]


def test_op10_equals_plain_patterns(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_pii"](spark, sf).collect()
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert of_base(r.spans) == want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in PATTERNS]


def test_pii_on_made_up_cases(spark):
    cases = [
        "a@b.co_x@y.com %%@a-b.c.d. @x.y a@b a..b@c.d.e@f.g",
        "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.2.3 999999999999999999999.1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 1234567890123456789012 5 5 0000000000000",
        "+49 (30) 1234-5678 +1 ((((( +12345678 +1 2 3 4 5 6 7 8 9 +1234567890123456",
        "🙂 é@x.y é a@x.y 🙂 +49 30 12345678",
        "x" * 50_000 + " " + "1" * 50_000 + " " + "a." * 20_000 + "@",
        "Konto DE89 3704 0044 0532 0130 00 und DE89370400440532013001, social security 078-05-1120, 078-05-1120",
        "a@b" + ".c" * 20_000,
    ]
    rows = {r.doc_id: r for r in pii.pii_digest(odd.texts(spark, list(enumerate(cases)))).collect()}
    for k, text in enumerate(cases):
        want = base_spans(text)
        assert of_base(rows[k].spans) == want or (rows[k].spans == "" and not want), k
    assert [s for s in rows[6].spans.split(",") if s[:2] in ("ib", "id")] == ["iban:6:33", "id:78:89", "id:91:102"]


def test_redaction_replaces_spans(spark):
    docs = odd.documents(spark)
    done = pii.redact(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    first = done.where("doc_id = 1").first()
    assert first.text == "Released under the MIT License. Write to [EMAIL] now, or call [PHONE]." and first.n_chars == len(first.text)
    assert done.where("doc_id = 2").first().text is None
    assert done.where("doc_id = 8").first().text == "🙂🙂 ünïcödé <|endoftext|> １２３ [CARD]"
    assert pii.pii_digest(odd.nulls(spark)).where("spans = ''").count() == len(odd.TEXTS) and pii.redact(odd.empty(spark)).count() == 0


def test_op2_base_equals_plain_scan(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = 0
    for r in QUERIES["op2_licences"](spark, sf).collect():
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        at = [(i, label) for i in range(len(words)) for p, label in licences.PHRASES.items() if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        found += len(at)
    assert found


def test_licence_templates_and_odd_tables(spark):
    index = licences.Index(*licences.document_counts(odd.documents(spark)))
    rows = licences.scan_licences(odd.documents(spark), index).collect()
    assert len(rows) == len(odd.TEXTS)
    assert [(r.base_labels, r.labels, r.score) for r in rows if r.doc_id == 1] == [("mit", "mit", 1.0)]
    assert all(r.n_words == 0 and r.first_word is None and r.labels == "" for r in rows if r.doc_id in (2, 3, 6))
    texts = [
        (1, "foo bar. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, "licensed under it by nobody, 4 or 0 of them"),
        (4, "All rights reserved."),
    ]
    got = {r.doc_id: r.labels for r in licences.scan_licences(odd.texts(spark, texts), index).collect()}
    assert got == {1: "mit", 2: "cc-by-nc", 3: "", 4: "reserved"}
    assert licences.scan_licences(odd.nulls(spark), index).count() == len(odd.TEXTS)
    assert licences.scan_licences(odd.empty(spark), licences.Index(*licences.document_counts(odd.empty(spark)))).count() == 0
