import hashlib
import re
import time
from collections import Counter

from lattica.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]
TEXTS = [
    None, "", "a@b.c@d.e x@y..z @q.r p@q q.w@e-.r-", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.003.4 1..2.3.4", "4111 1111 1111 1111 card 4111111111111112",
    "+1 (499) 555-6503 +12 +1234567890123456 ++49 30 1234567.", "é😀 mail: jo@x.org 10.0.0.1", "4" * 3000 + " " + "1." * 3000, "@" * 50 + "a" * 5000 + "@",
    'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', "call (499) 555-6503 now, ssn 123-45-6789", "sha1 1eb9c654e721b4f812088970e66a6345cee33dd6",
]


def brute(text):
    text, out = text or "", []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".") if len(x) < 99):
                continue
            if k == 2 and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    names = ("email", "ip", "card", "phone")
    return [f"{names[k]}:{s}:{e}" for s, k, e in sorted(out)]


def check(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in ("email", "ip", "card", "phone")], r.doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) or not want


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = pii.personal_data(docs).collect()
    check(rows, dict(enumerate(TEXTS)))
    by = {r.doc_id: r.spans for r in rows}
    assert by[9] == "secret:9:49" and by[0] == "" and "phone:5:19" in by[10]


def test_table_and_held_out_secrets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.personal_data(docs).collect()
    check(rows, texts)
    for r in rows:
        planted = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'(?i)(?:token = "|password=)([0-9a-f]{16,})', texts[r.doc_id])}
        added = {x for x in r.spans.split(",") if x.startswith(("secret", "id"))}
        assert planted == added


def test_added_spans_against_brute_force(spark):
    """The same counts and classifier, but every candidate compared with every span."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts, found, seen = {r.doc_id: r.text or "" for r in docs.collect()}, {}, Counter()
    for i, t in texts.items():
        base = pii.base_spans(t)
        found[i] = pii.candidates(t, base)
        seen.update((k, v, f) for _, k, _, _, v, f in found[i])
        loose = [(m.start(), m.end()) for _, p in pii.LOOSE for m in p.finditer(t) if all(m.end() <= s or m.start() >= e for s, _, e in base)]
        assert {(s, e) for s, _, e, own, _, _ in found[i] if not own} <= set(loose)
    accuracy, weights = pii.reliabilities([(*k, n) for k, n in seen.items()])
    assert accuracy.shape == (6, 4) and (accuracy >= 0.5).all()
    for r in pii.personal_data(docs).collect():
        taken = [(s, k, e) for s, k, e, own, _, _ in found[r.doc_id] if own]
        for s, k, e, own, _, bits in found[r.doc_id]:
            z = weights[k] + sum(weights[len(pii.KINDS) + i] for i in range(pii.FEATURES) if bits >> i & 1)
            if not own and z >= 0 and all(e <= a or s >= b for a, _, b in taken):
                taken.append((s, k, e))
        assert r.spans == pii.joined(taken) and r.n_spans == len(taken)


def test_assigned_secrets_are_candidates():
    """With and without quotes and blanks; a short one is neither for nor against by its form."""
    for head in ("password=", "password = ", 'password="', "password: "):
        text = f"x {head}7602ad27cf5550de1c y"
        (found,) = pii.candidates(text, pii.base_spans(text))
        assert found[:3] == (2 + len(head), pii.KINDS.index("secret"), 20 + len(head))
    assert pii.votes("secret", "7602ad27cf5550de1c", "password=", True) == (0, 0, 1, 1)
    assert pii.votes("secret", "7602ad27cf5550de1c00", "", True)[0] == 1 and pii.votes("secret", "averylongword-without1", "", True)[0] == -1
    assert not pii.candidates("password=averylongwordwithoutdigits", [])


def test_context_is_whole_words():
    assert pii.votes("ip", "1.2.3.4", "the server ", True)[2] == 1 and pii.votes("ip", "1.2.3.4", "the ship ", True)[2] == 0
    assert pii.votes("id", "123-45-6789", "he did ", True)[2] == 0 and pii.votes("phone", "+12", "hotel ", True)[2] == 0
    assert pii.votes("id", "123-45-6789", "social security: ", True)[2] == 1
    text = "x" * 20 + "id " + "y" * 27
    assert pii._before(text + "123-45-6789", len(text)) == " " + "y" * 27  # "id" is the end of a cut word


def test_time_grows_with_the_text():
    def seconds(n):
        text = "mail a@b.co or b [at] c.org, 10.0.0.1 +49 30 1234567, (499) 555-6503 " * n
        began = time.process_time()
        assert len(pii.candidates(text, pii.base_spans(text))) == 5 * n
        return time.process_time() - began

    seconds(50)
    assert seconds(4000) < 3 * seconds(2000)


def test_empty_and_repeated(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = pii.personal_data(spark.createDataFrame([(1, "a@b.co", "k"), (1, "a@b.co", "k"), (None, None, None)], "doc_id long, text string, spans string")).collect()
    assert sorted(r.spans for r in rows) == ["", "email:0:6", "email:0:6"]
