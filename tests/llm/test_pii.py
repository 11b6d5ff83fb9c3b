"""Base spans against the plain patterns, and the learned ones."""

import hashlib
import math
import random
import re
from collections import Counter

from tallyscope.llm import pii


def luhn(digits):
    values = [int(c) if i % 2 == 0 else (2 * int(c) - 9 * (2 * int(c) > 9))
              for i, c in enumerate(reversed(digits))]
    return sum(values) % 10 == 0


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


TEXTS = [
    "a@b.c_d@e.f x@y.z. @q.r s@t", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "é😀 a@b.co é",
    "+1 (656) 555-6669  +49 30 1234567-  +123", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111",
    "call (656) 555-1234 or 656-555-1234, joe.x (at) mail [dot] example.org", "+1.2.3.4.5.6.7.8.9.10",
    "a" * 3000 + "@" + ".a" * 2000 + "  " + "1 " * 2000 + "9" * 3000, "+" * 50 + "1" * 12,
    "mail joe@example.com now", "host 10.0.0.1 up", "tel +33 1 23 45 67 89 ok",
]


def test_base_spans_equal_the_patterns(documents_of, odd_documents):
    df = documents_of([(100 + i, t) for i, t in enumerate(TEXTS)]).unionByName(odd_documents)
    texts = {r.doc_id: r.text for r in df.collect()}
    found = pii.personal_data(df).collect()
    assert len(found) == df.count()
    for r in found:
        base = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(b[0] == k for b in base) for k in pii.KINDS], texts[r.doc_id][:60]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(filter(None, r.spans.split(",")))


def test_method_adds_what_the_votes_support(documents_of):
    good = [(i, f"write to joe{i}@example.com or call +1 (656) 555-{1000 + i} at once") for i in range(40)]
    bad = [(100 + i, f"serial 99{i:02d}-1111-1111-1111 and 999.{i}.1.1 here") for i in range(40)]
    rare = [(200, "call (656) 555-1234"), (201, "nothing at all"), (202, "version 300.1.2.3")]
    spans = {r.doc_id: r.spans for r in pii.personal_data(documents_of(good + bad + rare)).collect()}
    assert spans[200] == "phone:5:19" and spans[201] == "" and spans[202] == ""
    assert all(not (set(spans[100 + i].split(",")) - {""}) or brute(bad[i][1]) for i in range(40))


def planted(n=60, seed=7):
    """(text, span or None): personal data in other forms, and what only looks like it."""
    r = random.Random(seed)

    def name():
        return "".join(r.choices("abcdefghij", k=5))

    def digits(k):
        return "".join(r.choices("0123456789", k=k))

    def local(area, exchange):
        return f"{area}{digits(2)}-{exchange}{digits(2)}-{digits(4)}"

    def card(good):
        while True:
            c = "4" + digits(15)
            if luhn(c) == good:
                return ".".join(c[i : i + 4] for i in range(0, 16, 4))

    out = []
    for _ in range(n):
        two = r.choice("23456789")
        for before, span, kind in [
            ("please call ", local(two, two), "phone"), ("her number then ", local(two, two), "phone"),
            ("fax: ", f"0{digits(2)} {digits(4)} {digits(3)}", "phone"),
            ("write to ", f"{name()}.{name()} (at) {name()} [dot] org", "email"),
            ("she is ", f"{name()} at {name()} dot com", "email"),
            ("host ", "[.]".join(str(r.randrange(1, 200)) for _ in range(4)), "ip"),
            ("card ", card(True), "card"),
        ]:
            out.append((f"{name()} {before}", span, kind))
        for before, span in [
            ("order ", local(r.choice("01"), r.choice("0123456789"))),
            ("invoice no page ", local(r.choice("01"), two)), ("serial ", card(False)),
            ("at noon call ", f"{digits(3)} of"), ("met at ", f"{name()} dot {name()}"),
            ("version ", "[.]".join(str(r.randrange(256, 999)) for _ in range(4))),
        ]:
            out.append((f"{name()} {before}", span, None))
    return out


def test_added_spans_have_precision_and_recall(documents_of):
    rows = planted()
    base = [(f"mail {i}x@example.com or +1 (656) 555-{1000 + i}, card 4111 1111 1111 1111, "
             f"not 4111 1111 1111 1112", None, None) for i in range(200)]
    texts = [b + (s or "") + " and so on" for b, s, _ in rows + base]
    found = {r.doc_id: r.spans for r in pii.personal_data(documents_of(list(enumerate(texts)))).collect()}
    right = wrong = 0
    for i, (before, span, kind) in enumerate(rows):
        want = {f"{kind}:{len(before)}:{len(before) + len(span)}"} if kind else set()
        got = set(filter(None, found[i].split(",")))
        right += len(got & want)
        wrong += len(got - want)
    wanted = sum(kind is not None for _, _, kind in rows)
    assert right >= 0.95 * wanted and wrong <= 0.05 * right, (right, wrong, wanted)
    for i in range(len(rows), len(texts)):
        assert found[i] == ",".join(":".join(map(str, b)) for b in brute(texts[i]))


def random_counts(seed):
    r, seen = random.Random(seed), Counter()
    for _ in range(400):
        kind, yes = r.randrange(4), r.random() < 0.6
        votes = tuple(r.choice((0, 1, 1, 1, -1) if yes else (0, -1, -1, 1)) for _ in pii.LABELERS)
        shape = tuple(r.randrange(m) for m in pii.SHAPES)
        seen[kind, votes[0] > 0 and r.random() < 0.5, votes, shape] += 1
    return [(*k, n) for k, n in seen.items()]


def plain_em(matches):
    """The same estimates from single matches, one loop inside the other."""
    belief = [0.999 if base else 0.001 if v[0] < 0 else min(0.95, max(0.05, 0.5 + sum(v) / 10))
              for _, base, v in matches]
    free = [not base and v[0] >= 0 for _, base, v in matches]
    for _ in range(pii.ROUNDS):
        table = {}
        for side, start in ((0, 0.2), (1, 0.8)):
            for i in range(5):
                yes, any_ = [0.0] * 4, [0.0] * 4
                for (kind, _, v), b in zip(matches, belief):
                    share = b if side else 1 - b
                    yes[kind] += share * (v[i] > 0)
                    any_[kind] += share * (v[i] != 0)
                overall = (sum(yes) + 10 * start) / (sum(any_) + 10)
                for kind in range(4):
                    table[side, kind, i] = (yes[kind] + 10 * overall) / (any_[kind] + 10)
        prior = []
        for kind in range(4):
            mine = [b for (k, _, _), b, f in zip(matches, belief, free) if f and k == kind]
            prior.append((sum(mine) + 1) / (len(mine) + 2))
        for at, (kind, _, v) in enumerate(matches):
            if free[at]:
                yes, no = prior[kind], 1 - prior[kind]
                for i, x in enumerate(v):
                    if x:
                        p1, p0 = table[1, kind, i], table[0, kind, i]
                        yes *= p1 if x > 0 else 1 - p1
                        no *= p0 if x > 0 else 1 - p0
                belief[at] = yes / (yes + no)
    return belief, prior, table


def test_expectation_maximisation_equals_plain_loops():
    counts = random_counts(3)
    model = pii.fit_model(counts)
    matches = [(k, b, v) for k, b, v, _, n in counts for _ in range(n)]
    belief, prior, table = plain_em(matches)
    assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(model.prior, prior))
    assert all(math.isclose(model.favour[key], value, abs_tol=1e-6) for key, value in table.items())


def test_model_is_deterministic_and_empty_without_counts():
    counts = random_counts(5)
    one, other = pii.fit_model(counts), pii.fit_model(counts[::-1])
    assert one.bias == other.bias and (one.weights == other.weights).all() and one.shapes == other.shapes
    assert pii.fit_model([]) is None


def test_masks(documents_of):
    df = documents_of([(1, "to joe@example.com, +1 (656) 555-6669!"), (2, None), (3, "clean é")])
    rows = {r.doc_id: r for r in pii.masked(df).collect()}
    assert rows[1].text == "to [email], [phone]!" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[3].text == "clean é"
    assert pii.masked(df).columns == df.columns
    assert pii.masked(df.limit(0)).count() == 0
