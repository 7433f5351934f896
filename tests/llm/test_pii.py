"""Personal data: base patterns against plain regular expressions, bootstrapping on planted contexts and against plain Python."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pytest

from cohortlab.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_rule(text):
    """The base spans, literally."""
    def digits(s):
        return [int(c) for c in s if c in "0123456789"]

    def passes(s):
        d = digits(s)[::-1]
        return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and passes(m[0])]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def text_of(spans):
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


CASES = [
    "", "@", "a@b", "a@b.c", "a@b.c@d.e", "a@b.c.@d.e", "x@@y.z", "é.a@b.co.", ".@a.b", "a@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "0001.2.3.4 255.255.255.256",
    "1..2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111.", "4111 1111 1111 1112", "4111  1111 1111 1111", "+1 (988) 555-2485", "+1 2", "+12", "+1-2", "+1 555 123 4567 890 1234 5", "++49 30 1234567",
    "+1 (988) 555-2485 4111111111111111", "😀 a@b.c 漢字 +49 (30) 1234-5678 ..", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1 (", "+1 ) 3", "tel:+1.2.3.4.5.6.7.8", "a%b+c-d@x-y.z-1",
]


def test_base_spans_are_those_of_the_patterns():
    random.seed(4)
    alphabet = ["@", ".", "-", " ", "+", "(", ")", "1", "255", "300", "4111111111111111", "a", "b.c", "é", "x_y", "\n"]
    texts = CASES + ["".join(random.choices(alphabet, k=random.randint(1, 40))) for _ in range(20_000)]
    for t in texts:
        assert pii.written(pii.base_spans(t)) == text_of(by_rule(t)), t


def test_long_texts_take_linear_time():
    began = time.perf_counter()
    for t in ("y" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "a@" * 150_000, "+1" * 150_000, "(1" * 150_000, " at " * 75_000, "a[at]" * 60_000, "1:" * 150_000, "1 dot " * 50_000):
        pii.scan(t)
    assert time.perf_counter() - began < 60


def learnt(texts, rounds=pii.ROUNDS):
    """Accepted values and spans of every text, by plain dictionaries."""
    found = [pii.scan(t)[1] for t in texts]
    seeds = {(o.k, o.v) for own in found for o in own if o.seed}
    edges = {(p, o.k, o.v) for own in found for o in own for p in o.p}
    score, patterns, before = {}, {}, None
    for _ in range(rounds):
        by = defaultdict(list)
        for p, k, v in edges:
            by[p].append((k, v))
        patterns = {}
        for p, own in by.items():
            for k in range(4):
                mine = [1.0 if x in seeds else score.get(x, 0.0) for x in own if x[0] == k]
                other = sum(x in seeds for x in own if x[0] != k)
                unknown = sum(1 - score.get(x, 0.0) for x in own if x[0] == k and x not in seeds)
                c = sum(mine) / (sum(mine) + other + pii.UNKNOWN * unknown + pii.SMOOTH)
                if c >= pii.LEAST and sum(m >= pii.LEAST for m in mine) >= pii.SUPPORT:
                    patterns[p, k] = c
        doubt = defaultdict(float)
        for p, k, v in edges:
            if (p, k) in patterns and (k, v) not in seeds:
                doubt[k, v] += math.log1p(-patterns[p, k])
        score = {x: 1 - math.exp(d) for x, d in doubt.items() if 1 - math.exp(d) >= pii.LEAST}
        if (now := {x: round(s, 6) for x, s in score.items()}) == before:
            break
        before = now
    accepted = seeds | set(score)
    return accepted, [sorted((o.k, o.a, o.z) for o in own if o.seed or (o.k, o.v) in accepted) for own in found]


def planted():
    """Contexts that seeds teach, candidates that only these contexts give away, and a second step over a learnt value."""
    random.seed(6)
    prose = lambda: " ".join(random.choices("lorem ipsum dolor sit amet consectetur elit sed do".split(), k=12))
    rows = []
    for k in range(6):
        rows.append(f"{prose()} please call me on +1 (555) 010-{2000 + k} after noon {prose()}")
        rows.append(f"{prose()} write to me at user{k}@host{k}.example.com for details {prose()}")
        rows.append(f"{prose()} server listens on 10.0.0.{k} port {prose()}")
    unseen = [f"{prose()} please call me on 555 010 77{k}8 after noon {prose()}" for k in range(4)]
    unseen += [f"{prose()} write to me at unseen{k} [at] host dot org for details {prose()}" for k in range(3)]
    unseen += [f"{prose()} server listens on 10[.]9[.]8[.]{k} port {prose()}" for k in range(3)]
    # learnt values stand in another context, which becomes trusted by them alone
    second = [f"{prose()} ring the bell 555 010 77{k}8 any time now {prose()}" for k in range(4)] + [f"{prose()} ring the bell 555 999 1234 any time now {prose()}"]
    clean = [f"{prose()} order number 555 010 88{k}8 was shipped {prose()}" for k in range(4)] + [f"{prose()} on 2021-05-06 it rained {prose()}" for _ in range(4)]
    return rows, unseen, second, clean


def test_contexts_discover_unseen_identifiers_and_leave_others_alone(spark):
    rows, unseen, second, clean = planted()
    texts = rows + unseen + second + clean + rows[:3] * 40  # copies teach nothing more
    got = {r["_id"]: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    at = len(rows)
    found = [got[k]["spans"] for k in range(at, at + len(unseen))]
    assert [s.split(":")[0] for s in found] == ["phone"] * 4 + ["email"] * 3 + ["ip"] * 3
    assert unseen[4][int(found[4].split(":")[1]) : int(found[4].split(":")[2])] == "unseen0 [at] host dot org"
    at += len(unseen)
    assert all(got[k]["spans"].startswith("phone:") and got[k]["n_found"] == 1 for k in range(at, at + len(second)))
    at += len(second)
    assert all(got[k]["spans"] == "" for k in range(at, at + len(clean)))
    want = learnt(texts)[1]
    assert [got[k]["spans"] for k in range(len(texts))] == [",".join(f"{pii.KINDS[i]}:{a}:{z}" for i, a, z in own) for own in want]


def test_graph_scores_as_by_brute_force(spark):
    random.seed(9)
    left, right = ["to", "on", "by", "of"], ["now", "or", "and", "if"]
    forms = ["+1 555 {:07d}", "555 {:07d}", "u{}@x.org", "u{} [at] x dot org", "10.0.0.{}", "10[.]0[.]0[.]{}"]
    texts = [" ".join(w for _ in range(6) for w in (random.choice(left), random.choice(left), random.choice(forms).format(random.randint(0, 60)), random.choice(right), random.choice(right))) for _ in range(60)]
    accepted, want = learnt(texts)
    rows = pii.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    got = {(r["k"], r["v"]) for r in pii.learn(rows)[0].collect()}
    assert got == accepted and len(got) > 20
    spans = {r["_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [spans[k] for k in range(len(texts))] == [",".join(f"{pii.KINDS[i]}:{a}:{z}" for i, a, z in own) for own in want]


def test_odd_rows_and_empty_tables(spark, odd, odd_rows):
    got = pii.personal_data(odd)
    assert got.columns == ["_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found"]
    none = hashlib.sha256(b"").hexdigest()
    assert sorted(map(str, got.collect())) == sorted(map(str, pii.personal_data(odd.coalesce(1)).collect()))
    assert [r["base_sha256"] for r in got.collect()] == [none] * len(odd_rows) and {r["spans"] for r in got.collect()} == {""}
    assert pii.personal_data(odd.limit(0)).count() == 0
    rows = [(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c"), (2, None)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["_id"]), r["n_email"], r["spans"]) for r in got) == [("1", 1, "email:0:5"), ("1", 1, "email:0:5"), ("2", 0, ""), ("None", 1, "email:0:5")]


@pytest.mark.parametrize("text,want", [
    ("mail a [at] b [dot] c", [("a@b.c", pii.EMAIL)]), ("look at that", []), ("we met at home.de", []), ("joe at host dot com", [("joe@host.com", pii.EMAIL)]),
    ("joe@localhost", [("joe@localhost", pii.EMAIL)]), ("fe80::1ff:fe23:4567:890a", [("fe80::1ff:fe23:4567:890a", pii.IP)]), ("at 12:30:45", []), ("300.1.2.3", []),
    ("555-867-5309", [("5558675309", pii.PHONE)]), ("12345", []), ("1234567890123456", [("1234567890123456", pii.CARD)]),
])
def test_looser_forms(text, want):
    assert [(v, k) for k, _, _, v in pii._loose(text)] == want
