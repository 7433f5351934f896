"""Operators on single texts: licences, fingerprints, secrets, toxicity, BPE."""

import base64
import bz2
import gzip
import hashlib
import random
import re
import tracemalloc
import urllib.parse
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import bpe, fingerprints, license_scan, license_texts, secret_scan, toxicity
from cohortlab.llm.words import NOT_LETTERS, SPACES, column_bytes, shingles, words


def test_words_are_maximal_runs_with_equal_hashes_for_equal_words(monkeypatch):
    texts = ["ab  cd\nab", "", None, "é ab", "x" * 300 + " ab", "  "]
    column = pa.array(texts)
    for chunk in (1 << 20, 64):
        monkeypatch.setattr("cohortlab.llm.words.CHUNK", chunk)
        data, offsets = column_bytes(column)
        w = words(data, offsets)
        got = [(r, data[s:e].tobytes().decode()) for r, s, e in zip(w.row, w.start, w.end)]
        assert got == [(r, x) for r, t in enumerate(texts) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        by_word = {}
        for (_, x), h in zip(got, w.hash):
            assert by_word.setdefault(x, h) == h
        assert len(set(by_word.values())) == len(by_word)
    sliced = column_bytes(column.slice(3, 2))
    assert sliced[0][: sliced[1][1]].tobytes().decode() == "é ab"
    assert NOT_LETTERS.sum() == 128 - 52 and SPACES.sum() == 6


def test_short_texts_make_one_shingle():
    data, offsets = column_bytes(pa.array(["a b", "a b c d e", "a b c d e f", "", "a b"]))
    rows, h = shingles(words(data, offsets), 5)
    assert rows.tolist() == [0, 1, 2, 2, 4] and h[0] == h[4] and h[1] == h[2]


# ---- licences

def _norm(t):
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))


def _bigrams(w):
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def _licenses(text):
    text, out = text or "", set()
    units, at = [("text", 0, len(text))], 0
    for line in text.split("\n"):
        units.append(("line", at, at + len(line)))
        at += len(line) + 1
    at = 0
    for m in re.finditer(r"\n(?=[ \t\r]*\n)", text):
        units.append(("paragraph", at, m.start()))
        at = m.end()
    units.append(("paragraph", at, len(text)))
    for kind, a, z in units:
        own = _bigrams(_norm(text[a:z]))
        found = list(re.finditer("[A-Za-z0-9\u0080-\U0010ffff]+", text[a:z]))
        for name, template in license_texts.TEMPLATES.items():
            other = _bigrams(_norm(template))
            if own and 2 * len(own & other) / (len(own) + len(other)) >= 0.8:
                out.add(f"{kind}:{name}:{a + found[0].start()}:{a + found[-1].end()}:{2 * len(own & other) / (len(own) + len(other)):.4f}")
    return out


def test_licenses_as_by_brute_force(spark, odd, odd_rows):
    random.seed(1)
    rows = list(odd_rows) + [(30, "é\n\nAll rights reserved.\n \nx")]
    for k, text in enumerate(license_texts.TEMPLATES.values()):
        for drop in (0, 0.05, 0.1, 0.3):
            kept = " ".join(x for x in text.split() if random.random() >= drop)
            rows.append((100 + k, "Ünïts of the thing\n\n" + kept.replace(" 2. ", "\n2. ") + "\n\nmore of the same in the text"))
    got = license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted((str(i), ",".join(sorted(_licenses(t)))) for i, t in rows)
    assert sorted((str(r["_id"]), ",".join(sorted(x for x in r["hits"].split(",") if x))) for r in got) == want
    assert license_scan.licenses(odd).count() == len(odd_rows)
    assert license_scan.licenses(odd.limit(0)).count() == 0


def test_licenses_over_paragraphs_and_inside_lines(spark):
    mit = license_texts.TEMPLATES["mit"].replace("conditions: The above", "conditions:\n\nThe above").replace("Software. THE SOFTWARE", "Software.\n\nTHE SOFTWARE")
    bsd = license_texts.TEMPLATES["bsd-2-clause"].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" THIS SOFTWARE", "\n\nTHIS SOFTWARE", 1)
    commented = "\n".join("# " + x for x in mit.split("\n"))
    prose = "Ünïts of the thing and more of the same in the text. " * 40
    line = "Some words go before it here. Released under the MIT License. Then it goes on."
    rows = [(0, f"{prose}\n\n{mit}\n\n{prose}"), (1, bsd + "\n\n" + prose), (2, f"# File of a thing\n#\n{commented}\n{prose}"), (3, line), (4, prose), (5, f"{line} {prose} {line}")]
    got = {r["_id"]: r for r in license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["license"] for k in range(6)] == ["mit", "bsd-2-clause", "mit", "mit-notice", None, "mit-notice"]
    name, a, z, score = got[0]["windows"].split(":")[1:]
    assert (name, score) == ("mit", "1.0000") and rows[0][1][int(a) : int(z)] + "." == mit
    assert [x.split(":")[1] for x in got[5]["windows"].split(",")] == ["mit-notice"] * 2
    a, z = map(int, got[3]["windows"].split(":")[2:4])
    assert line[a:z] == "Released under the MIT License"


def test_the_library_names_versions_and_full_texts(spark):
    every = license_texts.every()
    cases = {
        "Licensed under the MIT License.": "mit-", "Licensed under CC BY 4.0.": "cc-by-4.0", "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0",
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0-", "Released under the MIT License.": "mit-notice",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0-line", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-line",
        every["bsd-3-clause"]: "bsd-3-clause", every["bsd-2-clause"]: "bsd-2-clause", "Copyright X. All rights reserved.\n\n" + every["bsd-3-clause"]: "bsd-3-clause",
        every["gpl-3-text"]: "gpl-3-text", every["gpl-2-text"]: "gpl-2-text", "x y z. " * 99 + every["apache-2.0-text"]: "apache-2.0-text",
        every["lgpl-2.1-text"]: "lgpl-2.1-text", every["cc0-1.0-text"]: "cc0-1.0-text", every["agpl-3.0-or-later"]: "agpl-3.0-or-later",
    }
    rows = [(k, text) for k, text in enumerate(cases)] + [(99, "Licensed under the Apache License, Version 1.1.")]
    got = {r["_id"]: r["license"] for r in license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string"), every).collect()}
    assert got.pop(99) is None  # no template has this version
    assert [g.startswith(w) for g, w in zip([got[k] for k in range(len(cases))], cases.values())] == [True] * len(cases), got


# ---- fingerprints

def test_fingerprints_of_edited_texts_and_neighbours(spark, odd, odd_rows):
    random.seed(2)
    rows = [(k * 3, " ".join(random.choice("abcdefgh") * random.randint(1, 3) for _ in range(random.randint(0, 400)))) for k in range(120)]
    frame = spark.createDataFrame(random.sample(rows, len(rows)), "doc_id long, text string").repartition(5)
    got = {r["_id"]: r for r in fingerprints.fingerprints(frame, ranges=7).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(text) // 4
        changed = text[: len(text) - k] + after[:k]
        own, edited, following = fingerprints.sketches(pa.array([text, changed, after]))
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.written(own) and r["edited_fingerprint"] == fingerprints.written(edited)
        assert r["near_edited"] == fingerprints.likeness(own, edited) and r["near_next"] == fingerprints.likeness(own, following)
    every = fingerprints.fingerprints(odd).collect()
    assert len(every) == len(odd_rows) and all(0 <= r["near_next"] <= 1 for r in every)
    assert len({r["fingerprint"] for r in every if r["_id"] in (3, 4)}) == 1
    assert fingerprints.fingerprints(odd.limit(0)).count() == 0
    only = fingerprints.fingerprints(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).collect()
    assert only[0]["near_next"] == 1.0


def test_sketches_estimate_likeness_and_merge():
    random.seed(3)
    vocabulary = [f"w{k}" for k in range(5000)]
    a = [random.choice(vocabulary) for _ in range(8000)]
    b = a[:6000] + [random.choice(vocabulary) for _ in range(2000)]
    x, y, z = fingerprints.sketches(pa.array([" ".join(a), " ".join(b), " ".join(a[:1000])]))
    assert abs(fingerprints.likeness(x, y) - 0.6) < 0.05
    assert fingerprints.containment(z, x) > 0.98
    assert (fingerprints.read(fingerprints.written(x)) == x).all()
    assert set(fingerprints.merge(x, y).tolist()) == set(x.tolist()) | set(y.tolist())


# ---- secrets

SECRET = 'password = "hunter22x"'


@pytest.mark.parametrize(
    "wrap",
    [
        urllib.parse.quote,
        lambda s: urllib.parse.quote(urllib.parse.quote(s)),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(base64.b64encode(("abc " + s).encode())).decode(),
        lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(zlib.compress(zlib.compress(s.encode()))).decode(),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: "".join(f"&#x{ord(c):x};" for c in s),
        lambda s: urllib.parse.quote(base64.b64encode(gzip.compress(base64.b64encode(s.encode()))).decode()),
    ],
)
def test_secrets_in_layers(wrap):
    text = "é " + wrap(SECRET) + " z"
    base, every, layers = secret_scan.scan(text)
    assert base == [] and layers > 0
    (kind, a, b), = every
    assert kind == "assign" and 2 <= a < b <= len(text) - 2


def _brute_secrets(text):
    out = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0]), s[2]))


def test_base_secrets_as_by_brute_force(spark, odd, odd_rows):
    random.seed(4)
    bits = ["password", "PassWD", "api_key", "APIKEY", "token", "secret", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "abcdef", "12", "AKIA", "ABCDEFGH0123", "0123456789abcdef", "é", "\n", ".-_/"]
    rows = [(k, "".join(random.choice(bits) for _ in range(random.randint(0, 60)))) for k in range(400)]
    got = secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        base = _brute_secrets(rows[r["_id"]][1])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(r["spans"].split(",")) | {""}
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
    assert secret_scan.secrets(odd).count() == len(odd_rows)
    assert secret_scan.secrets(odd.limit(0)).count() == 0


def test_layers_end():
    text = SECRET
    for _ in range(30):
        text = base64.b64encode(text.encode()).decode()
        if len(text) > 20_000:
            break
    assert len(secret_scan.scan(text)[1]) == 1
    for long in ("%41" * 100_000, "\\u0041" * 50_000, "A" * 500_000 + "==", "password " * 50_000):
        secret_scan.scan(long)


def test_an_equal_layer_counts_at_every_place():
    blob = base64.b64encode(SECRET.encode()).decode()
    packed = base64.b64encode(gzip.compress(("x " + blob + " y " + blob).encode(), mtime=0)).decode()
    for one in (blob, packed, base64.b64encode(blob.encode()).decode()):
        text = f"{one} and {one}\n{one}."
        every = sorted(secret_scan.scan(text)[1], key=lambda s: s[1])
        assert [k * (len(one) + 5 - (k == 2) * 2) <= a < b <= len(text) for k, (_, a, b) in enumerate(every)] == [True] * 3
        assert len({b - a for _, a, b in every}) == 1


@pytest.mark.parametrize("beside", ["\xa0", "\ufeff", "\u200b", "\u200d", "\u2028", "\u3000", "\f", "\v", "\x1b", b"\xff", b"caf\xe9 ", "utf-16"])
@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_a_layer_is_scanned_whatever_else_is_in_it(beside, pack):
    if beside == "utf-16":
        raw = ("x " + SECRET).encode("utf-16")
    else:
        raw = (beside if isinstance(beside, bytes) else beside.encode()) + b" " + SECRET.encode()
    text = "é " + base64.b64encode(pack(raw)).decode() + " z"
    (kind, a, b), = secret_scan.scan(text)[1]
    assert kind == "assign" and 2 <= a < b <= len(text) - 2


def _wrapped(raw, end="\n", before="", n=76):
    b = base64.b64encode(raw).decode()
    return end.join(before + b[k : k + n] for k in range(0, len(b), n))


@pytest.mark.parametrize(
    "text",
    [
        _wrapped(("x " * 107 + SECRET + " y" * 60).encode()),
        "-----BEGIN DATA-----\n" + _wrapped(random.Random(5).randbytes(321) + SECRET.encode(), n=64) + "\n-----END DATA-----",
        _wrapped(("x " * 15 + SECRET).encode(), "\r\n", "  ", 60),
        _wrapped(gzip.compress(random.Random(5).randbytes(300) + SECRET.encode())) + "\nThe end",
        _wrapped(zlib.compress(random.Random(5).randbytes(300) + SECRET.encode()), "\n", "> "),
        "https://h.example/v1/files/" + base64.b64encode(SECRET.encode()).decode().rstrip("="),
        "https://h.example/v1/files/" + base64.b64encode(SECRET.encode()).decode().rstrip("=") + "/thumb-nail",
        "https://h.example/v1/files/" + base64.urlsafe_b64encode(gzip.compress(SECRET.encode())).decode() + "/thumb",
        base64.b64encode(gzip.compress(b"first") + gzip.compress(SECRET.encode())).decode(),
        base64.b64encode(gzip.compress(random.Random(5).randbytes(900) + SECRET.encode() + random.Random(6).randbytes(900))[:-300]).decode(),
    ],
)
def test_wrapped_joined_and_cut_layers(text):
    found = secret_scan.scan("é " + text + " z")[1]
    assert {k for k, _, _ in found} == {"assign"} and all(2 <= a < b <= len(text) + 2 for _, a, b in found)


def test_large_content_is_scanned_in_chunks(monkeypatch):
    monkeypatch.setattr(secret_scan, "MAX_LAYER", 1 << 16)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1 << 10)
    monkeypatch.setattr(secret_scan, "PIECE", 1 << 12)
    for at in (0, (1 << 16) - 8, 150_000, 300_000):
        for pack in (gzip.compress, lambda x: bz2.compress(zlib.compress(x))):
            raw = b"x " * (at // 2) + SECRET.encode() + b" y" * ((300_000 - at) // 2)
            assert [k for k, _, _ in secret_scan.scan(base64.b64encode(pack(raw)).decode())[1]] == ["assign"]


# ---- toxicity

def test_segments_are_all_maximal_ones():
    def brute(score):
        # repeatedly the best segment (the first, shortest of equals), then both sides
        if not len(score) or max(score) <= 0:
            return []
        best = max(((sum(score[a:b]), -(b - a), -a) for a in range(len(score)) for b in range(a + 1, len(score) + 1)))
        a, b = -best[2], -best[2] - best[1]
        return brute(score[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute(score[b:])]

    random.seed(5)
    for _ in range(300):
        # powers of two: no two segments have the same sum
        score = np.array([random.choice((-1, 1)) * random.random() for _ in range(random.randint(1, 14))])
        assert [(a, b) for a, b, _ in toxicity.segments(score)] == brute(score)


@pytest.mark.parametrize("most", [(1 << 32) - 1, 50])
def test_tokens_are_counted_by_class_in_little_memory(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "MOST_COUNTED", most, raising=False)
    rows = [("Alpha beta, alpha", 0, True), ("alpha gamma" * 3, 1, True), (None, 1, True), ("beta " * 40, 1, True), ("not counted", 0, False)]
    made = []

    def count(self, f, schema):
        """``f`` on all rows here, with the memory that numpy held at most."""
        table = self.toArrow()
        tracemalloc.start()
        batches = list(f(iter(table.to_batches())))
        made.append((tracemalloc.get_traced_memory()[1], len(batches)))
        tracemalloc.stop()
        return spark.createDataFrame(pa.Table.from_batches(batches).to_pandas(), schema)

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.mapInArrow", count)
    got = {r["bin"]: (r["clean"], r["toxic"]) for r in toxicity.token_counts(spark.createDataFrame(rows, "text string, toxic int, counted boolean")).collect()}
    want = defaultdict(lambda: [0, 0])
    for text, toxic, counted in rows:
        for _, _, _, levels in toxicity._tokens(pa.array([text if counted else None], pa.string())):
            for b in np.concatenate(levels).tolist():
                want[b][toxic] += 1
    assert got == {b: tuple(map(float, n)) for b, n in want.items()}
    assert made[0][0] < 2 * 4 * toxicity.BINS + (12 << 20) and (made[0][1] > 1) == (most == 50)


def test_toxicity_is_learnt_and_held_out_rows_are_not(spark, odd, odd_rows):
    random.seed(6)
    calm, rude = [f"word{k}" for k in range(300)], ["vileone", "viletwo", "vilethree"]
    rows, labels = [], []
    for k in range(900):
        text = [random.choice(calm) for _ in range(80)]
        toxic = k % 5 == 0
        if toxic:
            text[10:10] = random.choices(rude, k=4)
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r["_id"]: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[k]["score"] >= 0.5) == bool(t) for k, _, t in labels]) > 0.99
    held = {r[0] for r in docs.filter(toxicity.held_out("doc_id")).select("doc_id").collect()}
    assert held == {k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    # labels of held-out rows change nothing
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped)
    assert (again.counts == model.counts).all() and (again.weights == model.weights).all()
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert {c for c in toxicity.clean(odd, model).columns} == set(odd.columns)
    assert toxicity.clean(odd, model).count() == len(odd_rows)
    nothing = toxicity.fit(docs, marks.limit(0))
    assert max(r["score"] for r in toxicity.score(docs, nothing).collect()) < 0.01
    twice = marks.unionByName(spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1)], marks.schema))
    assert toxicity.fit(docs, twice).counts.shape == model.counts.shape


# ---- BPE

@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary("byte_bpe_50k.json")
    return tokenizers.Tokenizer.from_file(path), bpe.load(path)


def test_bpe_as_the_library(tokenizer):
    theirs, own = tokenizer
    random.seed(7)
    letters = "aabbccdde  \n\t'stremllvd.,!éü🤦🏼‍\x1c\x1d\x85 　漢字12３٣½²ⅣⅧ"
    for k in range(3000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
        if k % 3 == 0:
            text = text.replace("d", "<|endoftext|>")
        if k % 5 == 0:
            text = "".join(random.choice("aehtin%*") for _ in range(60))
        packed = own.encode(text)
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == theirs.encode(text, add_special_tokens=False).ids
        assert own.decode(packed) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_of_rows(spark, tokenizer, odd, odd_rows):
    theirs, _ = tokenizer
    got = bpe.encode(odd, bpe.vocabulary("byte_bpe_50k.json"), with_ids=True).collect()
    want = sorted((str(i), theirs.encode(t or "", add_special_tokens=False).ids) for i, t in odd_rows)
    assert sorted((str(r["_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    assert bpe.encode(odd.limit(0), bpe.vocabulary("byte_bpe_50k.json")).count() == 0
