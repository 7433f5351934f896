"""Operators on whole tables: sharding, substring and exact dedup, n-gram join, mixing, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlab.llm import components, exact_dedup, mixing, ngram_join, queries, sharding, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


# ---- components

def test_components_of_chains_stars_and_rings(spark):
    random.seed(1)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(1, 2), (2, 3), (3, 1), (5, 5)]
    links += [(random.randint(1000, 1400), random.randint(1000, 1400)) for _ in range(250)]
    random.shuffle(links)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find({x for p in links for x in p}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: r for n, r in want.items() if n in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- sharding

@pytest.mark.parametrize("per_range", [1_000_000, 40])
def test_shards_are_even_and_slots_gapless(spark, monkeypatch, per_range):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", per_range)
    random.seed(2)
    rows = [(k, random.choice(["hot copy " * 3, "x" * random.randint(0, 300), "é" * random.randint(0, 50)])) for k in range(3000)]
    rows += [(7, "same row")] * 500
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 16).collect()
    assert sorted((r["_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows)
    held, slots = defaultdict(int), defaultdict(list)
    for r in got:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    total = sum(held.values())
    assert sorted(held) == list(range(16)) and all(abs(b - total / 16) <= 302 for b in held.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_no_range_with_several_keys_stays_overfull(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 20)
    random.seed(3)
    rows = [(k, "x" * (200_000 if k in (5, 6, 700) else random.randint(0, 30))) for k in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = docs.select(F.xxhash64("text").alias("h"), F.xxhash64("doc_id").alias("g"), (F.octet_length("text").cast("long") + 1).alias("size"), F.lit(1).alias("n"))
    total, ranges = sum(len(t) + 1 for _, t in rows), 128
    _, totals = sharding._splitters(keyed, ranges, total, len(rows))
    assert sum(t["rows"] for t in totals) == len(rows)
    for t in totals:
        assert t["keys"] == 1 or t["bytes"] <= sharding.OVERFULL * total / ranges and t["keys"] <= sharding.OVERFULL * max(len(rows) / ranges, 20)


def test_shards_of_odd_tables(spark, odd, odd_rows):
    got = sharding.shard(odd, 4).collect()
    assert len(got) == len(odd_rows) and {r["size"] for r in got if r["_id"] == 1} == {1}
    assert sharding.shard(odd.limit(0), 4).count() == 0


# ---- substring dedup

def _without_repeats(rows):
    none, first, every = substring_dedup.NO_ID, {}, []
    for i, t in rows:
        w, key = WORD.findall(t or ""), none if i is None else i
        every.append((i, key, w))
        for a in range(len(w) - 12):
            g = tuple(w[a : a + 13])
            first[g] = min(first.get(g, key), key)
    out = []
    for i, key, w in every:
        gone = [False] * len(w)
        for a in range(len(w) - 12):
            if first[tuple(w[a : a + 13])] < key:
                gone[a : a + 13] = [True] * 13
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages():
    random.seed(3)
    words = ["the", "of", "a", "x", "yy", "zz"] + [f"w{k}é" for k in range(400)]
    shared = [random.choice(words) for _ in range(70)]
    rows = [(None, None), (1, None), (1, ""), (2, "  \n"), (3, "a " * 100), (4, "a " * 50), (4, "a " * 20 + " b" * 20)]
    for k in range(400):
        w = [random.choice(words) for _ in range(random.randint(1, 120))]
        if k % 2:
            w[3:3] = shared[random.randint(0, 20) : 50 + random.randint(0, 20)]
        rows.append((random.choice([None, 10, 11, k + 20, k + 20, k + 20]), random.choice([" ", "\n", "  "]).join(w)))
    return rows + rows[5:80]


@pytest.mark.parametrize("bucket,one_of", [(6 << 20, 64), (20_000, 2)])  # the second has frequent minimisers in parts
def test_repeated_passages_go(spark, passages, monkeypatch, bucket, one_of):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(substring_dedup, "SAMPLE_ONE_OF", one_of)
    if one_of == 2:
        monkeypatch.setattr(substring_dedup, "HOT_SHARE", 0.05)
    frame = spark.createDataFrame(passages, "doc_id long, text string").repartition(5)
    if one_of == 2:
        rows = frame.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
        assert substring_dedup._frequent(rows, 10)
    got = substring_dedup.remove_repeats(frame).collect()
    assert sorted((tuple(r) for r in got), key=str) == _without_repeats(passages)


def test_rows_without_ids_are_told_apart_by_their_texts(spark):
    passage = " ".join(f"w{k}" for k in range(16))
    # texts with the passage and texts without any repeat that have one 32-bit hash
    numbers = spark.range(150_000)
    held = numbers.select(F.concat(F.lit(passage + " a"), F.col("id").cast("string")).alias("t"))
    free = numbers.select(F.concat_ws(" ", *[F.concat(F.lit(f"f{j}x"), F.col("id").cast("string")) for j in range(16)]).alias("t"))
    pairs = held.select(F.hash("t").alias("h"), "t").join(free.select(F.hash("t").alias("h"), F.col("t").alias("u")), "h").limit(3).collect()
    assert pairs
    for p in pairs:
        rows = [(1, passage), (None, p["t"]), (None, p["u"])]
        got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((tuple(r) for r in got), key=str) == _without_repeats(rows)
        assert sorted(r["n_removed"] for r in got) == [0, 0, 16]


def test_passages_of_odd_tables(odd, odd_rows):
    got = substring_dedup.remove_repeats(odd, with_text=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == _without_repeats(odd_rows)
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


# ---- exact dedup

def _copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    return {t: (min(g), len(g)) for t, g in groups.items()}


@pytest.mark.parametrize("most", [1 << 28, 1 << 19])
def test_exact_copies(spark, odd, odd_rows, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "MAX_BITS", most)
    random.seed(4)
    rows = [(k, random.choice(["a b", "ab", " a\tb", "x" * random.randint(0, 500), f"{k} text", f"{k % 50}\ntext"])) for k in range(2000)]
    for given, frame in ((rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(6)), (odd_rows, odd)):
        want, got = _copies(given), exact_dedup.duplicates(frame).collect()
        assert len(got) == len(given)
        by_sha = {hashlib.sha256(t.encode()).digest(): v for t, v in want.items()}
        kept = defaultdict(int)
        for r in got:
            (_, none, keep), n = by_sha[bytes(r["_sha"])]
            assert r["_keep_id"] == (None if none else keep) and r["_group_size"] == n
            kept[bytes(r["_sha"])] += r["_kept"]
        assert set(kept.values()) == {1} and len(kept) == len(want)
        assert exact_dedup.drop_copies(frame).count() == len(want)
    assert exact_dedup.drop_copies(odd).columns == odd.columns
    assert exact_dedup.duplicates(odd.limit(0)).count() == 0 == exact_dedup.drop_copies(odd.limit(0)).count()


def test_only_possibly_repeated_rows_are_grouped(spark):
    rows = exact_dedup.digests(spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 19_000).cast("string").alias("text"))).cache()
    bits = exact_dedup.filter_bits(20_000)
    maybe = exact_dedup.with_maybe(rows, exact_dedup.repeated_cells(rows, bits), bits).filter("_maybe")
    assert 2000 <= maybe.count() < 2300
    rows.unpersist()


# ---- n-gram join

def _similar(rows):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    of, common = defaultdict(list), defaultdict(int)
    for k, s in sets.items():
        for g in s:
            of[g].append(k)
    for members in of.values():
        for x in range(len(members)):
            for y in range(x):
                common[members[y], members[x]] += 1
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c)]
    top = union_find(sets, links)
    least = defaultdict(list)
    for k, t in top.items():
        least[t].append(rows[k][0])
    best = {t: min((i for i in ids if i is not None), default=None) for t, ids in least.items()}
    return sorted(((rows[k][0], len(sets[k]), best[top[k]]) for k in sets), key=str)


def _families(seed):
    random.seed(seed)
    words = [f"w{k}" for k in range(3000)]
    shared = [random.choice(words) for _ in range(40)]

    def family(n, copies, rate, more=()):
        base = [random.choice(words) for _ in range(n)]
        for _ in range(copies):
            own = list(base)
            for _ in range(int(random.random() * rate * n)):
                own[random.randrange(n)] = random.choice(words)
            own[5:5] = more
            yield " ".join(own)

    texts = [None, "", " ", "a", "a b", "A b", "a b c d e", "a b c d e f"]
    for n in (6, 8, 10, 15, 30, 60, 100, 400):
        texts += [*family(n, 12, 0.12), *family(n, 25, 0.06, shared)]
    texts += [*family(60, 50, 0.1, shared), *family(60, 50, 0.1, shared), *family(300, 60, 0.08)]
    return list(enumerate(texts))


def test_similar_groups_as_by_brute_force(spark):
    rows = _families(5)
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=str) == _similar(rows)


def _crowds(seed):
    """Texts made almost wholly of passages that many share: many components, cores that differ by a word, chains over them."""
    random.seed(seed)
    word = lambda: f"u{random.getrandbits(40)}"
    passage = [word() for _ in range(64)]
    cores = [passage, passage[:30] + ["x"] + passage[31:], passage[:10] + ["y"] + passage[11:50] + ["z"] + passage[51:], [word() for _ in range(70)]]
    rows = []
    for k in range(420):
        core = cores[k % 4] if k % 7 else cores[0][: random.randint(55, 64)]
        own = [word() for _ in range(random.randint(9, 15) if k % 4 else random.choice([3, 8, 12]))]
        rows.append((k, " ".join(core + own if k % 2 else own[:4] + core + own[4:])))
    return random.sample(rows, len(rows))


def test_similar_groups_in_crowds_as_by_brute_force(spark, monkeypatch):
    rows = _crowds(1)
    leaders = []
    between = ngram_join._between
    monkeypatch.setattr(ngram_join, "_between", lambda members, *a: leaders.append(members.select("node").distinct().count()) or between(members, *a))
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = _similar(rows)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert len({c for _, _, c in want}) > 30 and leaders and max(leaders) < len(rows) / 4


def test_near_copies_kept_apart_by_their_changes_make_no_pairs(spark, monkeypatch):
    random.seed(11)
    word = lambda: f"u{random.getrandbits(40)}"
    passage, rows = [word() for _ in range(120)], []
    for k in range(240):
        text = list(passage)
        for at in random.sample(range(5, 115, 5), 3):  # 15 of 116 shingles are its own; every eighth is like the passage, so they are linked
            if k % 8 or at < 30:
                text[at] = word()
        rows.append((k, " ".join(text)))
    pairs = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda p, sets: pairs.append(p.count()) or verified(p, sets))
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = _similar(rows)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert len({c for _, _, c in want}) > 150 and sum(pairs) < 8 * len(rows)


def test_similar_groups_of_odd_tables(odd, odd_rows):
    # ids repeat here: components are by row
    got = ngram_join.similar_groups(odd).collect()
    assert sorted((tuple(r) for r in got), key=str) == _similar(odd_rows)
    assert ngram_join.similar_groups(odd.limit(0)).count() == 0


def test_partners_share_a_signature_in_common_bands():
    random.seed(6)
    for _ in range(150):
        n = random.choice([1, 4, 5, 8, 12, 20, 39, 41, 60, 150, 700])
        a = {random.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(random.randint(0, n // 4)):
            b.discard(random.choice(sorted(b)))
        while random.random() < 0.7 and len(b) < 2 * n:
            b.add(random.getrandbits(64))
        if not b or len(a & b) * 5 < len(a | b) * 4:
            continue
        flat = np.array(sorted(a) + sorted(b), np.uint64)
        s = ngram_join.Sets(flat, np.array([0, len(a), len(a) + len(b)]))
        found = defaultdict(set)
        for lower in (False, True):
            row, sig, _ = ngram_join.signatures(s, lower)
            for r, x in zip(row.tolist(), sig.tolist()):
                found[r].add(x)
        assert found[0] & found[1], (len(a), len(b))


# ---- mixing

def test_rates_meet_the_targets(spark, odd, odd_rows):
    random.seed(7)
    rows, labels = [], []
    for k in range(1500):
        low = k % 4 == 0
        text = " ".join((f"WORD{random.randint(0, 99)}!!" if low else f"word{random.randint(0, 999)}") for _ in range(random.randint(1, 60)))
        rows.append((k, text))
        if k % 3 == 0:
            labels.append((k, 0 if low else 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = mixing.mix(docs, marks, F.col("quality"), (0.5, 0.5)).toPandas()
    words, p = got["n_words"].to_numpy(), np.stack(got["p"].to_numpy())
    shares = (words * got["rate"]).to_numpy() @ p / words.sum()
    assert np.abs(shares - 0.5).max() < 2e-3 and (got["rate"] >= 0).all()
    assert np.mean((p[:, 0] > 0.5) == (got["_id"] % 4 == 0)) > 0.98
    thinned = mixing.mix(docs, marks, F.col("quality"), (0.05, 0.95), most=1.0).toPandas()
    assert thinned["rate"].max() <= 1 and thinned["rate"].min() >= 0
    assert len(mixing.mix(odd, marks, F.col("quality"), (0.5, 0.5)).collect()) == len(odd_rows)
    blind = mixing.mix(docs, marks.limit(0), F.col("quality"), (0.5, 0.5)).collect()
    assert all(list(r["p"]) == [0.5, 0.5] for r in blind)
    assert mixing.mix(docs.limit(0), marks, F.col("quality"), (0.5, 0.5)).count() == 0


def test_bounded_rates_are_the_best_ones(spark):
    rng = np.random.default_rng(3)
    low = np.clip(rng.beta(0.6, 0.6, 4000), 0.02, 0.98)
    t = rng.integers(1, 60, 4000)
    rows = spark.createDataFrame([(int(n), [float(x), float(1 - x)]) for n, x in zip(t, low)], "n_words long, p array<double>").repartition(2).cache()
    p = np.column_stack([low, 1 - low])
    for total in (0.5, 0.9):
        rates, now, goal = mixing.fit_rates(rows, (0.1, 0.9), total=total, most=1.0)
        r = rates.of(p)
        assert np.allclose((r * t) @ p / t.sum(), now) and (r >= 0).all() and (r <= 1).all()
        gradient = p @ (now - goal)  # no corner of the box is nearer: the gap bounds what half the squared distance could still lose
        assert (t * gradient * (r - (gradient < 0))).sum() / t.sum() < 1e-5
    _, now, goal = mixing.fit_rates(rows, (0.1, 0.9), most=1.0)
    assert np.abs(now / now.sum() - (0.1, 0.9)).max() < 1e-3 and 0.1 < now.sum() < 1


def test_rates_of_many_domains_and_of_targets_out_of_reach(spark):
    rng = np.random.default_rng(5)
    p = np.exp(rng.normal(size=(3000, 4)) * 2)
    p /= p.sum(axis=1, keepdims=True)
    t, weights = rng.integers(0, 2000, 3000), (0.4, 0.35, 0.2, 0.05)
    rows = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p)], "n_words long, p array<double>").repartition(3).cache()
    for most in (None, 1.0, 0.5):
        rates, now, goal = mixing.fit_rates(rows, weights, most=most)
        r = rates.of(p)
        assert np.abs(now / now.sum() - weights).max() < 2e-4 and np.allclose((r * t) @ p / t.sum(), now) and np.allclose(now, goal, atol=2e-4)
        assert r.min() >= 0 and (most is None or r.max() <= most)
        column = sorted(x["r"] for x in rows.select(rates.column().alias("r")).collect())
        assert np.allclose(column, np.sort(r))
    # without bounds in reach the steps go to the least change of the rates, as the normal equations have it
    rates, now, goal = mixing.fit_rates(rows, (p * t[:, None]).sum(axis=0) / t.sum() + (0.01, -0.01, 0.005, -0.005))
    u = np.linalg.solve((p * t[:, None]).T @ p / t.sum(), now - (p * t[:, None]).sum(axis=0) / t.sum())
    assert rates.of(p).min() > 0 and np.allclose(rates.of(p), 1 + p @ u, atol=1e-4)
    # every document alike: no rates meet the shares, and not all documents go
    alike = spark.createDataFrame([(10, [0.5, 0.5])] * 20, "n_words long, p array<double>")
    rates, now, _ = mixing.fit_rates(alike, (0.1, 0.9), most=1.0)
    assert np.allclose(rates.of(np.full((1, 2), 0.5)), now.sum()) and now.sum() > 0.4


# ---- pipeline

def test_stages_on_odd_tables(spark, odd, odd_rows, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (8, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == odd.columns, name
            n = out.count()
            assert n <= len(odd_rows)
            if name == "exact dedup" and frame is odd:
                assert n == len(_copies(odd_rows))
            if name == "n-gram Jaccard join" and frame is odd:
                wordless = {(i, t) for i, t in odd_rows if not WORD.findall(t or "")}
                assert n == len(wordless) + len({t.strip() for _, t in odd_rows if WORD.findall(t or "")})
        assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() == frame.count()


def test_pipeline_runs_its_stages_in_order(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data_dir).cache()
    want = sorted(map(str, docs.collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, data_dir).collect())) == want
    assert 0 < len(want) < spark.read.parquet(f"{data_dir}/documents.parquet").count()


# ---- queries

def test_every_query_has_its_columns(spark, data_dir):
    columns = {
        "op2": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op3": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op4": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op6": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op7": ["doc_id", "held_out", "score", "predicted"],
        "op8": ["doc_id", "n_shingles", "component_id"],
        "op9": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        "op10": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op11": ["doc_id", "n_features", "weight", "score", "rank"],
        "op12": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op13": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    }
    for name, query in queries.QUERIES.items():
        got = query(spark, data_dir)
        n = spark.read.parquet(f"{data_dir}/{'embeddings' if name.startswith('op13') else 'documents'}.parquet").count()
        want = columns.get(name.split("_")[0], ["doc_id"])
        assert got.columns[: len(want)] == want, name
        assert got.count() == n, name
