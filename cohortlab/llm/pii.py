"""Personal data in texts: base patterns, and identifiers found by contexts learnt from what the base patterns find.

Seeds are the entities of the base patterns. Candidates are spans of looser forms (``name [at] host dot org``, ``10[.]0[.]0[.]1``, IPv6,
digit chains without a plus sign or a right check digit) that touch no seed. Every seed and candidate stands in up to three lexical patterns:
the two words before it, the words on both sides, the two words behind it; digits in such words count as 0.

Bootstrapping works on the graph of patterns and instances, an instance being a kind and a normalised value, so copies count once:

* a pattern's confidence for a kind is pos / (pos + other + UNKNOWN * unknown + SMOOTH): the scores of its instances of the kind, its seeds
  of other kinds, and what its candidates lack to a full score. It is trusted from LEAST on, with SUPPORT accepted instances;
* a candidate's score is 1 - product(1 - confidence) over its trusted patterns; it is accepted from LEAST on;
* accepted candidates feed the patterns they stand in, until no score changes (``rounds`` at most).

Every occurrence of an accepted value is a span, and so is an occurrence of a seed's value in a looser form.

One scan reads the texts; it leaves a narrow row per document with its spans in the shared folder. Edges are summed up per task before they
are shuffled, so a pattern or value that a third of the rows share is one row per task; occurrences meet accepted values in a
plain join, whose large keys adaptive execution splits. The patterns of all four regular expressions take linear time.

Defined results: NULL and empty texts have no spans; repeated rows are scanned alike; ids may be NULL or repeat; an empty table gives an
empty result; without seeds nothing is learnt. Spans are code points, end exclusive. Other columns are never read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Fixed patterns. What stands before the @ is looked up backwards, so that long runs without one cost nothing.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Looser forms.
AT = re.compile(r"\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT)\x20|@")
DOT = r"(?:\.|\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20)"
HOST = re.compile(rf"[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)*")
LOOSE_QUAD = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}}(?![0-9])")
COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
CHAIN = re.compile(r"(?<![0-9A-Za-z_])\(?[0-9](?:[ ()./-]{0,2}[0-9])++")
#: Digits of a phone and of a card number in looser form.
PHONE_DIGITS, CARD_DIGITS = range(7, 16), range(12, 20)

#: Code points looked at on either side for two words; punctuation that is no part of a word.
REACH, PUNCTUATION = 100, ".,;:!?()[]{}<>\"'"
ZEROS = str.maketrans("123456789", "000000000")
#: Least confidence, accepted instances a trusted pattern has at least, weight of unknown instances, and smoothing.
LEAST, SUPPORT, UNKNOWN, SMOOTH = 0.7, 3, 0.25, 0.5
ROUNDS = 6

Span = tuple[int, int, int]  # number of the kind, start, end


class Occurrence(NamedTuple):
    k: int
    a: int
    z: int
    v: int
    seed: bool
    p: list[str]


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(map(int, reversed(digits))):
        total += d if place % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _at_most_255(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind and start: leftmost, not overlapping within a kind."""
    out: list[Span] = []
    free = 0  # the local part cannot reach back over an @ or into a match
    for at in re.finditer("@", text) if "@" in text else ():
        own = text[free : at.start()]
        start = at.start() - (len(own) - len(own.rstrip(LOCAL)))
        free = at.end()
        if start < at.start() and (m := DOMAIN.match(text, at.start())):
            out.append((EMAIL, start, m.end()))
            free = m.end()
    out += [(IP, m.start(), m.end()) for m in QUAD.finditer(text) if all(map(_at_most_255, m[0].split(".")))]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((CARD, m.start(), m.end()))
    if "+" in text:
        out += [(PHONE, m.start(), m.end()) for m in PLUS.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _loose(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(kind, start, end, normalised value) of the looser forms."""
    free = 0
    for m in AT.finditer(text) if "at" in text or "AT" in text or "@" in text else ():
        own = text[free : m.start()]
        start = m.start() - (len(own) - len(own.rstrip(LOCAL)))
        free = m.end()
        host = HOST.match(text, m.end())
        if start == m.start() or not host:
            continue
        labels = re.split(DOT, host[0])
        plain = m[0].strip(" ").lower() == "at"
        if len(labels) > 1 and (not plain or "." not in host[0]) or len(labels) == 1 and m[0] == "@":
            yield EMAIL, start, host.end(), f"{text[start : m.start()]}@{'.'.join(labels)}".lower()
    for m in LOOSE_QUAD.finditer(text):
        parts = re.split(DOT, m[0])
        if all(map(_at_most_255, parts)):
            yield IP, m.start(), m.end(), ".".join(parts)
    for m in COLONS.finditer(text) if ":" in text else ():
        if m[0].count(":") == 7 and "::" not in m[0] or m[0].count("::") == 1 and len(m[0]) > 4:
            yield IP, m.start(), m.end(), m[0].lower()
    for m in CHAIN.finditer(text):
        if m.end() - m.start() < PHONE_DIGITS[0] or text[m.end() : m.end() + 1].isalnum():
            continue
        d = _digits(m[0])
        for kind, lengths in ((CARD, CARD_DIGITS), (PHONE, PHONE_DIGITS)):
            if len(d) in lengths:
                yield kind, m.start(), m.end(), d


def _value(kind: int, span: str) -> str:
    return _digits(span) if kind in (CARD, PHONE) else span.lower()


def _key(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _words(around: str) -> list[str]:
    return [w.strip(PUNCTUATION).lower().translate(ZEROS) for w in around.split()]


def contexts(text: str, a: int, z: int) -> list[str]:
    """The lexical patterns that the span stands in."""
    before, after = ["", "", *_words(text[max(0, a - REACH) : a])][-2:], [*_words(text[z : z + REACH]), "", ""][:2]
    patterns = (f"{before[0]} {before[1]} _" if all(before) else "", f"{before[1]} _ {after[0]}" if before[1] and after[0] else "", f"_ {after[0]} {after[1]}" if all(after) else "")
    return [p for p in patterns if p]


def scan(text: str) -> tuple[list[Span], list[Occurrence]]:
    """(base spans, seeds and candidates with their patterns)."""
    base = base_spans(text)
    taken = sorted((a, z) for _, a, z in base)
    starts, reach, furthest = [a for a, _ in taken], [], 0
    for _, z in taken:
        reach.append(furthest := max(furthest, z))
    found = [Occurrence(k, a, z, _key(_value(k, text[a:z])), True, contexts(text, a, z)) for k, a, z in base]
    for k, a, z, value in _loose(text):
        at = bisect.bisect_left(starts, z)  # spans that start before this one ends
        if not at or reach[at - 1] <= a:
            found.append(Occurrence(k, a, z, _key(value), False, contexts(text, a, z)))
    return base, found


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in sorted(spans))


OCCURRENCE = pa.struct([("k", pa.int32()), ("a", pa.int64()), ("z", pa.int64()), ("v", pa.int64()), ("seed", pa.bool_()), ("p", pa.list_(pa.string()))])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_email, n_ip, n_card, n_phone, base_sha256, found) of every row; found: its seeds and candidates."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            sha, found = [], []
            for value in b.column(1):
                base, own = scan(value.as_py() or "")
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[0] == k for s in base))
                sha.append(hashlib.sha256(written(base).encode()).hexdigest())
                found.append([o._asdict() for o in own])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(found, pa.list_(OCCURRENCE))],
                names=["_id", *(f"n_{k}" for k in KINDS), "base_sha256", "found"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    kinds = f"_id {id_type}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, found array<struct<k:int,a:bigint,z:bigint,v:bigint,seed:boolean,p:array<string>>>"
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(each, kinds)


def _trusted(edges: DataFrame, accepted: DataFrame | None) -> DataFrame:
    """(p, k, confidence, support) of the trusted patterns."""
    known = edges.withColumn("own", F.lit(0.0)) if accepted is None else edges.join(accepted.withColumnRenamed("score", "own"), ["k", "v"], "left").fillna(0.0, ["own"])
    score = F.when(F.col("seed"), 1.0).otherwise(F.col("own"))
    sums = [
        x.alias(f"{name}{k}") for k in range(len(KINDS)) for name, x in (
            ("pos", F.sum(F.when(F.col("k") == k, score).otherwise(0.0))), ("unknown", F.sum(F.when((F.col("k") == k) & ~F.col("seed"), 1 - score).otherwise(0.0))),
            ("support", F.count_if((F.col("k") == k) & (score >= LEAST))), ("seeds", F.count_if((F.col("k") == k) & F.col("seed"))),
        )
    ]
    per = known.groupBy("p").agg(*sums)

    def of(k: int):
        pos, other = F.col(f"pos{k}"), sum(F.col(f"seeds{j}") for j in range(len(KINDS)) if j != k)
        confidence = pos / (pos + other + F.col(f"unknown{k}") * UNKNOWN + SMOOTH)
        return F.struct(F.lit(k).alias("k"), confidence.alias("confidence"), F.col(f"support{k}").alias("support"))

    rows = per.select("p", F.explode(F.array(*[of(k) for k in range(len(KINDS))])).alias("x")).select("p", "x.*")
    return rows.filter((F.col("confidence") >= LEAST) & (F.col("support") >= SUPPORT))


def learn(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(accepted values (k, v, score), trusted patterns (p, k, confidence, support)) from what ``scanned`` returned."""
    own = rows.select(F.explode("found").alias("o")).select("o.*")
    values = cut_lineage(own.groupBy("k", "v").agg(F.max("seed").alias("seed")))
    # a pattern with fewer instances than a trusted one needs can be left out
    edges = own.select("k", "v", F.explode("p").alias("p")).distinct().join(values, ["k", "v"])
    wide = edges.groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT).select("p")
    edges = cut_lineage(edges.join(wide, "p"))
    accepted, before, patterns = None, None, None
    for _ in range(rounds):
        patterns = cut_lineage(_trusted(edges, accepted))
        doubt = F.sum(F.log1p(-F.col("confidence")))
        accepted = cut_lineage(edges.filter("not seed").join(patterns, ["p", "k"]).groupBy("k", "v").agg((1 - F.exp(doubt)).alias("score")).filter(F.col("score") >= LEAST))
        now = accepted.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("k", "v", F.round("score", 6)))).first()
        if now == before:
            break
        before = now
    return values.filter("seed").select("k", "v", F.lit(1.0).alias("score")).unionByName(accepted), patterns


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) of every row; n_found: spans found by context."""
    # the row number tells rows apart that repeat; it is fixed by the checkpoint
    rows = cut_lineage(scanned(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    accepted, _ = learn(rows, rounds)
    loose = rows.select("row", F.explode("found").alias("o")).filter("not o.seed").select("row", "o.k", "o.a", "o.z", "o.v")
    more = loose.join(accepted.select("k", "v"), ["k", "v"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("k", "a", "z")).alias("more"))
    base = F.transform(F.filter("found", lambda o: o["seed"]), lambda o: F.struct(o["k"].alias("k"), o["a"].alias("a"), o["z"].alias("z")))
    every = F.array_sort(F.concat(F.col("base"), F.coalesce("more", F.expr("cast(array() as array<struct<k:int,a:bigint,z:bigint>>)"))))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["a"].cast("string"), s["z"].cast("string"))), ",")
    joined = rows.withColumn("base", base).drop("found").join(more, "row", "left")
    return joined.select("_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_found"))
