import hashlib
import time

import numpy as np

from cohortlab.functions.bootstrap import _CLOSE, _COUNT, _LADDER, _STEPS, _add_in_order, _mixed, _poisson_counts, _weights, poisson_matrix
from cohortlab.functions.hashing import md5_words


def plain(ids, seed, replicates):
    raw = b"".join(
        hashlib.md5(f"{seed}|{b}".encode() + (b"" if i is None else b"|" + i.encode())).digest() for i in ids for b in range((replicates + 3) // 4)
    )
    draws = np.frombuffer(raw, ">u4").reshape(len(ids), -1)[:, :replicates]
    return np.searchsorted(_STEPS, draws.astype(np.int64), "right").astype(float)


def test_digests_of_any_length():
    tails = [b"", b"|", b"x" * 40, b"y" * 51, b"y" * 52, b"z" * 300, "ä€𝄞".encode(), *[str(i).encode() for i in range(300)]]
    heads = [b"", b"7|1", b"7|10", b"7|100", b"", b"7|1"]
    got = md5_words(tails, heads)
    assert all(got[i, j].astype(">u4").tobytes() == hashlib.md5(h + t).digest() for i, t in enumerate(tails) for j, h in enumerate(heads))
    assert md5_words([], heads).shape == (0, 6, 4)


def test_weights_next_to_every_step():
    near = np.unique(np.concatenate([_STEPS + k for k in (-65537, -65536, -1, 0, 1, 65535, 65536)]).clip(0, 2**32 - 1))
    assert _weights(near.astype(np.uint32)).tolist() == np.searchsorted(_STEPS, near, "right").tolist()


def test_row_weights_are_those_of_single_digests_and_take_a_fraction_of_their_time():
    ids = [None, "", "5", "5", "é", "k" * 60, *[str(7 * i) for i in range(1500)]]
    poisson_matrix(ids[:50], 42, 1000)
    begun = time.process_time()
    got = poisson_matrix(ids, 42, 1000)
    own = time.process_time() - begun
    begun = time.process_time()
    want = plain(ids, 42, 1000)
    assert (got == want).all()
    assert own < 0.6 * (time.process_time() - begun)


def test_counts_of_scores_next_to_every_step_and_in_a_fraction_of_the_time():
    keys = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    draws = _mixed(keys[:, None] ^ _mixed(np.arange(1, 1001, dtype=np.uint64))[None, :]) >> np.uint64(11)
    ones = np.ones(len(keys), np.int64)
    _poisson_counts(keys[:50], ones[:50], 1000)
    begun = time.process_time()
    got = _poisson_counts(keys, ones, 1000)
    own = time.process_time() - begun
    begun = time.process_time()
    want = np.searchsorted(_LADDER, draws / float(1 << 53), "right")
    assert (got == want).all()
    assert own < 0.5 * (time.process_time() - begun)
    # every draw next to a step is looked up by all its bits
    steps = (_LADDER[:-1] * 2.0**53).astype(np.int64)
    near = np.unique(np.concatenate([steps + k for k in (-1, 0, 1)]).clip(0, 2**53 - 1))
    upper = _COUNT[near >> 37]
    assert ((upper == _CLOSE) | (upper == np.searchsorted(_LADDER, near / 2.0**53, "right"))).all()


def test_running_totals_of_rows_with_positives_negatives_or_both():
    rng = np.random.default_rng(3)
    n_pos, n_neg = rng.integers(0, 3, 60), rng.integers(0, 3, 60)
    pos, neg = rng.integers(0, 5, (60, 7)) * (n_pos > 0)[:, None], rng.integers(0, 5, (60, 7)) * (n_neg > 0)[:, None]
    upto = 10 + np.cumsum(neg, axis=0)
    want = pos.sum(axis=0), 10 + neg.sum(axis=0), 3 + (pos * (upto - neg / 2)).sum(axis=0)
    pos_at, neg_at = np.flatnonzero(n_pos), np.flatnonzero(n_neg)
    state = [0.0, np.zeros(7), np.full(7, 10.0), np.full(7, 3.0)]
    _add_in_order(state, pos[pos_at], neg[neg_at], pos_at, neg_at)
    assert all((a == b).all() for a, b in zip(state[1:], want, strict=True))
