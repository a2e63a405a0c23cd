import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyshelf.llm import deleted


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "</s>"]


def fold(ident):
    return zlib.crc32(("null" if ident is None else str(ident)).encode()) % 7


def plain(rows, order=2):
    """The same model in dictionaries, without grouping of events."""
    def count(keep):
        grams, texts = [Counter() for _ in range(order)], 0
        for ident, text in rows:
            if keep(fold(ident)):
                own = ["<s>"] * order + tokens(text)
                texts += 1
                for n in range(order):
                    grams[n].update(tuple(own[i - n:i + 1]) for i in range(order, len(own)))
        return grams, texts

    def events(text, grams, texts):
        own = ["<s>"] * order + tokens(text)
        total, words = sum(grams[0].values()), len(grams[0])
        for i in range(order, len(own)):
            p, bucket = [1 / (words + 1), grams[0][(own[i],)] / max(total, 1)], 0
            for n in range(2, order + 1):
                context = tuple(own[i - n + 1:i])
                seen = texts if i == order else grams[n - 2][context]
                p.append(grams[n - 1][(*context, own[i])] / seen if seen else 0.0)
                if seen:
                    bucket = (n - 1) * deleted.CONTEXTS + int(math.log2(seen))
            yield own[i], bucket, p

    grams, texts = count(lambda f: f not in (2, 3))
    held = [e for ident, text in rows if fold(ident) == 3 for e in events(text, grams, texts)]
    codes = Counter()
    for _, bucket, p in held:
        code, times = deleted.grouped_events(np.array([bucket]), [np.array([x]) for x in p])
        codes[int(code[0])] += int(times[0])
    weights = deleted.mixture_weights(sorted(codes.items()), order)
    grams, texts = count(lambda f: f != 2)
    total, words = sum(grams[0].values()), len(grams[0])
    out = []
    for ident, text in rows:
        base = score = known = 0
        for token, bucket, p in events(text, grams, texts):
            c = grams[0][(token,)]
            base += math.log10((c + 1) / (total + 1 * (words + 1)))
            score += math.log10(sum(w * x for w, x in zip(weights[bucket], p)))
            known += c > 0
        out.append((ident, fold(ident) == 2, len(tokens(text)), known, total, base, score))
    return out


def same(got, want):
    def key(r):
        return (repr(r[0]), r[2], round(r[6], 6))

    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own, text = rng.choice(words), []
        for _ in range(rng.randint(0, 60)):
            text.append(own)
            own = words[(words.index(own) * 7 + rng.choice([1, 1, 1, 2, 5])) % 60] if own in words else rng.choice(words)
            if rng.random() < 0.05:
                text.append(f"Rare{rng.randint(0, 500)}")
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("order", [2, 3])
def test_against_plain_version(spark, order, monkeypatch):
    monkeypatch.setattr(deleted, "buckets_for", lambda chunks: 3)
    rows = corpus(order)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = deleted.scored(docs, order=order, chunk_bytes=4000).collect()
    same(got, plain(rows, order))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_fit_their_events():
    """Events where the pair estimate is right far more often than not get most of the weight."""
    bucket = np.full(1000, deleted.CONTEXTS + 4)
    good = np.where(np.arange(1000) < 900, 0.5, 0.0)
    code, times = deleted.grouped_events(bucket, [np.full(1000, 1e-4), np.full(1000, 1e-3), good])
    weights = deleted.mixture_weights(list(zip(code.tolist(), times.tolist())), 2)
    assert np.allclose(weights.sum(1), 1) and weights[deleted.CONTEXTS + 4, 2] > 0.85
    assert (weights[:deleted.CONTEXTS, 2] == 0).all()


def test_probabilities_add_up(spark):
    """Over all known words and one unknown, after the same start, chances add up to one."""
    rows = corpus(7)
    known = {w for ident, text in rows if fold(ident) != 2 for w in tokens(text)} - {"</s>"}
    probe = [(10_000 + i, w) for i, w in enumerate([*sorted(known), "never-seen"])]
    probe = [(i * 10_000_000, w) for i, w in probe]
    held = [(next(j for j in range(i, i + 1000) if fold(j) == 2), w) for i, w in probe]
    docs = spark.createDataFrame([*rows, *held, (next(j for j in range(10**12, 10**12 + 99) if fold(j) == 2), "")], "doc_id bigint, text string")
    got = deleted.scored(docs).collect()
    total = 0.0
    ends = {}
    plain_rows = {r[0]: r for r in plain([*rows, *held])}
    for r in got:
        if r.doc_id in plain_rows and r.doc_id >= 10_000_000:
            ends[r.doc_id] = r.score
    assert len(ends) == len(held)
    same([r for r in got if r.doc_id in plain_rows], list(plain_rows.values()))
    total = sum(10 ** s for s in ends.values())
    assert 0 < total < 1  # one word and then the end


def test_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (1, "a b c"), (2, ""), (3, "A B a b"), (3, "A B a b"), (9, "long " * 60_000), (14, "é ß")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, chunk int")
    same(deleted.scored(docs).collect(), plain(rows))
    assert deleted.scored(docs.limit(0)).collect() == []
    alone = [(next(j for j in range(99) if fold(j) == 2), "x y")]
    same(deleted.scored(spark.createDataFrame(alone, "doc_id bigint, text string")).collect(), plain(alone))
