import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import katz, language, registry, toxicity
from test_dedup import LOW, ODD_ROWS, SCHEMA, words_of

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def _brute_force(rows, learns, order):
    """(n_tokens, n_known, base, score) of each text, and the unigram masses."""
    tokens = {i: words_of((t or "").translate(LOW)) + [None] for i, t in rows}
    train = [i for i in tokens if learns(i)]
    c = Counter(t for i in train for t in tokens[i])
    total, distinct = sum(c.values()), len(c)
    du = katz.discounts(Counter(c.values()))
    d = lambda own, r: own[r] if r <= katz.GT else 1.0
    mass = sum(d(du, r) * r for r in c.values()) / max(total, 1)
    unknown = max(1 - mass, 0.5 / (total + 0.5 * (distinct + 1)))
    p1 = lambda w: (1 - unknown) / mass * d(du, c[w]) * c[w] / total if c[w] else unknown

    def grams(i, n):
        own = ["<s>", *tokens[i]]
        return [tuple(own[k : k + n]) for k in range(len(own) - n + 1)]

    counts = {n: Counter(g for i in train for g in grams(i, n)) for n in range(2, order + 1)}
    after, weights = {n: defaultdict(list) for n in counts}, {n: {} for n in counts}
    dn = {n: katz.discounts(Counter(counts[n].values())) for n in counts}
    for n in counts:
        for g in counts[n]:
            after[n][g[:-1]].append(g[-1])

    def weight(context):
        """(scale of seen n-grams, backoff weight) of a context."""
        n = len(context) + 1
        if context not in weights[n]:
            ws = after[n].get(context)
            if not ws:
                weights[n][context] = (0, 1.0, 1.0)
            else:
                r = [counts[n][(*context, w)] for w in ws]
                scale = 1.0 if any(x <= katz.GT for x in r) else sum(r) / (sum(r) + 0.5)
                seen = scale * sum(d(dn[n], x) * x for x in r) / sum(r)
                weights[n][context] = (sum(r), scale, (1 - seen) / (1 - sum(p(w, context[1:]) for w in ws)))
        return weights[n][context]

    def p(w, context):
        if not context:
            return p1(w)
        n, (times, scale, alpha) = len(context) + 1, weight(context)
        r = counts[n][(*context, w)]
        return scale * d(dn[n], r) * r / times if r else alpha * p(w, context[1:])

    out = {}
    for i, ts in tokens.items():
        base = sum(math.log10((c[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in ts)
        own = ["<s>", *ts]
        score = sum(math.log10(p(w, tuple(own[max(0, k + 2 - order) : k + 1]))) for k, w in enumerate(ts))
        out[i] = (len(ts), sum(c[t] > 0 for t in ts), total, base, score)
    return out, sum(map(p1, c)) + unknown


def test_katz_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for order, hot in ((3, 1_000_000), (3, 50), (2, 1_000_000)):
        want, whole = _brute_force(rows, lambda i: zlib.crc32(str(i).encode()) % 5 != 1, order)
        assert abs(whole - 1) < 1e-9
        got = katz.katz_scores(docs.repartition(5), language.fold("doc_id", 5) != 1, order=order, hot_context=hot).collect()
        assert len(got) == len(rows)
        for r in got:
            n, known, total, base, score = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6
    held = [i for i in want if zlib.crc32(str(i).encode()) % 5 == 1]
    assert sum(want[i][4] for i in held) > sum(want[i][3] for i in held)


def test_katz_of_odd_rows(spark):
    df = spark.createDataFrame(ODD_ROWS, SCHEMA)
    got = katz.katz_scores(df, F.col("doc_id") < 4).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 2, 2, 2, 5] and all(math.isfinite(r.score) for r in got)
    nothing = katz.katz_scores(df, F.lit(False)).collect()
    assert {r.train_tokens for r in nothing} == {0} and all(math.isfinite(r.score) for r in nothing)
    assert katz.katz_scores(df.limit(0), F.lit(True)).count() == 0


def test_language_held_out(spark):
    found = registry.op5_bitmask_language_id(spark, MEDIUM)
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    own = found.where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert own.where("lang = lang_pred").count() > 0.99 * own.count()
    assert found.where("score < 0 or score > 1").count() == 0


def _byte_grams(text):
    """Four bytes with no blank in the middle, and words of one byte, between blanks."""
    raw = (text or "").encode()
    fold = [32 if x < 128 and not chr(x).isalpha() else x | 32 if x < 128 else x for x in raw]
    own = [32, *fold, 32, 32]
    out = []
    for k in range(len(own) - 3):
        a, b, c, d = own[k : k + 4]
        if a == 32 and b != 32 and c == 32:
            out.append((32, b, 32, 32))
        elif b != 32 and c != 32:
            out.append((a, b, c, d))
    return out


def test_language_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    learnt, sizes = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5 != 0 and lang is not None and text is not None:
            learnt[lang].update(_byte_grams(text))
            sizes[lang] += 1
    number = lambda g: sum(x << 8 * k for k, x in enumerate(g))
    top = {x: set(sorted(c, key=lambda g: (-c[g], number(g)))[:4000]) for x, c in learnt.items()}
    order = sorted(top, key=lambda x: (-sizes[x], x))
    got = {r.doc_id: r for r in registry.op5_bitmask_language_id(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        own = _byte_grams(text)
        share = [sum(g in top[x] for g in own) / max(len(own), 1) for x in order]
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        # The filters' corrected false positives move a share by little.
        assert abs(r.score - max(share)) < 0.01
        if sorted(share)[-1] - sorted(share)[-2] > 0.02:
            assert r.lang_pred == order[share.index(max(share))]


def test_language_of_odd_rows(spark):
    learn = spark.createDataFrame([(k, "der und die nicht ñ y " * 9 if k % 2 else "the and of that a " * 9, "de" if k % 2 else "en") for k in range(20)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = language.train(learn)
    rows = [(1, None), (2, ""), (3, "12 !? ¿"), (4, "ñ"), (5, "that and the " * 5), (None, "nicht die"), (5, "that and the " * 5), (6, "und " * 200_000), (7, "der"), (8, "die"), (9, "und"), (10, "y"), (11, "a"), (12, "the"), (13, "zzqx")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("a.b", F.lit(1))
    found = {(r.doc_id, r.lang_pred, round(r.score, 3)) for r in language.predict(df, model).collect()}
    want = {(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (None, "de"), (6, "de"), (7, "de"), (8, "de"), (9, "de"), (10, "de"), (11, "en"), (12, "en")}
    assert {x[:2] for x in found if x[0] != 13} == want and all(s > 0.5 for i, x, s in found if x != "und" and i != 13)
    assert [s for i, _, s in found if i == 13] == [0.0]
    assert language.predict(df, model, keep=("doc_id", "a.b")).columns == ["doc_id", "a.b", "lang_pred", "score"]
    none = language.train(learn.limit(0))
    assert {r.lang_pred for r in language.predict(learn, none).collect()} == {"und"} and language.predict(learn.limit(0), model).count() == 0


def test_bloom_filter_has_no_false_negatives():
    grams = {f"l{k}": np.random.default_rng(k).integers(0, 2**32, 3000).astype(np.uint32) for k in range(11)}
    model = language.LanguageFilter.build(grams, {k: 1 for k in grams})
    for name, own in grams.items():
        got = model.counts(own, np.array([0, len(own)]))[0]
        best = model.languages[int(got.argmax())]
        assert best == name and got.max() > 0.999 * len(own) and np.sort(got)[-2] < 30


def test_toxicity_held_out(spark):
    found = registry.op6_kneser_ney_toxicity(spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    own = found.where("held_out").join(labels, "doc_id")
    clean, toxic = own.where("toxic = 0"), own.where("toxic = 1")
    assert clean.where("predicted = 1").count() < 0.02 * clean.count()
    assert toxic.agg(F.avg("score")).first()[0] > clean.agg(F.avg("score")).first()[0] + 0.4
    assert found.where("score < 0 or score > 1 or (score >= 0.7) != (predicted = 1)").count() == 0


def test_kneser_ney_levels_sum_to_one():
    words = ["lowe", "lower", "slow", "low", "owl"] * 3
    gram = []
    for w in words:
        data, word = np.frombuffer(f" {w} ".encode(), np.uint8), np.zeros(len(w) + 2, int)
        gram.append(toxicity.keys(data, word, 3)[0])
    gram = np.concatenate(gram)
    level = toxicity.Level(gram, np.ones(len(gram)))
    for context in level.context:
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs(level.estimate(every, np.full(256, 1 / 256)).sum() - 1) < 1e-9


def _padded_grams(text, order):
    """The n-grams that end at each byte of a word after its opening mark, short ones behind zeros."""
    out = []
    for word in words_of(text.translate(LOW)):
        own = [32, *word.encode(), 32]
        out += [tuple([0] * max(0, order - e - 1) + own[max(0, e + 1 - order) : e + 1]) for e in range(1, len(own))]
    return out


class _Plain:
    """One interpolated Kneser-Ney level over plain dictionaries."""

    def __init__(self, counts):
        self.counts, self.total, self.kinds = counts, Counter(), Counter()
        for g, n in counts.items():
            self.total[g[:-1]] += n
            self.kinds[g[:-1]] += 1
        ones, twos = (sum(n == k for n in counts.values()) for k in (1, 2))
        self.d = ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(self, g, below):
        t = self.total[g[:-1]]
        return (max(self.counts[g] - self.d, 0) + self.d * self.kinds[g[:-1]] * below) / t if t else below


def test_kneser_ney_against_brute_force(spark):
    toxic = ["you utter idiot", "such an idiotic moron", "idiots and morons"]
    plain = ["such a lovely day", "you and the idea", "an utter delight, editors"]
    docs = spark.createDataFrame(list(enumerate(toxic + plain)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 3)) for k in range(6)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, model_rows=1000, fit_rows=0)
    order = toxicity.ORDER
    grams = [Counter(g for t in texts for g in _padded_grams(t, order)) for texts in (plain, toxic)]
    now, shared = set(grams[0]) | set(grams[1]), {}
    for n in range(order - 1, 0, -1):
        shared[n] = _Plain(Counter(g[-n:] for g in now))
        now = {g[-n:] for g in now}
    tops = [_Plain(c) for c in grams]
    asked = _padded_grams("utterly idiotic editors x day", order)
    want = []
    for g in asked:
        below = 1 / 256
        for n in range(1, order):
            below = shared[n].p(g[-n:], below)
        want.append(math.log(tops[1].p(g, below) / tops[0].p(g, below)))
    got = model.ratios(np.array([int.from_bytes(bytes(g), "big") for g in asked], np.uint64))
    assert np.allclose(got, want) and max(want) > 1 and min(want) < -1


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(k, "you idiot moron " * 3 + f"a{k}" if k % 2 else f"kind words for you {k}", "x", "y") for k in range(60)] + ODD_ROWS, SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (7, None), (8, 5)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, model_rows=20, fit_rows=10)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 67 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.score for r in got if (r.doc_id or 0) > 9 and r.doc_id % 2]) > np.mean([r.score for r in got if (r.doc_id or 1) > 9 and r.doc_id % 2 == 0])
    empty = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.5}
