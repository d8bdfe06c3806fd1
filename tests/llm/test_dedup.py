import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.llm import stars
from quillstone.llm import textblocks as tb
from quillstone.llm.components import components
from quillstone.llm.line_dedup import bucket_keys, deduplicate_lines, least_of_bins
from quillstone.llm.near_dedup import borrow_order, near_duplicates, signature
from quillstone.llm.scratch import Scratch
from quillstone.llm.substring_dedup import remove_repeated_windows, sliding_least

SCHEMA = "doc_id long, text string, n_kept string, id string"
ODD_ROWS = [(None, "a b c d", "x", "y"), (1, None, "x", "y"), (2, "", "x", "y"), (3, " \n\t ", "x", "y"), (4, "one", "x", "y"), (4, "one", "x", "y"), (5, "one", None, None)]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_words_of_blocks():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \n\té\u0085\x1c") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "x" * 5000]
    seen = {}
    for limit in (40, 1 << 20):
        at_all = []
        for at, to, found in tb.blocks(pa.array(texts), tb.BLANK_WORDS, fold=True, limit=limit):
            for d in range(to - at):
                at_all.append(found.hash[found.first[d] : found.first[d + 1]].tolist())
        for text, got in zip(texts, at_all):
            want = words_of((text or "").translate(LOW))
            assert len(want) == len(got)
            for w, h in zip(want, got):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_large_blocks_are_scanned_in_parts(monkeypatch):
    texts = pa.array([f"word{k} other {k % 7}" for k in range(400)])
    whole = [w for _, _, w in tb.blocks(texts, tb.BLANK_WORDS, False, limit=1 << 20)][0]
    data, offsets = tb.flat(texts)
    cuts = list(tb.slices(offsets, 100))
    monkeypatch.setattr(tb.slices, "__defaults__", (100,))
    parts = tb.scan(data, offsets, tb.BLANK_WORDS, False)
    assert len(cuts) > 3
    for name in ("start", "end", "hash", "first"):
        assert (getattr(whole, name) == getattr(parts, name)).all()


def test_sliding_least():
    x = np.random.default_rng(0).integers(0, 100, 50)
    for w in (1, 2, 3, 7, 11):
        assert (sliding_least(x, w) == [x[i : i + w].min() for i in range(50 - w + 1)]).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    order, same = borrow_order(252), []
    for size in (4, 40, 2000):
        for _ in range(20):
            base = rng.integers(0, 2**63, size).astype(np.uint64)
            other = np.append(base[: int(size * 8 / 9 + 0.5)], rng.integers(0, 2**63, max(1, size // 9)).astype(np.uint64))
            a, b = np.unique(base), np.unique(other)
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            same.append((signature(a, 252, order) == signature(b, 252, order)).mean() - j)
    assert abs(np.mean(same)) < 0.03


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(1000, 1000 + k) for k in range(200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def _jaccard_components(docs, words):
    sets = {}
    for i, text in docs:
        w = words_of((text or "").translate(LOW))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= 80 * len(x | y) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    docs = []
    for base in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60]))]
        for copy in range(8):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(own)))
    docs += [(len(docs), None), (len(docs) + 1, "  "), (len(docs) + 2, "solo"), (len(docs) + 3, "SOLO")]
    want = _jaccard_components(docs, 2)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_copies_of_odd_rows(spark):
    df = spark.createDataFrame(ODD_ROWS, SCHEMA)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, words=2).collect())
    assert got == sorted([("None", 3, None, True), ("1", 0, 1, True), ("2", 0, 2, True), ("3", 0, 3, True), ("4", 1, 4, True), ("4", 1, 4, True), ("5", 1, 4, False)])
    assert near_duplicates(df.limit(0)).count() == 0


def _removed(docs, width):
    starts, words = {}, {i: words_of(t) for i, t in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            starts.setdefault(tuple(words[i][k : k + width]), (i, k))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if starts[tuple(w[k : k + width])] != (i, k):
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_windows_against_brute_force(spark):
    rng = random.Random(9)
    passages = [[rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(4, 30))] for _ in range(12)]
    docs = [(i, " ".join(x for _ in range(rng.randint(0, 6)) for x in rng.choice(passages))) for i in range(80)]
    docs += [(80, "same " * 40), (81, None), (82, "é " * 9), (83, "Tab\tand\nline " * 3)]
    got = remove_repeated_windows(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), width=8, with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == _removed(docs, 8)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_repeated_windows_of_odd_rows(spark):
    rows = [*ODD_ROWS, (None, "a b c d", "x", "y"), (6, "a b c d", "x", "y"), (6, "a b c d", "x", "y"), (7, "a b c d", "x", "y")]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in remove_repeated_windows(spark.createDataFrame(rows, SCHEMA), width=2).collect())
    assert got == sorted([
        ("None", 4, 0), ("None", 4, 0), ("1", 0, 0), ("2", 0, 0), ("3", 0, 0), ("4", 1, 0), ("4", 1, 0), ("5", 1, 0), ("6", 4, 0), ("6", 4, 0), ("7", 4, 4),
    ])
    assert remove_repeated_windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines(spark):
    line = " ".join(f"word{k}" for k in range(30))
    near = line.replace("word29", "other")
    rows = [(2, f"{line}\nkeep me\n\nkeep me", "x", "y"), (1, f"{near}\r\n own words here ", "x", "y"), (None, line, "x", "y"), (3, None, "x", "y"), (4, "", "x", "y"), (5, line, "x", "y")]
    got = {r.doc_id: r for r in deduplicate_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].text, got[1].n_lines, got[1].n_kept) == (f"{near}\r\n own words here ", 2, 2)
    assert (got[2].text, got[2].n_lines, got[2].n_kept) == ("keep me\n", 4, 2)
    assert got[3].text is None and got[3].n_lines == 0 and got[4].text == "" and got[5].text == "" and got[5].n_kept == 0
    assert got[None].text == line and got[1].id == "y"
    assert deduplicate_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def _kept_lines(spark, lines):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    return {r.doc_id for r in deduplicate_lines(df).collect() if r.n_kept}


def test_lines_without_spaces_and_with_long_words(spark):
    rng = random.Random(4)
    chinese = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(90))
    word = "".join(rng.choice("abcdefghij") for _ in range(90))
    lines = [
        "https://www.example.com/a/report", "https://www.example.com/minutes",  # the same beginning, other texts
        chinese, chinese[:12] + chinese[:11:-1], "x" + chinese,  # another end; a near copy with another beginning
        f"see {word}", f"see {word[:40]}{word[:39:-1]}", f"see {word}.",
        "col1value_aaaaaa\tx\ty", "col1value_aaaaaa\tp\tq", "id\t1\tname\tred", "id\t1\tname\tblue", "\U0001f600" * 20 + "a", "short", "shore",
    ]
    assert _kept_lines(spark, lines) == set(range(len(lines))) - {4, 7}


def _line_groups(lines):
    """The first line of each component of pairs at 0.8 or more on the shingles of whole lines."""
    sets = [{x[k : k + 12] for k in range(max(1, len(x) - 11))} for x in lines]
    comp = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    return set(comp)


def test_lines_near_the_threshold_against_brute_force(spark):
    rng = random.Random(8)
    lines = []
    for _ in range(50):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 6, 25]))) for _ in range(rng.choice([4, 15, 40]))]
        lines.append(" ".join(words))
        # Changes of one long or many short words move the two kinds of sets by different shares.
        for _ in range(3):
            own = list(words)
            for _ in range(rng.randint(1, max(1, len(own) // 8))):
                own[rng.randrange(len(own))] = "".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 25])))
            lines.append(" ".join(own))
    assert _kept_lines(spark, lines) == _line_groups(lines)


def test_bands_find_close_lines(spark):
    # (shared, only in one, only in the other): a pair at 0.8 is missed with a probability of some 5e-4.
    rng, rows = random.Random(2), []
    for case, (both, one, other) in enumerate([(4, 1, 0), (8, 1, 1), (9, 1, 0), (80, 10, 10)]):
        for k in range(4000):
            x = [rng.randrange(-(2**63), 2**63) for _ in range(both + one + other)]
            rows += [(case, k, "x", x[: both + one]), (case, k, "y", x[:both] + x[both + one :])]
    df = spark.createDataFrame(rows, "case int, k int, side string, own array<long>").select("case", "k", "side", F.explode("own").alias("h"))
    df = df.withColumn("bin", F.pmod("h", F.lit(16))).groupBy("case", "k", "side").agg(*least_of_bins(16))
    df = df.select("case", "k", "side", bucket_keys(8, 2).alias("keys")).groupBy("case", "k").pivot("side", ["x", "y"]).agg(F.first("keys"))
    missed = {r["case"]: r.n for r in df.groupBy("case").agg(F.count_if(~F.arrays_overlap("x", "y")).alias("n")).collect()}
    assert missed[0] < 8 and missed[1] < 8 and missed[2] < 3 and missed[3] < 8


def test_bands_and_sets_do_not_stay_on_disk(spark, monkeypatch):
    plans, there, real, save = [], [], stars._sketches, Scratch.save
    monkeypatch.setattr(stars, "_sketches", lambda own: plans.append(own._jdf.queryExecution().optimizedPlan().toString()) or real(own))
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: (save(self, df, name), there.append((name, [p.rsplit("/", 1)[1].split("-")[1:] for p in self.paths])))[0])
    line = "the quick brown fox jumps over the lazy dog, then over the sleeping cat and over the tired old horse, and then number {} comes"
    docs = [(k, line.format(k % 7), "", "") for k in range(9)] + [(10, "alone in its class", "", ""), (11, "alone in its class", "", ""), (12, "single", "", "")]
    got = {r.doc_id: r.n_kept for r in deduplicate_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {0: 1, **dict.fromkeys(range(1, 9), 0), 10: 1, 11: 0, 12: 1}
    # The bands of all classes go before pairs are met, and sets are not shuffled for their sketches.
    assert ["line", "classes"] in dict(there)["line-keys"] and ["line", "classes"] not in [x[-2:] for x in dict(there)["sketches"]]
    assert plans and not any("Repartition" in p for p in plans)


def test_long_documents_lose_lines_in_linear_time(spark):
    # Templates share most shingles and are not alike: each line stays, and copies of the whole document go.
    text = "\n".join(f"line number {k * 7919} has the text of {k * 104729} others" for k in range(3000))
    got = deduplicate_lines(spark.createDataFrame([(1, text), (2, text), (2, "other\n" + text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_kept, r.text) for r in got) == [(1, 3000, 3000, text), (2, 3000, 0, ""), (2, 3001, 1, "other")]


def test_columns_of_any_name(spark):
    names = ["a.b", "__gone", "__id", "gone", "row", "no", "line", "component", "n_lines", "x`y", "k1"]
    df = spark.createDataFrame([(1, "one line\none line")], "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    got = deduplicate_lines(df)
    assert got.columns == ["doc_id", "text", *(n for n in names if n != "n_lines"), "n_lines", "n_kept"]
    r = got.first()
    assert r.text == "one line" and (r.n_lines, r.n_kept) == (2, 1) and all(r[n] == n for n in names if n != "n_lines")
    assert near_duplicates(df).count() == 1


def test_line_dedup_is_native(spark):
    df = deduplicate_lines(spark.createDataFrame([(1, "a b\na b")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
