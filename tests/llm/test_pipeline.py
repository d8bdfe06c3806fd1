import re
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from quillstone.llm import registry

SF = "/root/testdata/sf0.001"


def _sets(rows, parts):
    return {k: {tuple(p) for p in parts(t)} for k, t in rows}


def _groups(sets):
    """Least member of each component of pairs at 0.8 or more."""
    comp = {k: k for k in sets}
    holds = defaultdict(list)
    for k in sorted(sets):
        for g in sets[k]:
            holds[g].append(k)
    pairs = {(a, b) for own in holds.values() for a in own for b in own if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


def _line_shingles(line):
    return {line[k : k + 12] for k in range(max(1, len(line) - 11))}


def test_stages_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    places = [((i, n), line) for i, t in docs.items() for n, line in enumerate(t.split("\n")) if line.strip(" \t\r")]
    first = {}
    for p, line in sorted(places):
        first.setdefault(line, p)
    comp = _groups({p: _line_shingles(line) for line, p in first.items()})
    gone = {p for p, line in places if comp[first[line]] != p}
    kept = {}
    for i, t in docs.items():
        lines = t.split("\n")
        left = [x for n, x in enumerate(lines) if (i, n) not in gone]
        text = "\n".join(left)
        if left and (len(left) == len(lines) or text.strip(" \t\r\n")):
            kept[i] = text
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: re.findall("[^\x20\x09-\x0d]+", t.translate(low)) for i, t in kept.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for i, w in words.items()}
    comp = _groups(sets)
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    alnum = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(low))
    windows = set()
    for t in items:
        w = alnum(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def dirty(text):
        w = alnum(text)
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    kept = {i for i, t in kept.items() if not dirty(t)}
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == kept
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert used.where("n > 4096").count() == 0


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    names = ["lang_pred", "score", "items", "n_hit", "__text", "id", "node", "component", "kept", "a b"]
    docs = docs.withColumns({n: F.lit(n) for n in names}).unionByName(docs.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema)), True)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        assert rows, name
        if name != "packing":
            assert {r["a b"] for r in rows} == {"a b"} and {r["score"] for r in rows} == {"score"}
            docs = spark.createDataFrame(rows, docs.schema)


def test_op_names():
    assert [f"op{n}_" for n in range(1, 11)] == [re.match(r"op\d+_", n)[0] for n in sorted(registry.queries(), key=lambda n: int(re.search(r"\d+", n)[0]))]
