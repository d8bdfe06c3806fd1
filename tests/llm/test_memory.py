"""What a worker holds at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quillstone.llm import language, packing
from quillstone.llm import substring_dedup as S
from quillstone.llm import textblocks as tb
from quillstone.llm.shards import squeeze


def test_kept_words_are_put_together_in_parts(monkeypatch):
    monkeypatch.setattr(S.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    texts = [" ".join(f"w{d}x{k}" for k in range(9000)) for d in range(40)]
    texts[1] = " ".join(texts[0].split()[:3000])
    (block,) = S._encoder(iter([pa.record_batch({"id": pa.array(range(40), pa.int64()), "text": texts})]))
    own = S._Block(block.to_pylist()[0], 20)
    _, repeated = own.anchors()
    own.candidates(repeated, 20)
    said = [pa.array([[{"shard": 0, "said": squeeze(x.astype(np.uint8))}]]) for x in (repeated, np.zeros(len(own.head)))]
    del own
    batch = pa.record_batch([*block.columns, *said], names=[*block.schema.names, "anchors", "windows"])
    tracemalloc.start()
    (got,) = S._remover(20, False)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column("n_removed").to_pylist() == [0, 3000, *[0] * 38]
    size = sum(map(len, texts))
    assert size > 3_000_000 and peak < 24 * size


def test_a_worker_keeps_for_one_kind_of_task():
    batch = pa.record_batch({"text": ["some words of a text"], "lang": ["en"]})
    cut = packing._cutter(packing.tokenizer_path(), 1, 4096, False)
    rows = pa.record_batch({"id": [1], "text": ["some words of a text"]})
    list(tb.blocks(batch.column("text"), tb.BLANK_WORDS, fold=True))
    assert len(tb._BYTES.up) > 1
    (before,) = cut(iter([rows]))
    assert packing._ENCODERS and len(tb._BYTES.up) == 1
    list(language._count_grams(iter([batch])))
    assert not packing._ENCODERS
    assert list(cut(iter([rows])))[0].equals(before) and packing._ENCODERS
    words = [w.hash.tolist() for *_, w in tb.blocks(batch.column("text"), tb.BLANK_WORDS, fold=True)]
    assert not packing._ENCODERS and len(words[0]) == 5


def test_texts_are_judged_in_small_blocks():
    texts = pa.array(["the house and the garden " * 800] * 60 + ["das Haus und der Garten " * 60_000])
    found = {x: np.unique(language.grams(*tb.flat(pa.array([t])))[0]) for x, t in (("en", texts[0].as_py()), ("de", texts[60].as_py()))}
    model = language.LanguageFilter.build(found, {"en": 2, "de": 1})
    tracemalloc.start()
    got = language._judge(texts[:60], model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(texts[0].as_py()) == 20_000 and peak < 16_000_000
    assert got[0].to_pylist() == ["en"] * 60 and set(got[1].to_pylist()) == {1.0}
    long, score = language._judge(texts[59:], model)
    assert long.to_pylist() == ["en", "de"] and score.to_pylist() == [1.0, 1.0]


def test_the_drivers_rows_need_no_worker(spark, monkeypatch):
    """Rows handed over as a list are dealt with by Python workers of another kind, which then stay beside the others."""
    docs = spark.range(40).selectExpr("id as doc_id", "if(id % 2 = 0, 'the house and a dog', 'das Haus und ein Hund') as text", "if(id % 2 = 0, 'en', 'de') as lang")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    model = language.train(docs)
    assert sorted(model.languages) == ["de", "en"]
    got = {(r.doc_id, r.lang_pred) for r in language.predict(docs, model).collect()}
    assert got == {(k, "de" if k % 2 else "en") for k in range(40)}
    assert packing.pack(docs, packing.tokenizer_path()).count() == 40
    assert packing.pack(docs.limit(0), packing.tokenizer_path()).count() == 0
