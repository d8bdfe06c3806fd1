import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import media, packing, registry
from quillstone.llm.chat import format_chats
from quillstone.llm.decontaminate import contamination
from test_dedup import ODD_ROWS, SCHEMA

PATH = packing.tokenizer_path()


def test_chat_snapshots(spark):
    turns = lambda c, texts: [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    rows = turns(1, "ab") + turns(2, "abc") + turns(3, "abc") + turns(4, "abd") + turns(5, "b") + turns(6, ["a", None]) + turns(7, ["a", ""])
    rows += [(2, 0, "user", "a"), (None, 0, "user", "z"), (8, None, None, None), (9, 2000, "user", "x"), (9, 5000, "user", "y"), (10, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1))
    for block in (1024, 2):
        got = defaultdict(list)
        for r in format_chats(df, block_turns=block).orderBy("conv_id", "part").collect():
            got[r.conv_id].append((r.n_turns, r.n_equal, r.chat))
        assert set(got) == {2, 4, 5, 6, 7, 8, 9}
        assert got[2][0][:2] == (3, 2) and got[9][0][0] == 2
        assert "".join(c for *_, c in got[2]) == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert format_chats(df.limit(0)).count() == 0


def test_token_ids_by_stretches():
    import random

    rng = random.Random(3)
    alphabet = "aBcsTt'.,!-_ \n<|>é́Σσ½日\u0085\x1c0 9Èe"
    words, whole = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    for k in range(150):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(5)] + ["It's DON'T, we'LL."] + ["<|endoftext|>a"] * (k % 2)
        data, offsets = packing.tb.flat(pa.array(texts))
        raw, own = packing.stretched(data, offsets)
        got = words.encode([raw[a:b] for a, b in zip(own[:-1].tolist(), own[1:].tolist())])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_stretches_of_letters_go_to_the_model():
    whole = Tokenizer.from_file(PATH)
    letters = [chr(k) for k in range(256) if chr(k).isalpha() and k not in (170, 181, 186)]
    texts = ["".join(letters[a : a + 9]) for a in range(len(letters))] + [x + y for x in letters for y in (".", "-", "'s", "\u00d7", "\u00f7", "1", "")]
    data, offsets = packing.tb.flat(pa.array(texts))
    raw, own = packing.stretched(data, offsets)
    words = packing.WordIds(PATH)
    got = words.encode([raw[a:b] for a, b in zip(own[:-1].tolist(), own[1:].tolist())])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    # The steps before the model cost more than the model: they are for other stretches only.
    words = packing.WordIds(PATH)
    words.tokenizer = None
    raw, _ = packing.stretched(*packing.tb.flat(pa.array(["Una PALABRA \u00c9t\u00e9, gr\u00f6\u00dfe"]))[:2])
    assert raw.split() == "una palabra \u00e9t\u00e9 , gr\u00f6\u00dfe".encode().split()
    got = np.frombuffer(words.encode([raw.replace(b",", b"")])[0], "<u4").tolist()
    assert got == whole.encode("una palabra \u00e9t\u00e9 gr\u00f6\u00dfe", add_special_tokens=False).ids


def test_packing_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 9000), (None, "x"), (-4, "y"), (-4, "y")], "doc_id long, text string"))
    got = packing.pack(docs, PATH, with_ids=True, rank_rows=20).collect()
    whole = Tokenizer.from_file(PATH)
    parts, places = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 <= 4096 and r.ids_crc32 == zlib.crc32(r.ids)
        parts[r.doc_id].append((r.start, r.piece, bytes(r.ids)))
        places[r.sequence_id].append((r.offset, r.length))
    for r in docs.collect():
        if r.doc_id is not None and r.doc_id != -4:
            own = sorted(parts[r.doc_id])
            ids = np.frombuffer(b"".join(x for *_, x in own), "<u4").tolist()
            assert ids == whole.encode(r.text or "", add_special_tokens=False).ids + [1]
            assert [(s, p) for s, p, _ in own] == [(4096 * k, k) for k in range(len(own))]
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 4096) + 1
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_plans_use_every_piece_once():
    rng = np.random.default_rng(1)
    for quantum in (8, 16, 64):
        histogram = np.zeros(4097, np.int64)
        np.add.at(histogram, np.minimum(rng.lognormal(6.5, 1, 20_000).astype(int) + 1, 4096), 1)
        plan = packing.plan_packing(histogram, 4096, quantum)
        assert (plan.used == histogram).all()
        assert plan.sequences <= 1.002 * (histogram * np.arange(4097)).sum() / 4096 + 1


def test_contamination_in_blocks(spark):
    docs = spark.createDataFrame(
        [*ODD_ROWS, (6, "x Alpha beta-gamma DELTA e f g h i j k z", "", ""), (7, "alpha beta gamma delta e f g h i j", "", ""), (8, "one two one", "", "")], SCHEMA
    )
    items = spark.createDataFrame([(1, "alpha beta gamma delta e f g h i j k"), (2, "ONE"), (3, None), (None, "two"), (10, "g h"), (2, "one"), (4, "!!")], "item_id long, text string")
    want = None
    for block in (200_000, 1):
        got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in contamination(docs, items, block_windows=block).collect()}
        assert got[(6, 13)] == (11, 2, "1,10", True) and got[(7, 10)] == (10, 2, "1,10", True) and got[(8, 3)] == (2, 1, "2", True)
        assert got[(4, 1)] == (1, 1, "2", True) and got[(1, 0)] == (0, 0, "", False) and got[(None, 4)][0] == 0
        want = want or got
        assert got == want
    assert contamination(docs, items.limit(0)).where("contaminated").count() == 0 and contamination(docs.limit(0), items).count() == 0


def test_wav_round_trip_and_tensors(spark):
    got = {r.doc_id: r for r in media.audio_features(spark.createDataFrame([*ODD_ROWS, (9, "long text " * 5000, "", "")], SCHEMA)).collect()}
    assert got[1].n_bytes == 0 and bytes(got[1].payload) == b" " * 192 and got[2].tensors == got[1].tensors
    r = got[9]
    rate, payload = media.decode_wav(bytes(r.media))
    assert payload == bytes(r.payload) and payload.rstrip() == ("long text " * 5000).rstrip().encode() and len(payload) % 192 == 0 and len(r.media) == 44 + len(payload)
    table = pa.ipc.open_stream(bytes(r.tensors)).read_all()
    assert table.column("log_mel").type.shape == [32, 40] and table.num_rows == -(-r.frames // 32)
    assert table.column("end_ms")[-1].as_py() == 10 * r.frames and all(s.end_ms > s.start_ms for s in r.segments)
    assert media.audio_features(spark.createDataFrame([], SCHEMA)).count() == 0


def _frames(payload, spec):
    """Log-mel energies by the definitions: direct convolution, one discrete Fourier sum a frame."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
    h = media._lowpass(spec.up, spec.down, spec.taps).astype(np.float64)
    half = len(h) // 2
    y = np.array([sum(x[m] * h[k * spec.down - m + half] for m in range(max(0, k * spec.down - half), min(len(x), k * spec.down + half + 1))) for k in range(-(-len(x) // spec.down))])
    n = max(1, 1 + -(-(len(y) - spec.frame) // spec.hop))
    y = np.concatenate((y, np.zeros(max(0, (n - 1) * spec.hop + spec.frame - len(y)))))
    wave = np.exp(-2j * np.pi * np.outer(np.arange(spec.fft // 2 + 1), np.arange(spec.frame)) / spec.fft)
    top = 2595 * np.log10(1 + spec.rate * spec.up / spec.down / 2 / 700)
    edge = [700 * (10 ** (top * k / (spec.mels + 1) / 2595) - 1) / (spec.rate * spec.up / spec.down) * spec.fft for k in range(spec.mels + 2)]
    out = []
    for f in range(n):
        power = np.abs(wave @ (y[f * spec.hop : f * spec.hop + spec.frame] * np.hanning(spec.frame))) ** 2
        bands = [
            sum(p * max(0.0, min((k - edge[m]) / (edge[m + 1] - edge[m]), (edge[m + 2] - k) / (edge[m + 2] - edge[m + 1]))) for k, p in enumerate(power))
            for m in range(spec.mels)
        ]
        out.append(np.log(np.array(bands) + 1e-6))
    return np.array(out)


def test_audio_query_against_brute_force(spark, tmp_path):
    texts = [None, "", "plain words " * 20, "é" * 96, "ends in é", "日本語" * 70, "\U0001f600" * 48, "a" * 192, "b" * 191, "ü" + "c" * 190, "plain words " * 20]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.op10_audio_features(spark, str(tmp_path)).collect()}
    own = {r.doc_id: r for r in media.audio_features(df).collect()}
    spec = media.AudioSpec()
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        stored = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt " + b"".join(
            v.to_bytes(n, "little") for v, n in ((16, 4), (1, 2), (1, 2), (16000, 4), (16000, 4), (1, 2), (8, 2))
        ) + b"data" + len(payload).to_bytes(4, "little") + payload
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        table = pa.ipc.open_stream(bytes(own[k].tensors)).read_all()
        mel = np.concatenate([x.reshape(-1, 40) for x in table.column("log_mel").combine_chunks().to_numpy_ndarray()])[: own[k].frames]
        want = _frames(payload, spec)
        assert mel.shape == want.shape and np.abs(mel - want).max() < 0.02
        assert r.feature == f"{own[k].frames}:{len(own[k].segments)}:{hashlib.sha256(bytes(own[k].tensors)).hexdigest()}"
    assert got[2].feature == got[10].feature and got[0].feature == got[1].feature


def test_resampling_against_direct_sums():
    rng = np.random.default_rng(2)
    x = rng.normal(size=77).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3), (1, 1)):
        h = media._lowpass(up, down, 8)
        half = len(h) // 2
        want = [sum(x[m] * h[k * down - m * up + half] for m in range(len(x)) if abs(k * down - m * up) <= half) for k in range(-(-77 * up // down))]
        assert np.allclose(media.resample(x, up, down, 8), want, atol=1e-5)


def test_hysteresis():
    energy = np.array([0, 0, 5, 2.4, 5, 0, 0, 0.0])
    assert media.segments(energy, 1.0, -0.5) == [(2, 5)]
