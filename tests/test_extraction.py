import random

from pyspark.sql import functions as F

from quillstone.functions import constants as C
from quillstone.functions import text as T
from quillstone.operators import acquire, chunking, layout, pages, quality, sections


def _windows(spark, costs, target=1200, overlap=150):
    df = spark.createDataFrame([(d, p, c) for d, cs in costs.items() for p, c in enumerate(cs)], "doc int, pos long, cost long")
    out = {}
    for r in chunking.chunk_windows(df, target, overlap).orderBy("doc", "chunk").collect():
        out.setdefault(r.doc, []).append((r.first, r.past))
    return out


def test_worked_chunks(spark):
    got = _windows(spark, {1: [1300, 10, 10], 2: [600, 600, 100, 100, 1200], 3: [1100, 100, 40, 1200]})
    assert got == {1: [(0, 1), (1, 3)], 2: [(0, 2), (2, 5)], 3: [(0, 2), (1, 4)]}


def _loop(costs, target, overlap):
    """Window after window, as the rule says it."""
    out, at = [], 0
    while at < len(costs):
        past, total = at, 0
        while past < len(costs) and (total < target or past == at):
            total += costs[past]
            past += 1
        out.append((at, past))
        if past == len(costs):
            break
        back, tail = past, 0
        while back > at and tail + costs[back - 1] <= overlap:
            back -= 1
            tail += costs[back]
        at = max(at + 1, back)
    return out


def test_chunks_of_random_costs(spark):
    rng = random.Random(7)
    costs = {d: [rng.choice([1, 5, 20, 60, 150, 400]) for _ in range(rng.randint(1, 40))] for d in range(150)}
    assert _windows(spark, costs, 300, 90) == {d: _loop(c, 300, 90) for d, c in costs.items()}


def test_clean_and_preview(spark):
    df = spark.createDataFrame([("　a  \t b\n\n\n\nc \n",)], "t string")
    r = df.select(T.clean_text(F.col("t")).alias("c"), T.preview(F.col("t"), 3).alias("p")).first()
    assert r.c == "a b\n\nc" and r.p == "a b"


def test_headings_and_sections(spark):
    rows = ["第一节 公司治理", "2.1 财务摘要......12", "普通正文一行", "重要提示" + "长" * 30, "  ", "第二节"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [(r.h, r.s) for r in df.select(T.is_heading(F.col("t")).alias("h"), T.canonical_section(F.col("t")).alias("s")).collect()]
    assert [h for h, _ in got] == [True, True, False, False, False, True]
    assert got[0][1] == "公司治理" and got[1][1] == "公司简介与主要财务指标" and got[4][1] == "未识别"


def test_section_carries_over_pages_and_lone_chapter_marks(spark):
    rows = [(1, 1, 0, "第一节"), (1, 1, 1, "公司治理"), (1, 1, 2, "x"), (1, 2, 0, "y"), (1, 3, 0, "重要事项"), (1, 3, 1, "z")]
    df = spark.createDataFrame(rows, "doc int, page int, line int, text string")
    got = sections.line_sections(df, T.is_heading(F.col("text")), sections.chapter_title(F.col("title"))).orderBy("page", "line")
    assert [r.section for r in got.collect()] == ["公司治理"] * 4 + ["重要事项"] * 2


def test_bookmarks_as_of(spark):
    pages = spark.createDataFrame([("d", p) for p in range(1, 6)], "doc string, page int")
    marks = spark.createDataFrame(
        [("d", 1, "A", 2, 1), ("d", 3, "deep", 3, 2), ("d", 2, "B", 4, 3), ("d", 1, "2026年半年度报告", 5, 4)],
        "doc string, level int, title string, page int, ord int",
    )
    got = sections.bookmark_pages(pages, marks).orderBy("page").collect()
    assert [r.section for r in got] == ["未识别", "A", "A", "B", "B"]


def test_header_rows(spark):
    df = spark.createDataFrame([([["a", "b"], ["c", "1"], ["d", "1", "2"]],), ([["a"], ["b"]],)], "r array<array<string>>")
    assert [r.h for r in df.select(T.header_rows(F.col("r")).alias("h")).collect()] == [2, 0]


def test_clusters(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 3.0, 5.0, 20.0)], "grp int, v double")
    assert sorted(r.mean for r in layout.cluster_1d(df, 3.0).collect()) == [3.0, 20.0]
    one = spark.createDataFrame([([0.0, 3.0, 6.0],)], "v array<double>")
    assert one.select(layout.leaders(F.col("v"), 4.0).alias("s")).first().s == [0.0, 6.0]


def test_visual_lines(spark):
    rows = [("d", 1, 50.0, 10.0, "b"), ("d", 1, 5.0, 12.0, "a"), ("d", 1, 5.0, 20.0, "c")]
    got = layout.visual_lines(spark.createDataFrame(rows, "doc string, page int, x double, y double, text string")).orderBy("ord")
    assert [r.text for r in got.collect()] == ["a | b", "c"]


WORDS = "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string"


def _rebuilt(spark, pages):
    rows = [(d, 1, *map(float, w[:4]), w[4]) for d, words in pages.items() for w in words]
    return {r.doc: r.rows for r in layout.rebuild_tables(spark.createDataFrame(rows, WORDS)).collect()}


def test_rebuilt_table(spark):
    words = [(0, 0, 30, 8, "Net"), (60, 0, 90, 8, "1,200"), (120, 0, 150, 8, "3.5%"), (0, 20, 40, 28, "wrapped"), (0, 40, 30, 48, "label"), (65, 40, 91, 48, "7")]
    below = [*words, (0, 60, 30, 68, "below")]
    got = _rebuilt(spark, {"a": words, "b": [(0, 0, 5, 5, "x")], "c": below, "d": words[:3]})
    assert got["a"] == [["Net", "1,200", "3.5%"], ["wrappedlabel", "7", ""]]
    assert got["c"] == [["Net", "1,200", "3.5%"], ["wrappedlabelbelow", "7", ""]]
    assert got["b"] is None and got["d"] is None


def _expected(words):
    """Every word is marked with its row's seed and its column, then rows are read from the top."""
    ends = sorted(w[2] for w in words if w[4].isdigit())
    starts = [k for k, x in enumerate(ends) if not k or x - ends[k - 1] > C.COLUMN_TOLERANCE] + [len(ends)]
    means = [sum(ends[i:j]) / (j - i) for i, j in zip(starts, starts[1:])]
    seed, seeds = None, {}
    for cy in sorted((w[1] + w[3]) / 2 for w in words):
        seed = cy if seed is None or cy - seed > C.ROW_TOLERANCE else seed
        seeds[cy] = seed
    table = {}
    for x0, y0, x1, y1, text in sorted(words):
        near = [k + 1 for k, m in enumerate(means) if abs(m - x1) <= C.COLUMN_TOLERANCE]
        table.setdefault(seeds[(y0 + y1) / 2], {}).setdefault(near[0] if near else 0, []).append(text)
    out, label = [], ""
    for _, own in sorted(table.items()):
        label += " ".join(own.get(0, []))
        if set(own) - {0}:
            out.append([label, *(" ".join(own.get(k + 1, [])) for k in range(len(means)))])
            label = ""
    if label and out:
        out[-1][0] += label
    return out if len(out) > 1 else None


def test_rebuilt_tables_against_brute_force(spark):
    rng = random.Random(11)
    pages = {}
    for page in range(40):
        words = {}
        for y in range(rng.randint(1, 7)):
            top = 12 * y
            for x in range(rng.randint(1, 4)):
                left, drift = 70 * x, rng.choice([0, 1])
                number = x and rng.random() < 0.8
                words[left + drift, top + drift] = (left + drift, top + drift, left + 40 + drift, top + drift + 8, str(rng.randint(1, 99)) if number else f"w{rng.randint(1, 9)}")
        pages[f"p{page}"] = list(words.values())
    want = {d: _expected(w) for d, w in pages.items()}
    assert _rebuilt(spark, pages) == want and sum(v is not None for v in want.values()) > 20


def test_two_columns_by_the_middle_of_the_page(spark):
    sides = [(x, y) for x in (0.0, 300.0) for y in (0.0, 150.0, 300.0)]
    blocks = spark.createDataFrame([("d", p, x, y, x + 150, y + 20) for p in (1, 2, 3) for x, y in sides], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([("d", 1, 500.0), ("d", 2, 1000.0), ("d", 3, 500.0), ("d", 4, 500.0)], "doc string, page int, page_width double")
    tables = spark.createDataFrame([("d", 3, 290.0, -5.0, 460.0, 330.0)], blocks.schema)
    assert {r.page: r.multicol for r in layout.two_columns(blocks, pages, tables).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_elements_of_a_page(spark):
    texts = spark.createDataFrame([("d", 1, 0, 10.0, "intro\n 2.2 Debts "), ("d", 1, 1, 50.0, "after"), ("d", 1, 2, 30.0, "odd\nHalf-year report")], "doc string, page int, pos int, y double, text string")
    tables = spark.createDataFrame([("d", 1, 1, 20.0, [["1", "2"], [" ", ""], ["3", "4"]]), ("d", 1, 2, 90.0, [["a", "b"], ["c", "1", "2"]]), ("e", 1, 1, 5.0, [["1", "2"]])], "doc string, page int, table_id int, y double, rows array<array<string>>")
    found = pages.captions(pages.place_tables(texts, tables), "report$")
    assert [(r.doc, r.kind, r.table_id, r.caption) for r in found.orderBy("doc", "ord").collect()] == [
        ("d", "text", None, None), ("d", "table", 1, "2.2 Debts"), ("d", "text", None, None), ("d", "text", None, None), ("d", "table", 2, ""), ("e", "table", 1, ""),
    ]
    got = [(r.doc, r.ord, r.row_index, r.text, r.header, r.is_header) for r in pages.atoms(found).where("kind != 'text'").orderBy("doc", "ord", "row_index").collect()]
    assert got == [
        ("d", 1, 1, "1 | 2", "2.2 Debts", False), ("d", 1, 3, "3 | 4", "2.2 Debts", False),
        ("d", 4, 0, "a | b", "a | b", True), ("d", 4, 1, "c | 1 | 2", "a | b", False), ("e", 0, 1, "1 | 2", "", False),
    ]


def test_suspicious_and_median(spark):
    df = spark.createDataFrame([(0, None), (99, None), (100, None), (5, "bad")], "c int, e string")
    got = [r.r for r in df.select(quality.suspicious_reason(F.col("c"), F.col("e")).alias("r")).collect()]
    assert got == ["no text", "low text: 99 < 100", None, "bad"]
    assert quality.upper_median_of(spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int"), "v").first().median == 3


def test_titles_and_picks(spark):
    df = spark.createDataFrame([("2026年半年度报告",), ("2026年半年度报告摘要",), ("2025年半年度报告",)], "t string")
    assert [r.r for r in df.select(acquire.title_reason(F.col("t")).alias("r")).collect()] == [None, "摘要", "标题不含半年报关键词"]
    picks = spark.createDataFrame([("a", "2026-08-01", 10, 0), ("a", "2026-08-01", 20, 1), ("a", "2026-07-01", 99, 2)], "code string, date string, size int, ord int")
    assert acquire.pick_latest_largest(picks, "code", "date", "size", "ord").first()["size"] == 20


def test_citation(spark):
    r = spark.range(1).select(
        T.citation(F.lit("N"), F.lit("S"), F.lit(5), F.lit(5)).alias("a"), T.citation(F.lit("N"), F.lit("S"), F.lit(5), F.lit(6)).alias("b"),
        T.human_size(F.lit(2048)).alias("k"), T.human_size(F.lit(3 << 20)).alias("m"), T.epoch_ms_to_date(F.lit(1767196800000)).alias("d"),
    ).first()
    assert (r.a, r.b, r.k, r.m, r.d) == ("N · S · p5", "N · S · p5-6", "2 KB", "3.00 MB", "2026-01-01")
