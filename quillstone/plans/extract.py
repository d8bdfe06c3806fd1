"""Extraction, chunking, acquisition, quality and evaluation queries, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import constants as C
from quillstone.functions import text as T
from quillstone.operators import acquire, answering, chunking, layout, pages, quality, sections
from quillstone.sources import table
from quillstone.sources.shared import shared_dir
from quillstone.streaming import ingest

TARGET, OVERLAP = 1200, 150
KEYS = ["The", "Der", "La", "En"]
HEADING = r"^[^ ]+\.$"
PAGE_LINES = 20


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _atoms(spark, sf):
    return chunking.line_atoms(_docs(spark, sf))


def _windows(spark, sf):
    return chunking.chunk_windows(_atoms(spark, sf).select("doc", "pos", "cost"), TARGET, OVERLAP)


def _lines(spark, sf):
    rows = _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    return rows.select("doc", (F.floor(F.col("n") / PAGE_LINES) + 1).cast("int").alias("page"), F.col("n").alias("line"), "text")


def _heading() -> Column:
    """In the test data: a line of one word and a full stop."""
    return F.col("text").rlike(HEADING)


def chunk_windows(spark, sf):
    return _windows(spark, sf).select(F.col("doc").alias("doc_id"), "chunk", "first", "past")


def chunk_rows(spark, sf):
    rows = chunking.chunk_rows(_atoms(spark, sf), _windows(spark, sf))
    return rows.select("chunk_id", F.col("doc").alias("doc_id"), "page_start", "page_end", "has_table", "chars", F.sha1("text").alias("text_sha1"))


def chunk_overlap_stats(spark, sf):
    w = Window.partitionBy("doc").orderBy("chunk")
    rows = _windows(spark, sf).withColumn("shared", F.coalesce(F.lag("past").over(w) - F.col("first"), F.lit(0)))
    return rows.groupBy(F.col("doc").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("shared").alias("shared"), F.max(F.col("past") - F.col("first")).alias("longest")
    )


def chunk_table_header(spark, sf):
    """Chunks that begin within a table and so repeat its header."""
    rows = _windows(spark, sf).join(_atoms(spark, sf), "doc").where("pos = first and kind = 'table-row' and not is_header")
    return rows.select(F.col("doc").alias("doc_id"), "chunk", "table_id", F.sha1("header").alias("header_sha1"))


def clean_text(spark, sf):
    raw = F.concat(F.lit(" \t"), F.regexp_replace("text", "\\. ", ".  \t"), F.lit("\n\n\n\n　 x \n"))
    return _docs(spark, sf).select("doc_id", F.sha1(T.clean_text(raw)).alias("clean_sha1"), F.length(T.clean_text(raw)).alias("chars"))


def preview(spark, sf):
    return _docs(spark, sf).select("doc_id", T.preview(F.col("text")).alias("preview"))


def document_text(spark, sf):
    made = T.document_text(F.col("source"), F.col("lang"), F.col("text"))
    return _docs(spark, sf).select("doc_id", F.sha1(made).alias("text_sha1"), F.sha1(T.query_text(F.col("text"))).alias("query_sha1"))


def heading_flags(spark, sf):
    rows = _lines(spark, sf)
    return rows.where(T.is_heading(F.col("text"), KEYS, "^$")).select(F.col("doc").alias("doc_id"), "line", "text")


def section_ffill(spark, sf):
    named = F.regexp_replace("title", r"\.$", "")
    rows = sections.line_sections(_lines(spark, sf), _heading(), named, "NONE", "^$")
    return rows.select(F.col("doc").alias("doc_id"), "line", "section")


def toc_pages(spark, sf):
    rows = sections.contents_pages(_lines(spark, sf), _heading(), F.col("text").rlike(r"\.$"))
    return rows.select(F.col("doc").alias("doc_id"), "page", "n_headings", "n_leaders", "is_toc")


def section_counts(spark, sf):
    """Chunks per section of the line at which they begin."""
    rows = section_ffill(spark, sf)
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("doc_id").alias("docs"))


def asof_bookmark(spark, sf):
    """Every event's user takes the last purchase at or before it: pages are events, bookmarks purchases."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").withColumn("page", F.row_number().over(order)).withColumn("doc", F.col("user_id").cast("string"))
    marks = rows.where("event_type = 'purchase'").select(
        "doc", F.lit(1).alias("level"), F.col("event_id").cast("string").alias("title"), "page", F.lit(1).alias("ord")
    )
    found = sections.bookmark_pages(rows.select("doc", "page"), marks, "none")
    return found.select(F.col("doc").cast("long").alias("user_id"), "page", F.col("section").alias("last_purchase"))


def section_method(spark, sf):
    lines = section_ffill(spark, sf).select(F.col("doc_id").alias("doc"), "section")
    marks = _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.explode(F.array_repeat(F.col("lang"), 1)).alias("section"))
    return sections.section_method(lines, marks, "NONE").select(F.col("doc").alias("doc_id"), "n_line", "n_book", "method")


def cluster_1d(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("value").alias("v"))
    return layout.cluster_1d(rows, 3.0).select("grp", "cluster", F.round("mean", 6).alias("mean"), "size")


def leader_rows(spark, sf):
    """Seeds of leader clustering over each brand's ordered prices."""
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_retailprice")).alias("v"))
    return rows.select("p_brand", F.size(layout.leaders(F.col("v"), 4.0)).alias("seeds"))


def _tables(spark, sf):
    """Rows of cells: lines with bars, split."""
    rows = _lines(spark, sf).where(F.contains("text", F.lit("|")))
    cells = F.transform(F.split("text", r"\|", -1), lambda c: F.trim(c))
    return rows.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", cells.alias("cells")))), lambda r: r["cells"]).alias("rows"))


def render_table(spark, sf):
    rows = _tables(spark, sf)
    return rows.select(
        F.col("doc").alias("doc_id"), F.size("rows").alias("n_rows"), T.filled_cells(F.col("rows")).alias("filled"),
        F.sha1(T.render_table(F.col("rows"))).alias("table_sha1"),
    )


def split_header(spark, sf):
    """Each order's lines as a table of (flag, status, quantity, price) cells with a header before them; lines of one number and part stay as stored."""
    stored = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "_metadata.file_path", "_metadata.row_index", "l_returnflag", "l_linestatus", "l_quantity"
    )

    def cells(line: Column) -> Column:
        text = [line["l_returnflag"], line["l_linestatus"], line["l_quantity"].cast("int").cast("string"), line["l_linenumber"].cast("string")]
        return F.when(line["l_returnflag"] != "N", F.array(*text)).otherwise(F.array(*text[:3]))

    lines = F.sort_array(F.collect_list(F.struct(*stored.columns[1:])))
    rows = stored.groupBy("l_orderkey").agg(lines.alias("lines")).select("l_orderkey", F.transform("lines", cells).alias("rows"))
    return rows.select("l_orderkey", F.size("rows").alias("n_rows"), T.header_rows(F.col("rows")).alias("header_rows"))


def _boxes(spark, sf):
    p = table(spark, sf, "part")
    x, y = (F.col("p_partkey") % 50 * 10).cast("double"), (F.col("p_size") * 10).cast("double")
    return p.select(
        F.col("p_partkey").alias("id"), F.lit("d").alias("doc"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("page"),
        x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 8).alias("y1"), F.col("p_name").alias("text"),
    )


def anti_range_filter(spark, sf):
    boxes = _boxes(spark, sf)
    return layout.outside_boxes(boxes.where("id % 10 != 0"), boxes.where("id % 10 = 0").drop("id", "text")).select("id", "page")


def rotated_boxes(spark, sf):
    turned = layout.rotate((0.0, 1.0, -1.0, 0.0, 500.0, 0.0), "x0", "y0", "x1", "y1")
    return _boxes(spark, sf).select("id", *turned)


def two_columns(spark, sf):
    """Blocks in two halves; a page of 1,400 has all of them on its left."""
    boxes = _boxes(spark, sf)
    wide = boxes.where("id % 10 != 0").withColumn("x0", F.when(F.col("x0") < 250, 0.0).otherwise(400.0)).withColumn("x1", F.col("x0") + 150)
    pages = boxes.select("doc", "page").distinct().withColumn("page_width", F.when(F.col("page") % 3 == 0, 1400.0).otherwise(500.0))
    tables = boxes.where("id % 10 = 0 and id % 3 = 0").select("doc", "page", F.lit(300.0).alias("x0"), F.col("y0") - 60, F.lit(600.0).alias("x1"), F.col("y0") + 60)
    return layout.two_columns(wide, pages, tables.toDF("doc", "page", "x0", "y0", "x1", "y1")).select("page", "multicol")


def band_words(spark, sf):
    """Words between the edges of boxes, by box."""
    boxes = _boxes(spark, sf)
    frames = boxes.where("id % 40 = 0").select("doc", "page", F.col("id").alias("box"), "y0", (F.col("y1") + 15).alias("y1"))
    return layout.in_band(boxes, frames).select("box", "id", "page")


def _elements(spark, sf):
    rows = _boxes(spark, sf)
    texts = rows.where("id % 10 != 0").select("doc", "page", F.col("id").alias("pos"), F.col("y0").alias("y"), F.when(F.col("id") % 4 == 0, F.concat("text", F.lit("\n running title "))).otherwise(F.concat(F.lit("x\n"), "text")).alias("text"))
    number = F.col("id").cast("string")
    cells = F.when(F.col("id") % 3 == 0, F.array(F.array(F.lit("item"), F.lit("unit")), F.array(F.lit("a"), number, number), F.array(F.lit(" "), F.lit("")), F.array(F.lit("b"), number, number)))
    cells = cells.otherwise(F.array(F.array(F.lit("a"), number, number), F.array(F.lit("b"), number, number)))
    tables = rows.where("id % 10 = 0").select("doc", "page", F.col("id").alias("table_id"), F.col("y0").alias("y"), cells.alias("rows"))
    return pages.captions(pages.place_tables(texts, tables), "running title")


def page_elements(spark, sf):
    """Tables between the texts of their pages, with captions."""
    return _elements(spark, sf).select("page", "ord", "kind", "y", "table_id", F.sha1("text").alias("text_sha1"), "caption")


def page_atoms(spark, sf):
    """Texts, table headers and table rows of all pages."""
    found = pages.atoms(_elements(spark, sf))
    return found.select("page", "ord", "row_index", "kind", F.sha1("text").alias("text_sha1"), "table_id", F.sha1("header").alias("header_sha1"), "is_header")


def visual_lines(spark, sf):
    return layout.visual_lines(_boxes(spark, sf).select("doc", "page", F.col("x0").alias("x"), F.col("y0").alias("y"), "text")).select("page", "ord", "y", "text")


def rebuild_tables(spark, sf):
    words = _boxes(spark, sf).withColumn("text", F.when(F.col("x0") > 200, (F.col("id") % 997).cast("string")).otherwise(F.col("text")))
    found = layout.rebuild_tables(words.drop("id"))
    return found.select("page", F.size("rows").alias("n_rows"), F.sha1(T.render_table(F.col("rows"))).alias("table_sha1"))


def table_cascade(spark, sf):
    """Found and rebuilt tables arbitrated by coverage and filled cells."""
    rows = _tables(spark, sf).withColumn("found", F.transform("rows", lambda r: F.slice(r, 1, 2))).withColumnRenamed("rows", "rebuilt")
    rows = rows.withColumn("coverage", F.col("doc") % 10 / 10.0)
    return layout.arbitrate(rows).select(F.col("doc").alias("doc_id"), "method", T.filled_cells(F.col("rows")).alias("filled"))


def pick_latest_largest(spark, sf):
    return acquire.pick_latest_largest(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey").select(
        "o_custkey", "o_orderkey", "o_totalprice"
    )


def title_filter_reason(spark, sf):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    reason = acquire.title_reason(title, ["the", "de"], ["and", "que", "nicht"], "th", "no keyword")
    return table(spark, sf, "pages").select("page_id", reason.alias("skip_reason"))


def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha1(T.strip_tags(F.col("html"))).alias("text_sha1"))


def ts_to_date(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", T.epoch_ms_to_date(ms).alias("day"))


def manifest_upsert(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("size"))
    old, new = cust.where("code % 3 != 0"), cust.where("code % 2 = 0").withColumn("size", F.col("size") + 1000)
    catalog = cust.where("code < 500").select("code", (F.lit(1000) - F.col("code")).alias("ord"))
    return acquire.upsert_manifest(old, new, catalog).select("code", F.round("size", 2).alias("size"), "place")


def resolve_ids(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("org_id"), F.col("n_regionkey").alias("r"))
    found = nations.where("r != 2").withColumn("category", F.when(F.col("r") == 1, "B").otherwise("A股"))
    fixed = nations.select("code", F.concat(F.lit("fixed "), "org_id").alias("org_id"))
    return acquire.resolve_ids(nations.select("code"), found, fixed)


def unknown_codes(spark, sf):
    known = _docs(spark, sf).select(F.col("source").alias("code")).distinct()
    asked = spark.createDataFrame([("src1",), ("src19",), ("src77",)], "code string")
    picked, unknown = acquire.select_codes(known, asked)
    return picked.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


def report_overview(spark, sf):
    """Totals per source with a grand total."""
    rows = _docs(spark, sf).withColumn("lines", F.size(F.split("text", "\n", -1))).withColumn("tables", F.contains("text", F.lit("|")).cast("int"))
    out = rows.rollup("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n_chars") > 0).alias("with_text"), F.sum("n_chars").alias("chars"),
        F.sum("lines").alias("lines"), F.sum("tables").alias("with_tables"),
    )
    return out.withColumn("source", F.coalesce("source", F.lit("all")))


def method_pivot(spark, sf):
    kinds = ["en", "fr", "de", "es"]
    return _docs(spark, sf).groupBy("source").pivot("lang", kinds).count().fillna(0)


def suspicious_pages(spark, sf):
    pages = _lines(spark, sf).groupBy("doc", "page").agg(F.sum(F.length("text")).alias("chars"))
    reason = quality.suspicious_reason(F.col("chars"), F.when(F.col("doc") % 101 == 0, "unreadable"))
    return pages.withColumn("reason", reason).where("reason is not null").select(F.col("doc").alias("doc_id"), "page", "chars", "reason")


def length_median(spark, sf):
    docs = _docs(spark, sf)
    stats = docs.agg(F.max("n_chars").alias("longest"), F.count_if(F.col("n_chars") > 4096).alias("cut"), F.round(F.avg("n_chars"), 6).alias("mean"))
    return quality.upper_median_of(docs, "n_chars").join(F.broadcast(stats))


def corpus_fingerprint(spark, sf):
    rows = _docs(spark, sf).select(F.col("source").alias("grp"), F.col("doc_id").alias("pos"), "text")
    return quality.fingerprint(rows, "model").select(F.col("grp").alias("source"), "fingerprint")


def count_reconcile(spark, sf):
    counts = _docs(spark, sf).groupBy(F.col("source").alias("code")).agg(F.count(F.lit(1)).alias("pages"))
    manifest = counts.where("code != 'src3'").select("code", F.when(F.col("code") == "src5", F.lit(1).cast("long")).otherwise(F.col("pages")).alias("manifest_pages"))
    return quality.reconcile(counts, manifest)


def stratified_sample(spark, sf):
    strata = [F.contains("text", F.lit("|")), F.col("lang") == "es"]
    return quality.stratified_sample(_docs(spark, sf).select("doc_id", "lang", "text"), "doc_id", strata, 20).select("pick", "doc_id", "lang")


def context_window(spark, sf):
    return answering.keyword_windows(_docs(spark, sf).select("doc_id", "text"), ["thing", "nicht", "ción", "avec"], 20, 30, 5)


def point_lookup(spark, sf):
    rows = _docs(spark, sf).where("source = 'src7' and lang = 'en'").orderBy("doc_id").limit(1)
    return rows.select("doc_id", "n_chars")


def verdict_pivot(spark, sf):
    rows = table(spark, sf, "labels").select(
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("config"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("verdict")
    )
    return answering.verdict_table(rows, ["clean", "toxic"])


def resume_anti_join(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "text")
    done = docs.where("doc_id % 3 = 0").select("doc_id", F.substring(F.sha1(F.when(F.col("doc_id") % 9 == 0, F.lit("old")).otherwise(F.col("text"))), 1, 16).alias("fingerprint"))
    return ingest.changed(docs, done).select("doc_id", "fingerprint")


def stream_ingest(spark, sf):
    """Chunks made by a file stream; the same as those made in one batch."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = _docs(spark, sf)
    docs.repartition(4, "doc_id").write.mode("overwrite").parquet(f"{base}/in")
    ingest.stream_chunks(spark, f"{base}/in", docs.schema, f"{base}/out", f"{base}/state", TARGET, OVERLAP, 2)
    return spark.read.parquet(f"{base}/out").select(F.col("doc").alias("doc_id"), "chunk", "first", "past")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_windows, chunk_rows, chunk_overlap_stats, chunk_table_header, clean_text, preview, document_text, heading_flags, section_ffill,
        toc_pages, section_counts, asof_bookmark, section_method, cluster_1d, leader_rows, render_table, split_header, anti_range_filter,
        rotated_boxes, two_columns, band_words, page_elements, page_atoms, visual_lines, rebuild_tables, table_cascade, pick_latest_largest, title_filter_reason, strip_tags,
        ts_to_date, manifest_upsert, resolve_ids, unknown_codes, report_overview, method_pivot, suspicious_pages, length_median,
        corpus_fingerprint, count_reconcile, stratified_sample, context_window, point_lookup, verdict_pivot, resume_anti_join,
        stream_ingest,
    )
}

_ATOMS = """ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
atoms0 AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, line, length(line) AS cost, contains(line, '|') AS tr FROM ls WHERE line != ''
),
atoms1 AS (SELECT *, tr AND NOT coalesce(lag(tr) OVER (PARTITION BY doc_id ORDER BY pos), false) AS head FROM atoms0),
atoms AS (
  SELECT *, CASE WHEN tr THEN sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) END AS tid, sum(cost) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM atoms1
),
bounds AS (SELECT doc_id, pos + 1 AS k, p FROM atoms UNION ALL SELECT DISTINCT doc_id, 0, 0 FROM atoms),
last AS (SELECT doc_id, max(k) AS n FROM bounds GROUP BY doc_id),
ends AS (
  SELECT b.doc_id, b.k, coalesce(min(e.k), any_value(n)) AS e FROM bounds b JOIN last USING (doc_id)
  LEFT JOIN bounds e ON e.doc_id = b.doc_id AND e.p - b.p >= 1200 GROUP BY b.doc_id, b.k
),
backs AS (SELECT b.doc_id, b.k, min(c.k) AS c FROM bounds b JOIN bounds c ON c.doc_id = b.doc_id AND c.k <= b.k AND b.p - c.p <= 150 GROUP BY b.doc_id, b.k),
walk AS (
  SELECT e.doc_id, 1 AS chunk, e.k AS first, e.e AS past FROM ends e WHERE k = 0
  UNION ALL
  SELECT w.doc_id, w.chunk + 1, e.k, e.e FROM walk w JOIN last USING (doc_id) JOIN backs b ON b.doc_id = w.doc_id AND b.k = w.past
  JOIN ends e ON e.doc_id = w.doc_id AND e.k = greatest(w.first + 1, b.c) WHERE w.past < n
)"""

_LINES = f"lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents), paged AS (SELECT *, (line // {PAGE_LINES} + 1)::INT AS page, regexp_matches(t, '{HEADING}') AS h FROM lines), toc AS (SELECT doc_id, page, count(*) FILTER (WHERE h) AS nh, count(*) FILTER (WHERE regexp_matches(t, '\\.$')) AS nl, count(*) FILTER (WHERE regexp_matches(t, '[.·…]{{3,}}')) AS nd FROM paged GROUP BY ALL), sectioned AS (SELECT doc_id, line, coalesce(last_value(CASE WHEN h AND nh < 4 AND nd < 4 THEN regexp_replace(t, '\\.$', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line), 'NONE') AS section FROM paged JOIN toc USING (doc_id, page))"
_TABLES = """tabs AS (
  SELECT doc_id, list(list_transform(string_split(line, '|'), lambda c: trim(c)) ORDER BY n) AS rws
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)
  WHERE contains(line, '|') GROUP BY doc_id
)"""
_BOXES = r"""boxes AS (
  SELECT p_partkey AS id, regexp_extract(p_brand, '(\d+)', 1)::INT AS page, (p_partkey % 50 * 10)::DOUBLE AS x0, (p_size * 10)::DOUBLE AS y0,
    (p_partkey % 50 * 10 + 30)::DOUBLE AS x1, (p_size * 10 + 8)::DOUBLE AS y1, p_name AS text FROM part
)"""
_ELEMENTS = """texts AS (
  SELECT page, id AS pos, y0 AS y, CASE WHEN id % 4 = 0 THEN text || chr(10) || ' running title ' ELSE 'x' || chr(10) || text END AS t,
    CASE WHEN id % 4 = 0 THEN 'running title' ELSE text END AS line FROM boxes WHERE id % 10 != 0
),
tables AS (
  SELECT b.page, b.id AS table_id, b.y0 AS y, min(x.pos) AS slot, CASE WHEN b.id % 3 = 0
    THEN 'item | unit' || chr(10) || 'a | ' || b.id || ' | ' || b.id || chr(10) || '  | ' || chr(10) || 'b | ' || b.id || ' | ' || b.id
    ELSE 'a | ' || b.id || ' | ' || b.id || chr(10) || 'b | ' || b.id || ' | ' || b.id END AS t
  FROM boxes b LEFT JOIN texts x ON x.page = b.page AND x.y > b.y0 WHERE b.id % 10 = 0 GROUP BY ALL
),
every AS (
  SELECT page, pos AS slot, 1 AS later, 'text' AS kind, y, NULL AS table_id, t, line FROM texts
  UNION ALL SELECT page, coalesce(slot, 1000000000), 0, 'table', y, table_id, t, NULL FROM tables
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY slot, later, y, table_id) - 1 AS n FROM every),
elements AS (
  SELECT page, n::INT AS ord, kind, y, table_id, t,
    CASE WHEN kind = 'table' THEN replace(coalesce(last_value(line IGNORE NULLS) OVER (PARTITION BY page ORDER BY n), ''), 'running title', '') END AS caption FROM ranked
)"""
_UNION_SPACE = r"[\s\x{00A0}\x{3000}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{001C}-\x{001F}]"
_RAW = r"' ' || chr(9) || regexp_replace(text, '\. ', '.  ' || chr(9), 'g') || repeat(chr(10), 4) || '　' || chr(160) || 'x ' || chr(10)"
_CLEAN = rf"""regexp_replace(regexp_replace(regexp_replace(replace(replace({_RAW}, '　', ' '), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'),
  '^{_UNION_SPACE}+|{_UNION_SPACE}+$', '', 'g')"""

ORACLES = {
    "chunk_windows": f"WITH RECURSIVE {_ATOMS} SELECT doc_id, chunk, first, past FROM walk",
    "chunk_rows": f"""WITH RECURSIVE {_ATOMS},
inside AS (
  SELECT w.doc_id, chunk, a.*, first_value(a0.line) OVER (PARTITION BY w.doc_id, chunk, a.pos) AS header,
    row_number() OVER (PARTITION BY w.doc_id, chunk, a.tid ORDER BY a.pos) AS nth
  FROM walk w JOIN atoms a ON a.doc_id = w.doc_id AND a.pos >= first AND a.pos < past
  LEFT JOIN atoms a0 ON a0.doc_id = a.doc_id AND a0.tid = a.tid AND a0.head
),
texts AS (
  SELECT doc_id, chunk, (min(pos) // 20 + 1)::INT AS page_start, (max(pos) // 20 + 1)::INT AS page_end, bool_or(tr) AS has_table,
    string_agg(CASE WHEN tr AND nth = 1 AND NOT head AND trim(header) != '' THEN '[表头] ' || header || chr(10) || line ELSE line END, chr(10) ORDER BY pos)
      FILTER (WHERE trim(line) != '') AS t
  FROM inside GROUP BY doc_id, chunk
)
SELECT doc_id || '_' || CASE WHEN chunk < 10000 THEN lpad(chunk::VARCHAR, 4, '0') ELSE chunk::VARCHAR END AS chunk_id, doc_id, page_start, page_end, has_table,
  length(coalesce(t, ''))::INT AS chars, sha1(coalesce(t, '')) AS text_sha1 FROM texts""",
    "chunk_overlap_stats": f"""WITH RECURSIVE {_ATOMS},
s AS (SELECT *, coalesce(lag(past) OVER (PARTITION BY doc_id ORDER BY chunk) - first, 0) AS sh FROM walk)
SELECT doc_id, count(*) AS chunks, sum(sh)::BIGINT AS shared, max(past - first) AS longest FROM s GROUP BY doc_id""",
    "chunk_table_header": f"""WITH RECURSIVE {_ATOMS}
SELECT w.doc_id, chunk, a.tid::BIGINT AS table_id, sha1(h.line) AS header_sha1 FROM walk w JOIN atoms a ON a.doc_id = w.doc_id AND a.pos = first AND tr AND NOT head
JOIN atoms h ON h.doc_id = a.doc_id AND h.tid = a.tid AND h.head""",
    "clean_text": f"SELECT doc_id, sha1({_CLEAN}) AS clean_sha1, length({_CLEAN})::INT AS chars FROM documents",
    "preview": rf"SELECT doc_id, left(regexp_replace(regexp_replace(text, '{_UNION_SPACE}+', ' ', 'g'), '^ | $', '', 'g'), 100) AS preview FROM documents",
    "document_text": """SELECT doc_id, sha1('《' || source || '2026年半年度报告 · ' || lang || '》' || chr(10) || text) AS text_sha1,
sha1('为这个句子生成表示以用于检索相关文章：' || text) AS query_sha1 FROM documents""",
    "heading_flags": rf"""WITH {_LINES}, s AS (SELECT *, regexp_replace(t, '^{_UNION_SPACE}+|{_UNION_SPACE}+$', '', 'g') AS b FROM lines),
f AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(b, '[.·…]{{3,}}') THEN regexp_replace(b, '[.·…]+\s*\d*\s*$', '') ELSE b END,
  '{_UNION_SPACE}+', '', 'g'), '^\d+(?:[.\-、]\d+)*[.、]?', ''), '^\|+', '') AS flat FROM s)
SELECT doc_id, line::INT AS line, t AS text FROM f WHERE length(b) BETWEEN 1 AND 30 AND length(flat) BETWEEN 1 AND 30
AND ({" OR ".join(f"starts_with(flat, '{k}')" for k in KEYS)})""",
    "section_ffill": f"WITH {_LINES} SELECT doc_id, line::INT AS line, section FROM sectioned",
    "toc_pages": f"WITH {_LINES} SELECT doc_id, page, nh AS n_headings, nl AS n_leaders, nh >= 4 OR nl >= 4 AS is_toc FROM toc",
    "section_counts": f"WITH {_LINES} SELECT section, count(*) AS lines, count(DISTINCT doc_id) AS docs FROM sectioned GROUP BY section",
    "asof_bookmark": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page FROM events)
SELECT user_id, page::INT AS page, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY page), 'none') AS last_purchase FROM e""",
    "section_method": f"""WITH {_LINES}, c AS (SELECT doc_id, count(DISTINCT section) FILTER (WHERE section != 'NONE') AS n_line FROM sectioned GROUP BY doc_id)
SELECT doc_id, n_line, 1::BIGINT AS n_book, CASE WHEN n_line >= 3 THEN 'headings' ELSE 'none' END AS method FROM c""",
    "cluster_1d": """WITH g AS (SELECT user_id AS grp, value AS v, coalesce((value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 3)::INT, 0) AS gap FROM events),
c AS (SELECT grp, v, sum(gap) OVER (PARTITION BY grp ORDER BY v ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g)
SELECT grp, cluster, round(avg(v), 6) AS mean, count(*) AS size FROM c GROUP BY ALL""",
    "leader_rows": """WITH RECURSIVE s AS (
  SELECT p_brand, min(p_retailprice) AS v, 1 AS k FROM part GROUP BY p_brand
  UNION ALL SELECT n.p_brand, n.v, n.k FROM (SELECT s.p_brand, min(p_retailprice) AS v, any_value(k) + 1 AS k FROM s JOIN part p ON p.p_brand = s.p_brand AND p_retailprice > s.v + 4 GROUP BY s.p_brand) n
)
SELECT p_brand, max(k)::INT AS seeds FROM s GROUP BY p_brand""",
    "visual_lines": f"""WITH RECURSIVE {_BOXES}, s AS (
  SELECT page, min(y0) AS y FROM boxes GROUP BY page
  UNION ALL SELECT n.page, n.y FROM (SELECT s.page, min(y0) AS y FROM s JOIN boxes b ON b.page = s.page AND b.y0 > s.y + {C.ROW_TOLERANCE} GROUP BY s.page) n
),
l AS (SELECT b.*, (SELECT max(s.y) FROM s WHERE s.page = b.page AND s.y <= b.y0) AS y FROM boxes b)
SELECT page, (row_number() OVER (PARTITION BY page ORDER BY y) - 1)::INT AS ord, y, string_agg(text, ' | ' ORDER BY x0, y0, text) AS text FROM l GROUP BY page, y""",
    "render_table": f"""WITH {_TABLES} SELECT doc_id, len(rws)::INT AS n_rows, len(list_filter(flatten(rws), lambda c: c != ''))::INT AS filled,
sha1(array_to_string(list_transform(rws, lambda r: array_to_string(r, ' | ')), chr(10))) AS table_sha1 FROM tabs""",
    "split_header": """WITH t AS (SELECT l_orderkey, list(l_returnflag != 'N' ORDER BY l_linenumber, l_partkey) AS numeric FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(numeric)::INT AS n_rows, greatest(coalesce(list_position(numeric, true), 0) - 1, 0)::INT AS header_rows FROM t""",
    "anti_range_filter": f"""WITH {_BOXES} SELECT id, page FROM boxes b WHERE id % 10 != 0 AND NOT EXISTS (
SELECT 1 FROM boxes t WHERE t.id % 10 = 0 AND t.page = b.page AND (b.x0 + b.x1) / 2 BETWEEN t.x0 - 1 AND t.x1 + 1 AND (b.y0 + b.y1) / 2 BETWEEN t.y0 - 1 AND t.y1 + 1)""",
    "rotated_boxes": f"WITH {_BOXES} SELECT id, 500 - y1 AS x0, x0 AS y0, 500 - y0 AS x1, x1 AS y1 FROM boxes",
    "two_columns": f"""WITH {_BOXES}, t AS (SELECT page, y0 FROM boxes WHERE id % 10 = 0 AND id % 3 = 0),
w AS (SELECT page, CASE WHEN x0 < 250 THEN 0 ELSE 400 END AS x0, y0, y1, CASE WHEN page % 3 = 0 THEN 700 ELSE 250 END AS mid FROM boxes b WHERE id % 10 != 0
  AND NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND CASE WHEN b.x0 < 250 THEN 75 ELSE 475 END BETWEEN 299 AND 601 AND (b.y0 + b.y1) / 2 BETWEEN t.y0 - 61 AND t.y0 + 61)),
s AS (SELECT page, count(*) AS n, count(*) FILTER (WHERE x0 + 75 < mid) AS nl, max(y1) FILTER (WHERE x0 + 75 < mid) - min(y0) FILTER (WHERE x0 + 75 < mid) AS lh,
  max(y1) FILTER (WHERE x0 + 75 >= mid) - min(y0) FILTER (WHERE x0 + 75 >= mid) AS rh FROM w GROUP BY page)
SELECT page, coalesce(n >= 4 AND nl > 0 AND nl < n AND lh > 200 AND rh > 200, false) AS multicol FROM (SELECT DISTINCT page FROM boxes) LEFT JOIN s USING (page)""",
    "band_words": f"""WITH {_BOXES} SELECT f.id AS box, b.id, b.page FROM boxes b JOIN boxes f ON f.page = b.page AND f.id % 40 = 0 AND b.y0 >= f.y0 - 2 AND b.y1 <= f.y1 + 17""",
    "page_elements": f"""WITH {_BOXES}, {_ELEMENTS} SELECT page, ord, kind, y, table_id, sha1(t) AS text_sha1, caption FROM elements""",
    "page_atoms": f"""WITH {_BOXES}, {_ELEMENTS}, parts AS (
  SELECT page, ord, 0 AS row_index, 'text' AS kind, t, NULL AS table_id, NULL AS header, NULL AS is_header FROM elements WHERE kind = 'text'
  UNION ALL SELECT page, ord, 0, 'table-row', 'item | unit', table_id, 'item | unit', true FROM elements WHERE table_id % 3 = 0
  UNION ALL SELECT page, ord, k, 'table-row', x || ' | ' || table_id || ' | ' || table_id, table_id, CASE WHEN table_id % 3 = 0 THEN 'item | unit' ELSE caption END, false
    FROM elements, (VALUES ('a', 1), ('b', 3)) v(x, k) WHERE table_id % 3 = 0
  UNION ALL SELECT page, ord, k, 'table-row', x || ' | ' || table_id || ' | ' || table_id, table_id, caption, false
    FROM elements, (VALUES ('a', 1), ('b', 2)) v(x, k) WHERE table_id % 3 != 0
)
SELECT page, ord, row_index, kind, sha1(t) AS text_sha1, table_id, sha1(header) AS header_sha1, is_header FROM parts""",
    "table_cascade": f"""WITH {_TABLES}, f AS (SELECT doc_id, rws, list_transform(rws, lambda r: r[1:2]) AS found FROM tabs),
g AS (SELECT *, len(list_filter(flatten(rws), lambda c: c != '')) AS nr, len(list_filter(flatten(found), lambda c: c != '')) AS nf FROM f)
SELECT doc_id, CASE WHEN doc_id % 10 / 10.0 >= 0.55 THEN 'grid' WHEN nr > nf THEN 'rebuilt' ELSE 'grid-narrow' END AS method,
(CASE WHEN doc_id % 10 / 10.0 < 0.55 AND nr > nf THEN nr ELSE nf END)::INT AS filled FROM g WHERE list_max(list_transform(found, lambda r: len(r))) >= 2""",
    "pick_latest_largest": """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) = 1""",
    "title_filter_reason": """WITH t AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS t FROM pages),
b AS (SELECT *, CASE WHEN contains(t, 'and') THEN 'and' WHEN contains(t, 'que') THEN 'que' WHEN contains(t, 'nicht') THEN 'nicht' END AS bad FROM t)
SELECT page_id, CASE WHEN (contains(t, 'the') OR contains(t, 'de')) AND contains(t, 'th') AND bad IS NULL THEN NULL ELSE coalesce(bad, 'no keyword') END AS skip_reason FROM b""",
    "strip_tags": rf"SELECT page_id, sha1(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), '^{_UNION_SPACE}+|{_UNION_SPACE}+$', '', 'g')) AS text_sha1 FROM pages",
    "ts_to_date": "SELECT event_id, strftime(to_timestamp(epoch_ms(ts) / 1000.0) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR, '%Y-%m-%d') AS day FROM events",
    "manifest_upsert": """WITH c AS (SELECT c_custkey AS code, c_acctbal AS size FROM customer), n AS (SELECT code, size + 1000 AS size FROM c WHERE code % 2 = 0),
m AS (SELECT * FROM c WHERE code % 3 != 0 AND code % 2 != 0 UNION ALL SELECT * FROM n)
SELECT code, round(size, 2) AS size, row_number() OVER (ORDER BY CASE WHEN code < 500 THEN 1000 - code END ASC NULLS LAST, code)::INT AS place FROM m""",
    "resolve_ids": "SELECT n_nationkey::VARCHAR AS code, CASE WHEN n_regionkey NOT IN (1, 2) THEN n_name ELSE 'fixed ' || n_name END AS org_id FROM nation",
    "unknown_codes": "SELECT c AS code, EXISTS (SELECT 1 FROM documents WHERE source = c) AS known FROM (SELECT unnest(['src1', 'src19', 'src77']) AS c)",
    "report_overview": """SELECT coalesce(source, 'all') AS source, count(*) AS docs, count(*) FILTER (WHERE n_chars > 0) AS with_text, sum(n_chars)::BIGINT AS chars,
sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(contains(text, '|')::INT)::BIGINT AS with_tables FROM documents GROUP BY ROLLUP (source)""",
    "method_pivot": "SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in ("en", "fr", "de", "es")) + " FROM documents GROUP BY source",
    "suspicious_pages": f"""WITH {_LINES}, c AS (SELECT doc_id, page, sum(length(t))::BIGINT AS chars FROM paged GROUP BY ALL),
r AS (SELECT *, CASE WHEN doc_id % 101 = 0 THEN 'unreadable' WHEN chars = 0 THEN 'no text' WHEN chars < 100 THEN 'low text: ' || chars || ' < 100' END AS reason FROM c)
SELECT doc_id, page, chars, reason FROM r WHERE reason IS NOT NULL""",
    "length_median": """SELECT list_sort(list(n_chars))[count(*) // 2 + 1] AS median, max(n_chars) AS longest, count(*) FILTER (WHERE n_chars > 4096) AS cut,
round(avg(n_chars), 6) AS mean FROM documents""",
    "corpus_fingerprint": "SELECT source, left(sha1('model' || string_agg(text, '' ORDER BY doc_id)), 16) AS fingerprint FROM documents GROUP BY source",
    "count_reconcile": """WITH c AS (SELECT source AS code, count(*) AS pages FROM documents GROUP BY source),
m AS (SELECT *, CASE WHEN code = 'src3' THEN NULL WHEN code = 'src5' THEN 1 ELSE pages END AS manifest_pages FROM c)
SELECT code, pages, manifest_pages, coalesce(pages = manifest_pages, false) AS ok FROM m""",
    "stratified_sample": """WITH d AS (SELECT doc_id, lang, contains(text, '|') AS a, lang = 'es' AS b, sha1('20260630:' || doc_id) AS draw FROM documents),
p AS (SELECT *, draw = (SELECT min(draw) FROM d WHERE a) AS first FROM d),
q AS (SELECT *, CASE WHEN first THEN 0 WHEN draw = (SELECT min(draw) FROM p WHERE b AND NOT first) THEN 1 ELSE 2 END AS level FROM p),
r AS (SELECT row_number() OVER (ORDER BY level, draw)::INT AS pick, doc_id, lang FROM q)
SELECT * FROM r WHERE pick <= 20""",
    "context_window": """WITH k AS (SELECT unnest(['thing', 'nicht', 'ción', 'avec']) AS keyword),
f AS (SELECT keyword, doc_id, text, instr(text, keyword) AS spot, row_number() OVER (PARTITION BY keyword ORDER BY doc_id) AS n FROM documents JOIN k ON contains(text, keyword))
SELECT keyword, n::INT AS n, doc_id, substring(text, greatest(spot - 20, 1), spot - greatest(spot - 20, 1) + length(keyword) + 30) AS context FROM f WHERE n <= 5""",
    "point_lookup": "SELECT doc_id, n_chars FROM documents WHERE source = 'src7' AND lang = 'en' ORDER BY doc_id LIMIT 1",
    "verdict_pivot": "SELECT 'q' || quality AS config, count(*) FILTER (WHERE toxic != 1) AS clean, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels GROUP BY quality",
    "resume_anti_join": "SELECT doc_id, left(sha1(text), 16) AS fingerprint FROM documents WHERE doc_id % 3 != 0 OR doc_id % 9 = 0",
    "stream_ingest": f"WITH RECURSIVE {_ATOMS} SELECT doc_id, chunk, first, past FROM walk",
}
