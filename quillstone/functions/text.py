"""Column functions on text: tokens, cleaning, headings, sections, formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import constants as C

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SPACE = r"[\s\x{00A0}\x{3000}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{001C}-\x{001F}]"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, and every other visible character by itself; case and marks stay."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def clean_text(text: Column, variants: tuple[str, str] = ("", "")) -> Column:
    """Variant characters mapped, wide blanks and runs of blanks to one, three newlines or more to two, ends stripped."""
    mapped = F.translate(text, variants[0] + "　 ", variants[1] + "  ")
    return strip(F.regexp_replace(F.regexp_replace(mapped, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def preview(text: Column, chars: int = 100) -> Column:
    """White space made single blanks, then a prefix."""
    return F.substring(strip(F.regexp_replace(text, f"{SPACE}+", " ")), 1, chars)


def strip_tags(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", ""))


def document_text(name: Column, section: Column, text: Column, label: str = C.DOC_LABEL) -> Column:
    return F.concat(F.lit("《"), name, F.lit(f"{label} · "), section, F.lit("》\n"), text)


def query_text(question: Column, task: str = C.QUERY_TASK) -> Column:
    return F.concat(F.lit(task), question)


def pages_label(first: Column, last: Column) -> Column:
    one = F.concat(F.lit("p"), first.cast("string"))
    return F.when(first == last, one).otherwise(F.concat(one, F.lit("-"), last.cast("string")))


def citation(name: Column, section: Column, first: Column, last: Column) -> Column:
    return F.concat_ws(" · ", name, section, pages_label(first, last))


def human_size(size: Column) -> Column:
    mega = 1024 * 1024
    return F.when(size >= mega, F.format_string("%.2f MB", size / mega)).otherwise(F.format_string("%.0f KB", size / 1024))


def epoch_ms_to_date(ms: Column, offset: str = "+08:00") -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), offset), "yyyy-MM-dd")


def _flat(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", ""), r"^\|+", "")


def canonical_section(raw: Column, rules: list[tuple[str, list[str]]] = C.SECTION_RULES, unknown: str = C.UNKNOWN_SECTION) -> Column:
    """The first rule one of whose keywords occurs, white space apart; else the title itself."""
    flat, out = _flat(raw), None
    for name, words in rules:
        hit = reduce(lambda a, b: a | b, (F.contains(flat, F.lit(w)) for w in words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    bare = strip(F.regexp_replace(strip(raw), r"^\|+", ""))
    bare = F.when(bare == "", F.lit(unknown)).otherwise(bare)
    return bare if out is None else out.otherwise(bare)


def is_heading(line: Column, keys: list[str] | None = None, chapter: str = C.CHAPTER, limit: int = C.HEADING_CHARS) -> Column:
    """A short line that is a chapter mark, or begins with a section keyword once numbers and leaders are gone."""
    keys = [w for _, words in C.SECTION_RULES for w in words] if keys is None else keys
    s = strip(line)
    bare = F.when(s.rlike(C.DOT_LEADER), F.regexp_replace(s, C.DOT_LEADER_TAIL, "")).otherwise(s)
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, f"{SPACE}+", ""), C.TITLE_NUMBER, ""), r"^\|+", "")
    begins = reduce(lambda a, b: a | b, (flat.startswith(k) for k in keys)) if keys else F.lit(False)
    return (F.length(s) > 0) & (F.length(s) <= limit) & (s.rlike(chapter) | ((F.length(flat) > 0) & (F.length(flat) <= limit) & begins))


def numeric_cell(cell: Column) -> Column:
    return strip(cell).rlike(C.NUMERIC_CELL)


def render_table(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def filled_cells(rows: Column) -> Column:
    return F.size(F.filter(F.flatten(rows), lambda c: strip(c) != ""))


def header_rows(rows: Column) -> Column:
    """How many rows stand before the first with two numeric cells or more; 0 if there is none."""
    numeric = F.transform(rows, lambda r: F.size(F.filter(r, numeric_cell)) >= 2)
    return F.greatest(F.array_position(numeric, F.lit(True)).cast("int") - 1, F.lit(0))
