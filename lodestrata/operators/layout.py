"""Characters and lines of page layouts: visible characters, lines, paragraphs, tables.

``chars``: file, page, seq, text, x, y (of the middle), top, size, bold, shade (0 black to 1 white).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["file", "page"]
#: Points that a character may lie below the first of its line, least size, shade from which it counts as white.
TOLERANCE, LEAST_SIZE, WHITE = 5.0, 6.0, 0.95
#: Sections of a block; points of an empty stretch between columns; share of rows that start a word at a column.
SECTIONS, GAP, ALIGNED = 10_000, 15.0, 0.6
# Shapes of headings.
HEADINGS = r"^\d+\.\s|^[가-힣]\.\s|^\(\d+\)|^제\s*\d+\s*[조장절]|^[■□◆◇○●▶]|^\[[^\]]+\]$"


def outside(chars: DataFrame, boxes: DataFrame) -> DataFrame:
    """Characters whose point lies in no box (file, page, x0, top0, x1, bottom1) of their page."""
    b = boxes.select(F.col("file").alias("_f"), F.col("page").alias("_p"), "x0", "top0", "x1", "bottom1")
    inside = (F.col("file") == F.col("_f")) & (F.col("page") == F.col("_p")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("top0"), F.col("bottom1"))
    return chars.join(b, inside, "left_anti")


def visible(chars: DataFrame) -> DataFrame:
    """Characters but for blank, tiny and near-white ones; tiny is below six points or 0.8 of the page's least size."""
    least = F.min(F.when(F.trim("text") != "", F.col("size"))).over(Window.partitionBy(*PAGE))
    limit = F.greatest(F.lit(LEAST_SIZE), least * 0.8)
    return chars.withColumn("_limit", limit).where((F.trim("text") != "") & (F.col("size") >= F.col("_limit")) & (F.col("shade") < WHITE)).drop("_limit")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds line_no to characters in the order of file, page and top; a line goes on over the end of a batch. Only changes of top are walked."""
    last, number, anchor = None, -1, 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch[c].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in PAGE]
        tops = batch["top"].to_numpy(zero_copy_only=False)
        new = np.concatenate([[tuple(batch[c][0].as_py() for c in PAGE) != last], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        at = np.flatnonzero(new | np.concatenate([[True], tops[1:] != tops[:-1]]))
        numbers = []
        for begins, top in zip(new[at].tolist(), tops[at].tolist(), strict=True):
            if begins or abs(top - anchor) > TOLERANCE:
                number, anchor = 0 if begins else number + 1, top
            numbers.append(number)
        last = tuple(batch[c][batch.num_rows - 1].as_py() for c in PAGE)
        line_no = np.repeat(np.array(numbers, "int32"), np.diff(np.append(at, batch.num_rows)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(line_no)], [*batch.schema.names, "line_no"])


def lines(chars: DataFrame) -> DataFrame:
    """Lines of each page: a character joins while it lies within five points of the line's first; bold if half of it is."""
    kinds = {c: chars.schema[c].dataType.simpleString() for c in (*PAGE, "seq", "text")}
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)  # noqa: E731  a missing place comes last
    placed = chars.select(*PAGE, "seq", "text", number("x"), number("top"), F.col("bold").cast("double").alias("bold"))
    dealt = placed.repartition(*PAGE).sortWithinPartitions(*PAGE, "top", "x", "seq")
    numbered = dealt.mapInArrow(_numbered, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", x double, top double, bold double, line_no int")
    there = lambda c: F.when(~F.isnan(c), F.col(c))
    found = numbered.groupBy(*PAGE, "line_no").agg(
        F.array_sort(F.collect_list(F.struct("x", "seq", "text"))).alias("_chars"), F.min_by("top", F.when(~F.isnan("top"), F.struct("x", "seq"))).alias("top"), F.avg(there("x")).alias("x"), F.coalesce(F.avg("bold") >= 0.5, F.lit(False)).alias("is_bold")
    )
    return found.select(*PAGE, "line_no", F.array_join(F.transform("_chars", lambda c: c["text"]), "").alias("text"), "top", "x", "is_bold")


def is_heading(text: Column) -> Column:
    return F.trim(text).rlike(HEADINGS)


def paragraphs(found: DataFrame) -> DataFrame:
    """Lines of a page joined into paragraphs; a blank line or a heading starts a new one."""
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    blank = F.trim("text") == ""
    breaks = F.when(blank | is_heading(F.col("text")), 1).otherwise(0)
    after = F.coalesce(F.lag(F.when(blank | is_heading(F.col("text")), 1).otherwise(0)).over(order), F.lit(0))
    marked = found.withColumn("_break", F.greatest(breaks, after)).withColumn("paragraph_no", F.sum("_break").over(order))
    joined = marked.where(~blank).groupBy(*PAGE, "paragraph_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_l"))
    return joined.select(*PAGE, "paragraph_no", F.array_join(F.transform("_l", lambda x: x["text"]), " ").alias("text"))


def table_score(cells: Column) -> Column:
    """Quality of ``array<array<string>>``: 30 structure, 40 filled cells, 20 numbers, 10 even rows."""
    flat = F.flatten(cells)
    filled = F.filter(flat, lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    share = lambda a, b: F.coalesce(F.try_divide(F.size(a).cast("double"), F.size(b)), F.lit(0.0))
    structure = F.when((F.size(cells) >= 2) & (F.size(F.get(cells, F.lit(0))) >= 2), 30.0).otherwise(0.0)
    even = F.when(F.size(F.array_distinct(F.transform(cells, lambda r: F.size(r)))) == 1, 10.0).otherwise(0.0)
    return structure + share(filled, flat) * 40 + share(F.filter(filled, lambda c: c.rlike("[0-9]")), filled) * 20 + even


def best_tables(candidates: DataFrame) -> DataFrame:
    """Of the candidates (file, page, strategy, table_no, cells) the strategy of the greatest score on each page, then distinct tables."""
    scored = candidates.withColumn("score", table_score(F.col("cells")))
    page = Window.partitionBy(*PAGE)
    totals = scored.withColumn("_total", F.sum("score").over(page.orderBy("strategy").rangeBetween(Window.currentRow, Window.currentRow)))
    best = totals.withColumn("_best", F.max(F.struct("_total", "strategy")).over(page)["strategy"]).where("strategy = _best").drop("_total", "_best")
    text = F.md5(F.array_join(F.transform("cells", lambda r: F.array_join(r, "\x1f", "")), "\x1e"))
    kept = best.withColumn("_text", text)
    rank = F.row_number().over(Window.partitionBy("file", "_text").orderBy("page", "table_no"))
    return kept.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_text")


def cell_text(cell_lines: Column) -> Column:
    """One line as it is, up to three joined, more as the first and an ellipsis."""
    n = F.size(cell_lines)
    return F.when(n <= 3, F.array_join(cell_lines, " ")).otherwise(F.concat(F.get(cell_lines, F.lit(0)), F.lit("...")))


def grouped_sections(sections: DataFrame, small: int = 100, block: int = SECTIONS) -> DataFrame:
    """Neighbouring sections (file, no, title, content) that are small or share their title with the one before become one.

    A group is titled by the large section before, or the file's first one, since a large section that goes on
    with a group has its title. So a section starts a group if it is large and differs from the last large
    one's title: a running value, which blocks of ``block`` numbers hand on as one row each. ``no`` is distinct in a file.
    """
    held = sections.select("file", "no", "title", "content").withColumn("_block", F.floor(F.col("no") / block)).withColumn("_large", F.length("content") >= small)
    blocks = held.groupBy("file", "_block").agg(F.min("no").alias("_least"), F.min_by(F.struct("title"), "no").alias("_head"), F.max_by(F.struct("title"), F.when(F.col("_large"), F.col("no"))).alias("_last"))
    order = Window.partitionBy("file").orderBy("_block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_first", F.row_number().over(order) == 1).withColumn("_last", F.coalesce("_last", F.when(F.col("_first"), F.col("_head"))))
    carried = blocks.select(F.col("file").alias("_f"), F.col("_block").alias("_b"), "_first", "_least", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    rows = held.join(carried, F.col("file").eqNullSafe(F.col("_f")) & F.col("_block").eqNullSafe(F.col("_b"))).drop("_f", "_b")
    within = Window.partitionBy("file", "_block").orderBy("no")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    heads = F.col("_first") & (F.col("no") == F.col("_least"))
    anchor = F.when(F.col("_large") | heads, F.struct("title"))
    last = F.coalesce(F.last(anchor, ignorenulls=True).over(before), F.col("_carried"))
    marked = rows.withColumn("_prior", last).withColumn("_starts", heads | (F.col("_large") & ~F.col("_prior.title").eqNullSafe(F.col("title"))))
    starts = marked.groupBy("file", "_block").agg(F.max(F.when(F.col("_starts"), F.col("no"))).alias("_start"))
    behind = starts.select(F.col("file").alias("_f"), F.col("_block").alias("_b"), F.max("_start").over(earlier).alias("_open"))
    placed = marked.join(behind, F.col("file").eqNullSafe(F.col("_f")) & F.col("_block").eqNullSafe(F.col("_b")))
    group = F.coalesce(F.max(F.when(F.col("_starts"), F.col("no"))).over(within.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open"))
    each = placed.select("file", "no", "title", "content", group.alias("_group"))
    joined = each.groupBy("file", "_group").agg(F.min_by("title", "no").alias("title"), F.array_sort(F.collect_list(F.struct("no", "content"))).alias("_parts"))
    return joined.select("file", F.col("_group").alias("no"), "title", F.array_join(F.transform("_parts", lambda x: F.coalesce(x["content"], F.lit(""))), "\n").alias("content"))


def _page_tables(lines: np.ndarray, x: np.ndarray, wide: np.ndarray, text: list[str], gap: float, share: float) -> Iterator[tuple[str, int, list[str]]]:
    """Strategy, columns and cells, row by row, of the candidates of one page, whose words are in the order of line, x and seq.

    Rows are the page's lines. "gaps" puts a column's end where a histogram of the page's width has an empty stretch of ``gap``
    or more; "aligned" starts one where at least ``share`` of the rows have a word.
    """
    left, right = x.round(3), (x + wide).round(3)
    ends, reach = [], None
    there = ~np.isnan(left + right)
    for a, b in sorted(set(zip(left[there].tolist(), right[there].tolist(), strict=True))):
        if reach is not None and a - reach >= gap:
            ends.append((reach + a) / 2)
        reach = b if reach is None else max(reach, b)
    row = np.cumsum(np.concatenate([[0], lines[1:] != lines[:-1]]))
    n = int(row[-1]) + 1
    starts, which = np.unique(left, return_inverse=True)
    held = np.bincount(np.unique(which * n + row) // n, minlength=len(starts))
    for strategy, cuts in (("gaps", ends), ("aligned", (starts[(held >= share * n) & ~np.isnan(starts)] - 1e-6)[1:])):
        columns = len(cuts) + 1
        cell = row * columns + np.searchsorted(cuts, x, "right")
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist()
        cells = [""] * (n * columns)
        for a, b, at in zip(first, [*first[1:], len(text)], cell[first].tolist(), strict=True):
            cells[at] = " ".join(text[a:b])
        yield strategy, columns, cells


def _tables(batches: Iterator[pa.RecordBatch], gap: float, share: float) -> Iterator[pa.RecordBatch]:
    """Candidates of the pages of words sorted by page; the last page of a batch may go on in the next."""
    names, pages = ["file", "page", "strategy", "table_no", "cells"], pa.list_(pa.list_(pa.string()))

    def made(words: pa.Table) -> pa.RecordBatch:
        words = words.combine_chunks()
        lines, x, wide = (words[c].to_numpy() for c in ("line_no", "x", "width"))
        text, at, found, out = words["text"].to_pylist(), _starts(words), [], [[0], [0], []]
        for k, (a, b) in enumerate(zip(at, [*at[1:], words.num_rows], strict=True)):
            for strategy, columns, cells in _page_tables(lines[a:b], x[a:b], wide[a:b], text[a:b], gap, share):
                found.append((at[k], strategy))
                out[2] += cells
                out[1] += range(out[1][-1] + columns, out[1][-1] + len(cells) + 1, columns)
                out[0].append(len(out[1]) - 1)
        rows = pa.ListArray.from_arrays(pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()))
        where = pa.array([a for a, _ in found], pa.int64())
        held = [words[c].combine_chunks().take(where) for c in PAGE]
        return pa.RecordBatch.from_arrays([*held, pa.array([c for _, c in found], pa.string()), pa.array([0] * len(found), pa.int32()), pa.ListArray.from_arrays(pa.array(out[0], pa.int32()), rows).cast(pages)], names)

    rest = None
    for batch in batches:
        words = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        last = _starts(words)[-1] if words.num_rows else 0
        if last:
            yield made(words.slice(0, last))
        rest = words.slice(last)
    if rest is not None and rest.num_rows:
        yield made(rest)


def _starts(words: pa.Table) -> list[int]:
    """Numbers of the rows that begin a page."""
    keys = [words[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in PAGE]
    return [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist()]


def table_candidates(glyphs: DataFrame, gap: float = GAP, share: float = ALIGNED) -> DataFrame:
    """Candidates for best_tables() from placed words (file, page, line_no, seq, x, width, text): file, page, strategy, table_no and cells. Words without a line are in no table."""
    kinds = f"file {glyphs.schema['file'].dataType.simpleString()}, page {glyphs.schema['page'].dataType.simpleString()}"
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)  # noqa: E731  a missing place comes last
    picked = glyphs.where("line_no IS NOT NULL").select(*PAGE, "line_no", "seq", number("x"), number("width"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = picked.repartition(*PAGE).sortWithinPartitions(*PAGE, "line_no", "x", "seq")
    return dealt.mapInArrow(partial(_tables, gap=gap, share=share), f"{kinds}, strategy string, table_no int, cells array<array<string>>")


def outcome(files: DataFrame) -> DataFrame:
    """One row: files, those read and those with an error."""
    return files.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
