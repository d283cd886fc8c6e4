"""Cells of CSV files, quoted line breaks included, without giving a whole file to one task.

Files are read by splits, line by line, and every pass reads the text again instead of writing it
down. What a line does depends on one bit, whether it begins inside a quoted cell, so each line is
judged for both cases. A pass over the lines of a split composes these maps: the split's own map, and
for both cases the counts of records and delimiters. The maps of a file's splits are chained, one row a
split, and the next pass knows the state, the record and the column that each of its splits begins in.

Three passes: delimiter counts, by which the dialect is chosen; the maps for that dialect; the cells.
"""

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions.extract import explode_matches, url_matches
from linkloom.session import stage
from linkloom.sources.files import read_lines

DELIMITERS = (",", ";", "\t", "|")  # the first of equals is chosen
QUOTES = ('"', "'")
BROADCAST_BLOCKS = 50_000  # rows of the table of splits that are sent to all tasks; more are joined by a sort
_LINE_BITS = 24
_BOM = "﻿"


# What a line does -----------------------------------------------------------------------------


def _patterns(delimiters: str, quote: str, spaces: str) -> tuple[str, str, str]:
    """One cell with the delimiter before it; a cell left open, in that form; inside and rest of a cell.

    A quote is one only at a cell's beginning. What follows the closing one belongs to the cell.
    """
    front, inside, rest = f"[{delimiters}]{spaces}", f"(?:[^{quote}]|{quote}{quote})*+", f"[^{delimiters}]*+"
    cell = f"{front}(?:{quote}{inside}(?:{quote}{rest})?+|{rest})"
    return cell, rf"\A{front}{quote}{inside}\z", rf"(?s)\A{quote}({inside})(?:{quote}(.*))?+"


def _cells(line: Column, quote: str, rx: Column, inside: bool) -> Column:
    """The cells of a line, each with the delimiter before it; the first gets one."""
    return F.regexp_extract_all(F.concat(F.lit("," + quote if inside else ","), line), rx, F.lit(0))


def _left_open(cells: Column, open_rx: Column) -> Column:
    return F.call_function("regexp_like", F.element_at(cells, -1), open_rx)


def _occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("int")


def _begins_with(part: str) -> Callable[[Column], Column]:
    return lambda text: F.startswith(text, F.lit(part))


class _Folded:
    """Composes the maps of a split's lines, batch by batch, for a state before its first line.

    A line that ends alike from both states settles it, others keep it or flip it. So the state before
    a line is the one settled last, flipped as often as flips followed.
    """

    def __init__(self, inside: bool) -> None:
        self.inside = inside

    def before(self, from_outside: np.ndarray, from_inside: np.ndarray) -> np.ndarray:
        """Whether each line begins inside a quoted cell, by how it ends from either state."""
        settles = from_outside == from_inside
        flips = np.concatenate([[0], np.cumsum(from_outside & ~from_inside)])
        number = np.arange(len(settles))
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(settles, number, -1))])
        found = last >= 0
        state = np.where(found, from_outside[np.maximum(last, 0)] if len(settles) else False, self.inside)
        states = state ^ ((flips - np.where(found, flips[np.maximum(last, 0) + 1] if len(settles) else 0, 0)) % 2 == 1)
        self.inside = bool(states[-1])
        return states[:-1]


def _by_split(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The rows of each split; those of one split stand together and in order."""
    begins = batch.column("block_start").to_numpy(zero_copy_only=False)
    paths = batch.column("path").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    heads = np.flatnonzero(np.append(True, (begins[1:] != begins[:-1]) | (paths[1:] != paths[:-1]))) if len(begins) else []
    for head, end in zip(heads, [*heads[1:], len(begins)]):
        yield (batch.column("path")[int(head)].as_py(), int(begins[head])), batch.slice(head, end - head)


def _array(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def _lines(spark: SparkSession, paths: list[str] | str, only_csv: bool) -> DataFrame:
    """path, block_start and text; a byte order mark before a line of a file's first split is taken off."""
    lines = read_lines(spark, paths, suffix_csv=True if only_csv else None)
    marked = (F.col("block_start") == 0) & F.startswith("text", F.lit(_BOM))
    return lines.select("path", "block_start", F.when(marked, F.substring("text", 2, 2**31 - 1)).otherwise(F.col("text")).alias("text"))


def _chained(blocks: DataFrame, *keys: str) -> DataFrame:
    """Add ``inside``: the state each split of a file begins in. One row a split and file comes together."""
    before = Window.partitionBy("path", *keys).orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    flip = (F.col("ends_0") & ~F.col("ends_1")).cast("int")
    settled = F.when(F.col("ends_0") == F.col("ends_1"), F.col("ends_0"))
    last = F.last(F.when(settled.isNotNull(), F.struct(settled.alias("to"), F.col("flips").alias("at"))), True).over(before)
    state = F.coalesce("last.to", F.lit(False))
    odd = (F.col("flips") - F.coalesce("last.at", F.lit(0))) % 2 == 1
    return (
        blocks.withColumn("flips", F.coalesce(F.sum(flip).over(before), F.lit(0)))
        .withColumn("last", last)
        .withColumn("inside", state != odd)
        .drop("flips", "last")
    )


# The dialect ----------------------------------------------------------------------------------

_COUNTS = 2 * len(DELIMITERS) + 1  # each delimiter, each with a space behind it, cells that are quoted


def _profiles(lines: DataFrame) -> DataFrame:
    """path, block_start, quote, ends_0, ends_1, and for both cases (0: the split begins outside a quoted
    cell, 1: inside) the lines that begin a record, with sums of their counts and of the squares."""
    text = F.col("text")
    plain = [_occurrences(text, part) for part in (*DELIMITERS, *[d + " " for d in DELIMITERS])]
    cells, ends, counts = {}, [], []
    for n, quote in enumerate(QUOTES):
        rx, open_rx, _ = _patterns("".join(DELIMITERS), quote, " ?+")
        has = F.contains(text, F.lit(quote))
        for case, inside in (("outside", False), ("inside", True)):
            cells[f"{case}{n}"] = F.when(has, _cells(text, quote, F.lit(rx), inside))
            opened = F.coalesce(_left_open(F.col(f"{case}{n}"), F.lit(open_rx)), F.lit(inside))
            ends.append(opened.alias(f"{case}{n}_open"))
        own = F.col(f"outside{n}")
        fronts = F.slice(F.transform(own, lambda c: F.left(c, F.lit(2))), 2, 2**31 - 1)
        quoted = F.size(F.filter(F.transform(own, lambda c: F.ltrim(F.substring(c, 2, 2))), _begins_with(quote)))
        counts.append((f"fronts{n}", fronts, f"quoted{n}", quoted))
    judged = lines.withColumns({"plain": F.array(*plain)} | cells)
    judged = judged.withColumns({name: column for f, x, q, y in counts for name, column in ((f, x), (q, y))})

    def counted(n: int) -> Column:
        fronts = F.col(f"fronts{n}")
        each = [F.size(F.filter(fronts, _begins_with(part))) for part in (*DELIMITERS, *[d + " " for d in DELIMITERS])]
        none = F.concat("plain", F.array(F.lit(0)))
        return F.when(fronts.isNotNull(), F.array(*each, F.col(f"quoted{n}"))).otherwise(none).alias(f"counts{n}")

    flat = judged.select("path", "block_start", *ends, *[counted(n) for n in range(len(QUOTES))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, folds, sums = None, [], None

        def row() -> pa.RecordBatch:
            out = []
            for n, quote in enumerate(QUOTES):
                cases = [{"n": int(c[0]), "sums": c[1].tolist(), "squares": c[2].tolist()} for c in sums[n]]
                out.append({"path": at[0], "block_start": at[1], "quote": quote, "ends_0": folds[n][0].inside, "ends_1": folds[n][1].inside, "cases": cases})
            return pa.RecordBatch.from_pylist(out, schema=schema)

        case = pa.struct([("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("squares", pa.list_(pa.float64()))])
        schema = pa.schema(
            [("path", pa.string()), ("block_start", pa.int64()), ("quote", pa.string()), ("ends_0", pa.bool_()), ("ends_1", pa.bool_()), ("cases", pa.list_(case))]
        )
        for batch in batches:
            for split, part in _by_split(batch):
                if split != at:
                    if at:
                        yield row()
                    at = split
                    folds = [[_Folded(False), _Folded(True)] for _ in QUOTES]
                    sums = [[[0, np.zeros(_COUNTS, dtype=np.int64), np.zeros(len(DELIMITERS))] for _ in range(2)] for _ in QUOTES]
                for n in range(len(QUOTES)):
                    counts = _array(part, f"counts{n}", _COUNTS)
                    ends = [_flags(part, f"{case}{n}_open") for case in ("outside", "inside")]
                    for fold, total in zip(folds[n], sums[n], strict=True):
                        begins = ~fold.before(*ends)
                        total[0] += np.count_nonzero(begins)
                        total[1] += counts[begins].sum(axis=0)
                        total[2] += (counts[begins, : len(DELIMITERS)].astype(float) ** 2).sum(axis=0)
        if at:
            yield row()

    kinds = "path string, block_start long, quote string, ends_0 boolean, ends_1 boolean, cases array<struct<n: long, sums: array<long>, squares: array<double>>>"
    return flat.mapInArrow(run, kinds)


def csv_dialects(spark: SparkSession, paths: list[str] | str, only_csv: bool = False) -> DataFrame:
    """path, delimiter, quote and skip_space of every file, from its whole text.

    Of the lines that begin a record, delimiters outside of quotes are counted. The delimiter is the one
    whose counts are steadiest: the square of their mean over the mean of their squares, which is 1 if every
    line has the same number and near 0 if few lines have any. Without any, it is a comma. The quote
    is the one that opens more cells. skip_space: a space follows every delimiter, or there is none.
    """
    return _chosen(_profiles(_lines(spark, paths, only_csv)))


def _chosen(profiles: DataFrame) -> DataFrame:
    case = F.get("cases", F.col("inside").cast("int"))
    k = len(DELIMITERS)
    states = _chained(profiles, "quote").select("path", "quote", case.alias("c"))
    sums = states.groupBy("path", "quote").agg(
        F.sum("c.n").alias("n"),
        *[F.sum(F.get("c.sums", F.lit(i))).alias(f"s{i}") for i in range(_COUNTS)],
        *[F.sum(F.get("c.squares", F.lit(i))).alias(f"q{i}") for i in range(k)],
    )
    # most cells opened, then the first quote; most steady, then the first delimiter
    order = F.create_map(*[F.lit(x) for n, q in enumerate(QUOTES) for x in (q, -n)])
    best = sums.groupBy("path").agg(F.max(F.struct(F.col(f"s{2 * k}").alias("quoted"), order[F.col("quote")].alias("o"), *[c for c in sums.columns if c != "path"])).alias("b"))
    steady = [
        F.struct(
            F.when(F.col(f"b.s{i}") > 0, F.pow(F.col(f"b.s{i}"), F.lit(2.0)) / (F.col("b.n") * F.col(f"b.q{i}"))).otherwise(F.lit(0.0)).alias("steady"),
            F.lit(-i).alias("o"),
            F.lit(d).alias("delimiter"),
            (F.col(f"b.s{i}") == F.col(f"b.s{k + i}")).alias("skip_space"),
        )
        for i, d in enumerate(DELIMITERS)
    ]
    return best.select("path", F.greatest(*steady).alias("d"), F.col("b.quote").alias("quote")).select("path", "d.delimiter", "quote", "d.skip_space")


# Records and cells ----------------------------------------------------------------------------


def _by_dialect(part: int) -> Column:
    """A pattern of the row's dialect."""
    known = {d + q + str(s).lower(): _patterns(d, q, " *+" if s else "")[part] for d, q, s in product(DELIMITERS, QUOTES, (True, False))}
    key = F.concat("delimiter", "quote", F.col("skip_space").cast("string"))
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[key]


def _judged(lines: DataFrame) -> DataFrame:
    """Add what a line does when it begins outside (0) or inside (1) a quoted cell.

    ends_0 and ends_1: does it end inside one; delims_0 and delims_1: delimiters between cells.
    """

    def cells(inside: bool) -> Column:
        front = F.concat("delimiter", "quote") if inside else F.col("delimiter")
        return F.regexp_extract_all(F.concat(front, "text"), _by_dialect(0), F.lit(0))

    has = F.contains("text", F.col("quote"))
    staged = lines.withColumn("cells_0", F.when(has, cells(False))).withColumn("cells_1", F.when(has, cells(True)))
    plain = F.length("text") - F.length(F.replace("text", F.col("delimiter")))
    return staged.select(
        *lines.columns,
        F.coalesce(_left_open(F.col("cells_0"), _by_dialect(1)), F.lit(False)).alias("ends_0"),
        F.coalesce(_left_open(F.col("cells_1"), _by_dialect(1)), F.lit(True)).alias("ends_1"),
        F.when(has, F.size("cells_0") - 1).otherwise(plain).cast("long").alias("delims_0"),
        F.when(has, F.size("cells_1") - 1).otherwise(F.lit(0)).cast("long").alias("delims_1"),
    )


def _with_table(lines: DataFrame, table: DataFrame, keys: list[str], ordered: bool = True) -> DataFrame:
    """Lines with the row of their split or file, in their order.

    A table beyond BROADCAST_BLOCKS rows is joined by a shuffle, after which the lines are sorted again.
    """
    if table.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        return lines.join(F.broadcast(table), keys, "left")
    if not ordered:
        return lines.join(table, keys, "left")
    spotted = lines.withColumn("spot", F.monotonically_increasing_id())
    joined = spotted.join(table.hint("merge"), keys, "left")
    return joined.sortWithinPartitions("path", "block_start", "spot").drop("spot")


_MAP = "path string, block_start long, lines long, ends_0 boolean, ends_1 boolean, records array<long>, delims array<long>, start_line array<long>, start_delims array<long>, first_record array<string>, later_urls boolean, closed boolean"


def _maps(judged: DataFrame) -> DataFrame:
    """The map of every split, and for both cases its records, delimiters, and of the line that begins its
    last record the number and the delimiters before (null if there is none).

    Of a file's first split also the lines of its first record, whether it ends there (closed), and
    whether lines behind it have a URL.
    """
    judged = judged.select(
        "path", "block_start", "ends_0", "ends_1", "delims_0", "delims_1",
        F.contains("text", F.lit("://")).alias("url"), F.when(F.col("block_start") == 0, F.col("text")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"path": pa.string(), "block_start": pa.int64(), "lines": pa.int64(), "ends_0": pa.bool_(), "ends_1": pa.bool_(), "first_record": pa.list_(pa.string()), "later_urls": pa.bool_(), "closed": pa.bool_()}
        numbers = ("records", "delims", "start_line", "start_delims")
        schema = pa.schema([(f.split()[0], kinds.get(f.split()[0], pa.list_(pa.int64()))) for f in _MAP.split(", ")])
        at, folds, row = None, [], {}

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([row | {"ends_0": folds[0].inside, "ends_1": folds[1].inside}], schema=schema)

        for batch in batches:
            for split, part in _by_split(batch):
                if split != at:
                    if at:
                        yield made()
                    at, folds = split, [_Folded(False), _Folded(True)]
                    row = {"path": at[0], "block_start": at[1], "lines": 0, "first_record": [], "later_urls": False, "closed": False}
                    row |= {"records": [0, 0], "delims": [0, 0], "start_line": [None, None], "start_delims": [None, None]}
                ends = (_flags(part, "ends_0"), _flags(part, "ends_1"))
                delims = [part.column(f"delims_{case}").to_numpy(zero_copy_only=False) for case in (0, 1)]
                for case, fold in enumerate(folds):
                    inside = fold.before(*ends)
                    own = np.where(inside, delims[1], delims[0])
                    begins = np.flatnonzero(~inside)
                    if len(begins):
                        last = int(begins[-1])
                        row["start_line"][case] = row["lines"] + last
                        row["start_delims"][case] = row["delims"][case] + int(own[:last].sum())
                    if case == 0:
                        urls = _flags(part, "url")
                        if at[1] == 0 and not row["closed"]:
                            more = begins[1:] if not row["records"][0] else begins
                            end = int(more[0]) if len(more) else part.num_rows
                            row["first_record"] = row["first_record"] + part.column("text").slice(0, end).to_pylist()
                            row["closed"] = bool(len(more))
                            urls = urls[end:]
                        row["later_urls"] |= bool(urls.any())
                    row["records"][case] += len(begins)
                    row["delims"][case] += int(own.sum())
                row["lines"] += part.num_rows
        if at:
            yield made()

    return judged.mapInArrow(run, _MAP)


def _begins(maps: DataFrame) -> DataFrame:
    """path, block_start, inside, and what stands before each split of its file: records, and of the record
    that is open the lines and the delimiters."""
    case = F.col("inside").cast("int")
    known = _chained(maps).select("path", "block_start", "inside", "lines", *[F.get(n, case).alias(n) for n in ("records", "delims", "start_line", "start_delims")])
    before = Window.partitionBy("path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    known = known.select("*", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"file_{n}") for n in ("lines", "records", "delims")])
    # starts grow, so the last one is the largest
    line = F.max(F.col("file_lines") + F.col("start_line")).over(before)
    delims = F.max(F.col("file_delims") + F.col("start_delims")).over(before)
    return known.select(
        "path", "block_start", "inside", F.col("file_records").alias("records_before"),
        (F.col("file_lines") - F.coalesce(line, F.lit(0))).alias("open_lines"),
        (F.col("file_delims") - F.coalesce(delims, F.lit(0))).alias("open_delims"),
    )


_PLACED = "path string, delimiter string, quote string, skip_space boolean, text string, inside boolean, source_row long, line_in_record long, first_col long"


def _placed(judged: DataFrame) -> DataFrame:
    """Lines with their state, record, place in the record and first column, by what stands before their split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = fold = None
        records = lines = delims = 0
        for batch in batches:
            for split, part in _by_split(batch):
                if split != at:
                    at = split
                    names = ("begins_inside", "records_before", "open_lines", "open_delims")
                    inside, records, lines, delims = (part.column(n)[0].as_py() for n in names)
                    if inside is None:
                        raise ValueError(f"the splits of {split[0]} have changed between two readings")
                    fold = _Folded(inside)
                inside = fold.before(_flags(part, "ends_0"), _flags(part, "ends_1"))
                counts = [part.column(f"delims_{case}").to_numpy(zero_copy_only=False) for case in (0, 1)]
                own = np.where(inside, counts[1], counts[0])
                total = np.concatenate([[0], np.cumsum(own)]) + delims
                number = np.arange(part.num_rows) + lines
                # a line that begins a record counts from itself, others from the last such line
                head = np.maximum.accumulate(np.where(inside, -1, np.arange(part.num_rows)))
                behind = head < 0
                first = np.where(behind, total[:-1], total[:-1] - total[np.maximum(head, 0)])
                place = np.where(behind, number, np.arange(part.num_rows) - head)
                row = records + np.cumsum(~inside)
                if len(row):
                    records, lines = int(row[-1]), int(place[-1]) + 1
                    delims = int(total[-1] - (0 if behind[-1] else total[head[-1]]))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in ("path", "delimiter", "quote", "skip_space", "text")], pa.array(inside), pa.array(row), pa.array(place), pa.array(first)],
                    ["path", "delimiter", "quote", "skip_space", "text", "inside", "source_row", "line_in_record", "first_col"],
                )

    return judged.mapInArrow(run, _PLACED)


def _values(text: Column, inside: Column) -> Column:
    """The cells of a line without their quotes."""
    front = F.when(inside, F.concat("delimiter", "quote")).otherwise(F.col("delimiter"))
    cells = F.regexp_extract_all(F.concat(front, text), _by_dialect(0), F.lit(0))
    value_rx, quote = _by_dialect(2), F.col("quote")

    def value(cell: Column) -> Column:
        cell = F.substring(cell, 2, 2**31 - 1)
        cell = F.when(F.col("skip_space"), F.ltrim(cell)).otherwise(cell)

        def group(n: int) -> Column:
            return F.call_function("regexp_extract", cell, value_rx, F.lit(n))

        unquoted = F.concat(F.replace(group(1), F.concat(quote, quote), quote), group(2))
        return F.when(F.startswith(cell, quote), unquoted).otherwise(cell)

    return F.transform(cells, value)


def scan_cells(
    spark: SparkSession,
    paths: list[str] | str,
    only_csv: bool = False,
    header: bool | None = None,
    delimiter: str | None = None,
    quote: str = '"',
    skip_space: bool = False,
) -> DataFrame:
    """Cells of CSV files: path, source_row, col_idx, source_column, line_in_record, text.

    Rows are records counted from 1, the header among them. A cell with line breaks comes as one row for
    each of its lines; empty ones are left out. ``header``: whether the first record names the columns; by
    default it does if it has no URL and others have one. Columns without a name are called col0, col1, …; so
    are all if the first record does not end in its split of the file. Without a ``delimiter``, each
    file's dialect is that of ``csv_dialects``; otherwise no file is read for it.
    """
    lines = _lines(spark, paths, only_csv)
    if delimiter is None:
        dialects = stage(csv_dialects(spark, paths, only_csv))
        spoken = _with_table(lines, dialects, ["path"])
    else:
        if delimiter not in DELIMITERS or quote not in QUOTES:
            raise ValueError(f"delimiters are {DELIMITERS}, quotes {QUOTES}")
        spoken = lines.select("*", F.lit(delimiter).alias("delimiter"), F.lit(quote).alias("quote"), F.lit(skip_space).alias("skip_space"))
        dialects = None
    maps = stage(_maps(_judged(spoken)))
    begins = _begins(maps).withColumnRenamed("inside", "begins_inside")
    if dialects is None:
        table = begins
    else:
        table = begins.join(dialects, "path")
        spoken = lines
    judged = _judged(_with_table(spoken, stage(table), ["path", "block_start"]))
    cells = _placed(judged).select(
        "path",
        "source_row",
        "line_in_record",
        "first_col",
        F.posexplode(_values(F.col("text"), F.col("inside"))).alias("cell_no", "text"),
    )
    cells = cells.where(F.col("text") != "").withColumn("col_idx", (F.col("first_col") + F.col("cell_no")).cast("int"))
    named = _with_table(cells, stage(_headers(maps, dialects, header, delimiter, quote, skip_space)), ["path"], ordered=False)
    return named.select(
        "path",
        "source_row",
        "col_idx",
        F.coalesce(F.get("header", F.col("col_idx")), F.concat(F.lit("col"), F.col("col_idx").cast("string"))).alias("source_column"),
        "line_in_record",
        "text",
    )


def _headers(
    maps: DataFrame, dialects: DataFrame | None, header: bool | None, delimiter: str | None, quote: str, skip_space: bool
) -> DataFrame:
    """path and header, the names in the first record, of files that have one."""
    whole = F.array_join("first_record", "\n")
    later = maps.groupBy("path").agg(F.max("later_urls").alias("urls"), F.count(F.lit(1)).alias("splits"))
    first = maps.where("block_start = 0").select("path", whole.alias("text"), "closed").join(later, "path")
    ends = F.col("closed") | (F.col("splits") == 1)
    if header is None:
        first = first.where(ends & F.col("urls") & ~F.contains("text", F.lit("://")))
    else:
        first = first.where(ends & F.lit(header))
    if dialects is None:
        first = first.select("*", F.lit(delimiter).alias("delimiter"), F.lit(quote).alias("quote"), F.lit(skip_space).alias("skip_space"))
    else:
        first = first.join(dialects, "path")
    return first.select("path", _values(F.col("text"), F.lit(False)).alias("header"))


def scan_csv(spark: SparkSession, paths: list[str] | str, only_csv: bool = False, header: bool | None = None) -> DataFrame:
    """path, source_row, col_idx, source_column, match_idx and raw_url for every URL in CSV cells.

    match_idx orders the URLs of a cell, those of its first line first.
    """
    cells = scan_cells(spark, paths, only_csv, header).where(F.contains("text", F.lit("://")))
    kept = ["path", "source_row", "col_idx", "source_column", "line_in_record"]
    found = explode_matches(cells, kept, url_matches(F.col("text")))
    return found.withColumn(
        "match_idx", F.shiftleft("line_in_record", _LINE_BITS) + F.col("match_idx")
    ).drop("line_in_record")
