import csv
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import linkloom.sources.csv
from linkloom.sources.csv import csv_dialects, scan_cells, scan_csv
from linkloom.sources.files import (
    discover_files,
    empty_fingerprint,
    fingerprints,
    hidden_files,
    literal_paths,
    path_order,
    wanted_file,
)
from linkloom.sources.text import scan_text


@pytest.fixture
def small_splits(spark):
    """Files are cut into many blocks, as large ones are."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "50")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_discovery(spark, tmp_path):
    for name in ("b.txt", "a.CSV", "c.md", "sub/d.txt", "sub/k=v/e.csv", "a b%20[1].TXT"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x")

    def names(target, recursive):
        found = discover_files(spark, str(target), recursive).orderBy(*path_order()).collect()
        return [r.path.split(str(tmp_path) + "/")[1] for r in found]

    assert names(tmp_path, False) == ["a b%20[1].TXT", "a.CSV", "b.txt"]
    assert names(tmp_path, True) == ["a b%20[1].TXT", "a.CSV", "b.txt", "sub/d.txt", "sub/k=v/e.csv"]
    assert names(tmp_path / "c.md", False) == ["c.md"]
    assert names(tmp_path / "none", False) == []


def test_line_numbers_across_splits(spark, tmp_path, small_splits):
    rnd = random.Random(6)
    want = set()
    for f in range(5):
        out = b""
        for line in range(1, 200):
            text = rnd.choice(["", "x" * rnd.randint(0, 90), f"see http://h{f}.com/{line}, ok", f"http://a.com/{line} http://b.com/{line}"])
            out += text.encode() + rnd.choice([b"\n", b"\r\n", b"\r"] if f % 2 else [b"\n"])
        path = tmp_path / f"f{f} ü%41.txt"
        path.write_bytes(out)
        with path.open(encoding="utf-8", newline="") as file:
            for line, text in enumerate(file, 1):
                for i, url in enumerate(w.rstrip(",") for w in text.split() if w.startswith("http")):
                    want.add((path.name, line, i, url))
    got = scan_text(spark, str(tmp_path)).withColumn("f", F.substring_index("path", "/", -1)).collect()
    assert {(r.f, r.source_row, r.match_idx, r.raw_url) for r in got} == want


def test_invalid_bytes_do_not_lose_urls(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xff\xfe http://a.com/\xe4b x\nhttp://b.com")
    rows = scan_text(spark, str(tmp_path)).orderBy("source_row").collect()
    assert [r.raw_url for r in rows] == ["http://a.com/�b", "http://b.com"]


VALUES = [
    "x", "", "http://a.com/1", 'see "q" http://b.org/(x). ok', "one http://l1.com\ntwo http://l2.com/;a,b\n\nlast",
    "a,b;c", '"', '""x', 'tail,"', "\n", "http://c.com/a,http://d.com/b", " 'single' ",
]


def write_csv_files(folder):
    rnd = random.Random(5)
    for k in range(10):
        with open(folder / f"f{k:02d}.csv", "w", newline="", encoding="utf-8") as out:
            if k % 5 == 0:
                out.write("﻿")
            writer = csv.writer(
                out, delimiter=",;\t|"[k % 4], lineterminator=["\n", "\r\n"][k % 2], quotechar="\"'"[k == 8]
            )
            if k % 3 == 0:
                writer.writerow(["name", "url", "url"])
            pool = [v for v in VALUES if "\n" not in v] if k in (1, 2) else VALUES
            for _ in range(80):
                writer.writerow([rnd.choice(pool) for _ in range(3 if k % 2 else rnd.randint(1, 5))])
            if k == 7:
                out.write('a,b"c,"d"e"f,http://z.com/"x\n5" pipe,"unterminated http://u.com\nmore http://v.com,x\n')


def expected_cells(folder, header=None):
    """The cells by Python's csv module, told the dialect that each file was written in."""
    want = {}
    for k, path in enumerate(sorted(folder.glob("*.csv"))):
        with open(path, encoding="utf-8-sig", errors="replace", newline="") as file:
            rows = list(csv.reader(file, delimiter=",;\t|"[k % 4], quotechar="\"'"[k == 8]))
        named = [any("://" in cell for cell in row) for row in rows]
        named = header if header is not None else not named[0] and any(named)
        for n, row in enumerate(rows, 1):
            for i, cell in enumerate(row):
                name = rows[0][i] if named and i < len(rows[0]) else f"col{i}"
                lines = [x for x in cell.replace("\r\n", "\n").split("\n") if x]
                if lines:
                    want[(path.name, n, i, name.replace("\r\n", "\n"))] = lines
    return want


def found_cells(spark, folder, **options):
    got = defaultdict(list)
    for r in scan_cells(spark, str(folder), **options).withColumn("f", F.substring_index("path", "/", -1)).collect():
        got[(r.f, r.source_row, r.col_idx, r.source_column)].append((r.line_in_record, r.text))
    return {k: [t for _, t in sorted(v)] for k, v in got.items()}


@pytest.mark.parametrize("splits", ["whole", "small", "joined"])
def test_csv_cells_equal_the_csv_module(spark, tmp_path, request, splits, monkeypatch):
    """Whole files, files of many splits, and a table of splits that is not broadcast."""
    if splits != "whole":
        request.getfixturevalue("small_splits")
    if splits == "joined":
        monkeypatch.setattr(linkloom.sources.csv, "BROADCAST_BLOCKS", 3)
    write_csv_files(tmp_path)
    found = {r.path.rsplit("/", 1)[-1]: (r.delimiter, r.quote) for r in csv_dialects(spark, str(tmp_path)).collect()}
    assert found == {f"f{k:02d}.csv": (",;\t|"[k % 4], "\"'"[k == 8]) for k in range(10)}
    assert found_cells(spark, tmp_path) == expected_cells(tmp_path)
    assert found_cells(spark, tmp_path, header=False) == expected_cells(tmp_path, False)
    if splits == "whole":
        assert found_cells(spark, tmp_path, header=True) == expected_cells(tmp_path, True)


def test_declared_dialect(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a; 'b;c';d\n")
    cells = scan_cells(spark, str(tmp_path), delimiter=";", quote="'", skip_space=True).orderBy("col_idx").collect()
    assert [c.text for c in cells] == ["a", "b;c", "d"]
    cells = scan_cells(spark, str(tmp_path), delimiter=",").collect()
    assert [c.text for c in cells] == ["a; 'b;c';d"]
    with pytest.raises(ValueError, match="delimiters"):
        scan_cells(spark, str(tmp_path), delimiter="x")


def test_dialect_is_that_of_the_whole_file(spark, tmp_path, small_splits):
    """Text in quotes does not count, however many of its lines there are; spaces are told."""
    text = 'one, two,, three\nfour, five\n' * 9
    rows = [f'{i}; "{text}"; http://x.test/{i}' for i in range(20)]
    (tmp_path / "a.csv").write_text("\n".join(rows))
    (tmp_path / "b.csv").write_text("single\ncolumn\n")
    (tmp_path / "c.csv").write_text("a|b\n" * 50 + "x,y,z|\n" * 9)
    (tmp_path / "d.csv").write_text("it's,a\nb,c's\n")
    found = {r.path[-5]: (r.delimiter, r.quote, r.skip_space) for r in csv_dialects(spark, str(tmp_path)).collect()}
    assert found == {"a": (";", '"', True), "b": (",", '"', True), "c": ("|", '"', False), "d": (",", '"', False)}
    cells = scan_cells(spark, str(tmp_path / "a.csv")).where("col_idx = 2").collect()
    assert sorted(c.text for c in cells) == sorted(f"http://x.test/{i}" for i in range(20))


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    """No exchange of lines, no written text: a single file of one huge record keeps its splits."""
    (tmp_path / "a.csv").write_text('a,b\n1,"' + "line, of text\n" * 3000 + '"\n2,http://x.test/\n')
    cells = scan_cells(spark, str(tmp_path))
    assert cells.rdd.getNumPartitions() > 50
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Sort " not in plan
    by_record = {r[0]: r[1] for r in cells.groupBy("source_row").count().collect()}
    assert by_record == {1: 2, 2: 3001, 3: 2}
    assert [(r.source_row, r.source_column, r.raw_url) for r in scan_csv(spark, str(tmp_path)).collect()] == [(3, "b", "http://x.test/")]


def test_csv_urls_of_a_cell_stay_in_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,u\n1,"http://b.com http://a.com\nhttp://c.com, x"\n2,http://d.com\n')
    rows = scan_csv(spark, str(tmp_path)).orderBy("source_row", "col_idx", "match_idx").collect()
    assert [(r.source_row, r.col_idx, r.raw_url) for r in rows] == [
        (2, 1, "http://b.com"), (2, 1, "http://a.com"), (2, 1, "http://c.com"), (3, 1, "http://d.com"),
    ]


def plain_fingerprint(data):
    """The digest of a file's bytes, by its rule."""
    lines = data.removeprefix(b"\xef\xbb\xbf").split(b"\n")
    if not lines[-1]:
        lines.pop()
    lanes = [0] * 4
    for number, line in enumerate(lines, 1):
        digest = hashlib.sha256(f"{number}:{hashlib.sha256(line).hexdigest()}".encode()).hexdigest()
        lanes = [lane ^ int(digest[15 * i : 15 * i + 15], 16) for i, lane in enumerate(lanes)]
    return hashlib.sha256("-".join(map(str, [*lanes, len(lines), len(data)])).encode()).hexdigest()


CONTENTS = [
    b"one\ntwo\n", b"one\ntwo", b"two\none\n", b"one\rtwo\n", b"one\r\ntwo", b"one\n\rtwo", b"\n", b"\n\n", b"\r\n", b"x",
    b"\xff\xfe\n\x00", b"\xef\xbb\xbfone\ntwo\n", b"same\nsame\n", b"same\nsame\nsame\n", b"long " * 300 + b"\r" + b"y" * 700,
    b"long " * 300 + b"\n" + b"y" * 700, b"".join(b"line %d\n" % i for i in range(500)),
]


@pytest.mark.parametrize("splits", ["whole", "small"])
def test_fingerprints_of_any_size(spark, tmp_path, request, splits):
    if splits == "small":
        request.getfixturevalue("small_splits")
    for i, data in enumerate(CONTENTS):
        (tmp_path / f"f{i:02d}.txt").write_bytes(data)
        (tmp_path / f"g{i:02d}.txt").write_bytes(data)
    got = {r.path[-7:-4]: (r.file_hash, r.file_size) for r in fingerprints(spark, str(tmp_path)).collect()}
    for i, data in enumerate(CONTENTS):
        assert got[f"f{i:02d}"] == got[f"g{i:02d}"] == (plain_fingerprint(data), len(data))
    assert len({h for h, _ in got.values()}) == len(CONTENTS)


def test_unwanted_files_are_not_hashed(spark, tmp_path):
    for name in ("a.txt", "b.md", "sub/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    found = fingerprints(spark, str(tmp_path), lambda path: wanted_file(path, str(tmp_path), False))
    assert [r.path.rsplit("/", 1)[-1] for r in found.collect()] == ["a.txt"]
    assert spark.range(1).select(empty_fingerprint()).first()[0] == plain_fingerprint(b"")


def test_empty_and_hidden_files(spark, tmp_path):
    for name, text in (("a.txt", "x"), ("e.txt", ""), ("_h.txt", "y"), (".i.csv", ""), ("sub/f.csv", ""), ("sub/_g.txt", "z"), ("e.md", "")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)

    def names(found):
        return sorted((r.path.split(str(tmp_path) + "/")[1], r.file_size) for r in found.collect())

    assert names(discover_files(spark, str(tmp_path))) == [("a.txt", 1), ("e.txt", 0)]
    assert names(hidden_files(spark, str(tmp_path))) == [(".i.csv", 0), ("_h.txt", 1)]
    assert names(discover_files(spark, str(tmp_path), True)) == [("a.txt", 1), ("e.txt", 0), ("sub/f.csv", 0)]
    assert names(hidden_files(spark, str(tmp_path), True)) == [(".i.csv", 0), ("_h.txt", 1), ("sub/_g.txt", 1)]
    assert names(discover_files(spark, str(tmp_path / "e.txt"))) == [("e.txt", 0)]


def test_literal_paths():
    assert literal_paths(["/a[1]{b}*?.txt"]) == [r"/a\[1\]\{b\}\*\?.txt"]
