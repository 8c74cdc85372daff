import csv
import random

import pytest

from ledgerlens.operators import store as ST
from ledgerlens.sources.csv_records import read_records


@pytest.fixture
def short_ranges(spark):
    """Files are read in ranges of some 64 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "64")
    spark.conf.set(names[1], "1")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def _records(path):
    """Python's reader over the lines that are no comments."""
    with open(path, newline="", encoding="utf-8") as f:
        return [r for r in csv.reader(line for line in f if not line.startswith("#")) if r and (len(r) > 1 or r[0].strip())]


def _write(path, r, rows, loose):
    with open(path, "w", newline="", encoding="utf-8") as f:
        for _ in range(rows):
            kind = r.random()
            if kind < 0.08:
                f.write(r.choice(['# it\'s 5" wide\n', "\n", '# "open\n']))
                continue
            values = []
            for _ in range(r.randrange(1, 6)):
                text = "".join(r.choices(["a", "bc", " ", "é", ",", '""', "\n", "\r\n", "x" * 30, ",\n"], k=r.randrange(0, 9)))
                if r.random() < 0.5:
                    values.append('"' + text + '"' + (r.choice(["", "tail"]) if loose else ""))
                else:
                    plain = "".join(c for c in text if c not in ',"\r\n')
                    values.append(plain + ('5" pipe' if loose and plain and r.random() < 0.3 else ""))
            line = ",".join(values)
            f.write((line or "z") + r.choice(["\n", "\r\n"]))
        if r.random() < 0.3:
            f.write('end,"never closed\nand, more\n')


def test_records_over_range_borders_equal_pythons_reader(spark, short_ranges, tmp_path):
    for seed in range(6):
        folder = tmp_path / str(seed)
        folder.mkdir()
        r = random.Random(seed)
        for name in ("a.csv", "b.csv"):
            _write(folder / name, r, 120, loose=seed % 2 == 1)
        (folder / "empty.csv").write_text("")
        got = {}
        rows = read_records(spark, str(folder))
        assert rows.select("at.block").distinct().count() > 20
        for row in sorted(rows.collect(), key=lambda x: (x.file, x.at)):
            # A record by itself is what Python's reader takes from the whole file.
            (values,) = csv.reader([line + "\n" for line in row.value.split("\n")[:-1]] + [row.value.split("\n")[-1]])
            got.setdefault(row.file, []).append(values)
        for name in ("a.csv", "b.csv"):
            want = [[v.replace("\r\n", "\n") for v in x] for x in _records(folder / name)]
            if want[-1][0] == "end":  # the end of the file after the open value
                want[-1][-1] = want[-1][-1].rstrip("\n")
            have = [x for x in got[name] if len(x) > 1 or x[0].strip()]
            assert have == want, (seed, name)
        assert "empty.csv" not in got


def test_mapping_file_of_many_ranges(spark, short_ranges, tmp_path):
    head = "raw_pattern,clean_name,category,priority\n"
    body = "".join(f'shop {i},"Shop ""{i}""\nLine two, ""{"x" * (i % 90)}""",Food,{i}\n# note "{i}\n' for i in range(150))
    (tmp_path / "m.csv").write_text("# rules\n" + head + body)
    rows = ST.read_mapping_csv(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.raw_pattern, r.category, r.priority, r.status) for r in rows] == [(f"shop {i}", "Food", i, "ok") for i in range(150)]
