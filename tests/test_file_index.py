"""The kept file index: footers are opened once, scans skip files by it, two jobs may refresh it at once."""

import os
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from billweave.operators.rules import Rules
from billweave.plans.monitor import billing_source, run_check
from billweave.sinks.state import StateStore
from billweave.sources import file_index
from billweave.sources.exports import load_source, resolve
from billweave.sources.file_index import FileIndex, in_range, load_indexed
from billweave.sources.footers import listing

from .billing import focus_raw, write_month
from .test_monitor import EXPECTED, NOW, found, write_anomaly_export


def write_days(spark, base, month, *days):
    """A month with a file for each group of days."""
    folder = base / f"BILLING_PERIOD={month}"
    folder.mkdir(parents=True, exist_ok=True)
    for group in days:
        rows = [dict(day=f"{month}-{n:02d}", service_name="EC2", account_id="1", cost=float(n)) for n in group]
        focus_raw(spark, rows).coalesce(1).write.parquet(str(base / "tmp" / f"{month}-{group[0]}"))
        (part,) = (base / "tmp" / f"{month}-{group[0]}").glob("*.parquet")
        part.rename(folder / f"{group[0]:02d}.parquet")
    return folder


def spoil(path: Path):
    """Other content of the same size and change time: opening the file would fail."""
    stat = path.stat()
    path.write_bytes(b"x" * stat.st_size)
    os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)


def names(rows):
    return sorted(Path(r.file).name for r in rows.collect())


def test_footers_are_opened_once(spark, tmp_path):
    august = write_days(spark, tmp_path / "data", "2026-08", (1, 5), (10, 15), (20, 25))
    index = FileIndex(spark, str(tmp_path / "index"))
    base = str(tmp_path / "data")
    first = index.refresh(base).collect()
    assert len(first) == 3 and {r.version for r in first} == {1}
    for path in august.glob("*.parquet"):
        spoil(path)
    assert index.refresh(base).collect() == first
    # A new month is read, the rest is not opened; months outside the range are not even listed.
    write_days(spark, tmp_path / "data", "2026-09", (3, 4))
    again = index.refresh(base, date(2026, 9, 1), date(2026, 10, 1)).collect()
    assert [(Path(r.file).name, r.version) for r in again] == [("03.parquet", 2)]
    assert sorted(r.version for r in index.refresh(base).collect()) == [1, 1, 1, 2]
    # A rewritten file is read again; one that is gone is left out.
    (august / "01.parquet").unlink()
    write_days(spark, tmp_path / "data2", "2026-08", (10, 16))
    (tmp_path / "data2" / "BILLING_PERIOD=2026-08" / "10.parquet").rename(august / "10.parquet")
    now = {Path(r.file).name: r for r in index.refresh(base).collect()}
    assert {n: r.version for n, r in now.items()} == {"03.parquet": 2, "10.parquet": 3, "20.parquet": 1}
    assert now["10.parquet"].row_groups[0].max_ts == datetime(2026, 8, 16)


def test_scans_open_files_of_the_range_only(spark, tmp_path):
    base = tmp_path / "data"
    folder = write_days(spark, base, "2026-08", (1, 5), (10, 15), (20, 25))
    rows = FileIndex(spark, str(tmp_path / "index")).refresh(str(base))
    cases = {("2026-08-05", "2026-08-10"): ["01.parquet"], ("2026-08-05", "2026-08-11"): ["01.parquet", "10.parquet"], ("2026-08-16", "2026-08-20"): [], ("2026-08-12", "2026-08-13"): ["10.parquet"]}
    for span, expected in cases.items():
        assert names(in_range(rows, [span])) == expected
    assert names(in_range(rows, [("2026-08-01", "2026-08-02"), ("2026-08-24", "2026-08-30")])) == ["01.parquet", "20.parquet"]
    spoil(folder / "20.parquet")
    nc = load_indexed(spark, rows, [("2026-08-04", "2026-08-12")])
    assert [Path(f).name for f in sorted(nc.inputFiles())] == ["01.parquet", "10.parquet"]
    assert nc.agg(F.sum("amortized_cost")).first()[0] == 31.0
    assert load_indexed(spark, rows, [("2030-01-01", "2030-02-01")]).count() == 0


def test_unknown_layouts_are_not_hidden(spark, tmp_path):
    write_days(spark, tmp_path / "data", "2026-08", (1,))
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "odd"))
    (part,) = (tmp_path / "odd").glob("*.parquet")
    part.rename(tmp_path / "data" / "BILLING_PERIOD=2026-08" / "odd.parquet")
    rows = FileIndex(spark, str(tmp_path / "index")).refresh(str(tmp_path / "data"))
    assert names(in_range(rows, [("2030-01-01", "2030-02-01")])) == ["odd.parquet"]
    with pytest.raises(Exception, match="unknown export layout"):
        load_indexed(spark, rows, [("2030-01-01", "2030-02-01")])


def test_parts_are_merged_and_races_are_harmless(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_index, "MOST_PARTS", 2)
    base, path = tmp_path / "data", str(tmp_path / "index")
    index, other = FileIndex(spark, path), FileIndex(spark, path)
    for i in range(4):
        write_days(spark, base, f"2026-0{i + 1}", (2,))
        # Another job refreshes between this one's listing of versions and its commit.
        if i == 2:
            mine = index._versions
            monkeypatch.setattr(index, "_versions", lambda: (monkeypatch.setattr(index, "_versions", mine), mine(), other.refresh(str(base)))[1])
        assert index.refresh(str(base)).count() == i + 1
    assert len(index._parts()) <= 2 and index.kept().count() == 4
    # A log file that a writer died on does not count.
    last = index._versions()[-1]
    (tmp_path / "index" / "log" / f"{last + 1}.json").write_text("[")
    assert index.refresh(str(base)).count() == 4
    write_days(spark, base, "2026-05", (2,))
    assert index.refresh(str(base)).count() == 5


def test_an_empty_source(spark, tmp_path):
    index = FileIndex(spark, str(tmp_path / "index"))
    assert index.refresh(str(tmp_path / "missing")).count() == 0
    assert load_indexed(spark, index.refresh(str(tmp_path / "missing")), [("2026-08-01", "2026-08-02")]).count() == 0


def test_a_check_with_a_kept_index(spark, tmp_path):
    base, kept = str(tmp_path / "data"), str(tmp_path / "index")
    write_anomaly_export(spark, base)
    with_index, without = StateStore(spark, str(tmp_path / "a")), StateStore(spark, str(tmp_path / "b"))
    source = billing_source(spark, "s", base, remote=True, kept_index=kept)
    out = run_check(with_index, source, Rules(), NOW)
    plain = run_check(without, billing_source(spark, "s", base, remote=True), Rules(), NOW)
    assert out == plain and found(with_index) == found(without) == EXPECTED
    assert len(FileIndex(spark, kept)._versions()) == 1


def test_listing_is_a_job_over_folders(spark, tmp_path, monkeypatch):
    """The driver's calls don't grow with the files: it lists the base folder and asks for no file."""
    from billweave.sources import storage

    base = tmp_path / "a base"
    for month in ("2026-07", "2026-08"):
        write_days(spark, base, month, (1,), (2,), (3,), (4,))
    (base / "BILLING_PERIOD=2026-07" / "_hidden").mkdir()
    (base / "BILLING_PERIOD=2026-07" / "_hidden" / "x.parquet").write_bytes(b"x")
    calls = []
    real = storage._fs
    monkeypatch.setattr(storage, "_fs", lambda spark, path: calls.append(path) or real(spark, path))
    found = resolve(spark, str(base))
    assert [len(p.files) for p in found] == [4, 4] and all(p.whole for p in found) and len(calls) == 1
    nc = load_source(spark, f"file:{base}")
    assert nc.count() == 8
    # Folders that hold nothing else are read as folders.
    assert nc.inputFiles() and nc.agg(F.sum("amortized_cost")).first()[0] == 20.0
    assert listing(spark, [str(tmp_path / "missing")]).count() == 0


def test_months_in_two_folders(spark, tmp_path):
    write_month(focus_raw(spark, [dict(day="2026-08-01", service_name="EC2", account_id="1", cost=1.0)]), tmp_path, "2026-08")
    write_month(focus_raw(spark, [dict(day="2026-08-02", service_name="EC2", account_id="1", cost=2.0)]), tmp_path, "2026-8", name="billing_period")
    assert load_source(spark, str(tmp_path)).agg(F.sum("amortized_cost")).first()[0] == 3.0
