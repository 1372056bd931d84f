"""The paged source: the cursor by hand, projection, pushed filters, failures that don't end the job."""

import json

from quantloom.sources import paged


def test_walk_by_hand():
    asked = []

    def service(bars, page):
        def fetch(to):
            asked.append(to)
            rows = [b for b in bars if to is None or b["date"] <= to]
            return sorted(rows, key=lambda b: b["date"])[-page:]

        return fetch

    bars = [{"date": f"2020-01-{i:02d}", "c": i} for i in range(1, 29)]
    days = lambda rows: sorted(r["date"][-2:] for r in rows)
    assert days(paged.walk(service(bars, 10), "2000-01-01", 10, 9)) == [f"{i:02d}" for i in range(1, 29)] and asked == [None, "2020-01-18", "2020-01-08"]
    asked.clear()
    assert days(paged.walk(service(bars, 10), "2020-01-12", 10, 9)) == [f"{i:02d}" for i in range(9, 29)] and len(asked) == 2  # reached
    assert len(paged.walk(service(bars, 10), "2000-01-01", 10, 2)) == 20  # as many calls as allowed
    assert len(paged.walk(service(bars, 10), "2000-01-01", 11, 9)) == 10  # a short page is the last
    assert paged.walk(service([], 10), "2000-01-01", 10, 9) == [] and paged.PAGE == 4999 and paged.MAX_CALLS == 5
    twice = [[{"date": "2020-01-02", "c": 1}, {"date": "2020-01-03", "c": 1}], [{"date": "2020-01-02", "c": 2}]]
    assert paged.walk(lambda to: twice.pop(0), "2000-01-01", 2, 9) == [{"date": "2020-01-02", "c": 2}, {"date": "2020-01-03", "c": 1}]


def cache(tmp_path, pages):
    folder = tmp_path / "cache"
    folder.mkdir()
    for (symbol, to), body in pages.items():
        (folder / f"{paged.page_key(symbol, paged.FLOOR, to)}.json").write_text(body if isinstance(body, str) else json.dumps(body))
    (tmp_path / "symbols").write_text("\n".join(dict.fromkeys(s for s, _ in pages)) + "\nabsent\n")
    return str(folder), str(tmp_path / "symbols")


def test_rows_failures_projection_and_filters(spark, tmp_path):
    bar = lambda day, **more: {"date": day, "adjClose": 1.5, **more}
    pages = {
        ("A", None): [bar("2020-01-03", volume=7), bar("2020-01-02")],
        ("A", "2020-01-01"): [bar("2020-01-01", adjOpen=2)],
        ("B", None): "[{",
        ("C", None): [bar("2020-01-03"), bar("2020-01-02")],
        ("C", "2020-01-01"): [{"date": "n/a", "adjClose": 3}],
        ("D", None): [bar("2020-01-03") | {"adjClose": "x"}],
        ("E", None): [],
    }
    folder, listed = cache(tmp_path, pages)
    read = lambda schema=paged.SCHEMA: paged.read_pages(spark, folder, listed, schema, page=2, per_task=2)
    got = read()
    assert got.rdd.getNumPartitions() == 3
    assert sorted((r.symbol, str(r.date), r.adjOpen, r.volume) for r in got.where("_failure is null").collect()) == [("A", "2020-01-01", 2.0, None), ("A", "2020-01-02", None, None), ("A", "2020-01-03", None, 7.0)]
    assert {r.symbol: r._failure for r in got.where("_failure is not null").collect()} == {"B": "page 1: JSONDecodeError", "C": "page 2: ValueError", "D": "page 1: ValueError"}
    bars = paged.settled(read("symbol string, date date, _failure string"), str(tmp_path / "failed"))
    assert bars.columns == ["symbol", "date"] and bars.count() == 4  # D's price is not asked for
    assert sorted(r.symbol for r in spark.read.parquet(str(tmp_path / "failed")).collect()) == ["B", "C"]
    one = read().where("symbol = 'A'")
    assert one.count() == 3 and one.rdd.getNumPartitions() == 1
    assert read().where("symbol in ('B', 'E') and _failure is not null").count() == 1


def test_pages_written_are_read_back(spark, tmp_path):
    bars = spark.range(0, 95).selectExpr("if(id % 2 = 0, 'x', 'y') as symbol", "date_add('2001-01-01', cast(id as int)) as date", "id * 0.5 as adjClose")
    paged.write_pages(bars, str(tmp_path / "p"), page=10)
    (tmp_path / "symbols").write_text("x\ny")
    got = paged.read_pages(spark, str(tmp_path / "p"), str(tmp_path / "symbols"), "symbol string, date date, adjClose double", page=10, start="2001-02-01", max_calls=99)
    key = lambda r: (r.symbol, r.date)
    want = {"x": 40, "y": 40}  # whole pages back to the first that holds a day up to the start
    rows = got.collect()
    assert {s: sum(r.symbol == s for r in rows) for s in "xy"} == want
    newest = sorted((r for r in bars.collect()), key=key)
    assert sorted(map(tuple, rows)) == sorted(tuple(r) for s in "xy" for r in [r for r in newest if r.symbol == s][-40:])


def test_tasks_are_bounded_and_a_file_system_is_looked_up_once_a_task(tmp_path, monkeypatch):
    from pyarrow import fs as pafs

    bar = [{"date": "2020-01-03", "adjClose": 1.5}]
    folder, listed = cache(tmp_path, {(f"s{i}", None): bar for i in range(2500)})
    source = paged.PagedReader({"symbols": listed, "path": folder, "per_task": "1"}, paged.T.StructType.fromDDL("symbol string, date date, _failure string"))
    parts = source.partitions()
    assert len(parts) <= paged.MAX_TASKS and [s for p in parts for s in p.symbols] == [*(f"s{i}" for i in range(2500)), "absent"]
    looked, real = [], pafs.FileSystem.from_uri
    monkeypatch.setattr(pafs, "FileSystem", type("Counted", (), {"from_uri": staticmethod(lambda uri: looked.append(uri) or real(uri))}))
    assert [b.num_rows for b in source.read(parts[0])] == [1] * len(parts[0].symbols) and len(parts[0].symbols) > 1 and len(looked) == 1
