"""Workbooks, the fetch of corporate actions by a given function, and cleaning in one pass."""

import io
import zipfile
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pairlab.jobs import daily as jobs
from pairlab.operators import actions, calendars, clean
from pairlab.sources import tables, xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(sheets: dict[str, list[list]], inline: bool = False) -> bytes:
    """A minimal workbook; None is an absent cell, numbers are numbers, strings are shared or inline."""
    shared: list[str] = []
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 7}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 7}" Target="{"/xl/" if i else ""}worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            rows = ""
            for r, row in enumerate(sheets[n], 1):
                cells = ""
                for c, v in enumerate(row):
                    ref = f"{chr(65 + c) if c < 26 else 'A' + chr(39 + c)}{r}"
                    if v is None:
                        continue
                    if isinstance(v, str) and inline:
                        cells += f'<c r="{ref}" t="inlineStr"><is><r><t>{v[:1]}</t></r><r><t>{v[1:]}</t></r></is></c>'
                    elif isinstance(v, str):
                        shared.append(v)
                        cells += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
                    else:
                        cells += f'<c r="{ref}"><v>{v}</v></c>'
                rows += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst {MAIN}>' + "".join(f"<si><t>{s}</t><rPh><t>aid</t></rPh></si>" for s in shared) + "</sst>")
    return out.getvalue()


def test_sheet_rows():
    wide = [None] * 27 + ["far"]
    for inline in (False, True):
        content = workbook({"other": [["x"]], "list": [["Symbol", "a &amp; b"], wide, [], [1.5, None, "日本"]]}, inline)
        assert list(xlsx.sheet_rows(content, "list")) == [(1, ["Symbol", "a & b"]), (2, wide), (4, ["1.5", None, "日本"])]
        assert list(xlsx.sheet_rows(content, "other")) == [(1, ["x"])]
    with pytest.raises(ValueError, match="no sheet none; there are other, list"):
        list(xlsx.sheet_rows(content, "none"))


def test_sector_sheet(spark, tmp_path):
    head = ["Company Name", "Industry", "Symbol", "Series", "ISIN Code"]
    rows = [head, [" Alpha Ltd ", "banks", " aaa ", "EQ", "INE1 "], ["No symbol", "x", None, "EQ", "INE2"], ["Blank", "x", "  ", "EQ", "INE3"], [None, None, "bbb", "EQ"], ["C", "it", "m&amp;m", "EQ", "INE5"]]
    (tmp_path / "a.xlsx").write_bytes(workbook({"cover": [["t"]], "ind_nifty500list": rows}))
    want = {("AAA", "Alpha Ltd", "BANKS", "INE1"), ("BBB", None, None, None), ("M&M", "C", "IT", "INE5")}
    assert {tuple(r) for r in xlsx.read_sectors(spark, f"{tmp_path}/a.xlsx").collect()} == want
    # Columns in another order are found by heading; headings that lack, by place.
    order = [4, 2, 0, 1, 3]
    (tmp_path / "b.xlsx").write_bytes(workbook({"ind_nifty500list": [[r[k] if k < len(r) else None for k in order] for r in rows]}, inline=True))
    assert {tuple(r) for r in xlsx.read_sectors(spark, f"{tmp_path}/b.xlsx").collect()} == want
    (tmp_path / "c.xlsx").write_bytes(workbook({"ind_nifty500list": [["Name", "Kind", "Ticker", "Series", "Code"], *rows[1:]]}))
    assert {tuple(r) for r in xlsx.read_sectors(spark, f"{tmp_path}/c.xlsx").collect()} == want
    assert xlsx.read_sectors(spark, f"{tmp_path}/*.xlsx").count() == 9  # each workbook by its own headings
    securities = [["Code", "ISIN No", *[None] * 7, "Industry"], [1, "INE1", *[None] * 7, "Private Banks"], [2, None, *[None] * 7, "x"], [3, "INE5"]]
    (tmp_path / "e.xlsx").write_bytes(workbook({"list": securities}))
    other = xlsx.read_second_industry(spark, f"{tmp_path}/e.xlsx", "list")
    assert {tuple(r) for r in other.collect()} == {("INE1", "Private Banks"), ("INE5", None)}
    joined = tables.with_second_industry(xlsx.read_sectors(spark, f"{tmp_path}/a.xlsx"), other)
    assert {r.symbol: r.bse_industry for r in joined.collect()} == {"AAA": "Private Banks", "BBB": None, "M&M": None}
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "d.xlsx").write_bytes(workbook({"ind_nifty500list": []}))
    with pytest.raises(ValueError, match="empty"):
        xlsx.read_sectors(spark, f"{tmp_path}/empty/d.xlsx")


def source(log):
    """A source that fails at times, always for one symbol, and has nothing for another; calls are written down."""

    def fetch(symbol):
        calls = log / symbol
        n = len(calls.read_text()) if calls.exists() else 0
        calls.write_text("." * (n + 1))
        if symbol == "DOWN" or symbol == "SHAKY" and n < 2:
            raise ConnectionError(f"{symbol} is not there")
        if symbol in ("NONE", "NIL"):
            return None if symbol == "NONE" else []
        return [(date(2020, 1, 2), 2.0, 0.0), (date(2020, 5, 1), None, 1.5), (date(2020, 6, 1), float("nan"), float("nan")), (date(2020, 7, 1), 5.0, 0.5)]

    return fetch


def test_fetch_of_actions(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    symbols = ["GOOD", "SHAKY", "DOWN", "NONE", "NIL", "GOOD", None]
    daily = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    found = jobs.fetch_actions(spark, daily, source(log), str(tmp_path / "out"), at_once=3, delay=0.001)
    told = {r.symbol: r for r in found["coverage"].collect()}
    assert {s: (r.status, r.n_splits, r.n_dividends) for s, r in told.items()} == {"GOOD": ("ok", 2, 2), "SHAKY": ("ok", 2, 2), "DOWN": ("error", 0, 0), "NONE": ("empty", 0, 0), "NIL": ("empty", 0, 0)}
    assert told["DOWN"].error == "ConnectionError: DOWN is not there" and told["NONE"].error is None
    assert {p.name: len(p.read_text()) for p in log.iterdir()} == {"GOOD": 1, "SHAKY": 3, "DOWN": 3, "NONE": 1, "NIL": 1}
    rows = [(r.symbol, r.action_type, str(r.ex_date), r.value) for r in found["actions"].collect()]
    assert sorted(rows) == sorted((s, k, d, v) for s in ("GOOD", "SHAKY") for k, d, v in (("split", "2020-01-02", 2.0), ("split", "2020-07-01", 5.0), ("dividend", "2020-05-01", 1.5), ("dividend", "2020-07-01", 0.5)))
    assert actions.fetch_one("X", lambda s: 1 / 0, tries=1, delay=0.0)["error"] == "ZeroDivisionError: division by zero"
    assert actions.fetch_actions(daily.limit(0), source(log)).count() == 0


def test_cleaning_counts_as_it_passes(spark, tmp_path):
    """The one-pass report equals counting after each rule on its own, and the bars are written once."""
    days = [d for i in range(260) if (d := date(2010, 1, 4) + timedelta(i)).weekday() < 5]
    rows = []
    for k, s in enumerate("ABCDEFGH"):
        for i, d in enumerate(days):
            if s == "C" and 60 <= i < 80 or s == "D" and i < 120:
                continue
            close = 100.0 + i + k if not (s == "B" and i >= 90) else 400.0 + i
            rows.append((s, d, close, close, close, None if s == "E" and i == 5 else close, 10.0 if s == "F" else 1e6))
    rows += [("A", date(2010, 1, 9), 1.0, 1.0, 1.0, 1.0, 1e6)]  # a Saturday
    full = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double").repartition(5)
    none = lambda schema: spark.createDataFrame([], schema)
    events = spark.createDataFrame([("G", days[20])], "symbol string, event_date date")
    kw = dict(events=events, keep=none("symbol string, date date"), dividends=none("symbol string, date date"), windows=none("start date, end date"), blind=none("symbol string"))
    for excused in (None, spark.createDataFrame([("B", days[90]), ("B", days[90])], "symbol string, date date")):
        out = str(tmp_path / str(excused is None))
        found = jobs.clean_daily(spark, full, out, excused=excused, min_symbols=5, min_days=70, start="2010-01-01", end="2012-12-31", **kw)
        calendar = calendars.trading_calendar(full, start="2010-01-01", end="2012-12-31", min_symbols=5)
        want, df = [("input", full.count(), 8)], full
        for name, rule in (
            ("calendar", lambda x: calendars.calendar_filter(x, calendar)), ("prices", clean.drop_bad_prices), ("phantoms", lambda x: clean.trim_phantoms(x, excused)), ("events", lambda x: clean.after_structural_events(x, events)),
            ("liquidity", clean.liquidity_filter), ("contiguity", clean.contiguity_filter), ("history", lambda x: clean.min_history(x, days=70)),
        ):
            df = rule(df)
            want.append((name, df.count(), df.select("symbol").distinct().count()))
        assert [(r.rule, r.n_rows, r.n_symbols) for r in found["report"].orderBy("step").collect()] == want
        assert len({n for _, n, _ in want}) > 5
        key = ["symbol", "date"]
        assert sorted(map(tuple, found["daily_clean"].select(*key).collect())) == sorted(map(tuple, df.select(*key).collect()))
    plan = clean.min_history(clean.contiguity_filter(clean.trim_phantoms(full)))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(symbol") == 1  # one shuffle for the rules of a symbol
