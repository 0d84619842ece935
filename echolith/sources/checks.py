"""Checks of input data: counts of groups and rows, and findings in plain words."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Check:
    """What a check found: (level, text) of ``ok``, ``warn`` or ``error``, a table of counts, values for the caller."""

    messages: list[tuple[str, str]] = field(default_factory=list)
    table: DataFrame | None = None
    info: dict = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return all(level != "error" for level, _ in self.messages)

    def add(self, level: str, text: str) -> Check:
        self.messages.append((level, text))
        return self


#: Most labels that a check reads into its messages.
MAX_LABELS = 1000


def _missing(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def _labels(check: Check, counts: DataFrame, label: str, least: int = 2) -> list:
    """Rows of the counts, a label each, with findings on labels of few groups; refuses columns that hold no labels."""
    rows = counts.orderBy(label).limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        check.add("error", f"Column '{label}' has over {MAX_LABELS} values; it does not look like a label.")
        return []
    for r in rows:
        if r["n_groups"] < least:
            check.add("warn", f"'{r[label]}' has {r['n_groups']} group(s); testing without one group needs {least}.")
    if len(rows) < 2:
        check.add("error", "A classifier tells two or more labels apart; these rows have fewer.")
    check.info["classes"] = [str(r[label]) for r in rows]
    return rows


def feature_table(df: DataFrame, label: str, group: str, features: list[str], classes: list[str] | None = None) -> Check:
    """Detections with features: columns, rows, groups and classes."""
    out = Check(info={"columns": df.columns, "features": features})
    if missing := _missing(df, [label, group, *features]):
        return out.add("error", f"Columns not found: {', '.join(missing)}. There are: {', '.join(df.columns[:30])}.")
    rows = df.filter(F.col(label).cast("string").isin(classes)) if classes else df
    out.table = rows.groupBy(F.col(label).cast("string").alias(label)).agg(F.countDistinct(group).alias("n_groups"), F.count("*").alias("n_detections"))
    total = rows.agg(F.count("*").alias("n"), F.countDistinct(group).alias("g")).head()
    got = _labels(out, out.table, label)
    out.messages.insert(0, ("ok", f"Rows: {total.n}. Groups: {total.g}. Labels: {len(got)}. Features: {len(features)}."))
    return out


def files(df: DataFrame, what: str, path: str = "path", start: str = "start", others: int = 0) -> Check:
    """Binary files of one kind (``sources.binary.list_files``), with the span of the times in their names."""
    r = df.agg(F.count("*").alias("n"), F.min(start).alias("a"), F.max(start).alias("z")).head()
    out = Check(info={"n_files": r.n})
    if not r.n:
        return out.add("error", f"No {what} files found; {others} others.")
    span = ""
    if r.a is not None:
        text = df.sparkSession.range(1).select(*(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.lit(float(x))), F.current_timezone()), "yyyy-MM-dd HH:mm") for x in (r.a, r.z))).head()
        span = f", {text[0]} to {text[1]} UTC"
    return out.add("ok", f"{r.n} {what} files{span}.")


def frame_inputs(df: DataFrame, expected: int, label: str = "label", group: str = "event_id") -> Check:
    """Frames with inputs f1, f2, ...: their number against the settings', rows by label."""
    inputs = [c for c in df.columns if c[0] == "f" and c[1:].isdigit()]
    out = Check(info={"n_inputs": len(inputs)})
    if missing := _missing(df, [label, group]):
        return out.add("error", f"Columns not found: {', '.join(missing)}.")
    if len(inputs) != expected:
        out.add("error", f"The frames have {len(inputs)} inputs, their settings give {expected}.")
    out.table = df.groupBy(F.col(label).cast("string").alias(label)).agg(F.countDistinct(group).alias("n_groups"), F.count("*").alias("n_frames"))
    _labels(out, out.table, label)
    return out


def days(df: DataFrame, what: str, start: str = "start", need: list[str] | None = None) -> Check:
    """Contours or clicks by UTC day of their start in seconds."""
    out = Check()
    if missing := _missing(df, [start, *(need or [])]):
        return out.add("error", f"{what} need the columns {', '.join([start, *(need or [])])}; missing: {', '.join(missing)}.")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(start) / 86_400).cast("int")).cast("string")
    out.table = df.filter(F.col(start).isNotNull()).groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    r = out.table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("d"), F.min("day").alias("a"), F.max("day").alias("z")).head()
    return out.add("ok", f"{r.n} {what} on {r.d} days ({r.a} to {r.z}).") if r.n else out.add("error", f"No {what} found.")


def periods(df: DataFrame, label: str = "label", event: str = "event_id", start: str = "start", end: str = "end") -> Check:
    """Labelled periods (seconds): events, periods and hours by label."""
    out = Check()
    if missing := _missing(df, [label, event, start, end]):
        return out.add("error", f"Columns not found: {', '.join(missing)}.")
    hours = F.round(F.sum(F.col(end) - F.col(start)) / 3600, 2).alias("hours")
    out.table = df.groupBy(F.col(label).cast("string").alias(label)).agg(F.countDistinct(event).alias("n_groups"), F.count("*").alias("n_periods"), hours)
    r = df.agg(F.count("*").alias("n"), F.countDistinct(event).alias("e")).head()
    if not r.n:
        return out.add("error", "No annotations found.")
    got = _labels(out, out.table, label)
    out.messages.insert(0, ("ok", f"Periods: {r.n}. Events: {r.e}. Labels: {len(got)}."))
    return out


def calls(df: DataFrame, label: str = "label", start: str = "start", others: list[str] | None = None) -> Check:
    """Annotated calls: rows by label and UTC day; the values of further label columns."""
    out = days(df, "calls", start, [label, *(others or [])])
    if not out.ok:
        return out
    n_days = out.table.count()
    if n_days < 2:
        out.add("warn", "Annotations from one day only: verdicts need labels from more days or events.")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(start) / 86_400).cast("int")).cast("string")
    out.table = df.groupBy(label, day.alias("day")).agg(F.count("*").alias("n"))
    for c in [label, *(others or [])]:
        values = [str(r[0]) for r in df.select(c).dropna().distinct().orderBy(c).limit(MAX_LABELS + 1).collect()]
        out.info[c] = values
        if len(values) > MAX_LABELS:
            out.add("error", f"Column '{c}' has over {MAX_LABELS} values; it does not look like a label.")
    return out
