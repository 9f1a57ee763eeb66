"""Timelines: groups, gaps, bursts, sessions, capped segments, as-of joins, events named in texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noema.operators import scan


def groups(rows: DataFrame, day: str, granularity: str) -> DataFrame:
    """key (year, month or day), count, mean confidence."""
    n = {"year": 4, "month": 7, "day": 10}[granularity]
    return rows.groupBy(F.substring(F.date_format(day, "yyyy-MM-dd"), 1, n).alias("key")).agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_conf"))


def of_months(named: DataFrame) -> DataFrame:
    """The timeline of what has a year and a month: each month with its label, how many it holds and its place, the latest first. Years below 0 are before our era; rows without a year are left out."""
    g = named.where("year is not null").groupBy("year", F.coalesce("month", F.lit(1)).alias("month")).agg(F.count("*").alias("n"))
    label = F.concat(F.when(F.col("year") < 0, "公元前").otherwise(""), F.abs("year").cast("string"), F.lit("年"), F.col("month").cast("string"), F.lit("月"))
    # one row a month
    return g.select("year", "month", label.alias("label"), "n", F.row_number().over(Window.orderBy(F.desc("year"), F.desc("month"))).alias("place"))


def gaps(days: DataFrame, over: int) -> DataFrame:
    """Neighbouring keys (day) more than ``over`` days apart. days holds one row a day, so the window is small by nature."""
    w = Window.orderBy("day")
    return days.select(F.lag("day").over(w).alias("before"), F.col("day").alias("after")).withColumn("days", F.datediff("after", "before")).where(F.col("days") > over)


def bursts(counts: DataFrame) -> DataFrame:
    """counts (key, n) with flag (n > 2.5 mean), burst (n > mean + 2 population deviations and at least 5) and multiple of the mean."""
    stats = counts.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("dev"))
    joined = counts.join(F.broadcast(stats))
    return joined.select("key", "n", (F.col("n") > 2.5 * F.col("mean")).alias("flag"), ((F.col("n") > F.col("mean") + 2 * F.col("dev")) & (F.col("n") >= 5)).alias("burst"), F.round(F.col("n") / F.col("mean"), 1).alias("multiple"))


def sessions(rows: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """Sessions of a key whose rows are at most ``minutes`` apart: start, end, rows. A key's rows are scanned in pieces, not in one window."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    # rows of one time are one step of the sequence
    steps = rows.groupBy(key, ts).agg(F.count("*").alias("_rows"))
    spaced = scan.neighbours(steps, key, ts, ts, name="_before")
    fresh = spaced.withColumn("_new", F.coalesce((micros(ts) - micros("_before") > minutes * 60_000_000).cast("long"), F.lit(1).cast("long")))
    numbered = scan.running(fresh, key, "_new", ts, name="session")
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.sum("_rows").alias("n"))


def capped_segments(rows: DataFrame, key: str, pause: float, cap: float) -> DataFrame:
    """Segments (key, start, stop, text) put together until a pause is longer or the length would pass the cap.

    The cap makes each step depend on the one before, but never across a pause:
    a key is split at its pauses, which are found and numbered in pieces of the key,
    and each run is folded in order, one row at a time.
    """
    order = ("start", "stop", "text")
    spaced = scan.neighbours(rows.select(key, *order), key, "stop", *order, name="_before")
    fresh = F.coalesce((F.col("start") - F.col("_before") > pause).cast("long"), F.lit(1).cast("long"))
    runs = scan.running(spaced.withColumn("_fresh", fresh).drop("_before"), key, "_fresh", *order, name="run")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        for b in batches:
            for k, run, start, stop, text in b.itertuples(index=False):
                text, own = "" if text is None else text, stop - start
                if now and now[:2] == [k, run] and now[5] + own <= cap:
                    now[3], now[4], now[5] = stop, [*now[4], text], now[5] + own
                    continue
                if now:
                    out.append((now[0], now[2], now[3], " ".join(now[4]), now[5]))
                now = [k, run, start, stop, [text], own]
            yield pd.DataFrame(out, columns=[key, "start", "stop", "text", "length"])
            out = []
        if now:
            yield pd.DataFrame([(now[0], now[2], now[3], " ".join(now[4]), now[5])], columns=[key, "start", "stop", "text", "length"])

    kind = T.StructType([rows.schema[key], *[T.StructField(c, T.StringType() if c == "text" else T.DoubleType()) for c in ("start", "stop", "text", "length")]])
    dealt = runs.select(key, "run", "start", "stop", "text").repartition(key, "run").sortWithinPartitions(key, "run", "start", "stop", "text")
    found = scan.running(dealt.mapInPandas(fold, kind).withColumn("_one", F.lit(1).cast("long")), key, "_one", *order, name="_n")
    return found.select(key, (F.col("_n") - 1).cast("int").alias("segment"), *order, F.round("length", 6).alias("length"))


def as_of(points: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """Each point (key, t) with the last boundary (key, at) no later than t, else the first; one sort by key and time, no range join, and a key with most rows is many tasks."""
    both = points.select(key, "t", "point", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("at")).unionByName(bounds.select(key, F.col("at").alias("t"), F.lit(None).cast("long").alias("point"), F.lit(0).alias("kind"), "at"))
    found = scan.last_known(both, key, "at", "t", "kind", name="bound").withColumn("bound", F.coalesce("bound", "least"))
    return found.where("kind = 1").select(key, "point", "t", "bound")


def events_in(text: F.Column) -> F.Column:
    """Year-month pairs that a text names as YYYY-MM or YYYY年M月, distinct and in order."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"(?<![0-9])([12][0-9]{3})-(0[1-9]|1[0-2])(?![0-9])"), F.lit(0)), F.transform(F.regexp_extract_all(text, F.lit(r"([12][0-9]{3})年(1[0-2]|[1-9])月"), F.lit(0)), lambda m: F.concat_ws("-", F.regexp_extract(m, r"^([0-9]{4})", 1), F.lpad(F.regexp_extract(m, r"年([0-9]+)月", 1), 2, "0"))))
    return F.array_sort(F.array_distinct(found))


def anchor(said: F.Column, today: F.Column) -> F.Column:
    """The first day that a relative expression means; null for others. Weeks begin on Monday."""
    monday = F.trunc(today, "week")
    names = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    days = {"today": today, "yesterday": F.date_sub(today, 1), "tomorrow": F.date_add(today, 1)}
    for unit, start in (("week", monday), ("month", F.trunc(today, "month")), ("quarter", F.trunc(today, "quarter")), ("year", F.trunc(today, "year"))):
        step = {"week": lambda x, n: F.date_add(x, 7 * n), "month": F.add_months, "quarter": lambda x, n: F.add_months(x, 3 * n), "year": lambda x, n: F.add_months(x, 12 * n)}[unit]
        days |= {f"last {unit}": step(start, -1), f"this {unit}": start, f"next {unit}": step(start, 1)}
    for k, name in enumerate(names):
        days |= {f"last {name}": F.date_add(monday, k - 7), f"this {name}": F.date_add(monday, k), f"next {name}": F.date_add(monday, k + 7)}
    out, low = F.lit(None).cast("date"), F.lower(F.trim(said))
    for name, day in days.items():
        out = F.when(low == name, day).otherwise(out)
    return out


def burst_records(items: DataFrame) -> DataFrame:
    """For each time key of items (key, category): n, how many times the mean it is (1 place), whether it is over 2.5 times the mean, whether it is recorded as a burst (over the mean and two population deviations, five at least), and its three commonest categories."""
    by = items.groupBy("key", "category").agg(F.count("*").alias("n"))
    # a key has few categories, and there are few keys
    g = by.groupBy("key").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "category"))), 1, 3).alias("some"))
    m = g.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("dev"))
    n = F.col("n")
    return g.join(F.broadcast(m)).select("key", "n", F.round(n / F.greatest("mean", F.lit(1)) + 1e-9, 1).alias("multiplier"), (n > 2.5 * F.col("mean")).alias("is_burst"), ((n > F.col("mean") + 2 * F.col("dev")) & (n >= 5)).alias("recorded"), F.array_join(F.transform("some", lambda x: x["category"]), ",").alias("top"))


def of_category(items: DataFrame, category: str, longest: int) -> DataFrame:
    """The months of items (key, category, confidence) that have the category, counted anew, with the marks of all items' months: a gap of over ``longest`` days to the next month, a burst over 2.5 times the mean."""
    g = items.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("category") == category).alias("of_category"), F.round(F.avg(F.when(F.col("category") == category, F.col("confidence"))), 6).alias("avg_conf"))
    day = F.to_date(F.concat("key", F.lit("-01")))
    # one row a month
    after = F.lead(day).over(Window.orderBy("key"))
    marked = g.select("*", F.coalesce(F.datediff(after, day) > longest, F.lit(False)).alias("is_gap"))
    m = g.agg(F.avg("n").alias("mean"))
    return marked.join(F.broadcast(m)).where("of_category > 0").select("key", "of_category", "avg_conf", "is_gap", (F.col("n") > 2.5 * F.col("mean")).alias("is_burst"))


def scene_chunks(segments: DataFrame, scenes: DataFrame, of: str) -> DataFrame:
    """One chunk of text for each scene of each recording.

    segments: of, start, stop, text; scenes: of, at (where one begins). A segment
    belongs to the last scene that begins no later than its middle, or to the
    first. Returns of, scene (from 1), n, label and content.
    """
    mid = (F.col("start") + F.col("stop")) / 2
    marks = scenes.select(of, F.col("at").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("stop"), F.lit(None).cast("string").alias("text"))
    both = segments.select(of, mid.cast("double").alias("t"), F.lit(1).alias("kind"), F.col("start").cast("double"), F.col("stop").cast("double"), "text").unionByName(marks.withColumn("t", F.col("t").cast("double")))
    begun = F.count_if(F.col("kind") == 0).over(Window.partitionBy(of).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("scene", F.greatest(begun, F.lit(1)).cast("int")).where("kind = 1")
    code = lambda x: F.format_string("%02d:%02d", F.floor(x / 60), F.floor(x) % 60)
    g = placed.groupBy(of, "scene").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("start", "stop", "text"))).alias("s"))
    label = F.concat(F.lit("["), code(F.col("s")[0]["start"]), F.lit("-"), code(F.element_at("s", -1)["stop"]), F.lit("]"))
    said = F.array_join(F.transform("s", lambda x: F.concat(F.lit("["), code(x["start"]), F.lit("] "), F.trim(F.coalesce(x["text"], F.lit(""))))), "\n")
    return g.select(of, "scene", "n", label.alias("label"), F.concat(F.lit("=== 场景 "), F.col("scene").cast("string"), F.lit(" "), label, F.lit(" ===\n\n[语音转写]\n\n"), said).alias("content"))


def qa_chunks(pairs: DataFrame, segments: DataFrame, of: str) -> DataFrame:
    """For each recording (of) one chunk of its questions and answers (of, at, question, answer), numbered after the chunks of its segments (of, chunks). Recordings without pairs have none."""
    said = F.concat(F.lit("Q: "), F.coalesce("question", F.lit("")), F.lit("\nA: "), F.coalesce("answer", F.lit("")), F.lit("\n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", said.alias("said")))), lambda x: x["said"]), "\n")
    whole = pairs.groupBy(of).agg(F.count("*").alias("pairs"), F.concat(F.lit("=== 问答对提取 ===\n"), lines).alias("content"))
    return whole.join(segments, of, "left").select(of, F.coalesce("chunks", F.lit(0)).alias("chunk_index"), "pairs", "content")


def segment_chunks(segments: DataFrame, of: str) -> DataFrame:
    """One chunk for each segment (of, start, stop, text) that says something: its times and its text."""
    code = lambda x: F.format_string("%02d:%02d", F.floor(x / 60), F.floor(x) % 60)
    text = F.trim("text")
    return segments.where(text != "").select(of, "start", F.concat(F.lit("["), code(F.col("start")), F.lit("-"), code(F.col("stop")), F.lit("] "), text).alias("content"))
