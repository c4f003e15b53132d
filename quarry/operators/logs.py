"""Logs and stack traces as line frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .scans import SPAN, Scan, running

#: Fixed value: where a record of a log begins.
BOUNDARY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]|^\[?(?:ERROR|WARN|FATAL)\b"
MARKER = text.MARKER


def numbered(lines: DataFrame, span: int = SPAN) -> DataFrame:
    """Lines with ``k``, their place in the log from 1 on."""
    return running(lines, {"k": Scan("sum", F.lit(1).cast("long"))}, span=span)


def segments(lines: DataFrame, most: int = 250, span: int = SPAN) -> DataFrame:
    """Lines with segment and part: a segment begins at a boundary; parts have at most ``most`` lines. One log may be many tasks' work."""
    begins = F.col("line").rlike(BOUNDARY)
    placed = running(numbered(lines, span), {"segment": Scan("sum", begins.cast("long")), "_first": Scan("max", F.when(begins, F.col("k")))}, span=span)
    return placed.withColumn("part", F.floor((F.col("k") - F.coalesce("_first", F.lit(1))) / most).cast("long")).drop("k", "_first")


def carried_times(lines: DataFrame, span: int = SPAN) -> DataFrame:
    """Lines with their own time, or else that of the last line that had one."""
    return running(lines, {"at": Scan("last", F.nullif(F.regexp_extract("line", text.TIMESTAMP, 0), F.lit("")))}, span=span)


def _near(marked: Column, before: int, after: int) -> tuple[dict[str, Scan], Column]:
    """Scans over numbered lines, and whether a line stands from ``before`` lines before a marked one to ``after`` behind it."""
    place = F.when(marked, F.col("k"))
    scans = {"_marked_before": Scan("max", place), "_marked_behind": Scan("next", place)}
    near = (F.col("k") - F.col("_marked_before") <= after) | (F.col("_marked_behind") - F.col("k") <= before)
    return scans, F.coalesce(near, F.col("_marked_before").isNotNull() & (F.col("k") - F.col("_marked_before") <= after), F.lit(False))


def around_markers(lines: DataFrame, before: int = 1, after: int = 5, span: int = SPAN) -> DataFrame:
    """Lines near a marker: from one before it to five after."""
    scans, near = _near(F.col("line").rlike(MARKER), before, after)
    return running(numbered(lines, span), scans, span=span).filter(near).drop("k", *scans)


def levels(lines: DataFrame) -> DataFrame:
    """Lines by level, in any case; WARNING counts as WARN, and a line may have several."""
    each = lines.select(F.explode(F.regexp_extract_all("line", F.lit(text.LEVEL), F.lit(0))).alias("level")).select(F.upper("level").alias("level"))
    return each.select(F.when(F.col("level") == "WARNING", "WARN").otherwise(F.col("level")).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def frame_keys(class_name: Column, method: Column) -> dict[str, Column]:
    """Package, class candidates and method candidates of a frame, as symbols are stored."""
    package = F.regexp_extract(class_name, r"^(.*)\.[^.]+$", 1)
    full = F.regexp_extract(class_name, r"([^.]+)$", 1)
    classes = F.array_distinct(F.array(full, F.substring_index(full, "$", 1), F.substring_index(full, "$", -1)))
    return {"package_name": package, "classes": classes, "methods": F.when(method.isin("<init>", "<clinit>"), F.array_distinct(F.concat(F.array(method), classes))).otherwise(F.array(method))}


def analysis(traces: DataFrame) -> DataFrame:
    """(trace_id, n_frames, n_app, first_app_method, detected) from frames in order."""
    app = text.is_application(F.col("class_name"))
    return traces.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.count_if(app).alias("n_app"),
        F.min_by(F.when(app, F.col("method_name")), F.when(app, F.col("frame_seq"))).alias("first_app_method"), (F.count(F.lit(1)) >= 2).alias("detected"),
    )


def first_seen(lines: DataFrame, pattern: str, most: int) -> DataFrame:
    """(log_id, found): distinct matches in the order in which they come, at most ``most``; only that many are ever gathered."""
    each = lines.select("log_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("at", "x"))
    once = each.groupBy("log_id", "x").agg(F.min(F.struct("line_no", "at")).alias("at"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("log_id").orderBy("at"))).filter(F.col("n") <= most)
    return ranked.groupBy("log_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda v: v["x"]).alias("found"))


def overview(lines: DataFrame) -> DataFrame:
    """Per log: lines with a marker, first and last time, first exception and last cause (null if there is none)."""
    none = lambda c: F.nullif(c, F.lit(""))
    at, thrown, cause = none(F.regexp_extract("line", text.TIMESTAMP, 0)), none(F.regexp_extract("line", text.TRACE_EXCEPTION, 0)), none(F.regexp_extract("line", text.CAUSE, 1))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    return lines.groupBy("log_id").agg(
        F.count_if(F.col("line").rlike(MARKER)).alias("error_line_count"), first(at).alias("first_at"), last(at).alias("last_at"), first(thrown).alias("first_exception"), last(cause).alias("last_cause"),
    )


def excerpt(lines: DataFrame, budget: int = 16_000, before: int = 1, after: int = 5, head: int = 80, tail: int = 20, span: int = SPAN) -> DataFrame:
    """(log_id, line_no, line): lines around markers that are spread over the whole log, within a budget of characters.

    With more markers than windows these are taken at even places; without any the first and
    last lines are. A line gets its share of the budget, but 200 characters, and 2000 at most.
    Only the lines chosen so far, a bounded number, meet in one task.
    """
    log = Window.partitionBy("log_id")
    order = log.orderBy("line_no")
    most = min(200, max(1, budget // 1200))
    marked = F.col("line").rlike(MARKER)
    sizes = lines.groupBy(F.col("log_id").alias("_log")).agg(F.count_if(marked).alias("n"), F.count(F.lit(1)).alias("total"))
    placed = running(lines.select("log_id", "line_no", "line", marked.alias("m")), {"k": Scan("sum", F.lit(1).cast("long")), "i": Scan("sum", F.col("m").cast("long"))}, span=span)
    rows = placed.join(sizes, F.col("log_id").eqNullSafe(F.col("_log"))).drop("_log").withColumn("i", F.col("i") - 1)
    # marker i is the p-th of ``most`` even places if p * (n - 1) / (most - 1) rounds to it
    p = F.bround(F.col("i") * (most - 1) / F.greatest(F.col("n") - 1, F.lit(1))) if most > 1 else F.lit(0)
    even = F.lit(False)
    for shift in (-1, 0, 1):
        place = p + shift
        even = even | ((place >= 0) & (place <= most - 1) & (F.bround(place * (F.col("n") - 1) / max(most - 1, 1)) == F.col("i")))
    scans, near = _near(F.col("m") & ((F.col("n") <= most) | even), before, after)
    rows = running(rows, scans, span=span).filter(F.when(F.col("n") > 0, near).otherwise((F.col("k") <= head) | (F.col("k") > F.col("total") - tail)))
    cap = F.least(F.greatest(F.floor(F.lit(budget) / F.count(F.lit(1)).over(log)), F.lit(200)), F.lit(2000)).cast("int")
    rows = rows.withColumn("cap", cap).withColumn("line", F.col("line").substr(F.lit(1), F.col("cap")))
    used = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("used", used).filter(F.col("used") < budget)
    return rows.select("log_id", "line_no", F.col("line").substr(F.lit(1), (F.lit(budget) - F.col("used")).cast("int")).alias("line"))


def records(lines: DataFrame, most: int = 250) -> DataFrame:
    """Records of a log (a segment, or a part of ``most`` lines) with their error's fields; a record's text is bounded by its lines."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    made = segments(lines, most).groupBy("log_id", "segment", "part").agg(F.min("line_no").alias("line_start"), F.count(F.lit(1)).alias("n_lines"), whole.alias("text"))
    none = lambda pattern, group=0: F.nullif(F.regexp_extract("text", pattern, group), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace("text", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]\S+", ""), r":[0-9]+\)", ":LINE)")
    return made.select(
        "log_id", "segment", "part", "line_start", "n_lines", F.substring("text", 1, 24000).alias("text"),
        none(text.JAVA_CODE.replace("(?U)", "")).alias("error_code"), none(r"\b[\w.]+(?:Exception|Error)\b").alias("exception_class"), none(r"\b(ERROR|WARN|FATAL|INFO|DEBUG)\b", 1).alias("severity"),
        none(r"Caused by:\s*[\w.]+(?:Exception|Error)(?::\s*[^\n]+)?").alias("root_cause"), F.substring(F.substring_index("text", "\n", 1), 1, 2000).alias("message"),
        F.sha2(F.substring(plain, 1, 4000), 256).alias("fingerprint"),
    )


def frames(trace: Column, prefixes: tuple[str, ...] = text.TRACE_PLATFORM) -> Column:
    """Stack frames of a trace, in order: class, package, method, file, line, and whether the application's."""
    at = lambda group: F.regexp_extract_all(trace, F.lit(text.JAVA_FRAME), F.lit(group))
    named = F.transform(F.arrays_zip(at(1).alias("c"), at(2).alias("m"), at(3).alias("p")), lambda f: F.struct(f["c"].alias("c"), f["m"].alias("m"), F.trim(f["p"]).alias("p")))
    unknown = lambda p: p.isin("Native Method", "Unknown Source", "")
    numbered = lambda p: p.rlike(r":[0-9]+$")
    return F.transform(named, lambda f: F.struct(
        f["c"].alias("class_name"), F.regexp_extract(f["c"], r"^(.*)\.[^.]+$", 1).alias("package_name"), f["m"].alias("method_name"),
        F.when(~unknown(f["p"]), F.regexp_replace(f["p"], r":[0-9]+$", "")).alias("file_name"),
        F.when(~unknown(f["p"]) & numbered(f["p"]), F.regexp_extract(f["p"], r":([0-9]+)$", 1).cast("long")).alias("line_number"), text.is_application(f["c"], prefixes).alias("is_app"),
    ))


def trace_fields(trace: Column) -> dict[str, Column]:
    """Of the text of a trace: frames, whether it is a trace, first exception, last cause with its message, codes, fingerprint."""
    every = lambda pattern, group=0: F.regexp_extract_all(trace, F.lit(pattern), F.lit(group))
    thrown, last = every(text.TRACE_EXCEPTION), lambda c: F.try_element_at(c, F.lit(-1))
    found = frames(trace)
    return {
        "frame_count": F.size(found).cast("long"), "app_frames": F.slice(F.filter(found, lambda f: f["is_app"]), 1, 100),
        "detected": (F.size(found) >= 2) | ((F.size(found) >= 1) & (F.size(thrown) > 0)), "primary_exception": F.try_element_at(thrown, F.lit(1)),
        "root_exception": last(every(text.CAUSE, 1)), "root_message": last(every(text.CAUSE, 2)), "exception_classes": F.slice(F.array_distinct(thrown), 1, 30),
        "error_codes": F.slice(F.array_distinct(every(text.TRACE_CODE)), 1, 30), "fingerprint": text.fingerprint(trace),
    }


def trace_query(trace: Column, fields: dict[str, Column], question: Column) -> Column:
    """A search query of 2000 characters at most: question, codes, exceptions, cause, the application's first frames, the trace's beginning."""
    said = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", ")))
    root = F.concat_ws(": ", fields["root_exception"], F.nullif(fields["root_message"], F.lit("")))
    place = lambda f: F.concat(F.lit("frame: "), f["class_name"], F.lit("."), f["method_name"], F.coalesce(F.concat(F.lit("("), f["file_name"], F.lit(":"), F.coalesce(f["line_number"].cast("string"), F.lit("")), F.lit(")")), F.lit("")))
    parts = F.concat(
        F.array(F.trim(question), said("codes: ", fields["error_codes"]), said("exceptions: ", fields["exception_classes"]), F.when(fields["root_exception"].isNotNull(), F.concat(F.lit("root cause: "), root))),
        F.transform(F.slice(fields["app_frames"], 1, 8), place), F.array(F.concat(F.lit("trace:\n"), F.substring(trace, 1, 700))),
    )
    return F.substring(F.array_join(F.array_compact(parts), "\n"), 1, 2000)


def search_query(lines: DataFrame, question: str) -> DataFrame:
    """(log_id, query): what to search for about a log, 2000 characters at most."""
    logs = lines.select("log_id").distinct()
    marked = lines.filter(F.col("line").rlike(MARKER)).groupBy("log_id", F.substring(F.trim("line"), 1, 500).alias("x")).agg(F.min("line_no").alias("at"))
    marked = marked.withColumn("n", F.row_number().over(Window.partitionBy("log_id").orderBy("at"))).filter("n <= 6")
    keys = marked.groupBy("log_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda v: v["x"]).alias("keys"))
    named = lambda pattern, c: first_seen(lines, pattern, 10).withColumnRenamed("found", c)
    rows = logs.join(named(text.TRACE_CODE, "codes"), "log_id", "left").join(named(text.TRACE_EXCEPTION, "types"), "log_id", "left").join(keys, "log_id", "left")
    said = F.concat_ws(
        "\n", F.lit(question), F.concat(F.lit("codes: "), F.array_join("codes", ", ")), F.concat(F.lit("exceptions: "), F.array_join("types", ", ")), F.concat(F.lit("lines:\n"), F.array_join("keys", "\n")),
    )
    return rows.select("log_id", F.substring(said, 1, 2000).alias("query"))
