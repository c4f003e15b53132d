"""Text columns: identifiers, codes, frames, headings, names and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words in any script.
APART = r"[^\p{L}\p{N}]+"
#: Patterns of identifiers, error codes, exceptions, levels and times.
TOKEN = r"(?U)[\w.$/-]{3,}"
CODE = r"[A-Z]{2,10}-?[0-9]{3,6}[A-Z]?"
EXCEPTION = r"[A-Za-z_$][A-Za-z0-9_$.]*(?:Exception|Error)"
LEVEL = r"(?i)\b(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|SEVERE)\b"
MARKER = r"(?i)\b(?:ERROR|FATAL|CRITICAL|SEVERE|WARN(?:ING)?)\b|Traceback|Caused by:|Exception|Throwable|ORA-[0-9]{5}|SQLSTATE|SQLCODE|오류|실패"
TIMESTAMP = r"\b(?:[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]{1,9})?(?:Z|[+-][0-9]{2}:?[0-9]{2})?|[0-9]{8}\s+[0-9]{6}(?:[.,][0-9]{1,9})?)\b"
CAUSE = r"(?m)^\s*(?:Caused by:|Suppressed:)\s*((?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*(?:Exception|Error|Throwable))(?::\s*(.*))?$"
JAVA_FRAME = r"(?m)^\s*(?:at\s+)?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+)\.([\w$<>]+)\(([^)]*)\)"
TRACE_CODE = r"\b(?:ORA-[0-9]{5}|SQLSTATE[=: ]+[0-9A-Z]{5}|SQLCODE[=: ]+-?[0-9]+|[A-Z]{2,12}[-_]?[0-9]{3,8}[A-Z]?)\b"
TRACE_EXCEPTION = r"\b(?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*(?:Exception|Error|Throwable)\b"
#: Packages whose frames are not the application's.
PLATFORM = ("java.", "javax.", "jdk.", "sun.", "org.springframework.")
#: The longer list, of traces that are asked about.
TRACE_PLATFORM = (
    "java.", "javax.", "jdk.", "sun.", "com.sun.", "org.springframework.", "org.apache.", "weblogic.", "oracle.", "org.postgresql.",
    "com.mysql.", "com.microsoft.sqlserver.", "com.ibm.db2.",
)


def found(text: Column, pattern: str) -> Column:
    """All matches, first occurrences only, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def identifiers(text: Column, most: int = 8) -> Column:
    """Tokens that look like identifiers: with a digit, a dot, or a capital first."""
    likely = F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: t.rlike("[0-9.]") | t.rlike("^[A-Z]"))
    return F.slice(likely, 1, most)


def normal_name(name: Column) -> Column:
    """An entity's normal form: lower case, no white space, 300 characters at most."""
    return F.substring(F.lower(F.regexp_replace(name, r"(?U)\s+", "")), 1, 300)


def is_application(class_name: Column, prefixes: tuple[str, ...] = PLATFORM) -> Column:
    platform = F.lit(False)
    for prefix in prefixes:
        platform = platform | class_name.startswith(prefix)
    return ~platform


def fingerprint(trace: Column) -> Column:
    """Hash of a trace without its times and line numbers."""
    x = F.regexp_replace(trace, TIMESTAMP, "TIMESTAMP")
    x = F.regexp_replace(x, r":[0-9]+\)", ":LINE)")
    return F.sha2(F.substring(F.regexp_replace(x, r"\s+", " "), 1, 12000), 256)


def rough_tokens(text: Column) -> Column:
    """Two for each word."""
    return (F.regexp_count(text, F.lit(r"\S+")) * 2).cast("long")


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the words of a text, each with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), APART), lambda w: w != "")
    grams = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Trigram similarity of two texts; 0 if neither has a word."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


#: Forms of headings, the most specific first.
HEADINGS = {
    "appendix": r"^\[별표\s*[0-9]+(?:-[0-9]+)?\]\s*.+",
    "special_clause": r"^[0-9]+(?:-[0-9]+)+\s+.+특별약관",
    "section": r"^제[0-9]+관\s+.+",
    "article": r"제\s*[0-9]+(?:조의[0-9]+|조)(?:\s*\([^)]*\))?",
}


def heading(text: Column) -> Column:
    """The class of a heading line, or null; white space is collapsed first."""
    line = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    case = F
    for name, form in HEADINGS.items():
        case = case.when(line.rlike(form), name)
    return case


#: What an answer says that found too little.
INSUFFICIENT = (
    r"확인할 수 없", r"찾을 수 없", r"포함(?:되어|돼) 있지 않", r"포함되지 않", r"관련 (?:내용|정보|문서).{0,20}(?:없|부족)", r"(?:문서|근거|정보).{0,20}부족",
    r"does not contain", r"not found in (?:the )?(?:documents|sources)", r"insufficient (?:evidence|context)",
)
#: Words of an architecture, and of an activity.
ARCHITECTURE = (
    "구성도", "아키텍처", "architecture", "시스템 구성", "연계 구성", "내부망", "외부망", "인터넷망", "dmz", "서버", "engine", "was", "webtob", "database", " db", "api", "중계서버",
)
ACTIVITY = ("성능 테스트", "테스트 수행", "검증 수행", "모니터링 수행", "시험 계획")


def is_insufficient(answer: Column) -> Column:
    """Whether an answer says that there is too little evidence; white space is collapsed first."""
    return F.lower(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)\s+", " ")).rlike("|".join(INSUFFICIENT))


def architecture_points(content: Column, from_image: Column) -> Column:
    """Three for each word of an architecture, eight for text read from an image, less three for each of an activity."""
    lower = F.lower(content)
    held = lambda words: sum((F.contains(lower, F.lit(w)).cast("long") for w in words), F.lit(0).cast("long"))
    return 3 * held(ARCHITECTURE) + F.when(from_image, 8).otherwise(0) - 3 * held(ACTIVITY)


def ocr_engine(page_kind: Column, table_score: Column) -> Column:
    """None (null) for native text with a good table or none, the second engine for a bad table, else the first."""
    return F.when((page_kind == "native_text") & (table_score.isNull() | (table_score >= 0.9)), None).when(table_score < 0.75, "rapidocr").otherwise("easyocr")


def markdown_class(line: Column) -> Column:
    return (
        F.when(line.rlike(r"^```"), "fence").when(line.rlike(r"^#{1,6} "), "heading").when(line.rlike(r"^(?:---+|\*\*\*+)$"), "rule")
        .when(line.rlike(r"^\s*[-*] "), "bullet").when(line.rlike(r"^\s*[0-9]+[.)] "), "numbered").when(F.trim(line) == "", "blank").otherwise("text")
    )


def cover_density(words: Column, terms: list[str], near: int = 16) -> Column:
    """Sum over the shortest stretches that hold all terms: 1, or ``near`` / length for longer ones; 0 without terms.

    A stretch ends where the earliest of the terms' last places moves on, and begins there.
    """
    if not terms:
        return F.lit(0.0)
    terms = list(dict.fromkeys(terms))
    which = F.array(*map(F.lit, terms))
    places = F.filter(
        F.transform(words, lambda w, i: F.struct(i.alias("at"), F.array_position(which, w).cast("int").alias("t"))), lambda x: x["t"] > 0
    )
    state = "struct<last:array<int>,from:int,score:double>"
    start = F.struct(F.array(*[F.lit(-1) for _ in terms]).alias("last"), F.lit(-1).alias("from"), F.lit(0.0).alias("score")).cast(state)

    def step(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda v, i: F.when(i + 1 == x["t"], x["at"]).otherwise(v))
        first = F.array_min(last)
        new = first > s["from"]
        length = x["at"] - first + 1
        gain = F.when(new, F.when(length > near, F.lit(float(near)) / length).otherwise(1.0)).otherwise(0.0)
        return F.struct(last.alias("last"), F.greatest(first, s["from"]).alias("from"), (s["score"] + gain).alias("score")).cast(state)

    return F.aggregate(places, start, step)["score"]


#: Names of an incident's fields as they are written.
INCIDENT_FIELDS = {
    "장애번호": "incident_id", "incident_id": "incident_id", "시스템": "system", "system": "system", "제품": "product", "product": "product", "버전": "version", "version": "version",
    "증상": "symptom", "symptom": "symptom", "원인": "cause", "cause": "cause", "조치": "action", "action": "action", "결과": "result", "result": "result",
}
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: A field of an incident; exceptions and codes in Java code.
_KEYED = r"(?U)^\s*([^:：]{1,40})\s*[:：]\s*(.+?)\s*$"
JAVA_EXCEPTION = r"(?U)\b(?:[A-Za-z_$][\w.$]*)?(?:Exception|Error|Throwable)\b"
JAVA_CODE = r"(?U)\b(?:ORA-\d{5}|SQLSTATE[=: ]+[0-9A-Z]{5}|[A-Z]{3,8}\d{3,6}[A-Z]?|SQLCODE[=: ]+-?\d+)\b"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blocks(text: Column) -> Column:
    """Parts of a text between blank lines, stripped; empty ones don't count."""
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda b: b != "")


def incident_fields(block: Column) -> Column:
    """An incident's eight fields from ``key: value`` lines, as an array of one struct; the last of a key wins."""
    known = F.create_map(*[F.lit(x) for pair in INCIDENT_FIELDS.items() for x in pair])
    pairs = F.transform(F.split(block, LINE_END), lambda ln: F.struct(
        F.try_element_at(known, F.lower(strip(F.regexp_extract(ln, _KEYED, 1)))).alias("key"), strip(F.regexp_extract(ln, _KEYED, 2)).alias("value"),
    ))
    of = lambda ps, k: F.try_element_at(F.filter(ps, lambda p: p["key"] == k), F.lit(-1))["value"]
    # an array of one array, so that lines are read once and not for each field
    return F.transform(F.array(pairs), lambda ps: F.struct(*[of(ps, k).alias(k) for k in dict.fromkeys(INCIDENT_FIELDS.values())]))


def java_diagnostics(code: Column, signature: Column, symbol_name: Column, symbol_type: Column) -> dict[str, Column]:
    """Exceptions that Java code refers to, declares, throws and catches, its error codes, and whether it is an exception."""
    known = lambda c: F.array_sort(F.array_distinct(c))
    every = lambda c, pattern, group=0: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    inside = lambda c, pattern: known(F.flatten(F.transform(every(c, pattern, 1), lambda x: every(x, JAVA_EXCEPTION))))
    searchable = F.concat(F.coalesce(signature, F.lit("")), F.lit("\n"), code)
    extends = F.concat(F.lit(r"(?U)\bclass\s+\Q"), symbol_name, F.lit(r"\E\b[^{;]*\bextends\s+[\w.$]*(?:Exception|Error|Throwable)\b"))
    named = (symbol_type == "class") & (symbol_name != "") & (symbol_name.rlike("(?:Exception|Error|Throwable)$") | F.regexp_like(code, extends))
    return {
        "exception_types": known(every(searchable, JAVA_EXCEPTION)),
        "declared_exceptions": inside(searchable, r"(?U)\bthrows\s+([^{;\n]+)"),
        "thrown_exceptions": known(every(code, r"(?U)\bthrow\s+new\s+([A-Za-z_$][\w.$]*(?:Exception|Error|Throwable))\b", 1)),
        "caught_exceptions": inside(code, r"(?U)\bcatch\s*\(([^)]*)\)"),
        "error_codes": known(every(code, JAVA_CODE)),
        "is_exception_class": F.coalesce(named, F.lit(False)),
    }
