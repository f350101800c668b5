"""Report and diagnostic queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pareframe.functions import diagnostics
from pareframe.sources import files
from pareframe.sources.tables import table

TYPES = ["click", "error", "purchase", "signup", "view"]


def line_stats(spark: SparkSession, d: str) -> DataFrame:
    """Lines, blank lines and marked lines by language."""
    lines = table(spark, d, "documents").select("lang", F.explode(F.split("text", "\n", -1)).alias("line"))
    blank, marked = F.trim("line") == "", F.col("line").rlike("^(//|#|/\\*|\\*)")
    return lines.groupBy("lang").agg(F.count("*").alias("n_lines"), F.count_if(blank).alias("n_blank"), F.count_if(marked).alias("n_marked"), F.count_if(~blank & ~marked).alias("n_code"))


def first_last_stat(spark: SparkSession, d: str) -> DataFrame:
    """First and last value of each user and type of event."""
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))


def run_count(spark: SparkSession, d: str) -> DataFrame:
    """Clicks, and events over the value of 50, by user."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n_clicks"), F.count_if(F.col("value") > 50).alias("n_high"))


def stage_pivot(spark: SparkSession, d: str) -> DataFrame:
    """The last value of each stage as a column."""
    last = F.max_by("value", F.struct("ts", "event_id"))
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", TYPES).agg(last)


def duration_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Whole minutes from a user's first event to the last."""
    return table(spark, d, "events").groupBy("user_id").agg(F.timestamp_diff("MINUTE", F.min("ts"), F.max("ts")).alias("minutes"))


def reduction_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of customers that a filter keeps, by segment."""
    kept = F.count_if(F.col("c_acctbal") > 0)
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.try_divide(kept, F.count("*")), 6).alias("ratio"))


def json_decode(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the number ``k`` in events' JSON, 0 where there is none."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


def strip_comments(spark: SparkSession, d: str) -> DataFrame:
    """Pages without their comments."""
    rest = F.regexp_replace("html", "(?s)<!--.*?-->", "")
    return table(spark, d, "pages").select("page_id", F.md5(rest).alias("digest"), (F.char_length("html") - F.char_length(rest)).alias("n_removed"))


def stack_prefix(spark: SparkSession, d: str) -> DataFrame:
    """How many lines at the beginning of a document begin with T, and the last of them without it."""
    kept = diagnostics.stack_prefix(F.split("text", "\n", -1), "T")
    return table(spark, d, "documents").select("doc_id", kept.alias("kept")).where(F.size("kept") > 0).select("doc_id", F.size("kept").alias("n"), F.md5(F.element_at("kept", -1)).alias("last"))


def _diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Events as compiler messages: a letter, a position, a text, and a stack for errors."""
    rows = table(spark, d, "events")
    letter = F.when(F.col("event_type") == "error", "e").when(F.col("event_type") == "click", "w").when(F.col("event_type") == "view", "i").otherwise("x")
    place = F.concat(F.lit("file:///base/src/U"), F.col("user_id").cast("string"), F.lit(".kt:"), (F.col("event_id") % 90 + 1).cast("string"), F.lit(":"), (F.col("event_id") % 7 + 1).cast("string"))
    mark = F.when(F.col("event_id") % 5 == 0, "[ksp] ").otherwise("")
    stack = F.when(F.col("event_type") == "error", F.concat(F.lit("\n\tat a.B"), F.col("user_id").cast("string"), F.lit("\n\tat c.D"))).otherwise("")
    text = F.concat(mark, F.lit("bad "), F.col("event_type"), stack)
    return rows.select("event_id", letter.alias("letter"), place.alias("place"), text.alias("text"))


def diag_parse(spark: SparkSession, d: str) -> DataFrame:
    """Errors and unknown ones, and all with a stack, with their parts; positions relative to the base."""
    message, stack = diagnostics.split_message(F.col("text"))
    at = diagnostics.position(F.regexp_replace("place", "^file://", ""))
    kind = F.when(F.startswith("message", F.lit(diagnostics.PROCESSOR_MARK)), "ksp").when(F.col("stack").isNotNull(), "internal").otherwise("general")
    rows = _diagnostics(spark, d).withColumns({"message": message, "stack": stack}).withColumns({"kind": kind, "severity": diagnostics.severity(F.col("letter")), "at": at})
    kept = rows.where("kind = 'internal' OR severity IN ('ERROR', 'UNKNOWN')")
    frames = F.coalesce(F.size(F.split("stack", "\n")), F.lit(0))
    file = diagnostics.relative_path(F.col("at.file"), F.lit("/base")).alias("file")
    return kept.select("event_id", "kind", "severity", "message", file, "at.line", "at.col", F.when(F.col("stack").isNotNull(), frames).otherwise(0).alias("n_frames"))


#: Frames of a stack, by the type of an event.
_STACK = "\n\tat org.jetbrains.kotlin.a.{}\n\tat org.jetbrains.kotlin.b.Tail\n\tat java.lang.Other"


def _raw_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Events as build events of every form: message, description, letter, place."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", F.pmod("event_id", F.lit(8)).alias("form"))
    user = F.col("user_id").cast("string")
    stack = F.concat(F.lit(_STACK.split("{}")[0]), F.col("event_type"), F.lit(_STACK.split("{}")[1]))
    file = F.concat(F.lit("/base/src/U"), user, F.lit(".kt"))
    issue = F.lit(f": Back-end: {diagnostics.INTERNAL_ENDS}")
    new, old = (F.lit(x) for x in diagnostics.BACKEND_TYPES)
    analysis = F.lit(diagnostics.INTERNAL_STARTS[2])
    forms = [
        (F.concat(new, issue), F.concat(new, issue, F.lit("\n"), file, F.lit(":-1:-1\nDetails of "), user, stack)),
        (F.concat(old, F.lit(": while lowering")), F.concat(old, F.lit(": while lowering\nFile being compiled: "), file, F.lit("\nDetails of "), user, stack)),
        (F.concat(new, issue), F.concat(new, issue, F.lit("\n"), file, F.lit(":3:4\nno stack"))),
        (F.concat(analysis, F.lit(": While analysing")), F.concat(analysis, F.lit(": While analysing file://"), file, F.lit(":19:3: bad "), F.col("event_type"), stack)),
        (F.concat(F.lit("any "), F.lit(diagnostics.INTERNAL_ENDS)), F.concat(F.lit("Some.Type: whole text of "), user)),
        (F.concat(F.lit("[ksp] processor of "), user, stack), F.lit("")),
        (F.concat(F.lit("[ksp] without a stack "), user), F.lit("")),
        (F.concat(F.lit("Unresolved reference in "), file, F.lit(":1:2")), F.lit("")),
    ]
    pick = lambda i: F.element_at(F.array(*(f[i] for f in forms)), F.col("form").cast("int") + 1)
    letter = F.when(F.col("event_type") == "error", "e").when(F.col("event_type") == "click", "w").when(F.col("event_type") == "view", "i").otherwise("x")
    return rows.select("event_id", "user_id", "event_type", "form", pick(0).alias("message"), pick(1).alias("description"), letter.alias("letter"), F.concat(file, F.lit(":7:8")).alias("place"))


def diag_rules(spark: SparkSession, d: str) -> DataFrame:
    """What a build reports, parsed by the rules for each kind, with paths relative to the base."""
    rows = diagnostics.relativised(diagnostics.reported(diagnostics.parsed(_raw_diagnostics(spark, d))), F.lit("/base"))
    place = [F.coalesce(f"at.{x}", F.lit(0)).alias(x) for x in ("line", "col")]
    return rows.select("event_id", "kind", "severity", "text", "at.file", *place, F.size(F.split(F.coalesce("stack", F.lit("")), "\n")).alias("n_frames"))


def diag_same(spark: SparkSession, d: str) -> DataFrame:
    """Of each 32 events and form of message: whether the diagnostics of the first 16 are the same failure as those of the
    others, in order."""
    rows = diagnostics.reported(diagnostics.parsed(_raw_diagnostics(spark, d))).withColumn("block", F.floor(F.col("event_id") / 32).cast("long"))
    half = lambda i: rows.where(F.floor(F.pmod("event_id", F.lit(32)) / 16) == i)
    return diagnostics.same_failures(half(0), half(1), ["block", "form"], ["event_id"])


def relative_pages(spark: SparkSession, d: str) -> DataFrame:
    """Paths of pages, seen from two folders; a path must go up where it isn't below."""
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", ""))
    rows = table(spark, d, "pages").select("page_id", path.alias("path"))
    base = F.concat_ws("/", F.lit(""), F.element_at(F.split("path", "/"), 2), F.lit("other"))
    text = F.concat(F.lit("see file://"), F.col("path"), F.lit(":3:14, then go on"))
    return rows.select("page_id", diagnostics.relative_path(F.col("path"), base).alias("from_other"), diagnostics.relative(text, F.lit("/none")).alias("in_text"))


def edit_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of a conversation with the next, turn by turn; all characters beyond ASCII count as the same one."""
    rows, plain = table(spark, d, "conversations"), F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    a = rows.select("conv_id", "turn", plain.alias("a"))
    b = rows.select((F.col("conv_id") - 1).alias("conv_id"), "turn", plain.alias("b"))
    return diagnostics.similarity(a.join(b, ["conv_id", "turn"]), ["conv_id"], "turn", "a", "b")


def log_stats(spark: SparkSession, d: str) -> DataFrame:
    """Events as the log of each user: what lies between the first signup and the first purchase, and the numbers in it.

    Views write lines of another form; every seventh event has a number that can't be read, which counts as 0.
    """
    rows = table(spark, d, "events").withColumn("number", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    value = F.when(F.col("event_id") % 7 == 0, "none").otherwise(F.floor("value").cast("string"))
    line = F.concat(F.date_format("ts", "HH:mm:ss.SSS"), F.lit(" - "), F.col("event_type"), F.lit(" took value: "), value)
    lines = rows.select(F.col("user_id").alias("path"), "number", F.when(F.col("event_type") == "view", "a view").otherwise(line).alias("line"))
    inside = files.slice_log(files.log_entries(lines), "signup", "purchase")
    found = files.number_after(F.col("message"), "value:")
    return inside.groupBy("path").agg(F.count("*").alias("n"), F.sum(found).alias("total"), F.min_by(found, "number").alias("first_value"), F.max_by(found, "number").alias("last_value"))


def line_count_json(spark: SparkSession, d: str) -> DataFrame:
    """Line counts of documents through the JSON of a line counter; every tenth is broken and counts as nothing."""
    lines = F.split("text", "\n", -1)
    blank = F.size(F.filter(lines, lambda x: F.trim(x) == ""))
    sums = F.to_json(F.struct(F.struct(blank.alias("blank"), F.lit(0).alias("comment"), (F.size(lines) - blank).alias("code"), F.lit(1).alias("nFiles"), F.lit("x").alias("more")).alias("SUM")))
    rows = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 10 == 0, "{broken").otherwise(sums).alias("counts"))
    counted = files.line_counts(rows, "counts")
    return counted.groupBy("lang").agg(*(F.sum(x).alias(x) for x in ("blank", "code", "files", "total")))


QUERIES = {
    "log_stats": (
        log_stats,
        r"""WITH l AS (SELECT user_id AS path, event_type, CASE WHEN event_id % 7 = 0 THEN 0 ELSE CAST(floor(value) AS INT) END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events),
        e AS (SELECT * FROM l WHERE event_type <> 'view'),
        b AS (SELECT path, min(number) FILTER (WHERE event_type = 'signup') AS f, min(number) FILTER (WHERE event_type = 'purchase') AS t FROM e GROUP BY path)
        SELECT path, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, arg_min(v, number) AS first_value, arg_max(v, number) AS last_value FROM e JOIN b USING (path) WHERE number BETWEEN f AND t GROUP BY path""",
    ),
    "line_count_json": (
        line_count_json,
        r"""WITH l AS (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents),
        c AS (SELECT lang, doc_id % 10 <> 0 AS good, len(lines) AS n, len(list_filter(lines, lambda x: trim(x) = '')) AS blank FROM l)
        SELECT lang, CAST(sum(CASE WHEN good THEN blank ELSE 0 END) AS BIGINT) AS blank, CAST(sum(CASE WHEN good THEN n - blank ELSE 0 END) AS BIGINT) AS code,
            CAST(sum(CASE WHEN good THEN 1 ELSE 0 END) AS BIGINT) AS files, CAST(sum(CASE WHEN good THEN n ELSE 0 END) AS BIGINT) AS total FROM c GROUP BY lang""",
    ),
    "line_stats": (
        line_stats,
        r"""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents),
        f AS (SELECT lang, trim(line) = '' AS blank, regexp_matches(line, '^(//|#|/\*|\*)') AS marked FROM l)
        SELECT lang, count(*) AS n_lines, count(*) FILTER (WHERE blank) AS n_blank, count(*) FILTER (WHERE marked) AS n_marked, count(*) FILTER (WHERE NOT blank AND NOT marked) AS n_code FROM f GROUP BY lang""",
    ),
    "first_last_stat": (
        first_last_stat,
        "SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id, event_type",
    ),
    "run_count": (run_count, "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_clicks, count(*) FILTER (WHERE value > 50) AS n_high FROM events GROUP BY user_id"),
    "stage_pivot": (stage_pivot, "SELECT user_id, " + ", ".join(f"arg_max(value, (ts, event_id)) FILTER (WHERE event_type = '{x}') AS {x}" for x in TYPES) + " FROM events GROUP BY user_id"),
    "duration_minutes": (duration_minutes, "SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 60000000 AS minutes FROM events GROUP BY user_id"),
    "reduction_ratio": (reduction_ratio, "SELECT c_mktsegment, round(count(*) FILTER (WHERE c_acctbal > 0) / count(*), 6) AS ratio FROM customer GROUP BY c_mktsegment"),
    "json_decode": (
        json_decode,
        "SELECT event_type, CAST(sum(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY event_type",
    ),
    "strip_comments": (
        strip_comments,
        "WITH r AS (SELECT page_id, html, regexp_replace(html, '<!--.*?-->', '', 'gs') AS rest FROM pages) SELECT page_id, md5(rest) AS digest, CAST(length(html) - length(rest) AS INT) AS n_removed FROM r",
    ),
    "stack_prefix": (
        stack_prefix,
        """WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS lines FROM documents),
        e AS (SELECT doc_id, lines, list_position(list_transform(lines, lambda x: starts_with(x, 'T')), false) AS stop FROM l),
        n AS (SELECT doc_id, lines, CASE WHEN stop IS NULL OR stop = 0 THEN len(lines) ELSE stop - 1 END AS n FROM e)
        SELECT doc_id, CAST(n AS INT) AS n, md5(substr(lines[n], 2)) AS last FROM n WHERE n > 0""",
    ),
    "diag_parse": (
        diag_parse,
        """WITH p AS (SELECT event_id, event_type = 'error' AS err, event_type, user_id,
            CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' WHEN 'view' THEN 'INFO' ELSE 'UNKNOWN' END AS severity FROM events)
        SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'ksp' WHEN err THEN 'internal' ELSE 'general' END AS kind, severity,
            CASE WHEN event_id % 5 = 0 THEN '[ksp] ' ELSE '' END || 'bad ' || event_type AS message, 'src/U' || user_id || '.kt' AS file,
            CAST(event_id % 90 + 1 AS INT) AS line, CAST(event_id % 7 + 1 AS INT) AS col, CASE WHEN err THEN 2 ELSE 0 END AS n_frames
        FROM p WHERE severity IN ('ERROR', 'UNKNOWN')""",
    ),
    "diag_rules": (
        diag_rules,
        r"""WITH f AS (SELECT event_id, user_id, event_type, event_id % 8 AS form,
            CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' WHEN 'view' THEN 'INFO' ELSE 'UNKNOWN' END AS severity FROM events)
        SELECT event_id, ['backend', 'backend', NULL, 'internal', 'internal', 'ksp', NULL, 'general'][form + 1] AS kind, severity,
            ['Details of ' || user_id, 'Details of ' || user_id, NULL, 'While analysing file://src/U' || user_id || '.kt:19:3: bad ' || event_type,
             'whole text of ' || user_id, 'processor of ' || user_id, NULL, 'Unresolved reference in src/U' || user_id || '.kt:1:2'][form + 1] AS text,
            CASE WHEN form IN (0, 1, 7) THEN 'src/U' || user_id || '.kt' END AS file,
            CAST(CASE form WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 7 THEN 7 ELSE 0 END AS INT) AS line, CAST(CASE form WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 7 THEN 8 ELSE 0 END AS INT) AS col,
            CAST(CASE WHEN form IN (0, 1, 3, 5) THEN 3 ELSE 1 END AS INT) AS n_frames
        FROM f WHERE form NOT IN (2, 6) AND (form <> 7 OR severity IN ('ERROR', 'UNKNOWN'))""",
    ),
    "diag_same": (
        diag_same,
        # two of each form in a half: texts and first frames differ by a few characters, and one place may be empty
        r"""WITH f AS (SELECT event_id, event_id // 32 AS block, event_id % 32 // 16 AS half, event_id % 8 AS form, event_type, 'U' || user_id AS u, user_id, event_type AS t,
            CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' WHEN 'view' THEN 'INFO' ELSE 'UNKNOWN' END AS severity FROM events),
        k AS (SELECT *, row_number() OVER (PARTITION BY block, form, half ORDER BY event_id) AS i,
            CASE WHEN form IN (0, 1) THEN 'Details of ' || user_id WHEN form = 3 THEN 'While analysing file:///base/src/' || u || '.kt:19:3: bad ' || t
                 WHEN form = 4 THEN 'whole text of ' || user_id WHEN form = 5 THEN 'processor of ' || user_id ELSE 'Unresolved reference in /base/src/' || u || '.kt:1:2' END AS text
            FROM f WHERE form NOT IN (2, 6) AND (form <> 7 OR severity IN ('ERROR', 'UNKNOWN'))),
        p AS (SELECT coalesce(a.block, b.block) AS block, coalesce(a.form, b.form) AS form,
            CASE WHEN a.event_id IS NULL OR b.event_id IS NULL THEN false
                 WHEN a.form = 7 THEN a.text = b.text AND a.severity = b.severity
                 ELSE 1 - exp(-1) * levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text))
                      - CASE WHEN a.form = 4 THEN 0 ELSE exp(-2) * levenshtein('a.' || a.t, 'a.' || b.t) / greatest(length('a.' || a.t), length('a.' || b.t)) END > 0.95 END AS same
            FROM (SELECT * FROM k WHERE half = 0) a FULL JOIN (SELECT * FROM k WHERE half = 1) b ON a.block = b.block AND a.form = b.form AND a.i = b.i)
        SELECT block, form, bool_and(same) AS same FROM p GROUP BY block, form""",
    ),
    "relative_pages": (
        relative_pages,
        r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages),
        r AS (SELECT page_id, p, array_to_string(list_filter(string_split(p, '/'), lambda x: x <> ''), '/') AS plain FROM p)
        SELECT page_id, CASE WHEN strpos(plain, '/') = 0 THEN '..' ELSE '../' || substr(plain, strpos(plain, '/') + 1) END AS from_other,
            'see file://../' || plain || ':3:14, then go on' AS in_text FROM r""",
    ),
    "edit_similarity": (
        edit_similarity,
        r"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS t FROM conversations),
        z AS (SELECT a.conv_id, a.t AS a, b.t AS b, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn) AS i FROM c a JOIN c b ON b.conv_id = a.conv_id + 1 AND b.turn = a.turn),
        s AS (SELECT conv_id, 1 - sum(exp(-i) * CASE WHEN greatest(length(a), length(b)) = 0 THEN 0 ELSE levenshtein(a, b) / greatest(length(a), length(b)) END) AS s FROM z GROUP BY conv_id)
        SELECT conv_id, round(s, 6) AS similarity, s > 0.95 AS similar FROM s""",
    ),
}
