"""Validation queries: required cells, shapes, ranges, declared rules, record checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicegate import messages
from sluicegate.operators import reports, validate
from sluicegate.plans import records
from sluicegate.queries.base import query, table

# Orders told as training records; valid in both engines.
RECORDS = {
    "row_number": "o_orderkey",
    "employee_id": "concat('E', o_custkey)",
    "full_name": "CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE concat(' ', o_orderpriority) END",
    "email": "CASE o_orderstatus WHEN 'P' THEN concat('user', o_custkey) "
             "ELSE concat('user', o_custkey, '@example.com') END",
    "course_code": "substr(o_orderpriority, 1, 1)",
    "course_name": "CASE WHEN o_totalprice < 20000 THEN '' ELSE o_orderpriority END",
    "completion_date": "CASE WHEN o_totalprice > 450000 THEN '31.02.2026' "
                       "ELSE concat(substr(cast(o_orderdate AS string), 1, 8), '01') END",
    "score": "CASE WHEN o_totalprice < 40000 THEN '' WHEN o_totalprice > 440000 THEN 'abc' "
             "ELSE cast(cast(floor(o_totalprice / 4000) AS int) AS string) END",
}
_SQL_RECORDS = "SELECT " + ", ".join(
    f"{e.replace('string', 'VARCHAR')} AS {c}" for c, e in RECORDS.items()) + " FROM orders"
# The same records cleaned, as SQL text: the checks below start from it.
_CLEAN = f"""
    SELECT row_number, employee_id, trim(full_name) AS full_name, email, course_code, course_name,
           CASE WHEN completion_date NOT LIKE '31.%' THEN CAST(completion_date AS DATE) END AS completion_date,
           score AS score_text, TRY_CAST(score AS DOUBLE) AS score
    FROM ({_SQL_RECORDS})"""


def _error(field: str, message: str, where: str) -> str:
    return f"""SELECT row_number, '{field}' AS field_name, '{message}' AS error_message FROM clean WHERE {where}"""


_OWN_ERRORS = " UNION ALL ".join([
    _error("full_name", messages.REQUIRED.format(field="full_name"), "full_name = ''"),
    _error("course_name", messages.REQUIRED.format(field="course_name"), "course_name = ''"),
    _error("completion_date", messages.REQUIRED.format(field="completion_date"), "completion_date IS NULL"),
    _error("score", messages.REQUIRED.format(field="score"), "score_text = ''"),
    _error("email", messages.BAD_EMAIL, "email NOT LIKE '%@%.%'"),
    _error("completion_date", messages.BAD_DATE, "completion_date IS NULL"),
    _error("score", messages.BAD_SCORE,
           "score_text <> '' AND (score IS NULL OR score <> floor(score) OR score < 0 OR score > 100)"),
])


def _raw_records(spark, folder):
    return table(spark, folder, "orders").select(*[F.expr(e).alias(c) for c, e in RECORDS.items()])


def _validated(spark, folder):
    clean = records.normalize_records(_raw_records(spark, folder), "row_number")
    return validate.validate(clean, records.record_rules())


@query(f"WITH clean AS ({_CLEAN}) {_OWN_ERRORS}")
def validation_errors(spark, folder):
    return validate.error_table(_validated(spark, folder), "row_number")


@query(f"""
    WITH clean AS ({_CLEAN}), wrong AS ({_OWN_ERRORS})
    SELECT row_number, employee_id, full_name, email, course_code, course_name, completion_date, score
    FROM clean WHERE row_number NOT IN (SELECT row_number FROM wrong)""")
def valid_rows(spark, folder):
    return validate.valid_rows(_validated(spark, folder)).drop("score_text")


# Records already stored: those of orders before 1996.
_STORED = f"""
    SELECT employee_id, course_code, completion_date FROM ({_CLEAN})
    WHERE completion_date < DATE '1996-01-01'"""


@query(f"""
    WITH clean AS ({_CLEAN}), own AS ({_OWN_ERRORS}),
    keyed AS (
        SELECT *, count(*) OVER w AS copies, row_number() OVER (w ORDER BY row_number) AS place
        FROM clean WHERE completion_date IS NOT NULL
        WINDOW w AS (PARTITION BY employee_id, course_code, completion_date)),
    copies AS (
        SELECT row_number, CASE WHEN place = 1 THEN copies - 1 ELSE 1 END AS n FROM keyed WHERE copies > 1),
    good AS (
        SELECT * FROM clean WHERE row_number NOT IN (SELECT row_number FROM own)
          AND row_number NOT IN (SELECT row_number FROM copies)),
    found AS (
        SELECT DISTINCT employee_id, course_code, completion_date FROM good
        INTERSECT SELECT employee_id, course_code, completion_date FROM ({_STORED}))
    SELECT row_number, field_name, error_message FROM own
    UNION ALL
    SELECT row_number, '{messages.DUPLICATE_FIELD}', '{messages.DUPLICATE_IN_FILE}'
    FROM (SELECT row_number, unnest(range(n)) FROM copies)
    UNION ALL
    SELECT row_number, '{messages.DUPLICATE_FIELD}', '{messages.RECORD_EXISTS}'
    FROM clean JOIN found USING (employee_id, course_code, completion_date)""")
def record_errors(spark, folder):
    """Every check on training records at once: own errors, duplicates, stored keys."""
    raw = _raw_records(spark, folder)
    stored = records.normalize_records(raw).filter("completion_date < DATE '1996-01-01'").select(*records.RECORD_KEY)
    return records.record_errors(records.check_records(raw, stored, "row_number"), "row_number")


@query(r"""
    SELECT doc_id, token FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \t\n\r]+')) AS token FROM documents)
    WHERE regexp_matches(token, '^[^\s@]+@[^\s@]+\.[^\s@]+$')""")
def pattern_check(spark, folder):
    tokens = F.filter(F.split("text", r"[ \t\n\r]+"), lambda t: t.rlike(validate.EMAIL))
    return table(spark, folder, "documents").filter(F.contains("text", F.lit("@"))).select(
        "doc_id", F.explode(tokens).alias("token"))


def line_rules():
    quantity = F.col("l_quantity")
    return [
        validate.whole_between("l_quantity", quantity.cast("string"), quantity, 1, 45, "quantity is not within 1..45"),
        validate.between("l_discount", F.col("l_discount"), 0.0, 0.05, "discount is over 5 percent"),
    ]


LINE_ERRORS = """
    SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity' AS field_name,
           'quantity is not within 1..45' AS error_message
    FROM lineitem WHERE l_quantity < 1 OR l_quantity > 45 OR l_quantity <> floor(l_quantity)
    UNION ALL
    SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount', 'discount is over 5 percent'
    FROM lineitem WHERE l_discount < 0 OR l_discount > 0.05"""


def line_errors(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    return validate.error_table(
        validate.validate(lines, line_rules()), "l_orderkey", "l_linenumber", "l_partkey")


@query(LINE_ERRORS)
def range_check(spark, folder):
    return line_errors(spark, folder)


@query("""
    SELECT o_orderkey, 'o_orderstatus' AS field_name, 'unknown status' AS error_message
    FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
    UNION ALL SELECT o_orderkey, 'o_orderpriority', 'unknown priority'
    FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
    UNION ALL SELECT o_orderkey, 'o_custkey', 'not 3 digits' FROM orders WHERE length(CAST(o_custkey AS VARCHAR)) <> 3
    UNION ALL SELECT o_orderkey, 'o_orderpriority', 'too long' FROM orders WHERE length(o_orderpriority) > 8""")
def declared_rules(spark, folder):
    rules = [
        validate.one_of("o_orderstatus", F.col("o_orderstatus"), ("O", "F"), "unknown status"),
        validate.one_of("o_orderpriority", F.col("o_orderpriority"), ("1-URGENT", "2-HIGH", "3-MEDIUM"), "unknown priority"),
        validate.digits("o_custkey", F.col("o_custkey").cast("string"), 3, "not 3 digits"),
        validate.within_length("o_orderpriority", F.col("o_orderpriority"), 8, "too long"),
    ]
    return validate.error_table(validate.validate(table(spark, folder, "orders"), rules), "o_orderkey")


@query(f"""
    SELECT l_orderkey, total_rows, total_rows - coalesce(error_rows, 0) AS valid_rows, coalesce(error_rows, 0) AS error_rows
    FROM (SELECT l_orderkey, count(*) AS total_rows FROM lineitem GROUP BY l_orderkey)
    LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS error_rows
               FROM ({LINE_ERRORS}) GROUP BY l_orderkey) USING (l_orderkey)""")
def batch_summary(spark, folder):
    return reports.batch_summary(
        table(spark, folder, "lineitem"), line_errors(spark, folder), "l_orderkey", "l_linenumber")
