"""One query for each operator, over whole tables, with its DuckDB equivalent."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import register
from ..operators import frame
from ..operators.base import BaseCleaner
from ..operators.country import CountryCleaner, CountryFormat
from ..operators.custom import PythonCleaner
from ..operators.extra import (
    AddressLineCleaner, BusinessCleaner, CreditCardCleaner, CurrencyCleaner, GstinCleaner, LanguageCodeCleaner, MacAddressCleaner, ScaleCleaner, UrlCleaner,
)
from ..operators.naming import CASES, ColRenamer
from ..operators.phone import PhoneCleaner, PhoneFormat
from ..operators.text import EmailCleaner, TextCleaner
from ..operators.times import DateTimeCleaner, TimeFormat
from ..operators.values import BoolCleaner, GenderCleaner, GenderFormat, NumberFormat, NumericCleaner, TruthFormat, UuidCleaner, UuidFormat
from ..sources.wrap import without_na
from ..streaming.stream import clean_stream
from .clean import clean, plan
from .detect import assign
from .pipeline import Pipeline, address

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def column(name: str, source: str, key: str, cleaner: BaseCleaner, of: Callable[[], Column] | str, sql: str) -> None:
    """A query of one cleaner: the key and what it makes of a column. sql: the same
    expression, or one for each component."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = F.col(of) if isinstance(of, str) else of()
        made = cleaner.expressions(value)
        return table(spark, sf_dir, source).select(key, *[v.alias(k or "cleaned") for k, v in made.items()])

    add(name, run, f"SELECT {key}, {sql} FROM {source}")


# ---- text -----------------------------------------------------------------------------
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def text_sql(c: str, html=True, urls=True, emails=True, digits=False, punctuation=False, spaces=True, lower=True) -> str:
    def gone(pattern: str, by: str = "") -> None:
        nonlocal c
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"

    if html:
        gone("<[^>]+>", " ")
    if urls:
        gone(rf"https?://[^{WS}]+|www\.[^{WS}]+")
    if emails:
        gone(rf"[^{WS}]+@[^{WS}]+")
    if digits:
        gone(r"\p{Nd}+")
    if punctuation:
        gone(rf"[^\p{{L}}\p{{N}}_{WS}]")
    gone(r"[\x00-\x1f\x7f-\x{9f}]" if spaces else r"[\x00-\x08\x0a-\x1f\x7f-\x{9f}]", " " if spaces else "")
    gone(f"[{WS}]+", " ")
    c = f"trim({c}, ' ')"
    return f"nullif({f'lower({c})' if lower else c}, '') AS cleaned"


for name, source, key, of, options, switches in (
    ("text_default", "documents", "doc_id", "text", {}, {}),
    ("text_html", "pages", "page_id", "html", {}, {}),
    ("text_digits_punct", "documents", "doc_id", "text", {"remove_digits": True, "remove_punctuation": True}, {"digits": True, "punctuation": True}),
    ("text_keep_newlines_off", "documents", "doc_id", "text", {"replace_newlines_with_spaces": False}, {"spaces": False}),
    ("text_no_lower", "documents", "doc_id", "text", {"lowercase": False}, {"lower": False}),
    ("text_keep_markup", "pages", "page_id", "html", {"remove_html": False, "remove_urls": False, "remove_emails": False}, {"html": False, "urls": False, "emails": False}),
):
    column(name, source, key, TextCleaner(**options), of, text_sql(of, **switches))

# ---- e-mail ---------------------------------------------------------------------------
MAIL = r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
column("email_default", "documents", "doc_id", EmailCleaner(), "text", f"nullif(lower(regexp_extract(text, '{MAIL}', 0)), '') AS cleaned")


def tagged() -> Column:
    return F.concat(F.lit("U."), F.col("c_custkey").cast("string"), F.lit("+T@Ex.Com"))


column("email_tags", "customer", "c_custkey", EmailCleaner(), tagged, "'u.' || c_custkey || '+t@ex.com' AS cleaned")
column("email_no_tags", "customer", "c_custkey", EmailCleaner(keep_tags=False), tagged, "'u.' || c_custkey || '@ex.com' AS cleaned")
column("email_no_dots", "customer", "c_custkey", EmailCleaner(keep_dots=False), tagged, "'u' || c_custkey || '+t@ex.com' AS cleaned")
column("email_no_lower", "customer", "c_custkey", EmailCleaner(lowercase=False), tagged, "'U.' || c_custkey || '+T@Ex.Com' AS cleaned")
column("email_split", "customer", "c_custkey", EmailCleaner(split_components=True), tagged, "'u.' || c_custkey AS local, 't' AS tag, 'ex.com' AS domain")

# ---- phone ----------------------------------------------------------------------------
FIVE = "lpad((c_custkey % 100000)::VARCHAR, 5, '0')"


def five() -> Column:
    return F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")


column("phone_e164", "customer", "c_custkey", PhoneCleaner(), lambda: F.concat(F.lit("+91 98765 "), five()), f"'+9198765' || {FIVE} AS cleaned")
for out_format, shape in ((PhoneFormat.INTERNATIONAL, "'+91 98765 ' || "), (PhoneFormat.NATIONAL, "'098765 ' || "), (PhoneFormat.RAW_DIGITS, "'9198765' || ")):
    column(f"phone_{out_format.value}", "customer", "c_custkey", PhoneCleaner(out_format=out_format, default_regions=("IN",)), lambda: F.concat(F.lit("call 98765-"), five()), f"{shape}{FIVE} AS cleaned")
column("phone_scientific", "customer", "c_custkey", PhoneCleaner(default_regions=("IN",)), lambda: F.concat(F.lit("9.8765"), five(), F.lit("E+09")), f"'+9198765' || {FIVE} AS cleaned")
column("phone_regions", "customer", "c_custkey", PhoneCleaner(default_regions=("US", "IN")), lambda: F.concat(F.lit("(415) 55"), F.substring(five(), 2, 1), F.lit("-"), F.substring(five(), 2, 4)), f"'+141555' || substr({FIVE}, 2, 1) || substr({FIVE}, 2, 4) AS cleaned")
RUN = r"\+?\(?\d[\d" + WS + r"().\-/]{4,}\d"
column(
    "phone_documents",
    "documents",
    "doc_id",
    PhoneCleaner(),
    "text",
    f"""CASE WHEN regexp_extract(text, '{RUN}') LIKE '+1%'
      AND regexp_matches(regexp_replace(regexp_extract(text, '{RUN}'), '[^0-9]', '', 'g'), '^1[2-9][0-8][0-9][2-9][0-9]{{6}}$')
      AND NOT regexp_matches(regexp_replace(regexp_extract(text, '{RUN}'), '[^0-9]', '', 'g'), '^1[0-9]11')
      THEN '+' || regexp_replace(regexp_extract(text, '{RUN}'), '[^0-9]', '', 'g') END AS cleaned""",
)

# ---- numbers --------------------------------------------------------------------------
LINE = "l_orderkey, l_linenumber"


def line(name: str, cleaner: BaseCleaner, of: Callable[[], Column], sql: str) -> None:
    add(name, lambda spark, sf_dir: table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cleaner.clean_expr(of()).alias("cleaned")), f"SELECT {LINE}, {sql} AS cleaned FROM lineitem")


def priced(sign: str) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(sign), F.col("l_extendedprice").cast("string"))


line("num_float", NumericCleaner(), priced("₹ "), "l_extendedprice")
line("num_int", NumericCleaner(out_format=NumberFormat.INT), priced("$-"), "-trunc(l_extendedprice)::BIGINT")
line("num_precision", NumericCleaner(precision=1), priced("$"), "round(l_extendedprice::VARCHAR::DECIMAL(18,4), 1)::DOUBLE")
line("num_no_precision", NumericCleaner(precision=None), lambda: F.concat(F.col("l_tax").cast("string"), F.lit(" x")), "l_tax")
line("num_dots", NumericCleaner(precision=None), lambda: F.regexp_replace(F.col("l_discount").cast("string"), r"\.", ".."), "l_discount")
column("num_suffix", "part", "p_partkey", NumericCleaner(parse_suffixes=True), lambda: F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("", "k", " M", "b", "T"))), (F.col("p_partkey") % 5 + 1).cast("int"))), "p_size * CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1e3 WHEN 2 THEN 1e6 WHEN 3 THEN 1e9 ELSE 1e12 END::DOUBLE AS cleaned")
column("num_misses", "part", "p_partkey", NumericCleaner(), "p_brand", "CASE WHEN regexp_replace(lower(p_brand), '[^0-9.e+-]', '', 'g') SIMILAR TO '[+-]?[0-9]+' THEN regexp_replace(lower(p_brand), '[^0-9.e+-]', '', 'g')::DOUBLE END AS cleaned")

# ---- truth values and genders ---------------------------------------------------------
for form, (yes, no) in ((TruthFormat.TRUEFALSE, ("true", "false")), (TruthFormat.BINARY, ("'1'", "'0'")), (TruthFormat.YESNO, ("'Yes'", "'No'"))):
    line(f"bool_{form.value}", BoolCleaner(out_format=form), lambda: F.coalesce(F.when(F.col("l_returnflag") == "A", "Yes"), F.col("l_returnflag")), f"CASE l_returnflag WHEN 'A' THEN {yes} WHEN 'N' THEN {no} END")
for form, (female, other) in ((GenderFormat.FULL, ("Female", "Other")), (GenderFormat.CHAR, ("F", "O")), (GenderFormat.BINARY, ("0", "-1"))):
    line(f"gender_{form.value}", GenderCleaner(out_format=form), lambda: F.col("l_linestatus"), f"CASE l_linestatus WHEN 'F' THEN '{female}' WHEN 'O' THEN '{other}' END")

# ---- UUIDs ----------------------------------------------------------------------------
DASHED = "regexp_replace(md5(o_orderkey::VARCHAR), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5')"


def hashed(*around: str) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(around[0]), F.upper(F.md5(F.col("o_orderkey").cast("string"))), F.lit(around[1]))


column("uuid_standard", "orders", "o_orderkey", UuidCleaner(), hashed("{", "}"), f"{DASHED} AS cleaned")
column("uuid_compact", "orders", "o_orderkey", UuidCleaner(out_format=UuidFormat.COMPACT), hashed("urn:uuid:", ""), "md5(o_orderkey::VARCHAR) AS cleaned")
column("uuid_urn", "orders", "o_orderkey", UuidCleaner(out_format=UuidFormat.URN), hashed("'", "'"), f"'urn:uuid:' || {DASHED} AS cleaned")
column(
    "uuid_version",
    "orders",
    "o_orderkey",
    UuidCleaner(allowed_versions=frozenset({1, 4})),
    hashed("", ""),
    f"CASE WHEN substr(md5(o_orderkey::VARCHAR), 17, 1) IN ('8', '9', 'a', 'b') AND substr(md5(o_orderkey::VARCHAR), 13, 1) IN ('1', '4') THEN {DASHED} END AS cleaned",
)

# ---- dates ----------------------------------------------------------------------------
WRITTEN = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "HH:mm:ss", "hh:mm a")


def dated() -> Column:
    return F.element_at(F.array(*[F.date_format("o_orderdate", p) for p in WRITTEN]), (F.col("o_orderkey") % 7 + 1).cast("int"))


DATE, ALONE = "strftime(o_orderdate, '{}')", "o_orderkey % 7 >= 5"
TIME = "CASE WHEN o_orderkey % 7 IN (0, 1, 5) THEN strftime(o_orderdate, '%H:%M:%S') WHEN o_orderkey % 7 = 6 THEN strftime(o_orderdate, '%H:%M:00') ELSE '00:00:00' END"
for form, sql in (
    (TimeFormat.ISO_DATETIME, f"CASE WHEN {ALONE} THEN '0001-01-01' ELSE {DATE.format('%Y-%m-%d')} END || 'T' || {TIME}"),
    (TimeFormat.ISO_DATE, f"CASE WHEN NOT {ALONE} THEN {DATE.format('%Y-%m-%d')} END"),
    (TimeFormat.ISO_TIME, TIME),
    (TimeFormat.INDIAN_DATE, f"CASE WHEN NOT {ALONE} THEN {DATE.format('%d-%m-%Y')} END"),
):
    column(f"dt_{form.value}", "orders", "o_orderkey", DateTimeCleaner(out_format=form), dated, f"{sql} AS cleaned")

# ---- countries ------------------------------------------------------------------------
#: What nation k writes, and the country meant: alpha-2, alpha-3, name.
PLACES = (
    ("IN", ("IN", "IND", "India")), ("IND", ("IN", "IND", "India")), ("india", ("IN", "IND", "India")), ("NotACountry", None), ("us", ("US", "USA", "United States")),
    ("United States", ("US", "USA", "United States")), ("XYZ", None), ("Deutschland", None), ("DEU", ("DE", "DEU", "Germany")), ("France", ("FR", "FRA", "France")),
    ("great britain", ("GB", "GBR", "United Kingdom")), ("Russia", ("RU", "RUS", "Russian Federation")), ("BRAZIL", ("BR", "BRA", "Brazil")),
)


def place() -> Column:
    return F.element_at(F.array(*[F.lit(p) for p, _ in PLACES]), (F.col("n_nationkey") % len(PLACES) + 1).cast("int"))


def place_sql(k: int, known: Callable[[str], bool] = lambda p: True) -> str:
    cases = " ".join(f"WHEN {i} THEN '{meant[k]}'" for i, (p, meant) in enumerate(PLACES) if meant and known(p))
    return f"CASE n_nationkey % {len(PLACES)} {cases} END AS cleaned"


for k, form in enumerate((CountryFormat.ALPHA2, CountryFormat.ALPHA3, CountryFormat.NAME)):
    column(f"country_{form.value}", "nation", "n_nationkey", CountryCleaner(out_format=form), place, place_sql(k))
column("country_in_alpha3", "nation", "n_nationkey", CountryCleaner(in_format=CountryFormat.ALPHA3), place, place_sql(2, lambda p: p in ("IND", "DEU")))
column("country_in_order", "nation", "n_nationkey", CountryCleaner(in_format=(CountryFormat.ALPHA3, CountryFormat.ALPHA2)), place, place_sql(2, lambda p: p in ("IN", "IND", "DEU", "us")))

# ---- names ----------------------------------------------------------------------------
#: nation's columns in every case.
NAMES = {
    "snake": ("n_nation_key", "n_name", "n_region_key"), "upper_snake": ("N_NATION_KEY", "N_NAME", "N_REGION_KEY"), "upper": ("NNATIONKEY", "NNAME", "NREGIONKEY"),
    "lower": ("nnationkey", "nname", "nregionkey"), "pascal": ("NNationKey", "NName", "NRegionKey"), "camel": ("nNationKey", "nName", "nRegionKey"),
    "kebab": ("n-nation-key", "n-name", "n-region-key"), "train": ("N-Nation-Key", "N-Name", "N-Region-Key"), "cobol": ("N-NATION-KEY", "N-NAME", "N-REGION-KEY"),
}
for case in CASES:
    add(
        f"rename_{case}",
        lambda spark, sf_dir, case=case: frame.rename_cols(df := table(spark, sf_dir, "nation"), ColRenamer(case).rename_cols(df.columns)),
        "SELECT " + ", ".join(f'{old} AS "{new}"' for old, new in zip(("n_nationkey", "n_name", "n_regionkey"), NAMES[case], strict=True)) + " FROM nation",
    )
add("rename_swap", lambda spark, sf_dir: frame.rename_cols(table(spark, sf_dir, "nation"), {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey"}), "SELECT n_nationkey AS n_regionkey, n_name, n_regionkey AS n_nationkey FROM nation")

# ---- dataflow primitives ---------------------------------------------------------------
W = frame.DataWriter
add("cols", lambda spark, sf_dir: spark.createDataFrame(frame.cols(table(spark, sf_dir, "orders")), "name string, kind string"), "SELECT * FROM (VALUES ('o_orderkey', 'int'), ('o_custkey', 'int'), ('o_orderstatus', 'str'), ('o_totalprice', 'double'), ('o_orderdate', 'str'), ('o_orderpriority', 'str')) t(name, kind)")
add("write_literal", lambda spark, sf_dir: frame.write_cols(table(spark, sf_dir, "customer"), [W("x", (), (("a", "str"),)), W(7, (), (("b", "int"), ("c", "double"))), W(None, (), (("d", "bool"),))]).select("c_custkey", "a", "b", "c", "d"), "SELECT c_custkey, 'x' AS a, 7::BIGINT AS b, 7::DOUBLE AS c, NULL::BOOLEAN AS d FROM customer")
add("write_single", lambda spark, sf_dir: frame.write_cols(table(spark, sf_dir, "customer"), [W(lambda name, key: f"{name}/{key}", ("c_name", "c_custkey"), (("c_name", "str"),))]), "SELECT c_custkey, c_name || '/' || c_custkey AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
add("write_multi", lambda spark, sf_dir: frame.write_cols(table(spark, sf_dir, "part"), [W(lambda size: None if size % 2 else (size * 2, f"s{size}"), ("p_size",), (("twice", "int"), ("label", "str")))]).select("p_partkey", "twice", "label"), "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 2 * p_size END::BIGINT AS twice, CASE WHEN p_size % 2 = 0 THEN 's' || p_size END AS label FROM part")
add("write_column", lambda spark, sf_dir: frame.write_cols(table(spark, sf_dir, "part"), [W(F.col("p_size") + 1, ("p_size",), (("p_size", "int"),)), W(F.col("p_size") * 10, ("p_size",), (("ten", "int"),))]).select("p_partkey", "p_size", "ten"), "SELECT p_partkey, (p_size + 1)::BIGINT AS p_size, ((p_size + 1) * 10)::BIGINT AS ten FROM part")
add("remove_cols", lambda spark, sf_dir: frame.remove_cols(table(spark, sf_dir, "customer"), ["c_name", "no_such"]), "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
add("cast_cols", lambda spark, sf_dir: frame.cast_cols(table(spark, sf_dir, "customer"), {"c_acctbal": "str", "c_nationkey": "float"}).select("c_custkey", "c_acctbal", "c_nationkey"), "SELECT c_custkey, c_acctbal::VARCHAR AS c_acctbal, c_nationkey::DOUBLE AS c_nationkey FROM customer")
add("cast_cols_safe", lambda spark, sf_dir: frame.cast_cols(table(spark, sf_dir, "customer"), {"c_mktsegment": "int"}, safe=True).select("c_custkey", "c_mktsegment"), "SELECT c_custkey, TRY_CAST(c_mktsegment AS BIGINT) AS c_mktsegment FROM customer")
add("profile_cols", lambda spark, sf_dir: spark.createDataFrame(frame.profile(table(spark, sf_dir, "region").orderBy("r_regionkey"), ["r_regionkey", "r_name"], 3), "r_regionkey int, r_name string"), "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 3")
add("na_tokens", lambda spark, sf_dir: without_na(table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "N/A").otherwise(F.col("o_orderstatus")).alias("v"))), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS v FROM orders")


# ---- detection -------------------------------------------------------------------------
def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clean import default_cleaners

    rows = []
    for name in ("customer", "orders", "part", "documents"):
        df = table(spark, sf_dir, name)
        rows += [(name, c, type(k).__name__ if k else None, round(s, 6)) for c, (k, s) in assign(df, df.columns, default_cleaners()).items()]
    return spark.createDataFrame(rows, "tab string, col string, cleaner string, confidence double")


add(
    "detect_assignments",
    detected,
    """SELECT tab, col, cleaner, confidence::DOUBLE AS confidence FROM (VALUES
  ('customer', 'c_custkey', 'NumericCleaner', 0.7), ('customer', 'c_name', 'TextCleaner', 0.1), ('customer', 'c_nationkey', 'NumericCleaner', 0.7),
  ('customer', 'c_acctbal', 'NumericCleaner', 0.7), ('customer', 'c_mktsegment', 'TextCleaner', 0.1),
  ('orders', 'o_orderkey', 'NumericCleaner', 0.7), ('orders', 'o_custkey', 'NumericCleaner', 0.7), ('orders', 'o_orderstatus', 'BoolCleaner', 1.0),
  ('orders', 'o_totalprice', 'NumericCleaner', 1.0), ('orders', 'o_orderdate', 'DateTimeCleaner', 1.0), ('orders', 'o_orderpriority', 'TextCleaner', 0.1),
  ('part', 'p_partkey', 'NumericCleaner', 0.7), ('part', 'p_name', 'TextCleaner', 0.1), ('part', 'p_brand', 'NumericCleaner', 0.7), ('part', 'p_type', 'TextCleaner', 0.1),
  ('part', 'p_size', 'NumericCleaner', 0.7), ('part', 'p_retailprice', 'NumericCleaner', 1.0),
  ('documents', 'doc_id', 'NumericCleaner', 0.7), ('documents', 'text', 'TextCleaner', 0.8), ('documents', 'lang', 'TextCleaner', 0.1),
  ('documents', 'source', 'NumericCleaner', 0.7), ('documents', 'n_chars', 'NumericCleaner', 0.7)
) t(tab, col, cleaner, confidence)""",
)

# ---- clean() ---------------------------------------------------------------------------
NAME = text_sql(r"nullif(regexp_replace(c_name, '^[ ]+|[ ]+$', '', 'g'), '')").removesuffix(" AS cleaned")
SEGMENT = NAME.replace("c_name", "c_mktsegment")
ROUND = "round(c_acctbal::VARCHAR::DECIMAL(18,4), 3)::DOUBLE"
add(
    "clean_e2e",
    lambda spark, sf_dir: clean(table(spark, sf_dir, "customer"), use_global_config=False),
    f"""SELECT c_custkey AS c_cust_key, c_name, c_nationkey AS c_nation_key, c_acctbal AS c_acct_bal, c_mktsegment AS c_mkt_segment,
  c_custkey::DOUBLE AS c_cust_key_cleaned, {NAME} AS c_name_cleaned, c_nationkey::DOUBLE AS c_nation_key_cleaned, {ROUND} AS c_acct_bal_cleaned, {SEGMENT} AS c_mkt_segment_cleaned FROM customer""",
)
add("clean_explicit", lambda spark, sf_dir: clean(table(spark, sf_dir, "documents").select("doc_id", "text"), cleaners={"text": EmailCleaner(split_components=True)}, ignore_cols=["doc_id"], use_global_config=False).drop("text"), f"SELECT doc_id, nullif(lower(regexp_extract(text, '{MAIL}', 1)), '') AS text_local_cleaned, NULL::VARCHAR AS text_tag_cleaned, nullif(lower(regexp_extract(text, '{MAIL}', 2)), '') AS text_domain_cleaned FROM documents")
add("clean_ignore", lambda spark, sf_dir: clean(table(spark, sf_dir, "customer"), ignore_cols=["c_name", "c_mkt_segment", "c_acctbal"], use_global_config=False), "SELECT c_custkey AS c_cust_key, c_name, c_nationkey AS c_nation_key, c_acctbal AS c_acct_bal, c_mktsegment AS c_mkt_segment, c_custkey::DOUBLE AS c_cust_key_cleaned, c_nationkey::DOUBLE AS c_nation_key_cleaned FROM customer")
add("clean_rename_map", lambda spark, sf_dir: clean(table(spark, sf_dir, "nation"), rename_col_map={"n_name": "Title"}, clean_cols=False, use_global_config=False), 'SELECT n_nationkey AS n_nation_key, n_name AS "Title", n_regionkey AS n_region_key FROM nation')
add("clean_no_rename", lambda spark, sf_dir: clean(table(spark, sf_dir, "nation"), rename_cols=False, cleaners={"n_name": TextCleaner(remove_digits=True)}, ignore_cols=["n_nationkey", "n_regionkey"], use_global_config=False), "SELECT n_nationkey, n_name, n_regionkey, lower(regexp_replace(n_name, '[0-9]+', '', 'g')) AS n_name_cleaned FROM nation")
add("clean_inplace", lambda spark, sf_dir: clean(table(spark, sf_dir, "nation"), inplace=True, cleaners={"n_name": TextCleaner()}, use_global_config=False), "SELECT n_nationkey::DOUBLE AS n_nation_key, lower(n_name) AS n_name, n_regionkey::DOUBLE AS n_region_key FROM nation")
add("clean_plan", lambda spark, sf_dir: spark.createDataFrame([(c, type(k).__name__) for c, (k, _) in plan(table(spark, sf_dir, "orders"), use_global_config=False).assigned.items()], "col string, cleaner string"), "SELECT * FROM (VALUES ('o_order_key', 'NumericCleaner'), ('o_cust_key', 'NumericCleaner'), ('o_order_status', 'BoolCleaner'), ('o_total_price', 'NumericCleaner'), ('o_order_date', 'DateTimeCleaner'), ('o_order_priority', 'TextCleaner')) t(col, cleaner)")


# ---- functions, custom cleaners, streams, pipelines ---------------------------------------
def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, "clean_number", NumericCleaner())
    table(spark, sf_dir, "part").createOrReplaceTempView("burnish_part")
    return spark.sql("SELECT p_partkey, clean_number(concat('$ ', p_size)) AS cleaned FROM burnish_part")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    shared = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    out = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    options = {"cleaners": {"event_type": TextCleaner()}, "ignore_cols": [c for c in events.columns if c != "event_type"], "rename_cols": False, "use_global_config": False}
    clean_stream(source, f"{out}/data", f"{out}/checkpoint", **options).awaitTermination()
    return spark.read.parquet(f"{out}/data").select("event_id", "event_type_cleaned")


add("sql_function", sql_function, "SELECT p_partkey, p_size::DOUBLE AS cleaned FROM part")
add("udf_custom_cleaner", lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", PythonCleaner(fn=lambda v: v[::-1]).clean_expr("p_name").alias("cleaned")), "SELECT p_partkey, reverse(p_name) AS cleaned FROM part")
add("stream_clean", streamed, "SELECT event_id, lower(event_type) AS event_type_cleaned FROM events")
add("pipeline_waves", lambda spark, sf_dir: Pipeline({"key": ("c_custkey", NumericCleaner(out_format=NumberFormat.INT)), "segment": ("c_mktsegment", TextCleaner())}, (address(("segment", "key"), "label"),)).fit_transform(table(spark, sf_dir, "customer")).select("c_custkey", "label"), "SELECT c_custkey, lower(c_mktsegment) || ', ' || c_custkey AS label FROM customer")

# ---- further cleaners ----------------------------------------------------------------------
column("url", "pages", "page_id", UrlCleaner(), "url", "url AS cleaned")
column("url_split", "pages", "page_id", UrlCleaner(split_components=True), "url", r"regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_replace(regexp_extract(url, '://([^/:]+)', 1), '^www\.', '') AS domain, nullif(regexp_extract(url, '://[^/]+(/[^ ]*)', 1), '') AS path")


def picked(*values: str) -> Callable[[], Column]:
    return lambda: F.element_at(F.array(*map(F.lit, values)), (F.col("n_nationkey") % len(values) + 1).cast("int"))


def chosen(*values: str | None) -> str:
    return f"CASE n_nationkey % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values) if v) + " END AS cleaned"


for name, cleaner, given, meant in (
    ("currency", CurrencyCleaner(), ("₹ 1,500", "usd", "5 €", "shells"), ("INR", "USD", "EUR", None)),
    ("credit_card", CreditCardCleaner(), ("4111 1111 1111 1111", "4111111111111112", "none"), ("************1111", None, None)),
    ("mac_address", MacAddressCleaner(), ("00-1A-2B-3C-4D-5E", "001a.2b3c.4d5e", "zz"), ("00:1a:2b:3c:4d:5e", "00:1a:2b:3c:4d:5e", None)),
    ("language_code", LanguageCodeCleaner(), ("en-GB", "Deutsch", "spa", "xx"), ("en", "de", "es", None)),
    ("gstin", GstinCleaner(), ("27AAPFU0939F1ZV", "27AAPFU0939F1ZW"), ("27AAPFU0939F1ZV", None)),
    ("business", BusinessCleaner(), ("PRIVATELIMITED", "Pvt Ltd", "Sole Prop", "shop"), ("Private Limited", "Private Limited", "Sole Proprietorship", None)),
    ("scale", ScaleCleaner(), ("500", "SMALL", "5", "many"), ("large", "small", "micro", None)),
    ("address_line", AddressLineCleaner(), (" 7,, Mill Rd ,", "Block C, Unit 4"), ("7, Mill Road", "Block C, Unit 4")),
):
    column(name, "nation", "n_nationkey", cleaner, picked(*given), chosen(*meant))
